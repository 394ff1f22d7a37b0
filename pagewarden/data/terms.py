"""Word lists and small lookup tables that define the signals."""

# URL keywords.
URL_KEYWORDS = (
    "login log-in signin sign-in verify verification secure security account update confirm wallet invoice suspended password credential billing payment auth authenticate"
    " session unlock alert recovery reset webscr cmd ebayisapi appleid icloud office365 onedrive sharepoint outlook webmail support customer validation authentication"
    " l0gin secur3 acc0unt upd4te verif1cation passw0rd"
).split()

# Phrases of urgency, of credentials and of money in page text.
URGENCY_TERMS = [
    "verify now", "verify your account", "suspended", "within 24 hours", "within 48 hours", "unusual activity", "unusual sign-in", "immediate action", "act now", "limited time",
    "expires", "final notice", "final warning", "account will be closed", "confirm immediately", "security alert", "unauthorized", "locked", "restricted", "failure to",
    "last warning", "avoid suspension", "time sensitive", "respond immediately", "action required", "click here", "update now", "validate now", "suspicious activity", "unrecognized device",
    "payment failed", "declined", "overdue", "immediately", "as soon as possible", "urgent", "important notice", "your attention is required", "do not ignore", "will be deactivated",
]
CREDENTIAL_TERMS = [
    "password", "passw0rd", "pin", "one-time code", "one time code", "otp", "security question", "username", "user id", "login", "sign in", "passcode", "verification code", "2fa",
    "two-factor", "mfa", "secret question", "mother's maiden name", "date of birth", "social security", "ssn", "account number", "card number", "cvv", "cvc", "expiry", "sort code",
    "routing number", "tax file number", "ird number", "access code", "recovery phrase", "seed phrase", "private key", "re-enter password", "current password",
]
FINANCIAL_TERMS = [
    "bank", "card", "payment", "invoice", "refund", "transfer", "wire", "billing", "credit", "debit", "balance", "statement", "transaction", "deposit", "withdrawal", "loan", "mortgage",
    "tax", "irs", "ird", "ato", "payroll", "salary", "remittance", "beneficiary", "iban", "swift", "bpay", "polipay", "direct debit", "overdue", "outstanding", "amount due", "purchase",
    "subscription", "charge",
]

# Domains of URL shorteners.
SHORTENERS = (
    "bit.ly t.co tinyurl.com goo.gl ow.ly buff.ly is.gd v.gd rebrand.ly cutt.ly shorturl.at rb.gy lnkd.in youtu.be amzn.to amzn.eu ebay.to t.ly short.link bit.do mcaf.ee soo.gd s2r.co"
    " clicky.me budurl.com bc.vc su.pr twurl.nl snipurl.com tiny.cc url4.eu tr.im adf.ly sh.st q.gs u.to zpr.io clck.ru vk.cc db.tt goo.su x.co s.id rlu.ru ht.ly dlvr.it ift.tt trib.al"
    " po.st spoti.fi apple.co wapo.st nyti.ms cnb.cx reut.rs"
).split()

# Risk of a public suffix; any other has 0.
TLD_RISK = {
    "com": 0.0, "org": 0.0, "net": 0.0, "edu": 0.0, "gov": 0.0, "mil": 0.0, "int": 0.0, "nz": 0.0, "au": 0.0, "uk": 0.0, "co.uk": 0.0, "co.nz": 0.0, "net.nz": 0.0,
    "org.nz": 0.0, "govt.nz": 0.0, "ac.nz": 0.0, "ca": 0.0, "de": 0.0, "fr": 0.0, "jp": 0.0, "nl": 0.0, "se": 0.0, "no": 0.0, "dk": 0.0, "fi": 0.0, "ie": 0.0, "ch": 0.0,
    "at": 0.0, "be": 0.0, "es": 0.0, "it": 0.0, "us": 0.0, "io": 0.05, "co": 0.1, "app": 0.05, "dev": 0.05, "ai": 0.1, "info": 0.2, "biz": 0.25, "online": 0.35,
    "site": 0.35, "website": 0.4, "space": 0.4, "store": 0.3, "shop": 0.3, "cloud": 0.25, "live": 0.3, "life": 0.3, "world": 0.3, "today": 0.35, "icu": 0.6, "xyz": 0.6,
    "top": 0.7, "zip": 0.9, "mov": 0.8, "cyou": 0.75, "sbs": 0.75, "cfd": 0.75, "monster": 0.7, "quest": 0.7, "buzz": 0.6, "click": 0.7, "link": 0.6, "work": 0.7,
    "rest": 0.6, "fit": 0.6, "loan": 0.8, "download": 0.8, "stream": 0.7, "racing": 0.7, "win": 0.75, "bid": 0.7, "review": 0.65, "country": 0.6, "kim": 0.7,
    "cricket": 0.6, "science": 0.5, "party": 0.6, "gdn": 0.65, "men": 0.65, "date": 0.7, "faith": 0.65, "accountant": 0.6, "ren": 0.6, "mom": 0.6, "lol": 0.6,
    "surf": 0.6, "bar": 0.6, "beauty": 0.6, "best": 0.5, "casa": 0.5, "homes": 0.5, "makeup": 0.6, "skin": 0.6, "spa": 0.5, "uno": 0.5, "wiki": 0.4, "tk": 0.9, "ml": 0.9,
    "ga": 0.9, "cf": 0.9, "gq": 0.9, "pw": 0.8, "cc": 0.5, "to": 0.5, "ws": 0.6, "su": 0.7, "ru": 0.3, "cn": 0.3,
}

# The main language of a country's pages, by the country's suffix.
LANGUAGE_OF_TLD = {
    "nz": "en", "au": "en", "uk": "en", "ie": "en", "us": "en", "ca": "en", "za": "en", "in": "en", "sg": "en", "de": "de", "at": "de", "fr": "fr", "be": "nl",
    "nl": "nl", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "it": "it", "pt": "pt", "br": "pt", "jp": "ja", "cn": "zh", "tw": "zh", "hk": "zh",
    "kr": "ko", "ru": "ru", "pl": "pl", "cz": "cs", "hu": "hu", "ro": "ro", "gr": "el", "tr": "tr", "se": "sv", "no": "no", "dk": "da", "fi": "fi", "th": "th",
    "vn": "vi", "id": "id", "il": "he", "sa": "ar", "ae": "ar", "eg": "ar",
}

# Public suffixes of more than one label, and those run by private parties. A parameter wherever hosts are split.
PUBLIC_SUFFIXES = "co.nz net.nz org.nz govt.nz ac.nz geek.nz school.nz com.au net.au org.au edu.au gov.au co.uk org.uk ac.uk gov.uk co.jp com.br com.cn com.mx com.sg co.in co.kr co.za com.tr com.tw com.hk".split()
PRIVATE_SUFFIXES = "github.io vercel.app netlify.app herokuapp.com pages.dev web.app firebaseapp.com blogspot.com cloudfront.net windows.net myshopify.com wixsite.com".split()

# Parked pages, as case-insensitive patterns.
PARKED_PATTERNS = ["this domain is for sale", "buy this domain", r"domain (?:is )?parked", r"parked (?:free )?(?:by|at)", "sedoparking", "afternic", "hugedomains", r"dan\.com", r"domain(?:s)? for sale", "the owner of this domain", r"godaddy\.com/domainsearch"]

# Characters that look like a letter, and pairs that look like one, in the order they are replaced.
LOOKALIKE_CHARACTERS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "ѕ": "s", "ј": "j", "і": "i", "ԁ": "d", "ν": "v", "ı": "i"}  # noqa: RUF001
LOOKALIKE_PAIRS = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "n"), ("nn", "m")]
