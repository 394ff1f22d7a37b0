"""The brand table: what a brand is called and which registrable domains are its own.

The table is a parameter of everything that uses it. The one built in has two hundred brands; a longer one
comes from a file, a JSON list of objects with token and etld1s: brands_from_json() reads its text, and
spark.pagewarden.brands names it to the registered queries, --brands to the commands.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pagewarden.functions.homoglyphs import fold_text


class Brand(NamedTuple):
    token: str
    domains: tuple[str, ...]

    @property
    def folded(self) -> str:
        return fold_text(self.token)


# Brands in order of precedence, each with its domains.
_BRANDS = """
google google.com google.co.nz google.co.uk google.com.au goo.gl
gmail gmail.com google.com
youtube youtube.com youtu.be
microsoft microsoft.com microsoftonline.com live.com office.com office365.com outlook.com
outlook outlook.com office.com microsoft.com
office office.com office365.com microsoft.com
office365 office365.com office.com microsoft.com
hotmail hotmail.com outlook.com live.com
azure azure.com microsoft.com windows.net
onedrive onedrive.com microsoft.com live.com
apple apple.com icloud.com
icloud icloud.com apple.com
itunes apple.com itunes.com
amazon amazon.com amazon.co.uk amazon.com.au amazon.ca amazon.de
aws aws.amazon.com amazon.com
facebook facebook.com fb.com meta.com
messenger messenger.com facebook.com
instagram instagram.com facebook.com
whatsapp whatsapp.com facebook.com
meta meta.com facebook.com
netflix netflix.com
linkedin linkedin.com lnkd.in
twitter twitter.com x.com t.co
dropbox dropbox.com dropboxusercontent.com
adobe adobe.com
docusign docusign.com docusign.net
zoom zoom.us zoom.com
slack slack.com
salesforce salesforce.com force.com
github github.com githubusercontent.com github.io
gitlab gitlab.com
spotify spotify.com
steam steampowered.com steamcommunity.com
discord discord.com discord.gg
telegram telegram.org t.me
tiktok tiktok.com
snapchat snapchat.com
reddit reddit.com redd.it
pinterest pinterest.com pin.it
ebay ebay.com ebay.co.uk ebay.com.au
walmart walmart.com
target target.com
bestbuy bestbuy.com
costco costco.com
aliexpress aliexpress.com
alibaba alibaba.com
fedex fedex.com
dhl dhl.com dhl.de
ups ups.com
usps usps.com
nzpost nzpost.co.nz
aramex aramex.com
dpd dpd.com dpd.co.uk
evri evri.com myhermes.co.uk
royalmail royalmail.com
chase chase.com
bankofamerica bankofamerica.com bofa.com
wellsfargo wellsfargo.com
citibank citibank.com citi.com
capitalone capitalone.com
americanexpress americanexpress.com amex.com
discover discover.com
hsbc hsbc.com hsbc.co.uk hsbc.com.au
barclays barclays.co.uk barclays.com
lloyds lloydsbank.com lloydsbank.co.uk
natwest natwest.com
santander santander.com santander.co.uk
deutschebank deutschebank.de db.com
ing ing.com ing.nl ing.com.au
paypal paypal.com paypal.me paypal.com.au
venmo venmo.com paypal.com
cashapp cash.app square.com
revolut revolut.com
wise wise.com transferwise.com
stripe stripe.com
square square.com squareup.com
coinbase coinbase.com
binance binance.com
kraken kraken.com
metamask metamask.io
bitcoin bitcoin.org
ethereum ethereum.org
robinhood robinhood.com
fidelity fidelity.com
schwab schwab.com
vanguard vanguard.com
xero xero.com xero.co.nz xero.com.au
myob myob.com myob.com.au myob.co.nz
quickbooks quickbooks.intuit.com intuit.com
intuit intuit.com
sage sage.com sage.co.uk
turbotax turbotax.intuit.com intuit.com
hnry hnry.co.nz
ato ato.gov.au
ird ird.govt.nz
realme realme.govt.nz realmeglobal.co.nz
kiwibank kiwibank.co.nz
anz anz.co.nz anz.com.au anz.com
asb asb.co.nz
bnz bnz.co.nz
westpac westpac.co.nz westpac.com.au
tsb tsb.co.nz tsb.co.uk
heartland heartland.co.nz heartlandbank.com.au
rabobank rabobank.co.nz rabobank.com.au rabobank.com
cooperativebank co-operativebank.co.nz
bankwest bankwest.com.au
commbank commbank.com.au netbank.com.au
nab nab.com.au
stgeorge stgeorge.com.au
macquarie macquarie.com.au macquarie.com
bendigo bendigobank.com.au
adelaidebank adelaidebank.com.au
ubank ubank.com.au
afterpay afterpay.com afterpay.com.au
zippay zip.co zipmoney.com.au
latitude latitude.com.au latitudefinancial.com
humm humm.com.au hummgroup.com
trade trademe.co.nz
trademe trademe.co.nz
spark spark.co.nz sparknz.co.nz
one one.nz vodafone.co.nz
vodafone vodafone.co.nz vodafone.com.au vodafone.com
2degrees 2degrees.nz
skinny skinny.co.nz
chorus chorus.co.nz
telstra telstra.com.au telstra.com
optus optus.com.au
tpg tpg.com.au tpgtelecom.com.au
vocus vocus.com.au vocusgroup.com.au
okta okta.com oktapreview.com
auth0 auth0.com
onelogin onelogin.com
pingidentity pingidentity.com pingone.com
duo duosecurity.com duo.com
cloudflare cloudflare.com cloudflareaccess.com
vercel vercel.com vercel.app
netlify netlify.com netlify.app
heroku heroku.com herokuapp.com
digitalocean digitalocean.com
godaddy godaddy.com
namecheap namecheap.com
squarespace squarespace.com
wix wix.com wixsite.com
shopify shopify.com myshopify.com
bigcommerce bigcommerce.com mybigcommerce.com
woocommerce woocommerce.com
magento magento.com adobe.com
prestashop prestashop.com
mit mit.edu
harvard harvard.edu
stanford stanford.edu
oxford ox.ac.uk
cambridge cam.ac.uk
auckland auckland.ac.nz
otago otago.ac.nz
canterbury canterbury.ac.nz
victoria victoria.ac.nz wgtn.ac.nz
waikato waikato.ac.nz
massey massey.ac.nz
aut aut.ac.nz
monash monash.edu monash.edu.au
unimelb unimelb.edu.au
usyd sydney.edu.au
unsw unsw.edu.au
uq uq.edu.au
adelaide adelaide.edu.au
anu anu.edu.au
airnewzealand airnewzealand.co.nz airnewzealand.com
qantas qantas.com
jetstar jetstar.com
airbnb airbnb.com airbnb.co.nz
booking booking.com
expedia expedia.com expedia.co.nz
uber uber.com
lyft lyft.com
doordash doordash.com
ubereats ubereats.com uber.com
menulog menulog.co.nz menulog.com.au
hellofresh hellofresh.com hellofresh.co.nz
countdown countdown.co.nz woolworths.co.nz
woolworths woolworths.co.nz woolworths.com.au
paknsave paknsave.co.nz
newworld newworld.co.nz
mitre10 mitre10.co.nz
thewarehouse thewarehouse.co.nz
farmers farmers.co.nz
briscoes briscoes.co.nz
rebel rebel.co.nz rebelsport.com.au
noel noelleeming.co.nz
jb jbhifi.co.nz jbhifi.com.au
harveynorman harveynorman.co.nz harveynorman.com.au
kogan kogan.com
temu temu.com
shein shein.com
etsy etsy.com
shopee shopee.com shopee.sg
lazada lazada.com
rakuten rakuten.com rakuten.co.jp
yahoo yahoo.com yahoo.co.jp yahoo.co.nz
bing bing.com microsoft.com
"""

BRANDS = [Brand(token, tuple(domains)) for token, *domains in map(str.split, _BRANDS.strip().splitlines())]


def brands_from_json(text: str) -> list[Brand]:
    """Brands from a JSON list of objects with token and etld1s, in order of precedence."""
    return [Brand(row["token"], tuple(row["etld1s"])) for row in json.loads(text)]
