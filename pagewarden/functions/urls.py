"""A URL column as a struct of its parts, or null for what can't be scored.

URLs of the common shape are taken apart by expressions. Those that the standard would change (escapes to
add, dot segments, user names, names with other letters, odd numbers) go to a Python parser, which gets
null for all others; pass general=False to leave it out where the table is known to be clean.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.functions import hosts, whatwg
from pagewarden.functions.hosts import DEFAULT_RULES, SuffixRules

_PIECES = "scheme string, host string, port string, path string, search string"
# Host names of letters, digits, hyphens and underscores that don't end in a number, or plain dotted quads.
_NAME = r"(?:[A-Za-z0-9_-]+\.)*[A-Za-z0-9_-]*[A-Za-z_-][A-Za-z0-9_-]*\.*"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_COMMON = rf"^(?i:(https?))://({_NAME}|(?:{_OCTET}\.){{3}}{_OCTET})(?::([1-9][0-9]{{0,3}}|[1-5][0-9]{{4}}))?((?:/[A-Za-z0-9._~!$&'()*+,;=:@%|\[\]-]*)*)(\?[A-Za-z0-9._~!$&()*+,;=:@%/?|^`{{}}\[\]\\-]*)?(?:#.*)?$"
# Segments of dots, also when escaped; a scheme without a host can't match _COMMON in the first place.
_DOTS = r"(?i)/(?:\.|%2e){1,2}(?:/|\?|#|$)"
_BLANK = r"[\x00-\x20]"


def _slow(urls: pd.Series) -> pd.DataFrame:
    rows = []
    for url in urls:
        u = whatwg.parse(url) if url is not None else None
        rows.append((u.scheme, u.host, u.port, u.path, u.search) if u else (None,) * 5)
    return pd.DataFrame(rows, columns=["scheme", "host", "port", "path", "search"])


def _groups(url: Column) -> Column:
    """The groups of a URL of the common shape as an array, taken in one match; null for any other."""
    # a URL that doesn't match stays as it is, and without control characters it is one piece then
    found = F.split(F.regexp_replace(url, _COMMON, "\x01".join(f"${k}" for k in range(1, 6))), "\x01")
    return F.when(~url.rlike(_BLANK) & (F.size(found) == 5) & ~url.rlike(_DOTS), found)


def _common(groups: Column) -> Column:
    """struct(scheme, host, port, path, search) from the groups."""
    get = lambda k: F.get(groups, F.lit(k))
    scheme, port = F.lower(get(0)), get(2)
    port = F.when(((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(port)
    search = F.when(get(4) == "?", "").otherwise(get(4))
    return F.struct(scheme.alias("scheme"), F.lower(get(1)).alias("host"), port.alias("port"), F.when(get(3) == "", "/").otherwise(get(3)).alias("path"), search.alias("search"))


def _parsed(url: Column, groups: Column) -> Column:
    """The same for URLs without groups, or null; a null struct comes back from Python as a struct of nulls."""
    # marked as it is to stay out of the inputs of other Python functions, into which it would be copied many times
    slow = F.pandas_udf(_slow, _PIECES).asNondeterministic()(F.when(groups.isNull(), url))
    return F.when(slow["host"].isNotNull(), slow)


def with_url_parts(df, url_col: str = "url", to: str = "parts", rules: SuffixRules = DEFAULT_RULES, general: bool = True):
    """df with a struct column: scheme, host, port, path, search, suffix, etld1, labels (left of etld1), is_ip, is_punycode.

    The struct is null for a URL that can't be scored: other schemes, no URL at all, an empty host. IP
    addresses have no suffix and are their own etld1; a host that is only a suffix has none.
    """
    t = f"__{to}"
    df = df.withColumn(f"{t}g", _groups(F.col(url_col)))
    groups = F.col(f"{t}g")
    df = df.withColumn(t, F.when(groups.isNotNull(), _common(groups)).otherwise(_parsed(F.col(url_col), groups)) if general else F.when(groups.isNotNull(), _common(groups)))
    host = F.regexp_replace(F.col(f"{t}.host"), r"\.+$", "")
    df = df.withColumn(f"{t}h", F.when(host != "", host))
    host = F.col(f"{t}h")
    df = df.withColumn(f"{t}ip", hosts.ip_host(host)).withColumn(f"{t}s", F.when(~F.col(f"{t}ip"), hosts.suffix(host, rules)))
    df = df.withColumn(f"{t}e", F.when(F.col(f"{t}ip"), host).otherwise(hosts.registrable(host, F.col(f"{t}s"))))
    n = F.length(host) - F.length(f"{t}e") - 1
    labels = F.when(~F.col(f"{t}ip") & (n > 0), F.split(F.substring(host, F.lit(1), n), r"\.")).otherwise(F.array().cast("array<string>"))
    parts = F.struct(*[F.col(f"{t}.{c}").alias(c) if c != "host" else host.alias(c) for c in ("scheme", "host", "port", "path", "search")], F.col(f"{t}s").alias("suffix"), F.col(f"{t}e").alias("etld1"), labels.alias("labels"), F.col(f"{t}ip").alias("is_ip"), host.contains("xn--").alias("is_punycode"))
    return df.withColumn(to, F.when(host.isNotNull(), parts)).drop(t, f"{t}g", f"{t}h", f"{t}ip", f"{t}s", f"{t}e")


def feed_url(raw: Column, keep_port: bool = True) -> Column:
    """A feed's URL in canonical form, or null: no user name, fragment or default port (or no port at all), scheme and host in lower case."""
    text = F.trim(raw)
    pattern = r"^(?i:(https?))://([^/?#]+)([^?#]*)(?:\?([^#]*))?"
    get = lambda k: F.regexp_extract(text, pattern, k)
    scheme, authority, path, query = F.lower(get(1)), F.regexp_replace(get(2), "^.*@", ""), get(3), get(4)
    host = F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(authority, r"^(?:\[[^\]]*\]|[^:]*):(\d+)$", 1).try_cast("int")
    other = port.isNotNull() & ~(((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443)))
    sound = text.rlike(pattern) & (host != "") & authority.rlike(r"^(\[[^\]]*\]|[^:]*)(:\d*)?$") & (port.isNull() | (port <= 65535))
    host = F.regexp_replace(host, r"^\[(.*)\]$", "$1") if not keep_port else host
    tail = F.concat(F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    shown = F.when(other, F.concat(F.lit(":"), port.cast("string"))).otherwise("") if keep_port else F.lit("")
    return F.when(sound, F.concat(scheme, F.lit("://"), host, shown, tail))


def typed_url(raw: Column) -> Column:
    """What a user typed as a full address: https unless a scheme is given; null if it isn't a URL."""

    @F.pandas_udf("string")
    def href(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: u.href if t is not None and (u := whatwg.parse(t)) else None)

    text = F.trim(raw)
    return href(F.when(text != "", F.when(text.rlike("^(?i:https?)://"), text).otherwise(F.concat(F.lit("https://"), text))))
