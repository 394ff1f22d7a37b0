"""Counts of terms and brands in text, as expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.data.brands import Brand
from pagewarden.data.terms import URL_KEYWORDS
from pagewarden.functions.homoglyphs import fold, fold_text, relative_distance

#: A longer relative distance than this is no likeness.
LIKENESS = 0.4


def _sum(flags: list[Column]) -> Column:
    """How many of some conditions hold; a null holds for none. Added up in pairs, so the expression stays shallow."""
    terms = [flag.cast("int") for flag in flags]
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return F.coalesce(terms[0], F.lit(0)) if terms else F.lit(0)


def url_keyword_count(url: Column, keywords: list[str] = URL_KEYWORDS) -> Column:
    """Number of different keywords within a URL, in any case."""
    low = F.lower(url)
    return _sum([low.contains(k) for k in keywords])


def term_count(text: Column, terms: list[str], lowered: bool = False) -> Column:
    """Number of different terms in a text, in any case, with no letter or digit (a-z, 0-9) on either side.

    lowered says that the text is in lower case already, which spares a copy of it for each term.
    """
    low = text if lowered else F.lower(text)
    # the plain search decides most of them without a pattern
    return _sum([low.contains(t) & low.rlike(f"(?:^|[^a-z0-9]){re.escape(t)}(?:[^a-z0-9]|$)") for t in terms])


def word_list(words: list[str]) -> Column:
    """A constant array of words without spaces, as one literal."""
    return F.split(F.lit(" ".join(words)), " ")


def among(name: str, words: list[str]) -> Column:
    """Whether a column, by its SQL name, is one of some words; they become a hash set of the plan."""
    return F.expr(f"{name} IN ({', '.join(map(repr, words))})")


def term_counts(name: str, terms: list[str]) -> Column:
    """term_count() of a column by its SQL name, with its text in lower case already, as one piece of SQL."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    flags = [f"int(contains({name}, {quoted(t)}) AND {name} RLIKE {quoted(f'(?:^|[^a-z0-9]){re.escape(t)}(?:[^a-z0-9]|$)')})" for t in terms]
    while len(flags) > 1:
        flags = [f"({flags[i]} + {flags[i + 1]})" if i + 1 < len(flags) else flags[i] for i in range(0, len(flags), 2)]
    return F.expr(f"coalesce({flags[0]}, 0)")


def has_brand(text: Column, brands: list[Brand]) -> Column:
    """Whether any brand is in a text, after folding: as all of it, as one of its words, or (from five letters) anywhere."""
    folded = fold(text)
    tokens = sorted({b.folded for b in brands})
    long = [re.escape(t) for t in tokens if len(t) >= 5]
    split = [t for t in tokens if re.search("[^a-z0-9]", t)]  # these are no word of any text
    found = F.arrays_overlap(F.split(folded, "[^a-z0-9]+"), word_list(tokens))
    if split:
        found = found | F.array_contains(word_list(split), folded)
    if long:
        found = found | folded.rlike("|".join(long))
    return F.coalesce(found, F.lit(False))


def brand_table(brands: list[Brand]) -> Column:
    """The brands as a constant array of structs (token, folded, domains), in order."""
    import json

    rows = json.dumps([{"token": b.token, "folded": b.folded, "domains": list(b.domains)} for b in brands])
    return F.from_json(F.lit(rows), "array<struct<token string, folded string, domains array<string>>>")


def first_brand(text: Column, brands: list[Brand]) -> Column:
    """The first brand of the list that is in a text, as struct(token, folded, domains), or null."""
    folded = fold(text)
    words = F.split(folded, "[^a-z0-9]+")

    def present(b):
        token = b["folded"]
        return (folded == token) | F.array_contains(words, token) | ((F.length(token) >= 5) & folded.contains(token))

    return F.when(has_brand(text, brands), F.get(F.filter(brand_table(brands), present), F.lit(0)))


def lookalike(etld1: str, suffix: str, brands: list[Brand]) -> Column:
    """How near a registrable domain (its SQL name, and that of its suffix) comes to a brand's name: 0 for a brand's own domain, up to LIKENESS, else 1.

    The parts of the domain in front of its suffix are compared, as they are, with the folded names that
    start with the same folded letter. A part that equals such a name gives 0 on any domain.
    """
    own = sorted({d for b in brands for d in b.domains})
    by_first: dict[str, list[str]] = {}
    for b in brands:
        by_first.setdefault(b.folded[:1], []).append(b.folded)

    def nearest(name: str) -> float:
        best = 1.0
        for part in re.split("[-_]", name):
            if part == "" or re.fullmatch("[0-9]+", part):
                continue
            for token in by_first.get(fold_text(part)[:1], ()):
                if abs(len(part) - len(token)) / max(len(part), len(token)) <= LIKENESS:
                    best = min(best, relative_distance(part, token))
            if best == 0:
                break
        return best if best < LIKENESS else 1.0

    @F.pandas_udf("double")
    def udf(names: pd.Series) -> pd.Series:
        # a batch has few different domains
        codes, values = pd.factorize(names)
        found = [nearest(v) for v in values]
        return pd.Series([found[c] if c >= 0 else None for c in codes], dtype=float)

    listed, domain = among(etld1, own), F.col(etld1)
    n = F.length(domain) - F.length(F.coalesce(F.col(suffix), F.lit(""))) - 1
    name = F.when(listed, None).otherwise(F.when(n > 0, F.substring(domain, F.lit(1), n)).otherwise(domain))
    return F.when(domain.isNull(), 1.0).when(listed, 0.0).otherwise(F.coalesce(udf(name), F.lit(1.0)))
