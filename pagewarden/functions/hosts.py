"""Public suffixes and registrable domains of hosts, in Python and as expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.data.terms import LANGUAGE_OF_TLD, PRIVATE_SUFFIXES, PUBLIC_SUFFIXES, TLD_RISK


@dataclass(frozen=True)
class SuffixRules:
    """Suffixes of more than one label, as rules of a public suffix list: plain names, *.name, and !name for exceptions.

    Any other last label is a suffix by itself; in strict mode only if it is listed in top.
    """

    public: frozenset[str] = frozenset(PUBLIC_SUFFIXES)
    private: frozenset[str] = frozenset(PRIVATE_SUFFIXES)
    top: frozenset[str] = field(default=frozenset(t.split(".")[-1] for t in [*TLD_RISK, *LANGUAGE_OF_TLD, *PUBLIC_SUFFIXES]))

    @classmethod
    def from_list(cls, text: str) -> SuffixRules:
        """The rules of a public suffix list: one in a line, // before comments, private ones behind the mark of their section."""
        rules: dict[bool, set[str]] = {False: set(), True: set()}
        private = False
        for line in text.splitlines():
            rule = line.strip().split(" ")[0].lower()
            if line.startswith("//"):
                private = (private or "===BEGIN PRIVATE" in line) and "===END PRIVATE" not in line
            elif rule:
                rules[private].add(rule if rule.isascii() else ".".join(x if x.isascii() else x.encode("idna").decode() for x in rule.split(".")))
        return cls(frozenset(r for r in rules[False] if "." in r), frozenset(rules[True]), frozenset(r.lstrip("!*.").split(".")[-1] for r in rules[False]))

    @cached_property
    def _every(self) -> frozenset[str]:
        return self.public | self.private

    def rules(self, with_private: bool = True) -> frozenset[str]:
        return self._every if with_private else self.public

    def suffix_of(self, host: str, with_private: bool = True) -> str:
        known, found, tail = self.rules(with_private), "", host
        while tail:
            rest = tail.partition(".")[2]
            if "!" + tail in known:
                return rest
            if not found and (tail in known or (rest and "*." + rest in known)):
                found = tail
            tail = rest
        return found or host.rpartition(".")[2]

    def registrable(self, host: str, with_private: bool = True, strict: bool = False) -> str | None:
        """The suffix with one more label; None if the host has no more, or (strict) if its top label isn't listed."""
        if is_ip_host(host):
            return None if strict else host
        suffix = self.suffix_of(host, with_private)
        if host == suffix or not host.endswith("." + suffix) or (strict and suffix.split(".")[-1] not in self.top):
            return None
        own = host[: -len(suffix) - 1].split(".")[-1]
        return f"{own}.{suffix}" if own else None


DEFAULT_RULES = SuffixRules()


def is_ip_host(host: str) -> bool:
    inner = host[1:-1] if host.startswith("[") and host.endswith("]") else host
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", inner):
        return all(int(x) <= 255 for x in inner.split("."))
    return inner != host and bool(re.fullmatch(r"[0-9a-fA-F:.]*:[0-9a-fA-F:.]*", inner))


def ip_host(host: Column) -> Column:
    """is_ip_host() as an expression."""
    quad = host.rlike(r"^\[?\d{1,3}(\.\d{1,3}){3}\]?$") & (host.startswith("[") == host.endswith("]"))
    small = F.forall(F.split(F.regexp_replace(host, r"[\[\]]", ""), r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    return (quad & small) | host.rlike(r"^\[[0-9a-fA-F:.]*:[0-9a-fA-F:.]*\]$")


def suffix(host: Column, rules: SuffixRules = DEFAULT_RULES, with_private: bool = True) -> Column:
    """The public suffix of a host name: the longest one that a rule names, else the last label."""
    tail = lambda n: F.substring_index(host, ".", -n)
    plain: dict[int, list[str]] = {}
    wild: dict[int, list[str]] = {}
    kept: dict[int, list[str]] = {}
    for r in sorted(rules.rules(with_private)):
        group, name = (kept, r[1:]) if r[0] == "!" else (wild, r[2:]) if r[:2] == "*." else (plain, r)
        group.setdefault(r.count(".") + 1, []).append(name)
    out = tail(1)
    for n in sorted({*plain, *wild} - {1}):
        fits = [tail(n).isin(plain[n])] if n in plain else []
        if n in wild:
            fits.append(tail(n - 1).isin(wild[n]) & (tail(n) != tail(n - 1)))
        out = F.when(fits[0] | fits[-1], tail(n)).otherwise(out)
    for n, names in sorted(kept.items()):
        out = F.when(tail(n).isin(names), tail(n - 1)).otherwise(out)
    return out


def registrable(host: Column, suffix_col: Column) -> Column:
    """Suffix and one more label; null if there is none."""
    n = F.length(host) - F.length(suffix_col) - 1
    own = F.substring_index(F.substring(host, F.lit(1), n), ".", -1)
    return F.when((n > 0) & (own != ""), F.concat(own, F.lit("."), suffix_col))
