"""Folding of characters that look alike, and edit distance."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.data.terms import LOOKALIKE_CHARACTERS, LOOKALIKE_PAIRS

_TABLE = str.maketrans(LOOKALIKE_CHARACTERS)


def fold_text(text: str) -> str:
    out = text.lower().translate(_TABLE)
    for pair, letter in LOOKALIKE_PAIRS:
        out = out.replace(pair, letter)
    return out


def fold(col: Column) -> Column:
    """fold_text() as an expression."""
    out = F.translate(F.lower(col), "".join(LOOKALIKE_CHARACTERS), "".join(LOOKALIKE_CHARACTERS.values()))
    for pair, letter in LOOKALIKE_PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return out


@lru_cache(65536)
def alignment_distance(a: str, b: str) -> int:
    """Edits to align two strings: insert, delete, replace, or swap two neighbours that stay untouched after."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            options = [rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)]
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                options.append(rows[-2][j - 2] + 1)
            row.append(min(options))
        rows.append(row)
    return rows[-1][-1]


def relative_distance(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return alignment_distance(a, b) / longest if longest else 0.0
