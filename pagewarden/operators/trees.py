"""Tree ensembles as a scorer: each tree becomes nested conditions over the features, and their sum a probability."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.operators.features import FEATURES
from pagewarden.operators.rules import feature


class Split(NamedTuple):
    """A node of a tree: the vector's index and the threshold below which a row goes left, else right; a leaf has a value alone."""

    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1
    value: float = 0.0


def _sql(tree: list[Split], at: int, columns: list[str] | None) -> str:
    node = tree[at]
    if node.feature < 0:
        return f"{float(node.value)!r}D"
    return f"CASE WHEN {feature(FEATURES[node.feature], columns)} < {float(node.threshold)!r}D THEN {_sql(tree, node.left, columns)} ELSE {_sql(tree, node.right, columns)} END"


def ensemble_score(trees: list[list[Split]], columns: list[str] | None = None, bias: float = 0.0) -> Column:
    """The logistic function of the trees' sum, from the features among some columns; each tree is a list of nodes from its root."""
    total = F.aggregate(F.expr(f"array({', '.join(_sql(t, 0, columns) for t in trees)})"), F.lit(float(bias)), lambda a, b: a + b) if trees else F.lit(float(bias))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
