"""Detection metrics of scores against labels (1 is positive), as DataFrames.

All of them start from counts for each different score, so rows are shuffled once and pre-aggregated.
Running totals are taken in two levels: within ranges of scores, and over the ranges' totals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEDIUM, HIGH = 0.35, 0.75
#: Ranges of scores that running totals are taken in.
RANGES = 1024


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """precision, recall, f1, fpr and accuracy; 0 where the denominator is."""
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": _ratio(2 * precision * recall, precision + recall), "fpr": _ratio(fp, fp + tn), "accuracy": _ratio(tp + tn, tp + fp + tn + fn)}


def confusion(df: DataFrame, thresholds: list[float], label: str = "label", score: str = "score") -> DataFrame:
    """One row for each threshold: threshold, tp, fp, tn, fn and the rates, to four places. One pass over df."""
    positive, sums = F.col(label) == 1, []
    for k, t in enumerate(thresholds):
        hit = F.col(score) >= F.lit(t)
        sums += [F.count_if(a & b).alias(f"{n}{k}") for n, a, b in (("tp", hit, positive), ("fp", hit, ~positive), ("tn", ~hit, ~positive), ("fn", ~hit, positive))]
    wide = df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{n}{k}").alias(n) for n in ("tp", "fp", "tn", "fn")]) for k, t in enumerate(thresholds)])
    out = wide.select(F.inline(rows))
    return out.withColumns({n: F.round(c, 4) for n, c in rates(*[F.col(n) for n in ("tp", "fp", "tn", "fn")]).items()})


def sweep_thresholds(steps: int = 21) -> list[float]:
    """Evenly spaced from 0 to 1."""
    return [k * (1 / (steps - 1)) for k in range(steps - 1)] + [1.0]


def threshold_sweep(df: DataFrame, steps: int = 21, label: str = "label", score: str = "score") -> DataFrame:
    out = confusion(df, sweep_thresholds(steps), label, score)
    return out.select(F.round("threshold", 2).alias("threshold"), "precision", "recall", "fpr")


def cumulative(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row for each different score: s, pos, neg, and tp, fp: the positives and negatives at s or above; n_pos, n_neg: all."""
    by_score = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    by_score = by_score.withColumn("range", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "s")) * RANGES).cast("int"))
    totals = by_score.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # RANGES + 1 rows at most
    whole = Window.partitionBy(F.lit(0))
    totals = totals.select("range", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p_above"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"), F.sum("p").over(whole).alias("n_pos"), F.sum("n").over(whole).alias("n_neg"))
    within = Window.partitionBy("range").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    joined = by_score.join(F.broadcast(totals), "range")
    return joined.select("s", "pos", "neg", (F.col("p_above") + F.sum("pos").over(within)).alias("tp"), (F.col("n_above") + F.sum("neg").over(within)).alias("fp"), "n_pos", "n_neg", "range")


def ranking_metrics(df: DataFrame, target: float = 0.95, label: str = "label", score: str = "score") -> DataFrame:
    """One row: n, n_positive, n_negative, roc_auc, pr_auc (null with one class only), fpr_at_recall (null without positives), to four places.

    roc_auc counts ties as one half. pr_auc is the average precision, a sum of steps. fpr_at_recall is
    that of the highest score whose recall reaches the target.
    """
    c = cumulative(df, label, score)
    both = (F.col("p") > 0) & (F.col("q") > 0)
    out = c.agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("q"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"),
        F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("steps"),
        F.max(F.when(F.col("tp") >= 0, F.when((F.col("n_pos") > 0) & (F.col("tp") / F.col("n_pos") >= target), F.struct("s", "fp")))).alias("at"),
    )
    fpr = F.when(F.col("p") > 0, F.round(_ratio(F.col("at.fp"), F.col("q")), 4))
    return out.select(
        F.coalesce(F.col("p") + F.col("q"), F.lit(0)).alias("n"), F.coalesce("p", F.lit(0)).alias("n_positive"), F.coalesce("q", F.lit(0)).alias("n_negative"),
        F.when(both, F.round(F.col("area") / (F.col("p") * F.col("q")), 4)).alias("roc_auc"), F.when(both, F.round(F.col("steps") / F.col("p"), 4)).alias("pr_auc"), fpr.alias("fpr_at_recall"),
    )


def summarize(df: DataFrame, label: str = "label", score: str = "score", extra: dict[str, Callable[[Column, Column], Column]] | None = None) -> dict:
    """All metrics as one dict; a few dozen numbers come to the driver.

    extra has further metrics by name: functions of the label and the score that give an aggregate. Like
    the others, a metric of two classes is None where there is one only.
    """
    ranking = ranking_metrics(df, 0.95, label, score).first()
    points = [r.asDict() for r in confusion(df, [MEDIUM, HIGH], label, score).orderBy("threshold").collect()]
    at = [{k: v for k, v in p.items() if k != "threshold"} for p in points]
    own = df.agg(*[f(F.col(label), F.col(score)).alias(k) for k, f in extra.items()]).first().asDict() if extra else {}
    if not (ranking["n_positive"] and ranking["n_negative"]):
        own = dict.fromkeys(own)
    return own | {
        "n": ranking["n"], "n_phishing": ranking["n_positive"], "n_benign": ranking["n_negative"], "roc_auc": ranking["roc_auc"], "pr_auc": ranking["pr_auc"],
        "fpr_at_recall_95": ranking["fpr_at_recall"], "at_medium": at[0], "at_high": at[1], "sweep": [r.asDict() for r in threshold_sweep(df, 21, label, score).orderBy("threshold").collect()],
    }


def passes_gate(summary: dict, least_recall: float = 0.9, most_fpr: float = 0.1) -> bool:
    """Whether the medium operating point is good enough."""
    return summary["at_medium"]["recall"] >= least_recall and summary["at_medium"]["fpr"] <= most_fpr


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row for each group: the keys, n, and for each name the value at an index (from 0, ascending, a function of n).

    Null values are left out. Counts for each different value are ordered within ranges between a group's
    smallest and largest value, so no list of values is made and no task orders a whole group.
    """
    rows = df.select(*keys, F.col(value).alias("__v")).filter("__v IS NOT NULL").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))

    def matched(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        """left with right's other columns, where the named ones are the same, nulls included."""
        other = right.withColumnsRenamed({c: f"__r_{c}" for c in names})
        return left.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in names], F.lit(True))).drop(*[f"__r_{c}" for c in names])

    rows = matched(rows, rows.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.sum("__c").alias("n")), keys)
    share = (F.col("__v") - F.col("__low")) / F.when(F.col("__high") > F.col("__low"), F.col("__high") - F.col("__low"))
    rows = rows.withColumn("__range", F.coalesce((share * RANGES).cast("int"), F.lit(0))).drop("__low", "__high")
    below = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES + 1 rows of a group
    ranges = rows.groupBy(*keys, "__range", "n").agg(F.sum("__c").alias("__in")).withColumn("__before", F.coalesce(F.sum("__in").over(below), F.lit(0)))
    for name, place in places.items():
        at = place(F.col("n"))
        ranges = ranges.withColumn(f"__at_{name}", F.when((at >= F.col("__before")) & (at < F.col("__before") + F.col("__in")), at - F.col("__before")))
    wanted = ranges.filter(F.coalesce(*[f"__at_{name}" for name in places]).isNotNull()).drop("__in", "__before", "n")
    some = matched(rows, wanted, [*keys, "__range"]).withColumn("__upto", F.sum("__c").over(Window.partitionBy(*keys, "__range").orderBy("__v")))
    hit = lambda name: (F.col(f"__at_{name}") < F.col("__upto")) & (F.col(f"__at_{name}") >= F.col("__upto") - F.col("__c"))
    return some.groupBy(*keys, "n").agg(*[F.max(F.when(hit(name), F.col("__v"))).alias(name) for name in places])


def floor_index(percent: float) -> Callable[[Column], Column]:
    """The index floor(percent / 100 * n), or the last one: what a floor percentile is read at."""
    return lambda n: F.least(n - 1, F.floor(F.lit(percent) / 100 * n))


def floor_percentiles(df: DataFrame, keys: list[str], value: str, percent: float) -> DataFrame:
    """One row for each group: the keys, percentile (at the floor index) and median (of the middle two)."""
    found = order_statistics(df, keys, value, {"percentile": floor_index(percent), "__a": lambda n: F.floor((n - 1) / 2), "__b": lambda n: F.floor(n / 2)})
    return found.select(*keys, "percentile", ((F.col("__a") + F.col("__b")) / 2).alias("median"))
