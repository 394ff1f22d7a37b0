"""Evaluation: score labelled pages, join scores to labels by URL, and sum up."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.operators import metrics
from pagewarden.operators.verdicts import Settings, score_pages


def score_records(pages: DataFrame, settings: Settings = Settings(), **options) -> DataFrame:
    """url, features, stage1, stage2, final, warnings, error of pages (url, html); error is set where there is no score."""
    return score_pages(pages.select("url", "html"), settings=settings, **options).select("url", "features", "stage1", "stage2", "final", "warnings", "error")


def joined_scores(rows: DataFrame, records: DataFrame, order: list[str]) -> DataFrame:
    """Labelled rows with the last record of their URL: label, score, level, error.

    order names the columns of records that tell which of a URL's records is the last (a line number, say).
    """
    last = F.row_number().over(Window.partitionBy("url").orderBy(*[F.desc(c) for c in order]))
    kept = records.withColumn("__n", last).filter("__n = 1").select("url", F.col("final.score").alias("score"), F.col("final.level").alias("level"), "error", F.lit(True).alias("__found"))
    out = rows.select("url", "label").join(kept, "url", "left")
    why = F.when(F.col("__found").isNull(), "no score").otherwise(F.coalesce("error", F.lit("unknown error")))
    return out.withColumn("error", F.when(F.col("score").isNull(), why)).drop("__found")


def evaluate(rows: DataFrame, settings: Settings = Settings(), **options) -> tuple[dict, DataFrame, DataFrame]:
    """(summary, scored rows, rows without a score) of labelled pages."""
    # labels and pages are one table: each page is scored where its row is, and no join is needed
    scored = score_pages(rows, settings=settings, **options).select("url", "label", F.col("final.score").alias("score"), F.col("final.level").alias("level"), "error")
    # three passes of sums follow; pages are read and scored once for all of them
    scored = scored.persist()
    good = scored.filter("error IS NULL").drop("error")
    return metrics.summarize(good), good, scored.filter("error IS NOT NULL").select("url", "error")


def _table(rows: list[dict]) -> list[str]:
    """Rows as a Markdown table under the names of their fields; fractions have four places, and what isn't known is a dash."""
    if not rows:
        return ["None.", ""]
    cell = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    line = lambda cells: f"| {' | '.join(cells)} |"
    return [line(rows[0]), line("---" for _ in rows[0]), *(line(map(cell, r.values())) for r in rows), ""]


def markdown(title: str, summary: dict, rows: list, errors: list) -> str:
    """A report for people, laid out as the summary is: what is a number, what is a point, what is a list of points.

    rows are (url, label, score, level), errors (url, error), for sets small enough to read. The riskiest
    pages come first, and pages that the medium point judges wrongly are listed on their own.
    """
    pages = [dict(zip(("url", "label", "score", "level"), r, strict=True)) for r in sorted(rows, key=lambda r: (-r[2], r[0]))]
    sections = {
        "Overall": [{k: v for k, v in summary.items() if not isinstance(v, list | dict)}],
        "Points": [{"point": k.removeprefix("at_"), **v} for k, v in summary.items() if isinstance(v, dict)],
        "Judged wrongly at the medium point": [p for p in pages if (p["label"] == 1) != (p["score"] >= metrics.MEDIUM)],
        "Pages": pages,
        "Without a score": [dict(zip(("url", "error"), e, strict=True)) for e in errors],
        "Trade-off": summary["sweep"],
    }
    return "\n".join([f"# {title} ({datetime.now(UTC).date().isoformat()})", "", *(line for name, part in sections.items() for line in (f"## {name}", "", *_table(part)))])


def results_json(title: str, summary: dict, rows: list, errors: list) -> str:
    """The same as JSON; the gate reads its summary."""
    named = {"pages": (("url", "label", "score", "level"), rows), "without_score": (("url", "error"), errors)}
    return json.dumps({"title": title, "summary": summary} | {k: [dict(zip(names, r, strict=True)) for r in part] for k, (names, part) in named.items()}, indent=1) + "\n"
