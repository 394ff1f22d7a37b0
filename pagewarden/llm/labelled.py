"""Labels that models may learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import crc32_of_id


def training_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """id, label (0 or 1) and fold (0 or 2) of the rows that aren't held out; several labels of an id are averaged."""
    rows = labels.select(F.col(id_col), F.col(label_col).cast("double").alias("label")).filter(F.col(id_col).isNotNull() & F.col("label").isNotNull())
    rows = rows.groupBy(id_col).agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    return rows.withColumn("fold", F.pmod(crc32_of_id(id_col), F.lit(3)).cast("int")).filter("fold != 1")


def sample(rows: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """n of the rows, the same ones each time: those whose ids have the smallest hashes."""
    return rows.orderBy(F.xxhash64(id_col), id_col).limit(n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
