"""WARC records and the audit of their replicas with Merkle trees.

Records are ordered by id and content and cut into segments (one WARC file each) where a hash of a record
says so, one in `segment_records` on average: a lost or an added record moves no other segment's borders.
The leaf of a record is a hash over its place, its offset range in the file and its content; a node is a
hash over its children's hashes in order and the range they cover; the segments' roots are the leaves of a
tree of the whole archive. Two replicas are the same if their roots are. Where they aren't, the children of
mismatching nodes alone are compared, level by level, down to the leaves. Within a segment the leaves behind
a lost record all mismatch, since their offsets have moved; the records of mismatching leaves are held
against each other at last, which tells the changed, lost and added ones from those that only moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm.common import frozen, ranked

#: Records in a WARC file, on average, and children of a node.
SEGMENT_RECORDS, FANOUT = 1024, 16
#: Records over which one task counts borders.
BLOCK = 1 << 14
_BREAK = "\r\n"


def warc_record(key: Column, url: Column, payload: Column) -> Column:
    """Bytes of a WARC/1.0 resource record; a null URL or payload counts as empty."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    head = F.concat_ws(
        _BREAK,
        F.lit("WARC/1.0"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:record:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.length(body).cast("string")),
    )
    return F.concat(F.concat(head, F.lit(_BREAK * 2)).cast("binary"), body, F.lit((_BREAK * 2).encode()))


def leaves(records: DataFrame, id_col: str, record_col: str, segment_records: int = SEGMENT_RECORDS) -> DataFrame:
    """One row for each different record: id, copies, segment, border, leaf (its place there), start, end (its bytes there), record_sha256.

    records is read once and slimmed to hashes. The order is that of the id (nulls last), then of the
    content's hash; a null record counts as an empty one. Records alike in id and content lie behind each
    other and are one row with their number. border names a segment by the hash of the record it begins
    with, '' for the first.
    """
    content = F.coalesce(F.col(record_col).cast("binary"), F.lit(b""))
    slim = records.select(F.col(id_col), F.length(content).cast("bigint").alias("length"), F.sha2(content, 256).alias("record_sha256"))
    slim = frozen(slim.groupBy(id_col, "record_sha256", "length").agg(F.count(F.lit(1)).alias("copies")))
    rows, _ = ranked(slim, [id_col, "record_sha256"], "rank")
    key = F.sha2(F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("")), "record_sha256"), 256)
    borders = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % segment_records == 0
    rows = rows.withColumn("border", F.when(borders, key)).withColumn("block", F.expr(f"rank div {BLOCK}L"))
    inside = F.count("border").over(Window.partitionBy("block").orderBy("rank"))
    blocks = rows.groupBy("block").agg(F.count("border").alias("borders"))
    # a row for each BLOCK records
    ahead = blocks.select(F.col("block").alias("__block"), F.coalesce(F.sum("borders").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rows = rows.withColumn("inside", inside).join(ahead, F.col("block") == F.col("__block")).withColumn("segment", F.col("ahead") + F.col("inside"))
    own = Window.partitionBy("segment")
    upto = F.sum(F.col("length") * F.col("copies")).over(own.orderBy("rank"))
    return frozen(rows.select(id_col, "copies", "segment", F.coalesce(F.max("border").over(own), F.lit("")).alias("border"), (F.row_number().over(own.orderBy("rank")) - 1).alias("leaf"), (upto - F.col("length") * F.col("copies")).alias("start"), upto.alias("end"), "record_sha256"))


def _parents(nodes: DataFrame, keys: list[str], fanout: int) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.struct("node", "hash", "start", "end")))  # fanout of them
    up = nodes.withColumn("up", F.expr(f"node div {fanout}")).groupBy(*keys, "up").agg(kids.alias("kids"))
    start, end = F.col("kids")[0]["start"], F.element_at("kids", -1)["end"]
    hashed = F.sha2(F.concat_ws(" ", F.transform("kids", lambda k: k["hash"]), start.cast("string"), end.cast("string")), 256)
    return up.select(*keys, F.col("up").alias("node"), hashed.alias("hash"), start.alias("start"), end.alias("end"))


def tree(leaf_rows: DataFrame, width: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the segments' trees from the leaves up to one root each: border, node, hash, start, end; no segment has over `width` leaves."""
    hashed = F.sha2(F.concat_ws(" ", F.col("leaf").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), "record_sha256", F.col("copies").cast("string")), 256)
    levels = [leaf_rows.select("border", F.col("leaf").cast("bigint").alias("node"), hashed.alias("hash"), "start", "end")]
    while width > 1:
        width = -(-width // fanout)
        levels.append(frozen(_parents(levels[-1], ["border"], fanout)))
    return levels


def archive_root(leaf_rows: DataFrame, segment_roots: DataFrame, fanout: int = 256) -> str | None:
    """The hash over all segments' roots in order; None for an empty archive."""
    order = leaf_rows.filter("leaf = 0").select("border", "segment")
    top = segment_roots.join(order, "border").select(F.col("segment").alias("node"), "hash", "start", "end")
    while True:
        top = frozen(_parents(top, [], fanout))
        rows = top.limit(2).collect()
        if len(rows) < 2:
            return rows[0]["hash"] if rows else None


def mismatching_leaves(left: list[DataFrame], right: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """border and leaf of the places where two archives differ or only one has a record.

    Starts at the segments' roots and looks only at the children of nodes that differ.
    """
    at = None
    for a, b in zip(reversed(left), reversed(right), strict=True):
        if at is not None:
            a, b = ((x.withColumn("up", F.expr(f"node div {fanout}")).join(at, ["border", "up"], "left_semi")) for x in (a, b))
        a, b = a.select("border", "node", F.col("hash").alias("one")), b.select("border", "node", F.col("hash").alias("two"))
        at = frozen(a.join(b, ["border", "node"], "full").filter(~F.col("one").eqNullSafe(F.col("two"))).select("border", F.col("node").alias("up")))
    return at.select("border", F.col("up").cast("int").alias("leaf"))


def _told_apart(mine: DataFrame, theirs: DataFrame, id_col: str) -> DataFrame:
    """Places of the records that only one of two sets has, in pairs by id as far as there are: __place, __border, replica_sha256 and status."""
    same = lambda a, b: a[id_col].eqNullSafe(b[id_col]) & (a["record_sha256"] == b["record_sha256"]) & (a["copies"] == b["copies"])
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("record_sha256", "copies"))
    gone = mine.join(theirs, same(mine, theirs), "left_anti").withColumn("__k", number)
    new = theirs.join(mine, same(theirs, mine), "left_anti").withColumn("__k", number)
    new = new.select(*[F.col(c).alias(f"__new_{c}") for c in new.columns])
    both = gone.join(new, gone[id_col].eqNullSafe(F.col(f"__new_{id_col}")) & (F.col("__k") == F.col("__new___k")), "full")
    here = F.col("record_sha256").isNotNull()
    status = F.when(here & F.col("__new_record_sha256").isNotNull(), "changed").when(here, "lost").otherwise("added")
    return both.select(*[F.when(here, F.col(c)).otherwise(F.col(f"__new_{c}")).alias(c) for c in (id_col, "copies", "segment", "border", "leaf", "start", "end")], "record_sha256", F.col("__new_record_sha256").alias("replica_sha256"), status.alias("status"))


def audit(primary: DataFrame, replica: DataFrame, id_col: str, record_col: str = "record", segment_records: int = SEGMENT_RECORDS) -> DataFrame:
    """One row for each different record of the primary, and each that only the replica has: id, copies,
    segment, leaf, start, end, record_sha256, replica_sha256, status, damaged.

    status is sound, changed (the replica has other content, or another number of copies, under the id),
    lost (the replica lacks it) or added (only the replica has it; the place is its place there); all but
    sound are damaged. With equal archive roots nothing is compared below them. Of several records of one
    id that differ, changed ones are paired in the order of their hashes. Ids may repeat or be null, null
    records count as empty ones, an empty archive has no places, and records are hashed whole whatever
    their length. Columns but the two named ones are not read.
    """
    mine, theirs = (leaves(x, id_col, record_col, segment_records) for x in (primary, replica))
    width = max((x.agg(F.max("leaf")).first()[0] or 0) + 1 for x in (mine, theirs))
    trees = [tree(x, width) for x in (mine, theirs)]
    columns = [id_col, "copies", "segment", "leaf", "start", "end", "record_sha256"]
    sound = mine.select(*columns, F.col("record_sha256").alias("replica_sha256"), F.lit("sound").alias("status"))
    if archive_root(mine, trees[0][-1]) == archive_root(theirs, trees[1][-1]):
        return sound.withColumn("damaged", F.lit(False))
    bad = mismatching_leaves(*trees)
    apart = frozen(_told_apart(mine.join(bad, ["border", "leaf"], "left_semi"), theirs.join(bad, ["border", "leaf"], "left_semi"), id_col))
    own = apart.filter("status != 'added'").select(F.col("segment").alias("__segment"), F.col("leaf").alias("__leaf"))
    sound = sound.join(own, (F.col("segment") == F.col("__segment")) & (F.col("leaf") == F.col("__leaf")), "left_anti")
    return sound.unionByName(apart.drop("border")).withColumn("damaged", F.col("status") != "sound")
