"""Exact duplicates with Patricia tries.

Each task first puts the whole byte strings of its own rows into a compressed radix trie, so a group of
copies leaves a task as one row, however large it is. The distinct strings are then dealt by length and
content hash, and the task that owns a partition inserts them into its trie, whose terminal nodes keep
the smallest id and the number of rows. A trie that outgrows its memory bound moves its heaviest
subtrees to the task's scratch file; they are read back one by one, each as a trie of its own.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import frozen, joined_by_group, unused, utf8, without_rows

#: Bytes that a task's trie may hold before subtrees are moved out.
TRIE_BYTES = 64 << 20
_NODE_BYTES = 250
_BREAKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_HEAD = struct.Struct("<q?qI")


def squeeze(raw: bytes) -> bytes:
    """Each run of the six ASCII white-space characters becomes one space."""
    raw = raw.translate(_BREAKS)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


def _smaller(a, b):
    return b if a is None or (b is not None and b < a) else a


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:]."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class _Node:
    __slots__ = ("count", "kids", "label", "least")

    def __init__(self, label: bytes):
        self.label, self.kids, self.count, self.least = label, None, 0, None


class _Spill:
    """A subtree that has moved to the scratch file; keys are what follows the path to it."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def add(self, rest: bytes, least, count: int) -> None:
        self.file.write(_HEAD.pack(least or 0, least is not None, count, len(rest)) + rest)

    def records(self):
        self.file.seek(0)
        while head := self.file.read(_HEAD.size):
            least, known, count, n = _HEAD.unpack(head)
            yield self.file.read(n), least if known else None, count
        self.file.close()


class PatriciaTrie:
    """Owners of byte strings: add() rows, then read items() once."""

    def __init__(self, bound: int = TRIE_BYTES):
        self.bound, self.held, self.root = bound, 0, _Node(b"")

    def add(self, key: bytes, least, count: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if not key.startswith(node.label, at):
                self._split(node, _shared(node.label, key, at))
            at += len(node.label)
            if at == len(key):
                node.least = _smaller(node.least, least) if node.count else least
                node.count += count
                return
            if node.kids is None:
                node.kids = {}
            kid = node.kids.get(key[at])
            if kid is None:
                leaf = node.kids[key[at]] = _Node(key[at:])
                leaf.least, leaf.count = least, count
                self.held += len(leaf.label) + _NODE_BYTES
                if self.held > self.bound:
                    self._move_out()
                return
            if isinstance(kid, _Spill):
                kid.add(key[at:], least, count)
                return
            node = kid

    def _split(self, node: _Node, k: int) -> None:
        low = _Node(node.label[k:])
        low.kids, low.count, low.least = node.kids, node.count, node.least
        node.label, node.kids, node.count, node.least = node.label[:k], {low.label[0]: low}, 0, None
        self.held += _NODE_BYTES

    def _move_out(self) -> None:
        """Move the heaviest subtrees below the first branching out, until half the bound is free."""
        top, others = self.root, bool(self.root.count)
        while top.kids and len(top.kids) == 1 and isinstance(only := next(iter(top.kids.values())), _Node) and only.kids:
            top, others = only, others or bool(only.count)
        if not others and len(top.kids or ()) < 2:
            self.bound *= 2  # one long string: it can't be parted
            return
        weights = sorted(((sum(len(n.label) + _NODE_BYTES for n in _nodes(k)), b) for b, k in (top.kids or {}).items() if isinstance(k, _Node)), reverse=True)
        for weight, b in weights:
            if self.held <= self.bound // 2:
                break
            spill = _Spill()
            for record in self._walk(top.kids[b], b""):
                spill.add(*record)
            top.kids[b] = spill
            self.held -= weight
        if self.held > self.bound:
            self.bound *= 2

    def _walk(self, top: _Node, path: bytes):
        stack = [(top, path)]
        while stack:
            node, path = stack.pop()
            if isinstance(node, _Spill):
                rest = PatriciaTrie(self.bound)
                for record in node.records():
                    rest.add(*record)
                for key, least, count in rest.items():
                    yield path + key, least, count
                continue
            path += node.label
            if node.count:
                yield path, node.least, node.count
            stack.extend((kid, path) for kid in (node.kids or {}).values())

    def items(self):
        """(byte string, smallest id, number of rows) of each terminal node."""
        return self._walk(self.root, b"")


def _nodes(top: _Node):
    stack = [top]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            yield node
            stack.extend((node.kids or {}).values())


def _columns(batch, *names):
    """Rows of some columns, few of them as Python objects at once."""
    for i in range(0, batch.num_rows, 256):
        yield from zip(*(batch.column(n).slice(i, 256).to_pylist() for n in names), strict=True)


def _local_owners(bound):
    def run(batches):
        trie = PatriciaTrie(1 << 62)

        def emptied():
            rows = [(len(k), int.from_bytes(hashlib.sha256(k).digest()[:8], "little", signed=True), k, least, n) for k, least, n in trie.items()]
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 2000], strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["n_bytes", "content_hash", "content", "least", "n"])

        for batch in batches:
            for raw, key in _columns(batch, "raw", "id"):
                trie.add(squeeze(raw), key)
            if trie.held > bound:
                yield from emptied()
                trie = PatriciaTrie(1 << 62)
        yield from emptied()

    return run


def _owners(bound):
    def run(batches):
        trie = PatriciaTrie(bound)
        for batch in batches:
            for record in _columns(batch, "content", "least", "n"):
                trie.add(*record)
        rows: list = []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["text_sha256", "keep_id", "group_size"])

        for key, least, n in trie.items():
            rows.append((hashlib.sha256(key).hexdigest(), least, n))
            if len(rows) == 5000:
                yield packed()
                rows = []
        if rows:
            yield packed()

    return run


def owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each distinct normalised text: text_sha256, keep_id (smallest id), group_size."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))
    local = rows.mapInArrow(_local_owners(trie_bytes), "n_bytes bigint, content_hash bigint, content binary, least bigint, n bigint")
    return local.repartition("n_bytes", "content_hash").mapInArrow(_owners(trie_bytes), "text_sha256 string, keep_id bigint, group_size bigint")


def _digests(batches):
    """The digest of each row's normalised text, and a hash of its text as it is."""
    for batch in batches:
        digests = pa.array([hashlib.sha256(squeeze(r)).hexdigest() for (r,) in _columns(batch, "raw")], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row_hash"), digests], ["id", "row_hash", "text_sha256"])


def _judged(df: DataFrame, id_col: str, text_col: str, trie_bytes: int) -> DataFrame:
    """One row for each input row: id, row_hash (of the text as it is), text_sha256, keep_id, group_size, kept."""
    kind = df.schema[id_col].dataType.simpleString()
    raw = utf8(text_col)
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(raw).alias("row_hash"), raw.alias("raw")).mapInArrow(_digests, f"id {kind}, row_hash bigint, text_sha256 string")
    rows = frozen(rows.withColumn("row", F.monotonically_increasing_id()))
    groups = frozen(owners(df, id_col, text_col, trie_bytes))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    out = joined_by_group(rows, groups, "text_sha256", "group_size", total)
    mine = F.col("id").eqNullSafe(F.col("keep_id"))
    stays = out.filter(mine).groupBy("text_sha256").agg(F.min(F.struct("row_hash", "row")).alias("s")).select(F.col("s.row").alias("__row"))
    return out.join(stays, F.col("row") == F.col("__row"), "left").withColumn("kept", F.col("__row").isNotNull()).drop("row", "__row")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each input row: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after each run of ASCII white space has become one space; a
    null text counts as empty. The row with the smallest id of a group stays; a null id is larger than
    any other, and a group of nothing but null ids has a null keep_id. Of several rows with that id
    one stays. A long text is one string of a trie, whatever its length. An empty table gives an empty
    result. Other columns are not read, so they may be called like those that come out.
    """
    return _judged(df, id_col, text_col, trie_bytes).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def without_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns; of rows alike in id and text one stays.

    Which rows go is settled by ids and hashes; the texts only meet the list of those. Columns may have any names.
    """
    judged = _judged(df, id_col, text_col, TRIE_BYTES).groupBy("id", "row_hash").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("k"))
    judged = frozen(judged.filter("k < n").select("id", "row_hash", "k"))
    kept = without_rows(df, judged.drop("k"), id_col, text_col)
    again = judged.filter("k = 1").drop("k")
    if again.isEmpty():
        return kept
    # rows alike in id and text, of which one stays
    key, mark = unused(df, "__id", "__hash")
    twice = df.withColumn(mark, F.xxhash64(utf8(text_col)))
    twice = twice.join(again.toDF(key, f"{mark}_of"), twice[id_col].eqNullSafe(F.col(key)) & (F.col(mark) == F.col(f"{mark}_of")))
    return kept.unionByName(twice.dropDuplicates([key, mark]).select(*df.columns))
