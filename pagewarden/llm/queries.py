"""The corpus operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules that the URL query is held to.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: The block list behind the rules, in the same form.
BLOCKED_HOSTS = [f"{name}.example.{top}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("net", "org")]
SHARD_DIMENSIONS = ["lang", "source", "size"]
TOKEN_LIMIT = 4096
#: In the audit, of every so many pages the replica has one record with a flipped bit, lacks one, and has one twice, the second time under another id.
DAMAGE_EVERY, LOST, ADDED = 97, 13, 29


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_sharding(spark, sf_dir):
    from pagewarden.llm.hilbert import shards

    return shards(table(spark, sf_dir, "documents"), SHARD_DIMENSIONS, n_shards=8, bits=4)


def op2_bpe_tree(spark, sf_dir):
    from pagewarden.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_token_counts(spark, sf_dir):
    from pagewarden.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op4_quality_additive(spark, sf_dir):
    from pagewarden.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark, sf_dir):
    from pagewarden.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op6_template_decontamination(spark, sf_dir):
    from pagewarden.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_cascade(spark, sf_dir):
    from pagewarden.llm.url_cascade import judge_urls

    blocked = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "key string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, blocked).drop("url")


def op9_jaccard_join(spark, sf_dir):
    from pagewarden.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_warc_audit(spark, sf_dir):
    from pagewarden.llm.warc_audit import audit, warc_record

    pages = table(spark, sf_dir, "pages")
    primary = pages.select("page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    kind = F.coalesce(F.pmod(F.col("page_id"), F.lit(DAMAGE_EVERY)), F.lit(1))
    # the last byte of the record, a line end, with its lowest bit flipped
    harmed = F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.lit(b"\x0b"))
    replica = primary.filter(kind != LOST).withColumn("record", F.when(kind == 0, harmed).otherwise(F.col("record")))
    more = primary.filter(kind == ADDED).withColumn("page_id", -1 - F.col("page_id"))
    return audit(primary, replica.unionByName(more), "page_id")


def op8_toxicity_kneser_ney(spark, sf_dir):
    from pagewarden.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_hilbert_sharding, op2_bpe_tree, op3_token_counts, op4_quality_additive, op5_exact_dedup, op6_template_decontamination, op7_url_cascade, op8_toxicity_kneser_ney, op9_jaccard_join, op10_warc_audit)}

_CRLF = "chr(13) || chr(10)"
#: A page's WARC record without its last byte.
_WARC = (
    f"encode('WARC/1.0' || {_CRLF} || 'WARC-Type: resource' || {_CRLF} || 'WARC-Record-ID: <urn:record:' || coalesce(cast(page_id as varchar), '') || '>' || {_CRLF}"
    f" || 'WARC-Target-URI: ' || coalesce(url, '') || {_CRLF} || 'Content-Type: text/html' || {_CRLF} || 'Content-Length: ' || strlen(coalesce(html, '')) || {_CRLF} || {_CRLF}"
    f" || coalesce(html, '') || {_CRLF} || chr(13))"
)



def _places(name: str) -> str:
    """SQL for the places of an archive's records: a border where a hash says so, offsets within a segment."""
    return f"""{name}_k AS (SELECT page_id, kind, sha, harmed, max(length) AS length, count(*) AS copies, sha256(coalesce(cast(page_id AS varchar), '') || ' ' || sha) AS k FROM {name} GROUP BY ALL),
        {name}_s AS (SELECT *, (count(*) FILTER (('0x' || k[:8])::BIGINT % 1024 = 0) OVER (ORDER BY page_id NULLS LAST, sha))::BIGINT AS segment FROM {name}_k),
        {name}_placed AS (SELECT *, (row_number() OVER w - 1)::INT AS leaf, (sum(length * copies) OVER w - length * copies)::BIGINT AS "start", (sum(length * copies) OVER w)::BIGINT AS "end"
            FROM {name}_s WINDOW w AS (PARTITION BY segment ORDER BY page_id NULLS LAST, sha))"""


ORACLE_SQL = {
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
        c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = w.doc_id""",
    "op10_warc_audit": f"""
        WITH b AS (SELECT page_id, coalesce((page_id % {DAMAGE_EVERY} + {DAMAGE_EVERY}) % {DAMAGE_EVERY}, 1) AS kind, {_WARC} AS body FROM pages),
        mine AS (SELECT page_id, kind, octet_length(body) + 1 AS length, sha256(body || '\\x0A'::BLOB) AS sha, sha256(body || '\\x0B'::BLOB) AS harmed FROM b),
        theirs AS (SELECT page_id, kind, length, CASE WHEN kind = 0 THEN harmed ELSE sha END AS sha, harmed FROM mine WHERE kind <> {LOST} UNION ALL SELECT -1 - page_id, -1, length, sha, harmed FROM mine WHERE kind = {ADDED}),
        {_places("mine")}, {_places("theirs")}
        SELECT page_id, copies, segment, leaf, "start", "end", sha AS record_sha256, CASE kind WHEN 0 THEN harmed WHEN {LOST} THEN NULL ELSE sha END AS replica_sha256,
            CASE kind WHEN 0 THEN 'changed' WHEN {LOST} THEN 'lost' ELSE 'sound' END AS status, kind IN (0, {LOST}) AS damaged FROM mine_placed
        UNION ALL SELECT page_id, copies, segment, leaf, "start", "end", NULL, sha, 'added', true FROM theirs_placed WHERE kind = -1""",
    "op7_url_cascade": rf"""
        WITH rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in URL_RULES.items())}),
        listed(rule) AS (VALUES {", ".join(f"('{r}')" for r in BLOCKED_HOSTS)}),
        u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        fits AS (SELECT page_id, max_by(rule, length(rule)) AS rule FROM p JOIN rules ON starts_with(path, substr(rule, instr(rule, '/')))
            AND (host = substr(rule, 1, instr(rule, '/') - 1) OR ends_with(host, '.' || substr(rule, 1, instr(rule, '/') - 1))) GROUP BY page_id),
        bad AS (SELECT DISTINCT page_id FROM p JOIN listed ON starts_with(path, substr(rule, instr(rule, '/')))
            AND (host = substr(rule, 1, instr(rule, '/') - 1) OR ends_with(host, '.' || substr(rule, 1, instr(rule, '/') - 1))))
        SELECT p.page_id, host, path, fits.rule, coalesce(rules.verdict, CASE WHEN bad.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM p LEFT JOIN fits USING (page_id) LEFT JOIN rules ON rules.rule = fits.rule LEFT JOIN bad ON bad.page_id = p.page_id""",
}
