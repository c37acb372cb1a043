"""The queries of this subpackage, and their SQL where DuckDB can express it on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, decontamination, ngram_join, packing, quality, sharding, substring, toxicity, url_filter, warc
from tessera.llm._shared import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    got = warc.read_archive(spark, path)
    number = lambda c: F.col(c).try_cast("long")
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item that a document holds."""
    got = decontamination.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def _fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def _judged(got: DataFrame, held_out) -> DataFrame:
    return got.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(quality.score(docs, table(spark, sf_dir, "labels"), _fold(3) != 1), _fold(3) == 1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(toxicity.score(docs, table(spark, sf_dir, "labels"), _fold(5) != 0), _fold(5) == 0)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return got.select("page_id", "host", "path", "rule", "verdict")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_substring, op3_sharding, op4_decontamination, op5_packing, op6_quality, op7_toxicity, op8_ann, op9_url_filter, op10_ngram_join)}

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = f"regexp_matches({_AZ.format("coalesce(url, '')")}, '(^|[^a-z0-9]){{}}($|[^a-z0-9])')"
_STRICT = " OR ".join(_TERM.format(t) for t in url_filter.STRICT)
_SOFT = " + ".join(f"CAST({_TERM.format(t)} AS INTEGER)" for t in url_filter.LIGHT + url_filter.HEAVY)
_WEIGHT = " + ".join(f"{url_filter.VOCABULARY[t]} * CAST({_TERM.format(t)} AS INTEGER)" for t in url_filter.LIGHT + url_filter.HEAVY)
_RULES = "\n".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p} {v}'"
    for h, p, v in sorted(url_filter.RULES, key=lambda r: -len(r[0]) - len(r[1]))
)

ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
               CASE WHEN n < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN n < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM f""",
    "op2_substring": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        g AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN array_to_string(ws[i:i + 34], ' ') END AS win FROM p),
        r AS (SELECT win FROM g WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
        m AS (SELECT g.doc_id, g.i, g.word, CASE WHEN r.win IS NULL THEN 0 ELSE 1 END AS hit FROM g LEFT JOIN r ON g.win = r.win),
        c AS (SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
        k AS (SELECT doc_id, sum(gone) AS n, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept FROM c GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op10_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                     ELSE list_distinct([array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)]) END AS ts FROM w),
        n AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n_shingles FROM s),
        t AS (SELECT doc_id, unnest(ts) AS x FROM s),
        b AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT p, q FROM b JOIN n x ON x.doc_id = p JOIN n y ON y.doc_id = q WHERE 100 * k >= 90 * (x.n_shingles + y.n_shingles - k)),
        r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT l.q, r.c FROM r JOIN l ON l.p = r.doc_id)
        SELECT n.doc_id, n_shingles, component_id FROM n JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = n.doc_id""",
    "op9_url_filter": f"""
        WITH u AS (SELECT page_id, url, coalesce(regexp_extract(url, '^[^:]*(?::[^:]*?)*?://([^/?#]*)([^?#]*)', 1), '') AS h,
                          coalesce(regexp_extract(url, '^[^:]*(?::[^:]*?)*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        r AS (SELECT page_id, url, {_AZ.format('h')} AS host, path FROM u),
        j AS (SELECT *, CASE {_RULES} END AS hit FROM r)
        SELECT page_id, host, path, split_part(hit, ' ', 1) AS rule,
               CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 2)
                    WHEN ({_STRICT}) OR ({_SOFT}) >= {url_filter.SOFT_NEEDED} AND ({_WEIGHT}) >= {url_filter.REJECT} THEN 'block' ELSE 'allow' END AS verdict
        FROM j""",
}
