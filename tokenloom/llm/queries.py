"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import rules

    return rules(table(spark, sf_dir, "documents"))


@query("""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import groups

    return groups(table(spark, sf_dir, "documents"))


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query("""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


@query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


@query("""
WITH l AS (
    SELECT doc_id, i, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
    FROM (
        SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
    )
), key AS (
    SELECT doc_id, i, line, CASE WHEN length(k) >= 10 THEN translate(k, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS k
    FROM l
), twice AS (
    SELECT k, min(doc_id) AS keep FROM key WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT key.*, keep IS NOT NULL AND keep <> doc_id AS gone FROM key LEFT JOIN twice USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup

    return dedup(table(spark, sf_dir, "documents"), ["doc_id"], texts=False)


@query()
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh
    FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
    SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 70 * (nx.n + ny.n - c)
), reach AS (
    SELECT x AS a, y AS b FROM link UNION SELECT a, y FROM reach JOIN link ON b = x
), low AS (
    SELECT a, min(b) AS b FROM reach GROUP BY a
), deg AS (
    SELECT x, count(*) AS d FROM link GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(d, 0) AS n_similar, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low ON a = doc_id LEFT JOIN deg ON x = doc_id
""")
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar

    return similar(table(spark, sf_dir, "documents"))


@query()
def op10_token_wavelets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


@query()
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digests

    return digests(table(spark, sf_dir, "documents"))
