"""Registered queries of the text operators, each over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    decontaminate, extraction, language, lexical, licenses, linededup, mixing, neardup, quality, resampling, substrings,
    topk, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_licenses")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


SUBSTRINGS_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM (
    SELECT doc_id, p, array_to_string(list_slice(words, p, p + 19), ' ') AS k
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM w))),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM starts WHERE nth > 1),
kept AS (
  SELECT doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS text
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) x
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op2_substrings", SUBSTRINGS_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substrings.substring_dedup(docs, size=20, levels=2, texts=False)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20"""


@query("op3_topk", TOP_K_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op4_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query("op5_linededup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of each document."""
    done = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("_lines_removed").alias("n_lines_removed"),
        F.col("_chunks_removed").alias("n_chunks_removed"),
        F.length("text").cast("long").alias("n_chars_kept"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.languages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(list_slice(words, p, p + 2), ' ') FOR p IN range(1, len(words) - 1)]) END AS s FROM w),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(s) AS n FROM shingles WHERE len(s) > 0 GROUP BY ALL),
one AS (SELECT rep, n, unnest(s) AS e FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM one a JOIN one b ON a.e = b.e AND a.rep < b.rep
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep, rep AS node FROM classes UNION SELECT r.rep, e.b FROM reach r JOIN ends e ON e.a = r.node),
roots AS (SELECT rep, min(node) AS root FROM reach GROUP BY rep)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id,
  coalesce(r.root, s.doc_id) = s.doc_id AS kept
FROM shingles s LEFT JOIN classes c ON list_sort(s.s) = c.s AND len(s.s) > 0 LEFT JOIN roots r ON r.rep = c.rep"""


@query("op10_neardup", NEARDUP_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


LEXICAL_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
size AS (
  SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n,
    CAST(count(*) OVER () AS BIGINT) AS docs, CAST(sum(len(terms)) OVER () AS BIGINT) AS total
  FROM d WHERE len(terms) > 0),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf JOIN size USING (row) GROUP BY term),
impact AS (
  SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)) AS x
  FROM tf JOIN size USING (row)),
scores AS (
  SELECT item_id, row, doc_id, CAST(sum(times * w * x) AS BIGINT) AS score
  FROM asked JOIN w USING (term) JOIN impact USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20"""


@query("op11_lexical", LEXICAL_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


@query("op12_extract")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


RESAMPLE_SQL = r"""
WITH step AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(0, 8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
f AS (
  SELECT row, unnest(words || [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS feature FROM d),
g AS (SELECT unnest(words || [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS feature FROM b),
bytes AS (
  SELECT feature, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)) AS v
  FROM (SELECT feature, hex(encode(feature)) AS h FROM (SELECT feature FROM f UNION SELECT feature FROM g))),
hashed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, v),
    lambda c, x: xor(crc[xor(c, x) % 256 + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM bytes, step),
corpus AS (SELECT row, bucket FROM f JOIN hashed USING (feature)),
s AS (SELECT bucket, count(*) AS s FROM corpus GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN hashed USING (feature) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(
    CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM s) + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
mean AS (
  SELECT row, CAST(count(*) AS BIGINT) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM corpus JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8)
      AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN mean USING (row)),
ranks AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= 25 * n // 100 THEN rank END AS BIGINT) AS rank
FROM scored LEFT JOIN ranks USING (row)"""


@query("op13_resample", RESAMPLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
