"""The registered queries of this folder, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appwatch.llm import (
    alignment, collocations, common, minhash, mixing, quality_classifier, quality_rules, secret_scan, sentencepiece, suffix_dedup, token_counts,
    topk, toxicity, warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, text,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS place FROM sizes),
ranked AS (SELECT *, [1.5e0, 2e0, 2e0][place + 1] AS w0, [0.5e0, 2e0, 4e0][place + 1] AS w1, (place + 1)::DOUBLE AS weight FROM placed),
filled AS (SELECT *, source_size * 3e0 / weight AS full_at FROM ranked),
leveled AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY full_at, source IS NULL, encode(source)
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY full_at, source IS NULL, encode(source)
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
plan AS (
  SELECT *, CASE WHEN common IS NULL OR full_at < common THEN source_size * 3e0 ELSE weight * common END AS target
  FROM (SELECT *, max(CASE WHEN level <= full_at THEN level END) OVER () AS common FROM leveled)),
taken AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.w0, p.w1, round(p.target)::BIGINT AS demand,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id::VARCHAR, md5(coalesce(d.text, ''))
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
mixed AS (
  SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS passes FROM taken),
dealt AS (
  SELECT *, (CASE WHEN size > 0 THEN least(passes * size + greatest(0, least(size, demand - passes * source_size - before)), 3 * size) ELSE 0 END)::BIGINT AS words
  FROM mixed),
curved AS (
  SELECT *, CASE WHEN words > 0 THEN least(1e0, (before::DOUBLE + least(size, words) / 2e0) / target) * (w0 + w1) / 2e0 END AS area FROM dealt)
SELECT doc_id, size, source_size, target, words AS taken,
  CASE WHEN area > 0 THEN 2e0 * area / (w0 + sqrt(w0 * w0 + 2e0 * (w1 - w0) * area)) WHEN words > 0 THEN 0e0 END AS position
FROM curved
"""


WARC_SQL = """
WITH pages_ AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
grouped AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS largest FROM pages_)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN largest IS NOT NULL AND (page_id IS NULL OR page_id < largest) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN largest IS NOT NULL AND (page_id IS NULL OR page_id < largest) THEN largest END AS refers_to
FROM grouped
"""


@query("op1_warc", WARC_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(common.table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_minhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"), minhash.Params(shingle=4))


@query("op5_mix_sources", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", *mixing.NEW)


TOPK_SQL = """
WITH vectors AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.vec, v.vec)::BIGINT AS score
  FROM vectors q JOIN vectors v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.vec) = len(v.vec))
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
WHERE rank <= 10
"""


@query("op6_topk", TOPK_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return token_counts.limits(token_counts.histogram(token_counts.encoded_lengths(docs, piece_model())))


@query("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return sentencepiece.encode_documents(docs, piece_model(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return suffix_dedup.remove_repeats(docs, outputs=("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.apply_rules(docs, quality_rules.fit_references(docs)).drop("text", "lang")


def _secret_sql(kind: str, no: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return (
        f"SELECT doc_id, row, {no} AS no, '{kind}' AS kind, sum(before + width) OVER w - width AS start, sum(before + width) OVER w AS stop, long_enough "
        f"FROM (SELECT doc_id, row, unnest(range(len(found))) AS i, unnest([len(x) FOR x IN pieces[:len(found)]]) AS before, unnest([len(x) FOR x IN found]) AS width, "
        f"unnest([len(x) >= {least} FOR x IN judged]) AS long_enough FROM (SELECT doc_id, row, string_split_regex(text, '{quoted}') AS pieces, "
        f"regexp_extract_all(text, '{quoted}') AS found, regexp_extract_all(text, '{quoted}', {group}) AS judged FROM d)) "
        "WINDOW w AS (PARTITION BY row ORDER BY i)"
    )


# The SQL has the patterns as the contract gives them, and drops short matches afterwards.
SECRETS_SQL = (
    "WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents), m AS ("
    + " UNION ALL ".join(
        _secret_sql(kind, no, pattern, group, least)
        for no, (kind, pattern, group, least) in enumerate(
            (("assign", secret_scan.RULES[0].pattern, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))
        )
    )
    + "), s AS (SELECT row, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex, "
    "string_agg(kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY start, no) AS spans "
    "FROM m WHERE long_enough GROUP BY row) "
    "SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, "
    "sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (row)"
)


@query("op12_secret_scan", SECRETS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(common.table(spark, sf_dir, "documents"))


PHRASES_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
f AS (
  SELECT lang, words, phrase, count(*)::HUGEINT AS f FROM (
    SELECT lang, 1 AS words, unnest(w) AS phrase FROM w
    UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM w
    UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM w)
  GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
cand AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
held AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM cand WHERE words = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE words = 3) GROUP BY ALL),
kept AS (SELECT cand.* FROM cand LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
cuts AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM kept
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE words = 3),
scored AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, (1000000 * a * a) // (l.f * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = head JOIN f r ON r.lang = c.lang AND r.phrase = tail),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM weakest)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", PHRASES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.phrases(common.table(spark, sf_dir, "documents"))
    return collocations.collocations(found).drop("doc_id", "start")


@query("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), piece_model())
