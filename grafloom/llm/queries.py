"""The driver's queries over these operators, with production parameters, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontaminate, langid, neardup, packing, pii, repeats, rules, secrets, warc
from .hashed import fold
from .store import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), carry={"ids_crc32": F.crc32("ids")})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), need=400, keep="none")
    return out.select("doc_id", "n_bytes", repeats.span_bytes(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), threshold=0.8)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from folds 1 to 4 of crc32(doc_id) mod 5; fold 0 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    out = classifier.classify(docs, learn, threshold=0.3)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    base = F.filter("secrets", lambda s: s["kind"].isin([k.name for k in secrets.KINDS if k.base]))
    size = lambda spans: F.size(spans).cast("long")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [size(F.filter(kinds, lambda s: s == F.lit(k.name))).alias(f"n_{k.name}") for k in secrets.KINDS if k.base]  # noqa: B023
    live = F.filter("secrets", lambda s: s["live"])
    return out.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
        size(live).alias("n_live"), (size(F.col("secrets")) - size(live)).alias("n_example"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(table(spark, sf_dir, "pages"), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.size(F.filter(F.transform(base, lambda s: s["kind"]), lambda s: s == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]  # noqa: B023
    return out.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from all folds but 2 of crc32(doc_id) mod 4, which is held out."""
    docs = table(spark, sf_dir, "documents")
    learn = docs.select("doc_id", "lang").filter(fold(F.col("doc_id"), 4) != 2)
    out = langid.identify(docs.select("doc_id", "text"), learn)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_suffix_array_dedup, op3_minhash_near_dedup, op4_quality_classifier, op5_quality_rules, op6_secret_scans, op7_benchmark_decontamination, op8_warc_zip, op9_personal_data, op10_language_id)}


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, {k + 1}, 5))::INT >> {s}) & 31), 1)" for k in range(0, 40, 5) for s in (15, 10, 5, 0)
)

OP8_SQL = f"""
WITH h AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha FROM h),
k AS (SELECT sha, max(page_id) AS keeper FROM d GROUP BY sha)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM d JOIN k USING (sha)
"""


def _secrets_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for i, k in enumerate(secrets.KINDS):
        re = quote(k.pattern)
        parts.append(
            f"SELECT doc_id, source, {i} AS o, {quote(k.name)} AS kind, {k.base} AS base, "
            "(list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0))::BIGINT AS s, length(m[i]) AS n, v[i] AS value "
            f"FROM (SELECT doc_id, source, m, v, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, source, regexp_extract_all(t, {re}) AS m, regexp_extract_all(t, {re}, {k.value}) AS v, "
            f"string_split_regex(t, {re}) AS p FROM d)) WHERE length(v[i]) >= {k.least}"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(parts)}),
c AS (SELECT * FROM a WHERE base OR NOT EXISTS (SELECT 1 FROM a AS b WHERE b.base AND b.doc_id = a.doc_id AND a.s < b.s + b.n AND b.s < a.s + a.n)),
f AS (SELECT value, count(DISTINCT string_split(source, '/')[1]) AS owners FROM c GROUP BY value),
j AS (SELECT c.*, owners <= {secrets.MAX_OWNERS} AND len(list_distinct(string_split(value, ''))) >= {secrets.MIN_DISTINCT} AND regexp_matches(value, '[0-9]')
    AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, {quote(secrets.PLACEHOLDERS)}) AS live, kind || ':' || s || ':' || (s + n) AS span FROM c JOIN f USING (value)),
k AS (SELECT * FROM j WHERE base OR live),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY s, o) FILTER (base) AS base_spans, string_agg(span, ',' ORDER BY s, o) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_secret_scans": _secrets_sql(), "op8_warc_zip": OP8_SQL}
