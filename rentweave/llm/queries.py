"""Registered queries of the corpus operators and, where SQL can say it, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rentweave.llm import (
    ann, arrowtokens, bpe, decontam, importance, langid, lzprint, negatives, oracles, rlz, simhash, suffix, urlfilter, warc,
)
from rentweave.llm.common import keyed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable:
    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fourth document by the crc-32 of its id in decimal; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@register(oracles.RLZ_COPIES)
def op1_rlz_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlz.remove_copies(table(spark, sf_dir, "documents", "doc_id", "text"), 13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.identify(docs, F.col("doc_id").isNotNull() & ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@register()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register(oracles.REPEATED_BYTES)
def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), 400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register(oracles.WARC_RECORDS)
def op2_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = warc.mark_copies(table(spark, sf_dir, "pages", "page_id", "url", "html"), 0)
    return warc.read_records(warc.normalise(warc.write_archives(marked)))


#: The rules that op3 judges by: action, host, path.
URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
_RULE_ROWS = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)


@register(f"""
WITH rules(action, rule_host, rule_path) AS (VALUES {_RULE_ROWS}),
rest AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest),
best AS (
    SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        max_by(action, length(rule_host || rule_path)) AS action
    FROM parts JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
""")
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_RULE_ROWS} AS t(action, host, path)")
    return urlfilter.judge(table(spark, sf_dir, "pages", "page_id", "url"), rules)


@register()
def op7_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return arrowtokens.read_documents(arrowtokens.write_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), 1))


@register()
def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents", "doc_id", "text"))
    return decontam.leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).drop("key")


@register()
def op4_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


@register(oracles.HARD_NEGATIVES)
def op11_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@register()
def op12_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


@register(oracles.importance_draw())
def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "benchmark", "text"))
