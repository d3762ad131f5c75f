"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import blocknames, kneser_ney, langid, licenses, lines, mixing, oracles, packing, prefixtrie, repair, simhash, spotsigs, substrings, tokens
from strideframe.llm.common import crc_part

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, source_size / weight) AS level FROM l WHERE level * weight <= 3 * source_size),
t AS (SELECT source, source_size, coalesce(least(CAST(3 * source_size AS DOUBLE), f.level * weight), 0.0) AS target,
      CAST('0x' || substr(md5('0|' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM l, f),
r AS (SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      row_number() OVER (PARTITION BY d.source ORDER BY d.size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT), doc_id) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target, CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) AS copies,
       CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) * size AS taken FROM r
"""


@query("op6_mixing", MIXING_SQL)
def op6_mixing(spark, sf):
    return mixing.mix(documents(spark, sf)).withColumn("target", F.round("target", 3))


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS kept, sha256(body) AS text_sha256 FROM d
"""


@query("op10_exact_dedup", EXACT_SQL)
def op10_exact_dedup(spark, sf):
    return blocknames.exact_groups(documents(spark, sf))


@query("op3_token_counts")
def op3_token_counts(spark, sf):
    return tokens.length_table(documents(spark, sf), path("byte_bpe_50k.json"))


@query("op4_packing")
def op4_packing(spark, sf):
    return packing.pack(documents(spark, sf), path("byte_bpe_50k.json"))


@query("op7_simhash")
def op7_simhash(spark, sf):
    return simhash.near_duplicates(documents(spark, sf))


@query("op9_language_id")
def op9_language_id(spark, sf):
    docs = documents(spark, sf).withColumn("held_out", crc_part("doc_id", 4) == 2)
    found = langid.identify(docs, langid.fit(docs.where("not held_out")))
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "accepted")


@query("op2_line_dedup")
def op2_line_dedup(spark, sf):
    return lines.line_decisions(documents(spark, sf))


@query("op5_lm_scoring")
def op5_lm_scoring(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text", (crc_part("doc_id", 7) == 2).alias("held_out"))
    model = kneser_ney.train(docs.where("not held_out"))
    return kneser_ney.score(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))


@query("op8_fingerprints")
def op8_fingerprints(spark, sf):
    return spotsigs.edited_fingerprints(documents(spark, sf))


@query("op1_license_scans")
def op1_license_scans(spark, sf):
    return licenses.scan(documents(spark, sf))


@query("op11_conversation_repair", oracles.REPAIR_SQL)
def op11_conversation_repair(spark, sf):
    convs = conversations(spark, sf)
    return repair.repair(convs, repair.damage(convs))


@query("op12_conversation_trie", oracles.TRIE_SQL)
def op12_conversation_trie(spark, sf):
    return prefixtrie.trie(*prefixtrie.rebuilt(conversations(spark, sf)))


@query("op13_substring_dedup", oracles.REPEATS_SQL)
def op13_substring_dedup(spark, sf):
    found = substrings.drop_repeats(documents(spark, sf).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
