"""Token ids of texts, and the exact histogram of encoded lengths."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of one range of the suffix sums.
RANGE = 1024


def _letters() -> dict[str, int]:
    """Byte of each printable stand-in that byte-level vocabularies use in place of raw bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=4)
def encoder(path: str):
    """Encoder of a byte-level BPE vocabulary file; one in each worker.

    The file's ids are its merge ranks, so the faster rank-based library gives the same ids as the file's own.  Added
    tokens whose contents stand in a text have the ids that the file gives them.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = _letters(), {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(text: str | None, path: str) -> list[int]:
    """Ids of a text; none for null."""
    return encoder(path).encode(text or "", allowed_special="all")


def ids_of(text: str | None, path: str) -> np.ndarray:
    """`encode` as an array."""
    return np.array(encode(text, path), dtype="<u4")


def lengths(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(encode(t, path)) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def length_table(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Exact histogram of encoded lengths with its suffix sums, one row for each length that occurs.

    Columns: n_tokens, n_docs; docs_up_to and tokens_up_to for documents of at most that length; docs_over and
    tokens_over for longer ones; truncated_tokens, the tokens left when documents are cut at that length; quantile,
    the share of documents of at most that length.  `at_limits` and `quantiles` read every answer off this table.

    Null and empty texts have length 0, rows that repeat count each time, an empty table gives an empty result.
    Sums run in two steps, over ranges of lengths and inside each, so no window holds more lengths than one range.
    """
    counts = lengths(docs, path, doc_id, text).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = counts.withColumn("part", F.floor(F.col("n_tokens") / RANGE))
    up = Window.partitionBy("part").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    parts = Window.partitionBy(F.floor(F.col("part") / RANGE)).orderBy("part")
    docs_in, tokens_in = F.sum("n_docs"), F.sum(F.col("n_docs") * F.col("n_tokens"))
    inside = counts.select("part", "n_tokens", "n_docs", docs_in.over(up).alias("d"), tokens_in.over(up).alias("t"))
    by_part = counts.groupBy("part").agg(docs_in.alias("pd"), tokens_in.alias("pt"))
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.withColumn("block", F.floor(F.col("part") / RANGE))
    blocks = by_part.groupBy("block").agg(F.sum("pd").alias("bd"), F.sum("pt").alias("bt"))
    # one row for each 1024 x 1024 lengths
    above = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(above), zero).alias("bd"), F.coalesce(F.sum("bt").over(above), zero).alias("bt"),
                           F.sum("bd").over(every).alias("all_docs"), F.sum("bt").over(every).alias("all_tokens"))
    by_part = by_part.select("part", "block", F.coalesce(F.sum("pd").over(before), zero).alias("pd"), F.coalesce(F.sum("pt").over(before), zero).alias("pt"))
    whole = inside.join(by_part, "part").join(blocks, "block")
    d, t = F.col("d") + F.col("pd") + F.col("bd"), F.col("t") + F.col("pt") + F.col("bt")
    return whole.select("n_tokens", "n_docs", d.alias("docs_up_to"), t.alias("tokens_up_to"), (F.col("all_docs") - d).alias("docs_over"),
                        (F.col("all_tokens") - t).alias("tokens_over"), (t + (F.col("all_docs") - d) * F.col("n_tokens")).alias("truncated_tokens"),
                        (d / F.col("all_docs")).alias("quantile"))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """What each context limit keeps: limit, docs_whole, docs_cut, kept_tokens, lost_tokens.  From `length_table`."""
    spark = table.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    within = lambda c: F.sum(F.when(F.col("n_tokens") <= F.col("limit"), F.col(c)).otherwise(0))
    rows = table.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit"))
    sums = rows.groupBy("limit").agg(within("n_docs").alias("docs_whole"), (F.sum("n_docs") - within("n_docs")).alias("docs_cut"),
                                     within("tokens").alias("short"), F.sum("tokens").alias("every"))
    kept = F.coalesce(F.col("short") + F.col("docs_cut") * F.col("limit"), F.lit(0))
    return wanted.join(F.broadcast(sums), "limit", "left").select(
        "limit", F.coalesce("docs_whole", F.lit(0)).alias("docs_whole"), F.coalesce("docs_cut", F.lit(0)).alias("docs_cut"), kept.alias("kept_tokens"), (F.coalesce("every", F.lit(0)) - kept).alias("lost_tokens"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least each share of the documents stays within: share, n_tokens.  From `length_table`."""
    wanted = table.select(*[F.min(F.when(F.col("quantile") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)])
    pairs: list[Column] = [F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)]
    return wanted.select(F.explode(F.array(*pairs)).alias("x")).select("x.share", "x.n_tokens")
