"""Exact deduplication by naming blocks, then pairs of names, until a document has one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import SPACES, hot_above, join_counted, slot_of
from strideframe.session import stage

#: Characters of a block.
BLOCK = 4096
#: Stands for the missing right half of an odd pair; names are 0 and up, those of hot keys below this.
NONE = -1


def squeezed(text: Column) -> Column:
    """Text without any white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACES}+", "")


def _named(rows: DataFrame, keys: list[str], total: int, spread: Column) -> DataFrame:
    """`rows` with the integer `name` of their keys: equal keys have one name, different keys different names.

    Distinct keys are sorted inside each partition of their grouping and numbered there, so the name of a key depends
    on the data alone.
    """
    found = rows.groupBy(*keys, slot_of(*keys).alias("slot")).agg(F.count(F.lit(1)).alias("n_rows"))
    found = found.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())
    # the few hot keys are numbered in a plan of their own, so their names get a range of their own
    hot = F.when(F.col("hot"), F.lit(NONE - 1) - F.col("name")).otherwise(F.col("name"))
    joined = join_counted(rows, found, keys, total, spread)
    return joined.withColumn("hot", F.col("n_rows") > hot_above(total)).withColumn("name", hot).drop("hot", "n_rows")


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_chars, text_sha256 and its identity (level, name).

    Two rows have the same identity exactly when their squeezed texts are equal; no hash decides it.  Squeezed texts
    are cut into blocks of `block` characters, distinct blocks get integer names, adjacent names are paired and the
    pairs named anew, level by level (the logarithm of the longest text's number of blocks), each level staged.
    The text itself is shuffled twice: to name blocks and to take the names back.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("body", squeezed(F.col("text")))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.length("body") / F.lit(block)).cast("int"))
    total, longest = rows.select(n_blocks.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    rows = rows.select("row", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"),
                       n_blocks.alias("left"), "body", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("at"))
    first = F.col("at") == 0
    rows = rows.select("row", "at", "left", *[F.when(first, F.col(c)).alias(c) for c in ("doc_id", "n_chars", "text_sha256")],
                       F.substring("body", F.col("at") * block + 1, F.lit(block)).alias("block"))
    facts = ["doc_id", "n_chars", "text_sha256"]
    level, done = 0, []
    names = stage(_named(rows, ["block"], total, F.xxhash64("row", "at")).drop("block"))
    while True:
        done.append(names.where("left = 1").select(*facts, F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        pairs = names.where("left > 1").groupBy("row", F.floor(F.col("at") / 2).alias("at")).agg(
            F.ceil(F.max("left") / 2).cast("int").alias("left"), *[F.max(c).alias(c) for c in facts],
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(NONE)).alias("b"))
        total, longest, level = -(-total // 2), -(-longest // 2), level + 1
        names = stage(_named(pairs, ["a", "b"], total, F.xxhash64("row", "at")).drop("a", "b"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Which row of equal texts stays: doc_id, keep_id, group_size, kept, text_sha256; one row for each row of `docs`.

    Texts are equal when their squeezed forms are.  The row with the most characters in its original text stays, then
    the smallest doc_id.  Null texts count as empty, and empty texts are equal to each other.  Rows that repeat the
    staying doc_id with the same text and length are all marked kept.  A null doc_id stays only if its group has no
    other of that length.  An empty table gives an empty result.
    """
    rows = identities(docs, doc_id, text, block)
    total = docs.count()
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    groups = rows.groupBy("level", "name", slot_of("level", "name").alias("slot")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("best"))
    out = join_counted(rows, groups, ["level", "name"], total, F.xxhash64("text_sha256", "doc_id"))
    best = F.col("best")
    kept = (F.col("n_chars") == -best["col1"]) & F.col("doc_id").eqNullSafe(best["doc_id"])
    return out.select("doc_id", best["doc_id"].alias("keep_id"), F.col("n_rows").alias("group_size"), kept.alias("kept"), "text_sha256")
