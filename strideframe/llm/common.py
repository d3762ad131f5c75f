"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.session import ensure_checkpoint_dir

#: A key counts as hot when it holds more than 1/HOT_SHARE of the rows, so at most HOT_SHARE keys are ever broadcast.
HOT_SHARE = 256
#: Code points that separate words: space and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def crc_part(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id gives 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def join_counted(rows: DataFrame, table: DataFrame, keys: Sequence[str], total: int, spread: Column) -> DataFrame:
    """Left join of `rows` with `table` on `keys`, safe for keys that hold a large share of the rows.

    `table` has one row for each key, with `n_rows`, the number of rows that have it, and was made by grouping by
    `keys` and `slot` (see `slot_of`).  Keys above total / HOT_SHARE rows, at most HOT_SHARE of them, are broadcast;
    all others meet in one shuffle that reuses the partitioning of the grouping.  Rows of hot keys carry null keys in
    that shuffle and are dealt by `spread`, so they never gather.  Null keys in `rows` find nothing.
    """
    values = [c for c in table.columns if c not in (*keys, "slot")]
    cut = hot_above(total)
    hot = table.where(F.col("n_rows") > cut).drop("slot")
    cold = table.where(F.col("n_rows") <= cut)
    hot = hot.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"_h_{v}") for v in values])
    cold = cold.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col("slot").alias("_cs"), *[F.col(v).alias(f"_c_{v}") for v in values])
    on_hot = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    seen = rows.join(F.broadcast(hot), on_hot, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    is_hot = F.col("_h_n_rows").isNotNull()
    seen = seen.withColumns({f"_j{i}": F.when(~is_hot, F.col(k)) for i, k in enumerate(keys)})
    seen = seen.withColumn("_js", F.when(is_hot, 1 + F.pmod(spread, F.lit(1 << 20)).cast("int")).otherwise(F.lit(0)))
    on_cold = [F.col(f"_j{i}") == F.col(f"_c{i}") for i in range(len(keys))] + [F.col("_js") == F.col("_cs")]
    out = seen.join(cold, on_cold, "left")
    return out.select(*rows.columns, *[F.coalesce(f"_h_{v}", f"_c_{v}").alias(v) for v in values])


def hot_above(total: int) -> Column:
    """A key with more rows than this is hot."""
    return F.lit(max(1, total // HOT_SHARE))


def slot_of(*keys: str) -> Column:
    """Always 0, but not a literal: a second partitioning column by which rows of hot keys can be dealt."""
    return F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")


def local_path(uri: str) -> str:
    """Path of a file: URI or plain path on a mounted shared folder."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: needs a shared folder that is mounted on every machine")
    return unquote(parts.path)


def shared_folder(spark) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/")


#: Buckets of a sieve, each a bitmap of 32768 bits: 4 MB at most, whatever it is made from.
SIEVE = 1024


def sift(rows: DataFrame, of: Column, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose `of` may be among `keys`: all that are, and a share of the others that grows with the keys.

    Spares shuffles before an exact join.  The bitmaps that are broadcast have a fixed bound.
    """
    place = lambda h: (F.pmod(h, F.lit(SIEVE)), F.pmod(F.shiftright(h, 24), F.lit(32768)))
    bucket, bit = place(F.xxhash64(F.col(key)))
    bitmaps = keys.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    names = rows.columns
    bucket, bit = place(F.xxhash64(of))
    rows = rows.withColumns({"_b": bucket, "_bit": bit}).join(F.broadcast(bitmaps), F.col("_b") == F.col("_bucket"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return rows.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*names)


def row_key(doc_id: str, *values: Column) -> Column:
    """Id and a hash of `values` as text for joins in which null ids meet too, but not with the empty id."""
    return F.concat_ws("|", F.xxhash64(*values).cast("string"), F.col(doc_id).cast("string"))


def pick(docs: DataFrame, chosen: DataFrame, key: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """The rows of `docs` whose `key` is in `chosen` (one row each), one row for a key, with `extra` of `chosen`."""
    rows = docs.select(F.struct("*").alias("doc"), key.alias("key")).join(chosen.select("key", *extra), "key")
    return rows.groupBy("key").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"), *[F.first(c).alias(c) for c in extra])


def first_of_groups(docs: DataFrame, rows: DataFrame, label: str, doc_id: str, text: str) -> DataFrame:
    """One row of `docs` for each label: that with the smallest id (null ids last), then text hash.

    `rows` has doc_id, hash (xxhash64 of the text) and the label of every row; equal texts have equal labels.
    """
    first = rows.groupBy(label).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("first")).select("first.*")
    chosen = first.select(row_key("doc_id", F.col("hash")).alias("key"))
    return pick(docs, chosen, row_key(doc_id, F.xxhash64(text))).select("doc.*")
