"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.common import SPACE_CHARS, SPACES, pick, row_key
from strideframe.session import stage

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MOST = 3


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    inner = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, f"{SPACES}+"))).otherwise(0).cast("long")


def unit(*cols: Column) -> Column:
    """A number from 0 to 1 (1 excluded) that depends on the values alone."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_weights(sources: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weights dealt in turn to sources in code point order, null last.  One row for each source."""
    order = Window.orderBy(F.col(source).asc_nulls_last())
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    return sources.withColumn("weight", dealt)


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Targets of sources with `source_size` and `weight` that share the whole by weight, none above `most` times its size.

    Filling is exact in one step: in order of size / weight, a source is full as long as the level that the others
    would have to reach is above its own limit.  Tables of one row for each source.
    """
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.lit(most) * F.col("source_size")
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = sources.withColumn("level", left / weights)
    # the level of the first source that is not full holds for it and all after it
    first = F.min(F.when(F.col("level") * F.col("weight") <= limit, F.struct(F.col("source_size") / F.col("weight"), "level"))).over(every)
    levels = levels.withColumn("level", first["level"])
    target = F.coalesce(F.least(limit.cast("double"), F.col("level") * F.col("weight")), F.lit(0.0))
    return levels.withColumn("target", target).drop("level")


def mix(docs: DataFrame, seed: int = 0, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, doc_id: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """How often each document goes into the mix: doc_id, size, source_size, target, copies, taken.

    A source's documents stand in order of size, then of a hash of their id; each has target / source_size expected
    copies, and a document is emitted once for each integer boundary that the running sum, shifted by one random
    offset for the source, crosses.  In order of size a source's taken words differ from its target by less than
    about one long document's.  Running numbers come from three counts (by size, by hash cell within a size, by row
    within a cell), so no window holds a whole source.  Texts are read once, for their sizes; what is staged and
    shuffled are ids, sizes and sources.

    Null texts have size 0, a null source is a source, rows that repeat an id are counted as rows of their own, an
    empty table gives an empty result, and sources without words have target 0 and take nothing.
    """
    return _copies(docs, seed, most, weights, doc_id, text, source)


def _copies(docs: DataFrame, seed: int, most: int, weights: tuple[int, ...], doc_id: str, text: str, source: str, told_by: tuple[Column, ...] = ()) -> DataFrame:
    """`mix`, with `key` (`row_key` by the columns `told_by`) if there are any; rows that repeat an id then stand in its order."""
    key = [row_key(doc_id, *told_by).alias("key")] if told_by else []
    named = ["key"] if told_by else []
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), *key))
    rows = rows.withColumn("_at", unit(F.col("doc_id")))
    by_size = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sources = by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    cells = F.greatest(F.lit(1), F.ceil(F.sqrt(F.coalesce(F.sum("n"), F.lit(0)))))
    # a cell of a size is a range of the hash; their number grows with the root of the corpus, as does what one holds
    rows = rows.withColumn("_cell", F.floor(F.col("_at") * by_size.agg(cells).scalar()))
    by_cell = rows.groupBy("source", "size", "_cell").agg(F.count(F.lit(1)).alias("n"))
    ahead = lambda *by, on: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = by_size.select("source", "size", ahead("source", on="size").alias("_size_start"))
    rates = targets(source_weights(sources, weights=weights), most).select(
        "source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"))
    starts = by_cell.select("source", "size", "_cell", ahead("source", "size", on="_cell").alias("_cell_start"))
    starts = _join(starts, _join(sizes, rates, "source"), "source", "size")
    inside = F.row_number().over(Window.partitionBy("source", "size", "_cell").orderBy("_at", F.col("doc_id").asc_nulls_last(), *named))
    ranked = rows.withColumn("_row", inside)
    ranked = _join(ranked, starts, "source", "size", "_cell")
    offset = unit(F.lit(seed), F.col("source"))
    number = F.col("_size_start") + F.col("_cell_start") + F.col("_row")
    crossed = lambda k: F.floor(k * F.col("_rate") + offset)
    copies = (crossed(number) - crossed(number - 1)).cast("long")
    return ranked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *named)


def _join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on keys that may be null."""
    named = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    return left.join(named, on).drop(*[f"_r{i}" for i in range(len(keys))])


def take(docs: DataFrame, seed: int = 0, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, doc_id: str = "doc_id",
         text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of `docs` as often as `mix` takes it, with all its columns.

    Rows that repeat id, text and source are taken together, from one of them; other rows with that id (or without
    one) are rows of their own.  The text is shuffled once.
    """
    told_by = (F.xxhash64(text), F.xxhash64(source))
    copies = _copies(docs, seed, most, weights, doc_id, text, source, told_by).groupBy("key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    rows = pick(docs, copies, row_key(doc_id, *told_by), ("copies",))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
