"""Order-dependent primitives that never put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task, which fails
when one key holds a large share of the data.  Here rows are windowed per ``(key, cell)``, where a
cell is a contiguous slice of the ordering column, and what crosses a cell border (row offsets,
edge rows, key totals) travels in a table with one row per cell.  Cells are cut at quantiles of each
key: no key above ``target_rows`` means a single cell per key.

Keys are expected to be non-null (the operators group like a join, so NULL keys would not match) and
ordering columns to be numeric.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strideframe.session import stage

CELL = "_cell"
TARGET_ROWS = 1_000_000
PIECE_ROWS = 8192

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def add_cell(df: DataFrame, keys: Sequence[str], order: str, target_rows: int = TARGET_ROWS, tie: Sequence[str] = (), whole: str | None = None) -> DataFrame:
    """Add ``_cell``: the number of the slice of (``order``, ``tie``) that a row of its key lies in.

    Slices are cut at quantiles of each key's own values, from a hash sample of about 64 rows for every
    ``target_rows``, so outliers, runs of equal ``order`` and sparse keys beside dense ones leave no slice
    much above half the target.  Only keys above the target have cuts: the table that is broadcast holds
    at most two for every ``target_rows`` rows of the data.  Rows equal in all of these columns stay together.
    ``whole`` names a column that tells whether the row's key has no cuts.
    """
    share = max(1, target_rows // 64)
    every = max(1, min(32, target_rows // (2 * share)))
    place = lambda: F.struct(order, *[c for c in tie if c != order])
    sample = df.where(F.pmod(F.xxhash64(*keys, order, *tie), F.lit(share)) == 0).groupBy(*keys).agg(F.sort_array(F.collect_set(place())).alias("_all"))
    cuts = sample.where(F.size("_all") > 2 * every).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.filter("_all", lambda x, i: i % every == every - 1).alias("_cuts"))
    marked = df.withColumn("_place", place()).join(F.broadcast(cuts), [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)], "left")
    # binary search for the number of cuts before the row
    found = F.expr("""aggregate(sequence(1, cast(ceil(log2(size(_cuts) + 1)) as int)), named_struct('lo', 0, 'hi', size(_cuts)), (s, i) ->
        if(s.lo >= s.hi, s, if(_cuts[(s.lo + s.hi) div 2] < _place, named_struct('lo', cast((s.lo + s.hi) div 2 + 1 as int), 'hi', s.hi),
        named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), s -> s.lo)""")
    cell = F.when(F.col("_cuts").isNotNull(), found).otherwise(0).cast("long")
    return marked.select(*df.columns, cell.alias(CELL), *([F.col("_cuts").isNull().alias(whole)] if whole else []))


def salted(df: DataFrame, cols: Sequence[str], salts: int = 64) -> DataFrame:
    """Add ``_cell`` as a hash salt, for operators that split a key without an order."""
    return df.withColumn(CELL, F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("long"))


def attach_totals(df: DataFrame, keys: Sequence[str], partials: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Add per-key totals to every row, joining on ``(key, cell)`` so that a hot key stays split.

    ``partials`` maps output name -> (merge, column) with merge one of sum / min / max.
    """
    cells = df.groupBy(*keys, CELL).agg(*[_MERGE[m](c).alias(name) for name, (m, c) in partials.items()])
    whole = W.partitionBy(*keys)
    for name, (merge, _) in partials.items():
        cells = cells.withColumn(name, _MERGE[merge](F.col(name)).over(whole))
    return df.join(cells, [*keys, CELL])


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: Sequence[str] = (),
    target_rows: int = TARGET_ROWS,
    keep_cell: bool = False,
    cell_ready: bool = False,
) -> DataFrame:
    """Add exact 0-based ``idx`` and group size ``n`` per key, ordered by ``order`` then ``tie``."""
    marked = df if cell_ready else add_cell(df, keys, order, target_rows, tie)
    before = W.partitionBy(*keys).orderBy(CELL).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, CELL)
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(
            *keys,
            CELL,
            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
            F.sum("_c").over(W.partitionBy(*keys)).alias("n"),
        )
    )
    local = F.row_number().over(W.partitionBy(*keys, CELL).orderBy(order, *tie))
    out = (
        marked.withColumn("_r", local)
        .join(offsets, [*keys, CELL])
        .withColumn("idx", (F.col("_r") - 1 + F.col("_off")).cast("long"))
        .drop("_r", "_off")
    )
    return out if keep_cell else out.drop(CELL)


def adjacent_pairs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: Sequence[str] = (),
    carry: Sequence[str] = (),
    target_rows: int = TARGET_ROWS,
    with_last: bool = False,
    with_span: bool = False,
) -> DataFrame:
    """One row per consecutive pair: ``prev`` and ``cur`` structs of (order, tie, carry).

    Pairs inside a cell come from ``lag``; the pair across each cell border comes from the cells'
    own first and last rows.  ``with_last`` adds the (last row, NULL) pair of every key;
    ``with_span`` adds the key's ``first`` and ``last`` row to every pair.
    """
    marked = add_cell(df, keys, order, target_rows, tie)
    fields = [order, *tie, *[c for c in carry if c != order and c not in tie]]
    item = F.struct(*fields)
    slim = marked.select(*keys, CELL, item.alias("cur"))
    inside = slim.withColumn("prev", F.lag("cur").over(W.partitionBy(*keys, CELL).orderBy("cur"))).filter(
        "prev is not null"
    )
    edges = marked.groupBy(*keys, CELL).agg(F.min(item).alias("head"), F.max(item).alias("tail"))
    span: list[str] = []
    if with_span:
        whole = W.partitionBy(*keys)
        span = ["first", "last"]
        edges = edges.withColumn("first", F.min("head").over(whole)).withColumn("last", F.max("tail").over(whole))
        inside = inside.join(edges.select(*keys, CELL, *span), [*keys, CELL])
    by_cell = W.partitionBy(*keys).orderBy(CELL)
    across = edges.select(*keys, F.lag("tail").over(by_cell).alias("prev"), F.col("head").alias("cur"), *span)
    pairs = inside.select(*keys, "prev", "cur", *span).unionByName(across.filter("prev is not null"))
    if with_last:
        ends = edges.withColumn("_end", F.lead(CELL).over(by_cell)).filter("_end is null")
        pairs = pairs.unionByName(ends.select(*keys, F.col("tail").alias("prev"), *span), allowMissingColumns=True)
    return pairs


def blocks(
    indexed: DataFrame, rows: int, before: int = 0, after: int = 0, idx: str = "idx", size: str = "n"
) -> DataFrame:
    """Replicate indexed rows into fixed-size blocks with halos: adds ``block`` and ``core``.

    Block b owns rows [b*rows, (b+1)*rows); it also sees ``before`` rows ahead of it and ``after``
    rows behind it, so windows and kernels keyed on (key, block) have bounded input.
    """
    first = F.greatest(F.floor((F.col(idx) - after) / rows), F.lit(0))
    last = F.least(F.floor((F.col(idx) + before) / rows), F.floor((F.col(size) - 1) / rows))
    return indexed.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn(
        "core", F.floor(F.col(idx) / rows) == F.col("block")
    )


def packed_blocks(
    df: DataFrame, keys: Sequence[str], order: str, v: str, tie: Sequence[str] = (), rows: int = 65_536,
    before: int = 0, after: int = 0, target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Each key's ordered values as one array for each block: keys, block, n, lo, hi, start, x.

    ``x`` holds rows [start, start + size) of the key: the block's own [b*rows, (b+1)*rows) with ``before`` rows ahead of
    it and ``after`` behind it, as far as the key has them; ``n``, ``lo`` and ``hi`` are the key's size and extremes.
    The rows themselves are shuffled once, by (key, cell), and ranked in their cell; from there on arrays of at most
    PIECE_ROWS values travel.
    """
    fields = list(dict.fromkeys([order, *tie, v]))
    marked = add_cell(df.select(*dict.fromkeys([*keys, *fields])), keys, order, target_rows, tie)
    ranked = marked.withColumn("_r", F.row_number().over(W.partitionBy(*keys, CELL).orderBy(*fields)))
    piece = F.floor((F.col("_r") - 1) / PIECE_ROWS).alias("_piece")
    packed = F.sort_array(F.collect_list(F.struct("_r", F.col(v).cast("double").alias("x"))))["x"].alias("x")
    pieces = ranked.groupBy(*keys, CELL, piece).agg(packed)
    pieces = stage(pieces.select("*", F.size("x").cast("long").alias("_c"), F.array_min("x").alias("lo"), F.array_max("x").alias("hi")))
    whole = W.partitionBy(*keys)
    earlier = whole.orderBy(CELL, "_piece").rowsBetween(W.unboundedPreceding, -1)
    sizes = pieces.select(*keys, CELL, "_piece", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_off"), F.sum("_c").over(whole).alias("n"),
                          F.min("lo").over(whole).alias("lo"), F.max("hi").over(whole).alias("hi"))
    placed = pieces.drop("lo", "hi").join(sizes, [*keys, CELL, "_piece"])
    first = F.greatest(F.floor((F.col("_off") - after) / rows), F.lit(0))
    last = F.least(F.floor((F.col("_off") + F.col("_c") - 1 + before) / rows), F.floor((F.col("n") - 1) / rows))
    parts = placed.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    a = F.greatest(F.col("_off"), F.col("block") * rows - before)
    b = F.least(F.col("_off") + F.col("_c"), (F.col("block") + 1) * rows + after)
    part = F.slice("x", (a - F.col("_off") + 1).cast("int"), (b - a).cast("int"))
    joined = parts.select(*keys, "block", "n", "lo", "hi", F.struct(a.alias("start"), part.alias("x")).alias("_part")).groupBy(*keys, "block").agg(
        *[F.min(c).alias(c) for c in ("n", "lo", "hi")], F.sort_array(F.collect_list("_part")).alias("_parts"))
    return joined.select(*keys, "block", "n", "lo", "hi", F.col("_parts")[0]["start"].alias("start"), F.flatten(F.col("_parts")["x"]).alias("x"))


def running_weight(
    df: DataFrame, keys: Sequence[str], order: str, weight: str, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Add ``before`` (weight of strictly smaller rows) and ``total``; ``order`` unique per key."""
    marked = add_cell(df, keys, order, target_rows)
    upto = W.partitionBy(*keys).orderBy(CELL).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, CELL)
        .agg(F.sum(weight).alias("_c"))
        .select(
            *keys,
            CELL,
            F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_off"),
            F.sum("_c").over(W.partitionBy(*keys)).alias("total"),
        )
    )
    inner = W.partitionBy(*keys, CELL).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        marked.withColumn("_b", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
        .join(offsets, [*keys, CELL])
        .withColumn("before", F.col("_b") + F.col("_off"))
        .drop("_b", "_off", CELL)
    )


def suffix_min(indexed: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Minimum of ``value`` over this row and all later rows of its key (needs ``_cell``)."""
    later = W.partitionBy(*keys).orderBy(CELL).rowsBetween(1, W.unboundedFollowing)
    tails = (
        indexed.groupBy(*keys, CELL)
        .agg(F.min(value).alias("_m"))
        .select(*keys, CELL, F.min("_m").over(later).alias("_later"))
    )
    inner = W.partitionBy(*keys, CELL).orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    return (
        indexed.withColumn("_own", F.min(value).over(inner))
        .join(tails, [*keys, CELL])
        .withColumn(out, F.least("_own", "_later"))
        .drop("_own", "_later")
    )
