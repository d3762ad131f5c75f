"""Conversation prefix trie: shared beginnings as nodes, subtree sums rolled up in bands of depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideframe.llm.common import join_counted, slot_of
from strideframe.operators.ordered import row_index
from strideframe.session import stage

#: Levels of a band: a node is summed into at most BAND ancestors in a round, and rounds grow with log_BAND(depth).
BAND = 8
#: Turns whose running identity is one window; longer conversations carry theirs over in a table.
BLOCK = 256
#: Bytes of a piece of a list of ids.
PIECE = 1 << 16


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, idx (0, 1, ... by turn, null first, then role and text), n (turns of the conversation), role and text; nulls are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    least = F.lit(-(1 << 63)).cast("long")
    rows = rows.where("conv_id is not null").select("conv_id", F.coalesce(F.col("turn").cast("long"), least).alias("turn"), text("role"), text("text"))
    return row_index(rows, ["conv_id"], "turn", ["role", "text"]).drop("turn")


def rebuilt(rows: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group: turns (conv_id, depth, role, text) and all conversations (conv_id, n).

    Conversation c begins with the first h turns of conversation c - c % group (all it has, none if it is absent), h being
    crc32 of c in decimals modulo `most`, and goes on with its own turns after its first h.
    """
    turns = stage(numbered(rows))
    convs = turns.groupBy("conv_id", slot_of("conv_id").alias("slot")).agg(F.count(F.lit(1)).alias("n_rows"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, "base": F.col("conv_id") - F.col("conv_id") % group})
    bases = convs.where("conv_id = base").select(F.col("base").alias("_base"), F.col("n_rows").alias("n_base"))
    convs = stage(convs.join(bases, F.col("base") == F.col("_base"), "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0)))).drop("_base", "n_base"))
    first = turns.where((F.col("idx") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    heads = convs.where("head > 0").select("conv_id", "base", "head").join(first, "base").where("idx < head")
    own = join_counted(turns, convs.drop("base"), ["conv_id"], turns.count(), F.xxhash64("idx")).where("idx >= h")
    out = heads.select("conv_id", (F.col("idx") + 1).alias("depth"), "role", "text").unionByName(
        own.select("conv_id", (F.col("idx") - F.col("h") + F.col("head") + 1).alias("depth"), "role", "text"))
    n = convs.select("conv_id", (F.col("head") + F.greatest(F.col("n_rows") - F.col("h"), F.lit(0))).alias("n"))
    return out, n


def _identities(turns: DataFrame) -> DataFrame:
    """conv_id, depth, chars, and the identities of the turns so far (a, b) and before this one (pa, pb).

    A sequence is named by two sums (xor) of hashes of (depth, role, text): sums go on from block to block of a
    conversation, so no conversation is one window.
    """
    kinds = {"ha": F.xxhash64("depth", "role", "text"), "hb": F.xxhash64(F.lit(1), "depth", "role", "text")}
    rows = turns.withColumns({**kinds, "chars": F.length("text").cast("long"), "block": F.floor((F.col("depth") - 1) / BLOCK)}).drop("role", "text")
    upto = W.partitionBy("conv_id", "block").orderBy("depth")
    inside = rows.withColumns({"xa": F.bit_xor("ha").over(upto), "xb": F.bit_xor("hb").over(upto)})
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("ha").alias("ta"), F.bit_xor("hb").alias("tb"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"t{c}").over(before), F.lit(0)).alias(f"o{c}") for c in "ab"])
    rows = inside.join(blocks, ["conv_id", "block"]).withColumns({c: F.col(f"x{c}").bitwiseXOR(F.col(f"o{c}")) for c in "ab"})
    return rows.select("conv_id", "depth", "chars", "a", "b", *[F.col(c).bitwiseXOR(F.col(f"h{c}")).alias(f"p{c}") for c in "ab"])


def _with_paths(rows: DataFrame, step: int) -> DataFrame:
    """Rows at every `step`-th depth, with `path`: the nodes of their band from its root to the row, at most BAND + 1."""
    rows = rows.where((F.col("depth") > 0) & (F.col("depth") % step == 0)) if step > 1 else rows
    band = F.floor((F.col("depth") / step - 1) / BAND)
    upto = W.partitionBy("conv_id", "band").orderBy("depth")
    own = F.collect_list(F.struct("a", "b")).over(upto)
    root = F.first(F.struct(F.col("pa").alias("a"), F.col("pb").alias("b"))).over(upto)
    return rows.withColumn("band", band).withColumn("path", F.concat(F.array(root), own)).drop("band")


def _sum(nodes: DataFrame, ancestors, values: list[str]) -> DataFrame:
    """The values summed into each of a node's `ancestors`."""
    up = nodes.select(F.explode(ancestors).alias("x"), *values).select("x.a", "x.b", *values)
    return up.groupBy("a", "b").agg(*[F.sum(v).alias(v) for v in values])


def subtree_sums(rows: DataFrame, nodes: DataFrame, deepest: int, values: list[str]) -> DataFrame:
    """a, b and the values summed over each node's subtree, itself included.

    `rows` has a row for each conversation and depth (conv_id, depth, a, b, pa, pb), `nodes` one for each node with its
    own values, the root (depth 0, a = b = 0) included.  Depths are cut into bands of BAND levels; the node at a band's
    foot is the root of those that go on below.  Band roots first take in what lies inside their band, then the
    band roots, a tree of 1 / BAND of the height, are summed in the same way, and at last every node takes in the nodes
    of its own band, the complete totals at the band's foot among them.
    """
    return _rolled(rows, nodes.select("depth", "a", "b", *values), 1, deepest, values)


def _rolled(rows: DataFrame, nodes: DataFrame, step: int, deepest: int, values: list[str]) -> DataFrame:
    paths = _with_paths(rows, step).withColumnsRenamed({"pa": "ra", "pb": "rb"})
    path = paths.groupBy("a", "b").agg(F.first("path").alias("path"))
    below = stage(nodes.where("depth > 0").join(path, ["a", "b"]))
    root = nodes.where("depth = 0").select("a", "b", *values)
    whole = F.col("path")
    if deepest // step <= BAND:
        return stage(_sum(below, whole, values).unionByName(root).groupBy("a", "b").agg(*[F.sum(v).alias(v) for v in values]))
    foot = F.col("depth") % (step * BAND) == 0
    inside = _sum(below.where(~foot), F.slice(whole, 1, 1), values)
    own = nodes.where(foot).select("a", "b", *values).unionByName(inside).groupBy("a", "b").agg(*[F.sum(v).alias(v) for v in values])
    roots = nodes.where(foot).select("depth", "a", "b").join(own, ["a", "b"])
    # rows of band roots: the one before is the root of the band they end
    high = paths.where(foot).select("conv_id", "depth", "a", "b", F.col("path")[0]["a"].alias("pa"), F.col("path")[0]["b"].alias("pb"))
    totals = _rolled(high, roots, step * BAND, deepest, values)
    done = below.where(foot).select("a", "b", "path").join(totals, ["a", "b"])
    lower = below.where(~foot).select("a", "b", "path", *values).unionByName(done)
    return stage(_sum(lower, F.slice(whole, 2, BAND), values).unionByName(totals.join(nodes.where("depth = 0").select("a", "b"), ["a", "b"])))


def _hash_lists(ends: DataFrame) -> DataFrame:
    """a, b and the SHA-256 of each node's conv_ids in decimals, ascending, with commas between.

    Ids are sorted over all tasks and joined to pieces there; one task only hashes a node's pieces as they come by.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0
        for b in batches:
            out = []
            for x, y, c in zip(*(col.to_pylist() for col in b.columns)):
                if (x, y) != key or size > PIECE:
                    if held:
                        out.append((*key, first, ",".join(held)))
                    key, first, held, size = (x, y), c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            if out:
                yield pa.record_batch([pa.array(col) for col in zip(*out)], names=["a", "b", "first", "ids"])
        if held:
            yield pa.record_batch([pa.array([v]) for v in (*key, first, ",".join(held))], names=["a", "b", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            out = []
            for x, y, ids in zip(*(col.to_pylist() for col in b.columns)):
                if (x, y) != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (x, y), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.record_batch([pa.array(col) for col in zip(*out)], names=["a", "b", "ends_sha256"])
        if key:
            yield pa.record_batch([pa.array([v]) for v in (*key, sha.hexdigest())], names=["a", "b", "ends_sha256"])

    cut = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").select("a", "b", "conv_id")
    cut = cut.mapInArrow(pieces, "a long, b long, first long, ids string")
    dealt = cut.repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ids")
    return dealt.mapInArrow(hashes, "a long, b long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    `turns` has conv_id, depth (1, 2, ... without gaps), role and text, none of them null; `convs` has every conversation
    once, with n, the number of its turns.  A node is a sequence of first turns that occurs; the root has none.  saved_tokens
    sums (members - 1) x code points of the last text over the subtree.  Conversations that are equal end at one node; those
    without turns end at the root; no conversations give an empty result.  Sequences are told apart by 128 bits of hash.
    """
    rows = stage(_identities(turns))
    convs = stage(convs)
    deepest = convs.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    below = rows.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                                *[F.first(c).alias(c) for c in ("pa", "pb", "chars")])
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", *[F.lit(None).cast("long").alias(c) for c in ("pa", "pb")], zero.alias("chars"))
    nodes = stage(below.unionByName(root))
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("_a"), F.col("pb").alias("_b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").drop("_a", "_b")
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")
    nodes = stage(nodes.withColumns({"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("chars"), "n_children": F.coalesce("n_children", F.lit(0))}))
    sums = subtree_sums(rows, nodes, deepest, ["n_leaves", "saved_tokens"])
    parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), slot_of("a", "b").alias("slot"),
                                                   F.col("n_children").alias("n_rows"), F.col("conv_id").alias("parent_conv_id"))
    out = join_counted(nodes.drop("n_leaves", "saved_tokens"), parents, ["pa", "pb"], nodes.count(), F.xxhash64("a", "b")).drop("n_rows")
    last = rows.join(convs.withColumnRenamed("conv_id", "_c"), (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("n"))).select("a", "b", "conv_id")
    ends = stage(last.unionByName(convs.where("n = 0").select(zero.alias("a"), zero.alias("b"), "conv_id")))
    out = out.join(sums, ["a", "b"]).join(_hash_lists(ends), ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
