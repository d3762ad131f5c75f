"""SimHash near-duplicates: fingerprints, pigeonhole blocks, connected groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import first_of_groups, join_counted, slot_of
from strideframe.llm.components import components
from strideframe.session import stage

SEED = 42
BITS = 64
#: A bucket of block values with more fingerprints than this is split again by finer blocks.
BUCKET = 50_000


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits: bit set where more than half of the hashes of the text's word shingles have it; 0 without words.

    A-Z are lower-cased; words are runs without ASCII white space; a text of fewer words is one shingle.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    return majority(np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], dtype=">u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    hashes, counts = hashes.astype(">u8", copy=False), np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the columns of `keep`, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps), *b.columns[2:]], names=["doc_id", "fp", *keep])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long" + (f", {kinds}" if keep else ""))


def blocks_for(n: int, distance: int) -> int:
    """Number of blocks: the fewest whose keys are long enough that unrelated fingerprints rarely share one.

    Pairs within `distance` bits share blocks - distance blocks whatever their number, so none is lost by the choice.
    """
    for blocks in range(distance + 1, BITS):
        if BITS * (blocks - distance) // blocks >= log2(max(2, n)) + 2:
            return blocks
    return BITS


def block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """One key for each choice of blocks - distance of the blocks."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for chosen in combinations(range(blocks), blocks - distance):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        mask = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.xxhash64(F.lit(mask), fp.bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def far_bits(a: np.ndarray, b) -> np.ndarray:
    """Number of differing bits."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect a bucket's fingerprints as all its close pairs would: at most one less than its members."""
    links, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = far_bits(rest, x) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                links += [(int(x), int(y)) for y in found]
                queue.extend(found)
    return links


def _linked(distance: int):
    def links(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
        two = starts[ends - starts == 2]
        a, b = fps[two], fps[two + 1]
        near = far_bits(a, b) <= distance
        out = list(zip(a[near].tolist(), b[near].tolist()))
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            out += forest(fps[s:e], distance)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        kept = []
        for b in batches:
            kept.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(k) for k, _ in kept) < BUCKET or kept[0][0][0] == kept[-1][0][-1]:
                continue
            keys, fps = (np.concatenate(x) for x in zip(*kept))
            last = np.searchsorted(keys, keys[-1])  # the last bucket may go on
            out = links(keys[:last], fps[:last])
            kept = [(keys[last:], fps[last:])]
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        if kept:
            keys, fps = (np.concatenate(x) for x in zip(*kept))
            out = links(keys, fps)
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return run


def _bucket_links(distinct: DataFrame, blocks: int, distance: int, split: bool, reach: int) -> DataFrame:
    """Links between distinct fingerprints that share a bucket and differ in `reach` bits or fewer."""
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("key"))
    linked = lambda rows: rows.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_linked(reach), "a long, b long")
    if not split:
        return linked(keyed)
    large = stage(keyed.groupBy("key").count().where(F.col("count") > BUCKET).select("key"))
    if large.isEmpty():
        return linked(keyed)
    # fingerprints of large buckets meet in finer blocks as well; the pairs of a large bucket are all found there
    again = keyed.join(large, "key", "left_semi").select("fp").distinct()
    finer = blocks_for(1 << 40, distance)
    return linked(keyed.join(large, "key", "left_anti")).unionByName(_bucket_links(again, finer, distance, False, reach))


def near_fingerprints(distinct: DataFrame, n: int, distance: int, reach: int | None = None) -> DataFrame:
    """Links (a, b) between the n fingerprints `fp`, each there once, that connect them as all pairs within `distance` bits would.

    With a wider `reach`, those that share a bucket link up to that many bits; pairs beyond `distance` may share none.
    """
    return _bucket_links(distinct.select("fp"), blocks_for(n, distance), distance, True, distance if reach is None else reach)


def near_groups(rows: DataFrame, distance: int = 4) -> DataFrame:
    """Groups of documents connected by fingerprints that differ in at most `distance` bits.

    `rows` has doc_id and fp (`fingerprints`, staged).  One row for each distinct fp: fp, n_rows (its documents), label
    (the same for a group's fingerprints) and component_id, the smallest doc_id of the group; `slot` is for `join_counted`.
    Equal fingerprints are collapsed before any pair is looked for.  Distinct ones are split into blocks so that close
    pairs share enough of them, meet in buckets by the values of the shared blocks, and are verified there by their
    Hamming distance; a bucket yields the links of a spanning forest, never all its pairs.  Null ids take part but
    name no group unless all are null; rows that repeat count as copies; an empty table gives an empty result.
    """
    same = stage(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")))
    n = same.count()
    labels = components(near_fingerprints(same, n, distance))
    grouped = same.join(labels, same["fp"] == labels["node"], "left").select("fp", "copies", "least", F.coalesce("label", "fp").alias("label"))
    first = grouped.groupBy("label", slot_of("label").alias("slot")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("least").alias("component_id"))
    named = join_counted(grouped.drop("least"), first, ["label"], n, F.xxhash64("fp"))
    return named.select("fp", slot_of("fp").alias("slot"), F.col("copies").alias("n_rows"), "label", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = stage(fingerprints(docs, words, doc_id, text))
    groups = stage(near_groups(rows, distance))
    out = join_counted(rows, groups.drop("label"), ["fp"], rows.count(), F.xxhash64("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id, with all columns of `docs`.

    A group is told by its fingerprints, so ids that are null or repeat with other texts take no other group's row; of
    rows that repeat that id in the group one stays, by text hash.  A group without any id keeps one row.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    rows = stage(fingerprints(slim, words, keep=("hash",)))
    groups = stage(near_groups(rows, distance))
    named = join_counted(rows, groups.drop("component_id"), ["fp"], rows.count(), F.xxhash64("doc_id"))
    return first_of_groups(docs, named, "label", doc_id, text)
