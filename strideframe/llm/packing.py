"""Best-fit decreasing packing of token sequences into windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.tokens import encode

WINDOW = 1024
#: Documents that are packed together.  Groups are independent, so their number follows the number of documents.
GROUP = 8192
#: A gap of at least so many tokens is filled by cutting a piece of the emptiest window; smaller ones stay padding.
LEAST_GAP = 8


class OpenWindows:
    """Open windows by what is left in them, with a segment tree over 1..capacity to find the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.by_left: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, left: int, by: int) -> None:
        i = left + self.size
        while i:
            self.tree[i] += by
            i //= 2

    def put(self, window: int, left: int) -> None:
        if left:
            self.by_left[left].append(window)
            self._add(left, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least `need`, and that room."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i % 2 or not self.tree[i + 1]):  # climb to the nearest right neighbour that holds one
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        left = i - self.size
        self._add(left, -1)
        return self.by_left[left].pop(), left


def best_fit(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start, length) for items of 1..capacity, given in decreasing order of size.

    Each item goes to the tightest open window.  Then the emptiest windows are taken apart, and their pieces fill the
    gaps of the others, cut to fit, as long as all that they hold finds room.
    """
    windows: list[list[tuple[int, int, int]]] = []
    room: list[int] = []
    tree = OpenWindows(capacity)
    for item, size in enumerate(sizes):
        found = tree.take(size)
        if found is None:
            windows.append([])
            found = len(windows) - 1, capacity
            room.append(capacity)
        w, left = found
        windows[w].append((item, 0, size))
        room[w] = left - size
        tree.put(w, room[w])
    order = sorted(range(len(windows)), key=lambda w: (room[w], w))  # fullest first
    gaps = [w for w in order if room[w] >= LEAST_GAP]
    free = sum(room[w] for w in gaps)
    while gaps and capacity - room[gaps[-1]] <= free - room[gaps[-1]]:
        last = gaps.pop()
        pieces, windows[last] = windows[last], []
        free -= capacity
        for item, start, size in pieces:
            while size:
                w = gaps[-1]
                part = min(size, room[w])
                windows[w].append((item, start, part))
                room[w] -= part
                start, size = start + part, size - part
                if not room[w]:
                    gaps.pop()
        if gaps and room[gaps[-1]] < LEAST_GAP:  # what is left of the last gap
            free -= room[gaps.pop()]
    return [w for w in windows if w]


def _encoded(path: str, capacity: int):
    """Checksums of a document's full windows, and the ids of what is left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = 4 * capacity
            total, checks, tails = [], [], []
            for t in b.column(1).to_pylist():
                ids = encode(t, path)
                ids.append(0)
                raw = np.array(ids, dtype="<u4").tobytes()
                full = len(raw) // step * step
                total.append(len(ids))
                checks.append([zlib.crc32(raw[i : i + step]) for i in range(0, full, step)])
                tails.append(raw[full:])
            yield pa.record_batch([b.column(0), pa.array(total, pa.int64()), pa.array(checks, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                                  names=["doc_id", "doc_tokens", "checks", "tail"])

    return run


def _packed(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # a total order, so that a lost task gives the same windows again
        group = group.assign(n=group["tail"].str.len() // 4).sort_values(["n", "doc_id", "doc_tokens", "tail"], ascending=[False, True, True, True], kind="stable")
        base, out, window = int(group["g"].iloc[0]) << 32, [], 0
        ids = [None if pd.isna(x) else x for x in group["doc_id"]]
        tails, totals = group["tail"].tolist(), group["doc_tokens"].tolist()
        for d, total, checks in zip(ids, totals, group["checks"]):
            for i, crc in enumerate(checks):
                out.append((d, i * capacity, capacity, int(crc), total, base + window, 0))
                window += 1
        for pieces in best_fit([len(t) // 4 for t in tails if t], capacity):
            offset = 0
            for item, start, size in pieces:
                raw = tails[item][4 * start : 4 * (start + size)]
                out.append((ids[item], totals[item] - len(tails[item]) // 4 + start, size, zlib.crc32(raw), totals[item], base + window, offset))
                offset += size
            window += 1
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = WINDOW, group: int = GROUP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in windows of at most `capacity` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then id 0.  It is first cut into full windows, which need no packing; what is left over
    is packed by best-fit decreasing together with that of about `group` others, chosen by a hash.  Only left-overs
    are shuffled, and a group never grows with the corpus.  A null text counts as empty (one token), rows that repeat
    a doc_id are documents of their own, and an empty table gives an empty result.
    """
    groups = max(1, -(-docs.count() // group))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(_encoded(path, capacity), "doc_id long, doc_tokens long, checks array<long>, tail binary")
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "doc_tokens", "tail"), F.lit(groups)))
    pieces = rows.groupBy("g").applyInPandas(_packed(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces
