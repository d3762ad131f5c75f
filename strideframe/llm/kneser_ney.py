"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, mapped by workers."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import local_path, shared_folder

#: Text bytes that are hashed at once, bigrams that are counted before they are sent on, characters behind one shard.
PIECE, FLUSH, SHARD_CHARS = 1 << 22, 1 << 22, 1 << 24
LEAST_SHARDS = 16
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the word hash
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)  # edges of a text
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
GAP = re.compile(rb"[\x09-\x0d\x20]")
LOW48 = np.uint64((1 << 48) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of a bigram: a context's hash and 48 bits of the next token's."""
    with np.errstate(over="ignore"):
        return mix(a * BASE + (b & LOW48))


def hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of lower-cased bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    word = ~SPACE[data]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    length = ends - starts
    with np.errstate(over="ignore"):
        powers = np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(length.max(), BASE, dtype=np.uint64))))
        inside = data[word].astype(np.uint64) + np.uint64(1)
        first = np.cumsum(length) - length
        inside *= powers[np.arange(len(inside)) - np.repeat(first, length)]
        sums = np.add.reduceat(inside, first)
        return mix(sums + length.astype(np.uint64) * START), starts


def sequences(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For groups of texts in their order: token hashes, each text from START to END, and each text's number of words."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode().lower()
        group.append(raw)
        size += len(raw)
        if size >= PIECE:
            yield _sequence(group)
            group, size = [], 0
    if group:
        yield _sequence(group)


def _sequence(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, counts = [], []
    if max(map(len, group)) <= 2 * PIECE:
        raw = b" ".join(group)
        hashes, starts = hash_words(raw)
        ends = np.cumsum([len(g) + 1 for g in group])
        counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
        words = [hashes]
    else:
        for raw in group:  # a very long text goes piece by piece, cut between words
            at, n = 0, 0
            while at < len(raw):
                cut = GAP.search(raw, min(len(raw), at + PIECE))
                stop = cut.start() if cut else len(raw)
                words.append(hash_words(raw[at:stop])[0])
                n, at = n + len(words[-1]), stop + 1
            counts.append(n)
    counts = np.asarray(counts, dtype=np.int64)
    seq = np.empty(int(counts.sum()) + 2 * len(counts), dtype=np.uint64)
    last = np.cumsum(counts + 2) - 1
    seq[last], seq[last - counts - 1] = END, START
    inner = np.ones(len(seq), dtype=bool)
    inner[last] = inner[last - counts - 1] = False
    seq[inner] = np.concatenate(words) if words else np.empty(0, np.uint64)
    return seq, counts


def bigrams(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent tokens inside texts."""
    inside = seq[:-1] != END
    return seq[:-1][inside], seq[1:][inside]


def small(values: np.ndarray) -> bytes:
    """Counts in one byte each; 255 and more follow as position and value."""
    big = np.flatnonzero(values >= 255)
    head = np.array([len(values), len(big)], dtype=np.uint64)
    low = np.minimum(values, 255).astype(np.uint8)
    return b"".join((head.tobytes(), low.tobytes(), bytes(-len(low) % 8), big.astype(np.uint64).tobytes(), values[big].astype(np.uint64).tobytes()))


def unsmall(raw) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One-byte counts, positions and values of the large ones, and the bytes that were read."""
    data = np.frombuffer(raw, dtype=np.uint8) if isinstance(raw, bytes) else raw
    n, big = (int(x) for x in data[:16].view(np.uint64))
    at = 16 + n + -n % 8
    return data[16 : 16 + n], data[at : at + 8 * big].view(np.uint64), data[at + 8 * big : at + 16 * big].view(np.uint64), at + 16 * big


def whole_counts(raw: bytes) -> np.ndarray:
    low, at, value, _ = unsmall(raw)
    out = low.astype(np.int64)
    out[at.astype(np.int64)] = value.astype(np.int64)
    return out


class Table:
    """A file with sorted 64-bit keys and one-byte columns, mapped into memory."""

    @staticmethod
    def write(path: str, keys: np.ndarray, *columns: np.ndarray) -> None:
        """Under its final name only when whole; a repeated task writes the same."""
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(np.array([len(keys), len(columns)], dtype=np.uint64).tobytes())
            f.write(np.ascontiguousarray(keys, dtype=np.uint64).tobytes())
            for c in columns:
                f.write(small(c))
        os.replace(part, path)

    def __init__(self, path: str):
        self.keys, self.columns = np.empty(0, np.uint64), []
        if not os.path.exists(path):  # a shard without entries
            return
        data = np.memmap(path, dtype=np.uint8, mode="r")
        n, columns = (int(x) for x in data[:16].view(np.uint64))
        self.keys, at = data[16 : 16 + 8 * n].view(np.uint64), 16 + 8 * n
        for _ in range(columns):
            low, big, value, size = unsmall(data[at:])
            self.columns.append((low, big, value))
            at += size

    def find(self, keys: np.ndarray, columns: int) -> list[np.ndarray]:
        """Columns for sorted keys; 0 for keys that aren't there."""
        out = [np.zeros(len(keys), dtype=np.int64) for _ in range(columns)]
        if not len(self.keys) or not len(keys):
            return out
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == keys)
        for values, (low, big, value) in zip(out, self.columns):
            found = low[at[hit]].astype(np.int64)
            large = np.flatnonzero(found == 255)
            found[large] = value[np.searchsorted(big, at[hit[large]].astype(np.uint64))].astype(np.int64)
            values[hit] = found
        return out


@lru_cache(maxsize=4096)
def _table(path: str) -> Table:
    return Table(path)


def _find(folder: str, kind: str, shards: int, shard: np.ndarray, keys: np.ndarray, columns: int) -> list[np.ndarray]:
    """Columns for keys in any order, each looked up in its shard's file."""
    order = np.lexsort((keys, shard))
    out = [np.zeros(len(keys), dtype=np.int64) for _ in range(columns)]
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        part = order[cuts[s] : cuts[s + 1]]
        for o, v in zip(out, _table(f"{folder}/{kind}-{s}").find(keys[part], columns)):
            o[part] = v
    return out


def summed(keys: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of values by keys, in order of the keys (the last one first)."""
    order = np.lexsort(keys)
    keys, values = [k[order] for k in keys], values[order]
    first = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))) if len(values) else np.empty(0, np.int64)
    return [k[first] for k in keys], np.add.reduceat(values, first) if len(first) else values


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash; their number is a power of two."""
    return (h >> np.uint64(65 - shards.bit_length())).astype(np.int64) if shards > 1 else np.zeros(len(h), np.int64)


COUNTED = "shard long, contexts binary, runs binary, nexts binary, counts binary"


def _counted(shards: int):
    def flush(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first, second = np.concatenate(a), np.concatenate(b) & LOW48
        (second, first), counts = summed([second, first], np.ones(len(first), dtype=np.int64))
        cuts = np.searchsorted(_shard_of(first, shards), np.arange(shards + 1))
        rows = []
        for s in np.flatnonzero(np.diff(cuts)):
            f, n, c = (x[cuts[s] : cuts[s + 1]] for x in (first, second, counts))
            heads = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
            runs = np.diff(np.concatenate((heads, [len(f)])))
            six = n.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows.append((int(s), f[heads].tobytes(), small(runs), np.ascontiguousarray(six).tobytes(), small(c)))
        names = ["shard", "contexts", "runs", "nexts", "counts"]
        types = [pa.int64(), *[pa.binary()] * 4]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], 0
        for batch in batches:
            for seq, _ in sequences(batch.column(0).to_pylist()):
                x, y = bigrams(seq)
                a.append(x)
                b.append(y)
                n += len(x)
                if n >= FLUSH:
                    yield from flush(a, b)
                    a, b, n = [], [], 0
        if n:
            yield from flush(a, b)

    return run


FACTS = "kind string, shard long, keys binary, counts binary, facts array<long>"


def _classes(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, and how many are 3 or more."""
    return [*(int((counts == i).sum()) for i in (1, 2, 3, 4)), int((counts >= 3).sum())]


def _merged(folder: str, shards: int):
    """Writes one shard's bigrams and contexts; gives its part of every next token's number of contexts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        s = int(group["shard"].iloc[0])
        first = np.concatenate([np.repeat(np.frombuffer(c, np.uint64), whole_counts(r)) for c, r in zip(group["contexts"], group["runs"])])
        second = np.concatenate([_from_six(x) for x in group["nexts"]])
        counts = np.concatenate([whole_counts(x) for x in group["counts"]])
        del group
        (second, first), counts = summed([second, first], counts)
        heads = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        add = lambda x: np.add.reduceat(x.astype(np.int64), heads)
        totals = add(counts)
        Table.write(f"{folder}/context-{s}", first[heads], totals, add(counts == 1), add(counts == 2), add(counts >= 3))
        keys = pair_key(first, second)
        order = np.argsort(keys)
        Table.write(f"{folder}/pair-{s}", keys[order], counts[order])
        rows = [("pairs", s, None, None, [*_classes(counts), int(totals.sum()), len(heads), len(counts)])]
        del first, keys, order
        (nexts,), n = summed([second << np.uint64(16)], np.ones(len(second), dtype=np.int64))
        cuts = np.searchsorted(_shard_of(nexts, shards), np.arange(shards + 1))
        rows += [("next", int(t), nexts[cuts[t] : cuts[t + 1]].tobytes(), small(n[cuts[t] : cuts[t + 1]]), None) for t in np.flatnonzero(np.diff(cuts))]
        return pd.DataFrame(rows, columns=["kind", "shard", "keys", "counts", "facts"])

    return run


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _continued(folder: str):
    """Writes the number of contexts of the tokens of one range; passes the facts on."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = [("pairs", r.shard, list(r.facts)) for r in group.itertuples() if r.kind == "pairs"]
        group = group[group["kind"] == "next"]
        if len(group):
            s = int(group["shard"].iloc[0])
            keys = np.concatenate([np.frombuffer(x, np.uint64) for x in group["keys"]])
            (keys,), n = summed([keys], np.concatenate([whole_counts(x) for x in group["counts"]]))
            Table.write(f"{folder}/next-{s}", keys, n)
            out.append(("next", s, [*_classes(n), int(n.sum()), 0, 0]))
        return pd.DataFrame(out, columns=["kind", "shard", "facts"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from the numbers of counts 1 to 4.

    Where a number that a formula divides by is 0, half the count's class stands in, so that some probability is left
    for what was never seen.
    """
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    d1 = 1 - 2 * y * n2 / n1 if n1 and n2 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5
    return min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)


@dataclass(frozen=True)
class Model:
    """A model in a shared folder and the few numbers that belong to it."""

    folder: str
    shards: int
    tokens: int  # training tokens, ends of texts included
    types: int  # distinct ones
    pairs: int
    pair_discounts: tuple[float, float, float]
    next_discounts: tuple[float, float, float]
    next_left: float  # share that the unigram level leaves to the uniform one

    def log10(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of tokens `b` after contexts `a`, and the training counts of `b`."""
        with np.errstate(divide="ignore", invalid="ignore"):
            ctx, at_a = np.unique(a, return_inverse=True)
            total, n1, n2, n3 = _find(self.folder, "context", self.shards, _shard_of(ctx, self.shards), ctx, 4)
            d = self.pair_discounts
            left = (d[0] * n1 + d[1] * n2 + d[2] * n3) / total
            token, at_b = np.unique(b, return_inverse=True)
            key = (token & LOW48) << np.uint64(16)
            order = np.unique(key, return_index=True, return_inverse=True)
            nexts = _find(self.folder, "next", self.shards, _shard_of(order[0], self.shards), order[0], 1)[0][order[2]]
            lower = np.full(len(token), 1.0 / (self.types + 1))
            if self.pairs:
                lower = (nexts - _taken(nexts, self.next_discounts)) / self.pairs + self.next_left * lower
            counted = np.where(token == END, START, token)  # every text has one end and one start
            known = _find(self.folder, "context", self.shards, _shard_of(counted, self.shards), counted, 1)[0]
            pair = pair_key(a, b)
            pairs, one, at_pair = np.unique(pair, return_index=True, return_inverse=True)
            count = _find(self.folder, "pair", self.shards, _shard_of(a[one], self.shards), pairs, 1)[0][at_pair]
            seen = (count - _taken(count, d)) / total[at_a] + left[at_a] * lower[at_b]
        return np.log10(np.where(total[at_a] > 0, seen, lower[at_b])), known[at_b]


def _taken(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def train(docs: DataFrame, text: str = "text", folder: str | None = None) -> Model:
    """Count the bigrams of all texts and store the model under `folder` (default: the shared folder of checkpoints).

    Tasks count the bigrams that they read, sorted by context, and send one row for each range of context hashes; one
    task merges a range and writes its sorted hash arrays; numbers of contexts take the same way by the next token's
    hash.  The driver gets a few numbers for each range.  The folder must be mounted on every machine.
    Null and empty texts are texts of no words; an empty table gives a model that knows nothing.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    shards = max(LEAST_SHARDS, 1 << max(0, (chars // SHARD_CHARS)).bit_length())
    folder = local_path(folder or shared_folder(spark)) + f"/bigrams-{uuid.uuid4().hex}"
    os.makedirs(folder)
    counted = docs.select(text).mapInArrow(_counted(shards), COUNTED)
    merged = counted.groupBy("shard").applyInPandas(_merged(folder, shards), FACTS)
    rows = merged.groupBy("shard").applyInPandas(_continued(folder), "kind string, shard long, facts array<long>").collect()
    pairs, nexts = (np.array([r["facts"] for r in rows if r["kind"] == k] or [[0] * 8]).sum(axis=0) for k in ("pairs", "next"))
    d, e = discounts(*pairs[:4].tolist()), discounts(*nexts[:4].tolist())
    left = float((e[0] * nexts[0] + e[1] * nexts[1] + e[2] * nexts[4]) / nexts[5]) if nexts[5] else 1.0
    return Model(folder, shards, int(pairs[5]), int(pairs[6]), int(pairs[7]), d, e, left)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without the text, with n_tokens, n_known, base_score, score and perplexity.

    A null text counts as empty: it has one token, its end.  Columns of these names in `docs` are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "base_score", "score", "perplexity")]
    made = ["n_tokens", "n_known", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for seq, words in sequences(batch.column(0).to_pylist()):
                value, count = model.log10(*bigrams(seq))
                base = np.log10((count + 1) / (model.tokens + model.types + 1))
                first = np.cumsum(words + 1) - words - 1
                for o, x in zip(out, (np.diff(np.concatenate((first, [len(value)]))), np.add.reduceat((count > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(value, first))):
                    o.append(x)
            n, known, base, value = (np.concatenate(o) if o else np.empty(0) for o in out)
            yield pa.record_batch([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(value, pa.float64()), pa.array(10.0 ** (-value / np.maximum(n, 1)), pa.float64())], names=[*kept, *made])

    rows = docs.select(F.col(text).alias("_text"), *kept)
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(run, ", ".join([*kinds, "n_tokens long, n_known long, base_score double, score double, perplexity double"]))
