"""Repeated passages by super-k-mers: windows that share a minimiser travel to its bucket as one string."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import join_counted, slot_of
from strideframe.session import stage

SEED = 42
#: Words of a minimiser.
MINIMISER = 5
#: Texts that a task cuts at a time, and super-k-mers that it gathers before it sends them on, in bytes.
CHUNK, FLUSH = 2 << 20, 64 << 20
#: Text for a bucket in bytes, and the bytes of super-k-mers beyond which a bucket is dealt again, window by window.
BUCKET, MOST = 12 << 20, 128 << 20
#: Minimisers that a share of 1/HOT_LEAST of about HOT_SAMPLE sampled documents have are dealt by window at once;
#: at most HOT_MOST are shipped.  They decide where windows meet, never what is found.
HOT_SAMPLE, HOT_LEAST, HOT_MOST = 16384, 100, 1 << 16
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
PLACES = np.uint64(0xFFFF)
#: Where an occurrence starts: documents with an id first, by id and text hash, then the number of the word.
PLACE = "no_id boolean, doc_id long, hash long, start long"


class Cut:
    """Super-k-mers of some documents: their words joined by single spaces, and numpy columns with one entry for each."""

    def __init__(self, texts: list[bytes], words: int):
        split = [t.split() for t in texts]
        flat = [w for s in split for w in s]
        self.joined = b" ".join(flat)
        sizes = np.array([len(s) for s in split], np.int64)
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.words = words
        first = np.cumsum(sizes) - sizes
        h = xxhash.xxh3_64_intdigest
        hashes = np.fromiter(map(h, flat), np.uint64, len(flat))
        n = len(flat) - words + 1
        if n <= 0:
            self.doc = self.at = self.count = self.mini = self.first = np.empty(0, np.int64)
            return
        grams = np.zeros(len(flat) - MINIMISER + 1, np.uint64)
        for j in range(MINIMISER):
            grams = (grams ^ hashes[j : j + len(grams)]) * MULTIPLIERS[j]
            grams ^= grams >> np.uint64(32)
        # the value in the high bits, then the place: the first of equal values wins
        least = (grams & ~PLACES) | (np.arange(len(grams), dtype=np.uint64) & PLACES)
        span, width = words - MINIMISER + 1, 1
        while width < span:
            step = min(width, span - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        doc = np.repeat(np.arange(len(texts)), sizes)
        inside = doc[:n] == doc[words - 1 :]
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | ~inside[:-1] | (doc[1:n] != doc[: n - 1])
        at = np.flatnonzero(new & inside)
        # a run ends where the next begins or where windows leave the document
        run = np.cumsum(new)
        self.count = np.bincount(run[inside], minlength=run[-1] + 1)[run[at]]
        self.at, self.doc, self.mini = at, doc[at], least[at] >> np.uint64(16)
        self.first = first

    def strings(self, at: np.ndarray, count: np.ndarray) -> list[bytes]:
        begin, end = self.starts[at].tolist(), self.ends[at + count + self.words - 2].tolist()
        return [self.joined[b:e] for b, e in zip(begin, end)]

    def rows(self, hot: np.ndarray) -> Iterator[tuple[bytes, int, int, int]]:
        """String, minimiser, document and starting word; windows with hot minimisers each by itself, named by its hash."""
        is_hot = np.isin(self.mini, hot) if len(hot) else np.zeros(len(self.at), bool)
        at, doc = self.at[~is_hot], self.doc[~is_hot]
        start = (at - self.first[doc]).tolist()
        yield from zip(self.strings(at, self.count[~is_hot]), self.mini[~is_hot].tolist(), doc.tolist(), start)
        if is_hot.any():
            count = self.count[is_hot]
            each = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at, doc = np.repeat(self.at[is_hot], count) + each, np.repeat(self.doc[is_hot], count)
            strings = self.strings(at, np.ones(len(at), np.int64))
            minis = [xxhash.xxh3_64_intdigest(s, SEED) >> 16 for s in strings]
            yield from zip(strings, minis, doc.tolist(), (at - self.first[doc]).tolist())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[bytes]]]:
    """Ids, hashes and texts of documents, about CHUNK bytes at a time."""
    ids, hashes, texts, size = [], [], [], 0
    for b in batches:
        for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            t = t.as_py()
            if not t:
                continue
            ids.append(i)
            hashes.append(h)
            texts.append(t.encode())
            size += len(texts[-1])
            if size > CHUNK:
                yield ids, hashes, texts
                ids, hashes, texts, size = [], [], [], 0
    if texts:
        yield ids, hashes, texts


class Pack:
    """Rows of numbers, with a string each or none, as compressed bytes."""

    @staticmethod
    def write(kinds: tuple, rows: list[tuple], strings: list[bytes] = ()) -> bytes:
        data = [np.array(c, k).tobytes() for c, k in zip(zip(*rows), kinds)]
        lengths = np.array([len(s) for s in strings], np.int32).tobytes()
        return zstandard.compress(b"".join([np.array([len(rows)], np.int64).tobytes(), *data, lengths, *strings]), 1)

    @staticmethod
    def read(kinds: tuple, pack: bytes) -> tuple[list[np.ndarray], bytes]:
        """The columns, at last the lengths of the strings if there are any, and the strings."""
        data = zstandard.decompress(pack)
        n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
        for k in (*kinds, np.int32):
            if at < len(data):
                out.append(np.frombuffer(data, k, n, at))
                at += out[-1].nbytes
        return out, data[at:]


#: Columns of packs: minimiser and place of a string; place and number of words of a stretch that occurs earlier.
STRINGS, STRETCHES = (np.uint64, np.bool_, np.int64, np.int64, np.int64), (np.bool_, np.int64, np.int64, np.int64, np.int64)


def _packed(docs: DataFrame, hot: np.ndarray, words: int, buckets: int) -> DataFrame:
    """bucket and pack: of equal strings in a task's stretch of documents the first travels to its bucket.

    The others occur earlier for certain; as stretches they go to any task, under a bucket below 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, tuple]] = {}
        later: list[tuple] = []
        size, any_task = 0, 0
        row = lambda bucket, pack: pa.record_batch([pa.array([bucket], pa.int64()), pa.array([pack], pa.binary())], names=["bucket", "pack"])
        for ids, hashes, texts in _chunks(batches):
            names = [(i is None, i or 0, h) for i, h in zip(ids, hashes)]
            for string, mini, doc, start in Cut(texts, words).rows(hot):
                place = (*names[doc], start)
                found = held.get(string)
                if found is None:
                    held[string] = (mini, place)
                    size += len(string) + 350
                    continue
                if place == found[1]:  # a row that repeats
                    continue
                if place < found[1]:
                    held[string], place = (mini, place), found[1]
                later.append((*place, string.count(b" ") + 1))
            if len(later) > 50_000:
                any_task = any_task * 31 + hashes[0]
                yield row(-1 - any_task % buckets, Pack.write(STRETCHES, later))
                later = []
            if size > FLUSH:
                yield from sent(held, row)
                held, size = {}, 0
        yield from sent(held, row)
        if later:
            yield row(-1 - (any_task * 31 + later[0][2]) % buckets, Pack.write(STRETCHES, later))

    def sent(held: dict, row) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[bytes]] = {}
        for string, (mini, _) in held.items():
            by_bucket.setdefault(mini % buckets, []).append(string)
        for bucket, strings in by_bucket.items():
            yield row(bucket, Pack.write(STRINGS, [(held[s][0], *held[s][1]) for s in strings], strings))

    return docs.select("doc_id", "hash", "text").mapInArrow(run, "bucket long, pack binary")


FOUND = (pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


class Found:
    """Rows found in a bucket: stretches of words that occur earlier, or (with `win`) windows to be dealt again."""

    def __init__(self):
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*self.rows), FOUND)], names=["win", "no_id", "doc_id", "hash", "start", "n"])
        self.rows = []
        return out


def _windows(string: bytes, words: int) -> list[bytes]:
    ends = [i for i, c in enumerate(string) if c == 32] + [len(string)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    return [string[starts[j] : ends[j + words - 1]] for j in range(len(ends) - words + 1)]


def _sorted_bucket(packs: list[bytes], words: int, found: Found) -> Iterator[pa.RecordBatch]:
    """Covered words of a bucket's documents: windows are sorted with their first places, equal ones stand together."""
    parts = [Pack.read(STRINGS, p) for p in packs]
    mini, *places, length = (np.concatenate(c) for c in zip(*(p[0] for p in parts)))
    text = b"".join(p[1] for p in parts)
    del parts
    offset = np.cumsum(length, dtype=np.int64) - length
    order = np.argsort(mini, kind="stable")
    value = mini[order]
    shared = np.zeros(len(order), bool)  # a string that has its minimiser alone has no window twice
    shared[1:] |= value[1:] == value[:-1]
    shared[:-1] |= value[1:] == value[:-1]
    shared = order[shared]
    for group in np.split(shared, np.flatnonzero(np.diff(mini[shared])) + 1) if len(shared) else ():
        firsts: dict[bytes, list] = {}
        for r in group.tolist():
            firsts.setdefault(text[offset[r] : offset[r] + length[r]], []).append(tuple(c[r].item() for c in places))
        rows = []
        for s, held in firsts.items():
            held = sorted(set(held))
            found.rows += [(None, *o, s.count(b" ") + 1) for o in held[1:]]
            if len(firsts) > 1:
                rows += [(w, (*held[0][:3], held[0][3] + j)) for j, w in enumerate(_windows(s, words))]
        rows.sort()
        found.rows += [(None, *p, words) for (w, p), (v, _) in zip(rows[1:], rows) if w == v]
        if len(found.rows) > 20000:
            yield found.batch()


def _dealt_again(pack: bytes, words: int, found: Found) -> Iterator[pa.RecordBatch]:
    """The windows of a pack with their places."""
    (_, *places, length), text = Pack.read(STRINGS, pack)
    at = 0
    for size, *place, start in zip(length.tolist(), *(c.tolist() for c in places)):
        found.rows += [(w, *place, start + j, words) for j, w in enumerate(_windows(text[at : at + size], words))]
        at += size
        if len(found.rows) > 20000:
            yield found.batch()


def _counted(packed: DataFrame, words: int) -> DataFrame:
    """Stretches found in each bucket (win null); windows of buckets that outgrow MOST bytes, to be dealt again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, packs, size, found = None, [], 0, Found()
        for b in batches:
            for k, pack in zip(b.column(0).to_pylist(), b.column(1)):
                pack = pack.as_py()
                if k < 0:
                    columns, _ = Pack.read(STRETCHES, pack)
                    found.rows += zip(repeat(None), *(c.tolist() for c in columns))
                    yield found.batch()
                    continue
                if k != bucket:
                    if packs:
                        yield from _sorted_bucket(packs, words, found)
                    bucket, packs, size = k, [], 0
                packs.append(pack)
                size += zstandard.frame_content_size(pack)
                if size > MOST:  # no pack of the bucket has been sorted yet: all of them go on
                    for p in packs:
                        yield from _dealt_again(p, words, found)
                    packs = []
        if packs:
            yield from _sorted_bucket(packs, words, found)
        if found.rows:
            yield found.batch()

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, f"win binary, {PLACE}, n long")


def _hot(docs: DataFrame, n: int, words: int) -> np.ndarray:
    """Minimisers that a large share of a hash sample of documents have."""
    sample = docs.where(F.pmod("hash", F.lit(max(1, n // HOT_SAMPLE))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _chunks(batches):
            cut = Cut(texts, words)
            pairs = np.unique(np.stack([cut.doc.astype(np.int64), cut.mini.astype(np.int64)]), axis=1) if len(cut.at) else np.empty((2, 0), np.int64)
            yield pa.record_batch([pa.array(pairs[1])], names=["mini"])

    each = sample.select("doc_id", "hash", "text").mapInArrow(run, "mini long")
    least = max(64, min(n, HOT_SAMPLE) // HOT_LEAST)
    found = each.groupBy("mini").count().where(F.col("count") >= least).orderBy(F.desc("count"), "mini").limit(HOT_MOST)
    return np.array([r["mini"] for r in found.collect()], np.int64).astype(np.uint64)


def repeats(docs: DataFrame, words: int = 20, bucket: int = BUCKET) -> DataFrame:
    """no_id, doc_id, hash, start and n: stretches of n words, all of whose windows of `words` words start earlier too.

    `docs` has doc_id (a whole number), hash (xxhash64 of the text) and text; staged.  Windows are cut into runs that
    share a minimiser, a run travels as the one string of its words to the minimiser's bucket, where the windows of
    strings that share it are sorted.  Strings that many documents have in common travel once from a task.  What one
    bucket cannot hold, and minimisers of many documents, are dealt by whole windows.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    hot = _hot(docs, size["n"], words)
    found = stage(_counted(_packed(docs, hot, words, max(1, size["bytes"] // bucket)), words))
    covered = found.where("win is null").drop("win")
    again = found.where("win is not null").withColumn("place", F.struct("no_id", "doc_id", "hash", "start")).select("win", "place")
    total = again.count()
    if not total:
        return covered
    firsts = again.groupBy("win", slot_of("win").alias("slot")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("place").alias("first"))
    later = join_counted(again, firsts, ["win"], total, F.xxhash64("place")).where("place > first")
    return covered.unionByName(later.select("place.*", F.lit(words).cast("long").alias("n")))


def _without(spans: list | None, text: str | None) -> tuple[int, int, bytes]:
    found = (text or "").encode().split()
    if not spans:
        return len(found), 0, b" ".join(found)
    gone = np.zeros(len(found) + 1, np.int64)
    for s, n in spans:
        gone[s] += 1
        gone[s + n] -= 1
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
    return len(found), len(found) - len(kept), b" ".join([found[i] for i in kept])


def drop_repeats(docs: DataFrame, words: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of `docs`, the text without the words that an earlier passage of `words` words or more
    covers, kept words joined by single spaces; `n_words` before and `n_removed` of them are added.

    Words are runs without `[\\x20\\x09-\\x0D]`.  A window repeats when its words start earlier too: in a row with a smaller
    doc_id (a whole number; null ids last, then by text hash), or further up in the same row; overlaps count.  Rows with the
    same id and text are one document, so none of them takes the other's words.  Windows are judged on the input.  A null
    text has no words and becomes empty; an empty table gives an empty result.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    key = F.concat_ws("|", "hash", F.when(~F.col("no_id"), F.col("doc_id")))
    spans = repeats(slim, words).groupBy(key.alias("_key")).agg(F.collect_list(F.struct("start", "n")).alias("_spans"))
    rows = docs.select(F.struct("*").alias("_doc"), F.concat_ws("|", F.xxhash64(text), F.col(doc_id).cast("long")).alias("_own"))
    rows = rows.join(spans, F.col("_own") == F.col("_key"), "left").select("_doc", F.col(f"_doc.{text}").alias("_text"), "_spans")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(spans, texts):
        out = [_without(None if s is None else [(x["start"], x["n"]) for x in s], t) for s, t in zip(spans, texts)]
        return pd.DataFrame([(n, gone, kept.decode()) for n, gone, kept in out], columns=["n_words", "n_removed", "kept"])

    rows = rows.select("_doc", cut("_spans", "_text").alias("_cut"))
    others = [F.col("_cut.kept").alias(c) if c == text else F.col(f"_doc.{c}").alias(c) for c in docs.columns]
    return rows.select(*others, "_cut.n_words", "_cut.n_removed")
