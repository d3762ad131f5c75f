"""Near-duplicates by SimHash of word shingles, confirmed by their Jaccard similarity; partitions that close sets have in
common find the pairs whose fingerprints lie further apart, so the result is exact."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm import simhash
from strideframe.llm.common import first_of_groups, join_counted, sift, slot_of
from strideframe.llm.components import components
from strideframe.session import stage

SEED = 42
#: Documents are near-duplicates from 4/5 of shared shingles on; `PARTITIONS` and `keys_of` rest on this value.
SHARED, OF = 4, 5
#: Fingerprints that share a bucket link at BITS_APART or fewer differing bits, which reaches a similarity of 0.8; up to
#: BITS_SURE bits they always share one.  What shares none is left to the partitions.
BITS_SURE, BITS_APART = 4, 14
#: Size classes grow by OF / SHARED, so two close sets are in the same or in neighbouring classes.
CLASSES = (OF / SHARED) ** np.arange(128)
#: Into how many partitions sets that meet in a class are dealt: more than may differ between two close ones.
PARTITIONS = (0.4 * CLASSES[1:]).astype(np.int64) + 1
#: Shingles are hot when HOT_LEAST of about HOT_SAMPLE sampled documents have them; at most HOT_MOST are shipped.
#: They decide what is compared first, never what is found.
HOT_SAMPLE, HOT_LEAST, HOT_MOST = 4096, 4, 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Texts are hashed together up to AT_ONCE bytes, words by eight bytes at a time up to LONG_WORD bytes.
AT_ONCE, LONG_WORD = 1 << 20, 64
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def _spread(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: each bit of x changes about half of all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; words as in `simhash.fingerprint`, fewer are one shingle."""
    return next(shingle_sets([text], words))


def shingle_sets(texts: Iterable[str | None], words: int = 5) -> Iterator[np.ndarray]:
    """`shingles` of each text; short texts are hashed together."""
    held, size = [], 0
    for t in texts:
        held.append((t or "").encode().lower())
        size += len(held[-1]) + 1
        if size > AT_ONCE:
            yield from _hashed(held, words)
            held, size = [], 0
    yield from _hashed(held, words)


def _hashed(raws: list[bytes], words: int) -> Iterator[np.ndarray]:
    raw = np.frombuffer(b" ".join(raws) + b" " * 8, np.uint8)
    edges = np.flatnonzero(np.diff(BLANK.take(raw), prepend=True))  # a word's start, its end, and so on
    starts, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from each place on
    word = _spread(_spread(size.astype(np.uint64)) ^ (eight[starts] & FIRST_BYTES.take(np.minimum(size, 8))))
    rest, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(rest):
        word[rest] = _spread(word[rest] ^ (eight[starts[rest] + at] & FIRST_BYTES.take(np.minimum(size[rest] - at, 8))))
        at += 8
        rest = rest[size[rest] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        word[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + size[i]].tobytes(), SEED)
    first = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))  # of the words, for each text and the end
    count, run, few = np.diff(first), np.zeros(len(word), np.uint64), np.zeros(len(raws), np.uint64)
    word = np.concatenate((word, np.zeros(words, np.uint64)))
    for i in range(words):
        run = run * MIX + word[i : i + len(run)]
        whole = np.flatnonzero(count == i + 1)
        few[whole] = run[first[whole]]
    run, few = _spread(run), _spread(few)
    for i, n in enumerate(count.tolist()):
        found = np.sort(run[first[i] : first[i] + n - words + 1] if n > words else few[i : i + min(n, 1)])
        yield found[np.diff(found, prepend=~found[:1]) != 0]


def node_of(hashes: np.ndarray) -> int:
    """A signed long that stands for the set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The set's SimHash as a signed long."""
    return int(np.uint64(simhash.majority(hashes)).astype(np.int64))


def sketch(hashes: np.ndarray) -> bytes:
    """Parity of the hashes that fall on each of about as many bits as there are hashes, a power of two, at least 64.

    Two sets differ in at least as many hashes as their sketches differ in bits, also after both are folded to a length.
    """
    bits = 1 << max(6, (len(hashes) - 1).bit_length())
    count = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), np.uint64)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0)
    return out


def keys_of(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Keys of which two sets with a Jaccard similarity of 0.8 or more share at least one.

    A set of s shingles differs from a close one in at most s / 4 of them (both sides counted).  They are dealt to k
    partitions by their hash, so at least k - s / 4 partitions are the same in both.  Partitions without a shingle,
    with hot ones only or with a single one are left out as far as they are fewer than that; what is left out depends
    on a partition's contents alone, so of the common ones at least one is a key of both sets.  `hot` is sorted.
    """
    return set_keys([hashes], hot)[0]


def set_keys(sets: list[np.ndarray], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`keys_of` all sets, none of them empty, and the place of each key's set."""
    size, hashes = np.array([len(s) for s in sets]), np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), size)
    own = np.searchsorted(CLASSES, size, "right") - 1
    cold = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] != hashes if len(hot) else np.ones(len(hashes), bool)
    mixed, out = _mixed(hashes), []
    for at in (own, own + 1):  # the class where a set meets its own and smaller ones, and that where it meets larger ones
        k = PARTITIONS[at]
        first, n = np.cumsum(k) - k, int(k.sum())
        part = first[of] + ((hashes >> np.uint64(7)) % k.astype(np.uint64)[of]).astype(np.int64)
        count, colds = np.bincount(part, minlength=n), np.bincount(part[cold], minlength=n)
        total = np.zeros(n, np.uint64)
        np.add.at(total, part, mixed)
        owner = np.repeat(np.arange(len(sets)), k)
        kept, done, least = np.ones(n, bool), np.zeros(len(sets), bool), k - size // 4
        for weak in ((colds == 0) | (count == 1), colds == 0):
            now = ~done & (np.add.reduceat(weak, first, dtype=np.int64) < least)
            kept &= ~(weak & now[owner])
            done |= now
        kept = np.flatnonzero(kept)
        owner = owner[kept]
        local = (kept - first[owner] + ((at[owner] + 1) << 32)).astype(np.uint64)
        out.append((_mixed(total[kept] + _mixed(local)), owner))
    keys, owners = (np.concatenate(c) for c in zip(*out))
    return keys.view(np.int64), owners


def _each(docs: DataFrame, columns: str, row, words: int) -> DataFrame:
    """`row` of the shingles of each text that has some, as record batches of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                sets = [s for s in shingle_sets(b.column(0).slice(at, 256).to_pylist(), words) if len(s)]
                if sets:
                    yield row(sets)

    return docs.select("text").mapInArrow(run, columns)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))


def _nodes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, hash, node, fp (fingerprint), size and sketch (null without words) of every row."""
    names = ["doc_id", "hash", "node", "fp", "size", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                c = b.slice(at, 1024)
                of = [(node_of(s), fingerprint_of(s), len(s), sketch(s)) if len(s) else (None,) * 4 for s in shingle_sets(c.column(2).to_pylist(), words)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([c.column(0), c.column(1), *map(pa.array, zip(*of), kinds)], names=names)

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hash long, node long, fp long, size long, sketch binary")


def _keyed(docs: DataFrame, hot: np.ndarray, words: int) -> DataFrame:
    def row(sets):
        keys, owners = set_keys(sets, hot)
        nodes = np.array([node_of(s) for s in sets], np.int64)
        return pa.record_batch([pa.array(keys), pa.array(nodes[owners])], names=["key", "node"])

    return _each(docs, "key long, node long", row, words)


def _hot(docs: DataFrame, n: int, words: int) -> np.ndarray:
    """Shingles that many documents of a sample have, sorted."""
    sample = docs.where(F.pmod("hash", F.lit(max(1, n // HOT_SAMPLE))) == 0).dropDuplicates(["hash"])
    each = _each(sample, "x array<long>", lambda sets: pa.record_batch([_lists(sets)], names=["x"]), words)
    found = each.select(F.explode("x").alias("x")).groupBy("x").count().where(F.col("count") >= HOT_LEAST)
    return np.sort(np.array([r["x"] for r in found.orderBy(F.desc("count"), "x").limit(HOT_MOST).collect()], np.int64).view(np.uint64))


def _with_ends(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of `docs` whose texts the pairs' nodes stand for, and few others, so that no other text is split again."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "hash"), "node")
    return sift(docs, F.col("hash"), ends, "hash")


def _close(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (a, b: nodes; staged) whose shingles are close enough; exact."""
    ends = stage(pairs.select("a", F.explode(F.array("a", "b")).alias("node")).groupBy("node", slot_of("node").alias("slot")).agg(
        F.count(F.lit(1)).alias("n_rows")))
    each = _each(docs, "node long, x array<long>", lambda sets: pa.record_batch([pa.array([node_of(s) for s in sets]), _lists(sets)], names=["node", "x"]), words)
    # copies of a set meet only on their way through the first, partial aggregation
    sets = sift(each, F.col("node"), ends, "node").groupBy("node").agg(F.first("x").alias("x"))
    sets = stage(sets.join(ends, "node").select("node", "slot", "n_rows", "x"))
    total = ends.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    for end in ("a", "b"):
        own = sets.withColumnsRenamed({"node": end, "x": f"x_{end}"})
        pairs = join_counted(pairs, own, [end], total, F.xxhash64("a", "b")).drop("n_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(OF * both >= SHARED * (len(x) + len(y) - both))
            yield pa.record_batch([c.filter(pa.array(near, pa.bool_())) for c in (b.column(0), b.column(1))], names=["a", "b"])

    return stage(pairs.select("a", "b", "x_a", "x_b").mapInArrow(run, "a long, b long"))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a key's nodes with different labels that may be close; rows (key, label, node, size, sketch) come by key and label.

    Sketches prove most pairs to be too far apart, and those leave nothing behind.
    """
    held: list[tuple] = []
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def pairs() -> None:
        _, label, node, size = (np.array(c, np.int64) for c in zip(*(r[:4] for r in held)))
        bits = folded([r[4] for r in held])
        for at in (np.flatnonzero(label[1:] != label[:-1]) + 1).tolist():  # those before a label's first, with its nodes
            for x in range(at, at + int(np.searchsorted(label[at:], label[at], "right"))):
                far = np.bitwise_count(bits[:at] ^ bits[x]).sum(axis=1, dtype=np.int64)
                near = node[:at][9 * far <= size[:at] + size[x]]  # sets of 0.8 differ in a ninth of both sizes at most
                if len(near):
                    out.append((np.minimum(near, node[x]), np.maximum(near, node[x])))

    def sent() -> pa.RecordBatch:
        a, b = (np.concatenate(c) for c in zip(*out))
        out.clear()
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != r[0]:
                pairs()
                held = []
                if len(out) > 1000:
                    yield sent()
            held.append(r)
    if held:
        pairs()
    if out:
        yield sent()


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b: nodes, a < b): SimHash links their fingerprints.

    A fingerprint stands for its least node; each other node that has it is a candidate with that one.
    """
    of = stage(nodes.groupBy("fp", slot_of("fp").alias("slot")).agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n_rows")))
    n, n_nodes = of.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    same = join_counted(nodes.select("fp", "node"), of, ["fp"], n_nodes, F.col("node")).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    links = stage(simhash.near_fingerprints(of, n, BITS_SURE, BITS_APART).distinct())
    ends = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp", slot_of("fp").alias("slot")).agg(F.count(F.lit(1)).alias("n_rows"))
    ends, total = stage(ends.join(of.select("fp", "lead"), "fp").select("fp", "slot", "n_rows", "lead")), 2 * links.count()
    for end in ("a", "b"):
        links = join_counted(links, ends.withColumnRenamed("fp", end), [end], total, F.xxhash64("a", "b")).drop("n_rows").withColumnRenamed("lead", f"lead_{end}")
    apart = links.select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b"))
    return stage(same.unionByName(apart).where("a <> b").distinct())


def near_links(docs: DataFrame, nodes: DataFrame, n: int, words: int = 5) -> DataFrame:
    """Links (a, b) between nodes that connect them as all pairs of close sets would.

    `docs` has hash and text, `nodes` node, fp, size, sketch and the hash of a text, once for each.  Nodes whose fingerprints SimHash links are
    compared first.  A fifth of the shingles may change more bits than blocks of fingerprints can bridge, so nodes that
    share a key are candidates too.  Each of them is compared with its key's lead, the node that shares keys with most
    others: the original of many copies is close to all of them.  Of what is then still apart only pairs that their
    sketches leave possible are compared; a key's members are linear in its rows, and pairs arise only where sets are
    close or nearly so.  No documents give no links.
    """
    printed = _by_fingerprint(nodes)
    found = _close(_with_ends(docs, printed, nodes), printed, words)
    hot = _hot(docs, n, words)
    keyed = _keyed(docs, hot, words)
    shared = keyed.groupBy("key", slot_of("key").alias("slot")).agg(F.min("node").alias("least"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n_rows"))
    shared = stage(shared.where("least <> last").select("key", "slot", "n_rows"))
    total = shared.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    members = join_counted(sift(keyed, F.col("key"), shared, "key"), shared, ["key"], total, F.col("node")).where("n_rows is not null")
    members = stage(members.groupBy("key", "node").agg(F.first("n_rows").alias("n_rows")))
    popular = members.join(members.groupBy("node").agg(F.sum("n_rows").alias("meets")), "node")
    leads = popular.groupBy("key", slot_of("key").alias("slot")).agg(F.max(F.struct("meets", "node"))["node"].alias("lead"), F.count(F.lit(1)).alias("n_rows"))
    members = stage(join_counted(members.drop("n_rows"), leads, ["key"], total, F.col("node")).select("key", "node", "lead"))
    led = members.where("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
    led = stage(led.distinct().join(printed, ["a", "b"], "left_anti"))
    links = stage(found.unionByName(_close(_with_ends(docs, led, nodes), led, words)))
    label = components(links)
    named = stage(members.join(label, "node", "left").select("key", F.coalesce("label", "node").alias("label"), "node"))
    open_keys = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count(F.lit(1)).alias("n")).where("l <> m and n > 2").select("key")
    rows = named.join(open_keys, "key", "left_semi").join(nodes, "node").repartition("key").sortWithinPartitions("key", "label", "node")
    left = rows.select("key", "label", "node", "size", "sketch").mapInArrow(_across, "a long, b long").distinct()
    left = stage(left.join(printed.unionByName(led), ["a", "b"], "left_anti"))
    return links.unionByName(_close(_with_ends(docs, left, nodes), left, words))


def keep_first(docs: DataFrame, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of documents connected by a Jaccard similarity of 0.8 or more, with all columns of `docs`.

    SimHash finds candidates, partitions those that it can't; all are confirmed by their shingles.  It is the row with the smallest doc_id (null ids last), then by text.  Texts without words are one group; rows that
    repeat id and text are one; an empty table gives an empty result.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    rows = stage(_nodes(slim, words))
    nodes = stage(rows.where("node is not null").groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "size", "sketch", "hash")]))
    label = components(near_links(slim, nodes, rows.count(), words))
    rows = rows.join(label, "node", "left").select("doc_id", "hash", F.coalesce("label", "node").alias("label"))
    return first_of_groups(docs, rows, "label", doc_id, text)
