"""Corpus operators against brute force, over ordinary documents and over odd ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strideframe.llm import blocknames, common, kneser_ney, langid, licenses, lines, mixing, packing, simhash, spotsigs, tokens
from strideframe.llm import components as comp

BPE = path("byte_bpe_50k.json")
KINDS = "doc_id long, text string, lang string, source string, n_chars long, score double, copies long, name string, key string, fp long, block string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), 0.5, 7, "n", "k", 1, "b")


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, copies with other spaces, line copies one word apart."""
    r = random.Random(5)
    vocab = ["the", "and", "of", "in", "Übung", "été", "año"] + ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(120)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = [say(r.randint(6, 40)) + "\n" + say(9) + "\n\n" + say(3) for _ in range(25)]
    texts = [None, "", " \n\t ", "one", "one", "ONE", "one two three four", *base, base[0], base[1] + " ", base[2].replace(" ", " \n"), base[3].replace(" ", "  ", 1)]
    for b in base[4:14]:
        words = b.split(" ")
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    for b in base[14:18]:
        texts.append(b.replace(" ", " extra ", 1))
    texts += [say(6000), "x" * 30000, "a\nb\na\n" * 3, "€" * 5000 + " end", "€" * 5000 + " end"]
    rows = [row(i * 3, t, ["en", "de", None][i % 3], ["a", "b", "", None][i % 4 if i % 3 else 0]) for i, t in enumerate(texts)]
    return rows + [rows[8], rows[9], row(None, base[5]), row(None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), KINDS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


def rows_of(df, *cols):
    return sorted(([tuple(r[c] for c in cols) for r in df.collect()]), key=str)


def test_exact_groups(odd, none):
    got = rows_of(blocknames.exact_groups(odd, block=64), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = defaultdict(list)
    for r in odd_rows():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    want = []
    for body, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in members:
            want.append((r[0], best[0], len(members), r[0] == best[0] and len(r[1] or "") == len(best[1] or ""), hashlib.sha256(body.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert blocknames.exact_groups(none).count() == 0


def test_join_counted_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") == 7, None).otherwise(F.col("id") % 50).alias("k"))
    table = rows.where("k is not null").groupBy("k", common.slot_of("k").alias("slot")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("id").alias("m"))
    got = {r["id"]: (r["n_rows"], r["m"]) for r in common.join_counted(rows, table, ["k"], 1000, F.col("id")).collect()}
    key = {i: 0 if i % 3 == 0 else None if i == 7 else i % 50 for i in range(1000)}
    by = defaultdict(list)
    for i, k in key.items():
        by[k].append(i)
    assert got == {i: (None, None) if k is None else (len(by[k]), max(by[k])) for i, k in key.items()}


def brute_lines(rows):
    seen = {(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1]}
    occ = sorted({(n, d, k, t, line.strip(SPACES)) for n, d, t in seen for k, line in enumerate(t.split("\n")) if line.strip(SPACES)}, key=lambda x: x[:3])
    first, gaps, cover = {}, {}, {}
    for n, d, k, t, line in occ:
        first.setdefault(line, (n, d, k))
    for line in first:
        w = line.split(" ")
        keys = {(tuple(w[:i]), tuple(w[i:])) for i in range(len(w) + 1)} if len(w) >= 4 else set()
        keys |= {(tuple(w[:i]), tuple(w[i + 1:])) for i in range(len(w))} if len(w) >= 5 else set()
        found = [gaps[x] for x in keys if x in gaps]
        if found:
            cover[line] = min(found)
        for x in keys:
            gaps.setdefault(x, first[line])
    out = {}
    for n, d, k, t, line in occ:
        to = cover.get(line) or first[line]
        out[n, d, k, t] = (line not in cover and first[line] == (n, d, k), None if to[0] else to[1], to[2], int(line in cover))
    return out


def test_line_decisions(odd, none):
    want = brute_lines(odd_rows())
    got = lines.line_decisions(odd).collect()
    per_row = [(None if n else d, k, *v) for r in odd_rows() if r[1] for (n, d, k, t), v in want.items() if (n, d, t) == (r[0] is None, r[0] or 0, r[1])]
    assert sorted([tuple(r) for r in got], key=str) == sorted(per_row, key=str)
    assert sum(not r["kept"] for r in got) > 20 and sum(r["edits"] for r in got) >= 10
    assert lines.line_decisions(none).count() == 0


def test_drop_lines(odd, none):
    want = brute_lines(odd_rows())
    expected = []
    for r in odd_rows():
        text = r[1]
        if text:
            keep = [line for k, line in enumerate(text.split("\n")) if not line.strip(SPACES) or want[r[0] is None, r[0] or 0, k, text][0]]
            text = "\n".join(keep)
        expected.append((r[0], text, *r[2:]))
    out = lines.drop_lines(odd)
    assert out.columns == odd.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)
    assert lines.drop_lines(none).count() == 0


def test_long_lines_one_word_apart(spark):
    words = [f"w{i}" for i in range(700)]
    texts = [words, words[:333] + words[334:], words[:5] + ["new"] + words[5:], words[:650] + ["y"] + words[651:], words[:1] + ["p", "q"] + words[1:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["first_doc_id"]) for r in lines.line_decisions(docs).collect()}
    assert got == {0: (True, 0), 1: (False, 0), 2: (False, 0), 3: (False, 0), 4: (True, 4)}


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(links, nodes):
    label = {n: n for n in nodes}
    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_near_duplicates(odd, none):
    rows = odd_rows()
    prints = [brute_fingerprint(r[1]) for r in rows]
    same = groups_of([(i, j) for i, p in enumerate(prints) for j, q in enumerate(prints) if i < j and bin(p ^ q).count("1") <= 4], range(len(rows)))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[same[i]] = min(least.get(same[i], r[0]), r[0])
    want = sorted([(r[0], f"{p:016x}", least.get(same[i])) for i, (r, p) in enumerate(zip(rows, prints))], key=str)
    assert rows_of(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(none).count() == 0


def test_blocks_lose_no_close_pair(spark, monkeypatch):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = {b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(20)} | {base[0] ^ (1 << x) ^ (1 << y) for x in range(64) for y in range(x)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    values = np.array(signed, dtype=np.int64).view(np.uint64)
    label = np.arange(len(values))
    near = [np.flatnonzero(np.bitwise_count(values ^ x) <= 4) for x in values]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    want = {f: int(label[i]) for i, f in enumerate(signed)}
    for bucket in (50_000, 200):  # the second splits the large group's buckets again
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        assert {r["fp"]: r["component_id"] for r in simhash.near_groups(rows).collect()} == want


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (2000, 2000)], "a long, b long")
    got = {r["node"]: r["label"] for r in comp.components(links).collect()}
    assert len({got[x] for x in range(n)}) == 1 and got[1000] == got[1001] != got[0] and 2000 not in got


def test_packing_is_whole_and_tight(odd, none):
    bpe = Tokenizer.from_file(BPE)
    rows = odd_rows()
    ids = [bpe.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows]
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    got = packing.pack(odd, BPE, capacity=64, group=16).toPandas()
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq["offset"].tolist() == [0, *seq["length"].cumsum().tolist()[:-1]] and seq["length"].sum() <= 64
    assert got["length"].sum() == sum(map(len, ids))
    whole = {(r[0], len(x)): x for r, x in zip(rows, ids)}
    for p in got.itertuples():
        x = whole[None if math.isnan(p.doc_id) else int(p.doc_id), p.doc_tokens]
        assert p.ids_crc32 == crc(x[p.start : p.start + p.length])
    copies = Counter((r[0], len(x)) for r, x in zip(rows, ids))
    for (d, n), own in got.groupby(["doc_id", "doc_tokens"]):
        cover = np.zeros(n, int)
        for p in own.itertuples():
            cover[p.start : p.start + p.length] += 1
        assert (cover == copies[int(d), n]).all()
    assert packing.pack(none, BPE).count() == 0


def test_best_fit_keeps_every_token():
    for seed in range(60):
        r = random.Random(seed)
        capacity = r.choice([16, 64, 1024])
        sizes = sorted([r.randint(1, capacity) if r.random() < 0.7 else r.randint(1, max(1, capacity // 8)) for _ in range(r.randint(0, 300))], reverse=True)
        windows = packing.best_fit(sizes, capacity)
        got = defaultdict(list)
        for w in windows:
            assert sum(n for _, _, n in w) <= capacity
            for item, start, n in w:
                got[item].append((start, n))
        for item, size in enumerate(sizes):
            at = 0
            for start, n in sorted(got[item]):
                assert start == at
                at += n
            assert at == size
        assert sum(capacity - sum(n for _, _, n in w) for w in windows) <= packing.LEAST_GAP * len(windows) + capacity


def test_added_tokens_in_texts(spark):
    bpe = Tokenizer.from_file(BPE)
    texts = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> x <|endoftext", "it's<|endoftext|>'s  ", "<|endoftext|>" + "word " * 100]
    want = [bpe.encode(t, add_special_tokens=False).ids for t in texts]
    assert [tokens.encode(t, BPE) for t in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.lengths(docs, BPE).collect()} == {i: len(x) for i, x in enumerate(want)}
    got = packing.pack(docs, BPE, capacity=64).toPandas()
    for i, ids in enumerate(want):
        for _, r in got[got["doc_id"] == i].iterrows():
            part = np.array([*ids, 0][r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert (r["ids_crc32"], r["doc_tokens"]) == (zlib.crc32(part.tobytes()), len(ids) + 1)


def naive_best_fit(sizes, capacity):
    """Room of the tightest window that holds a piece, looked for in all of them."""
    rooms, chosen = [], []
    for n in sizes:
        fitting = [room for room in rooms if room >= n]
        chosen.append(min(fitting) if fitting else capacity)
        if fitting:
            rooms.remove(min(fitting))
        rooms.append(chosen[-1] - n)
    return chosen, sorted(rooms)


def test_windows_are_the_tightest():
    r = random.Random(4)
    for capacity in (1, 7, 64, 1000):
        sizes = sorted((r.randint(1, capacity) for _ in range(400)), reverse=True)
        tree, chosen, rooms = packing.OpenWindows(capacity), [], {}
        for i, n in enumerate(sizes):
            w, left = tree.take(n) or (i, capacity)
            chosen.append(left)
            rooms[w] = left - n
            tree.put(w, left - n)
        want, want_rooms = naive_best_fit(sizes, capacity)
        assert (chosen, sorted(rooms.values())) == (want, want_rooms)


def test_length_table(odd, none):
    bpe = Tokenizer.from_file(BPE)
    n = np.array([len(bpe.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows()])
    table = tokens.length_table(odd, BPE)
    want = [(int(x), int((n == x).sum()), int((n <= x).sum()), int(n[n <= x].sum()), int((n > x).sum()), int(n[n > x].sum()), int(np.minimum(n, x).sum())) for x in sorted(set(n))]
    got = [tuple(r)[:7] for r in table.orderBy("n_tokens").collect()]
    assert got == want
    limits = tokens.at_limits(table, [0, 10, 10**9]).collect()
    assert {r["limit"]: r["kept_tokens"] for r in limits} == {x: int(np.minimum(n, x).sum()) for x in (0, 10, 10**9)}
    assert {r["share"]: r["n_tokens"] for r in tokens.quantiles(table, [0.5, 1.0]).collect()} == {0.5: int(np.sort(n)[math.ceil(len(n) / 2) - 1]), 1.0: int(n.max())}
    assert tokens.length_table(none, BPE).count() == 0
    assert [tuple(r) for r in tokens.at_limits(tokens.length_table(none, BPE), [5]).collect()] == [(5, 0, 0, 0, 0)]


def test_mix(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows()) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(odd.repartition(5)).collect()), key=str)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(none).count() == 0
    docs = spark.createDataFrame([row(i, "w " * (i % 37), "en", "s%d" % (i % 5 if i % 3 else 0)) for i in range(3000)], KINDS)
    for (_, target), own in mixing.mix(docs).toPandas().groupby(["source_size", "target"]):
        assert abs(own["taken"].sum() - target) <= own["size"].max()
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r["copies"] for r in mixing.mix(docs).collect())


def test_targets_fill_and_stop(spark):
    sizes = {"a": 1, "b": 100, "c": 1000, "d": 0, None: 10}
    got = {r["source"]: r["target"] for r in mixing.targets(mixing.source_weights(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        want = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if want[s] > 3 * sizes[s]}
        if not above:
            break
        full |= above
    assert got == pytest.approx(want | {s: 3.0 * sizes[s] for s in full})


def brute_kneser_ney(rows, held):
    split = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    seqs = [[0, *split(r[1])] for r in rows]
    train = [s for s, h in zip(seqs, held) if not h]
    count, pair = Counter(w for s in train for w in s[1:]), Counter(p for s in train for p in zip(s, s[1:]))
    context, nexts = Counter(w for s in train for w in s[:-1]), Counter(b for _, b in pair)
    d, e = (kneser_ney.discounts(*[Counter(c.values())[i] for i in (1, 2, 3, 4)]) for c in (pair, nexts))
    classes = defaultdict(Counter)
    for (a, _), n in pair.items():
        classes[a][min(n, 3)] += 1
    less = lambda n, x: n - (0, *x)[min(n, 3)]
    left = sum(e[min(n, 3) - 1] for n in nexts.values()) / len(pair)
    low = lambda b: less(nexts[b], e) / len(pair) + left / (len(count) + 1)
    p = lambda a, b: less(pair[a, b], d) / context[a] + sum(d[i - 1] * n for i, n in classes[a].items()) / context[a] * low(b) if context[a] else low(b)
    total = sum(count.values())
    for s in seqs:
        yield len(s) - 1, sum(count[w] > 0 for w in s[1:]), total, sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in s[1:]), sum(math.log10(p(a, b)) for a, b in zip(s, s[1:]))


def test_kneser_ney(odd, none, monkeypatch):
    monkeypatch.setattr(kneser_ney, "PIECE", 2000)  # long texts go in pieces
    rows = odd_rows()
    held = [zlib.crc32(str(r[0]).encode()) % 7 == 2 if r[0] is not None else False for r in rows]
    docs = odd.withColumn("held_out", common.crc_part("doc_id", 7) == 2)
    model = kneser_ney.train(docs.where("not held_out"))
    got = sorted(kneser_ney.score(docs, model).collect(), key=lambda r: (r["n_tokens"], r["score"]))
    want = sorted(brute_kneser_ney(rows, held), key=lambda x: (x[0], x[4]))
    assert [(r["n_tokens"], r["n_known"], model.tokens) for r in got] == [x[:3] for x in want]
    assert [r["base_score"] for r in got] == pytest.approx([x[3] for x in want]) and [r["score"] for r in got] == pytest.approx([x[4] for x in want])
    empty = kneser_ney.train(none)
    assert kneser_ney.score(none, model).count() == 0 and empty.tokens == 0
    assert all(math.isfinite(r["score"]) for r in kneser_ney.score(odd, empty).collect())


def brute_signatures(text):
    words, out = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower()), set()
    for i, x in enumerate(words):
        if x in spotsigs.ANCHORS or i in (0, len(words) - 1) or xxhash.xxh64_intdigest(x.encode(), 42) % spotsigs.OTHER == 0:
            chain = [y for y in words[i + 1 : i + 1 + spotsigs.REACH] if y not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            out.add(xxhash.xxh64_intdigest(" ".join([x, *chain]).encode(), 42) >> 32)
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("ranges", [1, 7])
def test_edited_fingerprints(spark, none, monkeypatch, ranges):
    if ranges > 1:
        monkeypatch.setattr(spotsigs, "RANGE_ROWS", 8)
    rows = [r for r in odd_rows() if r[0] is not None]
    rows = sorted({r[0]: r for r in rows}.values())
    got = {r["doc_id"]: r for r in spotsigs.edited_fingerprints(spark.createDataFrame(rows, KINDS).repartition(3)).collect()}
    as_text = lambda s: "".join(f"{x:08x}" for x in sorted(s))
    for r, after in zip(rows, rows[1:] + rows[:1]):
        text, cut = r[1] or "", len(r[1] or "") // 4
        edited = text[: len(text) - cut] + (after[1] or "")[:cut]
        a, b, c = map(brute_signatures, (text, edited, after[1]))
        g = got[r[0]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (g["fingerprint"], g["edited_fingerprint"]) == (as_text(a), as_text(b))
        assert (g["near_edited"], g["near_next"]) == pytest.approx((jaccard(a, b), jaccard(a, c)))
    assert spotsigs.edited_fingerprints(none).count() == 0


def test_repeated_and_null_ids_keep_their_rows(odd):
    got = spotsigs.edited_fingerprints(odd)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r[0]) for r in odd_rows())
    by_text = defaultdict(set)
    prints = {(r["doc_id"], r["n_chars"]): r["fingerprint"] for r in spotsigs.fingerprints(odd).collect()}
    for r in odd_rows():
        by_text[r[1] or ""].add(prints[r[0], len(r[1] or "")])
    assert all(len(x) == 1 for x in by_text.values())


def test_near_pairs(odd):
    member, pairs = spotsigs.near_pairs(odd, 0.6)
    ids = defaultdict(set)
    for r in member.collect():
        ids[r["set_id"]].add(r["doc_id"])
    sets = {}
    for r in odd_rows():
        sets.setdefault(frozenset(brute_signatures(r[1])), set()).add(r[0])
    assert len(ids) == len(sets)
    found = {frozenset((frozenset(map(str, ids[p["a"]])), frozenset(map(str, ids[p["b"]])))) for p in pairs.collect()}
    want = {frozenset((frozenset(map(str, x)), frozenset(map(str, y)))) for a, x in sets.items() for b, y in sets.items() if a and b and a != b and jaccard(a, b) >= 0.6}
    assert found == want and found


def test_language(spark, odd, none):
    says = {"en": "the house of this man is with that which they have", "de": "das haus dieses mannes ist mit dem der und nicht die", "fr": "la maison de cet homme est avec celui que nous avons"}
    r = random.Random(2)
    rows = [row(i, " ".join(r.choice(says[lang].split()) for _ in range(r.randint(5, 300))), lang) for i in range(240) for lang in [["en", "de", "fr"][i % 3]]]
    docs = spark.createDataFrame(rows, KINDS).drop("score")
    held = common.crc_part("doc_id", 4) == 2
    model = langid.fit(docs.where(~held))
    found = langid.identify(docs.where(held), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found) > 0
    assert model == langid.fit(docs.where(~held).repartition(7))
    strange = langid.identify(odd, model).collect()
    assert len(strange) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in strange)
    assert all((r["lang_pred"] == "und") == (not regex.search(r"\p{L}", r["text"] or "")) for r in strange)
    assert all(r["lang_pred"] == "und" for r in langid.identify(odd, langid.fit(none)).collect()) and langid.identify(none, model).count() == 0


def test_licenses(spark, odd, none):
    r, filler = random.Random(4), "some words that say nothing at all".split()
    say = lambda: " ".join(r.choice(filler) for _ in range(r.randint(0, 120)))
    docs, want = [], []
    for i in range(60):
        chosen = [(name, r.choice(TEMPLATES)) for name, TEMPLATES in r.sample(sorted(licenses.TEMPLATES.items()), r.randint(0, 3))]
        docs.append(row(i, " ".join(x for _, t in chosen for x in (say(), t)) + " " + say()))
        want += [(i, k, name, 0) for k, (name, _) in enumerate(chosen)]
    docs += [row(100, "this work is licenced under the GNU General Public License version 3"), row(101, "Licensed under CC BY 3.0."), row(102, "a license to say nothing")]
    want.append((100, 0, "GPL-3.0", 1))
    assert rows_of(licenses.scan(spark.createDataFrame(docs, KINDS)), "doc_id", "notice", "license", "edits") == sorted(want, key=str)
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    assert all(licenses.ANCHOR.search(t) for x in licenses.TEMPLATES.values() for t in x)
