"""Near-duplicate groups by shared shingles, and rows whose ids are null or repeat."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from test_llm_operators import KINDS, WORD, groups_of, odd_rows, row

from strideframe.llm import mixing, shingles, simhash


def brute_shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_first(rows):
    """Of each group the least row by id (null last); text hashes are left out, so ids of a group's rows differ here."""
    sets = [brute_shingles(r[1]) for r in rows]
    close = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    same = groups_of([(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if close(x, y)], range(len(rows)))
    first = {}
    for i, r in enumerate(rows):
        first[same[i]] = min(first.get(same[i], r), r, key=lambda r: (r[0] is None, r[0] or 0))
    return sorted(((r[0], brute_shingles(r[1])) for r in first.values()), key=str)


def edited_rows():
    """Texts with some words replaced, dropped or added, around a similarity of 0.8; many share a long passage."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage, texts = [word() for _ in range(60)], []
    for i in range(40):
        base = [word() for _ in range(r.choice([1, 3, 5, 8, 20, 60, 200, 400]))] + passage * (i % 3 == 0)
        for _ in range(r.randint(1, 6)):
            new = base[:]
            for _ in range(r.randint(0, 1 + len(base) // 40)):
                at = r.randrange(len(new))
                new[at : at + r.randint(0, 1)] = [word() for _ in range(r.randint(0, 1))] or [word()]
            texts.append(" ".join(new))
    return [row(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [4096, 0])
def test_close_shingles_are_found(spark, monkeypatch, hot):
    monkeypatch.setattr(shingles, "HOT_MOST", hot)
    rows = edited_rows()
    got = shingles.keep_first(spark.createDataFrame(rows, KINDS).repartition(3))
    assert sorted(((r["doc_id"], brute_shingles(r["text"])) for r in got.collect()), key=str) == brute_first(rows)
    assert len(brute_first(rows)) < len(rows) - 30  # the groups are many


def test_simhash_finds_candidates(spark, monkeypatch):
    """Each node's copies with few edited words are candidates by their fingerprints alone, and the stage takes them."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words)] + [" ".join([*words[:at], "new", *words[at + 1 :]]) for at in range(50, 400, 70)]
    rows = [row(i, t) for i, t in enumerate(texts)] + [row(100 + k, " ".join(random.Random(k).choices(words, k=60))) for k in range(20)]
    docs = spark.createDataFrame(rows, KINDS)
    sets = {shingles.node_of(s): s for r in rows if len(s := shingles.shingles(r[1]))}
    nodes = spark.createDataFrame([(k, shingles.fingerprint_of(s)) for k, s in sets.items()], "node long, fp long")
    pairs = {(r["a"], r["b"]) for r in shingles._by_fingerprint(nodes).collect()}
    apart = lambda a, b: int(simhash.far_bits(*(np.array([simhash.majority(sets[x])], np.uint64) for x in (a, b)))[0])
    assert pairs and all(a < b and apart(a, b) <= shingles.BITS_APART for a, b in pairs)
    found, sure = groups_of(pairs, sets), [(a, b) for a in sets for b in sets if a < b and apart(a, b) <= shingles.BITS_SURE]
    assert sure and all(found[a] == found[b] for a, b in sure)
    asked, close = [], shingles._close
    monkeypatch.setattr(shingles, "_close", lambda d, p, w: asked.append({(r["a"], r["b"]) for r in p.collect()}) or close(d, p, w))
    assert sorted(r["doc_id"] for r in shingles.keep_first(docs).collect()) == [0, *range(100, 120)]
    assert asked[0] and all(apart(a, b) <= shingles.BITS_APART for a, b in asked[0])  # fingerprints are asked first
    assert not asked[0] & (asked[1] | asked[2])
    assert shingles._by_fingerprint(nodes.limit(0)).count() == 0


def test_only_texts_of_pairs_are_compared(spark, monkeypatch):
    """Pairs are confirmed without splitting the texts that are in none."""
    say = lambda seed, k: " ".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz", k=k))
    texts = [say(0, 300) + f" new{i}" for i in range(4)] + [say(0, 300).upper() + " NEW0"] + [say(k, 40) for k in range(1, 60)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], KINDS).repartition(3)
    given, close = [], shingles._close
    monkeypatch.setattr(shingles, "_close", lambda d, p, w: given.append({r["doc_id"] for r in d.collect()}) or close(d, p, w))
    assert sorted(r["doc_id"] for r in shingles.keep_first(docs).collect()) == [0, *range(5, 64)]
    assert {1, 2, 3} <= given[0] | given[1] and all(ids <= set(range(5)) for ids in given)


def test_shingles_of_texts_that_are_hashed_together(monkeypatch):
    """Each text has as many hashes as different shingles, whatever stands beside it; equal shingles have equal hashes."""
    r = random.Random(3)
    letters = ["a", "b", "B", "é", "\0", "\xa0", "日", "x" * 7, "x" * 8, "y" * 63, "y" * 64, "y" * 65, "z" * 300]
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 3)))
    texts = [None, "", " \t\n", "a", "a\0", "a \0", *("".join(word() + r.choice(" \t\n\v\f\r") * r.randint(1, 2) for _ in range(r.randint(0, 12))) for _ in range(300))]
    for at_once in (1, 50, 1 << 20):
        monkeypatch.setattr(shingles, "AT_ONCE", at_once)
        sets = list(shingles.shingle_sets(texts))
        assert [len(s) for s in sets] == [len(brute_shingles(t)) for t in texts]
        assert all((np.diff(s) > 0).all() and s.tolist() == shingles.shingles(t).tolist() for s, t in zip(sets, texts))
        assert len(np.unique(np.concatenate(sets))) == len(set().union(*map(brute_shingles, texts)))
    hot, some = sets[-1], [s for s in sets if len(s)]
    keys, owners = shingles.set_keys(some, hot)
    assert all(sorted(keys[owners == i]) == sorted(shingles.keys_of(s, hot)) for i, s in enumerate(some))


def test_close_shingles_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), KINDS)
    got = shingles.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], brute_shingles(r["text"])) for r in got.collect()), key=str) == brute_first(odd_rows())
    assert shingles.keep_first(docs.limit(0)).count() == 0


def test_every_close_pair_shares_a_key():
    import numpy as np

    r = np.random.default_rng(1)
    none = np.empty(0, np.uint64)
    for _ in range(3000):
        n = int(r.integers(1, 120))
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        drop, add = int(r.integers(0, n // 5 + 1)), 0
        while 5 * (len(x) - drop) >= 4 * (len(x) + add + 1) and r.random() < 0.9:
            add += 1
        y = np.unique(np.concatenate([x[r.permutation(len(x))[drop:]], r.integers(0, 1 << 63, add).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        hot = r.choice(x, len(x) // 2) if r.random() < 0.5 else none
        if 5 * both >= 4 * (len(x) + len(y) - both):
            assert len(np.intersect1d(shingles.keys_of(x, hot), shingles.keys_of(y, hot)))


@pytest.mark.parametrize("keep_first", [simhash.keep_first, shingles.keep_first])
def test_null_and_repeated_ids_keep_their_groups(spark, keep_first):
    say = lambda seed: " ".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz", k=60))
    rows = [row(None, say(1)), row(None, say(2)), row(None, say(2)), row(5, say(3)), row(5, say(4)), row(5, say(4)), row(6, say(4)), row(7, None)]
    got = keep_first(spark.createDataFrame(rows, KINDS)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(None, say(1)), (None, say(2)), (5, say(3)), (5, say(4)), (7, None)])


def test_take_keeps_texts_of_null_and_repeated_ids(spark):
    texts = [" ".join(f"w{i}" for i in range(k, k + 9)) for k in range(6)]
    rows = [row(None if k < 3 else 4, t, source="a") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, KINDS)
    assert Counter(r["text"] for r in mixing.take(docs, most=1).collect()) == Counter(texts)
    assert mixing.take(docs).count() == sum(r["copies"] for r in mixing.mix(docs).collect())
