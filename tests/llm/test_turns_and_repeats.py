"""Conversation repair, the prefix trie and repeated passages against brute force, on odd rows too."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strideframe.llm import prefixtrie, repair, substrings
from strideframe.session import stage

TURNS = "conv_id long, turn long, role string, text string, idx long, n long, depth long, audit string, a long, part long"
PATTERN = re.compile(r"(s?(ua)+)?")


def turn_rows():
    """Conversations of many shapes: nulls everywhere, ties, repeated rows, a single one, a long one."""
    r = random.Random(11)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No", "Why?", "", " \n", None, "Well. ", "x" * 20000 + "!", "été…"]
    rows = []
    for c in [*range(0, 40), 100, 101, 103, 205, 207, 299, None]:
        for t in range(r.randint(1, 8)):
            rows.append((c, r.choice([t, t, t, None, t // 2]), r.choice(roles), r.choice(texts)))
    rows += [(7, 50 + t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(60)]
    rows += [rows[3], rows[4], rows[4]]
    return [(*x, 5, 6, 7, "n", 1, 2) for x in rows]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(turn_rows(), TURNS).repartition(3)


@pytest.fixture(scope="module")
def no_turns(spark):
    return spark.createDataFrame([], TURNS)


def brute_cheapest(rows):
    """All edits of a few rows, at most two inserts in a gap."""
    options = []
    gaps = ["", "I", "II"]
    for initial, fault in rows:
        own = [("D", 4, "")]
        if fault not in (1, 2):
            more = 3 if fault == 3 else 0
            own += [("K", more, initial), ("R", 3 + more, "?")]
        options.append([(g + a, 3 * len(g) + c, "?" * len(g) + x) for g in gaps for a, c, x in own])
    options.append([(g, 3 * len(g), "?" * len(g)) for g in gaps])
    best = None
    for chosen in itertools.product(*options):
        audit, cost, roles = ("".join(x) if isinstance(x[0], str) else sum(x) for x in zip(*chosen))
        if best and (cost, audit) >= best:
            continue
        if any(not i for (i, f), (e, _, x) in zip(rows, chosen) if e.endswith("K")):
            continue
        if any(PATTERN.fullmatch("".join(y)) for y in itertools.product(*["ua" if x == "?" else x for x in roles])):
            best = (cost, audit)
    return best


def test_cheapest_edits_of_all_short_conversations():
    kinds = [(i, f) for i in ("u", "a", "s", "t") for f in (0, 1, 3)]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert repair.cheapest(list(rows)) == brute_cheapest(rows), rows
    r = random.Random(3)
    for _ in range(25):
        rows = [(r.choice("uuaas"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(4)]
        assert repair.cheapest(rows) == brute_cheapest(rows), rows


def brute_repair(all_rows):
    by_conv = defaultdict(list)
    for c, t, role, text, *_ in all_rows:
        by_conv[c]
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault = zlib.crc32(key.encode()) % 20
        row = (t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        by_conv[c] += [] if fault == 0 else [row, row] if fault == 3 else [row]
    out = {}
    for c, rows in by_conv.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        marks, seen = [], set()
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            marks.append((role[:1], 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0))
            seen.add((role, text))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        faults = [f for _, f in marks]
        cost, audit = repair.cheapest(marks)
        fixed, left = [], rows[:]
        for letter in audit:
            role, text = left.pop(0)[1:] if letter != "I" else (None, "")
            if letter == "D":
                continue
            turn = "assistant" if fixed and fixed[-1][0][:1] == "u" else "user"
            fixed.append((role if letter == "K" else turn, text))
        assert PATTERN.fullmatch("".join(x[0][:1] for x in fixed)) and not left
        text = "\n".join(f"{a}:{b}" for a, b in fixed)
        out[c] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_repair(turns, no_turns):
    got = {r[0]: tuple(r)[1:] for r in repair.repair(turns, repair.damage(turns)).collect()}
    assert got == brute_repair(turn_rows())
    assert repair.repair(no_turns, repair.damage(no_turns)).count() == 0
    lost = repair.repair(turns, no_turns).where("cost = 0 and audit = ''")
    assert lost.count() == len(got)


def brute_trie(all_rows):
    convs = defaultdict(list)
    for c, t, role, text, *_ in all_rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(rows)] for c, rows in convs.items()}
    new = {}
    for c, rows in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = convs.get(c - c % 100, [])[:h] + rows[h:]
    members = defaultdict(list)
    for c, rows in new.items():
        for d in range(len(rows) + 1):
            members[tuple(rows[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def total(path):
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        below = [total(p) for p in children[path]]
        return (sum(x[0] for x in below) or int(not below), own + sum(x[1] for x in below))

    out = []
    for path, found in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in found if len(new[c]) == len(path)))
        out.append((min(found), len(path), min(members[path[:-1]]) if path else None, len(found), len(children[path]), *total(path), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("band, block", [(8, 256), (2, 3), (3, 1)])
def test_trie(turns, monkeypatch, band, block):
    monkeypatch.setattr(prefixtrie, "BAND", band)
    monkeypatch.setattr(prefixtrie, "BLOCK", block)
    monkeypatch.setattr(prefixtrie, "PIECE", 4)
    got = [tuple(r) for r in prefixtrie.trie(*prefixtrie.rebuilt(turns)).collect()]
    assert sorted(got, key=str) == brute_trie(turn_rows())


def test_trie_without_conversations(no_turns):
    assert prefixtrie.trie(*prefixtrie.rebuilt(no_turns)).count() == 0


DOCS = "doc_id long, text string, n_words long, n_removed long, hash long, start long, _doc string"


def document_rows():
    """Shared passages, copies, periodic texts, long and short ones, nulls, repeated ids and rows."""
    r = random.Random(13)
    vocab = ["the", "of", "Übung", "été", "x"] + ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(200)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passages = [say(n) for n in (20, 21, 25, 60, 300)]
    texts = [None, "", " \n", "one", say(19), say(20), "a b " * 40, "a " * 100, "€" * 30000, passages[4], passages[4], passages[4] + " " + passages[4]]
    for _ in range(60):
        texts.append("  \n".join([say(r.randint(0, 30)), r.choice(passages), say(r.randint(0, 30)), r.choice([*passages, ""])]))
    texts += [texts[20], texts[21].replace(" ", "\t"), say(70000)]
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    rows += [(5, texts[22]), (5, texts[23]), (None, texts[24]), (None, texts[25]), (None, None), rows[30], rows[30]]
    r.shuffle(rows)
    return [(*x, 1, 2, 3, 4, "d") for x in rows]


def brute_repeats(rows, hashes, k=20):
    """Kept text and counts of each (id, text)."""
    docs = sorted({(i is None, i or 0, hashes[t], t) for i, t, *_ in rows}, key=lambda x: x[:3])
    seen, out = set(), {}
    for no_id, i, _, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for s in range(len(words) - k + 1):
            w = tuple(words[s : s + k])
            if w in seen:
                gone.update(range(s, s + k))
            seen.add(w)
        out[None if no_id else i, t] = (len(words), len(gone), " ".join(w for n, w in enumerate(words) if n not in gone))
    return out


@pytest.mark.parametrize("how", ["plain", "small", "hot", "again"])
def test_drop_repeats(spark, monkeypatch, how):
    if how == "small":  # many packs and buckets
        monkeypatch.setattr(substrings, "CHUNK", 1000)
        monkeypatch.setattr(substrings, "FLUSH", 3000)
    if how == "hot":
        monkeypatch.setattr(substrings, "_hot", lambda docs, n, words: hot_values(docs))
    if how == "again":
        monkeypatch.setattr(substrings, "MOST", 20000)
    docs = spark.createDataFrame(document_rows(), DOCS).repartition(3)
    hashes = {r[0]: r[1] for r in docs.select("text", F.xxhash64("text")).collect()}
    got = substrings.drop_repeats(docs)
    assert got.columns[:7] == docs.columns
    want = brute_repeats(document_rows(), hashes)
    last = len(got.columns)
    rows = got.toDF(*[f"c{i}" for i in range(last)]).select("c0", "c1", f"c{last - 2}", f"c{last - 1}")
    found = sorted((str(r[0]), r[2], r[3], r[1]) for r in rows.collect())
    assert found == sorted((str(i), *want[i, t]) for i, t, *_ in document_rows())


def hot_values(docs):
    import numpy as np

    texts = [r["text"].encode() for r in docs.select("text").where("text is not null").collect()]
    values = substrings.Cut(texts, 20).mini
    return np.unique(values)[::2]


def test_drop_repeats_of_nothing(spark):
    empty = stage(spark.createDataFrame([], "doc_id long, text string"))
    assert substrings.drop_repeats(empty).count() == 0
