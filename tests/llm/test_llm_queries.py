"""The registered corpus queries and the pipeline on the smallest tables."""

import corpus_pipeline
import pytest
from oracle import compare, connect

from strideframe.llm.queries import QUERIES, SQL
from strideframe.session import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_one_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES[name](spark, SF)
    if name in ("op5_lm_scoring", "op7_simhash", "op8_fingerprints", "op9_language_id"):
        assert got.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty() and got.count() == docs.count()
    else:
        assert got.count() > 0


def brute_shingles(text):
    """Five-word shingles of a text, fewer words are one; texts without words are equal."""
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_dedup_differs_from_four_bits(spark):
    """A fifth of the shingles of a long text may differ, which changes more than four bits of a fingerprint."""
    import random

    from strideframe.llm import shingles, simhash

    r = random.Random(2)
    vocab = [f"w{i}" for i in range(500)]
    base = [r.choice(vocab) for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):  # copies with four edited words: 0.87 to the original, less than 0.8 to each other
        words = base[:]
        for at in r.sample(range(10, 290), 5 if i % 2 else 4):
            words[at] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(r.choice(vocab) for _ in range(80))) for i in range(20)]
    sets = {i: brute_shingles(t) for i, t in rows}
    assert min(len(sets[0] & sets[i]) / len(sets[0] | sets[i]) for i in range(1, 30)) >= 0.8
    assert min(len(sets[1] & sets[i]) / len(sets[1] | sets[i]) for i in range(2, 30)) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(x["doc_id"] for x in shingles.keep_first(docs).collect()) == [0, *range(100, 120)]
    assert simhash.keep_first(docs).count() > 21


def test_pipeline_stages(spark):
    from test_llm_operators import brute_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for _, f in corpus_pipeline.STAGES:
        found.append(stage(f(spark, found[-1], SF)))
    assert all(x.columns == docs.columns for x in found[:-1])
    start, known, lined, apart, mixed, packed = [x.toPandas() for x in found]
    assert len(known) >= 0.98 * len(start)
    want = brute_lines([(r.doc_id, r.text) for r in known.itertuples()])
    lines = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if not x.strip() or want[False, r.doc_id, k, r.text][0]) for r in known.itertuples()}
    assert dict(zip(lined.doc_id, lined.text)) == lines and (lined.n_chars == lined.text.str.len()).all()
    sets = [(brute_shingles(t), d) for d, t in sorted(lines.items())]
    left, kept = sets[:], []
    while left:  # groups in order of their smallest id
        group, left = [left[0]], left[1:]
        kept.append(group[0][1])
        while group:
            x, _ = group.pop()
            near = [y for y in left if 5 * len(x & y[0]) >= 4 * len(x | y[0])]
            left = [y for y in left if y not in near]
            group += near
    assert sorted(apart.doc_id) == kept
    assert set(mixed.doc_id) <= set(kept) and mixed.groupby("doc_id").size().max() <= 3
    assert packed.length.sum() == packed.drop_duplicates(["doc_id"]).set_index("doc_id").doc_tokens.reindex(mixed.doc_id).sum()
