"""Near-duplicate lines by a deletion-neighbourhood join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import SPACE_CHARS, join_counted, sift, slot_of
from strideframe.session import stage

#: One edited word in a line of at least so many words leaves a similarity of 0.8 or more.
LEAST_WORDS = 5
#: Words that are hashed together in the running hashes.
STEP = 64


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Lines with a word: the document's id and text hash, line number, the trimmed line and its 128-bit identity."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("doc_hash"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(SPACE_CHARS))).where(F.length("line") > 0)
    return rows.withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit(1), "line")})


def _place(*more: str) -> Column:
    """Where a line stands; earlier places compare as smaller, null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no", "doc_hash", *more)


def _half_keys() -> Column:
    """Keys of which lines within one edited word share one: their first or last half, by the shorter line's length.

    Only lines that share such a key with another need their variants.
    """
    keys = []
    for n in ("n", "(n - 1)"):
        for side, words in ((0, f"{n} div 2"), (1, f"{n} div 2 - {n}")):
            keys.append(F.expr(f"if({n} >= {LEAST_WORDS - 1}, xxhash64({n}, {side}, substring_index(line, ' ', cast({words} as int))), null)"))
    return F.array_compact(F.array(*keys))


def _running(words: str, n: str) -> str:
    """SQL for the hashes of the first 0, 1, ... words, in steps so that long lines cost no square of their length."""
    ends = f"""aggregate(if({n} < {STEP}, array(), sequence(0, {n} div {STEP} - 1)), array(0L),
        (acc, s) -> array_append(acc, xxhash64(element_at(acc, -1), slice({words}, cast(s * {STEP} + 1 as int), {STEP}))))"""
    return f"""transform(array({ends}), e -> transform(sequence(0, {n}),
        i -> xxhash64(element_at(e, cast(i div {STEP} + 1 as int)), slice({words}, cast(i div {STEP} * {STEP} + 1 as int), cast(i % {STEP} as int)))))[0]"""


def _variant_keys(rows: DataFrame) -> DataFrame:
    """`key` of every variant: the line without one of its words, and the line itself seen with a gap at each place.

    A key hashes what stands before and after the gap.  Lines that share a key differ in that gap only, so any two of
    them are one edited word apart, and two lines one edited word apart share a key.
    """
    rows = rows.withColumn("w", F.transform(F.split("line", " "), lambda x: F.xxhash64(x)))
    rows = rows.withColumn("r", F.reverse("w"))
    rows = rows.withColumns({"before": F.expr(_running("w", "n")), "after": F.reverse(F.expr(_running("r", "n")))})
    whole = "transform(sequence(0, n), i -> xxhash64(before[i], after[i]))"
    less = f"if(n < {LEAST_WORDS}, array(), transform(sequence(1, n), i -> xxhash64(before[i - 1], after[i])))"
    return rows.select("id", F.explode(F.array_distinct(F.expr(f"concat({whole}, {less})"))).alias("key"))


def _one_word_apart(x: str, y: str) -> Column:
    """Whether two lines differ by one inserted, deleted or replaced word; exact."""
    a, b = f"split({x}, ' ')", f"split({y}, ' ')"
    rows = f"""transform(array(struct({a} as a, {b} as b)), p -> struct(p.a as a, p.b as b,
        array_position(transform(sequence(1, least(size(p.a), size(p.b))), i -> p.a[i - 1] = p.b[i - 1]), false) as d))[0]"""
    return F.expr(f"""transform(array({rows}), p -> transform(array(cast(if(p.d = 0, least(size(p.a), size(p.b)) + 1, p.d) as int)), d ->
        if(size(p.a) = size(p.b), slice(p.a, d + 1, size(p.a)) = slice(p.b, d + 1, size(p.b)),
        if(size(p.a) = size(p.b) + 1, slice(p.a, d + 1, size(p.a)) = slice(p.b, d, size(p.b)),
        if(size(p.b) = size(p.a) + 1, slice(p.b, d + 1, size(p.b)) = slice(p.a, d, size(p.a)), false))))[0])[0]""")


def distinct_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each distinct line: its identity (a, b), n_rows, first (its earliest place) and cover, the earliest
    place of a line before it that is one edited word away (null if none).  Staged.

    Lines of at least LEAST_WORDS words (one of the two) may differ by one word; shorter ones must be equal.  Words are
    separated by single spaces.  No pair of a group is formed: a group of lines with a common variant needs only its
    earliest member.
    """
    lines = lines_of(docs, doc_id, text)
    n = (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n")
    found = lines.select("a", "b", _place().alias("place"), n, "line")
    found = stage(found.withColumn("halves", _half_keys()).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("place").alias("first"), F.max("n").alias("n"), F.max("halves").alias("halves")))
    halves = found.select("a", F.explode("halves").alias("key"))
    shared = stage(halves.groupBy("key", slot_of("key").alias("slot")).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1"))
    total = shared.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    near = join_counted(sift(halves, F.col("key"), shared, "key"), shared, ["key"], total, F.col("a")).where("n_rows is not null").select("a").distinct()
    near = stage(found.join(near, "a", "left_semi").select("a", "b", "n", "first"))
    # texts of those lines, by the place where each stands first
    at = near.select("a", "b", "n", *[F.col(f"first.{c}").alias(f"_{c}") for c in ("no_id", "doc_id", "line_no", "doc_hash")])
    texts = sift(lines, F.col("a"), near, "a").withColumn("no_id", F.col("doc_id").isNull())
    at = at.withColumnsRenamed({"a": "_a", "b": "_b"})
    equal = [F.col(c) == F.col(f"_{c}") for c in ("a", "b", "line_no", "doc_hash")]
    texts = texts.join(at, [*equal, F.col("doc_id").eqNullSafe(F.col("_doc_id"))])
    texts = texts.select("a", "b", "n", _place().alias("first"), "line").dropDuplicates(["a", "b"])
    # ids in order of place: partitions are ranges of it
    texts = stage(texts.repartitionByRange("first").sortWithinPartitions("first", "a", "b").withColumn("id", F.monotonically_increasing_id()))
    keys = _variant_keys(texts)
    common = stage(keys.groupBy("key", slot_of("key").alias("slot")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("lead")).where("n_rows > 1"))
    total = common.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    leads = join_counted(sift(keys, F.col("key"), common, "key"), common, ["key"], total, F.col("id")).where("lead < id").groupBy("id").agg(F.min("lead").alias("lead"))
    pairs = texts.join(leads, "id").select("a", "b", "line", "lead")
    lead = texts.select(F.col("id").alias("lead"), F.col("line").alias("lead_line"), F.col("first").alias("cover"))
    pairs = pairs.join(lead, "lead").where(_one_word_apart("line", "lead_line")).select("a", "b", "cover")
    return stage(found.join(pairs, ["a", "b"], "left").select("a", "b", slot_of("a", "b").alias("slot"), "n_rows", "first", "cover"))


def line_decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line with a word: doc_id, line_no, kept, first_doc_id, first_line_no, edits.

    A line goes when an earlier line (smaller doc_id, then line number) is equal, or one edited word away from its
    text's first occurrence; `first_*` names that earlier line, itself for kept ones, and `edits` tells which.  Rows
    that repeat a doc_id with the same text are one document; with other texts their lines compare by text hash.  Null
    ids come last; null and empty texts have no lines; an empty table gives an empty result.
    """
    table = distinct_lines(docs, doc_id, text)
    rows = lines_of(docs, doc_id, text).select("doc_id", "line_no", "doc_hash", "a", "b")
    total = table.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    out = join_counted(rows, table, ["a", "b"], total, F.xxhash64("doc_id", "line_no"))
    to = F.coalesce("cover", "first")
    kept = F.col("cover").isNull() & (F.col("first") == _place())
    return out.select("doc_id", "line_no", kept.alias("kept"), to["doc_id"].alias("first_doc_id"), to["line_no"].alias("first_line_no"),
                      F.col("cover").isNotNull().cast("int").alias("edits"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the lines taken out of their texts that an earlier line covers; lines without a word stay.

    All rows and columns stay, null texts too; a document may end up with an empty text.  Columns keep their names and
    order; the text is shuffled once.
    """
    table = distinct_lines(docs, doc_id, text).where("cover is null").select("first.*", "a")
    kept = table.groupBy("no_id", "doc_id", "doc_hash").agg(F.sort_array(F.collect_set("line_no")).alias("_at"))  # one document's lines
    kept = kept.withColumnsRenamed({"doc_id": "id", "doc_hash": "hash"}).drop("no_id")
    rows = docs.select(F.struct("*").alias("doc"))
    old = F.col(f"doc.{text}")
    rows = rows.join(kept, [F.col(f"doc.{doc_id}").eqNullSafe(F.col("id")), F.xxhash64(old) == F.col("hash")], "left")
    # for each line up to the last kept one, whether it stays; linear in the number of lines
    mask = F.expr("""flatten(transform(sequence(1, size(_at)), i ->
        concat(array_repeat(false, _at[i - 1] - if(i = 1, -1, _at[i - 2]) - 1), array(true))))""")
    mask = F.when(F.col("_at").isNotNull(), mask).otherwise(F.array().cast("array<boolean>"))
    picked = F.zip_with(F.split(old, "\n"), mask, lambda x, m: F.when(F.coalesce(m, F.lit(False)) | (F.length(F.btrim(x, F.lit(SPACE_CHARS))) == 0), x))
    new = F.when(old.isNotNull(), F.array_join(F.filter(picked, lambda x: x.isNotNull()), "\n"))
    return rows.select(F.col("doc").withField(text, new).alias("doc")).select("doc.*")
