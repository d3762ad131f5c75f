"""SpotSigs fingerprints: sets of content-word chains that follow common words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.session import stage

# fixed values: common words of English, German, French and Spanish
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was we were which will "
    "with you der die das den dem des ein eine und ist in im von zu mit auf für sich nicht auch es an als war bei le la les un une des de du et est en "
    "que qui dans pour sur par pas ne au aux avec ce il elle se el los las una del y es por con no lo su al como más o para").split()
#: Content words of a chain, words within which they are looked for, and one content word in so many that is an anchor
#: as well, so that texts without common words have signatures too.
CHAIN, REACH, OTHER = 2, 8, 16
#: Rows of one range of ids, and the most ranges: their bounds are held by every task.
RANGE_ROWS, RANGES = 1024, 10_000
LETTERS = r"[^\p{L}\p{N}]+"


def with_signatures(rows: DataFrame, text: str, out: str) -> DataFrame:
    """`rows` with the sorted set of signature hashes (32 bits each) of a text column as an array of longs.

    A signature is an anchor and the next CHAIN content words within REACH words; anchors are common words, the first
    and the last word and, one in OTHER, content words chosen by their hash.  Texts without words have none.
    """
    common = ", ".join(f"'{w}'" for w in sorted(set(ANCHORS)))
    words, content = f"_w_{out}", f"_c_{out}"
    rows = rows.withColumn(words, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), LETTERS), lambda x: x != ""))
    rows = rows.withColumn(content, F.expr(f"transform({words}, x -> if(x IN ({common}), null, x))"))
    at = f"filter(sequence(1, size({words})), i -> {content}[i - 1] is null or i in (1, size({words})) or pmod(xxhash64({words}[i - 1]), {OTHER}) = 0)"
    chain = f"slice(filter(slice({content}, i + 1, {REACH}), x -> x is not null), 1, {CHAIN})"
    sig = f"transform({at}, i -> shiftrightunsigned(xxhash64(concat_ws(' ', {words}[i - 1], {chain})), 32))"
    found = F.expr(f"if(size({words}) = 0, cast(array() as array<bigint>), sort_array(array_distinct({sig})))")
    return rows.withColumn(out, found).drop(words, content)


def as_string(signatures: Column) -> Column:
    """The set as text: 8 hex digits for each signature, in order."""
    return F.array_join(F.transform(signatures, lambda x: F.substring(F.lower(F.hex(x + F.lit(1 << 32))), 2, 8)), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets, 1 if both are empty.  Sets that share no signature are not looked into twice."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, 1.0).otherwise(common / F.greatest(every, F.lit(1))).cast("double")


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and text with `cell`, a range of ids with about RANGE_ROWS rows, and the first row of the next range added.

    The added rows have `extra` and stand last in their range; the first row of all follows the last.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = rows.count()
    cells = min(RANGES, max(1, n // RANGE_ROWS))
    shares = [i / cells for i in range(1, cells)]
    cuts = sorted(set(rows.select(F.percentile_approx("doc_id", shares, 10 * RANGES)).first()[0] or [])) if shares else []
    # binary search: the number of cuts up to the id
    steps = F.expr(f"""aggregate(sequence(1, {max(1, len(cuts).bit_length())}), named_struct('lo', 0, 'hi', {len(cuts)}),
        (s, i) -> if(s.lo < s.hi, if(doc_id >= element_at(_cuts, cast((s.lo + s.hi) div 2 as int) + 1), named_struct('lo', cast((s.lo + s.hi) div 2 as int) + 1, 'hi', s.hi),
        named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int))), s), s -> s.lo)""") if cuts else F.lit(0)
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array()
    rows = rows.withColumn("_cuts", bounds).withColumn("cell", F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(steps)).drop("_cuts")
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    first = rows.groupBy("cell").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_tie")).alias("f"))
    # at most RANGES rows
    order = Window.orderBy("cell")
    last = F.max("cell").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = first.select(F.col("cell").alias("_cell"), F.col("f.doc_id").alias("_id"), F.col("f._tie").alias("_first"), F.coalesce(F.lag("cell").over(order), last).alias("_to"))
    rows = rows.join(F.broadcast(first), [F.col("cell") == F.col("_cell"), F.col("doc_id").eqNullSafe(F.col("_id")), F.col("_tie") == F.col("_first")], "left")
    both = F.array(F.struct(F.col("cell"), F.lit(0).alias("extra")), F.struct(F.col("_to").alias("cell"), F.lit(1).alias("extra")))
    own = F.array(F.struct(F.col("cell"), F.lit(0).alias("extra")))
    return rows.select("doc_id", "text", "_tie", F.explode(F.when(F.col("_to").isNotNull(), both).otherwise(own)).alias("x")).select("doc_id", "text", "_tie", "x.*")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every row; equal texts have equal fingerprints."""
    rows = with_signatures(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "text", "signatures")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), as_string(F.col("signatures")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, whose last quarter is the start of the next document by doc_id.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next: the Jaccard similarity
    of the signature sets of the text and its edit, and of the text and the next document.  After the last document
    comes the first.  Texts are shuffled once, by ranges of ids, to meet their neighbours.  Null texts count as empty,
    null ids come last, rows that repeat an id follow each other in order of a hash of their text, a single row is its
    own neighbour, and an empty table gives an empty result.
    """
    rows = with_signatures(in_order(docs, doc_id, text).repartition("cell"), "text", "signatures")
    order = Window.partitionBy("cell").orderBy("extra", F.col("doc_id").asc_nulls_last(), "_tie")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_signatures": F.lead("signatures").over(order)}).where("extra = 0")
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail))
    rows = with_signatures(rows.withColumn("edited", edited), "edited", "edited_signatures")
    own, other = F.col("signatures"), F.col("edited_signatures")
    return rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_string(own).alias("fingerprint"),
                       as_string(other).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"), likeness(own, F.col("next_signatures")).alias("near_next"))


def near_pairs(docs: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with similar signature sets: (membership: doc_id and set_id; pairs: a, b and similarity of set ids).

    Equal sets are one set, so copies are never paired.  A set's signatures are ordered from the rarest; sets that are
    similar enough share one of the first n - ceil(least n) + 1 and lie in the same or the next partition of set
    length, so they meet on both; then the similarity is computed, unless the lengths alone rule it out.
    """
    rows = with_signatures(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "signatures").drop("text")
    rows = stage(rows.withColumn("set_id", F.sha2(F.to_json("signatures").cast("binary"), 256)))
    sets = stage(rows.groupBy("set_id").agg(F.any_value("signatures").alias("signatures")).where(F.size("signatures") > 0))
    each = sets.select("set_id", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    rare = each.join(each.groupBy("s").agg(F.count(F.lit(1)).alias("df")), "s")
    keep = F.col("n") - F.ceil(F.lit(least) * F.col("n")).cast("int") + 1
    first = rare.groupBy("set_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("x")).withColumn("s", F.explode(F.slice("x.s", F.lit(1), keep)))
    part = F.floor(F.log(F.col("n")) / F.lit(math.log(1 / least)) + F.lit(1e-9))
    keyed = stage(first.select("set_id", "n", "s", part.cast("int").alias("part")))
    left = keyed.select(F.col("set_id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = keyed.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), "s", "part")
    meet = left.join(right, ["s", "part"]).where((F.col("na") <= F.col("nb")) & (F.col("a") != F.col("b")) & (F.col("na") >= F.lit(least) * F.col("nb")))
    meet = meet.where((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b"))).select("a", "b").distinct()
    pairs = meet.join(sets.select(F.col("set_id").alias("a"), F.col("signatures").alias("sa")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("signatures").alias("sb")), "b")
    pairs = pairs.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= least)
    return rows.select("doc_id", "set_id"), pairs
