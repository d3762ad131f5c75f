"""Permutation test on curves: is the mean curve of session A different from that of session B?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strideframe.operators.ordered import CELL, attach_totals, salted
from strideframe.session import stage


def shuffle_hash(perm: Column, unit: Column) -> Column:
    """Pseudo-random position of a unit in one permutation: hex digits, in the order of the numbers they stand for."""
    return F.md5(F.concat_ws(":", perm.cast("string"), unit))


def _hex_bound(share: Column) -> Column:
    """The hash below which about this share of all hashes lies; below or above all of them outside 0 to 1."""
    digits = F.lower(F.lpad(F.hex((F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 2.0**52).cast("long")), 13, "0"))
    return F.when(share <= 0, "").when(share >= 1, "g").otherwise(digits)


def permutation_test(units: DataFrame, keys: Sequence[str], unit: str, session: str, curve: str, points: int, n_perm: int,
                     labels: tuple = ("T0", "T1")) -> DataFrame:
    """Per key: n_T0, n_T1, stat_observed, p_value = (1 + #{stat >= observed}) / (1 + n_perm).

    ``units`` has one row per (unit, session) with a fixed-length ``curve``.  Each permutation puts the
    n_T0 units with the smallest hash into the first group, so it is exact, repeatable and needs no
    ordering of all units: those surely below the cut are summed where they are read, and only the few
    with hashes near the expected n_T0/n quantile (8 deviations to both sides) are ranked.
    """
    unit_id = F.concat_ws(":", F.col(unit).cast("string"), F.col(session).cast("string"))
    base = units.where(F.col(session).isin(*labels)).select(*keys, unit_id.alias("_u"), (F.col(session) == labels[0]).alias("_a"),
                                                            F.col(curve).alias("_y"))
    # every unit is hashed n_perm times, so units are spread evenly; read by several branches
    base = stage(salted(base, ["_u"]).repartition(max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "_u"))
    at = [F.col("_y")[i] for i in range(points)]
    whole = stage(base.groupBy(*keys).agg(
        F.count_if("_a").alias("n_T0"), F.count_if(~F.col("_a")).alias("n_T1"),
        F.array(*[F.sum(F.when(F.col("_a"), y)) for y in at]).alias("_sa"), F.array(*[F.sum(y) for y in at]).alias("_sum")))

    def stat(part: Column) -> Column:
        gaps = F.zip_with(part, F.col("_sum"), lambda a, s: F.abs(a / F.col("n_T0") - (s - a) / F.col("n_T1")))
        return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g) / points

    testable = whole.where("n_T0 >= 2 and n_T1 >= 2").withColumn("stat_observed", stat(F.col("_sa")))
    counted = attach_totals(base, keys, {"n_T0": ("sum", F.col("_a").cast("long")), "n_T1": ("sum", (~F.col("_a")).cast("long"))}).drop(CELL)
    n = (F.col("n_T0") + F.col("n_T1")).cast("double")
    frac = F.col("n_T0") / n
    slack = 8 * F.sqrt(frac * (1 - frac) / n) + 40 / n
    draws = counted.where("n_T0 >= 2 and n_T1 >= 2").select(
        *keys, "_u", "_y", "n_T0", _hex_bound(frac - slack).alias("_from"), _hex_bound(frac + slack).alias("_to"), F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("perm"))
    draws = draws.withColumn("_h", shuffle_hash(F.col("perm"), F.col("_u")))
    sums = [F.count(F.lit(1)).alias("_k"), *[F.sum(y).alias(f"_s{i}") for i, y in enumerate(at)]]
    below = stage(draws.where("_h < _from").groupBy(*keys, "perm").agg(*sums))
    near = draws.where("_h >= _from and _h <= _to").select(*keys, "perm", "n_T0", "_h", "_u", "_y")
    # about 16 * sqrt(n) rows per key and permutation (4e6 of 3e11), so a plain window ranks them
    ranked = near.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "perm").orderBy("_h", "_u")))
    filled = ranked.join(below.select(*keys, "perm", F.col("_k").alias("_b")), [*keys, "perm"], "left").where(
        F.col("_r") + F.coalesce("_b", F.lit(0)) <= F.col("n_T0"))
    both_parts = below.unionByName(filled.groupBy(*keys, "perm").agg(*sums))
    drawn = both_parts.groupBy(*keys, "perm").agg(F.sum("_k").alias("_k"), F.array(*[F.sum(f"_s{i}") for i in range(points)]).alias("_part"))
    per_perm = drawn.join(testable, list(keys)).withColumn("_stat", stat(F.col("_part")))
    # sums run in another order than the observed one, hence the relative tolerance
    hits = per_perm.groupBy(*keys).agg(F.count_if(F.col("_k") == F.col("n_T0")).alias("_drawn"),
                                       F.count_if(F.col("_stat") >= F.col("stat_observed") * (1 - 1e-9)).alias("_ge"))
    out = whole.select(*keys, "n_T0", "n_T1").join(testable.select(*keys, "stat_observed"), list(keys), "left").join(hits, list(keys), "left")
    tested = F.col("stat_observed").isNotNull()
    complete = F.when(F.col("_drawn") == n_perm, (1 + F.col("_ge")) / F.lit(1.0 + n_perm)).otherwise(
        F.raise_error(F.lit("a permutation's cut fell outside its bracket")).cast("double"))
    both = (F.col("n_T0") > 0) & (F.col("n_T1") > 0)
    return out.select(*keys, "n_T0", "n_T1", F.when(tested, F.col("stat_observed")).when(both, 0.0).alias("stat_observed"),
                      F.when(tested, complete).when(both, 1.0).alias("p_value"), F.lit(n_perm).alias("n_permutations"))
