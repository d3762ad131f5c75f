"""Fusing, recoding and reshaping tidy tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions.text import (
    CONDITIONS,
    acc_axis,
    acc_sensor,
    canonical_task,
    fold_name,
    normal_side,
    performed_side,
    slug,
)

# --- fixed values: column families by prefix, and headers that are keys rather than metrics ---
FAMILIES = (("eeg_", "EEG"), ("imu_", "IMU"), ("emg_stability_", "emg_stability"), ("emg_meta_", "emg_meta_synergy"))
DEFAULT_FAMILY = "emg_movement"
KEY_HEADERS = {"id", "patient_id", "time", "timing", "session", "condition", "task_name", "cond"}
KEY_PARTS = ("patient", "task_name", "segment")
# ----------------------------------------------------------------------------------------------


def fuse(base: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str]]], first: Sequence[str] = ()) -> DataFrame:
    """Left-join feature tables onto ``base``, each on its own keys; ``first`` columns lead the result.

    Each part must be unique on its keys.  Join strategy is left to the planner and its size checks.
    """
    out = base
    for part, on in parts:
        clash = (set(out.columns) & set(part.columns)) - set(on)
        if clash:
            raise ValueError(f"columns on both sides: {sorted(clash)}")
        out = out.join(part, list(on), "left")
    return out.select(*first, *[c for c in out.columns if c not in first])


def expand_conditions(df: DataFrame, conditions: Sequence[str] = CONDITIONS, prefix: str = "eeg_", keys: Sequence[str] = ("patient_id", "time"),
                      id_col: str = "ID", time_col: str = "timing") -> DataFrame:
    """Condition-free rows repeated per condition; the id loses its _F / _M suffix and features get a prefix."""
    feats = [c for c in df.columns if c not in (id_col, time_col, *keys)]
    return df.select(
        F.regexp_replace(F.col(id_col).cast("string"), r"_F$|_M$", "").alias(keys[0]), F.col(time_col).alias(keys[1]),
        F.explode(F.array(*[F.lit(c) for c in conditions])).alias("condition"), *[F.col(c).alias(f"{prefix}{c}") for c in feats])


def affected_groups(demographics: DataFrame, side: str, id_col: str = "id") -> DataFrame:
    """(id, condition) -> more_affected / less_affected; people without a usable id or side are left out."""
    s = normal_side(F.col(side))
    rows = demographics.where((F.trim(F.col(id_col).cast("string")) != "") & s.isin("DX", "SX"))
    rows = rows.select(id_col, s.alias("_side"), F.explode(F.array(*[F.lit(c) for c in CONDITIONS])).alias("condition"))
    hit = performed_side(F.col("condition")) == F.col("_side")
    return rows.select(id_col, "condition", F.when(hit, "more_affected").otherwise("less_affected").alias("affected_group"))


def recode(df: DataFrame, condition: str, side: str, match: str = "more_affected", other: str = "less_affected", out: str = "recoded_group") -> DataFrame:
    """Label each row by whether the performed side is the given side; unusable sides are dropped, an unknown condition is NULL."""
    s, p = normal_side(F.col(side)), performed_side(F.col(condition))
    return df.where(s.isin("DX", "SX")).withColumn(out, F.when(p.isNotNull(), F.when(p == s, match).otherwise(other)))


def lookup(df: DataFrame, recommendations: DataFrame, entity: str, task: str, value: str, order: str, default, use_canonical: bool = True,
           required: bool = False) -> DataFrame:
    """Add ``value`` and ``<value>_source``: exact task name, else canonical task name, else the default.

    Exact duplicates keep the last by ``order``, canonical duplicates the first.  ``required`` fails the
    job when a row falls through.
    """
    exact = recommendations.groupBy(entity, task).agg(F.max_by(value, order).alias("_exact"))
    canon = recommendations.groupBy(entity, canonical_task(F.col(task)).alias("_canon")).agg(F.min_by(value, order).alias("_by_canon"))
    out = df.withColumn("_canon", canonical_task(F.col(task))).join(exact, [entity, task], "left").join(canon, [entity, "_canon"], "left")
    second = F.col("_by_canon") if use_canonical else F.lit(None)
    source = F.when(F.col("_exact").isNotNull(), "exact").when(second.isNotNull(), "canonical").otherwise("default")
    fallback = F.lit(default)
    if required:
        fallback = F.raise_error(F.lit("a task has no recommendation")).cast(df.sparkSession.range(1).select(F.lit(default)).schema[0].dataType)
    return out.withColumn(value, F.coalesce(F.col("_exact"), second, fallback)).withColumn(f"{value}_source", source).drop("_canon", "_exact", "_by_canon")


def resolve_channels(channels: DataFrame, recording: Sequence[str], wanted: Sequence[str], channel: str = "channel", position: str = "channel_index",
                     variants: dict[str, str] | None = None, prefer_x: bool = False) -> DataFrame:
    """Best channel for each wanted name: substring, then all words, then a language variant; first in channel order.

    ``wanted`` is configuration, so it is expanded per channel row and reduced by a partial aggregate.
    """
    names = F.array(*[F.lit(w) for w in wanted])
    rows = channels.withColumn("wanted", F.explode(names))
    low, want = F.lower(F.col(channel)), F.lower(F.trim("wanted"))
    table = F.create_map(*[F.lit(x) for kv in (variants or {"": ""}).items() for x in kv])
    other = F.coalesce(F.try_element_at(table, want), F.lit(""))
    words = F.filter(F.split(want, r"\s+"), lambda p: F.length(p) > 1)
    rank = (
        F.when(low.contains(want), 0).when((F.size(words) > 0) & F.forall(words, lambda p: low.contains(p)), 1)
        .when((other != "") & low.contains(other), 2)
    )
    axis = F.when(low.contains(".x"), 0).otherwise(1) if prefer_x else F.lit(0)
    hits = rows.withColumn("_rank", rank).where("_rank is not null and wanted != ''")
    best = hits.groupBy(*recording, "wanted").agg(F.min(F.struct(F.col("_rank"), axis.alias("_axis"), F.col(position), F.col(channel))).alias("_b"))
    return best.select(*recording, "wanted", F.col(f"_b.{channel}").alias(channel), F.col("_b._rank").alias("match_rank"))


def sensor_axes(channels: DataFrame, recording: Sequence[str], channel: str = "channel") -> DataFrame:
    """Accelerometer sensors that have all three axes, with the channel of each axis."""
    named = channels.select(*recording, acc_sensor(F.col(channel)).alias("sensor"), acc_axis(F.col(channel)).alias("_axis"), channel)
    by_axis = [F.max(F.when(F.col("_axis") == a, F.col(channel))).alias(a.lower()) for a in "XYZ"]
    return named.where("sensor is not null").groupBy(*recording, "sensor").agg(*by_axis).dropna(subset=["x", "y", "z"])


def _names(df: DataFrame, name: Column) -> list[str]:
    """Column names from the data; as many as the wide table has columns."""
    return [r[0] for r in df.select(name.alias("n")).distinct().orderBy("n").collect()]


def flatten_wide(df: DataFrame, keys: Sequence[str], name_parts: Sequence[str], values: Sequence[str], prefix: str, names: Sequence[str] | None = None) -> DataFrame:
    """One row per key with columns ``<prefix>_<part>_..._<value>``; names come from the caller or from the data."""
    base = F.concat_ws("_", F.lit(prefix), *[slug(F.col(p)) for p in name_parts])
    names = list(names) if names is not None else _names(df, base)
    cells = [F.max(F.when(F.col("_n") == n, F.col(v))).alias(f"{n}_{v}") for n in names for v in values]
    return df.withColumn("_n", base).groupBy(*keys).agg(*cells)


def wide_sessions(df: DataFrame, keys: Sequence[str], session: str, metrics: Sequence[str], order: str, group: str | None = None,
                  groups: Sequence[str] = (), sessions: Sequence[str] = ("T0", "T1")) -> DataFrame:
    """``<metric>__T0`` (or ``<metric>__<group>__T0``): the first non-null value by ``order`` in each cell."""
    cells = []
    for m in metrics:
        for g in groups or [None]:
            for s in sessions:
                hit = (F.col(session) == s) & F.col(m).isNotNull()
                hit = hit if g is None else hit & (F.col(group) == g)
                cells.append(F.min_by(F.when(hit, F.col(m)), F.when(hit, F.col(order))).alias("__".join([m, *([g] if g else []), s])))
    return df.groupBy(*keys).agg(*cells)


def unpivot_components(wide: DataFrame, ids: Sequence[str], prefix: str, metrics: Sequence[str]) -> DataFrame:
    """Columns ``<prefix><i>_<metric>`` to rows (ids, comp, metric, value); the column scan is on the schema only."""
    pattern = re.compile(re.escape(prefix) + r"(\d+)_(" + "|".join(metrics) + r")$")
    cols = [c for c in wide.columns if pattern.match(c)]
    if not cols:
        raise ValueError(f"no column matches {prefix}<i>_<metric>")
    long = wide.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(ids), cols, "_n", "value")
    rx = "^" + re.escape(prefix).replace(r"\_", "_") + r"(\d+)_(.+)$"
    return long.select(*ids, F.regexp_extract("_n", rx, 1).cast("int").alias("comp"), F.regexp_extract("_n", rx, 2).alias("metric"), "value")


def component_pairs(long: DataFrame, keys: Sequence[str], session: str = "session", clusters: DataFrame | None = None, task: Sequence[str] = ()) -> DataFrame:
    """T0, T1 and delta per (keys, component or cluster, metric); several components of one cluster are averaged."""
    label = "comp"
    if clusters is not None:
        long = long.join(clusters.select(*task, "comp", "meta_cluster"), [*task, "comp"])
        label = "meta_cluster"
    agg = long.groupBy(*keys, label, "metric").agg(*[F.avg(F.when(F.col(session) == s, F.col("value"))).alias(s) for s in ("T0", "T1")])
    return agg.where("T0 is not null or T1 is not null").withColumn("delta", F.col("T1") - F.col("T0"))


def paired_first(df: DataFrame, entity: str, session: str, group: str, values: Sequence[str], order: str) -> DataFrame:
    """First non-null value per (entity, group, session), kept where the first value column is complete in both sessions."""
    cells = [F.min_by(F.when(F.col(session) == s, F.col(v)), F.when((F.col(session) == s) & F.col(v).isNotNull(), F.col(order))).alias(f"{v}_{s}")
             for v in values for s in ("T0", "T1")]
    return df.groupBy(entity, group).agg(*cells).where(F.col(f"{values[0]}_T0").isNotNull() & F.col(f"{values[0]}_T1").isNotNull())


def mean_then_pair(df: DataFrame, entity: Sequence[str], session: str, values: Sequence[str]) -> DataFrame:
    """Mean over tasks per session, then T0/T1 pairs complete in both."""
    cells = [F.avg(F.when(F.col(session) == s, F.col(v))).alias(f"{v}_{s}") for v in values for s in ("T0", "T1")]
    out = df.groupBy(*entity).agg(*cells)
    for v in values:
        out = out.where(F.col(f"{v}_T0").isNotNull() & F.col(f"{v}_T1").isNotNull())
    return out


def common_to_all(df: DataFrame, group: Sequence[str], item: str) -> DataFrame:
    """Items that occur in every group."""
    total = df.select(*group).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.select(*group, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n_groups")).where(F.col("n_groups") == total)


def profile_metrics(df: DataFrame) -> DataFrame:
    """One row per column: family, or why it is not a metric (key, text, all missing, constant). One pass over the data."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    types = dict(df.dtypes)
    keyed = {c for c in df.columns if fold_name(c) in KEY_HEADERS or any(p in fold_name(c) for p in KEY_PARTS)}
    nums = [c for c in df.columns if c not in keyed and types[c] in numeric]
    rows = []
    for c in df.columns:
        family = next((f for p, f in FAMILIES if c.startswith(p)), DEFAULT_FAMILY)
        known = "meta_id" if c in keyed else None if c in nums else "non_numeric"
        rows.append((c, family, known))
    ends = [x for c in nums for x in (F.min(c).cast("double").alias(f"{c}__lo"), F.max(c).cast("double").alias(f"{c}__hi"))]
    stats = df.agg(F.count(F.lit(1)).alias("_rows"), *ends)
    cells = [
        F.struct(
            F.lit(c).alias("metric"),
            F.lit(family).alias("_family"),
            (F.lit(known) if known else F.when(F.col(f"{c}__lo").isNull(), "all_missing").when(F.col(f"{c}__lo") == F.col(f"{c}__hi"), "constant")).cast("string").alias("exclusion_reason"),
        )
        for c, family, known in rows
    ]
    out = stats.select(F.inline(F.array(*cells)))
    ok = F.col("exclusion_reason").isNull()
    return out.select("metric", F.when(ok, F.col("_family")).otherwise("").alias("metric_family"), ok.alias("included_in_stats"),
                      F.coalesce("exclusion_reason", F.lit("")).alias("exclusion_reason"))


def rename_family(df: DataFrame, source: str = "mean_meta_synergy_", target: str = "emg_meta_C") -> DataFrame:
    """``mean_meta_synergy_0_mean`` -> ``emg_meta_C0_mean``; stray blanks around headers are removed."""
    names = {c: c.strip() for c in df.columns if c != c.strip()}
    names |= {c: target + c[len(source):] for c in df.columns if re.match(re.escape(source) + r"\d+_", c)}
    return df.withColumnsRenamed(names)


def stack_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Row union of frames with different columns; missing ones are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_task(df: DataFrame, **ids: str) -> DataFrame:
    """Put constant identifier columns in front."""
    return df.select(*[F.lit(v).alias(k) for k, v in ids.items()], *df.columns)


def pair_files(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("visit", "stamp"), visit: str = "visit", path: str = "path", by: Sequence[str] = ()) -> DataFrame:
    """Match two file lists on (visit, stamp); subjects without any exact match are matched by visits unique on both sides."""
    left, right = a.withColumnRenamed(path, "path_a"), b.withColumnRenamed(path, "path_b")
    exact = left.join(right, [*by, *keys])
    done = exact.select(*by).distinct()

    def lone(df: DataFrame, col: str) -> DataFrame:
        return df.groupBy(*by, visit).agg(F.count(F.lit(1)).alias("_n"), F.min(col).alias(col), *([F.min("stamp").alias("stamp")] if col == "path_a" else [])).where("_n = 1").drop("_n")

    loose = lone(left, "path_a").join(lone(right, "path_b"), [*by, visit])
    loose = loose.join(done, list(by), "left_anti") if by else loose.where(exact.agg(F.count(F.lit(1)).alias("n")).scalar() == 0)
    return exact.select(*by, *keys, "path_a", "path_b").unionByName(loose.select(*by, *keys, "path_a", "path_b"))
