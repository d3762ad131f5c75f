"""Vendor text exports as long samples.

Two formats: comma files with `Label:` lines, and semicolon files with decimal commas.  Files are
split by Spark: lines are read with the text source (a large file is many partitions), header facts
are small per-file aggregates, and data rows are parsed with column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.text import decimal_comma_double, muscle_channel, muscle_slot, session_first
from strideframe.operators.ordered import CELL, row_index

# --- fixed values: header patterns and layout of the two export formats -----------------------
LABEL = (r"(?i)^Label:\s*(.+?)\s+Sampling frequency:\s*([\d.eE+-]+)\s+Number of points:\s*(\d+)\s+X start:\s*([\d.eE+-]+)\s+"
         r"Unit:\s*(\S+)\s+Domain Unit:\s*(\w+)")
DATA_ROW = r"^-?[\d.]+e[+-]\d+"
TIME_HEADER = r"^X\s*\[s\],"
SEMICOLON_MARK = r"Trigno Discover|Application.*;.*Trigno|Trigno.*;.*Application"
NAMES_ROW, RATES_ROW, FIRST_DATA_ROW = 4, 7, 9
COLUMNS_PER_SENSOR = 14
AXES = ("X", "Y", "Z")
DEFAULT_EMG_HZ, DEFAULT_ACC_HZ = 1259.26, 148.15
CALIBRATION = "Calibrazione"
# ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RecordingFiles:
    """Samples (path, patient_id, task_name, channel, sample_idx, t, v), channel facts and file metadata."""

    samples: DataFrame
    channels: DataFrame
    metadata: DataFrame


def discover_recordings(spark: SparkSession, root: str, tasks_only: bool = True) -> DataFrame:
    """Files under a folder with patient and task keys from their names; only names are listed, nothing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return _named(files).where(~F.col("stem").contains(CALIBRATION)) if tasks_only else _named(files)


def _named(df: DataFrame) -> DataFrame:
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    parts = F.split(stem, "_")
    n = F.size(parts)
    patient = F.when(n >= 2, F.array_join(F.slice(parts, 1, 2), "_")).otherwise(stem)
    task = F.when(n > 2, F.array_join(F.slice(parts, 3, F.greatest(n - 2, F.lit(1))), "_")).otherwise(stem)
    return df.withColumns({"stem": stem, "patient_id": patient, "task_name": session_first(task)})


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of text files with exact 1-based numbers per file, however large the file is.

    A file is read in splits.  Lines keep their order inside a split, and the split's start offset is
    the slice that the distributed row index works on, so no file passes through one task.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias(CELL), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    return row_index(raw, ["path"], "_at", cell_ready=True).select("path", (F.col("idx") + 1).alias("line_no"), "line")


def sniff_format(lines: DataFrame) -> DataFrame:
    """(path, format): 'semicolon' or 'labelled', from the first line."""
    return lines.where("line_no = 1").select("path", F.when(F.col("line").rlike(SEMICOLON_MARK), "semicolon").otherwise("labelled").alias("format"))


def _finite_pair(t: Column, v: Column) -> Column:
    inf = F.lit(float("inf"))
    return t.isNotNull() & v.isNotNull() & ~F.isnan(t) & ~F.isnan(v) & (F.abs(t) < inf) & (F.abs(v) < inf)


def _explode_columns(data: DataFrame, layout: DataFrame, split: str, parse) -> DataFrame:
    """Data lines to one row per channel sample; the layout (one row per channel) is grouped to one row per file."""
    spec = layout.groupBy("path").agg(F.collect_list(F.struct("channel", "t_col", "v_col")).alias("_spec"))
    cells = F.split(F.trim("line"), split)
    rows = data.join(spec, "path").withColumn("_c", cells).select("path", "line_no", "_c", F.inline("_spec"))
    t, v = parse(F.try_element_at("_c", F.col("t_col") + 1)), parse(F.try_element_at("_c", F.col("v_col") + 1))
    return rows.select("path", "channel", F.col("line_no").alias("sample_idx"), t.alias("t"), v.alias("v")).where(_finite_pair(F.col("t"), F.col("v")))


def _labelled(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    labels = lines.where(F.col("line").rlike(LABEL)).select(
        "path", "line_no", *[F.trim(F.regexp_extract("line", LABEL, i)).alias(c) for i, c in enumerate(("channel", "fs", "n", "x0", "unit", "domain_unit"), 1)])
    labels = labels.select("path", "line_no", "channel", F.col("fs").try_cast("double").alias("fs"), F.col("n").try_cast("long").alias("n_points"),
                           F.col("x0").try_cast("double").alias("x_start"), "unit", "domain_unit")
    head = lines.where(F.col("line").rlike(TIME_HEADER)).groupBy("path").agg(F.min("line_no").alias("_h"), F.min_by("line", "line_no").alias("_names"))
    numeric = lines.where(F.lower(F.trim("line")).rlike(DATA_ROW))
    data = numeric.join(head.select("path", "_h"), "path", "left").where("_h is null or line_no > _h").drop("_h")
    pairs = head.select("path", F.posexplode(F.split("_names", ",")).alias("_p", "_n")).where((F.col("_p") % 2 == 1) & F.col("_n").contains("["))
    named = pairs.select("path", F.trim(F.split("_n", r"\[")[0]).alias("channel"), (F.col("_p") - 1).alias("t_col"), F.col("_p").alias("v_col"))
    # files without a column header use the label order
    order = labels.join(labels.select("path", F.col("line_no").alias("_o")), "path").where("_o < line_no").groupBy("path", "channel").agg(F.count(F.lit(1)).alias("_k"))
    plain = labels.select("path", "channel").join(head.select("path"), "path", "left_anti").join(order, ["path", "channel"], "left").select(
        "path", "channel", (F.coalesce("_k", F.lit(0)) * 2).cast("int").alias("t_col"), (F.coalesce("_k", F.lit(0)) * 2 + 1).cast("int").alias("v_col"))
    samples = _explode_columns(data, named.unionByName(plain), ",", lambda c: F.trim(c).try_cast("double"))
    gain = lines.where(F.col("line").contains("System Gain")).groupBy("path").agg(F.min("line_no").alias("_g"))
    first = lines.where(~F.col("line").startswith("Label:")).groupBy("path").agg(F.min("line_no").alias("_f"))
    meta = lines.join(first, "path").join(gain, "path", "left").where((F.col("line_no") >= F.col("_f")) & (F.col("line_no") < F.coalesce("_g", F.col("_f"))) & F.col("line").contains(":"))
    return samples, labels.drop("line_no"), _key_values(meta)


def _key_values(lines: DataFrame) -> DataFrame:
    k, v = F.trim(F.regexp_extract("line", r"^([^:]*):(.*)$", 1)), F.trim(F.regexp_extract("line", r"^([^:]*):(.*)$", 2))
    # a later line of the same key counts
    pairs = lines.select("path", "line_no", k.alias("key"), v.alias("value")).where("key != ''").groupBy("path", "key").agg(F.max_by("value", "line_no").alias("value"))
    return pairs.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def channel_settings(lines: DataFrame) -> DataFrame:
    """Per-channel amplifier blocks of labelled files: path, block, settings map (six `key: value` lines each)."""
    starts = lines.where(F.trim("line").startswith("System Gain")).select("path", F.col("line_no").alias("block"))
    body = lines.where(F.col("line").contains(":")).join(starts, "path").where((F.col("line_no") >= F.col("block")) & (F.col("line_no") < F.col("block") + 6))
    k, v = F.trim(F.regexp_extract("line", r"^([^:]*):(.*)$", 1)), F.trim(F.regexp_extract("line", r"^([^:]*):(.*)$", 2)).try_cast("double")
    last = body.groupBy("path", "block", k.alias("k")).agg(F.max_by(v, "line_no").alias("v"))
    return last.groupBy("path", "block").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("settings"))


def _semicolon(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    names = lines.where(F.col("line_no") == NAMES_ROW).select(
        "path", F.posexplode(F.filter(F.split("line", ";"), lambda p: p.contains("(") & p.contains(")"))).alias("sensor", "_n"))
    names = names.withColumn("muscle", F.trim(F.regexp_replace("_n", r"\s*\(\d+\)\s*$", ""))).withColumn("slot", muscle_slot(F.col("muscle"))).where("slot is not null")
    once = names.groupBy("path", "slot").agg(F.min("sensor").alias("sensor"), F.min_by("muscle", "sensor").alias("muscle"))
    rates = lines.where(F.col("line_no") == RATES_ROW).select("path", F.split("line", ";").alias("_r"))
    base = F.col("sensor") * COLUMNS_PER_SENSOR
    kinds = [F.struct(muscle_channel(F.col("muscle")).alias("channel"), base.alias("t_col"), (base + 1).alias("v_col"), F.lit("mV").alias("unit"), F.lit(DEFAULT_EMG_HZ).alias("_d"))]
    kinds += [F.struct(muscle_channel(F.col("muscle"), F.lit(a)).alias("channel"), (base + 2 + 2 * i).alias("t_col"), (base + 3 + 2 * i).alias("v_col"), F.lit("g").alias("unit"),
                       F.lit(DEFAULT_ACC_HZ).alias("_d")) for i, a in enumerate(AXES)]
    layout = once.select("path", F.inline(F.array(*kinds))).join(rates, "path", "left")
    rate = decimal_comma_double(F.try_element_at("_r", F.col("v_col") + 1))
    layout = layout.withColumn("fs", F.coalesce(F.when(rate != 0, rate), F.col("_d")))
    data = lines.where((F.col("line_no") >= FIRST_DATA_ROW) & (F.trim("line") != ""))
    samples = _explode_columns(data, layout, ";", lambda c: F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double"))
    samples = trim_to_common_span(samples)
    counts = samples.groupBy("path", "channel").agg(F.count(F.lit(1)).alias("n_points"))
    channels = layout.select("path", "channel", "fs", "unit").join(counts, ["path", "channel"], "left").select(
        "path", "channel", "fs", F.coalesce("n_points", F.lit(0)).alias("n_points"), F.lit(0.0).alias("x_start"), "unit", F.lit("s").alias("domain_unit"))
    meta = lines.where((F.col("line_no") <= 5) & F.col("line").contains(":") & F.col("line").contains(";"))
    meta = _key_values(meta.withColumn("line", F.regexp_replace("line", r"^([^:;]*):;?\s*([^;]*).*$", "$1:$2")))
    return samples, channels, meta


def trim_to_common_span(samples: DataFrame, recording=("path",), channel: str = "channel", t: str = "t") -> DataFrame:
    """Keep samples between the latest channel start and the earliest channel end of their recording."""
    ends = samples.groupBy(*recording, channel).agg(F.min(t).alias("_a"), F.max(t).alias("_b"), F.count(F.lit(1)).alias("_n"))
    span = ends.where("_n >= 2").groupBy(*recording).agg(F.max("_a").alias("_lo"), F.min("_b").alias("_hi"))
    joined = samples.join(span, list(recording), "left")
    keep = F.col("_lo").isNull() | (F.col("_lo") >= F.col("_hi")) | F.col(t).between(F.col("_lo"), F.col("_hi"))
    return joined.where(keep).drop("_lo", "_hi")


def read_recordings(spark: SparkSession, paths, fmt: str = "auto", max_rows: int | None = None) -> RecordingFiles:
    """Parse exports of either format ('auto' decides per file). ``max_rows`` is a user-requested cap on data lines."""
    lines = read_lines(spark, paths)
    if max_rows is not None:
        numbered = lines.where(F.lower(F.trim("line")).rlike(DATA_ROW) | (F.col("line_no") >= FIRST_DATA_ROW))
        start = numbered.groupBy("path").agg(F.min("line_no").alias("_s"))
        lines = lines.join(start, "path", "left").where(F.col("_s").isNull() | (F.col("line_no") < F.col("_s") + max_rows)).drop("_s")
    return parse_recordings(lines, fmt)


def parse_recordings(lines: DataFrame, fmt: str = "auto") -> RecordingFiles:
    """Parse numbered lines (path, line_no, line) of exports of either format."""
    kinds = sniff_format(lines)

    def of(kind: str) -> DataFrame:
        if fmt != "auto":
            return lines if fmt == kind else lines.where(F.lit(False))
        return lines.join(kinds.where(F.col("format") == kind).select("path"), "path", "left_semi")

    parts = [_labelled(of("labelled")), _semicolon(of("semicolon"))]
    merged = [a.unionByName(b, allowMissingColumns=True) for a, b in zip(*parts)]
    return RecordingFiles(*[_named(m).drop("stem") for m in merged])


def channel_table(files: RecordingFiles, default_fs: float = 150.0) -> DataFrame:
    """Channel facts with a default rate where the file states none."""
    return files.channels.withColumn("fs", F.coalesce("fs", F.lit(default_fs)))
