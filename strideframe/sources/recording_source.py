"""Vendor text exports as a registered data source: `spark.read.format("recording")`.

The reader looks at the head of each file only, cuts the rest into byte ranges, and parses in each range the
columns of the wanted channels.  `sources.recordings` reads the same files with the text source, which also
gives line numbers, channel facts and metadata.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, InputPartition

from strideframe.functions.text import MUSCLE_SLOTS, MUSCLE_SYNONYMS, SESSION_LAST
from strideframe.sources.edf import FilteredReader, files_below, open_file
from strideframe.sources.recordings import AXES, COLUMNS_PER_SENSOR, DATA_ROW, FIRST_DATA_ROW, LABEL, NAMES_ROW, SEMICOLON_MARK, TIME_HEADER, trim_to_common_span

SCHEMA = "path string, patient_id string, task_name string, format string, channel string, offset long, t double, v double"
#: A head that is longer than this is no export; rows of a batch.
MOST_HEAD, ROWS = 16 << 20, 1 << 17
NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")


@dataclass(frozen=True)
class Layout:
    """Where a file's samples are: the first byte of its data and the columns (time, value) of each channel."""

    path: str
    format: str
    first: int
    size: int
    columns: tuple[tuple[str, int, int], ...]


class Range(InputPartition):
    def __init__(self, layout: Layout, begin: int, end: int):
        self.layout, self.begin, self.end = layout, begin, end


def _lines(f, at: int) -> Iterator[tuple[int, str]]:
    """Lines and where they begin, from byte `at`, which begins one."""
    f.seek(at)
    rest = b""
    while block := f.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield at, line.decode("utf-8", "replace").rstrip("\r")
            at += len(line) + 1
    if rest:
        yield at, rest.decode("utf-8", "replace").rstrip("\r")


def _slot(muscle: str) -> int | None:
    known = {m.lower(): i for i, m in enumerate(MUSCLE_SLOTS, 1)}
    name = muscle.strip().lower()
    return known.get(MUSCLE_SYNONYMS.get(name, name).lower())


def _semicolon_columns(names: str) -> Iterator[tuple[str, int, int]]:
    seen = set()
    for sensor, text in enumerate(x for x in names.split(";") if "(" in x and ")" in x):
        slot = _slot(re.sub(r"\s*\(\d+\)\s*$", "", text).strip())
        if slot is None or slot in seen:
            continue
        seen.add(slot)
        base, name = sensor * COLUMNS_PER_SENSOR, MUSCLE_SLOTS[slot - 1]
        yield f"{name}: EMG {slot}", base, base + 1
        for i, axis in enumerate(AXES):
            yield f"{name}: Acc {slot}.{axis}", base + 2 + 2 * i, base + 3 + 2 * i


def layout_of(path: str, fmt: str = "auto") -> Layout:
    """From the head of a file; `auto` tells the format by the first line."""
    with open_file(path) as f:
        size, labels, number = f.size(), [], 0
        for at, line in _lines(f, 0):
            number += 1
            if number == 1 and fmt == "auto":
                fmt = "semicolon" if re.search(SEMICOLON_MARK, line) else "labelled"
            if at > MOST_HEAD:
                raise ValueError(f"{path}: no data in the first {MOST_HEAD} bytes")
            if fmt == "semicolon":
                if number == NAMES_ROW:
                    labels = list(_semicolon_columns(line))
                if number == FIRST_DATA_ROW:
                    return Layout(path, fmt, at, size, tuple(labels))
                continue
            if found := re.match(LABEL, line):
                labels.append((found[1].strip(), 2 * len(labels), 2 * len(labels) + 1))
            if re.match(TIME_HEADER, line):
                cells = line.split(",")
                named = [(c.split("[")[0].strip(), i - 1, i) for i, c in enumerate(cells) if i % 2 == 1 and "[" in c]
                return Layout(path, fmt, at + len(line.encode()), size, tuple(named))
            if labels and re.match(DATA_ROW, line.strip().lower()):
                break  # without a header of columns the order of the labels counts
        return Layout(path, fmt, 0, size, tuple(labels) if fmt == "labelled" else ())


def _number(cell: str, decimal_comma: bool) -> float:
    cell = cell.replace(",", ".") if decimal_comma else cell
    return float(cell) if NUMBER.fullmatch(cell) else np.nan


class RecordingReader(FilteredReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.format = options.get("format", "auto")

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in (f for p in self.paths for f in files_below(p, ".csv")):
            if self.wanted("path", path):
                layout = layout_of(path, self.format)
                kept = tuple(c for c in layout.columns if self.wanted("channel", c[0]))
                layout = Layout(layout.path, layout.format, layout.first, layout.size, kept)
                out += [Range(layout, a, min(a + self.part, layout.size)) for a in range(layout.first, layout.size, self.part)] if kept else []
        return out or [Range(Layout("", "labelled", 0, 0, ()), 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where, comma = partition.layout, partition.layout.format == "semicolon"
        if not where.columns:
            return
        stem = re.search(r"([^/]+)\.[^./]+$", where.path)[1]
        parts = stem.split("_")
        patient = "_".join(parts[:2]) if len(parts) >= 2 else stem
        task = re.sub(SESSION_LAST, r"Task_\2_\1", "_".join(parts[2:]) if len(parts) > 2 else stem)
        rows: list[tuple[str, int, float, float]] = []
        with open_file(where.path) as f:
            for at, line in _lines(f, self._begin(f, partition)):
                if at >= partition.end:
                    break
                line = line.strip()
                if not line or (not comma and not re.match(DATA_ROW, line.lower())):
                    continue
                cells = line.split(";" if comma else ",")
                for channel, t_at, v_at in where.columns:
                    if v_at < len(cells):
                        t, v = _number(cells[t_at], comma), _number(cells[v_at], comma)
                        if np.isfinite(t) and np.isfinite(v):
                            rows.append((channel, at, t, v))
                if len(rows) > ROWS:
                    yield self._batch(where, patient, task, rows)
                    rows = []
        if rows:
            yield self._batch(where, patient, task, rows)

    @staticmethod
    def _begin(f, partition: Range) -> int:
        """The first line that begins in the range: the one before belongs to the range where it begins."""
        if partition.begin == partition.layout.first:
            return partition.begin
        f.seek(partition.begin - 1)
        at = partition.begin - 1
        while block := f.read(1 << 16):
            found = block.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(block)
        return partition.layout.size

    @staticmethod
    def _batch(where: Layout, patient: str, task: str, rows: list) -> pa.RecordBatch:
        same = [pa.array([x] * len(rows)) for x in (where.path, patient, task, where.format)]
        channel, at, t, v = zip(*rows)
        return pa.record_batch([*same, pa.array(channel), pa.array(at, pa.int64()), pa.array(t), pa.array(v)], names=[x.split()[0] for x in SCHEMA.split(", ")])


class RecordingSource(DataSource):
    """Options: path (file or folder of .csv files, several with commas), format (auto, labelled, semicolon), partBytes."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader({k.lower(): v for k, v in self.options.items()})


def scan_recordings(spark: SparkSession, paths: str | Sequence[str], fmt: str = "auto", part_bytes: int = 16 << 20) -> DataFrame:
    """Samples of exports of either format (path, patient_id, task_name, format, channel, offset, t, v), offset being the byte where a row begins.

    Filters on `channel` and `path` reach the reader.  Rows are as they stand in the files; `on_common_span` cuts the
    semicolon files to the span that all their channels have.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)
    return spark.read.format("recording").option("format", fmt).option("partBytes", part_bytes).load(paths if isinstance(paths, str) else ",".join(paths))


def on_common_span(samples: DataFrame) -> DataFrame:
    """`scan_recordings` of whole files, semicolon ones between their channels' latest start and earliest end."""
    cut = trim_to_common_span(samples.where(F.col("format") == "semicolon"))
    return samples.where(F.col("format") != "semicolon").unionByName(cut)
