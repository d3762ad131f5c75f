"""EDF and EDF+ recordings as a data source: files are cut into ranges of data records.

`spark.dataSource.register(EdfSource)`, then `spark.read.format("edf").load(path)`; `read_edf` does
both.  A header is a few kilobytes; a partition seeks to its records and decodes the wanted signals
only.  Files are opened through pyarrow's file systems (local, s3, gs, hdfs).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# --- fixed values: the layout of the header (bytes of each field) and names ---------------------
HEAD = (("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("bytes", 8), ("kind", 44), ("records", 8), ("seconds", 8), ("signals", 4))
SIGNAL = (("label", 16), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("digital_low", 8), ("digital_high", 8), ("filter", 80), ("samples", 8), ("reserved", 32))
ANNOTATIONS, INTERRUPTED = "EDF Annotations", "EDF+D"
SAMPLES = "path string, channel string, sample_idx long, t double, v double"
CHANNELS = "path string, number int, channel string, unit string, fs double, n_points long, low double, high double, transducer string, prefilter string"
NOTES = "path string, onset double, duration double, text string"
# ----------------------------------------------------------------------------------------------
#: Bytes of data records in a partition, and rows of a batch.
PART, ROWS = 16 << 20, 1 << 18


@dataclass(frozen=True)
class Signal:
    label: str
    unit: str
    low: float
    high: float
    digital_low: float
    digital_high: float
    samples: int
    offset: int  # of its samples in a record, in samples
    transducer: str
    prefilter: str

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Physical values; a signal without a digital range keeps its numbers."""
        span = self.digital_high - self.digital_low
        return (x - self.digital_low) * ((self.high - self.low) / span) + self.low if span else x.astype(float)


@dataclass(frozen=True)
class Header:
    path: str
    size: int  # bytes of the header
    records: int
    seconds: float
    interrupted: bool
    signals: tuple[Signal, ...]

    @property
    def width(self) -> int:
        """Bytes of a data record."""
        return 2 * sum(s.samples for s in self.signals)


def open_file(path: str):
    """A file to read and seek in, local or in a store."""
    system, name = fs.FileSystem.from_uri(path if re.match(r"\w[\w+.-]+:", path) else f"file://{path}")
    return system.open_input_file(name)


def files_below(path: str, ending: str) -> list[str]:
    """The file itself, or all files below a folder whose names end so."""
    scheme = re.match(r"(\w[\w+.-]+://)?", path)[0]
    system, name = fs.FileSystem.from_uri(path if scheme else f"file://{path}")
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((scheme if scheme != "file://" else "") + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(ending))


def read_header(path: str) -> Header:
    with open_file(path) as f:
        fixed = f.read(256).decode("latin-1")
        at, head = 0, {}
        for name, width in HEAD:
            head[name], at = fixed[at : at + width].strip(), at + width
        n, size = int(head["signals"]), int(head["bytes"])
        body = f.read(256 * n).decode("latin-1")
        if len(body) < 256 * n or size != 256 * (n + 1):
            raise ValueError(f"{path}: not an EDF header")
        at, columns = 0, {}
        for name, width in SIGNAL:
            columns[name] = [body[at + i * width : at + (i + 1) * width].strip() for i in range(n)]
            at += n * width
        signals, offset = [], 0
        for i in range(n):
            c = {k: v[i] for k, v in columns.items()}
            signals.append(Signal(c["label"], c["unit"], *[float(c[k]) for k in ("low", "high", "digital_low", "digital_high")], int(c["samples"]), offset, c["transducer"], c["filter"]))
            offset += signals[-1].samples
        # a file cut short, or still being written (-1), has the whole records that are there
        whole = max(0, f.size() - size) // max(1, 2 * offset)
    records = int(head["records"])
    return Header(path, size, whole if records < 0 else min(records, whole), float(head["seconds"]), head["kind"].startswith(INTERRUPTED), tuple(signals))


def notes_of(raw: bytes) -> Iterator[tuple[float, float | None, str]]:
    """Onset, duration and text of the annotations in a record's track; the one that times the record has an empty text."""
    for entry in raw.split(b"\x00"):
        time, *texts = entry.split(b"\x14")
        found = re.fullmatch(rb"([+-]\d+(?:\.\d*)?)(?:\x15(\d+(?:\.\d*)?))?", time)
        if found:
            for text in texts[:-1]:
                yield float(found[1]), float(found[2]) if found[2] else None, text.decode("utf-8", "replace")


class Records(InputPartition):
    def __init__(self, header: Header, first: int, n: int):
        self.header, self.first, self.n = header, first, n


class FilteredReader(DataSourceReader):
    """Equality and IN filters on `channel` and `path` are taken over: other channels are not decoded, other files not read."""

    def __init__(self, options: dict):
        self.paths = [p for p in (options.get("path") or "").split(",") if p] or re.findall(r'"([^"]+)"', options.get("paths", ""))
        self.part = int(options.get("partbytes", PART))
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("channel",), ("path",)):
                yield f
                continue
            name = f.attribute[0]
            self.only[name] = self.only[name] & values if name in self.only else values

    def wanted(self, name: str, value: str) -> bool:
        return name not in self.only or value in self.only[name]


class EdfReader(FilteredReader):
    """Data records of EDF files, or facts from their headers."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.table = options.get("table", "samples")

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in (f for p in self.paths for f in files_below(p, ".edf")):
            if not self.wanted("path", path):
                continue
            header = read_header(path)
            step = header.records if self.table == "channels" else max(1, self.part // max(1, header.width))
            out += [Records(header, first, min(step, header.records - first)) for first in range(0, header.records, max(1, step))] or [Records(header, 0, 0)]
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        h = partition.header
        tracks = [s for s in h.signals if s.label == ANNOTATIONS]
        signals = [s for s in h.signals if s.label != ANNOTATIONS and self.wanted("channel", s.label)]
        if self.table == "channels":
            rows = [(h.path, i, s.label, s.unit, s.samples / h.seconds if h.seconds else None, s.samples * h.records, s.low, s.high, s.transducer, s.prefilter)
                    for i, s in enumerate(h.signals) if s in signals]
            yield from _batches(rows, CHANNELS)
            return
        if self.table == "samples" and not signals:
            return
        at_once = max(1, min(ROWS // max(1, max((s.samples for s in signals), default=1)), self.part // max(1, h.width)))
        with open_file(h.path) as f:
            for first in range(partition.first, partition.first + partition.n, at_once):
                n = min(at_once, partition.first + partition.n - first)
                f.seek(h.size + first * h.width)
                data = np.frombuffer(f.read(n * h.width), "<i2").reshape(n, h.width // 2)
                track = lambda s, r: data[r, s.offset : s.offset + s.samples].tobytes()
                if self.table == "annotations":
                    notes = [(h.path, *x) for s in tracks for r in range(n) for x in notes_of(track(s, r)) if x[2]]
                    yield from _batches(notes, NOTES)
                    continue
                start = (first + np.arange(n)) * h.seconds
                if h.interrupted and tracks:
                    start = np.array([next((x[0] for x in notes_of(track(tracks[0], r))), start[r]) for r in range(n)])
                for s in signals:
                    v = s.scaled(data[:, s.offset : s.offset + s.samples]).ravel()
                    t = (start[:, None] + np.arange(s.samples) * (h.seconds / s.samples)).ravel()
                    names = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(v), np.int32)), [x]).dictionary_decode() for x in (h.path, s.label)]
                    yield pa.record_batch([*names, pa.array(np.arange(len(v)) + first * s.samples), pa.array(t), pa.array(v)], names=["path", "channel", "sample_idx", "t", "v"])


def _batches(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    if rows:
        yield pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


class EdfSource(DataSource):
    """Options: path (file or folder, several with commas), table (samples, channels or annotations), partBytes."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return {"samples": SAMPLES, "channels": CHANNELS, "annotations": NOTES}[self.options.get("table", "samples")]

    def reader(self, schema) -> EdfReader:
        return EdfReader({k.lower(): v for k, v in self.options.items()})


def read_edf(spark: SparkSession, paths: str | Sequence[str], table: str = "samples", part_bytes: int = PART) -> DataFrame:
    """Samples (path, channel, sample_idx, t in seconds, v in the channel's unit), channel facts or annotations of EDF files.

    Times of interrupted recordings are those that their records state.  Filters on `channel` and `path` reach the reader.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EdfSource)
    names = paths if isinstance(paths, str) else ",".join(paths)
    return spark.read.format("edf").option("table", table).option("partBytes", part_bytes).load(names)
