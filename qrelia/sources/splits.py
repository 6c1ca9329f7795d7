"""Named splits of datasets kept as files.

A dataset is a folder; below it a configuration (a folder, may be none), below that a split: a folder of files,
one file ``<split>.<ext>``, or numbered files ``<split>-*.<ext>``. A layout has a default split. Parquet files are read by Spark itself. JSON
lines and CSV files are read by a data source of ours, because Spark gives their rows no number: a row's place is its
file and its byte offset (JSON lines, read in pieces of a file by many tasks) or its row number (CSV, one task per
file: a quoted cell may hold line ends).
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from qrelia.sources.tables import POS, read_table

# The split that is read when none is named.
DEFAULT_SPLITS = {"beir": "test", "squad": "validation", "triplets": "train"}
EXTENSIONS = {"parquet": ("parquet",), "json": ("json", "jsonl"), "csv": ("csv",)}

PIECE_BYTES = 64 << 20  # of a JSON lines file read by one task
LOOK_BYTES = 1 << 20  # of the first file that tell the columns of a table
BATCH_ROWS = 4_096


def _open(path: str) -> tuple[fs.FileSystem, str]:
    parts = urlsplit(path)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def _entries(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)


def split_files(dataset: str, config: str | None, split: str, fmt: str = "parquet") -> list[str]:
    """Files of a split in order, as paths; none if the dataset has no such split."""
    system, base = _open("/".join(p for p in (dataset.rstrip("/"), config) if p))
    prefix = dataset[: len(dataset) - len(urlsplit(dataset).path)] if "://" in dataset else ""
    endings = EXTENSIONS[fmt]
    inside = [f for f in _entries(system, f"{base}/{split}") if f.is_file and f.extension in endings]
    beside = [f for f in _entries(system, base) if f.is_file and f.extension in endings]
    numbered = [f for f in beside if f.base_name.startswith(f"{split}-") or f.base_name.rsplit(".", 1)[0] == split]
    return [prefix + f.path for f in inside or numbered]


def split_names(dataset: str, config: str | None = None, fmt: str = "parquet") -> list[str]:
    """Names of the splits of a configuration."""
    system, base = _open("/".join(p for p in (dataset.rstrip("/"), config) if p))
    names = set()
    for f in _entries(system, base):
        if f.type == fs.FileType.Directory:
            names.add(f.base_name)
        elif f.extension in EXTENSIONS[fmt]:
            stem = f.base_name.rsplit(".", 1)[0]
            names.add(stem.split("-")[0])
    return sorted(names)


def read_split(
    spark: SparkSession,
    dataset: str,
    config: str | None = None,
    split: str | None = None,
    fmt: str = "parquet",
    layout: str = "beir",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of a split with ``pos``, their place in the order of the split.

    No ``split`` means the layout's default. A split that is not there is an error that names those that are.
    """
    split = split or DEFAULT_SPLITS[layout]
    files = split_files(dataset, config, split, fmt)
    if not files:
        raise FileNotFoundError(f"no split {split!r} in {dataset}/{config or ''}: there are {split_names(dataset, config, fmt)}")
    if fmt == "parquet" or order_by:
        return read_table(spark, files, fmt, order_by)
    spark.dataSource.register(OrderedText)
    reader = spark.read.format(OrderedText.name()).option("kind", fmt).option("files", json.dumps(files))
    return reader.option("pieceBytes", str(PIECE_BYTES)).load()


# --- rows of text files with their place --------------------------------------------


@dataclass
class Piece(InputPartition):
    file: int
    path: str
    begin: int
    end: int


class OrderedText(DataSource):
    """JSON lines or CSV files, given in order; adds ``pos``, a struct of file number and place in the file."""

    @classmethod
    def name(cls) -> str:
        return "ordered_text"

    def schema(self) -> StructType:
        files, kind = json.loads(self.options["files"]), self.options["kind"]
        system, path = _open(files[0])
        with system.open_input_stream(path, compression=None) as source:
            head = source.read(LOOK_BYTES)
        if kind == "csv":
            first = next(csv.reader(io.StringIO(head.decode("utf-8", "replace"))), [])
            fields = StructType([StructField(name, StringType()) for name in first])
        else:
            whole = head[: head.rfind(b"\n") + 1] or head
            rows = [json.loads(line) for line in whole.splitlines() if line.strip()]
            names = list(dict.fromkeys(name for row in rows for name in row))
            columns = {name: pa.array([row.get(name) for row in rows]) for name in names}
            fields = from_arrow_schema(pa.schema([(n, pa.string() if pa.types.is_null(c.type) else c.type) for n, c in columns.items()]))
        place = StructType([StructField("file", LongType()), StructField("at", LongType())])
        return StructType([*fields, StructField(POS, place)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _OrderedReader(schema, self.options)


class _OrderedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.files, self.kind = schema, json.loads(options["files"]), options["kind"]
        self.piece = int(options.get("pieceBytes", PIECE_BYTES))

    def partitions(self) -> list[Piece]:
        out = []
        for i, path in enumerate(self.files):
            system, at = _open(path)
            size = system.get_file_info(at).size
            step = self.piece if self.kind == "json" else max(size, 1)
            out += [Piece(i, path, b, min(b + step, size)) for b in range(0, size, step)]
        return out or [Piece(0, self.files[0], 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(self.schema)
        names = [n for n in types.names if n != POS]
        rows = []
        for at, row in (_json_rows if self.kind == "json" else _csv_rows)(piece):
            rows.append({**{n: row.get(n) for n in names}, POS: {"file": piece.file, "at": at}})
            if len(rows) == BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, types)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)


def _json_rows(piece: Piece) -> Iterator[tuple[int, dict]]:
    """Lines that start in the piece; the last one may end beyond it."""
    system, path = _open(piece.path)
    with system.open_input_file(path) as raw, io.BufferedReader(raw) as source:
        source.seek(max(piece.begin - 1, 0))
        if piece.begin:
            source.readline()  # the rest of a line that starts before
        while (at := source.tell()) < piece.end:
            line = source.readline()
            if not line:
                break
            if line.strip():
                yield at, json.loads(line)


def _csv_rows(piece: Piece) -> Iterator[tuple[int, dict]]:
    system, path = _open(piece.path)
    with system.open_input_stream(path, compression=None) as raw, io.TextIOWrapper(raw, "utf-8", newline="") as source:
        for i, row in enumerate(csv.DictReader(source)):
            yield i, {k: v if v != "" else None for k, v in row.items() if k is not None}

