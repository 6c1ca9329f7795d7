"""Session settings and durable intermediate tables."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyarrow import NativeFile, fs
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1_000  # texts in an Arrow batch, where workers hold them whole
_SCRATCH_KEY = "spark.qrelia.scratch"
_local_folders: list[tempfile.TemporaryDirectory] = []
_shipped: set[str] = set()


def local_session(cpus: int | None = None, app: str = "qrelia") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    n = cpus or os.cpu_count() or 1
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions run in tasks refer to it by name; it need not be installed there.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _local_folders.append(tempfile.TemporaryDirectory(prefix="qrelia-", ignore_cleanup_errors=True))
    package = Path(__file__).parent
    archive = f"{_local_folders[-1].name}/{package.name}"
    context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession, most: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small: a Python worker keeps the memory of its largest."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(rows))
    if now <= 0 or now > most:
        spark.conf.set(rows, str(most))


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for durable intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder is used until this process ends, which is only sound when
    every task runs on this machine.
    """
    chosen = spark.conf.get(_SCRATCH_KEY, None)
    if chosen:
        return chosen
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        _local_folders.append(tempfile.TemporaryDirectory(prefix="qrelia-", ignore_cleanup_errors=True))
        shared = _local_folders[-1].name
    chosen = f"{shared.rstrip('/')}/qrelia-{uuid.uuid4().hex}"
    spark.conf.set(_SCRATCH_KEY, chosen)
    _delete_at_session_end(spark, chosen)
    return chosen


def _delete_at_session_end(spark: SparkSession, path: str) -> None:
    """Have the file system drop this session's own folder when the driver ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts lineage so that a lost executor never re-evaluates a non-repeatable
    expression, and gives Catalyst real file sizes for its join choices.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_shared(uri: str) -> NativeFile:
    """A file of the shared folder, by its name in ``DataFrame.inputFiles``, opened inside a task."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path))
    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition a file scan that has fewer splits than the session has cores.

    ``key`` is a column of mostly different values. Only a small or oddly written
    input is shuffled by this: a large one already has many more splits than
    cores and is returned as it is. No partition count is given, so adaptive
    execution merges the partitions of a tiny input again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if df.rdd.getNumPartitions() < cores else df


def files_fingerprint(tables: list[DataFrame], what: str = "") -> str:
    """Digest of ``what`` and of name, length and time of all files below ``tables``; no file is read."""
    spark = tables[0].sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    seen = hashlib.sha256(what.encode())
    for table in tables:
        files = sorted(table.inputFiles())
        if not files:
            seen.update(uuid.uuid4().bytes)  # not from files: equal to no other
        wanted = {f.rsplit("/", 1)[1] for f in files}
        for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
            at = path_of(folder)
            for status in at.getFileSystem(conf).listStatus(at):
                name = status.getPath().toUri().getRawPath()
                if name.rsplit("/", 1)[1] in wanted or status.getPath().getName() in wanted:
                    seen.update(f"{name}|{status.getLen()}|{status.getModificationTime()}\n".encode())
    return seen.hexdigest()
