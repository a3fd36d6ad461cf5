"""What the operators of this subpackage share: shared folder, shipping, text."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Rows in an Arrow batch.  Texts may be long, so batches hold few rows.
BATCH_ROWS = 256
#: Bytes after which an Arrow batch ends although it has fewer rows.
BATCH_BYTES = 8 << 20
#: Public vocabulary file that the registered queries use.
VOCABULARY = "byte_bpe_50k.json"

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this package's code for the Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    if root.suffix != ".zip" and root.is_dir():
        folder = tempfile.mkdtemp(prefix="tickloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/tickloom.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        spark.sparkContext.addPyFile(f"{folder}/tickloom.zip")
    _shipped.add(app)


def light(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which a worker gives freed memory back; workers are kept for later tasks."""

    def trimmed(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return trimmed


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none (tests, a single machine) a temporary folder
    is made, set as the checkpoint folder and removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        folder = tempfile.mkdtemp(prefix="tickloom-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else f"file://{os.path.abspath(base)}"


def new_folder(spark: SparkSession, name: str) -> str:
    """Address of a new folder of this name below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def released(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Shuffle files go as soon as the table that needs them is written."""
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | settings
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_through(df: DataFrame) -> None:
    """Run a plan for what its tasks write."""
    with released(df.sparkSession):
        df.write.format("noop").mode("overwrite").save()


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage."""
    return written(df, new_folder(df.sparkSession, name))


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared place that no later read needs."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


class Scratch:
    """Tables of one operator in the shared folder, deleted when their readers are done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def folder(self, name: str) -> str:
        self.paths.append(new_folder(self.spark, name))
        return self.paths[-1]

    def store(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, self.folder(name))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, *self.paths)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of an address (file, hdfs, s3, ...)."""
    uri = uri if "://" in uri else uri.replace("file:", "file://", 1)
    return pafs.FileSystem.from_uri(uri)


def publish(folder: str, name: str, write) -> int:
    """Write a file under a name of its own, then move it to its final name.

    A task that runs twice (a lost executor, speculation) writes the same bytes
    and the last move wins, so readers never see half a file.  Returns bytes.
    """
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        write(f)
        size = f.tell()
    fs.move(part, f"{base}/{name}")
    return size


def open_input(folder: str, name: str) -> io.RawIOBase:
    fs, base = filesystem(folder)
    return fs.open_input_stream(f"{base}/{name}", compression=None)


#: Rows of an input file that one side file speaks of.
SIDE_ROWS = 1 << 20


def _side(file: str, chunk: int) -> str:
    return f"{hashlib.sha256(file.encode()).hexdigest()[:32]}-{chunk}"


def write_sides(places: DataFrame, folder: str) -> None:
    """Write rows (file, row, value long; each place once) as side files, one for SIDE_ROWS rows of an input file.

    Whoever reads those input files again looks its rows up there, so that their
    texts need not be shuffled to meet a decision.
    """
    spark = places.sparkSession
    prepare(spark)
    chunk = F.shiftright("row", SIDE_ROWS.bit_length() - 1).alias("chunk")
    rows = places.select("file", chunk, "row", "value").repartition(partitions(spark), "file", "chunk").sortWithinPartitions("file", "chunk", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(key, held) -> None:
            row, value = (np.concatenate(x) for x in zip(*held, strict=True))
            publish(folder, _side(*key), lambda f: f.write(row.astype("<i8").tobytes() + value.astype("<i8").tobytes()))

        at, held, n = None, [], 0
        for batch in batches:
            for key, low, high in _stretches(batch.column(0), batch.column(1).to_numpy()):
                if key != at and held:
                    put(at, held)
                    held, n = [], n + 1
                at = key
                held.append((batch.column(2).to_numpy()[low:high], batch.column(3).to_numpy()[low:high]))
        if held:
            put(at, held)
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    run_through(rows.mapInArrow(light(run), "n long"))


def _stretches(files: pa.Array, chunks: np.ndarray) -> Iterator[tuple[tuple[str, int], int, int]]:
    """Stretches of a batch with one file and chunk: ((file, chunk), first, end)."""
    if not len(chunks):
        return
    coded = files.dictionary_encode()
    code = coded.indices.to_numpy()
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (chunks[1:] != chunks[:-1])) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)], strict=True):
        yield (coded.dictionary[code[low]].as_py(), int(chunks[low])), low, high


class Sides:
    """Look-up in side files; the last few stay in memory."""

    def __init__(self, folder: str):
        self.folder, self.held = folder, OrderedDict()

    def _load(self, key: tuple[str, int]) -> tuple[np.ndarray, np.ndarray]:
        if key not in self.held:
            fs, base = filesystem(self.folder)
            raw = b""
            if fs.get_file_info(f"{base}/{_side(*key)}").type != pafs.FileType.NotFound:
                with open_input(self.folder, _side(*key)) as f:
                    raw = f.read()
            both = np.frombuffer(raw, "<i8")
            self.held[key] = (both[: len(both) // 2], both[len(both) // 2 :])
            if len(self.held) > 4:
                self.held.popitem(last=False)
        return self.held[key]

    def find(self, files: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each place is listed, and its value."""
        found, value = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
        for key, low, high in _stretches(files, rows // SIDE_ROWS):
            row, own = self._load(key)
            if len(row):
                at = np.minimum(np.searchsorted(row, rows[low:high]), len(row) - 1)
                found[low:high] = row[at] == rows[low:high]
                value[low:high] = np.where(found[low:high], own[at], 0)
        return found, value


def at_places(docs: DataFrame, folder: str, value: str | None = None) -> DataFrame:
    """Rows of ``docs`` (that has file places) listed in the side files, with their value; without ``value``: those not listed."""
    whole = F.struct("*").alias("whole")
    rows = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides(folder)
        for batch in batches:
            found, own = sides.find(batch.column(0), batch.column(1).to_numpy())
            out = pa.RecordBatch.from_arrays([batch.column(2), pa.array(own)], names=["whole", "value"])
            yield out.filter(pa.array(found if value else ~found))

    kept = rows.mapInArrow(light(run), StructType([StructField("whole", rows.schema["whole"].dataType), StructField("value", LongType())]))
    return kept.select("whole.*", *([F.col("value").alias(value)] if value else []))


def without_places(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (that has file places) that are not among the places (file, row)."""
    folder = new_folder(docs.sparkSession, "gone")
    write_sides(gone.select("file", "row", F.lit(0).cast("long").alias("value")), folder)
    return at_places(docs, folder)


def memory_map(folder: str, name: str):
    """Buffer over a file: mapped if local, else read."""
    import pyarrow as pa

    fs, base = filesystem(folder)
    path = f"{base}/{name}"
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as m:
            return m.read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
