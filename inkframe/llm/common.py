"""Shared pieces of the training-data operators: staging in the shared folder, table access, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex for the characters that separate words: the ASCII space and \t to \r. ``bytes.split()`` splits at the same ones.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; without it, a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(f"file://{tempfile.mkdtemp(prefix='inkframe-')}")
    return _own_folder[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet; it is deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stage(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: later steps start from files, not from df's lineage.
    zstd takes a third less room than snappy for texts."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as no column of df has it, in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; batches are cut so that one holds a bounded amount of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                out = fn(part)
                if out is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    return df.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about most_bytes each; a single row may be larger."""
    if batch.num_rows == 0:
        return
    rows = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


class Remembered:
    """What has been made of keys: at most two generations of `most` entries. A full generation becomes the older one, and
    what is used again moves on to the newer, so frequent keys stay and rare ones go."""

    def __init__(self, most: int, longest: int = 64) -> None:
        self.most, self.longest = most, longest
        self.now: dict = {}
        self.before: dict = {}

    def of(self, keys: set, make: Callable[[list], Iterable]) -> dict:
        """A table with all keys in it; make gives the values of those that are in neither generation."""
        if len(self.now) > self.most:
            self.before, self.now = {k: v for k, v in self.now.items() if len(k) <= self.longest}, {}
        now, before, new = self.now, self.before, []
        for key in keys.difference(now):
            if (had := before.get(key)) is not None:
                now[key] = had
            else:
                new.append(key)
        now.update(zip(new, make(new), strict=True))
        return now


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def text_or_empty(column: str) -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))
