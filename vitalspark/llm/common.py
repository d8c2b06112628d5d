"""What the operators of this subpackage share: tables, the shared folder, written tables."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_to_delete: list[tuple[SparkSession, str]] = []
_scratch: contextvars.ContextVar[list[tuple[SparkSession, str]] | None] = contextvars.ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset and Spark runs in this process alone, a folder of our own; on a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vitalspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/vitalspark-{uuid.uuid4().hex}/{name}"
    _to_delete.append((spark, path.rsplit("/", 1)[0]))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What is written() inside, but for what is to be kept, goes at its end."""
    token = _scratch.set([])
    try:
        yield
    finally:
        for spark, path in _scratch.get():
            delete(spark, path)
            _to_delete.remove((spark, path))
        _scratch.reset(token)


def written(spark: SparkSession, frame: DataFrame, name: str, keep: bool = False, group_rows: int | None = None) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read from there: lineage ends, and lost executors lose nothing.

    group_rows: most rows of a row group.  A writer holds a row group, and a reader decodes up to 4096 of its rows at
    once, whatever their size: where one row is long arrays, only few of them fit in memory.
    """
    small_batches(spark)
    path = new_folder(spark, name)
    if not keep and (open_ := _scratch.get()) is not None:
        open_.append((spark, path.rsplit("/", 1)[0]))
    (frame.write if group_rows is None else frame.write.option("parquet.block.row.count.limit", group_rows)).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@atexit.register
def _delete_all() -> None:
    for spark, path in _to_delete:
        try:
            delete(spark, path)
        except Exception:  # the session has ended before the driver: the folder is the cluster's to clean
            return


#: Bytes of one Arrow batch, where the session has Spark's own limit: a Python worker holds several copies of a batch.
BATCH_BYTES, SPARKS_OWN = "8m", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound what is sent to a Python worker at once; a limit that the session has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in (SPARKS_OWN, "64m"):
        spark.conf.set(key, BATCH_BYTES)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two longs (id0, key) that tell rows apart: also rows without a doc_id, or with a repeated one.

    Rows alike in doc_id and text share a key; they also share every result.
    """
    return docs.select("doc_id", "text").withColumns({"id0": F.coalesce("doc_id", F.lit(-1).cast("long")), "key": F.xxhash64("doc_id", "text")})


#: Ids up to which a set of doc_ids is broadcast (8 bytes each); a larger one is joined by a shuffle.
BROADCAST_IDS = 2_000_000


def sized(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids  # a written table's rows are counted from its files' footers


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't among ids; rows without a doc_id stay."""
    gone = written(docs.sparkSession, ids.where("doc_id IS NOT NULL").distinct(), "gone")
    return docs.join(sized(gone), "doc_id", "left_anti").select(docs.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; operators take the place as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
