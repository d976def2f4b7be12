"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see. A local folder only where that is unset and the session runs on one machine (tests)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarnlight-checkpoints-"))
    return sc.getCheckpointDir()


_written: list[tuple[object, str]] = []


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _remove_all() -> None:
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is None:  # a session that has ended leaves its files to the owner of the shared folder
            continue
        try:
            removed(spark, path)
        except (Py4JError, OSError):  # so does one whose JVM has gone
            return


atexit.register(_remove_all)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes what saved() wrote for df, once nothing reads it any more."""
    files = df.inputFiles()
    for entry in list(_written):
        spark, path = entry
        tail = path.rsplit("/", 1)[1]
        if any(f"/{tail}/" in f for f in files):
            removed(spark, path)
            _written.remove(entry)


def text_of(column: str | Column = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def hex_digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids that are broadcast at most.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs but the rows whose id is in gone (one column). Texts are shuffled only where gone is too long to broadcast."""
    gone = saved(gone.toDF("_gone"), "dropped-ids")
    if gone.count() <= broadcast_ids:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(doc_id) == F.col("_gone"), "left_anti")


#: Keys that are broadcast at most because they hold many rows.
HOT_KEYS = 20_000


def met(rows: DataFrame, keyed: DataFrame, on: list[str], size: str, total: int, hot_keys: int = HOT_KEYS) -> DataFrame:
    """The inner join of rows with keyed, whose keys are unique; both are stored. size: rows of a key, total: of all keys.

    Keys of more than 1 / hot_keys of all rows are fewer than hot_keys, whatever the data: these are broadcast, and
    in the shuffle of the other rows no key holds more than that share.
    """
    large = F.col(size) > total // hot_keys
    hot = F.broadcast(keyed.filter(large))
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(keyed.filter(large).select(*on)), on, "left_anti").join(keyed.filter(~large), on))


#: Bytes of input for each core up to which a table is dealt over the cores.
SPREAD_BYTES = 8_000_000


def spread(df: DataFrame) -> DataFrame:
    """df with work for each core. Files of some megabytes may be one split, which one core would work off; beyond
    SPREAD_BYTES a core (by the planner's estimate) splits are many, and nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPREAD_BYTES * cores else df


#: Rows of an Arrow batch at most. Spark's own default of 10,000 takes tens of megabytes of texts outside the heap, in
#: the JVM and in the worker, for each task.
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def released(run):
    """A batch function whose task gives its memory back at its end: workers live on and hold other operators' tasks later.

    The session's Arrow batches are cut to BATCH_ROWS from here on, if they were larger.
    """
    spark = SparkSession.getActiveSession()
    if spark and not 0 < int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return wrapped


def pieces(batch, column: int, most: int):
    """Slices of a batch that hold up to most bytes of a text column, one row at least: only these become Python objects."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
