"""Shared plumbing of the training-data operators.

Three conventions hold in every operator here:

* an operator first selects the columns it needs, so extra columns, whatever
  their names, never reach it;
* work that must leave the JVM runs in ``mapInArrow`` / ``applyInArrow`` over
  bounded batches;
* records that would be billions of tiny rows travel as packed NumPy blobs, one
  per (batch, bucket), so that Spark shuffles few rows and many bytes.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that is handed to Python.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Input bytes (as stored) for which one bucket of packed records is planned.
BUCKET_BYTES = 4 << 20
#: Assumed for a row where the optimizer knows no size.
ROW_BYTES = 2 << 10
MIN_BUCKETS = 96


def session(df: DataFrame) -> SparkSession:
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """df, materialised in the folder that the cluster shares; its lineage ends there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Spark drops the shuffles of finished phases when the driver's garbage is collected, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes the files of a result of cut that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; without a cluster, where none is named, one of this machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="waygrid-")


def stored_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size (for a file scan, the files' bytes), or where it has none, from a count."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.count() * ROW_BYTES


def buckets_for(size: int) -> int:
    """How many buckets packed records of an input of that many bytes are dealt to."""
    return int(max(MIN_BUCKETS, size // BUCKET_BYTES))


def text_or_empty(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string of the few types used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        fields.append(pa.field(name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]))
    return pa.schema(fields)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], Iterable[list]]], ddl: str) -> DataFrame:
    """Each Arrow batch, as Python lists by column, through make()'s function, which returns columns."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                columns = step([c.to_pylist() for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)


def pack(records: np.ndarray, bucket: np.ndarray, n: int) -> tuple[list[int], list[bytes]]:
    """records split by bucket (ints under n) into one blob per bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    records, counts = records[order], np.bincount(bucket, minlength=n)
    ends = np.cumsum(counts)
    full = np.flatnonzero(counts)
    return full.tolist(), [records[ends[b] - counts[b] : ends[b]].tobytes() for b in full]


def unpack(blobs: Iterable[bytes], dtype: np.dtype) -> np.ndarray:
    joined = b"".join(blobs)
    return np.frombuffer(joined, dtype)


def spans_text(spans: list[tuple[int, int, str]], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]], x[1])))
