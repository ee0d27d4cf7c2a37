"""What the operators of this package share."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Whole texts are counted in rows by Spark's Arrow batches; few rows a batch keep a batch of long
# texts within a worker's memory.
BATCH_ROWS = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of `df` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(df: DataFrame) -> DataFrame:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, if it is above, and return `df`."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and no other column, so that no further column can clash."""
    return small_batches(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


# A batch is handled in pieces of about this many bytes, since Spark bounds its rows and, from some way on, its bytes.
PIECE_BYTES = 2_000_000


def plain_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, for functions that take their batches in `pieces`; the session stays as it is."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def pieces(batches: Iterable[pa.RecordBatch], column: int = 1) -> Iterable[pa.RecordBatch]:
    """The rows of `batches` in pieces of about PIECE_BYTES of text in `column`; a longer text is a piece of its own."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PIECE_BYTES, side="right")))
            yield b.slice(at, to - at)
            at = to


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, as in local tests, one under the warehouse."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    return given or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")


def written(df: DataFrame) -> DataFrame:
    """`df` written once as a Parquet table in the shared folder and read again; takes less room than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by `written` that nothing reads any more, and let Spark delete the shuffle files of plans that are gone."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        for name in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """`df` as a checkpoint in the shared folder, so that a lost executor loses none of it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
              for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
