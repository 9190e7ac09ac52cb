"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where none is set and all runs on this machine, as in tests, a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vistaq-checkpoint-"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def own_folder(spark: SparkSession) -> str:
    """Where this application writes inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/vistaq-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet to the shared folder: a lost executor costs no recomputation, columns are pruned and the size is known to joins."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """The rows of a written table, to be sent to every task if they are counted to be at most ``rows``; else Spark joins as it does."""
    return F.broadcast(df) if df.count() <= rows else df


def release(spark: SparkSession) -> None:
    """Remove what this application has written to its own folder; results that were not read yet are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a batch handed to a Python worker; texts of any length come in batches of about this size.
BATCH_BYTES = 16 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same rows, in a session that hands batches of at most BATCH_BYTES to Python workers."""
    name, session = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if session._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(session.conf.get(name)) > BATCH_BYTES:
        session.conf.set(name, f"{BATCH_BYTES}b")
    return df


def text_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a table, for choosing numbers of partitions, never for dropping rows; measured where there is none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 56:
        return size
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


#: Schemas of the tables that were read, so that a table's footer is looked up once and not by a job each time.
_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def extended(schema: T.StructType, more: str) -> T.StructType:
    """The schema with the fields of a DDL string added."""
    return T.StructType([*schema.fields, *T._parse_datatype_string(more).fields])


def as_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Just the key and the text, under the operators' own names: other columns can't clash."""
    return in_small_batches(df).select(df[key].alias("doc_id"), df[text].cast("string").alias("text"))
