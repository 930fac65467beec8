"""Tables between steps: the folder that driver and executors share, and written intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a temporary folder serves, but in local mode only: elsewhere executors would
    write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evidence-spark-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read back: computed once, and a lost executor costs no more than it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(StructType.fromJson(df.schema.jsonValue())).parquet(path)
    out._stored_at = path
    return out


def local(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A few rows, or none, as literals of the plan. createDataFrame() of a list would start Python workers on every core to hand
    them on, which stay in memory beside those of the query, and its unknown size would keep a join from sending them."""
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    one = spark.range(0, 1, 1, 1)
    if not rows:
        return one.where("false").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    return one.select(F.inline(F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields, strict=True))) for r in rows))))


def discard(*dfs: DataFrame) -> None:
    """Remove what written() wrote, once nothing reads it any more."""
    for df in dfs:
        if getattr(df, "_stored_at", None):
            delete(df.sparkSession, df._stored_at)
