"""Tables written into the folder that driver and executors share, to cut lineage so that lost executors lose nothing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_opened: set[str] = set()
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. It goes when Python ends.

    Where that is unset, a local master gets a temporary folder; on a cluster no folder of one machine would do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        path = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="factloom-")
    path = f"{path.rstrip('/')}/factloom-{spark.sparkContext.applicationId}"
    if path not in _opened:
        _opened.add(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        atexit.register(_remove, system, place)
    return path


def _remove(system, place) -> None:
    with contextlib.suppress(Exception):  # Spark may be gone by then
        system.delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what `written` wrote for these tables. For those that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def global_row_number(df: DataFrame, order: list, name: str = "row_number", total: str | None = None) -> DataFrame:
    """df with its rows' numbers from 1 in the given order (and their total), without one task that sees all rows.

    Rows are dealt by range and written; each range numbers its own rows, starting from the sizes of those before it (one
    small row a range reaches the driver).
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())
    starts, seen = [], 0
    for part, size in sizes:
        starts.append((part, seen))
        seen += size
    starts = spark.createDataFrame(starts, "_range int, _start long")
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = dealt.withColumn("_number", number).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_number"))
    if total:
        out = out.withColumn(total, F.lit(seen).cast("long"))
    return out.drop("_range", "_start", "_number")
