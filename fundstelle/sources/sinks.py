"""Writers: inserts that leave existing keys alone, appended logs, JSON reports per configuration, JSONL checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundstelle.operators.ingest import new_rows


def existing(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path`` as it is now; an empty one if there is no such path on its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def insert_new(df: DataFrame, path: str, keys: list[str], order: list[Column] | None = None) -> None:
    """Appends rows whose key isn't there yet, one per key. Doing it again adds nothing."""
    new_rows(existing(df.sparkSession, path, df.schema), df, keys, order).write.mode("append").parquet(path)


def append_logs(rows: DataFrame, path: str) -> None:
    """Query logs, by day of creation so that windows read few files; costs have six decimals."""
    rows.withColumn("cost_usd", F.col("cost_usd").cast("decimal(10,6)")).withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def write_reports(rows: DataFrame, path: str) -> None:
    """One folder of JSON lines per configuration, named by its hash."""
    rows.write.mode("overwrite").partitionBy("config_hash").json(path)


def append_checkpoint(rows: DataFrame, path: str) -> None:
    """One line per finished question; nulls are kept, so that an error can be told from success."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)
