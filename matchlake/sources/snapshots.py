"""Reading and writing stat tables: CSV input, dated snapshots, season-partitioned matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

DATE_IN_NAME = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
SNAPSHOT_KEYS = ["stat", "table_type", "snapshot_date"]


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header line in latin-1, bound by header name whatever the order of the columns.

    Types come from ``schema``, never inferred: values that do not fit are null, columns
    of the schema that the file lacks are null, and other columns are left out.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    by_name = {name.strip(): name for name in reversed(raw.columns)}

    def column(field: StructField) -> Column:
        name = field.name.strip()
        if name not in by_name:
            return F.lit(None).cast(field.dataType).alias(field.name)
        text = F.col("`" + by_name[name].replace("`", "``") + "`")
        return text.try_cast(field.dataType).alias(field.name)

    return raw.select(*[column(f) for f in wanted.fields])


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def latest_snapshot(df: DataFrame, group: Sequence[str], file: Column | str, table_type: str | None = "Player") -> DataFrame:
    """Rows of the newest dated file of each group; files without a date are ignored.

    ``file`` names the file a row came from (``_metadata.file_name`` when read from CSV).
    """
    name = F.col(file) if isinstance(file, str) else file
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    dated = df.withColumn("snapshot_date", F.nullif(F.regexp_extract(base, DATE_IN_NAME, 1), F.lit("")))
    dated = dated.filter(F.col("snapshot_date").isNotNull() & name.endswith(".csv"))
    if table_type is not None:
        dated = dated.filter(base.startswith(f"{table_type}_"))
    newest = dated.groupBy(*group).agg(F.max("snapshot_date").alias("snapshot_date"))
    return dated.join(newest, [*group, "snapshot_date"])


def latest_file(spark: SparkSession, folder: str, table_type: str | None = "Player") -> str | None:
    """Path of the newest dated CSV below ``folder``, found from the listing alone.

    Only one row, the path, comes to the driver; file contents are not read.
    """
    pattern = f"{table_type}_*.csv" if table_type else "*.csv"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", F.regexp_extract("path", DATE_IN_NAME + r"[^/]*$", 1).alias("day"))
        .filter(F.col("day") != "")
    )
    newest = files.orderBy(F.desc("day"), "path").select("path").first()
    return newest["path"] if newest else None


def read_latest(spark: SparkSession, folder: str, schema: StructType | str, table_type: str | None = "Player") -> DataFrame | None:
    path = latest_file(spark, folder, table_type)
    return trim_headers(read_table(spark, path, schema)) if path else None


def write_dated(df: DataFrame, path: str, stat: str, table_type: str, day: str | None = None) -> None:
    """Store one run of a stat table; a rerun on the same day replaces only that day."""
    stamp = F.lit(day) if day else F.date_format(F.current_date(), "yyyy-MM-dd")
    (
        df.withColumns({"stat": F.lit(stat), "table_type": F.lit(table_type), "snapshot_date": stamp})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*SNAPSHOT_KEYS)
        .parquet(path)
    )


def read_dated(spark: SparkSession, path: str, stat: str, table_type: str = "Player") -> DataFrame:
    """Newest stored run of a stat table. The date bound is a subquery on a partition
    column, so only the newest folder is scanned."""
    runs = spark.read.parquet(path)
    runs = runs.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))
    runs = runs.filter((F.col("stat") == stat) & (F.col("table_type") == table_type))
    newest = runs.agg(F.max("snapshot_date")).scalar()
    return runs.filter(F.col("snapshot_date") == newest).drop(*SNAPSHOT_KEYS)


def write_matches(df: DataFrame, path: str) -> None:
    """Matches partitioned by season: a season filter then prunes folders."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("Season").parquet(path)
