"""Sources. Every reader takes an explicit schema and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str | list[str], schema: str, missing: str = "NA") -> DataFrame:
    """CSV with a header. The text ``NA`` and an unquoted empty cell are null.

    ``enforceSchema`` is off, so a header that differs from the schema is an error rather than
    a silent shift of columns.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", missing)
        .option("enforceSchema", False)
        .csv(path)
    )


def read_columns(spark: SparkSession, path: str | list[str], schema: str, missing: str = "NA") -> DataFrame:
    """The columns of the schema out of files that have more of them, found by name.

    Only the header line is read to find them. A value that does not fit its type is null. A folder without files, which
    a partitioned write of no rows leaves, has no rows; a missing one is an error.
    """
    wanted = T.StructType.fromDDL(schema)
    try:
        whole = spark.read.option("header", True).option("nullValue", missing).option("enforceSchema", False).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], wanted)
    return whole.select(*[_fitted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in wanted])


def _fitted(cell: Column, kind: T.DataType) -> Column:
    """The cell in its type; a count written as ``3.0`` is the integer 3."""
    if not isinstance(kind, T.IntegralType):
        return cell.try_cast(kind)
    number = cell.try_cast("double")
    return F.coalesce(cell.try_cast(kind), F.when(number == F.floor(number), number.try_cast(kind)))


def literal_table(spark: SparkSession, rows: Mapping | Sequence[tuple], schema: str) -> DataFrame:
    """A dimension written out in the program, such as labels by name."""
    data = list(rows.items()) if isinstance(rows, Mapping) else list(rows)
    return spark.createDataFrame(data, schema)


def read_drop(spark: SparkSession, root: str, upload_date: str, schema: str, name: str = "") -> DataFrame:
    """One dated drop, ``root/upload_date=…/name``; only that folder is listed."""
    path = f"{root}/upload_date={upload_date}" + (f"/{name}" if name else "")
    return read_table(spark, path, schema)


def read_drops(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All drops as one table with ``upload_date`` as partition column, so a filter on it prunes folders."""
    return read_table(spark, root, f"{schema}, upload_date string")


def file_name() -> Column:
    return F.col("_metadata.file_name")


def file_part(pattern: str, group: int = 1) -> Column:
    """Part of the name of the file a row came from; null where the name does not match."""
    found = F.regexp_extract(file_name(), pattern, group)
    return F.when(found != "", found)


def path_part(pattern: str, group: int = 1) -> Column:
    """As :func:`file_part`, over the whole path."""
    found = F.regexp_extract(F.col("_metadata.file_path"), pattern, group)
    return F.when(found != "", found)


def fixed_part(c: Column | str, start: int, from_end: int) -> Column:
    """The text from position ``start``, without the last ``from_end`` characters."""
    text = F.col(c) if isinstance(c, str) else c
    return F.substring(text, F.lit(start), F.length(text) - F.lit(from_end + start - 1))


def read_runs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of run files as one table; the run date is the first ten characters of the file name."""
    return read_table(spark, f"{folder}/*.csv", schema).withColumn("run_date", F.substring(file_name(), 1, 10))


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Path, modification time and size of files; their content is not read."""
    return (
        spark.read.format("binaryFile")
        .load(pattern)
        .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    )


def newest_files(spark: SparkSession, pattern: str, n: int = 4) -> DataFrame:
    """The n files changed last."""
    return list_files(spark, pattern).orderBy(F.desc("modified"), F.desc("path")).limit(n)


def newest_paths(spark: SparkSession, pattern: str, n: int = 4) -> list[str]:
    """Their paths, at most n, so that a reader opens these files and no others."""
    return [row.path for row in newest_files(spark, pattern, n).select("path").collect()]


def newest_folders(spark: SparkSession, pattern: str, n: int = 4) -> list[str]:
    """The n folders that hold the files changed last."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")
    changed = list_files(spark, pattern).groupBy(folder).agg(F.max("modified").alias("modified"))
    newest = changed.orderBy(F.desc("modified"), F.desc("folder")).limit(n)
    return [row.folder for row in newest.select("folder").collect()]


def read_newest_model_tables(spark: SparkSession, root: str, table: str, n: int = 4) -> DataFrame:
    """The n regions of a model output table, stored with one folder per region, that changed last."""
    paths = newest_folders(spark, f"{root}/{table}/region=*/*.parquet", n)
    return spark.read.option("basePath", f"{root}/{table}").parquet(*paths)


def read_model_table(spark: SparkSession, root: str, table: str, regions: list[str] | None = None) -> DataFrame:
    """A model output table stored as parquet with one folder per region."""
    df = spark.read.parquet(f"{root}/{table}")
    return df.where(F.col("region").isin(regions)) if regions else df


def read_model_jdbc(spark: SparkSession, url: str, table: str, region: str, **options: str) -> DataFrame:
    """A model output table from a database, where the deployment supplies the driver.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to read in parallel.
    """
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .load()
        .withColumn("region", F.lit(region))
    )


def read_calibration_files(spark: SparkSession, root: str) -> DataFrame:
    """All calibration files at once; region and series are partition columns of the folder."""
    return read_table(spark, root, "times string, values string, series string, region string")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive of model runs; a filter on ``model_run_date`` reads only the runs it names."""
    return spark.read.parquet(path)
