"""Writers: tables as numbered versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointer(table_dir: str) -> str:
    return f"{table_dir.rstrip('/')}/CURRENT"


def current_version(spark: SparkSession, table_dir: str) -> int | None:
    """Version the pointer names, None for a table never written."""
    jvm, target, fs = _hadoop(spark, _pointer(table_dir))
    if not fs.exists(target):
        return None
    return int(spark.read.text(_pointer(table_dir)).head()[0])


def versions(spark: SparkSession, table_dir: str) -> list[int]:
    """Numbers of the versions that were written completely."""
    jvm, target, fs = _hadoop(spark, table_dir)
    if not fs.exists(target):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(target)]
    numbers = [int(name[2:]) for name in names if name.startswith("v=")]
    done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{table_dir.rstrip('/')}/v={n}/_SUCCESS"))
    return sorted(n for n in numbers if done(n))


def write_version(
    df: DataFrame, table_dir: str, sort_by: list[str | Column] | None = None, version: int | None = None
) -> int:
    """Write a table as its next version and then move the pointer to it.

    A job that dies half-way leaves the pointer, and so the readers, on the old
    version. With ``sort_by`` files cover ranges, which lets later reads skip them. A
    stream passes the ``version`` of its batch, so that a repeated batch overwrites
    its own version.
    """
    spark = df.sparkSession
    number = version if version is not None else (current_version(spark, table_dir) or 0) + 1
    laid_out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else df
    laid_out.write.mode("overwrite").parquet(f"{table_dir.rstrip('/')}/v={number}")
    draft = f"{table_dir.rstrip('/')}/_CURRENT-{uuid.uuid4().hex}"
    jvm, source, fs = _hadoop(spark, draft)
    stream = fs.create(source, True)
    stream.write(bytearray(str(number), "ascii"))
    stream.close()
    target = jvm.org.apache.hadoop.fs.Path(_pointer(table_dir))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(source), fs.makeQualified(target), _overwrite(jvm, spark))
    return number


def _overwrite(jvm, spark: SparkSession):
    """The one-element option array the rename call takes."""
    option = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    array[0] = option
    return array


def read_version(
    spark: SparkSession, table_dir: str, version: int | None = None, schema: StructType | None = None
) -> DataFrame:
    """The current version of a table, or a given one; a known ``schema`` spares looking into the files."""
    number = current_version(spark, table_dir) if version is None else version
    if number is None:
        raise FileNotFoundError(f"table was never written: {table_dir}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{table_dir.rstrip('/')}/v={number}")
