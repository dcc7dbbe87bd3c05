"""Hadoop file operations through the session, so that any store that Spark reaches works; and readers by format."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.model import PLACE, SCOPE, VERSION, Kind, Unit


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file; False if it is there already. Only one writer can win."""
        fs, p = self._fs(path)
        fs.mkdirs(p.getParent())
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def age(self, path: str) -> float:
        """Seconds since the last change."""
        fs, p = self._fs(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)


def placed(df: DataFrame) -> DataFrame:
    """Rows read from Parquet files with their place: the file, by its path, then the row in it."""
    return df.withColumn(PLACE, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def conform(df: DataFrame, unit: Unit, scope: str | None = None) -> DataFrame:
    """Any frame as a unit's rows: declared types (doubles become exact decimals, times without zone are UTC), engine columns added; a place is kept."""
    have = {c.lower() for c in df.columns}
    out = []
    for c in unit.columns:
        if c.name.lower() not in have:
            out.append(F.lit(c.default).cast(c.spark_type()).alias(c.name))
        elif c.kind is Kind.GUID:
            out.append(F.lower(F.col(f"`{c.name}`")).alias(c.name))
        else:
            out.append(F.col(f"`{c.name}`").cast(c.spark_type()).alias(c.name))
    out += [F.col(f"`{e.name}`") for e in unit.element_sets if e.name.lower() in have]
    out += [(F.col(SCOPE) if SCOPE in df.columns else F.lit(scope).cast("string")).alias(SCOPE), F.lit(1).cast("long").alias(VERSION)]
    out += [F.col(PLACE)] if PLACE in df.columns else []
    return df.select(*out)


def read(spark: SparkSession, unit: Unit, path: str, format: str = "parquet", **options) -> DataFrame:
    """A unit's rows from files (parquet, orc, json, csv) or, with format jdbc, from a database table."""
    reader = spark.read.format(format).options(**options)
    if format in ("json", "csv"):
        reader = reader.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in unit.schema() if not f.name.startswith("__quern_")))
    return conform(reader.load() if format == "jdbc" else reader.load(path), unit)

