"""Record, report and index files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def read_records(spark: SparkSession, folder: str, schema: StructType, keys: list[str] | None = None) -> DataFrame:
    """One JSON record a file; files that can't be read as the schema are left out. With keys, only those records."""
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    return found if keys is None else found.where(F.col("key").isin(keys))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; cells may span lines; rows without any value are left out."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.where(F.concat_ws("", *(F.trim(F.col(f"`{c}`")) for c in rows.columns)) != "")


def write_sheet(df: DataFrame, path: str, bom: bool = False) -> None:
    """A CSV with a header; lists are joined by '; ' and line breaks folded to one space. With `bom` every file begins with the byte order mark that spreadsheets look for."""
    def cell(field: StructField) -> Column:
        c = F.col(f"`{field.name}`")
        text = F.array_join(c, "; ") if isinstance(field.dataType, ArrayType) else c
        if isinstance(field.dataType, (ArrayType, StringType)):
            text = F.regexp_replace(text, r"\s*[\r\n]+\s*", " ")
        return text.alias(field.name)

    rows = df.select(*(cell(f) for f in df.schema))
    rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0]) if bom else rows
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_index(df: DataFrame, path: str, version: int) -> None:
    """An index under its version; a reader of another version doesn't see it."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_index(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """The index of this version, or None, which asks for a full rebuild."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}/_SUCCESS")
    return spark.read.parquet(f"{path}/version={version}") if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
