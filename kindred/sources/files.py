"""Text and Parquet sources and sinks of the record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindred.sources.schema import TABLES


def scan_psv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Pipe-separated files without header or quotes; ``path`` may be a glob, ``schema`` a table's name."""
    schema = TABLES[schema] if isinstance(schema, str) else schema
    return spark.read.schema(schema).option("sep", "|").option("quote", "").option("escape", "").csv(path)


def scan_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Comma-separated files with a header: voter files, name frequencies, lists of directors."""
    schema = TABLES[schema] if isinstance(schema, str) else schema
    return spark.read.schema(schema).option("header", True).csv(path)


def parsed_date(text: Column) -> Column:
    """MMDDYYYY to a date; null where that is none."""
    return F.try_to_date(text, "MMddyyyy")


def with_surrogate_id(df: DataFrame, order: list[str], buckets: str, id_col: str = "id") -> DataFrame:
    """Dense ids from 1 in the order of ``order``, whatever the partitioning.

    ``buckets`` is a column that comes first in that order; its groups are numbered apart and shifted by the counts of
    the groups before, so that no single task numbers all rows.
    """
    sizes = df.groupBy(buckets).agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.col(buckets).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(buckets).alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(buckets).orderBy(*order))
    numbered = df.withColumn("_inside", inside)
    joined = numbered.join(offsets, numbered[buckets].eqNullSafe(offsets["_b"]))
    return joined.withColumn(id_col, (F.col("_before") + F.col("_inside")).cast("long")).drop("_b", "_before", "_inside")


def retrieved(df: DataFrame, columns: list[str], where: str = "", order: str = "", limit: tuple[int, int] | None = None) -> DataFrame:
    """Projection with upper-cased strings, filter, order, and (offset, count)."""
    if where:
        df = df.where(F.expr(where))
    if order:
        df = df.orderBy(*[F.expr(c.strip()) for c in order.split(",")])
    if limit:
        df = df.offset(limit[0]).limit(limit[1])
    kinds = dict(df.dtypes)
    return df.select(*[F.upper(c).alias(c) if kinds[c] == "string" else F.col(c) for c in columns])


def by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in ``ids``; Spark picks a broadcast where the sizes allow it."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def with_identity(df: DataFrame, identities: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with their identity, '' where there is none."""
    joined = df.join(identities.select(id_col, "identity"), id_col, "left")
    return joined.select(F.coalesce("identity", F.lit("")).alias("identity"), *df.columns)


def export_psv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "|").option("header", True).csv(path)


def save_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def save_edges(df: DataFrame, path: str, kind: str = "json") -> None:
    """Edge lists, near misses and candidate pairs as JSON lines or CSV."""
    (df.write.mode("overwrite").json if kind == "json" else df.write.mode("overwrite").csv)(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables: nodes (node, ...) and edges (a, b, ...)."""
    save_table(nodes, f"{path}/nodes")
    save_table(edges, f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def ensure_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``, an empty one made there if there is none."""
    if not exists(spark, path):
        truncate_table(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


def truncate_table(spark: SparkSession, path: str, schema: StructType) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
