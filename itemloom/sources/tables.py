"""The supplied test tables as data sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.model import Field, FieldType
from itemloom.operators.attributes import DataSource
from itemloom.sources.narrow import to_instances

NOMINAL, NUMERIC = FieldType.NOMINAL, FieldType.NUMERIC

ORDER_FIELDS = (
    Field(1, "status", NOMINAL),
    Field(2, "priority", NOMINAL),
    Field(3, "segment", NOMINAL),
    Field(4, "totalprice", NUMERIC),
    Field(5, "acctbal", NUMERIC),
)
EVENT_FIELDS = (
    Field(1, "event_type", NOMINAL),
    Field(2, "value", NUMERIC),
    Field(3, "user_id", NUMERIC),
)
PART_FIELDS = (
    Field(1, "brand", NOMINAL),
    Field(2, "type", NOMINAL),
    Field(3, "size", NUMERIC),
    Field(4, "retailprice", NUMERIC),
)
DOC_FIELDS = (
    Field(1, "lang", NOMINAL),
    Field(2, "source", NOMINAL),
    Field(3, "n_chars", NUMERIC),
    Field(4, "quality", NUMERIC),
    Field(5, "toxic", NUMERIC),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_totalprice").alias("totalprice"),
        F.col("c_acctbal").alias("acctbal"),
    )


def events_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "event_type", "value", F.col("user_id").cast("double").alias("user_id")
    )


def part_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("retailprice"),
    )


def docs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), "lang", "source", "n_chars", "quality", "toxic"
    )


def data_source(wide: DataFrame, fields) -> DataSource:
    """Narrow form of a wide table whose id column is ``id``; frequencies are counted when asked for."""
    return DataSource(tuple(fields), to_instances(wide, "id", fields), None, wide)


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow rows of the parts in each order; fields 1 (type) and 2 (brand), several values each."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    cells = F.array(
        F.struct(F.lit(1).alias("field"), F.col("p_type").alias("value_nominal")),
        F.struct(F.lit(2).alias("field"), F.col("p_brand").alias("value_nominal")),
    )
    return joined.select(F.col("l_orderkey").alias("id"), F.inline(cells)).withColumn(
        "value_numeric", F.lit(None).cast("double")
    )


BASKET_FIELDS = (Field(1, "type", NOMINAL), Field(2, "brand", NOMINAL))
