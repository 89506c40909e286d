"""The synthetic tables as papers, tags and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import node_id
from ..schemas import AUTHOR, AUTHORED_BY, BELONGS_TO, CATEGORY, CITES, HAS_TOPIC, PAPER, TECH, TOPIC, USES_TECH, WROTE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (paper, tag) of orders and parts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("tag")).distinct()


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as papers, customers as authors, priorities as categories, parts as techniques."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    part = table(spark, sf_dir, "part")
    paper = lambda c: node_id(PAPER, F.col(c).cast("string"))
    name = lambda c: F.create_map(F.lit("name"), F.col(c))
    author, tech = (lambda c: node_id(AUTHOR, F.col(c).cast("string"))), (lambda c: node_id(TECH, F.col(c).cast("string")))
    nodes = [
        orders.select(paper("o_orderkey").alias("element_id"), F.lit(PAPER).alias("label"), F.create_map(F.lit("id"), F.col("o_orderkey").cast("string")).alias("props")),
        customer.select(author("c_custkey").alias("element_id"), F.lit(AUTHOR).alias("label"), name("c_name").alias("props")),
        part.select(tech("p_partkey").alias("element_id"), F.lit(TECH).alias("label"), name("p_name").alias("props")),
        orders.select("o_orderpriority").distinct().select(node_id(CATEGORY, F.col("o_orderpriority")).alias("element_id"), F.lit(CATEGORY).alias("label"), name("o_orderpriority").alias("props")),
    ]
    edges = [
        orders.select(author("o_custkey").alias("src"), paper("o_orderkey").alias("dst"), F.lit(WROTE).alias("type")),
        orders.select(paper("o_orderkey").alias("src"), node_id(CATEGORY, F.col("o_orderpriority")).alias("dst"), F.lit(BELONGS_TO).alias("type")),
        tags(spark, sf_dir).select(paper("paper").alias("src"), tech("tag").alias("dst"), F.lit(USES_TECH).alias("type")),
    ]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(nodes), union(edges)


def reader_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The names that readers expect: orders as papers, customers as authors, suppliers as topics; an order cites those numbered as its parts."""
    orders, customer, supplier = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    lines = table(spark, sf_dir, "lineitem")
    of = lambda label, c: node_id(label, F.col(c).cast("string"))
    name = lambda c: F.create_map(F.lit("name"), F.col(c))
    nodes = orders.select(of(PAPER, "o_orderkey").alias("element_id"), F.lit(PAPER).alias("label"), F.create_map(F.lit("id"), F.col("o_orderkey").cast("string")).alias("props"))
    nodes = nodes.unionByName(customer.select(of(AUTHOR, "c_custkey").alias("element_id"), F.lit(AUTHOR).alias("label"), name("c_name").alias("props")))
    nodes = nodes.unionByName(supplier.select(of(TOPIC, "s_suppkey").alias("element_id"), F.lit(TOPIC).alias("label"), name("s_name").alias("props")))
    edges = orders.select(of(PAPER, "o_orderkey").alias("src"), of(AUTHOR, "o_custkey").alias("dst"), F.lit(AUTHORED_BY).alias("type"))
    edges = edges.unionByName(lines.select(of(PAPER, "l_orderkey").alias("src"), of(TOPIC, "l_suppkey").alias("dst"), F.lit(HAS_TOPIC).alias("type")))
    return nodes, edges.unionByName(lines.select(of(PAPER, "l_orderkey").alias("src"), of(PAPER, "l_partkey").alias("dst"), F.lit(CITES).alias("type")))
