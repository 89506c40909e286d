"""The read API: each route as a query over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import config
from ..functions.text import first_label
from ..schemas import PAPER, VOCABULARIES, Branch


def papers_recent(papers: DataFrame, created: str, key: str, n: int | None = None) -> DataFrame:
    """The n newest (``list_size`` of the settings, if n is not given); those without a time come first."""
    n = config(papers.sparkSession).list_size if n is None else n
    return papers.orderBy(F.desc_nulls_first(created), key).limit(n)


def branch(edges: DataFrame, kind: Branch) -> DataFrame:
    """(paper, other) of a kind of edges."""
    chosen = edges.where(F.col("type").isin(*kind.types)) if kind.types else edges.where("false")
    return chosen.select(F.col("src").alias("paper"), F.col("dst").alias("other")) if kind.outgoing else chosen.select(F.col("dst").alias("paper"), F.col("src").alias("other"))


def paper_detail(nodes: DataFrame, edges: DataFrame, paper_id: str | None = None, vocabulary: str = "writer") -> DataFrame:
    """element_id, props, authors, topics and citations (lists of element_id and props) of one paper, or of all.

    Of several nodes with one id the least element_id answers; an unknown id gives no row. All lists
    come from one aggregation over the union of their edges, so they never multiply each other.
    """
    papers = nodes.where(F.col("label") == PAPER)
    kinds = VOCABULARIES[vocabulary]
    if paper_id is not None:
        papers = papers.where(F.col("props")["id"] == paper_id).orderBy("element_id").limit(1)
    wanted = None
    for name, kind in kinds.items():
        rows = branch(edges, kind).withColumn("list", F.lit(name))
        wanted = rows if wanted is None else wanted.unionByName(rows)
    if paper_id is not None:
        wanted = wanted.join(F.broadcast(papers.select(F.col("element_id").alias("paper"))), "paper", "left_semi")
    labels = [label for kind in kinds.values() for label in kind.labels]
    # maps can't be told apart, their sorted entries can
    other = nodes.where(F.col("label").isin(*labels) | F.col("label").isNull()).select(F.col("element_id").alias("other"), F.struct("element_id", F.array_sort(F.map_entries("props")).alias("props")).alias("value"))
    lists = wanted.join(other, "other").groupBy(F.col("paper").alias("element_id")).agg(*(F.array_sort(F.collect_set(F.when(F.col("list") == name, F.col("value")))).alias(name) for name in kinds))
    shown = lambda c: F.transform(F.coalesce(c, F.array()), lambda n: F.struct(n["element_id"].alias("element_id"), F.map_from_entries(n["props"]).alias("props")))
    return papers.select("element_id", "props").join(lists, "element_id", "left").select("element_id", "props", *(shown(F.col(name)).alias(name) for name in kinds))


def outgoing(papers: DataFrame, edges: DataFrame, both_ways: bool = False) -> DataFrame:
    """Papers (p) and what their edges lead to (m, type); a paper without edges is one row."""
    steps = edges.select(F.col("src").alias("p"), F.col("dst").alias("m"), "type")
    if both_ways:
        steps = steps.unionByName(edges.select(F.col("dst").alias("p"), F.col("src").alias("m"), "type"))
    return papers.join(steps, "p", "left").select("p", "m", "type")


def expand(nodes: DataFrame, edges: DataFrame, n: int | None = None, both_ways: bool = False) -> DataFrame:
    """The first n rows of ``outgoing`` in a total order (``graph_rows`` of the settings, if n is not given).

    Each paper gives a row at least, so n rows come from the first n papers: only these are expanded.
    """
    n = config(nodes.sparkSession).graph_rows if n is None else n
    first = nodes.where(F.col("label") == PAPER).select(F.col("element_id").alias("p")).orderBy("p").limit(n)
    ends = F.col("src") == F.col("p") if not both_ways else (F.col("src") == F.col("p")) | (F.col("dst") == F.col("p"))
    near = edges.join(F.broadcast(first), ends, "left_semi")
    return outgoing(first, near, both_ways).orderBy("p", F.asc_nulls_last("type"), F.asc_nulls_last("m")).limit(n)


def graph_view(nodes: DataFrame, edges: DataFrame, n: int | None = None, both_ways: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, element_id, label, props), each once, and edges (source, target, type) between element ids.

    ``id`` is the node's own id property where it has one; edges always name element ids.
    """
    rows = expand(nodes, edges, n, both_ways)
    shown = rows.select(F.col("p").alias("element_id")).unionByName(rows.where("m is not null").select(F.col("m").alias("element_id"))).distinct()
    view = nodes.join(shown, "element_id", "left_semi").select(F.coalesce(F.col("props")["id"], "element_id").alias("id"), "element_id", first_label(F.array("label")).alias("label"), "props").dropDuplicates(["element_id"])
    found = rows.where("m is not null and type is not null").select(F.col("p").alias("source"), F.col("m").alias("target"), "type")
    return view, found


def point_lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def status(spark: SparkSession, queue: DataFrame | None = None, state: str | None = None) -> DataFrame:
    """status (``idle`` if none is known) and queueLength."""
    length = queue.agg(F.count("*").alias("queueLength")) if queue is not None else spark.range(1).select(F.lit(0).cast("long").alias("queueLength"))
    return length.select(F.coalesce(F.lit(state).cast("string"), F.lit("idle")).alias("status"), "queueLength")


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows and status of each table: ``ok``, or ``empty`` if it has no row."""
    counted = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.when(F.col("rows") > 0, "ok").otherwise("empty").alias("status"))
        counted = one if counted is None else counted.unionByName(one)
    return counted


def is_limited(path: Column) -> Column:
    """Only the API is rate-limited."""
    return F.startswith(path, F.lit("/api"))
