"""The property graph: nodes and edges of papers, from tasks and from what models found.

A node's id is its label and key. Papers are keyed by id and title, all others by their exact name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import AFFILIATED_WITH, AUTHOR, BELONGS_TO, CATEGORY, DATASET, INSTITUTION, PAPER, TECH, TESTED_ON, USES_TECH, WROTE
from .tables import merge_rows


def node_id(label: str, *key: Column) -> Column:
    return F.concat_ws("\u001f", F.lit(label), *key)


def paper_node(paper_id: Column, title: Column) -> Column:
    return node_id(PAPER, paper_id, title)


def has_items(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def _named(rows: DataFrame, label: str) -> DataFrame:
    return rows.select(node_id(label, F.col("name")).alias("element_id"), F.lit(label).alias("label"), F.create_map(F.lit("name"), F.col("name")).alias("props"))


def _unwound(papers: DataFrame, items: str, gates: list[str], independent: bool) -> DataFrame:
    """One row for each item; an empty list before it in the chain leaves none, as chained unwinding does."""
    gated = papers
    for g in [] if independent else gates:
        gated = gated.where(has_items(F.col(g)))
    return gated.select("paper", F.explode(items).alias("name"))


def _edges(rows: DataFrame, label: str, edge: str, outgoing: bool = True) -> DataFrame:
    other = node_id(label, F.col("name"))
    src, dst = (F.col("paper"), other) if outgoing else (other, F.col("paper"))
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(edge).alias("type"))


def _chain(papers: DataFrame, steps: list[tuple[str, str, str, bool]], independent: bool) -> tuple[DataFrame, DataFrame]:
    nodes, edges, gates = [], [], []
    for items, label, edge, outgoing in steps:
        rows = _unwound(papers, items, list(gates), independent)
        nodes.append(_named(rows.select("name").distinct(), label))
        edges.append(_edges(rows, label, edge, outgoing))
        gates.append(items)
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(nodes), union(edges).dropDuplicates(["src", "dst", "type"])


def task_graph(tasks: DataFrame, independent: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of tasks (id, title, authors, categories): categories count only where there are authors."""
    papers = tasks.select(paper_node(F.col("id"), F.col("title")).alias("paper"), "id", "title", "authors", "categories")
    own = papers.select(F.col("paper").alias("element_id"), F.lit(PAPER).alias("label"), F.create_map(F.lit("id"), F.col("id"), F.lit("title"), F.col("title")).alias("props")).dropDuplicates(["element_id"])
    nodes, edges = _chain(papers, [("authors", AUTHOR, WROTE, False), ("categories", CATEGORY, BELONGS_TO, True)], independent)
    return own.unionByName(nodes), edges


def finding_graph(findings: DataFrame, nodes: DataFrame, independent: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of findings (id, institutions, tech_tools, datasets), on every paper node with the id."""
    papers = nodes.where(F.col("label") == PAPER).select(F.col("props")["id"].alias("id"), F.col("element_id").alias("paper"))
    rows = findings.join(papers, "id")
    return _chain(rows, [("institutions", INSTITUTION, AFFILIATED_WITH, True), ("tech_tools", TECH, USES_TECH, True), ("datasets", DATASET, TESTED_ON, True)], independent)


def merge_graph(nodes: DataFrame, edges: DataFrame, new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return merge_rows(nodes, new[0], ["element_id"]), merge_rows(edges, new[1], ["src", "dst", "type"])
