"""Extensions: routes that are announced but nowhere specified in detail. Their rules are our own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_tags(tags: DataFrame, paper: object) -> DataFrame:
    """Of ``tags`` (paper, tag): the other papers that share tags with one paper, and how many."""
    own = tags.where(F.col("paper") == F.lit(paper)).select("tag").distinct()
    return tags.where(F.col("paper") != F.lit(paper)).join(own, "tag").groupBy("paper").agg(F.count_distinct("tag").alias("shared"))


def neighbourhood(nodes: DataFrame, edges: DataFrame, paper: str, types: tuple[str, ...]) -> DataFrame:
    """Of one paper (an element id) what it is joined to by edges of these types, either way: label, element_id and type."""
    near = edges.where(F.col("type").isin(*types) & ((F.col("src") == paper) | (F.col("dst") == paper)))
    other = near.select(F.when(F.col("src") == paper, F.col("dst")).otherwise(F.col("src")).alias("element_id"), "type")
    return nodes.select("element_id", "label").join(other, "element_id").select("label", "element_id", "type").distinct()


def related_authors(wrote: DataFrame, tags: DataFrame, author: object, n: int = 20) -> DataFrame:
    """Of ``wrote`` (paper, author) and ``tags`` (paper, tag): the authors who share most tags with one author."""
    used = tags.join(wrote, "paper").select("author", "tag").distinct()
    own = used.where(F.col("author") == F.lit(author)).select("tag")
    return used.where(F.col("author") != F.lit(author)).join(own, "tag").groupBy("author").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "author").limit(n)


#: Rows of a part of the papers, whose pairs are counted together.
PART_ROWS = 200_000


def coauthors(wrote: DataFrame) -> DataFrame:
    """Of ``wrote`` (paper, author): pairs of authors and their common papers. A paper's authors are few.

    The number of tasks follows the rows, so what a task holds doesn't grow with them. A part's pairs are counted
    where its papers' authors meet, and only these counts are sent; a task gets one part on average, and rarely more than five.
    """
    parts = max(wrote.sparkSession.sparkContext.defaultParallelism, -(-wrote.count() // PART_ROWS))
    part = F.pmod(F.xxhash64("paper"), F.lit(parts)).alias("part")
    papers = wrote.where("paper is not null").select(part, "paper", "author").repartition(parts, "part").groupBy("part", "paper").agg(F.collect_set("author").alias("authors"))
    pairs = papers.select("part", "authors", F.explode("authors").alias("a")).select("part", "a", F.explode(F.filter("authors", lambda y: y > F.col("a"))).alias("b"))
    counted = pairs.groupBy("part", "a", "b").agg(F.count("*").alias("papers"))
    return counted.repartition(parts, "a", "b").groupBy("a", "b").agg(F.sum("papers").alias("papers"))


def top_tags(tags: DataFrame, n: int = 20) -> DataFrame:
    """The tags of most papers."""
    return tags.distinct().groupBy("tag").agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "tag").limit(n)


def search(rows: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text contains the query, whatever the case."""
    return rows.where(F.contains(F.lower(text), F.lower(F.lit(query))))


def top_similar(vectors: DataFrame, query: list[float] | None, k: int = 10) -> DataFrame:
    """The k vectors with the largest inner product with one query vector, ties to the smaller id.

    Without a query vector all scores are null.
    """
    if query is None:
        score = F.lit(None).cast("double")
    else:
        products = F.zip_with("embedding", F.array(*(F.lit(float(x)) for x in query)), lambda a, b: a.cast("double") * b)
        score = F.round(F.aggregate(products, F.lit(0.0), lambda a, x: a + x), 6)
    return vectors.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)
