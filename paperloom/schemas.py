"""Schemas, labels, states and vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


TASK = _struct(
    id=_S, title=_S, authors=T.ArrayType(_S), source_url=_S, published=_S, updated=_S, primary_category=_S, categories=T.ArrayType(_S), summary_raw=_S, summary_detail=T.MapType(_S, _S)
)
PAPERS = _struct(id=_S, title=_S, published_date=T.TimestampNTZType(), summary_raw=_S, tldr_ai=_S, pdf_minio_url=_S, embedding=T.ArrayType(T.FloatType()), status=_S)
NODES = _struct(element_id=_S, label=_S, props=T.MapType(_S, _S))
EDGES = _struct(src=_S, dst=_S, type=_S)
EVENTS = _struct(event=_S, id=_S, title=_S)
ENTRY = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("title", _S),
        T.StructField("author", T.ArrayType(_struct(name=_S))),
        T.StructField("link", T.ArrayType(_struct(_href=_S, _rel=_S))),
        T.StructField("published", _S),
        T.StructField("updated", _S),
        T.StructField("primary_category", _struct(_term=_S)),
        T.StructField("category", T.ArrayType(_struct(_term=_S))),
        T.StructField("summary", _S),
    ]
)

#: The longest id that the papers table takes.
ID_CHARS = 50

# states of a paper
NEW, PROCESSING, ENRICHED, FAILED = "NEW", "PROCESSING", "ENRICHED", "FAILED"

# what is announced
NEW_PAPER, PAPER_ENRICHED = "NEW_PAPER", "PAPER_ENRICHED"

# labels and edge types that ingestion writes
PAPER, AUTHOR, CATEGORY, INSTITUTION, TECH, DATASET = "Paper", "Author", "Category", "Institution", "TechTag", "Dataset"
WROTE, BELONGS_TO, AFFILIATED_WITH, USES_TECH, TESTED_ON = "WROTE", "BELONGS_TO", "AFFILIATED_WITH", "USES_TECH", "TESTED_ON"
# the names that readers of the graph expect
TOPIC, AUTHORED_BY, HAS_TOPIC, CITES = "Topic", "AUTHORED_BY", "HAS_TOPIC", "CITES"


@dataclass(frozen=True)
class Branch:
    """Edges of a kind, seen from a paper, and the labels of what they lead to."""

    types: tuple[str, ...]
    labels: tuple[str, ...] = ()
    outgoing: bool = True


#: What a paper's authors, topics and citations are called: by readers, and by what ingestion writes.
VOCABULARIES = {
    "reader": {"authors": Branch((AUTHORED_BY,), (AUTHOR,)), "topics": Branch((HAS_TOPIC,), (TOPIC,)), "citations": Branch((CITES,), (PAPER,))},
    "writer": {"authors": Branch((WROTE,), (AUTHOR,), outgoing=False), "topics": Branch((BELONGS_TO, USES_TECH), (CATEGORY, TECH)), "citations": Branch(())},
}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
