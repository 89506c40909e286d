"""One batch of tasks through the whole pipeline, as pure transformations.

Every step that can fail for a paper has an outcome, and the outcomes decide the state: see ``outcome``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, config
from ..functions import documents as D
from ..functions.text import object_key, object_url, wall_time
from ..operators.graph import finding_graph, merge_graph, task_graph
from ..operators.tables import few, first_of_each, insert_absent, set_status, update_by_key
from ..schemas import EDGES, ENRICHED, EVENTS, FAILED, ID_CHARS, NEW_PAPER, NODES, PAPER, PAPER_ENRICHED, PAPERS, PROCESSING, empty
from ..sources.archives import extracted
from ..sources.fetch import Fetch
from ..sources.models import Ask, Embed, asked, embedded
from ..sources.objects import store_texts


@dataclass(frozen=True)
class State:
    """The tables that batches build up; events and quarantine are of the last batch only."""

    papers: DataFrame
    nodes: DataFrame
    edges: DataFrame
    events: DataFrame
    quarantine: DataFrame | None = None


def empty_state(spark: SparkSession) -> State:
    return State(empty(spark, PAPERS), empty(spark, NODES), empty(spark, EDGES), empty(spark, EVENTS))


def sound(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks that can be stored, and the rest with a reason (they would fail again at every delivery); ``unread`` holds a record that is no task."""
    bad_name = lambda items: F.coalesce(F.exists(items, lambda x: x.isNull()), F.lit(False))
    unread = F.col("unread") if "unread" in tasks.columns else F.lit(None)
    reason = (
        F.when(unread.isNotNull(), "no task")
        .when(F.col("id").isNull(), "no id")
        .when(F.length("id") > ID_CHARS, "id too long")
        .when(F.col("title").isNull(), "no title")
        .when(F.col("published").isNotNull() & wall_time(F.col("published")).isNull(), "published is no time")
        .when(bad_name("authors") | bad_name("categories"), "a name is null")
    )
    judged = tasks.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason", "unread"), judged.where("reason is not null")


def added(state: State, tasks: DataFrame, *order: str) -> State:
    """Store new papers and their graph, and announce every delivery."""
    good, bad = sound(tasks)
    rows = good.select("id", "title", wall_time(F.col("published")).alias("published_date"), "summary_raw", F.lit(None).cast("string").alias("tldr_ai"), F.lit(None).cast("string").alias("pdf_minio_url"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(PROCESSING).alias("status"), *order)
    papers = insert_absent(state.papers, rows, "id", *order)
    nodes, edges = merge_graph(state.nodes, state.edges, task_graph(good))
    events = good.select(F.lit(NEW_PAPER).alias("event"), "id", "title")
    return State(papers, nodes, edges, events, bad)


def outcome(tasks: DataFrame, texts: DataFrame, answers: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """For each id of a batch the outcome and what was found.

    FAILED: no source, a damaged archive, a model call that broke, an answer that is no JSON or no
    object, a vector of a wrong size. SKIPPED: no answer, or an empty one; the state stays. LATE_FAILED: stored, then a null name
    broke the graph; what was stored stays. ENRICHED else, with or without a vector.
    """
    text = texts.select("id", F.col("error").alias("text_error"), F.lit(True).alias("has_text"))
    answer = answers.select("id", "answer", F.col("error").alias("answer_error"))
    vector = vectors.select("id", "embedding", F.col("error").alias("vector_error"))
    rows = tasks.select("id", "source_url").join(text, "id", "left").join(answer, "id", "left").join(vector, "id", "left")
    doc = D.parsed(F.col("answer"))
    rows = rows.withColumn("doc", doc)
    found = rows.select(
        "*",
        D.text_field(F.col("doc"), "tldr", "").alias("tldr"),
        *(D.list_field(F.col("doc"), k).alias(k) for k in ("institutions", "tech_tools", "datasets")),
        F.try_variant_get("doc", "$.problem_solved", "string").alias("problem_solved"),
    )
    null_name = lambda k: F.coalesce(F.exists(k, lambda x: x.isNull()), F.lit(False))
    size = lambda k: F.coalesce(F.size(k), F.lit(0))
    # a null name breaks the graph only where the chain of lists reaches it
    broken = null_name("institutions") | ((size("institutions") > 0) & (null_name("tech_tools") | ((size("tech_tools") > 0) & null_name("datasets"))))
    return found.withColumn(
        "outcome",
        F.when(F.col("source_url").isNull() | F.col("has_text").isNull() | F.col("text_error").isNotNull(), FAILED)
        .when(F.col("answer_error").isNotNull(), FAILED)
        .when(F.col("answer").isNull(), "SKIPPED")
        .when(F.col("doc").isNull(), FAILED)
        .when(~D.is_truthy(F.col("doc")), "SKIPPED")
        .when(~D.is_object(F.col("doc")) | F.col("vector_error").isNotNull(), FAILED)
        .when(F.col("embedding").isNotNull() & (F.size("embedding") != dimension), FAILED)
        .when(broken, "LATE_FAILED")
        .otherwise(ENRICHED),
    )


def enriched(state: State, outcomes: DataFrame, endpoint: str = "localhost:9000", bucket: str = "papers") -> State:
    """Apply outcomes (one for each id): state, payload columns, findings and events."""
    stored = outcomes.where(F.col("outcome").isin(ENRICHED, "LATE_FAILED"))
    updates = stored.select("id", F.col("tldr").alias("tldr_ai"), object_url(endpoint, bucket, object_key(F.col("id"))).alias("pdf_minio_url"), "embedding", F.lit(ENRICHED).alias("status"))
    papers = update_by_key(state.papers, updates, "id", ["tldr_ai", "pdf_minio_url", "embedding", "status"])
    papers = set_status(papers, outcomes.where(F.col("outcome").isin(FAILED, "LATE_FAILED")), "id", FAILED)
    done = outcomes.where(F.col("outcome") == ENRICHED)
    nodes, edges = merge_graph(state.nodes, state.edges, finding_graph(done, state.nodes))
    events = state.events.unionByName(done.select(F.lit(PAPER_ENRICHED).alias("event"), "id", F.lit(None).cast("string").alias("title")))
    return replace(state, papers=papers, nodes=nodes, edges=edges, events=events)


def contents(requests: DataFrame, eprints: DataFrame | Fetch) -> DataFrame:
    """E-prints of requests (id, address): from a table (id, content) by id, or fetched, then with their errors."""
    return requests.select("id").join(eprints, "id") if isinstance(eprints, DataFrame) else eprints(requests)


def outcomes_once(tasks: DataFrame, eprints: DataFrame | Fetch, ask: Ask, embed: Embed, work: str, settings: Config, store: str | None = None, version: int = 0, order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """Outcomes of sound tasks, from tables below ``work``: each text is extracted and each model is called once.

    Papers, graph, events and objects all derive from these tables, so they never see different
    answers. ``store`` is where texts are put, as objects of this version.
    """
    spark = tasks.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    good = written(first_of_each(tasks, "id", *order).select("id", "source_url"), "tasks")
    asked_for = good.where("source_url is not null").select("id", F.col("source_url").alias("address"))
    texts = written(extracted(contents(asked_for, eprints)), "texts")
    usable = texts.where("error is null")
    if store is not None:
        store_texts(usable.select("id", "text"), store, version)
    answers = written(asked(usable, ask, settings.model_chars), "answers")
    # only what has an answer is embedded
    vectors = written(embedded(usable.join(answers.where("answer is not null").select("id"), "id", "left_semi"), embed, settings.embedding_chars), "vectors")
    found = outcome(good, texts, answers, vectors, settings.embedding_dimension)
    return written(found.drop("doc"), "outcomes")


def process(state: State, tasks: DataFrame, eprints: DataFrame | Fetch, ask: Ask, embed: Embed, work: str, settings: Config | None = None, store: str | None = None, version: int = 0, order: tuple[str, ...] = ("arrival",)) -> State:
    """A batch of tasks with its e-prints, stored or fetched, through all its states; see ``outcomes_once``."""
    settings = settings or config(tasks.sparkSession)
    after = added(state, tasks, *order)
    found = outcomes_once(sound(tasks)[0], eprints, ask, embed, work, settings, store, version, order)
    return enriched(after, found, settings.store_url, settings.store_bucket)


def touched(state: State, tasks: DataFrame) -> State:
    """What a batch can change of the state: its own papers, and all paper nodes with their ids."""
    ids = few(tasks.where("id is not null").select("id").distinct())
    papers = state.papers.join(ids, "id", "left_semi")
    nodes = state.nodes.where(F.col("label") == PAPER).join(ids, F.col("props")["id"] == ids["id"], "left_semi")
    return replace(state, papers=papers, nodes=nodes, edges=state.edges.where("false"))
