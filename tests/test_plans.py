"""The library's own operators on small fixtures, and its queries against their SQL."""

import gzip
import io
import math
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from paperloom import config
from paperloom.functions import text as X
from paperloom.operators import checkpoint, graph, tables
from paperloom.plans import ingest, queries, serve
from paperloom.schemas import EDGES, NODES, TASK
from paperloom.sources import archives, feed, models, objects

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


# -- columns


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (X.last_segment, "http://a.example/abs/2403.01234v1", "2403.01234v1"),
        (X.source_url, "http://a.example/abs/2403.01234v1", "http://a.example/e-print/2403.01234v1"),
        (X.legacy_pdf_url, "http://a.example/abs/1", "http://a.example/pdf/1.pdf"),
        (X.one_line, "A\n  B", "A   B"),
        (X.object_key, "2403.01234v1", "2024/03/2403.01234v1.txt"),
        (X.object_key, "9912001v1", "2099/12/9912001v1.txt"),
        (X.without_comments, "%c\nx % y\n %z\n%", "\nx % y\n %z\n"),
        (X.without_comments, "a\r%b\n", "a\r%b\n"),
        (lambda c: X.or_no_text(X.without_comments(c)), "%only", X.NO_TEXT),
        (X.or_no_text, " \t\n\u001c", X.NO_TEXT),
        (lambda c: X.wall_time(c).cast("string"), "2024-03-20T15:30:00Z", "2024-03-20 15:30:00"),
        (lambda c: X.wall_time(c).cast("string"), "soon", None),
        (lambda c: F.length(X.prefix(c, 2000)), "😀" * 3000, 2000),
    ],
)
def test_columns(spark, f, given, want):
    assert one(spark, f(F.col("t")), t=given) == want


def test_settings(spark):
    assert config.config(spark) == config.Config()
    spark.conf.set("paperloom.port", "8080x")
    assert config.config(spark).port == 8080
    spark.conf.unset("paperloom.port")


def test_sizes_come_from_the_settings(spark):
    papers = spark.range(80).select("id", F.col("id").alias("created"))
    nodes = spark.createDataFrame([(f"p{k:03d}", "Paper", {"id": str(k)}) for k in range(250)], NODES)
    edges = spark.createDataFrame([], EDGES)
    assert serve.papers_recent(papers, "created", "id").count() == 50 and serve.expand(nodes, edges).count() == 200
    spark.conf.set("paperloom.list_size", "7")
    spark.conf.set("paperloom.graph_rows", "9")
    try:
        assert serve.papers_recent(papers, "created", "id").count() == 7 and serve.expand(nodes, edges).count() == 9
        assert serve.graph_view(nodes, edges)[0].count() == 9 and serve.papers_recent(papers, "created", "id", 3).count() == 3
    finally:
        spark.conf.unset("paperloom.list_size")
        spark.conf.unset("paperloom.graph_rows")
    assert config.Config(store_ssl=True).store_url == "https://localhost:9000" and config.Config().store_url == "http://localhost:9000"


# -- feeds


@pytest.mark.parametrize(
    ("at", "published", "limit", "want", "after"),
    [
        (None, ["T3", "T2", "T1"], 9, ["T1", "T2", "T3"], "T3"),
        ("T1", ["T3", "T2", "T1"], 9, ["T2", "T3"], "T3"),
        ("T2", ["T3", "T2", "T2"], 9, ["T3"], "T3"),
        ("T1", ["T2", "T2"], 9, ["T2", "T2"], "T2"),
        ("T3", ["T2"], 9, [], "T3"),
        (None, ["T2", "T3", "T1"], 9, ["T1", "T3", "T2"], "T2"),
        ("T0", ["T3", "T2", "T1"], 2, ["T2", "T3"], "T3"),
        ("T1", [], 9, [], "T1"),
    ],
)
def test_checkpoints(spark, at, published, limit, want, after):
    rows = spark.createDataFrame(list(enumerate(published)), "pos long, published string")
    page = checkpoint.newest(rows, limit) if limit < 9 else rows
    found = checkpoint.emitted(page, at)
    assert [r["published"] for r in found.orderBy(F.desc("pos")).collect()] == want
    assert checkpoint.advanced(found, at).first()["checkpoint"] == after


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<entry><id>http://a.example/abs/2403.01234v1</id><title>A
 B</title><author><name>X</name></author><author><name>Y</name></author><link href="http://a.example/abs/2403.01234v1" rel="alternate"/>
<published>2024-03-20T15:30:00Z</published><category term="cs.LG"/><category term="cs.AI"/><arxiv:primary_category term="cs.LG"/><summary>s</summary></entry>
<entry><id>http://a.example/abs/2</id><title>C</title><author><name>X</name></author><link href="http://a.example/abs/2" rel="alternate"/>
<published>2024-03-19T00:00:00Z</published><updated>2024-03-21T00:00:00Z</updated><summary>s</summary></entry></feed>"""


def test_feed_to_tasks(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(ATOM)
    entries = feed.read_feed(spark, f"file://{tmp_path}/feed.xml")
    first, second = feed.tasks(entries).orderBy("pos").collect()
    assert (first["id"], first["title"], first["authors"], first["categories"]) == ("2403.01234v1", "A  B", ["X", "Y"], ["cs.LG", "cs.AI"])
    assert first["source_url"] == "http://a.example/e-print/2403.01234v1" and first["primary_category"] == "cs.LG" and first["updated"] == first["published"]
    assert second["categories"] == [] and second["primary_category"] is None and second["updated"] == "2024-03-21T00:00:00Z"
    assert feed.legacy_tasks(entries).orderBy("pos").first()["pdf_url"] == "http://a.example/pdf/2403.01234v1.pdf"


# -- archives


def tar_of(*members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, raw in members:
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    return out.getvalue()


def test_archives(spark):
    good = tar_of(("a.tex", b"A"), ("b.txt", b"B"), ("c.tex", b"C"))
    cases = {
        "tex": (good, "A\nC\n"),
        "none": (tar_of(("a.txt", b"A")), X.NO_TEXT),
        "case": (tar_of(("x.TEX", b"A")), X.NO_TEXT),
        "gz": (gzip.compress(b"hello"), "hello"),
        "plain": (b"hi", "hi"),
        "bytes": (tar_of(("a.tex", b"a\xffb")), "ab\n"),
        "empty": (b"", X.NO_TEXT),
        "cut": (gzip.compress(b"hello" * 500)[:-12], None),
        "null": (None, None),
    }
    df = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, (c, _) in cases.items()], "id string, content binary")
    got = {r["id"]: r for r in archives.extracted(df).collect()}
    for k, (_, text) in cases.items():
        assert got[k]["text"] == text and (got[k]["error"] is None) == (text is not None), k


# -- lifecycle


def batch(spark, rows):
    return spark.createDataFrame([(i, t, a, url, "2024-03-20T15:30:00Z", None, None, c, "s", {}, n) for n, (i, t, a, c, url) in enumerate(rows)], TASK.add("arrival", "long") if "arrival" not in TASK.names else TASK)


ANSWERS = {
    "ok": '{"tldr": "t", "institutions": ["i"], "tech_tools": ["x"], "datasets": ["d"]}',
    "none": None,
    "object": "{}",
    "broken": "{",
    "list": "[1]",
    "no_tldr": '{"institutions": []}',
    "null_tldr": '{"tldr": null}',
    "no_vector": '{"tldr": "t"}',
    "wrong_size": '{"tldr": "t"}',
    "null_name": '{"tldr": "t", "institutions": ["i", null]}',
    "scalar": '{"tldr": "t", "institutions": "i"}',
    "gated": '{"tldr": "t", "institutions": ["i"], "tech_tools": [], "datasets": ["d"]}',
    "raises": "never given",
}
#: id: (status, tldr, has a vector)
STATES = {
    "ok": ("ENRICHED", "t", True),
    "none": ("PROCESSING", None, False),
    "object": ("PROCESSING", None, False),
    "broken": ("FAILED", None, False),
    "list": ("FAILED", None, False),
    "no_tldr": ("ENRICHED", "", True),
    "null_tldr": ("ENRICHED", None, True),
    "no_vector": ("ENRICHED", "t", False),
    "wrong_size": ("FAILED", None, False),
    "null_name": ("FAILED", "t", True),
    "scalar": ("ENRICHED", "t", True),
    "gated": ("ENRICHED", "t", True),
    "raises": ("FAILED", None, False),
    "no_url": ("FAILED", None, False),
}


def ask(prompts):
    if any(p.endswith("\nraises") for p in prompts):
        raise OSError("the service hung up")
    return [ANSWERS[p.rsplit("\n", 1)[-1]] for p in prompts]


def embed(texts):
    return [None if t == "no_vector" else [1.0] * (2 if t == "wrong_size" else 3) for t in texts]


def test_lifecycle(spark, tmp_path):
    rows = [(k, f"title {k}", ["A", "A", "B"], ["c"], "u") for k in ANSWERS] + [("no_url", "t", [], ["c"], None), ("x" * 51, "t", [], [], "u"), ("nt", None, [], [], "u")]
    tasks = batch(spark, rows)
    eprints = spark.createDataFrame([(k, bytearray(k.encode())) for k in ANSWERS], "id string, content binary")
    settings = config.Config(embedding_dimension=3)
    state = ingest.process(ingest.empty_state(spark), tasks, eprints, ask, embed, f"file://{tmp_path}/work", settings, f"file://{tmp_path}/store")
    assert objects.stored_texts(spark, f"file://{tmp_path}/store").count() == len(ANSWERS)
    papers = {r["id"]: (r["status"], r["tldr_ai"], r["embedding"] is not None) for r in state.papers.collect()}
    assert papers == STATES
    assert sorted(r["reason"] for r in state.quarantine.collect()) == ["id too long", "no title"]
    edges = {(r["src"].split("\x1f")[1], r["dst"].split("\x1f")[1], r["type"]) for r in state.edges.collect()}
    assert {e for e in edges if e[0] == "ok"} == {("ok", "c", "BELONGS_TO"), ("ok", "i", "AFFILIATED_WITH"), ("ok", "x", "USES_TECH"), ("ok", "d", "TESTED_ON")}
    assert {e[2] for e in edges if e[0] == "gated"} == {"BELONGS_TO", "AFFILIATED_WITH"} and not any(e[0] == "no_url" for e in edges)
    assert ("scalar", "i", "AFFILIATED_WITH") in edges and {e[0] for e in edges if e[1] == "ok"} == {"A", "B"}
    events = {(r["event"], r["id"]) for r in state.events.collect()}
    assert {i for e, i in events if e == "PAPER_ENRICHED"} == {k for k, (s, _, _) in STATES.items() if s == "ENRICHED"}
    again = ingest.added(state, tasks, "arrival")
    assert (again.papers.count(), again.nodes.count(), again.edges.count()) == (state.papers.count(), state.nodes.count(), state.edges.count())
    renamed = ingest.added(state, batch(spark, [("ok", "other title", [], [], "u")]), "arrival")
    assert renamed.papers.where("id = 'ok'").first()["title"] == "title ok"
    assert renamed.nodes.where("label = 'Paper'").count() == state.nodes.where("label = 'Paper'").count() + 1


# -- reading


def test_detail_and_view(spark):
    nodes = spark.createDataFrame([("p", "Paper", {"id": "1"}), ("q", "Paper", {"id": "2"}), ("a", "Author", {"name": "A"}), ("b", "Author", {"name": "B"}), *((f"t{k}", None, {}) for k in range(3))], NODES)
    edges = spark.createDataFrame([("a", "p", "WROTE"), ("b", "p", "WROTE"), *(("p", f"t{k}", "USES_TECH") for k in range(3))], EDGES)
    row = serve.paper_detail(nodes, edges, "1").first()
    assert (len(row["authors"]), len(row["topics"]), row["citations"]) == (2, 3, [])
    assert serve.paper_detail(nodes, edges, "3").count() == 0
    view, found = serve.graph_view(nodes, edges.where("type = 'USES_TECH'"))
    assert {(r["id"], r["label"]) for r in view.collect()} == {("1", "Paper"), ("2", "Paper"), ("t0", "Node"), ("t1", "Node"), ("t2", "Node")}
    assert {r["source"] for r in found.collect()} == {"p"}
    assert len(serve.paper_detail(nodes, edges.where("false")).collect()) == 2


def test_objects_and_catalogues(spark, tmp_path):
    texts = spark.createDataFrame([("2403.1", "é"), ("2404.2", "b")], "id string, text string")
    objects.store_texts(texts, f"file://{tmp_path}/store")
    assert {(r["key"], r["bytes"]) for r in spark.read.parquet(f"file://{tmp_path}/store").collect()} == {("2024/03/2403.1.txt", 2), ("2024/04/2404.2.txt", 1)}
    assert objects.listed(spark, f"file://{tmp_path}/store").where("name like '%.parquet'").count() == 2
    # a late paper and a new text of an old one: all others of the month stay
    objects.store_texts(spark.createDataFrame([("2403.9", "late"), ("2404.2", "new")], "id string, text string"), f"file://{tmp_path}/store", 1)
    assert {(r["key"], r["text"]) for r in objects.stored_texts(spark, f"file://{tmp_path}/store").collect()} == {("2024/03/2403.1.txt", "é"), ("2024/03/2403.9.txt", "late"), ("2024/04/2404.2.txt", "new")}
    available = models.catalogue(spark.createDataFrame([('{"models": [{"name": "nomic-embed-text:latest"}]}',)], "value string"))
    required = spark.createDataFrame([("gemma4:e2b",), ("nomic-embed-text",)], "name string")
    assert [r["name"] for r in tables.missing(required, available).collect()] == ["gemma4:e2b"]


# -- streams


LINE = '{{"id": "{0}", "title": "{1}", "authors": ["A"], "categories": ["c"], "source_url": "u", "published": "2024-03-20T15:30:00Z"}}\n'


def test_ingest_stream(spark, tmp_path):
    from paperloom.streaming import ingest as S

    inbox, root = tmp_path / "inbox", tmp_path / "state"
    inbox.mkdir()
    store = S.paper_tables(spark, f"file://{root}", buckets=8, keep=3)
    quarantined = []

    def run():
        S.ingest(S.task_stream(spark, f"file://{inbox}"), store, f"file://{tmp_path}/checkpoint", after=lambda now, _: quarantined.append([(r["reason"], r["unread"]) for r in now.quarantine.collect()]), events=f"file://{tmp_path}/events").awaitTermination()

    (inbox / "1.json").write_text(LINE.format("1", "one") + LINE.format("1", "late") + "not json\n")
    run()
    (inbox / "2.json").write_text(LINE.format("1", "again") + LINE.format("2", "two"))
    run()
    assert {(r["id"], r["title"]) for r in store.read("papers").collect()} == {("1", "one"), ("2", "two")}
    assert store.read("edges").where("type = 'WROTE'").count() == 4 and quarantined == [[("no task", "not json")], []]
    assert spark.read.json(f"file://{tmp_path}/events/topic=events").groupBy("event").count().first()["count"] == 4
    for k in (3, 4, 5):
        (inbox / f"{k}.json").write_text(LINE.format(str(k), "more"))
        run()
    assert store.read("papers").count() == 5 and store.read("papers", before=3).count() == 3
    # versions that nobody may ask for any more are gone, with what only they named
    assert store.versions() == [2, 3, 4] and store.read("papers", before=2).count() == 0
    assert store.read("nodes").where("label = 'Paper'").count() == 7


def test_a_batch_touches_its_own_buckets(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from paperloom.streaming.tables import Keyed, KeyedTables

    schema = StructType([StructField("id", LongType()), StructField("value", StringType())])
    store = KeyedTables(spark, f"file://{tmp_path}/t", {"t": Keyed(schema, ["id"])}, buckets=16)
    rows = lambda ids, value: spark.createDataFrame([(i, value) for i in ids], schema)
    store.write(0, {"t": rows(range(1000), "old")})
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    batch = rows([3, 5000], "new")
    buckets = store.touched("t", batch)
    stored = store.read("t", only=buckets)
    # what a batch reads: its buckets' files, and no stored row is shuffled
    assert 1 <= len(buckets) <= 2 and len(stored.inputFiles()) < len(before) / 4
    plan = store._next("t", stored, batch, False)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("hashpartitioning") == 1 and "SortMergeJoin" not in plan
    store.write(1, {"t": batch})
    assert before.items() <= files().items()
    assert {tuple(r) for r in store.read("t").collect()} == {(i, "new" if i in (3, 5000) else "old") for i in [*range(1000), 5000]}
    # a batch that is run again, and readers of the version before it
    store.write(1, {"t": batch})
    assert store.read("t").count() == 1001 and store.read("t", before=1).where("value = 'new'").count() == 0
    # many small batches into one bucket don't leave many files there
    for v in range(2, 14):
        store.write(v, {"t": rows([7000], str(v))})
    (at,) = store.touched("t", rows([7000], ""))
    assert store.read("t").where("id = 7000").first()["value"] == "13" and len(store.read("t", only={at}).inputFiles()) <= 6
    store.write(14, {"t": rows([], "")})
    assert store.read("t").count() == 1002


def opener(folder, opened):
    """Opens files of a folder by the last segment of an address, and notes each call."""

    def open_one(address, seconds):
        with open(opened, "a") as f:
            f.write(address + "\n")
        return open(f"{folder}/{address.rsplit('/', 1)[-1]}", "rb")

    return open_one


def test_fetch_by_address(spark, tmp_path):
    from paperloom.sources.fetch import Limits, fetched

    for k in range(40):
        (tmp_path / str(k)).write_bytes(bytes([k]) * 10 * k)
    rows = [(str(k), f"http://x/{k}") for k in range(0, 20)] + [("none", None), ("gone", "http://x/gone"), ("large", "http://x/39"), ("0", "http://x/0")]
    requests = spark.createDataFrame(rows, "id string, address string").repartition(3).selectExpr("*", "'x' as content", "1 as error")
    found = fetched(requests, opener(tmp_path, tmp_path / "opened"), Limits(attempts=2, wait=0.0, most_bytes=300, in_flight=3)).collect()
    assert len(found) == len(rows)
    got = {r["id"]: (r["content"], r["error"], r["attempts"]) for r in found}
    assert all(got[str(k)] == (bytes([k]) * 10 * k, None, 1) for k in range(20))
    assert got["none"] == (None, "no address", 0) and got["large"] == (None, "ValueError: more than 300 bytes", 1)
    assert got["gone"][0] is None and "FileNotFoundError" in got["gone"][1] and got["gone"][2] == 2
    # only what was asked for was opened, each once (what failed, twice)
    opened = (tmp_path / "opened").read_text().split()
    assert sorted(opened) == sorted([a for _, a in rows if a] + ["http://x/gone"])
    assert fetched(requests.where("false"), opener(tmp_path, tmp_path / "more")).count() == 0 and not (tmp_path / "more").exists()


def test_fetch_bounds_calls_and_time(tmp_path):
    import threading

    from paperloom.sources.fetch import Limits, fetch_one, open_address

    waits = []

    def broken(address, seconds):
        raise TimeoutError(f"after {seconds}")

    assert fetch_one("a", broken, Limits(attempts=3, wait=5.0, seconds=7.0), waits.append) == (None, "TimeoutError: after 7.0", 3) and waits == [5.0, 10.0]

    class Slow(io.BytesIO):
        def read(self, size=-1):
            threading.Event().wait(0.02)
            return super().read(1)

    assert fetch_one("a", lambda a, s: Slow(b"x" * 1000), Limits(attempts=1, seconds=0.05))[1].startswith("TimeoutError")
    (tmp_path / "f").write_bytes(b"here")
    assert open_address(f"{tmp_path}/f", 1.0).read() == b"here" == open_address(f"file://{tmp_path}/f", 1.0).read()


def test_archive_bombs(spark):
    import zlib

    pack = zlib.compressobj(9, zlib.DEFLATED, 31)
    bomb = b"".join(pack.compress(b"a" * (1 << 20)) for _ in range(64)) + pack.flush()
    inside = tar_of(("a.tex", b"A"), ("b.bin", b"b" * (8 << 20)), ("c.tex", b"C"))
    one_large = tar_of(("a.tex", b"b" * (8 << 20)))
    assert len(bomb) < 1 << 17
    for content in (bomb, inside, one_large):
        with pytest.raises(archives.TooLarge):
            archives.raw_text(content, 1 << 20)
    assert archives.raw_text(inside, 16 << 20) == "A\nC\n" and len(archives.raw_text(bomb)) == 64 << 20
    linked = io.BytesIO()
    with tarfile.open(fileobj=linked, mode="w:gz") as tar:
        info = tarfile.TarInfo("a.tex")
        info.size = 5000
        tar.addfile(info, io.BytesIO(b"x" * 5000))
        for k in range(30):
            link = tarfile.TarInfo(f"{k}.tex")
            link.type, link.linkname = tarfile.LNKTYPE, "a.tex"
            tar.addfile(link)
    assert archives.raw_text(linked.getvalue()) == ("x" * 5000 + "\n") * 31
    with pytest.raises(archives.TooLarge):
        archives.raw_text(linked.getvalue(), 50_000)
    # it fails its own paper only, and so does a fetch that failed
    rows = [("bomb", bytearray(bomb), None), ("good", bytearray(b"text"), None), ("lost", None, "TimeoutError: x")]
    got = {r["id"]: (r["text"], r["error"]) for r in archives.extracted(spark.createDataFrame(rows, "id string, content binary, error string"), most_bytes=1 << 20).collect()}
    assert got["good"] == ("text", None) and got["lost"] == (None, "TimeoutError: x") and got["bomb"][1].startswith("TooLarge")


def test_enrichment_stream_opens_and_asks_once(spark, tmp_path):
    from paperloom.streaming import ingest as S

    inbox, prints, calls = tmp_path / "inbox", tmp_path / "prints", str(tmp_path / "calls")
    for folder in (inbox, prints):
        folder.mkdir()
    store = S.paper_tables(spark, f"file://{tmp_path}/state", buckets=8)

    def counted(prompts):
        with open(calls, "a") as f:
            f.writelines(p.rsplit("\n", 1)[-1] + "\n" for p in prompts)
        return ['{"tldr": "short", "institutions": ["i"]}'] * len(prompts)

    (prints / "7").write_bytes(gzip.compress(b"seven"))
    (prints / "8").write_bytes(b"eight")
    for k in range(50):
        (prints / f"other{k}").write_bytes(b"of no task")
    line = lambda i, t: LINE.format(i, t).replace('"u"', f'"http://a.example/e-print/{i}"')
    (inbox / "1.json").write_text(line("7", "t") + line("9", "without a print") + line("7", "again"))
    (inbox / "2.json").write_text(line("8", "t"))
    enrich = S.Enrichment(counted, lambda texts: [[1.0, 2.0]] * len(texts), f"file://{tmp_path}/work", f"file://{tmp_path}/store", opener(prints, tmp_path / "opened"))
    settings = config.Config(embedding_dimension=2, fetch_attempts=1)
    S.ingest(S.task_stream(spark, f"file://{inbox}"), store, f"file://{tmp_path}/checkpoint", enrich=enrich, settings=settings).awaitTermination()
    assert {r["id"]: (r["status"], r["tldr_ai"]) for r in store.read("papers").collect()} == {"7": ("ENRICHED", "short"), "8": ("ENRICHED", "short"), "9": ("FAILED", None)}
    assert sorted(open(calls).read().split()) == ["eight", "seven"]
    assert sorted(a.rsplit("/", 1)[-1] for a in (tmp_path / "opened").read_text().split()) == ["7", "8", "9"]
    assert {r["text"] for r in objects.stored_texts(spark, f"file://{tmp_path}/store").collect()} == {"seven", "eight"}
    # id 7 came with two titles, so it has two nodes
    assert store.read("edges").where("type = 'AFFILIATED_WITH'").count() == 3


def page_of(*entries):
    """A feed page of entries (id, published)."""
    body = "".join(f'<entry><id>http://a.example/abs/{i}</id><title>T</title><author><name>X</name></author><link href="http://a.example/abs/{i}"/><published>{at}</published><category term="cs.LG"/></entry>' for i, at in entries)
    return f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">{body}</feed>'


def read_topic(spark, queue, topic):
    from pathlib import Path

    return sorted(line for p in Path(queue).glob(f"topic={topic}/batch=*/*.json") for line in p.read_text().splitlines())


def test_polls_of_two_feeds(spark, tmp_path):
    import json

    from paperloom.streaming import polls

    queue, served = str(tmp_path / "queue"), tmp_path / "served"
    served.mkdir()

    def fetcher(name):
        def fetch(start, folder=str(served)):
            with open(f"{folder}/{name}") as f:
                return f.read()

        return fetch

    def run():
        pages = None
        for name in ("a", "b"):
            one = feed.feed_pages(spark, feed.Feed(name, fetcher(name), f"file://{tmp_path}/log-{name}", attempts=1))
            pages = one if pages is None else pages.unionByName(one)
        polls.poll_stream(pages, queue, f"file://{tmp_path}/checkpoint", once=True).awaitTermination()
        return [json.loads(x)["id"] for x in read_topic(spark, queue, "tasks")], [json.loads(x) for x in read_topic(spark, queue, "errors")]

    (served / "a").write_text(page_of(("a2", "T2"), ("a1", "T1")))
    (served / "b").write_text(page_of(("b9", "T9")))
    assert run() == (["a1", "a2", "b9"], [])
    # a new start: nothing comes twice, and each feed has its own checkpoint
    (served / "a").write_text(page_of(("a4", "T4"), ("a3", "T3"), ("a2", "T2")))
    (served / "b").write_text(page_of(("b9", "T9"), ("b5", "T5")))
    assert run() == (["a1", "a2", "a3", "a4", "b9"], [])
    # a page that breaks off, and a service that doesn't answer: told, and nothing is lost
    whole = page_of(("a6", "T6"), ("a5", "T5"))
    (served / "a").write_text(whole[: whole.index("a5")])
    (served / "b").unlink()
    ids, errors = run()
    assert ids == ["a1", "a2", "a3", "a4", "b9"]
    assert {e["feed"]: e["error"].split(":")[0] for e in errors} == {"a": "the page is broken", "b": "FileNotFoundError"}
    (served / "a").write_text(whole)
    (served / "b").write_text("<html><body>busy</body></html>")
    ids, errors = run()
    assert ids == ["a1", "a2", "a3", "a4", "a5", "a6", "b9"] and "the page is no feed" in {e["error"] for e in errors}


def test_checkpoints_of_streams_and_batches_agree(spark, tmp_path):
    """The cases of the batch operators, one poll each, through the stream."""
    import json

    from paperloom.streaming import polls

    cases = [(["T3", "T2", "T1"], ["T1", "T2", "T3"]), (["T4", "T3", "T3"], ["T4"]), (["T5", "T5"], ["T5", "T5"]), (["T2"], []), (["T6", "T8", "T7"], ["T7", "T8", "T6"]), (["T9", "T8", "T7"], ["T7", "T8", "T9"]), ([], [])]
    at, log, queue, settings = None, str(tmp_path / "log"), str(tmp_path / "queue"), config.Config(categories="")
    pages = [page_of(*((f"e{n}-{k}", p) for k, p in enumerate(published))) for n, (published, _) in enumerate(cases)]
    path = tmp_path / "page"

    def fetch(start, path=str(path)):
        with open(path) as f:
            return f.read()

    for n, (published, want) in enumerate(cases):
        path.write_text(pages[n])
        rows = spark.createDataFrame(list(enumerate(published)), "pos long, published string")
        fresh = checkpoint.emitted(rows, at)
        assert [r["published"] for r in checkpoint.oldest_first(fresh).collect()] == want
        at = checkpoint.advanced(fresh, at).first()["checkpoint"]
        polls.poll_stream(feed.feed_pages(spark, feed.Feed("c", fetch, log)), queue, f"file://{tmp_path}/checkpoint", True, settings).awaitTermination()
        lines = (tmp_path / "queue" / "topic=tasks" / f"batch={n}").glob("*")
        assert [json.loads(x)["published"] for p in lines for x in p.read_text().splitlines()] == want, n


def test_a_poll_that_is_run_again_sees_the_same_pages(spark, tmp_path):
    import json
    import shutil

    from paperloom.streaming import polls

    served, calls, checkpoint_path = tmp_path / "served", tmp_path / "calls", tmp_path / "checkpoint"
    served.write_text(page_of(("1", "T1")))
    calls.touch()

    def fetch(start, served=str(served), calls=str(calls)):
        with open(calls, "a") as f:
            f.write(f"{start}\n")
        with open(served) as f:
            return f.read()

    def run(queue):
        pages = feed.feed_pages(spark, feed.Feed("r", fetch, str(tmp_path / "log"), pages=2, size=1))
        polls.poll_stream(pages, queue, f"file://{checkpoint_path}", once=True).awaitTermination()

    run(str(tmp_path / "queue"))
    # the batch is fetched and then killed before it is noted as done: its place among the done ones goes, and its results
    for f in (checkpoint_path / "commits").glob("*"):
        f.unlink()
    shutil.rmtree(tmp_path / "queue")
    served.write_text(page_of())
    assert sorted(calls.read_text().split()) == ["0", "1"]
    run(str(tmp_path / "queue"))
    assert [json.loads(x)["id"] for x in read_topic(spark, tmp_path / "queue", "tasks")][:1] == ["1"]
    # it was not asked for again
    assert sorted(calls.read_text().split()) == ["0", "1"]


def test_lines_appear_whole_and_once(spark, tmp_path):
    from paperloom.streaming.sink import publish, registered

    source, out = tmp_path / "source", tmp_path / "out"
    source.mkdir()
    (source / "1.json").write_text('{"topic": "t", "value": "one"}\n{"topic": "u", "value": "two"}\n')
    stream = spark.readStream.schema("topic string, value string").json(f"file://{source}")

    def run(df):
        writer = df.writeStream.format(registered(spark)).option("path", str(out)).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True)
        writer.start().awaitTermination()

    run(stream)
    assert read_topic(spark, out, "t") == ["one"] and read_topic(spark, out, "u") == ["two"]
    # the same batch again: each line once
    for f in (tmp_path / "checkpoint" / "commits").glob("*"):
        f.unlink()
    run(stream)
    assert read_topic(spark, out, "t") == ["one"]
    # a task that fails leaves nothing, though others had written
    (source / "2.json").write_text('{"topic": "t", "value": "three"}\n' * 3)
    (source / "3.json").write_text('{"topic": "t", "value": "four"}\n')
    failing = stream.withColumn("value", F.when(F.col("value") == "four", F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        run(failing)
    assert read_topic(spark, out, "t") == ["one"]
    run(stream)
    assert read_topic(spark, out, "t") == ["four", "one", "three", "three", "three"]
    # batches by name
    lines = spark.createDataFrame([("e", str(k)) for k in range(9)], "topic string, value string").repartition(3)
    for _ in range(2):
        publish(lines, f"file://{out}", "b1")
    publish(lines.where("false"), f"file://{out}", "b2")
    assert read_topic(spark, out, "e") == [str(k) for k in range(9)]


def test_fetches_are_tried_again(spark, tmp_path):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    waits, tries = [], []

    def fetch(start):
        tries.append(start)
        if len(tries) < 3:
            raise TimeoutError
        return "page"

    assert feed.tried(fetch, 4, sleep=waits.append) == ("page", None) and waits == [5.0, 10.0] and tries == [4, 4, 4]
    assert feed.tried(lambda start: 1 / 0, 4, sleep=lambda s: None) == (None, "ZeroDivisionError: division by zero")

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200)
            self.end_headers()
            self.wfile.write(self.path.encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.conf.set("paperloom.feed_page", "7")
        one = feed.configured_feed(spark, "x", str(tmp_path / "log"), f"http://127.0.0.1:{server.server_port}/query")
        assert one.fetch(14) == "/query?search_query=cat:cs.LG+OR+cat:cs.AI&sortBy=submittedDate&sortOrder=descending&start=14&max_results=7"
        assert (one.size, one.attempts, one.wait) == (7, 3, 5)
    finally:
        spark.conf.unset("paperloom.feed_page")
        server.shutdown()


def test_a_stream_that_fails_is_started_again(spark, tmp_path):
    from paperloom.streaming.supervise import supervise

    source = tmp_path / "source"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text(f'{{"k": {k}}}\n')
    seen, waits, left = [], [], [2]

    def step(batch, batch_id):
        if batch_id == 1 and left[0]:
            left[0] -= 1
            raise OSError("the service hung up")
        seen.append(sorted(r["k"] for r in batch.collect()))

    def start():
        rows = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).json(f"file://{source}")
        return rows.writeStream.foreachBatch(step).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()

    failures = supervise(spark, start, wait=1.0, sleep=waits.append)
    # the first run had finished a batch before it failed; the second failed at once, so the wait grew
    assert len(failures) == 2 and all("hung up" in f for f in failures) and waits == [1.0, 2.0]
    assert sorted(k for b in seen for k in b) == [0, 1, 2]
    with pytest.raises(RuntimeError, match="3 times in a row"):
        supervise(spark, lambda: 1 / 0, wait=1.0, most_wait=1.5, restarts=2, sleep=waits.append)
    assert waits[2:] == [1.0, 1.5]


def test_the_gate_waits_for_models(spark):
    import json

    from paperloom.streaming.supervise import wait_for_models

    told = iter([OSError("down"), "no json", {"models": []}, {"models": [{"name": "gemma:2b"}]}, {"models": [{"name": "gemma:2b"}, {"name": "embed:latest"}]}])

    def answer():
        said = next(told)
        if isinstance(said, Exception):
            raise said
        return said if isinstance(said, str) else json.dumps(said)

    waits = []
    assert wait_for_models(spark, ["gemma", "embed"], answer, 7.0, sleep=waits.append) == 5 and waits == [7.0] * 4
    with pytest.raises(TimeoutError, match="embed"):
        wait_for_models(spark, ["gemma", "embed"], lambda: '{"models": [{"name": "gemma"}]}', polls=2, sleep=waits.append)


def test_status_of_running_streams(spark, tmp_path):
    from paperloom.streaming import ingest, polls
    from paperloom.streaming.supervise import StatusBoard

    served, queue = tmp_path / "served", str(tmp_path / "queue")
    served.write_text(page_of(("1", "2024-01-01T00:00:00Z"), ("2", "2024-01-02T00:00:00Z"), ("3", "2024-01-03T00:00:00Z")))

    def fetch(start, served=str(served)):
        with open(served) as f:
            return f.read()

    board = StatusBoard()
    spark.streams.addListener(board)
    try:
        settings = config.Config(poll_seconds=1)
        running = polls.poll_stream(feed.feed_pages(spark, feed.Feed("s", fetch, str(tmp_path / "log"))), queue, f"file://{tmp_path}/c1", settings=settings, name="poll")
        assert board.wait_for(lambda states, waiting: waiting == 3 and states["poll"] in ("running", "idle"), 90)
        row = board.status(spark).first()
        assert row["status"] in ("running", "idle") and row["queueLength"] == 3
        store = ingest.paper_tables(spark, f"file://{tmp_path}/state", buckets=4)
        taken = ingest.ingest(ingest.task_stream(spark, f"{queue}/topic=tasks"), store, f"file://{tmp_path}/c2", once=False, name="take")
        assert board.wait_for(lambda states, waiting: waiting == 0 and states.get("take") in ("running", "idle"), 90)
        assert {r["name"] for r in board.table(spark).collect()} == {"poll", "take"} and running.isActive and taken.isActive
        for q in (running, taken):
            q.stop()
        assert board.wait_for(lambda states, waiting: set(states.values()) == {"stopped"}, 60)
        assert tuple(board.status(spark).first()) == ("idle", 0) and store.read("papers").count() == 3
        broken = spark.readStream.format("rate").load().select(F.raise_error(F.lit("no")))
        broken.writeStream.format("noop").queryName("bad").option("checkpointLocation", f"file://{tmp_path}/c3").start()
        assert board.wait_for(lambda states, waiting: states.get("bad") == "failed", 60)
        assert board.status(spark).first()["status"] == "failed"
    finally:
        spark.streams.removeListener(board)
        for q in spark.streams.active:
            q.stop()


def plain_decisions(rows, span, limit):
    """rows (client, at in seconds, key): one after the other."""
    state, out = {}, []
    for client, at, key in sorted(rows):
        begin, n = state.get(client, (None, 0))
        begin, n = (at, 1) if begin is None or at >= begin + span else (begin, n + 1)
        state[client] = (begin, n)
        out.append((client, key, begin, n, n <= limit))
    return sorted(out)


def invented_requests(n=900):
    import random

    rng = random.Random(5)
    # one client has a third of all requests; others are rare, or come exactly at a window's end
    rows = [(rng.choice(["hot", "b", f"c{k % 40}"]), rng.choice([rng.randrange(-4000, 9000), 60 * rng.randrange(100)]), f"k{k:04d}") for k in range(n)]
    return rows + [("edge", 60 * k, f"e{k}") for k in range(9)]


def test_rate_decisions(spark, monkeypatch):
    from paperloom.operators import limits

    rows = invented_requests()
    df = spark.createDataFrame(rows, "who string, sec long, key string").withColumn("at", F.timestamp_seconds("sec")).withColumn("slot", F.lit("clash"))
    odd = spark.createDataFrame([(None, 1, "x"), ("b", None, "y")], "who string, sec long, key string").withColumn("at", F.timestamp_seconds("sec")).withColumn("slot", F.lit(None).cast("string"))
    for slot, span in ((16, 60), (2, 60), (1, 7)):
        monkeypatch.setattr(limits, "SLOT_WINDOWS", slot)
        got = limits.rate_decisions(df.unionByName(odd).repartition(4), "who", "at", "key", span, 3)
        found = sorted((r["who"], r["key"], int(r["w"]), r["nth"], r["allowed"]) for r in got.withColumn("w", F.unix_seconds("window_start")).collect())
        assert found == plain_decisions(rows, span, 3)
        assert set(got.columns) == {*df.columns, "window_start", "nth", "allowed"}
    assert limits.rate_decisions(df.where("false"), "who", "at", "key", 60, 3).count() == 0


def test_ways_through_a_slot():
    import random

    from paperloom.operators.limits import NEVER, ways_through

    rng = random.Random(2)
    for _ in range(300):
        times, span = sorted({rng.randrange(0, 60) for _ in range(rng.randint(1, 12))}), rng.randint(1, 15)
        upto, ends = ways_through(times, span, span)
        for end in [NEVER, *range(span + 1)]:
            at = end
            for t in times:
                at = t + span if t >= at else at
            k = next((k for k, u in enumerate(upto) if end <= u), None)
            assert (end if k is None else ends[k]) == at, (times, span, end)
        assert len(ends) <= sum(t <= span for t in times) + 1


def test_request_streams_decide_as_batches_do(spark, tmp_path):
    from paperloom.streaming import requests as S

    rows = sorted(((c, t + 10**6, k) for c, t, k in invented_requests(300)), key=lambda r: r[1])
    (tmp_path / "in").mkdir()
    schema = "client string, path string, sec long, key string"
    for n in range(4):  # in the order of time, a file each
        part = [(c, "/api/papers", t, k) for c, t, k in rows[n * len(rows) // 4 : (n + 1) * len(rows) // 4]] + [("hot", "/health", 5, f"free{n}"), (None, "/api/x", 5, "nobody")]
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"file://{tmp_path}/in/{n}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"file://{tmp_path}/in").withColumn("at", F.timestamp_seconds("sec"))
    decided = S.limited_requests(stream, config.Config(rate_limit=3, rate_seconds=60), late="3 hours")
    decided.writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["client"], r["key"], int(r["w"]), r["nth"], r["allowed"]) for r in spark.table("decided").withColumn("w", F.unix_seconds("window_start")).collect())
    assert got == plain_decisions(rows, 60, 3)


def test_contained_names(spark):
    import random

    rng = random.Random(7)
    word = lambda n, letters="abcd": "".join(rng.choices(letters, k=n))
    have = [*(word(rng.randint(0, 30)) for _ in range(300)), None, "x%_y", "aé😀b", ""]
    required = [*(word(rng.randint(0, 7)) for _ in range(400)), None, "%_", "é😀", "zz", "zzzz", "x%_y", "b", "", "ab", "ab"]
    frames = [spark.createDataFrame([(x,) for x in rows], "name string") for rows in (required, have)]
    order = lambda x: (x is not None, x or "")
    want = sorted((x for x in required if x is None or not any(h is not None and x in h for h in have)), key=order)
    assert sorted((r["name"] for r in tables.missing(*frames).collect()), key=order) == want
    none = frames[1].where("false")
    assert tables.missing(frames[0], none).count() == len(required) and tables.contained(none, frames[1]).count() == 0
    assert tables.contained(spark.createDataFrame([("",)], "name string"), frames[1]).count() == 1
    # many names: no comparison of each with each
    many = spark.range(100_000).select(F.concat(F.lit("name"), F.col("id").cast("string")).alias("name"))
    plan = tables.missing(many, many.where("name < 'name5'"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_contained_names_send_no_texts(spark):
    # a text has a row for each of its pieces nowhere, and no shuffle or broadcast carries texts
    texts = spark.range(300).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(2000)), lambda k: F.concat(F.col("id"), F.lit("x"), k))).alias("name"))
    names = spark.range(0, 3000, 10).select(F.concat(F.lit(" "), F.col("id") % 300, F.lit("x"), F.col("id"), F.lit(" ")).alias("name"))
    found = tables.contained(names, texts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "_have" not in plan
    assert sorted(r["name"] for r in found.collect()) == sorted(f" {k % 300}x{k} " for k in range(10, 2000, 10))
    # long names, names that differ late, names that go over the end of a text
    long = "".join(map(chr, range(0x3B1, 0x3B1 + 20))) * 40
    have = spark.createDataFrame([(long,), ("tail of on",), ("e text",), (None,), ("12345678",)], "name string")
    asked = [long, long[:-1] + "x", long[3:700], long[::-1], long[5:9], "tail of one", "of one text", "one", "12345678", "2345678", "123456789", "one text", "", None]
    assert sorted(r["name"] for r in tables.contained(spark.createDataFrame([(x,) for x in asked], "name string"), have).collect()) == sorted([long, long[3:700], long[5:9], "12345678", "2345678", ""])


def test_sieve_keeps_every_name(monkeypatch):
    import random

    import pyarrow as pa

    from paperloom.operators import within

    rng = random.Random(11)
    for chunk in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(within, "CHUNK", chunk)
        texts = ["".join(rng.choices("ab", k=rng.choice([0, 1, 9, 200]))).encode() for _ in range(12)]
        names = {t[k : k + n] for t in texts for k, n in [(rng.randrange(len(t) + 1), rng.randint(1, 90)) for _ in range(9)]} | {b"a" * n for n in range(1, 12)}
        names = sorted(names - {b""})
        batch = pa.RecordBatch.from_arrays([pa.array(names, pa.binary())], names=["name"])
        bits = {b for out in within._name_bits(16)([batch.slice(3), batch.slice(0, 3)]) for b in out.column(0).to_pylist()}
        table = bytearray(1 << 13)
        for b in bits:
            table[b >> 3] |= 1 << (b & 7)
        texts = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
        found = {x for out in within._look_up(sorted({len(n) for n in names}), bytes(table), 16)([texts.slice(0, 5), texts.slice(5)]) for x in out.column(0).to_pylist()}
        assert found & set(names) == {n for n in names if any(n in t for t in texts.column(0).to_pylist())}
        assert all(any(x in t for t in texts.column(0).to_pylist()) for x in found) and len(found - set(names)) < 0.1 * len(names) + 5


def test_coauthors_in_parts(spark, monkeypatch):
    import random
    from collections import Counter
    from itertools import combinations

    from paperloom.plans import extensions

    rng = random.Random(8)
    rows = [(p, rng.choice([1, 2, rng.randrange(40), None])) for p in range(600) for _ in range(rng.randint(1, 6))] + [(None, 1), (None, 2), (7, 1), (7, 1), (7, 2)] + [(999, a) for a in range(60)]
    wrote = {}
    for p, a in rows:
        if p is not None and a is not None:
            wrote.setdefault(p, set()).add(a)
    want = Counter(pair for authors in wrote.values() for pair in combinations(sorted(authors), 2))
    df = spark.createDataFrame(rows, "paper long, author long")
    for part_rows in (50, 200_000):
        monkeypatch.setattr(extensions, "PART_ROWS", part_rows)
        found = extensions.coauthors(df)
        assert found.columns == ["a", "b", "papers"] and {(r["a"], r["b"]): r["papers"] for r in found.collect()} == want
        # as many tasks as the rows ask for, in both steps
        assert found.rdd.getNumPartitions() == max(4, -(-len(rows) // part_rows))
    assert extensions.coauthors(df.where("false")).count() == 0


def test_most_similar(spark):
    import numpy as np

    from paperloom.operators.similar import most_similar

    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 6)) * np.exp(rng.normal(size=(900, 1)) * 1.5)
    v[100:130] = v[5]  # ties
    v[7] = 0
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    broken = [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + broken, "vec_id long, embedding array<double>").repartition(3).withColumn("score", F.lit("clash"))
    asked = df.where("vec_id % 30 = 7 or vec_id >= 2000")
    found = most_similar(asked, df, 10, block_rows=32)
    want = []
    for q in range(7, 900, 30):
        s = np.round(v @ v[q], 6) + 0.0
        want += [(q, n + 1, int(i), float(s[i])) for n, i in enumerate(np.lexsort((np.arange(900), -s))[:10])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.rows.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))
    # long vectors rule out most of the short ones
    assert found.pairs < 0.5 * 30 * 900
    few = most_similar(df.where("vec_id = 7"), df.where("vec_id < 3"), 10)
    assert [r["vec_id"] for r in few.rows.orderBy("rank").collect()] == [0, 1, 2] and few.pairs == 3
    assert most_similar(df.where("false"), df).rows.count() == 0 == most_similar(asked, df.where("false")).rows.count()
    with pytest.raises(Exception, match="different dimensions"):
        most_similar(df.where("vec_id = 7"), df.unionByName(spark.createDataFrame([(1, [1.0], "x")], df.schema)))


def test_search_index(spark, tmp_path):
    import random

    from paperloom.plans import searching

    rng = random.Random(3)
    said = ["".join(rng.choices("abcABé %_", k=rng.randint(0, 40))) for _ in range(300)] + ["Graph Neural Networks", "graph theory", "ÜBER Graphen", ""]
    papers = spark.createDataFrame([(str(k), t) for k, t in enumerate(said)] + [("none", None)], "id string, title string")
    nodes = spark.createDataFrame([("p", "Paper", {"id": "1", "title": "On GRAPHS"}), ("a", "Author", {"name": "Anna Graph"}), ("n", None, {}), ("t", "TechTag", {"name": "abc"})], NODES)
    texts = searching.title_texts(papers).unionByName(searching.node_texts(nodes))
    index = searching.TextIndex(spark, f"file://{tmp_path}/index", folders=16).build(texts)
    rows = [(r["kind"], r["id"], r["text"]) for r in texts.where("text is not null").collect()]
    for query in ("graph", "GRAPH", "über", "abca", "a%b", "_", "ab", "", "é a", "nowhere at all", "aaa"):
        want = sorted(r for r in rows if query.lower() in r[2].lower())
        assert sorted(tuple(r) for r in index.search(query).collect()) == want, query
    assert {r[0] for r in index.search("graph").collect()} == {"title", "node"}
    # a query's lists come from their own folders, and its trigrams are looked for in the files
    lists = index._lists(["gra", "rap"])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and ("PartitionFilters: [folder" in plan or "PartitionFilters: [isnotnull(folder" in plan)
    assert index.candidates("ab") is None and index.candidates("zzz").count() == 0


def test_search_index_keeps_lists(spark, tmp_path):
    from paperloom.plans import searching

    # many texts have the same trigrams: a list of them each, not a row for each text
    texts = spark.range(3000).select(F.lit("title").alias("kind"), F.col("id").cast("string").alias("id"), F.concat(F.lit("the same words in all texts, "), F.col("id") % 10).alias("text"))
    index = searching.TextIndex(spark, f"file://{tmp_path}/index", folders=8).build(texts.repartition(2))
    stored = spark.read.parquet(f"file://{tmp_path}/index/grams")
    assert stored.count() <= 3 * stored.select("gram").distinct().count() < 200
    assert index.search("TEXTS, 7").count() == 300 and index.search("words").count() == 3000


def test_lists_of_trigrams(monkeypatch):
    import random

    import pyarrow as pa

    from paperloom.plans import searching

    rng = random.Random(9)
    for letters, block in ((1, 4), (50, 3), (1 << 20, 1 << 15)):
        monkeypatch.setattr(searching, "LETTERS", letters)
        monkeypatch.setattr(searching, "BLOCK", block)
        rows = [(k + (k > 20) * (5 << 33), "".join(rng.choices("abé😀\x00", k=rng.choice([0, 2, 3, 40])))) for k in range(90)]
        if letters == 1 << 20:  # so many letters that numbers of 64 bits don't hold all trigrams and texts at once
            rows.append((7 << 33, "".join(map(chr, range(0x10000, 0x90000)))))
        batch = pa.RecordBatch.from_pydict({"number": [r[0] for r in rows], "text": [r[1] for r in rows]})
        want = {(t[k : k + 3], n) for n, t in rows for k in range(len(t) - 2)}
        got = [(g, b * block + p) for out in searching._lists([batch.slice(0, 13), batch.slice(13)]) for g, b, places in zip(*(c.to_pylist() for c in out.columns), strict=True) for p in places]
        assert set(got) == want


# -- queries against their SQL


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    found = duck.execute(queries.ORACLE[name])
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=str)
    assert sorted(names) == sorted(df.columns) and got == want


def test_merges_are_idempotent(spark):
    tasks = batch(spark, [("1", "t", ["A", "B"], ["c"], "u")])
    start = (spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    once = graph.merge_graph(*start, graph.task_graph(tasks))
    twice = graph.merge_graph(*once, graph.task_graph(tasks))
    assert [x.count() for x in once] == [x.count() for x in twice] == [4, 3]


def test_vector_topk_without_its_query_vector(spark, tmp_path):
    for name, rows in (("none", []), ("other", [(k, [1.0, float(k)]) for k in range(12, 0, -1)])):
        d = str(tmp_path / name)
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
        assert [tuple(r) for r in queries.QUERIES["vector_topk"](spark, d).collect()] == [(r[0], None) for r in sorted(rows)[:10]]
