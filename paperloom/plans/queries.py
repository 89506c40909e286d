"""Queries of the library's operators over the synthetic tables, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents
from ..functions import text as X
from ..operators import checkpoint, graph, limits, similar, tables
from ..sources import feed, models
from ..session import shared_path
from . import extensions, ingest, searching, serve
from .testdata import graph as test_graph
from .testdata import reader_graph, table, tags

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: A checkpoint within the events' time, the graph view's size, and papers and searches asked for.
SINCE, VIEW, PAPER_ID, SOUGHT = "2024-01-15T00:00:00Z", 200, 5, "tion"
ISO, ISO_SQL = "yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"


def query(sql: str | None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# -- the read API


@query("select o_orderkey as id, o_orderdate as created from orders order by o_orderdate desc nulls first, o_orderkey limit 50")
def papers_recent(spark, d):
    return serve.papers_recent(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created")), "created", "id", 50)


_DETAIL = """
with a as (select o_orderkey as id, list_sort(list(distinct c_name)) as authors from orders join customer on o_custkey = c_custkey group by o_orderkey),
t as (select l_orderkey as id, list_sort(list(distinct p_name)) as names from lineitem join part on l_partkey = p_partkey group by l_orderkey),
k as (select l_orderkey as id, count(distinct l_partkey) as n from lineitem group by l_orderkey)
select o_orderkey as id, coalesce(array_to_string(authors, '|'), '') as authors, coalesce(array_to_string(names, '|'), '') as topics,
coalesce(k.n, 0) as n_topics, 0::bigint as n_citations
from orders left join a on o_orderkey = a.id left join t on o_orderkey = t.id left join k on o_orderkey = k.id
"""


@query(_DETAIL)
def paper_detail(spark, d):
    """Every paper with its authors, topics and citations, as the detail route builds them."""
    nodes, edges = test_graph(spark, d)
    detail = serve.paper_detail(nodes, edges.where("type <> 'BELONGS_TO'"))
    return detail.select(F.col("props")["id"].cast("long").alias("id"), _names("authors").alias("authors"), _names("topics").alias("topics"), F.size("topics").cast("long").alias("n_topics"), F.size("citations").cast("long").alias("n_citations"))


def _names(column: str):
    return F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda n: n["props"]["name"]))), "|")


@query("""
with a as (select o_orderkey as id, list_sort(list(distinct c_name)) as authors from orders join customer on o_custkey = c_custkey group by o_orderkey),
t as (select l_orderkey as id, list_sort(list(distinct s_name)) as topics from lineitem join supplier on l_suppkey = s_suppkey group by l_orderkey),
c as (select l_orderkey as id, list_sort(list(distinct cited.o_orderkey::varchar)) as cited from lineitem join orders cited on l_partkey = cited.o_orderkey group by l_orderkey)
select o_orderkey as id, coalesce(array_to_string(authors, '|'), '') as authors, coalesce(array_to_string(topics, '|'), '') as topics, coalesce(array_to_string(cited, '|'), '') as citations
from orders left join a on o_orderkey = a.id left join t on o_orderkey = t.id left join c on o_orderkey = c.id""")
def paper_detail_reader(spark, d):
    """The detail route in the names that readers expect, with citations, a self join of papers."""
    detail = serve.paper_detail(*reader_graph(spark, d), vocabulary="reader")
    cited = F.array_join(F.array_sort(F.transform("citations", lambda n: n["props"]["id"])), "|")
    return detail.select(F.col("props")["id"].cast("long").alias("id"), _names("authors").alias("authors"), _names("topics").alias("topics"), cited.alias("citations"))


@query(f"""
select o_orderkey as id, (select coalesce(string_agg(distinct c_name, '|' order by c_name), '') from customer where c_custkey = o_custkey) as authors,
(select count(distinct l_suppkey) from lineitem where l_orderkey = o_orderkey) as n_topics,
(select count(distinct l_partkey) from lineitem where l_orderkey = o_orderkey and l_partkey in (select o_orderkey from orders)) as n_citations from orders where o_orderkey = {PAPER_ID}""")
def paper_by_id(spark, d):
    """The detail route for one paper."""
    detail = serve.paper_detail(*reader_graph(spark, d), str(PAPER_ID), "reader")
    return detail.select(F.col("props")["id"].cast("long").alias("id"), _names("authors").alias("authors"), F.size("topics").cast("long").alias("n_topics"), F.size("citations").cast("long").alias("n_citations"))


@query(f"select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey = {PAPER_ID}")
def point_lookup(spark, d):
    return serve.point_lookup(table(spark, d, "orders"), "o_orderkey", PAPER_ID)


_EXPAND = "with r as (select distinct l_orderkey as k, l_partkey as m from lineitem)"


@query(f"{_EXPAND} select o_orderkey as p, m from orders left join r on o_orderkey = k")
def optional_outgoing(spark, d):
    """Every paper and what it leads to; papers without edges stay, with null."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("p"))
    edges = tags(spark, d).select(F.col("paper").alias("src"), F.col("tag").alias("dst"), F.lit("USES_TECH").alias("type"))
    return serve.outgoing(orders, edges).select("p", "m")


@query(f"{_EXPAND} select o_orderkey as p from orders where o_orderkey not in (select k from r)")
def papers_without_edges(spark, d):
    nodes, edges = test_graph(spark, d)
    papers = nodes.where("label = 'Paper'").select(F.col("props")["id"].cast("long").alias("p"), F.col("element_id").alias("src"))
    return papers.join(edges.where("type = 'USES_TECH'"), "src", "left_anti").select("p")


_LIMITED = f"""
with r as (select distinct l_orderkey as k, l_partkey as m from lineitem),
x as (select 'Paper' || chr(31) || o_orderkey as p, case when m is null then null else 'TechTag' || chr(31) || m end as m from orders left join r on o_orderkey = k),
e as (select * from x order by p, m nulls last limit {VIEW})
"""


def _view(spark, d):
    nodes, edges = test_graph(spark, d)
    return serve.graph_view(nodes, edges.where("type = 'USES_TECH'"), VIEW)


@query(f"""{_LIMITED} select distinct element_id, label, id from (
select p as element_id, 'Paper' as label, split_part(p, chr(31), 2) as id from e
union all select m, 'TechTag', m from e where m is not null)""")
def graph_nodes(spark, d):
    return _view(spark, d)[0].select("element_id", "label", "id")


@query(f"{_LIMITED} select p as source, m as target, 'USES_TECH' as type from e where m is not null")
def graph_edges(spark, d):
    return _view(spark, d)[1]


@query("select 'idle' as status, count(*) as queueLength from events")
def queue_length(spark, d):
    return serve.status(spark, table(spark, d, "events"))


@query("""select 'papers' as name, count(*) as rows, case when count(*) > 0 then 'ok' else 'empty' end as status from orders
union all select 'edges', count(*), case when count(*) > 0 then 'ok' else 'empty' end from lineitem
union all select 'failed', count(*), case when count(*) > 0 then 'ok' else 'empty' end from events where user_id is null""")
def health(spark, d):
    """What the health route counts: stored papers and edges, and papers that failed."""
    return serve.health({"papers": table(spark, d, "orders"), "edges": table(spark, d, "lineitem"), "failed": table(spark, d, "events").where("user_id is null")})


@query("""select coalesce(url, '') as name, coalesce(s, 0)::bigint as size, timestamp '1970-01-01 00:00:00' as modified from
(select url, case when page_id > 10 then octet_length(encode(html)) end as s from pages)""")
def null_defaults(spark, d):
    """The file view: sizes missing for some objects, times for all."""
    from ..sources.objects import file_view

    pages = table(spark, d, "pages").select(F.col("url").alias("name"), F.when(F.col("page_id") > 10, F.octet_length("html")).alias("size"), F.lit(None).cast("timestamp").alias("lastModified"))
    return file_view(pages).select("name", "size", F.col("lastModified").cast("timestamp_ntz").alias("modified"))


# -- feeds and checkpoints


def _events(spark, d):
    return table(spark, d, "events").withColumn("published", F.date_format("ts", ISO)).withColumn("pos", -F.col("event_id"))


@query(f"select event_id, strftime(ts, '{ISO_SQL}') as published from events where strftime(ts, '{ISO_SQL}') > '{SINCE}'")
def checkpoint_filter(spark, d):
    return checkpoint.emitted(_events(spark, d), SINCE).select("event_id", "published")


@query(f"select arg_max(strftime(ts, '{ISO_SQL}'), event_id) as checkpoint from events where strftime(ts, '{ISO_SQL}') > '{SINCE}'")
def checkpoint_advance(spark, d):
    """The time of the entry emitted last, by position."""
    return checkpoint.advanced(checkpoint.emitted(_events(spark, d), SINCE), SINCE)


@query("select event_id, ts from (select event_id, ts from events order by ts desc, event_id limit 100) where ts > timestamp '2024-01-29 00:00:00'")
def feed_topn(spark, d):
    """The newest hundred first, then the checkpoint."""
    page = checkpoint.newest(table(spark, d, "events"), 100, "ts", "event_id")
    return page.where("ts > timestamp_ntz'2024-01-29 00:00:00'").select("event_id", "ts")


@query("select event_id, (5 * power(2, event_id % 3))::bigint as seconds from events")
def backoff(spark, d):
    """Events as failed calls, each some attempt of three, and how long the next one waits."""
    return table(spark, d, "events").select("event_id", X.backoff_seconds(F.col("event_id") % 3).alias("seconds"))


def _entries(spark, d):
    """Pages as entries of a feed: some without an update, a category or a link of their own."""
    none = F.lit(None)
    third = F.col("page_id") % 3
    term = lambda c: F.struct(c.alias("_term"))
    return table(spark, d, "pages").select(
        F.col("url").alias("id"),
        F.concat(F.lit("Title\n of "), F.col("page_id").cast("string")).alias("title"),
        F.array(F.struct(F.lit("A").alias("name")), F.struct(F.concat(F.lit("B"), third.cast("string")).alias("name"))).alias("author"),
        F.array(F.struct(F.lit("http://pdf.example/x").alias("_href"), F.lit("related").alias("_rel")), F.struct(F.concat(F.lit("http://a.example/abs/"), F.col("page_id").cast("string")).alias("_href"), none.cast("string").alias("_rel"))).alias("link"),
        F.lit("2024-01-01T00:00:00Z").alias("published"),
        F.when(third == 0, F.lit("2024-02-01T00:00:00Z")).alias("updated"),
        F.when(third > 0, term(F.lit("cs.LG"))).alias("primary_category"),
        F.when(third > 0, F.array(term(F.lit("cs.LG")), term(F.concat(F.lit("c"), third.cast("string"))))).alias("category"),
        F.lit("s").alias("summary"),
        F.col("page_id").alias("pos"),
    )


@query("""select page_id as pos, split_part(url, '/', -1) as id, 'Title  of ' || page_id as title, 'A|B' || page_id % 3 as authors, 'http://a.example/e-print/' || page_id as source_url,
case when page_id % 3 = 0 then '2024-02-01T00:00:00Z' else '2024-01-01T00:00:00Z' end as updated, case when page_id % 3 > 0 then 'cs.LG' end as primary_category,
case when page_id % 3 > 0 then 'cs.LG|c' || page_id % 3 else '' end as categories from pages""")
def feed_tasks(spark, d):
    """Entries as tasks."""
    rows = feed.tasks(_entries(spark, d))
    return rows.select("pos", "id", "title", F.array_join("authors", "|").alias("authors"), "source_url", "updated", "primary_category", F.array_join("categories", "|").alias("categories"))


@query("select page_id as pos, 'http://a.example/pdf/' || page_id || '.pdf' as pdf_url from pages")
def feed_tasks_legacy(spark, d):
    return feed.legacy_tasks(_entries(spark, d)).select("pos", "pdf_url")


@query("select doc_id from documents where lang in ('en', 'de') or source in ('en', 'de')")
def category_filter(spark, d):
    """Records in any of the wanted categories."""
    return table(spark, d, "documents").where(feed.in_categories(F.array("lang", "source"), ["en", "de"])).select("doc_id")


@query("select event_id, case when event_id % 2 = 0 then date_trunc('second', ts) end as at from events")
def wall_times(spark, d):
    """Times as text, every other one broken."""
    iso = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", ISO)).otherwise(F.lit("soon"))
    return table(spark, d, "events").select("event_id", X.wall_time(iso).alias("at"))


# -- keyed tables

_FIRST = "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events) where n = 1"


@query(_FIRST)
def upsert_first_wins(spark, d):
    """Events into an empty table by user: the first of each stays."""
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return tables.insert_absent(events.where("false"), events, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""select s_suppkey as id, s_name as name from supplier union all
select c_custkey, c_name from customer where c_custkey not in (select s_suppkey from supplier)""")
def insert_into_existing(spark, d):
    """Customers into suppliers by key: keys that are there keep their rows."""
    current = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    batch = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return tables.insert_absent(current, batch, "id", "name")


@query("""with u as (select l_orderkey as k, max(case when l_returnflag = 'R' then l_quantity end) as v from lineitem where l_linenumber > 2 group by 1)
select o_orderkey, case when u.k is not null then u.v else o_totalprice end as o_totalprice, case when u.k is not null then 'ENRICHED' else 'PROCESSING' end as status
from orders left join u on o_orderkey = u.k""")
def update_by_key(spark, d):
    """A matching null overwrites."""
    updates = table(spark, d, "lineitem").where("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("o_totalprice")).withColumn("status", F.lit("ENRICHED"))
    current = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit("PROCESSING").alias("status"))
    return tables.update_by_key(current, updates, "o_orderkey", ["o_totalprice", "status"])


@query("select o_orderkey, o_totalprice, case when o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') then 'FAILED' else 'PROCESSING' end as status from orders")
def update_status_only(spark, d):
    current = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit("PROCESSING").alias("status"))
    failed = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.set_status(current, failed, "o_orderkey", "FAILED")


@query("select user_id, arg_max(event_type, (ts, event_id)) as status from events group by user_id")
def status_latest(spark, d):
    return tables.latest_of_each(table(spark, d, "events").withColumnRenamed("event_type", "status"), "user_id", "status", "ts", "event_id")


@query("select user_id, date_trunc('day', ts)::timestamp as window_start, count(*) as seen, least(count(*), 3)::bigint as allowed from events group by 1, 2")
def rate_limit(spark, d):
    return tables.rate_windows(table(spark, d, "events"), "user_id", "ts", "1 day", 3).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events where user_id is not null and ts is not null),
w as (select event_id, user_id, k, ts as window_start, 1::bigint as nth from e where k = 1
union all select e.event_id, e.user_id, e.k, case when e.ts >= w.window_start + interval 6 hours then e.ts else w.window_start end, case when e.ts >= w.window_start + interval 6 hours then 1 else w.nth + 1 end
from w join e on e.user_id = w.user_id and e.k = w.k + 1)
select event_id, window_start, nth, nth <= 2 as allowed from w""")
def rate_decisions(spark, d):
    """Each request allowed or denied, in windows that begin with a client's first request."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return limits.rate_decisions(events, "user_id", "ts", "event_id", 6 * 3600, 2).select("event_id", "window_start", "nth", "allowed")


@query("select conv_id, string_agg(text, chr(10) order by turn, text) || chr(10) as text from conversations group by conv_id")
def ordered_concat(spark, d):
    return tables.joined_in_order(table(spark, d, "conversations"), "conv_id", "text", "turn")


_REQUIRED = ("cold", "widget", "gemma", "small wid", "embed")


@query(f"select name from (values {', '.join(f'({chr(39)}{r}{chr(39)})' for r in _REQUIRED)}) e(name) where not exists (select 1 from part where contains(p_name, name))")
def theta_anti(spark, d):
    """Required names that no part's name contains."""
    required = spark.createDataFrame([(r,) for r in _REQUIRED], "name string")
    return tables.missing(required, table(spark, d, "part").select(F.col("p_name").alias("name")))


# -- the graph


@query("select distinct l_orderkey as src, l_partkey as dst, 'USES_TECH' as type from lineitem")
def edges_uses_tech(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("USES_TECH").alias("type"))
    return tables.merge_rows(rows.where("false"), rows, ["src", "dst", "type"])


@query("""select 'P' || o_orderkey as element_id, 'Paper' as label from orders union select 'A' || c_custkey, 'Author' from customer
union select 'T' || p_partkey, 'TechTag' from part""")
def nodes_distinct(spark, d):
    """Nodes of two overlapping batches, merged."""
    ids = lambda name, key, mark, label: table(spark, d, name).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("element_id"), F.lit(label).alias("label"))
    papers, authors, parts = ids("orders", "o_orderkey", "P", "Paper"), ids("customer", "c_custkey", "A", "Author"), ids("part", "p_partkey", "T", "TechTag")
    return tables.merge_rows(papers.unionByName(authors), authors.unionByName(parts), ["element_id"])


_LISTS = "case when {0} % 3 = 0 then null when {0} % 3 = 1 then [] else [event_type, 'u' || user_id] end"


def _lists(column: str):
    n = F.pmod(F.col(column), F.lit(3))
    none = F.lit(None).cast("array<string>")
    return F.when(n == 0, none).when(n == 1, F.array().cast("array<string>")).otherwise(F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string"))))


@query(f"""with t as (select event_id, {_LISTS.format('event_id')} as a, {_LISTS.format('user_id')} as c from events)
select event_id, unnest(a) as name, 'WROTE' as type from t union
select event_id, unnest(c), 'BELONGS_TO' from t where coalesce(len(a), 0) > 0""")
def unwind_gate(spark, d):
    """Categories count only where there are authors; null and empty lists give nothing."""
    tasks = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.lit("t").alias("title"), _lists("event_id").alias("authors"), _lists("user_id").alias("categories"))
    _, edges = graph.task_graph(tasks)
    part = lambda c, k: F.element_at(F.split(c, "\u001f"), k)
    wrote = F.col("type") == "WROTE"
    return edges.select(part(F.when(wrote, F.col("dst")).otherwise(F.col("src")), 2).cast("long").alias("event_id"), part(F.when(wrote, F.col("src")).otherwise(F.col("dst")), 2).alias("name"), "type")


@query(f"""with t as (select event_id, {_LISTS.format('event_id')} as i, {_LISTS.format('user_id')} as t, {_LISTS.format('(event_id // 3)')} as s from events)
select event_id, unnest(i) as name, 'AFFILIATED_WITH' as type from t union
select event_id, unnest(t), 'USES_TECH' from t where coalesce(len(i), 0) > 0 union
select event_id, unnest(s), 'TESTED_ON' from t where coalesce(len(i), 0) > 0 and coalesce(len(t), 0) > 0""")
def unwind_gate_findings(spark, d):
    """The chain of three lists."""
    rows = table(spark, d, "events").withColumn("both", F.floor(F.col("event_id") / 3))
    found = rows.select(F.col("event_id").cast("string").alias("id"), _lists("event_id").alias("institutions"), _lists("user_id").alias("tech_tools"), _lists("both").alias("datasets"))
    nodes = rows.select(graph.paper_node(F.col("event_id").cast("string"), F.lit("t")).alias("element_id"), F.lit("Paper").alias("label"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("props"))
    _, edges = graph.finding_graph(found, nodes)
    part = lambda c: F.element_at(F.split(c, "\u001f"), 2)
    return edges.select(part("src").cast("long").alias("event_id"), part("dst").alias("name"), "type")


# -- columns


@query("select page_id, split_part(url, '/', -1) as last, replace(url, '/en/', '/e-print/') as source, replace(url, 'example', 'pdf') || '.pdf' as pdf, replace(url, ' ', '+') as plus from pages")
def url_parts(spark, d):
    url = F.col("url")
    as_link = lambda c: F.replace(c, F.lit("/en/"), F.lit("/abs/"))
    source = X.source_url(as_link(url))
    return table(spark, d, "pages").select("page_id", X.last_segment(url).alias("last"), source.alias("source"), X.legacy_pdf_url(F.replace(url, F.lit("example"), F.lit("abs"))).alias("pdf"), X.query_plus(url).alias("plus"))


@query("""select doc_id, '20' || substr(k, 1, 2) || '/' || substr(k, 3, 2) || '/' || k || '.txt' as object_key,
'http://localhost:9000/papers/20' || substr(k, 1, 2) || '/' || substr(k, 3, 2) || '/' || k || '.txt' as url from (select doc_id, lpad(doc_id::varchar, 8, '0') as k from documents)""")
def object_key(spark, d):
    key = X.object_key(F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return table(spark, d, "documents").select("doc_id", key.alias("object_key"), X.object_url("localhost:9000", "papers", key).alias("url"))


@query("select conv_id, turn, replace(text, chr(10), ' ') as title from conversations")
def title_clean(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.one_line(F.col("text")).alias("title"))


_TEX = "'%note' || chr(10) || text || chr(10) || '%' || lang || chr(10) || 'x % y' || chr(10)"


@query(f"select doc_id, regexp_replace({_TEX}, '(?m)^%.*$', '', 'g') as text from documents")
def tex_clean(spark, d):
    """Texts between comment lines, which go."""
    tex = F.concat(F.lit("%note\n"), F.col("text"), F.lit("\n%"), F.col("lang"), F.lit("\nx % y\n"))
    return table(spark, d, "documents").select("doc_id", X.without_comments(tex).alias("text"))


@query(f"select doc_id, case when not regexp_matches(t, '[^\\s]') then '{X.NO_TEXT}' else t end as text from (select doc_id, case when lang = 'de' then '  ' || chr(10) || chr(9) else text end as t from documents)")
def blank_text(spark, d):
    text = F.when(F.col("lang") == "de", F.lit("  \n\t")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.or_no_text(text).alias("text"))


@query("select doc_id, substr(text, 1, 2000) as text, length(substr(text, 1, 2000))::bigint as chars from documents")
def truncate(spark, d):
    cut = X.prefix(F.col("text"), 2000)
    return table(spark, d, "documents").select("doc_id", cut.alias("text"), F.length(cut).cast("long").alias("chars"))


@query("select doc_id, octet_length(encode(text))::bigint as bytes from documents")
def byte_length(spark, d):
    return table(spark, d, "documents").select("doc_id", X.byte_length(F.col("text")).alias("bytes"))


@query("select page_id, url from pages where ends_with(url, '#top')")
def suffix_filter(spark, d):
    return table(spark, d, "pages").where(X.has_suffix(F.col("url"), "#top")).select("page_id", "url")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, 'none' as missing from events")
def json_extract(spark, d):
    doc = documents.parsed(F.col("props"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(doc, "$.k", "long").alias("k"), documents.text_field(doc, "absent", "none").alias("missing"))


@query("select event_id, '{\"event\":\"' || event_type || '\",\"id\":\"' || event_id || '\"}' as event from events")
def event_json(spark, d):
    """Events as they are published: a null title is left out."""
    return table(spark, d, "events").select("event_id", documents.event_json(F.col("event_type"), F.col("event_id")).alias("event"))


@query("select event_id, case when event_id % 3 = 0 then event_type else 'Node' end as label from events")
def first_labels(spark, d):
    """The first of several labels; none, and no list, is a plain node."""
    third = F.col("event_id") % 3
    labels = F.when(third == 0, F.array(F.col("event_type"), F.lit("Other"))).when(third == 1, F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", X.first_label(labels).alias("label"))


@query("select doc_id, length(text)::bigint as chars from (select doc_id, substr(text, 1, 100) as text from documents)")
def prompts(spark, d):
    """What of a text goes into a prompt, by its length beside the prompt's own."""
    asked = models.prompted(F.col("text"), 100)
    return table(spark, d, "documents").select("doc_id", (F.length(asked) - len(models.PROMPT)).cast("long").alias("chars"))


@query("select p_name as name from part")
def model_catalogue(spark, d):
    """Names out of catalogue answers, a list in each."""
    part = table(spark, d, "part").groupBy(F.col("p_partkey") % 7).agg(F.collect_list(F.struct(F.col("p_name").alias("name"))).alias("models"))
    return models.catalogue(part.select(F.to_json(F.struct("models")).alias("value")))


@query("select page_id, starts_with(replace(url, 'https://', '/api/'), '/api') as limited from pages")
def limited_paths(spark, d):
    return table(spark, d, "pages").select("page_id", serve.is_limited(F.replace("url", F.lit("https://"), F.lit("/api/"))).alias("limited"))


_KINDS = 8


def _found(spark, d):
    """Orders as tasks whose texts, answers and vectors take every form."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") % _KINDS).alias("kind"))
    tasks = rows.select("id", F.lit("t").alias("title"), F.array(F.lit("A")).alias("authors"), F.array(F.lit("c")).alias("categories"), F.when(F.col("kind") != 0, F.lit("u")).alias("source_url"), F.lit("2024-03-20T15:30:00Z").alias("published"), F.lit("s").alias("summary_raw"), F.lit(1).alias("arrival"))
    answer = F.element_at(F.array(*map(F.lit, ("{}", '{"tldr": "x", "institutions": ["i"]}', '{"tldr": null}', "[1]", "{", "0", '{"tldr": "y"}', '{"tldr": "z", "institutions": ["i", null]}'))), F.col("kind").cast("int") + 1)
    answers = rows.select("id", F.when(F.col("kind") != 5, answer).alias("answer"), F.lit(None).cast("string").alias("error"))
    vectors = rows.select("id", F.when(F.col("kind") == 6, F.array(F.lit(1.0))).when(F.col("kind") != 2, F.array(F.lit(1.0), F.lit(2.0))).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("error"))
    texts = rows.where("kind <> 0").select("id", F.lit("text").alias("text"), F.lit(None).cast("string").alias("error"))
    return tasks, ingest.outcome(tasks, texts, answers, vectors, 2)


@query(f"""select o_orderkey::varchar as id, case o_orderkey % {_KINDS} when 0 then 'FAILED' when 1 then 'ENRICHED' when 2 then 'ENRICHED' when 3 then 'FAILED' when 4 then 'FAILED' when 5 then 'SKIPPED' when 6 then 'FAILED' else 'LATE_FAILED' end as outcome,
case o_orderkey % {_KINDS} when 1 then 'x' when 2 then null when 6 then 'y' when 7 then 'z' when 4 then null when 5 then null when 3 then null else '' end as tldr from orders""")
def outcomes(spark, d):
    """What becomes of papers: answers that are missing, empty, broken or no object, vectors of a wrong size, null names."""
    given = documents.is_object(documents.parsed(F.col("answer")))
    return _found(spark, d)[1].select("id", "outcome", F.when(given, F.col("tldr")).alias("tldr"))


@query(f"""select o_orderkey::varchar as id, case when o_orderkey % {_KINDS} in (1, 2) then 'ENRICHED' when o_orderkey % {_KINDS} = 5 then 'PROCESSING' else 'FAILED' end as status,
case o_orderkey % {_KINDS} when 1 then 'x' when 7 then 'z' end as tldr_ai, o_orderkey % {_KINDS} in (1, 7) as has_vector from orders""")
def lifecycle(spark, d):
    """Papers after a whole batch: first insert, then what was found."""
    tasks, found = _found(spark, d)
    state = ingest.enriched(ingest.added(ingest.empty_state(spark), tasks, "arrival"), found)
    return state.papers.select("id", "status", "tldr_ai", F.col("embedding").isNotNull().alias("has_vector"))


@query(f"""select o_orderkey as event_id, 'NEW_PAPER' as event from orders union all select o_orderkey, 'PAPER_ENRICHED' from orders where o_orderkey % {_KINDS} in (1, 2)""")
def lifecycle_events(spark, d):
    tasks, found = _found(spark, d)
    state = ingest.enriched(ingest.added(ingest.empty_state(spark), tasks, "arrival"), found)
    return state.events.select(F.col("id").cast("long").alias("event_id"), "event")


@query("""select c_custkey::varchar as id, case when c_custkey % 4 = 0 then 'no title' when c_custkey % 4 = 1 then 'published is no time' when c_custkey % 4 = 2 then 'a name is null' end as reason from customer where c_custkey % 4 < 3""")
def quarantine(spark, d):
    """Tasks that can't be stored, and why."""
    kind = F.col("c_custkey") % 4
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(kind != 0, F.col("c_name")).alias("title"),
        F.when(kind == 1, F.lit("soon")).otherwise(F.lit("2024-03-20T15:30:00Z")).alias("published"),
        F.array(F.lit("A"), F.when(kind != 2, F.lit("B"))).alias("authors"),
        F.array(F.lit("c")).alias("categories"),
    )
    return ingest.sound(rows)[1].select("id", "reason")


# -- extensions


@query(f"""with t as (select distinct l_orderkey as paper, l_partkey as tag from lineitem)
select b.paper, count(distinct b.tag) as shared from t a join t b on a.tag = b.tag where a.paper = {PAPER_ID} and b.paper <> {PAPER_ID} group by b.paper""")
def shared_tags(spark, d):
    return extensions.shared_tags(tags(spark, d), PAPER_ID)


@query("""with w as (select distinct l_orderkey as p, l_suppkey as s from lineitem)
select x.s as a, y.s as b, count(*) as papers from w x join w y on x.p = y.p and x.s < y.s group by 1, 2""")
def coauthor(spark, d):
    return extensions.coauthors(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("author")))


@query(f"""select 'Author' as label, o_custkey as key from orders where o_orderkey = {PAPER_ID}
union select 'TechTag', l_partkey from lineitem where l_orderkey = {PAPER_ID}""")
def neighbourhood(spark, d):
    """The authors and tags of one paper."""
    nodes, edges = test_graph(spark, d)
    found = extensions.neighbourhood(nodes, edges, f"Paper\x1f{PAPER_ID}", ("WROTE", "USES_TECH"))
    return found.select("label", F.element_at(F.split("element_id", "\x1f"), 2).cast("long").alias("key"))


@query(f"""with u as (select distinct o_custkey as author, l_partkey as tag from lineitem join orders on l_orderkey = o_orderkey)
select b.author, count(*) as shared from u a join u b on a.tag = b.tag where a.author = (select o_custkey from orders where o_orderkey = {PAPER_ID}) and b.author <> a.author
group by b.author order by shared desc, b.author limit 20""")
def related_authors(spark, d):
    """Who shares most tags with the author of one paper."""
    wrote = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), F.col("o_custkey").alias("author"))
    row = wrote.where(F.col("paper") == PAPER_ID).first()
    return extensions.related_authors(wrote, tags(spark, d), row and row["author"])


@query("select l_partkey as tag, count(distinct l_orderkey) as papers from lineitem group by 1 order by papers desc, tag limit 20")
def top_tags(spark, d):
    return extensions.top_tags(tags(spark, d))


@query(f"select doc_id, text from documents where contains(lower(text), lower('{SOUGHT}'))")
def search(spark, d):
    return extensions.search(table(spark, d, "documents"), "text", SOUGHT).select("doc_id", "text")


@query("""with q as (select embedding::double[] as q from embeddings where vec_id = 0)
select vec_id, round(list_dot_product(embedding::double[], (select q from q)), 6) as score from embeddings order by score desc, vec_id limit 10""")
def vector_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    row = vectors.where("vec_id = 0").first()
    return extensions.top_similar(vectors, row and row["embedding"], 10)


@query("""with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 50 = 0),
s as (select query_id, vec_id, round(list_dot_product(embedding::double[], q), 6) as score from q, embeddings),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s) select query_id, rank, vec_id, score from r where rank <= 10""")
def vector_topk_of_many(spark, d):
    """For many vectors the most similar ones, in blocks by length."""
    vectors = table(spark, d, "embeddings")
    return similar.most_similar(vectors.where("vec_id % 50 = 0"), vectors, 10).rows


@query("""with q as (select distinct lower(substr(trim(text), 1, 12)) as name from documents where text is not null),
e as (select name, exists (select 1 from documents d where contains(lower(d.text), name) and d.doc_id % 2 = 1) as hit from q) select name from e where hit""")
def names_contained(spark, d):
    """Of the beginnings of all documents those that a document with an odd number contains somewhere."""
    docs = table(spark, d, "documents")
    asked = docs.where("text is not null").select(F.lower(F.substring(F.trim("text"), 1, 12)).alias("name"))
    return tables.contained(asked, docs.where("doc_id % 2 = 1").select(F.lower("text").alias("name")))


@query(f"""select 'title' as kind, doc_id::varchar as id from documents where contains(lower(text), lower('{SOUGHT}'))
union all select 'node', 'Author' || chr(31) || c_custkey from customer where contains(lower(c_name), lower('{SOUGHT}'))
union all select 'node', 'TechTag' || chr(31) || p_partkey from part where contains(lower(p_name), lower('{SOUGHT}'))
union all select 'node', 'Category' || chr(31) || o_orderpriority from (select distinct o_orderpriority from orders) where contains(lower(o_orderpriority), lower('{SOUGHT}'))""")
def search_index(spark, d):
    """The search over titles and graph nodes, through a stored index: documents as titles."""
    nodes, _ = test_graph(spark, d)
    texts = searching.title_texts(table(spark, d, "documents"), "doc_id", "text").unionByName(searching.node_texts(nodes))
    return searching.TextIndex(spark, shared_path(spark, "search")).build(texts).search(SOUGHT).select("kind", "id")
