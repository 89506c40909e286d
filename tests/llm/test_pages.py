"""Archives, url rules and exact search, against brute force and on rows that break things."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import topk, url_filter, warc

# -- 6

PAGES = [
    (1, "http://a.example/x", "<p>one</p>"),
    (2, "http://a.example/x", "<p>one</p>"),
    (2, "http://a.example/x", "<p>one</p>"),
    (3, None, None),
    (4, "http://b.example/\r\nX: y", ""),
    (None, "http://c.example/", "<p>one</p>"),
    (None, "http://c.example/", "alone"),
    (-7, "http://d.example/ü", "é😀 " * 50_000),
    (8, "http://d.example/ü", "a\r\n\r\nWARC-Type: revisit\r\n"),
]


def pages_of(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return df.selectExpr("*", "'clash' as address", "1 as size", "2 as largest", "'x' as payload", "'y' as header")


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, least):
    got = sorted((tuple(r) for r in warc.archive_round_trip(pages_of(spark), least).collect()), key=str)
    bodies = {}
    for i, _, html in PAGES:
        if i is not None:
            bodies[html or ""] = max(i, bodies.get(html or "", i))
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        last = bodies.get(html or "") if len(raw) >= least else None
        revisit = last is not None and i != last
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    assert got == sorted(want, key=str)


def test_records_are_put_together_exactly(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages_of(spark), path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({html or "" for _, _, html in PAGES})
    records = warc.reconstruct(spark, path).collect()
    assert len(records) == len(PAGES)
    carried, ids = [], []
    for r in records:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)$", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and len(rest) == length + 4 and rest.endswith(b"\r\n\r\n")
        http, _, payload = rest[:-4].partition(b"\r\n\r\n")
        revisit = b"WARC-Type: revisit" in head.split(b"\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK") and re.search(rb"\r\nWARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", head)
        ids.append(re.search(rb"\r\nWARC-Record-ID: <(.*?)>\r\n", head)[1])
        if revisit:
            assert payload == b"" and int(re.search(rb"\r\nWARC-Refers-To: <urn:page:(\d+):", head)[1]) == {1: 2, None: 2, 3: 4}[r["page_id"]]
        else:
            carried.append((r["page_id"], payload))
    # page 2 stands twice with one payload, and its repeated record has one id; all others have their own
    want = [(i, (html or "").encode()) for i, _, html in PAGES if (i, html) not in ((1, "<p>one</p>"), (None, "<p>one</p>"), (3, None))]
    assert Counter(carried) == Counter(want) and len(set(ids)) == len(PAGES) - 1


def test_records_whose_lengths_lie_stop_the_reader(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages_of(spark), path)
    bad = [(r["page_id"], r["address"], r["whole"], bytearray(bytes(r["header"]).replace(b"Content-Length: ", b"Content-Length: 1", 1))) for r in spark.read.parquet(f"{path}/headers").collect()]
    spark.createDataFrame(bad, "page_id long, address string, whole boolean, header binary").write.mode("overwrite").parquet(f"{path}/headers")
    with pytest.raises(Exception, match="length differs"):
        warc.read_records(spark, path).collect()


def test_damaged_payloads_stop_the_reader(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages_of(spark), path)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("address", "cast('other' as binary) as payload").collect()
    spark.createDataFrame(bad, "address string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="differs from its address"):
        warc.read_records(spark, path).collect()


def test_no_pages(spark):
    none = pages_of(spark).where("false")
    assert warc.archive_round_trip(none).count() == 0
    assert url_filter.judge_urls(none).count() == 0


# -- 9


def test_automaton_equals_plain_globs():
    rng = random.Random(8)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(rng.randrange(n)))
    globs = [g for _ in range(120) if re.sub(r"\*", "", g := re.sub(r"\*+", "*", some("ab*?", 9)))]
    texts = [some("abc", 14) for _ in range(300)]
    automaton = url_filter.WildcardAutomaton([[c if c in "*?" else ord(c) for c in g] for g in globs])
    assert automaton.words > 1
    got = automaton.run([np.frombuffer(t.encode(), np.uint8).astype(np.int16) for t in texts])
    want = [[bool(re.fullmatch(g.replace("*", ".*").replace("?", "."), t)) for g in globs] for t in texts]
    assert (got == np.array(want)).all()


def test_url_rules(spark):
    cases = [
        ("http://WWW.Example.com/en/7/x?y", "www.example.com", "/en/7/x", "example.com/en/7", "allow"),
        ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        ("http://com/en/", "com", "/en/", "com/en/", "block"),
        ("http://xcom/en/", "xcom", "/en/", None, "allow"),
        ("https://a.example.net/de/8", "a.example.net", "/de/8", "example.net/de/8", "block"),
        ("https://a.example.net/de/9#t", "a.example.net", "/de/9", "net/de/", "allow"),
        ("ftp://x.org/es", "x.org", "/es", None, "allow"),
        ("ftp://x.org/es/", "x.org", "/es/", "org/es/", "block"),
        ("http://www.casino-one.biz/", "www.casino-one.biz", "/", None, "block"),
        ("http://a.biz", "a.biz", "", None, "allow"),
        ("http://a://b/c", "a:", "//b/c", None, "allow"),
        ("\n://é.org/es/ü", "é.org", "/es/ü", "org/es/", "block"),
        ("no scheme/en/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://com/en/" + "x" * 100_000, "com", "/en/" + "x" * 100_000, "com/en/", "block"),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)] + [(None, None)], "page_id long, url string").selectExpr("*", "'x' as rule", "'y' as host", "1 as verdict")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    assert len(got) == len(cases) + 1
    for k, c in enumerate(cases):
        assert got[k] == c[1:], c[0][:80]


# -- 8


def brute_force(rows, k):
    """rows: (id, integer vector)."""
    out = []
    for q, v in {i: v for i, v in rows if i % 20 == 0}.items():
        pad = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
        found = sorted((-pad(v, w), i) for i, w in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(topk, "PAGE", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 12))
    rows = [(k, (centres[k % 5] + rng.normal(size=12) * 0.2).tolist()) for k in range(400)]
    rows += [(k, rows[20][1]) for k in range(400, 520)]  # one vector many times: ties
    broken = [(1000, None), (1020, [None] * 12), (1040, [float("nan")] * 12), (1060, [float("inf")] * 12), (1080, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows + broken, "vec_id long, embedding array<double>").repartition(4).selectExpr("*", "'x' as v", "1 as shard", "2 as rank")
    got = sorted(tuple(r) for r in topk.top_inner_products(topk.integer_vectors(df), "vec_id % 20 = 0").collect())
    assert got == brute_force([(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows], 20)
    few = df.where("vec_id in (0, 1, 2)")
    assert topk.top_inner_products(topk.integer_vectors(few), "vec_id % 20 = 0").count() == 2
    assert topk.top_inner_products(topk.integer_vectors(df.where("false")), "vec_id % 20 = 0").count() == 0


def test_tree_prunes(monkeypatch):
    monkeypatch.setattr(topk, "PAGE", 32)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 60
    vectors = np.rint(centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 8))).astype(np.int64)
    tree = topk.MTree(np.arange(8000), vectors, float((vectors**2).sum(axis=1).max()))
    queries = np.arange(0, 200, 20)
    asked, ids, scores = tree.search(queries, vectors[queries], 20, np.full(10, -np.inf))
    for n, q in enumerate(queries):
        all_scores = vectors @ vectors[q]
        all_scores[q] = -(10**15)
        want = np.lexsort((np.arange(8000), -all_scores))[:20]
        mine = slice(20 * n, 20 * n + 20)
        assert set(asked[mine]) == {q} and ids[mine].tolist() == want.tolist() and scores[mine].tolist() == all_scores[want].tolist()
    assert tree.visited < 0.7 * 10 * 8000
    # a query that must beat a score gets nothing below it
    least = scores[:20].min() + 1
    assert set(tree.search(queries[:1], vectors[queries[:1]], 20, np.array([least]))[2]) == {s for s in scores[:20] if s >= least}
    # independent components in 64 dimensions: next to nothing can be ruled out, and results are the same
    vectors = np.floor(64 * (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(2000, 64)))).astype(np.int64)
    tree = topk.MTree(np.arange(2000), vectors, float((vectors**2).sum(axis=1).max()))
    _, ids, _ = tree.search(queries, vectors[queries], 20, np.full(10, -np.inf))
    assert 0.9 * 10 * 2000 < tree.visited < 1.2 * 10 * 2000
    for n, q in enumerate(queries):
        score = vectors @ vectors[q]
        assert ids[20 * n : 20 * n + 20].tolist() == [i for i in np.lexsort((np.arange(2000), -score)).tolist() if i != q][:20]


def test_large_integers_and_repeated_ids(spark):
    big = 2**31
    rows = [(k, [big + k, 1, -k]) for k in range(30)] + [(0, [7, 7, 7])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.top_inner_products(df, "vec_id = 20", 5).collect())
    product = lambda v, w: sum(a * b for a, b in zip(v, w, strict=True))
    want = sorted((-product(rows[20][1], v), i) for i, v in rows if i != 20)[:5]
    assert got == sorted((20, n + 1, i, -s) for n, (s, i) in enumerate(want))
    # of the two vectors with id 0 the least asks
    got = sorted(tuple(r) for r in topk.top_inner_products(df, "vec_id = 0", 1).collect())
    assert [r[3] for r in got] == [max(product([7, 7, 7], v) for i, v in rows if i)]


def test_numbers_beyond_64_bits(spark):
    most, least = 2**63 - 1, -(2**63)
    rows = [(k, [x, 1.0]) for k, x in enumerate([1e300, 2.0, -1e300, 1e17, 1e17, 0.0, 3.0])] + [(20, [1e300, -1e300]), (40, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    bound = lambda x: max(least, min(most, x))
    v = {i: [bound(int(64 * a)) for a in x] for i, x in rows}
    want = []
    for q in (0, 20, 40):
        found = sorted((-bound(sum(a * b for a, b in zip(v[q], w, strict=True))), i) for i, w in v.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert sorted(tuple(r) for r in topk.top_inner_products(topk.integer_vectors(df), "vec_id % 20 = 0").collect()) == want
