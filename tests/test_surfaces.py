"""Tools, addresses, boards, vectors, documents and the store's promises."""

import hashlib
import io
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobquarry import __main__ as cli
from jobquarry.functions import keys, sectors
from jobquarry.operators import aggregates, boards, changes, embeddings, ordering
from jobquarry.plans import tools
from jobquarry.plans.search import SearchQuery, search
from jobquarry.sources import documents, resolver
from jobquarry.sources.store import Store, fingerprint
from jobquarry.streaming import state

from .test_engine import jobs, postings


def test_keyword_results_come_best_first(spark):
    rows = [
        {"id": "a", "title": "nurse", "snippet": "data engineer data engineer", "posted_at": "2024-05-01"},
        {"id": "b", "title": "data engineer", "posted_at": "2023-01-01"},
        {"id": "c", "title": "data data engineer lead", "department": "data", "posted_at": None},
        {"id": "d", "title": "engineer", "posted_at": "2024-06-01"},
        {"id": "e", "title": "data engineer", "posted_at": "2024-06-01", "status": "expired"},
        *({"id": f"x{k}", "title": "clerk"} for k in range(9)),
    ]
    df = jobs(spark, rows)
    assert [r.id for r in search(df, SearchQuery(keywords="data engineer"), "2024-06-01").collect()] == ["b", "c", "a"]
    assert [r.id for r in search(df, SearchQuery(keywords="engineers data", limit=1), "2024-06-01", stemmed=True).collect()] == ["b"]
    assert [r.id for r in tools.keyword_substrings(df, SearchQuery(keywords="ngin LEA"), ("title",)).collect()] == ["c"]


def test_resume_and_sponsors(spark):
    df = jobs(spark, [{"id": f"{k}", "title": t, "company": c, "posted_at": "2024-05-01", "last_seen": "2024-05-30"} for k, (t, c) in enumerate([("data engineer", "Acme"), ("nurse", "Beta"), ("data clerk", "Gamma")])]).withColumns({"visa_sponsor": F.lit(True), "sponsorship_offered": F.lit(True)})
    best = tools.match_resume(df, "I engineer data pipelines", SearchQuery(limit=2), "2024-06-01").collect()
    assert [r.id for r in best] == ["0", "2"]
    stored = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 1.0])], "id string, embedding array<double>")
    assert [r.id for r in tools.match_resume(df, "x", SearchQuery(limit=2), "2024-06-01", stored, [1.0, 0.1]).collect()] == ["1", "2"]
    sponsors = spark.createDataFrame([("beta", 9, "2024-01-01"), ("acme", 2, "2019-01-01")], "name string, n long, last string")
    got = tools.sponsor_jobs(df, sponsors, SearchQuery(limit=5), "2024-06-01").collect()
    assert [(r.company, r.filings, r.sponsor_active) for r in got] == [("Beta", 9, True), ("Acme", 2, False), ("Gamma", 0, False)]
    assert [r.company for r in tools.sponsor_jobs(df, sponsors, SearchQuery(limit=5), "2024-06-01", 1, 2).collect()] == ["Beta"]
    assert tools.pool_size("resume", 2) == 120 and tools.pool_size("semantic", 50) == 500


def test_requests_and_their_cache(spark):
    df, cache = jobs(spark, [{"id": f"{k}", "level": "senior", "last_seen": "2024-05-30"} for k in range(3)]), tools.ResultCache(ttl=10, clock=lambda: now[0])
    now = [0.0]
    status, body = tools.handle({"level": "senior", "limit": 2}, df, "2024-06-01", "b1", cache)
    assert (status, body["count"]) == (200, 2) and tools.handle({"level": "senior", "limit": 2}, df, "2024-06-01", "b1", cache, body["etag"]) == (304, {})
    assert tools.handle({"semantic": True}, df, "x", "b1", cache)[0] == 501 and tools.handle({"nope": 1}, df, "x", "b1", cache)[0] == 400 and tools.handle({"limit": "2"}, df, "x", "b1", cache)[0] == 400
    ran = []
    slow = lambda: (ran.append(1), gate.wait(5))[0]
    gate = threading.Event()
    threads = [threading.Thread(target=cache.get, args=("k", slow)) for _ in range(4)]
    for t in threads:
        t.start()
    gate.set()
    for t in threads:
        t.join()
    assert len(ran) == 1
    now[0] = 11.0
    cache.get("k", slow)
    assert len(ran) == 2
    small = tools.ResultCache(size=2)
    for k in "abc":
        small.get(k, lambda: k)  # noqa: B023
    assert list(small.held) == ["b", "c"]


def test_command_line(spark, tmp_path):
    jobs(spark, [{"id": "a", "title": "dev", "last_seen": "2024-05-30"}]).write.parquet(f"{tmp_path}/j")
    out = io.StringIO()
    assert cli.main(["search", "--table", f"{tmp_path}/j", "--today", "2024-06-01", "--keywords", "dev"], spark, out) == 0
    assert json.loads(out.getvalue())["id"] == "a"
    out = io.StringIO()
    assert cli.main(["resolve", "https://jobs.lever.co/acme"], spark, out) == 0 and out.getvalue() == "lever acme\n"
    assert cli.main(["resolve", "https://example.org"], spark, io.StringIO()) == 1
    out = io.StringIO()
    assert cli.main(["sources"], spark, out) == 0 and len(out.getvalue().split()) >= 54


ADDRESSES = {
    "https://boards.greenhouse.io/acme/jobs/1": ("greenhouse", "acme"),
    "boards-api.greenhouse.io/v1/boards/acme/jobs": ("greenhouse", "acme"),
    "https://boards.greenhouse.io/v1": None,
    "https://jobs.ashbyhq.com/Acme/x": ("ashby", "Acme"),
    "https://acme.wd5.myworkdayjobs.com/de-DE/Careers/job/1": ("workday", "acme|wd5|Careers"),
    "https://apply.workable.com/acme/j/1": ("workable", "acme"),
    "https://www.recruitee.com/": None,
    "https://acme.fa.em2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1001/": ("oracle", "acme.fa.em2.oraclecloud.com|CX_1001"),
    "https://acme.taleo.net/careersection/2/jobsearch.ftl": ("taleo", "acme.taleo.net|2"),
    "https://jobs.jobvite.com/careers/Acme/job/x": ("jobvite", "acme"),
    "https://recruiting.ultipro.com/ACM1000ACME/JobBoard/0123abcd-0123-0123-0123-0123456789ab": ("ukg", "recruiting.ultipro.com|ACM1000ACME|0123abcd-0123-0123-0123-0123456789ab"),
    "https://career4.example.com/x": None,
    "": None,
    None: None,
}


def test_addresses(spark):
    df = spark.createDataFrame([(u,) for u in ADDRESSES], "url string").coalesce(1)
    got = {r.url: r.b and tuple(r.b) for r in df.select("url", resolver.resolve(F.col("url")).alias("b")).collect()}
    assert got == ADDRESSES
    registry = spark.createDataFrame([("example.com", "ex", "lever", "ex")], "domain string, key string, ats string, token string")
    known = {r.url: (r.source, r.token) for r in resolver.resolve_urls(df.where("url <> ''"), registry).collect()}
    assert known["https://career4.example.com/x"] == ("lever", "ex") and known["https://apply.workable.com/acme/j/1"] == ("workable", "acme")


def test_boards(spark):
    csv = spark.createDataFrame([(" Acme ", "t1", None, ""), ("Beta", "t2", "b.com", "Lever"), ("", "t3", None, None), ("Nil", None, None, None)], "company string, token string, domain string, ats string")
    got = {tuple(r) for r in boards.read_registry(csv, F.lit("/data/greenhouse.csv")).collect()}
    assert got == {("acme", "greenhouse", "t1", None), ("beta", "lever", "t2", "b.com")}
    now = spark.createDataFrame([("s", "1", "e1"), ("s", "2", "e2"), ("s", "3", None)], "source string, token string, etag string")
    before = spark.createDataFrame([("s", "1", "e1"), ("s", "2", "old"), ("s", "3", None)], "source string, token string, etag string")
    assert sorted(r.token for r in boards.changed_feeds(now, before).collect()) == ["2", "3"]
    missing = spark.createDataFrame([("s", "1", "a"), ("s", "1", "b"), ("s", "2", "c")], "source string, token string, id string")
    again = spark.createDataFrame([("s", "1", "b")], "source string, token string, id string")
    assert [r.id for r in boards.confirmed_relist(missing, again).collect()] == ["a"]


def test_the_first_rows_come_by_counted_cells(spark):
    ids = [None, None, *[f"{k * 7919 % 1000:03}" for k in range(1000)], *["500"] * 30]
    rows, order = spark.createDataFrame([(x,) for x in ids], "id string").repartition(3), sorted(ids, key=lambda x: x or "")
    for n in (0, 1, 2, 60, 333, 510, 1031, 1032, 10**9):
        assert [r.id for r in ordering.head_by(rows, "id", n, heap=20, cells=5).collect()] == order[:n], n


def test_vectors_are_kept_up(spark):
    rows = jobs(spark, [{"id": f"{k}", "title": f"t{k}"} for k in range(6)] + [{"id": "z", "status": "expired"}])
    want = embeddings.to_embed(rows, spark.createDataFrame([], "id string, sig string"), budget=4)
    encoded = embeddings.embed(want, lambda texts: [[float(len(t)), 1.0] for t in texts], batch=2)
    assert [r.id for r in encoded.orderBy("id").collect()] == ["0", "1", "2", "3"] and encoded.first().embedding == [2.0, 1.0]
    everything = embeddings.to_embed(rows, want.limit(0), budget=10**9)
    assert "TakeOrdered" not in everything._jdf.queryExecution().executedPlan().toString() and [r.id for r in everything.collect()] == list("012345")
    shards = [{r.id for r in embeddings.shard(rows, k, 3).collect()} for k in range(3)]
    assert sorted(x for s in shards for x in s) == sorted(r.id for r in rows.collect())
    moved = embeddings.migrate(encoded.select("id", "embedding"), rows)
    assert embeddings.to_embed(rows, moved.select("id", "sig")).count() == 2
    found = embeddings.nearest_by_matrix(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0]), ("d", None)], "id string, embedding array<double>"), {"q": [1.0, 0.0], "r": [0.0, 2.0]}, 2)
    got = {(r.query, r.id): round(r.score, 6) for r in found.collect()}
    assert got == {("q", "a"): 1.0, ("q", "c"): 0.707107, ("r", "c"): 0.707107, ("r", "a"): 0.0}


def test_a_single_shard_takes_no_digests(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    one = embeddings.shard(rows, 0, 1)
    assert "sha1" not in one._jdf.queryExecution().optimizedPlan().toString() and sorted(r.id for r in one.collect()) == ["a", "b"]
    assert embeddings.shard(rows, 1, 1).count() == 0
    big = 2**31 - 1
    got = rows.select("id", keys.sha1_mod(F.col("id"), big).alias("m")).collect()
    assert {r.id: r.m for r in got} == {None: None} | {x: int(hashlib.sha1(x.encode()).hexdigest(), 16) % big for x in "ab"}


def test_sector_model_abstains(spark):
    model = {"labels": ["A", "B"], "weights": np.eye(2).tolist(), "bias": [0, 0], "a": [4, 4], "b": [0, 0], "centroids": np.eye(2).tolist(), "least_p": 0.6, "least_margin": 0.2, "least_sim": 0.9}
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.7, 0.7]), (2, [0.0, 1.0])], "k int, f array<double>")
    assert [r.d.label for r in df.orderBy("k").select(sectors.decide(F.col("f"), model).alias("d")).collect()] == ["A", None, "B"]
    assert spark.range(1).select(sectors.domain_label(F.lit("careers.acme-bank.co.uk/x")).alias("d")).first().d == "acme-bank"


def test_documents(spark, tmp_path):
    pages = spark.createDataFrame([(1, '<tr><td class="t">Dev &amp; Ops</td><td>Reno</td></tr><tr><td class="t">Two</td></tr>'), (2, "no rows")], "k int, html string")
    rows = documents.html_rows(pages, r"(?s)<tr>.*?</tr>", {"title": r'class="t">(.*?)</td>', "place": r"</td><td>(.*?)</td>"})
    assert [(r.k, json.loads(r.payload)) for r in rows.collect()] == [(1, {"title": "Dev & Ops", "place": "Reno"}), (1, {"title": "Two"})]
    page = spark.createDataFrame([('<script id="__NEXT_DATA__" type="x">{"a": 1}</script>',), ("<script id='__NEXT_DATA__'>oops</script>",)], "html string")
    assert [r.payload for r in documents.embedded_json(page, "__NEXT_DATA__").collect()] == ['{"a": 1}']
    assert documents.surt("Jobs.Acme.com") == ("com,acme,jobs", "com,acme,jobs-")
    (tmp_path / "cv").mkdir()
    (tmp_path / "cv" / "a.txt").write_text(" python \n")
    (tmp_path / "cv" / "b.md").write_text("# sql")
    (tmp_path / "cv" / "c.bin").write_text("no")
    assert sorted(r.text for r in documents.read_resumes(spark, str(tmp_path / "cv")).collect()) == ["# sql", "python"]
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    documents.write_jsonl(df, f"{tmp_path}/l")
    (tmp_path / "l" / "bad.txt").write_text("oops\n\n")
    assert sorted(map(tuple, documents.read_jsonl(spark, f"{tmp_path}/l", "a int, b string").collect())) == [(1, "x"), (2, None)]
    for k, (n, ok) in enumerate([(5, True), (9, False), (7, True)]):
        documents.append_history(spark, f"{tmp_path}/h", {"seq": k, "total_jobs": n, "published": ok})
    assert documents.last_published(spark.read.json(f"{tmp_path}/h"), "total_jobs").first().total_jobs == 7
    assert documents.records(df, 1) == [{"a": 1, "b": "x"}] and list(documents.export(df, 5)["a"]) == [1, 2]
    documents.sidecar(spark, f"{tmp_path}/s", df, df, df)
    assert spark.read.parquet(f"{tmp_path}/s/deltas").count() == 2


def test_work_keeps_errors_as_rows(spark):
    def half(x):
        if x % 2:
            raise ValueError("odd")
        return x // 2

    got = {r.id: (r.result, r.error) for r in documents.work(spark.range(4), half, "id", attempts=2).collect()}
    assert got == {0: ("0", None), 1: (None, "ValueError: odd"), 2: ("1", None), 3: (None, "ValueError: odd")}


def test_store_keeps_what_readers_see(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    p = postings(spark, [{"company": f"C{k}", "sector": "AI/ML"} for k in range(4)])
    store.publish(changes.to_rows(p, "b1", "2024-01-01"), "b1", more={"vectors": spark.range(3)})
    held = store.table("jobs")
    assert store.verify() and store.table("vectors").count() == 3 and store.sector("ai-ml").count() == 4
    store.publish(changes.to_rows(p.where("ord < 3"), "b1", "2024-01-02"), "b1")
    assert held.count() == 4 and store.table("jobs").count() == 3 and store.verify()
    assert fingerprint(held.orderBy("id")) == fingerprint(held.repartition(3)) != fingerprint(held.limit(3))
    store.write_text("manifest.json", json.dumps(store.manifest() | {"schema_version": 99}))
    with pytest.raises(ValueError, match="schema 99"):
        store.table("jobs")


def test_measures_of_builds(spark):
    rows = spark.createDataFrame([("s", "z first", 1, 1), ("s", "a later", 0, 2), ("s", "a later", 0, 3), ("s", None, 5, 4), ("t", None, 7, 5)], "source string, error string, rows long, at int")
    got = {r.source: (r.boards, r.failed, r.rows, r.errors) for r in aggregates.health(rows, "at").collect()}
    assert got == {"s": (4, 3, 6, "z first; a later"), "t": (1, 0, 7, "")}
    numbers = spark.createDataFrame([(100.0, 104.0), (100.0, 120.0), (None, 1.0)], "g double, p double")
    assert tuple(aggregates.numeric_errors(numbers, "g", "p", 0.05).first()) == (2, 12.0, 0.5)
    found = spark.createDataFrame([("w", "a", "X"), ("w", "b", "Y"), ("w", "c", "Z")], "origin string, key string, sector string")
    gold = spark.createDataFrame([("a", "X"), ("b", "X")], "key string, sector string")
    assert tuple(aggregates.source_accuracy(found, gold).first()) == ("w", 2, 0.5)
    part = spark.createDataFrame([("s", 2, 1)], "source string, checked long, expired long")
    assert tuple(aggregates.shard_stats([part, part]).first()) == ("s", 4, 2)
    assert "- active jobs: 1,234" in aggregates.status_markdown({"active_jobs": 1234}, [("acme", 5)])


def test_builds_from_a_stream(spark, tmp_path):
    beats = []
    listener = state.Heartbeat(beats.append)
    spark.streams.addListener(listener)
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, v int").write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("id string, v int").parquet(f"{tmp_path}/in")
    state.build_from_stream(read(), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
    spark.createDataFrame([("b", 9), ("c", 3)], "id string, v int").write.mode("append").parquet(f"{tmp_path}/in")
    state.build_from_stream(read(), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
    assert sorted((r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 1), ("b", 2), ("c", 3)]
    spark.streams.removeListener(listener)
