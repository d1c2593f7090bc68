"""Reading folders, storing, whole scans, streams."""

import pytest
from pyspark.sql import functions as F

from fernsift.operators import findings as N
from fernsift.plans import scan as P
from fernsift.sources import store as W
from fernsift.sources import submissions as B
from fernsift.streaming import ingest as I
from tests.test_texts import TOKEN

CODE = (
    "function handler(req) {\n  const input = req.query.cmd;\n  el.innerHTML = input;\n}\n"
    f'const t = "{TOKEN}";\naddEventListener("message", e => {{ eval(e.data) }});\n'
    "fetch('/api/' + input);\nconst z = input;\ndocument.write(z);\n"
)


def test_source_tree(spark, tmp_path):
    for name in ("a.js", "b.txt", "sub/c.tsx", "node_modules/d.js", "sub/.git/e.mjs", "dist/f.ts", "builds/g.jsx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"ok \xff\xfe\n\xc3\xa9")
    got = B.read_source_tree(spark, str(tmp_path)).collect()
    assert sorted(r.file.rsplit("/", 1)[1] for r in got) == ["a.js", "c.tsx", "g.jsx"]
    assert {r.text for r in got} == {"ok \né"}
    named = spark.createDataFrame([("a.TS",), ("b",), ("x.tsx",), ("d.e/f",)], "n STRING")
    assert [r[0] for r in named.select(B.tag_language(F.col("n"))).collect()] == [
        "typescript", "javascript", "tsx", "javascript"]


def test_live_scan(sources):
    found = {(r.type, r.line): r for r in P.scan(sources(f=CODE)).collect()}
    flow = found["XSS_HTML_TEXT", 3]
    assert (flow.source, flow.sink, flow.confidence, flow.path) == ("req.query", "innerHTML", "HIGH", ["input"])
    assert found["SECRET_GITHUB_TOKEN", 5].confidence == "LOW"
    assert found["POSTMESSAGE_NO_ORIGIN_CHECK", 6].severity == "CRITICAL"
    assert found["CSPT_FETCH_API", 7].source == "input"
    assert found["XSS_HTML_TEXT", 9].path == ["z", "input"]
    assert ("TS_DOCUMENT_WRITE", 9) in found


def test_earlier_scan(sources):
    found = P.scan_v2(sources(f=CODE, g="const role = 'x';\n", h="")).collect()
    kinds = {(r.file, r.line, r.type) for r in found}
    assert {("f", 3, "XSS_INNERHTML_VAR"), ("f", 5, "SECRET_GITHUB_PAT"), ("f", 3, "TAINT_FLOW_HIGH"),
            ("f", 7, "SSRF_CHAIN")} <= kinds
    assert [r.evidence for r in found if r.file == "g"] == ["\U0001f50e 'role': const role = 'x';"]
    assert not [k for k in kinds if k[0] == "h"]
    masked = next(r for r in found if r.type == "SECRET_GITHUB_PAT")
    assert "ghp_aB3d...cC4f | " in masked.evidence


def test_dedup_is_idempotent(sources):
    found = P.scan(sources(f=CODE))
    assert N.dedup_findings(found).count() == found.count()


@pytest.fixture
def submitted(spark):
    return spark.createDataFrame(
        [("a.example", "x.js", CODE), ("a.example", "copy.js", CODE), ("b.example", "y.js", "eval(1)")], B.SUBMISSION)


def counts(store):
    return {n: store.read(n).count() for n in W.TABLES}


def test_job_is_repeatable(spark, submitted, tmp_path):
    store = W.Store(spark, str(tmp_path / "store"))
    assert counts(store) == dict.fromkeys(W.TABLES, 0)
    P.run_job(submitted, store, "one", engine="v2")
    first = counts(store)
    assert (first["targets"], first["source_files"], first["assets"]) == (2, 2, 3)
    P.run_job(submitted, store, "one", engine="v2")
    assert counts(store) == first
    P.run_job(submitted, store, "two", engine="v2")
    assert counts(store) == {**first, "assets": 6, "findings": 2 * first["findings"]}
    # both copies of the text have the same findings
    per_url = W.target_findings(store.read("findings"), store.read("assets")).groupBy("url").count().collect()
    by_url = {r["url"]: r["count"] for r in per_url}
    assert by_url["x.js"] == by_url["copy.js"] > by_url["y.js"] > 0
    text = W.fetch_source(store.read("source_files"), store.read("assets"), store.read("targets"), "a.example", "x.js")
    assert text.first().content == CODE
    gone = store.read("findings").first().finding_id
    W.delete_from(store, store.read("findings").filter(F.col("finding_id") == gone).select("finding_id"))
    assert store.read("findings").filter(F.col("finding_id") == gone).count() == 0
    target = store.read("targets").filter("domain = 'a.example'").first().target_id
    W.clear_target_from(store, target)
    assert {r["url"] for r in W.target_findings(store.read("findings"), store.read("assets")).collect()} == {"y.js"}
    W.wipe(store)
    assert counts(store) == {"targets": 0, "source_files": 2, "assets": 0, "findings": 0}
    P.run_job(submitted, store, "three", engine="v2")
    assert counts(store) == first


def test_deleted_rows_come_back_when_written_again(spark, submitted, tmp_path):
    store = W.Store(spark, str(tmp_path / "store"))
    P.run_job(submitted, store, "one", engine="v2")
    first, ids = counts(store), store.read("findings").select("finding_id")
    W.delete_from(store, ids)
    W.delete_from(store, ids)  # nothing is left to delete
    assert counts(store) == {**first, "findings": 0}
    P.run_job(submitted, store, "one", engine="v2")
    assert counts(store) == first
    W.delete_from(store, spark.createDataFrame([(None,), (-1,)], "finding_id BIGINT"))
    assert counts(store) == first


def test_lookups_read_the_buckets_they_touch(spark, tmp_path):
    """What one text is compared with is one bucket, whatever else is stored; the prefix is that of the stored rows."""
    made = spark.range(3000).selectExpr("concat('text ', id) AS code", "'d' AS domain", "'f' AS filename")
    texts = W.hashed(made).select("hash", F.col("code").alias("content"), F.current_timestamp().alias("created_at"))
    store = W.Store(spark, str(tmp_path / "store"), prefix=1)
    empty = texts.select("hash").limit(0)
    assert store.near("source_files", texts.select("hash")).count() == 0
    store.append("source_files", texts)
    again = W.Store(spark, store.path)  # 256 buckets by default, but the table has 16
    one = made.limit(1)
    near = again.near("source_files", W.hashed(one).select("hash"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert near.select(F.substring("hash", 1, 1)).distinct().count() == 1 and 100 < near.count() < 300
    assert W.store_sources(one, near).count() == 0 and again.near("source_files", empty).count() == 0
    some = made.limit(50).unionByName(made.limit(1).withColumn("code", F.lit("new"))).withColumn("code", F.col("code"))
    fresh = W.store_sources(some, again.near("source_files", W.hashed(some).select("hash"))).collect()
    assert [r.content for r in fresh] == ["new"]
    nulls = spark.createDataFrame([(None,)], "hash STRING")
    assert again.near("source_files", nulls).count() == 0
    deep = W.Store(spark, str(tmp_path / "deep"))  # buckets as 00, 1e, 1d stay texts
    deep.append("source_files", texts)
    assert deep.near("source_files", texts.select("hash")).count() == deep.read("source_files").count() == 3000
    assert deep.read("source_files").join(texts, ["hash", "content"]).count() == 3000 and deep.prefix("source_files") == 2


def test_metrics_write_the_buckets_that_change(spark, tmp_path):
    """A batch writes the buckets of its targets, a repeated one changes nothing, null is a target like others."""
    out, schema = str(tmp_path / "m"), "target_id LONG, critical LONG"
    put = lambda rows, n: I._merge_metrics(spark.createDataFrame(rows, schema), n, out, ["target_id"])
    now = lambda: {r.target_id: r.critical for r in I.latest_metrics(spark, out).collect()}
    put([], 0)
    assert now() == {}
    put([(n, 1) for n in range(500)] + [(None, 1)], 1)
    put([(7, 2), (None, 2)], 2)
    want = {n: 1 for n in range(500)} | {7: 2, None: 2}
    assert now() == want and len(I._versions(spark, out)) == I.BUCKETS
    assert sum(2 in batches for batches in I._versions(spark, out).values()) <= 2
    put([(7, 2), (None, 2)], 2)
    assert now() == want and I.latest_metrics(spark, out).count() == 501
    for n in range(3, 7):
        put([(7, n)], n)
    assert now() == want | {7: 6} and max(map(len, I._versions(spark, out).values())) == 2
    assert len(I._batches(spark, out)) <= 4


def test_stream_equals_batch(spark, submitted, tmp_path):
    submitted.coalesce(1).write.json(str(tmp_path / "in"))
    streamed, batch = (W.Store(spark, str(tmp_path / n)) for n in ("streamed", "batch"))
    stream = I.read_submission_stream(spark, str(tmp_path / "in"))
    I.stream_ingest(stream, streamed, str(tmp_path / "log"), engine="v2").awaitTermination()
    P.run_job(submitted, batch, "batch-0", engine="v2")
    for name in W.TABLES:
        assert sorted(map(tuple, streamed.read(name).drop("created_at").collect())) == sorted(
            map(tuple, batch.read(name).drop("created_at").collect()))
    metrics = I.stream_target_metrics(
        I.read_finding_stream(spark, streamed), str(tmp_path / "m"), str(tmp_path / "log2"), ["asset_id"])
    metrics.awaitTermination()
    live = sorted(map(tuple, I.latest_metrics(spark, str(tmp_path / "m")).collect()))
    assert live == sorted(map(tuple, N.target_metrics(batch.read("findings"), ["asset_id"]).collect()))


def test_report(spark, sources, tmp_path):
    found = P.scan(sources(f=CODE))
    W.write_report(found, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == found.count()
    assert N.severity_gate(found).first().failed
