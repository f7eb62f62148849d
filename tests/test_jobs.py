"""The jobs: two runs over growing input, failures half-way, reruns, settings, and their SQL."""

import json

import duckdb
import pytest

from jobs import call_graph_report, redact_corpus
from jobs.common import settings

SF = "/root/testdata/sf0.001"
TABLES = "part supplier orders customer lineitem events documents".split()
SECRET = "AK" + "IA" + "ABCDEFGH12345678"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("job", [redact_corpus, call_graph_report])
def test_query_matches_sql(spark, duck, job):
    df = job.query(spark, SF)
    want = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({job.ORACLE_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want


def _add(spark, place, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, changed string").coalesce(1).write.mode("append").parquet(place)


def _state(spark, output, source, by):
    rows = redact_corpus.texts(spark, output, spark.read.parquet(source).schema, by)
    told = redact_corpus.report(spark, output, by)
    return sorted(map(repr, rows.select("doc_id", "source", "lang", "text", "labels", "changed").collect())), sorted(map(repr, told.collect()))


FIRST = [(1, f"key {SECRET} end", "en", "a", "x"), (2, None, None, None, "x"), (3, "", "", "a", "x"), (4, "plain", "01", "b", "x")]
SECOND = [(5, f"{SECRET} {SECRET}", "en", "b", "x"), (1, "again", "en", "a", "x"), (4, "plain", "01", "b", "x")]


def test_redaction_takes_only_what_is_new(spark, tmp_path):
    source, output, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    by = redact_corpus.Settings(files_per_batch=1)
    _add(spark, source, FIRST)
    assert redact_corpus.run(spark, source, output, mark, by) == {"batches": 1, "rows": 4, "changed": 1}
    first = _state(spark, output, source, by)
    assert redact_corpus.run(spark, source, output, mark, by)["rows"] == 0 and _state(spark, output, source, by) == first
    _add(spark, source, SECOND[:1])
    _add(spark, source, SECOND[1:])
    assert redact_corpus.run(spark, source, output, mark, by) == {"batches": 2, "rows": 3, "changed": 1}
    rows, told = _state(spark, output, source, by)
    assert len(rows) == 7 and set(first[0]) <= set(rows) and SECRET not in "".join(rows)
    assert {r.lang for r in redact_corpus.texts(spark, output, spark.read.parquet(source).schema, by).collect()} == {"en", None, "", "01"}
    counts = {(r.source, r.label): (r.documents, r.changed) for r in redact_corpus.report(spark, output, by).collect()}
    assert counts == {("a", ""): (3, 1), ("a", "aws-akia"): (1, 1), ("b", ""): (3, 1), ("b", "aws-akia"): (1, 1), (None, ""): (1, 0)}


def test_redaction_of_growing_copies_equals_one_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by, grown, whole = redact_corpus.Settings(), f"{tmp_path}/grown", f"{tmp_path}/whole"
    for part in range(2):
        docs.filter(f"doc_id % 2 = {part}").write.mode("append").parquet(f"{grown}/in")
        redact_corpus.run(spark, f"{grown}/in", f"{grown}/out", f"{grown}/mark", by)
    docs.write.parquet(f"{whole}/in")
    redact_corpus.run(spark, f"{whole}/in", f"{whole}/out", f"{whole}/mark", by)
    assert _state(spark, f"{grown}/out", f"{grown}/in", by) == _state(spark, f"{whole}/out", f"{whole}/in", by)


def test_redaction_goes_on_after_a_failed_batch(spark, tmp_path, monkeypatch):
    source, output, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    by = redact_corpus.Settings()
    _add(spark, source, FIRST)

    def broken(*_):
        raise OSError("disk full")

    with monkeypatch.context() as m, pytest.raises(Exception, match="disk full"):
        m.setattr(redact_corpus, "findings", broken)
        redact_corpus.run(spark, source, output, mark, by)
    assert redact_corpus.run(spark, source, output, mark, by)["rows"] == 4
    rows, told = _state(spark, output, source, by)
    assert len(rows) == 4 and len(told) == 4


def test_output_and_checkpoint_belong_together(spark, tmp_path):
    source, output = f"{tmp_path}/in", f"{tmp_path}/out"
    _add(spark, source, FIRST)
    redact_corpus.run(spark, source, output, f"{tmp_path}/mark")
    with pytest.raises(RuntimeError, match="belong together"):
        redact_corpus.run(spark, source, output, f"{tmp_path}/other")


def test_empty_source_with_a_stated_schema(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(source)
    assert redact_corpus.run(spark, source, f"{tmp_path}/out", f"{tmp_path}/mark", redact_corpus.Settings(schema="doc_id long, text string, lang string, source string"))["rows"] == 0


def test_report_follows_its_settings_and_reruns(spark, tmp_path):
    by = call_graph_report.Settings(targets=3, depth=1, buckets=4)
    first = call_graph_report.run(spark, SF, str(tmp_path), by)
    rows = sorted(map(repr, call_graph_report.summary(spark, str(tmp_path)).collect()))
    assert call_graph_report.run(spark, SF, str(tmp_path), by) == first and first["targets"] == len(rows) == 3
    assert sorted(map(repr, call_graph_report.summary(spark, str(tmp_path)).collect())) == rows
    assert all(r.transitive_count == 0 for r in call_graph_report.summary(spark, str(tmp_path)).collect())
    edges = spark.read.parquet(f"{tmp_path}/edges")
    assert edges.groupBy("to_name").agg({"bucket": "min"}).count() == edges.select("to_name", "bucket").distinct().count() and edges.select("bucket").distinct().count() == 4


def test_settings_files(tmp_path):
    assert settings(redact_corpus.Settings, "jobs/redact_corpus.json") == redact_corpus.Settings()
    assert settings(call_graph_report.Settings, "jobs/call_graph_report.json") == call_graph_report.Settings()
    (tmp_path / "c.json").write_text(json.dumps({"nothing": 1}))
    with pytest.raises(ValueError, match="nothing"):
        settings(redact_corpus.Settings, str(tmp_path / "c.json"))


def test_texts_without_a_label_stay_and_others_are_masked(spark):
    from pyspark.sql import functions as F

    from loomgraph.functions.redact import detect_secrets, redact_secrets

    texts = [None, "", "plain sk- text", "AK" + "IA" + "ABCDEFGH12345678 and '" + "b" * 41 + "'", "ghp_" + "a" * 30, '"' + "c" * 40 + "'", "é" + "sk-" + "d" * 20]
    rows = spark.createDataFrame([(k, t, "en", "web") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = redact_corpus.masked(rows, redact_corpus.Settings()).orderBy("doc_id").collect()
    want = rows.select(redact_secrets(F.col("text")).alias("r"), detect_secrets(F.col("text")).alias("d"), "doc_id").orderBy("doc_id").collect()
    assert [(g.text, ",".join(g.labels), g.changed) for g in got] == [(w.r, w.d or "", w.r != t) for w, t in zip(want, texts, strict=True)]
    assert [g.changed for g in got] == [False, False, False, True, True, False, True]


def test_report_counts_callers_beyond_500_calls(spark, duck, tmp_path):
    call_graph_report.run(spark, SF, str(tmp_path), call_graph_report.Settings(depth=1, buckets=4))
    told = {r.id: r.direct_count for r in call_graph_report.summary(spark, str(tmp_path)).filter("kind = 'class'").collect()}
    want = dict(duck.sql("SELECT 'supp:' || l_suppkey, count(DISTINCT l_orderkey) FROM lineitem GROUP BY 1").fetchall())
    assert told and told == {k: want[k] for k in told} and max(told.values()) > 500
