"""Ingest of written traces: lines are parsed once and lie in files of a bounded number of lines."""

from pyspark.sql import functions as F

from trailgrain.plans import ingests
from trailgrain.sources import cdm
from trailgrain.sources.driver_tables import event_edges


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"datum": {"x.Subject": {"uuid": "p1", "cmdLine": "sh"}}}\n{"a"\nnull\n3\n')
    recs = cdm.records(cdm.read_lines(spark, str(tmp_path)))
    assert plan(recs).count("try_parse_json(") + plan(recs).count("parseJson") <= 1
    assert [r.kind for r in recs.select("kind").collect()] == ["Subject"]


def test_ingested_edges_do_not_parse_again(spark, monkeypatch):
    monkeypatch.setattr(ingests, "LINES_A_FILE", 100)
    read, lines = [], cdm.read_lines
    monkeypatch.setattr(cdm, "read_lines", lambda s, path: (read.append(path), lines(s, path))[1])
    edges = event_edges(spark, "/root/testdata/sf0.001")
    found = ingests.ingested_edges(edges)
    assert "text" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == edges.count() and len(read) == 1
    most = spark.read.text(read[0]).groupBy(F.col("_metadata.file_path")).count().agg(F.max("count"), F.count("*")).first()
    assert most[0] <= 100 and most[1] > 10
