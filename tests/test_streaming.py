"""Streams: the watch loop across runs, and the streaming timeout."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quirecheck.operators import checks as K
from quirecheck.streaming import watch as Y
from tests.support import session

SCHEMA = "seq long, path string, sha256 string, exit long"


@pytest.fixture(scope="module")
def spark():
    return session()


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_watch_across_runs(spark, tmp_path):
    inbox, journal, state = (str(tmp_path / n) for n in ("inbox", "journal", "state"))

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(inbox)
        worst = Y.watch_once(stream, lambda pending: pending, journal, state).first().exit
        return worst, sorted((r.seq, r.path) for r in Y.journal(spark, journal).collect())

    arrive(spark, inbox, [(1, "a", "h1", 0), (2, "b", "h2", 2), (3, "a", "h3", 1)])
    assert run() == (2, [(2, "b"), (3, "a")])
    # The same bytes again are skipped, changed bytes are validated, and old verdicts still count.
    arrive(spark, inbox, [(4, "a", "h3", 2), (5, "b", "h5", 0), (6, "c", "h1", 0)])
    assert run() == (1, [(2, "b"), (3, "a"), (5, "b"), (6, "c")])
    assert run()[0] == 1


def test_timeout_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = "key long, seq long, ts timestamp"

    def source(name, rows):
        folder = str(tmp_path / name)
        made = spark.createDataFrame([(k, s, t0 + dt.timedelta(seconds=x)) for k, s, x in rows], schema)
        made.coalesce(1).write.parquet(folder)
        return spark.readStream.schema(schema).parquet(folder)

    starts = source("starts", [(1, 1, 0), (2, 2, 0), (3, 3, 10), (9, 9, 100000)])
    finishes = source("finishes", [(1, 1, 30), (2, 2, 90), (9, 9, 100001)])
    late = Y.timeout_stream(starts, finishes, 60, "10 seconds")
    journal = str(tmp_path / "journal")
    Y.record_timeouts(late, journal, str(tmp_path / "cp")).awaitTermination()
    rows = [tuple(r) for r in Y.journal(spark, journal).select("seq", "path", "sha256", "exit", "origin").collect()]
    assert sorted(rows) == [(2, "2", "", 2, "timeout"), (3, "3", "", 2, "timeout")]


def test_reports_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Y, "COMPACT_EVERY", 2)
    inbox, journal, state, reports = (str(tmp_path / n) for n in ("inbox", "journal", "state", "reports"))
    validate = Y.checked([K.Check("Short", F.length("sha256") < 3, F.lit("long hash"))], "s")
    for n in range(5):  # one batch each; path p0 comes again with the same bytes, the others change
        arrive(spark, inbox, [(10 * n, "p0", "h", 0), (10 * n + 1, f"p{1 + n % 2}", "x" * n, 0)])
        stream = spark.readStream.schema(SCHEMA).parquet(inbox)
        Y.watch(stream, validate, journal, state, reports_path=reports).awaitTermination()
    entries = sorted((r.batch, r.path, r.exit) for r in Y.journal(spark, journal).collect())
    assert entries == [(0, "p0", 0), (0, "p1", 0), (1, "p2", 0), (2, "p1", 0), (3, "p2", 2), (4, "p1", 2)]
    assert {r.upto for r in spark.read.parquet(journal + "-latest").collect()} == {1, 3}
    kept = {(r.batch, r.path): json.loads(r.report)["status"] for r in spark.read.parquet(reports).collect()}
    assert kept == {(b, p): "FAIL" if e else "PASS" for b, p, e in entries}


def test_settled_arrivals_leave_open_files_alone(spark, tmp_path):
    schema = "seq long, path string, sha256 string, ts timestamp"
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(1, "a", "h1", 0), (2, "a", "h2", 5), (3, "b", "h3", 900)]
    spark.createDataFrame([(s, p, h, t0 + dt.timedelta(seconds=x)) for s, p, h, x in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = Y.settled_arrivals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "10 seconds", "0 seconds")
    journal = str(tmp_path / "journal")
    Y.watch(stream, lambda pending: pending.withColumn("exit", F.lit(0).cast("long")), journal, str(tmp_path / "state")).awaitTermination()
    assert [(r.path, r.sha256) for r in Y.journal(spark, journal).collect()] == [("a", "h2")]
