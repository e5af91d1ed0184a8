"""Arrivals as a stream: settling bursts, validating what has not been validated yet, reports and journal."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quirecheck.operators import incremental as J, reports as R
from quirecheck.operators.checks import Check, identified, run_checks
from quirecheck.operators.unions import union_all

JOURNAL_SCHEMA = "seq long, path string, sha256 string, exit long"
JOURNAL = [c.split()[0] for c in JOURNAL_SCHEMA.split(", ")]
#: Batches after which the last entry of every path is written out, so later batches read that and what came since.
COMPACT_EVERY = 16


def settled_stream(arrivals: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Bursts of a streaming table of arrivals (path, ts, seq, sha256), each emitted once it is over.

    The watermark decides when: a burst ends when no later write can join it.
    """
    return J.settled(arrivals.withWatermark("ts", lateness), gap)


def timeout_stream(starts: DataFrame, finishes: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """Streaming form of the timeout check: a finding (key, seq, ...) for every start without a finish in reach.

    It is told once the watermark says that no finish can come in time.
    """
    begun = starts.withWatermark("ts", lateness).select(F.col("key"), F.col("seq"), F.col("ts").alias("begun"))
    done = finishes.withWatermark("ts", lateness).select(F.col("key").alias("done_key"), F.col("ts").alias("done"))
    within = (
        (F.col("key") == F.col("done_key"))
        & (F.col("done") >= F.col("begun"))
        & (F.col("done") <= F.col("begun") + F.expr(f"interval {seconds} seconds"))
    )
    late = begun.join(done, within, "left_outer").filter("done is null")
    return late.select("key", "seq", *J.timeout_finding(seconds))


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Entries with their origin and the batch that wrote them; a journal that does not exist yet is empty."""
    schema = f"{JOURNAL_SCHEMA}, origin string, batch long"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _known(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """What earlier batches recorded: the last compacted state, and the batches since. A replayed batch does not see itself."""
    compacted, upto = f"{path}-latest", -1
    entries = journal(spark, path).filter((F.col("origin") == "watch") & (F.col("batch") < batch_id))
    if _exists(spark, compacted):
        latest = spark.read.schema(f"{JOURNAL_SCHEMA}, upto long").parquet(compacted).filter(F.col("upto") < batch_id)
        upto = latest.agg(F.max("upto")).first()[0]
        upto = -1 if upto is None else upto
        return union_all(latest.filter(F.col("upto") == upto).select(*JOURNAL), entries.filter(F.col("batch") > upto).select(*JOURNAL))
    return entries.select(*JOURNAL)


def watch(
    arrivals: DataFrame,
    validate: Callable[[DataFrame], DataFrame],
    journal_path: str,
    checkpoint_path: str,
    once: bool = True,
    reports_path: str | None = None,
) -> StreamingQuery:
    """Validate every arrival (seq, path, sha256, ...) the journal does not know, and record the verdict.

    ``validate`` turns pending arrivals into rows with an ``exit`` and, where reports are to be kept, their
    ``report``. Each batch writes its own folder of the reports and then of the journal, replacing them when
    the batch is replayed, so a crash records nothing twice and nothing without its report.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = _known(spark, journal_path, batch_id)
        last = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), "seq").alias("r")).select("r.*")
        verdicts = validate(J.journal_pending(last, earlier))
        if reports_path is not None:
            folder = f"{reports_path}/batch={batch_id}"
            verdicts.select("path", "seq", "sha256", "exit", "report").write.mode("overwrite").parquet(folder)
            verdicts = spark.read.parquet(folder)
        verdicts.select(*JOURNAL).write.mode("overwrite").parquet(f"{journal_path}/origin=watch/batch={batch_id}")
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            every = _known(spark, journal_path, batch_id + 1)
            last = every.groupBy("path").agg(F.max_by(F.struct(*JOURNAL), "seq").alias("r")).select("r.*")
            last.write.mode("overwrite").parquet(f"{journal_path}-latest/upto={batch_id}")

    writer = arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if once else writer).start()


def checked(checks: Sequence[Check], script: str, contents: Callable[[DataFrame], DataFrame] = lambda pending: pending) -> Callable[[DataFrame], DataFrame]:
    """A ``validate`` for :func:`watch` that runs a catalogue of checks and keeps a JSON report of every file.

    ``contents`` adds to the pending arrivals the columns that the checks read.
    """

    def validate(pending: DataFrame) -> DataFrame:
        docs = contents(pending).withColumn("doc_id", F.col("path"))
        findings = identified(run_checks(docs, list(checks)))
        rolled = R.report_rollup(docs.select("doc_id", F.lit(0).cast("bigint").alias("page_count")), findings)
        text = R.json_reports(rolled, findings, script).withColumnRenamed("json", "report")
        verdict = rolled.select("doc_id", R.exit_code(F.col("error_count"), F.col("warning_count")).alias("exit")).join(text, "doc_id")
        return pending.drop("exit").join(verdict.withColumnRenamed("doc_id", "path"), "path")

    return validate


def settled_arrivals(arrivals: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Settled bursts as arrivals for :func:`watch`: a file that is still being written is left alone."""
    return settled_stream(arrivals, gap, lateness).select(F.unix_micros("end").alias("seq"), "path", "sha256")


def record_timeouts(findings: DataFrame, journal_path: str, checkpoint_path: str, once: bool = True) -> StreamingQuery:
    """Journal every timeout of :func:`timeout_stream` as a rejection; without a hash, so the file is tried again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("seq", F.col("key").cast("string").alias("path"), F.lit("").alias("sha256"), F.lit(2).cast("bigint").alias("exit"))
        rows.write.mode("overwrite").parquet(f"{journal_path}/origin=timeout/batch={batch_id}")

    writer = findings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if once else writer).start()


def watch_once(
    arrivals: DataFrame, validate: Callable[[DataFrame], DataFrame], journal_path: str, checkpoint_path: str, reports_path: str | None = None
) -> DataFrame:
    """Process what is there, then the worst exit code over new and journalled files."""
    watch(arrivals, validate, journal_path, checkpoint_path, reports_path=reports_path).awaitTermination()
    return J.batch_verdict(J.journal_latest(journal(arrivals.sparkSession, journal_path)))
