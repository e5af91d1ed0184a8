"""Batches that continue earlier ones: the journal, verdicts of a batch, timeouts, golden reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quirecheck.operators.checks import ERROR
from quirecheck.operators.unions import union_all
from quirecheck.sources.checkpoints import checkpointed

# The fields of a report that a recording is compared by, in the order of their differences.
REPORT_FIELDS = ["schema_version", "status", "error_count", "warning_count", "info_count", "total_pages_analyzed", "profile"]
DIAGNOSTIC = ["id", "severity", "check_name", "message"]


# ---- journal ----


def journal_latest(journal: DataFrame) -> DataFrame:
    """The last entry of each path in an append-only journal (seq, path, sha256, exit)."""
    last = F.max_by(F.struct("sha256", "exit"), "seq")
    return journal.groupBy("path").agg(last.alias("last")).select("path", "last.sha256", "last.exit")


def journal_pending(arrivals: DataFrame, journal: DataFrame) -> DataFrame:
    """Arrivals to validate: those whose path and bytes are not the journal's. An empty hash never matches."""
    done = journal_latest(journal).filter(F.col("sha256") != "").select("path", "sha256")
    return arrivals.join(done, ["path", "sha256"], "left_anti")


def journal_resume(arrivals: DataFrame, journal: DataFrame, validated: DataFrame) -> DataFrame:
    """(path, exit): verdicts just reached, and the journal's for the paths that were skipped."""
    done = journal_latest(journal).filter(F.col("sha256") != "")
    skipped = done.join(arrivals.select("path", "sha256").distinct(), ["path", "sha256"], "left_semi")
    return union_all(validated.select("path", "exit"), skipped.select("path", "exit"))


def batch_verdict(verdicts: DataFrame) -> DataFrame:
    """The worst exit code of a batch; an empty batch is clean."""
    return verdicts.agg(F.coalesce(F.max("exit"), F.lit(0).cast("bigint")).alias("exit"))


def fail_fast(files: DataFrame, batch: list[str] | None = None) -> DataFrame:
    """Files of each batch in path order, up to and including the first with exit 2 or more.

    "Before the first error" needs only the least failing path, so no batch is ever sorted.
    """
    failing = F.min(F.when(F.col("exit") >= 2, F.col("path"))).alias("_stop")
    if not batch:
        stop = files.agg(failing).scalar()
        return files.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("path") <= F.col("_stop"))).drop("_stop")
    stops = files.groupBy(*batch).agg(failing).filter(F.col("_stop").isNotNull())
    return files.join(stops, batch, "left").filter(F.col("_stop").isNull() | (F.col("path") <= F.col("_stop"))).drop("_stop")


# ---- settling and timeouts ----


def settled(arrivals: DataFrame, gap: str) -> DataFrame:
    """One row per burst of a path: when it ended, how many writes it had, and the last content."""
    window = F.session_window("ts", gap)
    return arrivals.groupBy("path", window.alias("burst")).agg(
        F.count("*").alias("writes"), F.max_by("sha256", F.struct("ts", "seq")).alias("sha256")
    ).select("path", F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "writes", "sha256")


def timeout_findings(starts: DataFrame, finishes: DataFrame, seconds: int) -> DataFrame:
    """A finding for every start (key, seq, ts) of a key without a finish within the limit.

    Time is cut into slots as long as the limit. A finish later in the slot of the start is always
    in reach, and of the next slot only the first finish matters, so two numbers per key and slot
    answer every start and no pairs are formed.
    """
    at = F.unix_micros("ts")
    span = seconds * 1_000_000
    slot = F.floor(at / span)
    reach = (
        finishes.select("key", at.alias("done"), slot.alias("at_slot"), F.explode(F.array(slot, slot - 1)).alias("slot"))
        .groupBy("key", "slot")
        .agg(
            F.max(F.when(F.col("at_slot") == F.col("slot"), F.col("done"))).alias("last_here"),
            F.min(F.when(F.col("at_slot") > F.col("slot"), F.col("done"))).alias("first_next"),
        )
    )
    in_time = (F.col("last_here") >= at) | (F.col("first_next") <= at + span)
    late = starts.withColumn("slot", slot).join(reach, ["key", "slot"], "left").filter(~F.coalesce(in_time, F.lit(False)))
    return late.select("key", "seq", *timeout_finding(seconds))


def timeout_finding(seconds: int) -> list[Column]:
    """Severity, check name and message of a timeout."""
    # Fixed value: the message.
    message = F.lit(f"analysis did not finish within {seconds}s and was killed")
    return [F.lit(ERROR).alias("severity"), F.lit("timeout").alias("check_name"), message.alias("message")]


# ---- golden reports ----


def golden_record(reports: DataFrame, path: Column) -> DataFrame:
    """What is recorded: the report with its input reduced to the file name."""
    return reports.withColumn("input_file", F.regexp_extract(path, r"[^/\\]*\z", 0))


def not_recorded(reports: DataFrame, recorded: DataFrame) -> DataFrame:
    """Cases without a recording, which fail."""
    return reports.join(recorded.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", F.lit("no recorded report").alias("difference")
    )


def _fingerprinted(findings: DataFrame, out: str) -> DataFrame:
    """(doc_id, out): count and sums of two hashes of a report's findings, whatever their order."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *DIAGNOSTIC, *_nulls(DIAGNOSTIC)).cast("decimal(20,0)")).alias(f"h{seed}") for seed in (1, 2)]
    return findings.groupBy("doc_id").agg(F.count("*").alias("n"), *sums).select("doc_id", F.struct("n", "h1", "h2").alias(out))


def _nulls(columns: Sequence[str]) -> list[Column]:
    # A null is skipped by the hash, so that it would equal one in another column.
    return [F.col(c).isNull() for c in columns]


def changed_reports(expected_findings: DataFrame, actual_findings: DataFrame) -> DataFrame:
    """(doc_id): documents whose findings differ as multisets.

    Findings are reduced to one row per document before they are shuffled. Two different reports pass for
    equal with a chance of 2^-128.
    """
    e, a = _fingerprinted(expected_findings, "e"), _fingerprinted(actual_findings, "a")
    return e.join(a, "doc_id", "full").filter("not e <=> a").select("doc_id")


def golden_diff(
    expected: DataFrame,
    actual: DataFrame,
    expected_findings: DataFrame,
    actual_findings: DataFrame,
    expected_run: DataFrame | None = None,
    actual_run: DataFrame | None = None,
    fields: Sequence[str] = REPORT_FIELDS,
) -> DataFrame:
    """(doc_id, difference): report fields that changed, findings that are missing or unexpected.

    Of ``fields`` those are compared that either side has; a side without one counts as null. Findings are
    compared null-safely, and only in documents whose findings differ as a whole (:func:`changed_reports`); repeats
    of a finding are no difference. A changed list of executed checks (doc_id, checks_run) is told only where nothing
    else differs.
    """
    fields = [f for f in fields if f in expected.columns or f in actual.columns]

    def whole(df):
        return F.struct(*[F.col(f) if f in df.columns else F.lit(None).cast(dict(expected.dtypes + actual.dtypes)[f]).alias(f) for f in fields])

    def shown(c):
        return F.coalesce(c.cast("string"), F.lit("null"))

    left = expected.select("doc_id", whole(expected).alias("e"))
    right = actual.select("doc_id", whole(actual).alias("a"))
    changed = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col("e")[f].eqNullSafe(F.col("a")[f]),
                    F.concat(F.lit(f"{f}: expected "), shown(F.col("e")[f]), F.lit(", got "), shown(F.col("a")[f])),
                )
                for f in fields
            ]
        )
    )
    in_fields = left.join(right, "doc_id", "full").select("doc_id", F.explode(changed).alias("difference"))

    suspects = checkpointed(changed_reports(expected_findings, actual_findings).select(F.col("doc_id").alias("_suspect")))

    def only(mine, other, label):
        key = ["doc_id", *DIAGNOSTIC]
        mine, other = (df.join(suspects, F.col("doc_id").eqNullSafe(F.col("_suspect")), "left_semi") for df in (mine, other))
        known = other.select(*[F.col(k).alias(f"_{k}") for k in key])
        same = F.col("doc_id") == F.col("_doc_id")
        for k in DIAGNOSTIC:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        rest = mine.select(*key).join(known, same, "left_anti")
        said = F.concat_ws(" | ", *[F.coalesce(k, F.lit("null")) for k in DIAGNOSTIC])
        return rest.select("doc_id", F.concat(F.lit(label), said).alias("difference"))

    found = union_all(
        in_fields, only(expected_findings, actual_findings, "missing: "), only(actual_findings, expected_findings, "unexpected: ")
    )
    if expected_run is None:
        return found
    runs = expected_run.join(actual_run.withColumnRenamed("checks_run", "_got"), "doc_id", "full").filter("not checks_run <=> _got")
    other = runs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", F.concat(F.lit("checks that ran: expected "), shown(F.col("checks_run")), F.lit(", got "), shown(F.col("_got"))).alias("difference")
    )
    return union_all(found, other)
