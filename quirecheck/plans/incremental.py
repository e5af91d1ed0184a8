"""Queries over arrivals, journals and recorded reports, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirecheck.operators import checks as K, incremental as J, reports as R
from quirecheck.plans import catalogue as C, oracle_tables as O
from quirecheck.plans.registry import query
from quirecheck.sources import standins as S
from quirecheck.sources.checkpoints import checkpointed, scratch_path
from quirecheck.streaming import watch as Y

# Half of the arrivals, by their last digit, are already in the journal.
_SPLIT = {
    "journal": "select * from arr where seq % 10 < 5",
    "arriving": "select * from arr where seq % 10 >= 5",
    "latest": "select path, arg_max(sha256, seq) as sha256, arg_max(exit, seq) as exit from journal group by path",
    "pending": "select * from arriving a where not exists (select 1 from latest l where l.path = a.path and l.sha256 = a.sha256 and l.sha256 <> '')",
}


def _sql(body: str, **extra: str) -> str:
    return O.sql("arr", body, **_SPLIT, **extra)


def _journal(spark, d):
    return S.arrivals(spark, d).filter(F.col("seq") % 10 < 5)


def _arriving(spark, d):
    return S.arrivals(spark, d).filter(F.col("seq") % 10 >= 5)


@query("journal_latest", _sql("select * from latest"))
def journal_latest(spark, d):
    return J.journal_latest(_journal(spark, d))


@query("journal_pending", _sql("select seq, path, sha256, exit from pending"))
def journal_pending(spark, d):
    return J.journal_pending(_arriving(spark, d), _journal(spark, d)).select("seq", "path", "sha256", "exit")


def _resumed(spark, d):
    arriving, journal = _arriving(spark, d), _journal(spark, d)
    return J.journal_resume(arriving, journal, J.journal_pending(arriving, journal))


_RESUMED = """select path, exit from pending union all
    select path, exit from latest l where exists (select 1 from arriving a where a.path = l.path and a.sha256 = l.sha256)"""


@query("journal_resume", _sql("select * from resumed", resumed=_RESUMED))
def journal_resume(spark, d):
    return _resumed(spark, d)


@query("batch_verdict", _sql("select max(exit) as exit from resumed", resumed=_RESUMED))
def batch_verdict(spark, d):
    return J.batch_verdict(_resumed(spark, d))


_BATCHES = "select path, seq // 40 as batch, max(exit) as exit from arr group by path, seq // 40"


@query(
    "fail_fast",
    O.sql(
        "arr",
        """select path, batch, exit from (select *, coalesce(sum((exit >= 2)::int) over (partition by batch order by path
           rows between unbounded preceding and 1 preceding), 0) as failed from files) where failed = 0""",
        files=_BATCHES,
    ),
)
def fail_fast(spark, d):
    """Batches of forty arrivals, each path once."""
    files = S.arrivals(spark, d).groupBy("path", F.floor(F.col("seq") / 40).alias("batch")).agg(F.max("exit").alias("exit"))
    return J.fail_fast(files, ["batch"])


_SQL_SETTLE = """select path, count(*) as writes, arg_max(sha256, seq) as sha256, epoch_us(min(ts)) as start, epoch_us(max(ts)) + 21600000000 as "end"
    from (select *, sum(fresh) over (partition by path order by ts, seq) as burst from
      (select *, case when ts - lag(ts) over (partition by path order by ts, seq) < interval 6 hour then 0 else 1 end as fresh from arr))
    group by path, burst"""


def _timed(events):
    """Session windows and watermarks want an instant: the time without zone, taken as UTC."""
    since = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
    return events.withColumn("ts", F.timestamp_micros(F.expr(since)))


@query("settle", O.sql("arr", _SQL_SETTLE))
def settle(spark, d):
    """Bursts of a path: writes less than six hours apart."""
    found = J.settled(_timed(S.arrivals(spark, d)), "6 hours")
    return found.select(
        "path", "writes", "sha256", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end")
    )


def _arrival_stream(spark, d):
    """The event files as a stream of arrivals."""
    schema = S.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return S.as_arrivals(events)


@query(
    "settle_stream",
    O.sql("arr", f"""select * from ({_SQL_SETTLE}) where "end" <= (select epoch_us(max(ts)) - 3600000000 from arr)"""),
)
def settle_stream(spark, d):
    """The same bursts from a stream; those still open at the end are not emitted."""
    out, state = scratch_path(spark, "settled"), scratch_path(spark, "settled-state")
    bursts = Y.settled_stream(_timed(_arrival_stream(spark, d)), "6 hours", "1 hour")
    writer = bursts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select(
        "path", "writes", "sha256", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end")
    )


_WATCHED = """select seq, path, sha256, case when sha256 >= 'c' then 2 when right(sha256, 1) <= '4' then 1 else 0 end::bigint as exit,
    case when sha256 >= 'c' then 'FAIL' else 'PASS' end as status, (sha256 >= 'c')::bigint + (right(sha256, 1) <= '4')::bigint as findings
    from (select arg_max(seq, seq) as seq, path, arg_max(sha256, seq) as sha256 from arr group by path)"""


def _hash_checks():
    """A catalogue for arrivals, of which only the hash is known."""
    return [
        K.Check("First half", F.col("sha256") < "c", F.concat(F.lit("starts with "), F.substring("sha256", 1, 1))),
        K.Check("Last letter", F.substring("sha256", -1, 1) > "4", F.lit("ends low"), severity=K.WARNING),
    ]


def _watched(spark, d, kept):
    arrivals = _arrival_stream(spark, d)
    return arrivals, Y.checked(_hash_checks(), "hashes"), kept, scratch_path(spark, "watch-state"), scratch_path(spark, "watch-reports")


@query("watch_stream", O.sql("arr", _WATCHED))
def watch_stream(spark, d):
    """Every path checked once, with its last content; journal and reports are what was written."""
    arrivals, validate, journal, state, reports = _watched(spark, d, scratch_path(spark, "journal"))
    Y.watch(arrivals, validate, journal, state, reports_path=reports).awaitTermination()
    report = spark.read.parquet(reports).select(
        "path", F.get_json_object("report", "$.status").alias("status"),
        F.json_array_length(F.get_json_object("report", "$.diagnostics")).cast("bigint").alias("findings"),
    )
    return Y.journal(spark, journal).select("seq", "path", "sha256", "exit").join(report, "path")


@query("watch_once", O.sql("arr", "select max(exit) as exit from (" + _WATCHED + ")"))
def watch_once(spark, d):
    return Y.watch_once(*_watched(spark, d, scratch_path(spark, "journal")))


@query(
    "timeout_findings",
    """select v.user_id as key, v.event_id as seq, 'error' as severity, 'timeout' as check_name,
       'analysis did not finish within 7200s and was killed' as message from events v where v.event_type = 'view' and not exists
       (select 1 from events p where p.event_type = 'purchase' and p.user_id = v.user_id and p.ts >= v.ts and p.ts <= v.ts + interval 2 hour)""",
)
def timeout_findings(spark, d):
    """A view starts some work, a purchase of the same user finishes it."""
    events = _timed(S.table(spark, d, "events"))
    starts = events.filter("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts")
    finishes = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), "ts")
    return J.timeout_findings(starts, finishes, 7200)


# ---- golden reports ----

_REPORTED = """select d.doc_id, case when count(i.id) filter (where severity = 'error') = 0 then 'PASS' else 'FAIL' end as status,
    count(i.id) filter (where severity = 'error') as error_count, count(i.id) filter (where severity = 'warning') as warning_count,
    count(i.id) filter (where severity = 'info') as info_count from documents d left join {} i on i.doc_id = d.doc_id group by d.doc_id"""
_GOLDEN = {
    "ereport": _REPORTED.format("ident"),
    "actual": """select doc_id, severity, check_name, case when doc_id % 7 = 0 then message || '!' else message end as message, page_no,
        occurrence from ident where doc_id % 5 <> 0""",
    "aident": """select *, 'Q-' || substr(sha256(check_name || chr(31) || message || chr(31) || occurrence::varchar), 1, 8) as id from actual""",
    "areport": _REPORTED.format("aident"),
    "told": """select doc_id, f || ': expected ' || want || ', got ' || coalesce(got, 'null') as difference from
             (select e.doc_id, unnest(['status', 'error_count', 'warning_count', 'info_count', 'profile']) as f,
              unnest([e.status, e.error_count::varchar, e.warning_count::varchar, e.info_count::varchar, 'strict']) as want,
              unnest([a.status, a.error_count::varchar, a.warning_count::varchar, a.info_count::varchar, case when e.doc_id % 11 <> 0 then 'strict' end]) as got
              from ereport e left join areport a on a.doc_id = e.doc_id) e
             where want is distinct from got
           union all select doc_id, 'missing: ' || id || ' | ' || severity || ' | ' || check_name || ' | ' || message from ident i where not exists
             (select 1 from aident a where a.doc_id = i.doc_id and a.id = i.id and a.severity = i.severity and a.message = i.message)
           union all select doc_id, 'unexpected: ' || id || ' | ' || severity || ' | ' || check_name || ' | ' || message from aident a where not exists
             (select 1 from ident i where a.doc_id = i.doc_id and a.id = i.id and a.severity = i.severity and a.message = i.message)""",
}


@query(
    "golden_diff",
    C.sql_findings(
        """select * from told union all
           select doc_id, 'checks that ran: expected Enough words, No e-mail, Ends with a stop, Page length, got Enough words, No e-mail, Ends with a stop' as difference
           from documents where doc_id % 3 = 0 and doc_id not in (select doc_id from told)""",
        **_GOLDEN,
    ),
)
def golden_diff(spark, d):
    """Recorded reports against a run that lost some documents' findings, reworded others, and ran fewer checks on some."""
    expected = checkpointed(K.identified(C.findings(spark, d)))  # a recording is written once and read often
    reworded = F.when(F.col("doc_id") % 7 == 0, F.concat("message", F.lit("!"))).otherwise(F.col("message"))
    actual = expected.filter(F.col("doc_id") % 5 != 0).withColumn("message", reworded)
    actual = actual.withColumn("id", K.fingerprint(F.col("check_name"), F.col("message"), F.col("occurrence")))
    docs = S.documents(spark, d).select("doc_id", F.lit(1).cast("bigint").alias("page_count"))

    def report(findings, profile):
        return R.report_rollup(docs, findings).withColumn("profile", profile).withColumn("schema_version", F.lit(R.SCHEMA_VERSION))

    def names(checks):
        return F.lit(", ".join(c.name for c in checks))

    strict = F.lit("strict")
    run = docs.select("doc_id", names(C.all_checks()).alias("checks_run"))
    fewer = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, names(C.document_checks())).otherwise(names(C.all_checks())).alias("checks_run"))
    return J.golden_diff(report(expected, strict), report(actual, F.when(F.col("doc_id") % 11 != 0, strict)), expected, actual, run, fewer)


@query(
    "golden_record",
    """select page_id as doc_id, regexp_extract(url, '[^/]*$') as input_file, case when page_id % 6 = 0 then 'no recorded report' end as difference from pages""",
)
def golden_record(spark, d):
    """Pages as cases, five of six recorded: written, read back, and the cases still without a recording."""
    cases = S.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    reports = J.golden_record(cases, F.col("url")).drop("url")
    path = scratch_path(spark, "golden")
    reports.filter(F.col("doc_id") % 6 != 0).write.mode("overwrite").parquet(path)
    return reports.join(J.not_recorded(reports, spark.read.parquet(path)), "doc_id", "left")
