"""Queries that run checks over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirecheck.functions import text as T, values as X
from quirecheck.operators import checks as K
from quirecheck.plans import catalogue as C, oracle_tables as O
from quirecheck.plans.registry import query
from quirecheck.sources import standins as S


@query(
    "check_assert",
    O.sql(
        "",
        """select doc_id, 'error' as severity, 'Enough words' as check_name, 'only ' || words || ' words' as message
           from counted where not coalesce(case when doc_id % 10 <> 0 then words >= 50 end, false)""",
        counted=C.SQL_COUNTED,
    ),
)
def check_assert(spark, d):
    """The condition is null for every tenth document, which fails like false."""
    words = F.col("words")
    check = K.Check(
        "Enough words",
        F.when(F.col("doc_id") % 10 != 0, words >= 50),
        F.concat(F.lit("only "), words.cast("string"), F.lit(" words")),
    )
    return K.run_checks(C.counted(spark, d), [check]).select("doc_id", "severity", "check_name", "message")


@query(
    "check_require",
    """select doc_id, 'requirement not met: text ends with a full stop' as message from documents
       where not ends_with(text, '.')""",
)
def check_require(spark, d):
    return K.run_checks(S.documents(spark, d), [C.document_checks()[2]]).select("doc_id", "message")


@query(
    "check_severity",
    C.sql_findings("select severity, check_name, count(*) as findings from finding where check_no < 4 group by severity, check_name"),
)
def check_severity(spark, d):
    found = K.run_checks(C.counted(spark, d), C.document_checks())
    return found.groupBy("severity", "check_name").agg(F.count("*").alias("findings"))


@query("check_tags", C.sql_findings("select doc_id, check_name, message from finding where check_no in (1, 3)"))
def check_tags(spark, d):
    """Only checks tagged ``text`` run; the untagged rule is skipped."""
    found = K.run_checks(C.counted(spark, d), C.all_checks(), wanted_tags=["text"])
    return found.select("doc_id", "check_name", "message")


@query(
    "check_rule_pages",
    O.sql("page", "select doc_id, page_no, 'page too short' as message from page where page_no % 2 = 1 and length(text) < 20"),
)
def check_rule_pages(spark, d):
    """A rule on the odd pages only."""
    selected = S.text_pages(spark, d).filter(F.col("page_no") % 2 == 1)
    return K.run_checks(selected, C.page_rules()).select("doc_id", "page_no", "message")


@query(
    "check_error_finding",
    """select doc_id, case when digits = 0 then 'error' else 'info' end as severity,
       case when digits = 0 then 'error in check: division by zero' else 'dense digits' end as message
       from (select doc_id, n_chars, length(regexp_replace(text, '[^0-9]', '', 'g')) as digits from documents)
       where digits = 0 or not n_chars / digits >= 100""",
)
def check_error_finding(spark, d):
    """Characters per digit: a document without digits makes the check itself fail."""
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    docs = S.documents(spark, d).select("doc_id", F.char_length("text").alias("chars"), digits.alias("digits"))
    check = K.Check(
        "Digit density",
        X.divide(F.col("chars"), F.col("digits")) >= 100,
        F.lit("dense digits"),
        severity=K.INFO,
        error=X.divide_error(F.col("digits")),
    )
    return K.run_checks(docs, [check]).select("doc_id", "severity", "message")


@query(
    "check_conditional",
    """select doc_id, case when n_chars > 5000 then 'long' when n_chars > 1000 then 'medium'
       when n_chars > 100 then 'short' end as size_class from documents""",
)
def check_conditional(spark, d):
    chars = F.char_length("text")
    return S.documents(spark, d).select(
        "doc_id", F.when(chars > 5000, "long").when(chars > 1000, "medium").when(chars > 100, "short").alias("size_class")
    )


@query("occurrence", C.sql_findings("select doc_id, page_no, check_name, message, occurrence from occ"))
def occurrence(spark, d):
    return K.with_occurrence(C.findings(spark, d)).select("doc_id", "page_no", "check_name", "message", "occurrence")


@query("fingerprint", C.sql_findings("select doc_id, page_no, check_name, id from ident"))
def fingerprint(spark, d):
    return K.identified(C.findings(spark, d)).select("doc_id", "page_no", "check_name", "id")


@query(
    "checks_run",
    """select doc_id, n::bigint as check_no, name as check_name from documents,
       (values (1, 'Enough words'), (2, 'No e-mail'), (3, 'Ends with a stop'), (4, 'Page length')) as c(n, name)""",
)
def checks_run(spark, d):
    return K.checks_run(S.documents(spark, d), C.all_checks())
