"""The example catalogue of checks that several queries run, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quirecheck.functions import text as T
from quirecheck.operators.checks import INFO, WARNING, Check, Rule, run_checks
from quirecheck.operators.unions import union_all
from quirecheck.plans import oracle_tables as O
from quirecheck.sources import standins as S


def document_checks() -> list[Check]:
    text = F.col("text")
    return [
        Check(
            "Enough words",
            F.col("words") >= 50,
            F.concat(F.lit("only "), F.col("words").cast("string"), F.lit(" words")),
            tags=["text", "size"],
        ),
        Check(
            "No e-mail",
            ~F.contains(text, F.lit("@")),
            F.lit("e-mail address present"),
            severity=WARNING,
            tags=["privacy"],
        ),
        Check(
            "Ends with a stop",
            F.endswith(text, F.lit(".")),
            source="text ends with a full stop",
            severity=INFO,
            tags=["text"],
        ),
    ]


def page_rules() -> list[Rule]:
    return [Rule("Page length", F.char_length("text") >= 20, F.lit("page too short"))]


def all_checks() -> list[Check]:
    return [*document_checks(), *page_rules()]


def counted(spark, d) -> DataFrame:
    return S.documents(spark, d).withColumn("words", T.count_words(F.col("text")))


def findings(spark, d) -> DataFrame:
    """Findings of the whole catalogue: one pass over documents, one over their pages."""
    docs = run_checks(counted(spark, d), document_checks())
    pages = run_checks(S.text_pages(spark, d), page_rules(), first_no=4)
    return union_all(docs, pages)


SQL_COUNTED = f"select doc_id, text, len({O.words('text')})::bigint as words from documents"
SQL_FINDINGS = """select doc_id, 0 as page_no, 1 as check_no, 'error' as severity, 'Enough words' as check_name,
       'only ' || words || ' words' as message from counted where not words >= 50
    union all select doc_id, 0, 2, 'warning', 'No e-mail', 'e-mail address present' from documents where contains(text, '@')
    union all select doc_id, 0, 3, 'info', 'Ends with a stop', 'requirement not met: text ends with a full stop'
       from documents where not ends_with(text, '.')
    union all select doc_id, page_no, 4, 'error', 'Page length', 'page too short' from page where length(text) < 20"""
SQL_OCCURRENCE = """select *, row_number() over (partition by doc_id, check_name, message order by page_no) as occurrence from finding"""
SQL_IDENTIFIED = """select *, 'Q-' || substr(sha256(check_name || chr(31) || message || chr(31) || occurrence::varchar), 1, 8) as id from occ"""


def sql_findings(body: str, **extra: str) -> str:
    """``body`` over the CTEs counted, finding, occ and ident."""
    return O.sql("page", body, counted=SQL_COUNTED, finding=SQL_FINDINGS, occ=SQL_OCCURRENCE, ident=SQL_IDENTIFIED, **extra)
