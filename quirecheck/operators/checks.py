"""Declarative checks: a condition over a row of some table, and what to report when it fails.

All checks over one table run in a single pass; each row yields an array of its findings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from quirecheck.operators.ordinals import ordinal

ERROR, WARNING, INFO = "error", "warning", "info"
FINGERPRINT_PREFIX = "Q-"


@dataclass(frozen=True)
class Check:
    """One named check.

    ``condition`` must hold; false and null both fail. ``message`` may interpolate columns; without
    one the finding quotes ``source``, the condition as text. ``error`` is a Column that is non-null
    where the check could not be evaluated: it reports an error and suppresses the assertion.
    """

    name: str
    condition: Column
    message: Column | None = None
    source: str = ""
    severity: str = ERROR
    tags: Sequence[str] = field(default_factory=tuple)
    error: Column | None = None


@dataclass(frozen=True)
class Rule(Check):
    """A check applied page by page: untagged, and always of severity error."""


def select_checks(checks: Sequence[Check], wanted_tags: Sequence[str] | None) -> list[Check]:
    """Checks to run under a tag filter. Nothing matching is a mistake, not a pass."""
    if wanted_tags is None:
        return list(checks)
    wanted = set(wanted_tags)
    chosen = [c for c in checks if not isinstance(c, Rule) and wanted & set(c.tags)]
    if not chosen:
        raise ValueError(f"no check carries any of the tags {sorted(wanted)}")
    return chosen


def _finding(no: int, check: Check) -> Column:
    kind = "rule" if isinstance(check, Rule) else "check"
    message = check.message if check.message is not None else F.lit(f"requirement not met: {check.source}")
    failed = F.struct(
        F.lit(no).alias("check_no"),
        F.lit(ERROR if isinstance(check, Rule) else check.severity).alias("severity"),
        F.lit(check.name).alias("check_name"),
        message.alias("message"),
    )
    result = F.when(~F.coalesce(check.condition, F.lit(False)), failed)
    if check.error is None:
        return result
    broken = F.struct(
        F.lit(no).alias("check_no"),
        F.lit(ERROR).alias("severity"),
        F.lit(check.name).alias("check_name"),
        F.concat(F.lit(f"error in {kind}: "), check.error).alias("message"),
    )
    return F.when(check.error.isNotNull(), broken).otherwise(result)


def run_checks(
    rows: DataFrame,
    checks: Sequence[Check],
    wanted_tags: Sequence[str] | None = None,
    first_no: int = 1,
) -> DataFrame:
    """Findings (doc_id, page_no, check_no, severity, check_name, message) of ``checks`` over ``rows``.

    ``page_no`` is 0 for document rows; (check_no, page_no) orders the findings of a document.
    """
    chosen = select_checks(checks, wanted_tags)
    page = F.col("page_no") if "page_no" in rows.columns else F.lit(0)
    found = F.array_compact(F.array(*[_finding(first_no + i, c) for i, c in enumerate(chosen)]))
    return rows.select("doc_id", page.cast("bigint").alias("page_no"), F.explode(found).alias("f")).select(
        "doc_id", "page_no", "f.check_no", "f.severity", "f.check_name", "f.message"
    )


def checks_run(docs: DataFrame, checks: Sequence[Check], wanted_tags: Sequence[str] | None = None) -> DataFrame:
    """Every executed check of every document, clean ones too, in order."""
    names = F.array(*[F.lit(c.name) for c in select_checks(checks, wanted_tags)])
    return docs.select("doc_id", F.posexplode(names).alias("pos", "check_name")).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("check_no"), "check_name"
    )


def with_occurrence(findings: DataFrame) -> DataFrame:
    """Number identical (check, message) pairs of a document in page order."""
    return ordinal(findings, ["doc_id", "check_name", "message"], "page_no", "occurrence")


def fingerprint(check: Column, message: Column, occurrence: Column, prefix: str = FINGERPRINT_PREFIX) -> Column:
    """Identity of a finding: what it says and how often it was said before, not where it stands."""
    text = F.concat_ws("\x1f", check, message, occurrence.cast("string"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 8))


def identified(findings: DataFrame, prefix: str = FINGERPRINT_PREFIX) -> DataFrame:
    """Findings with their occurrence number and fingerprint ``id``."""
    return with_occurrence(findings).withColumn(
        "id", fingerprint(F.col("check_name"), F.col("message"), F.col("occurrence"), prefix)
    )
