"""Findings rolled up to verdicts, and the shapes in which reports leave the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quirecheck.functions.text import strip
from quirecheck.operators import layout as L
from quirecheck.operators.checks import ERROR, INFO, WARNING, identified

TOOL = "quirecheck"
# Version of the report, exit code of an unreadable input, address of the SARIF schema.
SCHEMA_VERSION = 1
UNREADABLE = 10
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def status(errors: Column) -> Column:
    return F.when(errors == 0, "PASS").otherwise("FAIL")


def report_rollup(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """One verdict per document (doc_id, page_count), clean documents included."""
    counts = findings.groupBy("doc_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in (ERROR, WARNING, INFO)]
    )
    filled = docs.join(counts, "doc_id", "left").select(
        "doc_id",
        F.col("page_count").alias("total_pages_analyzed"),
        *[F.coalesce(f"{s}_count", F.lit(0)).alias(f"{s}_count") for s in (ERROR, WARNING, INFO)],
    )
    return filled.withColumn("status", status(F.col("error_count")))


def exit_code(errors: Column, warnings: Column, fail_on_warning: bool = False, unreadable: Column | None = None) -> Column:
    """2 for errors, 1 for warnings (2 if they fail the run), 0 for neither; 10 was never judged."""
    code = F.when(errors > 0, 2).when(warnings > 0, 2 if fail_on_warning else 1).otherwise(0)
    if unreadable is not None:
        code = F.when(unreadable, UNREADABLE).otherwise(code)
    return code.cast("bigint")


def one_line(message: Column) -> Column:
    return strip(F.regexp_replace(message, r"(?U)\s+", " "))


def load_failures(docs: DataFrame, reason: Column) -> DataFrame:
    """A finding ``loading`` for every document with a reason why it could not be read."""
    return docs.filter(reason.isNotNull()).select(
        "doc_id", F.lit(ERROR).alias("severity"), F.lit("loading").alias("check_name"), one_line(reason).alias("message"),
        F.lit(UNREADABLE).cast("bigint").alias("exit"),
    )


# ---- sinks ----


def _line(findings: DataFrame) -> Column:
    """The line of the script a finding points to, where findings have one."""
    return F.col("line").cast("int") if "line" in findings.columns else F.lit(None).cast("int")


def json_reports(
    reports: DataFrame, findings: DataFrame, script: str, run: DataFrame | None = None, profile: str | None = None
) -> DataFrame:
    """(doc_id, json): the report of each document; a clean one has an empty list of diagnostics.

    ``run`` are the executed checks. Optional columns of ``reports`` are ``fixes`` (list of edits) and
    ``similarity`` (of a comparison); fields without a value are left out.
    """
    shown = F.struct("id", "severity", "check_name", "message", _line(findings).alias("line"))
    diagnostic = F.struct("check_no", "page_no", shown.alias("shown"))
    listed = findings.groupBy("doc_id").agg(F.sort_array(F.collect_list(diagnostic)).alias("found"))
    joined = reports.join(listed, "doc_id", "left")
    if run is not None:
        executed = run.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("check_no", "check_name"))).alias("_run"))
        joined = joined.join(executed, "doc_id", "left").withColumn("checks_run", F.transform("_run", lambda c: c["check_name"]))
    empty = F.array().cast("array<struct<id:string,severity:string,check_name:string,message:string,line:int>>")
    optional = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("checks_run", "fixes") if c in joined.columns]
    optional += [F.col("similarity")] if "similarity" in joined.columns else []
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(script).alias("script_name"),
        F.col("doc_id").cast("string").alias("input_file"), F.lit(profile).cast("string").alias("profile"), "status", "total_pages_analyzed",
        "error_count", "warning_count", "info_count", F.coalesce(F.transform("found", lambda f: f["shown"]), empty).alias("diagnostics"), *optional,
    )
    return joined.select("doc_id", F.to_json(body).alias("json"))


def csv_rows(reports: DataFrame, findings: DataFrame, script: str) -> DataFrame:
    """One row per finding, ready for ``write.csv(header=True)``."""
    return findings.join(reports.select("doc_id", "status"), "doc_id").select(
        "id", "severity", F.col("check_name").alias("check"), "message", F.coalesce(_line(findings).cast("string"), F.lit("")).alias("line"), F.lit(script).alias("script"),
        F.col("doc_id").cast("string").alias("file"), "status",
    )


def sarif_results(findings: DataFrame, script: str) -> DataFrame:
    """One SARIF result per finding as a JSON row, however many there are."""
    result = F.struct(
        F.col("check_name").alias("ruleId"),
        F.when(F.col("severity") == INFO, "note").otherwise(F.col("severity")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct(F.lit(script).alias("uri")).alias("artifactLocation"), F.struct(_line(findings).alias("startLine")).alias("region")
                ).alias("physicalLocation")
            )
        ).alias("locations"),
        F.struct(F.col("id").alias("findingId/v1")).alias("partialFingerprints"),
        F.struct(F.col("doc_id").cast("string").alias("inputFile")).alias("properties"),
    )
    return findings.select("doc_id", "check_no", "page_no", "check_name", F.to_json(result).alias("result"))


def sarif_reports(findings: DataFrame, script: str, tool: str = TOOL) -> DataFrame:
    """(doc_id, sarif): a SARIF 2.1.0 document per input, rules in first-seen order."""
    results = sarif_results(findings, script)
    rules = results.groupBy("doc_id", "check_name").agg(F.min(F.struct("check_no", "page_no")).alias("at"))
    rules = rules.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "check_name"))).alias("rules"))
    listed = results.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("check_no", "page_no", "result"))).alias("results")
    )
    rule = F.transform(
        "rules",
        lambda r: F.struct(r["check_name"].alias("id"), F.struct(r["check_name"].alias("text")).alias("shortDescription")),
    )
    head = F.to_json(F.struct(F.struct(F.lit(tool).alias("name"), rule.alias("rules")).alias("driver")))
    body = F.array_join(F.transform("results", lambda r: r["result"]), ",")
    text = F.concat(
        F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":'), head, F.lit(',"results":['), body, F.lit("]}]}")
    )
    return listed.join(rules, "doc_id").select("doc_id", text.alias("sarif"))


def junit_cases(run: DataFrame, findings: DataFrame) -> DataFrame:
    """One case per check of a document that ran or found something: counts, the first failing finding, all findings as lines.

    Checks that only findings name come last. Notes of severity info are kept but fail nothing.
    """
    failing = F.col("severity") != INFO
    line = F.concat(F.lit(" (line "), _line(findings).cast("string"), F.lit(")"))
    said = F.concat("id", F.lit(" ["), "severity", F.lit("]"), F.coalesce(line, F.lit("")), F.lit(" "), "message")
    found = findings.groupBy("doc_id", "check_name").agg(
        F.count("*").alias("findings"),
        F.count_if(failing).alias("failing"),
        F.min(F.when(failing, F.struct("check_no", "page_no", "message", "severity"))).alias("first"),
        F.min(F.struct("check_no", "page_no")).alias("at"),
        F.sort_array(F.collect_list(F.struct("check_no", "page_no", said.alias("said")))).alias("all"),
    )
    joined = run.withColumnRenamed("check_no", "_run_no").join(found, ["doc_id", "check_name"], "full")
    return joined.select(
        "doc_id", F.coalesce("_run_no", "at.check_no").alias("check_no"), F.col("_run_no").isNull().alias("extra"), "check_name",
        F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("failing", F.lit(0)).alias("failing"),
        F.col("first.message").alias("message"), F.col("first.severity").alias("severity"),
        F.coalesce(F.transform("all", lambda x: x["said"]), F.array().cast("array<string>")).alias("lines"),
    )


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def junit_lines(cases: DataFrame) -> DataFrame:
    """The ``<testcase>`` element of each case, with every finding in its body."""
    head = F.concat(
        F.lit('<testcase name="'), xml_escape(F.col("check_name")), F.lit('" classname="'), xml_escape(F.col("doc_id").cast("string")), F.lit('"')
    )
    body = xml_escape(F.concat(F.array_join("lines", "\n"), F.lit("\n")))
    failure = F.concat(
        F.lit('><failure message="'), xml_escape(F.col("message")), F.lit('" type="'), F.col("severity"), F.lit('">\n'), body, F.lit("</failure></testcase>")
    )
    note = F.concat(F.lit("><system-out>"), body, F.lit("</system-out></testcase>"))
    tail = F.when(F.col("failing") > 0, failure).when(F.col("findings") > 0, note).otherwise("/>")
    return cases.select("doc_id", "extra", "check_no", "check_name", "failing", F.concat(head, tail).alias("xml"))


def junit_reports(run: DataFrame, findings: DataFrame, script: str) -> DataFrame:
    """(doc_id, junit): one XML document per input, cases in the order of the checks."""
    case = F.struct("extra", "check_no", "check_name", "xml")
    grouped = junit_lines(junit_cases(run, findings)).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(case)).alias("cases"), F.count_if(F.col("failing") > 0).alias("failures")
    )
    counts = F.concat(F.lit('" tests="'), F.size("cases").cast("string"), F.lit('" failures="'), F.col("failures").cast("string"), F.lit('"'))
    text = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name="{TOOL}'), counts, F.lit(">\n<testsuite name=\""), xml_escape(F.lit(script)), counts,
        F.lit(' errors="0" skipped="0">\n'), F.array_join(F.transform("cases", lambda c: c["xml"]), "\n"), F.lit("\n</testsuite>\n</testsuites>\n"),
    )
    return grouped.select("doc_id", text.alias("junit"))


# ---- one row that says what a document is ----


def doc_summary(
    docs: DataFrame, images: DataFrame, fonts: DataFrame, boxes: DataFrame, meta: DataFrame | None = None, pages: DataFrame | None = None
) -> DataFrame:
    """What each document is: file, size, hash, metadata, pages, boxes on every page, fonts, images, ink and warnings.

    ``docs`` has doc_id and, where they are known, ``file``, ``size_bytes`` and ``sha256``. ``meta`` (doc_id,
    pos, key, value) gives the non-empty metadata and the warning of a missing title, ``pages`` (doc_id,
    text) the warning of a document without text.
    """
    image = images.groupBy("doc_id").agg(
        F.count("*").alias("images"), F.min(F.least("dpi_x", "dpi_y")).alias("min_dpi"),
        F.sort_array(F.collect_set("color_space")).alias("spaces"), L.highest_tac().alias("max_tac"),
        F.count_if(F.least("dpi_x", "dpi_y") < 300).alias("low"),
        F.bool_or(F.contains("color_space", F.lit("RGB"))).alias("rgb"),
    )
    font = fonts.groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("name", "embedded"))).alias("font_list"),
        F.count_distinct("name").alias("fonts"), F.bool_or(~F.col("embedded")).alias("loose_fonts"),
    )
    size = F.struct("width", "height")
    box = boxes.groupBy("doc_id").agg(
        F.count("*").alias("page_count"),
        F.min_by(size, "page_no").alias("first_size"),
        (F.min(size) == F.max(size)).alias("uniform"),
        *[F.bool_and(F.col(b).isNotNull()).alias(f"has_{b}") for b in ("trim", "bleed", "crop")],
    )
    joined = docs.join(box, "doc_id", "left").join(image, "doc_id", "left").join(font, "doc_id", "left")
    known = [F.col(c) for c in ("file", "size_bytes", "sha256") if c in docs.columns]
    untitled = blank = F.lit(None).cast("boolean")
    if meta is not None:
        filled = F.when(F.col("value") != "", F.struct("pos", F.struct("key", "value").alias("entry")))
        entries = meta.groupBy("doc_id").agg(F.sort_array(F.collect_list(filled)).alias("_meta"), F.bool_or((F.col("key") == "Title") & (F.col("value") != "")).alias("_titled"))
        joined = joined.join(entries, "doc_id", "left")
        listed = F.coalesce(F.transform("_meta", lambda e: e["entry"]), F.array().cast("array<struct<key:string,value:string>>"))
        known.append(listed.alias("metadata"))
        untitled = ~F.coalesce("_titled", F.lit(False))
    if pages is not None:
        spoken = pages.groupBy("doc_id").agg(F.bool_or(strip(F.coalesce("text", F.lit(""))) != "").alias("_spoken"))
        joined = joined.join(spoken, "doc_id", "left")
        blank = ~F.coalesce("_spoken", F.lit(False))
    named = [F.when(F.col(f"has_{b}"), label) for b, label in (("trim", "TrimBox"), ("bleed", "BleedBox"), ("crop", "CropBox"))]
    # The warning texts.
    warnings = [
        F.when(F.col("loose_fonts"), "there are non-embedded fonts"),
        F.when(F.col("low") > 0, F.concat(F.col("low").cast("string"), F.lit(" image(s) below 300 DPI"))),
        F.when(F.col("rgb"), "there are RGB images (offset printing requires CMYK)"),
        F.when(blank, "the document has no extractable text"),
        F.when(~F.col("has_trim"), "TrimBox missing on some page"),
        F.when(untitled, "no title in the metadata"),
    ]
    return joined.select(
        "doc_id",
        *known,
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.col("first_size.width").alias("width"),
        F.col("first_size.height").alias("height"),
        "uniform",
        F.array_compact(F.array(F.lit("MediaBox"), *named)).alias("boxes"),
        F.coalesce("fonts", F.lit(0)).alias("fonts"),
        F.coalesce("font_list", F.array().cast("array<struct<name:string,embedded:boolean>>")).alias("font_list"),
        F.coalesce("images", F.lit(0)).alias("images"),
        "min_dpi",
        F.coalesce("spaces", F.array().cast("array<string>")).alias("spaces"),
        F.coalesce("max_tac", F.lit(0.0)).alias("max_tac"),
        F.array_compact(F.array(*warnings)).alias("warnings"),
    )


def write_reports(reports: DataFrame, findings: DataFrame, script: str, folder: str, run: DataFrame | None = None) -> None:
    """JSON, CSV, SARIF and JUnit documents next to each other, each written by all tasks.

    ``run`` are the executed checks; without it, JUnit has only the checks that found something.
    """
    known = identified(findings)
    if run is None:
        run = known.select("doc_id", "check_no", "check_name").limit(0)
    json_reports(reports, known, script, run).select("json").write.mode("overwrite").text(f"{folder}/json")
    csv_rows(reports, known, script).write.mode("overwrite").csv(f"{folder}/csv", header=True, quote='"', escape='"')
    sarif_reports(known, script).select("sarif").write.mode("overwrite").text(f"{folder}/sarif")
    junit_reports(run, known, script).select("junit").write.mode("overwrite").text(f"{folder}/junit")
