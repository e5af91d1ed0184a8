"""Queries for scans, sources, sinks and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirecheck.operators import checks as K, reports as R
from quirecheck.plans import catalogue as C, oracle_tables as O
from quirecheck.plans.registry import query
from quirecheck.sources import files as I, standins as S
from quirecheck.sources.checkpoints import scratch_path

SEP = " ¦ "
SCRIPT = "catalogue"

# ---- sources ----


@query("scan_files", "select doc_id, strlen(text)::bigint + 1 as size, sha256(text || chr(10)) as sha256 from documents")
def scan_files(spark, d):
    """Documents written as one file each, a line break at the end, and read back: byte size and content hash.

    A folder holds the files of a thousand ids.
    """
    path = scratch_path(spark, "files")
    key = F.col("doc_id")
    name = F.concat_ws("", F.floor(key / 1000).cast("string"), F.lit("/doc_id="), key.cast("string"), F.lit(".txt"))
    I.write_files(S.documents(spark, d).select(name.alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("content")), path)
    found = I.scan_files(spark, path, "*.txt")
    return found.select(F.regexp_extract("path", "doc_id=(-?[0-9]+)", 1).cast("bigint").alias("doc_id"), F.col("size"), "sha256")


@query(
    "file_select",
    r"""select page_id, url as path from pages where regexp_matches(regexp_extract(url, '[^/]*$'), '^[0-9]*\?page=.*$')
        and not regexp_matches(url, '/[^/]*ref=y[^/]*$')
        and len(list_filter(string_split(substr(url, 8), '/'), lambda p: p <> '')) <= 3 order by path""",
)
def file_select(spark, d):
    urls = S.table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return I.select_files(urls, "*?page=*", exclude="*ref=y*", depth=3, root="http://").orderBy("path")


def _table(spark, d):
    """Reference rows with commas, quotes and line breaks in the name."""
    name = F.concat(F.col("p_name"), F.lit(', "no'), F.col("p_partkey").cast("string"), F.lit('"\nline two'))
    return S.table(spark, d, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("c1"), name.alias("c2"), F.col("p_brand").alias("c3"))


_SQL_TABLE = """select 'k' || p_partkey as c1, p_name || ', "no' || p_partkey || '"' || chr(10) || 'line two' as c2, p_brand as c3 from part"""


@query("load_dataset_csv", _SQL_TABLE)
def load_dataset_csv(spark, d):
    path = scratch_path(spark, "table-csv")
    _table(spark, d).write.csv(path, quote='"', escape='"')
    cells = F.col("cells")
    return I.load_dataset_csv(spark, path).select(cells[0].alias("c1"), cells[1].alias("c2"), cells[2].alias("c3"))


@query(
    "load_dataset_json",
    f"""select c1, c2, case when c3 like '%1%' then '' else c3 end as c3 from ({_SQL_TABLE})
        union all select 'c1', 'c2', 'c3' from (select distinct p_partkey // 50 from part)""",
)
def load_dataset_json(spark, d):
    """JSON files of fifty objects each, a thousand files to a folder; some objects lack the third key, never the first of a text."""
    part = F.floor(F.substring("c1", 2, 20).cast("bigint") / 50)
    rows = _table(spark, d).withColumn("c3", F.when(~F.contains("c3", F.lit("1")), F.col("c3")))
    item = F.struct(F.col("c3").isNull().alias("o"), F.to_json(F.struct("c1", "c2", "c3")).alias("j"))
    texts = rows.groupBy(part.alias("text")).agg(F.sort_array(F.collect_list(item)).alias("a")).select(
        "text", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["j"]), ","), F.lit("]")).alias("value")
    )
    path = scratch_path(spark, "table-json")
    name = F.concat_ws("", F.lit("folder="), F.floor(F.col("text") / 1000).cast("string"), F.lit("/part="), F.col("text").cast("string"), F.lit(".txt"))
    I.write_files(texts.select(name.alias("path"), F.concat("value", F.lit("\n")).alias("content")), path)
    cells = F.col("cells")
    return I.load_dataset_json(spark, path).select(cells[0].alias("c1"), cells[1].alias("c2"), cells[2].alias("c3"))


@query("load_glossary", O.sql("gloss", "select trim(term) as term from gloss where trim(term) <> '' and term_no % 5 <> 0"))
def load_glossary(spark, d):
    """Terms with blanks around them; every fifth line is a comment."""
    path = scratch_path(spark, "glossary")
    comment = F.when(F.col("term_no") % 5 == 0, "# ").otherwise("  ")
    S.glossary(spark, d).select(F.concat(comment, "term", F.lit(" "))).write.text(path)
    return I.load_glossary(spark, path).select("term")


# ---- roll-ups ----


def _paged(spark, d):
    return S.documents(spark, d).select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("page_count"))


def _reports(spark, d):
    return R.report_rollup(_paged(spark, d), C.findings(spark, d))


_SQL_REPORT = """select d.doc_id, page_count as total_pages_analyzed, count(f.severity) filter (where severity = 'error') as error_count,
    count(f.severity) filter (where severity = 'warning') as warning_count, count(f.severity) filter (where severity = 'info') as info_count,
    case when count(f.severity) filter (where severity = 'error') = 0 then 'PASS' else 'FAIL' end as status
    from (select doc_id, len(string_split(text, chr(10)))::bigint as page_count from documents) d
    left join finding f on f.doc_id = d.doc_id group by d.doc_id, page_count"""


@query("report_rollup", C.sql_findings("select * from report", report=_SQL_REPORT))
def report_rollup(spark, d):
    return _reports(spark, d)


@query(
    "exit_code",
    C.sql_findings(
        """select r.doc_id, case when n_chars < 40 then 10 when error_count > 0 then 2 when warning_count > 0 then 1 else 0 end::bigint as exit,
           case when error_count + warning_count > 0 then 2 else 0 end::bigint as strict_exit
           from report r join documents d on d.doc_id = r.doc_id""",
        report=_SQL_REPORT,
    ),
)
def exit_code(spark, d):
    """Texts under 40 characters count as unreadable."""
    unreadable = S.documents(spark, d).select("doc_id", (F.char_length("text") < 40).alias("unreadable"))
    errors, warnings = F.col("error_count"), F.col("warning_count")
    return _reports(spark, d).join(unreadable, "doc_id").select(
        "doc_id",
        R.exit_code(errors, warnings, unreadable=F.col("unreadable")).alias("exit"),
        R.exit_code(errors, warnings, fail_on_warning=True).alias("strict_exit"),
    )


@query(
    "load_failure",
    """select doc_id, 'error' as severity, 'loading' as check_name, 'could not open document: too short (' || n_chars || ' characters)' as message,
       10::bigint as exit from documents where n_chars < 100""",
)
def load_failure(spark, d):
    chars = F.char_length("text")
    reason = F.concat(F.lit("could not open document:\n   too\tshort ("), chars.cast("string"), F.lit("  characters)\n"))
    return R.load_failures(S.documents(spark, d), F.when(chars < 100, reason))


_SQL_SPACES = f"coalesce(string_agg(distinct color_space, '{SEP}' order by color_space), '')"


@query(
    "doc_summary",
    O.sql(
        "img font box",
        f"""select o_orderkey as doc_id, coalesce(b.n, 0) as page_count, case when b.n > 0 then 595.0::double end as width,
            case when b.n > 0 then 842.0::double end as height, case when b.n > 0 then true end as uniform,
            'MediaBox' || case when b.t then '{SEP}TrimBox' else '' end || case when b.bl then '{SEP}BleedBox' else '' end as boxes,
            coalesce(f.fonts, 0) as fonts, coalesce(font_list, '') as font_list, coalesce(i.images, 0) as images, i.min_dpi, coalesce(i.spaces, '') as spaces,
            coalesce(i.max_tac, 0.0) as max_tac, array_to_string(list_filter([case when f.loose then 'there are non-embedded fonts' end,
              case when i.low > 0 then i.low || ' image(s) below 300 DPI' end,
              case when i.rgb then 'there are RGB images (offset printing requires CMYK)' end,
              case when coalesce(b.n, 0) = 0 or o_orderkey % 4 = 0 then 'the document has no extractable text' end,
              case when not b.t then 'TrimBox missing on some page' end, case when o_orderkey % 3 = 0 then 'no title in the metadata' end], lambda x: x is not null), '{SEP}') as warnings,
            'order-' || o_orderkey || '.pdf' as file, length(o_orderstatus || o_orderpriority) as size_bytes, sha256(o_orderpriority) as sha256,
            array_to_string(list_filter([case when o_orderkey % 3 <> 0 then 'Title=Order ' || o_orderkey end, 'Author=' || o_orderpriority], lambda x: x is not null), '{SEP}') as metadata
            from orders
            left join (select doc_id, count(*) as n, bool_and(trim_box is not null) as t, bool_and(bleed is not null) as bl from box group by doc_id) b on b.doc_id = o_orderkey
            left join (select doc_id, count(*) as images, min(least(dpi_x, dpi_y)) as min_dpi, {_SQL_SPACES} as spaces,
              round(max(tac_max) * 10) / 10 as max_tac, count(*) filter (where least(dpi_x, dpi_y) < 300) as low,
              bool_or(contains(color_space, 'RGB')) as rgb from img group by doc_id) i on i.doc_id = o_orderkey
            left join (select doc_id, count(distinct name) as fonts, string_agg(distinct name || ' ' || embedded, '{SEP}' order by name || ' ' || embedded) as font_list,
              bool_or(not embedded) as loose from font group by doc_id) f on f.doc_id = o_orderkey""",
    ),
)
def doc_summary(spark, d):
    """Every third order has no title, every fourth no text."""
    orders, key = S.table(spark, d, "orders"), F.col("o_orderkey")
    docs = orders.select(
        key.alias("doc_id"), F.concat(F.lit("order-"), key.cast("string"), F.lit(".pdf")).alias("file"),
        F.length(F.concat("o_orderstatus", "o_orderpriority")).cast("bigint").alias("size_bytes"), F.sha2("o_orderpriority", 256).alias("sha256"),
    )
    title = F.when(key % 3 != 0, F.concat(F.lit("Order "), key.cast("string"))).otherwise("")
    entry = lambda pos, name, value: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("key"), value.alias("value"))
    meta = orders.select(key.alias("doc_id"), F.explode(F.array(entry(1, "Title", title), entry(2, "Author", F.col("o_orderpriority")))).alias("m")).select("doc_id", "m.*")
    boxes = S.boxes(spark, d, numbered=True)
    pages = boxes.select("doc_id", F.when(F.col("doc_id") % 4 == 0, " \t").otherwise("words").alias("text"))
    summary = R.doc_summary(docs, S.images(spark, d), S.fonts(spark, d), boxes, meta, pages)
    summary = summary.withColumn("metadata", F.transform("metadata", lambda e: F.concat_ws("=", e["key"], e["value"])))
    summary = summary.withColumn("font_list", F.transform("font_list", lambda f: F.concat_ws(" ", f["name"], f["embedded"].cast("string"))))
    for listed in ("boxes", "spaces", "warnings", "metadata", "font_list"):
        summary = summary.withColumn(listed, F.array_join(listed, SEP))
    return summary


# ---- sinks ----


@query(
    "sink_json",
    C.sql_findings(
        """select r.doc_id, to_json({'schema_version': 1, 'script_name': 'catalogue', 'input_file': r.doc_id::varchar, 'status': status,
             'total_pages_analyzed': total_pages_analyzed, 'error_count': error_count, 'warning_count': warning_count, 'info_count': info_count,
             'diagnostics': coalesce(found, []), 'checks_run': ['Enough words', 'No e-mail', 'Ends with a stop', 'Page length']})::varchar as json
           from report r left join (select doc_id, list({'id': id, 'severity': severity, 'check_name': check_name, 'message': message}
             order by check_no, page_no, id) as found from ident group by doc_id) i on i.doc_id = r.doc_id""",
        report=_SQL_REPORT,
    ),
)
def sink_json(spark, d):
    """The whole report documents; clean ones have an empty list of diagnostics."""
    found, docs = C.findings(spark, d), _paged(spark, d)
    run = K.checks_run(docs, C.all_checks())
    return R.json_reports(R.report_rollup(docs, found), K.identified(found), SCRIPT, run)


@query(
    "sink_csv",
    C.sql_findings(
        """select id, severity, check_name as "check", message, '' as line, 'catalogue' as script, i.doc_id::varchar as file, r.status
           from ident i join report r on r.doc_id = i.doc_id""",
        report=_SQL_REPORT,
    ),
)
def sink_csv(spark, d):
    found = C.findings(spark, d)
    return R.csv_rows(R.report_rollup(_paged(spark, d), found), K.identified(found), SCRIPT)


@query(
    "sink_sarif",
    C.sql_findings(
        """select doc_id, to_json({'$schema': 'https://json.schemastore.org/sarif-2.1.0.json', 'version': '2.1.0', 'runs': [{
             'tool': {'driver': {'name': 'quirecheck', 'rules': (select list({'id': n, 'shortDescription': {'text': n}} order by no)
               from (select check_name as n, min(check_no) as no from ident k where k.doc_id = i.doc_id group by check_name))}},
             'results': list({'ruleId': check_name, 'level': case when severity = 'info' then 'note' else severity end, 'message': {'text': message},
               'locations': [{'physicalLocation': {'artifactLocation': {'uri': 'catalogue'}, 'region': '{}'::json}}],
               'partialFingerprints': {'findingId/v1': id}, 'properties': {'inputFile': doc_id::varchar}} order by check_no, page_no)}]})::varchar as sarif
           from ident i group by doc_id"""
    ),
)
def sink_sarif(spark, d):
    """The whole SARIF documents."""
    return R.sarif_reports(K.identified(C.findings(spark, d)), SCRIPT)


@query(
    "sink_junit",
    C.sql_findings(
        """select doc_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<testsuites name="quirecheck' || counts || '>' || chr(10) ||
             '<testsuite name="catalogue' || counts || ' errors="0" skipped="0">' || chr(10) || body || chr(10) || '</testsuite>' || chr(10) ||
             '</testsuites>' || chr(10) as junit from suites""",
        listed="""select doc_id, check_name, min(check_no) as check_no, count(*) filter (where severity <> 'info') as failing,
             arg_min(message, page_no) filter (where severity <> 'info') as message, arg_min(severity, page_no) filter (where severity <> 'info') as severity,
             string_agg(id || ' [' || severity || '] ' || message, chr(10) order by page_no) || chr(10) as body from ident group by doc_id, check_name""",
        cases="""select d.doc_id, n as check_no, c.name, failing, f.message, f.severity, body
             from documents d cross join (values (1, 'Enough words'), (2, 'No e-mail'), (3, 'Ends with a stop')) c(n, name)
             left join listed f on f.doc_id = d.doc_id and f.check_name = c.name
             union all select doc_id, 100 + check_no, check_name, failing, message, severity, body from listed where check_name = 'Page length'""",
        texts="""select doc_id, check_no, coalesce(failing, 0) > 0 as fails, '<testcase name="' || name || '" classname="' || doc_id || '"' ||
             case when coalesce(failing, 0) > 0 then '><failure message="' || message || '" type="' || severity || '">' || chr(10) || body || '</failure></testcase>'
             when body is not null then '><system-out>' || body || '</system-out></testcase>' else '/>' end as xml from cases""",
        suites="""select doc_id, '" tests="' || count(*) || '" failures="' || count(*) filter (where fails) || '"' as counts,
             string_agg(xml, chr(10) order by check_no) as body from texts group by doc_id""",
    ),
)
def sink_junit(spark, d):
    """The whole JUnit documents; the check of the pages is not among those that ran, its findings are there all the same."""
    run = K.checks_run(S.table(spark, d, "documents").select("doc_id"), C.document_checks())
    return R.junit_reports(run, K.identified(C.findings(spark, d)), SCRIPT)
