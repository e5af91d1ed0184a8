"""Operators on small tables: checks, files, lookups, ordinals, edits, batches."""

import json
import math
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quirecheck.operators import checks as K, codes as B, edits as E, incremental as J, ordinals, pages as P
from quirecheck.operators import raster as R, reference, reports, structure
from quirecheck.sources import files as I
from tests.support import session


@pytest.fixture(scope="module")
def spark():
    return session()


def test_checks(spark):
    docs = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "doc_id long, n int")
    check = K.Check("Size", F.col("n") >= 10, F.concat(F.lit("only "), F.col("n").cast("string")), tags=["a"], severity=K.WARNING)
    broken = K.Check("Broken", F.lit(True), error=F.when(F.col("doc_id") == 3, F.lit("division by zero")), severity=K.INFO)
    found = {(r.doc_id, r.severity, r.message) for r in K.run_checks(docs, [check, broken]).collect()}
    assert found == {(1, "warning", "only 5"), (2, "warning", None), (3, "error", "error in check: division by zero")}
    assert K.select_checks([check, K.Rule("r", F.lit(True))], ["a"]) == [check]
    with pytest.raises(ValueError):
        K.select_checks([check], ["none"])


def test_occurrence_across_spans(spark):
    rows = [(doc, page) for doc in (1, 2) for page in range(1, 40) if (doc + page) % 3]
    df = spark.createDataFrame(rows, "doc_id long, page_no long")
    got = ordinals.ordinal(df, ["doc_id"], "page_no", "n", span=7).collect()
    assert len(got) == len(rows)
    for doc in (1, 2):
        assert [r.n for r in sorted((r for r in got if r.doc_id == doc), key=lambda r: r.page_no)] == list(
            range(1, sum(d == doc for d, _ in rows) + 1)
        )


def test_wildcards_equal_a_shell_pattern(spark):
    """Against the standard library, for every pattern and name over a small alphabet."""
    from fnmatch import fnmatchcase
    from itertools import product

    names = ["".join(x) for n in range(1, 5) for x in product("a.b", repeat=n)]
    patterns = ["".join(x) for n in range(1, 4) for x in product("a.*", repeat=n)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for pattern in patterns:
        got = {r.name for r in df.filter(I.wildcard(F.col("name"), pattern)).collect()}
        assert got == {n for n in names if fnmatchcase(n, pattern)}, pattern


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,"b, ""c""\nd"\n\nx,\n', newline="")
    assert [r.cells for r in I.load_dataset_csv(spark, str(tmp_path / "t.csv")).orderBy("row_no").collect()] == [
        ["a", 'b, "c"\nd'], ["x", ""],
    ]
    (tmp_path / "o.json").write_text('[{"z": "1", "a": 2.50}, {"a": null}, {"z": true, "q": 1}]')
    rows = I.load_dataset_json(spark, str(tmp_path / "o.json")).orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["z", "a"], ["1", "2.50"], ["", ""], ["true", ""]]
    (tmp_path / "a.json").write_text('[["k", 1], ["m", null], {"x": 1}]')
    rows = I.load_dataset_json(spark, str(tmp_path / "a.json")).orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["k", "1"], ["m", ""], None]
    assert rows[2].error == "row 3 is an object, but the first row was an array"
    (tmp_path / "g.txt").write_text("# words\n\n  Hello \nTotal Warranty\n")
    assert [r.term for r in I.load_glossary(spark, str(tmp_path / "g.txt")).orderBy("term_no").collect()] == ["Hello", "Total Warranty"]
    assert {r.size for r in I.scan_files(spark, str(tmp_path), "*.txt").collect()} == {33}


def test_lookups_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(0, ["code", "name", "x"])] + [
        (i, [str(rng.randrange(40)), "".join(rng.choice("abcç ") for _ in range(9)), "r"]) for i in range(1, 60)
    ]
    keys = [str(k) for k in range(45)] + ["".join(rng.choice("abcç") for _ in range(n)) for n in (1, 2, 3, 4) for _ in range(25)]
    table = spark.createDataFrame(rows, "row_no long, cells array<string>")
    asked = spark.createDataFrame([(k,) for k in keys], "key string")
    norm = lambda s: " ".join(s.split()).lower()
    for r in reference.query_table(asked, table).collect():
        k = norm(r.key)
        want = next((c for _, c in rows[1:] if norm(c[0]) == k or (len(k.encode()) >= 3 and k in norm(c[1]))), None)
        assert r.cells == want, r.key


def test_missing_terms(spark):
    docs = spark.createDataFrame([(1, "Hello  WORLD again"), (2, ""), (3, "total warranty, hi")], "doc_id long, text string")
    terms = spark.createDataFrame([(0, "hello world"), (1, "Total Warranty"), (2, "hi"), (3, "zzz")], "term_no long, term string")
    got = {r.doc_id: r.missing for r in reference.missing_terms(docs, terms).collect()}
    assert got == {
        1: ["Total Warranty", "hi", "zzz"], 2: ["hello world", "Total Warranty", "hi", "zzz"], 3: ["hello world", "zzz"],
    }


def test_reachable_with_cycle(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "b", "c"), (1, "d", "e"), (2, "a", "d")], "doc_id long, src string, dst string")
    roots = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, node string")
    got = {(r.doc_id, r.node) for r in structure.reachable(edges, roots, compact_every=1).collect()}
    assert got == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "d")}


def test_provenance_equals_brute_force(spark):
    rng = random.Random(2)
    base = [[rng.randrange(256) for _ in range(16)] for _ in range(9)]

    def noisy(px, amount):
        return [min(255, max(0, v + rng.randint(-amount, amount))) for v in px]

    old, new = [], []
    for doc in range(30):
        pages = [noisy(rng.choice(base), rng.choice([0, 3, 20])) for _ in range(6)]
        old += [(doc, i + 1, 4, 4, p) for i, p in enumerate(pages)]
        fresh = [noisy(rng.choice(pages), rng.choice([0, 0, 8, 15, 30])) for _ in range(6)]
        new += [(doc, i + 1, 4, 4, p) for i, p in enumerate(fresh)]

    def ssim(a, b):
        n = len(a)
        ma, mb = sum(a) / n, sum(b) / n
        va, vb = sum((x - ma) ** 2 for x in a) / n, sum((y - mb) ** 2 for y in b) / n
        cov = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / n
        return ((2 * ma * mb + 6.5025) * (2 * cov + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))

    schema = "doc_id long, page_no long, w int, h int, px array<int>"
    got = {(r.doc_id, r.page_no): r.origin for r in R.provenance(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()}
    round3 = lambda v: math.floor(v * 1000 + 0.5) / 1000
    for doc, n, _, _, px in new:
        scores = {m: round3(ssim(px, q)) for e, m, _, _, q in old if e == doc}
        want = "in place" if scores[n] >= 0.995 else "moved" if any(s >= 0.98 for m, s in scores.items() if m != n) else "rewritten"
        assert got[(doc, n)] == want, (doc, n, scores)
    assert set(got.values()) == {"in place", "moved", "rewritten"}


def test_edits(spark):
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "z")], "doc_id long, page_no long, text string")

    def texts(df, doc=1):
        rows = sorted((r.page_no, r.text) for r in df.collect() if r.doc_id == doc)
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1))
        return "".join(t for _, t in rows)

    assert texts(E.delete_page(pages, F.lit(2))) == "ac" and texts(E.delete_page(pages, F.lit(1)), 2) == "z"
    assert texts(E.duplicate_page(pages, F.lit(2))) == "abbc"
    assert texts(E.reorder_pages(pages, F.array(*[F.lit(n).cast("bigint") for n in (3, 1, 2)]))) == "cab"
    assert texts(E.split_document(pages, F.lit(2), F.lit(3))) == "bc"
    assert texts(E.merge_documents(pages, pages.filter("doc_id = 2").withColumn("doc_id", F.lit(1).cast("long")))) == "abcz"
    with pytest.raises(ValueError):
        E.rotate_pages(pages, 45)
    with pytest.raises(ValueError):
        E.set_box(pages, "trim", (5, 0, 5, 9))


def test_page_ranges(spark):
    cases = {"1-3,2": [1, 2, 3], " 5 , 1 ": [1, 5], "3-1": None, "0": None, "x": None, "1-20000000": None, "": []}
    for spec, want in cases.items():
        assert spark.range(1).select(P.page_list(F.lit(spec)).alias("v")).first().v == want, spec
    assert spark.range(1).select(P.range_error(F.lit("1,3-1")).alias("v")).first().v == "3-1"


def test_journal_and_batches(spark):
    journal = spark.createDataFrame([(1, "a", "h1", 2), (2, "a", "h2", 0), (3, "b", "", 2)], "seq long, path string, sha256 string, exit long")
    arrivals = spark.createDataFrame([(9, "a", "h2"), (10, "b", ""), (11, "c", "h1")], "seq long, path string, sha256 string")
    assert {r.path for r in J.journal_pending(arrivals, journal).collect()} == {"b", "c"}
    files = spark.createDataFrame([("p1", 0), ("p2", 2), ("p3", 2), ("p0", 1)], "path string, exit long")
    assert {r.path for r in J.fail_fast(files).collect()} == {"p0", "p1", "p2"}
    assert J.batch_verdict(files).first().exit == 2 and J.batch_verdict(files.limit(0)).first().exit == 0


def test_golden_diff(spark):
    report = "doc_id long, status string, error_count long, warning_count long, info_count long, total_pages_analyzed long"
    e = spark.createDataFrame([(1, "PASS", 0, 0, 0, 2), (2, "PASS", 0, 0, 0, 1)], report)
    a = spark.createDataFrame([(1, "FAIL", 1, 0, 0, 2), (2, "PASS", 0, 0, 0, 1)], report)
    finding = "doc_id long, id string, severity string, check_name string, message string"
    none, one = spark.createDataFrame([], finding), spark.createDataFrame([(1, "Q-1", "error", "c", "m")], finding)
    runs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, checks_run string")
    other = spark.createDataFrame([(1, "b"), (2, "b")], "doc_id long, checks_run string")
    got = {(r.doc_id, r.difference) for r in J.golden_diff(e, a, none, one, runs, other).collect()}
    assert got == {
        (1, "status: expected PASS, got FAIL"), (1, "error_count: expected 0, got 1"), (1, "unexpected: Q-1 | error | c | m"),
        (2, "checks that ran: expected a, got b"),
    }


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, 2), (2, 1)], "doc_id long, page_count long")
    finding = "doc_id long, page_no long, check_no int, severity string, check_name string, message string"
    found = spark.createDataFrame(
        [(1, 0, 2, "info", "B", 'say "<hi>" & go'), (1, 1, 1, "warning", "A", "x, y"), (1, 2, 1, "warning", "A", "x, y")], finding
    )
    verdicts = reports.report_rollup(docs, found)
    assert {(r.doc_id, r.status, r.warning_count, r.info_count) for r in verdicts.collect()} == {(1, "PASS", 2, 1), (2, "PASS", 0, 0)}
    reports.write_reports(verdicts, found, "s", str(tmp_path))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, quote='"', escape='"').count() == 3
    known = K.identified(found)
    sarif = json.loads(reports.sarif_reports(known, "s").first().sarif)
    assert [r["id"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]] == ["A", "B"]
    assert [r["level"] for r in sarif["runs"][0]["results"]] == ["warning", "warning", "note"]
    assert len({r["partialFingerprints"]["findingId/v1"] for r in sarif["runs"][0]["results"]}) == 3
    checks = [K.Check("A", F.lit(True)), K.Check("B", F.lit(True))]
    lines = reports.junit_lines(reports.junit_cases(K.checks_run(docs, checks), known)).collect()
    assert len(lines) == 4
    suite = ET.fromstring("<s>" + "".join(r.xml for r in lines) + "</s>")
    assert sum(c.find("failure") is not None for c in suite) == 1
    codes = [(e, w) for e, w in ((1, 0), (0, 1), (0, 0))]
    got = [spark.range(1).select(reports.exit_code(F.lit(e), F.lit(w)).alias("v")).first().v for e, w in codes]
    assert got == [2, 1, 0]
    assert spark.range(1).select(reports.exit_code(F.lit(0), F.lit(1), fail_on_warning=True).alias("v")).first().v == 2
