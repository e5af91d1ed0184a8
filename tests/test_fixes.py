"""Cases that once lost or mixed up rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quirecheck.operators import checks as K, pages as P, raster as X, reference as R, reports, structure
from quirecheck.sources import files as I
from tests.support import session


@pytest.fixture(scope="module")
def spark():
    return session()


def test_csv_rows_keep_their_own_width(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'k,v\n1,2,3\n\n"a ""q"" x, y",z\nonly\n"two\nlines",b,,\nx"y,z"\r\n,\n')
    rows = [r["cells"] for r in I.load_dataset_csv(spark, str(tmp_path)).orderBy("row_no").collect()]
    assert rows == [["k", "v"], ["1", "2", "3"], ['a "q" x, y', "z"], ["only"], ["two\nlines", "b", "", ""], ['x"y', 'z"'], ["", ""]]


def test_glossary_of_any_size_gives_one_answer(spark):
    docs = spark.createDataFrame([(1, "Hello wörld ab"), (2, None), (3, "")], "doc_id long, text string")
    few = [(1, "HELLO"), (2, ""), (3, None), (4, "ö"), (5, "zz"), (6, "ab")]
    many = few + [(100 + i, f"term {i} of many") for i in range(3000)]
    for terms in (few, many):
        got = {r["doc_id"]: r["missing"][:4] for r in R.missing_terms(docs, spark.createDataFrame(terms, "term_no long, term string")).collect()}
        assert got[1][:1] == ["zz"] and got[2] == got[3] == ["HELLO", "ö", "zz", "ab"]


def test_objects_belong_to_their_document(spark):
    objects = spark.createDataFrame([(1, 7, 100), (2, 7, 900)], "doc_id long, obj_id long, size long")
    wanted = spark.createDataFrame([(1, 7), (3, 7)], "doc_id long, obj_id long")
    rows = sorted(map(tuple, structure.object_sizes(objects, wanted).collect()))
    assert rows == [(1, 7, 100, None), (3, 7, None, "object 7 does not exist")]


def test_regions_of_pages_stay_apart(spark):
    spans = spark.createDataFrame([(1, 1, 0, "p1", 1.0, 1.0), (1, 2, 0, "p2", 1.0, 1.0), (1, 2, 1, "far", 99.0, 1.0)], "doc_id long, page_no long, pos long, text string, x double, y double")
    region = [("r", 0.0, 0.0, 5.0, 5.0)]
    assert sorted((r["page_no"], r["text"]) for r in P.text_in_regions(spans, region).collect()) == [(1, "p1"), (2, "p2")]
    pages = spark.createDataFrame([(1, 1, ""), (1, 2, ""), (2, 1, "")], "doc_id long, page_no long, text string")
    rows = {r["doc_id"]: (r["text"], r["error"]) for r in P.text_in_page_regions(spans, pages, 2, region).collect()}
    assert rows == {1: ("p2", None), 2: (None, "page 2 does not exist (the document has 1)")}


def test_added_pages_have_an_origin(spark):
    schema = "doc_id long, page_no long, w int, h int, px array<int>"
    light, dark = [200, 210, 190, 205], [3, 90, 14, 60]
    old = spark.createDataFrame([(1, 1, 2, 2, light)], schema)
    new = spark.createDataFrame([(1, 1, 2, 2, light), (1, 2, 2, 2, light), (1, 3, 2, 2, dark), (2, 1, 2, 2, light)], schema)
    got = {(r["doc_id"], r["page_no"]): r["origin"] for r in X.provenance(new, old).collect()}
    assert got == {(1, 1): "in place", (1, 2): "moved", (1, 3): "rewritten", (2, 1): "rewritten"}


def test_ranges_have_a_limit_only_where_they_are_listed(spark):
    row = spark.range(1).select(
        P.in_range(F.lit("1-5000000"), F.lit(4_000_000)).alias("inside"), P.page_list(F.lit("1-5000000")).alias("listed"), P.page_list(F.lit("2-3"), 2).alias("short")
    ).first()
    assert row["inside"] is True and row["listed"] is None and row["short"] == [2, 3]


def _findings(spark):
    rows = [(1, 0, 1, "error", "A & B", 'is "wrong"'), (1, 2, 1, "warning", "A & B", "late"), (1, 0, 0, "error", "loading", "lost <file>"), (2, 0, 2, "info", "C", "note")]
    return spark.createDataFrame(rows, "doc_id long, page_no long, check_no long, severity string, check_name string, message string")


def test_junit_keeps_every_finding(spark):
    import xml.etree.ElementTree as ET

    docs = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, page_count long")
    checks = [K.Check("A & B", F.lit(True), F.lit("")), K.Check("C", F.lit(True), F.lit(""))]
    found = K.identified(_findings(spark))
    suites = {r["doc_id"]: ET.fromstring(r["junit"]) for r in reports.junit_reports(K.checks_run(docs, checks), found, "s & t").collect()}
    assert {d: [(c.get("name"), [x.tag for x in c]) for c in s.iter("testcase")] for d, s in suites.items()} == {
        1: [("A & B", ["failure"]), ("C", []), ("loading", ["failure"])], 2: [("A & B", []), ("C", ["system-out"])], 3: [("A & B", []), ("C", [])],
    }
    assert suites[1].get("tests") == "3" and suites[1].get("failures") == "2" and suites[2][0].get("failures") == "0" and suites[1][0].get("name") == "s & t"
    failure = suites[1][0][0][0]
    assert failure.get("message") == 'is "wrong"' and failure.get("type") == "error"
    lines = [x.strip() for x in failure.text.strip().splitlines()]
    assert [x.split(" ", 1)[1] for x in lines] == ['[error] is "wrong"', "[warning] late"]


def test_json_and_sarif_are_whole(spark):
    docs = spark.createDataFrame([(1, 4), (2, 1), (3, 1)], "doc_id long, page_count long")
    found = K.identified(_findings(spark)).withColumn("line", F.when(F.col("page_no") > 0, F.col("page_no")).cast("int"))
    run = K.checks_run(docs, [K.Check("C", F.lit(True), F.lit(""))])
    rolled = reports.report_rollup(docs, found)
    out = {r["doc_id"]: json.loads(r["json"]) for r in reports.json_reports(rolled, found, "s", run=run, profile="strict").collect()}
    assert out[3]["diagnostics"] == [] and out[3]["checks_run"] == ["C"] and out[3]["profile"] == "strict" and "fixes" not in out[3]
    assert [d.get("line") for d in out[1]["diagnostics"]] == [None, None, 2] and list(out[1])[0] == "schema_version"
    sarif = {r["doc_id"]: json.loads(r["sarif"]) for r in reports.sarif_reports(found, "s").collect()}
    regions = [r["locations"][0]["physicalLocation"]["region"] for r in sarif[1]["runs"][0]["results"]]
    assert regions == [{}, {}, {"startLine": 2}]


def _colour(rng, w, h):
    return [(rng.randrange(256), rng.randrange(256), rng.randrange(256)) for _ in range(w * h)]


def _plain_compare(a, wa, ha, b, wb, hb, threshold=0.05, block=4):
    """Share of differing pixels and touched blocks, pixel by pixel on a white canvas."""
    w, h = max(wa, wb), max(ha, hb)
    at = lambda p, pw, ph, x, y: p[y * pw + x] if x < pw and y < ph else (255, 255, 255)
    white = lambda p: [v * (p[3] / 255) + 255 * (1 - p[3] / 255) for v in p[:3]] if len(p) == 4 else list(p)
    differ = {(x, y) for y in range(h) for x in range(w)
              if sum((u - v) ** 2 for u, v in zip(white(at(a, wa, ha, x, y)), white(at(b, wb, hb, x, y)))) ** 0.5 / 441.67 > threshold}
    return len(differ) / (w * h) * 100, len({(x // block, y // block) for x, y in differ})


def _pages(spark, rows, planes="rgb"):
    pixel = ", ".join(f"{c}: int" for c in planes)
    schema = f"doc_id long, page_no long, w_a int, h_a int, px_a array<struct<{pixel}>>, w_b int, h_b int, px_b array<struct<{pixel}>>"
    return spark.createDataFrame(rows, schema)


def test_compare_rasters_against_single_pixels(spark):
    import random

    rng = random.Random(9)
    rows, want = [], {}
    for n in range(1, 7):
        wa, ha, wb, hb = (rng.randrange(5, 14) for _ in range(4))
        a, b = _colour(rng, wa, ha), _colour(rng, wb, hb)
        b = [a[i] if i < len(a) and rng.random() < 0.6 and (wa, ha) == (wb, hb) else p for i, p in enumerate(b)]
        rows.append((1, n, wa, ha, a, wb, hb, b))
        want[n] = _plain_compare(a, wa, ha, b, wb, hb)
    got = {r["page_no"]: r for r in X.compare_rasters(_pages(spark, rows), align=False, block=4).collect()}
    for n, (percent, areas) in want.items():
        assert got[n]["diff_percent"] == pytest.approx(percent) and got[n]["areas"] == areas and got[n]["dx"] == 0


def test_transparent_pixels_are_white(spark):
    clear, white = [(10, 20, 30, 0)] * 9, [(255, 255, 255, 255)] * 9
    row = X.compare_rasters(_pages(spark, [(1, 1, 3, 3, clear, 3, 3, white)], "rgba")).first()
    assert row["diff_percent"] == 0.0 and row["areas"] == 0


def test_shifted_page_is_lined_up_and_told(spark):
    w, h = 160, 120

    def page(dx, dy):
        """Blots inside a white border, moved by (dx, dy)."""
        inside = lambda x, y: 20 <= x < 140 and 20 <= y < 100
        return [(0, 0, 0) if inside(x - dx, y - dy) and ((x - dx) // 5 * 31 + (y - dy) // 7 * 17) % 11 < 4 else (255, 255, 255) for y in range(h) for x in range(w)]

    pairs = _pages(spark, [(1, 1, w, h, page(0, 0), w, h, page(6, 4)), (1, 2, w, h, page(0, 0), w, h, page(0, 0))])
    still = {r["page_no"]: r["diff_percent"] for r in X.compare_rasters(pairs, align=False).collect()}
    rows = {r["page_no"]: r for r in X.compare_rasters(pairs).collect()}
    assert (rows[1]["dx"], rows[1]["dy"]) == (-6, -4) and rows[1]["diff_percent"] == 0.0 < still[1] and rows[2]["dx"] == 0
    inked = page(6, 4)
    inked[5 * w + 80] = (200, 0, 0)
    found = X.pixel_findings(X.compare_rasters(_pages(spark, [(1, 7, w, h, page(0, 0), w, h, inked)]))).first()["message"]
    assert found == "page 7: 0.01% of the pixels differ, in 1 area(s) (aligned by -6, -4 px)"


def test_blur_hides_single_pixels(spark):
    white = [(255, 255, 255)] * 81
    dotted = list(white)
    dotted[40] = (200, 200, 200)
    pairs = _pages(spark, [(1, 1, 9, 9, white, 9, 9, dotted)])
    assert X.compare_rasters(pairs, align=False).first()["diff_percent"] > 0
    assert X.compare_rasters(pairs, blur=1, align=False).first()["diff_percent"] == 0


def test_no_compared_page_is_no_similarity(spark):
    differences = spark.createDataFrame([(1, 1, 20.0), (1, 2, 0.0)], "doc_id long, page_no long, diff_percent double")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert {r["doc_id"]: r["similarity"] for r in X.pixel_similarity(differences, docs).collect()} == {1: 90.0, 2: 0.0}


def test_golden_difference_sees_nulls_and_every_field(spark):
    from quirecheck.operators import incremental as J

    report = "doc_id long, schema_version int, status string, profile string"
    finding = "doc_id long, id string, severity string, check_name string, message string"
    e, a = spark.createDataFrame([(1, 1, "PASS", "a")], report), spark.createDataFrame([(1, 2, "PASS", None)], report)
    same = spark.createDataFrame([(1, "Q", "error", "c", None)], finding)
    got = sorted(r["difference"] for r in J.golden_diff(e, a, same, same).collect())
    assert got == ["profile: expected a, got null", "schema_version: expected 1, got 2"]
    none = same.limit(0)
    assert [r["difference"] for r in J.golden_diff(e, e, same, none).collect()] == ["missing: Q | error | c | null"]


def test_line_differences_are_linear(spark):
    import time

    from quirecheck.functions import text

    n = 200_000
    df = spark.createDataFrame([("\n".join(f"old {i}" for i in range(n)), "\n".join(f"old {i}" if i % 2 else f"new {i}" for i in range(n)))], "a string, b string")
    start = time.time()
    row = df.select(F.size(text.line_diff(F.col("a"), F.col("b"))).alias("n"), text.diff_sample(F.col("a"), F.col("b"), 1).alias("s")).first()
    assert row["n"] == n and row["s"] == " | -old 0 | +new 0" and time.time() - start < 60


def test_numbers_of_tasks_follow_the_size_of_the_table(spark, monkeypatch):
    """A task that orders the elements of documents does not hold more of a larger table."""
    from quirecheck.plans import all_queries
    from quirecheck.sources import reading, standins

    d = "/root/testdata/sf0.001"
    few = sorted(map(tuple, all_queries()["list_fonts"].build(spark, d).collect()))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = os.path.getsize(f"{d}/lineitem.parquet")
    monkeypatch.setattr(reading, "TASK_BYTES", size // (usual + 5))
    assert standins.numbered_lines(spark, d).rdd.getNumPartitions() > usual
    many = all_queries()["list_fonts"].build(spark, d)
    assert many.rdd.getNumPartitions() > usual and sorted(map(tuple, many.collect())) == few


def test_pages_with_their_spans_need_no_shuffle(spark):
    from quirecheck.plans import all_queries

    regions = [("a", 0.0, 0.0, 20.0, 20.0), ("b", 10.0, 10.0, 30.0, 5.0), ("none", 90.0, 90.0, 1.0, 1.0)]
    rows = [(d, n, p, f"w{p}" if p % 5 else None, float(p * 7 % 40) if p % 6 else None, float(p * 3 % 25)) for d in (1, 2, None) for n in (1, 2) for p in range(d or 9, 30)]
    spans = spark.createDataFrame(rows[::-1], "doc_id int, page_no int, pos int, text string, x double, y double")
    pages = spans.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct("pos", "text", "x", "y")).alias("spans"))
    empty = spark.createDataFrame([(9, 1, []), (9, 2, None)], "doc_id int, page_no int, spans array<struct<pos:int,text:string,x:double,y:double>>")
    want = sorted(map(repr, P.text_in_regions(spans, regions, " ").collect()))
    assert sorted(map(repr, P.text_of_pages_in_regions(pages.union(empty), regions, " ").collect())) == want and len(want) == 12
    # Only the few files of a small table are dealt to all cores.
    plan = all_queries()["extract_from_region"].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") <= 1
