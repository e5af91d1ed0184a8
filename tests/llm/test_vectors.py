"""URL rules, vector groups and top-k against plain versions and their SQL twins."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirecheck.llm import topk, url_filter, vector_dedup
from quirecheck.llm.queries import ORACLES, QUERIES, URL_RULES
from tests.support import compare, database, session

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(name):
    difference, rows, _ = compare(QUERIES[name](session(), SF_DIR), database(SF_DIR), ORACLES[name])
    assert difference == "" and rows


def plain_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:end], rest[end:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_rules_equal_a_plain_search():
    spark, rng = session(), random.Random(1)
    hosts = ["net", "example.net", "a.example.net", "org", "x.org", "Example.COM", "bexample.com", "co.uk", "-a.net", "", "net.", "é.net", "x" * 500 + ".org"]
    paths = ["", "/", "/en/", "/en/x", "/de/1", "/fr", "/fr/é", "/en/en/"]
    urls = [None, "", "no scheme", "://", "http://a.net?x://b.org/"] + [f"{rng.choice(['http', 'ftp', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f'])}" for _ in range(500)]
    rules = URL_RULES + [("example.net", "/en/en/", "block"), ("a.example.net", "/", "allow"), ("x.org", "/", "block"), ("x.org", "/", "allow"), ("uk", None, "block"), (None, "/", "block"), ("", "/", "block")]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(0, None, "x", "y")], "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), default="keep").collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = plain_parts(urls[r["page_id"]])
        fits = [(h + (p or ""), v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fits, key=lambda x: (len(x[0]), x[1] == "block"), default=(None, "keep"))
        assert (r["host"], r["path"], r["verdict"]) == (host, path, best[1]) and r["rule"] == best[0], urls[r["page_id"]]
    assert url_filter.judge_urls(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert url_filter.judge_urls(df, spark.createDataFrame([], "host string, path string, verdict string")).where("verdict = 'allow'").count() == len(got)


@pytest.mark.parametrize("cell, tile", [(2_000, 1_024), (12, 16)])
def test_vector_groups_equal_all_pairs(monkeypatch, cell, tile):
    monkeypatch.setattr(vector_dedup, "CELL", cell)
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    spark, rng = session(), np.random.default_rng(3)
    rows = []
    for _ in range(30):
        centre = rng.normal(size=8)
        for spread in (0, 0, 0.02, 0.05, 0.09, 0.2):
            rows.append((len(rows), [float(x) for x in centre * rng.uniform(0.5, 3) + rng.normal(size=8) * spread], int(rng.integers(2))))
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 5, [2.0] * 5, [1e200] * 8, [1e-200] * 8]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, rows[0][1], None), (2001, rows[0][1], None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")

    def unit(v):
        a = np.array([np.nan if x is None else x for x in v or []], float)
        return a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()) if len(a) and np.isfinite(a).all() and a.any() else None

    units = {i: (unit(v), label) for i, v, label in rows}
    links = {i: {j for j, (w, m) in units.items() if i != j and u is not None and w is not None and None not in (k, m) and k == m and len(u) == len(w) and u @ w >= 0.98} for i, (u, k) in units.items()}
    group = {}
    for i in sorted(links):
        todo = [i] if i not in group else []
        while todo:
            a = todo.pop()
            if a not in group:
                group[a] = i
                todo += links[a]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicate_vectors(df).collect()}
    assert got == {i: (len(links[i]), group[i], group[i] == i) for i in links}
    assert vector_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile, big", [(1_024, 1), (7, 1), (7, 2**40)])
def test_top_k_equals_a_full_sort(monkeypatch, tile, big):
    monkeypatch.setattr(topk, "TILE", tile)
    spark, rng = session(), np.random.default_rng(5)
    vectors = {i: [int(x) * big for x in rng.integers(-3, 4, size=3)] for i in range(120)}
    vectors |= {500: None, 501: [1 * big], 502: vectors[0], 503: vectors[0]}
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()] + [(None, [9, 9, 9])], "vec_id long, vector array<long>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    wrap = lambda n: (n + 2**63) % 2**64 - 2**63
    known = {i: v for i, v in vectors.items() if v is not None}
    for q in (i for i in known if i % 10 == 0):
        scores = sorted((-wrap(sum(a * b for a, b in zip(known[q], v))), i) for i, v in known.items() if i != q)
        assert got.pop(q) == {n + 1: (i, -s) for n, (s, i) in enumerate(scores[:4])}
    assert not got and topk.top_k(df.limit(0), F.lit(True)).count() == 0 and topk.top_k(df.limit(1), F.lit(True)).count() == 0


@pytest.mark.parametrize("copies", [2, 10])
def test_top_k_of_a_repeated_query(copies):
    spark = session()
    rows = [(0, [10])] * copies + [(i, [6 - i]) for i in range(1, 6)]  # scores of the others: 50, 40, 30, 20, 10
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").coalesce(1)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")  # one tile
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0, k=5).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    assert got == [(i, i, 10 * (6 - i)) for i in range(1, 6)]


def test_quantised():
    spark = session()
    rows = [([0.5, -0.001],), ([float("nan")],), ([None, 1.0],), (None,), ([],), ([float("-inf")],)]
    got = [r["q"] for r in spark.createDataFrame(rows, "v array<float>").select(topk.quantised(F.col("v")).alias("q")).collect()]
    assert got == [[128, -1], None, None, None, None, None]


def test_a_query_leaves_a_shard_once_with_its_best():
    rng = np.random.default_rng(9)
    vectors = {i: rng.integers(-3, 4, size=4) for i in range(60)}

    def row(ids, query):
        return {"shard": 3, "query": query, "ids": np.array(ids, np.int64).tobytes(), "matrix": np.array([vectors[i] for i in ids], "<i1").tobytes(), "width": 4}

    rows = [row(range(at, at + 12), False) for at in range(0, 60, 12)] + [row([0, 20, 40], True)]
    schema = pa.schema([("shard", pa.int32()), ("query", pa.bool_()), ("ids", pa.binary()), ("matrix", pa.binary()), ("width", pa.int32())])
    got = [r for batch in topk._best(4)(iter(pa.RecordBatch.from_pylist([r], schema) for r in rows)) for r in batch.to_pylist()]
    assert [r["query_id"] for r in got] == [0, 20, 40]  # once for each of the five tiles before
    for r in got:
        want = sorted((-int(vectors[r["query_id"]] @ v), i) for i, v in vectors.items() if i != r["query_id"])[:4]
        assert [(int(x["minus"]), x["id"]) for x in r["best"]] == want


def test_tiles_are_packed_in_the_smallest_integers():
    for kind, number in zip(topk.KINDS, (100, 1_000, 100_000, 2**40)):
        row = {"ids": np.array([5, 6], np.int64).tobytes(), "matrix": np.array([[1, -number], [0, 2]], kind).tobytes(), "width": 2}
        ids, matrix = topk._unpacked(row)
        assert ids.tolist() == [5, 6] and matrix.tolist() == [[1, -number], [0, 2]]
    assert topk._inner(np.array([[2, 3, 9]], "<i1"), np.array([[100, 100]], "<i1")).tolist() == [[500]]
