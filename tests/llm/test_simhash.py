"""Fingerprints and groups against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from quirecheck.llm import simhash
from quirecheck.llm.queries import op6_simhash
from quirecheck.llm.shared import components
from tests.support import session

SF_DIR = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=4):
    """Smallest reachable id for {id: fingerprint}."""
    ids, out = sorted(prints), {}
    for i in ids:
        if i in out:
            continue
        out[i], todo = i, [i]
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in out and (prints[a] ^ prints[b]).bit_count() <= radius:
                    out[b] = i
                    todo.append(b)
    return out


def test_query():
    spark = session()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = {(i, f"{prints[i]:016x}", c) for i, c in plain_groups(prints).items()}
    assert {tuple(r) for r in op6_simhash(spark, SF_DIR).collect()} == want


@pytest.mark.parametrize("tree", [8, 4096])
def test_links_keep_every_group(monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    spark, rng = session(), random.Random(tree)
    values = {rng.getrandbits(64) for _ in range(60)} | {0}
    for v in list(values)[:12]:  # chains and dense groups around some of them
        for _ in range(20):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                v ^= 1 << b
            values.add(v)
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    prints = dict(enumerate(sorted(values)))
    signed = {i: int(np.uint64(v).astype(np.int64)) for i, v in prints.items()}
    found = {r["node"]: r["component"] for r in components(simhash.links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"))).collect()}
    groups = {}
    for i, v in signed.items():
        groups.setdefault(found.get(v, v), set()).add(i)
    want = {}
    for i, c in plain_groups(prints).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_tree_walks_agree():
    rng = random.Random(1)
    values = list({rng.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree(values)
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if (a ^ b).bit_count() <= 2}
    assert {(i, j) for i, a in enumerate(values) for j in tree.within(a, 2)} == want
    pairs = {(int(i), int(j)) for who, at in tree.within_many(np.array(values, np.uint64), 2) for i, j in zip(who, at)}
    assert pairs == want


def test_odd_rows():
    spark = session()
    df = spark.createDataFrame([(5, None, 1), (3, "", 1), (9, "One two", 1), (9, "one  TWO", 1), (None, "one two", 1), (None, "alone here", 1), (4, "w " * 300_000, 1)], "doc_id long, text string, fp int")
    rows = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr)
    by = {(r[0], r[1]): r[2] for r in rows}
    assert len(rows) == 7 and by[(5, "0" * 16)] == 3 and by[(None, f"{plain_fingerprint('one two'):016x}")] == 9
    assert by[(None, f"{plain_fingerprint('alone here'):016x}")] is None
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components():
    spark, rng = session(), random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    known = {}
    for a, b in edges:
        known.setdefault(a, set()).add(b)
        known.setdefault(b, set()).add(a)
    for start in known:
        seen, todo = {start}, [start]
        while todo:
            more = known[todo.pop()] - seen
            seen |= more
            todo += more
        assert found.get(start, start) == min(seen)
