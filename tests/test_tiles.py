"""Tiled comparison against the comparison of whole pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirecheck.functions import tiles as K
from quirecheck.operators import raster as R, tiles as T
from tests.support import session

SCHEMA = "doc_id int, page_no int, side int, page_w int, page_h int, planes binary"


def planes(a):
    return np.ascontiguousarray(a.transpose(2, 0, 1)).tobytes()


def framed(rows):
    df = session().createDataFrame(rows, SCHEMA)
    return df.select(F.struct("doc_id", "page_no").alias("page"), "side", "page_w", "page_h", "planes")


def pages_of(rng, alpha=False):
    """Pairs of pages: noise and coarse patterns, moved, disturbed, and cut to other sizes."""
    out = []
    for i in range(12):
        h, w = int(rng.integers(1, 90)), int(rng.integers(1, 90))
        depth = 4 if alpha else 3
        a = rng.integers(0, 256, (h, w, depth)).astype(np.uint8)
        if i % 2:
            a = np.repeat(np.repeat(rng.integers(0, 256, (h // 6 + 1, w // 6 + 1, depth)), 6, 0), 6, 1)[:h, :w].astype(np.uint8)
        b = np.roll(a, (int(rng.integers(-6, 7)), int(rng.integers(-6, 7))), (0, 1)).copy()
        b[rng.random((h, w)) < 0.02] = 0
        if i % 3 == 0:
            b = b[: max(1, h - 3), : max(1, w - 5)]
        out.append((i, a, b))
    return out


@pytest.mark.parametrize("blur, align, alpha", [(0, False, False), (1, True, False), (2, True, True)])
def test_tiles_equal_whole_pages(blur, align, alpha):
    pages = pages_of(np.random.default_rng(2 + blur), alpha)
    names = "rgba" if alpha else "rgb"
    fields = ",".join(f"{c}:int" for c in names)
    schema = f"doc_id int, page_no int, w int, h int, px array<struct<{fields}>>"
    px = lambda x: [tuple(int(v) for v in p) for p in x.reshape(-1, len(names))]
    spark = session()
    side = lambda k: spark.createDataFrame([(p[0], 1, p[k].shape[1], p[k].shape[0], px(p[k])) for p in pages], schema)
    whole = R.compare_rasters(R.pair_up(side(1), side(2), ["doc_id", "page_no"]), blur=blur, align=align, block=8).collect()
    rows = [(p[0], 1, k - 1, p[k].shape[1], p[k].shape[0], planes(p[k])) for p in pages for k in (1, 2)]
    found = T.compare_tiles(T.tiles_of(framed(rows), 16), blur=blur, align=align, block=8, size=16).collect()
    want = {r["doc_id"]: (r["dx"], r["dy"], round(r["diff_percent"], 9), r["areas"]) for r in whole}
    assert {r["page"]["doc_id"]: (r["dx"], r["dy"], round(r["diff_percent"], 9), r["areas"]) for r in found} == want
    assert not align or len({v[:2] for v in want.values()}) > 5


def test_pages_of_full_size_are_lined_up():
    rng = np.random.default_rng(7)
    h, w = 1754, 1240
    a = np.repeat(np.repeat(rng.integers(0, 256, (h // 6 + 1, w // 6 + 1, 3)), 6, 0), 6, 1)[:h, :w].astype(np.uint8)
    b = np.full_like(a, 255)
    b[10:, 14:] = a[:-10, :-14]
    b[400:440, 300:380] = 0
    found = T.compare_tiles(T.tiles_of(framed([(1, 1, 0, w, h, planes(a)), (1, 1, 1, w, h, planes(b))]))).collect()
    (r,) = found
    assert (r["dx"], r["dy"], r["width"], r["height"]) == (-14, -10, w, h)
    moved = np.full_like(b, 255)
    moved[:-10, :-14] = b[10:, 14:]
    mask = K.differing(a.transpose(2, 0, 1), moved.transpose(2, 0, 1), 0.05)
    assert r["diff_percent"] == pytest.approx(mask.mean() * 100) and r["areas"] == K.touched(mask, 32)


def test_odd_pages():
    white, black = bytes([255]) * 12, bytes(12)
    rows = [
        (1, 1, 0, 2, 2, white), (1, 1, 1, 2, 2, black), (None, 1, 0, 2, 2, white), (None, 1, 1, 2, 2, white), (2, None, 0, 2, 2, white),
        (3, 1, 0, 0, 0, b""), (3, 1, 1, 2, 2, white), (4, 1, 0, 2, 2, None), (4, 1, 1, 2, 2, white), (5, 1, 0, 4, 1, white), (5, 1, 1, 1, 4, black),
    ]
    got = {(r["page"]["doc_id"], r["page"]["page_no"]): (r["dx"], r["dy"], r["diff_percent"], r["areas"], r["width"], r["height"]) for r in T.compare_tiles(T.tiles_of(framed(rows))).collect()}
    assert got == {(1, 1): (0, 0, 100.0, 1, 2, 2), (None, 1): (0, 0, 0.0, 0, 2, 2), (5, 1): got[(5, 1)]} and got[(5, 1)][2:] == (25.0, 1, 4, 4)
    assert T.compare_tiles(T.tiles_of(framed(rows).limit(0))).count() == 0
    with pytest.raises(ValueError):
        T.compare_tiles(T.tiles_of(framed(rows)), size=100)


def test_kernels():
    assert [K.furthest_equal(t) for t in (0.0, 0.05, 1.0)] == [0, 487, 195072]
    light = np.arange(15, dtype=np.uint8).reshape(3, 5)
    assert K.box_greys(light, 2).tolist() == [[3, 5, 6], [10, 12, 14]]
    sums, counts = K.shift_sums(light, np.pad(light, 1), np.pad(np.ones((3, 5), bool), 1), 1)
    assert sums[4] == 0 and counts.tolist() == [8, 10, 8, 12, 15, 12, 8, 10, 8] and sums[5] == 12


def test_similarity_equals_whole_pages():
    rng = np.random.default_rng(3)
    pages = [(i, rng.integers(0, 256, (40, 33, 3)).astype(np.uint8)) for i in range(4)]
    rows = [(i, 1, s, 33, 40, planes(np.clip(a.astype(int) + s * i * 9, 0, 255).astype(np.uint8))) for i, a in pages for s in (0, 1)] + [(9, 1, 0, 33, 40, planes(pages[0][1])), (9, 1, 1, 10, 1, bytes(30))]
    got = {r["page"]["doc_id"]: r["ssim"] for r in T.similarity(T.tiles_of(framed(rows), 16), 16).collect()}
    assert set(got) == {0, 1, 2, 3} and got[0] == pytest.approx(1.0)
    for i, a in pages:
        x, y = (K.luminance(np.frombuffer(r[5], np.uint8).reshape(3, 40, 33)).astype(float).ravel() for r in rows[2 * i : 2 * i + 2])
        cov = ((x - x.mean()) * (y - y.mean())).mean()
        want = (2 * x.mean() * y.mean() + 6.5025) * (2 * cov + 58.5225) / ((x.mean() ** 2 + y.mean() ** 2 + 6.5025) * (x.var() + y.var() + 58.5225))
        assert got[i] == pytest.approx(want)


def test_pages_of_one_tile_are_compared_where_they_meet(monkeypatch):
    """Only pages of several tiles are dealt again; a small page with a large version is one of them."""
    rng = np.random.default_rng(5)
    a = np.repeat(np.repeat(rng.integers(0, 256, (6, 6, 3)), 6, 0), 6, 1).astype(np.uint8)
    b = np.full_like(a, 255)
    b[4:, 2:] = a[:-4, :-2]
    small = [(1, 1, 0, 36, 36, planes(a)), (1, 1, 1, 36, 36, planes(b)), (2, 1, 0, 36, 36, planes(a)), (2, 1, 1, 30, 20, planes(a[:20, :30]))]
    mixed = [(3, 1, 0, 36, 36, planes(a)), (3, 1, 1, 36, 108, planes(np.concatenate([b] * 3))), (4, 1, 1, 36, 36, planes(b))]
    of = lambda rows, size: {r["page"]["doc_id"]: tuple(r)[1:] for r in T.compare_tiles(T.tiles_of(framed(rows), size), blur=1, block=8, size=size).collect()}
    want = of(small + mixed, 16)
    assert set(want) == {1, 2, 3} and want[1][:2] != (0, 0) and of(small + mixed, 64) == want

    def dealt(*_):
        raise AssertionError("pages of one tile were dealt again")

    monkeypatch.setattr(T, "shifts", dealt)
    assert of(small, 64) == {k: want[k] for k in (1, 2)}


def test_shift_sums_of_partly_known_windows():
    rng = np.random.default_rng(8)
    for h, w, reach in ((1, 1, 2), (5, 9, 4), (130, 128, 4)):
        a, window = (rng.integers(0, 256, s).astype(np.uint8) for s in ((h, w), (h + 2 * reach, w + 2 * reach)))
        known = np.zeros(window.shape, bool)
        known[reach // 2 : h + reach, 1 : w + 2] = True
        sums, counts = K.shift_sums(a, window, known, reach)
        places = [(y, x) for y in range(2 * reach + 1) for x in range(2 * reach + 1)]
        there = [known[y : y + h, x : x + w] for y, x in places]
        assert counts.tolist() == [int(t.sum()) for t in there]
        assert sums.tolist() == [int((np.abs(window[y : y + h, x : x + w].astype(int) - a) * t).sum()) for (y, x), t in zip(places, there)]


def test_similarity_reads_its_tiles_once():
    spark = session()
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    grey = bytes(range(240))
    tiles = T.tiles_of(framed([(1, 1, 0, 8, 10, grey), (1, 1, 1, 8, 10, grey), (2, 1, 0, 8, 10, grey), (2, 1, 1, 10, 8, grey)]), 16)
    found = T.similarity(tiles.mapInArrow(counted, tiles.schema), 16).collect()
    assert [(r["page"]["doc_id"], r["ssim"]) for r in found] == [(1, pytest.approx(1.0))] and seen.value == 4
