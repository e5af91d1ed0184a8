"""Comparison of page-size rasters as tables of tiles.

A page is many rows: (page, side, page_w, page_h, ty, tx, planes), where ``page`` is a struct of the
page's keys, side 0 the old version and 1 the new one, and ``planes`` the bytes of one tile, plane by
plane, row by row. A tile is ``size`` pixels wide and high, less at the right and lower edge. Steps that
look past a tile's edge deal pieces of tiles to the windows that need them; what a step finds out about
a page is summed up from its tiles by a grouped aggregate. No task holds a page of more than one tile;
two versions of one tile each are compared where they first meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quirecheck.functions import raster as X, tiles as K
from quirecheck.operators.unions import union_all
from quirecheck.sources.checkpoints import discard, scratch_path, stored

#: Pixels of a tile's side.
SIZE = 256
_PIECE = "side int, height int, width int, ty int, tx int, y int, x int, h int, w int, planes binary"


def _page_ddl(df: DataFrame) -> str:
    return f"page {df.schema['page'].dataType.simpleString()}"


def _tile(data: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, h, w) if h * w else np.zeros((3, h, w), np.uint8)


#: Rows and bytes of a record batch.
_ROWS, _BYTES = 512, 1 << 23


def gathered(rows: Iterable[tuple], columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Record batches of rows of a page, as an array of one key, and the values of ``columns``; a batch for each row would cost more than its tile."""
    held, size = [], 0

    def batch():
        page, *values = zip(*held)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(page), *(pa.array(v, k) for v, k in zip(values, columns.values()))], names=["page", *columns])

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= _ROWS or size >= _BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


_I, _B, _N, _L = pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64())


def tiles_of(pages: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of whole rasters: rows (page, side, page_w, page_h, planes), all rows of each plane one after the other.

    Rasters without pixels and null rasters have no tiles.
    """

    def rows(batches):
        for batch in batches:
            side, width, height = (batch.column(c).to_pylist() for c in ("side", "page_w", "page_h"))
            for i, data in enumerate(batch.column("planes")):
                if not data.is_valid or not width[i] or not height[i]:
                    continue
                whole, page = _tile(data.as_buffer(), height[i], width[i]), batch.column("page").slice(i, 1)
                for ty in range(-(-height[i] // size)):
                    for tx in range(-(-width[i] // size)):
                        yield page, side[i], width[i], height[i], ty, tx, whole[:, ty * size : (ty + 1) * size, tx * size : (tx + 1) * size].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(rows(batches), {"side": _I, "page_w": _I, "page_h": _I, "ty": _I, "tx": _I, "planes": _B})

    return pages.select("page", "side", "page_w", "page_h", "planes").mapInArrow(run, f"{_page_ddl(pages)}, side int, page_w int, page_h int, ty int, tx int, planes binary")


def _pieces(tiles: DataFrame, size: int, margin: int = 0) -> DataFrame:
    """What each window gets of each tile. Rows also have dx, dy, by which the tile is moved, and the size of the canvas, right and bottom.

    The window of a tile of the canvas is larger than it by ``margin`` on all sides.
    """

    def rows(batches):
        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("side", "page_w", "page_h", "ty", "tx", "dx", "dy", "right", "bottom")))
            for i, (side, page_w, page_h, ty, tx, dx, dy, right, bottom) in enumerate(columns):
                h, w = min(size, page_h - ty * size), min(size, page_w - tx * size)
                tile, page = _tile(batch.column("planes")[i].as_buffer(), h, w), batch.column("page").slice(i, 1)
                top, left = ty * size + dy, tx * size + dx
                for to_y in range(max(0, (top - margin) // size), min(-(-bottom // size), (top + h - 1 + margin) // size + 1)):
                    for to_x in range(max(0, (left - margin) // size), min(-(-right // size), (left + w - 1 + margin) // size + 1)):
                        # The window, and the part of it that this tile has, on the canvas.
                        y0, x0 = to_y * size - margin, to_x * size - margin
                        y1, x1 = min((to_y + 1) * size, bottom) + margin, min((to_x + 1) * size, right) + margin
                        a, b, c, d = max(y0, top), min(y1, top + h), max(x0, left), min(x1, left + w)
                        if a < b and c < d:
                            part = tile[:, a - top : b - top, c - left : d - left]
                            yield page, side, bottom, right, to_y, to_x, a - y0, c - x0, b - a, d - c, part.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(rows(batches), dict.fromkeys(("side", "height", "width", "ty", "tx", "y", "x", "h", "w"), _I) | {"planes": _B})

    moved = tiles.select("page", "side", "page_w", "page_h", "ty", "tx", "dx", "dy", "right", "bottom", "planes")
    return moved.mapInArrow(run, f"{_page_ddl(tiles)}, {_PIECE}")


class Window(NamedTuple):
    """Part of a canvas of ``height`` and ``width``: the planes, 0 where nothing is, and a mask of what is there."""

    planes: np.ndarray
    known: np.ndarray
    height: int
    width: int


Kernel = Callable[[int, int, dict[int, Window]], Iterable[dict]]


def _on_windows(pieces: DataFrame, size: int, margins: dict[int, int], kernel: Kernel, returns: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """Rows of ``kernel(ty, tx, windows)`` for every place of a canvas, with the window of each side that is there."""

    def pieces_of(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ty", "tx", "side", "height", "width", "y", "x", "h", "w")]
            keys = batch.column("page").to_pylist()
            for i, row in enumerate(zip(*columns)):
                yield (repr(keys[i]), row[0], row[1]), row, batch.column("page").slice(i, 1), batch.column("planes")[i]

    def rows(batches):
        for (_, ty, tx), group in groupby(pieces_of(batches), key=lambda r: r[0]):
            windows: dict[int, Window] = {}
            for _, (_, _, side, height, width, y, x, h, w), page, data in group:
                part = _tile(data.as_buffer(), h, w)
                if side not in windows:
                    m = margins[side]
                    tall, wide = min(size, height - ty * size) + 2 * m, min(size, width - tx * size) + 2 * m
                    windows[side] = Window(np.zeros((len(part), tall, wide), np.uint8), np.zeros((tall, wide), bool), height, width)
                windows[side].planes[:, y : y + h, x : x + w] = part
                windows[side].known[y : y + h, x : x + w] = True
            for found in kernel(ty, tx, windows):
                yield page, ty, tx, *(found.get(c) for c in returns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(rows(batches), {"ty": _I, "tx": _I} | {c: kind for c, (_, kind) in returns.items()})

    schema = ", ".join([_page_ddl(pieces), "ty int", "tx int", *(f"{c} {ddl}" for c, (ddl, _) in returns.items())])
    keys = ["page", "ty", "tx"]
    # A number of its own, since few bytes can be much work.
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _still(tiles: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return tiles.withColumns({"dx": zero, "dy": zero, "right": F.col("page_w"), "bottom": F.col("page_h")})


def _blurred_window(window: Window, radius: int) -> np.ndarray:
    planes, known, *_ = window
    if not radius:
        return planes
    rows, columns = np.flatnonzero(known.any(1)), np.flatnonzero(known.any(0))
    inner = planes[:, rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
    # The edges of a page are repeated outwards; a page narrower than the margin ends within the window.
    around = [(0, 0), (rows[0], len(known) - 1 - rows[-1]), (columns[0], known.shape[1] - 1 - columns[-1])]
    return K.box_means(np.pad(inner, around, "edge"), radius)


def _blurred(tiles: DataFrame, radius: int, size: int, scales: tuple[int, ...], whole: Callable[[np.ndarray, np.ndarray, dict, dict], dict]) -> DataFrame:
    """Rows of two kinds: tiles of pages of several tiles, blurred, and what ``whole`` finds out about two versions of one tile each.

    Every pixel becomes the mean of its surroundings, ``radius`` wide; the edges of a page are repeated outwards. For each of
    ``scales`` a column grey<scale> has the tile's grey copy of that many times fewer pixels a side. ``size`` is a multiple
    of the scales, so their boxes stay within tiles. Rows of the second kind, and no others, have no side.
    """
    returns = {
        "side": ("int", _I), "page_w": ("int", _I), "page_h": ("int", _I), "planes": ("binary", _B), **{f"grey{s}": ("binary", _B) for s in scales},
        **{c: ("int", _I) for c in ("dx", "dy", "right", "bottom")}, "changed": ("long", _N), "areas": ("long", _N),
    }

    def kernel(ty, tx, windows):
        soft = {side: _blurred_window(w, radius) for side, w in windows.items()}
        greys = {side: {s: K.box_greys(light, s) for s in scales} for side, light in ((k, K.luminance(p) if scales else None) for k, p in soft.items())}
        if len(windows) == 2 and all(w.height <= size and w.width <= size for w in windows.values()):
            yield whole(soft[0], soft[1], greys[0], greys[1])
        else:
            for side, w in windows.items():
                yield {"side": side, "page_w": w.width, "page_h": w.height, "planes": soft[side].tobytes()} | {f"grey{s}": g.tobytes() for s, g in greys[side].items()}

    return _on_windows(_pieces(_still(tiles), size, radius), size, {0: radius, 1: radius}, kernel, returns)


def _greys(ready: DataFrame, scale: int) -> DataFrame:
    """Tiles of the grey copies."""
    small = lambda c: F.ceil(F.col(c) / scale).cast("int").alias(c)
    return ready.select("page", "side", small("page_w"), small("page_h"), "ty", "tx", F.col(f"grey{scale}").alias("planes"))


def _searched(greys: DataFrame, centres: DataFrame, size: int, reach: int, threshold: float) -> DataFrame:
    """(page, at, rough): the place, in scan order around the centre, where the new page fits the old one best, and the share that differs there.

    ``centres`` has (page, cx, cy). Every tile sums up its differences at each shift; the sums of a page decide.
    """
    moved = greys.join(centres, "page").withColumns(
        {
            "dx": F.when(F.col("side") == 1, -F.col("cx")).otherwise(0), "dy": F.when(F.col("side") == 1, -F.col("cy")).otherwise(0),
            "right": F.col("w_a"), "bottom": F.col("h_a"),
        }
    )
    count = 2 * reach + 1

    def kernel(ty, tx, windows):
        if len(windows) == 2:
            sums, counts, rough = K.searched(windows[0].planes[0], windows[1].planes[0], windows[1].known, reach, threshold)
            yield {"sums": sums, "counts": counts, "rough": rough}

    # Of the new page a tile sees the surroundings too.
    pieces = _pieces(moved.where("side = 0"), size).unionByName(_pieces(moved.where("side = 1"), size, reach))
    found = _on_windows(pieces, size, {0: 0, 1: reach}, kernel, {"sums": ("array<long>", _L), "counts": ("array<long>", _L), "rough": ("long", _N)})
    totals = found.select("page", "rough", F.posexplode(F.arrays_zip("sums", "counts")).alias("at", "x")).groupBy("page", "at").agg(F.sum("x.sums").alias("s"), F.sum("x.counts").alias("n"), F.sum("rough").alias("rough"))
    middle = F.col("at") == count * reach + reach
    share = F.max(F.when(middle & (F.col("n") > 0), F.col("rough") / F.col("n") * 100))
    # Without any common pixel a page stays at its centre.
    best = F.min(F.when(F.col("n") > 0, F.struct((F.col("s") / F.col("n")).alias("mean"), "at")))
    return totals.groupBy("page").agg(F.coalesce(best["at"], F.lit(count * reach + reach)).alias("at"), F.coalesce(share, F.lit(0.0)).alias("rough"))


def shifts(
    ready: DataFrame, sizes: DataFrame, size: int = SIZE, threshold: float = 0.05, align_above: float = 3.0, max_offset: int = 32, coarse: int = 8, fine: int = 2
) -> DataFrame:
    """(page, dx, dy): how far the new page is moved to fit the old one, from tiles with their grey copies.

    Coarse grey copies of the pages are compared at all shifts up to ``max_offset`` pixels, and the best one is
    refined on fine copies. A page whose coarse copies hardly differ stays where it is.
    """
    path = scratch_path(ready.sparkSession, "tile-centres")
    reach = max(max_offset // coarse, 2)
    scaled = lambda n, scale: F.ceil(F.col(n) / scale).cast("int").alias(n)
    zero = sizes.select("page", scaled("w_a", coarse), scaled("h_a", coarse), F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    first = _searched(_greys(ready, coarse), zero, size // coarse, reach, threshold)
    side = 2 * reach + 1
    # Truncates toward zero, like the integer division it stands for.
    on = lambda v: F.when(v < 0, F.ceil(v * coarse / fine)).otherwise(F.floor(v * coarse / fine)).cast("int")
    moving = first.where(F.col("rough") >= align_above)
    centres = moving.select("page", on(F.col("at") % side - reach).alias("cx"), on(F.floor(F.col("at") / side) - reach).alias("cy"))
    centres = stored(centres.join(sizes.select("page", scaled("w_a", fine), scaled("h_a", fine)), "page"), path)
    near = coarse // fine
    second = _searched(_greys(ready, fine), centres, size // fine, near, threshold).join(centres.select("page", "cx", "cy"), "page")
    wide = 2 * near + 1
    # The search asks where the old page lies in the new one, the result says the reverse.
    found = second.select("page", ((near - F.col("cx") - F.col("at") % wide) * fine).cast("int").alias("dx"), ((near - F.col("cy") - F.floor(F.col("at") / wide)) * fine).cast("int").alias("dy"))
    moves = stored(sizes.select("page").join(found, "page", "left").select("page", F.coalesce("dx", F.lit(0)).alias("dx"), F.coalesce("dy", F.lit(0)).alias("dy")), scratch_path(ready.sparkSession, "tile-moves"))
    discard(ready.sparkSession, path)
    return moves


def page_sizes(tiles: DataFrame) -> DataFrame:
    """(page, w_a, h_a, w_b, h_b) of the pages that both versions have."""
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    sizes = tiles.groupBy("page").agg(of(0, "page_w").alias("w_a"), of(0, "page_h").alias("h_a"), of(1, "page_w").alias("w_b"), of(1, "page_h").alias("h_b"))
    return sizes.where("w_a is not null and w_b is not null")


def compare_tiles(
    tiles: DataFrame, threshold: float = 0.05, blur: int = 0, align: bool = True, align_above: float = 3.0, max_offset: int = 32, coarse: int = 8, fine: int = 2, block: int = 32, size: int = SIZE
) -> DataFrame:
    """(page, dx, dy, diff_percent, areas, width, height) of the pages that both versions have.

    Both pages are blurred, the new one is moved to where it fits best, and their pixels are compared on a canvas
    that holds both; what is transparent, and what lies outside a page, is white. ``areas`` counts blocks of
    pixels that have a difference. ``size`` is a multiple of ``coarse``, ``fine`` and ``block``. Tiles of a page
    occur once; a null in the keys of a page is a value like others.
    """
    if any(size % n for n in (coarse, fine, block)):
        raise ValueError("the size of a tile must be a multiple of both scales and of the block")
    spark = tiles.sparkSession
    paths = [scratch_path(spark, f"tile-{name}") for name in ("pages", "sizes", "canvases")]
    scales = (coarse, fine) if align else ()

    def compared(a, b):
        mask = K.differing(a, b, threshold)
        return {"changed": int(np.count_nonzero(mask)), "areas": K.touched(mask, block)}

    def whole(a, b, greys_a, greys_b):
        dx, dy = K.lined_up(greys_a, greys_b, coarse, fine, max(max_offset // coarse, 2), threshold, align_above) if align else (0, 0)
        bottom, right = (max(p.shape[axis] for p in (a, b)) for axis in (1, 2))
        return {"dx": dx, "dy": dy, "right": right, "bottom": bottom} | compared(K.on_white(a, 0, 0, bottom, right), K.on_white(b, dy, dx, bottom, right))

    first = stored(_blurred(tiles, blur, size, scales, whole), paths[0])
    ready = first.where("side is not null")
    found = ["page", "dx", "dy", "right", "bottom", "changed", "areas"]
    done = first.where("side is null").select(*found)
    if not ready.select("side").isEmpty():
        # Tables of one row per page have a known size, so the planner decides how they meet the tiles.
        sizes = stored(page_sizes(ready), paths[1])
        still = sizes.select("page", F.lit(0).alias("dx"), F.lit(0).alias("dy"))
        moves = shifts(ready, sizes, size, threshold, align_above, max_offset, coarse, fine) if align else still
        canvas = sizes.select("page", F.greatest("w_a", "w_b").alias("right"), F.greatest("h_a", "h_b").alias("bottom")).join(moves, "page")
        canvas = stored(canvas, paths[2])
        own = lambda c: F.when(F.col("side") == 1, F.col(c)).otherwise(0)
        tiled = ready.select("page", "side", "page_w", "page_h", "ty", "tx", "planes").join(canvas, "page")
        pieces = _pieces(tiled.withColumns({"dx": own("dx"), "dy": own("dy")}), size)

        def kernel(ty, tx, windows):
            shape = next(iter(windows.values())).planes.shape
            sides = []
            for s in (0, 1):
                planes, known, *_ = windows.get(s) or (np.zeros(shape, np.uint8), np.zeros(shape[1:], bool))
                sides.append(planes if known.all() else np.where(known, planes, np.uint8(K.WHITE)))
            yield compared(*sides)

        parts = _on_windows(pieces, size, {0: 0, 1: 0}, kernel, {"changed": ("long", _N), "areas": ("long", _N)})
        totals = parts.groupBy("page").agg(F.sum("changed").alias("changed"), F.sum("areas").alias("areas"))
        done = union_all(done, canvas.join(totals, "page", "left").select(*found))
    # A part of the canvas that neither page covers is white on both sides.
    percent = F.coalesce("changed", F.lit(0)) / (F.col("right").cast("long") * F.col("bottom")) * 100
    out = done.select(
        "page", "dx", "dy", percent.alias("diff_percent"), F.coalesce("areas", F.lit(0)).cast("int").alias("areas"), F.col("right").alias("width"), F.col("bottom").alias("height")
    )
    out = stored(out, scratch_path(spark, "tile-differences"))
    discard(spark, *paths)
    return out


def _lights(tiles: DataFrame, size: int) -> DataFrame:
    """Grey tiles as pieces of a canvas that is the page itself."""

    def rows(batches):
        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("side", "page_w", "page_h", "ty", "tx")))
            for i, (side, page_w, page_h, ty, tx) in enumerate(columns):
                h, w = min(size, page_h - ty * size), min(size, page_w - tx * size)
                light = K.luminance(_tile(batch.column("planes")[i].as_buffer(), h, w))
                yield batch.column("page").slice(i, 1), side, page_h, page_w, ty, tx, 0, 0, h, w, light.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(rows(batches), dict.fromkeys(("side", "height", "width", "ty", "tx", "y", "x", "h", "w"), _I) | {"planes": _B})

    return tiles.select("page", "side", "page_w", "page_h", "ty", "tx", "planes").mapInArrow(run, f"{_page_ddl(tiles)}, {_PIECE}")


def similarity(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """(page, ssim): the global structural similarity of the grey values of pages that have one size in both versions."""

    def kernel(ty, tx, windows):
        # Pages of one size have the same tiles, so a tile tells by itself whether its page counts.
        if len(windows) == 2 and windows[0][2:] == windows[1][2:]:
            yield {"m": K.moments(windows[0].planes, windows[1].planes)}

    found = _on_windows(_lights(tiles, size), size, {0: 0, 1: 0}, kernel, {"m": ("array<long>", _L)})
    sums = found.groupBy("page").agg(*(F.sum(F.get("m", i)).cast("double").alias(c) for i, c in enumerate(("n", "a", "b", "aa", "bb", "ab"))))
    c, square = F.col, F.col("n") * F.col("n")

    def spread(x: str, y: str, xy: str) -> Column:
        return (c("n") * c(xy) - c(x) * c(y)) / square

    mean_a, mean_b = c("a") / c("n"), c("b") / c("n")
    index = ((mean_a * mean_b * 2 + X.C1) * (spread("a", "b", "ab") * 2 + X.C2)) / ((mean_a * mean_a + mean_b * mean_b + X.C1) * (spread("a", "a", "aa") + spread("b", "b", "bb") + X.C2))
    return sums.select("page", index.alias("ssim"))
