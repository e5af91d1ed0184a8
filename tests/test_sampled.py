"""Rasters judged by an enlarged sample, which no batch holds as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirecheck.functions import raster as X
from tests.support import session


@pytest.fixture(scope="module")
def spark():
    return session()


def rasters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 8, 8, [x % 8 * 30 + int(v) for x, v in enumerate(rng.integers(0, 1 + i % 5, 64))]) for i in range(60)]
    rows += [(60 + i, 5, 7, rng.integers(0, 256, 35).tolist()) for i in range(20)] + [(80, 8, 8, None)]
    return spark.createDataFrame(rows, "n int, w int, h int, px array<int>")


@pytest.mark.parametrize("function, side", [(X.is_banded, 64), (X.blockiness, 32)])
def test_samples_equal_enlarged_rasters(spark, function, side):
    px, w, h = F.col("px"), F.col("w"), F.col("h")
    big = X.resize(px, w, h, F.lit(side), F.lit(side))
    found = rasters(spark).select(function(big, F.lit(side), F.lit(side)).alias("want"), function(px, w, h, side=side).alias("got")).collect()
    assert len({r.want for r in found}) > 2 and all(r.got == r.want for r in found)


def test_no_enlarged_raster_leaves_its_kernel(monkeypatch):
    """Before, a batch of rasters of 2,048 x 2,048 was 32 MB for each of its rows."""
    import pyarrow as pa
    import tracemalloc

    run = []
    monkeypatch.setattr(X.F, "arrow_udf", lambda f, kind: lambda *columns: run.append(f))
    X.is_banded("px", "w", "h", side=2048)
    rows = 40
    batch = pa.array([list(range(64))] * rows, pa.list_(pa.int32())), pa.array([8] * rows), pa.array([8] * rows)
    tracemalloc.start()
    assert len(run) == 1 and len(run[0](*batch)) == rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 8 * 2048 * 2048


def test_hash_keeps_no_sample(spark, monkeypatch):
    """Before, samples of 32 x 32 left one kernel for the next, a whole batch of them."""
    px, w, h, side = F.col("px"), F.col("w"), F.col("h"), F.lit(X.SIDE)
    big = X.resize(px, w, h, side, side)
    found = rasters(spark).select(X.low_frequencies(big, side, side).alias("want"), X.low_frequencies(px, w, h).alias("got")).collect()
    assert all(r.got == r.want for r in found)
    made = []
    monkeypatch.setattr(X.F, "arrow_udf", lambda f, kind: lambda *columns: made.append(kind))
    X.low_frequencies("px", "w", "h")
    assert len(made) == 1
