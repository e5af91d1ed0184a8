"""Line differences of a batch, a few rows after the other."""

import pyarrow as pa
import pytest

from quirecheck.functions import text as T


@pytest.mark.parametrize("function", [T.line_diff, T.diff_sample])
def test_stretches_equal_whole_batches(monkeypatch, function):
    """Before, the lines of a whole batch were coded and copied at once."""
    run, seen = [], []
    only = T._only
    monkeypatch.setattr(T, "lines", lambda c: c)
    monkeypatch.setattr(T.F, "arrow_udf", lambda f, kind: lambda *columns: run.append(f))
    monkeypatch.setattr(T, "_only", lambda left, right: seen.append(len(left)) or only(left, right))
    function("a", "b")
    rows = [["a", "b" * 9], None, [], ["c", "c", "d"], ["e"], ["x" * 50], ["y"]]
    left = pa.array(rows, pa.list_(pa.string()))
    right = pa.array([["a"], ["q"], ["z"], ["d"], None, ["y"], ["y"]], pa.list_(pa.string()))
    whole = run[0](left, right)
    monkeypatch.setattr(T, "STRETCH", 8)
    seen.clear()
    assert run[0](left, right).equals(whole) and len(whole) == 7 and max(seen) < 7
    assert len(run[0](left.slice(0, 0), right.slice(0, 0))) == 0
    assert run[0](left.slice(3, 3), right.slice(3, 3)).equals(whole.slice(3, 3))
