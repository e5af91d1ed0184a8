"""Records of text files whose separators may stand inside quotes or brackets, read by many tasks.

A file is read as pieces between separators, wherever its blocks are cut. What a piece does depends on whether
it starts inside quotes, so each block reports its outcome for both cases: how it ends, by how much the depth
of brackets changes, and how many records start. A scan over these reports, one for each block, fixes how every
block starts; a second pass cuts the records, and only those that cross a block's border are put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quirecheck.operators.unions import union_all


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, value): what stands between separators, in order within a block."""
    found = spark.read.option("lineSep", separator).text(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _after(ends: tuple[np.ndarray, np.ndarray], start: bool) -> np.ndarray:
    """Whether each piece ends inside quotes, if the first starts so or not; ``ends`` tells it for pieces that start outside and inside."""
    out, inside = ends
    fixed, turns = out == inside, out & ~inside
    parity = np.cumsum(turns) % 2 == 1
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(out)), -1))
    known = last >= 0
    at = np.maximum(last, 0)
    return np.where(known, out[at] ^ parity[at], start) ^ parity


def _walked(ends, steps, start: bool, depth: int) -> tuple[np.ndarray, np.ndarray, bool, int]:
    """Before each piece: inside quotes or not, and the depth; then both at the end."""
    after = _after(ends, start)
    before = np.r_[start, after[:-1]].astype(bool)
    step = np.where(before, steps[1], steps[0])
    return before, depth + np.cumsum(step) - step, bool(after[-1]), int(depth + step.sum())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, pa.RecordBatch]]:
    """(file, block, place in the batch's order, rows) of stretches of one block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column("block").to_numpy()
        # Blocks of different files can start at one place.
        names = batch.column("file").dictionary_encode().indices.to_numpy()
        edges = np.r_[0, np.flatnonzero((starts[1:] != starts[:-1]) | (names[1:] != names[:-1])) + 1, len(starts)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield batch.column("file")[a].as_py(), int(starts[a]), a, batch.slice(a, b - a)


def _columns(rows: pa.RecordBatch) -> tuple:
    flag = lambda c: rows.column(c).to_numpy(zero_copy_only=False).astype(bool)
    return (flag("out"), flag("inside")), (rows.column("step_out").to_numpy(), rows.column("step_in").to_numpy()), flag("kept")


def records(found: DataFrame, separator: str, out: Column, inside: Column, steps: tuple[Column, Column], kept: Column, level: int) -> DataFrame:
    """(file, row_no, record), numbered from 0 over all files in order of their paths.

    ``found`` are pieces. ``out`` and ``inside`` tell whether a piece ends inside quotes if it starts outside or
    inside, ``steps`` how the depth changes in either case, and ``kept`` whether a record may begin with it. A record
    starts with the first piece of a file, and with each piece before which the depth is ``level``, outside quotes.
    """
    spark = found.sparkSession
    judged = found.select("file", "block", "value", out.alias("out"), inside.alias("inside"), steps[0].cast("int").alias("step_out"), steps[1].cast("int").alias("step_in"), kept.alias("kept"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # For both ways a block can start: how it is left, the change of depth, and records that start, by depth.
        held: dict[tuple, list] = {}
        for file, block, _, rows in _blocks(batches):
            ends, step, keeps = _columns(rows)
            state = held.setdefault((file, block), [[False, 0, {}], [True, 0, {}]])
            for case in state:
                before, depth, case[0], case[1] = _walked(ends, step, case[0], case[1])
                at, n = np.unique(depth[~before & keeps], return_counts=True)
                for d, k in zip(at.tolist(), n.tolist()):
                    case[2][d] = case[2].get(d, 0) + k
        for (file, block), cases in held.items():
            starts = [[{"depth": d, "n": n} for d, n in case[2].items()] for case in cases]
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "ends": [c[0] for c in cases], "steps": [c[1] for c in cases], "starts": starts}], reports)

    reports = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.bool_())), ("steps", pa.list_(pa.int64())), ("starts", pa.list_(pa.list_(pa.struct([("depth", pa.int64()), ("n", pa.int64())]))))])
    ddl = "file string, block long, ends array<boolean>, steps array<long>, starts array<array<struct<depth:bigint,n:bigint>>>"
    begins: dict[tuple, tuple] = {}
    number, last = 0, None
    for r in sorted(judged.drop("value").mapInArrow(report, ddl).collect()):  # one row for each block of the files
        if r["file"] != last:
            state, depth, last = False, 0, r["file"]
            first = True
        case = int(state)
        begins[r["file"], r["block"]] = (state, depth, number, first)
        number += sum(s["n"] for s in r["starts"][case] if depth + s["depth"] == level)
        number += first and level != 0  # the first piece of a file, above the level
        state, depth, first = r["ends"][case], depth + r["steps"][case], False
    known = spark.sparkContext.broadcast(begins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, depth, row, held, whole, first = None, False, 0, 0, [], False, False

        def done(complete: bool):
            if held:
                yield here[0], row, here[1], separator.join(held), whole and complete

        for file, block, _, rows in _blocks(batches):
            out: list[tuple] = []
            if (file, block) != here:
                out += done(False)
                here = (file, block)
                state, depth, number, first = known.value[here]
                row, held, whole = number - 1, [], False  # what comes before the first start belongs to the record before
            ends, step, keeps = _columns(rows)
            before, at, state_after, depth_after = _walked(ends, step, state, depth)
            begin = ~before & (at == level)
            if first and level != 0:
                begin[0] = True
            for text, starts, keep in zip(rows.column("value").to_pylist(), begin.tolist(), keeps.tolist()):
                if starts:
                    out += done(True)
                    held = []
                    if not keep:
                        continue
                    row, whole, first = row + 1, True, False
                held.append(text)
            state, depth, first = state_after, depth_after, False
            yield _rows(out)
        if here is not None:
            yield _rows(list(done(False)))

    def _rows(out: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["file", "row_no", "block", "record", "whole"])

    parts = judged.mapInArrow(cut, "file string, row_no long, block long, record string, whole boolean")
    crossing = parts.where("not whole").groupBy("file", "row_no").agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"))
    joined = crossing.select("file", "row_no", F.array_join(F.transform("parts", lambda p: p["record"]), separator).alias("record"))
    return union_all(parts.where("whole").select("file", "row_no", "record"), joined)


_CELL = r'(?:"(?:[^"]|"")*+"[^,]*+|(?!")[^,]*+)'


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, record) of CSV files; a quoted field may span lines, and empty lines are no records."""
    line = F.col("value")
    closed = rf"\A{_CELL}(?:,{_CELL})*+\z"
    continued = rf'\A(?:[^"]|"")*+"[^,]*+(?:,{_CELL})*+\z'
    zero = F.lit(0)
    return records(pieces(spark, path, "\n"), "\n", ~line.rlike(closed), ~line.rlike(continued), (zero, zero), ~F.replace(line, F.lit("\r"), F.lit("")).isin("", '""'), 0)


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, record) of JSON files that hold one array each: the texts of its items, cut at commas of depth 1.

    The first record of a file begins with the bracket of the array, and the last one ends with it.
    """
    text = F.col("value")
    # Left of the first quote that ends a string, then without whole strings, then left of one that stays open.
    outside = lambda t: F.regexp_replace(F.regexp_replace(t, r'(?s)"(?:[^"\\]++|\\.)*+"', ""), r'(?s)".*\z', "")
    rest = F.regexp_replace(text, r'(?s)\A(?:[^"\\]++|\\.)*+"', "")
    closes = text.rlike(r'(?s)\A(?:[^"\\]++|\\.)*+"')
    opens = lambda t: F.contains(F.regexp_replace(t, r'(?s)"(?:[^"\\]++|\\.)*+"', ""), F.lit('"'))
    brackets = lambda t: F.length(F.regexp_replace(t, r"[^\[{]", "")) - F.length(F.regexp_replace(t, r"[^\]}]", ""))
    inside = F.when(closes, opens(rest)).otherwise(True)
    steps = (brackets(outside(text)), F.when(closes, brackets(outside(rest))).otherwise(0))
    return records(pieces(spark, path, ","), ",", opens(text), inside, steps, F.lit(True), 1)
