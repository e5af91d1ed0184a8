"""Readers of files, reference tables and glossaries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quirecheck.functions.text import strip
from quirecheck.operators.unions import union_all
from quirecheck.sources.checkpoints import scratch_path, stored
from quirecheck.sources.records import csv_records, json_items


#: Bytes of a file held at once while it is hashed; names of a folder sent at once.
PIECE, NAMES = 1 << 20, 10_000


def scan_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, size, sha256) of the files in a folder.

    Tasks list the folders, level by level, and hash the files where they are, so the driver holds no list of them: it
    only learns whether a level has folders. Names with a leading dot or underline are passed over, as Spark's readers do
    it, and so are folders if not ``recursive``, but for those of partitions (``key=value``).
    """
    prefix, root = _located(spark, folder)
    listed = scratch_path(spark, "listed")
    level, depth = spark.createDataFrame([(root,)], "folder string"), 0
    while True:
        found = stored(level.mapInArrow(_list_folders(prefix, recursive), "folder string, path string, size long"), f"{listed}/level={depth}")
        depth += 1
        level = found.where("folder is not null").select("folder")
        if level.isEmpty():
            break
        level = level.repartition(spark.sparkContext.defaultParallelism, "folder")
    files = spark.read.schema("folder string, path string, size long, level int").parquet(listed).where("path is not null").select("path", "size")
    glob = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    files = files.where(F.element_at(F.split("path", "/"), -1).rlike(rf"(?s)\A(?:{glob})\z"))
    return files.repartition(_file_tasks(files), F.xxhash64("path")).mapInArrow(_hash_files(prefix), "path string, size long, sha256 string")


def _file_tasks(files: DataFrame) -> int:
    """Tasks for files, as many as for their number at least."""
    spark = files.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-files.count() // NAMES))


def _located(spark: SparkSession, folder: str) -> tuple[str, str]:
    """What stands before a path in Spark's names of files, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    prefix = re.match(r"[^:/]+:(?://[^/]*)?", full)[0]
    return prefix, full[len(prefix) :]


def _opened(prefix: str, path: str) -> tuple[FileSystem, str]:
    """The file system, and what it calls the path."""
    return (LocalFileSystem(), path) if prefix == "file:" else FileSystem.from_uri(prefix + path)


def _list_folders(prefix: str, recursive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            files, path = _opened(prefix, folder)
            itself = files.get_file_info(path)
            found = [itself] if itself.type == FileType.File else files.get_file_info(FileSelector(path))
            for at in range(0, len(found), NAMES):
                rows = []
                for info in found[at : at + NAMES]:
                    name, here = info.base_name, folder if info is itself else f"{folder.rstrip('/')}/{info.base_name}"
                    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
                    if hidden and not name.startswith(("_metadata", "_common_metadata")):
                        continue
                    if info.type == FileType.Directory:
                        if recursive or "=" in name:
                            rows.append((here, None, None))
                    else:
                        rows.append((None, here, info.size))
                folders, paths, sizes = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(folders, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["folder", "path", "size"])

    return run


def _hash_files(prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, hashes = batch.column(0).to_pylist(), []
            for path in paths:
                files, where = _opened(prefix, path)
                digest = hashlib.sha256()
                with files.open_input_stream(where) as read:
                    while piece := read.read(PIECE):
                        digest.update(piece)
                hashes.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([prefix + p for p in paths], pa.string()), batch.column(1), pa.array(hashes, pa.string())], names=["path", "size", "sha256"])

    return run


def write_files(rows: DataFrame, folder: str) -> None:
    """One file for each row (path, content), its path below ``folder``; tasks write the files where they are to be.

    Spark's own writers make one file of a folder, and the driver moves the folders one by one. A task that is run
    again writes the same files again, so paths have to be distinct and must not depend on the order of rows.
    """
    uri = re.sub(r"\Afile:/+", "file:///", folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(uri)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = f"{root}/{name}"
                parent = path.rpartition("/")[0]
                if parent not in made:
                    files.create_dir(parent)
                    made.add(parent)
                with files.open_output_stream(path) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("path", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def wildcard(name: Column, pattern: str) -> Column:
    """``*`` stands for any text; everything else is literal and the whole name must match."""
    return name.rlike(r"(?s)\A" + ".*".join(re.escape(p) for p in pattern.split("*")) + r"\z")


def select_files(
    files: DataFrame, pattern: str = "*", exclude: str | None = None, depth: int | None = None, root: str = ""
) -> DataFrame:
    """Rows whose file name matches, is not excluded, and lies at most ``depth`` folders below root."""
    name = F.element_at(F.split("path", "/"), -1)
    chosen = files.filter(wildcard(name, pattern))
    if exclude is not None:
        chosen = chosen.filter(~wildcard(name, exclude))
    if depth is not None:
        below = F.split(F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path")), "/")
        chosen = chosen.filter(F.size(F.filter(below, lambda p: p != "")) <= depth)
    return chosen


def load_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(term_no, term): one term per line; blank lines and lines that start with # are skipped."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("term_no"), strip(F.col("value")).alias("term"))
    return lines.filter((F.col("term") != "") & ~F.startswith("term", F.lit("#")))


def load_dataset_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, cells) of CSV files, no row taken as header; a quoted field may span lines.

    Every row keeps the cells it has, more or fewer than the first; empty lines are no rows. Rows are numbered
    from 0 in the order of the files' paths. A file of any size is read by many tasks.
    """
    return csv_records(spark, path).select("row_no", csv_cells(F.col("record")).alias("cells"))


def csv_cells(record: Column) -> Column:
    """Cells of one CSV record. A cell is quoted if it starts with a quote; a quote inside it is doubled.

    A quote that is not closed holds for the rest of the record. Carriage returns outside quotes are dropped.
    """
    pieces = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r'(?s),(?:"(?:[^"]|"")*+(?:"[^,]*+|\z)|[^,]*+)'), 0)
    bare = lambda text: F.replace(text, F.lit("\r"), F.lit(""))

    def plain(piece):
        cell = F.substring(piece, F.lit(2), F.length(piece))
        inner = F.replace(F.regexp_extract(cell, r'(?s)\A"((?:[^"]|"")*+)', 1), F.lit('""'), F.lit('"'))
        rest = F.regexp_extract(cell, r'(?s)\A"(?:[^"]|"")*+"(.*)\z', 1)
        return F.when(F.startswith(cell, F.lit('"')), F.concat(inner, bare(rest))).otherwise(bare(cell))

    return F.transform(pieces, plain)


def load_dataset_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every JSON file under ``path``, as of :func:`json_rows`; a file of any size is read by many tasks.

    The items are read several times, so they are written out once.
    """
    items = stored(json_items(spark, path), scratch_path(spark, "json-items"))
    files = items.groupBy("file").agg(F.min("row_no").alias("low"), F.max("row_no").alias("high"), F.min_by("record", "row_no").alias("head"))
    opened = lambda c: F.regexp_replace(c, r"\A\s*\[", "")
    closed = lambda c: F.regexp_replace(c, r"\]\s*\z", "")
    item = F.when(F.col("row_no") == F.col("low"), opened(F.col("record"))).otherwise(F.col("record"))
    item = F.when(F.col("row_no") == F.col("high"), closed(item)).otherwise(item)
    head = F.when(F.col("low") == F.col("high"), closed(opened(F.col("head")))).otherwise(opened(F.col("head")))
    found = items.join(files, "file").select((F.col("row_no") - F.col("low")).alias("i"), item.alias("item"), head.alias("first"))
    one = lambda c: F.try_element_at(F.from_json(_quoted_numbers(F.concat(F.lit("["), c, F.lit("]"))), "array<string>"), F.lit(1))
    return _item_rows(found.where(~F.col("item").rlike(r"\A\s*\z")).select(one(F.col("first")).alias("first"), "i", one(F.col("item")).alias("item")))


def _quoted_numbers(text: Column) -> Column:
    """JSON text with its numbers as strings, since parsing would shorten 2.50 to 2.5.

    Strings are matched first, so digits inside them stay; the marker cannot occur in JSON.
    """
    marked = F.regexp_replace(
        text, r'("(?:[^"\\]++|\\.)*+")|(-?[0-9][0-9.eE+-]*)', "$1\u0001$2\u0001"
    )
    return F.replace(F.replace(marked, F.lit("\u0001\u0001"), F.lit("")), F.lit("\u0001"), F.lit('"'))


def json_rows(files: DataFrame) -> DataFrame:
    """(row_no, cells, error) of JSON texts (value), each an array of arrays or of objects.

    The keys of the first object are a header row numbered 0 and set the order of the cells; a key
    missing later and null are ''; numbers keep their digits. A row of the other shape, or of none,
    has a message in ``error``.
    """
    items = files.select(F.from_json(_quoted_numbers(F.col("value")), "array<string>").alias("items")).select(
        F.element_at("items", 1).alias("first"), F.posexplode("items").alias("i", "item")
    )
    return _item_rows(items)


def _item_rows(items: DataFrame) -> DataFrame:
    """Rows of items (first, i, item) of arrays, the first item next to each."""

    def kind(c):
        start = F.substring(F.ltrim(c), 1, 1)
        return F.when(start == "{", "an object").when(start == "[", "an array").otherwise("neither")

    header = F.map_keys(F.from_json("first", "map<string,string>"))
    fields = F.from_json("item", "map<string,string>")
    row = F.when(
        kind(F.col("item")) == "an object",
        F.transform(header, lambda k: F.coalesce(F.try_element_at(fields, k), F.lit(""))),
    ).otherwise(F.transform(F.from_json("item", "array<string>"), lambda v: F.coalesce(v, F.lit(""))))
    wrong = F.when(
        (kind(F.col("item")) == "neither") | (kind(F.col("item")) != kind(F.col("first"))),
        F.concat(
            F.lit("row "), (F.col("i") + 1).cast("string"), F.lit(" is "), kind(F.col("item")),
            F.lit(", but the first row was "), kind(F.col("first")),
        ),
    )
    rows = items.select((F.col("i") + 1).cast("bigint").alias("row_no"), F.when(wrong.isNull(), row).alias("cells"), wrong.alias("error"))
    names = items.filter((F.col("i") == 0) & (kind(F.col("first")) == "an object")).select(
        F.lit(0).cast("bigint").alias("row_no"), header.alias("cells"), F.lit(None).cast("string").alias("error")
    )
    return union_all(names, rows)
