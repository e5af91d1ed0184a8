"""Two versions of a document compared page by page.

Pages are (doc_id, page_no, text); a document number names the pair. Work is staged from cheap to
expensive: word-set candidates within a diagonal band, alignment of what is ambiguous only, and
edit distance on aligned pairs only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirecheck.functions.distance import list_distance
from quirecheck.functions.overlap import overlapping
from quirecheck.functions.text import diff_sample, prepare, tokens
from quirecheck.functions.values import let, rounded
from quirecheck.operators.checks import ERROR, WARNING
from quirecheck.operators.layout import printed
from quirecheck.operators.ordinals import around
from quirecheck.operators.unions import union_all
from quirecheck.sources.checkpoints import checkpointed, scratch_path, stored

# Pages by which the band is wider than the difference in length, and the word overlap of a match.
SLACK, OVERLAP = 25, 0.6


def prepared(pages: DataFrame, ignore_dates: bool = False, normalized: bool = False) -> DataFrame:
    return pages.withColumn("text", prepare(F.col("text"), ignore_dates, normalized))


def page_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, n, m): pages of both versions; a version without pages counts 0."""
    n = a.groupBy("doc_id").agg(F.count("*").alias("n"))
    m = b.groupBy("doc_id").agg(F.count("*").alias("m"))
    return n.join(m, "doc_id", "full").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "m")])


def changed_metadata(a: DataFrame, b: DataFrame) -> DataFrame:
    """Warnings for entries of the first version that differ; a missing entry counts as ''."""
    other = b.select("doc_id", "key", F.col("value").alias("_new"))
    new = F.coalesce("_new", F.lit(""))
    message = F.concat(F.col("key"), F.lit(': "'), F.col("value"), F.lit('" → "'), new, F.lit('"'))
    return a.join(other, ["doc_id", "key"], "left").filter(F.col("value") != new).select(
        "doc_id", F.lit(WARNING).alias("severity"), F.lit("metadata").alias("check_name"), message.alias("message")
    )


# ---- candidate pairs ----

#: Documents of up to so many pages a side are compared in one cell, and pairs whose band is wider meet by a join.
PAGES, WIDE = 256, 500
#: Words of whole cells that are compared at once.
WORDS = 1 << 18


def _word_sets(pages: DataFrame, counts: DataFrame, slack: int) -> DataFrame:
    """Distinct words of each page, the pair's band, and the words that must meet a match.

    Two sets with a Jaccard index of at least 3/5 share at least 3/5 of either set, so they share
    one of the first ``size - ceil(3/5 size) + 1`` words in any common order. Long words come
    first: they are rare, and candidates stay few. A page without words holds the empty word only.
    """
    words = F.array_distinct(tokens(F.col("text")))
    some = F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(words)
    ranked = F.sort_array(F.transform("words", lambda w: F.struct((-F.char_length(w)).alias("rank"), w.alias("word"))))
    keep = F.col("size") - F.floor((F.col("size") * 3 + 4) / 5).cast("int") + 1
    band = F.abs(F.col("n") - F.col("m")) + slack
    return (
        pages.join(counts.select("doc_id", band.alias("band"), F.greatest("n", "m").alias("pages")), "doc_id")
        .select("doc_id", "page_no", some.alias("words"), "band", "pages")
        .withColumn("size", F.size("words"))
        .withColumn("prefix", F.transform(F.slice(ranked, 1, keep), lambda s: s["word"]))
    )


def _joined_matches(a: DataFrame, b: DataFrame, counts: DataFrame, slack: int) -> DataFrame:
    """Matches of the pairs in ``counts``, by a join on the words that must meet a match, however many pages there are."""
    left, right = _word_sets(a, counts, slack), _word_sets(b, counts, slack)
    block = F.floor(F.col("page_no") / (F.col("band") + 1))
    lefts = left.select(
        "doc_id", F.col("page_no").alias("i"), F.col("size").alias("size_a"), "band", block.alias("block"),
        F.explode("prefix").alias("word"),
    )
    last_block = F.floor(F.col("pages") / (F.col("band") + 1))
    near_blocks = F.sequence(F.greatest(block - 1, F.lit(0)), F.least(block + 1, last_block))
    rights = right.select(
        "doc_id", F.col("page_no").alias("j"), F.col("size").alias("size_b"), "prefix", F.explode(near_blocks).alias("block")
    ).withColumn("word", F.explode("prefix"))
    # One number stands for pair, block and word; a chance collision only adds a candidate.
    meet = F.xxhash64("doc_id", "block", "word").alias("meet")
    lefts = lefts.select("doc_id", "i", "size_a", "band", meet)
    rights = rights.select(F.col("doc_id").alias("doc_b"), "j", "size_b", meet)
    near = (
        (F.col("doc_id") == F.col("doc_b"))
        & (F.abs(F.col("i") - F.col("j")) <= F.col("band"))
        & (F.least("size_a", "size_b") * 5 >= F.greatest("size_a", "size_b") * 3)
    )
    candidates = lefts.join(rights, "meet").filter(near).select("doc_id", "i", "j", "band").distinct()
    shared = F.size(F.array_intersect("words_a", "words_b"))
    union = F.size("words_a") + F.size("words_b") - shared
    return (
        candidates.join(left.select("doc_id", F.col("page_no").alias("i"), F.col("words").alias("words_a")), ["doc_id", "i"])
        .join(right.select("doc_id", F.col("page_no").alias("j"), F.col("words").alias("words_b")), ["doc_id", "j"])
        .filter(shared / union >= OVERLAP)
        .select("doc_id", "i", "j", "band")
    )


def _cells(pages: DataFrame, side: int, long: DataFrame) -> DataFrame:
    """Pages with the cells they meet in: the whole pair, or a stretch of the diagonal four times as long as the band.

    A page of the second version goes to every cell that has a page within the band.
    """
    numbered = pages.filter(F.col("doc_id").isNotNull() & F.col("page_no").isNotNull())
    placed = numbered.select("doc_id", "page_no", "text").join(long.select("doc_id", "band"), "doc_id", "left")
    width = (F.col("band") + 1) * 4
    reach = F.col("band") if side else F.lit(0)
    cell = lambda number: F.coalesce(F.floor(number / width), F.lit(0))
    cells = F.sequence(cell(F.col("page_no") - reach), cell(F.col("page_no") + reach))
    return placed.filter(F.coalesce(F.col("band") <= WIDE, F.lit(True))).select(
        "doc_id", F.explode(cells).alias("cell"), F.lit(bool(side)).alias("second"), F.col("page_no").cast("long").alias("page_no"), "band", "text"
    )


def _cell_matches(a: DataFrame, b: DataFrame, long: DataFrame, slack: int) -> DataFrame:
    """Matches of pairs with a narrow band; cells are brought together, and many whole cells are compared at once."""
    kind = dict(a.dtypes)["doc_id"]
    schema = f"doc_id {kind}, i long, j long, band long"

    def compared(rows: pa.Table, cell: np.ndarray) -> pa.RecordBatch:
        second, number, band = (rows.column(c).combine_chunks() for c in ("second", "page_no", "band"))
        second, number = second.to_numpy(zero_copy_only=False), number.to_numpy()
        n, m = (np.bincount(cell[second == s], minlength=int(cell[-1]) + 1) for s in (False, True))
        band = np.where(band.is_valid().to_numpy(zero_copy_only=False), band.fill_null(0).to_numpy(), (np.abs(n - m) + slack)[cell])
        words = rows.column("words").combine_chunks()
        codes = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        # A cell that lacks a side gives nothing.
        both = ((n > 0) & (m > 0))[cell[row]]
        p, q = overlapping(cell, second, number, band, row[both], codes[both], OVERLAP)
        return pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks().take(pa.array(p)), pa.array(number[p]), pa.array(number[q]), pa.array(band[p], pa.int64())], names=["doc_id", "i", "j", "band"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, words
            rows = pa.Table.from_batches(held)
            doc, cell = (rows.column(c).combine_chunks() for c in ("doc_id", "cell"))
            doc, cell = doc.dictionary_encode().indices.to_numpy(zero_copy_only=False), cell.to_numpy()
            number = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (cell[1:] != cell[:-1])])
            # The last cell may go on in the next batch.
            upto = len(number) if last else int(np.searchsorted(number, number[-1]))
            sums = np.cumsum(rows.column("words").combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < upto:
                most = int(np.searchsorted(sums, (sums[at - 1] if at else 0) + WORDS, "right"))
                end = upto if most >= upto else max(int(np.searchsorted(number, number[most])), int(np.searchsorted(number, number[at], "right")))
                yield compared(rows.slice(at, end - at), number[at:end] - number[at])
                at = end
            held, words = rows.slice(upto).to_batches(), int(sums[-1] - (sums[upto - 1] if upto else 0))

        limit = WORDS
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                words += len(batch.column("words").flatten())
                if words >= limit:
                    yield from whole(False)
                    limit = words * 2 + WORDS  # a long cell is not looked through for each batch again
        if held:
            yield from whole(True)

    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = union_all(_cells(a, 0, long), _cells(b, 1, long)).repartition(n, "doc_id", "cell").sortWithinPartitions("doc_id", "cell")
    words = tokens(F.col("text"))
    # A page without words holds the empty word only.
    some = let(words, lambda w: F.when(F.size(w) == 0, F.array(F.lit(""))).otherwise(w))
    return rows.select("doc_id", "cell", "second", "page_no", "band", some.alias("words")).mapInArrow(run, schema)


def page_matches(a: DataFrame, b: DataFrame, slack: int = SLACK) -> DataFrame:
    """(doc_id, i, j, band): pages that may be the same page of two versions.

    They have equal word sets, both none, or a Jaccard index of at least 0.6, and their numbers
    differ by no more than the band, ``|n - m| + slack``; pages further apart are not matched. The band
    also cuts a pair into cells along the diagonal, so a page meets only the pages near it. Cells of versions
    whose lengths differ widely could be of any size; their pages meet by a join on words.
    """
    spark = a.sparkSession
    band = F.abs(F.col("n") - F.col("m")) + slack
    # Few documents are long: their bands are a small table.
    long = stored(page_counts(a, b).withColumn("band", band).filter((F.greatest("n", "m") > PAGES)), scratch_path(spark, "page-bands"))
    found = _cell_matches(a, b, long, slack)
    wide = long.filter(F.col("band") > WIDE)
    if wide.isEmpty():
        return found
    return union_all(found, _joined_matches(a, b, wide, slack))


# ---- alignment ----


def _align_segment(rows: pa.Table) -> pa.Table:
    """Longest common subsequence of one ambiguous stretch of a pair.

    ``best[j]`` is the longest alignment of the rows below with the columns from ``j`` on. Going up
    the rows it is a running maximum from the right. Only the decision "skip the row" is kept, for
    the columns of the row's band; left of the band it does not depend on the column, and right of
    the row's last match the row is always skipped.
    """
    first, band = rows["low_j"][0].as_py(), rows["band"][0].as_py()
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    order = np.lexsort((j, i))
    numbers, cuts = np.unique(i[order], return_index=True)
    matches = np.split(j[order], cuts[1:])
    width = max(int(m[-1]) for m in matches) - first
    best = np.zeros(width + 2, dtype=np.int64)  # columns first + 1 .. first + width, then the end
    skip, starts, skip_left = [None] * len(numbers), [0] * len(numbers), [False] * len(numbers)
    valid_from = width + 1
    for r in range(len(numbers) - 1, -1, -1):
        cols = matches[r] - first - 1
        low, last = max(0, int(numbers[r]) - band - first - 1), int(cols[-1])
        low = min(low, int(cols[0]))
        if low < valid_from:
            best[low:valid_from] = best[valid_from]
            valid_from = low
        below = best[low : last + 2].copy()
        reached = below[:-1].copy()
        reached[cols - low] = best[cols + 1] + 1
        now = np.maximum.accumulate(reached[::-1])[::-1]
        best[low : last + 1] = now
        skip[r] = below[:-1] >= best[low + 1 : last + 2]
        skip_left[r] = bool(below[0] >= now[0])
        starts[r] = low
    aligned, r, j = [], 0, 0
    while r < len(numbers) and j <= width:
        cols = matches[r] - first - 1
        if j > cols[-1]:
            r += 1
        elif j < starts[r]:
            # Every column left of the band looks the same.
            if skip_left[r]:
                r += 1
            else:
                j = starts[r]
        elif j in cols:
            aligned.append((numbers[r], j + first + 1))
            r, j = r + 1, j + 1
        elif skip[r][j - starts[r]]:
            r += 1
        else:
            j += 1
    return pa.table(
        {
            "doc_id": pa.array([rows["doc_id"][0].as_py()] * len(aligned), pa.int64()),
            "i": pa.array([int(n) for n, _ in aligned], pa.int64()),
            "j": pa.array([int(m) for _, m in aligned], pa.int64()),
        }
    )


def align(matches: DataFrame) -> DataFrame:
    """(doc_id, i, j): a longest increasing chain of matching pages.

    A page that matches one page only, with every other match of the pair strictly before or
    strictly after it, is part of every longest chain. Such anchors need no search, and they cut
    the pair into stretches that are aligned apart, which is all a grouped function ever sees.

    The matches, three numbers each, are read several times, so they are written out once.
    """
    matches = checkpointed(matches)
    rows = matches.groupBy("doc_id", "i").agg(
        F.min("j").alias("j_min"), F.max("j").alias("j_max"), F.count("*").alias("partners")
    )
    placed = around(rows, ["doc_id"], "i", {"max_before": "j_max"}, {"min_after": "j_min"})
    anchor = (
        (F.col("partners") == 1)
        & (F.coalesce("max_before", F.lit(-1)) < F.col("j_min"))
        & (F.col("min_after").isNull() | (F.col("min_after") > F.col("j_min")))
    )
    marked = placed.select("doc_id", "_span", "i", "j_min", anchor.alias("anchor"), F.when(anchor, F.col("j_min")).alias("anchor_j"))
    anchors = marked.filter("anchor").select("doc_id", "i", F.col("j_min").alias("j"))
    stretches = around(marked, ["doc_id"], "i", {"low_j": "anchor_j"}, {}).filter("not anchor").select(
        "doc_id", "i", F.coalesce("low_j", F.lit(0)).alias("low_j")
    )
    unclear = matches.join(stretches, ["doc_id", "i"]).select("doc_id", "low_j", "i", "j", "band")
    searched = unclear.groupBy("doc_id", "low_j").applyInArrow(_align_segment, "doc_id long, i long, j long")
    return union_all(anchors, searched)


def structure_findings(counts: DataFrame, a: DataFrame, b: DataFrame, aligned: DataFrame) -> DataFrame:
    """Errors: a changed page count, pages removed, pages inserted."""

    def lost(pages, side, verb):
        missing = pages.select("doc_id", F.col("page_no").alias(side)).join(aligned, ["doc_id", side], "left_anti")
        return missing.select(
            "doc_id", F.concat(F.lit("page "), F.col(side).cast("string"), F.lit(f" {verb}")).alias("message")
        )

    changed = counts.filter("n <> m").select(
        "doc_id",
        F.concat(F.lit("page count changed: "), F.col("n").cast("string"), F.lit(" → "), F.col("m").cast("string")).alias("message"),
    )
    every = union_all(changed, lost(a, "i", "removed"), lost(b, "j", "inserted"))
    return every.select("doc_id", F.lit(ERROR).alias("severity"), F.lit("structure").alias("check_name"), "message")


# ---- similarity of aligned pages ----


def with_word_similarity(pairs: DataFrame, out: str = "similarity") -> DataFrame:
    """Adds 1 - word edit distance / longer word count of ``text_a`` and ``text_b``; two texts without words are equal."""
    # Most aligned pages are the same; only the words of others are cut and compared.
    changed = F.col("text_a") != F.col("text_b")
    words = pairs.withColumns({f"_{s}": F.when(changed, tokens(F.col(f"text_{s}"))) for s in "ab"})
    longest = F.greatest(F.size("_a"), F.size("_b"))
    measured = words.withColumn("_longest", longest).withColumn("_distance", list_distance(F.col("_a"), F.col("_b")))
    value = F.when(~changed | (F.col("_longest") == 0), F.lit(1.0)).otherwise(1 - F.col("_distance") / F.col("_longest"))
    return measured.select(*pairs.columns, value.alias(out))


def aligned_texts(a: DataFrame, b: DataFrame, aligned: DataFrame) -> DataFrame:
    left = a.select("doc_id", F.col("page_no").alias("i"), F.col("text").alias("text_a"))
    right = b.select("doc_id", F.col("page_no").alias("j"), F.col("text").alias("text_b"))
    return aligned.join(left, ["doc_id", "i"]).join(right, ["doc_id", "j"])


def text_findings(similar: DataFrame, threshold: float = 100.0) -> DataFrame:
    """A finding per aligned page that is not the same: an error below the threshold."""
    percent = F.col("similarity") * 100
    message = F.concat(
        F.format_string("page %d → %d: similarity %.1f%%", "i", "j", F.bround(percent, 1)),
        diff_sample(F.col("text_a"), F.col("text_b")),
    )
    return similar.filter("similarity < 1").select(
        "doc_id",
        F.when(percent < threshold, ERROR).otherwise(WARNING).alias("severity"),
        F.lit("text").alias("check_name"),
        message.alias("message"),
    )


def overall_similarity(counts: DataFrame, similar: DataFrame) -> DataFrame:
    """(doc_id, similarity): mean over aligned pages and, as 0, pages left alone; 100 without pages."""
    # Rounded before dividing, so the sum does not depend on the order of its terms.
    sums = similar.groupBy("doc_id").agg(F.round(F.sum("similarity"), 9).alias("total"), F.count("*").alias("pairs"))
    pairs = F.coalesce("pairs", F.lit(0))
    pages = F.col("n") + F.col("m") - pairs
    value = F.when(pages == 0, F.lit(100.0)).otherwise(rounded(F.coalesce("total", F.lit(0.0)) / pages * 100, 1))
    return counts.join(sums, "doc_id", "left").select("doc_id", value.alias("similarity"))


def overall_findings(overall: DataFrame, threshold: float = 100.0) -> DataFrame:
    message = F.concat(
        F.lit("overall similarity "), printed(F.col("similarity")), F.lit("% below the minimum of "),
        printed(F.lit(float(threshold))), F.lit("%"),
    )
    return overall.filter(F.col("similarity") < threshold).select(
        "doc_id", F.lit(ERROR).alias("severity"), F.lit("similarity").alias("check_name"), message.alias("message")
    )


def compare_versions(
    a: DataFrame,
    b: DataFrame,
    ignore_dates: bool = False,
    normalized: bool = False,
    threshold: float = 100.0,
    slack: int = SLACK,
) -> tuple[DataFrame, DataFrame]:
    """All page findings, and the overall similarity of each pair; ``slack`` as in :func:`page_matches`."""
    a, b = prepared(a, ignore_dates, normalized), prepared(b, ignore_dates, normalized)
    counts = page_counts(a, b)
    aligned = align(page_matches(a, b, slack))
    similar = with_word_similarity(aligned_texts(a, b, aligned))
    overall = overall_similarity(counts, similar)
    findings = union_all(
        structure_findings(counts, a, b, aligned), text_findings(similar, threshold), overall_findings(overall, threshold)
    )
    return findings, overall
