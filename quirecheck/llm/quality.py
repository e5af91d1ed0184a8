"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken over whole texts where the rows are. Trees are grown on histograms of binned
statistics and then flattened: full binary trees as arrays of feature, threshold and leaf value, so a
batch of rows walks down all of them with a few numpy lookups per level.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirecheck.llm.shared import id_remainder, in_fraction, whole_text
from quirecheck.sources.checkpoints import checkpointed

#: Labelled rows the trees are fitted on, about; all rows are scored.
LABELLED = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, SHRINK = 80, 4, 64, 0.15, 4.0, 1.0

FEATURES = [
    "log_bytes", "log_words", "word_length", "long_words", "upper", "digit", "space", "newline", "ascii_punct", "stops", "commas", "bars",
    "odd_marks", "non_ascii", "control", "distinct_words", "top_word", "same_as_before", "distinct_lines", "line_words", "zipped", "bare_words",
    "capital_words", "all_capital_words", "numbers", "worst_mark",
]


def _classes() -> dict[str, np.ndarray]:
    tables = {}
    for name, chars in {
        "upper": bytes(range(65, 91)), "digit": b"0123456789", "space": b" \t\r\x0b\f", "newline": b"\n", "stops": b".?!", "commas": b",;:", "bars": b"|",
        "odd_marks": b"#$%&*+/<=>@[\\]^_`{}~", "ascii_punct": bytes(c for c in range(33, 127) if not chr(c).isalnum()),
        "non_ascii": bytes(range(128, 256)), "control": bytes([*range(9), *range(14, 32), 127]),
    }.items():
        tables[name] = np.isin(np.arange(256), list(chars))
    return tables


CLASSES = _classes()
MARKS = np.flatnonzero(CLASSES["ascii_punct"])


def statistics(text: bytes) -> list[float]:
    """FEATURES of one whole text; an empty text gives zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    size = len(text)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = {name: float(seen[table].sum()) / size for name, table in CLASSES.items()}
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(len(words), 1)
    counts = Counter(words)
    bare = sum(map(bytes.isalpha, words))
    f = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(len(words)), "word_length": sum(map(len, words)) / n,
        "long_words": sum(c for w, c in counts.items() if len(w) > 20) / n, "distinct_words": len(counts) / n,
        "top_word": max(counts.values(), default=0) / n, "same_as_before": sum(map(bytes.__eq__, words[1:], words)) / n,
        "distinct_lines": len(set(lines)) / max(len(lines), 1), "line_words": len(words) / max(len(lines), 1), "zipped": len(zlib.compress(text, 1)) / size,
        "bare_words": bare / n, "capital_words": sum(c for w, c in counts.items() if w[:1].isupper()) / n,
        "all_capital_words": sum(c for w, c in counts.items() if len(w) > 2 and w.isupper()) / n,
        "numbers": sum(c for w, c in counts.items() if w[:1].isdigit()) / n,
        "worst_mark": float(seen[[m for m in MARKS if m not in b".,"]].max()) / n,
    }
    return [float(f.get(name, share.get(name, 0.0))) for name in FEATURES]


def with_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x) of every row, x an array of FEATURES; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, x array<double>")


@dataclass(frozen=True)
class Trees:
    """Full binary trees of one depth, flattened. Node i has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for 0/1 labels by logistic loss; without labels of both kinds the base rate alone."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.array([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)]).T  # bin b: at most cut b
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            split = np.full(width, BINS, np.int64)
            for j, edges in enumerate(cuts):
                slot = (at - first) * (BINS + 1) + binned[:, j]
                gs = np.bincount(slot, g, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(slot, h, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                left_g, left_h = gs[:, : len(edges)], hs[:, : len(edges)]
                right_g, right_h = gs[:, -1:] - left_g, hs[:, -1:] - left_h
                gain = left_g**2 / (left_h + SHRINK) + right_g**2 / (right_h + SHRINK) - gs[:, -1:] ** 2 / (hs[:, -1:] + SHRINK)
                gain = np.where(np.minimum(left_h, right_h) * 4 >= LEAST_WEIGHT, gain, 0)
                for node in range(width):
                    b = int(gain[node].argmax()) if len(edges) else 0
                    if len(edges) and gain[node, b] > best[node]:
                        best[node], split[node] = gain[node, b], b
                        feature[first + node], threshold[first + node] = j, edges[b]
            node = at - first
            at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > split[node])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + SHRINK)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


def drawn_labels(labels: DataFrame, id_col: str, label_col: str, fold: int) -> DataFrame:
    """(id, y): about LABELLED labelled ids to learn from, drawn by a hash of the id; an id with several labels has the smallest."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    learned = known.where(id_remainder("id", fold) != 0).groupBy("id").agg(F.min("y").alias("y"))
    total = learned.count()
    return F.broadcast(learned.where(in_fraction(F.xxhash64("id", F.lit(1)), LABELLED / max(total, 1))))  # bounded by LABELLED


def fit_on(stats: DataFrame, drawn: DataFrame) -> Trees:
    """Trees for the drawn labels whose id is in ``stats`` (id, x); rows of one id count once, so the sample stays bounded."""
    rows = stats.join(drawn, "id").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    sample = sorted(tuple(r) for r in rows.collect())
    return fit(np.array([r[2] for r in sample], np.float64).reshape(-1, len(FEATURES)), np.array([r[1] for r in sample], np.float64))


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int = 5, threshold: float = 0.3) -> DataFrame:
    """Every row with its quality: (id_col, held_out, score, predicted).

    The trees learn from the labelled rows whose crc32(id as text) mod ``fold`` is not 0 (the others are
    ``held_out``), about LABELLED of them, drawn by a hash. Inputs are statistics of the whole text only.
    Null labels are left out; without labels of both kinds every score is the base rate. Null and empty
    texts get a score, too; a null id is held out, as its crc32 is that of the empty text. Repeated rows
    give repeated results, but an id is learned from once, with its smallest label and statistics; other columns are neither read nor carried.
    """
    stats = checkpointed(with_statistics(df, id_col, text_col))
    held = df.sparkSession.sparkContext.broadcast(fit_on(stats, drawn_labels(labels, id_col, label_col, fold)))  # TREES x 2^DEPTH numbers

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(np.array(x.tolist(), np.float64).reshape(-1, len(FEATURES))))

    scored = stats.select(F.col("id").alias(id_col), (id_remainder("id", fold) == 0).alias("held_out"), score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int = 5, threshold: float = 0.3) -> DataFrame:
    """The rows of ``df``, with all columns, that ``score_quality`` would give at least ``threshold``; nothing is shuffled."""
    drawn = drawn_labels(labels, id_col, label_col, fold)
    stats = with_statistics(df.select(id_col, text_col).join(drawn.select(F.col("id").alias(id_col)), id_col, "left_semi"), id_col, text_col)
    held = df.sparkSession.sparkContext.broadcast(fit_on(stats, drawn))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(np.array([statistics(t.encode()) for t in text], np.float64).reshape(-1, len(FEATURES))))

    return df.where(score(whole_text(text_col)) >= threshold)
