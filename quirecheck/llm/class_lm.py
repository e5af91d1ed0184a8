"""Brown's class-based bigrams: words are exchanged between classes, classes predict each other.

The model of a token is P(class | class before) x P(word | class). Counts cover all training texts. A core
of the most frequent words is clustered by exchange. Every other frequent word then joins the class that
its neighbours make likeliest: how often each class of the core stands before and after it is counted over
all training texts, and so are the transitions between the classes of all words. Words rarer than that form
one class of their own, with exact counts. Frequent words are looked up where the text is; only rare words
travel, to meet their counts in a join, so no common word is ever a join key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirecheck.llm.shared import id_remainder, slices
from quirecheck.sources.checkpoints import checkpointed

#: Words looked up in place, which all have a class; words of the core, classes, rounds of exchange.
FREQUENT, CLUSTERED, CLASSES, ROUNDS = 200_000, 1_200, 40, 4
#: Words a counting task holds before it hands them on, and bigrams.
HELD = 200_000
#: Bytes of text scored in one piece.
PART = 1 << 21
ADD, TRANSITION_ADD = 0.1, 0.5
#: The end of a text as a word; no word is empty.
END = b""


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end."""
    words = text.lower().split()
    words.append(END)
    return words


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for t in batch.column(column).cast(pa.binary()):
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the column ``text``; each task combines its counts before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in _texts(batch, "text"):
                held.update(tokens(text))
                if len(held) > HELD:
                    yield _pairs(held)
                    held = Counter()
        yield _pairs(held)

    return texts.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _pairs(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[list[tuple[bytes, int]], int]:
    """At most ``most`` words with their counts, by falling count, and the least count that is frequent."""
    bands = counts.groupBy(F.floor(F.log2("c") * 16).alias("band")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    least, total = None, 0
    for band in sorted(bands, reverse=True):
        total += band["n"]
        if total > most:
            break
        least = band["least"]
    if least is None:
        return [], 1 << 62
    words = counts.where(F.col("c") >= least).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in words), key=lambda x: (-x[1], x[0])), least


def bigram_counts(texts: DataFrame, words: list[bytes]) -> np.ndarray:
    """Counts of neighbouring tokens of the clustered ``words``; the last index is any other word.

    Each text starts behind an end. The driver gets at most (len(words) + 1) squared counts.
    """
    size = len(words) + 1
    held = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, end = held.value.get, held.value.get(END, size - 1)
        for batch in batches:
            codes = []
            for text in _texts(batch, "text"):
                ids = np.fromiter(map(get, tokens(text), repeat(size - 1)), np.int64)
                codes.append(np.concatenate([[end], ids[:-1]]) * size + ids)
                if sum(map(len, codes)) > HELD * 10:
                    yield _codes(codes)
                    codes = []
            if codes:
                yield _codes(codes)

    table = np.zeros(size * size)
    rows = texts.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    table[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return table.reshape(size, size)


def _codes(codes: list[np.ndarray]) -> pa.RecordBatch:
    code, n = np.unique(np.concatenate(codes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])


def context_counts(texts: DataFrame, index: dict, core: np.ndarray, classes: int) -> DataFrame:
    """(word, side, n): how often each class of the core stands before (side = class) or after (classes + class) a word outside the core.

    ``core`` has the class of each word of ``index``, -1 for words that have none yet; the last entry is any other word.
    """
    held = texts.sparkSession.sparkContext.broadcast((index, core))  # FREQUENT words at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, group = held.value
        other = len(places)
        codes: list[np.ndarray] = []
        for batch in batches:
            for text in _texts(batch, "text"):
                ids = np.fromiter(map(places.get, tokens(text), repeat(other)), np.int64)
                of = group[ids]
                before, after = np.concatenate([[group[places[END]]], of[:-1]]), np.concatenate([of[1:], [-1]])
                wanted = (of < 0) & (ids < other)
                for side, shift in ((before, 0), (after, classes)):
                    at = np.flatnonzero(wanted & (side >= 0))
                    codes.append(ids[at] * (2 * classes) + shift + side[at])
                if sum(map(len, codes)) > HELD * 20:
                    yield _codes(codes)
                    codes = []
        if codes:
            yield _codes(codes)

    counts = texts.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return counts.select(F.floor(F.col("code") / (2 * classes)).alias("word"), (F.col("code") % (2 * classes)).alias("side"), "n")


def likeliest(contexts: DataFrame, table: np.ndarray, own: int) -> DataFrame:
    """(word, class): the class, ``own`` or above, under which the transitions to and from a word's neighbours are likeliest."""
    smooth = np.log(table + TRANSITION_ADD)
    into, out = smooth - np.log((table + TRANSITION_ADD).sum(0)), smooth.T - np.log((table + TRANSITION_ADD).sum(1))
    weights = np.concatenate([into, out])[:, own:]  # rows: what stands before, what stands after

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            around = np.zeros((batch.num_rows, len(weights)))
            for i, sides in enumerate(batch.column("sides")):
                found = sides.values
                around[i, found.field("side").to_numpy()] = found.field("n").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(own + (around @ weights).argmax(1))], names=["word", "class"])

    gathered = contexts.groupBy("word").agg(F.collect_list(F.struct("side", "n")).alias("sides"))  # two entries for each class at most
    return gathered.select("word", "sides").mapInArrow(choose, "word long, class long")


def transition_counts(texts: DataFrame, index: dict, group: np.ndarray) -> np.ndarray:
    """Counts of neighbouring classes over all tokens; the driver gets classes x classes numbers at most."""
    size = int(group.max()) + 1
    held = texts.sparkSession.sparkContext.broadcast((index, group))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, classes = held.value
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for text in _texts(batch, "text"):
                of = classes[np.fromiter(map(places.get, tokens(text), repeat(len(places))), np.int64)]
                total += np.bincount(np.concatenate([[classes[places[END]]], of[:-1]]) * size + of, minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    table = np.zeros(size * size)
    rows = texts.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    table[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return table.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, fixed: list[int], classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each word: words move, one by one, to where the likelihood of the bigrams is highest.

    The words of ``fixed`` keep a class of their own each: the first of the classes.
    """
    size = len(bigrams)
    own = len(fixed)
    total = own + max(1, min(classes, size - own))
    group = np.array([own + i % (total - own) for i in range(size)])
    group[fixed] = np.arange(own)
    hot = np.eye(total)
    by = hot[group]
    table = by.T @ bigrams @ by
    row_sums, column_sums = bigrams.sum(1), bigrams.sum(0)
    for _ in range(rounds):
        moved = 0
        for w in range(size):
            if w in fixed:
                continue
            old, self_count = group[w], bigrams[w, w]
            right = np.bincount(group, bigrams[w], total)
            left = np.bincount(group, bigrams[:, w], total)
            right[old] -= self_count
            left[old] -= self_count
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= self_count
            base = _f(table)
            gain = (_f(table + right) - base).sum(1) + (_f(table + left[:, None]) - base).sum(0)
            d = np.arange(total)
            diagonal = table[d, d]
            gain += _f(diagonal + right + left + self_count) - _f(diagonal + right) - _f(diagonal + left) + _f(diagonal)
            # Wherever w goes, its neighbours' classes get their own side of its pairs back.
            rows, columns = table.sum(1) + left, table.sum(0) + right
            gain -= _f(rows + row_sums[w]) - _f(rows) + _f(columns + column_sums[w]) - _f(columns)
            gain[:own] = -np.inf
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else old
            table[new] += right
            table[:, new] += left
            table[new, new] += self_count
            moved += new != old
            group[w] = new
        if not moved:
            break
    return group


@dataclass(frozen=True)
class Model:
    """What scoring needs; the arrays run over the frequent words, then one entry for any other word."""

    index: dict
    known: np.ndarray  # log10(c + ADD)
    emission: np.ndarray  # log10 P(word | class); of a rare word the part that its count adds is left out
    group: np.ndarray
    transition: np.ndarray  # log10 P(class | class before)
    rare: np.ndarray  # words of the class of rare words
    per_token: float  # log10 of the base model's denominator


def fit(train: DataFrame, counts: DataFrame) -> tuple[Model, int, int]:
    """The model, the least count of a frequent word, and the number of training tokens."""
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    words, least = frequent_words(counts)
    clustered = [w for w, _ in words if w != END][:CLUSTERED] + [END]
    held = dict(words)
    if END not in held:  # ends may be rarer than FREQUENT words
        held.update((END, r["c"]) for r in counts.where(F.length("word") == 0).collect())  # one row, none without training texts
    bigrams = bigram_counts(train, clustered)
    size = len(clustered)
    group_of = exchange(bigrams, fixed=[size - 1, size])  # the end and the rare words stay apart
    table = np.zeros((group_of.max() + 1,) * 2)
    np.add.at(table, (group_of[:, None], group_of[None, :]), bigrams)
    every = [w for w, _ in words]
    if END not in every:
        every.append(END)
    index = {w: i for i, w in enumerate(every)}
    place = {w: group_of[i] for i, w in enumerate(clustered)}
    core = np.array([place.get(w, -1) for w in every] + [-1])
    found = likeliest(context_counts(train, index, core, len(table)), table, own=2).toPandas()  # FREQUENT rows at most
    group = np.where(core >= 0, core, group_of[size])  # a word without neighbours in the core stays with the rare
    group[found["word"].to_numpy(np.int64)] = found["class"].to_numpy(np.int64)
    table = transition_counts(train, index, group)
    transition = np.log10((table + TRANSITION_ADD) / (table.sum(1, keepdims=True) + TRANSITION_ADD * len(table)))
    c = np.array([held.get(w, 0) for w in every] + [0], np.float64)
    # Words without a class of the core, and all that are rarer than the frequent ones.
    apart = group[:-1] != group_of[size]
    rare_n, rare_v = n - c[:-1][apart].sum(), v - int((apart & (c[:-1] > 0)).sum())
    rare_total = np.log10(rare_n + ADD * (rare_v + 1))
    in_class = np.bincount(group[:-1], c[:-1], len(table))
    rare = group == group_of[size]
    with np.errstate(divide="ignore"):
        emission = np.where(rare, np.log10(c + ADD) - rare_total, np.log10(np.maximum(c, 1)) - np.log10(np.maximum(in_class[group], 1)))
    emission[-1] = -rare_total
    known = np.log10(c + ADD)
    known[-1] = 0
    return Model(index, known, emission, group, transition, rare, float(np.log10(n + ADD * (v + 1)))), least, n


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10) -> DataFrame:
    """Every row with log10 probabilities: (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity).

    Training texts are those whose crc32(id as text) mod ``fold`` is not 0; a null id counts as the empty
    text and is held out. A token is a word or the end of a text. ``base_score`` is the smoothed unigram
    model, ``score`` the class model, perplexity 10^(-score / n_tokens). Null texts count as empty: one
    token, the end. Without training texts both models still give finite scores. Other columns are not
    carried; repeated rows give repeated results.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (id_remainder(id_col, fold) == 0).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    counts = checkpointed(word_counts(train))
    model, least, n = fit(train, counts)
    held = df.sparkSession.sparkContext.broadcast(model)  # FREQUENT words at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        other = len(m.index)
        for batch in parts(batches):
            out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base", "score")}
            rare_words, rare_counts, ends = [], [], [0]
            for text in _texts(batch, "text"):
                words = tokens(text)
                ids = np.fromiter(map(m.index.get, words, repeat(other)), np.int64, len(words))
                group = m.group[ids]
                unknown = np.flatnonzero(ids == other)
                rare = Counter(words[i] for i in unknown)
                out["n_tokens"].append(len(ids))
                out["n_known"].append(int((m.known[ids] >= 0).sum()) - len(unknown))
                out["base"].append(float(m.known[ids].sum() - len(ids) * m.per_token))
                before = np.concatenate([[m.group[m.index[END]]], group[:-1]])
                out["score"].append(float(m.transition[before, group].sum() + m.emission[ids].sum()))
                rare_words += rare
                rare_counts += rare.values()
                ends.append(len(rare_words))
            found = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], names=["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()), pa.array(out["base"], pa.float64()), pa.array(out["score"], pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)],
                names=["row", "id", "held_out", *out, "rare"],
            )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches cut to a bounded size of text, as their rare words are held as objects."""
        for batch in batches:
            for a, b in slices([n or 0 for n in pc.binary_length(batch.column("text")).to_pylist()], PART):
                yield batch.slice(a, b - a)

    kind = df.schema[id_col].dataType.simpleString()
    scored = checkpointed(
        rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text").mapInArrow(
            score, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:bigint>>"
        )
    )
    looked_up = scored.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.n").join(counts.where(F.col("c") < least), "word", "left")
    more = looked_up.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("more")
    )
    total = F.col("score") + F.coalesce("more", F.lit(0.0))
    return scored.drop("rare").join(more, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
