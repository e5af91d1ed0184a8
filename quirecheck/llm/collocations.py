"""Collocations mined with weighted acyclic automata.

Each task counts the phrases of its texts, sorts them, cuts them at common boundaries into ranges, and builds
for each range an acyclic automaton whose edges carry counts, equal states of one depth once. The automata of
one range meet in a task, which forms their union with summed weights and keeps the frequent phrases. To look up the parts
of its candidates a range sends the automaton of those parts to the ranges that hold them; composing it with
the automaton there gives their counts. A part is asked for once per range, however many candidates share it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirecheck.llm.automata import CountAutomaton, Level, codes, cut, keys, renumbered, summed, union
from quirecheck.llm.shared import partitions
from quirecheck.operators.unions import union_all
from quirecheck.sources.checkpoints import checkpointed, discard, scratch_path, stored

#: Longest phrase.
WORDS = 3
#: Tokens a task holds before it builds automata, and bytes of a text taken apart at once.
HELD, SLICE = 1_000_000, 1 << 22
#: Phrases of the tasks that make a range, about; the share of the texts that boundaries are drawn from, and marks for each range.
RANGE, SHARE, MARKS = 2_000_000, 1 / 32, 16
#: Bytes that part a text into pieces, as they stand in the table of a translation to full stops.
_PARTED = bytes(ord(".") if i in b".,;:!?\n\x0b\x0c\r" else i for i in range(256)).lower()
#: The number of what parts pieces; words have numbers from 0 when they are in order.
_MARK = -1


class _Held:
    """Tokens of texts of one language, as numbers in order of appearance; 0 is what parts pieces."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[b"."]
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        end = 0
        while end < len(text):
            start, end = end, end + SLICE
            while end < len(text) and text[end] not in b" \t":  # words stay whole
                end += 1
            tokens = text[start:end].translate(_PARTED).replace(b".", b" . ").split()
            self.ids.append(np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens)))
            self.size += len(tokens)
        self.ids.append(np.zeros(1, np.int64))
        self.size += 1

    def shards(self) -> Iterator[tuple[list[bytes], list[Level]]]:
        """(words, levels) of stretches of bounded size; every phrase is counted where it starts."""
        words = sorted(w for w in self.number if w != b".")
        rank = np.empty(len(words) + 1, np.int64)
        rank[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
        rank[0] = _MARK
        ids = np.concatenate([rank[np.concatenate(self.ids)], np.full(WORDS, _MARK)])
        self.ids = []
        for at in range(0, len(ids) - WORDS, HELD):
            n = min(HELD, len(ids) - WORDS - at)
            yield words, _counted([ids[at + k : at + k + n] for k in range(WORDS)], len(words))


def _counted(columns: list[np.ndarray], size: int) -> list[Level]:
    """Distinct phrases of each length with their counts; column k has the words k places on."""
    out = []
    going = np.flatnonzero(columns[0] != _MARK)
    prefix, rows = np.zeros(len(going), np.int64), np.empty((1, 0), np.int64)
    for column in columns:
        there = column[going] != _MARK
        going, prefix = going[there], prefix[there]
        code, prefix, n = np.unique(prefix * size + column[going], return_inverse=True, return_counts=True)
        rows = np.concatenate([rows[code // max(size, 1)], (code % max(size, 1))[:, None]], 1)
        out.append((rows, n.astype(np.int64)))
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], list[Level]]]:
    """Sorted phrase counts of parts of the texts (lang, text)."""
    held: dict[str, _Held] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            if text.is_valid and len(text.as_buffer()):
                own = held.setdefault(lang, _Held())
                size -= own.size
                own.add(text.as_buffer().to_pybytes())
                size += own.size
            while size > HELD:
                largest = max(held, key=lambda k: held[k].size)
                size -= held[largest].size
                yield from ((largest, *shard) for shard in held.pop(largest).shards())
    for lang in list(held):
        yield from ((lang, *shard) for shard in held.pop(lang).shards())


def _phrases_at(words: list[bytes], levels: list[Level], at: np.ndarray) -> list[list[bytes]]:
    """The phrases at some places of the order of all of them."""
    if not len(at):
        return []
    every = np.concatenate([keys(ids, WORDS) for ids, _ in levels])
    chosen = np.frombuffer(np.partition(every, at)[at].tobytes(), ">u4").reshape(len(at), WORDS)
    return [[words[(x - 2) // 2] for x in row if x] for row in chosen.tolist()]


def boundaries(texts: DataFrame) -> dict[str, list[tuple[bytes, ...]]]:
    """Phrases that cut each language into ranges of about RANGE phrases: one phrase per range comes to the driver.

    They are drawn from a share of the texts; which ones decides how large the ranges are and nothing else.
    """
    step = max(1, int(RANGE * SHARE / MARKS))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, levels in _shards(batches):
            entries = sum(len(weight) for _, weight in levels)
            # Where the first mark stands depends on the phrases, so that small parts count with their share.
            first = int((levels[0][0].sum() * 0x9E3779B1 + entries) % step)
            found = _phrases_at(words, levels, np.arange(first, entries, step))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.list_(pa.binary()))], names=["lang", "mark"])

    drawn = texts.sample(SHARE, seed=7).mapInArrow(marks, "lang string, mark array<binary>")
    ordered = drawn.repartitionByRange(partitions(texts.sparkSession), "lang", "mark").sortWithinPartitions("lang", "mark")
    # The low bits number the rows of each sorted part.
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    chosen = ordered.select("lang", "mark", number.alias("number")).where(F.col("number") % MARKS == 0)
    out: dict[str, list] = {}
    for row in chosen.select("lang", "mark").distinct().collect():
        out.setdefault(row["lang"], []).append(tuple(map(bytes, row["mark"])))
    return {lang: sorted(found) for lang, found in out.items()}


def _grouped(df: DataFrame, work: Callable[[str, int, Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on the rows (kind, origin, automaton) of each (lang, range), in order of kind and origin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(column[i].as_py() for column in batch.columns) for batch in batches for i in range(batch.num_rows))
        for (lang, number), group in groupby(rows, key=lambda row: row[:2]):
            yield from work(lang, number, (row[2:] for row in group))

    ordered = df.select("lang", "range", "kind", "origin", "automaton").repartition(partitions(df.sparkSession), "lang", "range").sortWithinPartitions("lang", "range", "kind", "origin")
    return ordered.mapInArrow(run, schema)


#: What a row of a range is: its counts, parts others ask for, counts they answer, what longer candidates contain.
_COUNTS, _ASKED, _ANSWERED, _CONTAINED = range(4)
_PIECE = "lang string, range int, kind int, origin long, automaton binary"


def _piece(lang: str, number: int, kind: int, origin: int, words: list[bytes], levels: list[Level]) -> pa.RecordBatch:
    automaton = CountAutomaton.build(*renumbered(words, levels)).to_bytes()
    return pa.RecordBatch.from_arrays(
        [pa.array([lang]), pa.array([number], pa.int32()), pa.array([kind], pa.int32()), pa.array([origin], pa.int64()), pa.array([automaton], pa.binary())], names=["lang", "range", "kind", "origin", "automaton"]
    )


def frequent_phrases(texts: DataFrame, cuts, least: int) -> DataFrame:
    """Of every range one automaton of its phrases that occur ``least`` times or more; the origin is the number of all its words."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, levels in _shards(batches):
            for number, part in cut(words, levels, cuts.value.get(lang, [])):
                yield _piece(lang, number, _COUNTS, 0, words, part)

    def united(lang: str, number: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        words, levels = union([CountAutomaton.from_bytes(row[2]) for row in rows], WORDS)
        often = [weight >= least for _, weight in levels]
        yield _piece(lang, number, _COUNTS, int(levels[0][1].sum()), words, [(ids[o], weight[o]) for (ids, weight), o in zip(levels, often)])

    return _grouped(texts.mapInArrow(parts, _PIECE), united, _PIECE)


def _padded(levels: list[Level]) -> list[Level]:
    return levels + [(np.empty((0, m + 1), np.int64), np.empty(0, np.int64)) for m in range(len(levels), WORDS)]


def asked_parts(counts: DataFrame, cuts) -> DataFrame:
    """The parts of each range's candidates as automata for the ranges that hold them; a weight is 1 and the count of the commonest candidate around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, origin, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                automaton = CountAutomaton.from_bytes(data.as_py())
                levels = _padded(automaton.levels())
                asked = []
                for m in range(1, WORDS):
                    around = [(ids[:, a : a + m], weight) for ids, weight in levels[m:] for a in range(ids.shape[1] - m + 1)]
                    parts, (most,) = summed(np.concatenate([x for x, _ in around]), [np.concatenate([w for _, w in around])], np.maximum)
                    asked.append((parts, 1 + most))
                for number, part in cut(automaton.words, _padded(asked), cuts.value.get(lang, [])):
                    yield _piece(lang, number, _ASKED, origin, automaton.words, part)

    return counts.select("lang", "range", "automaton").mapInArrow(run, _PIECE)


def answers(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """Counts of the parts asked for, dealt back to where they come from, and for each phrase the weight of what contains it."""

    def work(lang: str, number: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        own: CountAutomaton | None = None
        around: list[CountAutomaton] = []
        for kind, origin, data in rows:
            automaton = CountAutomaton.from_bytes(data)
            if kind == _COUNTS:
                own = automaton
                continue
            around.append(automaton)
            if len(around) > 64:
                around = [CountAutomaton.build(*union(around, WORDS, np.maximum))]
            yield _piece(lang, origin, _ANSWERED, number, *composed(automaton, own))
        if around:
            yield _piece(lang, number, _CONTAINED, number, *union(around, WORDS, np.maximum))

    return _grouped(union_all(counts, asked), work, _PIECE)


def composed(asked: CountAutomaton, counts: CountAutomaton) -> tuple[list[bytes], list[Level]]:
    """The sequences that both have, with the weights of ``counts``: paths are followed in both at once."""
    place = {w: i for i, w in enumerate(counts.words)}
    to = np.fromiter((place.get(w, -1) for w in asked.words), np.int64, len(asked.words))
    edge_key = np.repeat(np.arange(len(counts.begin) - 1), np.diff(counts.begin)) * (len(counts.words) + 1) + counts.label
    a, b, ids = np.array([len(asked.begin) - 2]), np.array([len(counts.begin) - 2]), np.empty((1, 0), np.int64)
    out = []
    while len(a):
        fan = asked.begin[a + 1] - asked.begin[a]
        edge = np.repeat(asked.begin[a] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
        b, ids = np.repeat(b, fan), np.repeat(ids, fan, axis=0)
        label = to[asked.label[edge]]
        key = b * (len(counts.words) + 1) + label
        other = np.minimum(np.searchsorted(edge_key, key), max(len(edge_key) - 1, 0))
        met = (label >= 0) & (edge_key[other] == key) if len(edge_key) else np.zeros(len(key), bool)
        edge, other, ids = edge[met], other[met], np.concatenate([ids[met], label[met, None]], 1)
        wanted = (asked.weight[edge] > 0) & (counts.weight[other] > 0)
        out.append((ids[wanted], counts.weight[other[wanted]]))
        on = (asked.target[edge] > 0) & (counts.target[other] > 0)
        a, b, ids = asked.target[edge[on]], counts.target[other[on]], ids[on]
    return counts.words, _padded(out)


def scored(counts: DataFrame, answered: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one makes superfluous."""

    def work(lang: str, number: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[list[CountAutomaton]] = [[], [], []]
        for kind, _, data in rows:
            held[{_COUNTS: 0, _ANSWERED: 1, _CONTAINED: 2}[kind]].append(CountAutomaton.from_bytes(data))
        words, levels = union([CountAutomaton.build(*union(x, WORDS, np.maximum)) for x in held[:2]], WORDS, np.maximum)
        place = {w: i for i, w in enumerate(words)}
        over = lambda found: [(np.array([place[w] for w in found[0]], np.int64)[ids], weight) for ids, weight in found[1]]
        own = over(union(held[0], WORDS))
        around = over(union(held[2], WORDS, np.maximum))
        for m in range(2, WORDS + 1):
            ids, a = own[m - 1]
            if not len(a):
                continue
            longer = _looked_up(around[m - 1], ids)
            a, most = a.astype(object), np.maximum(longer - 1, 0).astype(object)
            best = None
            for k in range(1, m):
                left, right = (_looked_up(levels[n - 1], part).astype(object) for n, part in ((k, ids[:, :k]), (m - k, ids[:, k:])))
                score = 1_000_000 * a * a // (left * right)  # Python's numbers: no product is too large
                if best is None:
                    best = [left, right, score]
                else:
                    better = np.array(score < best[2], bool)
                    best = [np.where(better, new, old) for new, old in zip((left, right, score), best)]
            stays = ~np.array((most > 0) & (100 * most >= percent * a), bool)
            phrases = [b" ".join(words[i] for i in row).decode() for row in ids[stays].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), *(pa.array(x[stays].tolist(), pa.int64()) for x in (a, *best))], names=["lang", "phrase", "a", "l", "r", "score"]
            )

    return _grouped(union_all(counts, answered), work, "lang string, phrase string, a long, l long, r long, score long")


def _looked_up(level: Level, ids: np.ndarray) -> np.ndarray:
    """Weights of the rows of ``ids``, 0 where there is none."""
    have, weight = level
    if not len(have) or not len(ids):
        return np.zeros(len(ids), np.int64)
    code = codes(np.concatenate([have, ids]))
    have, want = code[: len(have)], code[len(have) :]
    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
    return np.where(have[at] == want, weight[at], 0)


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, percent: int = 50, most: int = 2_000) -> DataFrame:
    """The best collocations of each language: (lang, rank, phrase, a, l, r, n, score), numbers long.

    Texts are lower-cased (A-Z) and parted at ``.,;:!?`` and line ends; words stand between spaces and tabs.
    A candidate has 2 or 3 words and occurs a >= ``least`` times within parts, overlaps counted. Cut in two,
    its parts occur l and r times; the cut with the lowest score floor(1000000 a a / (l r)) counts, of equal
    ones the first. A candidate goes if it lies in a longer one that occurs at least ``percent`` % as often.
    Each language keeps ``most`` by score, a, then phrase in byte order; n are all its words. A null language
    is ``und``. Null and empty texts have no words; repeated rows count as often as they occur; a table
    without candidates gives no rows. Other columns are not read. Arithmetic is exact below 2^63.
    """
    spark = df.sparkSession
    paths = [scratch_path(spark, f"collocations-{name}") for name in ("counts", "asked", "answered", "scored")]
    texts = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    cuts = spark.sparkContext.broadcast(boundaries(texts))  # one phrase for each range
    counts = stored(frequent_phrases(texts, cuts, least), paths[0])
    totals = checkpointed(counts.groupBy("lang").agg(F.sum("origin").alias("n")))
    asked = stored(asked_parts(counts, cuts), paths[1])
    answered = stored(answers(counts, asked), paths[2])
    found = stored(scored(counts, answered, percent), paths[3])
    discard(spark, *paths[:3])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
