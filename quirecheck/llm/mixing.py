"""Mixing overlapping sources to target sizes by min-cost flow.

Documents with the same set of sources are one pattern. Patterns give words to their sources in layers:
the first copy of every document costs nothing, each further copy more than the last, and a source takes
no more than its target. The cheapest flow says how many copies of each pattern to take; the fraction of a
copy goes to the documents that come first by a seeded hash.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirecheck.llm.shared import WORD, whole_text
from quirecheck.sources.checkpoints import checkpointed

#: Patterns and sources that the flow is solved over; more raise an error, none are left out.
PATTERNS = 20_000
#: Bits of the hash that a first sum runs over; the cut is then made exactly within one value of them.
BITS = 12


def sizes(text_col: str = "text") -> Column:
    """Words of a text; null counts as empty."""
    return F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")


def targets(source_sizes: dict, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict:
    """Target of each source: ``share`` of all sizes by weight, at most ``most`` times the source's size.

    Sources weigh ``weights`` in turn, in order of their code points, null last. What a limit cuts off is
    shared among the others by weight, until nothing is above its limit.
    """
    order = sorted(source_sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(source_sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * source_sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: most * source_sizes[s] for s in full}
        left = max(0.0, left - sum(target[s] for s in full))
        open_ = [s for s in open_ if s not in target]
    return target


class Flow:
    """Min-cost flow by successive cheapest paths."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: float, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, start: int, end: int, least: float = 1e-6) -> None:
        while True:
            cost, via = [float("inf")] * len(self.out), [-1] * len(self.out)
            cost[start], queue, waiting = 0, deque([start]), {start}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] > least and cost[a] + self.cost[e] < cost[b]:
                        cost[b], via[b] = cost[a] + self.cost[e], e
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
            if via[end] < 0:
                return
            path, at = [], end
            while at != start:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def copies(patterns: dict[tuple, int], quotas: dict, most: int = 2) -> dict[tuple, float]:
    """Copies of each pattern (0 to ``most``, with a fraction) that fill the quotas at least cost.

    ``patterns`` maps sets of sources to sizes. The k-th copy costs k - 1 per word, so no document is
    repeated while another of its sources is unused. A pattern of size 0 gets none.
    """
    order, sources = sorted(patterns, key=repr), sorted(quotas, key=repr)
    place = {s: 1 + len(order) + i for i, s in enumerate(sources)}
    flow = Flow(2 + len(order) + len(sources))
    end = len(flow.out) - 1
    layers = {}
    for i, p in enumerate(order):
        layers[p] = [flow.edge(0, 1 + i, float(patterns[p]), k) for k in range(most)]
        for s in p:
            flow.edge(1 + i, place[s], float("inf"), 0)
    for s in sources:
        flow.edge(place[s], end, quotas[s], 0)
    flow.solve(0, end)
    return {p: sum(flow.room[e ^ 1] for e in layers[p]) / patterns[p] if patterns[p] else 0.0 for p in order}


def _keyed(df: DataFrame, id_col: str, sources_col: str, seed: int) -> DataFrame:
    """With the pattern of a row and its place in the order in which rows are taken."""
    pattern = F.to_json(F.struct(F.array_sort(F.array_distinct(sources_col)).alias("s")), {"ignoreNullFields": "false"})
    return df.withColumn("_pattern", pattern).withColumn("_order", F.xxhash64(id_col, sources_col, F.lit(seed)))


def plan_mix(slim: DataFrame, quotas: dict, most: int = 2, seed: int = 17) -> DataFrame:
    """How to take each pattern of ``slim`` (id, sources, size), which is read a few times: copies and a cut."""
    slim = _keyed(slim, "id", "sources", seed).select("_pattern", "sources", "_order", "size")
    found = slim.groupBy("_pattern").agg(F.first(F.array_sort(F.array_distinct("sources"))).alias("s"), F.sum("size").alias("n")).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} sets of sources")
    wanted = copies({tuple(r["s"]): r["n"] for r in found}, quotas, most)
    plan = []
    for r in found:
        times = wanted[tuple(r["s"])]
        whole = min(int(times + 1e-9), most)
        plan.append((r["_pattern"], whole, max(0.0, (times - whole) * r["n"]) if whole < most else 0.0))
    plan_df = slim.sparkSession.createDataFrame(plan, "_pattern string, _whole int, _more double")
    # The cut: first by leading bits of the hash, then exactly within the value where the sum passes.
    parts = slim.groupBy("_pattern", _high().alias("high")).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("_pattern").orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
    at = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(plan_df, "_pattern").where((F.col("before") <= F.col("_more")) & (F.col("before") + F.col("n") > F.col("_more")))
    near = slim.withColumn("high", _high()).join(at.select("_pattern", "high", "before", "_more"), ["_pattern", "high"])
    near = near.groupBy("_pattern", "_order").agg(F.sum("size").alias("n"), F.first("before").alias("before"), F.first("_more").alias("_more"))
    upto = Window.partitionBy("_pattern").orderBy(_rank()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Rows of one hash are in if more than half of them fits.
    fits = near.withColumn("sum", F.col("before") + F.sum("n").over(upto)).where(F.col("sum") - F.col("n") / 2 <= F.col("_more"))
    cuts = at.groupBy("_pattern").agg(F.min("high").alias("_high")).join(fits.groupBy("_pattern").agg(F.max(_rank()).alias("_last")), "_pattern", "left")
    return checkpointed(plan_df.join(cuts, "_pattern", "left"))


def _high() -> Column:
    return F.shiftrightunsigned("_order", 64 - BITS).cast("int")


def _rank() -> Column:
    """The hash in unsigned order, as its leading bits have it."""
    return F.col("_order").bitwiseXOR(F.lit(-(1 << 63)))


def with_copies(df: DataFrame, plan: DataFrame, id_col: str, sources_col: str, seed: int = 17) -> DataFrame:
    """``df`` with the column ``copies`` that ``plan_mix`` decided on; a column of that name is replaced."""
    df = df.drop("copies")
    first = (_high() < F.col("_high")) | ((_high() == F.col("_high")) & F.coalesce(_rank() <= F.col("_last"), F.lit(False)))
    taken = F.col("_whole") + F.when((F.col("_more") > 0) & F.coalesce(first, F.lit(True)), 1).otherwise(0)
    packed = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("id"), F.col(sources_col).alias("sources"))
    return _keyed(packed, "id", "sources", seed).join(plan, "_pattern").select("row.*", taken.cast("int").alias("copies"))


def mix(df: DataFrame, quotas: dict, id_col: str = "id", sources_col: str = "sources", size_col: str = "size", most: int = 2, seed: int = 17) -> DataFrame:
    """``df`` with ``copies``: how often the mix takes each row, 0 to ``most`` times.

    ``sources_col`` is the array of sources a row belongs to (null is a source like any other; an empty array
    gives 0 copies), ``quotas`` their targets in units of ``size_col``. Rows of one pattern and one hash are
    taken alike, so repeated rows stay together; the words taken of a pattern miss its share of the flow by
    about half of such a set at most. Reruns agree: nothing depends on the order of rows.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(sources_col).alias("sources"), F.col(size_col).alias("size"))
    return with_copies(df, plan_mix(slim, quotas, most, seed), id_col, sources_col, seed)


def _quotas(slim: DataFrame, weights: tuple, share: float, most: int) -> tuple[dict, dict]:
    by_source = {r["source"]: r["n"] for r in slim.groupBy("source").agg(F.sum("size").alias("n")).limit(PATTERNS + 1).collect()}
    if len(by_source) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} sources")
    return by_source, targets(by_source, weights, share, most)


def _slim(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return checkpointed(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.array(source_col).alias("sources"), sizes(text_col).alias("size")))


def mix_by_source(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(id, source, size, source_size, target, copies) of every row, mixed to weighted targets.

    Each row has one source; null is a source, too, and comes last. Null texts have size 0; rows of size 0
    are taken as the others. Empty tables give empty results.
    """
    slim = _slim(df, id_col, source_col, text_col)
    by_source, quotas = _quotas(slim, weights, share, most)
    mixed = mix(slim, quotas, most=most)
    sums = df.sparkSession.createDataFrame([(s, by_source[s], float(quotas[s])) for s in quotas], "source string, source_size long, target double")
    return mixed.join(sums, mixed["source"].eqNullSafe(sums["source"])).select("id", mixed["source"], "size", "source_size", "target", "copies")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of ``df`` as the mix of ``mix_by_source`` takes them: each as often as its copies say."""
    slim = _slim(df, id_col, source_col, text_col)
    plan = plan_mix(slim, _quotas(slim, weights, share, most)[1], most)
    packed = df.select(F.struct(*df.columns).alias("doc"), F.col(id_col).alias("id"), F.array(source_col).alias("sources"))
    taken = with_copies(packed, plan, "id", "sources").where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
