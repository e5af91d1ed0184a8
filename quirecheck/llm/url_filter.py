"""URL filters as a sort-merge range join.

A host is turned round label by label ("a.example.net" becomes "net.example.a."), so a rule for a
host and its subdomains is an interval of keys. Rows and rules are cut at the same boundaries, sorted,
and swept once; the sweep keeps the rules whose interval it is in on a stack, inner ones on top.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirecheck.llm.shared import ascii_lower, in_fraction, partitions

#: Keys drawn for each boundary; this bounds what the driver sees of the table.
KEYS_PER_BOUNDARY = 50


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no host part."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot: subdomains of a host start with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rule that decides each url of ``df``: (id_col, host, path, rule, verdict), one row per row.

    ``rules`` has host, path and verdict (texts). A rule fits its host and all subdomains where the
    path of the url starts with its path; the longest rule (host and path together, then host) wins,
    of equal ones the one that blocks. Without a rule the verdict is ``default`` and the rule null. A
    null url, or one without ``://``, has an empty host and path. Rules with a null host are ignored, a
    null path is empty. Empty tables give empty results; other columns of ``df`` are not carried.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    url = F.coalesce(F.col(url_col), F.lit(""))
    keyed = df.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64(F.col(id_col), F.col(url_col)).alias("salt"))
    # The salt follows a byte below every host character: a hot host spans many ranges, prefixes still hold.
    keyed = keyed.select("id", "host", "path", F.concat(host_key(F.col("host")), F.lit("\x00"), F.hex("salt")).alias("key"), "salt")
    bounds = spark.sparkContext.broadcast(_boundaries(keyed, n))

    @F.pandas_udf("int")
    def range_of(keys):
        return keys.map(lambda k: bisect.bisect_right(bounds.value, k)).astype("int32")

    rule_key = host_key(ascii_lower(F.col("host")))
    intervals = rules.where("host is not null").select(
        ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict", rule_key.alias("key"),
        F.concat(F.regexp_replace(rule_key, r"\.\z", ""), F.lit("/")).alias("end"),  # "/" follows "."
    )
    opened = intervals.select(
        F.lit(None).cast(df.schema[id_col].dataType).alias("id"), "host", "path", "key", "verdict",
        F.explode(F.sequence(range_of("key"), range_of("end"))).alias("range"),
    )
    urls = keyed.select("id", "host", "path", "key", F.lit(None).cast("string").alias("verdict"), range_of("key").alias("range"), F.lit(1).alias("kind"))
    events = urls.unionByName(opened.withColumn("kind", F.lit(0))).repartitionById(n, "range").sortWithinPartitions("range", "key", "kind")
    id_type = df.schema[id_col].dataType.simpleString()
    return events.mapInArrow(_sweeper(default), f"id {id_type}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def _boundaries(keyed: DataFrame, n: int) -> list[str]:
    """n - 1 keys that cut the table into ranges of about equal size, from a bounded sample."""
    total = keyed.count()
    if not total:
        return []
    share = min(1.0, n * KEYS_PER_BOUNDARY / total)
    # Drawn by a hash of the salt, as the salt itself is part of the order.
    keys = sorted(r[0] for r in keyed.where(in_fraction(F.xxhash64("salt"), share)).select("key").collect())
    return [keys[len(keys) * i // n] for i in range(1, n)] if keys else []


def _sweeper(default: str):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, dict]] = []  # (key, {path: (rule, verdict)}) of the intervals the sweep is in
        at = None
        for batch in batches:
            cols = {name: batch.column(name).to_pylist() for name in ("host", "path", "key", "verdict", "range", "kind")}
            keep, rules, verdicts = [], [], []
            for i, (host, path, key, verdict, part, kind) in enumerate(zip(*(cols[c] for c in ("host", "path", "key", "verdict", "range", "kind")))):
                if part != at:
                    stack, at = [], part
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}))
                    held = stack[-1][1]
                    if path not in held or verdict == "block":
                        held[path] = (host + path, verdict)
                    continue
                best = None
                for rule_key, held in reversed(stack):
                    for size in sorted({len(p) for p in held}, reverse=True):
                        found = held.get(path[:size]) if size <= len(path) else None
                        if found:
                            if best is None or len(found[0]) > len(best[0]):
                                best = found
                            break
                keep.append(i)
                rules.append(best[0] if best else None)
                verdicts.append(best[1] if best else default)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("host"), rows.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    return sweep
