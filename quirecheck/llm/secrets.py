"""Secret scans with a trigram inverted index, in DataFrame operations only.

From each rule's pattern follows a Boolean query over trigrams that every match must contain: a choice of
clauses, each a set of trigrams. Postings list the documents of every trigram that some query names;
intersecting them per clause leaves the candidates, and only those are matched. Rules without such trigrams
are matched everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirecheck.llm.shared import whole_text

#: Literal strings a query keeps apart at once; beyond that it cuts the literal, which only widens it.
STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the common dialect of Java and Python; matches count if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# A private key: its BEGIN line, named header lines, then either key characters up to the END line, or lines of
# at least 40 key characters and a last, shorter one. Line ends may be written as \\n. Other text stays outside.
# All repeats are possessive, which Java runs as loops, so the length of a text takes no stack.
_KEY, _BREAK = r"[A-Za-z0-9+/=]", r"(?:[ \t\r\n]|\\[nr])*+"
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    rf"(?:{_BREAK}(?:Proc-Type|DEK-Info|Key-Info|Content-Domain|Comment): [^\r\n\\]*+)*+"
    r"(?:[A-Za-z0-9+/= \t\r\n\\]*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:(?:{_BREAK}{_KEY}{{40,}}+)++(?:[\r\n]++{_KEY}++(?:[ \t]*+[\r\n]|$)|[\r\n]++$|(?:\\[nr])++{_KEY}*+)?+)?+)"
)

# The base rules come first, in the order that breaks ties. Runs of a class are greedy, so
# a run of at least 32 characters is the same as a run that is then checked for its length.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32, True),
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of which one must hold in every text that matches: its trigrams are all in the lower-cased text.

    An empty list means that the pattern names no trigrams that a match must have.
    """
    clauses = _clauses(sre_parser.parse(pattern))
    clauses = {c for c in clauses if not any(d < c for d in clauses)}
    return [] if frozenset() in clauses else sorted(clauses, key=sorted)


def _clauses(parsed) -> set[frozenset[str]]:
    """Every clause is a conjunction; a match satisfies at least one."""
    every = {frozenset()}
    literals = {""}  # what the text around here must be, one of these

    def flush():
        nonlocal every, literals
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in literals}
        every = {a | b for a, b in product(every, grams)}
        literals = {""}

    for part in parsed:
        strings = _strings(part)
        if strings is not None and len(literals) * len(strings) <= STRINGS:
            literals = {a + b for a, b in product(literals, strings)}
            continue
        flush()
        op, args = part
        if strings is not None:
            literals = set(strings)
        elif op is sre.SUBPATTERN:
            every = {a | b for a, b in product(every, _clauses(args[3]))}
        elif op is sre.MAX_REPEAT and args[0] > 0:
            every = {a | b for a, b in product(every, _clauses(args[2]))}
        elif op is sre.BRANCH:
            every = {a | b for a, b in product(every, set().union(*(_clauses(x) for x in args[1])))}
    flush()
    return every


def _strings(part) -> set[str] | None:
    """All lower-cased strings a part can match, if they are few; None otherwise."""
    op, args = part
    if op is sre.LITERAL:
        return {chr(args).lower()}
    if op is sre.IN and all(x[0] is sre.LITERAL for x in args):
        return {chr(x[1]).lower() for x in args}
    if op is sre.SUBPATTERN:
        return _sequence(args[3])
    if op is sre.BRANCH:
        kinds = [_sequence(x) for x in args[1]]
        return None if None in kinds else set().union(*kinds)
    if op is sre.MAX_REPEAT and args[1] is not sre.MAXREPEAT and args[1] <= 5:
        one = _sequence(args[2])
        if one is None:
            return None
        found = {"".join(x) for n in range(args[0], args[1] + 1) for x in product(one, repeat=n)} if len(one) ** args[1] <= STRINGS else None
        return found
    return None


def _sequence(parts) -> set[str] | None:
    out = {""}
    for part in parts:
        strings = _strings(part)
        if strings is None or len(out) * len(strings) > STRINGS:
            return None
        out = {a + b for a, b in product(out, strings)}
    return out


def postings(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """(id, gram): the inverted index, limited to the trigrams that queries can ask for; gram is a place in the list."""
    lowered = docs.select(F.col(id_col).alias("id"), F.lower(whole_text(text_col)).alias("t"))
    present = F.array_compact(F.array(*(F.when(F.contains("t", F.lit(g)), F.lit(i)) for i, g in enumerate(trigrams))))
    return lowered.select("id", F.explode(present).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]], trigrams: list[str]) -> DataFrame:
    """(id, kinds): documents in which some clause of a kind has all of its trigrams."""
    place = {g: i for i, g in enumerate(trigrams)}
    rows = [(place[g], number, kind, 1 << at, len(clause)) for number, (kind, clause) in enumerate((k, c) for k, q in queries.items() for c in q) for at, g in enumerate(sorted(clause))]
    clauses = index.sparkSession.createDataFrame(rows, "gram int, clause int, kind string, bit long, size int")  # the rule set
    met = index.join(clauses, "gram").groupBy("id", "clause").agg(F.bit_or("bit").alias("bits"), F.first("size").alias("size"), F.first("kind").alias("kind"))
    return met.where(F.bit_count("bits") == F.col("size")).groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Matches of one rule, leftmost and not overlapping: array of (start, number, end, kind), in code points.

    The text is cut at its matches; lengths of the pieces and of the matches add up to the places.
    """
    pattern = F.lit(rule.pattern)
    pieces, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, 0)
    checked = F.regexp_extract_all(text, pattern, rule.group) if rule.group else matches
    both = F.arrays_zip(pieces.alias("piece"), matches.alias("match"), checked.alias("checked"))
    element = "struct<start:int,number:int,end:int,kind:string>"

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        counts = F.coalesce(F.length(x["checked"]) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(counts, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{element}>").alias("out"))
    return F.aggregate(both, empty, add, lambda state: state["out"])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``df`` with ``spans``: array of (start, number, end, kind) in code points, the end exclusive, in order.

    Matches of each rule are leftmost and do not overlap; those of different rules may. A null text counts
    as empty. Rows with one id, or with a null id, share their candidates, which costs checks but changes no
    result; repeated rows are kept. A column of ``df`` that is called ``spans`` is replaced.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q}
    df = df.drop("spans")
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    text = whole_text(text_col)
    scanned = F.concat(none, *(spans_of(text, r, i) for i, r in enumerate(rules) if not queries[r.kind]))
    found = df.select(F.struct(*df.columns).alias("row"), scanned.alias("scanned"))
    kinds = F.array().cast("array<string>")
    if indexed:
        trigrams = sorted(set().union(*(c for q in indexed.values() for c in q)))
        hits = candidates(postings(df, id_col, text_col, trigrams), indexed, trigrams)
        found = found.join(hits, F.col(f"row.{id_col}").eqNullSafe(F.col("id")), "left")
        kinds = F.coalesce("kinds", kinds)
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    verified = [F.when(F.array_contains(kinds, r.kind), spans_of(text, r, i)).otherwise(none) for i, r in enumerate(rules) if queries[r.kind]]
    return found.select("row.*", F.array_sort(F.concat("scanned", *verified)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each stretch that spans cover replaced by ``mark``; overlapping spans are one stretch."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(state: Column, s: Column) -> Column:
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return (
            F.when(s["start"] >= state["at"], F.struct(s["end"].alias("at"), F.concat(state["out"], before, F.lit(mark)).alias("out")))
            .otherwise(F.struct(F.greatest(s["end"], state["at"]).alias("at"), state["out"].alias("out")))
        )

    return F.aggregate(spans, start, cut, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
