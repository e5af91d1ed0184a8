"""Lookups in reference tables and glossaries.

A reference table is (row_no, cells): untyped rows of text in file order, a header row first. Equality is a
join. Keys inside names are found by a join too, with the pieces of the names that begin and are as long as a key;
terms inside long texts by automata of bounded size, which walk the texts where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirecheck.functions.terms import Terms
from quirecheck.functions.text import normalize
from quirecheck.functions.validators import digits_of
from quirecheck.operators.unions import union_all
from quirecheck.sources.checkpoints import checkpointed

#: Shortest key, in bytes, that is sought inside a name.
INSIDE = 3
#: Letters at the start of a key that a piece of a name must share, at most, and the hashes of such starts.
HEAD, HEADS = 8, 1 << 18
#: Letters of the keys of one automaton, about.
SHARD = 4_000_000


def lookup_value(requests: DataFrame, reference: DataFrame, key: str = "key") -> DataFrame:
    """Second cell of the first row whose first cell equals the key; the header row counts."""
    first = reference.groupBy(F.col("cells")[0].alias(key)).agg(
        F.min_by(F.try_element_at("cells", F.lit(2)), "row_no").alias("value")
    )
    return requests.join(first, key, "left")


def _shards(terms: DataFrame, term: str) -> Iterator[list]:
    """The rows of ``terms`` in parts of about SHARD letters, one part on the driver at a time."""
    letters = terms.agg(F.sum(F.char_length(term))).first()[0] or 0
    parts = -(-letters // SHARD)
    for part in range(parts):
        yield terms.where(F.pmod(F.xxhash64(term), F.lit(parts)) == part).collect()


def containing(keys: DataFrame, texts: DataFrame, key: str, text: str, id_col: str) -> DataFrame:
    """(key, id) of every text that contains the key, for distinct keys that are not empty.

    Keys become automata of bounded size; each walks the texts where they are, so no text is shuffled. Null texts contain nothing.
    """
    kinds = f"{key} string, {id_col} {dict(texts.dtypes)[id_col]}"
    found = [keys.sparkSession.createDataFrame([], kinds)]
    for rows in _shards(keys.select(key), key):
        known = keys.sparkSession.sparkContext.broadcast([r[0] for r in rows])  # SHARD letters, about

        def walk(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            terms = Terms(known.value)
            for batch in batches:
                hits = [sorted(terms.within(t)) if t else [] for t in batch.column(1).to_pylist()]
                at = [i for i, h in enumerate(hits) for _ in h]
                yield pa.RecordBatch.from_arrays([pa.array([known.value[n] for h in hits for n in h], pa.string()), batch.column(0).take(pa.array(at, pa.int64()))], names=[key, id_col])

        found.append(texts.select(id_col, text).mapInArrow(walk, kinds))
    return union_all(*found)


def inside_names(keys: DataFrame, names: DataFrame, key: str, name: str, id_col: str) -> DataFrame:
    """(key, id) of every name that contains the key, for distinct keys that are not empty.

    Names are short. A table of bounded size, from the hash of a key's first letters to the lengths of such keys,
    tells which pieces of a name can be keys; these meet the keys by an equi-join. Null names contain nothing.
    """
    shortest = keys.agg(F.min(F.char_length(key))).first()[0] or 1
    head = min(HEAD, shortest)
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(HEADS)).cast("int")
    lengths = keys.select(hashed(F.substring(key, 1, head)).alias("_head"), F.char_length(key).alias("_n")).groupBy("_head").agg(F.collect_set("_n").alias("_lengths"))
    letters = F.char_length(name)
    # Names are few bytes and many pieces, so they are dealt to all tasks whatever their size.
    long = names.where(letters >= head).repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    starts = long.select(F.col(id_col), F.col(name), F.explode(F.sequence(F.lit(1), letters - head + 1)).alias("_at"))
    able = starts.withColumn("_head", hashed(F.substring(F.col(name), F.col("_at"), F.lit(head)))).join(F.broadcast(lengths), "_head")
    fit = able.select(id_col, name, "_at", F.explode("_lengths").alias("_n")).where(F.col("_at") + F.col("_n") <= letters + 1)
    pieces = fit.select(F.substring(F.col(name), F.col("_at"), F.col("_n")).alias(key), id_col)
    return keys.select(key).join(pieces, key)


def query_table(requests: DataFrame, reference: DataFrame, key: str = "key") -> DataFrame:
    """Adds ``cells``, the first data row that answers the key, or null.

    A row answers when its first cell equals the key or, for keys of three bytes and more, when its
    second cell contains it; both sides are normalised. Each distinct key is looked up once.
    """
    asked = requests.withColumn("_key", normalize(F.col(key)))
    # Both are read several times, and filters on what they compute would compute it again for each.
    keys = checkpointed(asked.select("_key").distinct()).filter(F.col("_key").isNotNull())
    rows = reference.select(
        "row_no",
        "cells",
        normalize(F.col("cells")[0]).alias("_key"),
        normalize(F.coalesce(F.try_element_at("cells", F.lit(2)), F.lit(""))).alias("_name"),
    )
    rows = checkpointed(rows).filter("row_no > 0")
    equal = keys.join(rows.select("_key", "row_no"), "_key")
    # Only the first row of a name can answer.
    names = rows.groupBy("_name").agg(F.min("row_no").alias("row_no"))
    inside = inside_names(keys.filter(F.octet_length("_key") >= INSIDE), names, "_key", "_name", "row_no")
    first = union_all(equal, inside).groupBy("_key").agg(F.min("row_no").alias("row_no"))
    answers = first.join(rows.select("row_no", "cells"), "row_no").select("_key", "cells")
    return asked.join(answers, "_key", "left").drop("_key")


def query_by_digits(requests: DataFrame, reference: DataFrame, key: str = "key", length: int | None = None) -> DataFrame:
    """:func:`query_table` on the digits of the key; with ``length``, other lengths get an ``error``."""
    digits = digits_of(F.col(key))
    asked = requests.withColumn("_digits", digits)
    if length is None:
        return query_table(asked, reference, "_digits").drop("_digits")
    wrong = F.length("_digits") != length
    message = F.concat(F.lit(f'postal code must have {length} digits (got "'), F.col("_digits"), F.lit('")'))
    asked = asked.withColumn("error", F.when(wrong, message)).withColumn("_digits", F.when(~wrong, F.col("_digits")))
    return query_table(asked, reference, "_digits").drop("_digits")


def validate_address(requests: DataFrame, reference: DataFrame, key: str, fragment: str) -> DataFrame:
    """Do the cells found for the code, joined with blanks, contain the fragment?"""
    found = query_by_digits(requests, reference, key)
    contained = F.contains(normalize(F.array_join("cells", " ")), normalize(F.col(fragment)))
    return found.withColumn("ok", F.coalesce(contained, F.lit(False))).drop("cells")


def _missing_parts(docs: DataFrame, glossary: DataFrame) -> list[DataFrame]:
    """For each part of the glossary (row, doc_id, missing): the terms (term_no, term) of the part that a text lacks, in order.

    ``row`` numbers the rows of ``docs``. A null text counts as empty; an empty term is in every text and a null
    term is no term. Parts are bounded by SHARD; a glossary of usual size is one, and every text is walked once.
    """
    plain = normalize(F.col("term")).alias("plain")
    terms = glossary.where(F.col("term").isNotNull()).select(F.col("term_no").cast("bigint").alias("term_no"), "term", plain).where("plain <> ''")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", normalize(F.coalesce("text", F.lit(""))).alias("text"))
    kinds = f"row long, doc_id {dict(docs.dtypes)['doc_id']}, missing array<struct<term_no:bigint,term:string>>"
    out = []
    for rows in _shards(terms, "plain"):
        ordered = sorted(rows, key=lambda r: (r["term_no"], r["term"]))
        known = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in ordered])

        def walk(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            rows = known.value
            distinct = list(dict.fromkeys(r[2] for r in rows))
            place = {t: i for i, t in enumerate(distinct)}
            of_term = np.array([place[r[2]] for r in rows])
            terms = Terms(distinct)
            listed = pa.StructArray.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string())], names=["term_no", "term"])
            for batch in batches:
                present = np.zeros((batch.num_rows, len(distinct)), bool)
                for i, t in enumerate(batch.column(2).to_pylist()):
                    present[i, list(terms.within(t))] = True
                row, at = np.nonzero(~present[:, of_term])
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed.take(pa.array(at)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["row", "doc_id", "missing"])

        out.append(texts.mapInArrow(walk, kinds))
    if not out:
        out.append(texts.select("row", "doc_id", F.array().cast("array<struct<term_no:bigint,term:string>>").alias("missing")))
    return out


def missing_rows(docs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(row, doc_id, missing), a row for each row of ``docs`` and each part of the glossary; see :func:`missing_terms`."""
    return union_all(*_missing_parts(docs, glossary))


def missing_terms(docs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, missing): the glossary terms absent from each text, in glossary order.

    The list of a document has nearly the whole glossary, so that much has to fit a row; :func:`missing_rows` has it in parts.
    """
    parts = _missing_parts(docs, glossary)
    whole = parts[0]
    if len(parts) > 1:
        whole = union_all(*parts).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.flatten(F.collect_list("missing"))).alias("missing"))
    return whole.select("doc_id", F.transform("missing", lambda t: t["term"]).alias("missing"))
