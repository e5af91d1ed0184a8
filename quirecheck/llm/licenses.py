"""License scans with a positional rare-token index, in DataFrame operations only.

Templates are sequences of words. How rare their words are is counted over all documents; the two rarest words
of a template's key phrase, which must stand in full, are its anchors. The rarer one is looked up in a document;
where the other stands at its distance from it, the template is put, and only those places are compared, word
by word. A template holds there if enough of its words, weighed by rarity, agree, and its key phrase stands.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirecheck.llm.shared import LOWER, UPPER, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The weight that must agree where not all of it must.
ENOUGH = 0.8


@dataclass(frozen=True)
class Template:
    """``words`` joined by spaces; ``key`` is the part that must stand in full (the whole for a base phrase)."""

    label: str
    words: str
    key: str
    base: bool = False


# The base phrases and their labels. The others are opening words of common licences.
BASE = [
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
]
TEMPLATES = [
    *BASE,
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
]


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and nothing else."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.regexp_extract_all(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), F.lit(WORD), 0)


def rarity(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each word of ``vocabulary`` over all rows of ``words``."""
    wanted = F.array(*map(F.lit, vocabulary))
    # An empty text counts as a document: "" is no word.
    seen = words.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(wanted, "words"))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in seen}  # at most the vocabulary and one
    return {w: math.log((1 + counts.get("", 0)) / (1 + counts.get(w, 0))) + 1 for w in vocabulary}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """(id_col, n_words, places): per row the places of templates, array of (start, template, label, base, score).

    ``start`` counts words from 0; a place needs its key phrase in full and ENOUGH of its weight, a base
    phrase all of it. Null and empty texts have no words and no places. Rows are judged one by one, so
    repeated rows and null ids need no care; other columns are not carried. A text of any length is scanned in
    time that grows with its length, however often its words are anchors.
    """
    texts = df.select(F.col(id_col).alias("id"), words_of(whole_text(text_col)).alias("words"))
    split = [t.words.split() for t in templates]
    weights = rarity(texts, sorted({w for words in split for w in words}))
    keys = [t.key.split() for t in templates]
    key_at = [next(i for i in range(len(words)) if words[i : i + len(key)] == key) for words, key in zip(split, keys)]
    posted: dict[str, list[tuple[int, int, int, str]]] = {}
    for number, (words, key, begin) in enumerate(zip(split, keys, key_at)):
        first, second = (sorted(range(begin, begin + len(key)), key=lambda i, words=words: (-weights[words[i]], i)) * 2)[:2]
        posted.setdefault(words[first], []).append((number, first, second - first, words[second]))
    rare = F.array(*map(F.lit, posted))
    entry = lambda n, o, d, w: F.struct(F.lit(n).alias("template"), F.lit(o).alias("offset"), F.lit(d).alias("on"), F.lit(w).alias("second"))
    index = F.create_map(*(x for w, found in posted.items() for x in (F.lit(w), F.array(*(entry(*f) for f in found)))))
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(rare, w), i)), lambda i: i.isNotNull())
    hits = texts.select("id", "words", at.alias("at"))
    # The rarer anchor stands once in a template, so no place is found twice.
    met = lambda i: F.filter(F.element_at(index, F.get("words", i)), lambda p: F.coalesce(F.get("words", i + p["on"]) == p["second"], F.lit(False)))
    placed = F.flatten(F.transform("at", lambda i: F.transform(met(i), lambda p: F.struct((i - p["offset"]).alias("start"), p["template"].alias("template")))))
    sizes = F.array(*(F.lit(len(words)) for words in split))
    inside = F.filter(placed, lambda p: (p["start"] >= 0) & (p["start"] + F.get(sizes, p["template"]) <= F.size("words")))
    # Templates as arrays, to compare the document's words at a place in one pass.
    wanted = F.array(*(F.array(*map(F.lit, words)) for words in split))
    weight = F.array(*(F.array(*(F.lit(weights[w]) for w in words)) for words in split))
    whole = F.array(*(F.lit(sum(weights[w] for w in words)) for words in split))
    key_from, key_size = (F.array(*map(F.lit, x)) for x in (key_at, list(map(len, keys))))

    def judged(p: Column) -> Column:
        t = p["template"]
        same = F.zip_with(F.slice("words", p["start"] + 1, F.get(sizes, t)), F.get(wanted, t), lambda a, b: a == b)
        agreed = F.aggregate(F.zip_with(same, F.get(weight, t), lambda s, w: F.when(s, w).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
        return F.struct(
            p["start"].alias("start"), t.alias("template"), F.get(F.array(*(F.lit(x.label) for x in templates)), t).alias("label"), F.get(F.array(*(F.lit(x.base) for x in templates)), t).alias("base"),
            F.least(agreed / F.get(whole, t), F.lit(1.0)).alias("score"), F.forall(F.slice(same, F.get(key_from, t) + 1, F.get(key_size, t)), lambda s: s).alias("keyed"), F.forall(same, lambda s: s).alias("exact"),
        )

    places = F.filter(F.transform(inside, judged), lambda p: F.when(p["base"], p["exact"]).otherwise(p["keyed"] & (p["score"] >= ENOUGH)))
    places = F.when(F.size("at") > 0, F.array_sort(places)).otherwise(F.array().cast("array<struct<start:int,template:int,label:string,base:boolean,score:double,keyed:boolean,exact:boolean>>"))
    return hits.select(F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"), places.alias("places"))


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, first and last base place, and labels of every row of ``scan``."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return scanned.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )
