"""The operators over their whole tables, with their production parameters."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirecheck.llm import bpe, class_lm, collocations, licenses, mixing, neighbours, quality, runs, secrets, simhash, topk, url_filter, vector_dedup
from quirecheck.llm.shared import WORD, whole_text

#: Fixed rules: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), words, public_tokenizers.PATTERN, decoded_col="decoded"))


def token_digests(decoded: DataFrame, *more: str) -> DataFrame:
    """What stands for ids and decoded bytes in a result: their number and hashes."""
    return decoded.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.RULES if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base_spans = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *map(count, base), F.sha2(secrets.listed(base_spans), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_by_source(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    return topk.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = runs.longest_run(F.col("runs"))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(runs.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text); each tenth text, by h = crc32(doc_id), repeats itself from word a on, with a period that h gives."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("long")
    words = F.when(h % 10 == 0, F.regexp_extract_all(whole_text(), F.lit(WORD), 0))
    cut = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words").cast("long"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    planted = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_vector_dedup, op3_bpe, op4_quality, op5_secrets, op6_simhash, op7_mixing, op8_licenses, op9_class_lm, op10_top_k, op11_collocations, op12_neighbours, op13_runs)}

ORACLES = {
    "op1_url_filter": r"""
        with u as (
            select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
        ), h as (
            select page_id,
                translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
            from u
        ), r(rule_host, rule_path, rule_verdict) as (
            values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), fits as (
            select page_id, host, path, rule_host || rule_path as rule, rule_verdict,
                row_number() over (partition by page_id order by length(rule_host || rule_path) desc nulls last) as place
            from h left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
        )
        select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from fits where place = 1
    """,
    "op2_vector_dedup": """
        with recursive u as (
            select vec_id, label, embedding::double[] as v from embeddings
        ), ok as (
            select vec_id, label, v, sqrt(list_dot_product(v, v)) as size from u
            where label is not null and len(v) > 0 and list_bool_and(list_transform(v, lambda x: x is not null and isfinite(x))) and list_dot_product(v, v) > 0
        ), links as (
            select a.vec_id as a, b.vec_id as b from ok a join ok b
                on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98
        ), reach(id, seen) as (
            select vec_id, vec_id from embeddings
            union
            select id, b from reach join links on seen = a
        ), parts as (
            select id, min(seen) as component_id from reach group by id
        )
        select id as vec_id, (select count(*) from links where a = id) as n_links, component_id, id = component_id as kept from parts
    """,
    "op11_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
            from documents where text is not null
        ), w as materialized (
            select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
        ), f as materialized (
            select lang, p, m, count(*) as f from (
                select lang, 1 as m, unnest(w) as p from w
                union all select lang, 2, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) from w where len(w) > 1
                union all select lang, 3, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])) from w where len(w) > 2
            ) group by lang, p, m
        ), n as (
            select lang, sum(f) as n from f where m = 1 group by lang
        ), often as materialized (
            select * from f where f >= 10
        ), parts as (
            select lang, p, m, f as a, k, array_to_string(string_split(p, ' ')[1:k], ' ') as p_l, array_to_string(string_split(p, ' ')[k+1:], ' ') as p_r from often, range(1, 3) as t(k) where k < m
        ), cuts as (
            select c.lang, c.p, c.m, c.a, k, l.f as l, r.f as r, c.a::hugeint * c.a * 1000000 // (l.f::hugeint * r.f) as score
            from parts c join often l on l.lang = c.lang and l.p = p_l join often r on r.lang = c.lang and r.p = p_r
        ), best as (
            select lang, p, m, a, l, r, score from cuts qualify row_number() over (partition by lang, p order by score, k) = 1
        ), around as (
            select lang, p, max(a) as f from (select lang, unnest([p_l, p_r]) as p, a from parts where m = 3) group by lang, p
        ), kept as (
            select b.*, b.p as phrase from best b left join around on b.m = 2 and around.lang = b.lang and around.p = b.p where around.f is null or 100 * around.f < 50 * b.a
        ), ranked as (
            select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
        )
        select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked join n using (lang) where rank <= 2000
    """,
    "op10_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
            where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
        ), s as (
            select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
        ), r as (
            select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s
        )
        select query_id, rank::int as rank, vec_id, score from r where rank <= 5
    """,
}


def _secrets_sql() -> str:
    """Every rule cut out of every text; the places follow from the lengths of pieces and matches."""
    cuts = []
    for number, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("(?<![0-9a-f])", "").replace("'", "''")  # runs are maximal from the left anyway
        pattern = re.sub(r"(?<=[*+}?])\+(?=[^+]|$)", "", pattern) if rule.kind == "private_key" else pattern  # nothing is ever given back
        cuts.append(
            f"select doc_id, {number} as number, '{rule.kind}' as kind, {rule.base} as base, {rule.least} as least, string_split_regex(text, '{pattern}') as pieces, "
            f"regexp_extract_all(text, '{pattern}', 0) as matches, regexp_extract_all(text, '{pattern}', {rule.group}) as checked from t"
        )
    counted = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in secrets.RULES if r.base)
    sizes = lambda of: f"coalesce(list_sum(list_transform({of}, lambda x: length(x))), 0)"
    return f"""
        with t as (select doc_id, coalesce(text, '') as text from documents),
        cuts as ({" union all ".join(cuts)}),
        matched as (select *, unnest(range(1, len(matches) + 1)) as i from cuts),
        spans as (
            select doc_id, number, kind, base, ({sizes("pieces[1:i]")} + {sizes("matches[1:i-1]")})::bigint as start,
                length(matches[i]) as size from matched where length(checked[i]) >= least
        ),
        listed as (select *, kind || ':' || start || ':' || (start + size) as span from spans)
        select t.doc_id, {counted},
            sha256(coalesce(string_agg(span, ',' order by start, number) filter (where base), '')) as base_sha256,
            coalesce(string_agg(span, ',' order by start, number), '') as spans
        from t left join listed on listed.doc_id = t.doc_id group by t.doc_id
    """


ORACLES["op5_secrets"] = _secrets_sql()
