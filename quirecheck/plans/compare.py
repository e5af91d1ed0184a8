"""Queries that compare two versions of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirecheck.functions import text as T
from quirecheck.operators import compare as C
from quirecheck.plans import oracle_tables as O
from quirecheck.plans.registry import query
from quirecheck.sources import standins as S

# ---- SQL twins: the same semantics by comparing all pages of a pair, row by row ----

_MATCH = {
    "cnt": """select d.doc_id, d.n, coalesce(v.m, 0) as m from (select doc_id, count(*) as n from page group by doc_id) d
        left join (select doc_id, count(*) as m from ver group by doc_id) v on v.doc_id = d.doc_id""",
    "wa": f"select doc_id, page_no as i, text, list_distinct({O.tokens('text')}) as w from page",
    "wb": f"select doc_id, page_no as j, text, list_distinct({O.tokens('text')}) as w from ver",
    "mat": """select a.doc_id, a.i, b.j, a.text as text_a, b.text as text_b from wa a join wb b on a.doc_id = b.doc_id
        join cnt c on c.doc_id = a.doc_id where abs(a.i - b.j) <= abs(c.n - c.m) + 25 and (a.text = b.text
        or (len(a.w) = 0 and len(b.w) = 0) or (len(list_intersect(a.w, b.w))::double /
          nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0) >= 0.6))""",
}
# dp(doc, i) holds the row of best alignments below page i; the walk then follows it from the top.
_ALIGN = {
    **_MATCH,
    "js": "select a.doc_id, a.i, coalesce(list(m.j) filter (where m.j is not null), []) as js from wa a left join mat m on m.doc_id = a.doc_id and m.i = a.i group by a.doc_id, a.i",
    "dp": """select doc_id, n + 1 as i, list_transform(range(m + 1), lambda x: 0) as d, m from cnt
        union all select doc_id, i, list_append(list_transform(range(1, m + 1), lambda x: list_max(c[x:])), 0) as d, m from (
          select dp.doc_id, js.i, dp.m, list_transform(range(1, dp.m + 1),
            lambda x: case when list_contains(js.js, x) then dp.d[x + 1] + 1 else dp.d[x] end) as c
          from dp join js on js.doc_id = dp.doc_id and js.i = dp.i - 1)""",
    "walk": """select doc_id, 1::bigint as i, 1::bigint as j, null::bigint as pi, null::bigint as pj from cnt
        union all select w.doc_id, case when hit or d1.d[w.j] >= d0.d[w.j + 1] then w.i + 1 else w.i end,
          case when hit or not d1.d[w.j] >= d0.d[w.j + 1] then w.j + 1 else w.j end,
          case when hit then w.i end, case when hit then w.j end
        from (select walk.*, list_contains(js.js, walk.j) as hit from walk join js on js.doc_id = walk.doc_id and js.i = walk.i) w
        join dp d0 on d0.doc_id = w.doc_id and d0.i = w.i join dp d1 on d1.doc_id = w.doc_id and d1.i = w.i + 1
        where w.j <= d0.m""",
    "ali": "select doc_id, pi as i, pj as j from walk where pi is not null",
}
# Word edit distance with the built-in distance of bytes: words common to both ends are cut off, and
# the distinct words that remain become single ASCII characters.
_SIM = {
    **_ALIGN,
    "tok": f"""select a.doc_id, a.i, a.j, p.text as text_a, v.text as text_b, {O.tokens('p.text')} as ta, {O.tokens('v.text')} as tb
        from ali a join page p on p.doc_id = a.doc_id and p.page_no = a.i join ver v on v.doc_id = a.doc_id and v.page_no = a.j""",
    "cut1": """select *, coalesce(list_position(list_transform(range(1, least(len(ta), len(tb)) + 1), lambda x: ta[x] <> tb[x]), true) - 1,
        least(len(ta), len(tb))) as h from tok""",
    "cut2": "select * exclude (ta, tb), len(ta) as na, len(tb) as nb, list_reverse(ta[h + 1:]) as ra, list_reverse(tb[h + 1:]) as rb from cut1",
    "cut3": """select * exclude (ra, rb), ra[t + 1:] as qa, rb[t + 1:] as qb from (select *, coalesce(list_position(list_transform(
        range(1, least(len(ra), len(rb)) + 1), lambda x: ra[x] <> rb[x]), true) - 1, least(len(ra), len(rb))) as t from cut2)""",
    "sim": """select doc_id, i, j, text_a, text_b, case when greatest(na, nb) = 0 then 1.0::double else 1 - levenshtein(
        array_to_string(list_transform(qa, lambda x: chr(list_position(v, x)::int)), ''),
        array_to_string(list_transform(qb, lambda x: chr(list_position(v, x)::int)), ''))::double / greatest(na, nb) end as similarity
        from (select *, list_distinct(list_concat(qa, qb)) as v from cut3)""",
    "overall": """select c.doc_id, case when n + m - p = 0 then 100.0 else round(t / (n + m - p) * 100 * 10) / 10 end::double as similarity
        from (select cnt.doc_id, n, m, coalesce(p, 0) as p, coalesce(t, 0) as t from cnt left join
          (select doc_id, round(sum(similarity), 9) as t, count(*) as p from sim group by doc_id) s on s.doc_id = cnt.doc_id) c""",
}


def _sql_diff_sample() -> str:
    def side(mine: str, other: str, sign: str) -> str:
        return (
            f"array_to_string(list_transform(list_filter({mine}, lambda x: not list_contains({other}, x))[1:3], "
            f"lambda x: ' | {sign}' || x), '')"
        )

    return side(O.lines("text_a"), O.lines("text_b"), "-") + " || " + side(O.lines("text_b"), O.lines("text_a"), "+")


def _versions(spark, d):
    return S.text_pages(spark, d), S.version_two(spark, d)


def _aligned(spark, d):
    a, b = _versions(spark, d)
    return a, b, C.align(C.page_matches(a, b))


def _similar(spark, d):
    a, b, aligned = _aligned(spark, d)
    return a, b, C.with_word_similarity(C.aligned_texts(a, b, aligned))


@query(
    "cmp_metadata",
    O.sql(
        "meta",
        """select a.doc_id, 'warning' as severity, 'metadata' as check_name,
           a.key || ': "' || a.value || '" → "' || coalesce(b.value, '') || '"' as message from meta a left join
           (select doc_id, key, case when key = 'Title' and doc_id % 4 = 0 then value || ' v2' else value end as value
            from meta where not (key = 'Lang' and doc_id % 5 = 0)) b on a.doc_id = b.doc_id and a.key = b.key
           where a.value <> coalesce(b.value, '')""",
    ),
)
def cmp_metadata(spark, d):
    """The second version has some titles changed and some languages gone."""
    a = S.web_meta(spark, d)
    title = F.when((F.col("key") == "Title") & (F.col("doc_id") % 4 == 0), F.concat("value", F.lit(" v2")))
    b = a.filter(~((F.col("key") == "Lang") & (F.col("doc_id") % 5 == 0))).withColumn("value", F.coalesce(title, "value"))
    return C.changed_metadata(a, b)


@query(
    "cmp_prepare",
    O.sql(
        "page",
        rf"""select doc_id, page_no, lower(trim(regexp_replace(t, '{O.WS}+', ' ', 'g'))) as text from (select doc_id, page_no,
            case doc_id % 4 when 0 then replace(text, ' ', ' <data> ') when 1 then text || ' on <data>'
            when 2 then text || ' <data>00''' else text || ', <data>' end as t from page)""",
    ),
)
def cmp_prepare(spark, d):
    """Every page gets dates in one of the four shapes, which are masked again."""
    key, page = F.col("doc_id") % 4, F.col("text")
    dated = (
        F.when(key == 0, F.replace(page, F.lit(" "), F.lit(" 2026-08-02 ")))
        .when(key == 1, F.concat(page, F.lit(" on 2/8/26")))
        .when(key == 2, F.concat(page, F.lit(" D:2026080217362200'")))
        .otherwise(F.concat(page, F.lit(", 12 de março de 2026")))
    )
    return C.prepared(S.text_pages(spark, d).withColumn("text", dated), ignore_dates=True, normalized=True)


@query("cmp_page_match", O.sql("ver", "select doc_id, i, j from mat", **_MATCH))
def cmp_page_match(spark, d):
    return C.page_matches(*_versions(spark, d)).drop("band")


@query("cmp_align", O.sql("ver", "select doc_id, i, j from ali", recursive=True, **_ALIGN))
def cmp_align(spark, d):
    return _aligned(spark, d)[2]


@query(
    "cmp_structure",
    O.sql(
        "ver",
        """select doc_id, 'error' as severity, 'structure' as check_name, message from (
           select doc_id, 'page count changed: ' || n || ' → ' || m as message from cnt where n <> m
           union all select doc_id, 'page ' || page_no || ' removed' from page p where not exists
             (select 1 from ali where ali.doc_id = p.doc_id and ali.i = p.page_no)
           union all select doc_id, 'page ' || page_no || ' inserted' from ver v where not exists
             (select 1 from ali where ali.doc_id = v.doc_id and ali.j = v.page_no))""",
        recursive=True,
        **_ALIGN,
    ),
)
def cmp_structure(spark, d):
    a, b, aligned = _aligned(spark, d)
    return C.structure_findings(C.page_counts(a, b), a, b, aligned)


@query(
    "word_similarity",
    O.sql("ver", "select doc_id, i, j, round(similarity, 9) as similarity from sim", recursive=True, **_SIM),
)
def word_similarity(spark, d):
    return _similar(spark, d)[2].select("doc_id", "i", "j", F.round("similarity", 9).alias("similarity"))


@query(
    "cmp_text",
    O.sql(
        "ver",
        f"""select doc_id, case when similarity * 100 < 90 then 'error' else 'warning' end as severity, 'text' as check_name,
            'page ' || i || ' → ' || j || ': similarity ' || printf('%.1f', similarity * 100) || '%' || {_sql_diff_sample()} as message
            from sim where similarity < 1""",
        recursive=True,
        **_SIM,
    ),
)
def cmp_text(spark, d):
    return C.text_findings(_similar(spark, d)[2], threshold=90.0)


@query(
    "line_diff_sample",
    O.sql(
        "ver",
        f"""select doc_id, {_sql_diff_sample()} as sample from (select d.doc_id, d.text as text_a, coalesce(v.text, '') as text_b
            from documents d left join (select doc_id, string_agg(text, chr(10) order by page_no) as text from ver group by doc_id) v
            on v.doc_id = d.doc_id)""",
    ),
)
def line_diff_sample(spark, d):
    """Whole texts of both versions: the first three lines gone and the first three new."""
    from quirecheck.operators.pages import whole_text

    new = whole_text(S.version_two(spark, d)).select("doc_id", F.col("text").alias("text_b"))
    pairs = S.documents(spark, d).join(new, "doc_id", "left")
    return pairs.select("doc_id", T.diff_sample(F.col("text"), F.coalesce("text_b", F.lit(""))).alias("sample"))


@query("cmp_overall", O.sql("ver", "select * from overall", recursive=True, **_SIM))
def cmp_overall(spark, d):
    a, b, similar = _similar(spark, d)
    return C.overall_similarity(C.page_counts(a, b), similar)
