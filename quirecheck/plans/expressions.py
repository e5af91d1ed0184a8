"""Queries for expressions, quantifiers, list and region operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirecheck.functions import geometry as G, text as T, values as X
from quirecheck.plans import oracle_tables as O
from quirecheck.plans.registry import query
from quirecheck.sources import standins as S

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_SQL_KEY = ", ".join(KEY)
SEP = " ¦ "


def _lines(spark, d):
    return S.table(spark, d, "lineitem")


@query(
    "arith",
    f"""select {_SQL_KEY}, l_partkey + l_linenumber as total, l_partkey - l_suppkey as difference, -l_linenumber as negated,
        l_quantity * l_linenumber as product,
        case when l_suppkey <> 0 and l_partkey % l_suppkey = 0 then (l_partkey // l_suppkey)::bigint end as exact_quotient,
        case when l_suppkey <> 0 then round(l_partkey::double / l_suppkey, 9) end as quotient,
        case when l_suppkey = 0 then 'division by zero' end as error,
        'line ' || l_linenumber::varchar as label from lineitem""",
)
def arith(spark, d):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return _lines(spark, d).select(
        *KEY,
        (a + F.col("l_linenumber")).alias("total"),
        (a - b).alias("difference"),
        (-F.col("l_linenumber")).alias("negated"),
        (F.col("l_quantity") * F.col("l_linenumber")).alias("product"),
        X.divide_exact(a, b).alias("exact_quotient"),
        F.round(X.divide(a, b), 9).alias("quotient"),
        X.divide_error(b).alias("error"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("label"),
    )


@query(
    "compare_ops",
    f"""select {_SQL_KEY}, l_quantity = l_linenumber as eq, l_quantity <> l_linenumber as ne, l_quantity < l_linenumber as lt,
        l_quantity <= l_linenumber as le, l_quantity > l_linenumber as gt, l_quantity >= l_linenumber as ge,
        nullif(l_tax, 0) is not distinct from nullif(l_discount, 0) as same from lineitem""",
)
def compare_ops(spark, d):
    a, b = F.col("l_quantity"), F.col("l_linenumber")
    return _lines(spark, d).select(
        *KEY,
        a.eqNullSafe(b).alias("eq"),
        (~a.eqNullSafe(b)).alias("ne"),
        (a < b).alias("lt"),
        (a <= b).alias("le"),
        (a > b).alias("gt"),
        (a >= b).alias("ge"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).eqNullSafe(F.nullif(F.col("l_discount"), F.lit(0.0))).alias("same"),
    )


@query(
    "logic_ops",
    f"""with t as (select {_SQL_KEY}, case when l_linenumber <> 2 then l_quantity > 25 end as p, l_tax > 0.04 as q,
        nullif(l_tax, 0.01) as m, l_discount as n from lineitem)
        select {_SQL_KEY}, case when coalesce(p, false) then q else p end as both_of,
        case when coalesce(p, false) then p else q end as either_of, not coalesce(p, false) as negated,
        case when m is not null then n else m end as value_and, case when m is not null then m else n end as value_or from t""",
)
def logic_ops(spark, d):
    """``p`` may be null; ``m`` is a number, so zero counts as true and only null does not."""
    p = F.when(F.col("l_linenumber") != 2, F.col("l_quantity") > 25)
    q = F.col("l_tax") > 0.04
    m, n = F.nullif(F.col("l_tax"), F.lit(0.01)), F.col("l_discount")
    return _lines(spark, d).select(
        *KEY,
        X.logical_and(p, q).alias("both_of"),
        X.logical_or(p, q).alias("either_of"),
        (~X.truthy(p)).alias("negated"),
        X.logical_and(m, n, boolean=False).alias("value_and"),
        X.logical_or(m, n, boolean=False).alias("value_or"),
    )


def _quantified(name, aggregate, empty):
    sql = f"""select l_orderkey, coalesce({name}(l_quantity >= 10) filter (where l_discount > 0.05), {empty}) as verdict
              from lineitem group by l_orderkey"""

    def build(spark, d):
        wanted = F.when(F.col("l_discount") > 0.05, F.col("l_quantity") >= 10)
        return _lines(spark, d).groupBy("l_orderkey").agg(F.coalesce(aggregate(wanted), F.lit(empty)).alias("verdict"))

    return sql, build


for _key, _args in {"list_all": ("bool_and", F.bool_and, True), "list_any": ("bool_or", F.bool_or, False)}.items():
    _sql, _build = _quantified(*_args)
    query(_key, _sql)(_build)


def _page_list(spark, d):
    return S.documents(spark, d).select("doc_id", F.split("text", "\n").alias("l"))


_SQL_PAGES = "(select doc_id, string_split(text, chr(10)) as l from documents)"


@query(
    "list_filter",
    f"""select doc_id, len(k)::bigint as kept, array_to_string(k, '{SEP}') as items
        from (select doc_id, list_filter(l, lambda x: length(x) > 200) as k from {_SQL_PAGES})""",
)
def list_filter(spark, d):
    kept = _page_list(spark, d).select("doc_id", F.filter("l", lambda x: F.char_length(x) > 200).alias("k"))
    return kept.select("doc_id", F.size("k").cast("bigint").alias("kept"), F.array_join("k", SEP).alias("items"))


@query(
    "list_map",
    f"select doc_id, array_to_string(list_transform(l, lambda x: length(x)::varchar), ',') as lengths from {_SQL_PAGES}",
)
def list_map(spark, d):
    return _page_list(spark, d).select(
        "doc_id", F.array_join(F.transform("l", lambda x: F.char_length(x).cast("string")), ",").alias("lengths")
    )


@query("list_each", f"select doc_id, unnest(l) as item from {_SQL_PAGES}")
def list_each(spark, d):
    return _page_list(spark, d).select("doc_id", F.explode("l").alias("item"))


@query("list_each_indexed", O.sql("page", "select doc_id, page_no - 1 as index, text as item from page"))
def list_each_indexed(spark, d):
    return _page_list(spark, d).select("doc_id", F.posexplode("l").alias("index", "item")).select(
        "doc_id", F.col("index").cast("bigint").alias("index"), "item"
    )


@query(
    "list_get",
    f"""select doc_id, len(l)::bigint as length, l[3] as third, l[1] as first_item, l[len(l)] as last_item,
        case when len(l) < 3 then 'item 3 does not exist (the list has ' || len(l) || ')' end as error from {_SQL_PAGES}""",
)
def list_get(spark, d):
    items = F.col("l")
    return _page_list(spark, d).select(
        "doc_id",
        F.size(items).cast("bigint").alias("length"),
        X.list_get(items, 3).alias("third"),
        X.list_get(items, 1).alias("first_item"),
        F.try_element_at(items, F.lit(-1)).alias("last_item"),
        X.list_get_error(items, 3).alias("error"),
    )


@query("list_contains", """select doc_id, list_contains(string_split(text, ' '), 'the') as found from documents""")
def list_contains(spark, d):
    return S.documents(spark, d).select("doc_id", F.array_contains(F.split("text", " "), "the").alias("found"))


@query(
    "list_join",
    f"""select doc_id, array_to_string(list_transform(l, lambda x: case when length(x) > 60 then x else 'null' end), ', ') as joined
        from {_SQL_PAGES}""",
)
def list_join(spark, d):
    """Short items become null, and nulls print as ``null``."""
    items = F.transform("l", lambda x: F.when(F.char_length(x) > 60, x))
    return _page_list(spark, d).select("doc_id", X.list_join(items).alias("joined"))


@query(
    "str_predicates",
    """select doc_id, contains(text, 'tion') as has, starts_with(text, 'D') as starts, ends_with(text, '.') as ends from documents""",
)
def str_predicates(spark, d):
    return S.documents(spark, d).select(
        "doc_id",
        F.contains("text", F.lit("tion")).alias("has"),
        F.startswith("text", F.lit("D")).alias("starts"),
        F.endswith("text", F.lit(".")).alias("ends"),
    )


@query(
    "str_transforms",
    f"""select page_id, {O.strip_ws("chr(9) || url || ' '")} as trimmed, upper(url) as upper_url, lower(url) as lower_url,
        length(html)::bigint as length from pages""",
)
def str_transforms(spark, d):
    padded = F.concat(F.lit("\t"), F.col("url"), F.lit(" "))
    return S.table(spark, d, "pages").select(
        "page_id", T.strip(padded).alias("trimmed"), F.upper("url").alias("upper_url"), F.lower("url").alias("lower_url"),
        F.char_length("html").cast("bigint").alias("length"),
    )


@query(
    "math_fns",
    f"""select {_SQL_KEY}, least(l_quantity, l_linenumber * 7.0) as low, greatest(l_quantity, l_linenumber * 7.0) as high,
        abs(l_linenumber - 4)::bigint as distance, round((l_quantity - 25) / 2)::bigint as rounded from lineitem""",
)
def math_fns(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber") * 7.0
    return _lines(spark, d).select(
        *KEY,
        F.least(q, n).alias("low"),
        F.greatest(q, n).alias("high"),
        F.abs(F.col("l_linenumber") - 4).cast("bigint").alias("distance"),
        X.half_away((q - 25) / 2).alias("rounded"),
    )


@query(
    "units",
    f"""select {_SQL_KEY}, literal, round(case u when 'mm' then n * 72 / 25.4 when 'cm' then n * 720 / 25.4 when 'in' then n * 72.0
        when 'pt' then n when '%' then n end, 6)::double as points,
        case when u = 'ell' then 'unknown unit: ''ell'' (use pt, mm, cm, in or %)' end as error
        from (select {_SQL_KEY}, l_quantity::bigint::double as n, l_quantity::bigint::varchar || u as literal, u from
          (select *, ['mm', 'cm', 'in', 'pt', '%', 'ell'][l_linenumber % 6 + 1] as u from lineitem))""",
)
def units(spark, d):
    names = F.array(*[F.lit(u) for u in ("mm", "cm", "in", "pt", "%", "ell")])
    literal = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.element_at(names, F.col("l_linenumber") % 6 + 1))
    return _lines(spark, d).select(*KEY, literal.alias("literal")).select(
        *KEY, "literal", F.round(X.to_points(F.col("literal")), 6).alias("points"), X.unit_error(F.col("literal")).alias("error")
    )


@query(
    "region_ops",
    f"""with t as (select {_SQL_KEY}, l_linenumber * 10.0::double as x, 20.0::double as y, l_quantity as w, l_quantity * 2 as h from lineitem)
        select {_SQL_KEY}, round(w * h, 4) as area, 60.0 between x and x + w and 40.0 between y and y + h as has_point,
        x < 90 and 40 < x + w and y < 80 and 30 < y + h as overlaps,
        (x - 5) || ',' || (y - 5) || ',' || (x + w + 5) || ',' || (y + h + 5) as grown,
        case when w - 12 > 0 and h - 12 > 0 then (x + 6) || ',' || (y + 6) || ',' || (x + w - 6) || ',' || (y + h - 6) end as shrunk,
        case when w - 12 <= 0 or h - 12 <= 0 then 'an inset of 6.0pt would leave the region with no area' end as error from t""",
)
def region_ops(spark, d):
    q = F.col("l_quantity")
    r = G.region(F.col("l_linenumber") * 10.0, F.lit(20.0), q, q * 2, "zone")
    fixed = G.region(F.lit(40.0), F.lit(30.0), F.lit(50.0), F.lit(50.0), "fixed")

    def printed(region):
        return F.array_join(F.transform(G.coordinates(region), lambda v: v.cast("string")), ",")

    zone = F.col("zone")
    return _lines(spark, d).select(*KEY, r.alias("zone")).select(
        *KEY,
        F.round(G.area(zone), 4).alias("area"),
        G.contains_point(zone, F.lit(60.0), F.lit(40.0)).alias("has_point"),
        G.intersects(zone, fixed).alias("overlaps"),
        printed(G.expand(zone, F.lit(5.0))).alias("grown"),
        F.when(G.inset(zone, F.lit(6.0)).isNotNull(), printed(G.inset(zone, F.lit(6.0)))).alias("shrunk"),
        G.inset_error(zone, F.lit(6.0)).alias("error"),
    )


@query(
    "doc_props",
    """select o_orderkey as doc_id, 'order-' || o_orderkey || '.pdf' as filename, coalesce(c_name, '') as author,
       coalesce(n, 0) as page_count, coalesce(f, 0) as font_count from orders left join customer on o_custkey = c_custkey
       left join (select l_orderkey, count(*) as n, count(distinct p_brand) as f from lineitem join part on l_partkey = p_partkey
       group by l_orderkey) on l_orderkey = o_orderkey""",
)
def doc_props(spark, d):
    """Orders as documents: line items are pages, brands are fonts, the customer is the author."""
    elements = S.fonts(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.count_distinct("name").alias("font_count")
    )
    author = S.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author"))
    docs = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    return docs.join(elements, "doc_id", "left").join(author, "o_custkey", "left").select(
        "doc_id",
        F.concat(F.lit("order-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.coalesce("font_count", F.lit(0)).alias("font_count"),
    )


@query(
    "elem_props",
    O.sql(
        "img box",
        """select i.doc_id, i.page_no as number, i.page_no - 1 as index, least(dpi_x, dpi_y) as dpi, color_space,
           round(tac_max, 4) as tac, round(ink_avg, 4) as ink_coverage, trim_box is not null as has_trim_box,
           bleed is not null as has_bleed_box, b.width, b.height
           from img i join box b on i.doc_id = b.doc_id and i.page_no = b.page_no""",
    ),
)
def elem_props(spark, d):
    images = S.images(spark, d, numbered=True).select(
        "doc_id", "page_no", F.least("dpi_x", "dpi_y").alias("dpi"), "color_space",
        F.round("tac_max", 4).alias("tac"), F.round("ink_avg", 4).alias("ink_coverage"),
    )
    boxes = S.boxes(spark, d, numbered=True).select(
        "doc_id", "page_no", F.col("trim").isNotNull().alias("has_trim_box"),
        F.col("bleed").isNotNull().alias("has_bleed_box"), "width", "height",
    )
    return images.join(boxes, ["doc_id", "page_no"]).select(
        "doc_id", F.col("page_no").alias("number"), (F.col("page_no") - 1).alias("index"), "dpi", "color_space", "tac",
        "ink_coverage", "has_trim_box", "has_bleed_box", "width", "height",
    )
