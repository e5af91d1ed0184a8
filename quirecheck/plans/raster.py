"""Queries over images and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirecheck.functions import raster as X
from quirecheck.functions.values import let, rounded
from quirecheck.operators import layout as L, raster as R
from quirecheck.operators.ordinals import nth_element
from quirecheck.plans import oracle_tables as O
from quirecheck.plans.registry import query
from quirecheck.sources import standins as S

SEP = " ¦ "


def _orders(spark, d):
    return S.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))


# ---- images ----


@query(
    "image_counts",
    """select o_orderkey as doc_id, count(l_orderkey) > 0 as has_images, count(l_orderkey) as images from orders
       left join lineitem on l_orderkey = o_orderkey group by o_orderkey""",
)
def image_counts(spark, d):
    return L.verdicts(_orders(spark, d), S.images(spark, d), has_images=(F.lit(True), False), images=(F.count("*"), 0))


@query(
    "image_nth",
    O.sql(
        "img",
        """select d.doc_id, least(dpi_x, dpi_y) as resolution, width || 'x' || height as size, color_space,
           case when i.doc_id is null then 'image 3 does not exist (found: ' || n || ')' end as error
           from (select doc_id, count(*) as n from img group by doc_id) d left join img i on i.doc_id = d.doc_id and i.page_no = 3""",
    ),
)
def image_nth(spark, d):
    third = nth_element(S.images(spark, d, numbered=True), ["page_no"], 3, "image")
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    return third.select(
        "doc_id",
        F.least("dpi_x", "dpi_y").alias("resolution"),
        F.when(F.col("error").isNull(), size).alias("size"),
        "color_space",
        "error",
    )


@query(
    "low_resolution",
    """select o_orderkey as doc_id, coalesce(bool_or(least(50 + l_quantity*10, 60 + l_quantity*9) < 300), false) as low
       from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey""",
)
def low_resolution(spark, d):
    return L.verdicts(_orders(spark, d), S.images(spark, d), low=(L.low_resolution(), False))


@query(
    "image_colorspaces",
    O.sql(
        "img",
        f"""select doc_id, string_agg(color_space, '{SEP}' order by seen_at) as spaces from
            (select doc_id, color_space, min(page_no) as seen_at from img group by doc_id, color_space) group by doc_id""",
    ),
)
def image_colorspaces(spark, d):
    listed = L.first_seen(S.images(spark, d, numbered=True), "color_space", "page_no", "spaces")
    return listed.withColumn("spaces", F.array_join("spaces", SEP))


@query(
    "effective_dpi",
    O.sql(
        "img",
        """select doc_id, page_no, round(case when l_linenumber % 3 > 0 then width / (l_linenumber * 36.0 / 72) else dpi_x end, 6) as eff_x,
           round(case when l_linenumber % 3 > 0 then height / (l_linenumber * 48.0 / 72) else dpi_y end, 6) as eff_y from img""",
    ),
)
def effective_dpi(spark, d):
    """Printed sizes depend on the line number; every third image has none and keeps its metadata."""
    n = F.col("l_linenumber")
    printed = n % 3 > 0
    lines = S.numbered_lines(spark, d).select(
        F.col("l_orderkey").alias("doc_id"), F.col("pos").alias("page_no"),
        F.when(printed, n * 36.0).otherwise(0.0).alias("width_pt"), F.when(printed, n * 48.0).otherwise(0.0).alias("height_pt"),
        (F.col("l_quantity") * 24).cast("bigint").alias("width"), (F.col("l_quantity") * 32).cast("bigint").alias("height"),
        (F.lit(50) + F.col("l_quantity") * 10).alias("dpi_x"), (F.lit(60) + F.col("l_quantity") * 9).alias("dpi_y"),
    )
    sized = (F.col("width_pt") > 0) & (F.col("height_pt") > 0)
    return lines.select(
        "doc_id", "page_no",
        F.round(F.when(sized, F.col("width") / (F.col("width_pt") / 72)).otherwise(F.col("dpi_x")), 6).alias("eff_x"),
        F.round(F.when(sized, F.col("height") / (F.col("height_pt") / 72)).otherwise(F.col("dpi_y")), 6).alias("eff_y"),
    )


# ---- grey rasters: every raster against the next one ----


def _next_pairs(spark, d, source=S.rasters):
    pages = source(spark, d)
    after = pages.withColumn("page_id", F.col("page_id") - 1)
    return R.pair_up(pages, after, ["page_id"])


_SQL_PAIRS = "select a.page_id, a.x, a.y, a.v as va, b.v as vb from pix a join pix b on b.page_id = a.page_id + 1 and b.x = a.x and b.y = a.y"


def _sql_pairs(body: str) -> str:
    return O.sql("pix", body, pairs=_SQL_PAIRS)


@query(
    "raster_resize",
    O.sql(
        "pix",
        """select g.page_id, string_agg(g.va::varchar, ',' order by g.y * 6 + g.x) as small_a,
           string_agg(b.v::varchar, ',' order by g.y * 6 + g.x) as small_b from
           (select a.page_id, t.i % 6 as x, t.i // 6 as y, a.v as va from (select unnest(range(24)) as i) t
            join pix a on a.x = (t.i % 6) * 8 // 6 and a.y = (t.i // 6) * 8 // 4) g
           join pix b on b.page_id = g.page_id + 1 and b.y * 8 + b.x = g.y * 6 + g.x group by g.page_id""",
    ),
)
def raster_resize(spark, d):
    """8 x 8 against a 6 x 4 cut: both end up 6 x 4."""
    pages = S.rasters(spark, d)
    small = pages.select(
        (F.col("page_id") - 1).alias("page_id"), F.lit(6).alias("w"), F.lit(4).alias("h"), F.slice("px", 1, 24).alias("px")
    )
    sized = R.to_common_size(R.pair_up(pages, small, ["page_id"]))

    def shown(c):
        return F.array_join(F.col(c).cast("array<string>"), ",")

    return sized.select("page_id", shown("px_a").alias("small_a"), shown("px_b").alias("small_b"))


_SQL_SSIM = """((2 * avg(va) * avg(vb) + 6.5025) * (2 * covar_pop(va, vb) + 58.5225)) /
    ((avg(va) * avg(va) + avg(vb) * avg(vb) + 6.5025) * (var_pop(va) + var_pop(vb) + 58.5225))"""


@query("ssim", _sql_pairs(f"select page_id, round({_SQL_SSIM} * 1000) / 1000 as ssim from pairs group by page_id"))
def ssim(spark, d):
    return _next_pairs(spark, d).select("page_id", R.similarity().alias("ssim"))


@query(
    "compare_images",
    _sql_pairs(f"select page_id, round({_SQL_SSIM} * 100 * 1000) / 1000 as similarity from pairs group by page_id"),
)
def compare_images(spark, d):
    score = rounded(X.ssim(F.col("px_a"), F.col("px_b")) * 100, 3)
    return _next_pairs(spark, d).select("page_id", score.alias("similarity"))


@query(
    "pixel_diff",
    _sql_pairs(
        """select page_id, round(avg(case when abs(va - vb) > 10 then 1.0::double else 0 end) * 100 * 1000) / 1000 as diff_percent
           from pairs group by page_id"""
    ),
)
def pixel_diff(spark, d):
    share = rounded(X.pixel_diff(F.col("px_a"), F.col("px_b")) * 100, 3)
    return _next_pairs(spark, d).select("page_id", share.alias("diff_percent"))


_HASH = {
    "cosine": "select u, x, cos((2 * x + 1) * u * pi() / 64) as c from (select unnest(range(8)) as u), (select unnest(range(32)) as x)",
    "horizontal": "select page_id, yy as y, u, sum(v * c) as s from (select page_id, v, x * 4 + dx as xx, y * 4 + dy as yy from pix, "
    "(select unnest(range(4)) as dx), (select unnest(range(4)) as dy)) p join cosine on cosine.x = p.xx group by page_id, yy, u",
    "freq": "select page_id, u, cosine.u2 as v, round(sum(s * cosine.c), 6) as f from horizontal join (select u as u2, x, c from cosine) cosine "
    "on cosine.x = horizontal.y group by page_id, u, cosine.u2",
    "bits": """select page_id, sum(case when f > med then (1::hugeint << (v * 8 + u)) else 0 end)::uhugeint as bits from
        (select *, median(case when u + v > 0 then f end) over (partition by page_id) as med from freq) group by page_id""",
}


@query("phash", O.sql("pix", "select page_id, lpad(lower(printf('%x', bits::ubigint)), 16, '0') as phash from bits", **_HASH))
def phash(spark, d):
    return R.with_hash(S.rasters(spark, d)).select("page_id", X.hash_hex(F.col("bits")).alias("phash"))


@query(
    "image_replaced",
    O.sql(
        "pix",
        """select a.page_id, bit_count(xor(a.bits::ubigint, b.bits::ubigint)) > 10 as replaced from bits a join bits b on b.page_id = a.page_id + 1""",
        **_HASH,
    ),
)
def image_replaced(spark, d):
    hashed = R.with_hash(S.rasters(spark, d)).select("page_id", "bits")
    after = hashed.select((F.col("page_id") - 1).alias("page_id"), F.col("bits").alias("next_bits"))
    return hashed.join(after, "page_id").select("page_id", (X.hamming(F.col("bits"), F.col("next_bits")) > 10).alias("replaced"))


def _blockiness():
    return X.blockiness(F.col("px"), F.col("w"), F.col("h"), side=32)


def _sql_scaled(times: int) -> str:
    return f"select page_id, x * {times} + dx as x, y * {times} + dy as y, v from pix, (select unnest(range({times})) as dx), (select unnest(range({times})) as dy)"


_SQL_BLOCK = """select page_id, case when a < 0.01 then 1 else a / greatest(b, 0.05) end as block from
    (select page_id, avg(case when x % 8 = 0 then step end) as a, avg(case when x % 8 <> 0 then step end) as b from
     (select page_id, x, abs(v - lag(v) over (partition by page_id, y order by x)) as step from big) where step is not null group by page_id)"""


@query("artifacts", O.sql("pix", "select page_id, block > 1.6 as artifacts from blocks", big=_sql_scaled(4), blocks=_SQL_BLOCK))
def artifacts(spark, d):
    return S.rasters(spark, d).select("page_id", (_blockiness() > 1.6).alias("artifacts"))


@query(
    "image_quality",
    O.sql(
        "pix",
        "select page_id, round(least(greatest(100 - greatest(block - 1, 0) * 60, 0), 100) * 1000) / 1000 as quality from blocks",
        big=_sql_scaled(4),
        blocks=_SQL_BLOCK,
    ),
)
def image_quality(spark, d):
    return S.rasters(spark, d).select("page_id", X.quality(_blockiness()).alias("quality"))


@query(
    "posterization",
    O.sql(
        "pix",
        """select page_id, max(v) - min(v) > 60 and count(distinct v) < 24 as posterized from
           (select page_id, case when page_id % 2 = 0 then v // 16 * 16 else v end as v from pix) group by page_id""",
    ),
)
def posterization(spark, d):
    """Even rasters are quantised to sixteen levels."""
    coarse = F.transform("px", lambda v: F.floor(v / 16).cast("int") * 16)
    px = F.when(F.col("page_id") % 2 == 0, coarse).otherwise(F.col("px"))
    return S.rasters(spark, d).select("page_id", X.is_posterized(px).alias("posterized"))


@query(
    "banding",
    O.sql(
        "pix",
        """select page_id, count(*) filter (where banded) >= 3 as banding from
           (select page_id, axis, line, count(*) filter (where d <> 0) >= 4 and count(*) filter (where d <> 0) <= 8
              and count(*) filter (where abs(d) >= 4) >= 3
              and greatest(count(*) filter (where d >= 4), count(*) filter (where d <= -4)) * 5 >= count(*) filter (where abs(d) >= 4) * 4
              and (max(at_pos) filter (where abs(d) >= 4) - min(at_pos) filter (where abs(d) >= 4))::double /
                  nullif(count(*) filter (where abs(d) >= 4) - 1, 0) >= 4 as banded
            from (select page_id, axis, line, at_pos, v - lag(v) over (partition by page_id, axis, line order by at_pos) as d from
              (select page_id, 'x' as axis, x as line, y as at_pos, v from big where x >= 16 and x < 48 and (x - 16) % 4 = 0
               union all select page_id, 'y', y, x, v from big where y >= 16 and y < 48 and (y - 16) % 4 = 0))
            group by page_id, axis, line) group by page_id""",
        pixs="select page_id, x, y, case when page_id % 2 = 0 then x * 30 + v // 64 else v end as v from pix",
        big=_sql_scaled(8).replace("from pix", "from pixs"),
    ),
)
def banding(spark, d):
    """Even rasters become a stepped horizontal gradient with a little texture."""
    gradient = F.transform("px", lambda v, i: i % 8 * 30 + F.floor(v / 64).cast("int"))
    px = F.when(F.col("page_id") % 2 == 0, gradient).otherwise(F.col("px"))
    return S.rasters(spark, d).select("page_id", X.is_banded(px, F.col("w"), F.col("h"), side=64).alias("banding"))


# ---- colour rasters: a page is cut to 6 columns in the second version ----


def _color_pairs(spark, d):
    pages = S.color_rasters(spark, d)
    cut = pages.select(
        (F.col("page_id") - 1).alias("page_id"), F.lit(6).alias("w"), "h", F.filter("px", lambda p, i: i % 8 < 6).alias("px")
    )
    pairs = R.pair_up(pages, cut, ["page_id"])
    return pairs.withColumn("doc_id", F.floor(F.col("page_id") / 10)).withColumn("page_no", F.col("page_id") % 10 + 1)


_CHANGES = {
    "canvas": """select a.page_id, a.x, a.y, a.r as r1, a.g as g1, a.b as b1, coalesce(b.r, 255) as r2, coalesce(b.g, 255) as g2,
        coalesce(b.b, 255) as b2 from rgb a left join (select * from rgb where x < 6) b
        on b.page_id = a.page_id + 1 and b.x = a.x and b.y = a.y where a.page_id + 1 in (select page_id from rgb)""",
    "cls": """select page_id, page_id // 10 as doc_id, page_id % 10 + 1 as page_no, x, y,
        case when sqrt((r1-r2)^2 + (g1-g2)^2 + (b1-b2)^2) / 441.67 <= 0.05 then 'same'
        when abs(0.299*(r1-r2) + 0.587*(g1-g2) + 0.114*(b1-b2)) <= 8 then 'recoloured'
        when 0.299*r1 + 0.587*g1 + 0.114*b1 < 0.299*r2 + 0.587*g2 + 0.114*b2 then 'removed' else 'added' end as class from canvas""",
    "pd": """select doc_id, page_no, avg(case when class <> 'same' then 1.0::double else 0 end) * 100 as diff_percent,
        count(distinct case when class <> 'same' then (x // 2, y // 2) end) as areas from cls group by doc_id, page_no""",
}


def _sql_changes(body: str) -> str:
    return O.sql("rgb", body, **_CHANGES)


def _sql_blur(source: str, last_x: int) -> dict[str, str]:
    """Means of three along both axes, edges repeated; the second step is the blurred page."""

    def one(table, axis, other, last):
        means = ", ".join(f"sum(q.{c})::int // 3 as {c}" for c in "rgb")
        return f"""select p.page_id, p.x, p.y, {means} from {table} p cross join (select unnest([-1, 0, 1]) as k) join {table} q on q.page_id = p.page_id
            and q.{other} = p.{other} and q.{axis} = least(greatest(p.{axis} + k, 0), {last}) group by p.page_id, p.x, p.y"""

    cut = f"(select * from rgb where x <= {last_x})"
    return {f"{source}_mid": one(cut, "x", "y", last_x), source: one(f"{source}_mid", "y", "x", 7)}


_BLURRED = {
    **_sql_blur("soft_a", 7),
    **_sql_blur("soft_b", 5),
    "soft_canvas": """select a.page_id, a.x, a.y, a.r as r1, a.g as g1, a.b as b1, coalesce(b.r, 255) as r2, coalesce(b.g, 255) as g2,
        coalesce(b.b, 255) as b2 from soft_a a left join soft_b b on b.page_id = a.page_id + 1 and b.x = a.x and b.y = a.y
        where a.page_id + 1 in (select page_id from rgb)""",
}


@query(
    "pixel_compare",
    O.sql(
        "rgb",
        """select page_id // 10 as doc_id, page_id % 10 + 1 as page_no, 0 as dx, 0 as dy,
           round(count(*) filter (where differs) / count(*)::double * 100, 6) as diff_percent, count(distinct case when differs then (x // 2, y // 2) end) as areas
           from (select *, sqrt((r1-r2)^2 + (g1-g2)^2 + (b1-b2)^2) / 441.67 > 0.05 as differs from soft_canvas) group by page_id""",
        **_BLURRED,
    ),
)
def pixel_compare(spark, d):
    """Blurred pages compared in one pass; where they lie is fixed, as pages so small fit best at any place."""
    found = R.compare_rasters(_color_pairs(spark, d), blur=1, align=False, block=2)
    return found.select("doc_id", "page_no", "dx", "dy", F.round("diff_percent", 6).alias("diff_percent"), F.col("areas").cast("bigint").alias("areas"))


@query("pixel_classify", _sql_changes("select page_id, x, y, class from cls"))
def pixel_classify(spark, d):
    changed = R.with_changes(_color_pairs(spark, d)).select("page_id", "width", F.posexplode("classes").alias("i", "class"))
    return changed.select(
        "page_id", (F.col("i") % F.col("width")).cast("bigint").alias("x"), F.floor(F.col("i") / F.col("width")).alias("y"),
        X.class_name(F.col("class")).alias("class"),
    )


@query(
    "pixel_diff_percent",
    _sql_changes("select doc_id, page_no, round(diff_percent, 6) as diff_percent, areas from pd"),
)
def pixel_diff_percent(spark, d):
    differences = R.page_differences(R.with_changes(_color_pairs(spark, d)), block=2)
    return differences.select(
        "doc_id", "page_no", F.round("diff_percent", 6).alias("diff_percent"), F.col("areas").cast("bigint").alias("areas")
    )


@query(
    "pixel_findings",
    _sql_changes(
        """select doc_id, 'error' as severity, 'pixel difference' as check_name, 'page ' || page_no || ': ' || printf('%.2f', diff_percent)
           || '% of the pixels differ, in ' || areas || ' area(s)' as message from pd where diff_percent > 90"""
    ),
)
def pixel_findings(spark, d):
    return R.pixel_findings(R.page_differences(R.with_changes(_color_pairs(spark, d)), block=2), max_diff=90.0)


@query(
    "pixel_similarity",
    _sql_changes("select doc_id, round(100 - round(sum(diff_percent), 6) / count(*), 6) as similarity from pd group by doc_id"),
)
def pixel_similarity(spark, d):
    similar = R.pixel_similarity(R.page_differences(R.with_changes(_color_pairs(spark, d)), block=2))
    return similar.select("doc_id", F.round("similarity", 6).alias("similarity"))


@query(
    "change_regions",
    _sql_changes(
        """select distinct doc_id, page_no, x // 3 * 3 as x, y // 3 * 3 as y, least(3, 8 - x // 3 * 3) as width,
           least(3, 8 - y // 3 * 3) as height from cls where class <> 'same'"""
    ),
)
def change_regions(spark, d):
    """Blocks of three pixels, so the last ones are clipped."""
    found = R.change_regions(R.with_changes(_color_pairs(spark, d)), block=3)
    return found.select("doc_id", "page_no", *[F.col(c).cast("bigint").alias(c) for c in ("x", "y", "width", "height")])


@query(
    "missing_pages",
    O.sql(
        "ver",
        """select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.page_no, b.page_no) as page_no, 'error' as severity,
           'page count' as check_name, 'page ' || coalesce(a.page_no, b.page_no) || ' is missing from ' ||
           case when a.doc_id is null then 'the first version' else 'the second version' end as message
           from page a full join ver b on a.doc_id = b.doc_id and a.page_no = b.page_no where a.doc_id is null or b.doc_id is null""",
    ),
)
def missing_pages(spark, d):
    return R.missing_pages(S.text_pages(spark, d), S.version_two(spark, d))


def _shifted(pages):
    """The raster moved right and down by an amount that depends on its number, edges wrapping."""
    w, h = F.col("w"), F.col("h")
    dx, dy = (F.col("page_id") % 3).cast("int"), (F.floor(F.col("page_id") / 3) % 3).cast("int")

    def source(i):
        return ((F.floor(i / w).cast("int") + h - dy) % h) * w + (i % w + w - dx) % w

    moved = let(F.col("px"), lambda p: F.transform(X.grid(w * h), lambda i: F.get(p, source(i))))
    return pages.select("page_id", "w", "h", moved.alias("px"))


_OFFSETS = {
    "b0": """select page_id, (x + page_id % 3) % 8 as x, (y + page_id // 3 % 3) % 8 as y, v from pix""",
    "ca": "select page_id, x // 2 as x, y // 2 as y, sum(v)::int // count(*) as v from pix group by page_id, x // 2, y // 2",
    "cb": "select page_id, x // 2 as x, y // 2 as y, sum(v)::int // count(*) as v from b0 group by page_id, x // 2, y // 2",
    "still": """select a.page_id, avg(case when abs(a.v - b.v)::double / 255 > 0.05 then 1.0::double else 0 end) * 100 < 3 as still
        from ca a join cb b on a.page_id = b.page_id and a.x = b.x and a.y = b.y group by a.page_id""",
    "first": """select page_id, dx, dy from (select a.page_id, dx, dy, row_number() over (partition by a.page_id
        order by avg(abs(a.v - b.v)), dy, dx) as rn from ca a, (select unnest(range(-2, 3)) as dx), (select unnest(range(-2, 3)) as dy), cb b
        where b.page_id = a.page_id and b.x = a.x + dx and b.y = a.y + dy group by a.page_id, dx, dy) where rn = 1""",
    "second": """select page_id, dx, dy from (select a.page_id, f.dx * 2 + o.dx as dx, f.dy * 2 + p.dy as dy, row_number() over (partition by a.page_id
        order by avg(abs(a.v - b.v)), f.dy * 2 + p.dy, f.dx * 2 + o.dx) as rn from pix a join first f on f.page_id = a.page_id,
        (select unnest(range(-2, 3)) as dx) o, (select unnest(range(-2, 3)) as dy) p, b0 b
        where b.page_id = a.page_id and b.x = a.x + f.dx * 2 + o.dx and b.y = a.y + f.dy * 2 + p.dy
        group by a.page_id, f.dx * 2 + o.dx, f.dy * 2 + p.dy) where rn = 1""",
}


@query(
    "best_offset",
    O.sql(
        "pix",
        """select s.page_id, case when still then 0 else -dx end as dx, case when still then 0 else -dy end as dy
           from still s join second on second.page_id = s.page_id""",
        **_OFFSETS,
    ),
)
def best_offset(spark, d):
    """Scales 2 and 1 stand for 8 and 2, since the rasters are small."""
    pages = S.rasters(spark, d)
    pairs = R.pair_up(pages, _shifted(pages), ["page_id"]).withColumnsRenamed({"w_a": "w", "h_a": "h"})
    found = R.best_offset(pairs, coarse=2, fine=1, max_offset=4)
    return found.select("page_id", F.col("shift.dx").cast("bigint").alias("dx"), F.col("shift.dy").cast("bigint").alias("dy"))


@query(
    "box_blur",
    O.sql(
        "pix",
        """select b.page_id, b.x, b.y, sum(a.v)::int // 3 as v from mid b cross join (select unnest([-1, 0, 1]) as k)
           join mid a on a.page_id = b.page_id and a.x = b.x and a.y = least(greatest(b.y + k, 0), 7) group by b.page_id, b.x, b.y""",
        mid="""select b.page_id, b.x, b.y, sum(a.v)::int // 3 as v from pix b cross join (select unnest([-1, 0, 1]) as k)
            join pix a on a.page_id = b.page_id and a.y = b.y and a.x = least(greatest(b.x + k, 0), 7) group by b.page_id, b.x, b.y""",
    ),
)
def box_blur(spark, d):
    blurred = S.rasters(spark, d).select("page_id", "w", F.posexplode(X.blur(F.col("px"), F.col("w"), F.col("h"), 1)).alias("i", "v"))
    return blurred.select(
        "page_id", (F.col("i") % F.col("w")).cast("bigint").alias("x"), F.floor(F.col("i") / F.col("w")).alias("y"), "v"
    )


# ---- ink estimated from pixels ----

_SQL_TAC = """select page_id, x, y, case when k >= 1 then 100.0 else ((1-r-k)/(1-k) + (1-g-k)/(1-k) + (1-b-k)/(1-k) + k) * 100 end as tac
    from (select *, 1 - greatest(r, g, b) as k from (select page_id, x, y, r/255.0::double as r, g/255.0::double as g, b/255.0::double as b from rgb))"""


@query(
    "tac_pixels",
    O.sql("rgb", "select page_id, round(max(tac), 6) as tac_max, round(avg(tac), 6) as tac_avg from tacs group by page_id", tacs=_SQL_TAC),
)
def tac_pixels(spark, d):
    px = F.col("px")
    return S.color_rasters(spark, d).select("page_id", F.round(X.highest_tac(px), 6).alias("tac_max"), F.round(X.mean_tac(px), 6).alias("tac_avg"))


@query(
    "tac_by_region",
    O.sql(
        "rgb",
        """select page_id, round(max(tac) * 10) / 10 as tac_max, round(round(avg(tac), 6) * 10) / 10 as coverage from tacs
           where x >= 1 and x < 5 and y >= 3 and y < 7 group by page_id""",
        tacs=_SQL_TAC,
    ),
)
def tac_by_region(spark, d):
    """A region of a 160 x 160 pt page; the raster counts from the top."""
    inside = X.crop(F.col("px"), F.col("w"), F.col("h"), (20.0, 20.0, 80.0, 80.0), (160.0, 160.0))
    px = F.col("px")
    found = S.color_rasters(spark, d).select("page_id", inside.alias("px")).select("page_id", X.highest_tac(px).alias("highest"), X.mean_tac(px).alias("mean"))
    return found.select(
        "page_id", rounded(F.coalesce("highest", F.lit(0.0)), 1).alias("tac_max"), rounded(F.round("mean", 6), 1).alias("coverage")
    )


# ---- provenance and scope: eight rasters make a document ----


def _old_pages(spark, d):
    return S.rasters(spark, d).withColumn("doc_id", F.floor(F.col("page_id") / 8)).withColumn("page_no", F.col("page_id") % 8 + 1)


def _new_pages(spark, d):
    """Every third document has its pages rotated by one place; every fifth page is inverted; some come twice, at the end again."""
    old = _old_pages(spark, d)
    moved = F.when(F.col("doc_id") % 3 == 0, F.col("page_no") % 8 + 1).otherwise(F.col("page_no"))
    px = F.when(F.col("page_id") % 5 == 0, F.transform("px", lambda v: F.lit(255) - v)).otherwise(F.col("px"))
    again = F.when(F.col("page_id") % 7 == 0, F.array(F.lit(0), F.lit(8))).otherwise(F.array(F.lit(0)))
    return old.withColumn("later", F.explode(again)).select("doc_id", (moved + F.col("later")).alias("page_no"), "w", "h", px.alias("px"))


_PROVENANCE = {
    "old": "select page_id // 8 as doc_id, page_id % 8 + 1 as page_no, x, y, v from pix",
    "new": """select page_id // 8 as doc_id, later + case when page_id // 8 % 3 = 0 then (page_id % 8 + 1) % 8 + 1 else page_id % 8 + 1 end as page_no,
        x, y, case when page_id % 5 = 0 then 255 - v else v end as v from pix, (values (0), (8)) t(later) where later = 0 or page_id % 7 = 0""",
    "sims": f"""select doc_id, n, m, round({_SQL_SSIM} * 1000) / 1000 as s from (select a.doc_id, a.page_no as n, b.page_no as m, a.v as va, b.v as vb
        from new a join old b on a.doc_id = b.doc_id and a.x = b.x and a.y = b.y) group by doc_id, n, m""",
}


@query(
    "page_provenance",
    O.sql(
        "pix",
        """select doc_id, n as page_no, case when bool_or(n = m and s >= 0.995) then 'in place'
           when bool_or(n <> m and s >= 0.98) then 'moved' else 'rewritten' end as origin from sims group by doc_id, n""",
        **_PROVENANCE,
    ),
)
def page_provenance(spark, d):
    return R.provenance(_new_pages(spark, d), _old_pages(spark, d))


_SQL_SAME_PAGE = f"""select a.doc_id, a.page_no, {_SQL_SSIM} as s from (select n.doc_id, n.page_no, n.v as va, o.v as vb from new n join old o
    on n.doc_id = o.doc_id and n.page_no = o.page_no and n.x = o.x and n.y = o.y) a group by a.doc_id, a.page_no"""


def _same_pages(spark, d):
    return R.pair_up(_new_pages(spark, d), _old_pages(spark, d), ["doc_id", "page_no"])


@query(
    "measure_ssim",
    O.sql("pix", f"select doc_id, page_no, round(s * 1000) / 1000 as ssim from ({_SQL_SAME_PAGE})", **_PROVENANCE),
)
def measure_ssim(spark, d):
    """Pages of two versions by number."""
    return _same_pages(spark, d).select("doc_id", "page_no", R.similarity().alias("ssim"))


@query(
    "diff_pages",
    O.sql("pix", f"select doc_id, page_no, round(s * 100 * 1000) / 1000 as similarity from ({_SQL_SAME_PAGE})", **_PROVENANCE),
)
def diff_pages(spark, d):
    score = rounded(X.ssim(F.col("px_a"), F.col("px_b")) * 100, 3)
    return _same_pages(spark, d).select("doc_id", "page_no", score.alias("similarity"))


@query(
    "change_scope",
    O.sql(
        "pix",
        """select doc_id, count(*) filter (where s < 0.995) as changed_pages, count(*) filter (where s < 0.995) <= 2 as within_scope,
           count(*) filter (where s < 0.995) > 0 as something_changed,
           coalesce(bool_or(s < 0.995) filter (where n = 4), false) as expected_changed,
           coalesce(bool_and(s >= 0.995) filter (where n <> 4), true) as rest_unchanged from sims where n = m group by doc_id""",
        **_PROVENANCE,
    ),
)
def change_scope(spark, d):
    return R.change_scope(_same_pages(spark, d), most=2, expected_page=4)


# ---- page ranges ----

_SPECS = ["1-2,4", "3", "2-", "1, 1-3 ,5"]


@query(
    "page_range",
    O.sql(
        "conv",
        """select doc_id, page_no, case when doc_id % 4 = 2 then '2-' end as error,
           case doc_id % 4 when 0 then page_no in (1, 2, 4) when 1 then page_no = 3 when 3 then page_no in (1, 2, 3, 5) end as selected from conv""",
    ),
)
def page_range(spark, d):
    """Four page specifications, one of them broken, dealt to conversations."""
    from quirecheck.operators import pages as P

    spec = F.element_at(F.array(*[F.lit(s) for s in _SPECS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return S.conversation_pages(spark, d).select(
        "doc_id", "page_no", P.range_error(spec).alias("error"), P.in_range(spec, F.col("page_no")).alias("selected")
    )


@query(
    "page_list",
    """select item_id, case item_id % 4 when 0 then '1,2,4' when 1 then '3' when 3 then '1,2,3,5' end as pages from benchmark""",
)
def page_list(spark, d):
    from quirecheck.operators import pages as P

    spec = F.element_at(F.array(*[F.lit(s) for s in _SPECS]), (F.col("item_id") % 4 + 1).cast("int"))
    pages = P.page_list(spec)
    return S.table(spark, d, "benchmark").select(
        "item_id", F.when(pages.isNotNull(), F.array_join(pages.cast("array<string>"), ",")).alias("pages")
    )
