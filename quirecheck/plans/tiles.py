"""Queries over page-size rasters as tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirecheck.operators import tiles as T
from quirecheck.plans import oracle_tables as O
from quirecheck.plans.registry import query
from quirecheck.sources import standins as S

_LIGHT = "floor(0.299::double * r + 0.587::double * g + 0.114::double * b)::int"


def _blurred(source: str, name: str) -> dict[str, str]:
    def means(table, order, apart):
        one = lambda c: f"(coalesce(lag({c}) over p, {c}) + {c} + coalesce(lead({c}) over p, {c})) // 3 as {c}"
        return f"select doc_id, x, y, {', '.join(map(one, 'rgb'))} from {table} window p as (partition by doc_id, {apart} order by {order})"

    return {f"{name}_mid": means(source, "x", "y"), name: means(f"{name}_mid", "y", "x")}


def _grey(name: str, scale: int) -> str:
    return f"select doc_id, x // {scale} as x, y // {scale} as y, (sum(v) // count(*))::int as v from (select *, {_LIGHT} as v from {name}) group by doc_id, x // {scale}, y // {scale}"


_ALIGNED = {
    **_blurred("scan_a", "soft_a"),
    **_blurred("scan_b", "soft_b"),
    "ca": _grey("soft_a", 8),
    "cb": _grey("soft_b", 8),
    "fa": _grey("soft_a", 2),
    "fb": _grey("soft_b", 2),
    "moving": "select doc_id from ca a join cb b using (doc_id, x, y) group by doc_id having count(*) filter (where abs(a.v - b.v)::double / 255 > 0.05)::double / count(*) * 100 >= 3",
    "first": """select doc_id, dx * 4 as cx, dy * 4 as cy from (
        select doc_id, dx, dy, row_number() over (partition by doc_id order by sum(abs(a.v - b.v))::double / count(*), dy, dx) as rn
        from (select doc_id, x + dx as x, y + dy as y, dx, dy, v from (select *, unnest(range(-4, 5)) as dy from (select *, unnest(range(-4, 5)) as dx from ca semi join moving using (doc_id)))) a
        join cb b using (doc_id, x, y) group by doc_id, dx, dy) where rn = 1""",
    "second": """select doc_id, -2 * fx as dx, -2 * fy as dy from (
        select doc_id, fx, fy, row_number() over (partition by doc_id order by sum(abs(a.v - b.v))::double / count(*), fy, fx) as rn
        from (select doc_id, x + fx as x, y + fy as y, fx, fy, v from (
            select *, unnest(range(cy - 4, cy + 5)) as fy from (select *, unnest(range(cx - 4, cx + 5)) as fx from fa join first using (doc_id)))) a
        join fb b using (doc_id, x, y) group by doc_id, fx, fy) where rn = 1""",
    "met": """select a.doc_id, coalesce(s.dx, 0) as dx, coalesce(s.dy, 0) as dy, a.x, a.y,
        sqrt((a.r - coalesce(b.r, 255))::double ^ 2 + (a.g - coalesce(b.g, 255))::double ^ 2 + (a.b - coalesce(b.b, 255))::double ^ 2) / 441.67 > 0.05 as differs
        from soft_a a left join second s on s.doc_id = a.doc_id
        left join soft_b b on b.doc_id = a.doc_id and b.x = a.x - coalesce(s.dx, 0) and b.y = a.y - coalesce(s.dy, 0)""",
}


@query(
    "tiled_compare",
    O.sql(
        "scan_a scan_b",
        """select doc_id, dx::int as dx, dy::int as dy, round(count(*) filter (where differs)::double / count(*) * 100, 6) as diff_percent,
           count(distinct case when differs then (x // 32, y // 32) end) as areas from met group by doc_id, dx, dy""",
        **_ALIGNED,
    ),
)
def tiled_compare(spark, d):
    """Pages cut into tiles: blurred, lined up by a search over coarse and fine copies, and compared."""
    found = T.compare_tiles(T.tiles_of(S.text_scans(spark, d)), blur=1)
    return found.select("page.doc_id", "dx", "dy", F.round("diff_percent", 6).alias("diff_percent"), F.col("areas").cast("bigint").alias("areas"))


@query(
    "tiled_similarity",
    O.sql(
        "scan_a scan_b",
        """select doc_id, round(((sa / n * (sb / n) * 2 + 6.5025) * ((n * ab - sa * sb) / (n * n) * 2 + 58.5225))
               / ((sa / n * (sa / n) + sb / n * (sb / n) + 6.5025) * ((n * aa - sa * sa) / (n * n) + (n * bb - sb * sb) / (n * n) + 58.5225)), 9) as ssim
           from (select doc_id, count(*)::double as n, sum(a.v)::double as sa, sum(b.v)::double as sb, sum(a.v * a.v)::double as aa, sum(b.v * b.v)::double as bb, sum(a.v * b.v)::double as ab
               from la a join lb b using (doc_id, x, y) group by doc_id)""",
        la=f"select doc_id, x, y, {_LIGHT} as v from scan_a",
        lb=f"select doc_id, x, y, {_LIGHT} as v from scan_b",
    ),
)
def tiled_similarity(spark, d):
    found = T.similarity(T.tiles_of(S.text_scans(spark, d)))
    return found.select("page.doc_id", F.round("ssim", 9).alias("ssim"))
