"""Queries that edit page sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirecheck.operators import edits as E
from quirecheck.plans import oracle_tables as O
from quirecheck.plans.registry import query
from quirecheck.sources import standins as S

_COUNTED = {"counted": "select *, count(*) over (partition by doc_id) as n from conv"}


def _sql(body: str) -> str:
    return O.sql("conv", body, **_COUNTED)


def _renumbered(source: str, order: str) -> str:
    return f"select doc_id, row_number() over (partition by doc_id order by {order}) as page_no, text from ({source})"


@query("edit_delete", _sql(_renumbered("select * from counted where page_no <> 3", "page_no")))
def edit_delete(spark, d):
    """Page 3 of every conversation that has one."""
    return E.delete_page(S.conversation_pages(spark, d), F.lit(3))


@query(
    "edit_duplicate",
    _sql(_renumbered("select *, 0 as k from counted union all select *, 1 from counted where page_no = doc_id % 4 + 1", "page_no, k")),
)
def edit_duplicate(spark, d):
    """A page that depends on the document, which short ones lack."""
    return E.duplicate_page(S.conversation_pages(spark, d), F.col("doc_id") % 4 + 1)


@query(
    "edit_reorder",
    _sql("select doc_id, case when n = 4 then [2, 4, 1, 3][page_no] else page_no end::bigint as page_no, text from counted"),
)
def edit_reorder(spark, d):
    """The order 3, 1, 4, 2 suits documents of four pages only."""
    order = F.array(*[F.lit(p).cast("bigint") for p in (3, 1, 4, 2)])
    return E.reorder_pages(S.conversation_pages(spark, d), order)


@query("edit_reverse", _sql("select doc_id, n - page_no + 1 as page_no, text from counted"))
def edit_reverse(spark, d):
    return E.reverse_pages(S.conversation_pages(spark, d))


@query("edit_split", _sql("select doc_id, page_no - 1 as page_no, text from counted where page_no between 2 and 3 and n >= 3"))
def edit_split(spark, d):
    return E.split_document(S.conversation_pages(spark, d), F.lit(2), F.lit(3))


@query(
    "edit_merge",
    _sql(
        """select doc_id, page_no, text from counted union all select c.doc_id, b.page_no + c.n, b.text from counted b
           join (select distinct doc_id, n from counted) c on b.doc_id = c.doc_id + 1"""
    ),
)
def edit_merge(spark, d):
    """Every conversation gets the next one's pages."""
    pages = S.conversation_pages(spark, d)
    return E.merge_documents(pages, pages.withColumn("doc_id", F.col("doc_id") - 1))


@query(
    "edit_rotate",
    O.sql("box", "select doc_id, page_no, case when page_no = 2 then 90 else 180 end as rotation from box"),
)
def edit_rotate(spark, d):
    """All pages by 180 degrees, then page 2 by 90."""
    pages = S.boxes(spark, d, numbered=True).select("doc_id", "page_no")
    return E.rotate_pages(E.rotate_pages(pages, 180), 90, page=2)


@query(
    "edit_boxes",
    O.sql(
        "box",
        """select doc_id, page_no, 600.0::double as width, 850.0::double as height, '0.0,0.0,600.0,850.0' as media, '5.0,5.0,590.0,840.0' as trim_box,
           case when bleed is not null then array_to_string(bleed, ',') end as bleed from box""",
    ),
)
def edit_boxes(spark, d):
    pages = E.set_box(E.set_page_size(S.boxes(spark, d, numbered=True), 600, 850), "trim", (5, 5, 590, 840))

    def shown(box):
        return F.when(F.col(box).isNotNull(), F.array_join(F.col(box).cast("array<string>"), ","))

    return pages.select(
        "doc_id", "page_no", "width", "height", shown("media").alias("media"), shown("trim").alias("trim_box"), shown("bleed").alias("bleed")
    )


@query(
    "edit_overlay",
    O.sql(
        "box",
        """select doc_id, page_no, kind, case when kind = 'number' then page_no || ' / ' || count(*) over (partition by doc_id, kind) else label end as text,
           x::double as x, y::double as y, size::double as size, angle::double as angle from box cross join (values
           ('watermark', 'DRAFT', 148.75, 294.7, 48, 45), ('number', '', 282.5, 20, 10, 0), ('stamp', 'CHECKED', 455, 802, 12, 0))
           as o(kind, label, x, y, size, angle)""",
    ),
)
def edit_overlay(spark, d):
    placed = E.overlays(S.boxes(spark, d, numbered=True), watermark="DRAFT", stamp="CHECKED", numbers=True)
    return placed.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query(
    "edit_downsample_plan",
    O.sql(
        "img",
        """select *, greatest(round(new_width * (height::double / width)), 1)::bigint as new_height from
           (select doc_id, page_no, width, height, greatest(round(width / dpi_x * 300), 1)::bigint as new_width
            from img where dpi_x > 300 and width >= 2 and height >= 2)""",
    ),
)
def edit_downsample_plan(spark, d):
    return E.downsample_plan(S.images(spark, d, numbered=True), 300)


_OPS = ["delete_page", "duplicate_page", "rotate_page", "reorder_pages", "split_document", "add_watermark", "set_trim_box", "add_page_numbers"]


@query(
    "edit_plan",
    _sql(
        """select o.doc_id, seq, op, case when error is null then description end as description, error from (
           select doc_id, seq, op, case op
             when 'delete_page' then case when p > n then 'delete_page: page ' || p || ' does not exist (the document has ' || n || ')'
               when n = 1 then 'delete_page: cannot remove the only page of the document' end
             when 'duplicate_page' then case when p > n then 'duplicate_page: page ' || p || ' does not exist (the document has ' || n || ')' end
             when 'rotate_page' then case when doc_id % 3 = 0 then 'rotate_page: rotation must be 90, 180 or 270 (got 45)'
               when p > n then 'rotate_page: page ' || p || ' does not exist (the document has ' || n || ')' end
             when 'reorder_pages' then case when n <> 3 then 'reorder_pages: the order must use each page from 1 to ' || n || ' exactly once' end
             when 'split_document' then case when p > n then 'split_document: page ' || p || ' does not exist (the document has ' || n || ')'
               when 2 > n then 'split_document: page 2 does not exist (the document has ' || n || ')'
               when 2 < p then 'split_document: invalid range (' || p || ' to 2)' end
             when 'add_watermark' then case when doc_id % 2 = 0 then 'add_watermark expects a text' end
             when 'set_trim_box' then case when doc_id % 2 = 0 then 'set_trim_box: invalid rectangle' end end as error,
           case op when 'delete_page' then 'page ' || p || ' removed' when 'duplicate_page' then 'page ' || p || ' duplicated'
             when 'rotate_page' then 'page ' || p || ' rotated 90°' when 'reorder_pages' then 'pages reordered to [2, 3, 1]'
             when 'split_document' then 'pages ' || p || '-2 saved to part' when 'add_watermark' then 'watermark "part" added'
             when 'set_trim_box' then 'TrimBox set to [0.0, 0.0, 5.0, 9.0]' else 'page numbering added' end as description
           from (select distinct doc_id, n, doc_id % 5 + 1 as p from counted), (values (1, 'delete_page'), (2, 'duplicate_page'),
             (3, 'rotate_page'), (4, 'reorder_pages'), (5, 'split_document'), (6, 'add_watermark'), (7, 'set_trim_box'), (8, 'add_page_numbers'))
             as v(seq, op)) o"""
    ),
)
def edit_plan(spark, d):
    """Eight edits queued for every conversation, some of them not valid for it."""
    key = F.col("doc_id")
    counts = S.conversation_pages(spark, d).groupBy("doc_id").agg(F.count("*").alias(E.N))
    even = key % 2 == 0
    corner = F.when(even, 0.0).otherwise(5.0)
    queued = counts.select("doc_id", F.posexplode(F.array(*[F.lit(o) for o in _OPS])).alias("i", "op")).select(
        "doc_id", (F.col("i") + 1).alias("seq"), "op", (key % 5 + 1).alias("page"), F.lit(2).alias("last_page"),
        F.when(key % 3 == 0, 45).otherwise(90).alias("degrees"),
        F.array(*[F.lit(p) for p in (2, 3, 1)]).alias("order"),
        F.when((F.col("op") == "add_watermark") & even, " ").otherwise("part").alias("text"),
        F.array(F.lit(0.0), F.lit(0.0), corner, F.lit(9.0)).alias("rect"),
        F.lit(600.0).alias("width"), F.lit(800.0).alias("height"),
    )
    return E.edit_plan(queued, counts)
