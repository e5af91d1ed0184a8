"""Queries over metadata, objects and the object graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirecheck.functions import validators as V
from quirecheck.operators import structure as R
from quirecheck.plans import oracle_tables as O
from quirecheck.plans.registry import query
from quirecheck.sources import standins as S

SEP = " ¦ "


@query(
    "meta_get",
    O.sql(
        "meta",
        """select doc_id, coalesce(max(value) filter (where key = 'Title'), '') as title,
           coalesce(max(value) filter (where key = 'Lang'), '') as lang,
           coalesce(max(value) filter (where key = 'Author'), '') as author from meta group by doc_id""",
    ),
)
def meta_get(spark, d):
    return R.metadata(S.web_meta(spark, d), ["Title", "Lang", "Author"])


_SQL_RAW_DATE = """select o_orderkey as id, case when o_orderkey % 9 = 0 then 'on ' || strftime(o_orderdate, '%d %b')
    else substr('D:' || strftime(o_orderdate, '%Y%m%d') || lpad((o_orderkey % 240000)::varchar, 6, '0') || '-03''00''',
    1, [10, 11, 12, 14, 16, 23][o_orderkey % 6 + 1]) end as raw from orders"""


@query(
    "meta_dates",
    f"""select id, raw, case when regexp_matches(raw, '^D:[0-9]{{8}}') then substr(raw, 3, 4) || '-' || substr(raw, 7, 2) || '-' || substr(raw, 9, 2)
        || ' ' || case when length(raw) >= 12 then substr(raw, 11, 2) else '00' end || ':' ||
        case when length(raw) >= 14 then substr(raw, 13, 2) else '00' end || ':' ||
        case when length(raw) >= 16 then substr(raw, 15, 2) else '00' end else raw end as stamp from ({_SQL_RAW_DATE})""",
)
def meta_dates(spark, d):
    key = F.col("o_orderkey")
    full = F.concat(
        F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((key % 240000).cast("string"), 6, "0"), F.lit("-03'00'")
    )
    length = F.element_at(F.array(*[F.lit(n) for n in (10, 11, 12, 14, 16, 23)]), (key % 6 + 1).cast("int"))
    raw = F.when(key % 9 == 0, F.concat(F.lit("on "), F.date_format("o_orderdate", "dd MMM"))).otherwise(
        F.substring(full, F.lit(1), length)
    )
    return S.table(spark, d, "orders").select(key.alias("id"), raw.alias("raw")).select(
        "id", "raw", V.pdf_date(F.col("raw")).alias("stamp")
    )


@query(
    "meta_list",
    O.sql(
        "meta",
        f"""select doc_id, coalesce(string_agg(key || ': ' || value, '{SEP}' order by pos) filter (where value <> ''), '') as entries
            from meta group by doc_id""",
    ),
)
def meta_list(spark, d):
    return R.metadata_entries(S.web_meta(spark, d)).select("doc_id", F.array_join("entries", SEP).alias("entries"))


@query("count_objects", "select l_orderkey as doc_id, count(*) as objects from lineitem group by l_orderkey")
def count_objects(spark, d):
    lines = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("objects"))


@query(
    "file_bloat",
    """select doc_id, strlen(text)::bigint as bytes, len(string_split(text, chr(10)))::bigint as page_count,
       strlen(text) // 1024 // len(string_split(text, chr(10))) > 0 as bloated from documents""",
)
def file_bloat(spark, d):
    size, pages = F.octet_length("text"), F.size(F.split("text", "\n"))
    return S.documents(spark, d).select(
        "doc_id", size.cast("bigint").alias("bytes"), pages.cast("bigint").alias("page_count"),
        R.is_bloated(size, pages, 0).alias("bloated"),
    )


@query("list_objects", O.sql("node", "select node, obj_id || ': ' || kind as label from node"))
def list_objects(spark, d):
    return R.labelled(S.nodes(spark, d)).select("node", "label")


@query(
    "object_size",
    O.sql(
        "node",
        """select w.doc_id, w.obj_id, n.size, case when n.size is null then 'object ' || w.obj_id || ' does not exist' end as error
           from (select c_custkey % 4 as doc_id, c_custkey * 11 // 4 as obj_id from customer) w
           left join (select obj_id % 4 as doc_id, obj_id // 4 as obj_id, size from node where kind = 'Stream/Image') n
           on n.doc_id = w.doc_id and n.obj_id = w.obj_id""",
    ),
)
def object_size(spark, d):
    """Four documents, in which object numbers repeat."""
    number = F.col("c_custkey") * 11
    wanted = S.table(spark, d, "customer").select((F.col("c_custkey") % 4).alias("doc_id"), F.floor(number / 4).alias("obj_id"))
    images = S.nodes(spark, d).filter(F.col("kind") == "Stream/Image")
    objects = images.select((F.col("obj_id") % 4).alias("doc_id"), F.floor(F.col("obj_id") / 4).alias("obj_id"), "size")
    return R.object_sizes(objects, wanted)


def _graph(spark, d):
    doc = F.lit(1).alias("doc_id")
    root = spark.range(1).select(doc, F.lit("r0").alias("node"))
    return S.nodes(spark, d).select(doc, "*"), S.edges(spark, d).select(doc, "*"), root


_SQL_REACH = "select 'r0' as node union select e.dst from edge e join reach r on e.src = r.node"


def _sql_unreached(extra: str) -> str:
    return O.sql(
        "edge node",
        f"""select n.node, n.obj_id || ': ' || n.kind as label from node n
            where n.kind not in ('ObjStm', 'XRef') {extra} and n.node not in (select node from reach)""",
        recursive=True,
        reach=_SQL_REACH,
    )


@query("unreferenced", _sql_unreached(""))
def unreferenced(spark, d):
    return R.unreferenced(*_graph(spark, d)).select("node", "label")


@query("orphaned", _sql_unreached("and (contains(n.kind, 'Font') or contains(n.kind, '/Image'))"))
def orphaned(spark, d):
    return R.orphaned(*_graph(spark, d)).select("node", "label")


# Events stand in for objects: the kind of event is the object's action or field type.
_ACTIONS = {"error": "JavaScript", "purchase": "SubmitForm", "signup": "Launch", "click": "GoTo"}
_SQL_OBJECTS = """select user_id as doc_id, event_id as obj_id, case event_type when 'error' then 'JavaScript'
    when 'purchase' then 'SubmitForm' when 'signup' then 'Launch' when 'click' then 'GoTo' end as action,
    value > 200 as encrypted, case when value < 2 then 'Sig' end as ft from events"""


def _objects(spark, d):
    action = F.lit(None).cast("string")
    for event, name in _ACTIONS.items():
        action = F.when(F.col("event_type") == event, name).otherwise(action)
    return S.table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("obj_id"), action.alias("action"),
        (F.col("value") > 200).alias("encrypted"), F.when(F.col("value") < 2, "Sig").alias("ft"),
    )


@query(
    "active_content",
    f"""select doc_id, bool_or(coalesce(action = 'JavaScript', false)) as has_javascript,
        coalesce(string_agg(distinct action, '{SEP}' order by action) filter (where action <> 'GoTo'), '') as actions
        from ({_SQL_OBJECTS}) group by doc_id""",
)
def active_content(spark, d):
    return R.active_content(_objects(spark, d)).withColumn("actions", F.array_join("actions", SEP))


@query(
    "suspicious_actions",
    f"select distinct doc_id, action || ' (object ' || obj_id || ')' as entry from ({_SQL_OBJECTS}) where action <> 'GoTo'",
)
def suspicious_actions(spark, d):
    return R.suspicious_actions(_objects(spark, d))


@query(
    "security_flags",
    f"""select doc_id, bool_or(encrypted) as encrypted, not bool_or(encrypted) as unrestricted,
        bool_or(coalesce(ft = 'Sig', false)) as has_signature_fields from ({_SQL_OBJECTS}) group by doc_id""",
)
def security_flags(spark, d):
    return R.security_flags(_objects(spark, d))
