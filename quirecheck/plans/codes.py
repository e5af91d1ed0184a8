"""Queries over codes, reference tables and glossaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirecheck.functions import validators as V
from quirecheck.functions.values import rounded
from quirecheck.operators import checks as K, codes as B, layout as L, reference as R
from quirecheck.operators.ordinals import nth_element
from quirecheck.plans import oracle_tables as O
from quirecheck.plans.registry import query
from quirecheck.sources import standins as S
from quirecheck.operators.unions import union_all

SEP = " ¦ "


def _docs(spark, d):
    return S.table(spark, d, "documents").select("doc_id")


@query(
    "code_counts",
    O.sql(
        "code",
        """select d.doc_id, count(c.text) > 0 as has_codes, coalesce(bool_or(format = 'QR_CODE'), false) as has_qr,
           count(c.text) as codes, coalesce(bool_or(format = 'CODE_128'), false) as has_code128
           from documents d left join code c on c.doc_id = d.doc_id group by d.doc_id""",
    ),
)
def code_counts(spark, d):
    return L.verdicts(_docs(spark, d), S.codes(spark, d), **B.code_counts())


@query(
    "code_nth",
    O.sql(
        "code",
        """select d.doc_id, c.format, c.text, c.page_no, round(c.x * 10) / 10 as x, round(c.y * 10) / 10 as y,
           case when c.text is null then 'code 2 does not exist (found: ' || d.n || ')' end as error
           from (select doc_id, count(*) as n from kept group by doc_id) d left join
           (select *, row_number() over (partition by doc_id order by page_no, code_no) as rn from kept) c
           on c.doc_id = d.doc_id and c.rn = 2""",
        kept="select * from code where code_no % 3 <> 1 or doc_id % 3 = 0",
    ),
)
def code_nth(spark, d):
    """The second code of each document; a part of the documents has only one."""
    kept = S.codes(spark, d).filter((F.col("code_no") % 3 != 1) | (F.col("doc_id") % 3 == 0))
    second = nth_element(kept, ["page_no", "code_no"], 2, "code")
    return second.select(
        "doc_id", "format", "text", "page_no", rounded(F.col("x"), 1).alias("x"), rounded(F.col("y"), 1).alias("y"), "error"
    )


@query("gtin_valid", O.sql("code", "select code_no, text, code_no % 2 = 0 as ok from code"))
def gtin_valid(spark, d):
    """The stand-in gives even parts the right check digit and odd parts a wrong one."""
    return S.codes(spark, d).select("code_no", "text", V.gtin_valid(F.col("text")).alias("ok"))


@query(
    "code_in_text",
    O.sql(
        "code",
        """select t.doc_id, coalesce(bool_and(contains(t.text, c.text)), false) as ok from
           (select d.doc_id, d.text || case when d.doc_id % 2 = 0 then coalesce(string_agg(' ' || c.text, ''), '') else '' end as text
            from documents d left join code c on c.doc_id = d.doc_id group by d.doc_id, d.text) t
           left join code c on c.doc_id = t.doc_id group by t.doc_id""",
    ),
)
def code_in_text(spark, d):
    """Codes are appended to the text of even documents."""
    codes = S.codes(spark, d)
    listed = codes.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("listed"))
    planted = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", "text", "listed")).otherwise(F.col("text"))
    docs = S.documents(spark, d).join(listed, "doc_id", "left").select("doc_id", planted.alias("text"))
    return B.codes_in_text(codes, docs)


@query(
    "code_format",
    O.sql(
        "code",
        """select d.doc_id, coalesce(bool_and(regexp_matches(c.text, '^789[0-9]+[0-7]$')), false) as ok
           from documents d left join code c on c.doc_id = d.doc_id group by d.doc_id""",
    ),
)
def code_format(spark, d):
    return L.verdicts(_docs(spark, d), S.codes(spark, d), ok=(B.all_match(r"^789\d+[0-7]$"), False))


@query(
    "code_position",
    O.sql(
        "code",
        """select d.doc_id, coalesce(bool_and(x between 20 and 450 and y between 100 and 540), false) as ok
           from documents d left join code c on c.doc_id = d.doc_id group by d.doc_id""",
    ),
)
def code_position(spark, d):
    return L.verdicts(_docs(spark, d), S.codes(spark, d), ok=(B.all_inside(20, 100, 450, 540), False))


# ---- lookups ----


@query(
    "lookup_value",
    """with r as (select n_nationkey::bigint as row_no, n_nationkey::varchar as k, n_name as v from nation
         union all select 1000 + r_regionkey, r_regionkey::varchar, r_name from region)
       select c_custkey as id, (c_custkey % 40)::varchar as key, f.v as value from customer
       left join (select k, arg_min(v, row_no) as v from r group by k) f on f.k = (c_custkey % 40)::varchar""",
)
def lookup_value(spark, d):
    """Nations then regions as one table with repeated keys: the first row wins."""

    def rows(name, key, value, start):
        return S.table(spark, d, name).select(
            (F.col(key) + start).cast("bigint").alias("row_no"), F.array(F.col(key).cast("string"), F.col(value)).alias("cells")
        )

    reference = union_all(rows("nation", "n_nationkey", "n_name", 0), rows("region", "r_regionkey", "r_name", 1000))
    requests = S.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40).cast("string").alias("key")
    )
    return R.lookup_value(requests, reference)


def _sql_base(requests: str, table: str, extra: str = "") -> str:
    """First row per request by equality or containment, by comparing all pairs."""
    return f"""select q.*{extra}, case when r.row_no is not null then r.c1 || '|' || r.c2 || '|' || r.c3 end as cells
        from ({requests}) q left join (select k, min(row_no) as row_no from
          (select distinct k from ({requests}) where k is not null) a join {table} on row_no > 0 and
          (lower(c1) = k or (strlen(k) >= 3 and contains(lower(c2), k))) group by k) f on f.k = q.k
        left join {table} r on r.row_no = f.row_no"""


def _cells():
    return F.array_join("cells", "|").alias("cells")


def _drop_k(sql: str) -> str:
    return f"select * exclude (k) from ({sql})"


_SQL_TERMS = "select p_partkey as id, upper(p_name) || '  ' || p_partkey % 50 as key, p_name || ' ' || p_partkey % 50 as k from part"


def _terms(spark, d):
    return S.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.upper("p_name"), F.lit("  "), (F.col("p_partkey") % 50).cast("string")).alias("key"),
    )


@query("query_medicine", O.sql("ref", _drop_k(_sql_base(_SQL_TERMS, "ref"))))
def query_medicine(spark, d):
    """Names in capitals with doubled blanks, found inside the second column."""
    return R.query_table(_terms(spark, d), S.reference_rows(spark, d)).select("id", "key", _cells())


_SQL_MIXED = """select p_partkey as id, case p_partkey % 3 when 0 then p_brand when 1 then c1 else 'no such thing' end as key,
    lower(case p_partkey % 3 when 0 then p_brand when 1 then c1 else 'no such thing' end) as k
    from part join ref on row_no = p_partkey + 1"""


@query("query_base", O.sql("ref", _drop_k(_sql_base(_SQL_MIXED, "ref"))))
def query_base(spark, d):
    """Keys that equal a first cell, keys found nowhere, and brands (a column that is not searched)."""
    rows = S.reference_rows(spark, d)
    kind = F.col("p_partkey") % 3
    key = F.when(kind == 0, F.col("p_brand")).when(kind == 1, F.col("cells")[0]).otherwise("no such thing")
    requests = S.table(spark, d, "part").withColumn("row_no", F.col("p_partkey") + 1).join(rows, "row_no").select(
        F.col("p_partkey").alias("id"), key.alias("key")
    )
    return R.query_table(requests, rows).select("id", "key", _cells())


_SQL_GTINS = """select row_no as id, substr(c1, 1, 3) || '-' || substr(c1, 4) || case when row_no % 5 = 0 then '9' else '' end as key,
    c1 || case when row_no % 5 = 0 then '9' else '' end as k from ref where row_no > 0"""


@query("query_gtin", O.sql("ref", _drop_k(_sql_base(_SQL_GTINS, "ref"))))
def query_gtin(spark, d):
    """Codes written with a dash; every fifth has a digit too many."""
    rows = S.reference_rows(spark, d)
    code = F.col("cells")[0]
    spoiled = F.when(F.col("row_no") % 5 == 0, "9").otherwise("")
    key = F.concat(F.substring(code, 1, 3), F.lit("-"), F.substring(code, 4, 20), spoiled)
    requests = rows.filter("row_no > 0").select(F.col("row_no").alias("id"), key.alias("key"))
    return R.query_by_digits(requests, rows).select("id", "key", _cells())


_SQL_CEPS = """select 0::bigint as row_no, 'cep' as c1, 'street' as c2, 'nation' as c3 union all
    select c_custkey + 1, (10000000 + c_custkey * 7)::varchar, c_name, n_name from customer join nation on c_nationkey = n_nationkey"""


def _postal_table(spark, d):
    header = spark.range(1).select(
        F.lit(0).cast("bigint").alias("row_no"), F.array(F.lit("cep"), F.lit("street"), F.lit("nation")).alias("cells")
    )
    nation = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = S.table(spark, d, "customer").join(nation, "c_nationkey").select(
        (F.col("c_custkey") + 1).alias("row_no"),
        F.array((F.col("c_custkey") * 7 + 10000000).cast("string"), F.col("c_name"), F.col("n_name")).alias("cells"),
    )
    return union_all(header, rows)


def _postal_requests(spark, d):
    """Order customers' codes with a dash; every ninth order has a digit too few."""
    code = (F.col("o_custkey") * 7 + 10000000).cast("string")
    last = F.when(F.col("o_orderkey") % 9 == 0, F.substring(code, 6, 2)).otherwise(F.substring(code, 6, 3))
    wanted = F.concat(F.lit("nation_"), (F.col("o_custkey") % 10).cast("string"))
    return S.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat_ws("-", F.substring(code, 1, 5), last).alias("key"), wanted.alias("fragment")
    )


_SQL_POSTAL = """select id, substr(c, 1, 5) || '-' || substr(c, 6) as key, fragment, c as k from
    (select o_orderkey as id, 'nation_' || o_custkey % 10 as fragment,
     substr((o_custkey * 7 + 10000000)::varchar, 1, case when o_orderkey % 9 = 0 then 7 else 8 end) as c from orders)"""


@query(
    "query_postal_code",
    O.sql(
        "",
        _drop_k(
            f"""select q.id, q.key, q.k, case when length(q.k) <> 8 then 'postal code must have 8 digits (got "' || q.k || '")' end as error,
            case when length(q.k) = 8 then r.c1 || '|' || r.c2 || '|' || r.c3 end as cells
            from ({_SQL_POSTAL}) q left join cep r on r.row_no > 0 and r.c1 = q.k"""
        ),
        cep=_SQL_CEPS,
    ),
)
def query_postal_code(spark, d):
    found = R.query_by_digits(_postal_requests(spark, d), _postal_table(spark, d), length=8)
    return found.select("id", "key", "error", _cells())


@query(
    "validate_address",
    O.sql(
        "",
        f"""select q.id, q.key, q.fragment, coalesce(contains(lower(r.c1 || ' ' || r.c2 || ' ' || r.c3), q.fragment), false) as ok
            from ({_SQL_POSTAL}) q left join (select k, min(row_no) as row_no from (select distinct k from ({_SQL_POSTAL})) a
              join cep on row_no > 0 and (c1 = k or contains(lower(c2), k)) group by k) f on f.k = q.k
            left join cep r on r.row_no = f.row_no""",
        cep=_SQL_CEPS,
    ),
)
def validate_address(spark, d):
    return R.validate_address(_postal_requests(spark, d), _postal_table(spark, d), "key", "fragment")


@query(
    "glossary_missing",
    O.sql(
        "gloss",
        f"""select d.doc_id, coalesce(string_agg(g.term, '{SEP}' order by g.term_no) filter
            (where not contains({O.norm('d.text')}, {O.norm('g.term')})), '') as missing
            from documents d, gloss g group by d.doc_id""",
    ),
)
def glossary_missing(spark, d):
    absent = R.missing_terms(S.documents(spark, d), S.glossary(spark, d))
    return absent.select("doc_id", F.array_join("missing", SEP).alias("missing"))


@query(
    "code_reference_check",
    O.sql(
        "code",
        """select doc_id, 'error' as severity, 'Approved batch' as check_name, 'code ' || text || ' is not in the batch table' as message
           from (select *, row_number() over (partition by doc_id order by page_no, code_no) as rn from code) where rn = 1
           and code_no % 3 = 0""",
    ),
)
def code_reference_check(spark, d):
    """The first code of each document against a batch table that lacks every third code."""
    codes = S.codes(spark, d)
    batches = codes.filter(F.col("code_no") % 3 != 0).select(
        F.col("code_no").alias("row_no"), F.array("text", F.concat(F.lit("batch "), F.col("code_no").cast("string"))).alias("cells")
    )
    first = nth_element(codes, ["page_no", "code_no"], 1, "code").withColumnRenamed("text", "key")
    check = K.Check(
        "Approved batch",
        F.col("value").isNotNull(),
        F.concat(F.lit("code "), F.col("key"), F.lit(" is not in the batch table")),
        error=F.col("error"),
    )
    rows = R.lookup_value(first, batches).drop("page_no")
    return K.run_checks(rows, [check]).select("doc_id", "severity", "check_name", "message")
