"""Queries for layout, font, colour and image verdicts per document."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirecheck.functions import color
from quirecheck.functions.values import rounded
from quirecheck.operators import layout as L
from quirecheck.plans import oracle_tables as O
from quirecheck.plans.registry import query
from quirecheck.sources import standins as S
from quirecheck.sources.reading import dealt
from quirecheck.operators.unions import union_all

SEP = " ¦ "


def _docs(spark, d):
    return S.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))


def _sql_verdicts(uses: str, source: str, columns: dict[str, tuple[str, str | None]]) -> str:
    """Orders left joined to aggregates; each column is (aggregate, value for no elements)."""
    aggregates = ", ".join(f"{a} as {n}" for n, (a, _) in columns.items())
    shown = ", ".join(f"coalesce({n}, {v}) as {n}" if v is not None else n for n, (_, v) in columns.items())
    return O.sql(
        uses,
        f"""select o_orderkey as doc_id, {shown} from orders left join
            (select doc_id, {aggregates} from {source} group by doc_id) a on a.doc_id = o_orderkey""",
    )


def _sql_list(value: str, where: str) -> str:
    return f"string_agg(distinct {value}, '{SEP}' order by {value}) filter (where {where})"


def _joined(c):
    return F.array_join(c, SEP)


# ---- ink ----


@query("tac_page_doc", _sql_verdicts("img", "img", {"tac": ("round(max(tac_max) * 10) / 10", "0.0")}))
def tac_page_doc(spark, d):
    return L.verdicts(_docs(spark, d), S.images(spark, d), tac=(L.highest_tac(), 0.0))


@query(
    "ink_coverage",
    _sql_verdicts("img", "img", {"coverage": ("round(round(sum(ink_avg), 6) / count(*) * 10) / 10", "0.0")}),
)
def ink_coverage(spark, d):
    return L.verdicts(_docs(spark, d), S.images(spark, d), coverage=(L.ink_coverage(), 0.0))


@query("validate_tac", _sql_verdicts("img", "img", {"ok": ("bool_and(tac_max <= 250)", "true")}))
def validate_tac(spark, d):
    return L.verdicts(_docs(spark, d), S.images(spark, d), ok=(L.tac_within(250), True))


@query(
    "exact_tac",
    O.sql(
        "ink",
        """select doc_id, page_no, round(max(tac) * 10) / 10 as tac from (select doc_id, page_no, case space
           when 'cmyk' then (c + m + y + k) * 100 when 'spot' then y * 100
           else case when kk >= 1 then 100.0 else
             ((1 - c - kk) / (1 - kk) + (1 - m - kk) / (1 - kk) + (1 - y - kk) / (1 - kk) + kk) * 100 end end as tac
           from (select *, 1 - greatest(c, m, y) as kk from ink)) group by grouping sets ((doc_id, page_no), (doc_id))""",
    ),
)
def exact_tac(spark, d):
    """Per page, and per document on the row without a page number."""
    pages = S.inks(spark, d, numbered=True).groupBy("doc_id", "page_no").agg(L.exact_tac().alias("tac"))
    docs = pages.groupBy("doc_id").agg(F.max("tac").alias("tac"))
    return union_all(pages, docs.withColumn("page_no", F.lit(None).cast("bigint")))


@query(
    "spot_colors",
    _sql_verdicts("ink", "ink", {"spots": (_sql_list("spot", "space = 'spot' and spot <> 'All'"), "''")}),
)
def spot_colors(spark, d):
    return L.verdicts(_docs(spark, d), S.inks(spark, d), spots=(_joined(L.spot_colors()), ""))


@query(
    "rich_black",
    _sql_verdicts("ink", "ink", {"rich_black": ("bool_or(space = 'cmyk' and k >= 0.6 and c + m + y >= 0.2)", "false")}),
)
def rich_black(spark, d):
    return L.verdicts(_docs(spark, d), S.inks(spark, d), rich_black=(L.has_rich_black(), False))


def _sql_lab(source: str) -> str:
    lin = ", ".join(
        f"case when {c} <= 0.04045 then {c} / 12.92 else pow(({c} + 0.055) / 1.055, 2.4) end as l{c}" for c in "rgb"
    )
    xyz = (
        "(lr * 0.4124::double + lg * 0.3576::double + lb * 0.1805::double) / 0.95047 as x, lr * 0.2126::double + lg * 0.7152::double + lb * 0.0722::double as yy, "
        "(lr * 0.0193::double + lg * 0.1192::double + lb * 0.9505::double) / 1.08883 as z"
    )
    curve = ", ".join(
        f"case when {t} > 0.008856 then cbrt({t}) else 7.787 * {t} + 16.0::double / 116 end as f{t[0]}" for t in ("x", "yy", "z")
    )
    return (
        f"select *, 116 * fy - 16 as ll, 500 * (fx - fy) as aa, 200 * (fy - fz) as bb from "
        f"(select *, {curve} from (select *, {xyz} from (select *, {lin} from ({source}))))"
    )


@query(
    "delta_e",
    O.sql(
        "ink",
        """select p.doc_id, p.page_no, round(sqrt((p.ll - q.ll)^2 + (p.aa - q.aa)^2 + (p.bb - q.bb)^2) * 10) / 10 as delta_e
           from own p, brand q""",
        own=_sql_lab(
            """select doc_id, page_no, case space when 'rgb' then c when 'cmyk' then (1 - c) * (1 - k) else 1 - y end as r,
               case space when 'rgb' then m when 'cmyk' then (1 - m) * (1 - k) else 1 - y end as g,
               case space when 'rgb' then y when 'cmyk' then (1 - y) * (1 - k) else 1 - y end as b from ink"""
        ),
        brand=_sql_lab(
            "select (1 - 0.1::double) * (1 - 0.1::double) as r, (1 - 0.6::double) * (1 - 0.1::double) as g, (1 - 0.3::double) * (1 - 0.1::double) as b"
        ),
    ),
)
def delta_e(spark, d):
    """Every ink against one brand colour given in CMYK."""
    space, c, m, y, k = (F.col(n) for n in ("space", "c", "m", "y", "k"))
    from_cmyk = color.cmyk_to_rgb(c, m, y, k)
    tint = 1 - F.col("pct")
    rgb = [
        F.when(space == "rgb", F.col(n)).when(space == "cmyk", via).otherwise(tint).alias(n)
        for n, via in zip("rgb", from_cmyk)
    ]
    brand = color.lab(*color.cmyk_to_rgb(*[F.lit(v) for v in (0.1, 0.6, 0.3, 0.1)]))
    inks = S.inks(spark, d, numbered=True).select("doc_id", "page_no", *rgb)
    own = color.lab(F.col("r"), F.col("g"), F.col("b"))
    return inks.select("doc_id", "page_no", rounded(color.delta_e(own, brand), 1).alias("delta_e"))


# ---- strokes and fonts ----


@query(
    "hairlines",
    _sql_verdicts(
        "img",
        "img",
        {
            "hairlines": ("coalesce(min(min_stroke_pt) < 0.25, false)", "false"),
            "fine_lines": ("coalesce(min(min_stroke_pt) < 1, false)", "false"),
            "strokes_ok": ("coalesce(min(min_stroke_pt) >= 0.3, true)", "true"),
        },
    ),
)
def hairlines(spark, d):
    return L.verdicts(
        _docs(spark, d),
        S.images(spark, d),
        hairlines=(L.stroke_below(0.25), False),
        fine_lines=(L.stroke_below(1.0), False),
        strokes_ok=(L.strokes_at_least(0.3), True),
    )


@query(
    "hairlines_exact",
    """select o_orderkey as doc_id, coalesce(bool_or(l_tax = 0), false) as zero_width from orders
       left join lineitem on l_orderkey = o_orderkey group by o_orderkey""",
)
def hairlines_exact(spark, d):
    strokes = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_tax")
    return L.verdicts(_docs(spark, d), strokes, zero_width=(L.has_zero_stroke(F.col("l_tax")), False))


@query(
    "list_fonts",
    O.sql(
        "font",
        f"""select doc_id, string_agg(name, '{SEP}' order by seen_at) as fonts from
            (select doc_id, name, min(pos) as seen_at from font group by doc_id, name) group by doc_id""",
    ),
)
def list_fonts(spark, d):
    fonts = dealt(S.fonts(spark, d), S.table(spark, d, "lineitem"), "doc_id")
    listed = L.first_seen(fonts, "name", "pos", "fonts")
    return listed.withColumn("fonts", _joined("fonts"))


@query("font_embedding", _sql_verdicts("font", "font", {"ok": ("bool_and(embedded)", "true")}))
def font_embedding(spark, d):
    return L.verdicts(_docs(spark, d), S.fonts(spark, d), ok=(L.all_embedded(), True))


@query(
    "font_risks",
    _sql_verdicts(
        "font",
        "font",
        {
            "missing_glyphs": (_sql_list("name", "missing_widths"), "''"),
            "substituted": (_sql_list("name", "not embedded"), "''"),
            "subsets_ok": ("bool_and(not embedded or subset)", "true"),
            "licensing": (
                _sql_list(
                    "(name || ' (' || case when font_type = 'Type3' then 'Type3' else 'not embedded' end || ')')",
                    "font_type = 'Type3' or not embedded",
                ),
                "''",
            ),
        },
    ),
)
def font_risks(spark, d):
    return L.verdicts(
        _docs(spark, d),
        S.fonts(spark, d),
        missing_glyphs=(_joined(L.fonts_where(F.col("missing_widths"))), ""),
        substituted=(_joined(L.fonts_where(~F.col("embedded"))), ""),
        subsets_ok=(L.embedded_are_subsets(), True),
        licensing=(_joined(L.licensing_risks()), ""),
    )


@query(
    "font_size_min",
    """select o_orderkey as doc_id, coalesce(bool_and(l_quantity >= 6), true) as ok from orders
       left join lineitem on l_orderkey = o_orderkey group by o_orderkey""",
)
def font_size_min(spark, d):
    sizes = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("size"))
    return L.verdicts(_docs(spark, d), sizes, ok=(L.sizes_at_least(), True))


# ---- boxes ----


@query("page_size", O.sql("box", "select doc_id, page_no, '595,842' as size from box"))
def page_size(spark, d):
    size = F.array_join(F.transform(F.array("width", "height"), L.printed), ",")
    return S.boxes(spark, d, numbered=True).select("doc_id", "page_no", size.alias("size"))


def _sql_box_line(label: str, name: str) -> str:
    shown = "list_transform({0}, lambda v: case when v = floor(v) then floor(v)::bigint::varchar else v::varchar end)".format(name)
    return f"case when {name} is not null then ['{label}: [' || array_to_string({shown}, ', ') || ']'] else [] end"


@query(
    "page_boxes",
    O.sql(
        "box",
        f"""select doc_id, page_no, array_to_string({_sql_box_line('MediaBox', 'media')} || {_sql_box_line('TrimBox', 'trim_box')}
            || {_sql_box_line('BleedBox', 'bleed')}, '{SEP}') as boxes from box""",
    ),
)
def page_boxes(spark, d):
    return S.boxes(spark, d, numbered=True).select("doc_id", "page_no", _joined(L.page_boxes()).alias("boxes"))


@query(
    "box_presence",
    _sql_verdicts(
        "box",
        "box",
        {
            "media": ("bool_and(media is not null)", "true"),
            "trim_ok": ("bool_and(trim_box is not null)", "true"),
            "bleed_ok": ("bool_and(bleed is not null)", "true"),
        },
    ),
)
def box_presence(spark, d):
    return L.verdicts(
        _docs(spark, d),
        S.boxes(spark, d),
        media=(L.boxes_present("media"), True),
        trim_ok=(L.boxes_present("trim"), True),
        bleed_ok=(L.boxes_present("bleed"), True),
    )


@query(
    "page_geometry",
    _sql_verdicts(
        "box",
        "box",
        {
            "ok": (
                """bool_and(coalesce(trim_box[1] - bleed[1] >= 4 - 0.01 and trim_box[2] - bleed[2] >= 4 - 0.01
                   and bleed[3] - trim_box[3] >= 4 - 0.01 and bleed[4] - trim_box[4] >= 4 - 0.01, false))""",
                "true",
            )
        },
    ),
)
def page_geometry(spark, d):
    return L.verdicts(_docs(spark, d), S.boxes(spark, d), ok=(L.bleed_clears_trim(4.0), True))


# ---- colour spaces and output settings ----


@query(
    "color_mode",
    _sql_verdicts(
        "img",
        "img",
        {
            "mode": (
                """case when bool_or(contains(color_space, 'RGB')) and bool_or(contains(color_space, 'CMYK')) then 'Mixed'
                   when bool_or(contains(color_space, 'RGB')) then 'RGB' when bool_or(contains(color_space, 'CMYK')) then 'CMYK'
                   else 'Other' end""",
                "'None'",
            )
        },
    ),
)
def color_mode(spark, d):
    return L.verdicts(_docs(spark, d), S.images(spark, d), mode=(L.color_mode(), "None"))


@query("validate_color_space", _sql_verdicts("img", "img", {"ok": ("bool_and(color_space = 'DeviceCMYK')", "true")}))
def validate_color_space(spark, d):
    return L.verdicts(_docs(spark, d), S.images(spark, d), ok=(L.all_in_space("DeviceCMYK"), True))


_SQL_SETTINGS = """select l_orderkey as doc_id, pos, l_tax > 0.07 as overprint,
    case when l_discount = 0 then 'Coated FOGRA' || (l_suppkey % 3 + 38) end as output_intent,
    case when l_linenumber % 2 = 1 then case l_returnflag when 'A' then 'Perceptual' when 'N' then 'RelativeColorimetric'
    else 'Saturation' end end as rendering_intent from li"""


def _settings(spark, d):
    flag = F.col("l_returnflag")
    intent = F.when(flag == "A", "Perceptual").when(flag == "N", "RelativeColorimetric").otherwise("Saturation")
    return S.numbered_lines(spark, d).select(
        F.col("l_orderkey").alias("doc_id"), "pos", (F.col("l_tax") > 0.07).alias("overprint"),
        F.when(F.col("l_discount") == 0, F.concat(F.lit("Coated FOGRA"), (F.col("l_suppkey") % 3 + 38).cast("string"))).alias(
            "output_intent"
        ),
        F.when(F.col("l_linenumber") % 2 == 1, intent).alias("rendering_intent"),
    )


@query(
    "overprint_intents",
    O.sql(
        "li",
        f"""select a.*, coalesce(intents, '') as intents from
            (select doc_id, not bool_or(overprint) as overprint_ok, max(output_intent) is not null as has_intent,
             coalesce(contains(max(output_intent), 'FOGRA39'), false) as intent_ok,
             coalesce(bool_and(rendering_intent = 'Perceptual'), true) as rendering_ok from settings group by doc_id) a
            left join (select doc_id, string_agg(rendering_intent, '{SEP}' order by seen_at) as intents from
              (select doc_id, rendering_intent, min(pos) as seen_at from settings where rendering_intent is not null
               group by doc_id, rendering_intent) group by doc_id) b on a.doc_id = b.doc_id""",
        settings=_SQL_SETTINGS,
    ),
)
def overprint_intents(spark, d):
    settings = _settings(spark, d)
    flags = L.verdicts(
        None,
        settings,
        overprint_ok=(L.overprint_off(), True),
        has_intent=(L.output_intent(), False),
        intent_ok=(L.output_intent("FOGRA39"), False),
        rendering_ok=(L.intents_are("Perceptual"), True),
    )
    listed = L.first_seen(settings.filter(F.col("rendering_intent").isNotNull()), "rendering_intent", "pos", "intents")
    return flags.join(listed, "doc_id", "left").withColumn("intents", F.coalesce(_joined("intents"), F.lit("")))
