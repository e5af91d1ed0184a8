"""SQL twins of the stand-in tables, composed into oracle queries as common table expressions."""

from __future__ import annotations

_GTIN = "(789000000000 + p_partkey * 37)::varchar"
_WEIGHTED = " + ".join(f"substr({_GTIN}, {i}, 1)::int * {1 if i % 2 else 3}" for i in range(1, 13))
_RIGHT = f"((10 - ({_WEIGHTED}) % 10) % 10)"
_GTIN13 = (
    f"{_GTIN} || (case when p_partkey % 2 = 0 then {_RIGHT} else ({_RIGHT} + 1) % 10 end)::varchar"
)

# Unicode white space spelled out, since the SQL engine's \s is ASCII only.
WS = (
    r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
ALNUM = r"\p{L}\p{M}\p{N}"
WORD = r"\p{L}\p{M}\p{Nd}\p{Pc}"


def norm(expr: str) -> str:
    return f"lower(trim(regexp_replace({expr}, '{WS}+', ' ', 'g')))"


def strip_ws(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def words(expr: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex({expr}, '{WS}+'), lambda w: "
        f"regexp_replace(w, '^[^{ALNUM}]+|[^{ALNUM}]+$', '', 'g')), lambda w: w <> '')"
    )


def tokens(expr: str) -> str:
    """Plain white-space tokens."""
    return f"list_filter(string_split_regex({expr}, '{WS}+'), lambda w: w <> '')"


def lines(expr: str) -> str:
    """Trimmed non-blank lines."""
    return f"list_filter(list_transform(string_split({expr}, chr(10)), lambda w: {strip_ws('w')}), lambda w: w <> '')"


_BOX_OFFSET = "(10.0 - l_discount * 200)"


def _box(offset: str) -> str:
    return f"[{offset}, {offset}, 595.0 - {offset}, 842.0 - {offset}]"


_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "li": (
        (),
        """select *, row_number() over (partition by l_orderkey
           order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as pos from lineitem""",
    ),
    "img": (
        ("li",),
        """select l_orderkey as doc_id, pos as page_no, (l_quantity*24)::bigint as width,
           (l_quantity*32)::bigint as height, 50 + l_quantity*10 as dpi_x, 60 + l_quantity*9 as dpi_y,
           case l_returnflag when 'A' then 'DeviceRGB' when 'N' then 'DeviceCMYK' else 'DeviceGray' end as color_space,
           l_discount*3000 as tac_max, l_tax*1000 as ink_avg,
           case when l_tax = 0 then null else l_tax*10 end as min_stroke_pt, l_linenumber from li""",
    ),
    "font": (
        ("li",),
        """select l_orderkey as doc_id, pos, p_brand as name, l_linestatus = 'F' as embedded,
           l_returnflag = 'N' as subset, case when p_size % 7 = 0 then 'Type3' else 'TrueType' end as font_type,
           p_size % 5 = 0 as missing_widths from li join part on l_partkey = p_partkey""",
    ),
    "box": (
        ("li",),
        f"""select l_orderkey as doc_id, pos as page_no, 595.0::double as width, 842.0::double as height,
           {_box('0.0')}::double[] as media,
           case when l_tax <> 0 then {_box('10.0')}::double[] end as trim_box,
           case when l_discount <> 0 then {_box(_BOX_OFFSET)}::double[] end as bleed from li""",
    ),
    "ink": (
        ("li",),
        """select l_orderkey as doc_id, pos as page_no,
           case l_returnflag when 'A' then 'rgb' when 'N' then 'cmyk' else 'spot' end as space,
           l_discount*10 as c, l_tax*10 as m, l_quantity/50 as y,
           case when l_linestatus = 'O' then 0.7::double else 0.2::double end as k,
           case when l_suppkey % 3 = 0 then 'All' else 'PANTONE ' || (l_suppkey % 9)::varchar end as spot from li""",
    ),
    "code": (
        (),
        f"""select p_partkey // 4 as doc_id, p_partkey as code_no, p_partkey % 7 + 1 as page_no,
           case p_size % 4 when 0 then 'QR_CODE' when 1 then 'CODE_128' else 'EAN_13' end as format,
           {_GTIN13} as text, p_size * 10.0::double as x, p_retailprice / 2 as y from part""",
    ),
    "ref": (
        (),
        f"""select 0::bigint as row_no, 'gtin' as c1, 'name' as c2, 'brand' as c3
           union all select p_partkey + 1, {_GTIN13}, p_name || ' ' || p_partkey::varchar, p_brand from part""",
    ),
    "page": (
        (),
        """select doc_id, i::bigint as page_no, l[i] as text from (select doc_id, string_split(text, chr(10)) l,
           unnest(range(1, len(string_split(text, chr(10))) + 1)) i from documents)""",
    ),
    "ver": (
        ("page",),
        """select doc_id, row_number() over (partition by doc_id order by page_no, k) as page_no, text from (
           select doc_id, page_no, 0 as k, case when (doc_id+page_no)%7=0 then 'CHANGED' || substr(text,
           case when instr(text,' ')=0 then length(text)+1 else instr(text,' ') end) else text end as text
           from page where (doc_id+page_no)%11 <> 0
           union all select doc_id, page_no, 1, 'INSERTED PAGE ' || page_no::varchar
           from page where (doc_id+page_no)%13=0) u""",
    ),
    "conv": ((), "select conv_id as doc_id, turn + 1 as page_no, text from conversations"),
    "meta": (
        (),
        r"""select page_id as doc_id, 0 as pos, 'Title' as key, regexp_extract(html, '<title>([^<]*)</title>', 1) as value from pages
           union all select page_id, 1, 'Lang', regexp_extract(html, 'lang="([^"]*)"', 1) from pages
           union all select page_id, 2, 'Charset', regexp_extract(html, 'charset="([^"]*)"', 1) from pages
           union all select page_id, 3, 'Keywords', '' from pages""",
    ),
    "gloss": (
        (),
        r"""select item_id as term_no, array_to_string(string_split(regexp_replace(text, '[\r\n]', '', 'g'), ' ')[1:2], ' ') as term
           from benchmark""",
    ),
    "pix": (
        (),
        """select page_id, i % 8 as x, i // 8 as y, least(255, greatest(0,
           floor((embedding[i+1]::double + 0.5) * 255)))::int as v
           from (select vec_id as page_id, embedding, unnest(range(64)) as i from embeddings)""",
    ),
    "rgb": (
        ("pix",),
        """select a.page_id, a.x, a.y, a.v as r, 255 - a.v as g, b.v as b from pix a join pix b
           on a.page_id = b.page_id and b.y * 8 + b.x = (a.y * 8 + a.x + 1) % 64""",
    ),
    "scan_a": (
        (),
        """select doc_id, (i % 96)::int as x, (i // 96)::int as y, case when v < 0 then 255 else v * 7 % 256 end as r, case when v < 0 then 255 else v * 13 % 256 end as g,
               case when v < 0 then 255 else v * 29 % 256 end as b
           from (select doc_id, unnest(vs) as v, unnest(range(len(vs))) as i from (
               select doc_id, list_concat(vs, list_transform(range((96 - len(vs) % 96) % 96), lambda k: -1)) as vs
               from (select doc_id, list_transform(regexp_extract_all(hex(text), '..'), lambda h: ('0x' || h)::int) as vs from documents where text is not null)))""",
    ),
    "scan_b": (
        ("scan_a",),
        """select doc_id, x, y, case when odd then 255 - r else r end as r, case when odd then 255 - g else g end as g, case when odd then 255 - b else b end as b
           from (select a.doc_id, a.x, a.y, (a.x * 31 + a.y * 17 + a.doc_id) % 97 = 0 as odd, coalesce(o.r, 255) as r, coalesce(o.g, 255) as g, coalesce(o.b, 255) as b
               from scan_a a left join scan_a o on o.doc_id = a.doc_id and o.x = a.x - 2 * (a.doc_id % 4) and o.y = a.y - 2 * (a.doc_id // 4 % 3))""",
    ),
    "arr": (
        (),
        """select event_id as seq, user_id::varchar as path, sha256(floor(value)::bigint::varchar) as sha256,
           case event_type when 'error' then 2 when 'purchase' then 1 else 0 end::bigint as exit, ts from events""",
    ),
    "edge": (
        (),
        """select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation
           union all select 'n' || c_nationkey, 'c' || c_custkey from customer
           union all select 'c' || o_custkey, 'o' || o_orderkey from orders""",
    ),
    "node": (
        (),
        """select 'r' || r_regionkey as node, r_regionkey::bigint as obj_id, 'Catalog' as kind, length(r_name)::bigint as size from region
           union all select 'n' || n_nationkey, n_nationkey, 'XRef', length(n_name) from nation
           union all select 'c' || c_custkey, c_custkey, 'Font', length(c_name) from customer
           union all select 'o' || o_orderkey, o_orderkey, 'Stream/Image', floor(o_totalprice)::bigint from orders""",
    ),
}


def sql(uses: str, body: str, recursive: bool = False, **extra: str) -> str:
    """``body`` preceded by the stand-ins named in ``uses`` and the extra expressions, in order."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name in ordered:
            return
        needs, text = _CTES[name]
        for need in needs:
            add(need)
        ordered[name] = text

    for name in uses.split():
        add(name)
    parts = [f"{n} as ({t})" for n, t in [*ordered.items(), *extra.items()]]
    head = "with recursive " if recursive else "with "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body
