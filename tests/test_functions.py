"""Literal cases of the Column functions."""

import calendar
import random

import pytest
from pyspark.sql import functions as F

from quirecheck.functions import color, geometry, raster as X, text as T, validators as V, values
from tests.support import session


@pytest.fixture(scope="module")
def spark():
    return session()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def on_strings(spark, function, cases):
    rows = spark.createDataFrame([(s,) for s in cases], "s string").select("s", function(F.col("s")).alias("v")).collect()
    assert {r.s: r.v for r in rows} == cases


def test_text(spark):
    on_strings(spark, T.normalize, {s: " ".join(s.lower().split()) for s in ("\tÉtude  No. 7\r\n in C ", "", "x", " \n", "A\u00a0b  C")})
    on_strings(spark, T.split_words, {"[Étude] no. 7; C-sharp?": ["Étude", "no", "7", "C-sharp"], "--- !!": [], "naïve, ação.": ["naïve", "ação"]})
    on_strings(spark, T.split_sentences, {"One. Two!  Three?": ["One", "Two", "Three?"], "": []})
    on_strings(spark, T.split_paragraphs, {"a\n \nb\nc": ["a", "b\nc"]})
    on_strings(
        spark,
        T.detect_language,
        {
            "isso não é uma coisa para os dois": "pt",
            "the cat is in the house and it was for that": "en",
            "el perro y la casa por las calles del pueblo": "es",
            "xyzzy plugh": "unknown",
            "que para": "pt",
        },
    )
    found = value(spark, T.personal_data(F.lit("529.982.247-25 529.982.247-26 11.222.333/0001-81 a.b@c.org. (11) 91234-5678")))
    assert [(p.label, p.value) for p in found] == [
        ("CPF", "529.982.247-25"), ("CNPJ", "11.222.333/0001-81"), ("E-mail", "a.b@c.org."), ("Phone", "(11) 91234-5678"),
    ]
    assert value(spark, T.line_diff(F.lit("a\nb\nb"), F.lit("a\nc"))) == ["-b", "-b", "+c"]
    assert value(spark, T.matches_whole(F.lit("abc\n"), "abc|d")) is False


def test_fuzzy_is_one_minus_distance_over_length(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(12)
    pairs = [("".join(rng.choice("ab é") for _ in range(rng.randrange(9))), "".join(rng.choice("ab é") for _ in range(rng.randrange(9)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", T.fuzzy_match(F.col("a"), F.col("b")).alias("v")).collect():
        a, b = (" ".join(x.lower().split()) for x in (r.a, r.b))
        assert r.v == pytest.approx(1 - distance(a, b) / max(len(a), len(b), 1)), (r.a, r.b)


def weighted(digits, weights):
    """A check digit modulo eleven."""
    rest = sum(d * w for d, w in zip(digits, weights)) % 11
    return 0 if rest < 2 else 11 - rest


def completed(rng, length):
    """Random digits with their two check digits: weights rise from the right, for the longer number up to nine."""
    digits = [rng.randrange(10) for _ in range(length)]
    for _ in range(2):
        places = range(2, len(digits) + 2)
        weights = [w if length == 9 else (w - 2) % 8 + 2 for w in places][::-1]
        digits.append(weighted(digits, weights))
    return "".join(map(str, digits))


@pytest.mark.parametrize("valid, length", [(V.cpf_valid, 9), (V.cnpj_valid, 12)])
def test_two_check_digits(spark, valid, length):
    rng = random.Random(length)
    good = [completed(rng, length) for _ in range(20)]
    cases = {g: True for g in good} | {g[:3] + "." + g[3:-2] + "-" + g[-2:]: True for g in good}
    cases |= {g[:-1] + str((int(g[-1]) + 1) % 10): False for g in good} | {g[1:]: False for g in good}
    on_strings(spark, valid, cases | {str(d) * (length + 2): False for d in range(10)} | {"": False})


def test_article_numbers(spark):
    rng = random.Random(4)
    cases = {"": False, "12345": False, "1234567890AB5": False}
    for length in (7, 11, 12, 13):
        for _ in range(8):
            body = [rng.randrange(10) for _ in range(length)]
            check = -sum(d * (3 if i % 2 == 0 else 1) for i, d in enumerate(reversed(body))) % 10
            number = "".join(map(str, body))
            cases |= {f"{number}{check}": True, f"{number}{(check + 3) % 10}": False}
    on_strings(spark, V.gtin_valid, cases)


def test_phones(spark):
    on_strings(spark, V.phone_valid, {"(21) 99876-0001": True, "2133445566": True, "44": False, "21998760001234": False})


def test_dates(spark):
    on_strings(
        spark, V.date_valid,
        {f"{d:02}/{m:02}/{y}": d <= calendar.monthrange(y, m)[1] for d in (28, 29, 30, 31) for m in range(1, 13) for y in (1900, 1996, 2000, 2021)}
        | {"1997-03-09": True, "n/a": False, "00/05/2011": False, "1/1/0000": False},
    )
    assert value(spark, V.date_valid(F.lit("2026-08-02"), V.DAY_FIRST)) is False
    with pytest.raises(ValueError):
        V.date_valid(F.lit("x"), "mm/dd")
    on_strings(
        spark, V.pdf_date,
        {"D:20260802173622-03'00'": "2026-08-02 17:36:22", "D:20260802": "2026-08-02 00:00:00", "": "", "yesterday": "yesterday", "D:202608021": "2026-08-02 00:00:00"},
    )


def test_values(spark):
    assert value(spark, values.half_away(F.lit(2.5))) == 3 and value(spark, values.half_away(F.lit(-2.5))) == -3
    assert value(spark, values.to_points(F.lit("3mm"))) == pytest.approx(8.503937)
    assert value(spark, values.to_points(F.lit("300%"))) == 300.0
    assert value(spark, values.unit_error(F.lit("3ell"))).startswith("unknown unit: 'ell'")
    assert value(spark, values.divide_exact(F.lit(6), F.lit(3))) == 2 and value(spark, values.divide_exact(F.lit(7), F.lit(3))) is None
    assert value(spark, values.divide(F.lit(1), F.lit(0))) is None
    assert value(spark, values.list_join(F.array(F.lit("a"), F.lit(None)))) == "a, null"
    assert value(spark, values.logical_and(F.lit(0.0), F.lit(5.0), boolean=False)) == 5.0
    zone = geometry.region(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))
    assert value(spark, geometry.contains_point(zone, F.lit(10.0), F.lit(10.0))) is True
    touching = geometry.region(F.lit(10.0), F.lit(0.0), F.lit(5.0), F.lit(5.0))
    assert value(spark, geometry.intersects(zone, touching)) is False
    assert value(spark, geometry.inset(zone, F.lit(5.0))) is None
    assert value(spark, geometry.region(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) is None


def test_color(spark):
    black = [F.lit(0.0)] * 3
    assert value(spark, color.tac_rgb(*black)) == 100.0
    white, dark = color.lab(*[F.lit(1.0)] * 3), color.lab(*black)
    assert value(spark, color.delta_e(white, dark)) == pytest.approx(100, abs=0.1)
    assert value(spark, color.delta_e(white, white)) == 0.0


def raster(spark, w, h, pixel):
    rows = [(w, h, [pixel(x, y) for y in range(h) for x in range(w)])]
    return spark.createDataFrame(rows, "w int, h int, px array<int>")


def test_rasters(spark):
    px, w, h = F.col("px"), F.col("w"), F.col("h")
    smooth = raster(spark, 64, 64, lambda x, y: x * 4 % 256)
    stepped = raster(spark, 64, 64, lambda x, y: x // 8 * 32)
    flat = raster(spark, 64, 64, lambda x, y: 200)

    def check(df, column):
        return df.select(column.alias("v")).first().v

    assert check(stepped, X.is_banded(px, w, h)) is True and check(smooth, X.is_banded(px, w, h)) is False
    assert check(stepped, X.is_posterized(px)) is True and check(flat, X.is_posterized(px)) is False
    assert check(flat, X.blockiness(px, w, h)) == 1.0 and check(stepped, X.blockiness(px, w, h)) > 1.6
    assert check(flat, X.ssim(px, px)) == pytest.approx(1.0)
    assert check(flat, X.hash_hex(X.hash_bits(X.low_frequencies(px, w, h)))) == "0000000000000001"
    assert check(smooth, X.blur(px, w, h, 1))[1] == 4
    assert check(raster(spark, 3, 1, lambda x, y: x * 9), X.blur(px, w, h, 1)) == [3, 9, 15]
    moved = raster(spark, 32, 32, lambda x, y: 0 if 8 <= x < 16 and 8 <= y < 16 else 255).withColumnsRenamed({"px": "px_a"})
    other = raster(spark, 32, 32, lambda x, y: 0 if 12 <= x < 20 and 10 <= y < 18 else 255).select(F.col("px").alias("px_b"))
    from quirecheck.operators.raster import best_offset

    shift = best_offset(moved.join(other), coarse=4, fine=1, max_offset=8).first()["shift"]
    assert (shift.dx, shift.dy) == (-4, -2)
    blocks = X.changed_blocks(F.array(*[F.lit(int(i in (0, 9))).cast("tinyint") for i in range(10)]), F.lit(5), 4)
    assert value(spark, blocks) == [0, 1]
    assert tuple(value(spark, X.block_region(F.lit(1), F.lit(5), F.lit(2), 4))) == (4, 0, 1, 2)
    black, white = (F.array(F.struct(*[F.lit(v).alias(c) for c in "rgb"])) for v in (0, 255))
    one = F.lit(1)
    assert value(spark, F.transform(X.changes(black, one, one, white, one, one), X.class_name)) == ["removed"]
