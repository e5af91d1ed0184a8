"""Spans against plain regular expressions, and trigram queries against their patterns."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quirecheck.llm import secrets
from quirecheck.llm.queries import ORACLES, op5_secrets
from tests.support import compare, session

SF_DIR = "/root/testdata/sf0.01"
KINDS = ["assign", "access", "hex"]


def plain_base(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_base(texts[r["doc_id"]])
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in KINDS] == want
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w.startswith(k + ":") for w in want) for k in KINDS]


def test_query():
    spark = session()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op5_secrets(spark, SF_DIR).collect()
    check(rows, texts)
    assert sum(r["n_assign"] for r in rows)


def test_odd_texts(tmp_path):
    spark, rng = session(), random.Random(8)
    pieces = ["password", "TOKEN", "Api_Key", "apikey", "secret", "=", ": ", '"', "'", "abcdefgh", "x1", "AKIA", "ABCD1234EFGH", "é", "𝒳", "\n", " ", "0123456789abcdef", "ghp_" + "a" * 36, "ı", "K"]
    texts = {i: "".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for i in range(400)}
    texts |= {900: None, 901: "", 902: "token=" + "a" * 300_000, 903: "é " * 50_000 + "AKIA" + "Z" * 20, 904: "ab" * 100_000, 905: "secret : " * 3000 + "token=x" * 500, 906: "=".join(["password"] * 4000)}
    spark.createDataFrame([(i, t, [1]) for i, t in texts.items()], "doc_id long, text string, spans array<int>").write.parquet(f"{tmp_path}/documents.parquet")
    check(op5_secrets(spark, str(tmp_path)).collect(), texts)


def test_repeated_and_null_ids():
    spark = session()
    df = spark.createDataFrame([(1, "token=abcdefgh"), (1, "token=abcdefgh"), (1, "none"), (None, "AKIA" + "Q" * 16), (None, None)], "doc_id long, text string")
    rows = sorted((repr(r["doc_id"]), [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in secrets.find_secrets(df).collect())
    assert rows == [("1", []), ("1", [("assign", 0, 14)]), ("1", [("assign", 0, 14)]), ("None", []), ("None", [("access", 0, 20)])]
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_redaction():
    spark = session()
    df = spark.createDataFrame([("é token=" + "a" * 40 + " end",), (None,), ("clean",)], "text string").withColumn("doc_id", F.lit(1))
    out = secrets.find_secrets(df).select(secrets.redacted(F.coalesce("text", F.lit("")), F.col("spans")).alias("t")).collect()
    assert sorted(r["t"] for r in out) == ["", "clean", "é [SECRET] end"]


def test_no_part_of_a_private_key_is_left(tmp_path):
    spark, rng = session(), random.Random(9)
    lines = ["".join(rng.choice("QRSTUVWXYZ+/0123456789") for _ in range(64)) for _ in range(400)]
    body = "\n".join(lines) + "\n"
    coded = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,7A01B2C3D4E5F60718293A4B5C6D7E8F\n\n"
    head, end = "-----BEGIN {}PRIVATE KEY-----", "-----END {}PRIVATE KEY-----"
    keys = [head.format(k) + "\n" + c + b + e for k in ("", "RSA ") for c in ("", coded) for b in (body, body.replace("\n", "\\n"), body[:-9] + "==\n") for e in (end.format(k), "")]
    texts = {i: f"see é-below: {k}" + (" and-after" if "END" in k else "") for i, k in enumerate(keys)}
    texts[900] = f"{keys[0]}\nbetween-keys\n{keys[0]}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: r["t"] for r in secrets.find_secrets(df).select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out == {i: "see é-below: [SECRET]" + (" and-after" if "END" in k else "") for i, k in enumerate(keys)} | {900: "[SECRET]\nbetween-keys\n[SECRET]"}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(op5_secrets(spark, str(tmp_path)), con, ORACLES["op5_secrets"])[0] == ""


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_every_match_satisfies_its_query(rule):
    examples = {
        "assign": ['PassWord" = abcdefgh1', "api_key:zzzzzzzzz", "APIKEY=zzzzzzzzz", "secret:'12345678"], "access": ["AKIA" + "A1" * 8], "hex": ["ab" * 20],
        "private_key": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"], "github": ["ghs_" + "x" * 36], "slack": ["xoxb-" + "1-a" * 5],
        "google": ["AIza" + "x" * 35], "signed_token": ["eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9],
    }[rule.kind]
    query = secrets.trigram_query(rule.pattern)
    assert bool(query) == (rule.kind != "hex")
    for text in examples:
        assert re.search(rule.pattern, text)
        grams = {text.lower()[i : i + 3] for i in range(len(text) - 2)}
        assert not query or any(c <= grams for c in query)


def test_text_after_a_key_header_stays(tmp_path):
    spark = session()
    head, line = "-----BEGIN PRIVATE KEY-----", "Q" * 64
    prose = ["\nThis line only tells of a key. It has words, and so it stays\n", " and then the text goes on for a long while without a single mark or number " * 20, "\nX-a: b" * 200_000, "\nComment: x" * 200_000 + "\nprose stays here", f"\n{line}\nthen prose - more", f"\n{line}\nshort\nthen prose", "\n" + f"{line}\n" * 200_000 + "short=="]
    left = prose[:3] + ["\nprose stays here", "\nthen prose - more", "then prose", ""]
    df = spark.createDataFrame([(i, head + p) for i, p in enumerate(prose)], "doc_id long, text string")
    out = {r["doc_id"]: r["t"] for r in secrets.find_secrets(df).select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out == {i: "[SECRET]" + t for i, t in enumerate(left)}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(op5_secrets(spark, str(tmp_path)), con, ORACLES["op5_secrets"])[0] == ""
