"""Ids against the tokenizer library, and exact round trips."""

import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from quirecheck.llm import bpe
from quirecheck.llm.queries import op3_bpe
from tests.support import session

SF_DIR = "/root/testdata/sf0.001"
WORDS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={w: i for i, w in enumerate(WORDS)}, special_tokens={})
TEXTS = [
    None, "", " ", "a", "naïve café, 東京 2024!\n\n  don't", "x" * 3000, "ab" * 2000, "é" * 1500, "　 \t\r\n ", "<|endoftext|>",
    "".join(random.Random(5).choice("aAbtheing ñß漢字🙂0123\n'") for _ in range(4000)), "the " * 500, "1" * 777 + "!" * 999,
]


def test_encoder_matches_library():
    encoder = bpe.Encoder(WORDS, public_tokenizers.PATTERN)
    for text in TEXTS:
        assert encoder.encode(text or "").tolist() == LIBRARY.encode_ordinary(text or "")


def test_long_pre_token_is_near_linear():
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(200_000))
    assert bpe.Encoder(WORDS, public_tokenizers.PATTERN).encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_the_queue_is_empty_again():
    encoder = bpe.Encoder(WORDS, public_tokenizers.PATTERN)
    for text in TEXTS:
        encoder.encode(text or "")
        assert not any(encoder.low)


def test_round_trip_keeps_rows_and_columns():
    spark = session()
    df = spark.createDataFrame([(i, t, i * 2, "old") for i, t in enumerate(TEXTS)] + [(1, "", 2, "old")], "doc_id int, text string, t int, ids string")
    out = bpe.decode(bpe.encode(df, WORDS, public_tokenizers.PATTERN), WORDS)
    assert out.columns == ["doc_id", "t", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        assert bytes(r["decoded"]) == text.encode() and r["ids"] == LIBRARY.encode_ordinary(text) and r["t"] == 2 * r["doc_id"]
    both = bpe.encode(df, WORDS, public_tokenizers.PATTERN, decoded_col="decoded")
    assert both.columns == out.columns and sorted(map(str, both.collect())) == sorted(map(str, rows))
    assert bpe.encode(df.limit(0), WORDS, public_tokenizers.PATTERN).count() == 0
    assert bpe.decode(out.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), WORDS).where("decoded is not null").count() == 0


def test_query():
    spark = session()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op3_bpe(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
