import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_minimal_perfect_hash_finds_every_entry_and_nothing_else():
    assert len(CODEC.table.keys) == len(RANKS) and None not in CODEC.table.keys
    assert all(CODEC.table.find(k) == v for k, v in RANKS.items())
    assert CODEC.table.find(b"no such entry at all") is None
    assert bpe.MinimalPerfectHash({b"a": 1}).find(b"a") == 1 and bpe.MinimalPerfectHash({}).find(b"a") is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_ids_match_a_known_encoder_and_decode(text):
    ids = CODEC.encode(text).tolist()
    assert CODEC.decode(ids) == text.encode()
    assert ids == KNOWN.encode_ordinary(text)


def test_every_code_point_is_classed_as_by_the_known_encoder():
    """Between a letter, a number and a mark, each code point of any plane joins the same run; surrogates cannot be encoded."""
    for base in range(0, 0x110000, 0x400):
        chars = [chr(c) for c in range(base, base + 0x400) if not 0xD800 <= c <= 0xDFFF]
        text = "".join(f"a{c}1{c}!{c}b " for c in chars)
        assert CODEC.encode(text).tolist() == KNOWN.encode_ordinary(text), hex(base)


def test_newer_letters_are_told_apart():
    newer = [chr(c) for a, b in bpe.NEWER_LETTERS + bpe.NEWER_NUMBERS for c in {a, b}]
    for c in newer:
        text = f"word{c}word {c}{c} 12{c}3"
        assert CODEC.encode(text).tolist() == KNOWN.encode_ordinary(text)


def test_long_and_odd_pieces():
    rng = random.Random(3)
    for text in ("a" * 50_000, "ab" * 999, "\n" * 300 + "x", " " * 77, "don't we'll", "".join(rng.choice("aé漢 \n'1") for _ in range(5000))):
        assert CODEC.encode(text).tolist() == KNOWN.encode_ordinary(text)


def test_operator_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").withColumn("ids", F.lit("clash"))
    docs = docs.unionByName(spark.createDataFrame([(None, None, "x"), (-1, "", "x"), (-1, "", "x")], "doc_id long, text string, ids string"))
    out = bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).withColumn("sha", bpe.ids_digest()).collect()
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    got = sorted(((r.doc_id, bytes(r.decoded).decode()) for r in out), key=str)
    assert got == texts
    for r in out:
        want = KNOWN.encode_ordinary(bytes(r.decoded).decode())
        assert list(r.ids) == want and r.sha == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).count() == 0
