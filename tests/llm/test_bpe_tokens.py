import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from daytrace.llm import bpe, token_counts  # noqa: E402
from daytrace.llm.queries import QUERIES  # noqa: E402
from daytrace.llm.segments import segments  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")
BITS = ["a", "aa", "ab ", "  ", " ", "\n", "\t", "é", "日本", "'s", "'ll", " 12", "3", "!!", "<|endoftext|>", "x" * 50, "😀", "\r\n", "the", " of", "\x1c", "　", "ab" * 40, "\x85", "0" * 30]


@pytest.fixture(scope="module")
def plain():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(PATH, P.PATTERN).ranks, special_tokens={})


def drawn(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 60))) * rng.choice([1, 1, 1, 30]) for _ in range(n)]


def test_ids_equal_the_library_and_decode_again(plain):
    own = bpe.codec(PATH, P.PATTERN)
    for text in [*drawn(600), "a" * 5000, " " * 5000, "ab" * 4000, "日" * 3000, "\n" * 2000 + "x", ""]:
        ids = own.encode(text)
        assert ids == np.array(plain.encode_ordinary(text), "<u4").tobytes(), repr(text[:60])
        assert own.decode(ids) == text.encode()


def test_every_token_is_its_own_encoding():
    own = bpe.codec(PATH, P.PATTERN)
    assert all(own.merge(t) == [r] for t, r in list(own.ranks.items())[::17])


def test_heap_merging_equals_plain_merging():
    own = bpe.codec(PATH, P.PATTERN)
    rng = random.Random(3)
    for _ in range(200):
        piece = bytes(rng.choices(b"abcth e", k=rng.randint(1, bpe.HEAP_BYTES)))
        assert own._merge_by_heap(piece) == own.merge(piece)


def test_segments_join_to_the_text():
    for text in drawn(300, 8):
        assert " ".join(segments(text)) == text


def test_columns_keep_nulls_and_read_back(spark):
    df = spark.createDataFrame([(1, "the cat"), (1, "the cat"), (None, None), (2, "")], "doc_id long, text string")
    got = df.select("doc_id", bpe.encode_column("text", PATH, P.PATTERN).alias("ids")).select("doc_id", "ids", bpe.decode_column("ids", PATH, P.PATTERN).alias("b"))
    rows = sorted([(r.doc_id, None if r.b is None else bytes(r.b)) for r in got.collect()], key=str)
    assert rows == sorted([(1, b"the cat"), (1, b"the cat"), (None, None), (2, b"")], key=str)


def test_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*drawn(300, 9), "", None, "word " * 5000]
    want = [None if t is None else len(own.encode(t, add_special_tokens=False)) for t in texts]
    assert token_counts.counter(P.path("byte_bpe_50k.json")).count(texts) == want
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    got = dict(df.select("i", token_counts.count_column("text", P.path("byte_bpe_50k.json"))).collect())
    assert [got[i] for i in range(len(texts))] == want


def test_count_of_long_texts_in_portions(monkeypatch):
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 64)
    own = token_counts.Counter(P.path("byte_bpe_50k.json"))
    texts = ["one two three " * 40, "x", None, "four\nfive  six " * 9]
    assert own.count(texts) == [None if t is None else len(own.tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def test_registered_queries_match_the_libraries(spark, plain):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op1_byte_bpe"](spark, sf).collect():
        ids = np.array(plain.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert QUERIES["op5_token_counts"](spark, sf).where(F.col("over_limit") != (F.col("n_tokens") > 1024)).count() == 0


def test_rank_file_is_read_as_ranks():
    with open(PATH, "rb") as f:
        token, rank = f.readline().split()
    assert bpe.codec(PATH, P.PATTERN).ranks[base64.b64decode(token)] == int(rank)


def test_one_pass_gives_both_columns(spark):
    texts = [None, "", "Some words", "Ünder  the tree", "a" * 3000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.c for r in df.select("doc_id", bpe.coded_column("text", PATH, P.PATTERN).alias("c")).collect()}
    own = bpe.codec(PATH, P.PATTERN)
    assert got[0].ids is None and got[0].decoded is None
    assert all(bytes(got[i].ids) == own.encode(t) and bytes(got[i].decoded) == t.encode() for i, t in enumerate(texts) if t is not None)


def test_a_full_cache_keeps_what_is_asked_for_again():
    made = []
    kept = bpe._Kept(lambda k: made.append(k) or k.upper(), most=3)
    for key in ["a", "b", "c", "a", "d", "a", "e", "f", "a", "g"]:
        assert kept[key] == key.upper()
    assert made.count("a") == 1 and len(kept) <= 3 and len(kept.older) <= 3
