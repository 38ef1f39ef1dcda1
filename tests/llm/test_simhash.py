import random
import re

import numpy as np
import pytest
import xxhash

from daytrace.llm import simhash
from daytrace.llm.queries import QUERIES


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(rows):
    """component ids of (id, fingerprint) rows by looking at all pairs"""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[find(k)] = min(first.get(find(k), i), i)
    return [first.get(find(k)) for k in range(len(rows))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "Ünder  the\x0bÄpfel\x0ctree x y", "a b c d e f " * 30, "x" * 5000])
def test_fingerprint_equals_the_plain_count(text):
    assert simhash.fingerprint((text or "").encode()) % (1 << 64) == plain(text)


def test_fingerprint_over_many_spans(monkeypatch):
    text = " ".join(random.Random(5).choices("red green blue Grey".split(), k=500))
    want = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_SPAN", 7)
    assert simhash.fingerprint(text.encode()) == want and want % (1 << 64) == plain(text)


def test_any_two_bits_share_a_variant():
    masks = [m % (1 << 64) for m, _ in simhash.one_wildcard(0, 64)]
    for a in range(64):
        for b in range(a + 1):
            assert any(m >> a & 1 == 0 and m >> b & 1 == 0 for m in masks)


def bits(rng, base, n):
    return base ^ sum(1 << b for b in rng.sample(range(64), n))


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("bucket", [2048, 6, 1])
@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_links_equal_all_pairs(spark, bucket, broadcast):
    rng = random.Random(bucket)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):  # chains that run away from their start, and crowds that share a half
        now = rng.getrandbits(64)
        for _ in range(12):
            prints.add(now)
            now = bits(rng, now, rng.choice([1, 2, 2, 3]))
        prints |= {now ^ rng.getrandbits(5) << 40 for _ in range(20)}
    prints |= {rng.getrandbits(64) for _ in range(40)}
    rows = sorted((signed(p), p) for p in prints)
    df = spark.createDataFrame([(s,) for s, _ in rows], "fp long")
    ties = [(r.i, r.j) for r in simhash.links(df, bucket, broadcast).collect()]
    root = {s: s for s, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in ties:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    assert [find(s) for s, _ in rows] == reach(rows)


def test_third_level_is_bounded():
    masks = [0]
    start, width = 0, 64
    for _ in range(simhash.LEVELS):
        mask, rest = simhash.one_wildcard(start, width)[0]
        masks.append(masks[-1] | mask % (1 << 64))
        start, width = rest, width // 2
    assert 2 ** (64 - masks[-1].bit_count()) <= simhash.BUCKET


def test_odd_rows(spark):
    texts = [(3, "a b c d"), (1, "A B  C\nD"), (1, None), (2, ""), (None, "quite another text with words"), (None, " "), (9, "w " * 40_000), (5, None)]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in texts], "doc_id long, text string, fp int, component string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint % (1 << 64), r.component_id) for r in simhash.components(df).collect()), key=repr)
    prints = [(i, plain(t)) for i, t in texts]
    want = sorted(((i is None, i or 0, p, c) for (i, p), c in zip(prints, reach(prints))), key=repr)
    assert got == want


def test_empty_table(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op13_simhash"](spark, sf).collect()}
    assert got == {d: (f"{p:016x}", c) for (d, p), c in zip(docs, reach(docs))}


def test_roots_of_a_path_are_one():
    path = np.array([-(1 << 63), -(1 << 63) + 1, 1, 0b111, 0b1111111], np.int64)
    assert simhash.roots(path).tolist() == [0, 0, 0, 0, 4]
