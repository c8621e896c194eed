"""SimHash near duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomledger.llm import components, queries, simhash

SPACE = " \t\n\v\f\r"


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    runs = [words[k : k + 3] for k in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    h = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=3):
    root = {i: i for i in range(len(prints))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def texts():
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["É", "xé", "A"]
    out = [" ".join(r.choice(words) for _ in range(r.randint(1, 200))) for _ in range(60)]
    for k in range(60):  # near copies
        w = out[k % 12].split(" ")
        w[r.randrange(len(w))] = r.choice(words)
        out.append(r.choice(SPACE).join(w).upper())
    return [*out, None, "", " \n\t", "one", "One two", "one two three", "one two three", "x" * 70_000, out[0], out[0]]


def test_fingerprints_and_components(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(7)).withColumn("fingerprint", F.lit("x"))
    got = {r["id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(t) for _, t in rows]
    assert [got[i]["fingerprint"] & (2**64 - 1) for i, _ in rows] == prints
    assert [got[i]["component_id"] for i, _ in rows] == brute_components(prints)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (None, "q r s t u")], "doc_id long, text string")
    assert sorted((r["id"] or 0, r["component_id"]) for r in simhash.near_duplicates(again).collect() if r["component_id"]) == [(0, 1), (1, 1), (1, 1)]


def test_text_of_many_pieces(monkeypatch):
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 9))) for _ in range(500))
    want = brute_print(text)
    for size in (1, 2, 5, 7, 64, 1000):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.simhash(text.encode()) == want and simhash.simhash(b" a  b ") == brute_print("a b")


@pytest.mark.parametrize("radius", [1, 2, 3, 6])
def test_bit_slices(radius):
    r = random.Random(radius)
    near = [r.getrandbits(64) for _ in range(150)]
    near += [x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, radius + 2))) for x in near for _ in range(2)]
    prints = np.unique(np.array(near, dtype=np.uint64))
    want = {(i, j) for j in range(len(prints)) for i in range(j) if (int(prints[i]) ^ int(prints[j])).bit_count() <= radius}
    for tile in (40, 1 << 16):
        got = [(int(a), int(b)) for i, j in simhash.within(prints, radius, tile) for a, b in zip(i, j, strict=True)]
        assert set(got) == want and len(got) == len(want)


def test_dense_ball_is_dealt_again(spark):
    """Fingerprints round one centre, and chains: buckets over the limit go by further bits, no link is lost."""
    r = random.Random(2)
    centre = r.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))) for _ in range(400)} | {r.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fingerprint long")
    want = brute_components(prints)
    for block, most in ((4096, 16384), (100, 200)):
        root = {x["node"]: x["root"] for x in components.connected(simhash._links(nodes, 3, block, most)).collect()}
        of = [root.get(simhash._signed(p), simhash._signed(p)) for p in prints]
        assert len({*zip(of, want, strict=True)}) == len({*of}) == len({*want})


def test_hubs_of_components(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 5)
    r = random.Random(4)
    edges = [(500 - 7 * (k % 2), k) for k in range(300)] + [(r.randrange(400, 900), r.randrange(400, 900)) for _ in range(120)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    prints = [brute_print(t) for _, t in rows]
    want = {i: (f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, brute_components(prints), strict=True)}
    assert {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in queries.op11_simhash(spark, d).collect()} == want
