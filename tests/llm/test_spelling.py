"""Spelling variants against brute force and SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomledger.llm import spelling
from loomledger.llm.oracles import ORACLE
from loomledger.llm.queries import QUERIES


def brute_words(rows, every, least=5, often=3):
    seen = Counter()
    for i, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{i}:{run}".encode())
            if every and i is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= least and n >= often}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words, ratio=2):
    forms, out = {}, {}
    for w, n in words.items():
        own = [v for v in words if v != w and near(w, v)]
        best = min(own, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= ratio * n else None
        out[w] = len(own)
    roots = {}
    for w in words:
        roots[w] = w
        while forms[roots[w]]:
            roots[w] = forms[roots[w]]
    return {w: (forms[w], roots[w], n, out[w], words[forms[w]] if forms[w] else None) for w, n in words.items()}


def vocabulary(seed, letters="abcdeé", sizes=(5, 6, 7), n=400):
    r = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "".join(r.choice(letters) for _ in range(r.choice(sizes)))
        out[w] = r.choice((3, 4, 5, 8, 20, 100))
    return out


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("cell,sample,letters,sizes", [(32_768, 200_000, "abcdeé", (5, 6, 7)), (40, 5000, "abcdeé", (5, 6, 7)), (20, 60, "abcdéþ", (7, 8, 30, 31)), (10, 100, "ab", (8, 9))])
def test_variants(spark, cell, sample, letters, sizes):
    words = vocabulary(cell, letters, sizes)
    words |= {"".join(w): 9 for w in ("xabcde", "xabced", "xacbde", "abcdex", "xacbdee")} | {"y" * 300: 4, "y" * 301: 9, "y" * 150 + "z" + "y" * 150: 20}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3).withColumn("form", F.lit(1)).withColumn("root", F.lit(1))
    assert result(spelling.variants(df, cell=cell, sample=sample)) == brute_variants(words)
    if cell == 40:
        assert spelling.variants(df.limit(0)).count() == 0


def test_anagrams_that_no_cut_divides(spark):
    """Words of one vector: their cell is dealt over several groups."""
    r = random.Random(9)
    base = list("aaabbbc")
    words = {}
    while len(words) < 100:
        r.shuffle(base)
        words["".join(base)] = 3
    words |= {w[:2] + "d" + w[3:]: 7 for w in list(words)[:40]} | {w[1:]: 8 for w in list(words)[:40]}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(spelling.variants(df, cell=10)) == brute_variants(words)


def test_words(spark):
    r = random.Random(3)
    some = list(vocabulary(1, "abcABé", (1, 5, 6)))
    rows = [(i, r.choice((" ", "-", "1", "’", "ÿ×")).join(r.choice(some) for _ in range(200))) for i in range(40)]
    rows += [(None, rows[0][1]), (40, None), (41, ""), (42, "Ā" + "b" * 70 + "ā" + "中éééééé中" * 4), (43, "x" * 60_000 + " "), (0, rows[0][1]), *[(44 + k, "x" * 60_000) for k in range(3)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(1))
    for every in (0, 2, 97):
        assert {x["word"]: x["n"] for x in spelling.count_words(docs, drop_every=every).collect()} == brute_words(rows, every)
    assert spelling.count_words(docs.limit(0)).count() == 0


def test_crc():
    r = np.random.default_rng(1)
    buf = r.integers(0, 256, 3000).astype(np.uint8)
    start = r.integers(0, 2000, 300)
    size = r.integers(0, 100, 300)
    begin = np.array([zlib.crc32(str(k).encode()) for k in range(300)], dtype=np.uint32)
    want = [zlib.crc32(buf[a : a + n].tobytes(), int(c)) for a, n, c in zip(start, size, begin, strict=True)]
    assert spelling.crc32_on(begin, buf, start, size).tolist() == want
    assert spelling.crc32_on(begin[:0], buf, start[:0], size[:0]).tolist() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(ORACLE["op12_spelling_variants"]).fetchall()}
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert result(QUERIES["op12_spelling_variants"](spark, d)) == want == brute_variants(brute_words(rows, 97))
