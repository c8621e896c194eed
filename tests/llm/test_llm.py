"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomledger.llm import chat, decontamination, fingerprint, line_dedup, mixing, near_duplicates, pii, quality, token_counts, toxicity
from loomledger.llm.common import join_hot
from loomledger.llm.words import Words, shingle_sets

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def texts(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    out = []
    for _ in range(n):
        out.append("\n".join(" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 8))))
    for k in range(20):  # near copies
        w = out[k % 5].split(" ")
        for _ in range(r.randint(0, max(1, len(w) // 12))):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    return [*out, None, "", "  \n", "one two", "ONE two", "one two", "x" * 50_000, out[0], out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "b", "a", "é"][i % 4], 0) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)


def test_words():
    ts = [t or "" for t in texts()]
    w = Words([t.encode() for t in ts])
    for i, t in enumerate(ts):
        assert w.first[i + 1] - w.first[i] == len(words(t))
    for t, s in zip(ts, shingle_sets(w), strict=True):
        own = words(t)
        assert len(s) == len({tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else ())


def test_shingles_of_short_slices(spark):
    """Slices of few words in all: one row in each partition."""
    for n in range(7):
        (own,) = shingle_sets(Words([" ".join("abcdef"[:n]).encode()]))
        assert len(own) == max(min(n, 1), n - 4)
    rows = [(n, " ".join(f"w{k}" for k in range(n % 7))) for n in range(14)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(14)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        own = words(t)
        sets[i] = {tuple(own[k : k + 5]) for k in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, docs):
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = near_duplicates.near_duplicates(docs.withColumn("size", F.lit(1)).withColumn("class", F.lit(2))).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_hot_group(spark):
    """More near copies than a frequent key's limit, and unlike texts that share most of their words."""
    r = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"z{r.random()}"
        rows.append((i, " ".join(w)))
    shared = " ".join(f"s{k}" for k in range(30))
    rows += [(100 + i, f"{shared} " + " ".join(f"u{i}x{k}" for k in range(i % 12))) for i in range(60)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_components(rows)


def test_near_duplicates_heavy_keys(spark, monkeypatch):
    """No bucket gathers the copies of a text, or all the texts that share a passage or are near copies."""
    monkeypatch.setattr(near_duplicates, "FEW_PAIRS", 20)
    r = random.Random(8)
    shared, base = [f"s{k}" for k in range(34)], [f"w{k}" for k in range(120)]
    rows = [(i, " ".join([*shared, *(f"u{i}x{k}" for k in range(i % 12))])) for i in range(150)]
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"z{r.random()}"
        rows.append((200 + i, " ".join(w)))
    rows += [(400 + i, "the same text in many rows of it") for i in range(300)]
    rows += [(800 + i, f"{rows[3][1]} {rows[151][1]} tail{i}") for i in range(40)]
    want = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met = []
    sketches = near_duplicates._sketches
    monkeypatch.setattr(near_duplicates, "_sketches", lambda *a: met.append(sketches(*a).collect()) or sketches(*a))
    got = near_duplicates.near_duplicates(docs).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want
    slices = docs.rdd.getNumPartitions()
    times = {}
    for x in (x for x in met[0] if x["bucket"] < 8):
        for k in np.frombuffer(x["keys"], np.uint32).tolist():
            times[x["bucket"], k] = times.get((x["bucket"], k), 0) + 1
    assert max(times.values()) <= near_duplicates.HOT * slices


def test_near_duplicates_many(spark):
    """5,000 near copies take about one comparison each, and as many unlike texts round a common passage hardly any."""
    r = random.Random(5)
    base, passage = [f"w{k}" for k in range(150)], [f"s{k}" for k in range(60)]
    rows = []
    for i in range(5000):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"z{r.random()}"
        rows.append((i, " ".join(w)))
    rows += [(10_000 + i, " ".join([*passage, *(f"u{i}x{k}" for k in range(20))])) for i in range(5000)]
    compared = []
    verified = near_duplicates._verified
    near_duplicates._verified = lambda pairs, *a: compared.append(pairs.count()) or verified(pairs, *a)
    try:
        got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        near_duplicates._verified = verified
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows[:5000]]
    near = {i for i, s in enumerate(sets) if 100 * len(s & sets[0]) >= 75 * len(s | sets[0])}
    component = {x["doc_id"]: x["component_id"] for x in got}
    assert all(component[i] == component[0] for i in near)
    assert all(component[i] == i for i in range(10_000, 15_000))
    assert sum(compared) < 3 * len(rows)


def test_hot_join_deals_rows_alike(spark):
    """Rows in another order, as after a lost executor, go to the same tasks; none is lost or doubled."""
    rows = [(k % 2, k) for k in range(400)]
    right = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "a long, v string")
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        got = []
        for order in (rows, rows[::-1]):
            joined = join_hot(spark.createDataFrame(order, "a long, b long").coalesce(1), right, "a", per_salt=20)
            got.append({(r["a"], r["b"], r["v"], r["task"]) for r in joined.withColumn("task", F.spark_partition_id()).collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got[0] == got[1] and {x[:3] for x in got[0]} == {(a, b, "xy"[a]) for a, b in rows} and len(got[0]) == 400
    assert len({x[3] for x in got[0]}) > 4


def test_decontamination(spark, docs):
    source = [t for t in texts() if t and len(words(t)) > 25]
    items = [("b1", " ".join(source[2].split()[3:20])), ("b6", " ".join([*source[2].split()[3:22], "then", "other"])), ("b7", source[2]), ("b8", source[2]), ("b2", "nothing of the sort"), ("b3", "One two"), (None, "x"), ("b4", None), ("b5", " ")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        own = word.findall((t or "").translate(LOWER)) if i else []
        n = min(10, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[k : k + n]), set()).add(i)
    for size in (1 << 20, 600):
        out, name = decontamination.contamination(docs.withColumn("contamination", F.lit(1)), bench, block_bytes=size)
        for r in out.collect():
            own = word.findall((r["text"] or "").translate(LOWER))
            hit, found, far = [0] * len(own), set(), 0
            for win, who in windows.items():
                for k in range(len(own) - len(win) + 1):
                    if tuple(own[k : k + len(win)]) == win:
                        found |= who
                        hit[k : k + len(win)] = [1] * len(win)
                        for o in (word.findall((t or "").translate(LOWER)) for i, t in items if i in who):
                            for j in range(len(o) - len(win) + 1):
                                if tuple(o[j : j + len(win)]) == win:
                                    far = max(far, next((n for n, (x, y) in enumerate(zip(o[j:], own[k:], strict=False)) if x != y), min(len(o) - j, len(own) - k)))
            x = r[name]
            assert (x["longest"]["words"] if x["longest"] else 0) == far
            assert (x["n_words"], sum(h["end"] - h["start"] for h in x["hits"]), x["items"]) == (len(own), sum(hit), sorted(found))
            assert (x["longest"] is None) == (not found)
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_decontamination_common_opening(spark):
    """Many items and many documents with one opening: work grows with both, not with their product."""
    opening = " ".join(f"w{k}" for k in range(12))
    bench = spark.createDataFrame([(f"b{i:04}", f"{opening} item{i}") for i in range(3000)], "item_id string, text string")
    docs = spark.createDataFrame([(i, f"x {opening} doc{i} y") for i in range(3000)] + [(3000, f"{opening} item7")], "doc_id long, text string")
    t = time.perf_counter()
    out, name = decontamination.contamination(docs, bench)
    got = {r["doc_id"]: r for r in out.select("doc_id", F.size(f"{name}.items").alias("n"), f"{name}.hits", f"{name}.longest").collect()}
    assert time.perf_counter() - t < 20
    assert all(got[i]["n"] == 3000 and [tuple(h) for h in got[i]["hits"]] == [(1, 13)] and got[i]["longest"]["words"] == 12 for i in range(3000))
    assert got[3000]["n"] == 3000 and tuple(got[3000]["longest"]) == ("b0007", 0, 0, 13)


def test_suffix_array():
    r = np.random.default_rng(0)
    text = r.integers(1, 4, 300).astype(np.uint64)
    order = decontamination.suffix_array(text)
    assert sorted(order.tolist()) == list(range(300))
    cut = [tuple(text[i : i + decontamination.DEPTH].tolist()) for i in order]
    assert cut == sorted(cut)


def test_line_dedup(spark):
    long = " ".join(f"w{k}" for k in range(60))
    half = [" ".join(f"h{j}x{k}" for k in range(30)) for j in range(3)]
    rows = [
        (1, f"start\n{long}\nend"), (2, f"other\n{long}\ncommon"), (3, "short\ncommon"), (4, "\n".join(half)), (5, "\n".join(["mine", *half, "tail"])),
        (6, "\n".join(half[:1])), (7, None), (8, ""), (9, f"start\n{long}\nend"), (10, f"{long}\nnew\n{long}"),
    ]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").withColumn("ranges", F.lit(1)).withColumn("K", F.lit(2))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "other\ncommon", 3: "short\ncommon", 4: rows[3][1], 5: "mine\ntail", 6: half[0], 7: None, 8: "", 10: "new"}
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, drop_emptied=False).collect()}[9] == ""
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def line_runs(rows, least):
    """For each row's lines with words: which must go (they lie in the fewest lines that hold `least` words from some line on, and these occurred before), and which may (they lie in any run of so many words that did)."""
    own = {}
    for i, t in rows:
        own[i] = [tuple(x.split()) for x in (t or "").split("\n") if x.split()]
    place, must, may = {}, {}, {}
    order = sorted(own)
    for i in order:
        must[i], may[i] = set(), set()
        for s in range(len(own[i])):
            e, n = s, 0
            while e < len(own[i]) and n < least:
                n += len(own[i][e])
                e += 1
            if n >= least:
                if place.setdefault(tuple(own[i][s:e]), (i, s)) != (i, s):
                    must[i] |= set(range(s, e))
        for j in order[: order.index(i) + 1]:
            for shift in range(-len(own[i]) + 1, len(own[j])):
                if j == i and shift >= 0:
                    continue
                run = []
                for s in range(len(own[i]) + 1):
                    if s < len(own[i]) and 0 <= s + shift < len(own[j]) and own[i][s] == own[j][s + shift]:
                        run.append(s)
                    else:
                        if sum(len(own[i][x]) for x in run) >= least:
                            may[i] |= set(run)
                        run = []
    return own, must, may


def test_line_dedup_random(spark):
    """Against brute force: every window that occurred before goes, and nothing that isn't in a run of so many words that did."""
    for seed, least in ((1, 6), (2, 6), (3, 9), (4, 3)):
        r = random.Random(seed)
        few = [" ".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(4 + 2 * seed)]
        rows = []
        for i in range(40):
            t = [r.choice([*few, "", " "]) if r.random() < 0.8 else f"own{i} {r.random()}" for _ in range(r.randint(0, 14))]
            if rows and r.random() < 0.5:
                old = r.choice(rows)[1].split("\n")
                a = r.randrange(len(old))
                t[len(t) // 2 : len(t) // 2] = old[a : a + r.randint(1, 8)]
            rows.append((i, "\n".join(t)))
        own, must, may = line_runs(rows, least)
        assert sum(map(len, must.values())) > 20
        docs = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string")
        got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(docs, min_words=least, drop_emptied=False).collect()}
        ks = {x["doc_id"]: x["k"] for x in docs.select("doc_id", line_dedup.row_key("doc_id", "text").alias("k")).collect()}
        gone = {i: set() for i, _ in rows}
        for x in line_dedup.repeated_runs(docs, min_words=least).collect():
            for i in [i for i in ks if ks[i] == x["k"]]:
                gone[i] |= set(range(x["start"], x["last"] + 1))
        for i, t in rows:
            assert must[i] <= gone[i] <= may[i], (seed, i)
            assert [tuple(x.split()) for x in got[i].split("\n") if x.split()] == [x for k, x in enumerate(own[i]) if k not in gone[i]]


def test_line_dedup_long(spark):
    """A text of 20,000 lines and its copy, one of 20,000 equal lines, and one of 20,000 lines in blocks of another order."""
    lines = [f"line {k} has some words of its own" for k in range(20_000)]
    blocks = [lines[k : k + 10] for k in range(0, 20_000, 10)]
    random.Random(1).shuffle(blocks)
    rows = [(1, "\n".join(lines)), (2, "new\n" + "\n".join(lines)), (3, "\n".join(["the same line again and again"] * 20_000)), (4, "\n".join(x for b in blocks for x in b))]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "new", 3: "the same line again and again"}


def test_mixing(spark, docs):
    out, n = mixing.copies(docs.withColumn("size", F.lit(0)).withColumn("target", F.lit(0)))
    rows = out.collect()
    assert len(rows) == docs.count()
    size, target = {}, {}
    for r in rows:
        assert r[n["size"]] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r[n["copies"]] <= 2
        size[r["source"]] = r[n["source_size"]]
        target[r["source"]] = r[n["target"]]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, want, left = dict(zip(order, (5, 2, 1, 5), strict=False)), {}, 1.5 * sum(size.values())
    open_ = set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * size[s]}
        if not full:
            want |= {s: weight[s] * level for s in open_}
            break
        want |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    assert target == pytest.approx(want)
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(r[n["copies"]] for r in rows) and mixed.count() == mixing.mix(docs).count()
    assert mixing.mix(docs.limit(0)).count() == 0


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark):
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    rows = [
        "é mail a.b@c.de, x@y.com_abc@d.com and a@b", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112, +1 (367) 555-2485 +12 +1234567890123456",
        None, "", "a" * 20_000, "1.1" * 3_000, "@@..++", "+1 (367) 555-2485",
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("spans", F.lit(1))
    for r in pii.find_pii(docs).collect():
        t = rows[r["doc_id"]] or ""
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t) if ok(m[0])]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), (r, spans)
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def test_pii_contexts(spark):
    numbers = ["4111111111111111", "4012888888881881", "4222222222222220001", "5555555555554444", "5105105105105100", "4111111111111112"]
    rows = [(i, f"my card {n} ends") for i, n in enumerate(numbers)]
    assert [luhn(n) for n in numbers] == [True, True, False, True, True, False]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # four of six instances of the patterns are cards: that isn't enough to name the others
    assert {i: (r["n_card"], r["n_found"]) for i, r in got.items()} == {i: (int(luhn(n)), 0) for i, n in enumerate(numbers)}
    more = [*rows, *((10 + i, f"my card {n} ends") for i, n in enumerate(["4000000000000002", "4242424242424242", "4000056655665556", "5200828282828210"]))]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame([*more, more[2]], "doc_id long, text string")).collect()}
    # eight of ten are
    assert {i for i, r in got.items() if r["n_found"]} == {2, 5} and got[2]["spans"] == "card:8:27" and got[5]["spans"] == "card:8:24"


def test_pii_hidden_seeds(spark):
    """A third of the identifiers is written so that no base expression has them; their contexts find 90 % of these at least, and hardly anything else."""
    r = random.Random(2)
    leads = ["mail", "write", "ping", "contact", "reach", "notify"]
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(5))
    rows, hidden = [], set()
    for i in range(900):
        name = f"{word()}{r.randint(10, 99)}@{word()}"
        hide = i % 3 == 0
        rows.append((i, f"{word()} {r.choice(leads)} {name}{'' if hide else '.example'} today {word()}"))
        if hide:
            hidden.add(i)
    rows += [(1000 + i, f"{word()} {word()} {r.randint(1, 999)} {word()} {word()}@{r.randint(1, 9)}") for i in range(300)]
    got = {x["doc_id"]: x for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {i for i, x in got.items() if x["n_found"] and "email" in x["spans"]}
    assert len(found & hidden) >= 0.9 * len(hidden) and len(found & hidden) >= 0.95 * len(found)


def test_pii_long(spark):
    """20,000 addresses in one text, and a run of 200,000 digits."""
    many = " ".join(f"see u{k}@h.example, {k % 256}.2.3.4" for k in range(20_000))
    docs = spark.createDataFrame([(1, many), (2, "1" * 200_000), (3, None)], "doc_id long, text string")
    start = time.perf_counter()
    got = {x["doc_id"]: x for x in pii.find_pii(docs).collect()}
    assert (got[1]["n_email"], got[1]["n_ip"], got[2]["n_card"], got[3]["n_email"]) == (20_000, 20_000, 0, 0)
    assert time.perf_counter() - start < 120


def test_pii_bootstraps(spark):
    """A number of several tokens is found by its lead word; numbers so found make a lead word without a seed a pattern."""
    r = random.Random(6)
    number = lambda: f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"
    letters = lambda i: "abcdefghij"[i // 10 % 10] + "abcdefghij"[i % 10]
    known = [f"n{letters(i)} ring +1 {number()} q{letters(i)}" for i in range(99)]
    odd = [f"+0 ({k}) 1-2" for k in range(8)]  # too few digits for the base
    found = [f"do ring {x} x{letters(k)}" for k, x in enumerate(odd)] + [f"then beep {x} y{letters(k)}" for k, x in enumerate(odd)] + ["you beep +0 (9) 1-2 soon"]
    rows = list(enumerate([*known, *found, "sum of 3 and (4) 5-6 or so"]))
    got = {x["doc_id"]: x for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[99:-1]:
        assert got[i]["n_phone"] == 0 and got[i]["spans"] == f"phone:{t.index('+')}:{t.index('+') + 10}", (i, got[i])
    assert all(got[i]["n_found"] == 0 and got[i]["n_phone"] == 1 for i in range(99)) and got[rows[-1][0]]["n_found"] == 0


def test_chat(spark):
    rows = [(1, 0, "user", "</s>[INST] \\e <x>"), (1, 1, "assistant", "a\\l[/INST]"), (2, 1, "assistant", None), (2, 0, "user", "é"), (3, 0, None, ""), (None, 0, "system", "s")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("segments", F.lit(1))
    made = chat.format_chats(turns)
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    for c in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        listed = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and got[c]["n_turns"] == len(own)
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1]["in_order"] and got[2]["in_order"] and not got[3]["in_order"] and not got[None]["in_order"]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_fingerprints(spark):
    ts = [t for t in texts(n=20)]
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(ts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(docs).collect()}
    order = sorted(range(len(ts)), reverse=True)
    assert len(got) == len(ts)
    for k, i in enumerate(order):
        t, after = ts[i] or "", ts[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[3 * i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for other, name in ((edited, "near_edited"), (after, "near_next")):
            a, b = set(fingerprint.digests(t)), set(fingerprint.digests(other))
            assert r[name] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    prints = {ts[i]: got[3 * i]["fingerprint"] for i in order}
    assert all(prints[ts[i]] == got[3 * i]["fingerprint"] for i in order)
    assert fingerprint.compare_with_next(docs.limit(0)).count() == 0
    one = fingerprint.compare_with_next(docs.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprints_of_any_ids(spark, kind):
    """Rows without ids and with repeated ones all stay, and each is compared with the one after it in the order that is stated."""
    ts = texts(n=30)
    ids = [None if i % 4 == 0 else i // 2 * 10 if kind == "long" else f"id{i // 2:03d}" for i in range(len(ts))]
    docs = spark.createDataFrame(list(zip(ids, ts, strict=True)), f"doc_id {kind}, text string").withColumn("at", F.lit(1)).repartition(5)
    h = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in {t or "" for t in ts}], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in zip(ids, ts, strict=True)), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else ids[1], h[x[1]]), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    out = fingerprint.compare_with_next(docs)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out.collect()), key=str) == sorted(want, key=str)
    assert out.schema["doc_id"].dataType.simpleString() == docs.schema["doc_id"].dataType.simpleString()
    none = fingerprint.compare_with_next(docs.where("doc_id is null"))
    assert none.count() == sum(i is None for i in ids) and fingerprint.compare_with_next(docs.limit(0)).count() == 0


def test_fingerprints_that_clash_end():
    """Two digests that are one can't be peeled, whatever the sketch; sketches grow as often as they must."""
    r = random.Random(3)
    a, b = ([r.getrandbits(64) for _ in range(300)] for _ in range(2))
    one, two = fingerprint.difference([7, 7, 7, *a[:40]], [*a[:40], 9])
    assert (sorted(one), two) == ([7, 7, 7], [9])
    for n in (0, 3, 30, 300):
        one, two = fingerprint.difference(a, [*a[n:], *b[:n]])
        assert (sorted(one), sorted(two)) == (sorted(a[:n]), sorted(b[:n]))


def test_toxicity(spark):
    r = random.Random(5)
    plain = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [r.choice(plain) for _ in range(30)]
        if bad:
            w[3] = "nastyword" + r.choice(["", "s", "en"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (600, None), (601, ""), (None, "x")], "doc_id long, text string").withColumn("toxic_score", F.lit(1))
    marks = spark.createDataFrame([*labels, (0, None)], "doc_id long, toxic int")
    out, name = toxicity.scored(docs, toxicity.train(docs, marks))
    got = {x["doc_id"]: x[name] for x in out.collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values()) and got[600] == got[601]
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(y) for i, y in held) >= 0.95 * len(held)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.where("doc_id is null or doc_id > 599").count() == 3
    assert toxicity.drop_toxic(docs, marks.limit(0)).count() == docs.count()
    # a sample of the labelled rows, repeated rows, and one very long text
    more = docs.union(docs).union(docs.where("doc_id = 5").withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 5000)))
    out, name = toxicity.scored(more, toxicity.train(more, marks, most_rows=300))
    got = {x["doc_id"]: x[name] for x in out.collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, y in held) >= 0.9 * len(held)


def test_machine_learns_pairs():
    """Two terms that are toxic only together: no additive weights tell them apart; the settings are those of production."""
    r = np.random.default_rng(2)
    a, b = r.random(2000) < 0.5, r.random(2000) < 0.5
    text = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    term = np.concatenate([np.zeros(a.sum(), dtype=np.int64), np.ones(b.sum(), dtype=np.int64)])
    m = toxicity.Machine(np.array([5, 9]), 0.0)
    m.fit(text, term, (a == b).astype(float))
    assert ((m.score(text, term, 2000) >= 0.5) == (a == b)).mean() > 0.95


def plain_machine(lists, labels, w, v, bias, epochs, rate=0.05, decay=3e-4):
    """The same machine term by term and pair by pair, with the same steps."""
    m, k = len(w), len(v)
    flat = [bias, *w, *(x for row in v for x in row)]
    first, second = [0.0] * len(flat), [0.0] * len(flat)

    def raw(terms):
        bias, w, v = flat[0], flat[1 : 1 + m], [flat[1 + m + f * m : 1 + m + (f + 1) * m] for f in range(k)]
        return bias + sum(w[t] for t in terms) + sum(v[f][s] * v[f][t] for i, s in enumerate(terms) for t in terms[i + 1 :] for f in range(k))

    for step in range(1, epochs + 1):
        g = [0.0, *(decay * x for x in flat[1:])]
        for terms, y in zip(lists, labels, strict=True):
            e = (1 / (1 + np.exp(-raw(terms))) - y) * (toxicity.TOXIC_WEIGHT if y else 1.0) / len(lists)
            g[0] += e
            for t in terms:
                g[1 + t] += e
                for f in range(k):
                    g[1 + m + f * m + t] += e * sum(flat[1 + m + f * m + s] for s in terms if s != t)
        for i, x in enumerate(g):
            first[i] += 0.1 * (x - first[i])
            second[i] += 0.01 * (x * x - second[i])
            flat[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return [1 / (1 + np.exp(-raw(t))) for t in lists]


def test_machine_against_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 7)
    r = np.random.default_rng(4)
    lists = [sorted(r.choice(6, r.integers(0, 6), replace=False).tolist()) for _ in range(25)]
    labels = r.integers(0, 2, 25).astype(float)
    m = toxicity.Machine(np.arange(6), 0.3)
    m.v *= 10
    want = plain_machine(lists, labels, m.w.tolist(), m.v.tolist(), m.bias, 7)
    text, term = np.repeat(np.arange(25), [len(x) for x in lists]), np.array([t for x in lists for t in x], dtype=np.int64)
    m.fit(text, term, labels)
    assert m.score(text, term, 25) == pytest.approx(want, abs=1e-9)


def test_token_counts(spark, docs):
    code = token_counts.encoder(token_counts.VOCABULARY)
    for block in (1 << 18, 7):
        got = token_counts.count_tokens(docs.repartition(3), block_tokens=block).collect()
        want = sorted((r["doc_id"], len(code.encode_ordinary(r["text"] or ""))) for r in docs.collect())
        assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == want
        if block == 7:
            break
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
    named = spark.createDataFrame([("a", "one two"), ("a", "one two"), (None, None), ("b", "x " * 50_000)], "doc_id string, text string").withColumn("Shard", F.lit(1))
    got = sorted(((r["doc_id"] or "", r["n_tokens"]) for r in token_counts.count_tokens(named, block_tokens=1000).collect()))
    assert got == [("", 0), ("a", 2), ("a", 2), ("b", len(code.encode_ordinary("x " * 50_000)))]


def test_flat_file(spark, tmp_path):
    flat = np.array([5, 6, 9, 9, 7, 8, 8, 8, 9, 1], dtype="<u2")
    (tmp_path / "t.bin").write_bytes(flat.tobytes())
    r = np.random.default_rng(1)
    prime = r.integers(0, 30, 100_003).astype("<u2")  # its length has no divisor that blocks could have
    (tmp_path / "u v.bin").write_bytes(prime.tobytes())
    (tmp_path / "w.bin").write_bytes(b"")
    for size in (4, 7, 1 << 20):
        got = token_counts.scan(token_counts.read_flat(spark, str(tmp_path / "t.bin"), block_bytes=size), end=9).orderBy("ordinal").collect()
        assert [(r["n_tokens"], r["closed"]) for r in got] == [(2, True), (0, True), (4, True), (1, False)]
    blocks = token_counts.read_flat(spark, f"{tmp_path}/*.bin", block_bytes=5000)
    assert blocks.count() == 1 + -(-prime.nbytes // 5000)
    got = [r["n_tokens"] for r in token_counts.scan(blocks, end=9).where("shard like '%v.bin'").orderBy("ordinal").collect()]
    ends = np.flatnonzero(prime == 9)
    want = (np.diff(np.concatenate(([-1], ends))) - 1).tolist()
    assert got[: len(want)] == want and sum(got[len(want) :]) == len(prime) - 1 - ends[-1]
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError, match="odd.bin"):
        token_counts.read_flat(spark, f"{tmp_path}/*.bin")


def test_quality(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    good = [" ".join(word() for _ in range(60)) + "." for _ in range(120)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(15)] + [" | ".join(word() for _ in range(60)) for _ in range(15)]
    docs = spark.createDataFrame([*enumerate([*good, *bad, None, ""])], "doc_id long, text string").withColumn("score", F.lit(1))
    got = {x["doc_id"]: x for x in quality.weak_quality(docs).collect()}
    assert sum(got[i]["keep"] for i in range(120)) == 120 and sum(got[i]["keep"] for i in range(120, 150)) == 0
    assert got[150]["score"] == got[151]["score"]
    _, right, n = quality.label_model(quality.read(docs))
    assert n == 152 and set(right) == set(quality.LABELLERS)
    assert quality.weak_quality(docs.limit(0)).count() == 0
    # a sample of 80 of 304 rows, repeated rows and one very long text among them
    more = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 1000)).union(docs.where("doc_id = 0").withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 3000)))
    some = {(x["doc_id"], x["score"]): x["keep"] for x in quality.weak_quality(more, most_rows=80).collect()}
    assert sum(k == (i % 1000 < 120) for (i, _), k in some.items() if i % 1000 < 150) >= 0.95 * 300


def test_quality_em():
    """The posteriors are those of the same steps taken vote by vote."""
    r = np.random.default_rng(3)
    rows = r.integers(-1, 2, (400, 3))
    patterns, counts = np.unique(rows, axis=0, return_counts=True)
    table, share, good = quality.estimate(patterns, counts.astype(float))
    own = [0.1 if 0 in v else 0.9 for v in rows.tolist()]
    for _ in range(quality.ROUNDS):
        p = (sum(own) + 1) / (len(own) + 2)
        t = {}
        for j in range(3):
            for label in (0, 1):
                w = [g if label else 1 - g for g in own]
                c = [sum(x for x, v in zip(w, rows[:, j].tolist(), strict=True) if v == k) for k in (-1, 0, 1)]
                c = [c[0] + 0.1, c[1] + 0.1 + 0.9 * (label == 0), c[2] + 0.1 + 0.9 * (label == 1)]
                t[j, label] = [x / sum(c) for x in c]
        own = []
        for v in rows.tolist():
            a, b = 1 - p, p
            for j in range(3):
                a, b = a * t[j, 0][v[j] + 1], b * t[j, 1][v[j] + 1]
            own.append(b / (a + b))
    want = {tuple(v): g for v, g in zip(rows.tolist(), own, strict=True)}
    assert share == pytest.approx(p) and all(g == pytest.approx(want[tuple(v)], abs=1e-6) for v, g in zip(patterns.tolist(), good, strict=True))


def test_quality_scores_are_those_of_plain_sums(spark):
    """Each text's score from its own features, word by word."""
    r = random.Random(8)
    ts = [" ".join(r.choice(("ab", "CD!!", "x", "Word", "|", "9")) for _ in range(r.randint(0, 40))) for _ in range(60)] + ["A" * 40_000 + "b!" * 20, None]
    docs = spark.createDataFrame([*enumerate(ts)], "doc_id long, text string")
    posterior, _, _ = quality.label_model(quality.read(docs))
    rows = sorted((x["by"], t or "") for x, t in ((x, ts[x["id"]]) for x in quality.read(docs).collect()))
    fitted = [(list(f), list(f.values()), posterior[sum((v + 1) * 3**j for j, v in enumerate(quality.votes(t)))]) for t in (t for _, t in rows) for f in (quality.features(t),)]
    w, bias = quality._fit(fitted)
    for x in quality.weak_quality(docs).collect():
        t = ts[x["doc_id"]] or ""
        raw = bias + sum(w[s] * v for s, v in quality.features(t).items())
        assert x["score"] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-4)
        assert x["posterior"] == posterior[sum((v + 1) * 3**j for j, v in enumerate(quality.votes(t)))]
