"""N-gram Jaccard join by parity sketches.

A text is the set of its distinct five-word shingles (64-bit hashes). Two texts link when 100 * |A & B| >= 75 * |A | B|.

* **Sketch.** For a size band, the token space is cut into m cells and every token is XORed into its cell. A token that only one of two sets has changes one cell at most, so the number of cells that differ (the Hamming distance of the sketches) is at most the symmetric difference d, and d <= (a + b) / 7 for linked sets of sizes a and b.
* **Size bands.** Linked sizes differ by 4/3 at most, so with band(a) = floor(log(a) / log(4/3)) they lie in the same band or in adjacent ones. A set is sketched for its band and, as the possibly larger partner, for the one below.
* **Pigeonhole.** Let s be the cells of A that aren't zero. s - d of them at least are equal in B. With m at half the largest size of the band, s > d holds but for rare sets, which emit their zero cells too (m > d always). So linked sets share a key (band, cell, value).
* **Buckets.** A key goes to its bucket as 4 bytes, its owner as 4 more (wider for larger corpora): the shuffle grows as the corpus does. A key of more than `HOT` sets within one slice of texts goes as one mark, whatever the number of its sets, so that no key fills a bucket.
* **Count.** Keys of up to `HOT` sets give their pairs; the rare keys that a pair shares are counted over all buckets, and pairs that share fewer than s - d (less the frequent ones) go. What is left is compared on the full shingle sets.
* **Frequent keys.** A set that keeps more than d other cells needs none of them. The others, sets that consist of frequent keys nearly alone, are sketched again at the finest grain, a cell for each token, where the bound is exact: linked sets share |A & B| >= 3 (a + b) / 7 tokens, so with tokens from the rarest on, one of the first a / 4 + 1 of each. Up to `HOT` sets behind such a token give their pairs. Of more, the set with most tokens from there on (of a group of near copies, the one nearest to the original) is compared with the rest, then further ones with those that aren't connected yet and have tokens enough, until none is left. No pair is lost, and groups of near copies cost about one comparison a member.

Texts with equal sets are one class, named by a 64-bit fingerprint of the set, from the start. All that grows with the corpus stays in Spark: the driver holds counts only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, join_hot, rows_fit, scratch, semi
from .components import connected, named
from .words import U, Words, chunks, mix, shingle_sets

RATIO = 4 / 3
#: Keys and tokens of more sets than this don't give all their pairs.
HOT = 16
#: Sets under this size take each token as a cell of its own.
SMALL = 64
#: How many times more sets of a group are compared with the others in each further round.
WIDER = 16
#: So many pairs are compared at once.
FEW_PAIRS = 20_000
KEYS_PER_BUCKET = 500_000

_PAIR, _COUNT, _SKETCH = 0, 1, 2


def digest(tokens: np.ndarray) -> int:
    """64-bit fingerprint of a set: equal sets have equal ones, in any order."""
    return int(mix(np.array([tokens.sum(dtype=U) + U(len(tokens))], dtype=U) ^ np.bitwise_xor.reduce(mix(tokens + U(0x51))))[0].astype(np.int64)) if len(tokens) else 0


def band(n: int) -> int:
    return int(math.log(n) / math.log(RATIO) + 1e-9)


def cell_keys(tokens: np.ndarray, level: int) -> tuple[np.ndarray, int]:
    """The keys of a set in a band, and how many of its cells hold something."""
    most, n = RATIO ** (level + 1), len(tokens)
    seed = mix(np.array([level + 1], dtype=U) << U(40))
    if most <= SMALL:
        return mix(tokens ^ seed), n
    m = int(most / 2)
    cell = tokens % U(m)
    order = np.argsort(cell)
    cell = cell[order]
    at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    value, cell = np.bitwise_xor.reduceat(tokens[order], at), cell[at]
    cells = np.count_nonzero(value)
    if cells <= n // 3:
        full = np.zeros(m, dtype=U)
        full[cell] = value
        value, cell = full, np.arange(m, dtype=U)
    else:
        value, cell = value[value != 0], cell[value != 0]
    return mix(value ^ mix(cell + seed)), cells


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, class) of every row; class: fingerprint of the shingle set, 0 if empty."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            sets = [(len(s), digest(s)) for s in shingle_sets(Words(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s[0] for s in sets], pa.int64()), pa.array([s[1] for s in sets], pa.int64())], names=["id", "n_shingles", "class"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(one, f"id {rows.schema['id'].dataType.simpleString()}, n_shingles long, class long")


def _set_sketches(texts: list[bytes]) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(class, size, 1 if for its own band and 0 if for the one below, cells, keys) of each sketch of the texts."""
    for tokens in shingle_sets(Words(texts)):
        if len(tokens):
            top, name = band(len(tokens)), digest(tokens)
            for level in (top, top - 1) if top else (0,):
                own, cells = cell_keys(tokens, level)
                yield name, len(tokens), int(level == top), cells, own


def _owners(name: np.ndarray, home: np.ndarray, width: int) -> np.ndarray:
    """Names of sketches in `width` bytes, the last bit tells own bands. Two sketches with one name only add candidates."""
    return (mix(name.astype(np.int64).view(U) ^ U(0x77)) >> U(65 - 8 * width)) << U(1) | home.astype(U)


def _packed(x: np.ndarray, width: int) -> bytes:
    """The last `width` bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(parts: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return out.view("<u8")[:, 0]


_ROWS = "bucket long, keys binary, owners binary, marks binary, sketches binary"
_SKETCHES = np.dtype([("owner", "<i8"), ("class", "<i8"), ("size", "<i8"), ("cells", "<i8"), ("hot", "<i8")])


def _sketches(docs: DataFrame, text: str, buckets: int, width: int) -> DataFrame:
    """Rows (bucket, keys, owners, marks, sketches). keys, owners: the keys of a slice of texts that fall in a bucket, and whose they are; marks: those of more than HOT of its sketches, without owners. Buckets from `buckets` on: the sketches themselves, and how many such keys each has."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, "text"):
            seen, heads, keys = set(), [], []
            for name, size, home, cells, own in _set_sketches(texts):
                if (name, home) not in seen:
                    seen.add((name, home))
                    heads.append((name, size, home, cells))
                    keys.append(own)
            if not heads:
                continue
            name, size, home, cells = (np.array(x, dtype=np.int64) for x in zip(*heads, strict=True))
            owner = _owners(name, home, width)
            who = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
            key = np.concatenate(keys)
            to, short = ((key & U(0xFFFFFFFF)) * U(buckets)) >> U(32), (key >> U(32)).astype(np.uint32)
            order = np.argsort((to << U(32)) | short, kind="stable")
            to, short, who = to[order], short[order], who[order]
            first = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (short[1:] != short[:-1]))))
            times = np.diff(np.append(first, len(short)))
            hot = np.repeat(times > HOT, times)
            marked = first[times > HOT]
            sketch = np.zeros(len(heads), dtype=_SKETCHES)
            sketch["owner"], sketch["class"], sketch["size"], sketch["cells"], sketch["hot"] = owner.view(np.int64), name, size, cells, np.bincount(who[hot], minlength=len(heads))
            mark_to, mark = to[marked], short[marked]
            to, short, who = to[~hot], short[~hot], who[~hot]
            at, mark_at = np.searchsorted(to, np.arange(buckets + 1, dtype=U)), np.searchsorted(mark_to, np.arange(buckets + 1, dtype=U))
            out: tuple[list, list, list, list, list] = ([buckets + int(owner[0] % U(buckets))], [b""], [b""], [b""], [sketch.tobytes()])
            for k in np.flatnonzero((np.diff(at) > 0) | (np.diff(mark_at) > 0)).tolist():
                a, b = at[k], at[k + 1]
                for x, v in zip(out, (k, short[a:b].tobytes(), _packed(owner[who[a:b]], width), mark[mark_at[k] : mark_at[k + 1]].tobytes(), b""), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), *[pa.binary()] * 4), strict=True)], names=["bucket", "keys", "owners", "marks", "sketches"])

    return docs.select(F.col(text).alias("text")).mapInArrow(one, _ROWS)


#: Pairs: owners, and n rare keys that they share. Counts: owner, and n of its keys that are frequent. Sketches: owner, class, size, cells, and n like that.
_FOUND = "kind int, a long, b long, n long, size long, cells long"


def _found(kind: int, a: np.ndarray, n: np.ndarray, b: np.ndarray | int = 0, size: np.ndarray | int = 0, cells: np.ndarray | int = 0) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(a), kind, dtype=np.int32), "a": a.astype(np.int64), "b": b, "n": n.astype(np.int64), "size": size, "cells": cells}).astype({"b": np.int64, "size": np.int64, "cells": np.int64})


def _meet(table: pa.Table, buckets: int, width: int) -> pa.Table:
    """What meets in a bucket: pairs of owners by rare keys, and how many frequent keys an owner has."""
    if table["bucket"][0].as_py() >= buckets:
        s = np.frombuffer(b"".join(table["sketches"].to_pylist()), dtype=_SKETCHES)
        return pa.Table.from_pandas(_found(_SKETCH, s["owner"], s["hot"], s["class"], s["size"], s["cells"]), preserve_index=False)
    key = np.frombuffer(b"".join(table["keys"].to_pylist()), dtype=np.uint32)
    names, who = np.unique(_unpacked(table["owners"].to_pylist(), width), return_inverse=True)
    both = np.unique((key.astype(U) << U(32)) | who.astype(U))
    # keys of one owner with equal names are one here: counted as frequent, so that no pair falls short of what it needs
    merged = np.bincount(who, minlength=len(names))
    key, who = (both >> U(32)).astype(np.uint32), (both & U(0xFFFFFFFF)).astype(np.int64)
    merged = merged - np.bincount(who, minlength=len(names))
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
    size = np.diff(np.append(at, len(key)))
    marks = np.unique(np.frombuffer(b"".join(table["marks"].to_pylist()), dtype=np.uint32))
    hot = (size > HOT) | np.isin(key[at], marks)
    home = (names & U(1)).astype(bool)
    pairs = [np.zeros(0, dtype=U)]
    for g in range(2, HOT + 1):
        own = at[(size == g) & ~hot]
        if len(own):
            rows = who[own[:, None] + np.arange(g)]
            i, j = (rows[:, x].ravel() for x in np.triu_indices(g, 1))
            good = home[i] | home[j]  # two larger partners meet in the band above
            pairs.append((i[good].astype(U) << U(32)) | j[good].astype(U))
    pairs, shared = np.unique(np.concatenate(pairs), return_counts=True)
    out = [_found(_PAIR, names[(pairs >> U(32)).astype(np.int64)], shared, names[(pairs & U(0xFFFFFFFF)).astype(np.int64)].astype(np.int64))]
    count = np.bincount(who[np.repeat(hot, size)], minlength=len(names)) + merged
    some = np.flatnonzero(count)
    out.append(_found(_COUNT, names[some], count[some]))
    return pa.Table.from_pandas(pd.concat(out), preserve_index=False)


def _candidates(reps: DataFrame, text: str, total: int, sets: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes that may link, by their sketches' rare keys; and the classes that frequent keys may link. total, sets: shingles and rows of `reps`."""
    buckets = max(8, -(-total // KEYS_PER_BUCKET))
    width = 4
    while 2 * sets > 1 << (8 * width - 7):  # not one owner in a hundred has another's name
        width += 1
    rows = _sketches(reps, text, buckets, width).repartition(2 * buckets, "bucket")
    found = cut(rows.groupBy("bucket").applyInArrow(lambda t: _meet(t, buckets, width), _FOUND))
    hot = found.where(F.col("kind") != _PAIR).groupBy(F.col("a").alias("owner")).agg(F.sum("n").alias("hot"))
    sketch = found.where(F.col("kind") == _SKETCH).select(F.col("a").alias("owner"), F.col("b").alias("class"), "size", "cells").distinct()
    sketch = cut(sketch.join(hot, "owner"))
    pairs = found.where(F.col("kind") == _PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"))
    for side in "ab":
        pairs = pairs.join(sketch.toDF(*(f"{c}_{side}" for c in sketch.columns)), F.col(side) == F.col(f"owner_{side}"))
    # of the cells that linked sets share, so many aren't frequent at least
    apart = F.floor((F.col("size_a") + F.col("size_b")) / 7)
    for side in "ab":
        pairs = pairs.where(F.col("n") + F.col(f"hot_{side}") >= F.col(f"cells_{side}") - apart)
    pairs = pairs.where("4 * least(size_a, size_b) >= 3 * greatest(size_a, size_b) and class_a != class_b")
    pairs = cut(pairs.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct())
    bound = cut(sketch.where(F.col("hot") >= F.col("cells") - F.floor(F.col("size") / 3)).select("class").distinct())
    free(found, sketch)
    return pairs, bound


def _shingles(docs: DataFrame, text: str) -> DataFrame:
    """(class, tokens) of every row."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, "text"):
            sets = list(shingle_sets(Words(texts)))
            flat = np.concatenate([*sets, np.zeros(0, dtype=U)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), lists], names=["class", "tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(one, "class long, tokens array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) whose sets are as similar as asked, in hundredths."""
    left = join_hot(pairs, sets.toDF("a", "left_tokens"), "a")
    both = join_hot(left, sets.toDF("b", "right_tokens"), "b", counts=pairs.groupBy("b").agg(F.count("*")))
    common = F.size(F.array_intersect("left_tokens", "right_tokens"))
    return both.where(100 * common >= similarity * (F.size("left_tokens") + F.size("right_tokens") - common)).select("a", "b")


def _joined(label: DataFrame | None, new: DataFrame) -> DataFrame:
    """`label` (node, root) after some more links; only links between components are followed."""
    if label is None:
        return connected(new)
    root = {s: label.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab"}
    cross = new.join(root["a"], "a", "left").join(root["b"], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a != b")
    cross = cut(cross)
    if cross.isEmpty():
        return label
    up = connected(cross)
    moved = label.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut(moved.union(up).distinct())


def _grown(label: DataFrame | None, pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """`label` after the links among `pairs`. Of many, each set is compared with its first partner, then come the pairs whose ends aren't connected yet."""
    if rows_fit(pairs, FEW_PAIRS):
        return _joined(label, _verified(pairs, sets, similarity))
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    label = _joined(label, _verified(first, sets, similarity))
    root = {s: label.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab"}
    rest = cut(pairs.join(root["a"], "a", "left").join(root["b"], "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b").join(first, ["a", "b"], "left_anti"))
    return label if rest.isEmpty() else _joined(label, _verified(rest, sets, similarity))


def _roots(rows: DataFrame, label: DataFrame) -> DataFrame:
    """`rows` with the root of each class `a`."""
    return rows.join(label, rows["a"] == label["node"], "left").select(*rows.columns, F.coalesce("root", "a").alias("root"))


def _enough(similarity: int):
    """Whether two sets of a group, x and y, can have tokens enough in common from the group's token on."""
    x, y, s = F.col("size"), F.col("size_b"), similarity
    return ((100 + s) * F.least("rest", "rest_b") >= s * (x + y)) & (100 * F.least(x, y) >= s * F.greatest(x, y)) & (F.col("root") != F.col("root_b"))


def _finest(label: DataFrame, bound: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """`label` after all links among the classes `bound`, sketched with a cell for each token."""
    tokens = semi(sets, bound, "class").select("class", F.size("tokens").cast("long").alias("size"), F.explode("tokens").alias("token"))
    n = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("class")
    ranked = join_hot(tokens, n, "token", counts=n).withColumn("at", F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "token")) - 1)
    # rest: tokens from this one on, itself included
    groups = cut(ranked.where(F.col("at") <= F.floor(F.col("size") * (100 - similarity) / 100)).select("token", "n", F.col("class").alias("a"), "size", (F.col("size") - F.col("at")).alias("rest")))
    other = lambda df: df.select("token", *(F.col(c).alias(f"{c}_b" if c != "a" else "b") for c in ("a", "size", "rest", "root")))
    some = cut(_roots(groups.where(F.col("n") <= HOT), label))
    pairs = cut(some.join(other(some), "token").where("a < b").where(_enough(similarity)).select("a", "b").distinct())
    free(some)
    if not pairs.isEmpty():
        label = _grown(label, pairs, sets, similarity)
    rows, leads, done = groups.where(F.col("n") > HOT).drop("n"), 1, []
    # the smallest partner that a set may have, and what they must share
    partner = F.greatest("least", F.ceil(F.col("size") * similarity / 100))
    able = (F.col("lo") < F.col("hi")) & ((100 + similarity) * F.least("rest", "most") >= similarity * (F.col("size") + partner))
    while True:
        own = cut(_roots(rows, label))
        free(*done)  # the rows of the round before
        # groups that are one component by now need no more comparisons, nor do sets that no other can be like
        whole = own.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("rest").alias("most"), F.min("size").alias("least")).where("lo < hi")
        now = cut(join_hot(own, whole, "token").where(able).select(*own.columns))
        free(own)
        if now.isEmpty():
            return label
        best = F.max(F.struct("rest", -F.col("size"), "a", "root", "size"))
        lead = now.groupBy("token", F.pmod(F.xxhash64("a"), F.lit(leads)).alias("deal")).agg(best.alias("x")).select("token", "x.a", "x.size", "x.rest", "x.root")
        lead = cut(lead)
        met = now.join(F.broadcast(other(lead)), "token") if rows_fit(lead, 50_000) else join_hot(now, other(lead), "token")
        new = met.where(_enough(similarity))
        new = cut(new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if not new.isEmpty():
            label = _grown(label, new, sets, similarity)
        # a lead has been compared with all others
        rows, leads = now.drop("root").join(lead.select("token", "a"), ["token", "a"], "left_anti"), leads * WIDER
        done = [now, lead, new]


def links(docs: DataFrame, info: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: int = 75) -> DataFrame:
    """(node, root) of classes that are linked with others: two have one root if and only if a chain of linked texts connects them. info: `classes(docs)`."""
    with scratch() as keep:
        one = cut(info.where("class != 0").groupBy("class").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n")))
        whole = one.agg(F.sum("n").alias("n"), F.count("*").alias("sets")).first()
        pairs, bound = _candidates(semi(docs, one.select("id"), doc_id), text, int(whole["n"] or 0), whole["sets"])
        some = cut(pairs.select("a").union(pairs.select("b")).union(bound).distinct().toDF("class"))
        reps = one.join(some, "class", "left_semi")
        sets = cut(semi(_shingles(semi(docs, reps.select("id"), doc_id), text), some, "class").dropDuplicates(["class"]))
        label = _grown(None, pairs, sets, similarity)
        return keep(_finest(label, bound, sets, similarity))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`; component_id: smallest id that a chain of links reaches.

    A null or empty text, or one without words, has no shingles and is linked with nothing; fewer than five words are one shingle. Equal texts (repeated rows too) are one class, in the same component. A row without an id takes part; its component has the smallest id there is, or null. Other columns are ignored. An empty table gives an empty result.
    """
    if similarity < 75:
        raise ValueError("the size bands hold for similarities of 75 hundredths or more")
    info = cut(classes(docs, doc_id, text))
    root = links(docs, info, doc_id, text, similarity)
    some = info.where("n_shingles > 0")
    ids = cut(named(some.groupBy(F.col("class").alias("node")).agg(F.min("id").alias("id")), root))
    free(root)
    linked = join_hot(some, ids.withColumnRenamed("node", "class"), "class").select("id", "n_shingles", "component_id")
    out = linked.union(info.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.withColumnRenamed("id", doc_id)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: int = 75) -> DataFrame:
    """`docs` with one document of each component, the one with the smallest id, and all that are linked with nothing. Repeated rows of the kept id stay; rows without an id stay."""
    found = near_duplicates(docs, doc_id, text, similarity)
    gone = found.where(F.col("component_id") != F.col(doc_id)).select(doc_id)
    return semi(docs, gone, doc_id, how="left_anti")
