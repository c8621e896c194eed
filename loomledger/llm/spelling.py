"""Spelling variants: words one edit apart, found with k-d trees over their letter counts.

* **Words.** Runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, counted over all texts: in numpy over the bytes of a slice of texts, then in a dictionary of bounded size, then by Spark.
* **Vectors.** A word is the vector of its letter counts (accented letters share six of the 32 dimensions). One edit changes at most one count by one up and one by one down, so near words of one length are at most two apart in L1, those of neighbouring lengths at most one.
* **Cells.** For each length, a k-d tree cuts the space into boxes of about `CELL` words. Its cuts come from a sample of at most `SAMPLE` words (by hash); every word of the corpus has its home in one box all the same, and visits every other box that its ball reaches, so the sample decides about speed alone. A box that no cut divides (anagrams) is dealt over several groups, each of which the others visit.
* **Searches.** A group builds a k-d tree with tight boxes over its words and searches it for all words of it, and all visitors, a level of the tree at a time: boxes beyond the radius are pruned, leaves compared by their vectors, what is left by the order of letters.
* **Forms.** Groups give counts and the best near word of each word; Spark adds them up. Words follow their forms by pointer doubling.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, share_of
from .words import U, Words, chunks

DIMS = 32
#: Words of a cell, and of the sample that the cells' cuts are taken from.
CELL, SAMPLE = 32_768, 200_000
LEAF = 16
#: Different words that a task counts before it hands them on.
COUNTED = 400_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_C3 = 0xC3  # the first byte of U+00C0 to U+00FF
_CLASS = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)], dtype=np.int64)


def _letters(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters."""
    lead = buf == _C3
    return _LETTER[buf] | lead | np.concatenate(([False], lead[:-1]))


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1).astype(np.uint32)
    return x


_CRC = _crc_table()


def crc32_on(crc: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = 64) -> np.ndarray:
    """CRC-32 of buf[start : start + size], gone on with from `crc`, for all runs at once; runs longer than `most` one by one."""
    order = np.argsort(-size, kind="stable")
    at, long = start[order], size[order]
    x = crc[order] ^ np.uint32(0xFFFFFFFF)
    whole = int(np.searchsorted(-long, -most, "left"))
    for p in range(int(long[whole]) if whole < len(long) else 0):
        k = int(np.searchsorted(-long, -p, "left"))
        part = slice(whole, k)
        x[part] = _CRC[(x[part] ^ buf[at[part] + p]) & np.uint32(255)] ^ (x[part] >> np.uint32(8))
    out = np.empty_like(x)
    out[order] = x ^ np.uint32(0xFFFFFFFF)
    for k in order[:whole].tolist():
        out[k] = zlib.crc32(buf[start[k] : start[k] + size[k]].tobytes(), int(crc[k]))
    return out


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 5, often: int = 3, drop_every: int = 0) -> DataFrame:
    """(word, n) of the words of at least `least` letters that occur at least `often` times in all texts; a null text has none.

    drop_every: plants spelling errors. A run whose crc32 of `<doc_id>:<run>` that number divides loses its letter number crc32 % length; rows without an id lose none.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch, texts in chunks(batches, "text"):
            w = Words([t.translate(_LOWER) for t in texts], _letters)
            size = w.end - w.start
            keep = np.ones(len(size), dtype=bool)
            raw = w.buf.tobytes()
            if drop_every:
                ids = batch.column("id").to_pylist()
                doc = w.text_of_word()
                crc = crc32_on(np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)[doc], w.buf, w.start, size)
                hit = (crc % np.uint32(drop_every) == 0) & np.array([i is not None for i in ids], dtype=bool)[doc]
                for k in np.flatnonzero(hit).tolist():
                    word = raw[w.start[k] : w.end[k]].decode()
                    p = int(crc[k]) % len(word)
                    if len(word) > least:
                        seen[(word[:p] + word[p + 1 :]).encode()] += 1
                keep &= ~hit
            pairs = np.concatenate(([0], np.cumsum(w.buf == _C3)))
            keep &= size - (pairs[w.end] - pairs[w.start]) >= least
            own = np.flatnonzero(keep)
            _, first, n = np.unique(w.hash[own], return_index=True, return_counts=True)
            own = own[first]
            for a, b, k in zip(w.start[own].tolist(), w.end[own].tolist(), n.tolist(), strict=True):
                seen[raw[a:b]] += k
            if len(seen) > COUNTED:
                yield told()
        yield told()

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(one, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter counts of words in Latin-1, at most 255 each."""
    out = np.zeros((len(words), DIMS), dtype=np.uint8)
    for a in range(0, len(words), 1 << 16):
        own = words[a : a + (1 << 16)]
        size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        where = np.repeat(np.arange(len(own)) * DIMS, size) + _CLASS[np.frombuffer(b"".join(own), dtype=np.uint8)]
        out[a : a + len(own)] = np.minimum(np.bincount(where, minlength=len(own) * DIMS), 255).reshape(-1, DIMS)
    return out


class Tree:
    """A k-d tree: node k has the box lo[k], hi[k] and the children left[k], right[k] (-1: a leaf, with points order[start[k] : end[k]]).

    tight: boxes are those of the points; else those of the cuts, which hold any other point too.
    """

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        self.order = np.arange(len(points))
        lo, hi, left, right, start, end = [], [], [], [], [], []
        todo = [(0, len(points), np.zeros(DIMS, dtype=np.uint8), np.full(DIMS, 255, dtype=np.uint8), -1, False)]
        while todo:
            a, b, low, high, parent, upper = todo.pop()
            k, own = len(lo), points[self.order[a:b]]
            if parent >= 0:
                (right if upper else left)[parent] = k
            if tight and b > a:
                low, high = own.min(axis=0), own.max(axis=0)
            lo.append(low), hi.append(high), left.append(-1), right.append(-1), start.append(a), end.append(b)
            if b - a <= leaf:
                continue
            # the cut nearest to the middle, of any dimension after its first few counts
            share = np.array([(own > v).mean(axis=0) for v in range(4)])
            v, dim = np.unravel_index(np.abs(share - 0.5).argmin(), share.shape)
            above = own[:, dim] > v
            n = int(np.count_nonzero(above))
            if n in (0, b - a):
                continue
            self.order[a:b] = self.order[a:b][np.argsort(above, kind="stable")]
            under, over = high.copy(), low.copy()
            under[dim], over[dim] = v, v + 1
            todo += [(b - n, b, over, high, k, True), (a, b - n, low, under, k, False)]
        self.lo, self.hi = np.array(lo, dtype=np.uint8), np.array(hi, dtype=np.uint8)
        self.left, self.right, self.start, self.end = (np.array(x) for x in (left, right, start, end))

    def visit(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the point, leaf) of the leaves whose boxes are within `radius` (L1) of the points."""
        who, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        out = [(who[:0], node[:0])]
        while len(who):
            q, lo, hi = points[who], self.lo[node], self.hi[node]
            apart = np.minimum(np.maximum(lo, q) - np.minimum(hi, q), 31)
            near = ((np.ascontiguousarray(apart).view(U) * U(0x0101010101010101)) >> U(56)).sum(axis=1) <= radius
            who, node = who[near], node[near]
            leaf = self.left[node] < 0
            out.append((who[leaf], node[leaf]))
            who, node = who[~leaf], node[~leaf]
            who, node = np.concatenate((who, who)), np.concatenate((self.left[node], self.right[node]))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf whose box of cuts holds a point; boxes don't overlap."""
        who, leaf = self.visit(points, 0)
        out = np.zeros(len(points), dtype=np.int64)
        out[who] = leaf
        return out


def _thermometer(points: np.ndarray) -> np.ndarray:
    """64 bits of a vector: which counts are over 0, and over 1. Their Hamming distance is at most the L1 distance."""
    return np.packbits(np.concatenate((points > 0, points > 1), axis=1), axis=1).view(U)[:, 0]


def _matrix(words: list[bytes]) -> np.ndarray:
    """Words of one length, a row each."""
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters are one edit apart: as long, or those of b one letter longer."""
    n = a.shape[1]
    if n == b.shape[1]:
        return np.count_nonzero(a != b, axis=1) == 1
    ahead, behind = a == b[:, :n], a == b[:, 1:]
    same = np.concatenate((ahead, np.zeros((len(a), 1), dtype=bool)), axis=1).argmin(axis=1)
    tail = np.concatenate((behind[:, ::-1], np.zeros((len(a), 1), dtype=bool)), axis=1).argmin(axis=1)
    return same + tail >= n


def _search(tree: Tree, points: np.ndarray, mark: np.ndarray, letters: np.ndarray, visitors: list[bytes], radius: int, own: bool = False, tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (visitor, word of the tree) that are one edit apart. own: the visitors are the tree's words; each pair once."""
    other = _matrix(visitors)
    for a in range(0, len(visitors), tile):
        q = vectors(visitors[a : a + tile])
        who, leaf = tree.visit(q, radius)
        size = tree.end[leaf] - tree.start[leaf]
        begin = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        i, j = np.repeat(who, size), tree.order[step - np.repeat(begin - tree.start[leaf], size)]
        if own:
            later = j > i + a
            i, j = i[later], j[later]
        near = np.bitwise_count(_thermometer(q)[i] ^ mark[j]) <= radius
        i, j = i[near], j[near]
        near = np.abs(q[i].astype(np.int16) - points[j]).sum(axis=1) <= radius
        i, j = i[near] + a, j[near]
        near = one_edit(other[i], letters[j])
        yield i[near], j[near]


_BEST = "word string, n_near long, form string, form_n long"


def _near_in_cell(table: pa.Table) -> pa.Table:
    """For each word of a cell and each visitor: how many of its near words it meets here, and the best."""
    words = [w.encode("latin-1") for w in table["word"].to_pylist()]
    n, role = table["n"].to_numpy(), table["role"].to_numpy()
    home = np.flatnonzero(role == 0)
    found = []
    if len(home):
        of = lambda rows: [words[k] for k in rows.tolist()]
        points = vectors(of(home))
        tree, mark, letters = Tree(points, LEAF, True), _thermometer(points), _matrix(of(home))
        for visitors, radius in ((home, 2), (np.flatnonzero(role == 1), 2), (np.flatnonzero(role == 2), 1)):
            if len(visitors):
                for i, j in _search(tree, points, mark, letters, of(visitors), radius, visitors is home):
                    found += [(visitors[i], home[j]), (home[j], visitors[i])]
    a, b = (np.concatenate([x[k] for x in found] or [home[:0]]) for k in (0, 1))
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.argsort(np.array(words))] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), dtype=bool), a[1:] != a[:-1])))
    times = np.diff(np.append(first, len(a)))
    word = table["word"].combine_chunks()
    return pa.table({"word": word.take(pa.array(a[first])), "n_near": pa.array(times, pa.int64()), "form": word.take(pa.array(b[first])), "form_n": pa.array(n[b[first]], pa.int64())})


class Cells:
    """For each length of words, the boxes that they are dealt over. Cells are numbered over all lengths."""

    def __init__(self, words: list[str], sizes: dict[int, int], cell: int):
        by: dict[int, list[bytes]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w.encode("latin-1"))
        self.tree, self.base, at = {}, {}, 0
        for length in sorted(sizes):
            own = by.get(length, [])
            # as many of the sample as stand for a cell of words
            leaf = max(1, len(own) * cell // sizes[length]) if sizes[length] > cell else len(own)
            self.tree[length], self.base[length] = Tree(vectors(own), leaf, False), at
            at += len(self.tree[length].left)

    def homes(self, words: list[bytes]) -> np.ndarray:
        size, out = np.fromiter(map(len, words), dtype=np.int64, count=len(words)), np.zeros(len(words), dtype=np.int64)
        for length in np.unique(size).tolist():
            own = np.flatnonzero(size == length)
            out[own] = self.base[length] + self.tree[length].home(vectors([words[k] for k in own.tolist()]))
        return out

    def visits(self, words: list[bytes], home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(numbers of words, cells, role): 1 in later cells of their length, 2 in those of the next."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for length in np.unique(size).tolist():
            own = np.flatnonzero(size == length)
            points = vectors([words[k] for k in own.tolist()])
            who, leaf = self.tree[length].visit(points, 2)
            cell = self.base[length] + leaf
            later = cell > home[own[who]]
            yield own[who[later]], cell[later], 1
            if length + 1 in self.tree:
                who, leaf = self.tree[length + 1].visit(points, 1)
                yield own[who], self.base[length + 1] + leaf, 2


def _dealt(vocabulary: DataFrame, cell: int, sample: int) -> DataFrame:
    """(cell, deal, role, word, n): each word at home (role 0) and where it visits."""
    size = F.length("word").alias("size")
    sizes = {r["size"]: r["count"] for r in vocabulary.groupBy(size).count().collect()}  # a row for each length of words
    large = [k for k, n in sizes.items() if n > cell]
    words = []
    if large:
        share = sample / sum(sizes[k] for k in large)
        words = [r[0] for r in vocabulary.where(F.length("word").isin(large) & share_of(F.xxhash64("word"), share)).select("word").limit(2 * sample).collect()]
    cells = Cells(words, sizes, cell)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = cells.homes([w.encode("latin-1") for w in batch.column("word").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(home)], names=["word", "n", "cell"])

    homes = cut(vocabulary.mapInArrow(at_home, "word string, n long, cell long"))
    # cells of far more words than asked for are dealt over groups: at most one in four of `cell` words
    deals = {r["cell"]: -(-r["count"] // cell) for r in homes.groupBy("cell").count().where(F.col("count") > 4 * cell).collect()}

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            home = batch.column("cell").to_numpy()
            if not words:
                continue
            deal = np.array([zlib.crc32(w) % deals[c] if c in deals else 0 for w, c in zip(words, home.tolist(), strict=True)], dtype=np.int64)
            parts = [(np.arange(len(words)), home, deal, 0)]
            for who, cell_, role in cells.visits(words, home):
                times = np.array([deals.get(c, 1) for c in cell_.tolist()], dtype=np.int64)
                where = np.repeat(np.arange(len(who)), times)
                parts.append((who[where], cell_[where], np.arange(len(where)) - np.repeat(np.cumsum(times) - times, times), role))
            if deals:  # of the other groups of one's own cell, the later ones
                times = np.array([deals.get(c, 1) for c in home.tolist()], dtype=np.int64) - deal - 1
                where = np.repeat(np.arange(len(words)), times)
                parts.append((where, home[where], deal[where] + 1 + np.arange(len(where)) - np.repeat(np.cumsum(times) - times, times), 1))
            who = np.concatenate([p[0] for p in parts])
            role = np.concatenate([np.full(len(p[0]), p[3], dtype=np.int32) for p in parts])
            take = lambda c: batch.column(c).take(pa.array(who))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[1] for p in parts])), pa.array(np.concatenate([p[2] for p in parts])), pa.array(role), take("word"), take("n")], names=["cell", "deal", "role", "word", "n"])

    return homes.mapInArrow(out, "cell long, deal long, role int, word string, n long")


def near_words(vocabulary: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, n_near, form, form_n) of the words of `vocabulary` (word, n; words once, of letters up to U+00FF) that have near words: how many, and the one of largest n (ties: the least in code-point order). cell, sample: see above; they don't change the result."""
    found = _dealt(vocabulary, cell, sample).groupBy("cell", "deal").applyInArrow(_near_in_cell, _BEST)
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", "x.form", (-F.col("x.minus")).alias("form_n"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of `links` (word, form) followed to their ends, twice as far each time; a form has more occurrences than its word, so there are no rings."""
    now = cut(links.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        free(now)
        now = step
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(vocabulary: DataFrame, ratio: int = 2, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `vocabulary` (word, n).

    form: the near word of largest n (ties: the least in code-point order) if that is at least `ratio` times the word's n, else null; root: the last form that forms lead to, the word itself without one. A table without words gives an empty result.
    """
    if ratio < 2:
        raise ValueError("a form has at least twice as many occurrences, or words may follow each other for ever")
    words = cut(vocabulary.select("word", "n"))
    near = near_words(words, cell, sample)
    known = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(F.col("form_n") >= ratio * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n"))))
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
