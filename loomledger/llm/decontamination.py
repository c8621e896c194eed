"""Benchmark decontamination by suffix arrays over the training texts.

The documents are dealt into shards of a few MB as Spark reads them. Each shard gets a suffix array over its words (in the order of their 64-bit hashes, which is as good as any), and every suffix of every benchmark text is looked up by binary search, one word deeper at a time. That gives the places of each benchmark suffix in the shard; equal windows of the benchmark have the same places and are taken once, so work grows with the places and not with places times items. Each place of a window then finds its longest verbatim match between its neighbours in the benchmark's own suffix array, and the documents touched by a match of a whole window are marked. Documents move nowhere: there is no shuffle at all.

The benchmark is a stated query set. It goes to the tasks in blocks of at most `BLOCK_BYTES`; each block is one pass over the documents. With several blocks rows are numbered once, and a pass writes numbers and what it found, no texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh
from .words import ALNUM, Runs, U, Words, chunks

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Suffixes of the documents are told apart by so many words at most: more than any window has.
DEPTH = 16


def suffix_array(words: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Places in the order of the suffixes that start there, by prefix doubling up to `depth` words; only what is still tied is sorted again."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if n else np.zeros(0, dtype=bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, dtype=np.int64)
    rank = np.full(n + depth, -1, dtype=np.int64)  # past the end: before all others
    rank[order] = start
    k = 1
    while k < depth:
        tied = ~new | np.append(~new[1:], False) if n else new
        slot = np.flatnonzero(tied)
        if not len(slot):
            break
        place = order[slot]
        key = (start[slot].astype(U) << U(32)) | (rank[place + k] + 1).astype(U)
        by = np.argsort(key, kind="stable")
        key, place = key[by], place[by]
        order[slot] = place
        differs = np.concatenate(([True], key[1:] != key[:-1]))
        new[slot] = differs
        first = np.maximum.accumulate(np.where(differs, slot, 0))
        start[slot] = first
        rank[place] = first
        k *= 2
    return order


class Suffixes:
    """All suffixes of the benchmark texts of a block, and their windows."""

    def __init__(self, items: list[tuple[str, str]]):
        w = Words([t.encode() for _, t in items], ALNUM)
        self.ids = np.array([i for i, _ in items], dtype=object)
        self.hash = np.append(w.hash, np.zeros(DEPTH, dtype=U))
        length = np.diff(w.first)
        self.item = np.repeat(np.arange(len(items)), length)
        self.at = np.arange(len(w.hash))
        self.left = np.repeat(w.first[1:], length) - self.at  # words to the end of the item
        self.need = np.minimum(np.repeat(length, length), WINDOW)

    def matches(self, text: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(d, suffixes, lo, hi): what matches d words, and where in the suffix array; for d = 1, 2, ... up to DEPTH, as long as any does."""
        sorted_first = text[order]
        lo = np.searchsorted(sorted_first, self.hash[self.at], "left")
        hi = np.searchsorted(sorted_first, self.hash[self.at], "right")
        alive, d, n = np.flatnonzero(hi > lo), 1, len(text)
        lo, hi = lo[alive], hi[alive]
        while len(alive):
            yield d, alive, lo, hi
            more = self.left[alive] > d
            alive, lo, hi = alive[more], lo[more], hi[more]
            if not len(alive):
                return
            if d == DEPTH:
                return
            value = self.hash[alive + d]
            ends = []
            for right in (False, True):
                a, b = lo.copy(), hi.copy()
                while (go := a < b).any():
                    mid = (a + b) >> 1
                    place = order[np.minimum(mid, n - 1)] + d
                    seen = np.where(place < n, text[np.minimum(place, n - 1)], U(0))
                    after = ((seen <= value) if right else (seen < value)) & go
                    a = np.where(after, mid + 1, a)
                    b = np.where(go & ~after, mid, b)
                ends.append(a)
            lo, hi = ends
            found = hi > lo
            alive, lo, hi, d = alive[found], lo[found], hi[found], d + 1

    @cached_property
    def ordered(self) -> np.ndarray:
        """The benchmark's own suffix array: suffixes with a window of full length in the order of their words, an item's end (hash 0) before all words."""
        ends = np.flatnonzero(self.left == 1) + 1
        text = np.insert(self.hash[: len(self.at)], ends, U(0))
        suffix_at = np.full(len(text), -1)
        suffix_at[self.at + np.searchsorted(ends, self.at, "right")] = self.at
        order = suffix_at[suffix_array(text, 1 << int(self.left.max(initial=1)).bit_length())]
        return order[(order >= 0) & (self.left[order] >= WINDOW)]

    def longest(self, text: np.ndarray, place: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of `text`, with `left` words to the end of its document: a suffix that agrees with it longest, and in how many words. Both neighbours of the place in the suffix array are compared; of two as good, the one before it is taken."""
        order, own, other = self.ordered, Runs(self.hash), Runs(text)

        def common(suffix: np.ndarray) -> np.ndarray:
            """Words that agree, by halving."""
            a, b = np.zeros(len(place), dtype=np.int64), np.minimum(self.left[suffix], left)
            while (a < b).any():
                mid = (a + b + 1) >> 1
                same = own.hash(suffix, suffix + mid) == other.hash(place, place + mid)
                a, b = np.where(same, mid, a), np.where(same, b, mid - 1)
            return a

        lo, hi = np.zeros(len(place), dtype=np.int64), np.full(len(place), len(order))
        while (go := lo < hi).any():
            mid = (lo + hi) >> 1
            suffix = order[np.minimum(mid, len(order) - 1)]
            n = common(suffix)
            ended = n == self.left[suffix]
            before = ended | ((n < left) & (self.hash[np.where(ended, 0, suffix + n)] < text[np.minimum(place + n, len(text) - 1)]))
            lo, hi = np.where(go & before, mid + 1, lo), np.where(go & ~before, mid, hi)
        under, over = order[np.maximum(lo - 1, 0)], order[np.minimum(lo, len(order) - 1)]
        n_under, n_over = common(under), common(over)
        return np.where(n_under >= n_over, under, over), np.maximum(n_under, n_over)


_HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_LONGEST = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("words", T.LongType())])
_ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", _HITS), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", _LONGEST)])


def _shard(suffixes: Suffixes, texts: list[bytes]) -> list[dict]:
    """What each text of a shard has of the benchmark."""
    w = Words(texts, ALNUM)
    first = w.first + np.arange(len(w.first))  # one separator after each text, hash 0: it matches nothing
    text = np.insert(w.hash, w.first[1:], U(0))
    order = suffix_array(text)
    hit = np.zeros(len(text) + 1, dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    holders, found_doc, found_window = [], [none], [none]  # items of each different window; which document has which window
    best_place, best_words, best_suffix = [none], [none], [none]
    for d, alive, lo, hi in suffixes.matches(text, order):
        whole = (suffixes.need[alive] == d) & (suffixes.left[alive] >= d)  # a short item is a window only at its first word
        if not whole.any():
            continue
        alive, lo, hi = alive[whole], lo[whole], hi[whole]
        by = np.argsort(lo, kind="stable")  # equal windows have the same places
        new = np.flatnonzero(np.diff(lo[by], prepend=-1))
        count = (hi - lo)[by[new]]
        slot = np.repeat(lo[by[new]] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        place, window = order[slot], np.repeat(np.arange(len(new)), count)
        np.add.at(hit, place, 1)
        np.add.at(hit, place + d, -1)
        doc = np.searchsorted(first, place, "right") - 1
        both = np.unique((doc << 32) | (window + len(holders)))
        found_doc.append(both >> 32)
        found_window.append(both & 0xFFFFFFFF)
        holders += [np.unique(suffixes.item[x]) for x in np.split(alive[by], new[1:])]
        if d < WINDOW:
            suffix, length = alive[by[new]][window], np.full(len(place), d)
        else:
            suffix, length = suffixes.longest(text, place, first[doc + 1] - 1 - place)
        best_place.append(place)
        best_words.append(length)
        best_suffix.append(suffix)
    place, length, suffix = (np.concatenate(x) for x in (best_place, best_words, best_suffix))
    doc = np.searchsorted(first, place, "right") - 1
    by = np.lexsort((place, -length, doc))
    best = {}
    for k in by[np.flatnonzero(np.diff(doc[by], prepend=-1))].tolist():  # the first of each text
        item = suffixes.item[suffix[k]]
        best[int(doc[k])] = {"item_id": str(suffixes.ids[item]), "item_word": int(suffix[k] - np.searchsorted(suffixes.item, item)), "doc_word": int(place[k] - first[doc[k]]), "words": int(length[k])}
    covered = (np.cumsum(hit)[:-1] > 0).astype(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0]))))
    spans: dict[int, list] = {}
    for a, b in edge.reshape(-1, 2).tolist():
        doc = int(np.searchsorted(first, a, "right")) - 1
        spans.setdefault(doc, []).append({"start": a - int(first[doc]), "end": b - int(first[doc])})
    doc, window = np.concatenate(found_doc), np.concatenate(found_window)
    by = np.argsort(doc, kind="stable")
    doc, window = doc[by], window[by]
    edges = np.flatnonzero(np.diff(doc, prepend=-1))
    items: dict[int, list] = {}
    for i, own in zip(doc[edges].tolist(), np.split(window, edges[1:]) if len(edges) else [], strict=True):
        items[i] = sorted(set(suffixes.ids[np.unique(np.concatenate([holders[x] for x in own]))].tolist()))
    words = np.diff(w.first).tolist()
    return [{"n_words": n, "hits": spans.get(i, []), "items": items.get(i, []), "longest": best.get(i)} for i, n in enumerate(words)]


def _merged(parts: list[dict]) -> dict:
    """What the blocks of the benchmark found in a text."""
    spans: list[dict] = []
    for x in sorted((x for p in parts for x in p["hits"]), key=lambda x: (x["start"], x["end"])):
        if spans and x["start"] <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], x["end"])
        else:
            spans.append(dict(x))
    best = min((p["longest"] for p in parts if p["longest"]), key=lambda x: (-x["words"], x["doc_word"], x["item_id"], x["item_word"]), default=None)
    return {"n_words": parts[0]["n_words"], "hits": spans, "items": sorted({x for p in parts for x in p["items"]}), "longest": best}


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """`docs` (its columns `keep`, or all) with a column of what the benchmark has in each text, and that column's name.

    The column is a struct: n_words; hits, the disjoint word ranges that lie in occurrences of benchmark windows; items, the sorted distinct ids with such windows; longest, the longest verbatim match through a window, with its places (ties: the first place in the text; of items, any one, the same in each run).

    A window is 10 consecutive words of an item, or all words of a shorter one. Null and empty texts have no words. Items without words match nothing; repeated items count once. All columns of `docs` stay as they are.
    """
    (name,) = fresh(docs, "contamination")
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    stay = docs.drop(name).columns if keep is None else keep

    def search(rows: DataFrame, own: DataFrame, stay: list[str], all_rows: bool) -> DataFrame:
        # bounded: a block of the stated query set
        block = rows.sparkSession.sparkContext.broadcast(sorted((r["i"], r["t"]) for r in own.collect()))

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            suffixes = Suffixes(block.value)
            for batch, texts in chunks(batches, text):
                found = _shard(suffixes, texts)
                if not all_rows:
                    hit = [i for i, x in enumerate(found) if x["hits"]]
                    batch, found = batch.take(pa.array(hit, pa.int64())), [found[i] for i in hit]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stay), pa.array(found, _arrow)], names=[*stay, name])

        return rows.mapInArrow(one, T.StructType([*(rows.schema[c] for c in stay), T.StructField(name, _ADDED)]))

    if blocks == 1:
        return search(docs, items, stay, True), name
    (row,) = fresh(docs.withColumn(name, F.lit(0)), "row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    parts = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        part = cut(search(numbered.select(row, text), own, [row], k == 0))
        parts = part if parts is None else parts.union(part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(row), pa.array([_merged(x) for x in batch.column(name).to_pylist()], _arrow)], names=[row, name])

    found = parts.groupBy(row).agg(F.collect_list(name).alias(name)).mapInArrow(merge, part.schema)
    return numbered.join(found, row).select(*stay, name), name


_span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_arrow = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(_span)), ("items", pa.list_(pa.string())), ("longest", pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())]))])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` without those in which any benchmark window occurs; the same columns."""
    found, name = contamination(docs, benchmark, text, item_id, item_text)
    return found.where(F.size(F.col(name)["hits"]) == 0).select(*(found[c] for c in docs.columns))
