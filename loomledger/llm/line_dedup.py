"""Deletes runs of lines that occurred before, by winnowing over line hashes (Schleimer, Wilkerson and Aiken, 2003).

Lines are those with words; two agree when their words do. Each line starts a *gram*, the fewest lines from there that hold half of `min_words` words, and a *window*, the fewest that hold `min_words`. A window's fingerprint is the least gram hash of those that lie in it, the rightmost of equal ones. Two places that share a run of `min_words` words share its windows whole, hence their fingerprints at the same lines. Only these places are kept, each once, however many windows chose it.

* Windows that a text itself repeats are found where the text is read; their later places give no fingerprints.
* Places of a fingerprint are joined with its first one only, in the order of (doc_id, line), and extended both ways as long as the lines agree. Runs of `min_words` words or more go.
* A place whose first one agrees on less than one of its windows may share that window with another place. Such windows, and those of first places, meet once more by a hash of all their lines. A window that occurs at two places is left over at both or at neither, so no repeat is missed.

Lines near a place travel with it (those of twice `min_words` words on either side), never the lines of a whole text. A deleted line always has an earlier copy, so what repeats stays once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free, fresh, join_hot, scratch
from .words import U, Words, chunks, runs_hash

MIN_WORDS = 50
#: Edits of so many bytes in all are broadcast; beyond that the texts are shuffled to them.
MOST_BYTES = 32 << 20


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with words of some texts, one after another: hash, number of words, and number of the line in its text, blank ones counted; and where each text's lines begin (and the last one's end)."""
    w = Words(texts, cased=True)
    line = np.searchsorted(np.flatnonzero(w.buf == 10), w.start)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(line)), dtype=bool), line[1:] != line[:-1])))
    end = np.append(at[1:], len(line)).astype(np.int64)
    first = np.searchsorted(at, w.first)
    breaks = np.array([0, *(t.count(b"\n") + 1 for t in texts)], dtype=np.int64)
    number = line[at] - np.repeat(np.cumsum(breaks)[:-1] + 1, np.diff(first))
    return runs_hash(w.hash, at, end), end - at, number, first


class Windows:
    """The windows of texts' lines: start, last (lines of all texts, one after another), at (the line of the fingerprint), name (hash of all lines), again (whether the text has it before) and, if so, first (where); gram: hashes of the grams of all lines."""

    def __init__(self, lines: np.ndarray, words: np.ndarray, first: np.ndarray, min_words: int):
        n = len(lines)
        before = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(words)))
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        reach = lambda m: np.searchsorted(before[1:], before[:-1] + m)  # noqa: E731  the last line of the fewest that hold m words
        half = reach(max(1, min_words // 2))
        self.gram = runs_hash(lines, np.arange(n), np.minimum(half + 1, n))
        last = reach(min_words)
        self.start = np.flatnonzero(last < first[1:][text]) if n else np.zeros(0, dtype=np.int64)
        self.last = last[self.start]
        self.name = runs_hash(lines, self.start, self.last + 1)
        self.text = text[self.start]
        self.at = self._least(self.start, np.searchsorted(half, self.last, "right") - 1)
        order = np.lexsort((self.start, self.name, self.text))
        same = np.concatenate((np.zeros(min(1, len(order)), dtype=bool), (self.name[order][1:] == self.name[order][:-1]) & (self.text[order][1:] == self.text[order][:-1])))
        self.again, self.first = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=np.int64)
        self.again[order] = same
        self.first[order] = self.start[order][np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else 0

    def _least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the gram hash is least in each range a to b, the rightmost of equal ones."""
        if not len(a):
            return a
        level = np.floor(np.log2(b - a + 1)).astype(np.int64)
        best, out = np.arange(len(self.gram)), np.zeros(len(a), dtype=np.int64)
        for k in range(int(level.max()) + 1):
            if k:
                left, right = best[: len(best) - (1 << k - 1)], best[1 << k - 1 :]
                best = np.where(self.gram[right] <= self.gram[left], right, left)
            own = np.flatnonzero(level == k)
            left, right = best[a[own]], best[b[own] - (1 << k) + 1]
            out[own] = np.where(self.gram[right] <= self.gram[left], right, left)
        return out


def _lists(values: dict[str, np.ndarray] | np.ndarray, text: np.ndarray | None, n: int, first: np.ndarray | None = None) -> pa.ListArray:
    """One list for each of n texts; text: whose each value is, in order, or first: where each text's values begin."""
    ends = np.searchsorted(text, np.arange(n + 1)) if first is None else first
    flat = pa.StructArray.from_arrays([pa.array(v) for v in values.values()], names=list(values)) if isinstance(values, dict) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)


_LINES = "k long, id {}, lines array<long>, words array<int>, again array<struct<start:int,last:int>>, prints array<struct<at:int,key:long>>"


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """For each text its lines (hash and words), the ranges of them that repeat others of the text, and the fingerprints of the rest."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            lines, words, _, first = lines_of(texts)
            w, n = Windows(lines, words, first, min_words), len(texts)
            last = w.last.copy()
            grow = np.flatnonzero(w.again)
            while len(grow):  # a run that repeats may have a few more lines, too few for a window
                grow = grow[last[grow] + 1 < first[1:][w.text[grow]]]
                grow = grow[lines[last[grow] + 1] == lines[last[grow] + 1 - w.start[grow] + w.first[grow]]]
                grow = grow[words_between(words, w.last[grow], last[grow]) < min_words]
                last[grow] += 1
            begin = first[w.text]
            own = {"start": (w.start - begin)[w.again].astype(np.int32), "last": (last - begin)[w.again].astype(np.int32)}
            at = np.unique(w.at[~w.again])
            of = np.searchsorted(first, at, "right") - 1
            prints = {"at": (at - first[of]).astype(np.int32), "key": w.gram[at].view(np.int64)}
            columns = [batch.column("k"), batch.column("id"), _lists(lines.view(np.int64), None, n, first), _lists(words.astype(np.int32), None, n, first), _lists(own, w.text[w.again], n), _lists(prints, of, n)]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "id", "lines", "words", "again", "prints"])

    return docs.mapInArrow(one, _LINES.format(docs.schema["id"].dataType.simpleString()))


def words_between(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words in the lines after a, up to b."""
    before = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(words)))
    return before[b + 1] - before[a + 1]


def _near(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """(place, left, lines, words): the lines that hold `reach` words on either side of each wanted place of a text; left: how many of them come before it."""
    for batch in batches:
        place, left, lines, words = [], [], [], []
        for k, places, own, count in zip(*(batch.column(c) for c in ("place", "at", "lines", "words")), strict=True):
            own, count, at = own.values.to_numpy(), count.values.to_numpy(), np.array(places.as_py())
            before = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(count)))
            a = np.maximum(np.searchsorted(before, before[at] - reach, "right") - 1, 0)
            b = np.minimum(np.searchsorted(before, before[at] + reach), len(own))
            place += k.as_py()
            left += (at - a).tolist()
            lines += [own[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            words += [count[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(left, pa.int32()), pa.array(lines, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))], names=["place", "left", "lines", "words"])


def _extended(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The range of lines round each place that agree with those round the other, if they hold `min_words` words."""
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        rows = zip(*(batch.column(c).to_pylist() for c in ("k", "at", "left", "lines", "words", "old_left", "old_lines")), strict=True)
        for k, at, left, lines, words, old_left, old in rows:
            a = 0
            while a < left and a < old_left and lines[left - a - 1] == old[old_left - a - 1]:
                a += 1
            b = 0
            while left + b < len(lines) and old_left + b < len(old) and lines[left + b] == old[old_left + b]:
                b += 1
            if sum(words[left - a : left + b]) >= min_words:
                for x, v in zip(out, (k, at, at - a, at + b - 1), strict=True):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), *[pa.int32()] * 3), strict=True)], names=["k", "at", "start", "last"])


def _first_places(places: DataFrame) -> DataFrame:
    """Places (k, id, at, key) of keys that occur at several, with the first one's place: (k, at, place, old_k, old_at, old_place). Repeated rows have the same places."""
    first = places.groupBy("key").agg(F.min(F.struct("id", "k", "at")).alias("old"), F.max(F.struct("id", "k", "at")).alias("new"), F.count("*").alias("n")).where("old < new")
    both = join_hot(places, first.select("key", F.col("old.k").alias("old_k"), F.col("old.at").alias("old_at")), "key", counts=first.select("key", "n"))
    return cut(both.select("k", "at", F.xxhash64("k", "at").alias("place"), "old_k", "old_at", F.xxhash64("old_k", "old_at").alias("old_place")).distinct())


def _matched(places: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """(k, at, start, last): what agrees round each place and its first one."""
    wanted = places.where("place != old_place")
    each = wanted.select("k", "at", "place").union(wanted.select("old_k", "old_at", "old_place")).distinct()
    each = each.groupBy("k").agg(F.collect_list(F.struct("at", "place")).alias("x")).select("k", "x.at", "x.place")
    near = cut(each.join(texts, "k").dropDuplicates(["k"]).select("place", "at", "lines", "words").mapInArrow(lambda it: _near(it, 2 * min_words), "place long, left int, lines array<long>, words array<int>"))
    old = near.select(F.col("place").alias("old_place"), F.col("left").alias("old_left"), F.col("lines").alias("old_lines"))
    both = join_hot(wanted.select("k", "at", "place", "old_place"), old, "old_place").join(near, "place")
    out = cut(both.select("k", "at", "left", "lines", "words", "old_left", "old_lines").mapInArrow(lambda it: _extended(it, min_words), "k long, at int, start int, last int"))
    free(near)
    return out


def _left_over(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Windows of places in `found` (at, start, last) that reach beyond what was matched there."""
    for batch in batches:
        n = len(batch)
        own, count = batch.column("lines"), batch.column("words")
        first = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum([len(x) for x in own])))
        lines, words = own.flatten().to_numpy().view(U), count.flatten().to_numpy()
        w = Windows(lines, words, first, min_words)
        low, high = np.full(len(lines), len(lines) + 1), np.full(len(lines), -1)
        there = np.zeros(len(lines), dtype=bool)
        for i, found in enumerate(batch.column("found").to_pylist()):
            for x in found:
                at = x["at"] + first[i]
                there[at] = True
                if x["start"] is not None:
                    low[at], high[at] = x["start"] + first[i], x["last"] + first[i]
        keep = there[w.at] & ~w.again & ~((low[w.at] <= w.start) & (w.last <= high[w.at]))
        text = w.text[keep]
        yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(text)), batch.column("id").take(pa.array(text)), pa.array((w.start[keep] - first[text]).astype(np.int32)), pa.array(w.name[keep].view(np.int64))], names=["k", "id", "at", "key"]) if n else batch


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(k, start, last): ranges of lines with words of a text that occurred before; ranges may overlap. k: `row_key` of the row."""
    lines = cut(_lines(docs.select(row_key(doc_id, text).alias("k"), F.col(doc_id).alias("id"), F.col(text).alias("text")), min_words).where(F.size("lines") > 0))
    texts = lines.select("k", "id", "lines", "words")
    places = _first_places(lines.select("k", "id", F.inline("prints")))
    runs = _matched(places, texts, min_words)
    found = places.select("k", "at").join(runs, ["k", "at"], "left").groupBy("k").agg(F.collect_list(F.struct("at", "start", "last")).alias("found"))
    kind = lines.schema["id"].dataType.simpleString()
    rest = cut(texts.join(found, "k").dropDuplicates(["k"]).mapInArrow(lambda it: _left_over(it, min_words), f"k long, id {kind}, at int, key long"))
    again = _first_places(rest)
    more = _matched(again, texts, min_words)
    free(places, rest, again)
    return runs.select("k", "start", "last").union(more.select("k", "start", "last")).union(lines.select("k", F.inline("again")))


def row_key(doc_id: str, text: str):
    """64-bit hash of a row's id and text: repeated rows share it, and are edited alike."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def _without(text: bytes, number: np.ndarray, ranges: list[dict]) -> bytes:
    """A text without ranges of its lines with words, which are its lines `number`; blank lines between two that go, go too."""
    rows = text.split(b"\n")
    gone = np.zeros(len(number) + 1, dtype=np.int64)
    np.add.at(gone, [r["start"] for r in ranges], 1)
    np.add.at(gone, [r["last"] + 1 for r in ranges], -1)
    gone = np.cumsum(gone)[:-1] > 0
    step = np.zeros(len(rows) + 1, dtype=np.int64)
    np.add.at(step, number[gone], 1)
    np.add.at(step, number[gone] + 1, -1)
    both = np.flatnonzero(gone[:-1] & gone[1:])
    np.add.at(step, number[both], 1)
    np.add.at(step, number[both + 1], -1)
    return b"\n".join(rows[j] for j in np.flatnonzero(np.cumsum(step)[:-1] == 0))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, drop_emptied: bool = True) -> DataFrame:
    """`docs` without the lines of runs of at least `min_words` words that occurred before, in the order of (doc_id, line); the same columns.

    Lines agree when their words do; blank lines don't count, and go with the lines on both sides of them. A text of which no word is left has repeated others in full; its row goes unless `drop_emptied` is false. Null, empty and short texts stay as they are. Rows with equal doc_id and text don't count as repeats of each other. Rows without a doc_id come first; of rows with one doc_id the order is that of a hash. If `docs` has an integer column n_chars it isn't recounted.
    """
    k, ranges = fresh(docs, "row_key", "ranges")
    with scratch() as keep:
        runs = repeated_runs(docs, doc_id, text, min_words)
        # one row for each text with repeats
        edits = keep(cut(runs.groupBy("k").agg(F.collect_set(F.struct("start", "last")).alias(ranges)).withColumnRenamed("k", k)))
    size = edits.agg(F.sum(F.size(ranges) * 8 + 32)).first()[0] or 0
    edits = F.broadcast(edits) if size <= MOST_BYTES else edits
    schema, columns = T.StructType(docs.schema.fields), docs.columns

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            touched = np.flatnonzero(batch.column(ranges).is_valid().to_numpy(zero_copy_only=False))
            out = batch.select(columns)
            if len(touched):
                texts, keep = batch.column(text).to_pylist(), np.ones(len(batch), dtype=bool)
                for i in touched.tolist():
                    own = texts[i].encode()
                    texts[i] = _without(own, lines_of([own])[2], batch.column(ranges)[i].as_py()).decode()
                    keep[i] = not drop_emptied or bool(texts[i].encode().strip())
                at = out.schema.get_field_index(text)
                out = out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type)).filter(pa.array(keep))
            yield out

    return docs.withColumn(k, row_key(doc_id, text)).join(edits, k, "left").mapInArrow(one, schema)
