"""SimHash near duplicates: 64-bit fingerprints of whole texts, linked at few differing bits, compared bit-sliced.

* **Fingerprint.** A bit is set if more than half the XXH64 hashes of a text's three-word shingles (repeats counted) have it.
* **Buckets.** Equal fingerprints are one node from the start, so copies cost nothing. Of two fingerprints that differ in `radius` bits, one of `radius + 1` groups of bits is equal in both: each fingerprint goes to a bucket for each group. A bucket of more than `MOST` fingerprints is dealt again by the bits that it has left, in as many groups, and so on: no task gets more, no pair is lost, and what a fingerprint costs doesn't grow with the corpus.
* **Bit-sliced comparison.** A bucket is kept as 64 planes, plane p holding bit p of all its fingerprints, 64 to a machine word. A fingerprint is compared with 64 others by one XOR a plane; carry-save counters, a few planes too, add the differing bits up in all lanes at once. Their overflow says that a lane is beyond the radius, and blocks of lanes that are all beyond it are abandoned.
* **Links.** A bucket gives each of its fingerprints a link to the least that it reaches there, not all pairs; components join what the buckets link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, free, join_hot, rows_fit
from .components import connected, named
from .words import U, chunks

SEED = 42
WORDS = 3
#: Fingerprints that a bucket has on average, and at most.
BLOCK, MOST = 4096, 16_384
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Planes before blocks are abandoned for the first time, and between the times after.
FIRST, NEXT = 16, 4

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = b" \t\n\v\f\r"
_ALL = U(0xFFFFFFFFFFFFFFFF)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; each list begins with the last words of the one before it, so that every shingle is in one list."""
    at, last = 0, []
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        last = [*last, *text[at:end].split()]
        at = end
        if at >= len(text) or len(last) >= WORDS:
            yield last
            last = last[1 - WORDS :]


def simhash(text: bytes) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    ones, n, words = np.zeros(64, dtype=np.int64), 0, []
    for words in _pieces(text.translate(_LOWER)):
        if len(words) < WORDS:
            continue
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(size + 1) - 1
        spans = map(slice, (end - size)[: 1 - WORDS].tolist(), end[WORDS - 1 :].tolist())
        k = len(words) - WORDS + 1
        h = np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), dtype=U, count=k)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += k
    if not n:
        return xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint) of every row, the fingerprint as a signed long; 0 for a null text or one without words."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            prints = np.array([simhash(t) for t in texts], dtype=U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints)], names=["id", "fingerprint"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(one, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint long")


def _planes(prints: np.ndarray) -> np.ndarray:
    """64 planes of bits, the fingerprints as lanes, 64 to a word."""
    bits = np.zeros((64, -(-len(prints) // 64) * 64), dtype=np.uint8)
    bits[:, : len(prints)] = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def within(prints: np.ndarray, radius: int, tile: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of distinct fingerprints that differ in at most `radius` bits, in slices of about `tile` words of lanes."""
    n, planes = len(prints), _planes(prints)
    width = planes.shape[1]
    # counters of so many bits, begun so that they overflow beyond the radius
    counters = radius.bit_length()
    begin = (1 << counters) - 1 - radius
    lanes = np.arange(64 * width)
    step = max(1, tile // width)
    for first in range(0, n, step):
        own = np.arange(first, min(n, first + step))
        word = np.arange(first // 64, width)  # lanes before the slice were compared from their side
        beyond = np.packbits((lanes[None, 64 * word[0] :] <= own[:, None]) | (lanes[None, 64 * word[0] :] >= n), axis=1, bitorder="little").view("<u8")
        query = [np.where(prints[own] >> U(p) & U(1), _ALL, U(0)) for p in range(64)]
        count = [np.full(beyond.shape, _ALL if begin >> c & 1 else U(0)) for c in range(counters)]
        row = col = None
        for p in range(64):
            if row is None:
                carry = planes[p, word][None, :] ^ query[p][:, None]
            else:
                carry = planes[p, col] ^ query[p][row]
            for c in count:
                more = c & carry
                c ^= carry
                carry = more
            beyond |= carry
            if p + 1 >= FIRST and (p + 1 - FIRST) % NEXT == 0:
                alive = np.nonzero(beyond != _ALL)
                row, col = (own[alive[0]] - first, word[alive[1]]) if row is None else (row[alive[0]], col[alive[0]])
                beyond, count = beyond[alive], [c[alive] for c in count]
                if not len(row):
                    break
        else:
            near, lane = np.nonzero(np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield own[row[near]], 64 * col[near] + lane


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`label`, the least node that each reaches, after the links i - j."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j = i[differ], j[differ]
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (label[label] != label).any():
            label = label[label]


def stars(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least one that it reaches within `prints`) of those that reach another; prints: distinct."""
    label = np.arange(len(prints))
    for i, j in within(prints, radius):
        label = _merged(label, i, j)
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def _finer(mask: int, groups: int, most: int = 64) -> list[int]:
    """`mask`, the bits that a bucket's fingerprints share, with the first bits (`most` of them) of each of `groups` groups of the others."""
    left = [p for p in range(64) if not mask >> p & 1]
    cuts = [len(left) * k // groups for k in range(groups + 1)]
    return [mask | sum(1 << p for p in left[a:b][:most]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(prints: DataFrame, radius: int, block: int, most: int) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all links within the radius do. prints: one column of distinct fingerprints."""
    spark = prints.sparkSession

    def star(table: pa.Table) -> pa.Table:
        a, b = stars(np.sort(table["fingerprint"].to_numpy().view(U)), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    n = prints.count()
    bits = min(64 // (radius + 1), max(0, math.ceil(math.log2(max(1, n) / block))))  # a bucket then has about `block`
    rows, masks, out = prints.select("fingerprint", F.lit(0).cast("long").alias("mask")), [0], []
    while True:
        finer = [(_signed(m), _signed(x)) for m in masks for x in (_finer(m, radius + 1, bits) if bits else [m])]
        # at most (radius + 1) ** level rows, and few levels: a bucket of k bits left has at most 2 ** k fingerprints
        dealt = rows.join(F.broadcast(spark.createDataFrame(finer, "mask long, finer long")), "mask").select("fingerprint", F.col("finer").alias("mask"), F.col("fingerprint").bitwiseAND(F.col("finer")).alias("value"))
        full = cut(dealt.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > most))
        largest = full.agg(F.max("n")).first()[0]
        if largest:
            right = full.drop("n")
            right = F.broadcast(right) if rows_fit(right, 500_000) else right  # 16 bytes each
            out.append(cut(dealt.join(right, ["mask", "value"], "left_anti").groupBy("mask", "value").applyInArrow(star, "a long, b long")))
            rows = cut(dealt.join(right, ["mask", "value"], "left_semi").select("fingerprint", "mask"))
            masks = [x & ((1 << 64) - 1) for x in {x for _, x in finer}]
            bits = max(1, math.ceil(math.log2(largest / block)) + 2)
        else:
            out.append(cut(dealt.groupBy("mask", "value").applyInArrow(star, "a long, b long")))
        free(full)
        if not largest:
            break
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    whole = cut(whole.distinct())
    free(*out)
    return whole


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(id, fingerprint, component_id) of every row of `docs`; component_id: smallest id that a chain of links reaches, links being between fingerprints that differ in at most `radius` bits.

    A null or empty text, or one without words, has fingerprint 0 and is linked like any other; fewer than three words are hashed as one shingle. Repeated rows stay. A row without an id takes part; its component has the smallest id there is, or null. Other columns are ignored. An empty table gives an empty result. block, most: fingerprints that a bucket has on average and at most; they don't change the result.
    """
    if not 0 < radius < 16:
        raise ValueError("a radius of 1 to 15 bits is asked for")
    rows = cut(fingerprints(docs, doc_id, text))
    nodes = cut(rows.groupBy(F.col("fingerprint").alias("node")).agg(F.min("id").alias("id")))
    edges = _links(nodes.select(F.col("node").alias("fingerprint")), radius, block, max(most, 1 << radius))
    root = connected(edges)
    ids = cut(named(nodes, root))
    free(edges, nodes, root)
    return join_hot(rows, ids.withColumnRenamed("node", "fingerprint"), "fingerprint").select("id", "fingerprint", "component_id")
