"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests (Goodrich and Mitzenmacher, 2011).

A paragraph is a line, or a sentence of it. Each paragraph's 64-bit digest (with the number of its occurrence, so that repeats don't cancel) goes to one cell in each of three tables: a count, the XOR of digests and the XOR of their checks. Two sketches subtract cell by cell; what both texts share vanishes, and peeling cells with one digest left recovers exactly the paragraphs that only one has. If peeling gets stuck the difference is too large for the sketch, and it is done again with four times the cells; a sketch with more cells than both texts have digests is stuck only if digests clash, and then the digests themselves are compared.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, share_of

CELLS = 8  # of each of three tables, in a fingerprint
_MASK = (1 << 64) - 1
_CHECK = 0xC2B2AE3D27D4EB4F
_SPLIT = re.compile(r"\n|(?<=[.!?]) ")


def digests(text: str) -> list[int]:
    """A 64-bit digest of each paragraph, all different."""
    out, seen = [], {}
    for part in _SPLIT.split(text):
        part = part.strip()
        if part:
            n = seen.get(part, 0)
            seen[part] = n + 1
            # not as the seed: for a few bytes that collides
            out.append(xxhash.xxh3_64_intdigest(f"{n} {part}".encode("utf-8", "surrogatepass")))
    return out


def sketch(keys: list[int], cells: int = CELLS, minus: list[int] = ()) -> tuple[list[int], list[int], list[int]]:
    """Counts, XORs of digests and XORs of checks of the cells; linear: the keys of `minus` are subtracted."""
    count, key, check = [0] * (3 * cells), [0] * (3 * cells), [0] * (3 * cells)
    for sign, some in ((1, keys), (-1, minus)):
        for k in some:
            h = (k * (2 * cells + 0x9E3779B97F4A7C15)) & _MASK
            c = ((k * _CHECK) & _MASK) >> 32
            for i in ((h >> 3) % cells, cells + (h >> 19) % cells, 2 * cells + (h >> 35) % cells):
                count[i] += sign
                key[i] ^= k
                check[i] ^= c
    return count, key, check


def peel(cells: int, count: list[int], key: list[int], check: list[int]) -> tuple[list[int], list[int]] | None:
    """The digests that only the first and only the second had, or None if stuck. The sketch is used up."""
    mul, one, two = 2 * cells + 0x9E3779B97F4A7C15, [], []
    todo = [i for i in range(3 * cells) if count[i] == 1 or count[i] == -1]
    while todo:
        i = todo.pop()
        sign = count[i]
        if sign != 1 and sign != -1:
            continue
        k = key[i]
        h = (k * mul) & _MASK
        c = ((k * _CHECK) & _MASK) >> 32
        if c != check[i]:
            continue
        places = ((h >> 3) % cells, cells + (h >> 19) % cells, 2 * cells + (h >> 35) % cells)
        if i not in places:
            continue
        if len(one) + len(two) > 3 * cells:  # a cell that only looked like one digest set it off
            return None
        (one if sign == 1 else two).append(k)
        for j in places:
            count[j] -= sign
            key[j] ^= k
            check[j] ^= c
            if count[j] == 1 or count[j] == -1:
                todo.append(j)
    return None if any(count) or any(key) or any(check) else (one, two)


def difference(a: list[int], b: list[int], base: tuple | None = None) -> tuple[list[int], list[int]]:
    """The digests that only a and only b has, by subtracted sketches of growing size; base: the sketches of both with CELLS cells."""
    cells = CELLS
    if base and abs(len(a) - len(b)) <= 3 * cells:  # else it can't be peeled
        (n, k, c), (m, l, d) = base
        found = peel(cells, [x - y for x, y in zip(n, m, strict=True)], [x ^ y for x, y in zip(k, l, strict=True)], [x ^ y for x, y in zip(c, d, strict=True)])
        if found:
            return found
    while 3 * cells <= len(a) + len(b):
        cells *= 4
        if 3 * cells < abs(len(a) - len(b)):
            continue
        found = peel(cells, *sketch(a, cells, b))
        if found:
            return found
    x, y = Counter(a), Counter(b)
    return list((x - y).elements()), list((y - x).elements())


def likeness(a: list[int], b: list[int], base: tuple | None = None) -> float:
    """Jaccard similarity of two lists of digests from the size of their difference; 1 if both are empty."""
    one, two = difference(a, b, base)
    apart, total = len(one) + len(two), len(a) + len(b)
    return 1.0 if not total else (total - apart) / (total + apart)


def written(n: int, s: tuple[list[int], list[int], list[int]]) -> str:
    """A sketch of n digests as text."""
    raw = np.array([n], dtype="<u4").tobytes() + (np.array(s[0]) & 0xFFFF).astype("<u2").tobytes() + np.array(s[1], dtype="<u8").tobytes() + np.array(s[2], dtype="<u4").tobytes()
    return base64.b64encode(raw).decode()


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the column fingerprint (fingerprint_ if taken). A null text counts as empty; equal texts have equal fingerprints."""
    (name,) = fresh(docs, "fingerprint")
    columns = docs.columns

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [digests(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([written(len(k), sketch(k)) for k in keys], pa.string())], names=[*columns, name])

    from pyspark.sql import types as T

    return docs.mapInArrow(one, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


_OUT = (("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"), ("fingerprint", pa.string(), "string"), ("edited_fingerprint", pa.string(), "string"), ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double"))
#: Bytes of text in a range of the order, about, and most ranges.
RANGE, RANGES = 32_000_000, 4000


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and falling id, a bucket's guest last; each row is compared with the one after it."""
    last, out = None, []
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, len(whole), 256)):
        for at, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("at", "guest", "id", "text")), strict=True):
            text = text or ""
            keys = digests(text)
            now = (at, guest, doc_id, text, keys, sketch(keys))
            if last is not None and last[0] == at and not last[1]:
                out.append(_row(last, now))
            last = now
        if out:
            kinds = [batch.schema.field("id").type, *(t for _, t, _ in _OUT)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", *(n for n, _, _ in _OUT)])
            out = []


def _row(now: tuple, after: tuple) -> tuple:
    _, _, doc_id, text, keys, own = now
    n = len(text)
    edited = text[: n - n // 2] + after[3][: n // 2]
    new = digests(edited)
    new_sketch = sketch(new)
    return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(len(keys), own), written(len(new), new_sketch), likeness(keys, new, (own, new_sketch)), likeness(keys, after[4], (own, after[5]))


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its fingerprint, that of its text with the second half taken from the next document (falling doc_id, rows without an id last; after the last: the first), and how like they are.

    The order is cut into ranges of about `RANGE` bytes, by the ids and, where there are none, by the texts' hashes; each range is one sorted stretch, and the first document of the stretch after it comes along as a guest. So texts are shuffled once and nothing but ids and hashes (two per range) reaches the driver. Ids may be numbers or texts. Null texts count as empty; of repeated ids, and without ids, each row is one, ordered by falling hash and then by text. An empty table gives no rows; a single document is its own next.
    """
    from pyspark.ml.feature import Bucketizer  # here: Python workers don't need it
    from pyspark.sql import types as T

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    kind = rows.schema["id"].dataType
    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} {t}" for n, _, t in _OUT)
    number = isinstance(kind, T.NumericType)
    steps = F.percentile_approx(F.col("id").cast("double"), [k / RANGES for k in range(1, RANGES)], 10 * RANGES) if number else F.lit(None)
    whole = rows.agg(steps.alias("x"), F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    if not whole["n"]:
        return rows.where("false").select("id", "text").mapInArrow(lambda it: iter(()), schema)
    parts = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (whole["bytes"] or 0) // RANGE + 1))
    if number:
        cuts = (whole["x"] or [])[:: max(1, RANGES // parts)]
    else:  # a sample of ids by their hashes, some for each range
        share = 20 * parts / whole["n"]
        some = sorted(r[0] for r in rows.where(F.col("id").isNotNull() & share_of(F.xxhash64("id"), share)).select("id").limit(100 * parts).collect())
        cuts = some[:: max(1, len(some) // parts)]
    # ranges fall as the ids do; rows without an id come after all others
    if number:
        splits = [-float("inf"), *(sorted({float(c) for c in cuts}) or [0.0]), float("inf")]
        dealt = Bucketizer(splits=splits, inputCol="x", outputCol="own").transform(rows.withColumn("x", F.coalesce(F.col("id").cast("double"), F.lit(0.0))))
    else:
        cuts = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast(f"array<{kind.simpleString()}>")
        dealt = rows.withColumn("own", F.array_size(F.filter(cuts, lambda c: c <= F.col("id"))))
    without = -1 - F.floor((F.lit(0.5) - F.col("h") / F.lit(2.0**64)) * parts * 0.999999).cast("int")
    dealt = dealt.select("id", "h", "text", F.when(F.col("id").isNull(), without).otherwise(F.col("own").cast("int")).alias("at"))
    ends = sorted(((r["at"], r["top"]) for r in dealt.groupBy("at").agg(F.max(F.struct("id", "h")).alias("top")).collect()), key=lambda r: r[0])  # a row for each range
    # the first row of a range is the next one after the last of the range above; that of the last range comes after all
    guests = [(*ends[k - 1][1], ends[k][0]) for k in range(len(ends))]
    guest = F.broadcast(spark.createDataFrame(guests, T.StructType([T.StructField("guest_id", kind), T.StructField("guest_h", T.LongType()), T.StructField("guest_at", T.IntegerType())])))
    both = dealt.join(guest, dealt["id"].eqNullSafe(F.col("guest_id")) & (dealt["h"] == F.col("guest_h")), "left")
    at_home = F.struct("at", F.lit(False).alias("guest"))
    both = both.withColumn("spot", F.explode(F.when(F.col("guest_at").isNull(), F.array(at_home)).otherwise(F.array(at_home, F.struct(F.col("guest_at").alias("at"), F.lit(True).alias("guest"))))))
    order = both.select("spot.at", "spot.guest", "id", "h", "text").repartition(parts, "at").sortWithinPartitions("at", "guest", F.desc_nulls_last("id"), F.desc("h"), "text")
    return order.mapInArrow(_compared, schema)
