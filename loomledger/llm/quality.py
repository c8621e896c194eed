"""Quality from weak labels: overlapping heuristic labellers vote, expectation-maximisation estimates how accurate each is (Dawid and Skene, 1979), and the posterior labels train a linear scorer over hashed features.

Votes are 1 (good), 0 (bad) or -1 (none). Only counts of vote patterns go to the estimation, at most 3 to the number of labellers of them, whatever the corpus. The scorer is trained on at most `MOST_ROWS` texts, a share of all rows by a hash of id and text; votes, patterns and scores cover all. A text is read once: its votes and features are kept as a table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, share_of

SLOTS = 1 << 16
MOST_ROWS = 20_000
ROUNDS = 50
LABELLERS = ("capitals", "marks", "separators", "repeats", "variety", "plain", "length")

_RUNS = re.compile(r"(.)\1+", re.DOTALL)
_CLASSES = str.maketrans({**{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "0" for c in range(48, 58)}})


def votes(text: str) -> tuple[int, ...]:
    """The labellers' votes on a text, in the order of LABELLERS. An empty text has a vote against it by its length, and no others."""
    words = text.split()
    n = len(words)
    if not n:
        return (-1,) * 6 + (0,)
    letters = sum(map(str.isalpha, text)) or 1
    upper = sum(map(str.isupper, text)) / letters
    marked = sum(1 for w in words if not w[-1].isalnum() and len(w) > 1 and not w[-2].isalnum()) / n
    alone = sum(1 for w in words if not any(map(str.isalnum, w))) / n
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    variety = len(set(words)) / n
    cores = [w.strip(".,;:!?()\"'") for w in words]
    plain = sum(w.isalpha() and (len(w) < 2 or w[1:].islower()) for w in cores) / n
    return (
        0 if upper > 0.3 else -1,
        0 if marked > 0.15 else -1,
        0 if alone > 0.08 else -1,
        0 if again > 0.1 else -1,
        0 if n >= 50 and variety < 0.15 else -1,
        1 if plain > 0.85 else 0 if plain < 0.6 else -1,
        1 if n >= 20 else -1,
    )


def features(text: str) -> dict[int, float]:
    """Hashed shares of word shapes, of words that repeat the one before, and the logarithm of the length; it sees no labeller's thresholds."""
    words = text.split()
    if not words:
        return {zlib.crc32(b"empty") % SLOTS: 1.0}
    shapes = Counter(_RUNS.sub(r"\1", text.translate(_CLASSES)).split())
    out: dict[int, float] = {}
    for shape, k in shapes.items():
        for key in (shape, "end " + shape[-1:], "in " + shape[:1]):
            slot = zlib.crc32(key.encode("utf-8", "surrogatepass")) % SLOTS
            out[slot] = out.get(slot, 0.0) + k / len(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    out[zlib.crc32(b"again") % SLOTS] = 3 * again
    out[zlib.crc32(b"short") % SLOTS] = 1 / len(words)
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """By EM over vote patterns: for each labeller P(vote | true label) as [label, vote], the share of good texts, and each pattern's posterior of good."""
    m = patterns.shape[1]
    # begin with: a text is bad if any labeller says so
    good = np.where((patterns == 0).any(axis=1), 0.1, 0.9)
    table, share = np.zeros((m, 2, 3)), 0.5
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - good), counts * good])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        for j in range(m):
            for label in (0, 1):
                table[j, label] = np.bincount(patterns[:, j] + 1, weight[label], 3) + (0.1, 0.1 + 0.9 * (label == 0), 0.1 + 0.9 * (label == 1))
                table[j, label] /= table[j, label].sum()
        logs = np.log([1 - share, share])[:, None] + sum(np.log(table[j][:, patterns[:, j] + 1]) for j in range(m))
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return table, float(share), good


def _code(text: str) -> int:
    """The votes on a text as one number, in base 3."""
    return sum((v + 1) * 3**j for j, v in enumerate(votes(text)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes and features of a batch's texts: each text is read once."""
    for whole in batches:
        for batch in (whole.slice(at, 1000) for at in range(0, len(whole), 1000)):
            texts = batch.column("text").to_pylist()
            found = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("by"), pa.array([_code(t) for t in texts], pa.int32()), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float32()))],
                names=["id", "by", "code", "slots", "shares"],
            )


def read(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, by, code, slots, shares) of every row: a hash of id and text, its votes as one number, its features. A null text counts as empty."""
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("by", F.xxhash64("id", "text"))
    return own.mapInArrow(_read, f"id {own.schema['id'].dataType.simpleString()}, by long, code int, slots array<int>, shares array<float>")


def label_model(rows: DataFrame) -> tuple[dict[int, float], dict[str, float], int]:
    """From rows with the `code` of `read`: the posterior of each vote pattern, the estimated accuracy of each labeller when it votes, and the number of rows. Repeated rows count each."""
    found = rows.groupBy("code").count().orderBy("code").collect()  # 3 to the number of labellers at most
    if not found:
        return {}, {}, 0
    code, counts = np.array([r["code"] for r in found]), np.array([r["count"] for r in found], dtype=float)
    patterns = np.stack([code // 3**j % 3 - 1 for j in range(len(LABELLERS))], axis=1)
    table, share, good = estimate(patterns, counts)
    prior = np.array([1 - share, share])
    right = {name: float((prior * [t[0, 1], t[1, 2]]).sum() / (prior[:, None] * t[:, 1:]).sum()) for name, t in zip(LABELLERS, table, strict=True)}
    return dict(zip(code.tolist(), good.tolist(), strict=True)), right, int(counts.sum())


def _fit(rows: list[tuple[list[int], list[float], float]], steps: int = 200, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """A logistic regression on soft labels, by AdaGrad over all rows at once."""
    n = np.array([len(r[0]) for r in rows])
    row, slot = np.repeat(np.arange(len(rows)), n), np.concatenate([np.array(r[0], dtype=np.int64) for r in rows])
    value, label = np.concatenate([np.array(r[1]) for r in rows]), np.array([r[2] for r in rows])
    w, bias, total, total_bias = np.zeros(SLOTS), 0.0, np.full(SLOTS, 1e-8), 1e-8
    weight = np.where(label < 0.5, 0.5 / max(1e-9, (label < 0.5).mean()), 0.5 / max(1e-9, (label >= 0.5).mean())) / len(rows)
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(np.bincount(row, w[slot] * value, len(rows)) + bias, -30, 30))) - label) * weight
        g, gb = np.bincount(slot, error[row] * value, SLOTS) + decay * w, error.sum()
        total += g * g
        total_bias += gb * gb
        w -= rate * g / np.sqrt(total)
        bias -= rate * gb / np.sqrt(total_bias)
    return w, bias


def weak_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS, threshold: float = 0.5) -> DataFrame:
    """(doc_id, posterior, score, keep) of every row of `docs`: the label model's and the scorer's probability that the text is good; keep: score >= threshold.

    The scorer's sample is of all rows, those without a label by any labeller too; of rows with one hash of id and text (repeated rows) any may be the last that it takes, and they are alike. A null text counts as empty. Equal texts score alike, repeated rows and rows without an id too. A text is read whole, however long. Other columns are ignored; an empty table gives no rows.
    """
    own = cut(read(docs, doc_id, text))
    posterior, _, n = label_model(own)
    sample = own.where(share_of(F.col("by"), most_rows / max(n, 1)) if n > most_rows else F.lit(True)).select("by", "slots", "shares", "code")
    # about most_rows of them, cut to so many
    rows = sorted((r["by"], r["slots"], r["shares"], posterior[r["code"]]) for r in sample.collect())
    rows = [r[1:] for r in rows[:most_rows]]
    w, bias = _fit(rows) if rows else (np.zeros(SLOTS), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), bias, posterior))  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, posterior = shared.value
        for batch in batches:
            slots, shares = batch.column("slots"), batch.column("shares")
            n = np.diff(slots.offsets.to_numpy())
            value = w[slots.flatten().to_numpy()].astype(np.float64) * shares.flatten().to_numpy()
            raw = bias + np.bincount(np.repeat(np.arange(len(n)), n), value, len(n))
            good = pa.array([posterior[c] for c in batch.column("code").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), good, pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], names=["id", "posterior", "score"])

    schema = T.StructType([own.schema["id"], T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())])
    scored = own.select("id", "code", "slots", "shares").mapInArrow(score, schema)
    return scored.select(F.col("id").alias(doc_id), "posterior", "score", (F.col("score") >= threshold).alias("keep"))
