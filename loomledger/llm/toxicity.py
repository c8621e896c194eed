"""Toxicity by a factorization machine over hashed terms (Rendle, 2010).

Terms are the words of a text and their first 3 to 8 bytes, hashed into 2^18 slots; a text has a term or hasn't. The counts of every slot over all labelled training texts choose the slots that the model sees. The machine has a weight for each and a short vector; the product of two vectors is the weight of the pair, so an insult beside the mention of a group counts for more than the two alone.

Training takes at most `MOST_ROWS` labelled texts, a share of them by a hash of their id; counts and scores cover all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, rows_fit, share_of
from .words import ALNUM, U, Words, chunks

SLOTS = 1 << 18
TERMS = 1024
PREFIXES = (3, 4, 5, 6, 7, 8)
#: How much more an error on a toxic text counts: there are fewer of them.
TOXIC_WEIGHT = 4.0
FACTORS = 4
MOST_ROWS = 20_000
EPOCHS = 120
#: Bytes of text that a task has in hand: their terms take some sixty times as much.
SLICE = 500_000


def held_out(doc_id: Column | str) -> Column:
    """Whether a row is kept from training: crc32 of the id as text is divisible by 5."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every term of some texts, each once, in order."""
    w = Words(texts, ALNUM)
    own = w.text_of_word()
    who, slot = [own], [w.hash]
    for n in PREFIXES:
        at, hashes = w.prefix(n)
        who.append(own[at])
        slot.append(hashes)
    both = np.unique(np.concatenate(who).astype(U) * U(SLOTS) + np.concatenate(slot) % U(SLOTS))
    return (both // U(SLOTS)).astype(np.int64), (both % U(SLOTS)).astype(np.int64)


class Machine:
    """score = sigmoid(bias + sum w + sum of the products of the vectors of each pair of terms)."""

    def __init__(self, slots: np.ndarray, bias: float):
        self.number = np.full(SLOTS, -1, dtype=np.int32)
        self.number[slots] = np.arange(len(slots))
        self.bias, self.w = bias, np.zeros(len(slots))
        self.v = np.random.default_rng(1).normal(0, 0.02, (FACTORS, len(slots)))

    def known(self, text: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        term = self.number[slot]
        return text[term >= 0], term[term >= 0]

    def raw(self, text: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.stack([np.bincount(text, v[term], n) for v in self.v])
        squares = np.bincount(text, (self.v**2).sum(0)[term], n)
        return self.bias + np.bincount(text, self.w[term], n) + 0.5 * ((sums**2).sum(0) - squares), sums

    def score(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(text, term, n)[0], -30, 30)))

    def fit(self, text: np.ndarray, term: np.ndarray, label: np.ndarray, rate: float = 0.05, decay: float = 3e-4) -> None:
        """Adam on the logistic loss of all rows at once."""
        n, m = len(label), len(self.w)
        weight = np.where(label > 0, TOXIC_WEIGHT, 1.0) / n
        params = [np.array([self.bias]), self.w, *self.v]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, EPOCHS + 1):
            raw, sums = self.raw(text, term, n)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label) * weight
            each = error[text]
            total = np.bincount(term, each, m)
            grads = [np.array([error.sum()]), total + decay * self.w]
            grads += [np.bincount(term, each * s[text], m) - total * v + decay * v for s, v in zip(sums, self.v, strict=True)]
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            self.bias = float(params[0][0])


def _examples(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """(id, text, label) of the labelled rows that aren't held out; a document is toxic if any of its labels says so."""
    own = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).groupBy("id").agg(F.max("label").alias("label")).where(~held_out("id"))
    own = F.broadcast(own) if rows_fit(own, 500_000) else own
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(own, "id")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label with each slot; slot -1: all texts."""
    n = np.zeros((2, SLOTS + 1), dtype=np.int64)
    for batch, texts in chunks(batches, "text", SLICE):
        label = np.array(batch.column("label").to_pylist(), dtype=np.int64) > 0
        text, slot = terms(texts)
        for k in (0, 1):
            n[k, :SLOTS] += np.bincount(slot[label[text] == k], minlength=SLOTS)
            n[k, SLOTS] += np.count_nonzero(label == k)
    slot = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n[0, slot]), pa.array(n[1, slot])], names=["slot", "clean", "toxic"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS) -> Machine | None:
    """A machine fitted to the labels, or None if there are no examples of one label.

    Labels that are null, or of ids that no row has, don't count; rows without an id have none. Of repeated labels of an id the highest holds; repeated rows of an id count each. Empty tables give None.
    """
    examples = _examples(docs, labels, doc_id, text, label)
    # at most SLOTS + 1 rows, whatever the corpus
    rows = examples.select("text", "label").mapInArrow(_counted, "slot int, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    whole = rows[rows.slot == SLOTS]
    if whole.empty or not whole.clean.iloc[0] or not whole.toxic.iloc[0]:
        return None
    all_clean, all_toxic = int(whole.clean.iloc[0]), int(whole.toxic.iloc[0])
    rows = rows[rows.slot < SLOTS]
    # the root of the chi-square statistic of each slot against the label
    p, q, n = rows.toxic.astype(float), rows.clean.astype(float), all_toxic + all_clean
    gain = np.abs(p * (all_clean - q) - q * (all_toxic - p)) / np.sqrt((p + q + 1) * (n - p - q + 1))
    chosen = rows.assign(gain=gain).sort_values(["gain", "slot"], ascending=[False, True]).slot.to_numpy()[:TERMS]
    model = Machine(np.sort(chosen), float(np.log(all_toxic / all_clean)))
    number = model.number

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", SLICE):
            text_, slot = terms(texts)
            term = number[slot]
            text_, term = text_[term >= 0], term[term >= 0]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text_, np.arange(len(texts) + 1)), pa.int32()), pa.array(term))
            yield pa.RecordBatch.from_arrays([batch.column("by"), lists, batch.column("label")], names=["by", "terms", "label"])

    by = F.xxhash64("id")
    few = examples.select(by.alias("by"), "text", "label").where(share_of(by, most_rows / n_all) if (n_all := all_clean + all_toxic) > most_rows else F.lit(True))
    # about most_rows of them, cut to so many
    sample = few.mapInArrow(encode, "by long, terms array<int>, label int").toPandas().sort_values("by", kind="stable")[:most_rows]
    count = np.array([len(x) for x in sample.terms])
    model.fit(np.repeat(np.arange(len(sample)), count), np.concatenate(sample.terms.to_list()).astype(np.int64), (sample.label.to_numpy() > 0).astype(float))
    return model


def scored(docs: DataFrame, model: Machine | None, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """`docs` (its columns `keep`, or all) with a score from 0 to 1, and that column's name. Null and empty texts have the score of no terms; without a model all have 0."""
    (name,) = fresh(docs, "toxic_score")
    columns = docs.columns if keep is None else keep
    if model is None:
        return docs.select(*columns, F.lit(0.0).alias(name)), name
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text, SLICE):
            m = shared.value
            score = m.score(*m.known(*terms(texts)), len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(score)], names=[*columns, name])

    return docs.mapInArrow(one, T.StructType([*(docs.schema[c] for c in columns), T.StructField(name, T.DoubleType())])), name


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows that score `threshold` or more; the same columns. Rows with a null id or text are scored like all others; repeated rows score alike."""
    out, name = scored(docs, train(docs, labels, doc_id, text, label), text)
    return out.where(F.col(name) < threshold).select(*(out[c] for c in docs.columns))
