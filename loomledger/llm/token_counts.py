"""Token counts by a separator scan over flat token files.

A flat token file is nothing but token ids, document after document, each ended by the end-of-document id; it has no index. The file is read in blocks of a fixed size. Each block is searched for the id with one vector comparison and cut into stretches; the number of ends in all blocks before (a prefix scan over the blocks' counts) gives each stretch the number of its document, and the stretches of a document are added up, over as many blocks as it spans.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE of this vocabulary cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
BLOCK_TOKENS = 1 << 18
GROUP = 1024
#: Bytes of flat files that one task reads, about.
TASK_BYTES = 64 << 20


@functools.cache
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat token files: (shard, block, tokens, first, ids). tokens: unsigned 16-bit ids; each input partition is a shard.

    first and ids are no part of the files: they say which documents start in a block, for whoever wants to name the counts. A null text is an empty document, a null id stays one, repeated rows are documents of their own, other columns are left out. An id of the end that a text itself would yield can't arise: the vocabulary doesn't have it.
    """

    rows_ = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        shard, block, seen, first = TaskContext.get().partitionId(), 0, 0, 0
        parts: list[np.ndarray] = []
        held, ids = 0, []
        code = encoder(vocabulary)
        last = np.array([end], dtype="<u2")

        def rows(flat: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([flat.tobytes()], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(kind))], names=["shard", "block", "tokens", "first", "ids"])

        for batch in batches:
            kind = batch.column("id").type
            for name, value in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(name)
                seen += 1
                own = np.array(code.encode_ordinary(value or ""), dtype="<u2")
                parts += [own, last]
                held += len(own) + 1
                if held >= block_tokens:
                    flat = np.concatenate(parts)
                    while len(flat) >= block_tokens:
                        yield rows(flat[:block_tokens])
                        flat, block, first, ids = flat[block_tokens:], block + 1, seen, []
                    parts, held = [flat], len(flat)
        if held or ids:
            yield rows(np.concatenate(parts) if parts else last[:0])

    return rows_.mapInArrow(one, f"shard int, block long, tokens binary, first long, ids array<{rows_.schema['id'].dataType.simpleString()}>")


def read_flat(spark: SparkSession, path: str, width: int = 2, block_bytes: int = BLOCK_TOKENS * 2) -> DataFrame:
    """(shard, block, tokens) of flat token files of any length; `shard` is the file's path.

    `path` names a file, a folder or a glob in a store that both Spark and Arrow open (local, HDFS, S3, GCS, ABFS). Spark deals ranges of bytes; a task opens the file and reads its ranges only. Empty files have no blocks; a file that isn't made of tokens of `width` bytes raises.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    seen = files.agg(F.sum("length").alias("bytes"), F.max((F.col("length") % width != 0).cast("int")).alias("odd"), F.first(F.when(F.col("length") % width != 0, F.col("path")), ignorenulls=True).alias("which")).first()
    if seen["odd"]:
        raise ValueError(f"{seen['which']} isn't made of tokens of {width} bytes")
    step = max(width, block_bytes - block_bytes % width)
    ranges = files.where("length > 0").select(F.col("path").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block"))
    ranges = ranges.repartition(max(1, -(-(seen["bytes"] or 0) // TASK_BYTES)), "shard", "block")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), strict=True):
                store, name = FileSystem.from_uri(quote(re.sub(r"^file:/+", "file:///", shard), safe="/:@"))
                with store.open_input_file(name) as f:
                    f.seek(block * step)
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([block], pa.int64()), pa.array([f.read(step)], pa.binary())], names=["shard", "block", "tokens"])

    return ranges.mapInArrow(one, "shard string, block long, tokens binary")


def _cut_up(end: int, dtype: str):
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "tokens")), strict=True):
                flat = np.frombuffer(raw, dtype=dtype)
                ends = np.flatnonzero(flat == end)
                n = np.diff(np.concatenate(([-1], ends))) - 1
                rest = len(flat) - (ends[-1] + 1 if len(ends) else 0)
                sizes = np.append(n, rest)
                k = np.arange(len(sizes), dtype=np.int64)
                closed = k < len(ends)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(shard, batch.column("shard").type), len(k)), pa.array(np.full(len(k), block, dtype=np.int64)), pa.array(k), pa.array(sizes.astype(np.int64)), pa.array(closed)], names=["shard", "block", "k", "n", "closed"])

    return one


def scan(blocks: DataFrame, end: int = END, dtype: str = "<u2") -> DataFrame:
    """(shard, ordinal, n_tokens, closed) of every document in blocks (shard, block, tokens); the end isn't counted.

    What follows the last end of a shard is a document only if it has tokens; closed is false for it. Documents without tokens count 0. Blocks may come in any order; an empty table gives no rows.
    """
    kind = blocks.schema["shard"].dataType.simpleString()
    stretches = cut(blocks.select("shard", "block", "tokens").mapInArrow(_cut_up(end, dtype), f"shard {kind}, block long, k long, n long, closed boolean"))
    counts = stretches.groupBy("shard", "block").agg(F.sum(F.col("closed").cast("long")).alias("ends")).withColumn("part", F.floor(F.col("block") / GROUP))
    # prefix sums in two steps, over groups of blocks and within them: no window holds a whole large file
    groups = counts.groupBy("shard", "part").agg(F.sum("ends").alias("of_group"))
    groups = groups.select("shard", "part", F.coalesce(F.sum("of_group").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("groups_before"))
    inside = Window.partitionBy("shard", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("here", F.coalesce(F.sum("ends").over(inside), F.lit(0))).join(groups, ["shard", "part"]).select("shard", "block", (F.col("here") + F.col("groups_before")).alias("offset"))
    numbered = stretches.join(offsets, ["shard", "block"]).select("shard", (F.col("offset") + F.col("k")).alias("ordinal"), "n", "closed")
    return numbered.groupBy("shard", "ordinal").agg(F.sum("n").alias("n_tokens"), F.max("closed").alias("closed")).where("closed or n_tokens > 0")


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, shard, ordinal, n_tokens) of every row of `docs`, counted in the flat token files that its texts make: 0 for a null or empty text; null ids and repeated rows keep their rows, other columns are left out, an empty table gives no rows."""
    blocks = cut(write_flat(docs, doc_id, text, vocabulary, block_tokens=block_tokens))
    names = blocks.select("shard", "first", F.posexplode("ids").alias("at", "id")).select("shard", (F.col("first") + F.col("at")).alias("ordinal"), "id")
    return names.join(scan(blocks), ["shard", "ordinal"]).select(F.col("id").alias(doc_id), "shard", "ordinal", "n_tokens")
