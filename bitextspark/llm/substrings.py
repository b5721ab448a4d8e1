"""Passages that repeat across documents, by content-defined chunking with a gear hash.

A gear hash rolls over the bytes of a text: h = (h << 1) + G[byte], here in 32 bits, so it
depends on the last 32 bytes only. A chunk border is a word start at which the hash (of the
bytes before it) is the least among the word starts within `reach` words on either side.
Borders depend on nearby content alone: an insertion moves them but does not change which
they are, and chunks have `reach` + 1 words at least and about 2 * `reach` + 1 on average.

Chunks are deduplicated by digest. A digest that occurs in two documents or more is a
repeat; consecutive repeated chunks of a document form a passage, which is reported from
`min_words` words on. A common passage of 50 words holds 20 words of whole chunks
(the rest may be cut off with the neighbouring text at its two ends).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitextspark.llm.words import blocks, code_points, mix, span_hash, words

REACH = 4
MIN_WORDS = 20
#: One random 32-bit value for each byte.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
CHUNKS = "doc_id bigint, ordinal int, start int, end int, n_words int, digest bigint"


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the window five times (1 to 32 bytes)."""
    h = GEAR[data]
    for k in range(5):
        step = 1 << k
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    return h


def borders(block, w, reach: int) -> np.ndarray:
    """Mask of the words that begin a chunk; the first word of a row always does."""
    n = len(w.start)
    if not n:
        return np.zeros(0, dtype=bool)
    h = gear_hash(block.data)
    before = np.maximum(w.start - 1, 0)
    value = mix(h[before].astype(np.uint64))
    first = w.first[w.row]
    # A window that reaches over the row's begin would see another document.
    clean = w.start - block.bounds[w.row] >= 32
    value[~clean] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = clean.copy()
    for k in range(1, reach + 1):
        same = w.row[k:] == w.row[:-k]
        least[k:] &= ~same | (value[k:] < value[:-k])
        least[:-k] &= ~same | (value[:-k] < value[k:])
    least |= np.arange(n) == first
    return least


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """`CHUNKS` of all texts; `start` and `end` are code points, `end` exclusive.

    Null, empty and blank texts have no chunks. Words are runs of non-blank characters,
    compared without ASCII case; the digest covers the words of the chunk alone, so blanks
    between words do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                w = words(block, lower=True)
                if not len(w.start):
                    continue
                at = np.flatnonzero(borders(block, w, reach))
                ends = np.append(at[1:], len(w.start))
                counts = ends - at
                row = w.row[at]
                # Order-dependent sums of word hashes; word positions count from the chunk's start.
                place = np.arange(len(w.start)) - np.repeat(at, counts)
                total = np.zeros(len(w.hash) + 1, dtype=np.uint64)
                np.cumsum(mix(w.hash + mix(place.astype(np.uint64))), out=total[1:])
                digest = mix(total[ends] - total[at] + counts.astype(np.uint64))
                points = code_points(block.data)
                base = points[block.bounds[row]]
                first_chunk = np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows).take(pa.array(row)),
                        pa.array(np.arange(len(at)) - first_chunk, pa.int32()),
                        pa.array(points[w.start[at]] - base, pa.int32()),
                        pa.array(points[w.end[ends - 1]] - base, pa.int32()),
                        pa.array(counts, pa.int32()),
                        pa.array(digest.view(np.int64)),
                    ],
                    names=["doc_id", "ordinal", "start", "end", "n_words", "digest"],
                )

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(
        "doc_id IS NOT NULL"
    ).mapInArrow(run, CHUNKS)


def passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH, min_words: int = MIN_WORDS
) -> DataFrame:
    """`(doc_id, start, end, n_words, n_chunks, first_doc, removed)`: the parts of passages
    that occur in another document too.

    A passage is a run of repeated chunks of `min_words` words or more. It is cut into parts by what
    happens to its chunks: a chunk is `removed` unless this document is the smallest id that holds it, so
    each chunk stays in one document at least. `first_doc` is the smallest of the ids that its
    chunks stay in. Repeats within one document alone are not reported. Rows with null ids are left out,
    rows that repeat an id count as one document's. An empty table gives no rows.
    """
    cut = chunks(docs, doc_id, text, reach)
    seen = (
        cut.groupBy("digest")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where("first_doc < last_doc")
        .select("digest", "first_doc")
    )
    repeated = cut.join(seen, "digest").drop("digest")
    # Consecutive ordinals share ordinal - rank. A document is one row's worth of chunks.
    order = W.partitionBy("doc_id").orderBy("ordinal", "start")
    run = repeated.withColumn("run", F.col("ordinal") - F.dense_rank().over(order))
    # Within a run: consecutive chunks of one decision; both windows share a sort.
    decided = run.withColumn("removed", F.col("doc_id") != F.col("first_doc"))
    turns = (F.col("removed") != F.lag("removed").over(order)).cast("int")
    parts = decided.withColumn("turn", turns).withColumn("part", F.sum(F.coalesce("turn", F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    sized = parts.withColumn("run_words", F.sum("n_words").over(W.partitionBy("doc_id", "run")))
    grouped = sized.where(F.col("run_words") >= min_words).groupBy("doc_id", "run", "part", "removed").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("n_words").cast("bigint").alias("n_words"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.min("first_doc").alias("first_doc"),
    )
    return grouped.select(
        F.col("doc_id").alias(doc_id),
        "start",
        "end",
        "n_words",
        "n_chunks",
        "first_doc",
        "removed",
    )


def without(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the removed passages cut out of `text`; other columns and rows stay."""
    spans = (
        found.where("removed")
        .groupBy(doc_id)
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    )
    kept = F.aggregate(
        "__spans",
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["done"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])).alias("done"), s["end"].alias("at")
        ),
        lambda acc: F.concat(acc["done"], F.substring(F.col(text), acc["at"] + 1, F.char_length(text))),
    )
    joined = docs.join(spans, doc_id, "left")
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)
