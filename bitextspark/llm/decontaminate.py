"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. One pass over the corpus looks up every n-gram of words in the n-grams of the benchmark
   and cuts a window of words around the hits, so only passages that share an n-gram leave
   the scan.
2. Windows of the same words are one from here on, so an item that very many documents copy
   with their surroundings is aligned once.
3. Every shared n-gram, common or not, pairs a window with the items that hold it, so what is
   found in a document does not depend on other documents. Each pair is aligned word by
   word. The score is the best local alignment over the item's length: 1 for a verbatim
   copy; replaced, dropped and inserted words cost a little each, so paraphrased or edited
   copies stay above `min_score`. A copy without any n-gram of its item is not found,
   whatever its score would be.

The benchmark is small by nature; `MAX_ITEM_BYTES` bounds what is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextspark.llm.components import _store
from bitextspark.llm.words import NOT_ALNUM, blocks, window_hash, words

MAX_ITEM_BYTES = 64 << 20
_FILTER_BITS = 22


@dataclass(frozen=True)
class Decontamination:
    """`gap`, `mismatch`: costs against 1 for an equal word. `slack`: words of a window
    beyond the longest item on each side of a hit, for insertions."""

    n: int = 4
    min_score: float = 0.4
    mismatch: float = 0.5
    gap: float = 0.5
    slack: int = 20


class _Items:
    """Word hashes of the benchmark's rows and their n-grams. A row is known by its number here, so
    rows with equal or null ids stay apart until the result is made."""

    def __init__(self, rows: list[tuple[int | None, str]], n: int):
        self.ids = [i for i, _ in rows]
        self.words: dict[int, np.ndarray] = {}
        grams: list[tuple[int, int]] = []
        for block in blocks(pa.array([t for _, t in rows], pa.string())):
            w = words(block, lower=True, separator=NOT_ALNUM)
            for i in range(block.rows):
                self.words[block.first + i] = w.hash[w.first[i] : w.first[i + 1]]
            at, hashes = window_hash(w, n)
            grams += zip(hashes.view(np.int64).tolist(), (block.first + w.row[at]).tolist())
        self.grams = sorted(set(grams))
        self.sorted = np.unique(np.array([g for g, _ in self.grams], dtype=np.int64).view(np.uint64))
        self.longest = max([n, *map(len, self.words.values())])


def _item_rows(items: DataFrame, item_id: str, text: str) -> list[tuple[int | None, str]]:
    """The benchmark's distinct rows, after a check of their size."""
    clean = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").distinct()
    size = clean.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"benchmark texts of {size} bytes; split the benchmark into parts of {MAX_ITEM_BYTES}")
    return sorted(((r["i"], r["t"]) for r in clean.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


WINDOWS = "doc_id bigint, start int, words binary, grams array<bigint>"


def windows(docs: DataFrame, items: _Items, cfg: Decontamination, doc_id: str, text: str) -> DataFrame:
    """Passages that share an n-gram with an item: word positions, word hashes, shared n-grams."""
    grams, reach, n = items.sorted, items.longest + cfg.slack, cfg.n
    mask = np.uint64((1 << _FILTER_BITS) - 1)
    present = np.zeros(1 << _FILTER_BITS, dtype=bool)
    present[(grams & mask).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                w = words(block, lower=True, separator=NOT_ALNUM)
                at, hashes = window_hash(w, n)
                may = present[(hashes & mask).astype(np.int64)]
                at, hashes = at[may], hashes[may]
                if not len(at) or not len(grams):
                    continue
                slot = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
                hit = grams[slot] == hashes
                at, hashes = at[hit], hashes[hit]
                if not len(at):
                    continue
                row = w.row[at]
                low = np.maximum(at - reach, w.first[row])
                high = np.minimum(at + n + reach, w.first[row + 1])
                fresh = np.ones(len(at), dtype=bool)
                fresh[1:] = (row[1:] != row[:-1]) | (low[1:] > np.maximum.accumulate(high)[:-1])
                starts = np.flatnonzero(fresh)
                ends = np.append(starts[1:], len(at))
                spans = [(int(low[a]), int(high[b - 1])) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows).take(pa.array(row[starts])),
                        pa.array(low[starts] - w.first[row[starts]], pa.int32()),
                        pa.array([w.hash[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([np.unique(hashes[a:b]).view(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "start", "words", "grams"],
                )

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, WINDOWS)


def align(item: np.ndarray, passages: np.ndarray, cfg: Decontamination) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of `item` in each row of `passages` (0-padded), and the
    ends (exclusive) of that alignment in the passage and in the item. Linear gap costs: a row
    of the matrix takes a running maximum instead of a loop over its columns. Of equal scores
    the one that ends first in the item counts, then the one that ends first in the passage."""
    count, width = passages.shape
    ramp = cfg.gap * np.arange(1, width + 1, dtype=np.float32)
    above = np.zeros((count, width + 1), dtype=np.float32)
    best, end, last = np.zeros(count, np.float32), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for at, word in enumerate(item):
        step = np.where(passages == word, np.float32(1), np.float32(-cfg.mismatch))
        row = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] - np.float32(cfg.gap)), 0)
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        top = row.argmax(axis=1)
        value = row[np.arange(count), top]
        better = value > best
        best[better], end[better], last[better] = value[better], top[better] + 1, at + 1
        above[:, 1:] = row
    return best, end, last


def alignment_start(item: np.ndarray, passage: np.ndarray, end: int, last: int, cfg: Decontamination) -> int:
    """Where the alignment that `align` found begins in the passage. Before its ends no other one
    scores as much, so aligning both beginnings backwards finds this one again."""
    if last <= end and np.array_equal(passage[end - last : end], item[:last]):
        return end - last
    return end - int(align(item[:last][::-1], passage[:end][::-1][None, :], cfg)[1][0])


MATCHES = "doc_id bigint, item_id bigint, score double, start int, end int"
#: `item` is the number of a benchmark row; `start` and `end` count from the window's first word.
ALIGNED = "digest string, item int, score double, start int, end int"


def _aligned(pairs: DataFrame, items: _Items, cfg: Decontamination) -> DataFrame:
    item_words = items.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(1).to_numpy(zero_copy_only=False)
            sizes = np.array([len(v.as_buffer()) // 8 for v in batch.column(2)], dtype=np.int64)
            keep: list[tuple[int, float, int, int]] = []
            order = np.lexsort((sizes, numbers))
            cuts = np.flatnonzero(np.diff(numbers[order], prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                item = item_words[int(numbers[order[a]])]
                at = a
                while at < b:  # passages of like length, up to 4 million cells a row at once
                    width = sizes[order[at]]
                    upto = at + 1
                    while upto < b and (upto - at + 1) * sizes[order[upto]] <= 1 << 20 and sizes[order[upto]] <= 2 * width + 64:
                        upto += 1
                    rows = order[at:upto]
                    block = np.zeros((len(rows), int(sizes[rows].max())), dtype=np.uint64)
                    for k, r in enumerate(rows):
                        block[k, : sizes[r]] = np.frombuffer(batch.column(2)[int(r)].as_buffer(), dtype=np.uint64)
                    best, end, last = align(item, block, cfg)
                    for k, r in enumerate(rows):
                        score = float(best[k]) / len(item)
                        if score >= cfg.min_score:
                            begin = alignment_start(item, block[k, : sizes[r]], int(end[k]), int(last[k]), cfg)
                            keep.append((int(r), round(score, 6), begin, int(end[k])))
                    at = upto
            rows = pa.array([k[0] for k in keep], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array([k[1] for k in keep], pa.float64()),
                    pa.array([k[2] for k in keep], pa.int32()),
                    pa.array([k[3] for k in keep], pa.int32()),
                ],
                names=["digest", "item", "score", "start", "end"],
            )

    return pairs.select("digest", "item", "words").mapInArrow(run, ALIGNED)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    cfg: Decontamination = Decontamination(),
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """`(doc_id, item_id, score, start, end)`: documents that hold a copy of an item.

    One row per document id and item id, of the best passage (ties: the first); `start` and `end`
    are the word positions of its alignment. Null and empty texts and items shorter than `n` words
    match nothing; rows with a null id are matched and keep the null. Different items of one id are
    all looked for; documents and items that share an id give one row per pair of ids. Empty tables
    give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    items = _Items(_item_rows(benchmark, item_id, item_text), cfg.n)
    if not items.grams:
        return spark.createDataFrame([], MATCHES)
    found = _store(windows(docs, items, cfg, doc_id, text).withColumn("digest", F.sha2("words", 256)), "windows")
    # A window's n-grams follow from its words.
    distinct = found.groupBy("digest").agg(F.first("words").alias("words"), F.first("grams").alias("grams"))
    distinct = _store(distinct, "distinct")
    postings = spark.createDataFrame(
        pa.table({"gram": pa.array([g for g, _ in items.grams], pa.int64()), "item": pa.array([i for _, i in items.grams], pa.int32())})
    )
    ids = spark.createDataFrame(
        pa.table({"item": pa.array(range(len(items.ids)), pa.int32()), "item_id": pa.array(items.ids, pa.int64())})
    )
    # At most the benchmark's n-grams, whose texts were checked above.
    shared = distinct.select("digest", F.explode("grams").alias("gram")).join(F.broadcast(postings), "gram")
    pairs = shared.select("digest", "item").distinct()
    scored = _aligned(distinct.drop("grams").join(pairs, "digest"), items, cfg)
    scored = scored.join(F.broadcast(ids), "item")
    aligned = found.select("doc_id", F.col("start").alias("at"), "digest").join(scored, "digest").select(
        "doc_id", "item_id", "score", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end")
    )
    best = aligned.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("score", (-F.col("start")).alias("before"), (-F.col("end")).alias("until"))).alias("m")
    )
    return best.select(
        F.col("doc_id").alias(doc_id),
        F.col("item_id").alias(item_id),
        F.col("m.score").alias("score"),
        (-F.col("m.before")).alias("start"),
        (-F.col("m.until")).alias("end"),
    )
