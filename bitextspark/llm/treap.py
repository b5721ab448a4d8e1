"""Ranked lexical search over K2-treaps: quadtrees of the term-document grid with impact maxima.

Documents are indexed where they are read, in blocks of bounded size. The grid of a block has a row
for each of its terms (the most frequent first) and a column for each document (the shortest
first). A point of the grid is a term in a document; its impact is the part of the score that does not
depend on the term's weight: (10^9 * tf) div (1000 * tf + 20 * m), m growing with the document's
length. The grid is halved in both directions from level to level (the longer direction
alone at first). A level stores its occupied cells in Z order: four bits for the children of each
cell of the level above, and each cell's maximum as its difference to the maximum of the cell
above, so the bits and the differences are all there is, and a child is found by counting bits.

A query is a set of rows. Their paths go down the tree together: a range of columns holds, for each
of its rows, the cell that the row's path is in, and the sum of weight * maximum bounds the score of
each document in the range. Ranges are opened best first, some hundred at a time, and dropped when
their bound cannot reach the list of best documents any more. At the last level cells are points,
and bounds are scores. A task keeps its lists from block to block; only they are shuffled.

Terms are named by 64-bit hashes; two terms of one hash count as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitextspark.llm.words import NOT_ALNUM, blocks, bound_batches, words
from bitextspark.scale import scratch_path

#: An index block is closed once it has so many documents or bytes of text.
COLUMNS, TEXT_BYTES = 4096, 8_000_000
#: Bytes of query text that are searched in one pass over the index.
PACK_BYTES = 4_000_000
#: Column ranges that are opened at a time.
_OPENED = 256
_NO_ID = np.int64(np.iinfo(np.int64).max)
_ONES = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)
_INDEX = (
    "documents bigint, terms_in_all bigint, ids binary, terms binary, frequencies binary, row_bits int, column_bits int, "
    "children array<binary>, maxima array<binary>"
)


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with at least one term, and their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = every = 0
        for batch in batches:
            for block in blocks(batch.column(0)):
                counts = np.diff(words(block, lower=True, separator=NOT_ALNUM, hashed=False).first)
                some, every = some + int((counts > 0).sum()), every + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([every])], names=["some", "every"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(run, "some bigint, every bigint")
    total = counted.agg(F.coalesce(F.sum("some"), F.lit(0)), F.coalesce(F.sum("every"), F.lit(0))).first()
    return total[0], total[1]


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Impact of a term that occurs `tf` times in a document of `n` terms."""
    m = 100 - 50 + (50 * n.astype(np.int64) * documents) // max(terms, 1)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


def _bits(n: int) -> int:
    return max(1, (n - 1).bit_length())


def quadtree(row: np.ndarray, column: np.ndarray, value: np.ndarray, row_bits: int, column_bits: int) -> tuple[list, list]:
    """Children bits (a byte for each parent cell) and maxima (differences to the parent's; on
    the first level: to 2**20) of each level, from the top."""
    depth = max(row_bits, column_bits)
    code = np.zeros(len(row), dtype=np.int64)
    for b in range(depth):
        code |= (row >> b & 1) << (2 * b + 1) | (column >> b & 1) << (2 * b)
    order = np.argsort(code)
    code, top = code[order], value[order].astype(np.int64)
    children, maxima = [], []
    for _ in range(depth):
        above = code >> 2
        first = np.flatnonzero(np.diff(above, prepend=-1))
        higher = np.maximum.reduceat(top, first)
        sizes = np.diff(np.append(first, len(code)))
        children.append(np.add.reduceat(1 << (code & 3), first).astype(np.uint8))
        maxima.append((np.repeat(higher, sizes) - top).astype(np.int32))
        code, top = above[first], higher
    maxima[-1] += np.int32((1 << 20) - top[0])
    return children[::-1], maxima[::-1]


def _packed(nibbles: np.ndarray) -> bytes:
    padded = np.append(nibbles, np.zeros(len(nibbles) % 2, np.uint8))
    return (padded[::2] | padded[1::2] << 4).tobytes()


def _index_row(parts: list[tuple], documents: int, terms: int) -> dict:
    """One block of the index from parts `(ids, n, hash, document, tf)`."""
    ids = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    shift = np.cumsum([0, *(len(p[0]) for p in parts)])
    hashes = np.concatenate([p[2] for p in parts])
    at = np.concatenate([p[3] + s for p, s in zip(parts, shift)])
    tf = np.concatenate([p[4] for p in parts])
    columns = np.lexsort((ids, n))
    place = np.empty_like(columns)
    place[columns] = np.arange(len(columns))
    names, inverse, frequency = np.unique(hashes, return_inverse=True, return_counts=True)
    rows = np.argsort(-frequency, kind="stable")
    number = np.empty_like(rows)
    number[rows] = np.arange(len(rows))
    row_bits, column_bits = _bits(len(names)), _bits(len(ids))
    children, maxima = quadtree(number[inverse], place[at], impacts(tf, n[at], documents, terms), row_bits, column_bits)
    return {
        "documents": documents,
        "terms_in_all": terms,
        "ids": ids[columns].astype("<i8").tobytes(),
        "terms": names[rows].astype("<u8").tobytes(),
        "frequencies": frequency[rows].astype("<i4").tobytes(),
        "row_bits": row_bits,
        "column_bits": column_bits,
        "children": [_packed(c) for c in children],
        "maxima": [m.astype("<i4").tobytes() for m in maxima],
    }


_ARROW = pa.schema(
    [
        ("documents", pa.int64()),
        ("terms_in_all", pa.int64()),
        ("ids", pa.binary()),
        ("terms", pa.binary()),
        ("frequencies", pa.binary()),
        ("row_bits", pa.int32()),
        ("column_bits", pa.int32()),
        ("children", pa.list_(pa.binary())),
        ("maxima", pa.list_(pa.binary())),
    ]
)


def write(docs: DataFrame, location: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Index all rows of `docs` into a Parquet table; two passes over the texts and no shuffle.

    Rows without a term (null, empty or only separators) are not in the index. A row with a null id
    is indexed and found as null. Rows with one id are documents of their own. Other columns are not
    read. A row of the index is a row group of its own: Parquet looks at a row group's size only after 100
    rows, and a task holds the whole of the one that it writes or reads.
    """
    bound_batches(docs.sparkSession)
    documents, terms = corpus_size(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = size = 0
        for batch in batches:
            ids = batch.column(0).fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                w = words(block, lower=True, separator=NOT_ALNUM)
                counts = np.diff(w.first)
                some = np.flatnonzero(counts)
                if not len(some):
                    continue
                number = np.cumsum(counts > 0) - 1
                names, inverse = np.unique(w.hash, return_inverse=True)
                pair, tf = np.unique(inverse * len(some) + number[w.row], return_counts=True)
                parts.append((ids[block.first + some], counts[some], names[pair // len(some)], pair % len(some), tf))
                held, size = held + len(some), size + len(block.data)
                if held >= COLUMNS or size >= TEXT_BYTES:
                    yield pa.RecordBatch.from_pylist([_index_row(parts, documents, terms)], schema=_ARROW)
                    parts, held, size = [], 0, 0
        if parts:
            yield pa.RecordBatch.from_pylist([_index_row(parts, documents, terms)], schema=_ARROW)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    rows.mapInArrow(run, _INDEX).write.options(**{"compression": "zstd", "parquet.block.row.count.limit": "1"}).parquet(location)


@dataclass
class Level:
    """Cells above one level: `bits` of their children, the position of the first child, and the
    children's maxima."""

    bits: np.ndarray
    first: np.ndarray
    maxima: np.ndarray

    def child(self, cell: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Position of a child of each cell; -1 where there is none."""
        bits = np.where(cell >= 0, self.bits[cell], 0)
        at = self.first[cell] + _ONES[bits & ((1 << slot) - 1)]
        return np.where(bits >> slot & 1, at, -1)


class Treap:
    """One block of the index, ready for searches."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.terms = np.frombuffer(row["terms"], dtype="<u8")
        self.sorted = np.argsort(self.terms)
        self.row_bits, self.column_bits = row["row_bits"], row["column_bits"]
        self.depth = max(self.row_bits, self.column_bits)
        self.levels: list[Level] = []
        above = np.array([1 << 20], dtype=np.int64)
        for children, maxima in zip(row["children"], row["maxima"]):
            both = np.frombuffer(children, dtype=np.uint8)
            bits = np.stack([both & 15, both >> 4], axis=1).reshape(-1)[: len(above)].astype(np.int64)
            sizes = _ONES[bits]
            above = np.repeat(above, sizes) - np.frombuffer(maxima, dtype="<i4")
            self.levels.append(Level(bits, np.cumsum(sizes) - sizes, above))
        # Smallest id of each range of columns, level by level.
        padded = np.full(1 << self.column_bits, _NO_ID)
        padded[: len(self.ids)] = self.ids
        self.least = [padded.reshape(1 << min(level, self.column_bits), -1).min(axis=1) for level in range(self.column_bits + 1)]

    def rows(self, names: np.ndarray) -> np.ndarray:
        """Row of each term name; -1 where the block does not have it."""
        at = np.searchsorted(self.terms, names, sorter=self.sorted)
        at = self.sorted[np.minimum(at, len(self.sorted) - 1)]
        return np.where(self.terms[at] == names, at, -1)

    def search(self, rows: np.ndarray, weights: np.ndarray, best: "Best") -> None:
        """Bring the documents of this block into `best`, for terms `rows` with `weights`."""
        fits = (rows >= 0) & (weights > 0)
        rows, weights = rows[fits], weights[fits]
        if not len(rows):
            return
        # Open ranges of each level: bound, column prefix, cell of each row's path.
        fronts: list[list[tuple]] = [[] for _ in range(self.depth + 1)]
        fronts[0].append((np.array([weights.sum() << 20]), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64)))
        heads = [-1] * (self.depth + 1)
        heads[0] = int(fronts[0][0][0][0])
        while max(heads) >= 0:
            at = int(np.argmax(heads))
            bound, column, cell = (np.concatenate(x) for x in zip(*fronts[at])) if len(fronts[at]) > 1 else fronts[at][0]
            fronts[at], heads[at] = [], -1
            wanted = best.wants(bound, self._least(at, column))
            bound, column, cell = bound[wanted], column[wanted], cell[wanted]
            if len(bound) > _OPENED:
                order = np.argpartition(-bound, _OPENED)
                later = order[_OPENED:]
                fronts[at].append((bound[later], column[later], cell[later]))
                heads[at] = int(bound[later].max())
                column, cell = column[order[:_OPENED]], cell[order[:_OPENED]]
            if not len(column):
                continue
            level, shift = self.levels[at], self.depth - 1 - at
            slot = 2 * (rows >> shift & 1) if shift < self.row_bits else np.zeros(len(rows), np.int64)
            for half in (0, 1) if shift < self.column_bits else (0,):
                below = level.child(cell, slot + half)
                total = np.where(below >= 0, level.maxima[below], 0) @ weights
                prefix = 2 * column + half if shift < self.column_bits else column
                wanted = np.flatnonzero(best.wants(total, self._least(at + 1, prefix)))
                if not len(wanted):
                    continue
                if shift:
                    fronts[at + 1].append((total[wanted], prefix[wanted], below[wanted]))
                    heads[at + 1] = max(heads[at + 1], int(total[wanted].max()))
                else:
                    best.add(total[wanted], self.ids[prefix[wanted]])

    def _least(self, level: int, column: np.ndarray) -> np.ndarray:
        return self.least[max(0, self.column_bits - self.depth + level)][column]


class Best:
    """The `k` best documents of a query so far: highest score first, then smallest id."""

    def __init__(self, k: int):
        self.k = k
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    def wants(self, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        if len(self.scores) < self.k:
            return bound > 0
        score, last = self.scores[-1], self.ids[-1]
        return (bound > score) | ((bound == score) & (least_id < last))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _term_names(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct term names of each text."""
    out: list[np.ndarray] = []
    for block in blocks(pa.array(texts, pa.string())):
        w = words(block, lower=True, separator=NOT_ALNUM)
        out += [np.unique(w.hash[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
    return out


def _packs(items: DataFrame, limit: int) -> Iterator[list]:
    """Rows of `items` in lists of bounded text."""
    pack: list = []
    size = 0
    for row in items.toLocalIterator():
        pack.append(row)
        size += len(row[1] or "") + 64
        if size > limit:
            yield pack
            pack, size = [], 0
    if pack:
        yield pack


def _frequencies(index: DataFrame, names: np.ndarray) -> np.ndarray:
    """Documents of the whole index that hold each term of `names` (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            for terms, frequencies in zip(batch.column(0), batch.column(1)):
                here = np.frombuffer(terms.as_py(), dtype="<u8")
                at = np.minimum(np.searchsorted(names, here), len(names) - 1)
                hit = names[at] == here
                total[at[hit]] += np.frombuffer(frequencies.as_py(), dtype="<i4")[hit]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "df"])

    found = index.select("terms", "frequencies").mapInArrow(run, "at bigint, df bigint").groupBy("at").agg(F.sum("df").alias("df"))
    out = np.zeros(len(names), dtype=np.int64)
    for row in found.toLocalIterator():  # at most one row for each name
        out[row.at] = row.df
    return out


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def search(spark: SparkSession, location: str, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """`(item_id, rank, doc_id, score)`: the `k` best documents of the index for each row of `items`.

    `items` are read in packs of bounded text, each of which is one pass over the index. Rows
    without a term find nothing; a null id stays null; rows with one id are queries of their own.
    Documents rank by score, then by id (null last); only scores above 0 count.
    """
    bound_batches(spark)
    index = spark.read.schema(_INDEX).parquet(location)
    head = index.select("documents").first()
    found: DataFrame | None = None
    given = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    kind = given.schema["item_id"].dataType.simpleString()
    for number, pack in enumerate(_packs(given, PACK_BYTES) if head is not None else ()):
        per_item = _term_names([r.text for r in pack])
        names = np.unique(np.concatenate(per_item))
        if not len(names):
            continue
        df = _frequencies(index, names)
        weights = np.array([weight(head.documents, f) if f else 0 for f in df.tolist()], dtype=np.int64)
        queries = [np.searchsorted(names, p) for p in per_item]
        hits = index.select("ids", "terms", "row_bits", "column_bits", "children", "maxima").mapInArrow(
            _searcher(names, weights, queries, k), "item int, score bigint, doc_id bigint"
        )
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(pack)], f"item int, item_id {kind}")
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")  # ids: one bounded pack
        found = named if found is None else found.unionByName(named)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return found


def _searcher(names: np.ndarray, weights: np.ndarray, queries: list[np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Best(k) for _ in queries]
        for batch in batches:
            for at in range(batch.num_rows):
                treap = Treap(batch.slice(at, 1).to_pylist()[0])
                rows = treap.rows(names)
                for query, best in zip(queries, lists):
                    treap.search(rows[query], weights[query], best)
        item = np.repeat(np.arange(len(lists), dtype=np.int32), [len(b.ids) for b in lists])
        ids = np.concatenate([b.ids for b in lists])
        columns = [pa.array(item), pa.array(np.concatenate([b.scores for b in lists])), pa.array(ids, mask=ids == _NO_ID)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "score", "doc_id"])

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Index `docs` in the shared folder and search it for `items` (see `write` and `search`)."""
    location = scratch_path(docs.sparkSession, "treap")
    write(docs, location, doc_id, text)
    return search(docs.sparkSession, location, items, k, item_id, text)
