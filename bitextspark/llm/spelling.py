"""Spelling variants: near words by Gram matrices of letter counts, and the form each leads to.

Two words that differ by one inserted, deleted or replaced letter have letter-count vectors at
a squared distance of at most two, and lengths that differ by at most one. Words are blocked by
length and by how many of their letters fall into each of five letter classes. One edit moves
at most one letter between two classes or adds one to a class, so a block has near words in
itself, in ten blocks of its length and in five of the next length (seen from its smaller
end). For each two such blocks, cut into tiles of bounded size, one NumPy product of the
letter counts gives all squared distances; only pairs at most two apart are verified, letter by
letter. Pairs never leave a task: a tile returns, for each word, the number of its near words and
the most frequent one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextspark.llm.components import _store
from bitextspark.llm.grouped import whole_groups
from bitextspark.scale import broadcast_if_small

#: Letters: a-z and U+00C0 to U+00FF, numbered in this order.
LETTERS = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))
_RUN = re.compile("[a-zÀ-ÿ]+")
_NUMBER = np.zeros(256, dtype=np.int64)
_NUMBER[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
CLASSES = 5
#: Words and letters of a tile: the product of two tiles has at most TILE * TILE cells.
TILE, TILE_LETTERS = 2048, 1 << 20
#: A task's counts go out when they hold so many words or letters.
_WORDS, _LETTERS = 200_000, 4_000_000
DROP_EVERY = 199


def _counted(docs: DataFrame, min_length: int, doc_id: str, text: str) -> DataFrame:
    """`(word, n)`, several rows a word: counts of letter runs, after the hash has deleted a letter
    of every 199th pair of document and run."""

    def flush(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        letters = 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not value.is_valid:
                    continue
                lowered = value.as_py().encode("utf-8", "replace").lower().decode()
                prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(_RUN.findall(lowered)).items():
                    if len(word) < min_length:
                        continue
                    h = zlib.crc32(word.encode(), prefix)
                    if h % DROP_EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    if word in total:
                        total[word] += n
                    else:
                        total[word] = n
                        letters += len(word)
                if len(total) > _WORDS or letters > _LETTERS:
                    yield flush(total)
                    total, letters = {}, 0
        yield flush(total)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint")


def frequent_words(docs: DataFrame, min_length: int = 6, min_count: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(word, n)`: distinct words of enough letters that occur often enough in all of `docs`."""
    return _counted(docs, min_length, doc_id, text).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _class_counts(word: Column) -> Column:
    parts = ["".join(LETTERS[i] for i in range(c, len(LETTERS), CLASSES)) for c in range(CLASSES)]
    return F.array(*[F.length(word) - F.length(F.translate(word, p, "")) for p in parts])


def _moved(block: Column, away: int | None, to: int) -> Column:
    steps = [(-1 if c == away else 0) + (1 if c == to else 0) for c in range(CLASSES)]
    return F.array(*[block[c] + s for c, s in enumerate(steps)])


def _met(words: DataFrame) -> DataFrame:
    """Blocks that meet, `(meeting, block, other, tiles, other_tiles)` with one row for each."""
    blocks = words.groupBy("block").agg(F.count(F.lit(1)).alias("count"), F.sum(F.length("word")).alias("letters"))
    tiles = F.greatest(F.ceil(F.col("count") / TILE), F.ceil(F.col("letters") / TILE_LETTERS))
    blocks = _store(blocks.select("block", "count", tiles.cast("bigint").alias("tiles")), "blocks")
    b = F.col("block")
    swaps = [_moved(b, x, y) for x in range(CLASSES) for y in range(x + 1, CLASSES)]
    others = F.array(b, *swaps, *[_moved(b, None, y) for y in range(CLASSES)])
    named = blocks.select(F.col("block").alias("other"), F.col("tiles").alias("other_tiles"), F.col("count").alias("other_count"))
    met = blocks.select("block", "count", "tiles", F.explode(others).alias("other")).join(named, "other")
    met = met.where("block <> other OR count > 1")
    return met.select(F.xxhash64("block", "other").alias("meeting"), "block", "other", "tiles", "other_tiles")


def _cells(words: DataFrame) -> DataFrame:
    """Words dealt to the cells in which two tiles meet: `(meeting, cell, side, word, n)`. Side 0
    is a tile that meets itself, sides 1 and 2 are two tiles."""
    met = _store(_met(words), "meetings")
    same = F.col("block") == F.col("other")
    number = F.xxhash64("word")

    def spread(at: str, tiles: str, partners: str, side: int) -> DataFrame:
        """Each word of the blocks `at` with every tile of the other block."""
        listed = met.select(F.col(at).alias("block"), "meeting", F.col(tiles).alias("__mine"), F.col(partners).alias("__theirs"), same.alias("__same"))
        joined = words.join(broadcast_if_small(listed), "block").withColumn("__tile", F.pmod(number, F.col("__mine")))
        dealt = joined.withColumn("__partner", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__theirs") - 1)))
        own = F.col("__same") & (F.col("__tile") == F.col("__partner"))
        if side == 1:  # a block with itself: tile t meets t and each later tile
            dealt = dealt.where("NOT __same OR __tile <= __partner")
            cell = F.col("__tile") * F.col("__theirs") + F.col("__partner")
        else:
            dealt = dealt.where("NOT __same OR __tile > __partner")
            cell = F.col("__partner") * F.col("__mine") + F.col("__tile")
        return dealt.select("meeting", cell.alias("cell"), F.when(own, 0).otherwise(side).alias("side"), "word", "n")

    return spread("block", "tiles", "other_tiles", 1).unionByName(spread("other", "other_tiles", "tiles", 2))


def letter_codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letter codes (all letters are below U+0100)."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Rows of letter counts, in a float type that holds their products exactly."""
    n, length = codes.shape
    at = np.arange(n)[:, None] * len(LETTERS) + _NUMBER[codes]
    counts = np.bincount(at.reshape(-1), minlength=n * len(LETTERS)).reshape(n, -1)
    return counts.astype(np.float32 if length < 4096 else np.float64)


def near_positions(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `a` and `b` (letter codes; `b` as long as `a`, or one letter longer) that
    differ by exactly one edit."""
    x, y = letter_counts(a), letter_counts(b)
    distance = -2 * (x @ y.T)
    distance += (x * x).sum(axis=1)[:, None]
    distance += (y * y).sum(axis=1)[None, :]
    i, j = np.nonzero(distance <= 2)
    near = np.zeros(len(i), dtype=bool)
    step = max(1, (1 << 22) // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        one, two = a[i[at : at + step]], b[j[at : at + step]]
        length = one.shape[1]
        if two.shape[1] == length:
            near[at : at + step] = (one != two).sum(axis=1) == 1
        else:
            head = np.logical_and.accumulate(one == two[:, :length], axis=1).sum(axis=1)
            tail = np.logical_and.accumulate((one == two[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            near[at : at + step] = head + tail >= length
    return i[near], j[near]


def _near(cells: DataFrame) -> DataFrame:
    """`(word, n_near, best_n, best)` for each word and cell in which it has a near word."""

    def best(at: np.ndarray, other: np.ndarray, names: list[str], of: list[str], counts: np.ndarray) -> tuple[list, list, list, list]:
        rank = np.array(sorted(range(len(of)), key=of.__getitem__))
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        order = np.lexsort((place[other], -counts[other], at))
        at, other = at[order], other[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        sizes = np.diff(np.append(first, len(at)))
        return [names[k] for k in at[first].tolist()], sizes.tolist(), counts[other[first]].tolist(), [of[k] for k in other[first].tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ("meeting", "cell")):
            out: tuple[list, list, list, list] = ([], [], [], [])
            sides, counts = table.column("side").to_numpy(), table.column("n").to_numpy()
            for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                words = table.column("word").slice(p, q - p).to_pylist()
                if sides[p] == 0:  # a tile with itself: each pair from both ends
                    codes = letter_codes(words)
                    i, j = near_positions(codes, codes)
                    found = [(i, j, words, words, counts[p:q])]
                else:
                    cut = int(np.searchsorted(sides[p:q], 2))
                    if cut in (0, len(words)):
                        continue
                    names, n = (words[:cut], words[cut:]), (counts[p : p + cut], counts[p + cut : q])
                    i, j = near_positions(letter_codes(names[0]), letter_codes(names[1]))
                    found = [(i, j, names[0], names[1], n[1]), (j, i, names[1], names[0], n[0])]
                for at, other, mine, of, c in found:
                    if len(at):
                        for column, more in zip(out, best(at, other, mine, of, c)):
                            column += more
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["word", "n_near", "best_n", "best"])

    placed = cells.repartition("meeting", "cell").sortWithinPartitions("meeting", "cell", "side")
    return placed.mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")


def _roots(forms: DataFrame) -> DataFrame:
    """`(word, root)`: forms followed to the last one. Counts grow along a chain, so there are no
    rings; each round follows twice as many steps."""
    links = _store(forms, "forms")
    while True:
        ends = links.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        longer = _store(links.join(broadcast_if_small(ends, ("root", "__next")), "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__more")), "forms")
        links = longer.drop("__more")
        if longer.where("__more").isEmpty():
            return links


def variants(
    docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`(word, form, root, n, n_near, form_n)` for every frequent word of `docs`.

    Two words are near if they differ by exactly one inserted, deleted or replaced letter. The
    form is the most frequent near word (ties: the smallest) if it is `ratio` times as frequent as the
    word, else null. Null and empty texts have no words; a null id counts as an empty one when
    letters are deleted by hash; repeated rows count each. Other columns are not read; an empty table
    gives no rows.
    """
    words = _store(frequent_words(docs, min_length, min_count, doc_id, text), "words")
    blocked = words.withColumn("block", _class_counts(F.col("word")))
    near = _near(_cells(blocked)).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("form"))).alias("best")
    )
    fits = -F.col("best.m") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word",
        F.when(fits, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, -F.col("best.m")).alias("form_n"),
    )
    joined = _store(joined, "variants")
    roots = _roots(joined.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
