"""Token ids of a corpus as fixed-width bit-packed blocks with random access.

Format (a Parquet dataset, one row per block, blocks in ascending document order):

| column | content |
| --- | --- |
| part, block | place of the block: part in key order, block within the part |
| width | bits per id, the least that hold the vocabulary |
| n_ids | ids in the block |
| doc_ids, doc_bounds | the block's documents and their id offsets inside it (n + 1) |
| payload | the ids, most significant bit first, padded to a byte |

A second small table (`offsets`) has the number of ids before each part, so the global
offset of a document is a sum of two look-ups, and id k of a document is found by
unpacking one block from bit `width * (bound + k)` on. Blocks hold whole documents and
close at `BLOCK_IDS` ids, so a task holds one block at a time.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextspark.llm.tables import DistinctTable
from bitextspark.llm.words import Block, blocks, row_sums, texts

BLOCK_IDS = 1 << 18
MAX_ENTRIES = 600_000
SLICE_BYTES = 1 << 20

BLOCKS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_bounds", T.ArrayType(T.IntegerType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def bit_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as `width`-bit fields, most significant bit first."""
    if width == 16:
        return ids.astype(">u2").tobytes()
    out = []
    for a in range(0, len(ids), 1 << 15):  # a multiple of 8 ids fills whole bytes
        part = ids[a : a + (1 << 15)].astype(np.uint32)
        shifts = np.arange(width - 1, -1, -1, dtype=np.uint32)
        out.append(np.packbits(((part[:, None] >> shifts) & 1).astype(np.uint8)).tobytes())
    return b"".join(out)


def unpack(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """`count` ids from id `first` on; only the bytes that hold them are read."""
    if width == 16:
        return np.frombuffer(payload, dtype=">u2", offset=2 * first, count=count).astype(np.uint32)
    out = np.empty(count, dtype=np.uint32)
    raw = np.frombuffer(payload, dtype=np.uint8)
    for a in range(0, count, 1 << 15):
        n = min(1 << 15, count - a)
        bit = width * (first + a)
        bits = np.unpackbits(raw[bit // 8 : (bit + width * n + 7) // 8])[bit % 8 : bit % 8 + width * n]
        weights = (1 << np.arange(width - 1, -1, -1)).astype(np.uint32)
        out[a : a + n] = bits.reshape(n, width).astype(np.uint32) @ weights
    return out


#: Words of lower-cased text in ASCII and the letters U+00C0 to U+00FF.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+")
#: White space, printable ASCII, and the bytes of U+00C0 to U+00FF.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[*range(0x09, 0x0E), *range(0x20, 0x7F), 0xC3]] = True
_ENCODERS: dict[str, "WordEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The usual printable letter for each byte, for characters up to U+00FF as UTF-8."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


class WordEncoder:
    """The tokenizers library behind a bounded table of distinct words.

    Ids never cross white space in a vocabulary that drops it, so a text's ids are those
    of its white-space chunks. Plain chunks are cut into words and each distinct word is
    given to the library's merge model once; every other text goes through the whole
    library. `self.plain` is checked on load: a tokenizer that behaves otherwise is used
    without the table.
    """

    PROBES = ("It's the FIRST, don't  we'll-go 12 times\n[a_b] ÉÈ ça été über größe!?", "x'S 'tis ''d ~~ *&^ ñandú's")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.vocabulary = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.letters = _byte_letters()
        self.words: dict[str, list[int]] = {}
        self.chunks = DistinctTable(self._chunks, MAX_ENTRIES, 32_000_000)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = all(self._chunk(p.lower()) == self._whole([p])[0] for p in self.PROBES)

    def _whole(self, batch: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.translate(self.letters))]

    def _chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of plain lower-case chunks; letters alone are one word."""
        cut = [[c] if c.isalpha() else _WORD.findall(c) for c in chunks]
        known = self.words
        for w in chain.from_iterable(cut):
            if w not in known:
                known[w] = self._word(w)
        return [known[ws[0]] if len(ws) == 1 else [i for w in ws for i in known[w]] for ws in cut]

    def _chunk(self, chunk: str) -> list[int]:
        return [i for ids in self._chunks(chunk.split()) for i in ids]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's texts, flat, and the bounds of each text."""
        if len(self.words) > MAX_ENTRIES:  # the older half has the frequent words
            self.words = dict(islice(self.words.items(), MAX_ENTRIES // 2))
        data = block.data
        odd = ~_PLAIN[data]
        pair = (data[1:] & 0xC0 == 0x80) & (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        odd[1:] &= ~pair
        plain = row_sums(odd, block.bounds) == 0
        batch = texts(block)
        by_chunk = np.array([self.plain and p and not any(s in text for s in self.special) for p, text in zip(plain, batch)], dtype=bool)
        # Plain texts have ASCII white space only. Strings that Arrow cuts off beside it may be empty; they have no ids.
        column = pc.if_else(pa.array(by_chunk), pa.array(batch, pa.large_string()), "")
        lists = pc.ascii_split_whitespace(pc.utf8_lower(column))
        coded = lists.flatten().dictionary_encode()
        counts = np.cumsum([0, *pc.list_value_length(lists).to_numpy()])
        flat, bounds = self.chunks.join_kinds(coded.dictionary.to_pylist(), coded.indices.to_numpy(), counts)
        whole = np.flatnonzero(~by_chunk).tolist()
        if not whole:
            return flat, bounds
        rows = np.split(flat, bounds[1:-1])
        for i, ids in zip(whole, self._whole([batch[i] for i in whole])):
            rows[i] = np.array(ids, dtype=np.int32)
        return np.concatenate(rows), np.cumsum([0, *map(len, rows)])


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_blocks(docs: DataFrame, tokenizer: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of packed ids of documents in ascending `doc_id`.

    One range shuffle orders the documents; ties (repeated ids) are ordered by text, so a
    retried task writes the same bytes. Null texts count as empty (they hold `end_id`
    only); a null id sorts first and stays null. Other columns are not read.
    """
    ordered = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = encoder(tokenizer)
        width = bit_width(max(words.vocabulary, (end_id or 0) + 1))
        part, block = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        sizes: list[int] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, keys, sizes, held, block
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            row = [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([width], pa.int32()),
                pa.array([len(flat)], pa.int64()),
                pa.array([keys], pa.list_(pa.int64())),
                pa.array([np.cumsum([0, *sizes]).astype(np.int32)], pa.list_(pa.int32())),
                pa.array([pack(flat, width)], pa.binary()),
            ]
            ids, keys, sizes, held, block = [], [], [], 0, block + 1
            return pa.RecordBatch.from_arrays(row, names=BLOCKS.names)

        tail = np.array([] if end_id is None else [end_id], dtype=np.int32)
        for batch in batches:
            doc_keys = batch.column(0).to_pylist()
            for piece in blocks(batch.column(1), SLICE_BYTES):
                flat, bounds = words.encode(piece)
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    ids.append(np.concatenate([flat[a:b], tail]))
                    keys.append(doc_keys[piece.first + k])
                    sizes.append(len(ids[-1]))
                    held += sizes[-1]
                    if held >= BLOCK_IDS:
                        yield close()
        if keys:
            yield close()

    return ordered.mapInArrow(run, BLOCKS)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the token file of `docs` below `path` (blocks, then offsets).

    An empty table writes an empty file. Payloads are stored uncompressed: packed ids
    hardly compress, and readers can map them.
    """
    encode_blocks(docs, tokenizer, end_id, doc_id, text).write.mode("overwrite").option("compression", "none").parquet(
        f"{path}/blocks"
    )
    spark = docs.sparkSession
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row per part, a few thousand at most: the number of tasks of the write.
    totals = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    totals.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("ids_before")).coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/offsets")


DOCUMENTS = "doc_id bigint, part int, block int, bound int, n_tokens bigint, ids array<int>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """`(doc_id, start, n_tokens, ids)` of every document of a token file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, part, block, bounds, flat in _unpacked(batches):
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids,
                    pa.array([part] * n, pa.int32()),
                    pa.array([block] * n, pa.int32()),
                    pa.array(bounds[:-1], pa.int32()),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32))),
                ],
                names=["doc_id", "part", "block", "bound", "n_tokens", "ids"],
            )

    docs = spark.read.parquet(f"{path}/blocks").mapInArrow(run, DOCUMENTS)
    return _with_start(spark, path, docs).select("doc_id", "start", "n_tokens", "ids")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """`(doc_id, start, n_tokens, ids_crc32)`: unsigned crc32 of the unpacked ids as
    little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, part, block, bounds, flat in _unpacked(batches):
            raw, n = flat.astype("<u4").tobytes(), len(doc_ids)
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids,
                    pa.array([part] * n, pa.int32()),
                    pa.array([block] * n, pa.int32()),
                    pa.array(bounds[:-1], pa.int32()),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "part", "block", "bound", "n_tokens", "ids_crc32"],
            )

    docs = spark.read.parquet(f"{path}/blocks").mapInArrow(
        run, "doc_id bigint, part int, block int, bound int, n_tokens bigint, ids_crc32 bigint"
    )
    return _with_start(spark, path, docs).select("doc_id", "start", "n_tokens", "ids_crc32")


def _unpacked(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in BLOCKS.names}
            bounds = row["doc_bounds"].values.to_numpy(zero_copy_only=False)
            flat = unpack(row["payload"].as_buffer(), row["width"].as_py(), 0, row["n_ids"].as_py())
            yield row["doc_ids"].values, row["part"].as_py(), row["block"].as_py(), bounds, flat


def _with_start(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """Add the ids before each block: part offsets plus the blocks before it in the part."""
    before = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    heads = (
        spark.read.parquet(f"{path}/blocks")
        .select("part", "block", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("in_part"))
        .join(spark.read.parquet(f"{path}/offsets"), "part")
        .select("part", "block", (F.col("ids_before") + F.col("in_part")).alias("block_start"))
    )
    return docs.join(heads, ["part", "block"]).withColumn("start", F.col("block_start") + F.col("bound"))


def ids_at(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Random access: `count` ids from global position `start` on, by unpacking only the
    blocks that hold them. `count` bounds what is brought to the driver."""
    blocks_of = spark.read.parquet(f"{path}/blocks")
    heads = _with_start(spark, path, blocks_of.select("part", "block", "width", "n_ids", "payload", F.lit(0).alias("bound")))
    hit = heads.where((F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start))
    out = [np.zeros(0, np.uint32)]
    for r in hit.orderBy("start").select("start", "n_ids", "width", "payload").toLocalIterator():
        first = max(0, start - r["start"])
        last = min(r["n_ids"], start + count - r["start"])
        out.append(unpack(bytes(r["payload"]), r["width"], first, last - first))
    return np.concatenate(out)
