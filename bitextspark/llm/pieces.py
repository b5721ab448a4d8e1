"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers and the characters up to the next marker. In the
given vocabulary no piece has a marker after another character (checked when it is
loaded), so no merge crosses the border between chunks and a text's ids are the ids of
its chunks, joined by position. Each task segments a distinct chunk once; the table is
bounded in entries and bytes and emptied when the task ends, and results do not
depend on it. Vocabularies without that property are encoded text by text.

The table is built where the texts are, not by a shuffle: exploding words, joining them
to one global table and regrouping would move every word of the corpus twice (about 20
bytes each, several times the compressed input).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bitextspark.llm.tables import DistinctTable
from bitextspark.llm.words import blocks, give_back, texts

MARK = "▁"
#: Bytes of text that a worker holds arrays of at a time.
SLICE_BYTES = 1 << 18
_RUNS = re.compile(" +[^ ]*")
_TABLES: dict[str, "ChunkTable"] = {}


class ChunkTable:
    """Encoder and decoder of one Python worker."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = self.model.encode("a  b ")
        plain = self.model.encode("a", out_type=str)
        self.separable = (
            not any(MARK in p.lstrip(MARK) for p in pieces)
            and self.model.decode(probe) == "a  b "
            and plain[0].startswith(MARK)
            and self.model.decode(self.model.encode("Ａ ﬁ ²")) == "Ａ ﬁ ²"
        )
        self.is_byte = np.array([self.model.is_byte(i) for i in range(len(pieces))])
        self.lone = self.model.piece_to_id(MARK)
        self.table = DistinctTable(self._segment)

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """The empty chunk is a marker that nothing follows."""
        return [ids if c else [self.lone] for c, ids in zip(chunks, self.model.encode(chunks, num_threads=1))]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks without their first marker (the model adds one before each)."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text.startswith(" "):
            return [c[1:] for c in _RUNS.findall(" " + text)]
        return text.split(" ")

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the bounds of each text."""
        if not self.separable:
            lists = self.model.encode(batch, num_threads=1)
            sizes = np.array([len(x) for x in lists], dtype=np.int64)
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(sizes.sum()))
            return flat, np.concatenate([[0], np.cumsum(sizes)])
        return self.table.join([self.chunks(t) if t else [] for t in batch])

    def decode(self, flat: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of id rows. The library decodes faster than pieces can be looked up."""
        edges = bounds.tolist()
        return [self.model.decode(flat[a:b].tolist()) for a, b in zip(edges[:-1], edges[1:])]


def table(model_path: str) -> ChunkTable:
    """The chunk table of this Python worker."""
    if model_path not in _TABLES:
        _TABLES[model_path] = ChunkTable(model_path)
    return _TABLES[model_path]


def id_lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32, copy=False)))


def _append(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    if name in schema.names:
        raise ValueError(f"the table has a column {name!r} already; choose another output name")
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append `out` array<int>: the ids of the whole text, without begin or end ids.

    Null and empty texts give an empty array; repeated rows give repeated rows; other
    columns pass through. A column that is named like `out` raises when the plan is made.
    """

    return _encoded(df, model_path, text, out, None)


def round_trip(df: DataFrame, model_path: str, text: str = "text", out: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Append `out` as `encode` does and `decoded` as `decode` does, in one step: a task has one
    worker with one model and one table."""
    return _encoded(df, model_path, text, out, decoded)


def _encoded(df: DataFrame, model_path: str, text: str, out: str, decoded: str | None) -> DataFrame:
    schema = _append(df.schema, out, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = _append(schema, decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = table(model_path)
        try:
            for batch in batches:
                at = batch.schema.get_field_index(text)
                for block in blocks(batch.column(at), SLICE_BYTES):
                    flat, bounds = chunks.encode(texts(block))
                    columns = [*batch.slice(block.first, block.rows).columns, id_lists(flat, bounds)]
                    if decoded:
                        columns.append(pa.array(chunks.decode(flat, bounds), pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        finally:
            chunks.table.release()
            give_back()

    return df.mapInArrow(run, schema)


def _id_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    bounds = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    row, n = 0, len(column)
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES, side="right")) - 1))
        yield row, end - row, values[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded", drop_ids: bool = False) -> DataFrame:
    """Append `out` string: the decoded text of an id array; null and empty arrays give ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = table(model_path)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            kept = [i for i in range(batch.num_columns) if not (drop_ids and i == at)]
            for first, rows, flat, bounds in _id_blocks(batch.column(at)):
                part = batch.slice(first, rows)
                texts_out = pa.array(chunks.decode(flat, bounds), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in kept), texts_out], names=[*(batch.schema.names[i] for i in kept), out]
                )

    fields = [f for f in df.schema.fields if not (drop_ids and f.name == ids)]
    return df.mapInArrow(run, _append(T.StructType(fields), out, T.StringType()))
