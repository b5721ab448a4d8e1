"""Quality rules: counting rules on words and lines, and the fertility of a public tokeniser.

The base rules count words, symbols, repeated lines and repeated three-word windows. The
fertility rules measure how well a public vocabulary fits a text: characters per token,
the share of byte-fallback tokens and the entropy of the token distribution. Text in a
language that the vocabulary knows lies in a narrow band; symbol junk, shouted text and
mangled encodings leave it. Fixed bands by language or script are the outer limits. Inside
them, `relative_bands` takes the median and the median deviation of each measure over all
documents of one language, script and length class; what lies too many deviations from the
median is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextspark.llm import pieces
from bitextspark.llm.components import _store
from bitextspark.llm.words import blocks, code_points, give_back, row_sums, span_hash, texts, window_hash, words
from bitextspark.scale import broadcast_if_small

SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


@dataclass(frozen=True)
class Band:
    """Accepted ranges. `entropy` is in bits per token, relative to log2 of the token count."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: tuple[float, float]


#: Accepted ranges for a 32k vocabulary. The least characters per token are two thirds of the
#: language's median over all documents of 40 tokens or more, whatever their labels (sf0.1: 2.623
#: de, 2.628 en, 2.290 es, 2.348 fr), rounded down.
BANDS = {
    "de": Band((1.74, 7.0), 0.06, (0.42, 1.0)),
    "en": Band((1.75, 7.0), 0.06, (0.42, 1.0)),
    "es": Band((1.52, 7.0), 0.06, (0.42, 1.0)),
    "fr": Band((1.56, 7.0), 0.06, (0.42, 1.0)),
}


@dataclass(frozen=True)
class QualityRules:
    """`bands` by language; `scripts` for other languages; texts of fewer than `min_tokens`
    tokens are too short for the fertility rules and pass them.

    `deviations`: accepted distance from the median of the text's group, in median absolute
    deviations scaled to a standard deviation. `least`: the smallest deviation that is taken for
    each measure (characters per token: as a share of the median), so that many copies of one text
    do not make a group's band a point. `prior`: documents that the deviation `wide` weighs as
    much as, so that a group of a few documents has a wide band."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_tokens: int = 40
    deviations: float = 6.0
    least: tuple[float, float, float] = (0.015, 0.01, 0.02)
    wide: tuple[float, float, float] = (0.10, 0.05, 0.10)
    prior: int = 5
    bands: dict[str, Band] = field(default_factory=lambda: dict(BANDS))
    scripts: dict[str, Band] = field(
        default_factory=lambda: {
            "latin": Band((1.2, 7.0), 0.10, (0.45, 1.0)),
            "other": Band((0.25, 5.0), 0.95, (0.30, 1.0)),
        }
    )


MEASURES = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("n_words", T.LongType()),
            ("word_chars", T.LongType()),
            ("n_symbols", T.LongType()),
            ("n_dup_lines", T.LongType()),
            ("n_repeat_words", T.LongType()),
            ("n_tokens", T.LongType()),
            ("chars_per_token", T.DoubleType()),
            ("byte_share", T.DoubleType()),
            ("token_entropy", T.DoubleType()),
            ("latin_share", T.DoubleType()),
        )
    ]
)


def _repeats(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each key: its count within its row, and whether it came earlier in the row."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    head = np.ones(len(k), dtype=bool)
    head[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    group = np.cumsum(head) - 1
    counts = np.bincount(group) if len(k) else np.zeros(0, np.int64)
    n, earlier = np.empty(len(k), np.int64), np.empty(len(k), bool)
    n[order], earlier[order] = counts[group], ~head
    return np.vstack([n, earlier]) if len(k) else np.zeros((2, 0), np.int64)


def _duplicate_lines(block, has_word: np.ndarray) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line of the row."""
    data, n = block.data, len(block.data)
    if not n:
        return np.zeros(block.rows, np.int64)
    feeds = np.flatnonzero(data == 0x0A)
    heads = np.unique(np.concatenate([block.bounds[:-1], feeds + 1]))
    heads = heads[heads < n]
    row = np.searchsorted(block.bounds, heads, side="right") - 1
    ends = np.minimum(np.append(heads[1:], n), block.bounds[row + 1])
    ends = ends - ((ends > heads) & (data[ends - 1] == 0x0A))
    before = np.zeros(n + 1, np.int64)
    np.cumsum(has_word, out=before[1:])
    real = before[ends] > before[heads]
    heads, ends, row = heads[real], ends[real], row[real]
    _, earlier = _repeats(span_hash(data, heads, ends), row)
    return np.bincount(row, weights=earlier, minlength=block.rows).astype(np.int64)


def _repeat_words(w, n_rows: int) -> np.ndarray:
    """Per row: words in three-word windows that occur twice or more in the row."""
    at, keys = window_hash(w, 3)
    n, _ = _repeats(keys, w.row[at])
    hit = at[n > 1]
    covered = np.zeros(len(w.row) + 3, dtype=bool)
    for k in range(3):
        covered[hit + k] = True
    return row_sums(covered[: len(w.row)], w.first)


def _fertility(flat: np.ndarray, bounds: np.ndarray, is_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of byte tokens, and relative entropy of the token distribution of each row."""
    rows = len(bounds) - 1
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(rows, dtype=np.int64), sizes)
    keys = np.sort((row << 20) | flat)
    head = np.ones(len(keys), dtype=bool)
    head[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(head)
    counts = np.diff(np.append(at, len(keys))).astype(np.float64)
    spread = np.bincount(keys[at] >> 20, weights=counts * np.log2(counts), minlength=rows)
    n = np.maximum(sizes, 1)
    entropy = np.where(sizes > 1, (np.log2(n) - spread / n) / np.log2(np.maximum(n, 2)), 1.0)
    return row_sums(is_byte[flat], bounds) / n, np.round(entropy, 9)


def measure(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Append the columns of `MEASURES`. Null texts count as empty and give zeros (entropy
    and Latin share 1); other columns pass through; clashing names raise at plan time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = pieces.table(model_path)
        try:
            for batch in batches:
                for block in blocks(batch.column(batch.schema.get_field_index(text)), pieces.SLICE_BYTES):
                    w = words(block, lower=False)
                    gap_free = np.zeros(len(block.data) + 1, np.int64)
                    gap_free[w.start] += 1
                    np.subtract.at(gap_free, w.end, 1)
                    inside = np.cumsum(gap_free[:-1]) > 0
                    heads = (block.data & 0xC0) != 0x80
                    chars = row_sums(heads & inside, block.bounds)
                    flat, bounds = chunks.encode(texts(block))
                    sizes = np.diff(bounds)
                    byte_share, entropy = _fertility(flat, bounds, chunks.is_byte)
                    all_chars = row_sums(heads, block.bounds)
                    # Latin text is ASCII or has lead bytes C3 to CB (U+00C0 to U+02FF).
                    foreign = row_sums(block.data >= 0xCC, block.bounds)
                    columns = [
                        np.diff(w.first),
                        chars,
                        row_sums(_SYMBOL[block.data], block.bounds),
                        _duplicate_lines(block, inside),
                        _repeat_words(w, block.rows),
                        sizes,
                        np.round(all_chars / np.maximum(sizes, 1), 9),
                        np.round(byte_share, 9),
                        entropy,
                        np.round(1 - foreign / np.maximum(all_chars, 1), 9),
                    ]
                    kinds = [pa.int64()] * 6 + [pa.float64()] * 4
                    rows = batch.slice(block.first, block.rows)
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))],
                        names=[*batch.schema.names, *MEASURES.names],
                    )
        finally:
            chunks.table.release()
            give_back()

    clash = set(df.columns) & set(MEASURES.names)
    if clash:
        raise ValueError(f"the table has columns {sorted(clash)} already; drop or rename them")
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *MEASURES.fields]))


def base_failed(rules: QualityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )


def _inside(band: Band) -> Column:
    return (
        F.col("chars_per_token").between(*band.chars_per_token)
        & (F.col("byte_share") <= band.byte_share)
        & F.col("token_entropy").between(*band.entropy)
    )


def fertile(rules: QualityRules, lang: str | None = "lang") -> Column:
    """Whether the measures lie in the band of the row's language or script."""
    script = F.when(F.col("latin_share") >= 0.5, _inside(rules.scripts["latin"])).otherwise(
        _inside(rules.scripts["other"])
    )
    banded = script
    if lang is not None:
        for name, band in sorted(rules.bands.items()):
            banded = F.when(F.col(lang).eqNullSafe(name), _inside(band)).otherwise(banded)
    return (F.col("n_tokens") < rules.min_tokens) | banded


#: Median absolute deviation to standard deviation of a normal distribution.
_SIGMA = 1.4826
_MEASURED = ("chars_per_token", "byte_share", "token_entropy")
_GROUP = ("__lang", "__latin", "__class")


def _grouped(measured: DataFrame, lang: str | None) -> DataFrame:
    """With the columns of `_GROUP`: language, script, and the power of two below the letters in words
    (not the tokens: junk of more tokens stays among texts of its length)."""
    return measured.withColumns(
        {
            "__lang": F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang else F.lit(""),
            "__latin": F.col("latin_share") >= 0.5,
            "__class": F.floor(F.log2(F.greatest("word_chars", F.lit(1)))),
        }
    )


def _grid(value: Column) -> Column:
    """Values in steps of 0.0001 up to 100: an exact median keeps a count per step, so its state is
    bounded however many documents there are, and no order of merging changes it."""
    return F.round(F.least(value, F.lit(100.0)), 4)


def relative_bands(measured: DataFrame, rules: QualityRules, lang: str | None = "lang") -> DataFrame:
    """Per language, script and length class: `n` texts of `min_tokens` tokens or more, and for each
    measure its median `<measure>__m` and half width `<measure>__h`.

    Texts of the same words, letters, tokens and measures count once, so exact copies do not shift a band.
    """
    counted = _grouped(measured, lang).where(F.col("n_tokens") >= rules.min_tokens)
    told_by = ("n_words", "word_chars", "n_tokens", *_MEASURED)
    texts_once = counted.select(*_GROUP, *told_by).distinct().select(*_GROUP, *[_grid(F.col(c)).alias(c) for c in _MEASURED])
    texts_once = _store(texts_once, "fertility")
    medians = texts_once.groupBy(*_GROUP).agg(
        F.count(F.lit(1)).alias("n"), *[F.median(c).alias(f"{c}__m") for c in _MEASURED]
    )
    medians = _store(medians, "fertility-medians")
    spread = texts_once.join(broadcast_if_small(medians.drop("n")), list(_GROUP)).groupBy(*_GROUP).agg(
        *[F.median(_grid(F.abs(F.col(c) - F.col(f"{c}__m")))).alias(f"{c}__d") for c in _MEASURED]
    )
    out = medians.join(spread, list(_GROUP))
    for c, least, wide in zip(_MEASURED, rules.least, rules.wide):
        unit = F.col(f"{c}__m") if c == "chars_per_token" else F.lit(1.0)
        seen = F.col(f"{c}__d") * _SIGMA
        mixed = F.sqrt((F.col("n") * seen * seen + rules.prior * (wide * unit) * (wide * unit)) / (F.col("n") + rules.prior))
        out = out.withColumn(f"{c}__h", rules.deviations * F.greatest(mixed, least * unit))
    return out.select(*_GROUP, "n", *[f"{c}__{x}" for c in _MEASURED for x in "mh"])


def usual(rules: QualityRules) -> Column:
    """Whether the measures lie in the band of the row's group. Few byte tokens are never a fault."""
    distance = {c: F.col(c) - F.col(f"{c}__m") for c in _MEASURED}
    inside = (
        (F.abs(distance["chars_per_token"]) <= F.col("chars_per_token__h"))
        & (distance["byte_share"] <= F.col("byte_share__h"))
        & (F.abs(distance["token_entropy"]) <= F.col("token_entropy__h"))
    )
    return (F.col("n_tokens") < rules.min_tokens) | inside


def judge(
    df: DataFrame,
    model_path: str,
    rules: QualityRules,
    text: str = "text",
    lang: str | None = "lang",
    keep_text: bool = True,
) -> DataFrame:
    """Measures, `base_failed` and `kept` (base rules, fixed and relative bands passed).

    The measures are written once to scratch (without the text if `keep_text` is off) and read three
    times: for medians, for deviations and for the verdicts. Null and empty texts fail the base
    rules, repeated rows get the same verdict, null and empty languages count as one, an empty
    table gives no rows, and columns that clash with the appended ones raise at plan time.
    """
    clash = {"base_failed", "kept", *_GROUP} & set(df.columns)
    if clash:
        raise ValueError(f"the table has columns {sorted(clash)} already; drop or rename them")
    measured = measure(df, model_path, text)
    measured = _store(measured if keep_text else measured.drop(text), "measures")
    bands = relative_bands(measured, rules, lang).drop("n")
    judged = _grouped(measured, lang).join(broadcast_if_small(bands), list(_GROUP), "left")
    judged = judged.withColumn("base_failed", base_failed(rules)).withColumn(
        "kept", ~F.col("base_failed") & fertile(rules, lang) & usual(rules)
    )
    return judged.select(*measured.columns, "base_failed", "kept")
