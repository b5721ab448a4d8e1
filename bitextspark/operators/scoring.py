"""Corpus BLEU and chrF from clipped n-gram counts.

Counting is local to a sentence, so nothing is shuffled but the per-task totals.
The counts of all sentences of a block come from sorted n-gram numbers, in one Arrow-batched
helper without a loop over sentences: expressing them as exploded n-grams with a grouping
gives the same numbers about three times slower than a counter per sentence (twelve rows per
character through two hash aggregations).
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextspark.functions import text as tx

PUNCTUATION = r"([!-/:-@\[-`{-~])"


def score_tokens(text: Column, pre_tokenized: bool = False) -> Column:
    """Tokens for scoring; ASCII punctuation stands alone unless already tokenised."""
    return tx.tokens(text if pre_tokenized else F.regexp_replace(text, PUNCTUATION, " $1 "))


def characters(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, tx.WHITESPACE, "")


def hypotheses_with_references(hyps: DataFrame, refs: DataFrame, key: str = "id") -> DataFrame:
    """Every reference with its hypothesis; a missing hypothesis counts as an empty one, so
    it lowers the score instead of leaving it."""
    hyp_columns = [c for c in hyps.columns if c != key]
    joined = refs.join(hyps, key, "left")
    return joined.select(key, *[F.coalesce(c, F.lit("")).alias(c) if c == "hyp" else c for c in hyp_columns], *[c for c in refs.columns if c != key])


#: Characters of hypotheses and references that are counted together; a longer pair is alone.
BLOCK_CHARS = 1 << 20


def _units(texts: list[str], words: bool) -> tuple[np.ndarray, int, np.ndarray]:
    """Codes of all words or characters of the texts, flat, their number of distinct values, and
    the length of each text."""
    if words:
        rows = [x.split(" ") if x else [] for x in texts]
        codes, values = pd.factorize(np.array(list(chain.from_iterable(rows)), dtype=object))
        return codes.astype(np.int64), len(values), np.fromiter(map(len, rows), np.int64, len(rows))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    values, codes = np.unique(points, return_inverse=True)
    return codes.astype(np.int64), len(values), np.fromiter(map(len, texts), np.int64, len(texts))


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.diff(np.append(heads, len(keys)))


def match_counts(hyp: list[str], ref: list[str], orders: list[int], words: bool) -> np.ndarray:
    """Rows of [match, hyp, ref] per order, a match being clipped within its row.

    An n-gram is a number: the codes of its units as digits, together with its row. Where the
    digits would not fit 63 bits, the numbers so far are replaced by their ranks, so equal
    numbers always mean equal n-grams.
    """
    n_rows = len(hyp)
    unit, base, sizes = _units([*hyp, *ref], words)
    segment = np.repeat(np.arange(2 * n_rows, dtype=np.int64), sizes)
    border = int(sizes[:n_rows].sum())  # positions from here on are references
    out = np.zeros((n_rows, 3 * len(orders)), dtype=np.int64)
    at = np.arange(len(unit))
    gram, width = np.zeros(len(unit), dtype=np.int64), 1
    for n in range(1, max(orders) + 1):
        inside = at + n <= len(unit)
        inside[inside] = segment[at[inside] + n - 1] == segment[at[inside]]
        at, gram = at[inside], gram[inside]
        if width * base * max(n_rows, 1) >= 1 << 63:
            values, gram = np.unique(gram, return_inverse=True)
            width = len(values)
        gram, width = gram * base + unit[at + n - 1], width * base
        if n not in orders:
            continue
        cut = int(np.searchsorted(at, border))
        h, h_count = _tally(segment[at[:cut]] * width + gram[:cut])
        r, r_count = _tally((segment[at[cut:]] - n_rows) * width + gram[cut:])
        place = np.minimum(np.searchsorted(r, h), max(len(r) - 1, 0))
        both = r[place] == h if len(r) else np.zeros(len(h), dtype=bool)
        clipped = np.minimum(h_count[both], r_count[place[both]])
        k = 3 * orders.index(n)
        np.add.at(out[:, k], h[both] // max(width, 1), clipped)
        lengths = np.maximum(sizes - n + 1, 0)
        out[:, k + 1], out[:, k + 2] = lengths[:n_rows], lengths[n_rows:]
    return out


def _match_counter(orders: list[int], words: bool):
    """Arrow UDF: (hyp, ref) -> [match, hyp, ref] per order, for words or characters. Null texts
    count as empty."""

    def counts(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        hyp, ref = hyp.fillna(""), ref.fillna("")
        block = (hyp.str.len() + ref.str.len()).cumsum().to_numpy() // BLOCK_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(hyp)]
        rows = [
            match_counts(hyp.iloc[a:b].tolist(), ref.iloc[a:b].tolist(), orders, words)
            for a, b in zip(cuts[:-1], cuts[1:])
            if b > a
        ]
        return pd.Series([row for part in rows for row in part], dtype=object)

    return F.pandas_udf(counts, "array<bigint>")


def clipped_counts(df: DataFrame, hyp: Column, ref: Column, orders: list[int], words: bool) -> DataFrame:
    """Per order n: matched (clipped per sentence), hypothesis and reference n-grams."""
    counted = df.select(_match_counter(orders, words)(hyp, ref).alias("c"))
    totals = counted.agg(*[F.sum(F.get("c", F.lit(k))).alias(f"c{k}") for k in range(3 * len(orders))])
    cells = [
        F.struct(
            F.lit(n).alias("n"), *[F.col(f"c{3 * j + k}").alias(x) for k, x in enumerate(("match", "hyp", "ref"))]
        )
        for j, n in enumerate(orders)
    ]
    return totals.select(F.inline(F.array(*cells)))


def bleu_from_counts(counts: DataFrame, max_n: int = 4) -> DataFrame:
    """One row: the score, its precisions and the brevity penalty.

    A zero precision is smoothed to 1/2^k of one match, k counting the zeros so far;
    an order without n-grams gives a score of 0.
    """
    at = lambda c, n: F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0))
    row = counts.agg(
        *[at(c, n).alias(f"{c}{n}") for c in ("match", "hyp") for n in range(1, max_n + 1)],
        at("hyp", 1).alias("hyp_len"),
        at("ref", 1).alias("ref_len"),
    )
    zeros = F.lit(0)
    precisions = []
    for n in range(1, max_n + 1):
        m, h = F.col(f"match{n}"), F.col(f"hyp{n}")
        zeros = zeros + F.when((m == 0) & (h > 0), 1).otherwise(0)
        smooth = F.lit(1.0) / F.pow(F.lit(2.0), zeros)
        precisions.append(F.when(h > 0, F.when(m > 0, m * 1.0).otherwise(smooth) / h))
    brevity = F.when(F.col("hyp_len") >= F.col("ref_len"), 1.0).when(F.col("hyp_len") == 0, 0.0).otherwise(
        F.exp(1.0 - F.col("ref_len") / F.nullif(F.col("hyp_len"), F.lit(0)))
    )
    mean_log = sum((F.ln(p) for p in precisions), F.lit(0.0)) / max_n
    return row.select(
        F.round(F.coalesce(100.0 * brevity * F.exp(mean_log), F.lit(0.0)), 6).alias("bleu"),
        *[F.round(100.0 * p, 6).alias(f"p{n}") for n, p in enumerate(precisions, 1)],
        F.round(brevity, 6).alias("brevity"),
        "hyp_len",
        "ref_len",
    )


def corpus_bleu(df: DataFrame, pre_tokenized: bool = False, max_n: int = 4) -> DataFrame:
    """BLEU of `df(hyp, ref)`."""
    hyp, ref = (tx.join_tokens(score_tokens(F.col(c), pre_tokenized)) for c in ("hyp", "ref"))
    return bleu_from_counts(clipped_counts(df, hyp, ref, list(range(1, max_n + 1)), words=True), max_n)


def chrf_from_counts(counts: DataFrame, beta: float = 2.0) -> DataFrame:
    """One row: F-score over the averages of precision and recall, taking the orders
    for which both sides have n-grams."""
    used = counts.where((F.col("hyp") > 0) & (F.col("ref") > 0)).agg(
        F.avg(F.col("match") / F.col("hyp")).alias("p"), F.avg(F.col("match") / F.col("ref")).alias("r")
    )
    b2 = beta * beta
    score = (1 + b2) * F.col("p") * F.col("r") / F.nullif(b2 * F.col("p") + F.col("r"), F.lit(0.0))
    return used.select(
        F.round(F.coalesce(100.0 * score, F.lit(0.0)), 6).alias("chrf"),
        F.round("p", 6).alias("precision"),
        F.round("r", 6).alias("recall"),
    )


def corpus_chrf(df: DataFrame, char_order: int = 6, word_order: int = 0, beta: float = 2.0) -> DataFrame:
    """chrF of `df(hyp, ref)`; `word_order=2` gives chrF++."""
    hyp, ref = (characters(F.col(c)) for c in ("hyp", "ref"))
    counts = clipped_counts(df, hyp, ref, list(range(1, char_order + 1)), words=False)
    if word_order:
        words = [tx.join_tokens(score_tokens(F.col(c))) for c in ("hyp", "ref")]
        counts = counts.unionByName(clipped_counts(df, *words, list(range(1, word_order + 1)), words=True))
    return chrf_from_counts(counts, beta)
