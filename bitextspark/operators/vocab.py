"""Token counts, joint vocabulary, encoding and encoding statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextspark.config import EOS_ID, FILLER, SPECIALS, UNK_ID
from bitextspark.functions import ids as fi
from bitextspark.scale import global_rank, lookup_fits, lookup_tokens, quarter_powers


def token_counts(df: DataFrame, *array_cols: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences of each token over the given array columns.

    Partial counts are made before the shuffle, so a frequent token costs one row
    per map task.
    """
    sides = F.array(*[F.struct(F.col(c).alias("toks")) for c in array_cols])
    tokens = df.select(*by, F.inline(sides)).select(*by, F.explode("toks").alias("symbol"))
    return tokens.groupBy(*by, "symbol").agg(F.count(F.lit(1)).alias("count"))


def top_words(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent symbols; a report whose size is the caller's n."""
    return counts.orderBy(F.desc("count"), "symbol").limit(n)


def with_threshold(counts: DataFrame, threshold: int) -> DataFrame:
    return counts.where(F.col("count") >= threshold)


def build_vocabulary(counts: DataFrame, threshold: int = 1, n_words: int | None = None, padding_factor: int = 8) -> DataFrame:
    """`(id, symbol, count)`: specials first, then by falling count and symbol, then
    fillers up to a multiple of `padding_factor` (0 switches them off).

    Ids come from a distributed sort (`global_rank`), not from one window.
    """
    spark = counts.sparkSession
    kept = with_threshold(counts, threshold).where(~F.col("symbol").isin(*SPECIALS))
    ranked = global_rank(kept, [F.desc("count"), "symbol"], "rank")
    if n_words is not None:
        ranked = ranked.where(F.col("rank") < n_words)
    words = ranked.select((F.col("rank") + len(SPECIALS)).cast("int").alias("id"), "symbol", "count")
    heads = spark.createDataFrame([(i, s, 0) for i, s in enumerate(SPECIALS)], "id int, symbol string, count bigint")
    out = heads.unionByName(words)
    if padding_factor > 1:
        size = ranked.agg(F.count(F.lit(1)).alias("n")).first()["n"] + len(SPECIALS)
        fill = [(size + k, f"{FILLER}{k:04d}", 0) for k in range(-size % padding_factor)]
        if fill:
            out = out.unionByName(spark.createDataFrame(fill, "id int, symbol string, count bigint"))
    return out


def vocabulary_lines(vocab: DataFrame) -> DataFrame:
    """`symbol count` text rows (specials are implied and left out)."""
    return vocab.where(F.col("id") >= len(SPECIALS)).select("id", F.concat_ws(" ", "symbol", "count").alias("line"))


def parse_vocabulary(lines: DataFrame) -> DataFrame:
    """Inverse of `vocabulary_lines`; the count is what follows the last blank."""
    return lines.select(
        "id",
        F.regexp_extract("line", r"^(.*) ([0-9]+)$", 1).alias("symbol"),
        F.regexp_extract("line", r"^(.*) ([0-9]+)$", 2).cast("bigint").alias("count"),
    )


def _by_id() -> Column:
    """Classes of a vocabulary, commonest first: ids rise by falling count."""
    return quarter_powers(F.col("id") + 1)


def encode(
    df: DataFrame, vocab: DataFrame, keys: tuple[str, ...], arrays: dict[str, str], carry: tuple[str, ...] = (),
    add_eos: bool = True,
) -> DataFrame:
    """Token arrays -> id arrays; unknown tokens become the unk id, eos is appended.

    A vocabulary measured to be small goes to the tasks; of a larger one the smallest ids, which the most
    frequent tokens have, and only other tokens are joined.
    """
    small = lookup_fits(vocab, "symbol", "id")
    found = lookup_tokens(df, list(keys), arrays, vocab, "symbol", "id", F.lit(UNK_ID), small, list(carry), _by_id())
    if not add_eos:
        return found
    return found.withColumns({out: fi.append(F.col(out), EOS_ID) for out in arrays})


def decode(df: DataFrame, vocab: DataFrame, keys: tuple[str, ...], arrays: dict[str, str]) -> DataFrame:
    """Id arrays -> token arrays (eos removed first)."""
    stripped = df.withColumns({c: fi.strip_eos(F.col(c)) for c in arrays.values()})
    small = lookup_fits(vocab, "id", "symbol")
    return lookup_tokens(stripped, list(keys), arrays, vocab, "id", "symbol", F.lit(SPECIALS[UNK_ID]), small, common=_by_id())


def encoding_statistics(encoded: DataFrame, ids: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sentences, tokens (with eos) and the percentage of tokens replaced by unk."""
    n_unk = F.size(F.filter(ids, lambda x: x == UNK_ID))
    return encoded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sentences"),
        F.sum(F.size(ids).cast("bigint")).alias("tokens"),
        F.round(F.sum(n_unk) * 100.0 / F.sum(F.size(ids)), 6).alias("unk_percent"),
    )


def linked_type_counts(words: DataFrame, unk: Column | None = None) -> DataFrame:
    """(src, tgt) type counts over links, ignoring links that touch an unknown word."""
    if unk is not None:
        words = words.where((F.col("src") != unk) & (F.col("tgt") != unk))
    return words.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("n"))


def most_frequent_target(counts: DataFrame) -> DataFrame:
    """src -> most frequent target; ties go to the smallest target."""
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("tgt").alias("tgt")))
    return counts.groupBy("src").agg(best.alias("b")).select("src", "b.tgt", (-F.col("b.k")).alias("n"))
