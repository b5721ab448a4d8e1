"""Pair cleaning: URL, identity, length and ratio filters, retained-line selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextspark.config import CleanConfig
from bitextspark.functions import text as tx
from bitextspark.scale import broadcast_if_small


def has_url(text: Column) -> Column:
    return text.contains("http:") | text.contains("https:")


def differs(src: Column, tgt: Column, awk_numeric: bool = True) -> Column:
    """src != tgt; with `awk_numeric` two numeric-looking sides compare as numbers."""
    if not awk_numeric:
        return src != tgt
    as_number = lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")).try_cast("double")
    same_number = tx.looks_numeric(src) & tx.looks_numeric(tgt) & (as_number(src) == as_number(tgt))
    return (src != tgt) & ~F.coalesce(same_number, F.lit(False))


def length_ok(n_src: Column, n_tgt: Column, cfg: CleanConfig) -> Column:
    ok = n_src.between(cfg.min_tokens, cfg.max_tokens) & n_tgt.between(cfg.min_tokens, cfg.max_tokens)
    if cfg.max_ratio is not None:
        # An empty side never passes, also when min_tokens is 0.
        ok = ok & (n_src > 0) & (n_tgt > 0)
        ok = ok & (n_src <= n_tgt * F.lit(cfg.max_ratio)) & (n_tgt <= n_src * F.lit(cfg.max_ratio))
    return ok


def drop_urls(pairs: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    return pairs.where(~(has_url(F.col(src)) | has_url(F.col(tgt))))


def drop_identical(pairs: DataFrame, src: str = "src", tgt: str = "tgt", awk_numeric: bool = True) -> DataFrame:
    return pairs.where(differs(F.col(src), F.col(tgt), awk_numeric))


def with_tokens(pairs: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Add `src_tok`, `tgt_tok`.

    The one-row `inline` keeps later length filters above the split, so each text is
    split once instead of once in the filter and once in the projection.
    """
    both = F.struct(tx.tokens(F.col(src)).alias("src_tok"), tx.tokens(F.col(tgt)).alias("tgt_tok"))
    return pairs.select("*", F.inline(F.array(both)))


def clean_pairs(pairs: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """The full cleaner. Adds token arrays and squeezes both texts to single blanks."""
    if cfg.drop_urls:
        pairs = drop_urls(pairs)
    if cfg.drop_identical:
        pairs = drop_identical(pairs, awk_numeric=cfg.awk_numeric)
    kept = with_tokens(pairs).where(length_ok(F.size("src_tok"), F.size("tgt_tok"), cfg))
    return kept.withColumns(
        {"src": tx.join_tokens(F.col("src_tok")), "tgt": tx.join_tokens(F.col("tgt_tok"))}
    )


def drop_empty(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.length(col) > 0)


def retain_lines(df: DataFrame, retained: DataFrame, key: str = "line_no") -> DataFrame:
    """Rows whose 1-based line number is listed in `retained`."""
    wanted = retained.select(key)
    return df.join(broadcast_if_small(wanted), key, "left_semi")


def split_by_size(df: DataFrame, src: str, tgt: str, max_src: int, max_tgt: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by id-array sizes."""
    fits = (F.size(src) <= max_src) & (F.size(tgt) <= max_tgt)
    return df.where(fits), df.where(~fits)
