"""Columns over token-id arrays: specials, shifting, padding, masks, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitextspark.config import BOS_ID, EOS_ID, PAD_ID


def _const(x: int | Column) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def append_eos(ids: Column, eos: int = EOS_ID) -> Column:
    """Add eos unless the row already ends in it."""
    last = F.get(ids, F.size(ids) - 1)
    return F.when(last.eqNullSafe(F.lit(eos)), ids).otherwise(F.concat(ids, F.array(F.lit(eos))))


def prepend(ids: Column, token: int | Column = BOS_ID) -> Column:
    return F.concat(F.array(_const(token)), ids)


def prepend_bos(ids: Column, bos: int | Column = BOS_ID) -> Column:
    """Add bos unless the row already starts with it."""
    return F.when(F.get(ids, F.lit(0)).eqNullSafe(_const(bos)), ids).otherwise(prepend(ids, bos))


def append(ids: Column, token: int | Column) -> Column:
    return F.concat(ids, F.array(_const(token)))


def strip_eos(ids: Column, eos: int = EOS_ID) -> Column:
    last = F.get(ids, F.size(ids) - 1)
    return F.when(last.eqNullSafe(F.lit(eos)), F.slice(ids, F.lit(1), F.size(ids) - 1)).otherwise(ids)


def truncate(ids: Column, max_len: int, eos: int = EOS_ID) -> Column:
    """Cut to max_len - 1 tokens without eos, then close with eos."""
    return F.concat(F.slice(strip_eos(ids, eos), 1, max(0, max_len - 1)), F.array(F.lit(eos)))


def decoder_input(ids: Column, eos: int = EOS_ID) -> Column:
    """Teacher-forcing input: eos moves from the end to the front."""
    return F.concat(F.array(F.lit(eos)), F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))))


def drop_second(ids: Column) -> Column:
    """Remove the origin mark that follows the task tag."""
    return F.concat(F.slice(ids, 1, 1), F.slice(ids, F.lit(3), F.greatest(F.size(ids) - 2, F.lit(0))))


def round_up(n: Column, multiple: int) -> Column:
    return n if multiple <= 1 else (F.ceil(n / F.lit(multiple)) * multiple).cast("int")


def pad_left(ids: Column, length: Column, pad: int = PAD_ID) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), length - F.size(ids)), ids)


def pad_right(ids: Column, length: Column, pad: int = PAD_ID) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), length - F.size(ids)))


def count_non_pad(ids: Column, pad: int = PAD_ID) -> Column:
    return F.size(strip_pad(ids, pad))


def strip_pad(ids: Column, pad: int = PAD_ID) -> Column:
    return F.array_remove(ids, pad)


def row_tokens(src: Column, tgt: Column) -> Column:
    return F.greatest(F.size(src), F.size(tgt))


def mask_synthetic(src: Column, tgt: Column, task: Column, mark_id: int | Column, pad: int = PAD_ID) -> Column:
    """Blank the target of auxiliary rows whose source carries the synthetic mark
    right after the task tag."""
    hit = (task != "base") & F.get(src, F.lit(1)).eqNullSafe(_const(mark_id))
    return F.when(hit, F.array_repeat(F.lit(pad), F.size(tgt))).otherwise(tgt)
