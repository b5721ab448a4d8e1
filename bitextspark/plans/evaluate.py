"""From a generation log to scores: extract, undo the text processing, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextspark.functions import text as tx
from bitextspark.operators.scoring import corpus_bleu, corpus_chrf, hypotheses_with_references
from bitextspark.sources.tables import extract_hypotheses


def plain_text(text, lang: str):
    """Undo sub-words, tokenisation and truecasing."""
    return tx.capitalise(tx.detokenise(tx.undo_subwords(text), F.lit(lang)))


def score_log(log: DataFrame, refs: DataFrame, lang: str, word_order: int = 0) -> DataFrame:
    """One row with BLEU and chrF of the `H-` lines of `log(value)` against `refs(id, ref)`."""
    hyps = extract_hypotheses(log).select("id", plain_text(F.col("hyp"), lang).alias("hyp"))
    both = hypotheses_with_references(hyps, refs)
    bleu = corpus_bleu(both).select(F.lit(1).alias("one"), "bleu", "brevity")
    chrf = corpus_chrf(both, word_order=word_order).select(F.lit(1).alias("one"), "chrf")
    return bleu.join(chrf, "one").drop("one")
