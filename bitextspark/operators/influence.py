"""Analysis of perturbation logs: how much each output token depends on the source
and on the target prefix.

Input: `pert(side, sample_id, run, pos, token, logp)`, side `source` or `target`.
All results are plain aggregates with map-side partial sums; positions are keys, so
dropping a non-finite score never shifts the tokens after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextspark.functions import text as tx


def finite_scores(pert: DataFrame) -> DataFrame:
    return pert.where(~F.isnan("logp") & (F.abs("logp") < float("inf")))


def variances(pert: DataFrame, use_probabilities: bool = True) -> DataFrame:
    """Population variance over runs per side, sample and position."""
    value = F.exp("logp") if use_probabilities else F.col("logp")
    return pert.groupBy("side", "sample_id", "pos").agg(F.var_pop(value).alias("variance"))


def token_influence(pert: DataFrame, by: tuple[str, ...] = (), use_probabilities: bool = True) -> DataFrame:
    """Source variance over total variance per token; null where both are zero.

    One grouping with conditional variances, so the two sides are never joined.
    """
    value = F.exp("logp") if use_probabilities else F.col("logp")
    on = lambda side: F.var_pop(F.when(F.col("side") == side, value))
    grouped = pert.groupBy(*by, "sample_id", "pos").agg(
        F.min("token").alias("token"), on("source").alias("v_source"), on("target").alias("v_target")
    )
    total = F.col("v_source") + F.col("v_target")
    return grouped.withColumn("influence", F.when(total > 0, F.col("v_source") / total))


def average_influence(tokens: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Micro-average over all tokens, with the tokens whose influence is undefined."""
    return tokens.groupBy(*by).agg(
        F.round(F.avg("influence"), 6).alias("source_influence"),
        F.count("influence").alias("tokens"),
        F.count_if(F.col("influence").isNull()).alias("undefined"),
    )


def perplexity(pert: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Negative log-likelihood in bits and perplexity, all sides and runs pooled."""
    nll = -F.sum("logp") / F.count(F.lit(1)) / F.log(F.lit(2.0))
    out = pert.groupBy(*by).agg(nll.alias("nll"), F.count(F.lit(1)).alias("scores"))
    return out.select(*by, F.round("nll", 6).alias("nll"), F.round(F.pow(F.lit(2.0), "nll"), 6).alias("perplexity"), "scores")


def sentence_scores(pert: DataFrame) -> DataFrame:
    return pert.groupBy("side", "sample_id", "run").agg(F.avg("logp").alias("score"))


def ensemble_scores(scores: DataFrame, keys: tuple[str, ...] = ("sample_id", "pos")) -> DataFrame:
    """Log of the mean probability over models; a single model keeps its score."""
    return scores.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) == 1, F.max("logp")).otherwise(F.ln(F.avg(F.exp("logp")))).alias("logp")
    )


def _line(rows: Column, value: str) -> Column:
    return tx.render_scores(F.transform(rows, lambda r: r["token"]), F.transform(rows, lambda r: r[value]))


def influence_lines(tokens: DataFrame) -> DataFrame:
    """`tok(0.53) tok(0.40)` per sample. A group is the tokens of one sentence."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "token", "influence")))
    return tokens.groupBy("sample_id").agg(rows.alias("r")).select("sample_id", _line(F.col("r"), "influence").alias("line"))


def run_lines(pert: DataFrame) -> DataFrame:
    """Tab-joined `word [log-prob]` cells per side, sample and run."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "token", "logp")))
    cell = lambda r: F.format_string("%s [%.6f]", r["token"], r["logp"])
    grouped = pert.groupBy("side", "sample_id", "run").agg(rows.alias("r"))
    return grouped.select("side", "sample_id", "run", F.array_join(F.transform("r", cell), "\t").alias("line"))
