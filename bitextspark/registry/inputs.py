"""Inputs of the registered queries, derived from the given tables.

Every input exists twice, as a DataFrame and as a SQL view with the same
content. All of them cover the whole table and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextspark.config import CleanConfig
from bitextspark.functions import text as tx
from bitextspark.operators.clean import clean_pairs
from bitextspark.registry.base import view
from bitextspark.scale import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pairs_of(documents: DataFrame) -> DataFrame:
    """Consecutive lines of each document as a pseudo-bitext."""
    docs = documents.select("doc_id", "lang", F.split("text", "\n").alias("ls")).where(F.size("ls") > 1)
    both = F.arrays_zip(
        F.slice("ls", F.lit(1), F.size("ls") - 1).alias("src"),
        F.slice("ls", F.lit(2), F.size("ls") - 1).alias("tgt"),
    )
    return docs.select("doc_id", "lang", F.posexplode(both).alias("pos", "z")).select(
        (F.col("doc_id") * (1 << 32) + F.col("pos") + 1).alias("pair_id"),
        "lang",
        F.col("z.src").alias("src"),
        F.col("z.tgt").alias("tgt"),
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs_of(spread(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id"))


def clean(spark: SparkSession, sf: str, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Cleaned pairs with token arrays."""
    return clean_pairs(pairs(spark, sf), cfg)


# --- SQL side -------------------------------------------------------------

# The code points of `text.WHITESPACE` as a plain RE2 class.
WS_SQL = (
    r"'[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"
)


def sql_tokens(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, {WS_SQL}), lambda x: x <> '')"


def sql_numeric(expr: str) -> str:
    return f"regexp_matches({expr}, '{tx.NUMERIC}')"


def sql_differs(a: str, b: str) -> str:
    return (
        f"CASE WHEN {sql_numeric(a)} AND {sql_numeric(b)} "
        f"THEN try_cast(trim({a}) AS DOUBLE) <> try_cast(trim({b}) AS DOUBLE) ELSE {a} <> {b} END"
    )


view(
    "pairs",
    """SELECT doc_id*4294967296+i AS pair_id, lang, ls[i] AS src, ls[i+1] AS tgt
       FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents) d,
            unnest(range(1, len(ls))) r(i)""",
)
view(
    "tk",
    f"SELECT pair_id, lang, src, tgt, {sql_tokens('src')} AS st, {sql_tokens('tgt')} AS tt FROM pairs",
    "pairs",
)
view(
    "cp",
    f"""SELECT pair_id, lang, array_to_string(st, ' ') AS src, array_to_string(tt, ' ') AS tgt, st, tt
        FROM tk
        WHERE NOT (contains(src,'http:') OR contains(src,'https:') OR contains(tgt,'http:') OR contains(tgt,'https:'))
          AND {sql_differs('src', 'tgt')}
          AND len(st) BETWEEN 5 AND 100 AND len(tt) BETWEEN 5 AND 100
          AND len(st) <= 9.0::DOUBLE*len(tt) AND len(tt) <= 9.0::DOUBLE*len(st)""",
    "tk",
)
