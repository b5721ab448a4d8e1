"""String functions, truecasing."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextspark.functions import text as tx
from bitextspark.operators import truecase as tc
from bitextspark.registry import inputs as inp
from bitextspark.registry.base import query, view
from bitextspark.scale import materialise


def sql_rules(expr, rules):
    for pattern, replacement in rules:
        p = pattern.replace("'", "''")
        r = replacement.replace("$1", "\\1").replace("$2", "\\2").replace("'", "''")
        expr = f"regexp_replace({expr}, '{p}', '{r}', 'g')"
    return expr


def _sql_by_language(expr, rules):
    cases = " ".join(f"WHEN lang = '{c}' THEN {sql_rules(expr, [r])}" for c, r in rules.items() if c)
    return f"CASE {cases} ELSE {sql_rules(expr, [rules['']])} END"


view("n0", f"SELECT pair_id, lang, {sql_rules('src', tx.NORMALISE_RULES)} AS x FROM pairs", "pairs")
view("n1", f"SELECT pair_id, lang, {sql_rules('x', tx.SPLIT_RULES)} AS x FROM n0", "n0")
view(
    "tokd",
    f"SELECT pair_id, lang, trim(regexp_replace({_sql_by_language('x', tx.APOSTROPHE_RULES)}, '\\s+', ' ', 'g')) AS x FROM n1",
    "n1",
)
view("tokw", f"SELECT pair_id, lang, {inp.sql_tokens('x')} AS w FROM tokd", "tokd")


def tokenised(spark, sf):
    return inp.pairs(spark, sf).select("pair_id", "lang", tx.tokenise(F.col("src"), F.col("lang")).alias("x"))


def words(spark, sf):
    return tokenised(spark, sf).select("pair_id", "lang", tx.tokens(F.col("x")).alias("w"))


@query("str1_split_join", "SELECT pair_id, array_to_string(st, ' ') AS src, len(st)::BIGINT AS n FROM tk", "tk")
def _(spark, sf):
    t = inp.pairs(spark, sf).select("pair_id", tx.tokens(F.col("src")).alias("t"))
    return t.select("pair_id", tx.join_tokens(F.col("t")).alias("src"), F.size("t").cast("bigint").alias("n"))


@query("str2_squeeze", "SELECT page_id, md5(regexp_replace(html, '\\s+', ' ', 'g')) AS digest FROM pages")
def _(spark, sf):
    return inp.table(spark, sf, "pages").select("page_id", F.md5(tx.squeeze(F.col("html"))).alias("digest"))


@query(
    "str3_undo_subwords",
    """SELECT pair_id, regexp_replace(x, '(@@ )|(@@ ?$)', '', 'g') AS src FROM
         (SELECT pair_id, regexp_replace(src, 'en', 'en@@ ', 'g') AS x FROM pairs)""",
    "pairs",
)
def _(spark, sf):
    return inp.pairs(spark, sf).select(
        "pair_id", tx.undo_subwords(F.regexp_replace("src", "en", "en@@ ")).alias("src")
    )


@query("str4_tokenise", "SELECT pair_id, x AS src FROM tokd", "tokd")
def _(spark, sf):
    return tokenised(spark, sf).select("pair_id", F.col("x").alias("src"))


@query(
    "str6_undo_truecase",
    """SELECT pair_id, CASE WHEN substr(src,1,1) = 'ß' THEN 'ß' ELSE upper(substr(src,1,1)) END || substr(src,2) AS src FROM pairs""",
    "pairs",
)
def _(spark, sf):
    return inp.pairs(spark, sf).select("pair_id", tx.capitalise(F.col("src")).alias("src"))


@query(
    "str7_detokenise",
    f"SELECT pair_id, {_sql_by_language('y', tx.DETOKENISE_APOSTROPHES)} AS src FROM (SELECT pair_id, lang, {sql_rules('x', tx.DETOKENISE_RULES)} AS y FROM tokd)",
    "tokd",
)
def _(spark, sf):
    return tokenised(spark, sf).select("pair_id", tx.detokenise(F.col("x"), F.col("lang")).alias("src"))


view(
    "tcpos",
    "SELECT pair_id, lang, i, w[i] AS x, (i = 1 OR w[i-1] IN ('.',':','?','!')) AS starts FROM tokw, unnest(range(1, len(w)+1)) u(i)",
    "tokw",
)
view(
    "tcmodel",
    """SELECT lang, low, x AS best, n FROM (SELECT *, row_number() OVER (PARTITION BY lang, low ORDER BY n DESC, x) AS r FROM
         (SELECT lang, lower(x) AS low, x, count(*) AS n FROM tcpos WHERE NOT starts GROUP BY ALL)) WHERE r = 1""",
    "tcpos",
)


@query("agg4_truecase_model", "SELECT lang, low AS lower, best, n FROM tcmodel", "tcmodel")
def _(spark, sf):
    return tc.learn_truecase(words(spark, sf), "w")


@query(
    "str5_apply_truecase",
    """SELECT pair_id, array_to_string(list(CASE WHEN starts THEN coalesce(best, x) ELSE x END ORDER BY i), ' ') AS src
       FROM tcpos LEFT JOIN tcmodel ON tcpos.lang = tcmodel.lang AND lower(tcpos.x) = tcmodel.low GROUP BY pair_id""",
    "tcpos",
    "tcmodel",
)
def _(spark, sf):
    w = words(spark, sf)
    cased = tc.apply_truecase(w, materialise(tc.learn_truecase(w, "w")), "w")
    return cased.where(F.size("w") > 0).select("pair_id", tx.join_tokens(F.col("w")).alias("src"))


@query(
    "jn8_truecase_lookup",
    """SELECT pair_id, i::BIGINT - 1 AS pos, x AS word, best FROM tcpos JOIN tcmodel ON tcpos.lang = tcmodel.lang AND lower(x) = low
       WHERE starts AND best <> x""",
    "tcpos",
    "tcmodel",
)
def _(spark, sf):
    w = words(spark, sf)
    cased = tc.apply_truecase(w, materialise(tc.learn_truecase(w, "w")), "w", given="word")
    changed = F.filter(
        F.zip_with(F.arrays_zip("word", F.col("w").alias("best")), F.sequence(F.lit(0), F.size("w") - 1), lambda z, i: F.struct(i.alias("pos"), z["word"].alias("word"), z["best"].alias("best"))),
        lambda z: z["word"] != z["best"],
    )
    return cased.where(F.size("w") > 0).select("pair_id", F.inline(changed)).withColumn("pos", F.col("pos").cast("bigint"))
