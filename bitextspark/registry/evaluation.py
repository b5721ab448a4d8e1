"""Perturbation analysis and translation scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextspark.functions import sampling as sm
from bitextspark.functions import text as tx
from bitextspark.operators import influence as nf
from bitextspark.operators import scoring as sc
from bitextspark.registry import inputs as inp
from bitextspark.plans.evaluate import score_log
from bitextspark.registry.base import query, view
from bitextspark.registry.text import sql_rules
from bitextspark.scale import spread


def pert(spark, sf):
    """Scores of every token of every benchmark text: 2 sides x 5 runs, from md5."""
    texts = spread(inp.table(spark, sf, "benchmark"), "item_id")
    toks = texts.select(F.col("item_id").alias("sample_id"), F.posexplode(tx.tokens(F.col("text"))).alias("pos", "token"))
    runs = toks.withColumn("side", F.explode(F.array(F.lit("source"), F.lit("target")))).withColumn(
        "run", F.explode(F.sequence(F.lit(0), F.lit(4)))
    )
    digest = F.md5(F.concat_ws("|", "side", "sample_id", "run", "pos"))
    return runs.withColumn("logp", -sm.hex_int(digest, 4) / F.lit(16384.0))


view(
    "pert",
    f"""SELECT *, -('0x' || substr(md5(concat_ws('|', side, sample_id, run, pos)),1,4))::BIGINT / 16384.0::DOUBLE AS logp FROM (
          SELECT item_id AS sample_id, i-1 AS pos, w[i] AS token, side, run
          FROM (SELECT item_id, {inp.sql_tokens('text')} AS w FROM benchmark), unnest(range(1, len(w)+1)) u(i),
               (VALUES ('source'), ('target')) s(side), range(0, 5) r(run))""",
)
view(
    "infl",
    """SELECT *, CASE WHEN vs + vt > 0 THEN vs / (vs + vt) END AS influence FROM (
         SELECT sample_id, pos, min(token) AS token, var_pop(exp(logp)) FILTER (WHERE side = 'source') AS vs,
                var_pop(exp(logp)) FILTER (WHERE side = 'target') AS vt FROM pert GROUP BY sample_id, pos)""",
    "pert",
)


@query(
    "flt7_finite_scores",
    """SELECT side, sample_id, run, pos FROM (SELECT side, sample_id, run::BIGINT AS run, pos::BIGINT AS pos, logp FROM pert)
       WHERE logp > -3.5""",
    "pert",
)
def _(spark, sf):
    # Scores at or below -3.5 are made infinite or undefined first.
    low = F.col("logp") <= -3.5
    broken = F.when(F.col("run") % 2 == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    holes = pert(spark, sf).withColumn("logp", F.when(low, broken).otherwise(F.col("logp")))
    kept = nf.finite_scores(holes)
    return kept.select("side", "sample_id", F.col("run").cast("bigint").alias("run"), F.col("pos").cast("bigint").alias("pos"))


@query(
    "agg11_probability_variance",
    "SELECT side, sample_id, pos::BIGINT AS pos, round(var_pop(exp(logp)), 6) AS variance FROM pert GROUP BY ALL",
    "pert",
)
def _(spark, sf):
    v = nf.variances(pert(spark, sf))
    return v.select("side", "sample_id", F.col("pos").cast("bigint").alias("pos"), F.round("variance", 6).alias("variance"))


@query(
    "agg12_source_influence",
    """SELECT round(avg(influence), 6) AS source_influence, count(influence) AS tokens, count(*) - count(influence) AS undefined FROM infl""",
    "infl",
)
def _(spark, sf):
    return nf.average_influence(nf.token_influence(pert(spark, sf)))


@query(
    "jn10_token_influence",
    "SELECT sample_id, pos::BIGINT AS pos, token, round(influence, 6) AS influence FROM infl",
    "infl",
)
def _(spark, sf):
    t = nf.token_influence(pert(spark, sf))
    return t.select("sample_id", F.col("pos").cast("bigint").alias("pos"), "token", F.round("influence", 6).alias("influence"))


@query(
    "agg13_perplexity",
    """SELECT side, round(nll, 6) AS nll, round(pow(2, nll), 6) AS perplexity, scores FROM (
         SELECT side, -sum(logp) / count(*) / ln(2) AS nll, count(*) AS scores FROM pert GROUP BY side)""",
    "pert",
)
def _(spark, sf):
    return nf.perplexity(pert(spark, sf), by=("side",))


@query(
    "agg14_sentence_score",
    "SELECT side, sample_id, run::BIGINT AS run, round(avg(logp), 6) AS score FROM pert GROUP BY ALL",
    "pert",
)
def _(spark, sf):
    s = nf.sentence_scores(pert(spark, sf))
    return s.select("side", "sample_id", F.col("run").cast("bigint").alias("run"), F.round("score", 6).alias("score"))


@query(
    "agg15_ensemble_score",
    "SELECT side, sample_id, pos::BIGINT AS pos, round(ln(avg(exp(logp))), 6) AS logp FROM pert GROUP BY ALL",
    "pert",
)
def _(spark, sf):
    s = nf.ensemble_scores(pert(spark, sf), keys=("side", "sample_id", "pos"))
    return s.select("side", "sample_id", F.col("pos").cast("bigint").alias("pos"), F.round("logp", 6).alias("logp"))


@query(
    "str10_influence_lines",
    """SELECT sample_id, string_agg(token || '(' || printf('%.2f', influence) || ')', ' ' ORDER BY pos) AS line FROM infl GROUP BY sample_id""",
    "infl",
)
def _(spark, sf):
    return nf.influence_lines(nf.token_influence(pert(spark, sf)))


@query(
    "str10b_run_lines",
    """SELECT side, sample_id, run::BIGINT AS run, string_agg(token || ' [' || printf('%.6f', exp(logp)) || ']', chr(9) ORDER BY pos) AS line
       FROM pert GROUP BY side, sample_id, run""",
    "pert",
)
def _(spark, sf):
    # Exponentials, so that no score is an exact half, where the two engines round differently.
    probabilities = pert(spark, sf).withColumn("logp", F.exp("logp"))
    return nf.run_lines(probabilities).withColumn("run", F.col("run").cast("bigint"))


@query(
    "srt5_report_order",
    "SELECT sample_id, round(avg(influence), 6) AS influence, count(*) AS tokens FROM infl GROUP BY sample_id ORDER BY sample_id",
    "infl",
)
def _(spark, sf):
    per_sample = nf.token_influence(pert(spark, sf)).groupBy("sample_id").agg(
        F.round(F.avg("influence"), 6).alias("influence"), F.count(F.lit(1)).alias("tokens")
    )
    return per_sample.orderBy("sample_id")


# --- translation scores ---------------------------------------------------


def hyp_ref(spark, sf):
    """Cleaned targets as references; hypotheses drop and mask some tokens by md5."""
    draw = lambda i: F.md5(F.concat_ws("|", F.lit("hyp"), "pair_id", i))
    marked = F.transform("tgt_tok", lambda x, i: F.when(draw(i) < "1", "").when(draw(i) < "3", "★").otherwise(x))
    return inp.clean(spark, sf).select(
        F.col("pair_id").alias("id"), tx.join_tokens(F.array_remove(marked, "")).alias("hyp"), F.col("tgt").alias("ref")
    )


D = "md5(concat_ws('|','hyp',pair_id,i-1))"
view(
    "hr",
    f"""SELECT pair_id AS id, tgt AS ref, array_to_string(list_filter(list_transform(tt, lambda x, i:
          CASE WHEN {D} < '1' THEN '' WHEN {D} < '3' THEN '★' ELSE x END), lambda x: x <> ''), ' ') AS hyp FROM cp""",
    "cp",
)


@query(
    "jn11_hypothesis_reference",
    "SELECT id, hyp = ref AS same, length(hyp) AS nh, length(ref) AS nr FROM hr",
    "hr",
)
def _(spark, sf):
    both = hyp_ref(spark, sf)
    joined = sc.hypotheses_with_references(both.select("id", "hyp"), both.select("id", "ref"))
    return joined.select(
        "id", (F.col("hyp") == F.col("ref")).alias("same"),
        F.length("hyp").cast("bigint").alias("nh"), F.length("ref").cast("bigint").alias("nr"),
    )


def _sql_counts(hyp, ref, orders, glue, table="hr"):
    gram = f"array_to_string(u[i:i+n-1], '{glue}')"
    return f"""SELECT n, sum(least(hc, rc))::BIGINT AS m, sum(hc)::BIGINT AS h, sum(rc)::BIGINT AS r FROM (
        SELECT id, n, g, count(*) FILTER (WHERE side = 1) AS hc, count(*) FILTER (WHERE side = 0) AS rc FROM (
          SELECT id, side, n, {gram} AS g FROM (
            SELECT id, 1 AS side, {hyp} AS u FROM {table} UNION ALL SELECT id, 0, {ref} FROM {table}) x,
            range(1, {orders}+1) o(n), unnest(range(1, greatest(len(u) - n + 2, 1))) p(i))
        GROUP BY id, n, g) GROUP BY n"""


def _sql_score_tokens(c):
    return inp.sql_tokens(f"regexp_replace({c}, '{sc.PUNCTUATION}', ' \\1 ', 'g')")


def _sql_chars(c):
    return f"string_split(regexp_replace({c}, {inp.WS_SQL}, '', 'g'), '')"


view("bc", _sql_counts(_sql_score_tokens("hyp"), _sql_score_tokens("ref"), 4, " "), "hr")
view("cc", _sql_counts(_sql_chars("hyp"), _sql_chars("ref"), 6, ""), "hr")
view("wc", _sql_counts(_sql_score_tokens("hyp"), _sql_score_tokens("ref"), 2, " "), "hr")


BLEU = """SELECT round(100 * bp * exp((ln(p[1]) + ln(p[2]) + ln(p[3]) + ln(p[4])) / 4), 6) AS bleu,
              round(100*p[1], 6) AS p1, round(100*p[2], 6) AS p2, round(100*p[3], 6) AS p3, round(100*p[4], 6) AS p4,
              round(bp, 6) AS brevity, hyp_len, ref_len
       FROM (SELECT *, CASE WHEN hyp_len >= ref_len THEN 1.0::DOUBLE ELSE exp(1 - ref_len / hyp_len) END AS bp FROM (
         SELECT list(m::DOUBLE / h ORDER BY n) AS p, max(h) FILTER (WHERE n = 1) AS hyp_len, max(r) FILTER (WHERE n = 1) AS ref_len FROM {}))"""


@query("agg16_corpus_bleu", BLEU.format("bc"), "bc")
def _(spark, sf):
    return sc.corpus_bleu(hyp_ref(spark, sf))


CHRF = """SELECT round(100 * 5 * p * r / (4 * p + r), 6) AS chrf, round(p, 6) AS precision, round(r, 6) AS recall
          FROM (SELECT avg(m / h) AS p, avg(m / r) AS r FROM ({}))"""


@query("agg17_corpus_chrf", CHRF.format("SELECT * FROM cc"), "cc")
def _(spark, sf):
    return sc.corpus_chrf(hyp_ref(spark, sf))


@query("agg17b_corpus_chrf_words", CHRF.format("SELECT * FROM cc UNION ALL SELECT * FROM wc"), "cc", "wc")
def _(spark, sf):
    return sc.corpus_chrf(hyp_ref(spark, sf), word_order=2)


# A generation log: hypothesis rows among others, sub-words still joined by `@@ `.
view(
    "log",
    f"""SELECT id, ref, CASE WHEN substr(x, 1, 1) = 'ß' THEN 'ß' ELSE upper(substr(x, 1, 1)) END || substr(x, 2) AS hyp FROM
          (SELECT id, ref, {sql_rules('hyp', tx.DETOKENISE_RULES + [tx.DETOKENISE_APOSTROPHES['en']])} AS x FROM hr)""",
    "hr",
)
view("lbc", _sql_counts(_sql_score_tokens("hyp"), _sql_score_tokens("ref"), 4, " ", "log"), "log")
view("lcc", _sql_counts(_sql_chars("hyp"), _sql_chars("ref"), 6, "", "log"), "log")


@query(
    "score_generation_log",
    f"SELECT b.bleu, b.brevity, c.chrf FROM ({BLEU.format('lbc')}) b, ({CHRF.format('SELECT * FROM lcc')}) c",
    "lbc",
    "lcc",
)
def _(spark, sf):
    both = hyp_ref(spark, sf)
    pieces = F.regexp_replace("hyp", "([a-z])en", "$1@@ en")
    line = lambda kind, text: F.concat_ws("\t", F.concat(F.lit(kind), F.col("id").cast("string")), F.lit("-0.25"), text)
    log = both.select(F.explode(F.array(line("S-", F.col("ref")), line("H-", pieces))).alias("value"))
    return score_log(log, both.select("id", "ref"), "en")
