"""Links, lexicons, bilingual tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextspark.functions import text as tx
from bitextspark.operators import bilingual as bl
from bitextspark.registry import inputs as inp
from bitextspark.registry.base import query, view
from bitextspark.scale import global_rank, stored


def linked(spark, sf):
    """Clean pairs with links: near-diagonal positions kept by md5, some neighbours crossed."""
    n = F.least(F.size("src_tok"), F.size("tgt_tok"))
    kept = F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: F.md5(F.concat_ws("|", F.lit("link"), "pair_id", i)) < "c"
    )

    def target(i):
        other = i.bitwiseXOR(F.lit(1))
        crossed = F.md5(F.concat_ws("|", F.lit("cross"), "pair_id", F.floor(i / 2))) < "4"
        return F.when(crossed & (other < n), other).otherwise(i)

    links = F.transform(kept, lambda i: F.struct(i.alias("s"), target(i).alias("t")))
    return inp.clean(spark, sf).select("pair_id", "src_tok", "tgt_tok", links.alias("links"))


view(
    "lk",
    """SELECT pair_id, s, CASE WHEN md5(concat_ws('|','cross',pair_id,s//2)) < '4' AND xor(s,1) < n THEN xor(s,1) ELSE s END AS t,
              row_number() OVER (PARTITION BY pair_id ORDER BY s) - 1 AS k
       FROM (SELECT pair_id, unnest(range(0, least(len(st),len(tt)))) AS s, least(len(st),len(tt)) AS n FROM cp)
       WHERE md5(concat_ws('|','link',pair_id,s)) < 'c'""",
    "cp",
)
view("lw", "SELECT l.pair_id, k, s, t, st[s+1] AS src, tt[t+1] AS tgt FROM lk l JOIN cp USING (pair_id)", "lk", "cp")
view(
    "lexn",
    """SELECT src, tgt, count(*) AS n FROM (
         SELECT src, tgt FROM lw
         UNION ALL SELECT 'NULL', tt[i] FROM cp, unnest(range(1, len(tt)+1)) u(i)
            WHERE (pair_id, i-1) NOT IN (SELECT (pair_id, t) FROM lk)
         UNION ALL SELECT st[i], 'NULL' FROM cp, unnest(range(1, len(st)+1)) u(i)
            WHERE (pair_id, i-1) NOT IN (SELECT (pair_id, s) FROM lk))
       GROUP BY src, tgt""",
    "lw",
    "lk",
    "cp",
)
view(
    "lex",
    "SELECT tgt, src, n, n / sum(n) OVER (PARTITION BY src) AS prob, row_number() OVER (ORDER BY src, tgt) - 1 AS row_no FROM lexn",
    "lexn",
)
view(
    "best",
    """SELECT src, tgt, prob FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY prob DESC, row_no) AS r
         FROM lex WHERE src <> 'NULL' AND tgt <> 'NULL') WHERE r = 1""",
    "lex",
)


def lexicon(spark, sf):
    return bl.lexical_table(bl.lexical_counts(linked(spark, sf)))


def numbered_lexicon(spark, sf):
    return global_rank(lexicon(spark, sf), ["src", "tgt"], "row_no")


@query("src3_alignment_scan", "SELECT pair_id, k, s, t FROM lk", "lk")
def _(spark, sf):
    lines = linked(spark, sf).select("pair_id", bl.render_links(F.col("links")).alias("line"))
    parsed = lines.select("pair_id", F.posexplode(bl.parse_links(F.col("line"))).alias("k", "l"))
    return parsed.select("pair_id", *[F.col(c).cast("bigint").alias(n) for n, c in (("k", "k"), ("s", "l.s"), ("t", "l.t"))])


@query(
    "src4_lexicon_scan",
    """SELECT 'ok' AS part, tgt, src, round(n / 64.0::DOUBLE, 6) AS prob FROM lexn
       UNION ALL SELECT 'rejected', text, '', NULL FROM benchmark""",
    "lexn",
)
def _(spark, sf):
    # Lexicon lines plus free text that does not parse.
    good = bl.lexical_counts(linked(spark, sf)).select(
        F.concat_ws("  ", "tgt", "src", (F.col("n") / 64.0).cast("string")).alias("value")
    )
    bad = inp.table(spark, sf, "benchmark").select(F.col("text").alias("value"))
    parsed, rejected = bl.parse_lexicon(good.unionByName(bad))
    return parsed.select(F.lit("ok").alias("part"), "tgt", "src", F.round("prob", 6).alias("prob")).unionByName(
        rejected.select(F.lit("rejected").alias("part"), F.col("value").alias("tgt"), F.lit("").alias("src"), F.lit(None).cast("double").alias("prob"))
    )


@query(
    "jn2_three_way_zip",
    """SELECT coalesce(a.pair_id, b.pair_id, c.pair_id) AS pair_id,
              CASE WHEN a.pair_id IS NULL OR b.pair_id IS NULL OR c.pair_id IS NULL THEN 'rejected' ELSE 'complete' END AS part
       FROM (SELECT DISTINCT pair_id FROM lk) a FULL JOIN pairs b ON a.pair_id = b.pair_id
            FULL JOIN cp c ON coalesce(a.pair_id, b.pair_id) = c.pair_id""",
    "lk",
    "pairs",
    "cp",
)
def _(spark, sf):
    links = linked(spark, sf).where(F.size("links") > 0).select("pair_id", "links")
    src = inp.pairs(spark, sf).select("pair_id", "src")
    tgt = inp.clean(spark, sf).select("pair_id", "tgt")
    complete, rejected = bl.zip_three(links, src, tgt)
    return complete.select("pair_id", F.lit("complete").alias("part")).unionByName(
        rejected.select("pair_id", F.lit("rejected").alias("part"))
    )


@query(
    "jn3_lock_step_links",
    """SELECT p.pair_id, count(l.pair_id) AS n_links FROM pairs p LEFT JOIN lk l ON p.pair_id = l.pair_id GROUP BY p.pair_id""",
    "pairs",
    "lk",
)
def _(spark, sf):
    links = linked(spark, sf).select("pair_id", "links")
    return bl.attach_links(inp.pairs(spark, sf).select("pair_id"), links).select(
        "pair_id", F.size("links").cast("bigint").alias("n_links")
    )


@query("jn7_link_words", "SELECT pair_id, k, src, tgt FROM lw", "lw")
def _(spark, sf):
    return bl.link_words(linked(spark, sf)).select("pair_id", F.col("k").cast("bigint").alias("k"), "src", "tgt")


@query(
    "jn12_link_intersection",
    """SELECT pair_id, s, t FROM lk INTERSECT SELECT pair_id, s, s FROM lk""",
    "lk",
)
def _(spark, sf):
    diagonal = F.transform("links", lambda l: F.struct(l["s"].alias("s"), l["s"].alias("t")))
    rows = linked(spark, sf).select("pair_id", F.inline(bl.intersect_links(F.col("links"), diagonal)))
    return rows.select("pair_id", F.col("s").cast("bigint").alias("s"), F.col("t").cast("bigint").alias("t"))


@query(
    "flt8_null_entries",
    "SELECT tgt, src, n FROM lexn WHERE src <> 'NULL' AND tgt <> 'NULL'",
    "lexn",
)
def _(spark, sf):
    return bl.without_null(bl.lexical_counts(linked(spark, sf))).select("tgt", "src", "n")


@query("agg5_lexical_table", "SELECT tgt, src, n, round(prob, 6) AS prob FROM lex", "lex")
def _(spark, sf):
    return lexicon(spark, sf).select("tgt", "src", "n", F.round("prob", 6).alias("prob"))


@query(
    "agg5b_lexical_table_inverse",
    "SELECT tgt, src, round(n / sum(n) OVER (PARTITION BY tgt), 6) AS prob FROM lexn",
    "lexn",
)
def _(spark, sf):
    inverse = bl.lexical_table(bl.lexical_counts(linked(spark, sf)), given="tgt")
    return inverse.select("tgt", "src", F.round("prob", 6).alias("prob"))


@query("agg6_best_translation", "SELECT src, tgt, round(prob, 6) AS prob FROM best", "best")
def _(spark, sf):
    return bl.best_translations(numbered_lexicon(spark, sf)).select("src", "tgt", F.round("prob", 6).alias("prob"))


@query(
    "agg6b_best_by_first_field",
    """SELECT src, tgt, round(prob, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY tgt ORDER BY prob DESC, row_no) AS r
         FROM lex WHERE src <> 'NULL' AND tgt <> 'NULL') WHERE r = 1""",
    "lex",
)
def _(spark, sf):
    return bl.best_by_first_field(numbered_lexicon(spark, sf)).select("src", "tgt", F.round("prob", 6).alias("prob"))


@query("agg8_target_vocabulary", "SELECT DISTINCT tgt FROM lexn", "lexn")
def _(spark, sf):
    return bl.target_vocabulary(bl.lexical_counts(linked(spark, sf)))


@query(
    "agg10_short_alignments",
    """SELECT count(*) FILTER (WHERE floor(len(tt)*0.7::DOUBLE) >= nl) AS short, count(*) AS pairs
       FROM (SELECT c.*, coalesce(l.nl, 0) AS nl FROM cp c LEFT JOIN (SELECT pair_id, count(*) AS nl FROM lk GROUP BY 1) l USING (pair_id))""",
    "lk",
    "cp",
)
def _(spark, sf):
    return bl.count_short_alignments(linked(spark, sf), 0.7)


@query(
    "agg21_alignment_weights",
    "SELECT pair_id, k, round(1.0::DOUBLE / count(*) OVER (PARTITION BY pair_id, t // 2), 6) AS weight FROM lk",
    "lk",
)
def _(spark, sf):
    # Halved target positions, so that several links share one.
    shared = F.transform("links", lambda l: F.struct(l["s"].alias("s"), F.floor(l["t"] / 2).cast("int").alias("t")))
    rows = linked(spark, sf).select("pair_id", F.posexplode(bl.link_weights(shared)).alias("k", "weight"))
    return rows.select("pair_id", F.col("k").cast("bigint").alias("k"), F.round("weight", 6).alias("weight"))


@query(
    "agg22_alignment_validity",
    """SELECT c.pair_id, CASE WHEN max(s) >= len(any_value(st)) - 2 OR max(t) >= len(any_value(tt)) - 2 THEN 0 ELSE count(l.pair_id) END AS n_links
       FROM cp c LEFT JOIN lk l USING (pair_id) GROUP BY c.pair_id""",
    "cp",
    "lk",
)
def _(spark, sf):
    kept = bl.valid_links(F.col("links"), F.size("src_tok") - 1, F.size("tgt_tok") - 1)
    return linked(spark, sf).select("pair_id", F.size(kept).cast("bigint").alias("n_links"))


# --- replacement ----------------------------------------------------------

STRIDE = "[2147483647, 2147483629, 2147483587, 2147483579]::BIGINT[]"


def sql_rank(task, j, size):
    d = f"md5(concat_ws('|','17','{task}',1,pair_id,'draw'))"
    hexint = lambda a: f"('0x' || substr({d},{a},8))::BIGINT"
    return f"({hexint(1)} + {j} * ({STRIDE})[{hexint(9)} % 4 + 1]) % {size}"


view("ent", "SELECT row_number() OVER (ORDER BY src) - 1 AS rank, src, tgt FROM best", "best")
view("voc", "SELECT row_number() OVER (ORDER BY tgt) - 1 AS rank, tgt FROM (SELECT DISTINCT tgt FROM lexn)", "lexn")


view(
    "rep",
    f"""SELECT j.pair_id, j.s, j.t, e.src AS esrc, e.tgt AS etgt FROM (
          SELECT *, {sql_rank('replace', 'j', '(SELECT count(*) FROM ent)')} AS rank FROM (
            SELECT pair_id, s, t, n, row_number() OVER (PARTITION BY pair_id ORDER BY
                   CASE WHEN n < nl THEN md5(concat_ws('|','17','replace',1,pair_id,k)) ELSE '' END, k) - 1 AS j
            FROM (SELECT l.*, floor(len(c.tt)*0.3::DOUBLE)::BIGINT AS n, count(*) OVER (PARTITION BY l.pair_id) AS nl
                  FROM lk l JOIN cp c USING (pair_id))) WHERE j < n) j
        JOIN ent e USING (rank)""",
    "lk",
    "cp",
    "ent",
)


@query(
    "aux12_replace",
    """SELECT x.pair_id, x.src, y.tgt FROM
         (SELECT c.pair_id, array_to_string(list(coalesce(r.esrc, c.w) ORDER BY c.i),' ') AS src
            FROM (SELECT pair_id, i, st[i] AS w FROM cp, unnest(range(1, len(st)+1)) u(i)) c
            LEFT JOIN rep r ON r.pair_id = c.pair_id AND r.s = c.i-1 GROUP BY c.pair_id) x
         JOIN (SELECT c.pair_id, array_to_string(list(coalesce(r.etgt, c.w) ORDER BY c.i),' ') AS tgt
            FROM (SELECT pair_id, i, tt[i] AS w FROM cp, unnest(range(1, len(tt)+1)) u(i)) c
            LEFT JOIN rep r ON r.pair_id = c.pair_id AND r.t = c.i-1 GROUP BY c.pair_id) y USING (pair_id)""",
    "rep",
    "cp",
)
def _(spark, sf):
    # Links are read twice, for the lexicon and for the replacement.
    pairs = stored(linked(spark, sf), "linked")
    table = bl.lexical_table(bl.lexical_counts(pairs))
    entries = bl.rank_lexicon(bl.best_translations(table, row_no=None))
    made = bl.replace_words(pairs, entries, 0.3)
    return made.select("pair_id", tx.join_tokens(F.col("src_tok")).alias("src"), tx.join_tokens(F.col("tgt_tok")).alias("tgt"))


@query(
    "aux13_replace_target",
    f"""SELECT pair_id, array_to_string(list(coalesce(w, tt[i]) ORDER BY i), ' ') AS tgt FROM (
          SELECT c.pair_id, c.tt, c.i, v.tgt AS w FROM (
            SELECT *, CASE WHEN j < floor(len(tt)*0.3::DOUBLE) THEN {sql_rank('replace_tgt', 'j', '(SELECT count(*) FROM voc)')} END AS rank FROM (
              SELECT pair_id, tt, i, row_number() OVER (PARTITION BY pair_id ORDER BY md5(concat_ws('|','17','replace_tgt',1,pair_id,i-1))) - 1 AS j
              FROM cp, unnest(range(1, len(tt)+1)) u(i))) c LEFT JOIN voc v ON v.rank = c.rank)
        GROUP BY pair_id""",
    "voc",
    "cp",
)
def _(spark, sf):
    pairs = stored(linked(spark, sf), "linked")
    words = bl.rank_vocabulary(bl.target_vocabulary(bl.lexical_counts(pairs)))
    made = bl.replace_target_words(pairs, words, 0.3)
    return made.select("pair_id", tx.join_tokens(F.col("tgt_tok")).alias("tgt"))


@query(
    "aux14_monotone",
    """SELECT pair_id, array_to_string(list(x ORDER BY a, i), ' ') AS tgt FROM (
         SELECT pair_id, i, x, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY i
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS a
         FROM (SELECT c.pair_id, i, tt[i] AS x, m.s FROM cp c, unnest(range(1, len(tt)+1)) u(i)
               LEFT JOIN (SELECT pair_id, t, min(s) AS s FROM lk GROUP BY pair_id, t) m ON m.pair_id = c.pair_id AND m.t = i-1))
       GROUP BY pair_id""",
    "cp",
    "lk",
)
def _(spark, sf):
    made = bl.monotone_target(F.col("tgt_tok"), F.col("links"))
    return linked(spark, sf).select("pair_id", tx.join_tokens(made).alias("tgt"))


@query(
    "str8_unit_reassembly",
    """SELECT pair_id, replace(array_to_string(st[1:least(len(st),len(tt))],' '), '|', '¦') AS src,
              replace(tgt, '|', '¦') AS tgt FROM cp""",
    "cp",
)
def _(spark, sf):
    # Units of zipped words; surplus target words have an empty source half and
    # surplus source words are left out.
    pairs = inp.clean(spark, sf)
    safe = lambda w: F.replace(w, F.lit("|"), F.lit("¦"))
    body = F.transform(
        "tgt_tok", lambda w, i: F.concat(safe(F.coalesce(F.get("src_tok", i), F.lit(""))), F.lit("|"), safe(w))
    )
    units = pairs.select("pair_id", F.posexplode(F.concat(F.array(F.lit("Ɛ|Ɛ")), body)).alias("unit_pos", "unit"))
    return bl.reassemble_units(units)
