"""Counts, vocabularies, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextspark.config import TaskSpec
from bitextspark.functions import text as tx
from bitextspark.operators import bilingual as bl
from bitextspark.operators import tasks as tk
from bitextspark.operators import vocab as vo
from bitextspark.registry import inputs as inp
from bitextspark.registry.base import query, view
from bitextspark.registry.bilingual import linked
from bitextspark.registry.rows import ids_text

view(
    "cnt",
    """SELECT symbol, count(*) AS count FROM (SELECT unnest(st) AS symbol FROM cp UNION ALL SELECT unnest(tt) FROM cp)
       GROUP BY symbol""",
    "cp",
)
# Threshold 2, so that some tokens are unknown when encoding.
view(
    "vocab",
    "SELECT row_number() OVER (ORDER BY count DESC, symbol) + 3 AS id, symbol, count FROM cnt WHERE count >= 2",
    "cnt",
)
view(
    "encv",
    """SELECT pair_id, list_append(list(coalesce(v.id, 3) ORDER BY i), 2) AS t
       FROM (SELECT pair_id, i, tt[i] AS w FROM cp, unnest(range(1, len(tt)+1)) u(i)) c LEFT JOIN vocab v ON v.symbol = c.w
       GROUP BY pair_id""",
    "cp",
    "vocab",
)


def vocabulary(spark, sf, padding=0):
    counts = vo.token_counts(inp.clean(spark, sf), "src_tok", "tgt_tok")
    return vo.build_vocabulary(counts, threshold=2, padding_factor=padding)


@query(
    "agg1_token_counts",
    """SELECT lang, symbol, count(*) AS count FROM (SELECT lang, unnest(tt) AS symbol FROM cp) GROUP BY lang, symbol
       HAVING count(*) >= 2""",
    "cp",
)
def _(spark, sf):
    return vo.with_threshold(vo.token_counts(inp.clean(spark, sf), "tgt_tok", by=("lang",)), 2)


@query(
    "agg1b_top_words",
    "SELECT symbol, count FROM cnt ORDER BY count DESC, symbol LIMIT 100",
    "cnt",
)
def _(spark, sf):
    return vo.top_words(vo.token_counts(inp.clean(spark, sf), "src_tok", "tgt_tok"), 100)


@query(
    "agg2_joint_vocabulary",
    """SELECT symbol, count(*) AS count FROM (
         SELECT unnest(['TO_de'] || st) AS symbol FROM cp UNION ALL SELECT unnest(['TO_detrain2'] || st) FROM cp
         UNION ALL SELECT unnest(tt) FROM cp UNION ALL SELECT unnest(list_reverse(tt)) FROM cp) GROUP BY symbol""",
    "cp",
)
def _(spark, sf):
    versions = tk.tag_sources(tk.add_tasks(inp.clean(spark, sf), [TaskSpec("rev")]), "de")
    return vo.token_counts(versions, "src_tok", "tgt_tok")


@query(
    "win1_vocabulary_ids",
    """SELECT id::BIGINT AS id, symbol, count::BIGINT AS count FROM (
         SELECT id, symbol, count FROM vocab
         UNION ALL SELECT * FROM (VALUES (0,'<s>',0),(1,'<pad>',0),(2,'</s>',0),(3,'<unk>',0))
         UNION ALL SELECT (SELECT count(*) FROM vocab) + 4 + k, 'madeupword' || lpad(k::VARCHAR, 4, '0'), 0
           FROM range(0, 8) r(k) WHERE k < (8 - ((SELECT count(*) FROM vocab) + 4) % 8) % 8)""",
    "vocab",
)
def _(spark, sf):
    v = vocabulary(spark, sf, padding=8)
    return v.select(F.col("id").cast("bigint").alias("id"), "symbol", "count")


@query(
    "src5_vocabulary_lines",
    "SELECT id::BIGINT AS id, symbol, count, symbol || ' ' || count AS line FROM vocab",
    "vocab",
)
def _(spark, sf):
    lines = vo.vocabulary_lines(vocabulary(spark, sf))
    back = vo.parse_vocabulary(lines).withColumnRenamed("id", "__id")
    joined = lines.join(back, F.col("id") == F.col("__id"))
    return joined.select(F.col("id").cast("bigint").alias("id"), "symbol", "count", "line")


@query("jn5_encode", "SELECT pair_id, array_to_string(t, ' ') AS ids FROM encv", "encv")
def _(spark, sf):
    pairs = inp.clean(spark, sf)
    out = vo.encode(pairs, vocabulary(spark, sf), ("pair_id",), {"ids": "tgt_tok"})
    return out.select("pair_id", ids_text(F.col("ids")).alias("ids"))


@query(
    "jn5b_encode_decode",
    """SELECT pair_id, array_to_string(list(CASE WHEN v.id IS NULL THEN '<unk>' ELSE w END ORDER BY i), ' ') AS tgt
       FROM (SELECT pair_id, i, tt[i] AS w FROM cp, unnest(range(1, len(tt)+1)) u(i)) c LEFT JOIN vocab v ON v.symbol = c.w
       GROUP BY pair_id""",
    "cp",
    "vocab",
)
def _(spark, sf):
    v = vocabulary(spark, sf)
    ids = vo.encode(inp.clean(spark, sf), v, ("pair_id",), {"ids": "tgt_tok"})
    back = vo.decode(ids, v, ("pair_id",), {"toks": "ids"})
    return back.select("pair_id", tx.join_tokens(F.col("toks")).alias("tgt"))


@query(
    "agg9_encoding_statistics",
    """SELECT c.lang, count(*) AS sentences, sum(len(t))::BIGINT AS tokens,
              round(sum(len(list_filter(t, lambda x: x = 3))) * 100.0::DOUBLE / sum(len(t)), 6) AS unk_percent,
              (SELECT count(*) + 4 FROM vocab) AS symbols
       FROM encv e JOIN cp c USING (pair_id) GROUP BY c.lang""",
    "encv",
    "cp",
    "vocab",
)
def _(spark, sf):
    v = vocabulary(spark, sf)
    ids = vo.encode(inp.clean(spark, sf), v, ("pair_id",), {"ids": "tgt_tok"}, carry=("lang",))
    return vo.encoding_statistics(ids, "ids", by=("lang",)).withColumn("symbols", F.lit(v.count()).cast("bigint"))


@query(
    "agg7_linked_types",
    """SELECT src, tgt, n FROM (SELECT src, tgt, n, row_number() OVER (PARTITION BY src ORDER BY n DESC, tgt) AS r FROM
         (SELECT src, tgt, count(*) AS n FROM lw GROUP BY src, tgt)) WHERE r = 1""",
    "lw",
)
def _(spark, sf):
    words = bl.link_words(linked(spark, sf))
    return vo.most_frequent_target(vo.linked_type_counts(words)).select("src", "tgt", "n")


@query(
    "flt9_unknown_links",
    """SELECT src, tgt, count(*) AS n FROM lw WHERE src IN (SELECT symbol FROM vocab) AND tgt IN (SELECT symbol FROM vocab)
       GROUP BY src, tgt""",
    "lw",
    "vocab",
)
def _(spark, sf):
    # Sentences are encoded, not links: a word of several links is looked up once, and a row is a pair.
    toks = ("src_tok", "tgt_tok")
    ids = {"src_ids": "src_tok", "tgt_ids": "tgt_tok"}
    known = vo.encode(linked(spark, sf), vocabulary(spark, sf), ("pair_id",), ids, carry=(*toks, "links"), add_eos=False)
    named = known.withColumns(
        {w: F.zip_with(w, i, lambda x, n: F.when(n == 3, "<unk>").otherwise(x)) for w, i in zip(toks, ids)}
    )
    named = bl.link_words(named).select("src", "tgt")
    return vo.linked_type_counts(named, F.lit("<unk>"))
