"""Training examples and batches of a marked, tagged corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextspark.config import GENUINE_MARK, SYNTHETIC_MARK, TaskSpec
from bitextspark.functions import ids as fi
from bitextspark.operators import tasks as tk
from bitextspark.operators import vocab as vo
from bitextspark.plans.examples import ExampleConfig, TrainingExamples
from bitextspark.registry import inputs as inp
from bitextspark.registry.base import query, view
from bitextspark.registry.rows import MASKED, _stage, ids_text

SPECS = [TaskSpec("rev"), TaskSpec("wrdp2", 0.3)]
CONFIG = ExampleConfig(("rev", "wrdp2"), epochs=2, max_source=60, max_target=60, max_tokens=2000, multiple=8, marked=True)
EPOCH = 4

# Pairs of two languages count as genuine, the others as synthetic. Sources are tag, mark, words.
view("xs", f"SELECT pair_id, CASE WHEN lang IN ('en', 'fr') THEN '{GENUINE_MARK}' ELSE '{SYNTHETIC_MARK}' END AS mark, st, tt FROM cp", "cp")
view(
    "xv",
    f"""SELECT pair_id, task, e, ['TO_fr' || tag, mark] || st AS s, t FROM xs JOIN (
          SELECT pair_id, 'base' AS task, '' AS tag, 1 AS e, tt AS t FROM xs
          UNION ALL SELECT pair_id, 'rev', 'train2', 1, list_reverse(tt) FROM xs
          UNION ALL SELECT pair_id, 'wrdp2', 'train3', 1, m FROM {MASKED.format(task='wrdp2', epoch=1, alpha=0.3)}
          UNION ALL SELECT pair_id, 'wrdp2', 'train3', 2, m FROM {MASKED.format(task='wrdp2', epoch=2, alpha=0.3)}) USING (pair_id)""",
    "xs",
    "cp",
)
view(
    "xt",
    """SELECT pair_id, task, e, side, i, z[i] AS symbol FROM (SELECT pair_id, task, e, 's' AS side, s AS z FROM xv UNION ALL SELECT pair_id, task, e, 't', t FROM xv),
         unnest(range(1, len(z)+1)) u(i)""",
    "xv",
)
view("xvocab", "SELECT symbol, row_number() OVER (ORDER BY count(*) DESC, symbol) + 3 AS id FROM xt WHERE e = 1 GROUP BY symbol", "xt")
view(
    "xe",
    """SELECT pair_id, task, e, list_append(list(id ORDER BY i) FILTER (side = 's'), 2) AS s, list_append(list(id ORDER BY i) FILTER (side = 't'), 2) AS t
       FROM (SELECT xt.*, coalesce(v.id, 3) AS id FROM xt LEFT JOIN xvocab v USING (symbol)) GROUP BY pair_id, task, e""",
    "xt",
    "xvocab",
)
view(
    "xx",
    f"""SELECT pair_id, task, s[1:1] || s[3:] AS s, CASE WHEN task <> 'base' AND s[2] = mark THEN list_transform(label, lambda x: 1::BIGINT) ELSE label END AS t,
          [2] || fed[1:len(fed)-1] AS p, CASE WHEN task <> 'base' AND s[2] = mark THEN 0 ELSE len(label) END AS n
        FROM (SELECT x.pair_id, x.task, x.s, CASE WHEN x.task = 'wrdp2' THEN b.t ELSE x.t END AS label, x.t AS fed
              FROM xe x JOIN xe b ON b.pair_id = x.pair_id AND b.task = 'base'
              WHERE x.e = CASE WHEN x.task = 'wrdp2' THEN 2 ELSE 1 END AND len(b.s) <= 60 AND len(b.t) <= 60),
             (SELECT max(id) FILTER (symbol = '{SYNTHETIC_MARK}') AS mark FROM xvocab)""",
    "xe",
    "xvocab",
)


def _versions(spark, sf):
    mark = F.when(F.col("lang").isin("en", "fr"), GENUINE_MARK).otherwise(SYNTHETIC_MARK)
    pairs = inp.clean(spark, sf).withColumn("src_tok", F.concat(F.array(mark), F.col("src_tok")))
    return tk.tag_sources(tk.add_tasks(pairs, SPECS, epochs=2), "fr")


def training_examples(spark, sf):
    """Vocabulary and encoded versions are stages that the three queries share."""
    counts = lambda: vo.token_counts(_versions(spark, sf).where("epoch = 1"), "src_tok", "tgt_tok")
    vocabulary = _stage(spark, sf, "example-vocabulary", lambda: vo.build_vocabulary(counts()))
    arrays = {"src_ids": "src_tok", "tgt_ids": "tgt_tok"}
    versions = _stage(
        spark, sf, "example-versions", lambda: vo.encode(_versions(spark, sf), vocabulary, ("pair_id", "task", "epoch"), arrays)
    )
    return TrainingExamples(versions, vocabulary, CONFIG)


@query(
    "prj8_drop_mark_column",
    "SELECT pair_id, array_to_string(s[1:1] || s[3:], ' ') AS ids, len(s) - 1 AS n FROM xe WHERE task = 'base'",
    "xe",
)
def _(spark, sf):
    base = training_examples(spark, sf).versions.where("task = 'base'").withColumn("cut", fi.drop_second(F.col("src_ids")))
    return base.select("pair_id", ids_text(F.col("cut")).alias("ids"), F.size("cut").cast("bigint").alias("n"))


@query(
    "flt10_synthetic_row_mask",
    f"""SELECT pair_id, task, e::BIGINT AS epoch, array_to_string(CASE WHEN hit THEN list_transform(t, lambda x: 1) ELSE t END, ' ') AS tgt_ids,
          CASE WHEN hit THEN 0 ELSE len(t) END AS ntokens
        FROM (SELECT *, task <> 'base' AND s[2] = (SELECT id FROM xvocab WHERE symbol = '{SYNTHETIC_MARK}') AS hit FROM xe)""",
    "xe",
    "xvocab",
)
def _(spark, sf):
    made = training_examples(spark, sf)
    masked = fi.mask_synthetic(F.col("src_ids"), F.col("tgt_ids"), F.col("task"), made.symbol_id(SYNTHETIC_MARK))
    rows = made.versions.withColumn("masked", masked)
    return rows.select(
        "pair_id", "task", F.col("epoch").cast("bigint").alias("epoch"), ids_text(F.col("masked")).alias("tgt_ids"),
        fi.count_non_pad(F.col("masked")).cast("bigint").alias("ntokens"),
    )


@query(
    "ex1_training_examples",
    """SELECT pair_id, task, array_to_string(s, ' ') AS src_ids, array_to_string(t, ' ') AS tgt_ids, array_to_string(p, ' ') AS prev_ids,
         n::BIGINT AS ntokens FROM xx""",
    "xx",
)
def _(spark, sf):
    rows = training_examples(spark, sf).examples(EPOCH)
    return rows.select(
        "pair_id", "task", *[ids_text(F.col(c)).alias(c) for c in ("src_ids", "tgt_ids", "prev_ids")], F.col("ntokens").cast("bigint").alias("ntokens")
    )


@query(
    "ex2_training_batches",
    """SELECT batch_id, task, nsentences, ntokens, array_to_string(list(pair_id ORDER BY k, pair_id), ' ') AS ids,
         array_to_string(list(array_to_string(list_resize([]::BIGINT[], ls - len(s), 1) || s, ' ') ORDER BY k, pair_id), '|') AS source,
         array_to_string(list(array_to_string(list_resize(t, lt, 1), ' ') ORDER BY k, pair_id), '|') AS target,
         array_to_string(list(array_to_string(list_resize(p, lt, 1), ' ') ORDER BY k, pair_id), '|') AS prev_output
       FROM (SELECT *, ((max(len(s)) OVER w + 7) // 8) * 8 AS ls, ((max(len(t)) OVER w + 7) // 8) * 8 AS lt, count(*) OVER w AS nsentences,
                    (sum(n) OVER w)::BIGINT AS ntokens
             FROM xx JOIN (SELECT pair_id, -len(s) AS k, l || '-' || (row_number() OVER (PARTITION BY l ORDER BY md5(concat_ws('|','17','order',pair_id)), pair_id) - 1) // (2000 // l) AS batch_id
                           FROM (SELECT *, ((greatest(len(s), len(t)) + 7) // 8) * 8 AS l FROM xx WHERE task = 'base')) USING (pair_id)
             WINDOW w AS (PARTITION BY batch_id, task))
       GROUP BY batch_id, task, nsentences, ntokens""",
    "xx",
)
def _(spark, sf):
    batches, _ = training_examples(spark, sf).batches(EPOCH)
    matrix = lambda c: F.array_join(F.transform(c, ids_text), "|").alias(c)
    return batches.select("batch_id", "task", "nsentences", "ntokens", ids_text(F.col("ids")).alias("ids"), *map(matrix, ("source", "target", "prev_output")))
