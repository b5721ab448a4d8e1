"""Auxiliary tasks, the task mixture and epoch views."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextspark.config import RESAMPLED_TASKS, TaskSpec
from bitextspark.functions import text as tx
from bitextspark.operators import mixture as mx
from bitextspark.operators import tasks as tk
from bitextspark.operators.subword import segment_text
from bitextspark.plans.corpus import CorpusBuild, CorpusConfig, task_statistics
from bitextspark.registry import inputs as inp
from bitextspark.registry.base import query, view
from bitextspark.registry.rows import MASKED
from bitextspark.scale import scratch_path


def one_task(spark, sf, name, alpha=None):
    specs = [TaskSpec(name, alpha)]
    versions = tk.add_tasks(inp.clean(spark, sf), specs, include_base=False)
    return versions.select("pair_id", tx.join_tokens(F.col("tgt_tok")).alias("tgt"))


def _fixed(name, op, expr):
    @query(f"{op}_{name}", f"SELECT pair_id, array_to_string({expr}, ' ') AS tgt FROM cp", "cp")
    def _(spark, sf, name=name):
        return one_task(spark, sf, name)


BY_LENGTH = "list_transform(list_sort(list_transform(tt, lambda x, i: {{'k': {sign}len(x), 'i': i, 'x': x}})), lambda r: r.x)"
_fixed("rev", "aux1", "list_reverse(tt)")
_fixed("copy", "aux2", "tt")
_fixed("alpha", "aux3", "list_sort(tt)")
_fixed("invalpha", "aux4", "list_reverse_sort(tt)")
_fixed("length", "aux5", BY_LENGTH.format(sign=""))
_fixed("invlength", "aux6", BY_LENGTH.format(sign="-"))
_fixed("src", "aux7", "st")


@query("aux7b_src_without_mark", "SELECT pair_id, regexp_replace(src, '^[^ ]* ', '') AS tgt FROM cp", "cp")
def _(spark, sf):
    versions = tk.add_tasks(inp.clean(spark, sf), [TaskSpec("src")], remove_mark=True, include_base=False)
    return versions.select("pair_id", tx.join_tokens(F.col("tgt_tok")).alias("tgt"))


def sql_key(task, epoch, pos):
    return f"md5(concat_ws('|','17','{task}',{epoch},pair_id,{pos}))"


SHUFFLED = (
    "list_transform(list_sort(list_transform(tt, lambda x, i: {{'k': {key}, 'i': i, 'x': x}})), lambda r: r.x)"
)


@query(
    "aux8_shuffle",
    f"SELECT pair_id, array_to_string({SHUFFLED.format(key=sql_key('shuf', 1, 'i-1'))}, ' ') AS tgt FROM cp",
    "cp",
)
def _(spark, sf):
    return one_task(spark, sf, "shuf")


@query(
    "aux9_word_dropout",
    f"SELECT pair_id, array_to_string(m, ' ') AS tgt FROM {MASKED.format(task='wrdp', epoch=1, alpha=0.3)}",
    "cp",
)
def _(spark, sf):
    return one_task(spark, sf, "wrdp", 0.3)


# Pairs whose target is segmented (200 merges).
view(
    "units",
    """SELECT cp.pair_id, st, u.tt FROM cp JOIN (SELECT pair_id, string_split(string_agg(units, ' ' ORDER BY i), ' ') AS tt FROM
         (SELECT pair_id, i, tt[i] AS word FROM cp, unnest(range(1, len(tt)+1)) u(i)) JOIN seg USING (word) GROUP BY pair_id) u ON u.pair_id = cp.pair_id""",
    "cp",
    "seg",
)


@query(
    "aux10_subword_dropout",
    f"SELECT pair_id, array_to_string(m, ' ') AS tgt FROM {MASKED.format(task='wrdp2', epoch=1, alpha=0.5).replace('FROM cp', 'FROM units')}",
    "units",
)
def _(spark, sf):
    from bitextspark.registry.iterative import merges

    units = inp.clean(spark, sf).select("pair_id", "src_tok", segment_text(F.col("tgt"), merges(spark, sf)).alias("units"))
    made = tk.add_tasks(units.withColumn("tgt_tok", F.split("units", " ")), [TaskSpec("wrdp2", 0.5)], include_base=False)
    return made.select("pair_id", tx.join_tokens(F.col("tgt_tok")).alias("tgt"))


SWAPPED = f"""
  ranked AS (SELECT pair_id, i, tt[i] AS x, len(tt) AS n,
                    row_number() OVER (PARTITION BY pair_id ORDER BY {sql_key('swap', 1, 'i-1')}) AS r
             FROM cp, unnest(range(1, len(tt)+1)) u(i)),
  sized AS (SELECT *, least(n, floor(n*0.5::DOUBLE)::INT + floor(n*0.5::DOUBLE)::INT % 2) AS m FROM ranked),
  target AS (SELECT *, CASE WHEN r > m THEN r WHEN m % 2 = 1 AND r = 1 THEN m WHEN m % 2 = 1 AND r = m THEN 2
                       WHEN r % 2 = 1 THEN r + 1 ELSE r - 1 END AS from_r FROM sized)
"""


@query(
    "aux11_swap",
    f"""SELECT pair_id, array_to_string(x, ' ') AS tgt FROM (WITH {SWAPPED}
         SELECT a.pair_id, list(b.x ORDER BY a.i) AS x FROM target a JOIN target b
           ON a.pair_id = b.pair_id AND a.from_r = b.r GROUP BY a.pair_id)""",
    "cp",
)
def _(spark, sf):
    return one_task(spark, sf, "swap", 0.5)


TWO_EPOCHS = f"""
  SELECT pair_id, 'base' AS task, 1::BIGINT AS epoch, tt AS t FROM cp
  UNION ALL SELECT pair_id, 'rev', 1, list_reverse(tt) FROM cp
  UNION ALL SELECT pair_id, 'wrdp', e, m FROM (SELECT 1 AS e, * FROM {MASKED.format(task='wrdp', epoch=1, alpha=0.3)}
     UNION ALL SELECT 2, * FROM {MASKED.format(task='wrdp', epoch=2, alpha=0.3)})
  UNION ALL SELECT pair_id, 'shuf', e, m FROM (
     SELECT 1 AS e, pair_id, {SHUFFLED.format(key=sql_key('shuf', 1, 'i-1'))} AS m FROM cp
     UNION ALL SELECT 2, pair_id, {SHUFFLED.format(key=sql_key('shuf', 2, 'i-1'))} FROM cp)
"""
SPECS = [TaskSpec("rev"), TaskSpec("wrdp", 0.3), TaskSpec("shuf", resample=True)]


@query(
    "aux16_multi_task",
    f"SELECT pair_id, task, epoch, array_to_string(t, ' ') AS tgt FROM ({TWO_EPOCHS})",
    "cp",
)
def _(spark, sf):
    versions = tk.add_tasks(inp.clean(spark, sf), SPECS, epochs=2)
    return versions.select(
        "pair_id", "task", F.col("epoch").cast("bigint").alias("epoch"), tx.join_tokens(F.col("tgt_tok")).alias("tgt")
    )


@query(
    "mix2_epoch_view",
    f"""SELECT pair_id, task, array_to_string(t, ' ') AS tgt FROM ({TWO_EPOCHS})
        WHERE epoch = CASE WHEN task = 'wrdp' THEN 2 ELSE 1 END""",
    "cp",
)
def _(spark, sf):
    # Training epoch 4 over two precomputed epochs reads epoch 2 of the resampled tasks; by
    # the schedule these do not include `shuf`.
    versions = tk.add_tasks(inp.clean(spark, sf), SPECS, epochs=2)
    seen = tk.epoch_view(versions, 4, 2, RESAMPLED_TASKS)
    return seen.select("pair_id", "task", tx.join_tokens(F.col("tgt_tok")).alias("tgt"))


@query(
    "m0_task_statistics",
    f"""SELECT task, side, count(DISTINCT pair_id) AS pairs, count(*) AS tokens, count(DISTINCT w) AS distinct_tokens FROM (
         SELECT pair_id, task, 'src' AS side, unnest(['TO_fr' || tag] || st) AS w
           FROM cp, (VALUES ('base',''),('src','train2'),('rev','train3'),('alpha','train4'),('length','train5')) v(task, tag)
         UNION ALL SELECT pair_id, 'base', 'tgt', unnest(tt) FROM cp
         UNION ALL SELECT pair_id, 'src', 'tgt', unnest(st) FROM cp
         UNION ALL SELECT pair_id, 'rev', 'tgt', unnest(list_reverse(tt)) FROM cp
         UNION ALL SELECT pair_id, 'alpha', 'tgt', unnest(list_sort(tt)) FROM cp
         UNION ALL SELECT pair_id, 'length', 'tgt', unnest({BY_LENGTH.format(sign='')}) FROM cp)
        GROUP BY task, side""",
    "cp",
)
def _(spark, sf):
    specs = [TaskSpec(n) for n in ("src", "rev", "alpha", "length")]
    versions = tk.tag_sources(tk.add_tasks(inp.clean(spark, sf), specs), "fr")
    return task_statistics(versions, ["base", *[s.name for s in specs]])


# --- mixture weights ------------------------------------------------------

LOSSES = "SELECT event_id AS update, event_type AS task, value AS loss, 1 + event_id % 7 AS size FROM events"


def losses(spark, sf):
    return inp.table(spark, sf, "events").select(
        F.col("event_id").alias("update"),
        F.col("event_type").alias("task"),
        F.col("value").alias("loss"),
        (1 + F.col("event_id") % 7).alias("size"),
    )


@query(
    "mix1_task_weights",
    f"""SELECT task, count(*) AS updates, round(sum(loss * CASE WHEN task = 'view' THEN 0.5::DOUBLE ELSE 0.125::DOUBLE END), 6) AS weighted,
               round(sum(loss * 0.2::DOUBLE), 6) AS uniform FROM ({LOSSES}) GROUP BY task""",
)
def _(spark, sf):
    names = ["view", "click", "error", "purchase", "signup"]
    w = mx.task_weights(spark, names, base_weight=0.5)
    u = mx.task_weights(spark, names).withColumnRenamed("weight", "uniform_weight")
    log = losses(spark, sf).join(F.broadcast(w), "task").join(F.broadcast(u), "task")
    return log.groupBy("task").agg(
        F.count(F.lit(1)).alias("updates"),
        F.round(F.sum(F.col("loss") * F.col("weight")), 6).alias("weighted"),
        F.round(F.sum(F.col("loss") * F.col("uniform_weight")), 6).alias("uniform"),
    )


@query(
    "mix3_draw_task",
    f"""SELECT b.update, w.task AS drawn FROM (
          SELECT update, ('0x' || substr(md5(concat_ws('|','17','draw',update)),1,8))::BIGINT / 4294967296.0::DOUBLE AS u FROM ({LOSSES})) b
        JOIN (VALUES ('base', 0.0::DOUBLE, 0.5::DOUBLE), ('rev', 0.5, 0.75), ('wrdp', 0.75, 1.0)) w(task, lo, hi)
          ON b.u >= w.lo AND b.u < w.hi""",
)
def _(spark, sf):
    weights = mx.normalised_weights(["base", "rev", "wrdp"], base_weight=0.5)
    return losses(spark, sf).select("update", mx.draw_task(F.col("update"), weights).alias("drawn"))


@query(
    "agg19_mixture_loss",
    f"""SELECT user_id AS update, round(sum(loss*w*5), 6) AS loss, sum(size)::BIGINT AS sample_size, sum(CASE WHEN task='view' THEN size ELSE 0 END)::BIGINT AS base_size
        FROM (SELECT user_id, value AS loss, 1 + event_id % 7 AS size, event_type AS task,
                     CASE WHEN event_type = 'view' THEN 0.5::DOUBLE ELSE 0.125::DOUBLE END AS w FROM events) GROUP BY user_id""",
)
def _(spark, sf):
    log = inp.table(spark, sf, "events").select(
        F.col("user_id").alias("update"), F.col("event_type").alias("task"), F.col("value").alias("loss"), (1 + F.col("event_id") % 7).alias("size")
    )
    weights = mx.normalised_weights(["view", "click", "error", "purchase", "signup"], base_weight=0.5)
    return mx.mixture_loss(log, weights, base_task="view", assume_reduced=True)


@query("agg20_merge_partial_logs", f"SELECT task, count(*) AS parts, round(sum(loss), 6) AS loss, sum(size)::BIGINT AS size FROM ({LOSSES}) GROUP BY task")
def _(spark, sf):
    return mx.merge_logs(losses(spark, sf), ["task"], {"loss": "double", "size": "bigint"})


@query("agg23_loss_per_size", f"SELECT task, round(sum(loss)/sum(size), 6) AS loss_per_unit FROM ({LOSSES}) GROUP BY task")
def _(spark, sf):
    return mx.loss_per_size(losses(spark, sf), ["task"])


@query("corpus_build_bilingual")
def _(spark, sf):
    """Every stage from raw pairs to encoded versions; counts per task and epoch."""
    specs = (TaskSpec("rev"), TaskSpec("wrdp", 0.3), TaskSpec("replace", 0.3), TaskSpec("mono"))
    cfg = CorpusConfig("en", "fr", specs, epochs=2, n_merges=30)
    build = CorpusBuild(spark, inp.pairs(spark, sf).select("pair_id", "src", "tgt"), cfg, scratch_path(spark, "build"))
    ids = build.encoded()
    return ids.groupBy("task", "epoch").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum(F.size("src_ids").cast("bigint")).alias("src_tokens"),
        F.sum(F.size("tgt_ids").cast("bigint")).alias("tgt_tokens"),
    )
