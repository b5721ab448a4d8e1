"""Order, buckets, batches, padding."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitextspark.functions import ids as fi
from bitextspark.operators import batching as ba
from bitextspark.operators import examples as ex
from bitextspark.operators.bilingual import render_links
from bitextspark.registry.base import query, view
from bitextspark.registry.bilingual import linked
from bitextspark.registry.rows import _versions_as_ids, encoded, encoded_sizes, ids_text
from bitextspark.config import TaskSpec

H = "md5(concat_ws('|','17','order',pair_id))"
MAX_TOKENS = 4000


@query(
    "srt1_training_order",
    f"SELECT pair_id, row_number() OVER (ORDER BY len(s), len(t), {H}, pair_id) - 1 AS ord FROM enc",
    "enc",
)
def _(spark, sf):
    return ba.training_order(encoded(spark, sf), "src_ids", "tgt_ids").select("pair_id", "ord")


def _bounds(side):
    return f"""SELECT DISTINCT k, (SELECT min(n) FROM (SELECT len({side}) AS n, count(*) OVER (ORDER BY len({side})) AS c FROM enc)
                 WHERE c * 8 >= k * (SELECT count(*) FROM enc)) AS b FROM range(1, 9) r(k)"""


view("sb", _bounds("s"), "enc")
view("tb", _bounds("t"), "enc")
view(
    "bucketed",
    """SELECT pair_id, s, t, (SELECT min(b) FROM sb WHERE b >= len(s)) AS sb, (SELECT min(b) FROM tb WHERE b >= len(t)) AS tb FROM enc""",
    "enc",
    "sb",
    "tb",
)


@query(
    "arr4_length_buckets",
    "SELECT pair_id, sb::BIGINT AS src_bucket, tb::BIGINT AS tgt_bucket FROM bucketed",
    "bucketed",
)
def _(spark, sf):
    rows = ba.assign_buckets(encoded(spark, sf), "src_ids", "tgt_ids", 8)
    return rows.select("pair_id", F.col("src_bucket").cast("bigint").alias("src_bucket"), F.col("tgt_bucket").cast("bigint").alias("tgt_bucket"))


@query(
    "srt2_bucketed_order",
    f"SELECT pair_id, row_number() OVER (ORDER BY greatest(sb, tb), {H}, pair_id) - 1 AS ord FROM bucketed",
    "bucketed",
)
def _(spark, sf):
    rows = ba.assign_buckets(encoded(spark, sf), "src_ids", "tgt_ids", 8)
    return ba.bucketed_order(rows, "src_bucket", "tgt_bucket").select("pair_id", "ord")


@query("arr5_row_tokens", "SELECT pair_id, greatest(len(s), len(t)) AS n FROM enc", "enc")
def _(spark, sf):
    return encoded(spark, sf).select("pair_id", fi.row_tokens(F.col("src_ids"), F.col("tgt_ids")).cast("bigint").alias("n"))


view(
    "packed",
    f"""SELECT pair_id, s, t, l, l || '-' || (rn // (4000 // l)) AS batch_id, rn % (4000 // l) AS slot FROM (
          SELECT *, row_number() OVER (PARTITION BY l ORDER BY {H}, pair_id) - 1 AS rn FROM (
            SELECT *, greatest(len(s), len(t)) AS l FROM enc))""",
    "enc",
)


def packed(spark, sf):
    rows = encoded(spark, sf)
    return ba.pack(rows, fi.row_tokens(F.col("src_ids"), F.col("tgt_ids")), MAX_TOKENS)[0]


def packed_sizes(spark, sf):
    """Batches of `packed` with sizes in place of ids: `(pair_id, src_size, tgt_size, batch_id, slot)`."""
    return ba.pack(encoded_sizes(spark, sf), F.greatest("src_size", "tgt_size"), MAX_TOKENS)[0]


@query("bat3_token_budget_batches", "SELECT pair_id, batch_id, slot FROM packed", "packed")
def _(spark, sf):
    return packed_sizes(spark, sf).select("pair_id", "batch_id", "slot")


@query(
    "bat3b_over_budget_rows",
    """SELECT part, count(*) AS n FROM (SELECT CASE WHEN greatest(len(s), len(t)) > 40 THEN 'rejected' ELSE 'packed' END AS part FROM enc) GROUP BY part""",
    "enc",
)
def _(spark, sf):
    rows = encoded(spark, sf)
    kept, rejected = ba.pack(rows, fi.row_tokens(F.col("src_ids"), F.col("tgt_ids")), 40)
    parts = kept.select(F.lit("packed").alias("part")).unionByName(rejected.select(F.lit("rejected").alias("part")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg18_batch_totals",
    "SELECT batch_id, count(*) AS nsentences, sum(len(t))::BIGINT AS ntokens FROM packed GROUP BY batch_id",
    "packed",
)
def _(spark, sf):
    return ba.batch_totals(packed_sizes(spark, sf), "src_size", "tgt_size", size=F.col)


@query(
    "bat4_collate",
    """SELECT batch_id, nsentences, ntokens, array_to_string(list(pair_id ORDER BY k, pair_id), ' ') AS ids,
         array_to_string(list(array_to_string(list_resize([]::BIGINT[], ls - len(s), 1) || s, ' ') ORDER BY k, pair_id), '|') AS source,
         array_to_string(list(array_to_string(list_resize(t, lt, 1), ' ') ORDER BY k, pair_id), '|') AS target,
         array_to_string(list(array_to_string(list_resize([2] || t[1:len(t)-1], lt, 1), ' ') ORDER BY k, pair_id), '|') AS prev_output
       FROM (SELECT *, -len(s) AS k, max(len(s)) OVER w AS ls, max(len(t)) OVER w AS lt, count(*) OVER w AS nsentences,
                    (sum(len(t)) OVER w)::BIGINT AS ntokens FROM packed WINDOW w AS (PARTITION BY batch_id))
       GROUP BY batch_id, nsentences, ntokens""",
    "packed",
)
def _(spark, sf):
    rows = ba.collate(packed(spark, sf), "src_ids", "tgt_ids")
    matrix = lambda c: F.array_join(F.transform(c, ids_text), "|").alias(c)
    return rows.select(
        "batch_id", "nsentences", "ntokens", ids_text(F.col("ids")).alias("ids"),
        matrix("source"), matrix("target"), matrix("prev_output"),
    )


@query(
    "bat4b_collate_links",
    """SELECT batch_id, string_agg((l.s + ls - len(p.s)) || '-' || (l.t + i * lt), ' ' ORDER BY i, l.k) AS links FROM
         (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY -len(s), pair_id) - 1 AS i,
                 max(len(s)) OVER (PARTITION BY batch_id) AS ls, max(len(t)) OVER (PARTITION BY batch_id) AS lt FROM packed) p
         JOIN lk l USING (pair_id) GROUP BY batch_id""",
    "packed",
    "lk",
)
def _(spark, sf):
    rows = packed(spark, sf).join(linked(spark, sf).select("pair_id", "links"), "pair_id")
    batches = ba.collate(rows, "src_ids", "tgt_ids", links="links")
    return batches.where(F.size("links") > 0).select("batch_id", render_links(F.col("links")).alias("links"))


@query(
    "bat4c_collate_auxiliaries",
    """SELECT batch_id, task, array_to_string(list(pair_id ORDER BY k, pair_id), ' ') AS ids,
         array_to_string(list(array_to_string(list_resize(x, lt, 1), ' ') ORDER BY k, pair_id), '|') AS target
       FROM (SELECT *, -len(s) AS k, max(len(x)) OVER (PARTITION BY batch_id, task) AS lt FROM (
         SELECT batch_id, pair_id, s, 'base' AS task, t AS x FROM packed
         UNION ALL SELECT batch_id, pair_id, s, 'rev', list_append(list_reverse(t[1:len(t)-1]), 2) FROM packed))
       GROUP BY batch_id, task""",
    "packed",
)
def _(spark, sf):
    placed = packed(spark, sf).select("pair_id", "batch_id", F.size("src_ids").alias("base_len"))
    rows = _versions_as_ids(spark, sf, [TaskSpec("rev")]).join(placed, "pair_id")
    batches = ba.collate(rows, "src_ids", "tgt_ids", by=("task",), order="base_len")
    return batches.select(
        "batch_id", "task", ids_text(F.col("ids")).alias("ids"),
        F.array_join(F.transform("target", ids_text), "|").alias("target"),
    )


@query("win6_strided_split", "SELECT pair_id, batch_id, slot % 3 AS part FROM packed", "packed")
def _(spark, sf):
    return ba.split_batch(packed_sizes(spark, sf), 3).select("pair_id", "batch_id", "part")


@query(
    "srt3_in_batch_order",
    "SELECT batch_id, pair_id, row_number() OVER (PARTITION BY batch_id ORDER BY -len(s), pair_id) - 1 AS pos FROM packed",
    "packed",
)
def _(spark, sf):
    rows = ba.collate(packed(spark, sf), "src_ids", "tgt_ids")
    placed = rows.select("batch_id", F.posexplode("ids").alias("pos", "pair_id"))
    return placed.select("batch_id", "pair_id", F.col("pos").cast("bigint").alias("pos"))


@query(
    "arr1_pad_to_length",
    """SELECT pair_id, array_to_string(list_resize([]::BIGINT[], ((len(s)+7)//8)*8 - len(s), 1) || s, ' ') AS src,
              array_to_string(list_resize(t, ((len(t)+7)//8)*8, 1), ' ') AS tgt FROM enc""",
    "enc",
)
def _(spark, sf):
    s, t = F.col("src_ids"), F.col("tgt_ids")
    return encoded(spark, sf).select(
        "pair_id",
        ids_text(fi.pad_left(s, fi.round_up(F.size(s), 8))).alias("src"),
        ids_text(fi.pad_right(t, fi.round_up(F.size(t), 8))).alias("tgt"),
    )


@query(
    "arr2_decoder_input",
    "SELECT pair_id, array_to_string([2] || t[1:len(t)-1], ' ') AS ids FROM enc",
    "enc",
)
def _(spark, sf):
    return encoded(spark, sf).select("pair_id", ids_text(fi.decoder_input(F.col("tgt_ids"))).alias("ids"))


@query(
    "arr3_constraint_padding",
    """SELECT pair_id, array_to_string(list_resize(list_filter(s, lambda x: x > 8), 
              (max(len(list_filter(s, lambda x: x > 8))) OVER (PARTITION BY batch_id)), 0), ' ') AS constraints FROM packed""",
    "packed",
)
def _(spark, sf):
    # Constraint lists (long words) padded with zeros to the longest of their batch.
    # A batch is bounded by the budget, so its rows meet in one window; they are ranked once and carry no other ids.
    lists = encoded(spark, sf).select(
        "pair_id", F.filter("src_ids", lambda x: x > 8).alias("c"), fi.row_tokens(F.col("src_ids"), F.col("tgt_ids")).alias("n")
    )
    rows = ba.pack(lists, F.col("n"), MAX_TOKENS)[0].select("pair_id", "batch_id", "c")
    longest = F.max(F.size("c")).over(W.partitionBy("batch_id"))
    padded = rows.withColumn("n", longest).withColumn("p", fi.pad_right(F.col("c"), F.col("n"), 0))
    return padded.select("pair_id", ids_text(F.col("p")).alias("constraints"))


@query(
    "arr6_strip_padding",
    "SELECT pair_id, array_to_string(t, ' ') AS tgt FROM enc",
    "enc",
)
def _(spark, sf):
    padded = fi.pad_right(F.col("tgt_ids"), fi.round_up(F.size("tgt_ids"), 16))
    return encoded(spark, sf).withColumn("p", padded).select("pair_id", ids_text(fi.strip_pad(F.col("p"))).alias("tgt"))


@query(
    "jn4_attach_auxiliaries",
    """SELECT pair_id, array_to_string(s,' ') AS src, array_to_string(t,' ') AS tgt,
              'alpha,rev' AS tasks, array_to_string(list_append(list_reverse(t[1:len(t)-1]),2),' ') AS rev_tgt FROM enc""",
    "enc",
)
def _(spark, sf):
    versions = _versions_as_ids(spark, sf, [TaskSpec("rev"), TaskSpec("alpha")])
    records = ex.attach_auxiliaries(versions)
    return records.select(
        "pair_id",
        ids_text(F.col("src_ids")).alias("src"),
        ids_text(F.col("tgt_ids")).alias("tgt"),
        F.array_join(F.sort_array(F.map_keys("aux")), ",").alias("tasks"),
        ids_text(F.col("aux")["rev"]["tgt_ids"]).alias("rev_tgt"),
    )
