"""Sources and sinks: each query writes what Spark derives from the tables to the
scratch folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextspark.config import TaskSpec
from bitextspark.functions import text as tx
from bitextspark.operators import bilingual as bl
from bitextspark.operators import tasks as tk
from bitextspark.operators import vocab as vo
from bitextspark.registry import inputs as inp
from bitextspark.registry.base import query
from bitextspark.registry.bilingual import linked
from bitextspark.registry.rows import encoded, ids_text, vocabulary
from bitextspark.scale import global_rank, scratch_path
from bitextspark.sources import bitext as bt
from bitextspark.sources import tables as tb


def _export(spark, sf, compression="none"):
    paths = []
    for side in ("src", "tgt"):
        path = scratch_path(spark, side)
        bt.write_text(inp.pairs(spark, sf).select("pair_id", side), side, ["pair_id"], path, compression)
        paths.append(path)
    return paths


NUMBERED = "SELECT row_number() OVER (ORDER BY pair_id) AS line_no, src, tgt FROM pairs"


@query("src1_bitext_scan", f"SELECT line_no AS pair_id, '◸ ' || src AS src, tgt FROM ({NUMBERED})", "pairs")
def _(spark, sf):
    return bt.read_bitext(spark, *_export(spark, sf), mark="◸ ")


@query("jn1_positional_zip", NUMBERED, "pairs")
def _(spark, sf):
    sides = [
        global_rank(inp.pairs(spark, sf).select("pair_id", s), ["pair_id"], "rank").select((F.col("rank") + 1).alias("line_no"), s)
        for s in ("src", "tgt")
    ]
    return bt.zip_lines(*sides)


@query("src2_paired_tsv_scan", NUMBERED, "pairs")
def _(spark, sf):
    lines = inp.pairs(spark, sf).select("pair_id", F.concat_ws("\t", "src", "tgt").alias("line"))
    path = scratch_path(spark, "tsv")
    bt.write_text(lines, "line", ["pair_id"], path)
    return bt.read_tsv(spark, path)


@query(
    "src6_sharded_splits",
    """SELECT pair_id, 0::BIGINT AS shard, c::BIGINT AS copy, src, tgt FROM pairs, range(1,4) r(c) WHERE lang = 'en'
       UNION ALL SELECT pair_id, 1, 1, src, tgt FROM pairs WHERE lang = 'fr'
       UNION ALL SELECT pair_id, 2, 1, src, tgt FROM pairs WHERE lang NOT IN ('en','fr')""",
    "pairs",
)
def _(spark, sf):
    # The second shard is stored the other way round; a shard after the first gap is not read.
    root = scratch_path(spark, "shards")
    pairs = inp.pairs(spark, sf)
    for name, part in (
        ("train.en-fr", "lang = 'en'"), ("train1.fr-en", "lang = 'fr'"), ("train2.en-fr", "lang not in ('en', 'fr')"), ("train4.en-fr", "true"),
    ):
        sides = ("src", "tgt") if name.endswith("en-fr") else ("tgt", "src")
        rows = pairs.where(part).select("pair_id", *[F.col(s).alias(code) for s, code in zip(sides, name.split(".")[1].split("-"))])
        rows.write.parquet(f"{root}/{name}")
    return bt.read_split(spark, root, "train", "en", "fr", upsample_primary=3).select(
        "pair_id", F.col("shard").cast("bigint").alias("shard"), F.col("copy").cast("bigint").alias("copy"),
        F.col("en").alias("src"), F.col("fr").alias("tgt"),
    )


def _write_versions(spark, sf, specs, epochs):
    versions = tk.add_tasks(inp.clean(spark, sf), specs, epochs=epochs)
    arrays = {"src_ids": "src_tok", "tgt_ids": "tgt_tok"}
    rows = vo.encode(versions, vocabulary(spark, sf), ("pair_id", "epoch", "task"), arrays).withColumn("split", F.lit("train"))
    path = scratch_path(spark, "encoded")
    tb.write_encoded(rows, path)
    return path


@query(
    "src7_auxiliary_discovery",
    "SELECT task, (SELECT count(*) FROM cp) AS n FROM (VALUES ('rev'), ('alpha'), ('src')) v(task)",
    "cp",
)
def _(spark, sf):
    path = _write_versions(spark, sf, [TaskSpec("rev"), TaskSpec("alpha"), TaskSpec("src")], 1)
    tasks = tb.list_auxiliaries(spark, path)
    counts = tb.read_encoded(spark, path).groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(tasks, "task", "left_semi")


@query(
    "src8_epoch_scan",
    """SELECT pair_id, 'shuf' AS task, array_to_string(list_append(list(id ORDER BY k), 2), ' ') AS ids FROM (
         SELECT pair_id, t[i] AS id, md5(concat_ws('|','17','shuf',2,pair_id,i-1)) AS k FROM enc, unnest(range(1, len(t))) u(i)) GROUP BY pair_id
       UNION ALL SELECT pair_id, 'base', array_to_string(t, ' ') FROM enc
       UNION ALL SELECT pair_id, 'rev', array_to_string(list_append(list_reverse(t[1:len(t)-1]), 2), ' ') FROM enc""",
    "enc",
)
def _(spark, sf):
    # Training epoch 4 of 2 precomputed epochs: resampled tasks from epoch=2, the others from epoch=1.
    path = _write_versions(spark, sf, [TaskSpec("shuf", resample=True), TaskSpec("rev")], 2)
    return tb.read_epoch(spark, path, 4, 2, ("shuf",)).select("pair_id", "task", ids_text(F.col("tgt_ids")).alias("ids"))


@query(
    "src9_compressed_text",
    "SELECT line_no AS pair_id, md5(src) AS src, md5(tgt) AS tgt FROM (" + NUMBERED + ")",
    "pairs",
)
def _(spark, sf):
    rows = bt.read_bitext(spark, *_export(spark, sf, "gzip"))
    return rows.select("pair_id", F.md5("src").alias("src"), F.md5("tgt").alias("tgt"))


@query(
    "src10_generation_log",
    """SELECT conv_id * 4294967296 + turn AS id, regexp_replace(text, '[\\n\\t]', ' ', 'g') AS hyp FROM conversations WHERE role = 'assistant'""",
)
def _(spark, sf):
    # Assistant turns are hypotheses; user turns are the S- and P- noise around them.
    flat = F.regexp_replace("text", "[\n\t]", " ")
    ident = (F.col("conv_id") * (1 << 32) + F.col("turn")).cast("string")
    kind = F.when(F.col("role") == "assistant", "H-").when(F.col("turn") % 4 == 0, "S-").otherwise("P-")
    log = inp.table(spark, sf, "conversations").select(F.concat_ws("\t", F.concat(kind, ident), F.lit("-0.5"), flat).alias("value"))
    return tb.extract_hypotheses(log)


@query(
    "src11_encoded_sink",
    """SELECT pair_id, task, array_to_string(CASE task WHEN 'base' THEN t ELSE list_append(list_reverse(t[1:len(t)-1]), 2) END, ' ') AS ids
       FROM enc, (VALUES ('base'), ('rev')) v(task)""",
    "enc",
)
def _(spark, sf):
    path = _write_versions(spark, sf, [TaskSpec("rev")], 1)
    return tb.read_encoded(spark, path).where("split = 'train'").select("pair_id", "task", ids_text(F.col("tgt_ids")).alias("ids"))


@query(
    "src12_alignment_sink",
    "SELECT pair_id, string_agg(s || '-' || t, ' ' ORDER BY k) AS links FROM lk GROUP BY pair_id",
    "lk",
)
def _(spark, sf):
    path = scratch_path(spark, "aligned")
    rows = linked(spark, sf).select("pair_id", "links", F.lit("train").alias("split"))
    tb.write_encoded(rows, path, partition=("split",))
    return tb.read_encoded(spark, path).where(F.size("links") > 0).select("pair_id", bl.render_links(F.col("links")).alias("links"))


@query(
    "src13_metric_sink",
    """SELECT event_type AS tag, event_id AS step, value FROM events UNION ALL
       SELECT 'mean/' || event_type, max(event_id), round(avg(value), 6) FROM events GROUP BY event_type""",
)
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    log = inp.table(spark, sf, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value")
    tb.append_metrics(log, path)
    means = log.groupBy("tag").agg(F.max("step").alias("step"), F.round(F.avg("value"), 6).alias("value"))
    tb.append_metrics(means.withColumn("tag", F.concat(F.lit("mean/"), F.col("tag"))), path)
    return tb.read_metrics(spark, path)


@query(
    "src14_text_sink",
    "SELECT row_number() OVER (ORDER BY pair_id) AS line_no, array_to_string(list_reverse(tt), ' ') AS line FROM cp",
    "cp",
)
def _(spark, sf):
    rows = tk.add_tasks(inp.clean(spark, sf), [TaskSpec("rev")], include_base=False)
    path = scratch_path(spark, "text")
    bt.write_text(rows.select("pair_id", tx.join_tokens(F.col("tgt_tok")).alias("line")), "line", ["pair_id"], path)
    return bt.read_numbered_lines(spark, path, "line")


@query(
    "src15_stage_skip",
    "SELECT pair_id, array_to_string(s, ' ') AS ids FROM enc",
    "enc",
)
def _(spark, sf):
    root = scratch_path(spark, "stages")
    first = tb.run_stage(spark, root, "encode", {"sf": sf}, lambda: encoded(spark, sf).select("pair_id", "src_ids"))

    def rebuilt():
        raise RuntimeError("a finished stage must not be built again")

    again = tb.run_stage(spark, root, "encode", {"sf": sf}, rebuilt)
    return again.select(*first.columns).select("pair_id", ids_text(F.col("src_ids")).alias("ids"))
