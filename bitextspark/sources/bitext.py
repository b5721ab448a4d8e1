"""Line-aligned text files: numbered scans, pairing, ordered export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitextspark.functions import text as tx
from bitextspark.scale import broadcast_if_small, materialise, scratch_path


def read_numbered_lines(spark: SparkSession, path: str | Sequence[str], name: str = "value") -> DataFrame:
    """`(line_no, <name>)` of text files, 1-based over all files: paths in the given order,
    files of a folder by name.

    The lines are copied once to the scratch folder, each with its file, the block it was
    read from and its place in the task. Offsets and rows both come from that copy, so it
    does not matter whether a later scan would be cut at other borders. One offset per
    block is needed: a count per block and a running sum over blocks (some 10^6 rows for
    100 TB). Blank lines count; compressed files are one block each.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw: DataFrame | None = None
    for k, one in enumerate(paths):
        lines = spark.read.text(one).select(
            F.col("value").alias(name),
            F.lit(k).alias("__path"),
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__block"),
        )
        raw = lines if raw is None else raw.unionByName(lines)
    copy = scratch_path(spark, "lines")
    raw.withColumn("__row", F.monotonically_increasing_id()).write.parquet(copy)
    kept = spark.read.parquet(copy)
    before = W.orderBy("__path", "__file", "__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = materialise(
        kept.groupBy("__path", "__file", "__block")
        .agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .select("__path", "__file", "__block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    return kept.join(broadcast_if_small(blocks, ["__file"]), ["__path", "__file", "__block"]).select(
        (F.col("__before") + F.col("__row") - F.col("__first") + 1).alias("line_no"), name
    )


def read_bitext(spark: SparkSession, src_path: str, tgt_path: str, mark: str = "", check: bool = True) -> DataFrame:
    """Two parallel text files -> `(pair_id, src, tgt)`, paired by line number.

    A missing file raises when the scan is planned; unequal line counts raise here
    unless `check` is off.
    """
    src = read_numbered_lines(spark, src_path, "src")
    tgt = read_numbered_lines(spark, tgt_path, "tgt")
    if check:
        n_src, n_tgt = src.count(), tgt.count()
        if n_src != n_tgt:
            raise ValueError(f"sides differ: {n_src} and {n_tgt} lines")
    return zip_lines(src, tgt).select(
        F.col("line_no").alias("pair_id"), tx.prepend(F.col("src"), mark).alias("src") if mark else F.col("src"), "tgt"
    )


def zip_lines(left: DataFrame, right: DataFrame, key: str = "line_no") -> DataFrame:
    """Positional zip as an equi join on the line key."""
    return left.join(right, key)


def parse_tsv(lines: DataFrame, col: str = "value") -> DataFrame:
    """Split a tab-separated line column into `src`, `tgt`."""
    keep = [c for c in lines.columns if c != col]
    return lines.select(*keep, tx.tab_field(F.col(col), 0).alias("src"), tx.tab_field(F.col(col), 1).alias("tgt"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return parse_tsv(read_numbered_lines(spark, path))


def write_text(df: DataFrame, line: str, order: Sequence[str], path: str, compression: str = "none") -> None:
    """One line per row in `order`: range-partitioned part files whose names sort in
    corpus order, so no single task sees the whole corpus."""
    df.orderBy(*order).select(F.col(line).alias("value")).write.mode("overwrite").option(
        "compression", compression
    ).text(path)


def read_shards(spark: SparkSession, shards: Sequence[DataFrame], upsample_primary: int = 1) -> DataFrame:
    """Concatenate shards; rows of the first one are repeated `upsample_primary` times."""
    if upsample_primary < 1:
        raise ValueError("upsample_primary must be at least 1")
    out = None
    for k, shard in enumerate(shards):
        copies = upsample_primary if k == 0 else 1
        rows = shard.withColumns(
            {"shard": F.lit(k), "copy": F.explode(F.sequence(F.lit(1), F.lit(copies)))}
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def existing_shards(spark: SparkSession, root: str, split: str, src: str, tgt: str) -> list[str]:
    """Paths of `<split>`, `<split>1`, ... below `root` until one is missing; each shard
    is a `<src>-<tgt>` or `<tgt>-<src>` folder."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: list[str] = []
    while True:
        name = f"{split}{len(found) or ''}"
        options = [f"{root}/{name}.{a}-{b}" for a, b in ((src, tgt), (tgt, src))]
        hit = [p for p in options if _exists(jvm, conf, p)]
        if not hit:
            return found
        found.append(hit[0])


def read_split(
    spark: SparkSession, root: str, split: str, src: str, tgt: str, upsample_primary: int = 1, combine: bool = True
) -> DataFrame:
    """All shards of a split, found by path: `<split>`, `<split>1`, ... until one is missing.

    A shard is a Parquet folder in either direction; its name gives the direction, and its columns are
    named by language, so the result has one order of sides. `shard` is the place in the order of
    discovery; rows of the first shard come `upsample_primary` times (`copy`). Without
    `combine` only the first shard is read. No shard at all is an error.
    """
    found = existing_shards(spark, root, split, src, tgt)
    if not found:
        raise FileNotFoundError(f"no {split} of {src}-{tgt} below {root}")
    shards = [spark.read.parquet(path) for path in (found if combine else found[:1])]
    for path, shard in zip(found, shards):
        if not {src, tgt} <= set(shard.columns):
            raise ValueError(f"{path} has no columns {src} and {tgt}")
    return read_shards(spark, shards, upsample_primary)


def _exists(jvm, conf, path: str) -> bool:
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a (possibly remote) path exists."""
    return _exists(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
