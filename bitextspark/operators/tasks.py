"""Auxiliary-task versions of sentence pairs.

Row-wise tasks are column expressions `fn(src_tok, tgt_tok, key) -> (src, tgt)`
and are produced in one pass over the corpus. Bilingual tasks live in
`operators.bilingual`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextspark.config import (
    BILINGUAL_TASKS,
    DEFAULT_SEED,
    MASK,
    TAG_PREFIX,
    TaskSpec,
)
from bitextspark.functions import sampling as sm
from bitextspark.functions import text as tx
from bitextspark.functions.arrays import let


@dataclass(frozen=True)
class Draw:
    """What a random task needs to name its sample."""

    seed: int
    task: str
    epoch: Column
    pair_id: Column
    alpha: float | None = None

    def keys(self, toks: Column) -> Column:
        return sm.position_keys(toks, self.seed, self.task, self.epoch, self.pair_id)


def reverse(toks: Column) -> Column:
    return F.reverse(toks)


def sort_alpha(toks: Column) -> Column:
    return F.sort_array(toks)


def sort_alpha_desc(toks: Column) -> Column:
    return F.sort_array(toks, asc=False)


def _sort_by(toks: Column, key: Callable[[Column], Column]) -> Column:
    rows = F.transform(toks, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(rows), lambda r: r["x"])


def sort_length(toks: Column) -> Column:
    """Stable, ascending."""
    return _sort_by(toks, F.length)


def sort_length_desc(toks: Column) -> Column:
    """Descending; equal lengths keep their order."""
    return _sort_by(toks, lambda x: -F.length(x))


def shuffle(toks: Column, draw: Draw) -> Column:
    key = lambda i: sm.sample_key(draw.seed, draw.task, draw.epoch, draw.pair_id, i)
    rows = F.transform(toks, lambda x, i: F.struct(key(i).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(rows), lambda r: r["x"])


def mask_words(toks: Column, draw: Draw) -> Column:
    """Exactly floor(n * alpha) distinct positions become the mask symbol."""

    def apply(keys: Column) -> Column:
        last = F.get(F.sort_array(keys), sm.share(F.size(keys), draw.alpha) - 1)
        return let(
            F.struct(keys.alias("k"), last.alias("last")),
            lambda s: F.transform(
                toks, lambda x, i: F.when(F.get(s["k"], i) <= s["last"], F.lit(MASK)).otherwise(x)
            ),
        )

    return let(draw.keys(toks), apply)


def swap_words(toks: Column, draw: Draw) -> Column:
    """Swap hash-ordered positions pairwise until floor(n * alpha) have moved.

    Positions in key order are exchanged 1-2, 3-4, ...; an odd count over an odd
    sentence closes with one more exchange with the first position. Fewer than two
    tokens stay as they are.
    """

    def apply(order: Column) -> Column:
        n = F.size(order)
        want = sm.share(n, draw.alpha)
        moved = F.when(n < 2, 0).otherwise(F.least(n, (want + want % 2).cast("int")))
        odd = moved % 2 == 1

        def partner(r: Column) -> Column:
            pairwise = F.when(r % 2 == 0, r + 1).otherwise(r - 1)
            closed = (
                F.when(odd & (r == 0), moved - 1).when(odd & (r == moved - 1), F.lit(1)).otherwise(pairwise)
            )
            return F.when(r < moved, closed).otherwise(r)

        rows = F.transform(
            order,
            lambda z, r: F.struct(
                z["i"].alias("to"), F.get(toks, F.get(order, partner(r))["i"]).alias("x")
            ),
        )
        return F.transform(F.sort_array(rows), lambda z: z["x"])

    key = lambda i: sm.sample_key(draw.seed, draw.task, draw.epoch, draw.pair_id, i)
    order = F.sort_array(F.transform(toks, lambda _, i: F.struct(key(i).alias("k"), i.alias("i"))))
    return let(order, apply)


# name -> column transform of the target tokens
TARGET_TASKS: dict[str, Callable[[Column, Draw], Column]] = {
    "base": lambda t, d: t,
    "copy": lambda t, d: t,
    "rev": lambda t, d: reverse(t),
    "alpha": lambda t, d: sort_alpha(t),
    "invalpha": lambda t, d: sort_alpha_desc(t),
    "length": lambda t, d: sort_length(t),
    "invlength": lambda t, d: sort_length_desc(t),
    "shuf": shuffle,
    "wrdp": mask_words,
    "wrdp2": mask_words,
    "swap": swap_words,
}


def apply_task(name: str, src_tok: Column, tgt_tok: Column, draw: Draw, remove_mark: bool = False) -> Column:
    """New target tokens of one row-wise task; unknown names raise here."""
    if name == "src":
        without = F.slice(src_tok, F.lit(2), F.greatest(F.size(src_tok) - 1, F.lit(0)))
        return F.when(F.size(src_tok) > 1, without).otherwise(src_tok) if remove_mark else src_tok
    if name not in TARGET_TASKS:
        raise ValueError(f"no row-wise task {name!r}")
    return TARGET_TASKS[name](tgt_tok, draw)


def none_task(pairs: DataFrame) -> DataFrame:
    """The `none` task emits no rows."""
    return pairs.where(F.lit(False))


def add_tasks(
    pairs: DataFrame,
    specs: list[TaskSpec],
    epochs: int = 1,
    seed: int = DEFAULT_SEED,
    remove_mark: bool = False,
    include_base: bool = True,
) -> DataFrame:
    """All row-wise versions of `pairs(pair_id, src_tok, tgt_tok)` in one pass.

    Returns `(pair_id, task, ordinal, epoch, src_tok, tgt_tok)`. Fixed tasks appear
    once, at epoch 1; resampled tasks once per epoch. `ordinal` is 1 for the base
    and 2, 3, ... for the auxiliaries in list order.
    """
    specs = [s for s in specs if s.name != "none"]
    bilingual = [s.name for s in specs if s.name in BILINGUAL_TASKS]
    if bilingual:
        raise ValueError(f"{bilingual} need links or a lexicon: see operators.bilingual")
    if epochs < 1:
        raise ValueError("epochs must be at least 1")
    listed = ([(TaskSpec("base"), 1)] if include_base else []) + [(s, k) for k, s in enumerate(specs, 2)]
    if len({s.name for s, _ in listed}) != len(listed):
        raise ValueError("a task is listed twice")
    versions = [
        F.struct(F.lit(s.name).alias("task"), F.lit(k).alias("ordinal"), F.lit(e).alias("epoch"))
        for s, k in listed
        for e in range(1, (epochs if s.resampled else 1) + 1)
    ]
    rows = pairs.select("pair_id", "src_tok", "tgt_tok", F.explode(F.array(*versions)).alias("v"))
    target = None
    for s, _ in listed:
        draw = Draw(seed, s.name, F.col("v.epoch"), F.col("pair_id"), s.alpha)
        made = apply_task(s.name, F.col("src_tok"), F.col("tgt_tok"), draw, remove_mark)
        cond = F.col("v.task") == s.name
        target = F.when(cond, made) if target is None else target.when(cond, made)
    return rows.select(
        "pair_id", "v.task", "v.ordinal", "v.epoch", "src_tok", target.alias("tgt_tok")
    )


def to_tag(lang: str, ordinal: Column | None = None) -> Column:
    """`TO_<lang>` for the base, `TO_<lang>train<k>` for the k-th version (k >= 2)."""
    base = F.lit(f"{TAG_PREFIX}{lang}")
    if ordinal is None:
        return base
    return F.when(ordinal > 1, F.concat(base, F.lit("train"), ordinal.cast("string"))).otherwise(base)


def tag_sources(df: DataFrame, lang: str, enabled: bool = True) -> DataFrame:
    """Put the task tag in front of `src_tok`; identity when the mixture is off."""
    if not enabled:
        return df
    return df.withColumn("src_tok", F.concat(F.array(to_tag(lang, F.col("ordinal"))), F.col("src_tok")))


def epoch_view(aux: DataFrame, epoch: int, epochs: int, resampled: tuple[str, ...]) -> DataFrame:
    """Rows seen in a training epoch: resampled tasks rotate over 1..epochs, the
    rest always come from epoch 1. Both tests are plain filters on the partition
    columns, so only the wanted directories are read."""
    e = rotate_epoch(epoch, epochs)
    return aux.where(
        (F.col("task").isin(*resampled) & (F.col("epoch") == e))
        | (~F.col("task").isin(*resampled) & (F.col("epoch") == 1))
    )


def rotate_epoch(epoch: int, epochs: int) -> int:
    """1, 2, ..., N, 1, 2, ...; N = 0 means a single unversioned data set."""
    return (epoch - 1) % epochs + 1 if epochs else 1


def union_versions(base: DataFrame, *others: DataFrame) -> DataFrame:
    out = base
    for df in others:
        out = out.unionByName(df)
    return out


def union_origins(genuine: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Genuine and back-translated bitext with an explicit origin column."""
    return genuine.withColumn("origin", F.lit("genuine")).unionByName(
        synthetic.withColumn("origin", F.lit("synthetic"))
    )
