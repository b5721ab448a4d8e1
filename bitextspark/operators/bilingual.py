"""Operators that need word links or a lexicon: lexical tables, best translations,
bilingual replacement, target replacement and monotone reordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextspark.config import DEFAULT_SEED, NULL_WORD, SENTENCE_BREAK
from bitextspark.functions import sampling as sm
from bitextspark.functions import text as tx
from bitextspark.functions.arrays import let
from bitextspark.scale import LOOKUP_BYTES, global_rank, lookup_tokens, small_enough

LINKS = "array<struct<s:int,t:int>>"


# --- links ----------------------------------------------------------------


def parse_links(line: Column) -> Column:
    """`0-0 2-1` -> array of 0-based (source, target) positions."""
    return F.transform(
        tx.tokens(line),
        lambda x: F.struct(
            F.split_part(x, F.lit("-"), F.lit(1)).cast("int").alias("s"),
            F.split_part(x, F.lit("-"), F.lit(2)).cast("int").alias("t"),
        ),
    )


def render_links(links: Column) -> Column:
    return F.array_join(F.transform(links, lambda l: F.concat_ws("-", l["s"], l["t"])), " ")


def attach_links(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Each pair with its links; a pair without a link row gets an empty list."""
    return pairs.join(links, "pair_id", "left").withColumn(
        "links", F.coalesce("links", F.array().cast(LINKS))
    )


def zip_three(links: DataFrame, src: DataFrame, tgt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alignment, source and target lines by pair id: (complete rows, rows with a side missing)."""
    rows = links.join(src, "pair_id", "full").join(tgt, "pair_id", "full")
    complete = F.col("links").isNotNull() & F.col("src").isNotNull() & F.col("tgt").isNotNull()
    return rows.where(complete), rows.where(~complete)


def link_words(pairs: DataFrame) -> DataFrame:
    """One row per link with the words it joins."""
    return pairs.select("pair_id", "src_tok", "tgt_tok", F.posexplode("links").alias("k", "l")).select(
        "pair_id",
        "k",
        F.col("l.s").alias("s"),
        F.col("l.t").alias("t"),
        F.get("src_tok", F.col("l.s")).alias("src"),
        F.get("tgt_tok", F.col("l.t")).alias("tgt"),
    )


def intersect_links(forward: Column, backward: Column) -> Column:
    """Links found in both directions, in the order of the first."""
    return F.array_intersect(forward, backward)


def link_weights(links: Column) -> Column:
    """1 / number of links that share the target position."""
    return F.transform(
        links, lambda l: F.lit(1.0) / F.size(F.filter(links, lambda m: m["t"] == l["t"]))
    )


def valid_links(links: Column, src_len: Column, tgt_len: Column) -> Column:
    """Drop all links of a row if one of them points at or past the closing token."""
    outside = F.exists(links, lambda l: (l["s"] >= src_len - 1) | (l["t"] >= tgt_len - 1))
    return F.when(outside, F.array().cast(LINKS)).otherwise(links)


# --- lexicon --------------------------------------------------------------


def parse_lexicon(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """`tgt src prob` lines -> (lexicon, rejected lines). A line needs exactly three
    fields, the last one numeric."""
    fields = tx.tokens(F.col(col))
    parsed = lines.withColumn("f", fields).withColumn("prob", F.get("f", F.lit(2)).try_cast("double"))
    good = (F.size("f") == 3) & F.col("prob").isNotNull()
    lexicon = parsed.where(good).select(
        *[c for c in lines.columns if c != col], F.get("f", F.lit(0)).alias("tgt"), F.get("f", F.lit(1)).alias("src"), "prob"
    )
    return lexicon, lines.where(~F.coalesce((F.size(fields) == 3) & F.get(fields, F.lit(2)).try_cast("double").isNotNull(), F.lit(False)))


def lexical_counts(pairs: DataFrame) -> DataFrame:
    """Counts of linked word types; unlinked words on either side pair with `NULL`."""
    positions = lambda toks: F.transform(toks, lambda _, i: i)
    free = lambda toks, side: F.array_except(positions(toks), F.col(f"links.{side}"))
    cell = lambda s, t: F.struct(s.alias("src"), t.alias("tgt"))
    null = F.lit(NULL_WORD)
    cells = F.concat(
        F.transform("links", lambda l: cell(F.get("src_tok", l["s"]), F.get("tgt_tok", l["t"]))),
        F.transform(free(F.col("tgt_tok"), "t"), lambda i: cell(null, F.get("tgt_tok", i))),
        F.transform(free(F.col("src_tok"), "s"), lambda i: cell(F.get("src_tok", i), null)),
    )
    return pairs.select(F.inline(cells)).groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("n"))


def lexical_table(counts: DataFrame, given: str = "src") -> DataFrame:
    """P(other | given) from type counts.

    The denominator is an aggregate joined back rather than a window, so a hot word
    (such as `NULL`) is never gathered in one window partition.
    """
    totals = counts.groupBy(given).agg(F.sum("n").alias("total"))
    return counts.join(totals, given).select("tgt", "src", "n", (F.col("n") / F.col("total")).alias("prob"))


def without_null(lexicon: DataFrame) -> DataFrame:
    return lexicon.where((F.col("src") != NULL_WORD) & (F.col("tgt") != NULL_WORD))


def best_translations(lexicon: DataFrame, row_no: str | None = "row_no") -> DataFrame:
    """src -> most probable tgt, `NULL` excluded.

    A repeated pair keeps its last probability; equal probabilities go to the pair
    that came first. A computed lexicon has no rows in order and no repeated pairs:
    with `row_no=None` ties go to the smallest tgt in a single aggregation.
    """
    entries = without_null(lexicon)
    if row_no is None:
        best = F.min(F.struct((-F.col("prob")).alias("k"), F.col("tgt").alias("tgt")))
        return entries.groupBy("src").agg(best.alias("b")).select("src", "b.tgt", (-F.col("b.k")).alias("prob"))
    last = entries.groupBy("src", "tgt").agg(
        F.min(row_no).alias("first_row"), F.max_by("prob", row_no).alias("prob")
    )
    return last.groupBy("src").agg(
        F.max_by(F.struct("tgt", "prob"), F.struct(F.col("prob"), -F.col("first_row"))).alias("b")
    ).select("src", "b.tgt", "b.prob")


def best_by_first_field(lexicon: DataFrame, row_no: str = "row_no") -> DataFrame:
    """tgt (the first field) -> its most probable src; the first row wins ties."""
    best = F.max_by(F.struct("src", "prob"), F.struct(F.col("prob"), -F.col(row_no)))
    return without_null(lexicon).groupBy("tgt").agg(best.alias("b")).select("b.src", "tgt", "b.prob")


def target_vocabulary(lexicon: DataFrame, keep_null: bool = True) -> DataFrame:
    """Distinct target words; the literal `NULL` entry stays unless switched off."""
    words = lexicon.select("tgt").distinct()
    return words if keep_null else words.where(F.col("tgt") != NULL_WORD)


def count_short_alignments(pairs: DataFrame, alpha: float) -> DataFrame:
    """Pairs with too few links for the share of words to replace."""
    n = sm.share(F.size("tgt_tok"), alpha)
    return pairs.agg(F.count_if(n >= F.size("links")).alias("short"), F.count(F.lit(1)).alias("pairs"))


# --- replacement tasks ----------------------------------------------------


class Ranked:
    """A word table with ranks 0..size-1, measured once so that look-ups know
    whether they may broadcast it."""

    def __init__(self, df: DataFrame, order: str, text_cols: list[str]):
        self.df = global_rank(df, [order], "rank")
        self.size = self.df.count()
        self.small = small_enough(self.df, text_cols, LOOKUP_BYTES)
        if self.size == 0:
            raise ValueError("the word table for replacement is empty")


def rank_lexicon(best: DataFrame) -> Ranked:
    return Ranked(best.select("src", "tgt"), "src", ["src", "tgt"])


def rank_vocabulary(words: DataFrame) -> Ranked:
    return Ranked(words.select("tgt"), "tgt", ["tgt"])


def _ranks(task: str, seed: int, epoch: int, n: Column, size: int) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(task), F.lit(epoch), F.col("pair_id"), F.lit("draw")))
    steps = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return let(digest, lambda d: F.transform(steps, lambda k: sm.draw_rank(d, k, size)))


def _hash_first(items: Column, n: Column, task: str, seed: int, epoch: int) -> Column:
    """The n items with the smallest keys, in key order."""
    keyed = F.transform(
        items,
        lambda x, i: F.struct(sm.sample_key(seed, task, F.lit(epoch), F.col("pair_id"), i).alias("k"), x.alias("x")),
    )
    return F.transform(F.slice(F.sort_array(keyed), F.lit(1), n), lambda z: z["x"])


def _overwrite(toks: Column, spots: Column, side: str, words: Column, field: str | None) -> Column:
    """Put words[k] at position spots[k]; the last write wins."""
    plan = F.zip_with(
        spots,
        words,
        lambda p, w: F.struct((p[side] if side else p).alias("p"), (w[field] if field else w).alias("w")),
    )
    return let(
        plan,
        lambda rows: F.transform(
            toks,
            lambda x, i: F.coalesce(F.try_element_at(F.filter(rows, lambda r: r["p"] == i), F.lit(-1))["w"], x),
        ),
    )


def _replace(
    pairs: DataFrame, task: str, table: Ranked, value: Column, spots, alpha: float, epochs: int, seed: int
) -> DataFrame:
    """Shared shape of both replacements: choose spots and ranks per epoch in the row,
    look all ranks up in one pass, overwrite, and unfold the epochs."""
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must be in [0, 1], got {alpha!r}")
    n = F.least(sm.share(F.size("tgt_tok"), alpha), F.lit(table.size).cast("int"))
    es = range(1, epochs + 1)
    chosen = pairs.select(
        "pair_id", "src_tok", "tgt_tok", *[spots(n, e).alias(f"spots{e}") for e in es]
    ).withColumns({f"ranks{e}": _ranks(task, seed, e, F.size(f"spots{e}"), table.size) for e in es})
    entries = table.df.select("rank", value.alias("entry"))
    return lookup_tokens(
        chosen,
        ["pair_id"],
        {f"words{e}": f"ranks{e}" for e in es},
        entries,
        "rank",
        "entry",
        F.lit(None),
        table.small,
        carry=["src_tok", "tgt_tok", *[f"spots{e}" for e in es]],
        common=F.floor(F.col("rank") * 64 / F.lit(table.size)),  # drawn alike often: as many entries as fit go to the tasks
    )


def replace_words(
    pairs: DataFrame, lexicon: Ranked, alpha: float, epochs: int = 1, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Overwrite both sides of floor(|tgt| * alpha) links with random lexicon pairs.

    With fewer links than that, all of them are overwritten.
    """

    def spots(n: Column, e: int) -> Column:
        links = F.col("links")
        return F.when(n < F.size(links), _hash_first(links, n, "replace", seed, e)).otherwise(links)

    rows = _replace(
        pairs.withColumn("links", F.col("links").cast(LINKS)).select("pair_id", "src_tok", "tgt_tok", "links"),
        "replace", lexicon, F.struct("src", "tgt"), spots, alpha, epochs, seed,
    )
    made = [
        F.struct(
            F.lit(e).alias("epoch"),
            _overwrite(F.col("src_tok"), F.col(f"spots{e}"), "s", F.col(f"words{e}"), "src").alias("src_tok"),
            _overwrite(F.col("tgt_tok"), F.col(f"spots{e}"), "t", F.col(f"words{e}"), "tgt").alias("tgt_tok"),
        )
        for e in range(1, epochs + 1)
    ]
    return rows.select("pair_id", F.inline(F.array(*made)))


def replace_target_words(
    pairs: DataFrame, vocabulary: Ranked, alpha: float, epochs: int = 1, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Overwrite floor(|tgt| * alpha) target words with distinct random vocabulary words."""

    def spots(n: Column, e: int) -> Column:
        positions = F.transform("tgt_tok", lambda _, i: i)
        return _hash_first(positions, n, "replace_tgt", seed, e)

    rows = _replace(
        pairs.select("pair_id", "src_tok", "tgt_tok"), "replace_tgt", vocabulary, F.col("tgt"), spots, alpha, epochs, seed
    )
    made = [
        F.struct(
            F.lit(e).alias("epoch"),
            F.col("src_tok"),
            _overwrite(F.col("tgt_tok"), F.col(f"spots{e}"), "", F.col(f"words{e}"), None).alias("tgt_tok"),
        )
        for e in range(1, epochs + 1)
    ]
    return rows.select("pair_id", F.inline(F.array(*made)))


# --- monotone reordering --------------------------------------------------

_SPAN = 1 << 31


def monotone_target(tgt_tok: Column, links: Column) -> Column:
    """Target tokens ordered by the source position they are linked to.

    A token with several links takes the smallest source position; a token without
    links follows the nearest linked token before it, and stays first if there is none.
    """
    # One number per link that sorts by target position, then by falling source position.
    codes = F.transform(
        links, lambda l: l["t"].cast("bigint") * _SPAN + (F.lit(_SPAN - 1) - l["s"].cast("bigint"))
    )

    def place(codes_: Column) -> Column:
        def anchor(j: Column) -> Column:
            last = F.array_max(F.filter(codes_, lambda c: c < (j.cast("bigint") + 1) * _SPAN))
            return F.coalesce(F.lit(_SPAN - 1) - last % _SPAN, F.lit(-1))

        rows = F.transform(
            tgt_tok, lambda x, j: F.struct(anchor(j).alias("a"), j.alias("j"), x.alias("x"))
        )
        return F.transform(F.sort_array(rows), lambda r: r["x"])

    return let(codes, place)


def reassemble_units(units: DataFrame) -> DataFrame:
    """Rebuild both sentences of a pair from its `src|tgt` units.

    `units(pair_id, unit_pos, unit)`; empty halves are dropped and the sentence-break
    symbol ends a sentence. A group is the units of one sentence pair.
    """

    def half(k: int) -> Column:
        words = F.transform(F.col("__u"), lambda u: F.split_part(u["unit"], F.lit("|"), F.lit(k)))
        kept = F.filter(words, lambda w: F.length(w) > 0)
        return F.trim(F.regexp_replace(F.array_join(kept, " "), SENTENCE_BREAK, ""))

    grouped = units.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.struct("unit_pos", "unit"))).alias("__u")
    )
    return grouped.select("pair_id", half(1).alias("src"), half(2).alias("tgt"))
