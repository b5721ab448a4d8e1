"""Literal cases for rules and edge behaviour."""

import math

import pytest
from pyspark.sql import functions as F

from bitextspark.config import CleanConfig, TaskSpec, parse_tasks
from bitextspark.functions import ids as fi
from bitextspark.functions import text as tx
from bitextspark.operators import batching as ba
from bitextspark.operators import bilingual as bl
from bitextspark.operators import clean as cl
from bitextspark.operators import examples as ex
from bitextspark.operators import influence as nf
from bitextspark.operators import mixture as mx
from bitextspark.operators import scoring as sc
from bitextspark.operators import tasks as tk
from bitextspark.operators import vocab as vo
from bitextspark.streaming import bandit as bd


def one(spark, col, **values):
    """Evaluate a column over one literal row."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col.alias("out")).first().out


def pairs(spark, rows):
    return spark.createDataFrame(rows, "src string, tgt string")


def test_identity_filter_compares_numbers(spark):
    df = pairs(spark, [("1.0", "1"), (" 7", "7"), ("abc", "abc"), ("a", "b")])
    assert [(r.src, r.tgt) for r in cl.drop_identical(df).collect()] == [("a", "b")]
    assert len(cl.drop_identical(df, awk_numeric=False).collect()) == 3


def test_url_filter(spark):
    df = pairs(spark, [("see http: x", "y"), ("x", "https://q"), ("ok", "fine")])
    assert [r.src for r in cl.drop_urls(df).collect()] == ["ok"]


def test_length_filter_bounds_and_ratio(spark):
    words = lambda n: " ".join(["w"] * n)
    df = pairs(spark, [(words(n), words(n) + " x") for n in (3, 4, 5, 99, 100)])
    kept = cl.clean_pairs(df).select(F.size("src_tok")).collect()
    assert sorted(r[0] for r in kept) == [5, 99]
    uneven = pairs(spark, [(words(5), words(46)), (words(5), words(45))])
    assert cl.clean_pairs(uneven).count() == 1
    assert cl.clean_pairs(uneven, CleanConfig(max_ratio=None)).count() == 2


@pytest.mark.parametrize("text", ["a\x1cb", "a\xa0b", "a　b", " a  b ", "a\x0bb", "a b", "a\x85b", "a b"])
def test_whitespace_tokens(spark, text):
    assert one(spark, tx.tokens(F.col("t")), t=text) == text.split() == ["a", "b"]


def test_every_whitespace_code_point_agrees_with_str_split(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    got = {r.c for r in df.where(F.size(tx.tokens(F.concat(F.lit("a"), "c", F.lit("b")))) == 2).collect()}
    assert got == {c for c in chars if len(f"a{c}b".split()) == 2}


def test_undo_subwords(spark):
    assert one(spark, tx.undo_subwords(F.col("t")), t="a@@ b c@@") == "ab c"
    assert one(spark, tx.undo_subwords(F.col("t")), t="x@@ ") == "x"


def test_first_token(spark):
    assert one(spark, tx.drop_first(F.col("t")), t="◹ a b") == "a b"
    assert one(spark, tx.keep_first(F.col("t")), t="◹ a b") == "◹"
    assert one(spark, tx.drop_first(F.col("t")), t="solo") == "solo"


def test_tokenise_and_detokenise(spark):
    line = "Don't stop, well-known 3,5 (yes)."
    toks = one(spark, tx.tokenise(F.col("t"), F.lit("en")), t=line)
    assert toks == "Don 't stop , well @-@ known 3,5 ( yes ) ."
    assert one(spark, tx.detokenise(F.col("t"), F.lit("en")), t=toks) == line
    assert one(spark, tx.tokenise(F.col("t"), F.lit("fr")), t="l'eau") == "l' eau"


def test_tags(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["a"])], "ordinal int, src_tok array<string>")
    got = [r.src_tok[0] for r in tk.tag_sources(df, "de").orderBy("ordinal").collect()]
    assert got == ["TO_de", "TO_detrain2", "TO_detrain3"]
    assert tk.tag_sources(df, "de", enabled=False).first().src_tok == ["a"]


def version(spark, text, spec, src="s1 s2", **kw):
    df = spark.createDataFrame([(7, src.split(), text.split())], "pair_id long, src_tok array<string>, tgt_tok array<string>")
    return " ".join(tk.add_tasks(df, [spec], include_base=False, **kw).first().tgt_tok)


def test_sorts(spark):
    got = [version(spark, "bb a cc a", TaskSpec(t)) for t in ("alpha", "invalpha", "length", "invlength")]
    assert got == ["a a bb cc", "cc bb a a", "a a bb cc", "bb cc a a"]
    assert version(spark, "zeta Alpha été b", TaskSpec("alpha")) == "Alpha b zeta été"


def test_dropout_counts(spark):
    ten = " ".join("abcdefghij")
    assert version(spark, ten, TaskSpec("wrdp", 0.3)).count("★") == 3
    assert version(spark, ten, TaskSpec("wrdp", 0.05)).count("★") == 0
    assert version(spark, ten, TaskSpec("wrdp", 1.0)) == " ".join("★" * 10)


@pytest.mark.parametrize("n,alpha,moved", [(5, 0.6, 4), (5, 1.0, 5), (1, 1.0, 0), (2, 0.5, 2), (3, 1.0, 3), (6, 0.0, 0)])
def test_swap_moves_the_right_number(spark, n, alpha, moved):
    toks = [f"t{i}" for i in range(n)]
    out = version(spark, " ".join(toks), TaskSpec("swap", alpha)).split()
    assert sorted(out) == sorted(toks)
    assert sum(a != b for a, b in zip(toks, out)) == moved


def test_src_task_and_mark(spark):
    assert version(spark, "x", TaskSpec("src"), src="◹ a b") == "◹ a b"
    assert version(spark, "x", TaskSpec("src"), src="◹ a b", remove_mark=True) == "a b"
    assert version(spark, "x", TaskSpec("src"), src="solo", remove_mark=True) == "solo"


def test_bad_tasks():
    for bad in ("bpe", "rev2", "nope"):
        with pytest.raises(ValueError):
            TaskSpec(bad)
    with pytest.raises(ValueError):
        TaskSpec("wrdp", 1.5)
    with pytest.raises(ValueError):
        TaskSpec("swap")
    assert parse_tasks("rev+wrdp", "0.3") == [TaskSpec("rev"), TaskSpec("wrdp", 0.3)]


def test_epoch_rotation():
    assert [tk.rotate_epoch(e, 2) for e in range(1, 6)] == [1, 2, 1, 2, 1]
    assert tk.rotate_epoch(9, 0) == 1


def linked(spark, n_links):
    links = [(0, 0), (1, 1), (2, 3)][:n_links]
    return spark.createDataFrame(
        [(1, ["s0", "s1", "s2"], ["t0", "t1", "t2", "t3"], links)],
        "pair_id long, src_tok array<string>, tgt_tok array<string>, links array<struct<s:int,t:int>>",
    )


def lexicon(spark):
    rows = [("X%d" % i, "Y%d" % i) for i in range(10)]
    return bl.rank_lexicon(spark.createDataFrame(rows, "src string, tgt string"))


@pytest.mark.parametrize("n_links", [3, 2])
def test_replace_overwrites_both_sides(spark, n_links):
    out = bl.replace_words(linked(spark, n_links), lexicon(spark), 0.5).first()
    new_src = [(i, w) for i, w in enumerate(out.src_tok) if w.startswith("X")]
    new_tgt = [(i, w) for i, w in enumerate(out.tgt_tok) if w.startswith("Y")]
    assert len(new_src) == len(new_tgt) == 2
    assert sorted(w[1:] for _, w in new_src) == sorted(w[1:] for _, w in new_tgt)
    assert len({w for _, w in new_tgt}) == 2


def test_replace_without_broadcast_is_the_same(spark):
    lex = lexicon(spark)
    a = bl.replace_words(linked(spark, 3), lex, 0.5, epochs=3).collect()
    lex.small = False
    assert sorted(map(str, bl.replace_words(linked(spark, 3), lex, 0.5, epochs=3).collect())) == sorted(map(str, a))


def test_short_alignment_counter_is_strict(spark):
    assert bl.count_short_alignments(linked(spark, 2), 0.5).first().short == 1
    assert bl.count_short_alignments(linked(spark, 3), 0.5).first().short == 0


def test_best_translation_rules(spark):
    rows = [("x", "s", 0.5, 1), ("y", "s", 0.5, 2), ("NULL", "s", 0.9, 3), ("q", "r", 0.9, 4), ("p", "r", 0.5, 5), ("q", "r", 0.1, 6)]
    df = spark.createDataFrame(rows, "tgt string, src string, prob double, row_no int")
    assert {r.src: r.tgt for r in bl.best_translations(df).collect()} == {"s": "x", "r": "p"}
    assert {r.tgt for r in bl.target_vocabulary(df).collect()} == {"x", "y", "NULL", "q", "p"}
    assert {r.tgt for r in bl.target_vocabulary(df, keep_null=False).collect()} == {"x", "y", "q", "p"}
    first = {r.tgt: r.src for r in bl.best_by_first_field(df).collect()}
    assert first == {"x": "s", "y": "s", "q": "r", "p": "r"}


def test_monotone(spark):
    df = spark.createDataFrame(
        [(["a", "b", "c", "d"], [(2, 0), (0, 2)])], "tgt_tok array<string>, links array<struct<s:int,t:int>>"
    )
    # a(2) b(after a) c(0) d(after c)
    assert df.select(bl.monotone_target(F.col("tgt_tok"), F.col("links"))).first()[0] == ["c", "d", "a", "b"]


def test_none_task_has_no_rows(spark):
    assert tk.none_task(linked(spark, 1)).count() == 0


def test_id_functions(spark):
    ids = F.array(*[F.lit(x) for x in (5, 6, 2)])
    row = spark.range(1)
    get = lambda c: row.select(c).first()[0]
    assert get(fi.decoder_input(ids)) == [2, 5, 6]
    assert get(fi.append_eos(ids)) == [5, 6, 2]
    assert get(fi.strip_eos(ids)) == [5, 6]
    assert get(fi.pad_left(F.array(F.lit(7), F.lit(2)), F.lit(3))) == [1, 7, 2]
    assert get(fi.pad_right(F.array(F.lit(7), F.lit(2)), F.lit(3))) == [7, 2, 1]
    assert get(fi.drop_second(F.array(*[F.lit(x) for x in (10, 11, 12, 13)]))) == [10, 12, 13]
    assert get(fi.truncate(ids, 2)) == [5, 2]
    assert get(fi.truncate(ids, 0)) == [2]
    assert get(fi.round_up(F.lit(9), 8)) == 16
    masked = fi.mask_synthetic(F.array(F.lit(9), F.lit(8), F.lit(7)), ids, F.lit("rev"), 8)
    assert get(masked) == [1, 1, 1] and get(fi.count_non_pad(masked)) == 0
    assert get(fi.mask_synthetic(F.array(F.lit(9), F.lit(8)), ids, F.lit("base"), 8)) == [5, 6, 2]


def test_link_columns(spark):
    df = spark.createDataFrame([([(5, 7), (2, 3), (1, 3), (4, 2)],)], "links array<struct<s:int,t:int>>")
    assert df.select(bl.link_weights(F.col("links"))).first()[0] == [1.0, 0.5, 0.5, 1.0]
    assert df.select(bl.valid_links(F.col("links"), F.lit(6), F.lit(9))).first()[0] == []
    assert len(df.select(bl.valid_links(F.col("links"), F.lit(7), F.lit(9))).first()[0]) == 4
    assert df.select(bl.render_links(F.col("links"))).first()[0] == "5-7 2-3 1-3 4-2"


def test_mixture_weights():
    assert mx.normalised_weights(["a", "b", "c"]) == [(t, 1 / 3) for t in "abc"]
    assert mx.normalised_weights(["a", "b", "c"], 0.5) == [("a", 0.5), ("b", 0.25), ("c", 0.25)]


def score(rows, spark):
    return spark.createDataFrame(rows, "side string, sample_id long, run int, pos int, token string, logp double")


def test_influence_and_perplexity(spark):
    rows = [("source", 1, r, 0, "a", math.log(p)) for r, p in enumerate((0.2, 0.4))]
    assert nf.variances(score(rows, spark)).first().variance == pytest.approx(0.01)
    flat = [(s, 1, r, 0, "a", -1.0) for s in ("source", "target") for r in (0, 1)]
    assert nf.average_influence(nf.token_influence(score(flat, spark))).first().undefined == 1
    half = [("source", 1, 0, p, "a", -math.log(2)) for p in (0, 1)]
    row = nf.perplexity(score(half, spark)).first()
    assert (row.nll, row.perplexity) == (1.0, 2.0)
    mixed = rows + [("target", 1, r, 0, "a", -1.0) for r in (0, 1)]
    assert nf.token_influence(score(mixed, spark)).first().influence == 1.0


def test_bleu_and_chrf_extremes(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat")], "id long, hyp string, ref string")
    assert sc.corpus_bleu(df).first().bleu == 100.0
    assert sc.corpus_chrf(df).first().chrf == 100.0
    assert sc.corpus_chrf(df, word_order=2).first().chrf == 100.0
    clipped = spark.createDataFrame([(1, "the the the the the", "the cat is here now")], "id long, hyp string, ref string")
    row = sc.corpus_bleu(clipped).first()
    # one clipped unigram, then smoothed zeros 1/2, 1/4, 1/8
    want = 100 * math.exp(sum(map(math.log, (1 / 5, 0.5 / 4, 0.25 / 3, 0.125 / 2))) / 4)
    assert row.bleu == pytest.approx(want, abs=1e-6)
    nothing = spark.createDataFrame([(1, "", "a b")], "id long, hyp string, ref string")
    assert sc.corpus_bleu(nothing).first().bleu == 0.0 and sc.corpus_chrf(nothing).first().chrf == 0.0


def test_exp3_update():
    import numpy as np

    w = np.zeros(2)
    assert bd.probabilities(w, 0.25).tolist() == [0.5, 0.5]
    bd._step(w, 0, 1.0, 0.25)
    assert w.tolist() == [0.25, 0.0]


def test_vocabulary_padding_and_round_trip(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"])], "pair_id long, t array<string>")
    v = vo.build_vocabulary(vo.token_counts(df, "t"))
    assert v.count() == 8 and {r.symbol: r.id for r in v.collect()}["a"] == 4
    ids = vo.encode(df, v, ("pair_id",), {"ids": "t"})
    back = vo.decode(ids, v, ("pair_id",), {"t": "ids"})
    assert {r.pair_id: r.t for r in back.collect()} == {1: ["a", "b", "a"], 2: ["c"]}


def test_wrdp2_keeps_the_base_label(spark):
    rows = [(1, "base", [5, 2], [6, 7, 2]), (1, "wrdp2", [5, 2], [9, 7, 2])]
    df = spark.createDataFrame(rows, "pair_id long, task string, src_ids array<int>, tgt_ids array<int>")
    row = ex.example_for_task(ex.attach_auxiliaries(df), "wrdp2").first()
    assert row.tgt_ids == [6, 7, 2] and row.prev_ids == [2, 9, 7]


def test_bucket_bounds(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 10, 10, 10, 20)], "n int")
    table = {r.size: r.bucket for r in ba.bucket_table(df, F.col("n"), 2).collect()}
    assert table == {1: 4, 2: 4, 3: 4, 4: 4, 10: 20, 20: 20}
