"""Steps whose shuffles and spills must grow no faster than the input; tables that are folders."""


import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
import bitextspark.scale as scale
from bitextspark.operators import examples as ex
from bitextspark.operators import vocab as vo

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_encoding_moves_no_row_and_makes_no_row_of_a_token(spark):
    df = spark.createDataFrame([(1, ["a", "b", None], ["c"]), (2, [], None), (1, ["b"], ["a"])], "pair_id int, s array<string>, t array<string>")
    v = spark.createDataFrame([(7, "a"), (8, "b")], "id int, symbol string")
    out = vo.encode(df, v, ("pair_id",), {"x": "s", "y": "t"})
    assert not any(word in plan_of(out) for word in ("Repartition", "Aggregate", "Join"))
    assert sorted(map(tuple, out.collect())) == [(1, [7, 8, 3, 2], [3, 2]), (1, [8, 2], [7, 2]), (2, [2], [2])]


def test_only_tokens_beyond_the_common_part_of_a_large_vocabulary_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(
        [(1, ["a", "b", None, "zz"], ["f"]), (2, [], None), (None, ["e", "a"], ["a"]), (1, ["f", "f"], ["e", "x", "b"])],
        "pair_id int, s array<string>, t array<string>",
    )
    v = spark.createDataFrame([(4 + k, w) for k, w in enumerate("abcdef")], "id int, symbol string")
    args = (df, v, ("pair_id",), {"x": "s", "y": "t"}, ("s",))
    want = sorted(map(str, vo.encode(*args).collect()))
    monkeypatch.setattr(scale, "LOOKUP_BYTES", 80)
    sent, joined = scale._common_part(v, "symbol", "id", vo._by_id())
    assert {r.symbol for r in sent.collect()} == {"a", "b", "c"} and joined.count() == 3
    for bound in (80, 1, 130):
        monkeypatch.setattr(scale, "LOOKUP_BYTES", bound)
        assert sorted(map(str, vo.encode(*args).collect())) == want
    monkeypatch.setattr(scale, "LOOKUP_BYTES", 80)
    plan = plan_of(vo.encode(*args))
    assert "Generate explode(__missed" in plan and "explode_outer" not in plan
    ids = vo.encode(df, v, ("pair_id",), {"x": "s"})
    back = [vo.decode(ids, v, ("pair_id",), {"w": "x"}).collect()]
    monkeypatch.setattr(scale, "LOOKUP_BYTES", 1 << 20)
    back.append(vo.decode(ids, v, ("pair_id",), {"w": "x"}).collect())
    assert sorted(map(str, back[0])) == sorted(map(str, back[1]))


def test_keys_that_share_a_digest_are_told_apart(monkeypatch):
    monkeypatch.setattr(scale, "_digests", lambda words: np.array([len(w) for w in words], dtype="uint64"))
    entries = scale._Entries(pa.array(["ab", "cd", "e", "fg"], pa.large_string()), pa.array([1, 2, 3, 4]))
    tokens = pa.array(["cd", "x", "fg", None, "e", "ab", "zz", "abc"], pa.large_string())
    assert entries.find(tokens).to_pylist() == [2, None, 4, None, 3, 1, None, None]
    assert scale._Entries(pa.array([], pa.large_string()), pa.array([], pa.int32())).find(tokens).null_count == len(tokens)


def test_examples_of_all_tasks_read_the_records_once(spark):
    rows = [(1, "base", [5, 2], [6, 2]), (1, "rev", [5, 2], [7, 2]), (2, "base", [8, 2], [9, 2])]
    records = ex.attach_auxiliaries(spark.createDataFrame(rows, "pair_id int, task string, src_ids array<int>, tgt_ids array<int>"))
    out = ex.examples_for_tasks(records, ("base", "rev"))
    assert plan_of(out).count("Aggregate") == 1
    assert sorted((r.pair_id, r.task, r.tgt_ids) for r in out.collect()) == [(1, "base", [6, 2]), (1, "rev", [7, 2]), (2, "base", [9, 2])]


def test_intake_reads_a_table_that_is_a_folder(spark, tmp_path):
    folder = tmp_path / "documents.parquet"
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(str(folder))
    got = entry.queries()["stm4_incremental_intake"](spark, str(tmp_path))
    want = entry.queries()["stm4_incremental_intake"](spark, SF)
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    assert digest(got) == digest(want) and want.count() > 0


def test_translation_counts_are_kept_as_a_table_and_totals_are_not_shuffled_against_them(spark):
    from bitextspark.operators import align as al

    df = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, ["a"], ["x", "y"])], "pair_id int, s array<string>, t array<string>")
    table = al.train(df, "s", "t", rounds=1)
    plan = plan_of(table)
    assert "LogicalRDD" not in plan and "parquet" in plan and "broadcast" in plan
    sums = table.groupBy("s", "null").agg(F.sum("p").alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-9 for r in sums)


def test_recasing_joins_nothing_and_keeps_the_words_as_they_were(spark):
    from bitextspark.operators import truecase as tc

    model = spark.createDataFrame([("en", "the", "the", 3)], "lang string, lower string, best string, n int")
    df = spark.createDataFrame([(1, "en", ["The", "a", ".", "The", "."]), (2, "en", []), (3, "fr", ["The"])], "pair_id int, lang string, w array<string>")
    out = tc.apply_truecase(df, model, "w", given="before")
    assert "Join" not in plan_of(out)
    assert sorted((r.pair_id, r.w, r.before) for r in out.collect()) == [
        (1, ["the", "a", ".", "the", "."], ["The", "a", ".", "The", "."]), (2, [], []), (3, ["The"], ["The"]),
    ]


def test_links_are_known_by_the_words_of_their_sentence(spark, monkeypatch):
    from bitextspark.registry import vocabulary as rv

    seen, encode = [], vo.encode
    monkeypatch.setattr(rv.vo, "encode", lambda df, v, keys, arrays, **more: seen.append(keys) or encode(df, v, keys, arrays, **more))
    assert entry.queries()["flt9_unknown_links"](spark, SF).count() > 0
    assert seen == [("pair_id",)]


def test_batches_group_the_ids_of_a_pair_once(spark):
    from bitextspark.plans.examples import ExampleConfig, TrainingExamples

    rows = [(k, task, 1, [9, 20, 5 + k, 2], [6] * (1 + k % 3) + [2]) for k in range(6) for task in ("base", "rev")]
    rows.append((7, "base", 1, [9, 20, 5, 2], [6] * 30))
    versions = spark.createDataFrame(rows, "pair_id int, task string, epoch int, src_ids array<int>, tgt_ids array<int>")
    vocabulary = spark.createDataFrame([(20, "m")], "id int, symbol string")
    made = TrainingExamples(versions, vocabulary, ExampleConfig(("rev",), max_tokens=12, marked=True))
    batches, over = made.batches(1)
    assert plan_of(batches).count("map_from_entries") == 1
    assert [(r.pair_id, len(r.tgt_ids)) for r in over.collect()] == [(7, 30)]
    got = sorted((r.task, i) for r in batches.collect() for i in r.ids)
    assert got == sorted((t, k) for k in range(6) for t in ("base", "rev"))
    assert all(max(map(len, r.source + r.target)) * r.nsentences <= 12 for r in batches.collect())


def test_constraints_are_ranked_once_and_padded_without_a_join(spark):
    out = entry.queries()["arr3_constraint_padding"](spark, SF)
    plan = plan_of(out)
    # One ranking is a window over rows and one over slices; a batch is a third. The only join is the ranking's.
    assert (plan.count("row_number()"), plan.count("Join "), plan.count("\nWindow ") + plan.count("- Window ")) == (1, 1, 3)


def test_batch_totals_need_sizes_only(spark):
    from bitextspark.registry import rows as rr

    for name in ("agg18_batch_totals", "bat3_token_budget_batches", "win6_strided_split"):
        out = entry.queries()[name](spark, SF)
        assert not any("encoded-pairs" in f for f in out.inputFiles()), name
    sizes = rr.encoded(spark, SF).select("pair_id", F.size("src_ids").alias("src_size"), F.size("tgt_ids").alias("tgt_size"))
    assert sizes.count() > 0 and sizes.exceptAll(rr.encoded_sizes(spark, SF)).isEmpty() and rr.encoded_sizes(spark, SF).exceptAll(sizes).isEmpty()


def test_a_word_is_merged_once_for_units_and_dictionary(spark, monkeypatch):
    from bitextspark.operators import subword as sw
    from bitextspark.registry import iterative as it

    merged, merged_types = [], sw.merged_types
    monkeypatch.setattr(it, "merges", lambda spark, sf: [("e", "r</w>", 9), ("t", "h", 8), ("th", "er</w>", 7)])
    monkeypatch.setattr(sw, "merged_types", lambda words, *a, **more: merged.append(words.select("symbol")) or merged_types(words, *a, **more))
    monkeypatch.setattr(sw, "token_counts", lambda *a: 1 / 0)
    assert entry.queries()["jn9_subword_lookup"](spark, SF).count() > 0
    assert len(merged) == 1 and merged[0].count() == merged[0].distinct().count() > 0


def test_unknown_units_of_merged_words_are_split_by_side(spark):
    from bitextspark.operators import subword as sw

    merges = [("a", "b", 9), ("ab", "c</w>", 5), ("@", "@", 4)]
    words = spark.createDataFrame([("en", w, 1) for w in ("abc", "aba@@", "@@", "a</w>b")] + [("fr", "abc", 1)], "lang string, symbol string, count long")
    merged = sw.merged_types(words, merges)
    got = {(r.lang, r.symbol): r.units for r in sw.known_units(merged, merges, {"en": {"abc", "ab@@"}, "fr": {"c", "ab@@"}}).collect()}
    assert got == {("en", "abc"): "abc", ("fr", "abc"): "ab@@ c", ("en", "aba@@"): "ab@@ a@@ @@@ @", ("en", "@@"): "@@@ @", ("en", "a</w>b"): "a@@ <@@ /@@ w@@ >@@ b"}
    units = {r.symbol: r["count"] for r in sw.merged_unit_counts(merged).where("lang = 'fr'").collect()}
    assert units == {"abc": 1}


def test_statistics_keep_one_row_a_word_whatever_the_number_of_tasks(spark):
    import re

    import pytest
    from bitextspark.plans.corpus import task_statistics

    plan = plan_of(entry.queries()["m0_task_statistics"](spark, SF))
    assert re.findall(r"Aggregate \[([^\]]*)\]", plan)[-1].startswith("w#") and "task" not in re.findall(r"Aggregate \[([^\]]*)\]", plan)[-1]
    rows = [("base", ["a", "b", "a"], ["c"]), ("rev", ["a"], []), ("base", [], ["c", "a"]), ("rev", ["d", "a"], None)]
    versions = spark.createDataFrame(rows, "task string, src_tok array<string>, tgt_tok array<string>")
    got = sorted(map(tuple, task_statistics(versions, ["base", "rev", "none"]).collect()))
    assert got == [("base", "src", 1, 3, 2), ("base", "tgt", 2, 3, 2), ("rev", "src", 2, 3, 2)]
    with pytest.raises(Exception, match="not listed: rev"):
        task_statistics(versions, ["base"]).collect()


def test_rows_without_rare_tokens_are_not_joined(spark, monkeypatch):
    df = spark.createDataFrame([(k, ["a"] * 3, ["a", "zz"] if k == 3 else ["b"]) for k in range(6)], "pair_id int, s array<string>, t array<string>")
    v = spark.createDataFrame([(4, "a"), (5, "b"), (900, "zz")], "id int, symbol string")
    monkeypatch.setattr(scale, "LOOKUP_BYTES", 60)
    out = vo.encode(df, v, ("pair_id",), {"x": "s", "y": "t"})
    assert "Union" in plan_of(out)
    assert sorted(map(tuple, out.collect())) == [(k, [4, 4, 4, 2], [4, 900, 2] if k == 3 else [5, 2]) for k in range(6)]


def test_encoded_rows_are_written_where_they_are(spark, tmp_path):
    from bitextspark.sources import tables as tb

    rows = spark.range(40, numPartitions=4).select("id", F.lit("train").alias("split"), (F.col("id") % 2).alias("epoch"), F.lit("base").alias("task"))
    tb.write_encoded(rows, str(tmp_path / "out"))
    assert [len(list((tmp_path / f"out/split=train/epoch={e}/task=base").glob("*.parquet"))) for e in (0, 1)] == [4, 4]
    assert tb.read_encoded(spark, str(tmp_path / "out")).count() == 40


def test_linked_pairs_are_kept_as_a_table(spark):
    for name in ("aux12_replace", "aux13_replace_target"):
        plan = plan_of(entry.queries()[name](spark, SF))
        assert "LogicalRDD" not in plan and "parquet" in plan


def test_a_lexicon_beyond_the_bound_moves_only_rows_with_open_draws(spark, monkeypatch):
    from bitextspark.operators import bilingual as bl

    rows = [(k, [f"s{k}", "a", "b"], [f"t{k}", "x", "y", "z"], [(0, 0), (1, 2)]) for k in range(30)]
    df = spark.createDataFrame(rows, "pair_id int, src_tok array<string>, tgt_tok array<string>, links array<struct<s:int,t:int>>")
    best = spark.createDataFrame([(f"w{k:02d}", f"v{k}") for k in range(40)], "src string, tgt string")
    made = lambda: bl.replace_words(df, bl.rank_lexicon(best), 0.3)
    want = sorted(map(tuple, made().collect()))
    monkeypatch.setattr(scale, "LOOKUP_BYTES", 1500)
    monkeypatch.setattr(bl, "LOOKUP_BYTES", 1500)
    out = made()
    assert "Union" in plan_of(out) and sorted(map(tuple, out.collect())) == want


def test_tokenised_texts_are_computed_before_the_cleaner_names_them(spark, tmp_path):
    from bitextspark.operators.clean import clean_pairs
    from bitextspark.plans.corpus import CorpusBuild, CorpusConfig

    df = spark.createDataFrame([(1, "a b", "c d")], "pair_id long, src string, tgt string")
    build = CorpusBuild(spark, df, CorpusConfig("en", "fr"), str(tmp_path))
    plan = clean_pairs(build.tokenised())._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp_replace(regexp_replace" in line for line in plan.split("\n") if "Filter" in line)
