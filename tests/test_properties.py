"""Invariants, partition independence, iterative jobs against brute force, streams."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitextspark.config import TaskSpec
from bitextspark.functions import ids as fi
from bitextspark.operators import align as al
from bitextspark.operators import batching as ba
from bitextspark.operators import bilingual as bl
from bitextspark.operators import subword as sw
from bitextspark.operators import tasks as tk
from bitextspark.operators import vocab as vo
from bitextspark.registry import inputs as inp
from bitextspark.registry.stateful import TASKS, perturbed_events, rewards
from bitextspark.scale import global_rank, hashed_group_rank
from bitextspark.sources import bitext as bt
from bitextspark.sources import tables as tb
from bitextspark.streaming import bandit as bd
from bitextspark.streaming import ema as em
from bitextspark.streaming import influence as si
from bitextspark.streaming import intake as it

SF = "/root/testdata/sf0.001"
PAIR = "pair_id long, src_tok array<string>, tgt_tok array<string>"


def sample_pairs(spark, n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, rng.choices(words, k=rng.randint(1, 12)), rng.choices(words, k=rng.randint(1, 12))) for i in range(n)]
    return spark.createDataFrame(rows, PAIR)


SPECS = [TaskSpec(n, a) for n, a in [("src", None), ("rev", None), ("alpha", None), ("length", None), ("shuf", None), ("wrdp", 0.4), ("wrdp2", 0.4), ("swap", 0.5)]]


def test_task_invariants(spark):
    df = sample_pairs(spark)
    base = {r.pair_id: (r.src_tok, r.tgt_tok) for r in df.collect()}
    seen = Counter()
    for r in tk.add_tasks(df, SPECS, epochs=2).collect():
        seen[(r.task, r.epoch)] += 1
        src, tgt = base[r.pair_id]
        assert r.src_tok == src
        if r.task == "src":
            assert r.tgt_tok == src
        elif r.task in ("wrdp", "wrdp2"):
            assert r.tgt_tok.count("★") == int(len(tgt) * 0.4)
            assert all(a == b or b == "★" for a, b in zip(tgt, r.tgt_tok))
        else:
            assert sorted(r.tgt_tok) == sorted(tgt)
    resampled = {"wrdp", "wrdp2", "swap"}
    assert seen == {
        (s, e): len(base)
        for s in ["base"] + [x.name for x in SPECS]
        for e in ((1, 2) if s in resampled else (1,))
    }


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partition_independence(spark, parts):
    df = sample_pairs(spark)
    want = sorted(map(str, tk.add_tasks(df, SPECS, epochs=2).collect()))
    assert sorted(map(str, tk.add_tasks(df.repartition(parts), SPECS, epochs=2).collect())) == want
    counts = vo.token_counts(df, "src_tok", "tgt_tok")
    vocab = sorted(map(str, vo.build_vocabulary(counts).collect()))
    assert sorted(map(str, vo.build_vocabulary(vo.token_counts(df.repartition(parts), "src_tok", "tgt_tok")).collect())) == vocab


def test_ranks_match_a_sort(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 3).alias("g"))
    got = {r.v: r.k for r in global_rank(df, ["v"], "k").collect()}
    assert got == {v: v for v in range(1000)}
    hashed = df.withColumn("h", F.md5(F.col("v").cast("string")))
    rows = hashed_group_rank(hashed, ["g"], "h", ["v"], "k").collect()
    for g in (0, 1, 2):
        mine = sorted((r.h, r.v, r.k) for r in rows if r.g == g)
        assert [k for *_, k in mine] == list(range(len(mine)))


def test_lookup_paths_agree(spark):
    df = sample_pairs(spark)
    v = vo.build_vocabulary(vo.token_counts(df, "src_tok"), threshold=8)
    from bitextspark.scale import lookup_tokens

    args = (df, ["pair_id"], {"a": "src_tok", "b": "tgt_tok"}, v, "symbol", "id", F.lit(3))
    small = lookup_tokens(*args, True, ["src_tok"])
    large = lookup_tokens(*args, False, ["src_tok"])
    cols = ["pair_id", "src_tok", "a", "b"]
    assert sorted(map(str, small.select(cols).collect())) == sorted(map(str, large.select(cols).collect()))


@pytest.mark.parametrize("budget", [12, 40])
def test_batches_respect_the_budget(spark, budget):
    df = sample_pairs(spark, 200)
    length = fi.row_tokens(F.col("src_tok"), F.col("tgt_tok"))
    packed, rejected = ba.pack(df, length, budget)
    sizes = packed.groupBy("batch_id").agg((F.count("*") * F.max(length)).alias("n")).collect()
    assert all(r.n <= budget for r in sizes)
    assert packed.count() + rejected.count() == 200


def brute_bpe(words, n_merges):
    """One merge at a time over (word, count)."""
    state = [(list(w[:-1]) + [w[-1] + "</w>"], c) for w, c in words.items()]
    out = []
    for _ in range(n_merges):
        pairs = Counter()
        for syms, c in state:
            for p in zip(syms, syms[1:]):
                pairs[p] += c
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        if pairs[best] < 2:
            break
        out.append((*best, pairs[best]))
        merged = []
        for syms, c in state:
            new, i = [], 0
            while i < len(syms):
                if i + 1 < len(syms) and (syms[i], syms[i + 1]) == best:
                    new.append(syms[i] + syms[i + 1])
                    i += 2
                else:
                    new.append(syms[i])
                    i += 1
            merged.append((new, c))
        state = merged
    return out, {"".join(s)[:-4]: s for s, _ in state}


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_equal_one_at_a_time_learning(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices("aabcd", k=rng.randint(1, 7))): rng.randint(1, 9) for _ in range(60)}
    words["aaaa"] = 40
    counts = spark.createDataFrame(list(words.items()), "symbol string, count long")
    want, pieces = brute_bpe(words, 40)
    got = sw.learn_merges(counts, 40, window=30)
    assert got == want
    units = {r.symbol: r.units for r in sw.segment_types(counts, got).collect()}
    for w, syms in pieces.items():
        assert units[w] == "@@ ".join(syms)[:-4]


def indexed_bpe(words, n):
    """One merge at a time with pair counts kept up to date, for larger tables."""
    state = [([*w[:-1], w[-1] + "</w>"], c) for w, c in words]
    pairs, where = Counter(), {}
    for k, (syms, c) in enumerate(state):
        for p in zip(syms, syms[1:]):
            pairs[p] += c
            where.setdefault(p, set()).add(k)
    out = []
    while len(out) < n:
        best, count = max(pairs.items(), key=lambda x: (x[1], x[0]))
        out.append((*best, count))
        for k in where.pop(best):
            syms, c = state[k]
            for p in zip(syms, syms[1:]):
                pairs[p] -= c
            new, i = [], 0
            while i < len(syms):
                step = 2 if tuple(syms[i : i + 2]) == best else 1
                new.append("".join(syms[i : i + step]))
                i += step
            state[k] = (new, c)
            for p in zip(new, new[1:]):
                pairs[p] += c
                where.setdefault(p, set()).add(k)
    return out


def test_a_thousand_merges_of_a_table(spark):
    from bitextspark.operators import vocab as vo
    from bitextspark.registry import inputs as inp
    from bitextspark.scale import stored

    counts = stored(vo.token_counts(inp.clean(spark, "/root/testdata/sf0.01"), "src_tok", "tgt_tok"), "counts")
    rounds = []
    got = sw.learn_merges(counts, 1000, rounds=rounds)
    assert got == indexed_bpe([(r.symbol, r["count"]) for r in counts.collect()], 1000)
    assert len(rounds) < 20 and sum(rounds) == 1000


@pytest.mark.parametrize("seed", range(4))
def test_small_windows_and_few_fragments_change_nothing(spark, seed):
    """Ties everywhere, symbols made in two ways, runs of one symbol."""
    rng = random.Random(100 + seed)
    words = {"".join(rng.choices("aab" if seed % 2 else "abcde", k=rng.randint(1, 9))): rng.choice([1, 1, 2, 3]) for _ in range(40)}
    counts = spark.createDataFrame(list(words.items()), "symbol string, count long").coalesce(1)
    want, _ = brute_bpe(words, 12)
    assert sw.learn_merges(counts, 12, window=rng.choice([1, 3, 7]), max_fragments=rng.choice([2, 10, 100])) == want


def test_dictionary_segments_like_the_text(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abcd", k=rng.randint(1, 8))): rng.randint(1, 9) for _ in range(50)}
    merges = sw.learn_merges(spark.createDataFrame(list(words.items()), "symbol string, count long"), 20)
    rows = [(i, " ".join(rng.choices(sorted(words), k=6)), " ".join(rng.choices([*sorted(words), "new", "★"], k=3))) for i in range(30)]
    rows += [(100, "", "abcd"), (101, None, "")]
    df = spark.createDataFrame(rows, "pair_id long, src string, tgt string")
    types = spark.createDataFrame([("en", w, c) for w, c in words.items()], "lang string, symbol string, count long")
    known = sw.vocabulary_sets(sw.unit_counts(types, merges), ("en", "fr"), threshold=30)
    assert known["en"] and not known["fr"]
    got = {r.pair_id: r for r in sw.segment_by_dictionary(df, merges, {"src": "en", "tgt": "fr"}, known).collect()}
    want = df.select("pair_id", sw.segment_text(F.col("src"), merges, known["en"]).alias("src"), sw.segment_text(F.col("tgt"), merges, known["fr"]).alias("tgt"))
    for r in want.collect():
        assert (got[r.pair_id].src, got[r.pair_id].tgt) == (r.src or "", r.tgt)
    assert all(u.endswith("@@") or len(u) <= 1 for u in got[100].tgt.split())  # nothing known: single letters


def test_segmentation_respects_the_vocabulary(spark):
    merges = [("a", "b", 9), ("ab", "c</w>", 5)]
    df = spark.createDataFrame([("abc ab",)], "t string")
    assert df.select(sw.segment_text(F.col("t"), merges)).first()[0] == "abc a@@ b"
    assert df.select(sw.segment_text(F.col("t"), merges, {"ab@@", "c", "a@@", "b"})).first()[0] == "ab@@ c a@@ b"


def test_alignment_learns_and_never_loses_likelihood(spark):
    lexicon = {f"s{i}": f"t{i}" for i in range(8)}
    rng = random.Random(5)
    rows = []
    for i in range(80):
        src = rng.sample(sorted(lexicon), 4)
        rows.append((i, src, [lexicon[s] for s in src][::-1]))
    df = spark.createDataFrame(rows, PAIR)
    scores = []
    sentences = al.sentence_types(df, "src_tok", "tgt_tok")
    table = al.first_round(sentences)
    for _ in range(3):
        scores.append(al.log_likelihood(df, table, "src_tok", "tgt_tok"))
        table = al.next_round(sentences, table)
    assert scores == sorted(scores)
    links = al.align(df, rounds=4).collect()
    good = sum((l.s + l.t == 3) for r in links for l in r.links)
    assert good >= 0.9 * 4 * len(rows)
    assert len(links) == len(rows)


def test_bitext_files_round_trip(spark, tmp_path):
    pairs = [(i, f"s {i}" if i % 5 else "", f"t {i}") for i in range(200)]
    df = spark.createDataFrame(pairs, "pair_id long, src string, tgt string").repartition(7)
    for side, kind in (("src", "none"), ("tgt", "gzip")):
        bt.write_text(df, side, ["pair_id"], str(tmp_path / side), kind)
    back = bt.read_bitext(spark, str(tmp_path / "src"), str(tmp_path / "tgt")).orderBy("pair_id").collect()
    assert [(r.pair_id - 1, r.src, r.tgt) for r in back] == pairs
    (tmp_path / "short").write_text("one\n")
    with pytest.raises(ValueError):
        bt.read_bitext(spark, str(tmp_path / "src"), str(tmp_path / "short"))


def test_shard_discovery(spark, tmp_path):
    for name in ("train.en-fr", "train1.fr-en", "train3.en-fr"):
        (tmp_path / name).mkdir()
    found = bt.existing_shards(spark, str(tmp_path), "train", "en", "fr")
    assert [f.rsplit("/", 1)[1] for f in found] == ["train.en-fr", "train1.fr-en"]


def test_stage_is_built_once_per_configuration(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert tb.run_stage(spark, str(tmp_path), "s", config, build).count() == 3
    assert len(built) == 2


def files_of(df, path, n):
    """The rows of `df` as n files in event order."""
    rows = df.orderBy("ts", "event_id").collect()
    spark, schema = df.sparkSession, df.schema
    size = len(rows) // n + 1
    for k in range(n):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1)
        part.write.mode("append").parquet(str(path))


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_stream_ema_equals_batch(spark, tmp_path):
    events = inp.table(spark, SF, "events")
    files_of(events, tmp_path / "in", 3)
    stream = stream_of(spark, tmp_path / "in", events.schema)
    em.stream_ema(stream, ["user_id"], ["ts", "event_id"], "value", str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = {r.user_id: (r.n, round(r.ema, 9)) for r in em.read_stream_ema(spark, str(tmp_path / "out"), ["user_id"]).collect()}
    want = {}
    for r in events.orderBy("ts", "event_id").collect():
        n, e = want.get(r.user_id, (0, 0.0))
        want[r.user_id] = (n + 1, e * 0.99 + r.value * 0.01)
    assert got == {k: (n, round(e, 9)) for k, (n, e) in want.items()}


def test_stream_exp3_equals_batch_and_stays_a_distribution(spark, tmp_path):
    events = inp.table(spark, SF, "events")
    files_of(events, tmp_path / "in", 3)
    out = bd.stream_exp3(rewards(stream_of(spark, tmp_path / "in", events.schema)), TASKS)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "log")
    ).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.updates):
        last[r.key] = r.probs
    batch = bd.exp3(rewards(events), TASKS).collect()
    want = {}
    for r in sorted(batch, key=lambda r: r.step):
        assert abs(sum(r.probs) - 1) < 1e-9 and min(r.probs) >= 0.05 - 1e-12
        want[r.key] = r.probs
    assert {k: [round(p, 9) for p in v] for k, v in last.items()} == {k: [round(p, 9) for p in v] for k, v in want.items()}


def test_stream_influence_equals_batch_for_closed_windows(spark, tmp_path):
    events = inp.table(spark, SF, "events")
    files_of(events, tmp_path / "in", 6)
    stream = si.stream_influence(perturbed_events(stream_of(spark, tmp_path / "in", events.schema)))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "log")
    ).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {str(r.start)[:10]: (r.source_influence, r.tokens) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    rows = perturbed_events(events).withColumn("interval", F.date_format("ts", "yyyy-MM-dd"))
    want = {r.interval: (r.source_influence, r.tokens) for r in si.interval_influence(rows).collect()}
    assert len(got) >= 10
    assert all(want[k] == v for k, v in got.items())


def test_stream_intake_equals_batch(spark, tmp_path):
    docs = inp.table(spark, SF, "documents")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    specs = [TaskSpec("rev"), TaskSpec("wrdp", 0.3)]
    stream = inp.pairs_of(stream_of(spark, tmp_path / "in", docs.schema))
    it.start_intake(stream, str(tmp_path / "out"), str(tmp_path / "log"), specs).awaitTermination()
    cols = ["pair_id", "task", "epoch", "tgt_tok"]
    got = spark.read.parquet(str(tmp_path / "out")).select(cols).collect()
    want = it.intake(inp.pairs_of(docs), specs).select(cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_reassembly(spark):
    units = [(1, 0, "Ɛ|Ɛ"), (1, 1, "a|x"), (1, 2, "|y"), (1, 3, "b|")]
    df = spark.createDataFrame(units, "pair_id long, unit_pos int, unit string")
    row = bl.reassemble_units(df).first()
    assert (row.src, row.tgt) == ("a b", "x y")


def test_one_hot_key_keeps_all_rows(spark):
    """Most rows under one key: averages, ranks and encodings stay whole and exact."""
    n = 5000
    df = spark.range(n).select(
        F.when(F.col("id") % 5 < 4, 0).otherwise(F.col("id")).alias("key"),
        F.col("id").alias("t"),
        (F.col("id") * 37 % 101).cast("double").alias("x"),
    )
    got = {r.key: (r.n, r.ema) for r in em.ema(df, ["key"], ["t"], "x").collect()}
    e = 0.0
    for r in df.where("key = 0").orderBy("t").collect():
        e = e * 0.99 + r.x * 0.01
    assert got[0][0] == df.where("key = 0").count()
    assert got[0][1] == pytest.approx(e, abs=1e-9)
    toks = spark.range(n).select(
        F.col("id").alias("pair_id"),
        F.array(F.lit("the"), F.when(F.col("id") % 3 == 0, "the").otherwise(F.col("id").cast("string"))).alias("t"),
    )
    v = vo.build_vocabulary(vo.token_counts(toks, "t"))
    ids = vo.encode(toks, v, ("pair_id",), {"ids": "t"})
    assert ids.count() == n
    assert ids.select(F.explode("ids").alias("i")).where("i = 4").count() == n + len(range(0, n, 3))


def test_corpus_build_stages(spark, tmp_path):
    """Row counts, tags, epochs and label columns of a small marked corpus."""
    from bitextspark.config import CleanConfig
    from bitextspark.plans.corpus import CorpusBuild, CorpusConfig

    rng = random.Random(2)
    words = ["house", "tree", "river", "stone", "cloud", "light", "green", "small"]
    rows = [
        (i, "◹ " + " ".join(s := rng.choices(words, k=6)), " ".join(w[::-1] for w in s)) for i in range(40)
    ]
    df = spark.createDataFrame(rows, "pair_id long, src string, tgt string")
    specs = (TaskSpec("src"), TaskSpec("wrdp", 0.5), TaskSpec("replace_tgt", 0.5), TaskSpec("mono"))
    cfg = CorpusConfig("en", "fr", specs, epochs=2, n_merges=12, clean=CleanConfig(max_tokens=300), marked=True, em_rounds=2)
    build = CorpusBuild(spark, df, cfg, str(tmp_path))
    rows = build.versions().collect()
    n = build.segmented().count()
    assert n == 40
    counts = Counter((r.task, r.epoch) for r in rows)
    assert counts == {("base", 1): n, ("src", 1): n, ("mono", 1): n, ("wrdp", 1): n, ("wrdp", 2): n, ("replace_tgt", 1): n}
    tags = {"base": "TO_fr", "src": "TO_frtrain2", "wrdp": "TO_frtrain3", "replace_tgt": "TO_frtrain4", "mono": "TO_frtrain5"}
    for r in rows:
        assert r.src.startswith(tags[r.task] + " ◹ ")
        if r.task == "src":
            assert r.tgt == r.src.split(" ", 2)[2]
        if r.task == "wrdp":
            assert r.tgt.count("★") == 3
    encoded = build.encoded()
    assert encoded.count() == len(rows)
    assert encoded.where("array_contains(src_ids, 3) or array_contains(tgt_ids, 3)").where("epoch = 1").count() == 0


def test_dev_and_test_pass_through_the_models_of_train(spark, tmp_path):
    from bitextspark.plans.corpus import CorpusBuild, CorpusConfig

    rng = random.Random(4)
    words = ["house", "tree", "river", "stone", "cloud", "light"]
    train = [(i, " ".join(s := rng.choices(words, k=6)), " ".join(w[::-1] for w in s)) for i in range(30)]
    dev = [(1, "house unseen", "esuoh http: x"), (2, "", "eert"), (3, "same same", "same same")]
    make = lambda rows: spark.createDataFrame(rows, "pair_id long, src string, tgt string")
    cfg = CorpusConfig("en", "fr", (TaskSpec("rev"),), n_merges=30, em_rounds=1)
    build = CorpusBuild(spark, make(train), cfg, str(tmp_path), dev=make(dev))
    rows = {r.pair_id: r for r in build.tagged("dev").collect()}
    assert set(rows) == {1, 2, 3} and all(r.src.startswith("TO_fr") for r in rows.values())
    assert rows[1].src.startswith("TO_fr house u@@")
    ids = {r.pair_id: r for r in build.encoded("dev").collect()}
    unknown = 3
    assert unknown in ids[1].src_ids and unknown not in ids[1].src_ids[:2] and len(ids[2].src_ids) == 2 and ids[2].tgt_ids[-1] == 2
    for given in ("src", "tgt"):
        sums = build.lexicon(given).groupBy(given).agg(F.sum("prob").alias("p")).collect()
        assert sums and all(abs(r.p - 1) < 1e-9 for r in sums)
    # The same input finds every stage again, another one does not.
    files = lambda: sorted(p.name for p in tmp_path.iterdir())
    before = files()
    CorpusBuild(spark, make(train), cfg, str(tmp_path), dev=make(dev)).encoded("dev")
    assert files() == before
    CorpusBuild(spark, make(train), cfg, str(tmp_path), dev=make(dev[:2])).encoded("dev")
    added = set(files()) - set(before)
    assert added and all("-dev-" in name for name in added)
    CorpusBuild(spark, make(train[1:]), cfg, str(tmp_path)).cleaned()
    assert any("clean-train" in name for name in set(files()) - set(before) - added)


def test_a_changed_file_is_a_new_stage(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(5).write.parquet(path)
    build = lambda: spark.read.parquet(path).selectExpr("id + 1 AS id")
    run = lambda: tb.run_stage(spark, str(tmp_path / "out"), "s", {}, build, inputs=(build(),)).count()
    first = tb.fingerprint(build())
    assert run() == 5 and tb.fingerprint(build()) == first
    spark.range(7).write.mode("append").parquet(path)
    spark.catalog.refreshByPath(path)
    assert tb.fingerprint(build()) != first and run() == 12
    assert tb.fingerprint(build().where("id > 3")) != tb.fingerprint(build())


def test_numbered_lines_survive_other_splits(spark, tmp_path):
    """Lines keep their numbers when the scan is cut differently between build and action."""
    for name in ("b", "a"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(20_000)))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes") if spark.conf.get(k, None)}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "4")
        lines = bt.read_numbered_lines(spark, [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")])
        spark.conf.set("spark.sql.files.minPartitionNum", "16")
        got = {r.line_no: r.value for r in lines.collect()}
    finally:
        for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, saved[k]) if k in saved else spark.conf.unset(k)
    assert len(got) == 40_000
    assert (got[1], got[20_000], got[20_001], got[40_000]) == ("b0", "b19999", "a0", "a19999")


def test_missing_hypothesis_lowers_the_score(spark):
    from bitextspark.operators.scoring import hypotheses_with_references

    refs = spark.createDataFrame([(1, "a b"), (2, "c d")], "id bigint, ref string")
    hyps = spark.createDataFrame([(1, "a b")], "id bigint, hyp string")
    assert {(r.id, r.hyp) for r in hypotheses_with_references(hyps, refs).collect()} == {(1, "a b"), (2, "")}


def test_loss_without_weight_raises(spark):
    from bitextspark.operators.mixture import mixture_loss

    log = spark.createDataFrame([(1, "base", 1.0, 10), (1, "other", 1.0, 10)], "update bigint, task string, loss double, size bigint")
    with pytest.raises(Exception, match="no weight for task other"):
        mixture_loss(log, [("base", 1.0)]).collect()


@pytest.mark.parametrize("words", [True, False])
def test_match_counts_equal_counters(words):
    from bitextspark.operators.scoring import match_counts

    rnd = random.Random(7)
    line = lambda: " ".join(rnd.choice(["a", "b", "ab", "é😀", "", "-"]) for _ in range(rnd.randint(0, 9)))
    for rows in (0, 1, 5, 200):
        hyp, ref = ([line() for _ in range(rows)] for _ in range(2))
        for orders in ([1, 2, 3, 4], [2, 4], [1, 2, 3, 4, 5, 6]):
            expected = []
            for pair in zip(hyp, ref):
                h, r = (x.split(" ") if words and x else x for x in pair)
                row = []
                for n in orders:
                    hg, rg = (Counter(zip(*(x[i:] for i in range(n)))) for x in (h, r))
                    row += [(hg & rg).total(), hg.total(), rg.total()]
                expected.append(row)
            assert match_counts(hyp, ref, orders, words).tolist() == expected


def test_match_counts_of_many_distinct_words():
    """Numbers of four words exceed 63 bits here, so ranks take their place."""
    from bitextspark.operators.scoring import match_counts

    rnd = random.Random(3)
    hyp = [" ".join(str(rnd.randrange(200_000)) for _ in range(30)) for _ in range(4000)]
    assert match_counts(hyp, hyp, [1, 4], True).sum(axis=0).tolist() == [120_000] * 3 + [108_000] * 3
    assert match_counts(hyp, hyp[::-1], [4], True)[:, 0].sum() == 0


def test_score_counts_take_nulls_and_long_pairs(spark):
    from bitextspark.operators import scoring

    pairs = spark.createDataFrame([("a b", "a b"), (None, "a b c"), ("x", None), ("a " * 600_000, "a " * 600_000)], "hyp string, ref string")
    counts = scoring.clipped_counts(pairs, F.col("hyp"), F.col("ref"), [1, 2], words=False)
    got = {r.n: (r.match, r.hyp, r.ref) for r in counts.collect()}
    assert got == {1: (1_200_003, 1_200_004, 1_200_008), 2: (1_200_001, 1_200_001, 1_200_005)}  # 2 + 4 + 0 + 1,199,999
    assert scoring.clipped_counts(pairs.limit(0), F.col("hyp"), F.col("ref"), [1], words=True).collect()[0].match is None
