"""Operators of the llm subpackage against brute force, with nulls, ties and empty tables."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitextspark.llm import chat, decontaminate, licences, neardup, pieces, pii, quality, substrings, tokenfile, urls, words
from bitextspark.llm.components import connected
from bitextspark.llm.queries import PIECES, WORD_PIECES

PROSE = "the quick onerain erth of thandle in restion over anding tiwh lazy ouble"


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE.split()) + str(rng.randint(0, 9999)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated and long rows, and a column more."""
    rows = [
        (1, "Hello  world\n▁x é 日本", "a"), (2, None, "b"), (3, "", None), (4, "   \n ", "c"), (1, "Hello  world\n▁x é 日本", "a"),
        (None, "no id here", "d"), (5, prose(4000, 1), "e"), (6, "\ttab\x0b <s> 'Tis DON'T", "f"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, extra string")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, extra string")


def test_sentencepiece_equals_library(odd, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = pieces.decode(pieces.encode(odd, PIECES), PIECES).collect()
    assert len(rows) == 8
    for r in rows:
        assert r.ids == model.encode(r.text or "") and r.decoded == model.decode(r.ids)
    assert pieces.encode(nothing, PIECES).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(odd, PIECES, out="extra")


def test_chunk_table_on_random_marks():
    rng = random.Random(5)
    table = pieces.ChunkTable(PIECES)
    batch = ["".join(rng.choice(" ▁ab\né日😀.<s>") for _ in range(rng.randint(0, 25))) for _ in range(800)]
    flat, bounds = table.encode(batch)
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [table.model.encode(t) for t in batch]


def test_token_file_round_trip(spark, odd, nothing, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_PIECES)
    tokenfile.write(odd, str(tmp_path / "t"), WORD_PIECES, end_id=1)
    got = tokenfile.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    want = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    start, flat = 0, []
    for g, (key, text) in zip(got, want, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (key, start, len(ids), ids)
        start, flat = start + len(ids), flat + ids
    sums = {r.start: r.ids_crc32 for r in tokenfile.checksums(spark, str(tmp_path / "t")).collect()}
    assert all(sums[g.start] == zlib.crc32(np.array(g.ids, "<u4").tobytes()) for g in got)
    assert tokenfile.ids_at(spark, str(tmp_path / "t"), 3, 500).tolist() == flat[3:503]
    tokenfile.write(nothing, str(tmp_path / "e"), WORD_PIECES, end_id=1)
    assert tokenfile.read(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("width", [1, 7, 11, 16, 17])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 70_001).astype(np.uint32)
    packed = tokenfile.pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    assert (tokenfile.unpack(packed, width, 777, 1234) == ids[777:2011]).all()


def _brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub(r"\D", "", m.group())
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_patterns_equal_regexes():
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("a@.-1 9+(é%_0") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == _brute_spans(t)
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_crf_held_out_accuracy(spark, odd):
    crf = pii.train(pii.labelled_table(spark))
    rng = np.random.default_rng(99)
    held = [pii._example(rng) for _ in range(300)]
    hit = found = want = 0
    for (text, spans), got in zip(held, pii.crf_spans([t for t, _ in held], crf)):
        right = {s for s in spans if pii._plausible(s[0], text[s[1] : s[2]])}
        hit, found, want = hit + len(right & set(got)), found + len(got), want + len(right)
    assert hit / found > 0.97 and hit / want > 0.9
    rows = pii.find(odd, crf, masked="hidden").collect()
    assert len(rows) == 8 and all(r.base_spans == [] for r in rows if r.doc_id in (2, 3, 4))
    assert [r.hidden for r in rows if r.doc_id == 2] == [None]
    one = spark.createDataFrame([("call +1 (017) 555-7713 or a.b@x.example.com",)], "text string")
    assert pii.find(one, crf, masked="hidden").first().hidden == "call [PHONE] or [EMAIL]"


def _quality(t):
    white = r"[^\x20\x09-\x0D]+"
    w = re.findall(white, t)
    lines = [x for x in t.split("\n") if re.search(white, x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd, nothing):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "b ", "é", "\n", " ", "#x ", "ab c "]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in quality.judge(df, PIECES, quality.QualityRules(), lang=None).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _quality(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.kept for r in quality.judge(odd, PIECES, quality.QualityRules(), lang=None).where("text IS NULL").collect()} == {False}
    assert quality.judge(nothing, PIECES, quality.QualityRules()).count() == 0


def _measured(spark, rows):
    """Rows of (id, lang, tokens, characters per token, byte share, entropy) with the other measures."""
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double")
    return df.withColumns(
        {"n_words": F.col("doc_id"), "word_chars": F.col("n_tokens") * 3, "n_symbols": F.lit(0), "n_dup_lines": F.lit(0), "n_repeat_words": F.lit(0), "latin_share": F.lit(1.0)}
    )


def test_each_fertility_measure_alone_rejects(spark):
    rng = np.random.default_rng(12)
    rules = quality.QualityRules()
    rows = [
        (i, ["en", "fr", None][i % 3], int(rng.integers(70, 500)), float(2.6 + rng.normal() / 20), float(0.01 + rng.random() / 100), float(0.7 + rng.normal() / 30))
        for i in range(3000)
    ]
    junk = [
        (5000, "en", 100, 1.9, 0.01, 0.7), (5001, "en", 100, 4.5, 0.01, 0.7), (5002, "en", 100, 2.6, 0.3, 0.7),
        (5003, "en", 100, 2.6, 0.01, 0.3), (5004, "en", 100, 2.6, 0.01, 0.97), (5005, None, 300, 1.9, 0.01, 0.7),
    ]
    spared = [(6000, "en", 39, 1.9, 0.9, 0.1), (6001, "de", 100, 1.9, 0.2, 0.9), (6002, "en", 100, 2.55, 0.0, 0.69)]
    df = _measured(spark, rows + junk + spared)
    bands = quality.relative_bands(df, rules)
    judged = quality._grouped(df, "lang").join(bands, list(quality._GROUP), "left")
    kept = {r.doc_id: r.k for r in judged.select("doc_id", quality.usual(rules).alias("k")).collect()}
    assert [x[0] for x in junk if kept[x[0]]] == [] and all(kept[x[0]] for x in spared)
    assert sum(not kept[x[0]] for x in rows) == 0
    # Against numpy, copies counted once.
    again = quality.relative_bands(df.unionByName(df.where("doc_id % 5 = 0")).unionByName(df), rules)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, bands.collect()), key=str)
    every = [x for x in rows + junk + spared if x[1] == "en" and 128 <= 3 * x[2] < 256]
    band = bands.where("__lang = 'en' AND __class = 7").first()
    for k, (name, least, wide) in enumerate(zip(quality._MEASURED, rules.least, rules.wide)):
        values = np.round([x[3 + k] for x in every], 4)
        middle = np.median(values)
        unit = middle if k == 0 else 1.0
        spread = 1.4826 * np.median(np.round(np.abs(values - middle), 4))
        mixed = np.sqrt((len(values) * spread**2 + rules.prior * (wide * unit) ** 2) / (len(values) + rules.prior))
        assert band[f"{name}__m"] == pytest.approx(middle, abs=1e-9)
        assert band[f"{name}__h"] == pytest.approx(rules.deviations * max(mixed, least * unit), abs=1e-3)


def test_shouted_text_leaves_the_band_of_its_language(spark):
    chosen = random.Random(3)
    texts = [(i, "xx", " ".join(chosen.choices(PROSE.split(), k=120))) for i in range(40)]
    shouted = [(100, "xx", texts[0][2].upper()), (101, "xx", None), (102, None, texts[1][2]), (103, "xx", "")]
    df = spark.createDataFrame(texts + shouted, "doc_id bigint, lang string, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(df, PIECES, quality.QualityRules()).collect()}
    assert all(got[i] == (False, True) for i in range(40))
    assert (got[100], got[101], got[102], got[103]) == ((False, False), (True, False), (False, True), (True, False))


def test_bands_leave_room_for_short_texts_with_long_tokens(spark):
    # Characters per token of doc_id 830 and 4725 of sf0.1 (quality 1), and of a text far below its language.
    rows = [(1, "en", 2.204), (2, "en", 2.188), (3, "de", 2.2), (4, "es", 1.9), (5, "fr", 1.9), (6, "en", 1.3), (7, "fr", 1.3)]
    measures = "100L AS n_tokens, 0.01D AS byte_share, 0.8D AS token_entropy, 1D AS latin_share"
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, chars_per_token double").selectExpr("*", *measures.split(", "))
    kept = df.where(quality.fertile(quality.QualityRules())).collect()
    assert {r.doc_id for r in kept} == {1, 2, 3, 4, 5}


def _components(texts, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, odd, nothing):
    texts, rng = {}, random.Random(2)
    for group in range(12):
        base = prose(rng.choice([3, 8, 60, 120]), group).split()
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            texts[len(texts) + 1] = " ".join(copy)
    texts[500], texts[501], texts[502] = None, "", " \n"
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(df, neardup.NearDuplicates(percent=85)).collect()}
    assert got == _components(texts, 85)
    rows = neardup.link(odd).collect()
    assert len(rows) == 8 and [r.kept for r in rows if r.doc_id is None] == [True]
    assert neardup.link(nothing).count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    two = np.concatenate([one[:300], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    flat = np.concatenate([one, two, one[:3]])
    sig = neardup.super_minhash(flat, np.array([0, 400, 800, 803]), 252)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.1
    assert (sig != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    # A slot of a one-element set holds each rank of the permutation once.
    alone = neardup.super_minhash(one[:1], np.array([0, 1]), 252)[0] >> np.uint64(40)
    assert sorted(alone.tolist()) == list(range(252))


def test_cells_hold_every_pair_once_in_bounded_size(monkeypatch):
    monkeypatch.setattr(neardup, "HALF", 100)
    ids = np.arange(40, dtype=np.int64) * 7
    n = np.tile(np.array([30, 60, 10, 250], dtype=np.int64), 10)
    pairs = np.array([(i, j) for i in range(40) for j in range(i + 1, 40)], dtype=np.int32).T
    size = dict(zip(ids.tolist(), n.tolist()))
    seen, parts = [], set()
    for part, used, i, j in neardup._cells(pairs, ids, n):
        parts.add(part)
        assert sum(size[x] for x in used.tolist()) <= 2 * (100 + 250)
        seen += zip(used[i].tolist(), used[j].tolist())
    assert len(parts) > 1
    assert sorted(seen) == sorted(zip(ids[pairs[0]].tolist(), ids[pairs[1]].tolist()))


def test_links_do_not_depend_on_the_size_of_runs(spark, monkeypatch):
    # Long bands: most similar pairs share one bucket only, which a finer bucket would lose.
    cfg, rng = neardup.NearDuplicates(percent=80, miss=0.5), random.Random(11)
    base, texts = prose(150, 300).split(), []
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(150), rng.choice((1, 2, 2, 3, 3))):
            copy[k] = f"edit{rng.random()}"
        texts.append((i, " ".join(copy)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    whole = {r.doc_id: r.component_id for r in neardup.link(df, cfg).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 3)
    assert {r.doc_id: r.component_id for r in neardup.link(df, cfg).collect()} == whole
    assert 1 < len(set(whole.values())) < 60


def test_runs_of_a_bucket_hold_every_pair_of_components_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    component = {i: i if i < 11 else 11 if i < 40 else 40 for i in range(60)}
    mixed = spark.createDataFrame([(7, i, 100, c) for i, c in component.items()], "bucket bigint, id bigint, n bigint, component bigint")
    sketches = spark.createDataFrame([(i, bytes(232) + bytes(rng % 256 for rng in range(i, i + 20))) for i in component], "id bigint, sketch binary")
    # All estimates are uncertain, so every pair of two components is listed.
    cells = neardup._compared(neardup._placed(mixed), sketches, neardup.NearDuplicates(percent=92), neardup.QUOTAS[-1]).collect()
    seen = sorted((r.ids[x], r.ids[y]) for r in cells for x, y in zip(r.i, r.j))
    assert seen == [(a, b) for a in component for b in component if a < b and component[a] != component[b]]
    assert len({r.cell for r in cells}) > 20 and max(len(r.ids) for r in cells) <= 8 * 4


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 101), (None, 3)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[101] == got[200] == 100
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_decontamination_finds_copies_and_edits(spark, odd, nothing):
    item = prose(40, 77)
    edited = item.split()
    edited[7], edited[21] = "changed", "words"
    del edited[30]
    rows = [(1, prose(100, 1)), (2, prose(50, 2) + " " + item.upper() + " " + prose(30, 3)), (3, " ".join(edited)), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(9, item), (10, None), (11, "short"), (9, item)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.matches(docs, items).collect()}
    assert set(got) == {(2, 9), (3, 9)} and got[2, 9] == 1.0 and 0.8 < got[3, 9] < 1.0
    assert decontaminate.matches(nothing, items).count() == 0
    assert decontaminate.matches(docs, items.where("false")).count() == 0
    assert decontaminate.matches(odd, items).count() == 0


def test_decontamination_does_not_depend_on_other_documents(spark):
    item = prose(14, 78)
    edited = item.split()
    edited[3], edited[8], edited[12] = "x1", "x2", "x3"  # one n-gram of four words is left
    rows = [(1, prose(30, 1) + " " + " ".join(edited) + " " + prose(30, 2))]
    rows += [(i, prose(20, i) + " " + item) for i in range(2, 8)]
    items = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    every, one = (
        {(r.doc_id, r.item_id): r for r in decontaminate.matches(spark.createDataFrame(part, "doc_id bigint, text string"), items).collect()}
        for part in (rows, rows[:1])
    )
    assert set(every) == {(i, 9) for i in range(1, 8)} and every[1, 9] == one[1, 9]
    assert (every[1, 9].score, every[1, 9].start, every[1, 9].end) == (round(9.5 / 14, 6), 30, 44)
    assert (every[2, 9].start, every[2, 9].end) == (20, 34)


def test_alignment_equals_plain_smith_waterman():
    rng, cfg = np.random.default_rng(4), decontaminate.Decontamination()
    for _ in range(30):
        a, b = rng.integers(1, 5, 9).astype(np.uint64), rng.integers(1, 5, 14).astype(np.uint64)
        h = np.zeros((10, 15))
        for i in range(1, 10):
            for j in range(1, 15):
                step = 1 if a[i - 1] == b[j - 1] else -cfg.mismatch
                h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] - cfg.gap, h[i, j - 1] - cfg.gap)
        assert decontaminate.align(a, b[None, :], cfg)[0][0] == pytest.approx(h.max())


def test_alignment_start_is_traced():
    rng, cfg = np.random.default_rng(5), decontaminate.Decontamination()
    for _ in range(200):
        a, b = rng.integers(1, 5, 9).astype(np.uint64), rng.integers(1, 5, 14).astype(np.uint64)
        best, end, last = (int(x[0]) if k else float(x[0]) for k, x in enumerate(decontaminate.align(a, b[None, :], cfg)))
        if not best:
            continue
        score, begins = np.zeros((10, 15)), [[{j} for j in range(15)] for _ in range(10)]
        for i in range(1, 10):
            for j in range(1, 15):
                step = 1 if a[i - 1] == b[j - 1] else -cfg.mismatch
                ways = [(score[i - 1, j - 1] + step, begins[i - 1][j - 1]), (score[i - 1, j] - cfg.gap, begins[i - 1][j])]
                ways += [(score[i, j - 1] - cfg.gap, begins[i][j - 1]), (0, {j})]
                score[i, j] = max(w for w, _ in ways)
                begins[i][j] = set().union(*(x for w, x in ways if w == score[i, j]))
        assert score[last, end] == best == score.max()
        assert decontaminate.alignment_start(a, b, end, last, cfg) in begins[last][end]


def test_decontamination_keeps_items_of_one_id_and_null_ids_apart(spark):
    one, two, three = prose(30, 501), prose(30, 502), prose(30, 503)
    edited = ("new words here " + one).split()
    del edited[13], edited[20]
    rows = [(1, prose(20, 1) + " " + one), (2, two), (None, three), (4, " ".join(edited)), (4, prose(9, 4)), (6, one + " " + one)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    items = spark.createDataFrame([(9, one), (9, two), (None, three), (9, one)], "item_id bigint, text string").withColumn("start", F.lit(0))
    got = {(r.doc_id, r.item_id): (r.score, r.start, r.end) for r in decontaminate.matches(docs, items).collect()}
    assert got == {
        (1, 9): (1.0, 20, 50), (2, 9): (1.0, 0, 30), (None, None): (1.0, 0, 30), (4, 9): (0.9, 3, 31), (6, 9): (1.0, 0, 30),
    }


def test_repeated_passages(spark, odd, nothing):
    passage = prose(55, 1000)
    rows = [(i, f"{prose(30 + i, i)} {passage} {prose(20, 90 + i)}") for i in range(1, 7)] + [(50, prose(200, 50)), (51, None), (52, "")]
    rows.append((60, f"{prose(40, 60)}\n{prose(60, 61)}\n{prose(60, 61)}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start", F.lit(0))
    found = substrings.passages(docs)
    got = {r.doc_id: r for r in found.collect()}
    assert set(got) == set(range(1, 7)) and {k for k, r in got.items() if not r.removed} == {1}
    text = dict(rows)
    assert all(text[k][r.start : r.end] in passage and r.n_words >= 20 for k, r in got.items())
    cut = {r.doc_id: r.text for r in substrings.without(docs, found).collect()}
    assert cut[1] == text[1] and cut[51] is None and len(cut[2]) == len(text[2]) - (got[2].end - got[2].start)
    assert substrings.passages(nothing).count() == 0
    substrings.passages(odd).collect()


def test_every_repeated_chunk_stays_in_one_document(spark):
    """Random documents made of overlapping parts; document 1 holds X, the next ones X Y, and so on."""
    rng = random.Random(12)
    parts = [prose(30, 200 + k) for k in range(12)]
    rows = [(1, parts[0]), (2, f"{parts[0]} {parts[1]}"), (3, f"{parts[0]} {parts[1]}")]
    rows += [(i, " ".join(rng.choices(parts, k=rng.randint(1, 6)))) for i in range(4, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substrings.passages(docs)
    cuts, gone, left = {}, set(), set()
    for r in found.where("removed").collect():
        cuts.setdefault(r.doc_id, []).append((r.start, r.end))
    assert cuts
    for c in substrings.chunks(docs).collect():
        removed = any(a <= c.start and c.end <= b for a, b in cuts.get(c.doc_id, ()))
        (gone if removed else left).add(c.digest)
    assert gone and gone <= left
    assert len(substrings.without(docs, found).where("length(text) > 0").collect()) > 3


def test_distinct_table_keeps_the_older_half():
    from bitextspark.llm.tables import DistinctTable

    asked = []
    table = DistinctTable(lambda s: asked.append(list(s)) or [[len(x), 7] for x in s], limit=10, limit_bytes=2000)
    rng = random.Random(1)
    for k in range(60):
        texts = [["common", *(f"x{rng.randint(0, 400)}" for _ in range(5))], [], ["y" * rng.choice([1, 50, 3000])]]
        flat, bounds = table.join(texts)
        assert flat.tolist() == [v for t in texts for x in t for v in (len(x), 7)] and bounds.tolist() == [0, 12, 12, 14]
        assert len(table.codes) <= 20
    assert sum("common" in a for a in asked) < 45
    table.release()
    assert not table.codes and table.used == 0


def test_licences(spark, odd, nothing):
    rows = [
        (1, "Under the MIT License. under the mit license"), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, "MIT License"),
        (5, "This work is licensed under the GNU General Public License, version 3."), (6, "sauber mit license" + " x" * 5000), (7, "under the mit licensed"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    templates = licences.BASE + licences.NOTICES
    index = licences.build_index(licences.document_frequencies(docs, templates), 7, templates)
    got = {r.doc_id: r for r in licences.summarise(licences.scan(docs, index), index, ["doc_id"]).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 0, 4, "mit")
    assert got[2].labels == "cc-by-nc" and got[2].score == 1.0 and got[5].labels == "gpl-3" and got[5].base_labels == ""
    assert (got[3].n_words, got[3].labels, got[3].first_word) == (0, "", None)
    assert got[4].labels == "mit" and got[6].n_words == 5003 and got[7].labels == ""
    assert licences.scan(odd, index).count() == 8 and licences.scan(nothing, index).count() == 0


def test_licence_places_equal_brute_force(spark):
    templates = licences.BASE + licences.NOTICES
    rng = random.Random(33)
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = []
    for i in range(120):
        out = []
        while len(out) < 60:
            t = rng.choice(templates)
            a, b = sorted((rng.randint(0, len(t.words)), rng.randint(0, len(t.words))))
            out += t.words if rng.random() < 0.4 else t.words[a:b] if rng.random() < 0.7 else [rng.choice(vocabulary)]
        rows.append((i, " ".join(out[rng.randint(0, 8) :])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = licences.build_index(licences.document_frequencies(docs, templates), len(rows), templates)
    assert all(1 < len({w for w, _ in p}) for p in index.postings)
    got = {r.doc_id: sorted((h.template, h.start, round(h.score, 9)) for h in r.hits) for r in licences.scan(docs, index).collect()}
    for i, text in rows:
        w, want = text.split(), []
        for number, t in enumerate(templates):
            for s in range(-len(t.words), len(w)):
                if all(s + at >= 0 and w[s + at : s + at + len(k)] == k for at, k in t.key_spans()):
                    equal = sum(s + j >= 0 and w[s + j : s + j + 1] == [x] for j, x in enumerate(t.words))
                    want.append((number, s, round(equal / len(t.words), 9)))
        assert got[i] == sorted(want)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b\\\\", "<\\s>", "", None, "line\nline", "<s>", "é😀"]
    rows = [(1, t, ["system", "user", "assistant", "us\ner", None, "<s>"][t % 6], nasty[t % 8]) for t in range(24)]
    rows += [(2, 0, "user", "only"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (None, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("prompt", F.lit(1))
    made = chat.examples(df)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    want = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in rows[:24])
    assert got[1].turns_text == want and got[1].n_turns == 24
    assert got[1].loss_text == "".join(t or "" for _, _, r, t in rows[:24] if r == "assistant")
    assert (got[2].loss_text, got[2].n_turns, got[3].loss_text, got[None].n_turns) == ("", 1, "bb", 1)
    assert made.where("conv_id = 3").count() == 2
    assert chat.read_back(chat.examples(df.where("false"))).count() == 0


def test_bloom_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 7 = 0")
    cascade = urls.Cascade(spark, universe.unionByName(universe.limit(5)), listed)
    judged = universe.select("key", cascade.contains(F.col("key")).alias("hit"))
    assert len(cascade.levels) > 2
    assert judged.where("hit <> (hash(key) % 7 = 0)").count() == 0
    empty = urls.Cascade(spark, universe, listed.where("false"))
    assert universe.where(empty.contains(F.col("key"))).count() == 0


def test_url_rules(spark):
    rules = [urls.Rule("org", "/", "allow"), urls.Rule("example.org", "/es/", "block")]
    rows = [(1, "http://A.Example.ORG/es/x?q"), (2, "http://badexample.org/es/"), (3, None), (4, "nothing"), (5, "x://spam.net:80#f"), (6, "http://a.b.spam.net/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    listed = spark.createDataFrame([("spam.net",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules, listed).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2][2:] == ("org/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][3] == "allow" and got[6] == ("a.b.spam.net", "/", None, "block")
    assert urls.judge(pages.where("false"), rules, listed).count() == 0


def test_hashes_do_not_depend_on_the_block():
    column = pa.array(["alpha beta gamma", None, "delta", "beta"])
    all_at_once = {bytes(b.data[s:e]): h for b in words.blocks(column) for w in [words.words(b, True)] for s, e, h in zip(w.start, w.end, w.hash)}
    one_by_one = {bytes(b.data[s:e]): h for b in words.blocks(column, 1) for w in [words.words(b, True)] for s, e, h in zip(w.start, w.end, w.hash)}
    assert all_at_once == one_by_one and len(all_at_once) == 4


def test_pipeline_equals_brute_force(spark, tmp_path):
    item = prose(40, 77)
    texts = {i: prose(80, i) for i in range(1, 9)}
    texts[11] = texts[1] + " more"
    texts[12] = prose(60, 12) + " " + item
    texts[13], texts[14], texts[15] = "too short", None, "again and again " * 40
    texts[16] = prose(70, 16) + " mail a.b@x.example.com now"
    rows = [(i, t, None, "src", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: texts[i] for i in [*range(1, 9), 16]}
    want[16] = want[16].replace("a.b@x.example.com", "[EMAIL]")
    assert set(got) == set(want)
    assert all(got[i].ids == model.encode(t) and got[i].round_trip for i, t in want.items())


def test_chunks_of_a_block_are_asked_once_each():
    """White space of every kind, empty and odd texts between plain ones: the ids of the whole library."""
    coder = tokenfile.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rows = ["  Two  two\t\nTWO\x0b\x0cÉté été don't, 3x  ", "", None, "ein Wort   x", " ", "two été", "日本 two", "\x1ctwo\x85 ÷×"]
    asked: list[str] = []

    class Codes(dict):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    coder.chunks.codes = Codes()
    (block,) = list(words.blocks(pa.array(rows)))
    flat, bounds = coder.encode(block)
    got = [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [coder._whole([r or ""])[0] for r in rows]
    assert len(asked) == len(set(asked)) and "two" in asked
