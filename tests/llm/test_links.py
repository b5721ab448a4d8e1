"""SimHash links and spelling variants against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bitextspark.llm import simhash, spelling


def brute_fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, near):
    """Smallest node that each node reaches."""
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in nodes}


def test_fingerprints_equal_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "One", "one TWO", "É é A b c", "a b c " * 40, "x" * 300_000, " ".join(map(str, range(100_000)))]
    texts += [" ".join(rng.choice(["ab", "Cd", "é", "日本"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def _planted(rng, n):
    """Random fingerprints, and chains around some of them with up to four bits changed."""
    out = []
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5])):
            out.append(x)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_links_connect_what_all_pairs_connect(spark, block):
    rng = random.Random(block)
    values = sorted(set(_planted(rng, 250)) | {rng.getrandbits(9) << 20 for _ in range(150)} | {0, 1, 7, 15, (1 << 64) - 1})
    signed = [simhash._signed(v) for v in values]
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3]
    want = components(signed, [(simhash._signed(a), simhash._signed(b)) for a, b in near])
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint bigint"), block=block).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() >= 1 for r in found)
    assert components(signed, [(r.a, r.b) for r in found]) == want


def test_every_linked_pair_has_a_common_key():
    rng = random.Random(8)
    masks = [simhash._segments(s, (0, 1, *two)) for s in range(8) for two in ((2, 3), (2, 4), (3, 4))]
    assert len(set(masks)) == 24
    for _ in range(2_000):
        difference = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not difference & m for m in masks)
        varying = difference | rng.getrandbits(64) & rng.getrandbits(64)
        parts = simhash.varying_parts(varying)
        assert sum(parts) == varying and any(not difference & p for p in parts)


def test_simhash_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, 1), (3, base + " more", 2), (9, base, 3), (9, base, 3), (1, None, 4), (2, "", 5), (7, " \n", 6), (None, base, 7), (None, "alone here now", 8), (4, "other text of few words", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint int")
    got = simhash.link(docs).collect()
    assert len(got) == len(rows)
    prints = {r[1]: brute_fingerprint(r[1]) for r in rows}
    near = [(a[0], b[0]) for a in rows for b in rows if None not in (a[0], b[0]) and (prints[a[1]] ^ prints[b[1]]).bit_count() <= 3]
    want = components({r[0] for r in rows if r[0] is not None}, near)
    assert want[2] == want[7] == 1 and want[9] == want[5] == 3
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted([str(want[5]), "None"])
    assert {(r.doc_id, r.fingerprint) for r in got} == {(r[0], f"{prints[r[1]]:016x}") for r in rows}
    assert simhash.link(docs.where("doc_id = 100")).count() == 0


def test_whole_table_of_fingerprints(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in simhash.link(docs).collect()}
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = components(prints, near)
    assert {k: (int(r.fingerprint, 16), r.component_id) for k, r in got.items()} == {k: (prints[k], want[k]) for k in prints}


def brute_variants(docs, min_length=6, min_count=5, ratio=5):
    import re

    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, c in words.items():
        mine = [v for v in words if v != w and near(v, w)]
        best = min(mine, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * c else None
        out[w] = [form, None, c, len(mine), words[form] if form else None]
    for w in words:
        end = w
        while out[end][0]:
            end = out[end][0]
        out[w][1] = end
    return {w: tuple(v) for w, v in out.items()}


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    stems = ["colour", "Éclairs", "thandle", "restion", "aaaaaaa", "ouble÷x", "anding"]
    letters = "abcé"

    def edited(w):
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
        return w

    docs = [(i % 90 if i % 10 else None, ", ".join(edited(rng.choice(stems)) for _ in range(60)) or None) for i in range(120)]
    docs += [(1000, None), (1001, ""), (1002, " 12 -- "), (1003, "y" * 5000 + " z " + " ".join(["q" * 7000] * 5 + ["q" * 7001] * 25 + ["w" * 70] * 5 + ["w" * 71] * 25 + ["w" * 72] * 125)), (5, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("word", F.lit(1)).withColumn("block", F.lit(2))
    want = brute_variants(docs)
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[1] not in (w, v[0]) for w, v in want.items())
    assert rows_of(spelling.variants(df)) == want
    monkeypatch.setattr(spelling, "TILE", 3)  # many tiles
    assert rows_of(spelling.variants(df)) == want
    assert spelling.variants(df.where("doc_id = 77777")).count() == 0


def test_variants_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(spelling.variants(docs)) == brute_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_gram_products_keep_every_near_pair():
    rng = random.Random(6)
    short = sorted({"".join(rng.choice("abÿ") for _ in range(6)) for _ in range(200)})
    longer = sorted({"".join(rng.choice("abÿ") for _ in range(7)) for _ in range(300)})
    i, j = spelling.near_positions(spelling.letter_codes(short), spelling.letter_codes(longer))
    want = {(a, b) for a, s in enumerate(short) for b, t in enumerate(longer) if any(t[:k] + t[k + 1 :] == s for k in range(7))}
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) > 100
    assert np.array_equal(spelling.letter_counts(spelling.letter_codes(["aab"]))[0, :3], [2, 1, 0])
