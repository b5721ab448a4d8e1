"""Ranked search over K2-treaps against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bitextspark.llm import treap

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=50):
    counts = [(key, Counter(terms(text))) for key, text in docs]
    counts = [(key, c) for key, c in counts if c]
    N, L = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counts:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * N) // L
            score = sum(
                math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def texts(rng, n):
    words = ["été", "日本", "A1", *(f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(400))]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 200]))) for _ in range(n)]


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    docs = list(enumerate(texts(rng, 300)))
    docs += [(i, docs[7][1]) for i in range(1000, 1100)] + [(None, docs[7][1]), (None, "w1 only null"), (3, docs[3][1]), (400, None), (401, ""), (402, " -.- ")]
    docs += [(500, " ".join(["long"] * 400_000 + ["w1"]))]
    items = [(1, docs[7][1]), (2, "W1, w1; É-absent"), (3, None), (4, "--"), (5, "nowhere"), (None, "w2 w3"), (2, "w5 日本 été"), (6, "long")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit(1)).withColumn("item_id", F.lit("x"))
    queries = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit(1)).withColumn("doc_id", F.lit(1))
    want = brute(docs, items)
    assert rows(treap.rank(df.repartition(3), queries)) == want
    monkeypatch.setattr(treap, "COLUMNS", 16)  # many blocks
    monkeypatch.setattr(treap, "PACK_BYTES", 100)  # several passes
    assert rows(treap.rank(df.repartition(2), queries)) == want
    assert rows(treap.rank(df, queries, k=3)) == brute(docs, items, 3)
    assert treap.rank(df.where("doc_id = 400"), queries).count() == 0
    assert treap.rank(df, queries.where("item_id = 77")).count() == 0


def test_quadtree_gives_back_every_point():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (5, 900), (900, 5), (64, 64)):
        row, column = np.divmod(rng.choice(shape[0] * shape[1], size=max(1, shape[0] * shape[1] // 3), replace=False), shape[1])
        value = rng.integers(1, 1 << 20, len(row))
        row_bits, column_bits = treap._bits(shape[0]), treap._bits(shape[1])
        children, maxima = treap.quadtree(row, column, value, row_bits, column_bits)
        stored = {
            "ids": np.arange(shape[1], dtype="<i8").tobytes(), "terms": np.arange(shape[0], dtype="<u8").tobytes(),
            "row_bits": row_bits, "column_bits": column_bits,
            "children": [treap._packed(c) for c in children], "maxima": [m.tobytes() for m in maxima],
        }
        block = treap.Treap(stored)
        want = {(r, c): v for r, c, v in zip(row.tolist(), column.tolist(), value.tolist())}
        for r in range(shape[0]):
            best = treap.Best(10**6)
            block.search(np.array([r]), np.array([1]), best)
            assert {(r, c): v for c, v in zip(best.ids.tolist(), best.scores.tolist())} == {k: v for k, v in want.items() if k[0] == r}
            few = treap.Best(2)
            block.search(np.array([r]), np.array([1]), few)
            assert few.scores.tolist() == best.scores.tolist()[:2] and few.ids.tolist() == best.ids.tolist()[:2]


def test_term_names_follow_the_documented_words():
    names = treap._term_names(["A b", "a B b", None, "É", "é"])
    assert names[0].tolist() == names[1].tolist() and len(names[2]) == 0 and names[3].tolist() != names[4].tolist()
    assert len(pa.array(names[0])) == 2


def test_an_index_row_is_a_row_group(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.range(3 * treap.COLUMNS, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word " * 40), "id").alias("text"))
    treap.write(docs, str(tmp_path / "index"))
    found = [pq.ParquetFile(f).metadata for f in (tmp_path / "index").glob("*.parquet")]
    sizes = [m.row_group(g).num_rows for m in found for g in range(m.num_row_groups)]
    assert len(sizes) >= 2 and set(sizes) == {1}
