"""SimHash near duplicates: fingerprints of word shingles, linked by pigeonring filtering.

A fingerprint is cut into eight segments of eight bits that form a ring. If two fingerprints
differ in at most three bits, then some segment starts a chain around the ring in which the
first l segments together differ in at most 3 * l / 8 bits, for every l from 1 to 8 (the
pigeonring principle). In whole bits: nothing in the first two segments, at most one bit in the
first five, at most two in the first seven, at most three in all.

1. Equal fingerprints are one class, so copies cost no comparison.
2. The first five segments of such a chain hold at most one differing bit, so its first two
   segments and two of the next three agree exactly. These 32 bits are the key of a bucket: 24
   keys a fingerprint (eight starts, three choices).
3. Inside a bucket, pairs pass the chain of five segments, then that of seven, then the
   full count of differing bits. Pairs stay inside the task; a bucket returns links from each
   member to the smallest one it is linked with.
4. A bucket of more than `BLOCK` members is never compared as a whole: the bits that vary in it are
   cut into four parts, one of which must agree in each linked pair, and its members are dealt to
   finer buckets by each part; again, while some bucket is too large. Members are distinct
   fingerprints, so this ends at the latest when three bits vary (at most eight members). No
   pair is lost and no member is sent to all others.
5. Links are joined to components over distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextspark.llm.components import _store, connected
from bitextspark.llm.grouped import component_labels, whole_groups
from bitextspark.scale import broadcast_if_small

SHINGLE = 3
DISTANCE = 3
#: Fixed value: seed of the shingle hash.
SEED = 42
#: Members of a bucket that are compared with each other in one task.
BLOCK = 4096
SEGMENTS = 8
#: Hashes of one text that are counted at a time.
_SLICE = 1 << 16
_KEYS = "start int, mask bigint, bits bigint, fingerprint bigint"


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of one text, repeats included.

    Words are runs between ASCII white space, with A-Z lower-cased. A text with fewer words has its
    whole word sequence as its only shingle; a text without words (or null) has none and gets 0.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    totals = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _SLICE):
        spans = zip(starts[at : at + _SLICE].tolist(), ends[at : at + _SLICE].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * totals > len(starts), bitorder="little")
    return int(ones.view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(id, fingerprint)` for every row; the fingerprint as a signed number of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fingerprint"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, fingerprint bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _segments(start: int, places: tuple[int, ...]) -> int:
    """Mask of the segments `places` counted around the ring from `start`."""
    return sum(0xFF << 8 * ((start + p) % SEGMENTS) for p in places)


def _chain(start: int, length: int) -> int:
    return _segments(start, tuple(range(length)))


def first_keys(distinct: DataFrame) -> DataFrame:
    """`_KEYS` of each fingerprint: 24 rows."""
    choices = [(s, _signed(_segments(s, (0, 1, *two)))) for s in range(SEGMENTS) for two in ((2, 3), (2, 4), (3, 4))]
    keys = F.array(
        *[
            F.struct(F.lit(s).alias("start"), F.lit(m).cast("bigint").alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("bigint")).alias("bits"))
            for s, m in choices
        ]
    )
    return distinct.select(F.inline(keys), "fingerprint")


def varying_parts(varying: int) -> list[int]:
    """The bits that vary in a bucket in four parts; a linked pair agrees on one of them."""
    bits = [b for b in range(64) if varying >> b & 1]
    return [sum(1 << b for b in bits[k :: DISTANCE + 1]) for k in range(DISTANCE + 1)]


def _finer(members: DataFrame) -> DataFrame:
    """`_KEYS` of the finer buckets of `members`, which have `varying` besides `_KEYS`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, mask, fp, varying = (batch.column(c).to_numpy() for c in ("start", "mask", "fingerprint", "varying"))
            for one in np.unique(varying):
                at = np.flatnonzero(varying == one)
                for part in varying_parts(int(one) & (1 << 64) - 1):
                    finer = mask[at] | np.int64(_signed(part))
                    columns = [start[at], finer, fp[at] & finer, fp[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["start", "mask", "bits", "fingerprint"])

    return members.mapInArrow(run, _KEYS).distinct()


def near_pairs(start: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs within groups of `values` (unsigned), by ever longer chains.

    All groups are compared together: each value with the one k places after it in its group.
    """
    chains = [np.array([_chain(s, n) for s in range(SEGMENTS)], dtype=np.uint64) for n in (5, 7, SEGMENTS)]
    end = np.repeat(bounds[1:], np.diff(bounds))
    here = np.arange(len(values))
    k = 1
    while True:
        here = here[here + k < end[here]]
        if not len(here):
            return
        a, b = here, here + k
        for chain, most in zip(chains, (1, 2, DISTANCE)):
            near = np.bitwise_count((values[a] ^ values[b]) & chain[start[a]]) <= most
            a, b = a[near], b[near]
        if len(a):
            yield a, b
        k += 1


def _links(keys: DataFrame) -> DataFrame:
    """`(a, b)`: each member of a bucket with the smallest fingerprint that it is linked with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ("start", "mask", "bits")):
            signed = table.column("fingerprint").to_numpy()
            label = np.arange(len(signed))
            parts: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            for a, b in near_pairs(table.column("start").to_numpy(), signed.view(np.uint64), bounds):
                parts.append((a, b))
                held += len(a)
                if held > 1 << 20:
                    parts = [_shrunk(len(signed), parts)]
                    held = 0
            if parts:
                label = component_labels(len(signed), *map(np.concatenate, zip(*parts)))
            linked = np.flatnonzero(label != np.arange(len(signed)))
            yield pa.RecordBatch.from_arrays([pa.array(signed[label[linked]]), pa.array(signed[linked])], names=["a", "b"])

    placed = keys.repartition("start", "mask", "bits").sortWithinPartitions("start", "mask", "bits")
    return placed.mapInArrow(run, "a bigint, b bigint")


def _shrunk(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    label = component_labels(n, *map(np.concatenate, zip(*parts)))
    linked = np.flatnonzero(label != np.arange(n))
    return label[linked], linked


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links `(a, b)` that connect all fingerprints of `distinct(fingerprint)` which differ in at
    most three bits: the same components as all such pairs, but not every pair."""
    if block < 1 << DISTANCE:
        raise ValueError("a bucket of eight members cannot be cut further")
    keys, found = first_keys(distinct), []
    by = ["start", "mask", "bits"]
    while True:
        varying = F.bit_or("fingerprint").bitwiseXOR(F.bit_and("fingerprint"))
        sizes = keys.groupBy(by).agg(F.count(F.lit(1)).alias("size"), varying.alias("varying"))
        hot = _store(sizes.where(F.col("size") > block).drop("size"), "hot")
        if hot.isEmpty():
            found.append(_store(_links(keys), "links"))
            break
        named = broadcast_if_small(hot)
        found.append(_store(_links(keys.join(named, by, "left_anti").select(*keys.columns)), "links"))
        keys = _store(_finer(keys.join(named, by).select(*keys.columns, "varying")), "finer")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """`(doc_id, fingerprint, component_id)` for every row of `docs`.

    `fingerprint` has 16 hex digits. Null, empty and blank texts have fingerprint zero and are
    linked like any other. `component_id` is the smallest id that is reachable; rows with a null id
    are linked too and get the component of their fingerprint, which is null if no row of it has an
    id. Rows with one id keep a row each. Other columns are not read; an empty table gives no rows.
    """
    prints = _store(fingerprints(docs, doc_id, text), "fingerprints")
    classes = _store(prints.groupBy("fingerprint").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")), "classes")
    joined = _store(connected(links(classes.select("fingerprint"), block)), "components")
    named = classes.join(joined.withColumnRenamed("id", "fingerprint"), "fingerprint", "left")
    named = named.withColumn("component", F.coalesce("component", "fingerprint"))
    smallest = named.where("component <> fingerprint OR size > 1 OR id IS NULL").select("component").distinct()
    smallest = named.join(smallest, "component").groupBy("component").agg(F.min("id").alias("component_id"))
    table = _store(named.select("fingerprint", "component").join(smallest, "component").drop("component"), "named")
    return prints.join(broadcast_if_small(table), "fingerprint", "left").select(
        F.col("id").alias(doc_id),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
