"""Near-duplicate documents: SuperMinHash signatures, banding, verification, components.

SuperMinHash gives each element a random permutation of the signature's slots and, at rank
j of that permutation, a value in [j, j + 1); a slot keeps its smallest value. Values of
rank j are below all values of rank j + 1, so the ranks are worked off level by level for
all documents of a block together, and a document is finished at the first level after
which none of its slots is empty: two or three levels for ordinary texts.

Links are found in four steps.
1. Documents with equal shingle sets (128-bit digest) form a class; its smallest id stands
   for it from here on, so a group of exact copies costs no comparison.
2. Bands of the signature are buckets. Each bucket compares its members with its smallest
   id only: as many pairs as members, never all pairs.
3. Compared pairs are confirmed on full shingle sets.
4. What is left are buckets whose other members are not in one component yet. Their
   signatures (a byte for each slot) are compared inside the task, and pairs whose
   estimate comes near the threshold are confirmed on full sets as well. These pairs are
   never rows: a bucket lists them in cells of bounded size, each set is sent once to every
   cell that needs it, and only confirmed links come out. A round takes first the most
   similar one of each member, and more (`QUOTAS`, at last all) only where components
   still meet in a bucket, so a group of linked copies needs few pairs. The members
   of a bucket are cut into runs of about `BLOCK`, a component of more members having runs of
   its own, and each two runs are compared in a task of their own. Runs of one component
   are not compared, so a large group of linked copies meets the few others once; members
   that no link joins are all compared with each other, whatever the size of the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitextspark.llm.components import _store, connected, extended
from bitextspark.llm.words import blocks, mix, window_hash, words
from bitextspark.scale import broadcast_if_small

SLOTS = 252
_SALT = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Explicit permutations are kept for so many elements at a time.
_SLICE = 20_000
_REPLAYED = 6
#: Members of a run (about): a task compares two runs of a bucket at a time.
BLOCK = 1024
#: Pairs of a member in each round of comparisons; the last round takes all.
QUOTAS = (1, BLOCK)
#: Shingles of one half of a cell (8 bytes each): a task holds two halves at a time.
HALF = 2_000_000


@dataclass(frozen=True)
class NearDuplicates:
    """`percent`: links need 100 * intersection >= percent * union of `shingle`-word shingles.

    `rows` per band is the largest number at which a pair exactly at the threshold is missed
    by all bands with a probability of at most `miss`.
    """

    percent: int = 80
    shingle: int = 5
    slots: int = SLOTS
    miss: float = 1e-5

    @property
    def margin(self) -> float:
        """4.5 standard deviations of an estimate at the threshold."""
        s = self.percent / 100
        return 4.5 * (s * (1 - s) / self.slots) ** 0.5

    @property
    def rows(self) -> int:
        s = self.percent / 100
        return max([1, *(r for r in range(1, 33) if (1 - s**r) ** (self.slots // r) <= self.miss)])


def shingle_sets(block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, flat, and the bounds of each row.

    A row with fewer words than `size` has its whole word sequence as its only shingle; a
    row without words has none.
    """
    w = words(block, lower=True)
    at, hashes = window_hash(w, size)
    row = w.row[at]
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        total = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            value = w.hash[np.minimum(w.first[short] + k, len(w.hash) - 1)]
            total = total * _SALT + np.where(has, value, np.uint64(k + 1))
        hashes = np.concatenate([hashes, mix(total)])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        hashes, row = hashes[order], row[order]
    edges = np.searchsorted(row, np.arange(block.rows + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    bounds = np.zeros(block.rows + 1, dtype=np.int64)
    np.cumsum(np.bincount(row[fresh], minlength=block.rows), out=bounds[1:])
    return hashes[fresh], bounds


def _draw(elements: np.ndarray, level: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """At one level: the slot index swapped to the front, and the value of that level."""
    h = mix(elements + np.uint64((level + 1) * int(_SALT) % (1 << 64)))
    k = (h >> np.uint64(40)) % np.uint64(slots - level) + np.uint64(level)
    value = (np.uint64(level) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
    return k.astype(np.int64), value


def super_minhash(elements: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (rows x slots) of sets given flat with bounds; an empty set stays empty."""
    rows = len(bounds) - 1
    sig = np.full(rows * slots, _EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(bounds))
    draws: list[np.ndarray] = []
    level = 0
    while len(elements) and level < min(_REPLAYED, slots):
        k, value = _draw(elements, level, slots)
        place = k
        for earlier in range(level - 1, -1, -1):  # undo the swaps of the permutation so far
            place = np.where(draws[earlier] == place, earlier, place)
        draws.append(k)
        at = owner * slots + place
        free = sig[at] == _EMPTY  # filled at a lower level, it is final
        np.minimum.at(sig, at[free], value[free])
        level += 1
        unfinished = (sig.reshape(rows, slots) == _EMPTY).any(axis=1)
        go = unfinished[owner]
        if not go.all():
            elements, owner, draws = elements[go], owner[go], [d[go] for d in draws]
    # Few elements are left, those of short documents: keep their permutations explicitly.
    starts = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else np.zeros(0, np.int64)
    cuts = [0] if len(owner) else []
    for s in starts[1:]:
        if s - cuts[-1] >= _SLICE:
            cuts.append(int(s))
    for a, b in zip(cuts, [*cuts[1:], len(owner)]):
        _finish(sig, elements[a:b], owner[a:b], [d[a:b] for d in draws], slots)
    return sig.reshape(rows, slots)


def _finish(sig: np.ndarray, elements: np.ndarray, owner: np.ndarray, draws: list[np.ndarray], slots: int) -> None:
    order = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
    every = np.arange(len(elements))
    for level, k in enumerate(draws):
        order[every, k], order[:, level] = order[:, level].copy(), order[every, k].copy()
    for level in range(len(draws), slots):
        if not len(elements):
            return
        k, value = _draw(elements, level, slots)
        every = np.arange(len(elements))
        place = order[every, k].copy()
        order[every, k] = order[:, level]
        order[:, level] = place
        at = owner * slots + place
        free = sig[at] == _EMPTY
        np.minimum.at(sig, at[free], value[free])
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        mine = sig.reshape(-1, slots)[owner[first]]
        go = np.repeat((mine == _EMPTY).any(axis=1), np.diff(np.append(first, len(owner))))
        if not go.all():
            elements, owner, order = elements[go], owner[go], order[go]


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """64-bit key of each band (documents x bands)."""
    bands = sig.shape[1] // rows
    cut = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)) * _SALT
    for r in range(rows):
        total = mix(total + cut[:, :, r])
    return total


FINGERPRINTS = "id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary"


def fingerprints(docs: DataFrame, cfg: NearDuplicates, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`FINGERPRINTS` of every row; null texts count as empty."""
    size, slots, per_band = cfg.shingle, cfg.slots, cfg.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets, bounds = shingle_sets(block, size)
                n = np.diff(bounds)
                sums = []
                for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
                    total = np.zeros(len(sets) + 1, dtype=np.uint64)
                    np.cumsum(mix(sets ^ salt), out=total[1:])
                    sums.append(mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64)).view(np.int64))
                signatures = super_minhash(sets, bounds, slots)
                sketch = (signatures & np.uint64(0xFF)).astype(np.uint8).tobytes()
                keys = band_keys(signatures, per_band)[n > 0]
                ends = np.cumsum(np.concatenate([[0], np.where(n > 0, slots // per_band, 0)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows),
                        pa.array(n, pa.int64()),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
                        pa.array([sketch[slots * i : slots * (i + 1)] for i in range(block.rows)], pa.binary()),
                    ],
                    names=["id", "n_shingles", "d1", "d2", "bands", "sketch"],
                )

    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, FINGERPRINTS)


def _sets(docs: DataFrame, cfg: NearDuplicates) -> DataFrame:
    size = cfg.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets, bounds = shingle_sets(block, size)
                raw = sets.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows),
                        pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()),
                    ],
                    names=["id", "set"],
                )

    return docs.mapInArrow(run, "id bigint, set binary")


def _sets_of(ids: DataFrame, docs: DataFrame, cfg: NearDuplicates) -> DataFrame:
    needed = _store(ids.distinct(), "needed")
    return _store(_sets(docs.join(broadcast_if_small(needed, ()), "id", "left_semi"), cfg), "sets")


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    merged = np.concatenate([one, two])
    merged.sort()
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= percent * (len(merged) - common)


def _confirmed(pairs: DataFrame, docs: DataFrame, cfg: NearDuplicates) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as a written table."""
    pairs = _store(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    ends = [pairs.select(F.col(x).alias("id")).distinct() for x in "ab"]
    sets = _sets_of(ends[0].unionByName(ends[1]), docs, cfg)
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b")
    percent = cfg.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                hit.append(_similar(one, two, percent))
            kept = batch.filter(pa.array(hit, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return _store(both.mapInArrow(run, "a bigint, b bigint"), "confirmed")


def _confirmed_cells(cells: DataFrame, docs: DataFrame, cfg: NearDuplicates) -> DataFrame:
    """The pairs of `CELLS` whose full sets reach the threshold, as a written table of `(a, b)`."""
    listed = cells.select("bucket", "cell", "part", F.explode("ids").alias("id"))
    sets = _sets_of(listed.select("id"), docs, cfg)
    percent = cfg.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple[list[int], list[int], list[int]] = ([], [], [])
        held: dict[int, list[np.ndarray]] = {}

        def links() -> pa.RecordBatch:
            ids, i, j = cell
            near = [
                (ids[x], ids[y])
                for x, y in zip(i, j)
                if any(_similar(p, q, percent) for p in held.get(ids[x], ()) for q in held.get(ids[y], ()))
            ]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in near], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for id, raw, *lists in zip(*(batch.column(c) for c in ("id", "set", "ids", "i", "j"))):
                if id.is_valid:
                    held.setdefault(id.as_py(), []).append(np.frombuffer(raw.as_py(), dtype=np.uint64))
                else:  # the list of a cell comes before its sets
                    yield links()
                    cell, held = tuple(x.as_py() for x in lists), {}
        yield links()

    placed = cells.unionByName(listed.join(sets, "id"), allowMissingColumns=True).repartition("bucket", "cell", "part")
    ordered = placed.sortWithinPartitions("bucket", "cell", "part", F.col("id").asc_nulls_first())
    return _store(ordered.select("id", "set", "ids", "i", "j").mapInArrow(run, "a bigint, b bigint"), "confirmed")


def _leaders(members: DataFrame) -> DataFrame:
    """Members `(bucket, id, n)` of buckets of two or more, with the bucket's smallest id."""
    heads = members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("head"), F.count(F.lit(1)).alias("size"))
    return members.join(heads.where("size > 1").drop("size"), "bucket")


def _close(cfg: NearDuplicates):
    """Sizes that allow the threshold: 100 * smaller >= percent * larger."""
    return 100 * F.least("n", "head.n") >= cfg.percent * F.greatest("n", "head.n")


def _near(
    bucket: int,
    ids: np.ndarray,
    buckets: list,
    run: np.ndarray,
    crossed: bool,
    n: np.ndarray,
    component: np.ndarray,
    sketch: np.ndarray,
    cfg: NearDuplicates,
    quota: int,
) -> np.ndarray:
    """Pairs (two rows of positions) of different components in one cell of a bucket whose
    estimate comes near the threshold, for each member those with its `quota` most similar ones
    (from `BLOCK` on: all). A `crossed` cell has two runs and pairs between them only.

    Pairs are taken from the most similar down. A pair of at least `threshold + margin` is
    sure to be confirmed, so pairs that such pairs connect already are left out. Members
    that share several of their `buckets` are a pair in the smallest one only. Members come
    by id, so pairs have one order in all cells, and what is left out in one is connected by
    earlier pairs that other cells return.
    """
    low, high = cfg.percent / 100 - cfg.margin, cfg.percent / 100 + cfg.margin
    every = quota >= BLOCK
    found: list[np.ndarray] = []
    estimates: list[np.ndarray] = []
    for i in range(len(ids)):
        start = i + 1 if every else 0  # with all pairs, each is met from its smaller end
        fits = (component[start:] != component[i]) & (
            100 * np.minimum(n[start:], n[i]) >= cfg.percent * np.maximum(n[start:], n[i])
        )
        if crossed:
            fits &= run[start:] != run[i]
        other = np.flatnonzero(fits) + start
        if len(other):
            estimate = (sketch[other] == sketch[i]).mean(axis=1)
            if not every:
                best = np.lexsort((ids[other], -estimate))[:quota]
                other, estimate = other[best], estimate[best]
            other, estimate = other[estimate >= low], estimate[estimate >= low]
            found.append(np.stack([np.minimum(other, i), np.maximum(other, i)]).astype(np.int32))
            estimates.append(estimate)
    if not found:
        return np.zeros((2, 0), dtype=np.int32)
    pairs, estimate = np.concatenate(found, axis=1), np.concatenate(estimates)
    if not every:  # two members may have named each other
        _, at = np.unique(pairs[0].astype(np.int64) * len(ids) + pairs[1], return_index=True)
        pairs, estimate = pairs[:, at], estimate[at]
    order = np.lexsort((pairs[1], pairs[0], -estimate))
    pairs, sure = pairs[:, order], estimate[order] >= high
    parent = {c: c for c in component.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    chosen = np.zeros(len(sure), dtype=bool)
    for k in np.flatnonzero(sure).tolist():
        x, y = (root(int(component[p])) for p in pairs[:, k])
        if x != y:
            parent[x] = y
            chosen[k] = True
    roots = np.array([root(c) for c in component.tolist()])
    chosen |= ~sure & (roots[pairs[0]] != roots[pairs[1]])
    pairs = pairs[:, chosen]
    here = [min(buckets[i] & buckets[j]) == bucket for i, j in zip(*pairs.tolist())]
    return pairs[:, np.array(here, dtype=bool)]


CELLS = "bucket bigint, cell bigint, part bigint, ids array<bigint>, i array<int>, j array<int>"


def _cells(pairs: np.ndarray, ids: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of positions cut into cells `(part, ids, i, j)`, `i` and `j` being positions in the
    cell's ids. A cell takes pairs between two runs of members of about `HALF` shingles each
    (or one longer member), so its sets have bounded size."""
    run = (np.cumsum(n) - n) // HALF
    part = run[pairs[0]] * (run[-1] + 1) + run[pairs[1]]
    for p in np.unique(part).tolist():
        mine = pairs[:, part == p]
        used, local = np.unique(mine, return_inverse=True)
        i, j = local.reshape(mine.shape).astype(np.int32)
        yield p, ids[used], i, j


def _compared(members: DataFrame, sketches: DataFrame, cfg: NearDuplicates, quota: int) -> DataFrame:
    """`CELLS` with each near pair once, of buckets of `(id, n, component, place)`; `sketches` has
    `(id, sketch)`."""

    def groups(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            keys, cells = (table.column(c).to_numpy() for c in ("bucket", "cell"))
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (cells[1:] != cells[:-1])))
            yield table.slice(0, int(cuts[-1])), cuts
            held = table.slice(int(cuts[-1])).combine_chunks().to_batches()  # the last cell may go on
        if held:
            table = pa.Table.from_batches(held)
            yield table, np.array([0, table.num_rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in groups(batches):
            if not table.num_rows:
                continue
            names = ("bucket", "cell", "id", "run", "crossed", "n", "component")
            keys, cells, ids, runs, crossed, n, component = (table.column(c).to_numpy() for c in names)
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            out: list[tuple] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                buckets = [set(x) for x in table.column("buckets").slice(a, b - a).to_pylist()]
                own = (x[a:b] for x in (n, component, sketch))
                pairs = _near(int(keys[a]), ids[a:b], buckets, runs[a:b], bool(crossed[a]), *own, cfg, quota)
                out += [(int(keys[a]), int(cells[a]), *cell) for cell in _cells(pairs, ids[a:b], n[a:b])]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = zip(*out) if out else [()] * len(kinds)
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "cell", "part", "ids", "i", "j"])

    # A member's buckets are at most its bands. Exploding them below the repartition matters:
    # after a join on `bucket` Spark would drop the repartition and could then split a cell as
    # a skewed part of that join.
    by_id = members.groupBy("id").agg(
        F.first("n").alias("n"), F.first("component").alias("component"), F.collect_set("place").alias("places")
    )
    one = by_id.join(sketches, "id").withColumn("buckets", F.col("places.bucket")).withColumn("place", F.explode("places"))
    bucket, run_no, runs, skip, until = (F.col(f"place.{x}") for x in ("bucket", "run", "runs", "skip", "until"))
    partner = F.explode(F.filter(F.sequence(F.lit(0).cast("bigint"), runs - 1), lambda k: (k < skip) | (k >= until)))
    met = one.withColumn("partner", partner).select(
        bucket.alias("bucket"),
        (F.least(run_no, "partner") * runs + F.greatest(run_no, "partner")).alias("cell"),
        "id",
        run_no.alias("run"),
        (run_no != F.col("partner")).alias("crossed"),
        "n",
        "component",
        "sketch",
        "buckets",
    )
    return met.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "id").mapInArrow(run, CELLS)


def _mixed(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of the buckets in which components still meet, with `component`."""
    labelled = members.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = labelled.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("mixed"))
    return labelled.join(sizes.where("mixed").drop("mixed"), "bucket")


def _placed(mixed: DataFrame) -> DataFrame:
    """`mixed` with `place`: the bucket, the member's run in it, the number of `runs`, and the runs
    from `skip` to `until` (exclusive), which hold its own component alone."""
    sizes = mixed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    owned = sizes.withColumn("own", F.when(F.col("size") > BLOCK, F.col("component")))  # null: in runs with others
    runs = owned.groupBy("bucket", "own").agg(F.ceil(F.sum("size") / BLOCK).alias("count"))
    whole = W.partitionBy("bucket")
    before = whole.orderBy(F.col("own").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("runs", F.sum("count").over(whole))
    runs = runs.select(F.col("bucket").alias("in"), F.col("own").alias("of"), "count", "first", "runs")
    cut = owned.join(runs, (F.col("bucket") == F.col("in")) & F.col("own").eqNullSafe(F.col("of")))
    until = F.when(F.col("own").isNotNull(), F.col("first") + F.col("count")).otherwise(F.col("first"))
    cut = cut.select("bucket", "component", "count", "first", "runs", until.alias("until"))
    run = F.col("first") + F.pmod(F.xxhash64("id"), F.col("count"))
    place = F.struct("bucket", run.alias("run"), "runs", F.col("first").alias("skip"), "until")
    return mixed.join(cut, ["bucket", "component"]).withColumn("place", place)


def _linked(components: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components `(id, component)` with the links of `found(a, b)`."""
    if components is None:
        return _store(connected(found), "components")
    return components if found.isEmpty() else _store(extended(components, found), "components")


def link(docs: DataFrame, cfg: NearDuplicates = NearDuplicates(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, n_shingles, component_id, kept)` for every row of `docs`.

    Null and empty texts have no shingles and are linked with nothing. Rows with one id
    count as one document. A row whose id is null keeps a null component and is kept. Other
    columns are not read; an empty table gives no rows.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    prints = _store(fingerprints(docs, cfg, doc_id, text), "fingerprints")
    some = prints.where("n_shingles > 0 AND id IS NOT NULL")
    own = F.struct("n_shingles", "bands", "sketch")
    classes = some.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), F.min_by(own, "id").alias("own"))
    reps = _store(classes.select("id", "size", "d1", "d2", F.col("own.n_shingles").alias("n"), "own.bands", "own.sketch"), "classes")
    members = reps.select("id", "n", F.explode("bands").alias("bucket")).distinct()
    met = _store(_leaders(members), "buckets")
    others = met.where(F.col("id") != F.col("head.id"))
    pairs = others.where(_close(cfg)).select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct()
    components = _linked(None, _confirmed(pairs, source, cfg))
    left = others.select("bucket", "id", "n")
    for quota in QUOTAS:
        left = _store(_mixed(left.select("bucket", "id", "n"), components), "open")
        near = _store(_compared(_placed(left), reps.select("id", "sketch"), cfg, quota), "cells")
        if near.isEmpty():
            break
        components = _linked(components, _confirmed_cells(near, source, cfg))
    named = reps.where("size > 1").select("d1", "d2", F.col("id").alias("rep"))
    joined = prints.drop("bands", "sketch").join(named, ["d1", "d2"], "left").withColumn(
        "rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "id")).otherwise(F.col("id"))
    )
    component = F.coalesce("component", "rep")
    return joined.join(components.withColumnRenamed("id", "rep"), "rep", "left").select(
        F.col("id").alias(doc_id),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
