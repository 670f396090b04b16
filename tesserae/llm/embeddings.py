"""Embedding near-duplicates by sorted projection passes.

1. Vectors with equal components collapse to the smallest vec_id, with the number of vec_ids that have them.
2. In each pass a vector's key is the concatenation of 64 random hashes: on which side of the sample's median its
   projection on a random direction lies. Cutting at medians keeps the halves even where vectors crowd in a cone.
   Vectors are ordered by key; those at a small angle share long key prefixes, so they stand close. Each vector is
   compared with those up to a window of ranks before it (its block of the order and the block before); pairs with
   cosine >= the threshold are united, across passes, into components. Passes carry single-precision vectors; a pair
   too near the threshold for them is confirmed apart, from the doubles.
3. All vectors are then compared across components, in block pairs of at most BLOCK_BYTES a side, and what links
   there unites its components too: no link depends on the passes, on their number or on a sample. This check is
   quadratic in the distinct vectors; pairs inside a component need no edge, so it puts out next to nothing.
4. Inside a component all pairs are compared, in block pairs of bounded size, which gives every vector's exact
   number of links: a group larger than the window loses none.

The passes are there to leave little to unite. How often a pair right at the threshold meets in them is measured
(`plan_passes`): SAMPLE vectors stand for the table, PROBES of them get a partner at the threshold in a random
direction, and TRIALS passes tell how far apart the two come to stand. The passes are as many as the worst quarter of
the probes needs to miss a pair with probability MISS at most; of WINDOWS the one with the least work is taken. The
sample so sets only which links the passes find and which the check finds, never which are found.

Links are confirmed in double precision. No pair is put out: units give stars and counts.

Defined cases: a vector that is null, zero, or holds null or non-finite components has no links, is its own
component and is kept; so are vectors of another length than those they meet. Equal rows count as one vector, but
each is returned; n_links counts other vec_ids (one that stands with several different vectors counts once for each
that links). A null vec_id has no component and is kept; an empty table gives no rows; other columns play no part,
whatever their names. Ties at the threshold link. The length of vectors is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._graph import block_pairs, components, star_edges
from tesserae.llm._store import stored
from tesserae.llm._text import U64, mix
from tesserae.llm.minhash import unit_rows

THRESHOLD = 0.95
#: Ranks before a vector that it is compared with: the choices.
WINDOWS = (256, 1024)
BITS = 64
MISS = 1e-3
#: Sampled vectors, those of them that get a partner, and passes tried, to plan the real passes.
SAMPLE, PROBES, TRIALS = 8192, 256, 64
#: What single-precision cosines may be off.
SLACK = 1e-5
#: Single-precision bytes of one side of a block pair in the check; small tables are cut into up to 4 blocks of 1 MB or more.
BLOCK_BYTES = 16 << 20
#: Vectors a side that are compared at once in the check.
TILE = 1024
#: Distinct vectors of a block when a component's pairs are compared.
PAIR_BLOCK = 1024


def plan_passes(sample: np.ndarray, n: int, threshold: float = THRESHOLD, windows: tuple[int, ...] = WINDOWS, miss: float = MISS) -> tuple[int, int]:
    """(passes, window) for n vectors like the unit vectors of `sample`."""
    if n <= windows[-1] or len(sample) < 2:
        return 1, windows[-1]
    m, dim = sample.shape
    rng = np.random.default_rng(17)
    x = sample[rng.permutation(m)[:PROBES]]
    aside = rng.standard_normal(x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    y = threshold * x + (1 - threshold**2) ** 0.5 * aside / np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    gaps = np.empty((TRIALS, len(x)))
    for turn in range(TRIALS):
        cut = cuts(sample, turn)
        order = np.sort(keys_of(sample, turn, cut))
        gaps[turn] = np.abs(np.searchsorted(order, keys_of(x, turn, cut)) - np.searchsorted(order, keys_of(y, turn, cut)))
    best = None
    for window in windows:
        share = window / n  # of the table that lies in a window
        near = max(share, 4 / m)  # what the sample can resolve
        meet = _worst_quarter(gaps <= near * m)
        if near > share:  # meeting falls as a power of the share
            wide = _worst_quarter(gaps <= 16 * near * m)
            meet *= (share / near) ** max(0.05, log(wide / meet) / log(16))
        turns = max(2, ceil(log(miss) / log(1 - meet))) if meet < 1 else 2
        work = turns * (200 + window)  # shipping a vector costs about as much as comparing it with 200 others
        if best is None or work < best[0]:
            best = work, turns, window
    return best[1], best[2]


def _worst_quarter(met: np.ndarray) -> float:
    """The share of passes in which the quarter of the pairs (columns) that meets least does."""
    rate = np.sort(met.mean(axis=0))
    return float(min(1 - 1e-9, max(0.5 / TRIALS, rate[: max(1, len(rate) // 4)].mean())))


def cuts(sample: np.ndarray, turn: int) -> np.ndarray:
    """The sample's median along each direction of a pass."""
    return np.median(sample @ directions(turn, sample.shape[1]), axis=0)


def keys_of(x: np.ndarray, turn: int, cut: np.ndarray | float) -> np.ndarray:
    """The key of each unit vector in a pass."""
    return np.packbits(x @ directions(turn, x.shape[1]) > cut, axis=1).view(">u8").astype(U64).ravel()


def directions(turn: int, dim: int) -> np.ndarray:
    """BITS random directions of pass `turn`; the same on every worker."""
    return np.random.default_rng(1_000_003 * turn + dim).standard_normal((dim, BITS))


def _valid_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, h1, h2, vec): a 128-bit hash of the components and the doubles' bytes; vec is null if it cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, vecs = [], [], []
            for value in batch.column(1):
                x = None
                if value.is_valid and value.values.null_count == 0:
                    x = np.asarray(value.values, np.float64)
                    largest = np.abs(x).max() if len(x) else 0.0
                    x = x / largest if 0 < largest < np.inf else None
                if x is None:
                    h1.append(0), h2.append(0), vecs.append(None)
                    continue
                bits = (x + 0.0).view(U64)  # + 0.0: a negative zero equals zero
                place = mix(np.arange(1, len(bits) + 1, dtype=U64))
                h1.append(int(mix(bits + place).sum().view(np.int64))), h2.append(int(mix(bits ^ (place * U64(3))).sum().view(np.int64)))
                vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(vecs, pa.binary())], names=["vec_id", "h1", "h2", "vec"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, h1 long, h2 long, vec binary")


def _matrix(vecs: list[bytes], kind: type = np.float64) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places and unit vectors."""
    out = {}
    size = np.array([len(v) for v in vecs])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        x = np.frombuffer(b"".join(vecs[k] for k in at), kind).reshape(len(at), -1)
        out[int(n)] = at, x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def _pass_keys(distinct: DataFrame, turns: int, sample: np.ndarray) -> DataFrame:
    """(turn, key, rep) for every pass; keys sort as their bits do."""
    at_medians = [cuts(sample, turn) for turn in range(turns)] if len(sample) else []
    length = sample.shape[1]  # all of the sample that tasks need

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            for at, x in _matrix(batch.column(1).to_pylist()).values():
                for turn in range(turns):
                    key = keys_of(x, turn, at_medians[turn] if x.shape[1] == length else 0.0)
                    key = (key ^ U64(1 << 63)).view(np.int64)  # unsigned order as signed order
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), turn, np.int32)), pa.array(key), pa.array(ids[at])], names=["turn", "key", "rep"])

    return distinct.select("rep", "vec").mapInArrow(run, "turn int, key long, rep long")


def _sampled(distinct: DataFrame) -> np.ndarray:
    """Unit vectors of the most frequent length among SAMPLE vectors, by hash: bounded, and the same on every run."""
    vecs = [r["vec"] for r in distinct.orderBy(F.xxhash64("h1"), "h1").limit(SAMPLE).select("vec").collect()]
    by_length = _matrix(vecs)
    return max((x for _, x in by_length.values()), key=len) if by_length else np.zeros((0, 1))


def _ranked(keys: DataFrame, window: int) -> DataFrame:
    """(block, rep): the block of `window` ranks in which each vector stands in each pass.

    One range sort; tasks number their rows, and the rows of each task (as many numbers as tasks) are summed up.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n)), batch.column(0)], names=["part", "at", "rep"])
            seen += n

    ordered = keys.repartitionByRange("turn", "key", "rep").sortWithinPartitions("turn", "key", "rep").select("rep")
    numbered = stored(ordered.mapInArrow(number, "part int, at long, rep long"), "embedding-order")
    counts = {r["part"]: r["count"] for r in numbered.groupBy("part").count().collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    spark = keys.sparkSession
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    return numbered.join(F.broadcast(offsets), "part").select(F.floor((F.col("before") + F.col("at")) / window).alias("block"), "rep")


def _window_edges(ranked: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """Stars over what links inside a block and with the block before it."""
    visits = ranked.select("rep", F.explode(F.array(F.struct("block", F.lit(0).alias("guest")), F.struct((F.col("block") + 1).alias("block"), F.lit(1).alias("guest")))).alias("v"))
    single = _single(distinct)
    dealt = visits.select("rep", "v.block", "v.guest").join(single, "rep").select("block", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep", "vec", "guest")
    dealt = dealt.repartition("block").sortWithinPartitions("block", "i", "j", "rep", "guest")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, (vecs, _guest) in unit_rows(batches):
            for at, x in _matrix(vecs, np.float32).values():
                cosine = x @ x.T
                sure = cosine >= threshold + SLACK
                np.fill_diagonal(sure, False)
                a, b = star_edges(sure, ids[at])
                open_a, open_b = np.nonzero(np.triu((cosine >= threshold - SLACK) & ~sure, 1))
                out = np.concatenate([a, ids[at][open_a]]), np.concatenate([b, ids[at][open_b]])
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(np.arange(len(out[0])) < len(a))], names=["a", "b", "sure"])

    edges = stored(dealt.mapInArrow(compare, "a long, b long, sure boolean").where("a <> b").distinct(), "embedding-edges")
    return edges.where("sure").select("a", "b").union(_confirmed(edges.where("NOT sure").select("a", "b"), distinct, threshold))


def _missed_edges(distinct: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Stars over all links between different components of `found`; a vector without one is its own."""
    size = (distinct.agg(F.sum(F.length("vec"))).first()[0] or 0) // 2
    blocks = max(1, -(-size // BLOCK_BYTES), min(4, size >> 20))
    rows = _single(distinct).join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    own = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("own")
    dealt = block_pairs(rows, F.lit(blocks), F.col("rep")).select(F.lit(0).alias("unit"), "i", "j", "rep", "vec", "component", own)
    dealt = dealt.repartition("i", "j").sortWithinPartitions("unit", "i", "j", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), ids, (vecs, component, own) in unit_rows(batches):
            component, own = np.array(component, np.int64), np.array(own)
            for at, x in _matrix(vecs, np.float32).values():
                one, two = np.flatnonzero(own[at] == i), np.flatnonzero(own[at] == j)
                for a in range(0, len(one), TILE):
                    for b in range(a if i == j else 0, len(two), TILE):
                        left, right = one[a : a + TILE], two[b : b + TILE]
                        cosine = x[left] @ x[right].T
                        if cosine.max() < threshold - SLACK:
                            continue
                        left, right = at[left], at[right]
                        near = (cosine >= threshold - SLACK) & (component[left][:, None] != component[right][None, :])
                        sure = near & (cosine >= threshold + SLACK)
                        star = _stars_between(sure, component[left], component[right])
                        open_a, open_b = np.nonzero(near & ~sure)
                        out = np.concatenate([star[0], ids[left[open_a]]]), np.concatenate([star[1], ids[right[open_b]]])
                        if len(out[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(np.arange(len(out[0])) < len(star[0]))], names=["a", "b", "sure"])

    edges = stored(dealt.mapInArrow(compare, "a long, b long, sure boolean").distinct(), "embedding-missed")
    return edges.where("sure").select("a", "b").union(_confirmed(edges.where("NOT sure").select("a", "b"), distinct, threshold))


def _stars_between(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`star_edges` of what links the rows, which `left` names, with the columns, which `right` names."""
    row, column = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    both = np.zeros((len(row) + len(column),) * 2, bool)
    both[: len(row), len(row) :] = linked[np.ix_(row, column)]
    return star_edges(both | both.T, np.concatenate([left[row], right[column]]))


def _single(distinct: DataFrame) -> DataFrame:
    """(rep, vec) with vectors in single precision, of unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for at, x in _matrix(batch.column(1).to_pylist()).values():
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([row.tobytes() for row in x.astype(np.float32)], pa.binary())], names=["rep", "vec"])

    return distinct.select("rep", "vec").mapInArrow(run, "rep long, vec binary")


def _confirmed(pairs: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b) that link in double precision: the few within SLACK of the threshold."""
    one, two = (distinct.select(F.col("rep").alias(n), F.col("vec").alias(f"v{n}")) for n in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [len(x) == len(y) and float((_unit(x) * _unit(y)).sum()) >= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _unit(vec: bytes) -> np.ndarray:
    x = np.frombuffer(vec, np.float64)
    return x / np.linalg.norm(x)


def _link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, links): vectors, copies counted, that link with rep inside its component, without its own copies."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    units = block_pairs(members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / PAIR_BLOCK)), F.col("blocks"), F.col("rep"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("int")).cast("int").alias("own")
    dealt = units.select("component", "i", "j", "rep", "vec", "copies", own).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "rep")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), ids, (vecs, copies, own) in unit_rows(batches):
            copies, own = np.array(copies, np.int64), np.array(own)
            for at, x in _matrix(vecs).values():
                linked = x @ x.T >= threshold
                np.fill_diagonal(linked, False)
                if i != j:  # pairs inside a block are counted where it meets itself
                    linked &= own[at][:, None] != own[at][None, :]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array((linked * copies[at][None, :]).sum(axis=1))], names=["rep", "links"])

    return dealt.mapInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, windows: tuple[int, ...] = WINDOWS, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding)."""
    rows = stored(_valid_rows(vectors), "embedding-rows")
    usable = rows.where("vec IS NOT NULL AND vec_id IS NOT NULL").dropDuplicates(["vec_id", "h1", "h2"])
    distinct = stored(usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "embedding-distinct")
    sample = _sampled(distinct)
    turns, window = plan_passes(sample, distinct.count(), threshold, windows, miss)
    edges = _window_edges(_ranked(_pass_keys(distinct, turns, sample), window), distinct, threshold)
    found = stored(components(edges, "embedding-components"), "embedding-found")
    missed = _missed_edges(distinct, found, threshold)
    if not missed.isEmpty():
        known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = stored(components(known.union(missed), "embedding-components"), "embedding-found")
    members = distinct.join(found.withColumnRenamed("node", "rep"), "rep")
    links = _link_counts(members.select("component", "rep", "vec", "copies"), threshold)
    labels = distinct.select("rep", "h1", "h2", "copies").join(found.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    joined = rows.withColumn("_usable", F.expr("vec IS NOT NULL AND vec_id IS NOT NULL")).drop("vec").join(labels, ["h1", "h2"], "left")
    n_links = F.when(F.col("_usable"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0))
    component = F.when(F.col("_usable"), F.coalesce("component", "rep")).otherwise(F.col("vec_id"))
    out = joined.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
