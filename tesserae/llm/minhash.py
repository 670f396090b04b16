"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every text becomes its set of distinct `WORDS`-word shingles (64-bit hashes) and a signature of COORDINATES
   minima. Texts of equal sets collapse to the smallest doc_id, so exact copies cost one row from here on.
2. Signatures are posted under each (coordinate, value) pair. Values that only one set has are dropped; a set with
   fewer than MATCHES shared values can match nobody. Of s shared values only the s - MATCHES + 1 rarest ones (the
   prefix, in one global order) are kept as lists: two sets that agree on MATCHES coordinates meet in one of them.
   Lists of very common values (a passage that many texts hold) so drop out, but for texts made of little else.
3. Inside a list, agreeing coordinates are counted by merging posting lists, of which the longest are skipped and only
   looked up (`_agreeing`); pairs with at least MATCHES are candidates. Long lists are cut
   into block pairs (`block_pairs`), so no task grows with a list, and only a star over each unit's candidate
   components is put out, never its pairs.
4. Components of candidates are small. The sets of each are compared in full (again in block pairs): a link needs
   100 * intersection >= 75 * union. Components of the confirmed links are the result. A block is bounded in shingles
   and in members, so a unit's memory is, whatever the component.

A pair at the least similarity, 0.75, agrees on fewer than MATCHES of the COORDINATES with probability 4e-6.
Sets meet in one candidate component whenever they would meet as a pair, so only such a miss loses a link.

Defined cases: a text with fewer than WORDS words has its whole word sequence as one shingle; a null text or one
without words has an empty set and links with nothing; rows of equal doc_id count as one document whose texts are
linked through it; a row with a null doc_id is returned with its size, no component, and kept; an empty table
gives no rows; other columns play no part, whatever their names; a pair right at the threshold links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._graph import block_pairs, components, runs, star_search
from tesserae.llm._store import stored
from tesserae.llm._text import U64, chunks, mix, signed, word_hashes

WORDS = 5
COORDINATES = 64
MATCHES = 32
#: The link condition: SHARE[0] * |A and B| >= SHARE[1] * |A or B|.
SHARE = (100, 75)
#: Members of a block in a posting list; shingles, and members, of a block in a component of candidates.
LIST_BLOCK = 512
SET_BLOCK, SET_MEMBERS = 1 << 19, 1024
#: Coordinates with the longest posting lists, which are not merged but looked up for what the others leave.
SKIPPED = 16
#: Candidates up to which their ids are broadcast to the second scan (16 bytes each); beyond it a join by shuffle.
MOST_BROADCAST = 1_000_000

_odd = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64)) | U64(1)
MULTIPLIERS, ADDENDS = _odd[:COORDINATES], _odd[COORDINATES:]
_steps = mix(np.arange(1001, 1001 + WORDS, dtype=U64)) | U64(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, doc = word_hashes(data, offs)
    n = len(offs) - 1
    bounds = np.searchsorted(doc, np.arange(n + 1))
    if len(words) >= WORDS:
        rolled = np.zeros(len(words) - WORDS + 1, U64)
        for k in range(WORDS):
            rolled += words[k : k + len(rolled)] * _steps[k]
        rolled = mix(rolled)
    out = []
    for d in range(n):
        a, b = bounds[d], bounds[d + 1]
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            short = np.array([b - a], U64)
            for k in range(a, b):
                short = mix(short * _steps[0] + words[k])
            out.append(short)
        else:
            out.append(np.zeros(0, U64))
    return out


def _signed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n, h1, h2, sig): set size, a 128-bit hash of the set, and the signature's bytes."""
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offs in chunks(batch.column(1)):
                sets = shingle_sets(data, offs)
                full = [s for s in sets if len(s)]
                size = np.array([len(s) for s in sets], np.int64)
                h1, h2 = np.zeros(len(sets), U64), np.zeros(len(sets), U64)
                sigs: list[bytes | None] = [None] * len(sets)
                if full:
                    flat, where = np.concatenate(full), np.flatnonzero(size)
                    starts = np.concatenate([[0], np.cumsum(size[where])[:-1]])
                    h1[where], h2[where] = np.add.reduceat(mix(flat), starts), np.add.reduceat(mix(flat ^ U64(0xA5A5A5A5A5A5A5A5)), starts)
                    table = np.empty((len(where), COORDINATES), np.uint32)
                    for c in range(COORDINATES):
                        table[:, c] = np.minimum.reduceat(flat * MULTIPLIERS[c] + ADDENDS[c], starts) >> U64(32)
                    for k, w in enumerate(where):
                        sigs[w] = table[k].tobytes()
                ids = batch.column(0).slice(row, end - row).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(signed(h1)), pa.array(signed(h2)), pa.array(sigs, pa.binary())], names=[f for f, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary")


def _candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b): stars over sets that agree on at least MATCHES coordinates inside a list."""
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            keys = (np.arange(COORDINATES, dtype=np.int64) << 32)[None, :] | sigs.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, COORDINATES)), pa.array(keys.ravel())], names=["doc", "key"])

    posts = reps.select("doc", "sig").mapInArrow(post, "doc long, key long")
    shared = stored(posts.groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1"), "minhash-values")
    common = posts.join(shared, "key").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("cnt", "key"))).alias("all"))
    common = common.where(F.size("all") >= MATCHES).withColumn("prefix", F.slice("all", F.lit(1), F.size("all") - (MATCHES - 1)))
    lists = common.join(reps.select("doc", "sig"), "doc").select("doc", "sig", F.explode("prefix").alias("p")).select("doc", "sig", "p.key", "p.cnt")
    units = block_pairs(lists, F.ceil(F.col("cnt") / LIST_BLOCK), F.col("doc")).select("key", "i", "j", "doc", "sig")
    dealt = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, columns in unit_rows(batches):
            sigs = np.frombuffer(b"".join(columns[0]), np.uint32).reshape(-1, COORDINATES)
            a, b = _agreeing(sigs, ids)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(match, "a long, b long")


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, list[list]]]:
    """Units of rows sorted by (key, i, j): (key, i, j), the ids and the other columns; holds one unit at a time."""
    key: tuple | None = None
    ids: list[np.ndarray] = []
    rest: list[list] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(c)) for c in range(3)]
        bounds = runs(*keys)
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            this = tuple(int(k[s]) for k in keys)
            if this != key:
                if key is not None and sum(map(len, ids)) > 1:
                    yield key, np.concatenate(ids), rest
                key, ids, rest = this, [], [[] for _ in range(batch.num_columns - 4)]
            ids.append(np.asarray(batch.column(3).slice(s, e - s)))
            for c, held in enumerate(rest):
                held.extend(batch.column(4 + c).slice(s, e - s).to_pylist())
    if key is not None and sum(map(len, ids)) > 1:
        yield key, np.concatenate(ids), rest


def _agreeing(sigs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star over each component of rows that agree on at least MATCHES coordinates.

    Collisions are counted by merging posting lists: for a row, the rows that stand under the same value of a
    coordinate. The SKIPPED longest lists are not merged; only rows that the others leave within reach of MATCHES are
    looked up in them. Where the lists are so long that they hold most rows, the rows left are looked up in all.
    """
    n = len(ids)
    if n == 2:
        hit = int((sigs[0] == sigs[1]).sum()) >= MATCHES and ids[0] != ids[1]
        return (ids[1:], ids[:1]) if hit else (ids[:0], ids[:0])
    order = np.argsort(sigs, axis=0, kind="stable")
    ranked = np.take_along_axis(sigs, order, axis=0)
    bounds = []
    for c in range(COORDINATES):
        begin = np.searchsorted(ranked[:, c], sigs[:, c])
        bounds.append((begin, np.searchsorted(ranked[:, c], sigs[:, c], side="right")))
    begin, end = (np.stack(x, axis=1) for x in zip(*bounds, strict=True))
    size = end - begin
    by_length = np.argsort(size, axis=1, kind="stable")
    merged, skipped = by_length[:, : COORDINATES - SKIPPED], by_length[:, COORDINATES - SKIPPED :]
    work = np.take_along_axis(size, merged, axis=1).sum(axis=1)

    def linked(x: int, rows: np.ndarray) -> np.ndarray:
        if work[x] > 8 * len(rows):
            return (sigs[rows] == sigs[x]).sum(axis=1) >= MATCHES
        met = np.bincount(np.concatenate([order[begin[x, c] : end[x, c], c] for c in merged[x].tolist()]), minlength=n)[rows]
        near = np.flatnonzero(met >= MATCHES - SKIPPED)
        hit = np.zeros(len(rows), bool)
        hit[near] = met[near] + (sigs[rows[near][:, None], skipped[x]] == sigs[x, skipped[x]]).sum(axis=1) >= MATCHES
        return hit

    return star_search(ids, linked)


def _confirm(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges (a, b): stars over the sets of one candidate component whose full sets meet the link condition."""
    sizes = stored(clusters.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("members")), "minhash-sizes")
    blocks = F.greatest(F.ceil(F.col("total") / SET_BLOCK), F.ceil(F.col("members") / SET_MEMBERS))
    members = stored(clusters.join(sizes, "component").select("doc", "component", blocks.alias("blocks"), "h1"), "minhash-members")
    small = members.count() <= MOST_BROADCAST
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(F.broadcast(members) if small else members, "doc")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offs in chunks(batch.column(4)):
                packed = pa.array([s.tobytes() for s in shingle_sets(data, offs)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, end - row) for c in range(3)), packed], names=["doc", "component", "blocks", "shingles"])

    full = texts.select("doc", "component", "blocks", "h1", "text").mapInArrow(sets, "doc long, component long, blocks long, shingles binary")
    units = block_pairs(full, F.col("blocks"), F.col("doc")).select("component", "i", "j", "doc", "shingles")
    dealt = units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "doc")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, columns in unit_rows(batches):
            a, b = linked_sets([np.frombuffer(x, U64) for x in columns[0]], ids)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def linked_sets(sets: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star over each component of sets that meet the link condition; memory is in proportion to what they hold."""
    size = np.array([len(s) for s in sets], np.int64)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    mark = np.zeros(len(place) + 1, bool)

    def linked(x: int, rows: np.ndarray) -> np.ndarray:
        # Only sets of a size that can meet the condition are looked at.
        close = np.flatnonzero((SHARE[0] * size[rows] >= SHARE[1] * size[x]) & (SHARE[0] * size[x] >= SHARE[1] * size[rows]))
        hit = np.zeros(len(rows), bool)
        if not len(close):
            return hit
        own = place[starts[x] : ends[x]]
        mark[own] = True
        count = size[rows[close]]
        at = np.repeat(starts[rows[close]] - np.cumsum(count) + count, count) + np.arange(count.sum())
        shared = np.add.reduceat(mark[place[at]].astype(np.int64), np.cumsum(count) - count)
        mark[own] = False
        hit[close] = (SHARE[0] * shared >= SHARE[1] * (size[x] + count - shared)) & (shared > 0)
        return hit

    return star_search(ids, linked)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`; kept marks the smallest doc_id of a component."""
    signed_rows = stored(_signed_rows(docs), "minhash-signatures")
    filled = signed_rows.where("n > 0 AND doc_id IS NOT NULL")
    reps = stored(filled.groupBy("h1", "h2").agg(F.min_by(F.struct("n", "sig"), "doc_id").alias("x"), F.min("doc_id").alias("doc")).select("doc", "h1", "h2", "x.n", "x.sig"), "minhash-sets")
    found = components(_candidates(reps), "minhash-candidates")
    clusters = reps.join(found.withColumnRenamed("node", "doc"), "doc").select("doc", "component", "n", "h1")
    links = components(_confirm(docs, clusters), "minhash-links")
    labels = reps.select("doc", "h1", "h2").join(links.withColumnRenamed("node", "doc"), "doc", "left").select("h1", "h2", F.coalesce("component", "doc").alias("component_id"))
    grouped = signed_rows.join(labels, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = grouped.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
