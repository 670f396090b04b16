"""Conflict-constrained best-fit packing of documents into training sequences.

Texts are measured in words. A text longer than a bin is cut into pieces of a full bin and one rest. Pieces are
taken from the largest down; open bins stand in order of what is left in them (their residual) and carry two kinds
of bitmaps: which sources they hold, one plane for each time a source may come, and which duplicate clusters. The
first bin at or after the piece's size is its tightest fit; while that bin conflicts (the source has come
`source_limit` times, or the cluster is there), the search goes on to the next residual, until a bin is compatible
or a new one is opened. So every piece goes to the tightest compatible bin that is open.

Documents are dealt by a hash of doc_id and cluster into shards, and a task packs runs of at most `block_docs`
documents one after the other, so bins never span runs: memory and time of a task are bounded for any input, and
what is lost is at most the open bins at the end of each run. Equal documents fall into one shard and never into one bin. A hot
source or cluster costs bins, as the constraint demands, and a walk over a run's open bins: each conflict is told by
one bit.

Defined cases: a null text is empty; an empty text is a piece of 0 words, and takes a place in a bin like any
other; null sources are one source; null doc_ids are dealt by their texts; repeated rows are packed separately,
into different bins; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.mixing import word_count

CAPACITY = 2048
SOURCE_LIMIT = 3
BLOCK_DOCS = 4096
SHARD_DOCS = 2048
SCHEMA = "doc_id long, piece int, start long, n_words long, bin string, place int, source string, cluster long"


class Bin:
    """An open bin: residual, one source bitmap for each time a source may come, a cluster bitmap and pieces."""

    __slots__ = ("clusters", "number", "pieces", "residual", "sources")

    def __init__(self, number: int, capacity: int, source_limit: int) -> None:
        self.number, self.residual, self.sources, self.clusters, self.pieces = number, capacity, [0] * source_limit, 0, 0

    def admits(self, source: int, cluster: int) -> bool:
        return not (self.sources[-1] & source or self.clusters & cluster)

    def add(self, size: int, source: int, cluster: int) -> int:
        """Takes a piece; returns its place in the bin."""
        self.residual -= size
        for level, plane in enumerate(self.sources):
            if not plane & source:
                self.sources[level] = plane | source
                break
        self.clusters |= cluster
        self.pieces += 1
        return self.pieces - 1


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT) -> list[tuple[int, int]]:
    """(bin, place) of every piece, in the given order; sizes are at most `capacity`.

    Bits are given out in order of appearance, so bitmaps are exact: equal bits are equal sources or clusters. Bins of
    one residual stand in a list; residuals with bins are kept sorted, and the successor search walks them upwards.
    """
    source_bit: dict = {}
    cluster_bit: dict = {}
    by_residual: dict[int, list[Bin]] = {}
    residuals: list[int] = []
    out, opened = [], 0
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = source_bit.setdefault(source, 1 << len(source_bit))
        c = cluster_bit.setdefault(cluster, 1 << len(cluster_bit))
        found: Bin | None = None
        for at in range(bisect_left(residuals, size), len(residuals)):
            shelf = by_residual[residuals[at]]
            for k, candidate in enumerate(shelf):
                if candidate.admits(s, c):
                    found = candidate
                    del shelf[k]
                    if not shelf:
                        del by_residual[residuals[at]], residuals[at]
                    break
            if found is not None:
                break
        if found is None:
            found = Bin(opened, capacity, source_limit)
            opened += 1
        out.append((found.number, found.add(size, s, c)))
        if found.residual not in by_residual:
            by_residual[found.residual] = []
            insort(residuals, found.residual)
        by_residual[found.residual].append(found)
    return out


def _pieces(n_words: int, capacity: int) -> list[tuple[int, int]]:
    """(start, words) of a text's pieces: full bins, then the rest; an empty text is one piece."""
    return [(s, min(capacity, n_words - s)) for s in range(0, n_words, capacity)] or [(0, 0)]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, block_docs: int = BLOCK_DOCS, shard_docs: int = SHARD_DOCS, cluster: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start and n_words (its words), bin, place in the bin, source and cluster.

    `cluster` names a column of duplicate clusters; without it, texts of equal lower-cased words are a cluster, by a
    64-bit hash. Only sizes are shuffled, never texts. Pieces of one document may share no bin, as it is in one cluster.
    """
    words = word_count(F.col("text"))
    same = F.xxhash64(F.regexp_replace(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"[\x20\x09-\x0D]+", " ")) if cluster is None else F.xxhash64(F.col(cluster))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"), F.col("source").cast("string").alias("source"), same.alias("cluster"))
    shards = max(1, docs.count() // shard_docs)
    keyed = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).cast("int")).withColumn("turn", F.xxhash64("doc_id", F.lit(7)))
    dealt = keyed.repartition("shard").sortWithinPartitions("shard", "turn", "doc_id", "words", "source", "cluster").select("shard", "doc_id", "words", "source", "cluster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held = None, 0, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if held and (row[0] != shard or len(held) == block_docs):
                    yield _packed(held, f"{shard}-{block}", capacity, source_limit)
                    block, held = (block + 1 if row[0] == shard else 0), []
                shard = row[0]
                held.append(row[1:])
        if held:
            yield _packed(held, f"{shard}-{block}", capacity, source_limit)

    return dealt.mapInArrow(run, SCHEMA)


def _packed(rows: list[tuple], name: str, capacity: int, source_limit: int) -> pa.RecordBatch:
    pieces = [(n, doc_id, k, start, source, cluster) for doc_id, words, source, cluster in rows for k, (start, n) in enumerate(_pieces(words, capacity))]
    order = sorted(range(len(pieces)), key=lambda k: (-pieces[k][0], k))
    bins = best_fit([pieces[k][0] for k in order], [pieces[k][4] for k in order], [pieces[k][5] for k in order], capacity, source_limit)
    columns = [[pieces[k][c] for k in order] for c in (1, 2, 3, 0)] + [[f"{name}-{b}" for b, _ in bins], [p for _, p in bins]] + [[pieces[k][c] for k in order] for c in (4, 5)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def fill_rate(packed: DataFrame, capacity: int = CAPACITY) -> float:
    """Words in bins as a share of the bins' room."""
    row = packed.agg(F.sum("n_words"), F.count_distinct("bin")).first()
    return float(np.divide(row[0] or 0, (row[1] or 1) * capacity))
