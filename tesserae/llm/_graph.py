"""Connected components of a distributed edge list, and bounded block pairs for all-pairs work inside a group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm._store import remove, written


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long); component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is two grouped minima and two
    equi-joins, so a hot node is pre-aggregated and its join side can be split by AQE. Rounds are logarithmic in
    the graph's diameter; each is written to the shared folder, so lineage stays short, and deleted once the next
    is written. Nothing is collected but a count and a checksum. Null nodes and self-loops are ignored.
    """
    edge = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, path = written(edge.distinct(), label)
    seen = _checksum(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt, own = written(small.select("e.u", "e.v").where("u <> v").distinct(), label)
        check = _checksum(nxt)
        remove(edges.sparkSession, path)
        now, path = nxt, own
        if check == seen:
            break
        seen = check
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def block_pairs(rows: DataFrame, n_blocks: Column, salt: Column) -> DataFrame:
    """`rows` dealt to every unordered pair (i, j) of its group's `n_blocks` blocks; adds i and j.

    A group of n members in blocks of b becomes about (n/b)**2/2 units of at most 2b rows each: no unit grows with
    the group, and every pair of members meets in at least one unit (pairs within a block meet in unit (i, i)).
    """
    dealt = rows.withColumn("_n", n_blocks.cast("int")).withColumn("_own", F.pmod(F.xxhash64(salt), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumn("i", F.least("_own", "_o")).withColumn("j", F.greatest("_own", "_o")).drop("_o", "_n", "_own")


def star_edges(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of the components of a symmetric boolean matrix over `ids`."""
    n = len(ids)
    left = np.ones(n, bool)
    out_a, out_b = [], []
    for x in range(n):
        if not left[x]:
            continue
        found = np.zeros(n, bool)
        found[x] = True
        front = np.array([x])
        while len(front):
            reached = linked[front].any(axis=0) & ~found
            found |= reached
            front = np.flatnonzero(reached)
        left &= ~found
        members = np.flatnonzero(found)
        if len(members) > 1:
            root = ids[members].min()
            other = members[ids[members] != root]
            out_a.append(ids[other])
            out_b.append(np.full(len(other), root))
    if not out_a:
        return np.zeros(0, ids.dtype), np.zeros(0, ids.dtype)
    return np.concatenate(out_a), np.concatenate(out_b)


def star_search(ids: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges as of `star_edges`, where linked(x, rows) tells which of `rows` link with row x.

    A row is asked for only among rows that no component has yet, so a group that hangs together costs about one
    comparison a row, not one a pair, and no matrix is held.
    """
    left = np.arange(len(ids))
    out_a, out_b = [], []
    while len(left):
        members, left = [left[:1]], left[1:]
        front = members[0].tolist()
        while front and len(left):
            hit = linked(front.pop(), left)
            if hit.any():
                members.append(left[hit])
                front += left[hit].tolist()
                left = left[~hit]
        found = ids[np.concatenate(members)]
        other = found[found != found.min()]
        out_a.append(other)
        out_b.append(np.full(len(other), found.min()))
    return np.concatenate([ids[:0], *out_a]), np.concatenate([ids[:0], *out_b])


def runs(*keys: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal keys: starts followed by the length."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)
