"""Exact-substring dedup: common prefixes from a Burrows-Wheeler transform by threshold-bounded interval expansion.

What is removed: every byte covered by a string of LENGTH bytes that also starts anywhere else in the corpus.

1. Windows to regions. Every window of LENGTH bytes has an anchor, its GRAM-byte substring of least hash (the last
   of equal ones). The anchor depends on the window's bytes alone, so equal windows have equal anchors. Neighbouring
   windows with the same anchor form a region; each window is in exactly one. Regions whose anchor occurs once in
   the corpus hold no repeated window and go; the others are grouped by anchor, equal regions pre-aggregated. A group
   of one distinct region stands in several places as a whole, and all its windows are repeated.
2. Interval expansion. Groups are batched, about BATCH_BYTES at a time: the distinct regions are concatenated, and
   suffix array and Burrows-Wheeler transform are built. Boundaries between neighbouring suffixes are then found in
   the order of their common prefix (Beller et al., 2013): all with value l + 1 follow from those with value l by one
   backward extension, as two neighbouring rows with the same preceding byte c are neighbours again after extension
   by c and share one byte more than the least value between them. The search is breadth-first and stops at LENGTH:
   boundaries that are not found by then are common prefixes of at least LENGTH bytes, whatever their exact value.
   Rows without a boundary between them start equal windows; those that occur twice or more (a region counts as
   often as it occurs) are repeated.
3. Repeated windows go back to all occurrences of their region, are merged per document, and cut out.

An anchor with more than HOT_REGIONS distinct regions (the edge of a passage that very many texts hold) would be too
large a batch; its windows are counted one by one, by anchor and window hash, which is linear, pre-aggregated and
gives the same result. Documents are named by a hash of doc_id and text, so repeated rows are safe.

Defined cases: a null text is empty; a text shorter than LENGTH has no windows; rows of equal doc_id, also equal
rows, are separate documents (so equal rows of LENGTH bytes or more lose all their text), but what is found for one
copy serves all; null doc_ids are allowed; an empty table gives no rows; other columns play no part, whatever their
names; text that is cut inside a character leaves its other bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm._store import stored
from tesserae.llm._text import CHUNK_BYTES, U64, buffers, chunks, mix, prefix_sums, signed, span_hash

LENGTH = 200
GRAM = 32
BATCH_BYTES = 1 << 20
HOT_REGIONS = 4096
#: Rows up to which places of regions, or removed runs, are broadcast to a scan (under 64 bytes each); beyond it a join.
MOST_BROADCAST = 2_000_000
SEPARATOR = 0xFF  # in no UTF-8 text


def regions(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor hash, region hash) of every region, in order."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    n = len(data)
    if n < length:
        return none
    sums = prefix_sums(data)
    at = np.arange(n - gram + 1)
    least = span_hash(sums, at, at + gram)
    grams = least
    place = at.astype(np.int32)
    # Least hash, and its last place, of ever longer stretches of grams; two of a power of two cover any length.
    want, have = length - gram + 1, 1
    while have < want:
        step = min(have, want - have)
        left, right = least[:-step], least[step:]
        later = right <= left
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, right, left)
        have += step
    start = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(offs[:-1], offs[1:], strict=True) if b - a >= length] or [np.zeros(0, np.int64)])
    if not len(start):
        return none
    anchor = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    begin, end, anchor = start[first], start[last] + length, anchor[first]
    name = mix(span_hash(sums, begin, end) + (anchor - begin).astype(U64))
    doc = np.searchsorted(offs, begin, side="right") - 1
    return doc, begin - offs[doc], end - begin - length + 1, grams[anchor], name


def _pieces(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Runs of texts as they are; one very long text in pieces that share its windows out. (bytes, offsets, shift)"""
    if len(data) <= 2 * CHUNK_BYTES:
        yield data, offs, 0
        return
    for begin in range(0, len(data) - length + 1, CHUNK_BYTES):
        end = min(len(data), begin + CHUNK_BYTES + length - 1)
        yield data[begin:end], np.array([0, end - begin]), begin


def _regions(named: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for row, _, data, offs in chunks(batch.column(1), CHUNK_BYTES // 2):
                for piece, bounds, shift in _pieces(data, offs, length):
                    doc, start, windows, anchor, region = regions(piece, bounds, length, gram)
                    columns = [signed(anchor), signed(region), keys[row + doc], (start + shift).astype(np.int32), windows.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "region", "key", "start", "windows"])

    return named.select("key", "text").mapInArrow(run, "anchor long, region long, key long, start int, windows int")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling from 8 bytes; only what is still tied is sorted again."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    first = np.zeros(n, U64)
    for k in range(8):
        first = (first << U64(8)) | padded[k : k + n].astype(U64)
    order = np.argsort(first)
    head = np.ones(n, bool)
    head[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    starts = np.flatnonzero(head)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    # A suffix shorter than 8 bytes ties with one that has zero bytes there; the empty end then ranks first.
    span = 8
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(tied):
        where = order[tied]
        then = rank[np.minimum(where + span, n)] + 1
        key = (rank[where] << 32) | then
        within = np.argsort(key)
        where, key = where[within], key[within]
        order[tied] = where
        fresh = np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(fresh)
        rank[where] = np.repeat(tied[starts], np.diff(np.append(starts, len(tied))))
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        span *= 2
    return order


def short_boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether row j of the suffix array shares fewer than `length` bytes with row j - 1, separators being all unequal.

    Breadth-first by value: `found` holds the boundaries of a value up to l, `fresh` those of value l.
    """
    n = len(text)
    before = np.where(order > 0, text[order - 1], SEPARATOR).astype(np.uint8)
    rows = np.argsort(before, kind="stable")  # rows[k] extends to row k: the LF mapping, inverted
    lands = np.empty(n, np.int64)
    lands[rows] = np.arange(n)
    prior = np.full(n, -1, np.int64)  # the row before with the same preceding byte
    same = before[rows[1:]] == before[rows[:-1]]
    prior[rows[1:][same]] = rows[:-1][same]
    lead = text[order]
    found = np.ones(n + 1, bool)
    found[1:n] = (lead[1:] != lead[:-1]) | (lead[1:] == SEPARATOR)
    fresh = np.flatnonzero(found[:n])
    waiting = np.flatnonzero((prior >= 0) & (before != SEPARATOR) & ~found[lands])
    for _ in range(length - 1):
        if not len(fresh):
            break
        until = _next_boundary(found, fresh) if len(fresh) <= n // 16 else None
        size = until - fresh if until is not None else None
        total = int(size.sum()) if size is not None else n
        if total > n // 8:
            # Many: every row still waiting looks whether a fresh boundary lies between its prior row and itself.
            seen = np.zeros(n, np.int32)
            seen[fresh] = 1
            np.cumsum(seen, out=seen)
            between = seen[waiting] > seen[prior[waiting]]
            hit = lands[waiting[between]]
            hit = hit[~found[hit]]
            waiting = waiting[~between]
        else:
            # Few: the rows from a fresh boundary to the next boundary whose prior row lies before it.
            step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            begin = np.repeat(fresh, size)
            row = begin + step
            ok = (prior[row] >= 0) & (prior[row] < begin) & (before[row] != SEPARATOR)
            hit = lands[row[ok]]
            hit = hit[~found[hit]]
        found[hit] = True
        if len(hit) > n // 64:
            mark = np.zeros(n, bool)
            mark[hit] = True
            fresh = np.flatnonzero(mark)
        else:
            fresh = np.unique(hit)
    return found[:n]


def _next_boundary(found: np.ndarray, fresh: np.ndarray, near: int = 64) -> np.ndarray:
    """The next boundary after each of `fresh`; most are a few rows away, the others are searched for."""
    until = fresh + 1
    live = np.flatnonzero(~found[until])
    for _ in range(near):
        if not len(live):
            return until
        until[live] += 1
        live = live[~found[until[live]]]
    places = np.flatnonzero(found)
    until[live] = places[np.searchsorted(places, until[live])]
    return until


def repeated_windows(bodies: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each distinct region its repeated windows, as (first, last) pairs counted from the region's start."""
    size = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(size + 1)
    starts = ends - size - 1
    text = np.frombuffer(b"".join(b + b"\xff" for b in bodies), np.uint8)
    order = suffix_array(text)
    group = np.cumsum(short_boundaries(text, order, length)) - 1
    owner = np.searchsorted(ends, order, side="right")
    whole = order + length < ends[owner]
    times = np.bincount(group, weights=np.where(whole, weights[owner], 0))
    again = np.sort(order[whole & (times[group] > 1)])
    owner = np.searchsorted(ends, again, side="right")
    new = np.ones(len(again), bool)
    new[1:] = (again[1:] != again[:-1] + 1) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first, len(again))[1:] - 1
    pairs = np.stack([again[first] - starts[owner[first]], again[last] - starts[owner[first]]], axis=1).astype(np.int32).reshape(-1, 2)
    cuts = np.searchsorted(owner[first], np.arange(len(bodies) + 1))
    return [pairs[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _expand(bodies: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """(anchor, region, pairs) of regions with repeated windows; rows of one anchor are one batch or part of one."""
    dealt = bodies.repartition("anchor").sortWithinPartitions("anchor", "region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, at = 0, None

        def finish() -> pa.RecordBatch:
            found = repeated_windows([h[3] for h in held], np.array([h[2] for h in held], np.int64), length)
            rows = [(h[0], h[1], p.tobytes()) for h, p in zip(held, found, strict=True) if len(p)]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["anchor", "region", "pairs"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if held and row[:2] == held[-1][:2]:
                    continue  # from another copy of a repeated row
                if size >= batch_bytes and row[0] != at:
                    yield finish()
                    held, size = [], 0
                held.append(row)
                at = row[0]
                size += len(row[3])
        if held:
            yield finish()

    return dealt.mapInArrow(run, "anchor long, region long, pairs binary")


def _wholly(alone: DataFrame) -> DataFrame:
    """The same for anchors with one distinct region: it stands in several places, so all its windows are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = np.asarray(batch.column(2)).astype(np.int32) - 1
            pairs = np.stack([np.zeros(len(last), np.int32), last], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in pairs], pa.binary())], names=["anchor", "region", "pairs"])

    return alone.select("anchor", "region", "windows").mapInArrow(run, "anchor long, region long, pairs binary")


def _count_windows(bodies: DataFrame, length: int) -> DataFrame:
    """The same as `_expand` for anchors with very many regions: windows are counted by hash, in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, region, weight, body in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                data = np.frombuffer(body, np.uint8)
                at = np.arange(len(data) - length + 1)
                n = len(at)
                columns = [np.full(n, anchor), np.full(n, region), np.full(n, weight), at.astype(np.int32), signed(span_hash(prefix_sums(data), at, at + length))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "region", "weight", "at", "window"])

    windows = bodies.mapInArrow(run, "anchor long, region long, weight long, at int, window long")
    again = windows.groupBy("anchor", "window").agg(F.sum("weight").alias("times")).where("times > 1").drop("times")
    found = windows.join(again, ["anchor", "window"]).groupBy("anchor", "region").agg(F.array_sort(F.collect_list("at")).alias("at"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for places in batch.column(2).to_pylist():
                x = np.array(places)
                first = np.flatnonzero(np.append(True, x[1:] != x[:-1] + 1))
                last = np.append(first[1:], len(x)) - 1
                pairs.append(np.stack([x[first], x[last]], axis=1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pairs, pa.binary())], names=["anchor", "region", "pairs"])

    return found.mapInArrow(pair, "anchor long, region long, pairs binary")


def _bodies(named: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """(anchor, region, weight, body) of one occurrence of each distinct region."""
    wanted = stored(reps.groupBy("key").agg(F.collect_list(F.struct("anchor", "region", "weight", "start", "windows")).alias("wanted")), "suffix-wanted")
    small = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= MOST_BROADCAST
    texts = named.select("key", "text").join(F.broadcast(wanted) if small else wanted, "key")
    # Each copy of a repeated row gives the same bodies; they are taken once, where they come together.
    texts = texts.select("wanted", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(1))
            raw = data.tobytes()
            lists = batch.column(0)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            start, windows = (np.asarray(flat.field(k)).astype(np.int64) for k in (3, 4))
            begin = offs[row] + start
            end = begin + windows + length - 1
            for a in range(0, len(begin), 20_000):
                part = slice(a, a + 20_000)
                body = pa.array([raw[x:y] for x, y in zip(begin[part], end[part], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(flat.field(k).slice(a, 20_000) for k in range(3)), body], names=["anchor", "region", "weight", "body"])

    return texts.mapInArrow(run, "anchor long, region long, weight long, body binary")


def merge_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals [start, end) that overlap or touch, merged."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first, len(starts))[1:] - 1]


def _covered(repeats: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(key, runs): the removed runs of each text, merged, as (start, end) pairs."""
    placed = repeats.join(found, ["anchor", "region"]).select("key", "start", "pairs")
    listed = placed.groupBy("key").agg(F.collect_set(F.struct("start", "pairs")).alias("all"))  # a set: copies of a repeated row say the same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                pairs = np.concatenate([np.frombuffer(x["pairs"], np.int32).reshape(-1, 2).astype(np.int64) + x["start"] for x in row])
                out.append(np.stack(merge_runs(pairs[:, 0], pairs[:, 1] + length), axis=1).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "runs"])

    return listed.mapInArrow(run, "key long, runs binary")


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("key"))


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_regions: int = HOT_REGIONS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(key, runs): of every text that holds repeated strings, the byte runs to remove; key is that of `_named`."""
    named = _named(docs)
    every = stored(_regions(named, length, gram), "suffix-regions")
    # Written, so that the join stands alone in its stage and a hot anchor's side can be split.
    shared = stored(every.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("anchor"), "suffix-shared")
    repeats = stored(every.join(shared, "anchor"), "suffix-repeats")
    first = F.min(F.struct("key", "start", "windows")).alias("rep")
    counted = repeats.groupBy("anchor", "region").agg(F.count("*").alias("weight"), first).select("anchor", "region", "weight", "rep.*")
    every = stored(counted.withColumn("_n", F.count("*").over(Window.partitionBy("anchor"))), "suffix-distinct")
    alone, distinct = every.where("_n = 1"), every.where("_n > 1").drop("_n")
    hot = stored(every.where(F.col("_n") > hot_regions).select("anchor", F.lit(True).alias("hot")).distinct(), "suffix-hot")
    bodies = _bodies(named, distinct, length)
    if hot.isEmpty():
        found = _expand(bodies, length, batch_bytes)
    else:
        bodies = stored(bodies.join(hot, "anchor", "left"), "suffix-bodies")
        found = _expand(bodies.where("hot IS NULL").drop("hot"), length, batch_bytes).union(_count_windows(bodies.where("hot").drop("hot").dropDuplicates(["anchor", "region"]), length))
    return _covered(repeats, found.union(_wholly(alone)), length)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_regions: int = HOT_REGIONS, batch_bytes: int = BATCH_BYTES, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of every row of `docs`."""
    covered = stored(repeated_runs(docs, length, gram, hot_regions, batch_bytes), "suffix-covered")
    small = (covered.agg(F.sum(F.length("runs") + 16)).first()[0] or 0) <= MOST_BROADCAST * 16
    texts = _named(docs).join(F.broadcast(covered) if small else covered, "key", "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(1))
            removed, spans, digest, kept = [], [], [], []
            for k, cut in enumerate(batch.column(2).to_pylist()):
                text = memoryview(data[offs[k] : offs[k + 1]])
                pairs = np.frombuffer(cut or b"", np.int64).reshape(-1, 2)
                hashed, at, left = hashlib.sha256(), 0, []
                for a, b in pairs.tolist():
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                for part in left:
                    hashed.update(part)
                removed.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
                spans.append(len(pairs))
                digest.append(hashed.hexdigest())
                if keep_text:
                    kept.append(b"".join(left))
            columns = [batch.column(0), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
