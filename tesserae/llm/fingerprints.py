"""Document fingerprints from prefix polynomial hashes.

A text c_0..c_n of code points has two prefix arrays P[i] = sum(c_j * b**j, j < i) modulo the prime 2**31 - 1, one
for each of two bases. From them the hash of any span costs O(1), so equality of spans and, by binary search, the
longest common extension of two positions need no comparison of characters (`PrefixHashes`).

Likeness of two texts. Every span of `SPAN` code points is an anchor, whatever the length of the texts. Where an anchor
of one text stands in the other too (those inside their longest common extension from the start do, and are not looked
up), its place is joined with the next one if that follows on the same diagonal, and the
ends of these chains are widened to the longest common extension, backward and forward. What is so covered in either
text is common, exactly what its spans that stand in the other text cover: with c the mean
of the two covered lengths, likeness is c / (n + m - c): 1 for equal texts, 0 without a common span, and a third
where one half was replaced. A text shorter than SPAN has its longest common extension from the start only. Whole
batches of documents share one pair of prefix arrays, so the extensions of all of them are searched for at once.

The fingerprint as a string, to be stored and compared later (`likeness`), is a text's length and whole hash,
followed by the `KEEP` smallest mixed hashes of its spans. Equal texts have equal fingerprints.

Defined cases: a null text is empty; two empty texts are alike (1), an empty and a non-empty one are not (0);
rows of equal doc_id are ordered by text; a null doc_id comes after all others; a table of one row has itself as
next document; an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._store import stored
from tesserae.llm._text import mix

PRIME = (1 << 31) - 1
BASES = (0x2F1B3A57 % PRIME, 0x51ED2709 % PRIME)
SPAN = 16
KEEP = 64
#: Texts under so many code points have an exact likeness: all texts.
SHORT = 1 << 31
#: Entries of the table by which most spans that the other text lacks are left out before places are looked up.
SIEVE_BITS = 21
#: Most blocks of neighbouring documents; bounds what is known of them on the driver and in tasks.
MOST_BLOCKS = 1 << 15
BLOCK_ROWS = 500
#: Code points of the documents that are worked on together; a longer document is alone.
BATCH_POINTS = 1 << 17
U64 = np.uint64


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x below 2**62."""
    x = (x & U64(PRIME)) + (x >> U64(31))
    return np.minimum(x, x - U64(PRIME))  # below the prime the difference wraps around to a large number


class _Powers:
    """b**i and b**-i modulo the prime, grown by doubling."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, _reduce(self.up * U64(pow(self.base, k, PRIME)))])
            self.down = np.concatenate([self.down, _reduce(self.down * U64(pow(self.inverse, k, PRIME)))])
        return self.up, self.down


POWERS = [_Powers(b) for b in BASES]


class PrefixHashes:
    """Prefix arrays of one text, given as an array of code points."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        values = points.astype(U64) + U64(1)
        self.sums = []
        for powers in POWERS:
            up, _ = powers.upto(self.n + 1)
            sums = np.zeros(self.n + 1, U64)
            np.cumsum(_reduce(values * up[: self.n]), out=sums[1:])  # below 2**62 for texts under 2**31 code points
            self.sums.append(_reduce(sums))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end)."""
        out = np.zeros(len(start), U64)
        for powers, sums in zip(POWERS, self.sums, strict=True):
            _, down = powers.upto(self.n + 1)
            out = (out << U64(31)) | _reduce(_reduce(sums[end] + U64(PRIME) - sums[start]) * down[start])
        return out

    def windows(self, length: int) -> np.ndarray:
        """62-bit hashes of all spans of one length."""
        count = self.n - length + 1
        out = np.zeros(count, U64)
        for powers, sums in zip(POWERS, self.sums, strict=True):
            _, down = powers.upto(self.n + 1)
            out = (out << U64(31)) | _reduce(_reduce(sums[length:] + U64(PRIME) - sums[:count]) * down[:count])
        return out

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])


def equal_spans(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    """Whether a[i:i+length] and b[j:j+length] are equal (up to a 62-bit collision)."""
    return i + length <= a.n and j + length <= b.n and a.span(i, i + length) == b.span(j, j + length)


def longest_common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """The largest length for which a[i:i+length] equals b[j:j+length], by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _keep(values: np.ndarray) -> np.ndarray:
    """The KEEP smallest distinct values, ascending."""
    if len(values) > 8 * KEEP:  # repeated spans may fill the first of them: widen until enough distinct ones stand
        take = 4 * KEEP
        while take < len(values):
            smallest = np.unique(np.partition(values, take)[:take])
            if len(smallest) >= KEEP:
                values = smallest
                break
            take *= 4
    return np.unique(values)[:KEEP]


def sketch(points: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(length, whole-text hash, the KEEP smallest mixed span hashes, ascending and distinct)."""
    return Batch([points]).sketches()[0]


class Batch:
    """Texts one after the other under common prefix arrays; places count from the first text's start."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        self.size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.hashes = PrefixHashes(np.concatenate([np.zeros(0, np.uint32), *texts]))
        self.spans = mix(self.hashes.windows(SPAN)) if self.hashes.n >= SPAN else np.zeros(0, U64)

    def sketches(self) -> list[tuple[int, int, np.ndarray]]:
        whole = self.hashes.spans(self.start, self.end)
        short = (mix(whole) >> U64(32)).astype(np.uint32)
        values = self.spans.view(np.uint32)[1::2]  # the upper halves
        return [
            (n, int(whole[k]) if n else 0, _keep(values[a : a + n - SPAN + 1]) if n >= SPAN else short[k : k + (n > 0)])
            for k, (a, n) in enumerate(zip(self.start.tolist(), self.size.tolist(), strict=True))
        ]

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of so many code points at i and j are equal, up to a 62-bit collision."""
        same = np.ones(len(i), bool)
        for powers, sums in zip(POWERS, self.hashes.sums, strict=True):
            up, _ = powers.upto(self.hashes.n + 1)
            left = _reduce(_reduce(sums[i + length] + U64(PRIME) - sums[i]) * up[j])
            same &= left == _reduce(_reduce(sums[j + length] + U64(PRIME) - sums[j]) * up[i])
        return same

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, backward: bool = False) -> np.ndarray:
        """The longest common extension of each pair of places, up to `most`, by binary search; backward, of what ends there."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (live := np.flatnonzero(low < high)).size:
            middle = (low[live] + high[live] + 1) // 2
            shift = middle if backward else 0
            same = self.equal(i[live] - shift, j[live] - shift, middle)
            low[live] = np.where(same, middle, low[live])
            high[live] = np.where(same, high[live], middle - 1)
        return low

    def _anchors(self, text: np.ndarray, skip: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number in `text`, place, key) of the spans of texts but their first ones; keys are equal where numbers and spans are."""
        count = np.maximum(0, self.size[text] - SPAN + 1 - skip)
        number = np.repeat(np.arange(len(text)), count)
        place = np.arange(count.sum()) + np.repeat(self.start[text] + skip - np.cumsum(count) + count, count)
        return number, place, mix(self.spans[place] + np.repeat(mix(np.arange(len(text), dtype=U64)), count))

    def _covered(self, a: np.ndarray, b: np.ndarray, alike: np.ndarray) -> np.ndarray:
        """Code points of each text of `a` that common extensions with the text of `b` cover; `alike` from the start are known to."""
        (pair, i, key_a), (_, j, key_b) = self._anchors(a, np.maximum(0, alike - SPAN + 1)), self._anchors(b)
        kept = _sieved(key_a, key_b)
        pair, i, key_a = pair[kept], i[kept], key_a[kept]
        kept = _sieved(key_b, key_a)
        j, key_b = j[kept], key_b[kept]
        # The first place in b of each span of b; then the spans of a that are among them.
        distinct, first = np.unique(key_b, return_index=True)
        at = np.minimum(np.searchsorted(distinct, key_a), max(0, len(distinct) - 1))
        hit = distinct[at] == key_a if len(distinct) else np.zeros(len(key_a), bool)
        pair, i, j = pair[hit], i[hit], j[first[at[hit]]]
        joined = np.zeros(len(i), bool)  # with the anchor before
        joined[1:] = (pair[1:] == pair[:-1]) & (i[1:] == i[:-1] + 1) & (j[1:] == j[:-1] + 1)
        head = np.flatnonzero(~joined)
        last = np.append(head[1:], len(i))[: len(head)] - 1
        pair, left, right = pair[head], i[head], i[last]
        back = np.minimum(left - self.start[a[pair]], j[head] - self.start[b[pair]])
        ahead = np.minimum(self.end[a[pair]] - right, self.end[b[pair]] - j[last])
        begin = left - self.extension(left, j[head], back, backward=True)
        until = right + self.extension(right, j[last], ahead)
        first = np.flatnonzero(alike >= SPAN)
        pair, begin, until = np.append(first, pair), np.append(self.start[a[first]], begin), np.append((self.start[a] + alike)[first], until)
        cover = np.zeros(len(a), np.int64)
        if not len(pair):
            return cover
        order = np.lexsort((begin, pair))
        pair, begin, until = pair[order], begin[order], until[order]
        # Texts of `a` may repeat, so places of each pair are moved apart before overlaps are taken out.
        apart = pair * (self.hashes.n + 1)
        reach = np.maximum.accumulate(until + apart)
        before = np.append(0, reach[:-1])
        np.add.at(cover, pair, np.maximum(0, until + apart - np.maximum(begin + apart, before)))
        return cover

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Likeness of the texts numbered a and b, pair by pair."""
        n, m = self.size[a], self.size[b]
        alike = self.extension(self.start[a], self.start[b], np.minimum(n, m))
        common = (self._covered(a, b, alike) + self._covered(b, a, alike)) / 2
        tiny = np.minimum(n, m) < SPAN
        common[tiny] = alike[tiny]
        return np.where(n + m > 0, common / np.maximum(1, n + m - common), 1.0)


def _sieved(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places of `keys` without most of those that are not among the others."""
    seen = np.zeros(1 << SIEVE_BITS, bool)
    seen[others >> U64(64 - SIEVE_BITS)] = True
    return np.flatnonzero(seen[keys >> U64(64 - SIEVE_BITS)])


def render(sketched: tuple[int, int, np.ndarray]) -> str:
    """The fingerprint string: length, whole hash and values in hexadecimal."""
    n, whole, values = sketched
    return f"{n:x}-{whole:016x}-{values.astype('>u4').tobytes().hex()}"


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """Estimated Jaccard similarity of the span sets of two sketches."""
    if a[:2] == b[:2]:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    union = np.union1d(a[2], b[2])
    least = union[:KEEP] if max(len(a[2]), len(b[2])) >= KEEP else union  # fewer values are the whole set
    shared = np.intersect1d(a[2], b[2], assume_unique=True)
    return float(np.isin(least, shared, assume_unique=True).sum() / len(least))


def edited(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The text whose last floor(n/2) code points are replaced by as many first ones (or all) of the next text."""
    half = len(points) // 2
    return np.concatenate([points[: len(points) - half], following[:half]])


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def _bytes(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to it and to the next document.

    Documents are dealt into blocks of neighbouring doc_ids (at most MOST_BLOCKS, by approximate quantiles; they
    only set the balance). Each block is streamed in descending doc_id with one text carried along, so a block of
    any size fits. The first document of a block also goes to the block before it, which ends with its neighbour:
    one shuffle of the texts, and at most MOST_BLOCKS doc_ids reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = stored(rows.select("doc_id"), "ids")
    total = ids.count()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    wanted = max(1, min(MOST_BLOCKS, total // block_rows))
    cuts = sorted(set(ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.2 / wanted))) if wanted > 1 else []
    bounds = sorted({min(int(x), (1 << 63) - 1) for x in cuts})  # quantiles are doubles, so the largest ids round past a long
    # Block 0 holds the largest doc_ids; nulls are in the last one.
    placed = _blocks(rows, bounds)
    heads = {r["_block"]: r["head"] for r in _blocks(ids, bounds).groupBy("_block").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    # The head of each block is also wanted by the block before it, the very first head by the last block.
    before = {heads[b]: order[k - 1] for k, b in enumerate(order)}
    guests = [(h, b) for h, b in before.items() if h is not None]
    null_guest = before.get(None)
    marks = F.broadcast(spark.createDataFrame(guests, "doc_id long, _guest int")) if guests else None
    dealt = placed.join(marks, "doc_id", "left") if marks is not None else placed.withColumn("_guest", F.lit(None).cast("int"))
    if null_guest is not None:
        dealt = dealt.withColumn("_guest", F.when(F.col("doc_id").isNull(), F.lit(null_guest)).otherwise(F.col("_guest")))
    own = F.struct(F.col("_block").alias("b"), F.lit(0).alias("g"))
    both = F.when(F.col("_guest").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_guest").alias("b"), F.lit(1).alias("g"))))
    dealt = dealt.withColumn("_to", F.explode(both)).select(F.col("_to.b").alias("block"), F.col("_to.g").alias("guest"), "doc_id", "text")
    sorted_rows = dealt.repartition("block").sortWithinPartitions("block", "guest", F.col("doc_id").desc_nulls_last(), "text")

    most = BATCH_POINTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[np.ndarray] = []  # of `ids`, and at the end one that is only a next document
        block, ended, size = None, False, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for k in range(batch.num_rows):
                b, guest, doc_id, points = columns[0][k].as_py(), columns[1][k].as_py(), columns[2][k].as_py(), _points(columns[3][k].as_py())
                if b != block:
                    if len(texts) > 1:
                        yield _rows(ids, texts)
                    block, ended, ids, texts, size = b, False, [], [], 0
                if ended:  # the first guest of a block ends it; further ones (equal doc_ids) are not looked at
                    continue
                texts.append(points)
                size += len(points)
                if size > most and len(texts) > 1:
                    yield _rows(ids, texts)
                    ids, texts, size = [], [points], len(points)
                if guest:
                    ended = True
                    if len(texts) > 1:
                        yield _rows(ids, texts)
                    ids, texts = [], []
                else:
                    ids.append(doc_id)

    return sorted_rows.mapInArrow(run, SCHEMA)


def _rows(ids: list[int | None], texts: list[np.ndarray]) -> pa.RecordBatch:
    """Result rows of documents, each with the next one in `texts`."""
    n = len(ids)
    changed = [edited(texts[k], texts[k + 1]) for k in range(n)]
    batch = Batch([*texts, *changed])
    own = np.arange(n)
    found = batch.sketches()
    pairs = batch.alike(np.concatenate([own, own]), np.concatenate([own + n + 1, own + 1]))
    columns = [ids, [len(t) for t in texts[:n]], [hashlib.sha256(_bytes(t)).hexdigest() for t in changed], [render(x) for x in found[:n]], [render(x) for x in found[n + 1 :]], pairs[:n], pairs[n:]]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _blocks(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """Adds _block: how many bounds lie at or above the doc_id, from the largest down.

    The range of the bounds is cut into cells of one width. A row looks its cell up in a broadcast table of at most
    4 * MOST_BLOCKS rows and is compared with the bounds of that cell only.
    """
    if not bounds:
        return rows.withColumn("_block", F.lit(0))
    cells = 4 * len(bounds)
    width = max(1, (bounds[-1] - bounds[0]) // cells + 1)
    inside: dict[int, list[int]] = {}
    for b in bounds:
        inside.setdefault((b - bounds[0]) // width, []).append(b)
    table, seen = [], 0
    for cell in range(-1, cells + 1):
        here = inside.get(cell, [])
        table.append((cell, seen, here))
        seen += len(here)
    spark = rows.sparkSession
    lookup = F.broadcast(spark.createDataFrame(table, "_cell long, _before int, _here array<long>"))
    offset = F.col("doc_id").cast("decimal(20,0)") - F.lit(bounds[0])  # no 64-bit overflow
    cell = F.greatest(F.lit(-1), F.least(F.lit(cells), F.floor(offset / F.lit(width)).cast("decimal(38,0)"))).cast("long")
    below = F.col("_before") + F.size(F.filter("_here", lambda x: x < F.col("doc_id")))
    found = rows.withColumn("_cell", cell).join(lookup, "_cell", "left")
    block = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(F.lit(len(bounds)) - below)
    return found.withColumn("_block", block.cast("int")).drop("_cell", "_before", "_here")
