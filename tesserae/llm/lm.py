"""Bigram language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Counting: each task hashes the tokens of its texts and counts words and word pairs; counts travel as packed arrays,
dealt by the top bits of the hash into buckets, so they are pre-aggregated and no key is hot. Merged counts are
written once, by bucket and level, where the level of a count c is floor(log2 c).

Filter: an n-gram of level q is put in under (n-gram, 0) .. (n-gram, q). A lookup probes level after level until one
is missing, so it never reads a count too low, and one too high with a probability that falls with each level. Every
bucket has a segment of its own, sized to what it holds, built where its counts lie. Every word and pair is in it.
Up to MOST_FILTER_BYTES in all, the segments are broadcast. Past that, texts are cut into chunks of CHUNK_TEXT bytes;
the distinct n-grams of a chunk go to the partition of their segment by a shuffle, and their levels come back to the
chunk by another. Both ways read the same bits, so scores do not depend on which one is taken. The texts are cut
twice, so rows that come out of a shuffle are written first, and a chunk that was cut otherwise raises.

Probability: p(w | h) = t * c(h,w) / c(h) + (1 - t) * (c(w) + 1) / (C + V + 1), all c from the filter, C their sum;
t by the level of h, fitted by expectation maximisation on all training texts, each against the counts of the others:
what a text itself adds to c(h,w), c(h) and c(w) is taken off, and its tokens whose history then has nothing left are
passed over. A level without others, as that of histories that stand once, takes the weight of the next level that has
them. Levels are looked up once: the words' and pairs' levels of each text are written, two bytes a token before
compression, with a histogram of what fitting needs, and read again when the weights are known.

Base: exact add-one unigram scores. Counts of the most frequent words (at most HEAD_WORDS, 16 bytes each) are
broadcast; the rest of a text's words, which are rare, are looked up by an equi-join with the written counts.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lowered, then one end. Words are told apart by 64-bit hashes.

Defined cases: a null text is empty and has its end token only; a row with a null doc_id is a training row; with no
training rows N and V are 0; repeated rows are counted and scored one by one; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm._store import stored
from tesserae.llm._text import U64, chunks, mix, runs_of, signed, word_hashes

HEAD_WORDS = 1 << 21
#: Size up to which the filter is broadcast: the driver puts it together and every worker holds it.
MOST_FILTER_BYTES = 8 << 20
BITS_PER_ENTRY = 12
PROBES = 6
#: The weights are fitted on one in so many training texts: on every one.
TUNE_SHARE = 1
#: Tokens of whole texts that are fitted on or weighed at once; a longer text is alone.
GROUP_TOKENS = 1 << 17
#: Tokens counted before a task hands on its counts.
FLUSH_TOKENS = 2_000_000
#: Bytes of text whose n-grams are asked for together, where the filter is not broadcast; a longer text is a chunk.
CHUNK_TEXT = 8 << 20
#: Bytes of text hashed at once: each takes some 60 bytes meanwhile, a token only 40 for its whole chunk.
HASHED_TEXT = (1 << 20) - 1
#: N-grams looked up at once in a segment.
PROBE_KEYS = 500_000
#: Texts for each bucket of counts.
BUCKET_DOCS = 2000

END, BEGIN = U64(0x0E0D0E0D0E0D0E0D), U64(0x0B0E0B0E0B0E0B0E)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, history hash, document index) of every token, ends included, in order."""
    words, doc = word_hashes(data, offs)
    n = len(offs) - 1
    out = np.empty(len(words) + n, U64)
    count = np.bincount(doc, minlength=n) + 1
    ends = np.cumsum(count) - 1
    isend = np.zeros(len(out), bool)
    isend[ends] = True
    out[isend], out[~isend] = END, words
    history = np.empty(len(out), U64)
    history[1:] = out[:-1]
    history[ends - count + 1] = BEGIN
    return out, history, np.repeat(np.arange(n), count)


def pair_key(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(history * U64(0x9E3779B97F4A7C15) + token)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = runs_of(keys)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def low_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of a hash that come after those of its bucket: ascending inside a bucket, as hashes are."""
    return ((keys << U64(bits)) >> U64(32)).astype(np.uint32)


def packed_keys(low: np.ndarray) -> bytes:
    """Ascending 32-bit keys as differences of three bytes each, after the first key; as they are where one is wider."""
    step = np.diff(low, prepend=low[:1])
    if len(low) and int(step.max()) < 1 << 24:
        return b"\x03" + low[:1].tobytes() + step.astype("<u4").view(np.uint8).reshape(-1, 4)[1:, :3].tobytes()
    return b"\x04" + low.tobytes()


def unpacked_keys(body: bytes) -> np.ndarray:
    if body[:1] == b"\x04":
        return np.frombuffer(body, np.uint32, offset=1)
    step = np.zeros(((len(body) - 5) // 3 + 1, 4), np.uint8)
    step[1:, :3] = np.frombuffer(body, np.uint8, offset=5).reshape(-1, 3)
    out = step.view("<u4").ravel()
    out[0] = np.frombuffer(body, np.uint32, 1, 1)[0]
    return np.cumsum(out, dtype=np.uint32)


def _counted(train: DataFrame, bits: int) -> DataFrame:
    """(kind, bucket, keys, counts): packed counts of words (kind 0) and pairs (kind 1) from each task."""
    shift = U64(64 - bits)

    def packed(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bucket = (keys >> shift).astype(np.int32)
        starts = runs_of(bucket)
        bounds = np.append(starts, len(keys))
        body = keys if kind == 0 else low_of(keys, bits)  # the bucket holds a pair's other bits
        parts = list(zip(bounds[:-1], bounds[1:], strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(starts), kind, np.int32)), pa.array(bucket[starts]), pa.array([body[a:b].tobytes() if kind == 0 else packed_keys(body[a:b]) for a, b in parts], pa.binary()), pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in parts], pa.binary())],
            names=["kind", "bucket", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, arrays in enumerate(held):
                if arrays:
                    yield packed(kind, *np.unique(np.concatenate(arrays), return_counts=True))
                arrays.clear()

        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0), HASHED_TEXT):
                token, history, _ = tokens(data, offs)
                held[0].append(token)
                held[1].append(pair_key(history, token))
                size += len(token)
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    size = 0
        yield from flush()

    return train.select("text").mapInArrow(run, "kind int, bucket int, keys binary, counts binary")


def _merged(counted: DataFrame) -> DataFrame:
    """(kind, bucket, level, n, total, keys, counts): the whole corpus's counts, packed by bucket and level."""
    dealt = counted.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")

    def leveled(kind: int, bucket: int, k: np.ndarray, c: np.ndarray) -> list[tuple]:
        level = np.frexp(c.astype(np.float64))[1] - 1
        return [(kind, bucket, int(q), int((level == q).sum()), int(c[level == q].sum()), k[level == q].tobytes(), c[level == q].tobytes() if kind == 0 else b"") for q in np.unique(level)]

    def finish(kind: int, bucket: int, parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        keys = np.concatenate([np.frombuffer(k, U64) if kind == 0 else unpacked_keys(k) for k, _ in parts])
        rows = leveled(kind, bucket, *_merge(keys, np.frombuffer(b"".join(c for _, c in parts), np.uint32).astype(np.int64)))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "bucket", "level", "n", "total", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for kind, bucket, k, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at is not None and at != (kind, bucket):
                    yield finish(*at, parts)
                    parts = []
                at = (kind, bucket)
                parts.append((k, c))
        if at is not None:
            yield finish(*at, parts)

    return dealt.mapInArrow(run, "kind int, bucket int, level int, n long, total long, keys binary, counts binary")


def _positions(kind: int, low: np.ndarray, level: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The PROBES bit positions of (n-gram, level) in a segment of so many bits."""
    h = mix(low.astype(U64) * U64(0xD1342543DE82EF95) + U64((2 * level + kind + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    a, b = h & U64(0xFFFFFFFF), (h >> U64(32)) | U64(1)
    size = np.asarray(bits, U64)
    for i in range(PROBES):
        yield (a + U64(i) * b) % size


def _probed(body: np.ndarray, kind: int, low: np.ndarray, size: np.ndarray, base: np.ndarray) -> np.ndarray:
    """1 + level of each n-gram in the segment of so many bits at its base, 0 if it is absent."""
    out = np.zeros(len(low), np.int64)
    live = np.arange(len(low))
    level = 0
    while len(live):
        for k, where in enumerate(_positions(kind, low, level, size)):
            at = base + where
            hit = (body[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0
            if k == 0:
                every = hit
            else:
                every &= hit
        live, low, size, base = live[every], low[every], size[every], base[every]
        out[live] += 1
        level += 1
        if level > 62:
            break
    return out


class LogFrequencyFilter:
    """Segments of bits, one for each bucket."""

    def __init__(self, bits: int, segments: list[tuple[int, int, bytes]]) -> None:
        self.bits, self.shift = bits, U64(64 - bits)
        self.size = np.ones(1 << bits, U64)
        self.base = np.zeros(1 << bits, U64)
        self.body = np.zeros(1 + sum(len(body) for _, _, body in segments), np.uint8)
        at = 1  # absent buckets look at the first byte, which is 0
        for bucket, size, body in segments:
            self.size[bucket], self.base[bucket] = size, at * 8
            self.body[at : at + len(body)] = np.frombuffer(body, np.uint8)
            at += len(body)

    def levels(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """1 + level of each n-gram as the filter has it, 0 if it is absent."""
        bucket = (keys >> self.shift).astype(np.int64)
        return _probed(self.body, kind, low_of(keys, self.bits), self.size[bucket], self.base[bucket])


class Looked:
    """Tokens of some texts (rows row to end of a batch) with the levels of the words, their histories and the pairs."""

    def __init__(self, row: int, end: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.row, self.end = row, end
        self.token, self.history, self.doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.pair = pair_key(self.history, self.token)
        self.words, self.place = np.unique(self.token, return_inverse=True)

    def give(self, word_level: np.ndarray, pair_level: np.ndarray) -> Looked:
        """Levels of the distinct `words` and of every pair."""
        self.word_level, self.pair_level = word_level[self.place], pair_level
        self.history_level = np.empty(len(self.token), np.int64)
        self.history_level[1:] = self.word_level[:-1]
        self.history_level[self.history == BEGIN] = word_level[np.searchsorted(self.words, END)]  # as many beginnings as ends
        return self


def expected_count(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level (1 + floor(log2 c)); 0 for absent n-grams."""
    return np.where(levels > 0, 1.5 * np.exp2(levels - 1.0) - 0.5, 0.0)


def _segment(rows: list[tuple[int, int, bytes]], bits: int, per_entry: int) -> tuple[int, np.ndarray]:
    """(bits, packed body) of the segment that holds the n-grams of (kind, level, keys)."""
    entries = sum((level + 1) * (len(keys) // (8 if kind == 0 else 4)) for kind, level, keys in rows)
    size = -(-entries * per_entry // 64) * 64
    grid = np.zeros(size, np.uint8)
    for kind, level, keys in rows:
        low = low_of(np.frombuffer(keys, U64), bits) if kind == 0 else np.frombuffer(keys, np.uint32)
        for q in range(level + 1):
            for where in _positions(kind, low, q, size):
                grid[where.astype(np.int64)] = 1
    return size, np.packbits(grid, bitorder="little")


def _build(kept: DataFrame, bits: int) -> LogFrequencyFilter:
    """Segments are built by bucket on the executors; only their bits, bounded in sum, come to the driver."""
    dealt = kept.repartition("bucket").sortWithinPartitions("bucket")
    per_entry = BITS_PER_ENTRY

    def segment(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        size, body = _segment(rows, bits, per_entry)
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([size], pa.int64()), pa.array([body.tobytes()], pa.binary())], names=["bucket", "size", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for bucket, kind, level, keys in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at is not None and at != bucket:
                    yield segment(at, rows)
                    rows = []
                at = bucket
                rows.append((kind, level, keys))
        if at is not None:
            yield segment(at, rows)

    return LogFrequencyFilter(bits, [(r["bucket"], r["size"], r["body"]) for r in dealt.mapInArrow(run, "bucket int, size long, body binary").collect()])


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Chunks of rows (uid, doc_id, _held, text), each with its first uid, alike for equal rows in equal order."""
    for batch in batches:
        for row, end, _, _ in chunks(batch.column(3), most):
            yield batch.column(0)[row].as_py(), batch.slice(row, end - row)


def _whole(column: pa.Array) -> Looked:
    """All texts of a chunk at once; their bytes are hashed a part at a time."""
    parts = []
    for row, _, data, offs in chunks(column, HASHED_TEXT):
        token, history, doc = tokens(data, offs)
        parts.append((token, history, doc + row))
    return Looked(0, len(column), parts)


def _asked(texts: DataFrame, bits: int) -> DataFrame:
    """(chunk, bucket, words, pairs): what each chunk asks of each bucket."""
    shift, most = U64(64 - bits), CHUNK_TEXT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in _cut(batches, most):
            seen = _whole(own.column(3))
            words, pairs = seen.words, np.unique(seen.pair)
            bucket = np.unique(np.concatenate([words >> shift, pairs >> shift]))
            body = []
            for keys in (words, pairs):
                at = np.append(np.searchsorted(keys >> shift, bucket), len(keys))
                low = low_of(keys, bits)
                body.append(pa.array([packed_keys(low[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), number, np.int64)), pa.array(bucket.astype(np.int32)), *body], names=["chunk", "bucket", "words", "pairs"])

    return texts.mapInArrow(run, "chunk long, bucket int, words binary, pairs binary")


def _numbered(texts: DataFrame) -> DataFrame:
    """`texts` with the number of the chunk of each row."""
    most = CHUNK_TEXT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in _cut(batches, most):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, number, np.int64)), *own.columns], names=["chunk", "uid", "doc_id", "_held", "text"])

    return texts.mapInArrow(run, "chunk long, uid long, doc_id long, _held boolean, text string")


def _answered(asks: DataFrame, kept: DataFrame, bits: int) -> DataFrame:
    """(chunk, bucket, words, pairs): the levels of what chunks ask for, looked up where the segment of the bucket is."""
    held = kept.select("bucket", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("pairs"), "kind", "level", "keys")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("kind", "int"), ("level", "int"), ("keys", "binary"))]
    both = held.unionByName(asks.select("bucket", "chunk", "words", "pairs", *none))
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())
    per_entry, most = BITS_PER_ENTRY, PROBE_KEYS

    def look(bucket: int, segment: tuple[int, np.ndarray], asked: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        size, body = segment
        columns = []
        for kind in (0, 1):
            each = [unpacked_keys(row[1 + kind]) for row in asked]
            low = np.concatenate(each)
            level = _probed(body, kind, low, np.full(len(low), size, U64), np.zeros(len(low), U64)).astype(np.uint8) if size else np.zeros(len(low), np.uint8)
            at = np.cumsum([0, *map(len, each)])
            columns.append(pa.array([level[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([row[0] for row in asked], pa.int64()), pa.array(np.full(len(asked), bucket, np.int32)), *columns], names=["chunk", "bucket", "words", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, segment, asked, size = None, [], None, [], 0
        for batch in batches:
            for bucket, chunk, words, pairs, kind, level, keys in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if bucket != at:
                    if asked:
                        yield look(at, segment, asked)
                    at, rows, segment, asked, size = bucket, [], None, [], 0
                if chunk is None:
                    rows.append((kind, level, keys))
                    continue
                if segment is None:
                    segment, rows = _segment(rows, bits, per_entry), []
                asked.append((chunk, words, pairs))
                size += (len(words) + len(pairs)) // 3
                if size >= most:
                    yield look(at, segment, asked)
                    asked, size = [], 0
        if asked:
            yield look(at, segment, asked)

    return dealt.mapInArrow(run, "chunk long, bucket int, words binary, pairs binary")


def _by_chunk(texts: DataFrame, kept: DataFrame, bits: int, use: Callable[[Looked, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `use` makes of the rows (uid, doc_id, _held, text) of each chunk and of the answers to what the chunk asks."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("bucket", "int"), ("words", "binary"), ("pairs", "binary"))]
    both = _numbered(texts).select("chunk", *none, "uid", "doc_id", "_held", "text").unionByName(_answered(_asked(texts, bits), kept, bits), allowMissingColumns=True)
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", F.col("bucket").asc_nulls_last(), "uid")

    def finish(words: list[bytes], pairs: list[bytes], rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in pa.Table.from_batches(rows).combine_chunks().to_batches():
            seen = _whole(own.column(3))
            distinct, place = np.unique(seen.pair, return_inverse=True)
            word_level, pair_level = (np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) for parts in (words, pairs))
            if len(word_level) != len(seen.words) or len(pair_level) != len(distinct):
                raise ValueError("a chunk's texts are not those it asked for: the input's rows change their order")
            yield from use(seen.give(word_level, pair_level[place]), own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, pairs, rows = None, [], [], []
        for batch in batches:
            chunk = batch.column(0).to_numpy(zero_copy_only=False)
            answer = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            bounds = [*runs_of(2 * chunk + answer), len(chunk)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if chunk[a] != at:
                    if rows:
                        yield from finish(words, pairs, rows)
                    at, words, pairs, rows = chunk[a], [], [], []
                if answer[a]:
                    words += batch.column(2).slice(a, b - a).to_pylist()
                    pairs += batch.column(3).slice(a, b - a).to_pylist()
                else:
                    rows.append(batch.slice(a, b - a).select([4, 5, 6, 7]))
        if rows:
            yield from finish(words, pairs, rows)

    return dealt.mapInArrow(run, schema)


class Model:
    """What scoring needs, on every worker: the filter (unless it is asked by bucket), the weights and the head of the word counts."""

    def __init__(self, held: LogFrequencyFilter | None, words: int, mass: float) -> None:
        self.filter, self.words, self.mass = held, words, mass
        self.weights = np.full(64, 0.3)
        self.weights[0] = 0.0
        self.head_keys, self.head_counts = np.zeros(0, U64), np.zeros(0, np.int64)

    def without_filter(self) -> Model:
        """What a task needs beside the levels."""
        out = copy(self)
        out.filter = None
        return out

    def parts(self, word: np.ndarray, history: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair probability, word probability) of tokens whose words, histories and pairs have these counts."""
        follow = np.divide(pair, history, out=np.zeros(len(history)), where=history > 0)
        return np.minimum(1.0, follow), (word + 1) / (self.mass + self.words + 1)

    def log10(self, word_level: np.ndarray, history_level: np.ndarray, pair_level: np.ndarray) -> np.ndarray:
        pair, word = self.parts(*map(expected_count, (word_level, history_level, pair_level)))
        t = self.weights[history_level]
        return np.log10(t * pair + (1 - t) * word)

    def left_out(self, seen: Looked, tuned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Histogram over the tokens of the texts in `tuned` of (level of the history, ratio of pair to word probability), a text's own counts taken off."""
        found = []
        ends = np.append(np.flatnonzero(np.diff(seen.doc)), len(seen.doc) - 1) + 1  # of each text's tokens
        for a, b in groups(np.diff(ends, prepend=0)):
            at = slice(ends[a - 1] if a else 0, ends[b - 1])
            doc, history_level = seen.doc[at], seen.history_level[at]
            salt = mix((doc - doc[0]).astype(U64) + U64(1))
            own_word, own_pair = (_times(mix(keys[at] ^ salt)) for keys in (seen.token, seen.pair))
            begins = seen.history[at] == BEGIN
            own_history = np.where(begins, 1, np.roll(own_word, 1))
            word, history, pair = (np.maximum(0.0, expected_count(level) - own) for level, own in ((seen.word_level[at], own_word), (history_level, own_history), (seen.pair_level[at], own_pair)))
            use = tuned[doc] & (history >= 1)
            follow, alone = self.parts(word[use], history[use], pair[use])
            ratio = np.where(follow > 0, np.rint(2 * np.log2(np.maximum(follow, 1e-300) / alone)), -9999).astype(np.int64)
            found.append(np.unique(history_level[use] * 100_000 + ratio + 50_000, return_counts=True))
        return _merge(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _times(keys: np.ndarray) -> np.ndarray:
    """How often each key stands among the keys."""
    _, place, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[place]


def groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of texts of about GROUP_TOKENS tokens in all, at least one text each."""
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + GROUP_TOKENS, side="right")))
        yield a, b
        a = b


def _packed_levels(seen: Looked, bounds: np.ndarray) -> list[bytes]:
    """The levels of the words and pairs of each text; those of histories follow from them."""
    both = np.stack([seen.word_level, seen.pair_level], axis=1).astype(np.uint8)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        press = zlib.compressobj(1, zlib.DEFLATED, -15, 4, zlib.Z_HUFFMAN_ONLY)
        out.append(press.compress(both[a:b]) + press.flush())
    return out


def _used(model: Model, texts: DataFrame, kept: DataFrame, bits: int, use: Callable[[Looked, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `use` makes of rows (uid, doc_id, _held, text) and their levels, from the model's filter or by bucket."""
    if model.filter is None:
        return _by_chunk(texts, kept, bits, use, schema)

    shared = texts.sparkSession.sparkContext.broadcast(model.filter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for row, end, data, offs in chunks(batch.column(3)):
                seen = Looked(row, end, [tokens(data, offs)])
                yield from use(seen.give(held.levels(0, seen.words), held.levels(1, seen.pair)), batch)

    return texts.mapInArrow(run, schema)


def _tune(model: Model, scored: DataFrame) -> None:
    """Fits the weights by level on the histograms of all chunks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                both, n = np.frombuffer(body, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(n)], names=["both", "n"])

    rows = scored.where("fit IS NOT NULL").select("fit").mapInArrow(unpack, "both long, n long").groupBy("both").agg(F.sum("n").alias("n")).collect()
    by_level: dict[int, list[tuple[float, int]]] = {}
    for r in rows:
        level, ratio = divmod(r["both"], 100_000)
        by_level.setdefault(level, []).append((0.0 if ratio - 50_000 == -9999 else 2.0 ** ((ratio - 50_000) / 2), r["n"]))
    for level, seen in by_level.items():
        ratio, n = (np.array(x, np.float64) for x in zip(*seen, strict=True))
        t = 0.3
        for _ in range(50):
            t = float((n * t * ratio / (t * ratio + 1 - t)).sum() / n.sum())
            t = min(max(t, 1e-4), 0.95)
        model.weights[level] = t
    fitted = sorted(by_level)
    for level in range(1, len(model.weights)):
        if fitted and level not in by_level:
            model.weights[level] = model.weights[next((q for q in fitted if q > level), fitted[-1])]


def _head(merged: DataFrame, level: int) -> tuple[np.ndarray, np.ndarray]:
    rows = merged.where(f"kind = 0 AND level >= {level}").select("keys", "counts").collect()
    keys = np.frombuffer(b"".join(bytes(r["keys"]) for r in rows), U64)
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in rows), np.int64)
    del rows
    order = np.argsort(keys)
    return keys[order], counts[order]


def _head_level(histogram: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Least level of head words under their bound."""
    return min((q for k, q in histogram if k == 0 and sum(n for (kind, p), (n, _) in histogram.items() if kind == 0 and p >= q) <= HEAD_WORDS), default=64)


def remainder(doc_id: str, modulus: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(-1))


def score_documents(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns where not held out."""
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = stored(docs, "lm-docs")
    held = F.coalesce(held_out if held_out is not None else remainder("doc_id", 7) == 2, F.lit(False))
    marked = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("_held"))
    train = marked.where("NOT _held")
    bits = max(4, int(np.ceil(np.log2(max(1, docs.count() / BUCKET_DOCS)))))
    merged = stored(_merged(_counted(train, bits)), "lm-counts")
    histogram = {(r["kind"], r["level"]): (r["n"], r["total"]) for r in merged.groupBy("kind", "level").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    n_train = sum(t for (k, _), (_, t) in histogram.items() if k == 0)
    n_words = sum(n for (k, _), (n, _) in histogram.items() if k == 0)
    head_level = _head_level(histogram)
    mass = sum(n * float(expected_count(np.array([q + 1]))[0]) for (k, q), (n, _) in histogram.items() if k == 0)
    kept = merged.select("bucket", "kind", "level", "keys")
    held_bytes = sum(n * (q + 1) for (_, q), (n, _) in histogram.items()) * BITS_PER_ENTRY // 8
    model = Model(_build(kept, bits) if held_bytes <= MOST_FILTER_BYTES else None, n_words, mass)
    model.head_keys, model.head_counts = _head(merged, head_level)
    shared = docs.sparkSession.sparkContext.broadcast(model.without_filter())
    all_head = head_level <= min((q for k, q in histogram if k == 0), default=0)

    share = TUNE_SHARE

    def look(seen: Looked, own: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = shared.value
        row, n, doc = seen.row, seen.end - seen.row, seen.doc
        at = np.minimum(np.searchsorted(model.head_keys, seen.words), max(0, len(model.head_keys) - 1))
        known = model.head_keys[at] == seen.words if len(model.head_keys) else np.zeros(len(seen.words), bool)
        count = np.where(known, model.head_counts[at] if len(model.head_counts) else 0, 0)
        logs, known = np.log10(count + 1.0)[seen.place], known[seen.place]
        rare = np.flatnonzero(~known) if not all_head else np.zeros(0, np.int64)
        bounds = np.searchsorted(doc[rare], np.arange(n + 1)).astype(np.int32)
        held = own.column(2).slice(row, n).to_numpy(zero_copy_only=False)
        fit = np.concatenate(model.left_out(seen, ~held & (pc.fill_null(own.column(1).slice(row, n), 0).to_numpy(zero_copy_only=False) % share == 0)))
        out = [
            *(own.column(c).slice(row, n) for c in range(3)),
            pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
            pa.array(np.bincount(doc, weights=known, minlength=n).astype(np.int64)),
            pa.array(np.bincount(doc, weights=logs, minlength=n)),
            pa.array(_packed_levels(seen, np.searchsorted(doc, np.arange(n + 1))), pa.binary()),
            pa.array([fit.astype(np.int64).tobytes(), *[None] * (n - 1)], pa.binary()),
            pa.ListArray.from_arrays(pa.array(bounds), pa.array(signed(seen.token[rare]))),
        ]
        yield pa.RecordBatch.from_arrays(out, names=["uid", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "levels", "fit", "rare"])

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, levels binary, fit binary, rare array<long>"
    scored = stored(_used(model, marked.select("uid", "doc_id", "_held", "text"), kept, bits, look, schema), "lm-scores")
    _tune(model, scored)
    fitted = Model(None, n_words, mass)
    fitted.weights = model.weights

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, found = batch.column(3).to_numpy(), []
            for a, b in groups(size):
                word, pair = np.frombuffer(b"".join(zlib.decompress(x, -15) for x in batch.column(6).slice(a, b - a).to_pylist()), np.uint8).reshape(-1, 2).T.astype(np.int64)
                end = np.cumsum(size[a:b])
                history = np.roll(word, 1)
                history[end - size[a:b]] = word[end - 1]  # a beginning counts as the end does
                found.append(np.bincount(np.repeat(np.arange(b - a), size[a:b]), weights=fitted.log10(word, history, pair), minlength=b - a))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(np.concatenate([np.zeros(0), *found]))], names=[*batch.schema.names[:6], "score"])

    weighed = scored.drop("fit", "rare").mapInArrow(weigh, "uid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, score double")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(counts, np.int64))], names=["word", "c"])

    tail = merged.where(f"kind = 0 AND level < {head_level}").select("keys", "counts").mapInArrow(unpack, "word long, c long")
    asked = scored.select("uid", F.explode("rare").alias("word"))
    found = asked.join(tail, "word").groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("tail_log"), F.count("*").alias("tail_known"))
    out = weighed.join(found, "uid", "left")
    base = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n_train + n_words + 1)))
    known = F.col("head_known") + F.coalesce("tail_known", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
