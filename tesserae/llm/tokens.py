"""Token counts of whole texts with a public SentencePiece BPE model, huge texts by overlap resynchronisation.

A text of up to `chunk_chars` characters is encoded as it is. A longer one is encoded in chunks that overlap; each
chunk's tokens come with character offsets, and neighbours are spliced at a position in their overlap where both
have a token boundary and that is proven stable: no piece of the vocabulary holds the two characters around it
side by side, so no merge can ever cross it and what stands left and right of it is encoded independently. If the
overlap holds no such position, it is widened, in the end to the whole text, so counts are always the library's.

Proof sketch: BPE only ever merges two neighbouring symbols into a piece of the vocabulary. A symbol that covers
positions p-1 and p holds those two characters side by side; if no piece does, no such symbol arises and merges
left of p never look at symbols right of it. The model's normaliser is the identity, but for the dummy space it
puts before a text; that space can only reach up to a chunk's first stable position.

Defined cases: a null text is empty and has 0 tokens; null doc_ids and repeated rows are rows like others; an
empty table gives no rows; columns of the input that are not asked for play no part; bytes that are not UTF-8 are
encoded as U+FFFD and count in n_bytes as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm._text import chunks

#: Characters of a text above which it is encoded in chunks, and of a chunk.
CHUNK_CHARS = 16384
#: Characters by which chunks overlap at first.
OVERLAP_CHARS = 256


class PieceCounter:
    """Counts tokens under one model. `model` is the model file's bytes, so executors need no file."""

    def __init__(self, model: bytes, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk_chars, self.overlap_chars = chunk_chars, overlap_chars
        n = self.processor.vocab_size()
        pieces = [self.processor.id_to_piece(i) for i in range(n)]
        plain = [not (self.processor.is_byte(i) or self.processor.is_control(i) or self.processor.is_unknown(i)) for i in range(n)]
        self.joined = {(a, b) for p, ok in zip(pieces, plain, strict=True) if ok for a, b in zip(p, p[1:], strict=False)}
        # Characters that a token covers; of the bytes of a character outside the vocabulary, the first counts.
        self.width = np.array([len(p) if ok else 0 for p, ok in zip(pieces, plain, strict=True)], np.int64)
        for i in range(n):
            if self.processor.is_byte(i):
                byte = int(pieces[i][1:-1], 16)
                self.width[i] = byte < 0x80 or byte >= 0xC0
        self.widened = 0

    def stable(self, text: str, p: int) -> bool:
        """Whether no piece can cross position p of `text`."""
        a, b = text[p - 1].replace(" ", "▁"), text[p].replace(" ", "▁")
        return (a, b) not in self.joined

    def ends(self, text: str) -> np.ndarray:
        """The end of every token, in characters of `text`."""
        ids = np.asarray(self.processor.encode(text), np.int64)
        return np.cumsum(self.width[ids]) - 1  # less the dummy space

    def count_huge(self, text: str) -> int:
        """Tokens of a text by chunks; equal to len(encode(text))."""
        total, at, n = 0, 0, len(text)
        overlap, size = self.overlap_chars, self.chunk_chars
        while True:
            begin = max(0, at - overlap) if at else 0
            end = min(n, max(at, begin) + size)
            ends = self.ends(text[begin:end]) + begin
            # All up to `at` are counted; `at` must be a boundary here too, beyond the reach of the dummy space.
            if at and not (begin == 0 or (at in ends and self._settled(text, begin, at))):
                self.widened += 1
                overlap *= 2
                continue
            done = int(np.searchsorted(ends, at, side="right")) if at else 0
            if end == n:
                return total + len(ends) - done
            cut = self._cut(text, ends, max(at, end - overlap), end)
            if cut is None:
                self.widened += 1
                overlap, size = overlap * 2, size * 2
                continue
            total += int(np.searchsorted(ends, cut, side="right")) - done
            at, overlap, size = cut, self.overlap_chars, self.chunk_chars

    def _settled(self, text: str, begin: int, at: int) -> bool:
        """Whether a stable position lies in (begin, at]: the dummy space cannot reach beyond it."""
        return any(self.stable(text, p) for p in range(at, begin, -1))

    def _cut(self, text: str, ends: np.ndarray, low: int, end: int) -> int | None:
        """The last token boundary in (low, end) that is stable."""
        for p in ends[::-1]:
            if p <= low:
                return None
            if p < end and self.stable(text, int(p)):
                return int(p)
        return None

    def counts(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= self.chunk_chars]
        encoded = iter(self.processor.encode(short, num_threads=1)) if short else iter(())
        return [len(next(encoded)) if len(t) <= self.chunk_chars else self.count_huge(t) for t in texts]


@lru_cache(maxsize=2)
def _counter(model: bytes, chunk_chars: int, overlap_chars: int) -> PieceCounter:
    return PieceCounter(model, chunk_chars, overlap_chars)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text; one pass over (doc_id, text), no shuffle.

    The model file (under 1 MB) is read on the driver and travels with the task. Texts are encoded in runs of a
    few MB, so a task's memory is bounded by one such run or its longest text.
    """
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value, chunk_chars, overlap_chars)
        for batch in batches:
            for row, end, data, offs in chunks(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b].decode(errors="replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
                n = np.array(counter.counts(texts), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row).cast(pa.int64()), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
