"""Token counts of whole documents; huge ones by overlapping chunks that are spliced at proven stable boundaries.

A merge of the vocabulary only ever makes a piece of the vocabulary. So where no piece holds the characters left and
right of a boundary next to each other, no merge crosses it, whatever stands around: the boundary is stable, and the
tokens on either side do not depend on the other side. Chunks of a huge document overlap; each is encoded with the
offsets of its tokens, and two neighbours are spliced at the first offset of the overlap where both have a token end and
the boundary is stable. If an overlap holds none, it is widened, and the chunk then doubled, in the end to the rest of the document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import replaced, small_batches, with_fields

SPACE_MARK = "▁"


class PieceCounter:
    """Counts tokens as a sentencepiece BPE model gives them, without begin or end tokens."""

    def __init__(self, path: str, chunk: int = 100_000, overlap: int = 2_000):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.crossed = set()
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)):
                p = self.model.id_to_piece(i)
                self.crossed.update(p[k : k + 2] for k in range(len(p) - 1))
        # Chunking relies on text that the model's normaliser leaves alone, but for the mark of spaces and one in front.
        probe = " \tAä ｆ▁  b\n"
        self.plain = self.model.normalize(probe) == SPACE_MARK + probe.replace(" ", SPACE_MARK)

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk or not self.plain]
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk and self.plain:
                out[i] = self.long(t)
        return out

    def ends(self, marked: str, start: int, stop: int) -> list[int]:
        """Ends of the tokens of marked[start:stop], as offsets in ``marked``.

        The encoder puts a mark in front of what it gets, so a chunk starts at a mark, which is left to the encoder.
        Bytes of one character end together at that character's end, where the last of them does.
        """
        pieces = self.model.encode(marked[start + 1 : stop], out_type=str)
        if stop == start + 1:  # an empty text has no tokens, but a lone mark has one
            return [stop]
        out, at, held = [], start, 0
        for p in pieces:
            if len(p) == 6 and p.startswith("<0x") and self.model.is_byte(self.model.piece_to_id(p)):
                held -= 1
                if held < 0:
                    held = len(marked[at].encode("utf-8", "replace")) - 1
                    at += 1
                out.append(at)
            else:
                at += len(p)
                out.append(at)
        return out

    def stable(self, marked: str, at: int) -> bool:
        return marked[at] == SPACE_MARK and marked[at - 1 : at + 1] not in self.crossed

    def next_stable(self, marked: str, start: int, stop: int) -> int | None:
        at = marked.find(SPACE_MARK, start, stop)
        while at >= 0 and not self.stable(marked, at):
            at = marked.find(SPACE_MARK, at + 1, stop)
        return at if at >= 0 else None

    def long(self, text: str) -> int:
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        total, done, stop = 0, 0, min(len(marked), self.chunk)
        ends = self.ends(marked, done, stop)
        while stop < len(marked):
            overlap, splice = self.overlap, None
            while splice is None:
                lo = max(done + 1, stop - overlap)
                nxt = self.next_stable(marked, lo, stop)
                if nxt is not None:
                    further = min(len(marked), nxt + self.chunk)
                    more = self.ends(marked, nxt, further)
                    both = set(more)
                    splice = next((e for e in ends[bisect_left(ends, nxt + 1) :] if e < stop and e in both and self.stable(marked, e)), None)
                if lo == done + 1:
                    break
                overlap *= 2
            if splice is None:  # nothing in reach: encode on from the last splice with a chunk of twice the size
                stop = min(len(marked), done + 2 * (stop - done))
                ends = self.ends(marked, done, stop)
            else:
                total += bisect_left(ends, splice + 1) - bisect_left(ends, done + 1)
                ends, done, stop = more[bisect_left(more, splice + 1) :], splice, further
        return total + len(ends) - bisect_left(ends, done + 1)


@lru_cache(maxsize=2)
def counter(path: str, chunk: int, overlap: int) -> PieceCounter:
    return PieceCounter(path, chunk, overlap)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk: int = 100_000, overlap: int = 2_000) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``), replacing columns of those names.

    ``path`` is the sentencepiece model, found at the same place on every executor. A null text counts as empty: no
    bytes, no tokens. Rows are never dropped or joined; every other column passes through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, chunk, overlap)
        for b in small_batches(batches, 500):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = c.counts(texts)
            yield replaced(b, n_bytes=pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), n_tokens=pa.array(n, pa.int64()), over_limit=pa.array([x > limit for x in n], pa.bool_()))

    return docs.mapInArrow(run, with_fields(docs, "n_bytes long, n_tokens long, over_limit boolean"))
