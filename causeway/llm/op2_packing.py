"""Sum-of-squares packing of documents into training windows.

Each input partition is a stream. Its level array counts the open windows by fill level; a document's
rest (what full windows leave of it) goes to the level, or to a new window, that keeps the sum of
squared counts smallest. Documents of a window or more fill windows of their own first. When the
stream ends, windows still open are drained: their pieces are laid end to end and cut at the window
length, so a partition leaves one window unfilled at most. No shuffle and no state beyond the open
windows, of which there are few by the rule itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, small_batches
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """The level array: how many windows are open at each fill, and which."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.pieces: dict[int, list[tuple]] = {}
        self.windows = 0

    def new(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, n: int, piece: tuple) -> tuple[int, list[tuple]] | None:
        """Puts a piece of n ids (0 < n < size) in a window; returns the window with all its pieces once full."""
        c, size = self.counts, self.size
        # growth of the sum of squares when level h gives a window to level h + n
        levels = np.flatnonzero(c[1 : size - n + 1]) + 1
        best, level = 2 * int(c[n]) + 1, 0
        if len(levels):
            target = np.where(levels + n < size, c[np.minimum(levels + n, size)], 0)
            change = 2 - 2 * c[levels] + 2 * target
            change = np.where(levels + n == size, 1 - 2 * c[levels], change)
            k = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal changes the fullest window
            if change[k] <= best:
                level = int(levels[k])
        if level:
            window = self.open[level].pop()
            c[level] -= 1
        else:
            window = self.new()
            self.pieces[window] = []
        self.pieces[window].append(piece)
        if level + n == size:
            return window, self.pieces.pop(window)
        c[level + n] += 1
        self.open[level + n].append(window)
        return None


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and end_id; a null or empty text is end_id alone. Rows may
    repeat: each row is a document. An empty table gives no piece. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, levels, first = encoder(tokenizer, "word"), SumOfSquares(window), TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4").tobytes()
        kinds = [pa.field(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")]

        def emit(sequence: int, pieces: list[tuple], rows: list) -> None:
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, first + sequence, at))
                at += len(ids) // 4

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], schema=pa.schema(kinds))

        for b in batches:
            rows: list = []
            for doc, ids in zip(b["doc_id"].to_pylist(), enc.encode(b["text"].to_pylist())):
                ids += end
                total, at = len(ids) // 4, 0
                while total - at >= window:
                    emit(levels.new(), [(doc, at, ids[4 * at : 4 * (at + window)], total)], rows)
                    at += window
                if at < total and (full := levels.place(total - at, (doc, at, ids[4 * at :], total))):
                    emit(*full, rows)
            if rows:
                yield batch(rows)
        rows, left, room = [], [], window
        for pieces in levels.pieces.values():  # the drain: at most one window stays open
            for doc, start, ids, total in pieces:
                while ids:
                    take = ids[: 4 * room]
                    left.append((doc, start, take, total))
                    ids, start, room = ids[len(take) :], start + len(take) // 4, room - len(take) // 4
                    if not room:
                        emit(levels.new(), left, rows)
                        left, room = [], window
        if left:
            emit(levels.new(), left, rows)
        if rows:
            yield batch(rows)

    rows = narrow(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.mapInArrow(run, SCHEMA)
