"""Packing of token sequences as vector bin packing.

Every piece of a document has three sizes: tokens, one segment, and tokens that bear loss.  A sequence holds at most a limit of
each.  Pieces go, the largest first within a window, to the open sequence whose free space points most in the direction of the
piece (the largest dot product of free space and demand, both as shares of the limits) among those that hold it whole; where
none does and no more sequences may be open, the piece is cut so that one sequence gets exactly full.  Nothing is shuffled:
each task packs the rows of its partition, keeps a bounded number of sequences open, and refills these at its end by cutting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .shared import require, slices

#: Sequences a task keeps open.
OPEN = 48


class Packer:
    """add() takes documents' ids and returns the pieces that are placed for good; finish() returns the rest.

    A piece: (document, start, ids, sequence, offset).  Ids are little-endian unsigned 32-bit integers.
    """

    def __init__(self, tokens: int, segments: int, loss: int, first: int = 0, keep_open: int = OPEN):
        if min(tokens, segments, loss) < 1:
            raise ValueError("every limit must be positive")
        self.limit = np.array([tokens, segments, loss], dtype=np.float64)
        self.keep_open = keep_open
        self.free = np.zeros((0, 3))
        self.held: list[list[tuple]] = []
        self.next = first

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, _ in pieces:
            out.append((doc, start, ids, self.next, offset))
            offset += len(ids) // 4
        self.next += 1
        return out

    def _fits(self, n: int, start: int, loss_from: int, free: np.ndarray) -> int:
        """How many tokens of a piece from start on a sequence with this free space takes."""
        take = min(n, int(free[0])) if free[1] >= 1 else 0
        bare = max(0, loss_from - start)
        return min(take, bare + int(free[2]))

    @staticmethod
    def _loss(start: int, n: int, loss_from: int) -> int:
        return max(0, start + n - max(start, loss_from))

    def _put(self, k: int, piece: tuple, loss: int) -> list[tuple]:
        self.held[k].append(piece)
        self.free[k] -= (len(piece[2]) // 4, 1, loss)
        if self.free[k].min() >= 1:
            return []
        self.free = np.delete(self.free, k, axis=0)
        return self._close(self.held.pop(k))

    def add(self, documents: list[tuple]) -> list[tuple]:
        """documents: (document, ids, loss_from): tokens before position loss_from bear no loss."""
        out: list[tuple] = []
        rest: list[tuple] = []
        whole = int(min(self.limit[0], self.limit[2]))
        for doc, ids, loss_from in documents:
            n, start = len(ids) // 4, 0
            while n - start >= whole:
                out += self._close([(doc, start, ids[4 * start : 4 * (start + whole)], loss_from)])
                start += whole
            if start < n:
                rest.append((doc, start, ids[4 * start :], loss_from))
        rest.sort(key=lambda x: -len(x[2]))
        for doc, start, ids, loss_from in rest:
            while ids:
                n = len(ids) // 4
                loss = self._loss(start, n, loss_from)
                demand = np.array((n, 1, loss), dtype=np.float64)
                holds = (self.free >= demand).all(axis=1)
                if holds.any():
                    score = (self.free / self.limit) @ (demand / self.limit)
                    out += self._put(int(np.where(holds, score, -1).argmax()), (doc, start, ids, loss_from), loss)
                    break
                if len(self.held) < self.keep_open:
                    self.held.append([])
                    self.free = np.vstack([self.free, self.limit])
                    if (demand <= self.limit).all():
                        out += self._put(len(self.held) - 1, (doc, start, ids, loss_from), loss)
                        break
                takes = [self._fits(n, start, loss_from, f) for f in self.free]
                k = int(np.argmax(takes))
                out += self._put(k, (doc, start, ids[: 4 * takes[k]], loss_from), self._loss(start, takes[k], loss_from))
                start, ids = start + takes[k], ids[4 * takes[k] :]
        return out

    def finish(self) -> list[tuple]:
        """Fills the open sequences one after another by cutting; the last is split into lengths that are powers of two, which need no padding."""
        pieces = [p for held in self.held for p in held]
        self.held, self.free = [], np.zeros((0, 3))
        out: list[tuple] = []
        now: list[tuple] = []
        free = self.limit.copy()
        left = sum(len(p[2]) // 4 for p in pieces)
        size = int(self.limit[0])

        def room() -> np.ndarray:
            """The limits of the next sequence; a last one is the largest power of two that the rest fills."""
            full = self.limit.copy()
            if left < size:
                full[0] = 1 << (max(left, 1).bit_length() - 1)
            return full

        free = room()
        for doc, start, ids, loss_from in pieces:
            while ids:
                take = self._fits(len(ids) // 4, start, loss_from, free)
                if take:
                    now.append((doc, start, ids[: 4 * take], loss_from))
                    free -= (take, 1, self._loss(start, take, loss_from))
                    start, ids, left = start + take, ids[4 * take :], left - take
                if free.min() < 1 or not take:
                    out += self._close(now)
                    now, free = [], room()
        if now:
            out += self._close(now)
        return out


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, max_segments: int = 2048, max_loss: int | None = None, end_id: int | None = 1, loss_from_col: str | None = None) -> DataFrame:
    """Packs all texts into sequences under the three limits; end_id, if not null, follows every text's ids.

    Returns a row per piece: id_col, start (the document's ids before it), length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset (the piece's place in its sequence; gapless from 0).  Every id lies in exactly one piece.
    loss_from_col: number of leading tokens that bear no loss (prompts); null counts as 0.

    A null text counts as empty and has just end_id; without end_id it has no piece.  Repeated rows are packed as often as they
    occur; null ids stay null; other columns are left out whatever their names; an empty table has no pieces.  The sequence
    numbers follow from partition and order within it, so a task that runs again gives the same rows.
    """
    require(docs, id_col, text_col)
    spec = docs.sparkSession.sparkContext.broadcast(bpe.read_spec(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    limits = max_tokens, max_segments, max_tokens if max_loss is None else max_loss

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        doc, start, ids, sequence, offset = zip(*pieces, strict=True)
        names = [d[0] for d in doc]
        total = [d[1] for d in doc]
        return pa.RecordBatch.from_pydict({"_id": pa.array(names, id_type[0]), "start": pa.array(start, pa.int64()), "length": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()), "doc_tokens": pa.array(total, pa.int64()), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    id_type: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(spec.value, bpe.LibraryBpe)
        packer = Packer(*limits, first=TaskContext.get().partitionId() << 40)
        for batch in slices(batches, "_text"):
            id_type[:] = [batch.schema.field("_id").type]
            ids = [x + tail for x in model.encode(batch.column("_text").to_pylist())]
            starts = [x or 0 for x in batch.column("_from").to_pylist()]
            placed = packer.add([((i, len(x) // 4), x, f) for i, x, f in zip(batch.column("_id").to_pylist(), ids, starts, strict=True)])
            if placed:
                yield rows(placed)
        if placed := packer.finish():
            yield rows(placed)

    plain = docs.selectExpr(f"`{id_col}` AS _id", f"CAST(`{text_col}` AS STRING) AS _text", f"CAST(`{loss_from_col}` AS BIGINT) AS _from" if loss_from_col else "CAST(0 AS BIGINT) AS _from")
    out = plain.mapInArrow(run, f"_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("_id", id_col)
