"""Packing by deficit round-robin: every window holds the sources in their target shares.

Each source is a queue of tokens, its documents on end. A round gives every queue a quantum, its share of
a window's tokens; what a queue may spend is kept as its deficit (half a cell at first), and it is served
in cells of ``CELL`` tokens as far as its deficit reaches. What is left is carried to the next round, an emptied queue leaves
the ring, and windows are the served cells in order.

A cell's round follows from its own place in its queue, and how many cells all queues have had before a
round follows from their quanta, so the service is computed, not played: a task that knows where its
documents stand in their queues knows their windows. For that, a task that tokenises counts the tokens of
each queue; totals of tasks, summed in order, carry queues over partitions. Ids are written once, by
the task that makes them, and are not shuffled while one total for each task and queue can be broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assay.storage import materialize

from .exprs import held_batches
from .tokens import BYTE_BPE, encoder

WINDOW, CELL, END_ID = 2048, 64, 1
#: Queues of their own for the largest sources; all other sources share one more.
QUEUES = 256
#: A quantum's fractions of a token, and cells looked up at once.
UNIT, AT_ONCE = 1 << 16, 4096


class Service:
    """Where deficit round-robin puts each token, from the queues' tokens and their weights alone."""

    def __init__(self, tokens: list[int], weights: list[float], window: int = WINDOW, cell: int = CELL):
        self.tokens, self.window, self.cell = np.array(tokens, np.int64), window, cell
        self.cells = self.tokens // cell
        share = np.array(weights, float) / (sum(weights) or 1)
        #: What a round adds to each deficit, in units.
        self.quantum = np.maximum(1, np.rint(share * window * UNIT)).astype(np.int64)
        self.half = cell * UNIT // 2
        self.last = self._round(self.cells)
        held = window // cell
        self.full = int(self.cells.sum()) // held
        #: Beyond the full windows: cells left over in order of service, then the ends of queues shorter than a cell.
        rest = (int(self.cells.sum()) - self.full * held) * cell
        ends = self.tokens - self.cells * cell
        self.ends = rest + np.cumsum(ends) - ends
        left, self.tail = rest + int(ends.sum()), [0]
        while left:  # full windows, then powers of two, which need no padding
            self.tail.append(self.tail[-1] + min(window, 1 << left.bit_length() - 1))
            left -= self.tail[-1] - self.tail[-2]

    def _round(self, served: np.ndarray) -> np.ndarray:
        """The round that serves the last of so many cells of each queue. A deficit starts at half a cell, so that rounds are neither short nor long."""
        return np.maximum(0, -((self.half - served * (self.cell * UNIT)) // self.quantum))

    def _served(self, rounds: np.ndarray) -> np.ndarray:
        """Cells that each queue (rows) has had after each of these rounds (columns)."""
        spent = np.minimum(rounds, self.last[:, None]) * self.quantum[:, None] + self.half
        return np.minimum(spent // (self.cell * UNIT), self.cells[:, None])

    def places(self, queue: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Places of cells in the order of service: by round, then queue, then place in the queue."""
        out = np.empty(len(cell), np.int64)
        for a in range(0, len(cell), AT_ONCE):
            q, j = queue[a : a + AT_ONCE], cell[a : a + AT_ONCE]
            at = np.arange(len(q))
            own = -((self.half - (j + 1) * (self.cell * UNIT)) // self.quantum[q])
            before, after = self._served(own - 1), self._served(own)
            ring = np.cumsum(after - before, axis=0) - (after - before)
            out[a : a + AT_ONCE] = before.sum(axis=0) + ring[q, at] + j - before[q, at]
        return out

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, length, sequence, offset) of the pieces of documents that stand at ``start`` in their queues."""
        if not len(n):
            return (np.empty(0, np.int64),) * 5
        first, count = start // self.cell, (start + n - 1) // self.cell - start // self.cell + 1
        row = np.repeat(np.arange(len(n)), count)
        j = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        q, low, high = queue[row], np.maximum(start[row], j * self.cell), np.minimum((start + n)[row], (j + 1) * self.cell)
        whole = j < self.cells[q]
        place = np.empty(len(j), np.int64)
        place[whole] = self.places(q[whole], j[whole]) * self.cell + (low - j * self.cell)[whole]
        place[~whole] = self.full * self.window + self.ends[q[~whole]] + (low - j * self.cell)[~whole]
        row, begin, length, place = self._cut(row, low - start[row], high - low, place)
        edges = np.array(self.tail, np.int64)
        late = place - self.full * self.window
        number = np.searchsorted(edges, late, side="right") - 1
        sequence = np.where(late < 0, place // self.window, self.full + number)
        offset = np.where(late < 0, place % self.window, late - edges[np.maximum(number, 0)])
        go_on = (row[1:] == row[:-1]) & (sequence[1:] == sequence[:-1]) & (offset[1:] == offset[:-1] + length[:-1])
        heads = np.flatnonzero(np.concatenate(([True], ~go_on)))
        return row[heads], begin[heads], np.add.reduceat(length, heads), sequence[heads], offset[heads]

    def _cut(self, row: np.ndarray, begin: np.ndarray, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Fragments beyond the full windows, cut where a sequence ends; others lie in one window."""
        edges = np.array(self.tail, np.int64) + self.full * self.window
        inside = np.searchsorted(edges, place + length, side="left") - np.searchsorted(edges, place, side="right")
        again = np.repeat(np.arange(len(row)), inside + 1)
        nth = np.arange(len(again)) - np.repeat(np.cumsum(inside + 1) - inside - 1, inside + 1)
        edge = np.searchsorted(edges, place, side="right")[again] + nth
        low = np.where(nth == 0, place[again], edges[np.minimum(edge - 1, len(edges) - 1)])
        high = np.where(nth == inside[again], (place + length)[again], edges[np.minimum(edge, len(edges) - 1)])
        return row[again], begin[again] + low - place[again], high - low, low


def _tokenise(vocabulary: str, queues: dict[bytes, int], kind: pa.DataType, end_id: int):
    """Rows (part, queue, start, n, ids): ids of whole texts, of two bytes where they fit, and tokens of the queue before them in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(vocabulary), TaskContext.get().partitionId()
        held = [0] * (len(queues) + 1)
        for batch in batches:
            named, row = batch.column(1).to_pylist(), 0
            for ids, lengths in own.encode_rows(batch.column(2)):
                size = 2 if max(int(ids.max(initial=0)), end_id) < 1 << 16 else 4
                data, ends, end = memoryview(ids.astype(f"<u{size}").tobytes()), np.cumsum(lengths) * size, end_id.to_bytes(size, "little")
                out: tuple[list, ...] = ([], [], [], [])
                for i, (a, b) in enumerate(zip((ends - lengths * size).tolist(), ends.tolist())):
                    q = queues.get(named[row + i], len(queues))
                    n = (b - a) // size + 1
                    for column, x in zip(out, (q, held[q], n, bytes(data[a:b]) + end)):
                        column.append(x)
                    held[q] += n
                rows = len(lengths)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, rows).cast(kind), pa.array([part] * rows, pa.int32()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["id", "part", "queue", "start", "n", "ids"])
                row += rows
        own.forget()

    return run


def _place(service: Service, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queue, start, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
            row, begin, length, sequence, offset = service.pieces(queue, start, n)
            ids = batch.column(4)
            crc, at, data = [], -1, memoryview(b"")
            for i, a, size in zip(row.tolist(), (begin * 4).tolist(), (length * 4).tolist()):
                if i != at:
                    held = ids[i].as_buffer()
                    at, data = i, memoryview(np.frombuffer(held, f"<u{len(held) // n[i]}").astype("<u4").tobytes())
                crc.append(zlib.crc32(data[a : a + size]))
            columns = [batch.column(0).take(pa.array(row)).cast(kind), pa.array(begin), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = BYTE_BPE, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is the ids of its whole text and ``end_id``. Sequences are full, but for the last few, which
    have powers of two, so that none needs padding. ``window`` is a power of two, of ``CELL`` at least.
    ``weights`` are the sources' target shares of every window (of those not named: 0, so that they come last);
    by default each source's share of all tokens, under which all queues last to the end. When a
    queue is empty the others share its place by their weights. While all queues last, a source is within
    two cells of its target in each full window, the largest within a quarter of a cell more for each queue; what a
    window owes is carried on. At most ``QUEUES`` sources, the largest by bytes, have queues of their
    own; all others stand in one queue more, whose weight is the sum of theirs.

    A null source is a source. A null or empty text is its end id alone; a very long one is encoded in parts.
    Documents of a queue stand in the order in which the table is read, whatever their ids, which may be null or
    repeated; repeated rows are documents of their own. An empty table gives no rows. Further columns are not read.
    """
    if window < CELL or window & (window - 1):
        raise ValueError(f"window: a power of two, {CELL} at least")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    text = F.col(text_col).cast("string")
    digest = lambda c: F.unhex(F.sha2(F.concat(F.when(c.isNull(), "n").otherwise("s"), F.coalesce(c.cast("string"), F.lit(""))), 256))
    rows = docs.select(F.col(id_col).alias("id"), digest(F.col(source_col)).alias("source"), text.alias("text"))

    sizes = rows.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1).alias("held"))
    largest = sizes.orderBy(F.desc("held"), "source").limit(QUEUES).collect()  # digests of QUEUES sources at most
    queues = {bytes(r["source"]): i for i, r in enumerate(largest)}

    with held_batches(spark):
        schema = f"id {kind.simpleString()}, part int, queue int, start bigint, n bigint, ids binary"
        encoded = materialize(rows.mapInArrow(_tokenise(vocabulary, queues, to_arrow_type(kind), end_id), schema), "ids")
    parts = encoded.groupBy("queue", "part").agg(F.sum("n").alias("held"))
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(parts.withColumn("base", F.coalesce(F.sum("held").over(order), F.lit(0))), "bases")
    totals = {r["queue"]: r["held"] for r in bases.groupBy("queue").agg(F.sum("held").alias("held")).collect()}  # QUEUES + 1 rows at most
    tokens = [totals.get(q, 0) for q in range(len(queues) + 1)]

    shares = [float(x) for x in tokens]
    if weights is not None:
        asked = spark.createDataFrame([(name, float(w)) for name, w in weights.items()], "name string, weight double")
        shares = [0.0] * len(tokens)
        for r in asked.select(digest(F.col("name")).alias("source"), "weight").collect():
            shares[queues.get(bytes(r["source"]), len(queues))] += r["weight"]
    service = Service(tokens, shares, window)
    # a row for each task and queue: Spark broadcasts it below its threshold, and joins by shuffle beyond it
    placed = encoded.join(bases.select("queue", "part", "base"), ["queue", "part"]).select("id", "queue", (F.col("base") + F.col("start")).alias("start"), "n", "ids")
    schema = f"id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return placed.mapInArrow(_place(service, to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)
