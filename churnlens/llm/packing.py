"""Bounded-space online packing of tokenised documents into fixed-length sequences.

Every input partition keeps a fixed number of open windows.  A piece goes to the open window it fits best; when
none fits, the fullest window is emitted: its gap is filled with the head of the piece when the gap is longer
than ``max_gap``, otherwise it is padded.  The windows that are still open at the end of a partition are the
leftovers: they are packed again in rounds, ``fan_in`` partitions at a time, until one group is left, whose last
windows are filled one after the other; the very last one is cut into powers of two, which need no padding.

Memory: ``open_windows`` sequences per task besides the batch at hand; leftovers of ``fan_in`` tasks in a merge.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import stored, workers_find_package
from churnlens.llm.tokens import ID_DTYPE, encoder, in_byte_batches

SEQUENCE_LENGTH = 4096
#: Open windows per task.
OPEN_WINDOWS = 24
#: Longest gap that is padded rather than filled with the head of another document.
MAX_GAP = 16
#: Partitions whose leftovers one merge task packs.
FAN_IN = 16
_FLUSH_ROWS = 20_000

_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "part long, ids binary")


class _Windows:
    """The open windows of one task; ``rows`` gathers the emitted pieces."""

    def __init__(self, length: int, n_open: int, max_gap: int, first_id: int):
        self.length, self.n_open, self.max_gap, self.next_id = length, n_open, max_gap, first_id
        self.open: list[list] = []  # [used, pieces]; a piece: (doc_id, start, ids, doc_tokens)
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple], part: int | None = None) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), doc_tokens, self.next_id, at, part,
                              None if part is None else ids.tobytes()))
            at += len(ids)
        self.next_id += 1

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids) >= self.length:
            self._emit([(doc_id, start, ids[:self.length], doc_tokens)])
            start, ids = start + self.length, ids[self.length:]
        while len(ids):
            room = [(w[0], i) for i, w in enumerate(self.open) if w[0] + len(ids) <= self.length]
            if room:
                i = max(room)[1]
            elif len(self.open) < self.n_open:
                self.open.append([0, []])
                i = len(self.open) - 1
            else:
                i = max(range(len(self.open)), key=lambda j: self.open[j][0])
                gap = self.length - self.open[i][0]
                if gap > self.max_gap:
                    self.open[i][1].append((doc_id, start, ids[:gap], doc_tokens))
                    start, ids = start + gap, ids[gap:]
                self._emit(self.open.pop(i)[1])
                continue
            window = self.open[i]
            window[0] += len(ids)
            window[1].append((doc_id, start, ids, doc_tokens))
            if window[0] == self.length:
                self._emit(self.open.pop(i)[1])
            return

    def leave(self, part: int) -> None:
        """Pass the open windows on as leftovers."""
        for _, pieces in self.open:
            self._emit(pieces, part)
        self.open = []

    def finish(self) -> None:
        """Fill the last windows one after the other; cut the end into powers of two."""
        rest = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open = []
        left = sum(len(p[2]) for p in rest)
        room, window = 0, []
        for doc_id, start, ids, doc_tokens in rest:
            while len(ids):
                if not room:
                    room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
                n = min(room, len(ids))
                window.append((doc_id, start, ids[:n], doc_tokens))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if not room:
                    self._emit(window)
                    window = []

    def take_rows(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                                "sequence_id", "offset", "part")), ("ids", pa.binary())])


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = SEQUENCE_LENGTH,
                   open_windows: int = OPEN_WINDOWS, max_gap: int = MAX_GAP, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document with the end id only; a null doc_id stays null; repeated rows are packed
    once each; an empty table gives no rows; other columns are ignored.  Each task writes its pieces before the
    leftovers are merged, so a lost executor repeats its own tasks only; the same input partitions give the same
    rows.  Sequence ids are unique, not dense.  ``length`` must be a power of two.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    workers_find_package(spark)

    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words = encoder(tokenizer_path, False)
        windows = _Windows(length, open_windows, max_gap, part << 32)
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in in_byte_batches(texts):
                flat, counts = words.encode(texts.slice(a, b - a))
                ends = np.cumsum(counts)
                for doc_id, stop, n in zip(ids_of[a:b], ends, counts, strict=True):
                    ids = np.empty(n + 1, ID_DTYPE)
                    ids[:n], ids[n] = flat[stop - n:stop], end_id
                    windows.add(doc_id, 0, ids, int(n) + 1)
                    if len(windows.rows) >= _FLUSH_ROWS:
                        yield _batch(windows.take_rows(), _ARROW)
                pa.default_memory_pool().release_unused()
        windows.leave(part)
        yield _batch(windows.take_rows(), _ARROW)

    packed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                    .mapInArrow(pack_task, _SCHEMA), "packed")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    done, left, level = [packed.where("part IS NULL").select(columns)], packed.where("part IS NOT NULL"), 0
    while True:
        last = left.agg(F.max("part")).first()[0]
        if last is None:
            break
        level += 1
        left = stored(_merged(left, level, last < fan_in, length, open_windows, max_gap, fan_in), "leftovers")
        done.append(left.where("part IS NULL").select(columns))
        left = left.where("part IS NOT NULL")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _merged(left: DataFrame, level: int, final: bool, length: int, open_windows: int, max_gap: int,
            fan_in: int) -> DataFrame:
    def merge_task(key: tuple, table: pa.Table) -> pa.Table:
        group = int(key[0].as_py())
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        windows = _Windows(length, open_windows, max_gap, (level << 56) + (group << 32))
        for row in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
            windows.add(row["doc_id"], row["start"], np.frombuffer(row["ids"], ID_DTYPE), row["doc_tokens"])
        if final:
            windows.finish()
        else:
            windows.leave(group)
        return pa.Table.from_batches([_batch(windows.take_rows(), _ARROW)])

    groups = left.withColumn("to", F.floor(F.col("part") / fan_in).cast("long"))
    return groups.groupBy("to").applyInArrow(merge_task, _SCHEMA)
