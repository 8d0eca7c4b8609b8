"""Token ids of a corpus in wavelet-matrix shard files.

A shard holds the ids of consecutive documents as bit planes, highest bit first; each plane orders the ids by
the bits above it (zeros before ones), so one compressed file answers access, rank (counting) and select
(occurrence lookup) by walking the planes.  The ids are cut into segments that fit a processor's cache, each a
wavelet matrix of its own.  A plane is compressed in chunks of 4 KB; beside it lies its directory, the ones before
every block of 512 bits.  A look-up takes the count from the directory and counts or searches the packed bits of
one block, so it decompresses one chunk of a plane, never a whole plane.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm.common import scratch, stored, workers_find_package
from churnlens.llm.tokens import ID_DTYPE, encoder, in_byte_batches

# The file format.  magic, header length (uint32), header JSON, parts at the header's offsets.
MAGIC = b"WMX3"
SEGMENT_TOKENS = 1 << 18
#: Bytes of a block (one count in the directory) and of a chunk (compressed at once) of a plane.
BLOCK, CHUNK = 64, 4096

#: Ids after which a shard is closed (a longer document still lies in one shard).
SHARD_TOKENS = 3_000_000


def _directory(plane: np.ndarray) -> bytes:
    """The ones before each block of a plane, and in all of it."""
    ones = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK), dtype="<u4")
    return np.concatenate([np.zeros(1, "<u4"), np.cumsum(ones, dtype="<u4")]).tobytes()


def build_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """File content of a shard: ``ids`` of the documents one after the other."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    parts: list[bytes] = []
    size = 0

    def put(data: bytes) -> list[int]:
        nonlocal size
        packed = squeeze(data)
        raw = len(packed) >= len(data)
        parts.append(data if raw else packed)
        size += len(parts[-1])
        return [size - len(parts[-1]), len(parts[-1]), int(raw)]

    segments = []
    for at in range(0, len(ids), SEGMENT_TOKENS):
        rest = ids[at:at + SEGMENT_TOKENS].astype(np.uint16 if width <= 16 else np.uint32)
        planes = []
        for k in range(width - 1, -1, -1):
            bit = (rest & rest.dtype.type(1 << k)) != 0
            zero = ~bit
            plane = np.packbits(bit, bitorder="little")
            data = plane.tobytes()
            planes.append([int(np.count_nonzero(zero)), put(_directory(plane)),
                           [put(data[i:i + CHUNK]) for i in range(0, len(data), CHUNK)]])
            rest = np.concatenate([rest.compress(zero), rest.compress(bit)])
        segments.append(planes)
    known = np.array([d is not None for d in doc_ids], bool)
    head = {"n": len(ids), "docs": len(doc_ids), "width": width, "segments": segments,
            "doc_ids": put(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()),
            "known": put(known.tobytes()), "lengths": put(np.array(lengths, "<i8").tobytes())}
    text = json.dumps(head).encode()
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, *parts])


class _Segment:
    """One wavelet matrix: n ids in planes of (number of zeros, directory, chunks), the highest first."""

    def __init__(self, n: int, planes: list, get):
        self.n, self.width, self._planes, self._get = n, len(planes), planes, get
        self.zeros = [p[0] for p in planes]
        self._counts: dict[int, np.ndarray] = {}

    def _before(self, k: int) -> np.ndarray:
        """Ones before each block of plane k, by the directory."""
        if k not in self._counts:
            self._counts[k] = np.frombuffer(self._get(self._planes[k][1]), "<u4")
        return self._counts[k]

    def _block(self, k: int, block: int) -> np.ndarray:
        """The packed bits of one block of plane k."""
        chunk, at = divmod(block * BLOCK, CHUNK)
        return np.frombuffer(self._get(self._planes[k][2][chunk]), np.uint8)[at:at + BLOCK]

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        block, rest = divmod(i, 8 * BLOCK)
        before = int(self._before(k)[block])
        if not rest:
            return before
        bits = self._block(k, block)
        last = int(bits[rest // 8]) & ((1 << rest % 8) - 1) if rest % 8 else 0
        return before + int(np.bitwise_count(bits[:rest // 8]).sum(dtype=np.int64)) + last.bit_count()

    def _find(self, k: int, one: bool, nth: int) -> int:
        """Position in plane k of the nth (from 0) one or zero."""
        before = self._before(k).astype(np.int64)
        if not one:
            before = np.arange(len(before)) * 8 * BLOCK - before
        block = int(np.searchsorted(before[:-1], nth, "right")) - 1
        bits = np.unpackbits(self._block(k, block), bitorder="little")
        return block * 8 * BLOCK + int(np.flatnonzero(bits == one)[nth - before[block]])

    def decode(self) -> np.ndarray:
        """All ids in their order: the planes undone from the lowest."""
        ids = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for k in range(self.width - 1, -1, -1):
            packed = np.frombuffer(b"".join(map(self._get, self._planes[k][2])), np.uint8)
            bit, zeros = np.unpackbits(packed, count=self.n, bitorder="little").view(bool), self.zeros[k]
            up = np.empty_like(ids)
            up[np.flatnonzero(~bit)] = ids[:zeros]
            up[np.flatnonzero(bit)] = ids[zeros:] | ids.dtype.type(1 << (self.width - 1 - k))
            ids = up
        return ids

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.width):
            ones = self._ones(k, i)
            bit = self._ones(k, i + 1) - ones
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def span(self, token: int, i: int) -> tuple[int, int]:
        """Where the id's occurrences before position i lie behind the lowest plane."""
        lo, hi = 0, i
        for k in range(self.width):
            a, b = self._ones(k, lo), self._ones(k, hi)
            if token >> (self.width - 1 - k) & 1:
                lo, hi = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def select(self, token: int, nth: int) -> int:
        at = self.span(token, self.n)[0] + nth
        for k in range(self.width - 1, -1, -1):
            one = bool(token >> (self.width - 1 - k) & 1)
            at = self._find(k, one, at - self.zeros[k] if one else at)
        return at


class WaveletShard:
    """Look-ups in a shard's content; a look-up decompresses directories and single chunks, the last ones are kept."""

    #: Decompressed parts that are kept for the next look-ups.
    KEEP_PARTS = 256

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise ValueError("not a shard file")
        n = struct.unpack_from("<I", content, 4)[0]
        self.head = json.loads(content[8:8 + n])
        self.body = memoryview(content)[8 + n:]
        self.n, self.width = self.head["n"], self.head["width"]
        self.chunks_read = 0
        self._kept = lru_cache(self.KEEP_PARTS)(self._unpack)
        self.segments = [_Segment(min(SEGMENT_TOKENS, self.n - i * SEGMENT_TOKENS), planes, lambda e: self._kept(*e))
                         for i, planes in enumerate(self.head["segments"])]

    def _get(self, entry: list[int]) -> bytes:
        return self._unpack(*entry)

    def _unpack(self, at: int, size: int, raw: int) -> bytes:
        import zstandard

        self.chunks_read += 1
        data = self.body[at:at + size]
        return bytes(data) if raw else zstandard.ZstdDecompressor().decompress(data)

    @property
    def doc_ids(self) -> list[int | None]:
        known = np.frombuffer(self._get(self.head["known"]), bool)
        return [int(d) if k else None
                for d, k in zip(np.frombuffer(self._get(self.head["doc_ids"]), "<i8"), known, strict=True)]

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._get(self.head["lengths"]), "<i8")

    def decode(self) -> np.ndarray:
        """All ids in their order."""
        out = np.empty(self.n, ID_DTYPE)
        for i, segment in enumerate(self.segments):
            out[i * SEGMENT_TOKENS:(i + 1) * SEGMENT_TOKENS] = segment.decode()
        return out

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return self.segments[i // SEGMENT_TOKENS].access(i % SEGMENT_TOKENS)

    def rank(self, token: int, i: int) -> int:
        """Occurrences of an id before position i."""
        if token >> self.width:
            return 0
        total, i = 0, min(max(i, 0), self.n)
        for k, segment in enumerate(self.segments[:-(-i // SEGMENT_TOKENS)]):
            lo, hi = segment.span(token, min(segment.n, i - k * SEGMENT_TOKENS))
            total += hi - lo
        return total

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of an id."""
        if nth >= 0 and not token >> self.width:
            for k, segment in enumerate(self.segments):
                lo, hi = segment.span(token, segment.n)
                if nth < hi - lo:
                    return k * SEGMENT_TOKENS + segment.select(token, nth)
                nth -= hi - lo
        raise IndexError(nth)

    def positions(self, token: int) -> list[int]:
        return [self.select(token, i) for i in range(self.count(token))]


def _local_or_uri(spark: SparkSession, folder: str) -> str:
    """The folder as pyarrow's file systems name it (a plain path, or a URI with its host)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.removeprefix("file:").replace("//", "/") if full.startswith("file:") else full


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode (doc_id, text) and write shard files in ascending doc_id order; the stored list of the files.

    A null doc_id comes first, ties are ordered by a hash of the text, null and empty texts have the end id only,
    repeated rows are written once each, other columns are ignored; an empty table gives no file.  Rows that are
    equal in both are dealt to ranges by a hash of their place in the input, so they spread over tasks (``docs`` has
    to be read from files: their rows keep their places when a task is repeated).  The list has file, part, seq
    (their order) and n_tokens.  A repeated task writes files of new names, and only the files of
    the attempt that succeeded are in the list.
    """
    spark = docs.sparkSession
    workers_find_package(spark)
    target = _local_or_uri(spark, folder)

    def write_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        words = encoder(tokenizer_path, True)
        disk, root = fs.FileSystem.from_uri(target)
        disk.create_dir(root, recursive=True)
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        chunks: list[np.ndarray] = []
        held = 0
        end = np.array([end_id], ID_DTYPE)

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, chunks, held, seq
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wmx"
            with disk.open_output_stream(f"{root}/{name}") as out:
                out.write(build_shard(doc_ids, lengths, np.concatenate(chunks)))
            row = pa.RecordBatch.from_pydict({"file": [name], "part": [part], "seq": [seq], "n_tokens": [held]},
                                             pa.schema([("file", pa.string()), ("part", pa.int64()),
                                                        ("seq", pa.int64()), ("n_tokens", pa.int64())]))
            doc_ids, lengths, chunks, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in in_byte_batches(texts, 8_000_000):
                flat, counts = words.encode(texts.slice(a, b - a))
                for doc_id, at, n in zip(ids_of[a:b], (np.cumsum(counts) - counts).tolist(), counts.tolist(),
                                         strict=True):
                    doc_ids.append(doc_id)
                    lengths.append(n + 1)
                    chunks += [flat[at:at + n], end]
                    held += n + 1
                    if held >= shard_tokens:
                        yield close()
                pa.default_memory_pool().release_unused()
        if doc_ids:
            yield close()

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .select("doc_id", "text", F.xxhash64("text").alias("h"),
                       F.xxhash64(F.monotonically_increasing_id()).alias("place"))
               .repartitionByRange(F.col("doc_id").asc_nulls_first(), "h", "place")
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h"))
    return stored(ordered.select("doc_id", "text").mapInArrow(
        write_task, "file string, part long, seq long, n_tokens long"), "shard-list")


def read_shards(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """The documents of the listed shard files: doc_id, start, n_tokens, ids_crc32."""
    def read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                shard = WaveletShard(content.as_py())
                ids, lengths = shard.decode(), shard.lengths
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends, lengths, strict=True)]
                yield pa.record_batch([pa.array([path.as_py().rpartition("/")[2]] * len(crc), pa.string()),
                                       pa.array(shard.doc_ids, pa.int64()), pa.array(ends - lengths, pa.int64()),
                                       pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                                      ["file", "doc_id", "local", "n_tokens", "ids_crc32"])

    docs = (spark.read.format("binaryFile").option("pathGlobFilter", "*.wmx").load(folder).select("path", "content")
            .mapInArrow(read_task, "file string, doc_id long, local long, n_tokens long, ids_crc32 long"))
    before = files.select("file", (F.sum("n_tokens").over(Window.orderBy("part", "seq"))
                                   - F.col("n_tokens")).alias("before"))
    return docs.join(before, "file").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens",
                                            "ids_crc32")


def corpus_ids(docs: DataFrame, tokenizer_path: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write a corpus to shard files in the shared folder and read it back (see ``write_shards``)."""
    spark = docs.sparkSession
    folder = scratch(spark, "wavelet")
    files = write_shards(docs, tokenizer_path, end_id, folder, shard_tokens)
    if not files.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, files)
