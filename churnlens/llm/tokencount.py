"""Token counts of whole texts; huge texts by overlapping chunks that are spliced at proven common boundaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import workers_find_package
from churnlens.llm.tokens import in_batches

#: Texts up to this many characters are encoded in one call.
CHUNK_CHARS = 65_536
#: Characters that neighbouring chunks share at first.
OVERLAP_CHARS = 512


class ResyncCounter:
    """Counts the pieces of a sentencepiece model, with bounded memory per call.

    A blank between two letters or digits is a stable boundary when no piece of the vocabulary has the blank's
    mark behind another character: then no merge crosses it, in a chunk or in the whole text.  This is checked
    once per model; without it every text is encoded whole.
    """

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.stable = not any("▁" in p.lstrip("▁") for p in pieces)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Pieces of each whole text (None: 0)."""
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if t and (len(t) <= self.chunk or not self.stable)]
        for i, ids in zip(short, self.lib.encode([texts[i] for i in short], return_type="numpy", num_threads=1),
                          strict=True):
            out[i] = len(ids)
        known = set(short)
        for i, t in enumerate(texts):
            if t and i not in known:
                out[i] = self.spliced(t)
        return out

    def _starts(self, text: str, a: int, b: int) -> list[int]:
        """Where the pieces of text[a:b] begin, as positions in the text."""
        return [a + begin for begin, _ in self.lib.encode(text[a:b], return_type="offset_mapping")["offsets"]]

    def spliced(self, text: str) -> int:
        """Pieces of a long text: chunks with overlaps, cut where both neighbours agree on a stable boundary."""
        total, cut = 0, 0  # pieces that begin before ``cut`` are counted
        a, b = 0, min(self.chunk, len(text))
        left = self._starts(text, a, b)
        while b < len(text):
            overlap = self.overlap
            while True:
                lo = max(b - overlap, cut)
                hi = min(max(lo + self.chunk, b + self.overlap), len(text))
                right = self._starts(text, lo, hi)
                both = set(left) & set(right)
                found = [p for p in range(b - 2, lo, -1) if text[p] == " " and p in both
                         and text[p - 1].isalnum() and text[p + 1].isalnum()]
                if found or lo == cut:
                    break
                overlap *= 2  # the chunks do not align: let them share more
            if found:
                total += sum(cut <= s < found[0] for s in left)
                cut = found[0]
                a, b, left = lo, hi, [s for s in right if s >= cut]
            else:
                b = min(b + 2 * (b - cut), len(text))  # no boundary in the whole chunk: take a longer one
                left = [s for s in self._starts(text, a, b) if s >= cut]
        return total + sum(s >= cut for s in left)


@lru_cache(maxsize=4)
def counter(path: str, chunk: int, overlap: int) -> ResyncCounter:
    return ResyncCounter(path, chunk, overlap)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK_CHARS,
                 overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    One row per row, repeated rows included; a null text counts 0 bytes and 0 tokens; a null doc_id stays null;
    an empty table gives no rows; other columns are ignored.  No shuffle.
    """
    workers_find_package(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("over_limit", pa.bool_())])

    def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_path, chunk, overlap)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n: list[int] = []
            for a, b in in_batches(texts, 1_000_000):
                n += model.counts(texts[a:b])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()),
                                   pa.array([x > limit for x in n], pa.bool_())], schema=schema)

    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        size.alias("n_bytes"))
            .mapInArrow(count_task, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
