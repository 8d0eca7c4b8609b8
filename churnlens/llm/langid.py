"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter n-gram is bound from its letters' vectors, each permuted
(rolled) by its place, by multiplying them; a text's vector bundles (adds) the vectors of its n-grams.  The
bundles of all training texts of a language are its prototype; a text gets the language whose prototype has the
highest cosine with the text's vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import own_columns_apart, workers_find_package
from churnlens.llm.tokens import in_batches

DIMENSIONS = 1024
NGRAM = 3
SEED = 20_240_229
#: Codes of letters: 0 separates words, Latin letters have codes of their own, others share the rest by number.
CODES = 160
FOLDS = 5
UNKNOWN = "und"
_LATIN = [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]


def _letter_codes() -> np.ndarray:
    """Code of every lower-case code point below 65536; 0 for what is no letter."""
    codes = np.zeros(1 << 16, np.int64)
    for cp in range(0x80, 1 << 16):
        if chr(cp).isalpha():
            codes[cp] = 1 + len(_LATIN) + cp % (CODES - 1 - len(_LATIN))
    codes[_LATIN] = np.arange(1, 1 + len(_LATIN))
    return codes


class Profiler:
    """Vectors of texts; n-gram vectors are built once per worker and kept in a bounded cache."""

    def __init__(self, dims: int, ngram: int, seed: int, cache_rows: int = 16_384):
        rng = np.random.default_rng(seed)
        letters = rng.choice(np.array([-1, 1], np.int8), (CODES, dims))
        self.places = [np.roll(letters, ngram - 1 - i, axis=1) for i in range(ngram)]
        self.ngram, self.dims = ngram, dims
        self.codes = _letter_codes()
        self.slot = np.full(CODES ** ngram, -1, np.int32)  # n-gram -> row of the cache
        self.where = np.zeros(CODES ** ngram, np.int32)  # n-gram -> its column in the batch at hand
        self.seen = np.zeros(CODES ** ngram, bool)
        self.rows = np.empty((cache_rows, dims), np.int8)
        self.used = 0

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        new = grams[self.slot[grams] < 0]
        if self.used + len(new) > len(self.rows):
            self.slot[:] = -1
            self.used, new = 0, grams
            if len(new) > len(self.rows):
                return self._bind(new).astype(np.float32)
        if len(new):
            self.rows[self.used:self.used + len(new)] = self._bind(new)
            self.slot[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return self.rows[self.slot[grams]].astype(np.float32)

    def _bind(self, grams: np.ndarray) -> np.ndarray:
        bound = np.ones((len(grams), self.dims), np.int8)
        for i in range(self.ngram):
            bound *= self.places[i][grams // CODES ** (self.ngram - 1 - i) % CODES]
        return bound

    def grams(self, text: str) -> np.ndarray:
        """The n-grams of a text: words in lower case with one separator on each side; empty without a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.zeros(len(points) + 2, np.int64)
        codes[1:-1] = self.codes[np.minimum(points, 0xFFFF)]
        if len(points) and points.max() > 0xFFFF:
            wide = np.flatnonzero(points > 0xFFFF)
            codes[1 + wide] = [1 + len(_LATIN) + int(p) % (CODES - 1 - len(_LATIN)) if chr(p).isalpha() else 0
                               for p in points[wide]]
        keep = (codes > 0) | np.r_[True, codes[:-1] > 0]  # runs of other characters are one separator
        codes = codes[keep]
        if len(codes) < 2:
            return np.zeros(0, np.int64)
        if len(codes) < self.ngram:
            codes = np.r_[codes, np.zeros(self.ngram - len(codes), np.int64)]
        out = codes[:len(codes) - self.ngram + 1].copy()
        for i in range(1, self.ngram):
            out *= CODES
            out += codes[i:len(codes) - self.ngram + 1 + i]
        return out

    def bundles(self, grams: list[np.ndarray]) -> np.ndarray:
        """Bundled vectors of texts from their n-grams."""
        out = np.zeros((len(grams), self.dims), np.float32)
        if not sum(map(len, grams)):
            return out
        together = np.concatenate(grams)
        self.seen[together] = True
        unique = np.flatnonzero(self.seen)
        self.seen[unique] = False
        for a in range(0, len(unique), 2048):
            part = unique[a:a + 2048]
            counts = np.zeros((len(grams), len(part)), np.float32)
            self.where[part] = np.arange(1, len(part) + 1)
            for row, g in zip(counts, grams, strict=True):
                row += np.bincount(self.where[g], minlength=len(part) + 1)[1:]
            self.where[part] = 0
            out += counts @ self._vectors(part)
        return out


@lru_cache(maxsize=2)
def profiler(dims: int, ngram: int, seed: int) -> Profiler:
    return Profiler(dims, ngram, seed)


def fold(doc_id: str) -> Column:
    """The fold of a document: crc32 of its id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def train(labelled: DataFrame, dims: int = DIMENSIONS, ngram: int = NGRAM, seed: int = SEED
          ) -> tuple[list[str], np.ndarray]:
    """(text, lang) -> languages and their prototypes, one unit row each, from all rows.

    Each task adds up one vector per language; only those sums (languages times dimensions) reach the driver.
    Null texts and labels and texts without a letter are left out.
    """
    workers_find_package(labelled.sparkSession)

    def bundle_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = profiler(dims, ngram, seed)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_batches(texts, 1_000_000):
                by: dict[str, list[np.ndarray]] = {}
                for t, lang in zip(texts[a:b], langs[a:b], strict=True):
                    by.setdefault(lang, []).append(profile.grams(t))
                for (lang, _), v in zip(by.items(), profile.bundles([np.concatenate(g) for g in by.values()]),
                                        strict=True):
                    total[lang] = total.get(lang, 0.0) + v.astype(np.float64)
        profiler.cache_clear()  # a worker that lives on holds no tables for the steps after this
        yield pa.record_batch([pa.array(list(total), pa.string()),
                               pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
                              ["lang", "v"])

    sums = (labelled.where("text IS NOT NULL AND lang IS NOT NULL")
            .select(F.col("text").cast("string"), F.col("lang").cast("string"))
            .mapInArrow(bundle_task, "lang string, v array<double>")
            .select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
            .select("lang", F.col("v.x").alias("v")).orderBy("lang").collect())
    found = [(r["lang"], np.array(r["v"])) for r in sums if any(r["v"])]
    langs = [x for x, _ in found]
    protos = np.array([v / np.linalg.norm(v) for _, v in found]) if found else np.zeros((0, dims))
    return langs, protos


def predict(docs: DataFrame, langs: list[str], protos: np.ndarray, dims: int = DIMENSIONS, ngram: int = NGRAM,
            seed: int = SEED) -> DataFrame:
    """docs (text, ...) -> its columns, lang_pred and score (the cosine, 0 to 1).

    ``und`` with score 0 for a null text, one without a letter, or without any trained language; ties go to the
    language first in code point order.  One row per row; columns named like the added ones are replaced.
    """
    workers_find_package(docs.sparkSession)
    own = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in own]
    text_at = names.index("text")
    protos32 = protos.astype(np.float32)

    def predict_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = profiler(dims, ngram, seed)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            pred: list[str] = []
            score: list[float] = []
            for a, b in in_batches(texts, 500_000):
                grams = [profile.grams(t) if t else np.zeros(0, np.int64) for t in texts[a:b]]
                vectors = profile.bundles(grams)
                norm = np.linalg.norm(vectors, axis=1)
                cos = vectors @ protos32.T / np.where(norm > 0, norm, 1)[:, None] if langs else np.zeros((len(grams), 1))
                best = cos.argmax(axis=1)
                known = (norm > 0) & bool(langs)
                pred += [langs[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                score += np.where(known, cos.max(axis=1).clip(0, 1), 0.0).astype(np.float64).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()),
                                              pa.array(score, pa.float64())], [*names, "lang_pred", "score"])
            pa.default_memory_pool().release_unused()
        profiler.cache_clear()

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    return docs.select(*names).mapInArrow(predict_task, f"{types}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, held_out, lang_pred, score, learned from the folds that are not held out.

    Fold 0 of the crc32 of doc_id is held out; a null doc_id is not.  Repeated rows count and are predicted once
    each; an empty table gives no rows; lang, source and doc_id are no inputs of a prediction.
    """
    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    langs, protos = train(docs.where(~held).select("text", "lang"))
    return (predict(docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text")), langs,
                    protos).select("doc_id", "held_out", "lang_pred", "score"))


def identified_documents(docs: DataFrame, least_score: float = 0.0, contradicts: float | None = None) -> DataFrame:
    """The documents whose language is identified, with their own columns; rejects ``und`` and lower scores.

    With ``contradicts``, a document whose label names another language than its text is rejected as well, if the
    score is at least that; labels stay no input of the prediction, and documents without one are kept.
    """
    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    langs, protos = train(docs.where(~held).select("text", "lang"))
    keep = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)
    if contradicts is not None:
        keep &= ~F.coalesce((F.col("lang") != F.col("lang_pred")) & (F.col("score") >= contradicts), F.lit(False))
    return own_columns_apart(docs, ["text"] if contradicts is None else ["text", "lang"],
                             lambda own: predict(own, langs, protos).where(keep))
