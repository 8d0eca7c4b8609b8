"""Token operators against the libraries, and exact round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from churnlens.llm import packing, tokencount, wavelet
from churnlens.llm.common import scratch
from churnlens.llm.tokens import WordCachedEncoder

BITS = [" ", "  ", "\n", "\t", "a", "Be", "'s", "1", "23", ",", ".", "é", "\u0301", "日本", "\u3000", "\x1c", "\x85", "\xa0",
        "İ", "<|endoftext|>", "<|startoftext|>", "ß", "½", "_", "😀", "Σ", "\r\n", "\x00", "ﬁ", "\x02", " the", " end.",
        "\nNew", "▁", " word", "ing "]


def lib_ids(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe", "word_bpe"])
def test_cached_ids_are_the_librarys(name, request):
    path = request.getfixturevalue(name)
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [None, "", "a, b."]
    ids, counts = WordCachedEncoder(path, name == "byte_bpe", cache_words=300).encode(texts)
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert counts.tolist() == [len(w.ids) for w in want]
    assert ids.tolist() == [i for w in want for i in w.ids]


def test_resynchronised_counts(piece_model):
    rng = random.Random(4)
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    counter = tokencount.ResyncCounter(piece_model)
    for k in range(400):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(30, 300)))
        counter.chunk, counter.overlap = rng.choice([(20, 3), (40, 5), (120, 10)])
        assert counter.spliced(text) == len(lib.encode(text)), (k, text)
    assert counter.spliced("y" * 1000) == len(lib.encode("y" * 1000))  # no boundary anywhere


def test_token_counts_rows(odd_docs, no_docs, piece_model):
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    got = Counter(map(tuple, tokencount.token_counts(odd_docs, piece_model, 100, 5000, 50).collect()))
    want = Counter()
    for r in odd_docs.collect():
        n = len(lib.encode(r.text or ""))
        want[(r.doc_id, len((r.text or "").encode()), n, n > 100)] += 1
    assert got == want
    assert tokencount.token_counts(no_docs, piece_model).count() == 0


def check_packing(docs, pieces, path, end_id, length):
    want = Counter()
    for r in docs.collect():
        want[(r.doc_id, tuple(lib_ids(path, r.text or "") + [end_id]))] += 1
    ids_by = defaultdict(list)
    for (doc_id, ids), n in want.items():
        ids_by[(doc_id, len(ids))] += [np.array(ids, "<u4")] * n
    covered, windows = Counter(), defaultdict(list)
    for p in pieces:
        options = ids_by[(p.doc_id, p.doc_tokens)]
        assert any(zlib.crc32(o[p.start:p.start + p.length]) == p.ids_crc32 for o in options)
        assert p.length > 0
        covered[(p.doc_id, p.doc_tokens)] += p.length
        windows[p.sequence_id].append((p.offset, p.length))
    assert covered == Counter({k: k[1] * len(v) for k, v in ids_by.items()})
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    total = sum(covered.values())
    return padding / max(1, total)


def test_packing_covers_every_id_once(documents, word_bpe):
    docs = documents.repartition(7)
    pieces = packing.pack_documents(docs, word_bpe, 2, length=1024, open_windows=4, fan_in=3).collect()
    assert check_packing(docs, pieces, word_bpe, 2, 1024) < 0.02


def test_packing_odd_rows(odd_docs, no_docs, word_bpe):
    pieces = packing.pack_documents(odd_docs, word_bpe, 2, length=256, open_windows=2).collect()
    assert check_packing(odd_docs, pieces, word_bpe, 2, 256) < 0.05
    assert packing.pack_documents(no_docs, word_bpe, 2).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(no_docs, word_bpe, 2, length=1000)


def check_ids(docs, got, path):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for doc_id, text in rows:
        ids = np.array(lib_ids(path, text) + [0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want


def test_shards_give_the_ids_back(documents, odd_docs, no_docs, byte_bpe):
    check_ids(documents, wavelet.corpus_ids(documents, byte_bpe, 0, shard_tokens=20_000), byte_bpe)
    check_ids(odd_docs, wavelet.corpus_ids(odd_docs, byte_bpe, 0, shard_tokens=10), byte_bpe)
    assert wavelet.corpus_ids(no_docs, byte_bpe, 0).count() == 0


def test_wavelet_lookups():
    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (70_000, 3), (1_200_000, 50_257), (3000, 100_000)):
        ids = (rng.zipf(1.4, n) % top).astype(np.uint32)
        shard = wavelet.WaveletShard(wavelet.build_shard([4, None], [n, 0], ids))
        assert (shard.decode() == ids).all() and shard.doc_ids == [4, None] and shard.lengths.tolist() == [n, 0]
        for i in rng.integers(0, n, 5) if n else []:
            assert shard.access(int(i)) == ids[i]
        for token in {0, 1, 2, 77, top, *map(int, ids[:3])}:
            where = np.flatnonzero(ids == token)
            assert shard.count(token) == len(where)
            assert shard.rank(token, n // 2) == (where < n // 2).sum()
            for k in {0, len(where) // 2, len(where) - 1} if len(where) else ():
                assert shard.select(token, k) == where[k]
            if len(where) < 5:
                assert shard.positions(token) == where.tolist()
        with pytest.raises(IndexError):
            shard.access(n)


def test_only_listed_files_are_read(spark, documents, byte_bpe):
    folder = scratch(spark, "orphans")
    first = wavelet.write_shards(documents.limit(5), byte_bpe, 0, folder)
    wavelet.write_shards(documents, byte_bpe, 0, folder)  # files that the list does not name
    assert wavelet.read_shards(spark, folder, first).count() == 5


def test_lookups_read_single_chunks():
    ids = np.random.default_rng(8).integers(0, 50_000, wavelet.SEGMENT_TOKENS).astype(np.uint32)
    content = wavelet.build_shard([1], [len(ids)], ids)
    plane_chunks = wavelet.SEGMENT_TOKENS // 8 // wavelet.CHUNK

    def parts(look):
        shard = wavelet.WaveletShard(content)
        look(shard)
        return shard.chunks_read

    assert plane_chunks == 8
    assert parts(lambda s: s.access(100_000)) <= 16 * 2  # a directory and a chunk a plane
    assert parts(lambda s: s.rank(int(ids[0]), 200_000)) <= 16 * 3
    assert parts(lambda s: s.select(int(ids[0]), 0)) <= 16 * 4
    assert parts(lambda s: s.decode()) >= 16 * plane_chunks


def test_equal_rows_spread_over_shards(spark, byte_bpe):
    same = spark.range(0, 3000, 1, 6).selectExpr("CAST(NULL AS LONG) AS doc_id", "'the same text' AS text")
    folder = scratch(spark, "same")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else such small ranges become one
    try:
        files = wavelet.write_shards(same, byte_bpe, 0, folder).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({f["part"] for f in files}) > 2
    assert max(f["n_tokens"] for f in files) < sum(f["n_tokens"] for f in files) / 2
    assert wavelet.read_shards(spark, folder, spark.createDataFrame(files)).count() == 3000
