"""Token ids of whole texts with the public tokenizer files, at word-cache speed.

Both vocabularies split a text into words before merging, so equal words always get equal ids.  A batch of
texts is cut (by Arrow, outside Python) at places where the pre-tokenizer always cuts; the library encodes each
different word once, and the ids of the texts are gathered from a bounded cache.  Texts in which a cut could be
unsafe (two white-space characters side by side or at an end, a special token's string, the mark used here) go
to the library whole, so the ids are always those of the library for the whole text.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bound on words per Python worker that were met again (about 200 bytes each); a third as many new ones are kept.
CACHE_WORDS = 300_000
#: Ids travel as unsigned 32-bit little-endian.
ID_DTYPE = np.dtype("<u4")

_BARE = "\x02"  # put before a piece that no blank precedes
_BLANK = r"\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Where blanks belong to words, a text with such a place is not cut.
_UNSAFE = f"[{_BLANK}][{_BLANK}]|^[{_BLANK}]|[{_BLANK}]$|{_BARE}"
#: Words that are encoded as one text.
_JOINED = 1000
_LETTERS = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"


class WordCachedEncoder:
    """Ids equal to the library's for the whole text.

    ``keep_space``: the blank before a word belongs to the word (byte-level files); otherwise white space is
    dropped and letters are lower-cased by the file itself (word-level files).
    """

    def __init__(self, path: str, keep_space: bool, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.keep_space = keep_space
        self.specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.limit = cache_words
        # ids that begin (byte-level) or end (word-level) a word
        vocabulary = self.lib.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if keep_space else t.endswith("</w>"))]] = True
        self.words: dict[str, bytes] = {}  # words met at least twice
        self.fresh: dict[str, bytes] = {}  # words met once, emptied first

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_ids(self, keys: list[str]) -> list[bytes]:
        """Ids of words from the library: most of them many at a time, as one text of words behind blanks.

        A word can join if its ids can be told from its neighbours': behind a blank, only the first begins with one;
        without blanks, only the last of a word of letters ends a word.
        """
        out: list[bytes | None] = [None] * len(keys)
        if self.keep_space:
            joined = [i for i, k in enumerate(keys) if k and k[0] != _BARE and k != "\n"]
        else:
            joined = [i for i, k in enumerate(keys) if k.isalpha() and (k.isascii() or max(k) < "\u0100")]
        parts = [joined[a:a + _JOINED] for a in range(0, len(joined), _JOINED)]
        texts = ["".join([" " + keys[i] for i in part]) for part in parts]
        for part, e in zip(parts, self.lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, ID_DTYPE)
            edges = np.flatnonzero(self.edge[ids])
            cuts = np.append(edges, len(ids)) if self.keep_space else np.append(0, edges + 1)
            if len(edges) != len(part) or cuts[0] or cuts[-1] != len(ids):
                continue  # not one edge a word: these words are encoded one by one
            data, cuts = ids.tobytes(), (cuts * ID_DTYPE.itemsize).tolist()
            for i, a, b in zip(part, cuts, cuts[1:], strict=False):
                out[i] = data[a:b]
        rest = [i for i, b in enumerate(out) if b is None]
        for i, b in zip(rest, self.library([self._text_of(keys[i]) for i in rest]), strict=True):
            out[i] = b
        return out

    def _text_of(self, key: str) -> str:
        if not self.keep_space or not key:
            return key
        return key[1:] if key[:1] == _BARE else "\n" if key == "\n" else " " + key

    def _ids(self, keys: list[str]) -> list[bytes]:
        """Ids of words by cache key; the library sees only words that are not cached."""
        found = list(map(self.words.get, keys))
        new = []
        for i in [i for i, f in enumerate(found) if f is None]:
            found[i] = b = self.fresh.pop(keys[i], None)
            if b is None:
                new.append(i)
            else:
                self.words[keys[i]] = b
        if len(self.words) > self.limit:
            self.words.clear()
        if new:
            if len(self.fresh) + len(new) > self.limit // 3:
                self.fresh.clear()
            for i, b in zip(new, self._new_ids([keys[i] for i in new]), strict=True):
                found[i] = self.fresh[keys[i]] = b
        return found

    def _cuttable(self, column: pa.Array) -> np.ndarray:
        """Which texts are sure to have the library's ids when they are cut."""
        bad = pc.equal(pc.binary_length(column), 0)
        for s in self.specials:
            bad = pc.or_(bad, pc.match_substring(column, s, ignore_case=not self.keep_space))
        if self.keep_space:
            bad = pc.or_(bad, pc.match_substring_regex(column, _UNSAFE))
        return ~pc.fill_null(bad, True).to_numpy(zero_copy_only=False)

    def _pieces(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of texts, and the number of pieces of each: cut before blanks and around line ends."""
        if self.keep_space:
            column = pc.replace_substring(column, "\n", f" \n {_BARE}")
            mark, none = pa.scalar(_BARE, pa.large_string()), pa.scalar("", pa.large_string())
            column = pc.binary_join_element_wise(mark, column, none)
        else:  # white space is dropped, and A-Z lower-cased, by the file itself as well
            column = pc.ascii_lower(pc.replace_substring(column, "\n", " "))
        cut = pc.split_pattern(column, " ")
        return cut.flatten(), np.diff(cut.offsets.to_numpy())

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text (null: none)."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        fast = self._cuttable(column)
        ids, counts = self._encode_fast(column.filter(pa.array(fast)))
        if fast.all():
            return ids, counts
        parts: list[np.ndarray] = [np.zeros(0, ID_DTYPE)] * len(column)
        for i, a, n in zip(np.flatnonzero(fast), np.cumsum(counts) - counts, counts, strict=True):
            parts[i] = ids[a:a + n]
        slow = np.flatnonzero(~fast)
        for i, b in zip(slow, self.library([t or "" for t in column.take(pa.array(slow)).to_pylist()]), strict=True):
            parts[i] = np.frombuffer(b, ID_DTYPE)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _encode_fast(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(column):
            return np.zeros(0, ID_DTYPE), np.zeros(0, np.int64)
        flat, n_pieces = self._pieces(column)
        coded = flat.dictionary_encode()
        pieces = coded.dictionary
        # a letter word with a tail of commas or stops is two words; every other piece is looked up as it is
        core = pc.ascii_rtrim(pieces, ",.")
        bare = pc.replace_substring_regex(core, f"^{_BARE}", "") if self.keep_space else core
        letters = pc.match_substring_regex(bare, _LETTERS)
        core = pc.if_else(letters, core, pieces).dictionary_encode()
        tail = pc.struct_field(pc.extract_regex(pieces, "(?P<tail>[,.]*)$"), "tail")
        tail = pc.if_else(letters, tail, pa.scalar("", tail.type)).dictionary_encode()
        cores, tails = (d.dictionary.to_numpy(zero_copy_only=False).tolist() for d in (core, tail))
        mark = _BARE if self.keep_space else ""
        blobs = self._ids(cores + [mark + t if t else "" for t in tails])
        # ragged gather: each piece gives the ids of its word and of its tail
        n = np.fromiter(map(len, blobs), np.int64, len(blobs)) // ID_DTYPE.itemsize
        first = np.cumsum(n) - n
        heap = np.frombuffer(b"".join(blobs), ID_DTYPE)
        word_of = np.stack([core.indices.to_numpy(), tail.indices.to_numpy() + len(cores)], axis=1)
        words = word_of[coded.indices.to_numpy()].ravel()
        lens = n[words]
        ends = np.cumsum(lens)
        at = np.repeat(first[words] - (ends - lens), lens)
        at += np.arange(len(at))
        per_piece = lens[0::2] + lens[1::2]
        counts = np.add.reduceat(per_piece, np.cumsum(n_pieces) - n_pieces)  # a text has one piece at least
        return heap[at], counts


@lru_cache(maxsize=4)
def encoder(path: str, keep_space: bool) -> WordCachedEncoder:
    """One encoder per file and Python worker."""
    return WordCachedEncoder(path, keep_space)


def in_batches(texts: list[str | None], chars: int = 4_000_000):
    """Slices of a list of texts with a bounded number of characters (one text at least)."""
    return _slices((len(t) if t else 0 for t in texts), chars)


def in_byte_batches(texts: pa.Array, size: int = 3_000_000):
    """Slices of a text column with a bounded number of bytes (one text at least)."""
    return _slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), size)


def _slices(sizes, most: int):
    start, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start <= i:
        yield start, i + 1
