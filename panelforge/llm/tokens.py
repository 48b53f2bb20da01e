"""Exact token ids of whole texts, with the work done once for each distinct chunk.

Both tokenizers split a text with a pattern before they merge, so the ids of a text are the ids of its chunks in order
wherever a cut can't change how the pattern matches. ``ChunkEncoder`` cuts a batch of texts at blanks in Arrow, looks each
distinct chunk up in a bounded cache, sends only chunks not seen yet to the tokenizers library, and gathers the ids with
numpy. A text in which a cut could matter (see ``_UNSAFE_*``) goes to the library whole. A chunk of Latin letters and
punctuation is cut further before the look-up, into *pieces* that both patterns match apart, so that "word", "Word," and
"word." share one (see ``_pieces``, and ``_word_pieces`` for the word tokenizer). Runs of letters go to the library's merges at
once, as its normalizer and pattern don't change or cut them.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Chunks remembered by a worker, at most.
CACHE_CHUNKS = 600_000
#: Bytes of text whose chunks are held at once (one longer text is held alone).
GROUP_BYTES = 1_000_000

#: White space beyond ASCII, and controls that only some functions take as white space.
_ODD = r"\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}"
_UNSAFE_WORD = rf"[\x{{0}}{_ODD}]"
#: The byte tokenizer keeps white space; a blank beside other white space is matched together with it.
_UNSAFE_BYTE = rf"\x{{0}}| [ \t-\r{_ODD}]|[\t-\r{_ODD}] "

#: Letters whose lower case, normal form and class are the same in all versions of Unicode, and marks that neither pattern
#: takes together with letters, as it does an apostrophe.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
_WORD = re.compile(f"\0?[{_LETTERS}]+")
#: Kinds of bytes: a blank, letters, marks, a line end, all others.
_BLANK, _LETTER, _MARK, _END, _OTHER = range(5)
_KINDS = np.array([_BLANK if c == " " else _END if c == "\n" else _LETTER if c.isascii() and c.isalpha() else _MARK if re.match(f"[{_MARKS}]", c) else _OTHER for c in map(chr, range(256))], np.uint8)
#: The characters that stand for the bytes above 127 of a letter in a byte-level vocabulary.
_AS_BYTE = {b: 0x100 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class ChunkEncoder:
    """Ids as unsigned 16-bit numbers (32-bit for vocabularies above 65,536 ids)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Texts that hold an added token's string are encoded whole, as the library does by default.
        self.added = "|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values())
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        self.keeps_blanks = bool(self._ids([" "])[0])
        #: Stands between chunks that are encoded together, and is one id there that none of them makes.
        self.between = "\n" if self.keeps_blanks else " 7 "
        ((self.mark,),) = self._ids([self.between])
        self._restart()

    def _restart(self) -> None:
        self.cache: dict[str, int] = {}
        self.start, self.size, self.again = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)
        self.flat, self.used = np.zeros(1 << 18, self.dtype), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[str]) -> None:
        """Keys are chunks or pieces; for a tokenizer that keeps blanks, one after its blank, or a text's first or a piece after NUL."""
        letters = [x.isascii() and x.isalpha() or _WORD.fullmatch(x) is not None for x in keys]
        words = list(compress(keys, letters))
        self._learn_whole([x for x, is_word in zip(keys, letters, strict=True) if not is_word])
        tokenize = self.model.tokenize
        ids = [[t.id for t in tokenize(x if x.isascii() and not self.keeps_blanks else self._spelled(x))] for x in words]
        self._store(words, np.fromiter(chain.from_iterable(ids), self.dtype), np.fromiter(map(len, ids), np.int64))

    def _spelled(self, word: str) -> str:
        """A run of letters as the library hands it to its merges."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_AS_BYTE)
        return word if not self.keeps_blanks else word[1:] if word[0] in "\0\u0100" else "\u0120" + word

    def _gathered(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of the keys at these places, one after the other."""
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def _learn_whole(self, keys: list[str]) -> None:
        if self.keeps_blanks:
            alone = [x for x in keys if not x.isprintable() or not x]
            together = [x for x in keys if x.isprintable() and x]
            real = [x[1:] if x[:1] == "\0" else " " + x for x in alone]
            between, ahead = self.between + " ", " "
        else:
            alone = real = [x for x in keys if "7" in x or not x]
            together = [x for x in keys if "7" not in x and x]
            between, ahead = self.between, ""
        parts = [np.array(x, self.dtype) for x in self._ids(real)]
        sizes = [len(x) for x in parts]
        for k in range(0, len(together), 200):
            group = together[k : k + 200]
            ids = np.array(self._ids([ahead + between.join(group)])[0], self.dtype)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(group) - 1:
                each = self._ids([ahead + x for x in group])
                parts += [np.array(x, self.dtype) for x in each]
                sizes += [len(x) for x in each]
            else:
                parts.append(ids[ids != self.mark])
                sizes += np.diff(np.concatenate([[-1], cuts, [len(ids)]]) - np.arange(len(group) + 1)).tolist()
        self._store(alone + together, np.concatenate(parts) if parts else np.zeros(0, self.dtype), np.array(sizes, np.int64))

    def _store(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.cache), len(self.cache) + len(chunks)
        while m > len(self.start):
            self.start, self.size, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.again))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.cache.update(zip(chunks, range(n, m), strict=True))
        self.start[n:m] = self.used + np.cumsum(sizes) - sizes
        self.size[n:m] = sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _find(self, keys: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.cache.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            wanted = list(compress(keys, (at < 0).tolist()))
            new = list(dict.fromkeys(wanted))
            if len(self.cache) + len(new) > CACHE_CHUNKS and self.cache:
                self._shrink()
                return self._find(keys)
            self._learn(new)
            self.again[at[at >= 0]] = True
            at[missing] = np.fromiter(map(self.cache.__getitem__, wanted), np.int64, len(missing))
        return at

    def _shrink(self) -> None:
        """Keep the chunks that were met again since the last time, or none if these are half of the bound or more."""
        names, n = list(self.cache), len(self.cache)
        kept = np.flatnonzero(self.again[:n])
        start, size, flat = self.start[kept], self.size[kept], self.flat
        self._restart()
        if 2 * len(kept) < CACHE_CHUNKS:
            ends = np.cumsum(size)
            self._store([names[i] for i in kept], flat[np.repeat(start - ends + size, size) + np.arange(size.sum())], size)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (nulls as empty) one after the other, and where each text's ids begin and end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        parts, sizes, a, upto = [], [], 0, np.cumsum(lengths)
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] - lengths[a] + GROUP_BYTES, "right")))
            ids, n = self._group(texts.slice(a, b - a))
            parts.append(ids)
            sizes.append(n)
            a = b
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, self.dtype)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        unsafe = pc.match_substring_regex(texts, _UNSAFE_BYTE if self.keeps_blanks else _UNSAFE_WORD).to_numpy(zero_copy_only=False)
        if self.added:
            unsafe = unsafe | pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False)
        if unsafe.any():
            whole = [np.array(x, self.dtype) for x in self._ids(texts.filter(pa.array(unsafe)).to_pylist())]
            texts = pc.if_else(pa.array(unsafe), "", texts)
        if self.keeps_blanks:
            pieces, bounds = _pieces(texts)
        else:
            pieces, bounds = _word_pieces(texts)
        coded = pieces.dictionary_encode()
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if self.keeps_blanks:
            names = [x[1:] if x[0] == " " else "\0" + x for x in names]
        where = self._find(names)[codes]
        size = self.size[where]
        ids = self._gathered(where, size)
        ends = np.concatenate([[0], np.cumsum(size)])[bounds]
        sizes = np.diff(ends)
        if unsafe.any():
            pieces = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            for k, x in zip(np.flatnonzero(unsafe), whole, strict=True):
                pieces[k], sizes[k] = x, len(x)
            ids = np.concatenate(pieces)
        return ids, sizes


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of texts (large strings without null) with the blank before them, and where each text's begin and end among
    them. Chunks of letters, marks and single line ends between these are cut into runs of each kind."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[0] == at[-1]:
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
    raw, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
    kind, _ = _kinds(raw)
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    first[:-1] |= kind == _BLANK
    starts, first = np.flatnonzero(first[:-1]), first[:-1]
    bare = (kind == _BLANK) | (kind == _END)  # beside which, or a text's border, a line end isn't single
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:] = bare[:-1] | first[1:]
    after[:-1] = bare[1:] | first[1:]
    odd = (kind == _OTHER) | (kind == _END) & (before | after)
    plain = np.repeat(~np.logical_or.reduceat(odd, starts), np.diff(starts, append=len(raw)))
    first[1:] |= plain[1:] & (kind[1:] != kind[:-1]) & (kind[:-1] != _BLANK)
    cuts = np.flatnonzero(first)
    ends = np.append(cuts, len(raw))
    pieces = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    return pieces, np.searchsorted(ends, at)


def _kinds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and where the letters U+00C0 to U+00FF begin, which have two."""
    kind = _KINDS[raw]
    wide = np.flatnonzero(raw[:-1] == 0xC3)
    wide = wide[(raw[wide + 1] != 0x97) & (raw[wide + 1] != 0xB7)]
    kind[wide] = kind[wide + 1] = _LETTER
    return kind, wide


def _word_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """As ``_pieces``, without white space, for a tokenizer that drops it and takes letters in lower case: so those of chunks
    that are cut are turned to it first."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw, at = (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]
    keep = (raw != 32) & ((raw - np.uint8(9)) > 4)
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    first[1:] |= ~keep
    raw, first, at = raw[keep], first[:-1][keep], np.concatenate([[0], np.cumsum(keep)])[at]
    if not len(raw):
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
    kind, wide = _kinds(raw)
    starts = np.flatnonzero(first)
    plain = np.repeat(~np.logical_or.reduceat(kind == _OTHER, starts), np.diff(starts, append=len(raw)))
    raw[plain & ((raw - np.uint8(65)) < 26)] += 32
    last = wide[plain[wide] & (raw[wide + 1] < 0x9F)] + 1
    raw[last] += 32
    first[1:] |= plain[1:] & (kind[1:] != kind[:-1])
    cuts = np.flatnonzero(first)
    ends = np.append(cuts, len(raw))
    return pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]), np.searchsorted(ends, at)


def binary_array(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of a numpy array as an Arrow binary column, without a copy for each row."""
    at = bounds.astype(np.int64) * flat.itemsize
    kind, off = (pa.binary(), np.int32) if len(at) == 0 or at[-1] < 2**31 - 1 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(off).tobytes()), pa.py_buffer(np.ascontiguousarray(flat))])


def ids_of(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of ``binary_array``."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // dtype.itemsize
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype)
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def crc_u32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
