"""Token ids by the tokenizers library, each distinct piece of a block encoded once.

The pre-tokenizers of both vocabularies never join text across white space, so a text's ids are those of
its pieces in order. A piece is a word with the white space before it (for the byte-level vocabulary with one
space; what is left of a run of white space is a piece as the pre-tokenizer cuts it), or the symbols after
its letters. Texts where that could differ (white space outside ASCII, strings that look like special
tokens) are encoded whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from ._common import LOWER_BYTES, binary, mix, ragged, strings

#: Pieces whose ids a worker remembers (about 30 bytes each); beyond that it starts anew. It only saves time.
REMEMBERED = 1_500_000
#: New pieces are merged into the sorted store when there are so many.
RECENT = 150_000
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_SYMBOL = np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_FOLDED = np.where(_SPACE, 32, LOWER_BYTES).astype(np.uint8)
_ODD = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}]|<\\|"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def hashes(pieces: pa.Array) -> np.ndarray:
    """64 bits for each string: a polynomial of its bytes, its length mixed in."""
    off, data = binary(pieces)
    lens = np.diff(off)
    out = lens.astype(np.uint64)
    for n in np.unique(lens):
        rows = np.flatnonzero(lens == n)
        if n > 256:
            out[rows] = [xxhash.xxh3_64_intdigest(data[off[r] : off[r + 1]].tobytes()) for r in rows]
            continue
        h = np.full(len(rows), n, np.uint64)
        for k in range(int(n)):
            h = h * np.uint64(0x9E3779B97F4A7C15) + data[off[rows] + k] + np.uint64(1)
            h ^= h >> np.uint64(29)
        out[rows] = mix(h)
    return out


class Encoder:
    """byte_level: white space is part of the text, else it only parts words."""

    def __init__(self, path: str, byte_level: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.byte_level = Tokenizer.from_file(path), byte_level
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.stores, self.flat = [none, none], np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32)

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Start in self.flat and length of each piece's ids. The pieces differ from each other."""
        if sum(len(s[0]) for s in self.stores) > REMEMBERED:
            self._forget()
        keys = hashes(pieces)
        start, lens, new = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        for known, at, n in self.stores:
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                same = known[i] == keys
                start[same], lens[same] = at[i[same]], n[i[same]]
                new &= ~same
        where = np.flatnonzero(new)
        if not len(where):
            return start, lens
        texts, ids = pieces.take(pa.array(where)).to_pylist(), []
        for i in range(0, len(texts), 2048):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 2048], add_special_tokens=False)]
        lens[where] = np.fromiter(map(len, ids), np.int64, len(ids))
        start[where] = len(self.flat) + np.cumsum(lens[where]) - lens[where]
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), self.flat.dtype)])
        old, recent = self.stores
        recent = tuple(np.concatenate(x) for x in zip(recent, (keys[where], start[where], lens[where]), strict=True))
        order = np.argsort(recent[0], kind="stable")
        recent = tuple(x[order] for x in recent)
        if len(recent[0]) > RECENT:
            recent = tuple(np.concatenate(x) for x in zip(old, recent, strict=True))
            order = np.argsort(recent[0], kind="stable")
            old, recent = tuple(x[order] for x in recent), tuple(x[:0] for x in recent)
        self.stores = [old, recent]
        return start, lens

    def _pieces(self, col: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Offsets of each text's pieces, and the pieces, side by side as they stand in the texts."""
        off, data = binary(col)
        n = len(data)
        if not self.byte_level:
            data = _FOLDED[data]  # the tokenizer lower-cases and drops white space itself
        first = np.zeros(n + 1, bool)
        first[off] = True
        space = np.append(_SPACE[data], True)
        after_space = np.concatenate([[False], space[:-1]]) & ~first  # white space of the same text stands before
        starts = first.copy()
        if n:
            # symbols after an ASCII letter are tokenized for themselves
            starts[1:n] |= _LETTER[data[:-1]] & _SYMBOL[data[1:]]
        starts |= space & ~after_space
        if self.byte_level:
            last = np.flatnonzero(~space & after_space) - 1  # the last white space before a word
            starts[last] = True  # a space goes with its word, any other stands alone
            starts[(last + 1)[data[last] != 32]] = True
        starts[n] = False
        at = np.flatnonzero(starts)
        return np.searchsorted(at, off), strings(np.append(at, n), data)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and the ids (unsigned, of 16 bits if they fit). Null counts as empty."""
        col = pc.fill_null(col, "")
        odd = pc.match_substring_regex(col, _ODD).to_numpy(zero_copy_only=False)
        at, flat = self._pieces(pc.if_else(pa.array(odd), "", col) if odd.any() else col)
        coded = flat.dictionary_encode()
        starts, lens = self._ids(coded.dictionary)
        which = coded.indices.to_numpy()
        lens = lens[which]
        out = self.flat[ragged(starts[which], lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])[at]
        if odd.any():
            own = [out[ends[k] : ends[k + 1]] for k in range(len(col))]
            for k in np.flatnonzero(odd):
                own[k] = np.array(self.tokenizer.encode(col[int(k)].as_py(), add_special_tokens=False).ids, out.dtype)
            out, ends = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        return ends.astype(np.int64), out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, byte_level: bool) -> Encoder:
    """One for each worker process."""
    if (path, byte_level) not in _encoders:
        _encoders[path, byte_level] = Encoder(path, byte_level)
    return _encoders[path, byte_level]
