"""Simple-8b word-aligned coding of ids, vectorised.

A file image is: magic, counts, the word offset of each block of BLOCK ids, then little-endian 64-bit words.
The top 4 bits of a word select how many ids it holds and of how many bits each. Selector 0 is the escape:
the next word is one id as it is (for ids of 60 bits or more). No word spans two blocks, so any block can
be decoded alone. Encoding cuts a block greedily: each word takes the most ids that fit it.
"""

from __future__ import annotations

import numpy as np

#: Ids in a word and bits of each, by selector; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
MAGIC = b"S8B1"
_POWERS = np.array([1 << k for k in range(64)], np.uint64)
_BITS = np.searchsorted(_POWERS, np.arange(1 << 16).astype(np.uint64), side="right").astype(np.uint8)


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    n_blocks = -(-n // block)
    if not n:
        return MAGIC + np.array([0, block, 0, 0], np.int64).tobytes()
    wide = _BITS[ids.astype(np.uint16)] if int(ids.max()) < 1 << 16 else np.searchsorted(_POWERS, ids, side="right").astype(np.uint8)
    room = np.minimum(np.arange(block, 0, -1)[np.arange(n) % block], np.arange(n, 0, -1)).astype(np.uint16)  # ids to the block's end
    chosen = np.where(wide > WIDTHS[-1], 0, len(COUNTS) - 1).astype(np.uint8)
    most, held = wide, 1  # the widest of `held` ids from here on
    for sel in range(len(COUNTS) - 2, 0, -1):  # from few wide ids to many narrow ones: the last that fits holds most
        while held < COUNTS[sel]:
            reach = min(held, int(COUNTS[sel]) - held)
            more = np.full(n, 255, np.uint8)
            if reach < n:
                more[:-reach] = most[reach:]
            most, held = np.maximum(most, more), held + reach
        fits = (most <= WIDTHS[sel]) & (room >= COUNTS[sel])
        if not fits.any():
            break  # fewer bits for more ids can't fit either
        chosen[fits] = sel
    step = COUNTS[chosen]
    # the words' starts: follow the steps from each block's start, all blocks side by side
    firsts = np.arange(0, n, block)
    stops = np.minimum(firsts + block, n)
    at = firsts.copy()
    live = np.arange(n_blocks)
    is_start = np.zeros(n, bool)
    while len(live):
        is_start[at[live]] = True
        at[live] += step[at[live]]
        live = live[at[live] < stops[live]]
    start = np.flatnonzero(is_start)
    sel = chosen[start]
    size = np.where(sel == 0, 2, 1)
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == 0:
            out[place[rows] + 1] = ids[start[rows]]
            continue
        word = np.full(len(rows), int(s) << 60, np.uint64)
        for k in range(COUNTS[s]):
            word |= ids[start[rows] + k] << np.uint64(k * WIDTHS[s])
        out[place[rows]] = word
    offsets = np.append(place[np.searchsorted(start, firsts)], len(out)).astype(np.int64)
    return MAGIC + np.array([n, block, n_blocks, len(out)], np.int64).tobytes() + offsets.tobytes() + out.tobytes()


def image_size(image: bytes) -> int:
    """Bytes of the image that begins here, whatever follows it."""
    n, _, n_blocks, n_words = np.frombuffer(image, np.int64, 4, 4)
    return 36 + (8 * (int(n_blocks) + 1) + 8 * int(n_words) if n else 0)


def decode(image: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids (uint64) of blocks first_block .. last_block (excluded; None: to the end)."""
    if image[:4] != MAGIC:
        raise ValueError("not a Simple-8b file")
    n, block, n_blocks, n_words = np.frombuffer(image, np.int64, 4, 4)
    last = int(n_blocks) if last_block is None else min(last_block, int(n_blocks))
    if not n or first_block >= last:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(image, np.int64, int(n_blocks) + 1, 36)
    words = np.frombuffer(image, np.uint64, int(n_words), 36 + 8 * (int(n_blocks) + 1))[offsets[first_block] : offsets[last]]
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == 0).any():  # what follows an escape is an id, whatever its top bits are
        for k in np.flatnonzero(sel == 0):
            if not raw[k]:
                raw[k + 1] = True
    count = np.where(raw, 0, COUNTS[sel])
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(sel[~raw]):
        rows = np.flatnonzero((sel == s) & ~raw)
        if s == 0:
            out[place[rows]] = words[rows + 1]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[place[rows] + k] = (words[rows] >> np.uint64(k * WIDTHS[s])) & mask
    return out
