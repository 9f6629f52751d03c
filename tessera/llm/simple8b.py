"""Simple-8b for arrays of ids, with blocks that decode independently.

A 64-bit word holds a selector in its top four bits and 60 bits of payload. Selector s < 14 packs
COUNT[s] values of WIDTH[s] bits, lowest first; selector 14 says that the payload is unused and the next
word is one raw 64-bit value (the escape for values of more than 60 bits). A block has BLOCK values at
most and begins with a new word, so that its offset in words is enough to decode it alone; the last word
of a block may have fewer values than its selector says, the rest being zeros.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
ESCAPE = 14
COUNT = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], dtype=np.int64)
WIDTH = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64], dtype=np.int64)


_BITS16 = np.zeros(1 << 16, np.uint8)
for _b in range(16):
    _BITS16[1 << _b : 2 << _b] = _b + 1


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    out = np.zeros(len(values), np.uint8)
    for shift in (0, 16, 32, 48):
        part = ((values >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
        np.maximum(out, np.where(part > 0, _BITS16[part] + np.uint8(shift), 0).astype(np.uint8), out=out)
        if not len(values) or int(values.max()) >> (shift + 16) == 0:
            break
    return out


def _selectors(values: np.ndarray, row: np.ndarray, column: np.ndarray, blocks: int) -> np.ndarray:
    """For each place the first selector all of whose values, or all that are left in the block, fit."""
    widest = np.zeros((blocks, BLOCK + 64), np.uint8)  # what stands beyond a block needs no bits
    widest[row, column] = _bits(values)
    chosen = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    reach, n = widest.copy(), 1
    # of the selectors that any value fits, the one with the most values
    wide = int(np.searchsorted(WIDTH[:ESCAPE], widest.max(initial=1)))
    for s in range(min(wide, ESCAPE - 1), -1, -1):
        while n < COUNT[s]:  # reach[i]: the widest of n values from i
            more = min(n, int(COUNT[s]) - n)
            reach[:, : -more or None] = np.maximum(reach[:, : -more or None], reach[:, more:])
            n += more
        fits = reach[:, :BLOCK] <= WIDTH[s]
        if not fits.any():
            break
        np.copyto(chosen, np.uint8(s), where=fits)
    return chosen[row, column]


def encode(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks and the first word of each block; ``lengths`` has the values of each block."""
    values, lengths = values.astype(np.uint64), np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    column = np.arange(len(values)) - np.repeat(starts, lengths)
    selector = _selectors(values, row, column, len(lengths))
    # all blocks walk from word to word at the same time
    at, end, is_head = starts, ends, np.zeros(len(values), bool)
    while len(at := at[live := at < end]):
        end = end[live]
        is_head[at] = True
        at = at + COUNT[selector[at]]
    head = np.flatnonzero(is_head)
    used = selector[head].astype(np.int64)
    escaped = used == ESCAPE
    slot = np.arange(len(head)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(head) + int(escaped.sum()), np.uint64)
    if len(head):
        n = np.diff(head, append=len(values))
        within = np.arange(len(values)) - np.repeat(head, n)
        shift = (within * np.repeat(np.where(escaped, 0, WIDTH[used]), n)).view(np.uint64)
        words[slot] = np.bitwise_or.reduceat(values << shift, head)
        words[slot[escaped] + 1] = values[head[escaped]]
        words[slot[escaped]] = 0
        words[slot] |= used.astype(np.uint64) << np.uint64(60)
    per_block = np.bincount(row[head], weights=1 + escaped, minlength=len(lengths)).astype(np.int64)
    return words, np.cumsum(per_block) - per_block


def decode(words: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All values of the blocks that begin at ``offsets`` and have ``lengths`` values."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)
    if (selector == ESCAPE).any():  # a raw word may look like anything: walk over those that may follow an escape
        for k in np.flatnonzero(selector == ESCAPE):
            if not raw[k]:
                raw[k + 1] = True
    head = np.flatnonzero(~raw[:-1])
    s = selector[head]
    n = COUNT[s]
    block = np.searchsorted(offsets, head, side="right") - 1 if len(head) else head
    # empty blocks share their offset with the next one; a word belongs to the last block that begins there
    before = np.cumsum(n) - n
    first = np.searchsorted(head, offsets)
    start = np.concatenate((before, [n.sum()]))[first]
    within_block = before - start[block]
    n = np.minimum(n, lengths[block] - within_block)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(np.where(s == ESCAPE, 0, WIDTH[s]), n)
    mask = np.where(s == ESCAPE, 0, (np.uint64(1) << np.minimum(WIDTH[s], 60).astype(np.uint64)) - np.uint64(1)).astype(np.uint64)
    out = (np.repeat(words[head], n) >> (place * width).astype(np.uint64)) & np.repeat(mask, n)
    single = np.cumsum(n) - n
    out[single[s == ESCAPE]] = words[head[s == ESCAPE] + 1]
    return out
