"""Simple-8b: numbers packed into 64-bit words, as many in a word as its widest allows.

The upper four bits of a word say how its other sixty are shared out: selector s, from 1 on, is
``60 // WIDTHS[s - 1]`` numbers of that width, the first in the lowest bits. Selector 0 is an escape:
the next word is one number of more than 60 bits as it is (whose upper four bits are never all
zero, so it is not taken for another escape). Numbers are coded in blocks of a fixed count, each of
which begins a new word: blocks are found by their offsets, and coded and decoded side by side.
"""

from __future__ import annotations

import numpy as np

#: The widths of the code.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = tuple(60 // w for w in WIDTHS)
#: Numbers in a block.
BLOCK = 1024

_STEPS = np.array([1, *COUNTS], np.int64)


def _selectors(flat: np.ndarray) -> np.ndarray:
    """The selector that packs most from each place on."""
    best = np.zeros(len(flat), np.uint8)
    for s in range(len(WIDTHS), 0, -1):
        width, count = WIDTHS[s - 1], COUNTS[s - 1]
        fits, have = flat < (1 << width) if width < flat.itemsize * 8 else np.ones(len(flat), bool), 1
        while have < count and fits.any():  # the next ``have`` places fit
            step = min(have, count - have)
            fits[:-step] &= fits[step:]
            have += step
        if have == count:
            np.copyto(best, s, where=fits)
    return best


def encode(numbers: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers to (words, words of each block); the last block may be short."""
    numbers = np.asarray(numbers)
    n = len(numbers)
    rows = -(-n // block)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # A row for each block; the places after it, as many as a word can hold, are zeros that fit anywhere.
    across = block + max(COUNTS)
    grid = np.zeros((rows, across), np.uint32 if numbers.max() < 1 << 32 else np.uint64)
    whole = n // block
    grid[:whole, :block] = numbers[: whole * block].reshape(whole, block)
    if whole < rows:
        grid[whole, : n - whole * block] = numbers[whole * block :]
    flat = grid.ravel()
    best = _selectors(flat)

    # All blocks step from word to word side by side.
    begins = np.arange(rows) * across
    ends = begins + np.minimum(block, n - np.arange(rows) * block)
    at, taken = begins, []
    while len(at):
        taken.append(at)
        at = at + _STEPS[best[at]]
        going = at < ends
        if not going.all():
            at, ends = at[going], ends[going]
    at = np.sort(np.concatenate(taken))
    chosen = best[at]
    place = np.cumsum(1 + (chosen == 0)) - 1  # of the last word of each step
    words = np.zeros(int(place[-1]) + 1, np.uint64)
    words[place[chosen == 0]] = flat[at[chosen == 0]]
    for s, (width, count) in enumerate(zip(WIDTHS, COUNTS, strict=True), 1):
        of = np.flatnonzero(chosen == s)
        if len(of):
            packed = np.full(len(of), np.uint64(s) << np.uint64(60))
            for j in range(count):
                packed |= flat[at[of] + j].astype(np.uint64) << np.uint64(width * j)
            words[place[of]] = packed
    row = at // across
    return words, np.bincount(row, weights=1 + (chosen == 0), minlength=rows).astype(np.int64)


def decode(words: np.ndarray, sizes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """Words of consecutive blocks, of ``sizes`` words each, to their ``n`` numbers; all but the last block are full."""
    rows = len(sizes)
    if not rows:
        return np.zeros(0, np.uint64)
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    escape = selector == 0
    raw = np.zeros(len(words), bool)
    raw[1:] = escape[:-1]
    count = np.where(escape, 0, np.where(raw, 1, _STEPS[np.minimum(selector, len(WIDTHS))]))
    row = np.repeat(np.arange(rows), sizes)
    before = np.cumsum(count) - count
    at = before - before[np.cumsum(sizes) - sizes][row]
    grid = np.zeros((rows, block + max(COUNTS)), np.uint64)
    grid[row[raw], at[raw]] = words[raw]
    for s, (width, each) in enumerate(zip(WIDTHS, COUNTS, strict=True), 1):
        of = np.flatnonzero((selector == s) & ~raw)
        if len(of):
            mask = np.uint64((1 << width) - 1)
            for j in range(each):
                grid[row[of], at[of] + j] = (words[of] >> np.uint64(width * j)) & mask
    return grid[:, :block].reshape(-1)[:n]
