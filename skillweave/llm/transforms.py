"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

A transform lists, for all suffixes of a shard's strings in order, the symbol before each: 0 (the end mark) before a whole
string, else the byte plus one. End marks are smaller than bytes and ordered by string, so no two suffixes are equal and the
first rows are the end marks themselves.

merge() never sorts suffixes. It holds the interleave of the shards' rows, at first by one symbol, and refines it: reading
rows in their present order and dealing each row's predecessor (the last-to-first step of its shard) out by the symbol gives
the order by one symbol more. The pass in which a border between two rows shows up tells their common prefix, so nothing is
compared, and intervals without a border below depth are the repeated ones. A block whose rows a pass did not part
deals its predecessors out as before, so the next pass reads only the blocks that were parted.
"""

from __future__ import annotations

import numpy as np

#: Symbols of nine bits that fit into the first sorting key.
_PACK = 7


def transform(strings: list[bytes]) -> np.ndarray:
    """The transform of a shard's strings, by doubling the ranks of suffixes not yet alone; strings may be empty or equal."""
    sizes = np.fromiter((len(s) for s in strings), np.int64, len(strings))
    m, n = len(sizes), int(sizes.sum()) + len(sizes)
    if not m:
        return np.zeros(0, np.uint8)
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    key, inside = np.zeros(n, np.int64), np.ones(n, bool)
    padded = np.append(text, np.zeros(_PACK, np.int64))
    for ahead in range(_PACK):
        later = padded[ahead : ahead + n]
        key <<= 9
        key |= np.where(inside, later, 0)
        inside &= later != 0
    order = np.argsort(key)
    sorted_ = key[order]
    head = np.ones(n, bool)
    head[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(n, np.int64)  # where each suffix's block starts
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    short = np.flatnonzero(~inside)  # the end mark was seen: equal ones are settled by string
    short = short[np.argsort(rank[short], kind="stable")]
    block = rank[short]
    head = np.diff(block, prepend=-1) != 0
    rank[short] = block + np.arange(len(short)) - np.flatnonzero(head)[np.cumsum(head) - 1]
    order[rank[short]] = short
    step, several = _PACK, np.bincount(rank, minlength=n) > 1
    rows = order[several[rank[order]]]
    while len(rows):
        block = rank[rows]
        at = np.argsort(block * n + rank[rows + step])
        rows, key = rows[at], rank[rows[at] + step]
        head, part = np.ones(len(rows), bool), np.ones(len(rows), bool)
        head[1:] = block[1:] != block[:-1]
        part[1:] = head[1:] | (key[1:] != key[:-1])
        place = block + np.arange(len(rows)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        order[place] = rows
        number = np.cumsum(part) - 1
        rank[rows] = place[part][number]
        rows = rows[np.bincount(number)[number] > 1]
        step *= 2
    symbols = text[order - 1]
    return symbols.astype(np.uint8 if symbols.max() < 256 else np.uint16)


def last_to_first(symbols: np.ndarray) -> np.ndarray:
    """For each row, the row of the suffix that is longer by the row's symbol; rows of end marks map to end marks."""
    step = np.empty(len(symbols), np.int32)
    step[np.argsort(symbols, kind="stable")] = np.arange(len(symbols), dtype=np.int32)
    return step


def walked(symbols: np.ndarray, step: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's string and the length of its suffix, and each string's length: all strings are walked back from their ends.

    ends are the rows of the end marks, the first rows unless told (when several shards' rows follow one another).
    """
    owner, length = np.empty(len(symbols), np.int32), np.empty(len(symbols), np.int32)
    row = np.arange(int((symbols == 0).sum())) if ends is None else ends
    string, sizes, done = np.arange(len(row)), np.zeros(len(row), np.int64), 0
    while len(row):
        owner[row], length[row] = string, done
        on = symbols[row] != 0
        sizes[string[~on]] = done
        row, string, done = step[row[on]], string[on], done + 1
    return owner, length, sizes


def merge(transforms: list[np.ndarray], depth: int, steps: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of all transforms' rows by the first depth symbols, and common prefixes.

    Rows are numbered through all transforms in turn. The second array holds for each place the length of the common prefix
    with the place before, or depth if it is at least that; -1 at the first place. Suffixes that end before depth differ.
    steps are the transforms' last-to-first steps, if they are at hand.
    """
    if not transforms:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    base = np.cumsum([0, *[len(t) for t in transforms]])
    symbols = np.concatenate(transforms)
    n = len(symbols)
    step = np.concatenate([t + np.int32(b) for t, b in zip(steps or map(last_to_first, transforms), base)])
    first = np.concatenate([np.sort(t) for t in transforms])
    order = np.argsort(first, kind="stable").astype(np.int32)
    first = first[order]
    border = first == 0
    border[1:] |= first[1:] != first[:-1]
    prefix = np.where(border, 0, depth).astype(np.int32)
    prefix[:1] = -1
    block = np.empty(n, np.int32)  # where each row's block starts
    block[order] = np.flatnonzero(border)[np.cumsum(border) - 1]
    rows = order
    for passed in range(1, depth):
        symbol = symbols[rows]
        source = rows[np.argsort(symbol, kind="stable")[len(symbol) - np.count_nonzero(symbol) :]]
        if not len(source):
            break
        rows = step[source]
        group, inner = block[rows], block[source]
        head = np.ones(len(rows), bool)
        head[1:] = group[1:] != group[:-1]
        parted = ~head
        parted[1:] &= inner[1:] != inner[:-1]
        heads = np.flatnonzero(head)
        live = np.logical_or.reduceat(parted, heads)  # only rows of blocks that this pass parts have to move
        if not live.any():
            break
        sizes = np.diff(np.append(heads, len(rows)))
        moved = np.repeat(live, sizes)
        rows, parted, sizes = rows[moved], parted[moved], sizes[live]
        start = np.cumsum(sizes) - sizes
        place = np.arange(len(rows), dtype=np.int32) + np.repeat(group[heads[live]] - start.astype(np.int32), sizes)
        order[place] = rows
        prefix[place[parted]] = passed
        parted[start] = True
        cut = np.flatnonzero(parted)
        block[rows] = np.repeat(place[cut], np.diff(np.append(cut, len(rows))))
    return order, prefix
