"""Words of many texts at once, as hashes, with numpy over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Multiplier of the polynomial over a word's bytes; odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return POWERS["up"][:n], POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after it
    row: np.ndarray  # text of each word, from 0
    first: np.ndarray  # number of words before each text, and before the end
    hash: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Runs of bytes other than 0x20 and 0x09-0x0D in each text; offsets are relative to data. lower: A-Z become a-z before hashing."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    n = len(data)
    word = ~space
    begins = word.copy()
    begins[1:] &= space[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = word[edge]
    ends = word.copy()
    ends[:-1] &= space[1:]
    tail = offsets[1:][offsets[1:] > 0] - 1
    ends[tail] = word[tail]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets, "left")
    up, down = powers(n + 1)
    if lower:
        data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    return Words(start, end, row, first, mixed(value + (end - start).astype(np.uint64)))


def windows(w: Words, size: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, hash) of each run of `size` words within a text. short: a text of fewer words gives all its words as one run."""
    n = len(w.hash)
    at = np.arange(max(0, n - size + 1))
    at = at[w.row[at] == w.row[at + size - 1]] if len(at) else at
    code = np.zeros(len(at), np.uint64)
    for k in range(size):
        code = mixed(code + w.hash[at + k] + np.uint64(k))
    row = w.row[at]
    if short:
        count = np.diff(w.first)
        few = np.flatnonzero((count > 0) & (count < size))
        start = w.first[:-1][few]
        small = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            has = count[few] > k
            small[has] = mixed(small[has] + w.hash[start[has] + k] + np.uint64(k))
        small = mixed(small + count[few].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        row, at, code = np.concatenate([row, few]), np.concatenate([at, start]), np.concatenate([code, small])
        order = np.argsort(row, kind="stable")
        row, at, code = row[order], at[order], code[order]
    return row, at, code
