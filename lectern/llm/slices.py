"""Byte-level tokens: where they lie in the UTF-8 buffers of a batch of texts, and which of them are the same.

A lookup table over the 256 byte values says which bytes belong to tokens; bytes of 0x80 and above always do, so no
character is cut. A batch's texts lie one after another in one buffer, whose edges against a shifted copy of itself are
the tokens' bounds. Tokens are put in groups by a 64-bit hash, and every one is then compared, byte by byte, with its
group's first one; what differs gets a group of its own, so the groups are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once (one text at least).
CHUNK = 8 << 20
#: Tokens that are hashed at once.
_RUN = 1 << 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lookup(separators: bytes) -> np.ndarray:
    """The table of a token's bytes: all but the separators (ASCII)."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


@dataclass(frozen=True)
class Slices:
    """Tokens of a chunk of texts: raw[start:end] each, in order, with the number of their text."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes together."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    at = np.cumsum(lengths) // size
    bounds = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)]
    return ((int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a)


def slices(texts: pa.Array, table: np.ndarray) -> Slices:
    """The tokens of texts (null: none), with A-Z lower-cased."""
    whole = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = bytes(memoryview(whole.buffers()[2])[offsets[0] : offsets[-1]]).translate(_LOWER) if len(whole) and whole.buffers()[2] else b""
    offsets = offsets - offsets[0]
    inside = np.r_[False, table[np.frombuffer(raw, np.uint8)], False]
    before, after = inside[:-2].copy(), inside[2:].copy()
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside[1:-1] & ~before), np.flatnonzero(inside[1:-1] & ~after) + 1
    return Slices(raw, start, end, np.searchsorted(offsets, start, "right") - 1)


def _differing(raw: bytes, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which tokens aren't byte for byte the token of number other."""
    length = end - start
    odd = length != length[other]
    buffer = np.frombuffer(raw, np.uint8)
    order = np.argsort(length, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        if len(rows) and length[rows[0]] > 0:
            window = np.lib.stride_tricks.sliding_window_view(buffer, length[rows[0]])
            mine = rows[(other[rows] != rows) & ~odd[rows]]
            for part in np.array_split(mine, max(1, len(mine) * int(length[rows[0]]) // CHUNK)):
                odd[part] = (window[start[part]] != window[start[other[part]]]).any(1)
    return odd


def grouped(s: Slices, code: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(of, first): the group of each token, and the number of the first token of each group."""
    raw = s.raw
    codes = np.empty(len(s.start), np.uint64)
    for i in range(0, len(codes), _RUN):
        part = slice(i, i + _RUN)
        codes[part] = [code(raw[a:b]) for a, b in zip(s.start[part].tolist(), s.end[part].tolist(), strict=True)]
    _, first, of = np.unique(codes, return_index=True, return_inverse=True)
    odd = np.flatnonzero(_differing(raw, s.start, s.end, first[of]))
    if len(odd):
        own: dict[tuple[int, bytes], int] = {}
        more = []
        for i in odd.tolist():
            key = (int(of[i]), raw[s.start[i] : s.end[i]])
            if key not in own:
                own[key] = len(first) + len(more)
                more.append(i)
            of[i] = own[key]
        first = np.r_[first, more]
    return of, first


def words(s: Slices, numbers: np.ndarray) -> pa.Array:
    """The tokens of these numbers as strings."""
    return pa.array([s.raw[a:b] for a, b in zip(s.start[numbers].tolist(), s.end[numbers].tolist(), strict=True)], pa.binary()).cast(pa.string())


def sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, in order, and for each array of values the sums of the rows of a key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)
