"""Words and their hashes, as the text operators share them.

A word is a run of bytes other than space and 0x09-0x0D; working on UTF-8 bytes cuts at
the same places as working on characters, as both sets of separators are ASCII.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(20_11).integers(0, 1 << 64, 256, np.uint64)
_BLOCK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


@cache
def _powers(size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _ODD)]))


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(where words start, their 64-bit polynomial hashes)."""
    raw = np.frombuffer(data, np.uint8)
    gap = _IS_SEPARATOR[raw]
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    sizes = np.diff(np.append(starts, len(raw)))
    place = np.arange(len(raw) - starts[0], dtype=np.int32) - np.repeat((starts - starts[0]).astype(np.int32), sizes)
    value = _BYTES[raw[starts[0]:]] * _powers(1 << int(sizes.max()).bit_length())[place]
    value[gap[starts[0]:]] = 0
    return starts, mix(np.add.reduceat(value, starts - starts[0]))


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """The hashes of each text's words, in order; none for null.

    Texts are read in blocks of about a megabyte that end between words, so memory does not
    grow with a text (but for its hashes and its longest word).
    """
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        starts, hashes = _hashes(b" ".join([t for _, t in held]))
        ends = np.cumsum([len(t) + 1 for _, t in held])
        for (i, _), part in zip(held, np.split(hashes, np.searchsorted(starts, ends)[:-1])):
            out[i] = np.concatenate([out[i], part]) if len(out[i]) else part
        held.clear()

    for i, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = _SEPARATOR.search(text, at + _BLOCK) if len(text) - at > _BLOCK else None
            stop = end.start() if end else len(text)
            held.append((i, text[at:stop]))
            size += stop - at
            at = stop
            if size >= _BLOCK:
                flush()
                size = 0
    flush()
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int, seed: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """One 64-bit hash per run of ``width`` consecutive words, or per run that starts at ``at``."""
    count = max(len(hashes) - width + 1, 0) if at is None else len(at)
    out = np.full(count, np.uint64(width + 1000 * seed), np.uint64)
    factor, power = int(_ODD) + 2 * seed, 1
    for i in range(width):
        power = power * factor % (1 << 64)
        out += (hashes[i:i + count] if at is None else hashes[at + i]) * np.uint64(power)
    return mix(out)
