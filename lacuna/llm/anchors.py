"""Anchors: positions that equal byte strings choose alike, for blocks of texts at once.

Of the windows of SPAN bytes each chooses the GRAM-byte strings inside it whose hash is
least. Equal windows choose equal strings at equal places, wherever they stand.
"""

from __future__ import annotations

import numpy as np

from lacuna.llm.common import mix64

#: Bytes of a match, of an anchor's string, and bytes handled at once.
SPAN, GRAM, CHUNK = 50, 20, 400_000

_B = 0xD1342543DE82EF95  # any odd number
_BYTE = mix64(np.random.default_rng(20260303).integers(1, 1 << 63, 256, dtype=np.uint64))


def _after(a: np.ndarray, la: int, b: np.ndarray, lb: int) -> np.ndarray:
    """Hashes of la + lb bytes from those of la and of lb."""
    out = a * np.uint64(pow(_B, lb, 1 << 64))
    out[: len(a) - la] += b[la:]
    return out


def _ahead(a: np.ndarray, width: int, best) -> np.ndarray:
    """best over a[i : i + width] for each i (shorter at the end)."""
    out, have = a.copy(), 1
    while have < width:
        step = min(have, width - have)
        best(out[:-step], out[step:], out=out[:-step]) if len(out) > step else None
        have += step
    return out


def anchors(raw: np.ndarray, ends: np.ndarray, gram: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the anchors of texts laid end to end."""
    n = len(raw)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    have, size, parts = _BYTE[raw], 1, {}
    while size <= gram:
        parts[size] = have
        have, size = _after(have, size, have, size), 2 * size
    total, done = None, 0
    for size in sorted(parts, reverse=True):
        if gram & size:
            total = parts[size] if total is None else _after(total, done, parts[size], size)
            done += size
    key = mix64(total)
    short = (key >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    width = span - gram + 1
    least = _ahead(short, width, np.minimum)
    for end, size in zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True):
        least[max(end - span + 1, end - size) : end] = 0
    most = _ahead(least[::-1], width, np.maximum)[::-1]
    at = np.flatnonzero((short == most) & (most > 0))
    return at, key[at]


def chunks(texts: list[bytes]):
    """(index of the first text, texts) of about CHUNK bytes each."""
    lo, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > CHUNK:
            yield lo, texts[lo:i]
            lo, held = i, 0
        held += len(x)
    if lo < len(texts):
        yield lo, texts[lo:]
