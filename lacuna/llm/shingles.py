"""Word shingles of texts as sets of 64-bit hashes, for blocks of texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

from lacuna.llm.common import mix64

#: Bytes of text handled at once; words in a shingle; bytes of a word beyond which a library hashes it.
BLOCK_BYTES, WORDS, LONG = 1_000_000, 5, 64

_rng = np.random.default_rng(20260202)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = mix64(_rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_START, _STEP = mix64(_rng.integers(1, 1 << 63, 2, dtype=np.uint64)) | np.uint64(1)
_KEPT_BITS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def blocks(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    block, held = [], 0
    for text in texts:
        raw = (text or "").encode()
        if held + len(raw) > BLOCK_BYTES and block:
            yield block
            block, held = [], 0
        block.append(raw)
        held += len(raw) + 1
    if block:
        yield block


def word_hashes(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z in lower case, and the number of words of each text.

    A word's hash starts from its length and takes in eight bytes after the other, each step
    a bijection of what was taken in, so that no arithmetic of the letters makes two words
    alike; words over LONG bytes get a cryptographic hash.
    """
    raw = b"".join([b" ", b" ".join(block).lower(), b" " * 8])  # of bytes: ASCII letters only
    space = _IS_SPACE[np.frombuffer(raw, np.uint8)]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    size = np.flatnonzero(~space[:-1] & space[1:]) + 1 - starts
    eights = np.ndarray(len(raw) - 7, np.dtype("<u8"), raw, 0, (1,))  # those that start at each byte
    words = mix64(size.astype(np.uint64) * _STEP + _START)
    some, most = np.arange(len(starts)), int(size.max(initial=0))
    for at in range(0, min(most, LONG), 8):
        if at:
            some = some[size[some] > at]
        part = eights[starts[some] + at] & _KEPT_BITS[np.minimum(size[some] - at, 8)]
        words[some] = mix64((words[some] ^ part) * _STEP + _START)
    if most > LONG:
        for i in np.flatnonzero(size > LONG).tolist():
            words[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : starts[i] + size[i]], digest_size=8).digest(), "little")
    stops = np.cumsum([len(x) + 1 for x in block]) + 1
    upto = np.searchsorted(starts, stops)
    return words, np.diff(upto, prepend=0)


def sets(block: list[bytes], words_in: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, in ascending order within each text, and each text's number of them.

    A text with fewer words than a shingle has its whole sequence as one; no words, none.
    """
    words, n = word_hashes(block)
    first = np.cumsum(n) - n
    count = np.where(n >= words_in, n - words_in + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n, words_in)[text]
    out = size.astype(np.uint64) * _PLACE[words_in]
    padded = np.concatenate([words, np.zeros(words_in, np.uint64)])
    for i in range(words_in):
        part = padded[at + i] * _PLACE[i]
        out += part if i == 0 else np.where(size > i, part, np.uint64(0))
    out = mix64(out)
    order = np.argsort(out)
    order = order[np.argsort(text[order], kind="stable")]
    out, text = out[order], text[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[new], np.bincount(text[new], minlength=len(n))
