"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens of a block of texts are laid out as one linked list of symbols.
An index maps the rank of each adjacent pair to all its positions. Ranks are applied in
ascending order, each to all its positions at once, and only the lists of the pairs that
appear next to a merge are updated. Texts are then looked up word by word.

Cases: null and empty text give no ids; a special token's string in a text is that token,
as the vocabulary file says; very long texts and very long words need memory in
proportion to their length only; repeated rows give repeated rows; an empty table gives
an empty result; columns beside the named ones are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lacuna.llm.common import spread

# Fixed value: the pre-token pattern of the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words whose ids a Python worker holds before it drops all but the first FIRST_WORDS, and bytes of text in a block.
KEPT_WORDS, FIRST_WORDS, BLOCK_BYTES = 250_000, 50_000, 6_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


class _Numbered(dict):
    """Numbers its keys in the order of their first look-up."""

    def __missing__(self, key):
        self[key] = out = len(self)
        return out


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = self.left.astype(np.int64) * self.size + self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.split = regex.compile(PATTERN)
        self.special_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.names = [str(i) for i in range(self.size)]
        self.forget()

    def forget(self) -> None:
        self.words, self.flat, self.ends, self.text = _Numbered(), np.zeros(0, np.int32), np.zeros(0, np.int64), []

    def trim(self) -> None:
        """Keeps the words met first, among which are the frequent ones."""
        self.words = _Numbered(islice(self.words.items(), FIRST_WORDS))
        self.ends = self.ends[:FIRST_WORDS].copy()
        self.flat = self.flat[: int(self.ends[-1])].copy()
        del self.text[FIRST_WORDS:]

    # -- the pair occurrence index

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where it has none."""
        want = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.by_key[at], -1) if len(self.keys) else np.full(len(want), -1)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, end to end, and where each word's ids end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(sizes)
        n = int(stop[-1]) if len(words) else 0
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[stop - 1] = -1
        before[(stop - sizes)[sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[after[at]])
            found = rank >= 0
            at, rank = at[found], rank[found]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            lo = 0
            for hi in [*cut.tolist(), len(at)]:
                r = int(rank[lo])
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(active, r)
                lo = hi

        add(np.flatnonzero(after >= 0))
        fresh = np.zeros(n, bool)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[r], self.right[r]
            nxt = after[at]
            live = (symbol[at] == a) & (nxt >= 0)
            live &= symbol[nxt] == b
            at = at[live]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # in a run of one symbol every other pair merges, from the left
                at = np.sort(at)
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(chained, 0, place))
                at = at[(place - run) % 2 == 0]
            gone = after[at]
            nxt = after[gone]
            symbol[at], symbol[gone], after[at] = self.made[r], -1, nxt
            has = nxt >= 0
            before[nxt[has]] = at[has]
            prv = before[at]
            fresh[at] = True
            prv = prv[prv >= 0]
            prv = prv[~fresh[prv]]
            fresh[at] = False
            add(np.concatenate([prv, at[has]]))
        live = symbol >= 0
        return symbol[live], np.concatenate([[0], np.cumsum(live)])[stop]

    # -- texts

    def numbered(self, text: str) -> list[int]:
        """Numbers of a text's words; a special token t is -1 - t."""
        if self.special_split and any(x in text for x in self.special):
            out: list[int] = []
            for part in self.special_split.split(text):
                out += [-1 - self.special[part]] if part in self.special else map(self.words.__getitem__, self.split.findall(part))
            return out
        return list(map(self.words.__getitem__, self.split.findall(text)))

    def learn(self) -> None:
        """Encodes the words numbered since the last call."""
        known = len(self.ends)
        if known == len(self.words):
            return
        new = list(self.words)[known:]
        flat, ends = self.merged([w.encode() for w in new])
        names = self.names
        ids = flat.tolist()
        lo = 0
        for hi in ends.tolist():
            self.text.append(",".join([names[i] for i in ids[lo:hi]]))
            lo = hi
        base = len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, ends + base])

    def ids(self, words: list[int]) -> np.ndarray:
        """Ids of one text from its words' numbers."""
        if not words:
            return np.zeros(0, np.int32)
        w = np.array(words, np.int64)
        plain = w >= 0
        if not plain.all():
            cut = np.flatnonzero(~plain)
            parts, lo = [], 0
            for i in cut.tolist():
                parts += [self.ids(words[lo:i]), np.array([-1 - words[i]], np.int32)]
                lo = i + 1
            return np.concatenate([*parts, self.ids(words[lo:])])
        end = self.ends[w]
        size = end - np.where(w > 0, self.ends[w - 1], 0)
        total = np.cumsum(size)
        return self.flat[np.arange(total[-1]) + np.repeat(end - total, size)]

    def decimal(self, words: list[int]) -> str:
        """The decimal ids of one text, joined by commas."""
        text = self.text
        return ",".join([text[i] if i >= 0 else self.names[-1 - i] for i in words])

    def decode(self, ids: Iterable[int]) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")

    def blocks(self, texts: Iterable[str | None]) -> Iterator[list[list[int]]]:
        """The texts' words, numbered and learnt, in blocks of about BLOCK_BYTES."""
        block, held = [], 0
        for text in texts:
            if len(self.words) > KEPT_WORDS and not block:
                self.trim()
            block.append(self.numbered(text or ""))
            held += len(text or "")
            if held >= BLOCK_BYTES:
                self.learn()
                yield block
                block, held = [], 0
        if block:
            self.learn()
            yield block


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column ids: array<int> of its whole texts' ids."""
    at = df.columns.index(text)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema if f.name != ids)}, `{ids}` array<int>"
    keep = [i for i, c in enumerate(df.columns) if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec(path)
        for batch in batches:
            lists = [tok.ids(w) for block in tok.blocks(batch.column(at).to_pylist()) for w in block]
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            made = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *lists]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), made], [*(df_names[i] for i in keep), ids])

    df_names = df.columns
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the column text, decoded from ids (null where they are null)."""
    at, names = df.columns.index(ids), df.columns
    keep = [i for i, c in enumerate(names) if c != text]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema if f.name != text)}, `{text}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec(path)
        for batch in batches:
            made = pa.array([None if x is None else tok.decode(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), made], [*(names[i] for i in keep), text])

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec(path)
        for batch in batches:
            n, coded, plain = [], [], []
            for block in tok.blocks(x.as_py() for x in batch.column(1)):
                for words in block:
                    ids = tok.ids(words)
                    n.append(len(ids))
                    coded.append(hashlib.sha256(tok.decimal(words).encode()).hexdigest())
                    plain.append(hashlib.sha256(tok.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
