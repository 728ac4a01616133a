"""Removal of repeated byte strings by a distributed suffix sort.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a
smaller id. Only suffixes that can repeat are sorted: every window of SPAN bytes chooses
an anchor (see anchors.py), and an anchor matters if its string occurs in two documents.
A block of documents, about BLOCK bytes of text, sorts the suffixes of its anchors, up to SPAN bytes long, with the
bytes before them, keeps equal ones once with their least document id, and sends them as
front-coded sorted runs to ranges of the suffix order, cut at the first GRAM bytes of
sampled suffixes, one for every RANGE bytes of text. A range merges its runs with a
loser tree whose nodes hold the length of the prefix known to be common with the last
suffix put out, so known prefixes are never compared again. The common prefixes of
neighbours give the groups of equal windows and their least document ids; the blocks get
those back and mark what they remove.

Cases: null and empty texts have no bytes; texts under SPAN bytes keep all; a null id
neither loses bytes nor takes them from others; rows that share an id do not take from
each other; equal texts lose all but the first; very long texts are cut at no place; an
empty table gives an empty result; other columns pass through repeated_removed() unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.anchors import GRAM, SPAN, anchors, chunks
from lacuna.llm.common import mix64, partitions, pieces, staged, unused

#: Bytes before an anchor that a window can have; anchors a block adds to the sample; anchors in the sample.
BEFORE, SAMPLED, SPLITTERS_FROM = SPAN - GRAM, 64, 4096
#: Bytes of text in a block, and for which there is one range of suffixes.
BLOCK, RANGE = 4_000_000, 16_000_000
#: Entries of a group that are compared in pairs; larger groups look their windows up.
PAIRWISE, WAITING, NOBODY = 6, 20_000, np.iinfo(np.int64).max
ZIP = pa.Codec("zstd", compression_level=1)
WIDTH = SPAN + 1 + BEFORE + 1  # suffix, its length, bytes before it reversed, their number + 1


class Block:
    """Documents of one block and their anchors."""

    def __init__(self, ids: list[int | None], texts: list[bytes]):
        order = sorted((i for i, d in enumerate(ids) if d is not None), key=lambda i: ids[i])
        self.rows = order
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        size = np.array([len(x) for x in self.texts], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.raw = np.frombuffer(b"".join(self.texts), np.uint8)  # texts are slices of it from here on
        at, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo, some in chunks(self.texts):
            hi = lo + len(some)
            base = self.starts[lo]
            a, k = anchors(self.raw[base : self.ends[hi - 1]], self.ends[lo:hi] - base)
            at.append(a + base)
            keys.append(k)
        self.at, self.keys = np.concatenate(at), np.concatenate(keys)
        self.doc = np.searchsorted(self.ends, self.at, "right")
        del self.texts

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in ascending order, and whether two documents of the block have them."""
        order = np.argsort(self.keys, kind="stable")
        keys, ids = self.keys[order], self.ids[self.doc[order]]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(keys))[: len(first)] - 1
        return keys[first], ids[first] != ids[last]  # ids ascend within a key, as the sort is stable

    def narrow(self, elsewhere: np.ndarray) -> None:
        """Keeps the anchors whose strings two documents have, here or elsewhere (keys in any order)."""
        keys, twice = self.shared()
        keep = np.union1d(keys[twice], elsewhere)
        at = np.minimum(np.searchsorted(keep, self.keys), max(len(keep) - 1, 0))
        found = keep[at] == self.keys if len(keep) else np.zeros(len(self.keys), bool)
        self.at, self.keys, self.doc = self.at[found], self.keys[found], self.doc[found]

    def sort(self) -> None:
        """The distinct suffixes with what stands before them, sorted, with least ids; which one each anchor has."""
        n = len(self.at)
        table = np.zeros((n, WIDTH), np.uint8)
        here = np.minimum(self.ends[self.doc] - self.at, SPAN)
        ago = np.minimum(self.at - self.starts[self.doc], BEFORE)
        padded = np.concatenate([np.zeros(BEFORE, np.uint8), self.raw, np.zeros(SPAN, np.uint8)])
        for i in range(SPAN):
            table[:, i] = np.where(i < here, padded[self.at + BEFORE + i], 0)
        table[:, SPAN] = here
        for i in range(BEFORE):
            table[:, SPAN + 1 + i] = np.where(i < ago, padded[self.at + BEFORE - 1 - i], 0)
        table[:, -1] = ago + 1
        order = np.argsort(table.reshape(-1).view(f"S{WIDTH}"), kind="stable") if n else np.zeros(0, np.int64)
        rows = table[order]
        new = np.ones(n, bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        first = np.flatnonzero(new)
        self.entry = np.zeros(n, np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.table = rows[first]
        self.least = np.minimum.reduceat(self.ids[self.doc[order]], first) if n else np.zeros(0, np.int64)
        self.here, self.ago = here, ago

    def covered(self, entry: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether each byte goes. The arguments are windows of entries (lo to hi bytes before the anchor) that documents above `least` lose."""
        change = np.zeros(len(self.raw) + 1, np.int32)
        low, high = np.maximum(SPAN - self.here, 0), self.ago
        own = (self.ids[self.doc] > self.least[self.entry]) & (low <= high)
        np.add.at(change, (self.at - high)[own], 1)
        np.add.at(change, (self.at - low + SPAN)[own], -1)
        order = np.argsort(entry, kind="stable")
        entry, lo, hi, least = entry[order], lo[order], hi[order], least[order]
        a, b = np.searchsorted(entry, self.entry, "left"), np.searchsorted(entry, self.entry, "right")
        which = np.repeat(np.arange(len(a)), b - a)
        told = np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[which]
        goes = self.ids[self.doc[which]] > least[told]
        which, told = which[goes], told[goes]
        np.add.at(change, self.at[which] - hi[told], 1)
        np.add.at(change, self.at[which] - lo[told] + SPAN, -1)
        return np.cumsum(change[:-1], dtype=np.int32) > 0


def encoded(texts: pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of texts, none for null."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def front_coded(table: np.ndarray, least: np.ndarray, first: int) -> bytes:
    """A sorted run: suffixes without the prefix they share with the one before."""
    n = len(table)
    here, ago = table[:, SPAN].astype(np.int64), table[:, -1].astype(np.int64) - 1
    same = np.zeros(n, np.int64)
    differs = table[1:, :SPAN] != table[:-1, :SPAN]
    same[1:] = np.where(differs.any(1), differs.argmax(1), SPAN)
    same[1:] = np.minimum(same[1:], np.minimum(here[1:], here[:-1]))
    place = np.arange(SPAN)
    rest = table[:, :SPAN][(place >= same[:, None]) & (place < here[:, None])]
    before = table[:, SPAN + 1 : -1][np.arange(BEFORE) < ago[:, None]]
    head = np.array([n, first, len(rest)], np.int64)
    out = b"".join([head.tobytes(), least.astype(np.int64).tobytes(), *(x.astype(np.uint8).tobytes() for x in (same, here, ago)), rest.tobytes(), before.tobytes()])
    return len(out).to_bytes(8, "little") + ZIP.compress(out, asbytes=True)


def run_of(raw: bytes, block: int) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """(prefix shared with the entry before, suffix, bytes before it reversed, least id, block, entry)."""
    raw = ZIP.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)
    n, first, size = np.frombuffer(raw, np.int64, 3).tolist()
    least = np.frombuffer(raw, np.int64, n, 24).tolist()
    at = 24 + 8 * n
    same, here, ago = (raw[at + i * n : at + (i + 1) * n] for i in range(3))
    at += 3 * n
    ahead, suffix = at + size, b""
    for i in range(n):
        k = here[i] - same[i]
        suffix = suffix[: same[i]] + raw[at : at + k]
        at += k
        yield same[i], suffix, raw[ahead : ahead + ago[i]], least[i], block, first + i
        ahead += ago[i]


def merged(runs: list[Iterator]) -> Iterator[tuple]:
    """Entries of all runs in the order of their suffixes, each with the prefix it shares with the one before.

    A loser tree: `known` is what a run's head shares with the last entry put out.
    Of two heads the one that shares more is less; only where they share alike are bytes
    compared, from there on.
    """
    count = len(runs)
    if not count:
        return
    size = 1
    while size < count:
        size *= 2
    head: list = [None] * size
    known = [0] * size
    for i, run in enumerate(runs):
        head[i] = next(run, None)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix is then the one it shares with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        i, j = known[a], known[b]
        if i > j:
            return a, b
        if j > i:
            return b, a
        s, t = x[1], y[1]
        most = min(len(s), len(t))
        if s[i:] == t[i:]:
            known[b] = most
            return a, b
        while i < most and s[i] == t[i]:
            i += 1
        if i == most:
            won = len(s) <= len(t)
        else:
            won = s[i] < t[i]
        if won:
            known[b] = i
            return a, b
        known[a] = i
        return b, a

    tree = [0] * (2 * size)
    winner = list(range(size))
    level = size
    while level > 1:  # first round: every head is compared from its first byte
        nxt = []
        for i in range(0, level, 2):
            w, loser = play(winner[i], winner[i + 1])
            tree[level // 2 + i // 2] = loser
            nxt.append(w)
        winner, level = nxt, level // 2
    top = winner[0]
    while head[top] is not None:
        out = head[top]
        yield known[top], out
        nxt = head[top] = next(runs[top], None) if top < count else None
        known[top] = nxt[0] if nxt is not None else 0
        at = (top + size) // 2
        while at >= 1:
            w, tree[at] = play(top, tree[at])
            top = w
            at //= 2


def few_windows(group: list[tuple]) -> Iterator[tuple[int, int, int, int, int]]:
    """(block, entry, lo, hi, least id) for the windows of a group's entries that an entry elsewhere has too, with a smaller id.

    group: (prefix shared with the one before, entry), in the order of the suffixes. Compares all pairs.
    """
    for i, (_, x) in enumerate(group):
        same = SPAN
        for shared, y in group[i + 1 :]:
            same = min(same, shared)
            if x[3] != y[3]:
                a, b = x[2], y[2]
                high = len(a) if a == b else common(a, b)
                if SPAN - same <= high:
                    z, least = (y, x[3]) if x[3] < y[3] else (x, y[3])
                    yield z[4], z[5], SPAN - same, high, least


def many_windows(groups: list[tuple]) -> Iterator[tuple[int, int, int, int, int]]:
    """As few_windows, for several groups end to end: looks up, for each number of bytes before the anchor, who shares the window."""
    n = len(groups)
    shared = np.array([k for k, _ in groups])
    here = np.array([len(x[1]) for _, x in groups])
    ago = np.array([len(x[2]) for _, x in groups])
    least = np.array([x[3] for _, x in groups], np.int64)
    befores, rank = np.unique(np.array([x[2] + bytes(BEFORE - len(x[2])) + bytes([len(x[2]) + 1]) for _, x in groups], f"S{BEFORE + 1}"), return_inverse=True)
    table = np.frombuffer(befores.tobytes(), np.uint8).reshape(len(befores), BEFORE + 1)
    differs = table[1:, :BEFORE] != table[:-1, :BEFORE]
    alike = np.concatenate([[0], np.where(differs.any(1), differs.argmax(1), BEFORE)])
    best = np.full((n, BEFORE + 2), NOBODY)
    for x in range(BEFORE + 1):
        at = np.flatnonzero((here >= SPAN - x) & (ago >= x))
        if len(at):
            suffix, before = np.cumsum(shared < SPAN - x), np.cumsum(alike < x)[rank]
            _, which = np.unique(suffix[at] * (len(befores) + 1) + before[at], return_inverse=True)
            found = np.full(len(at), NOBODY)
            np.minimum.at(found, which, least[at])
            best[at, x] = found[which]
    best[best >= least[:, None]] = NOBODY
    change = np.ones((n, BEFORE + 2), bool)
    change[:, 1:] = best[:, 1:] != best[:, :-1]
    row, lo = np.nonzero(change)
    hi = np.append(lo[1:], 0) - 1
    told = best[row, lo]
    for i, a, b, m in zip(*(x[told < NOBODY].tolist() for x in (row, lo, hi, told)), strict=True):
        yield groups[i][1][4], groups[i][1][5], a, b, m


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


PACKED = "block int, part int, kind int, data binary"


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table({"block": pa.array(columns[0], pa.int32()), "part": pa.array(columns[1], pa.int32()), "kind": pa.array(columns[2], pa.int32()), "data": pa.array(columns[3], pa.binary())})


def _deal(keys: np.ndarray, n: int) -> np.ndarray:
    return (((mix64(keys) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def repeated_removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept, the bytes of text that stay (binary).

    whole_characters: what is left in kept of characters that were cut goes too. Columns of docs
    with these names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    tasks = partitions(spark)
    blocks = pieces(docs, text, BLOCK, 4 * tasks)
    n, place = max(tasks, -(-blocks * BLOCK // RANGE)), unused(docs, "block")
    names = docs.columns
    salt = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))), F.lit(blocks)).cast("int")
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), salt.alias("block"))

    def block_of(t: pa.Table) -> Block:
        return Block(t.column("doc_id").to_pylist(), encoded(t.column("text")))

    def anchor(key: tuple, t: pa.Table) -> pa.Table:
        b = block_of(t)
        keys, _ = b.shared()
        part = _deal(keys, n)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(n + 1))
        me = key[0].as_py()
        rows = [(me, p, 0, keys[order[cut[p] : cut[p + 1]]].tobytes()) for p in range(n) if cut[p] < cut[p + 1]]
        some = np.argsort(b.keys, kind="stable")[:SAMPLED]
        sample = b"".join(b.raw[i : i + GRAM].tobytes() for i in b.at[some].tolist())
        return _rows([*rows, (me, me % n, 2, sample)])

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        rows = [(b, 0, 2, x) for b, k, x in zip(t.column("block").to_pylist(), kind.tolist(), t.column("data").to_pylist(), strict=True) if k == 2]
        t = t.filter(pa.array(kind == 0))
        of = t.column("block").to_pylist()
        lists = [np.frombuffer(x, np.uint64) for x in t.column("data").to_pylist()]
        if lists:
            every = np.concatenate(lists)
            where = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            order = np.argsort(every, kind="stable")
            sorted_ = every[order]
            same = np.zeros(len(every), bool)
            same[1:] = sorted_[1:] == sorted_[:-1]
            same[:-1] |= same[1:]
            hit = np.zeros(len(every), bool)
            hit[order] = same
            cut = np.searchsorted(where, np.arange(len(lists) + 1))
            for i, b in enumerate(of):
                mine = hit[cut[i] : cut[i + 1]]
                if mine.any():
                    rows.append((b, 0, 1, lists[i][mine].tobytes()))
        return _rows(rows)

    found = staged(dealt.groupBy("block").applyInArrow(anchor, PACKED).groupBy("part").applyInArrow(meet, PACKED), "anchors")
    shared = found.filter("kind = 1").select("block", "part", "kind", "data")
    heads = F.explode(F.transform(F.sequence(F.lit(1), F.length("data"), F.lit(GRAM)), lambda i: F.substring(F.col("data"), i, GRAM)))
    sample = found.filter(f"kind = 2 AND length(data) >= {GRAM}").select(heads.alias("s"))
    sample = sorted(bytes(r.s) for r in sample.orderBy(F.xxhash64("s")).limit(SPLITTERS_FROM).collect())
    splitters = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    cuts = np.array(splitters, f"S{GRAM}")

    def narrowed(b: Block, more: pa.Table) -> Block:
        kind = more.column("kind").to_pylist()
        there = [np.frombuffer(x, np.uint64) for k, x in zip(kind, more.column("data").to_pylist(), strict=True) if k == 1]
        b.narrow(np.unique(np.concatenate(there)) if there else np.zeros(0, np.uint64))
        b.sort()
        return b

    def sort(key: tuple, t: pa.Table, more: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows([])
        b = narrowed(block_of(t), more)
        head = np.ascontiguousarray(b.table[:, :GRAM]).reshape(-1).view(f"S{GRAM}")  # entries that share GRAM bytes share a range
        part = np.searchsorted(cuts, head, "right")
        cut = np.searchsorted(part, np.arange(len(cuts) + 2))
        me = t.column("block")[0].as_py()
        return _rows([(me, p, 0, front_coded(b.table[cut[p] : cut[p + 1]], b.least[cut[p] : cut[p + 1]], int(cut[p]))) for p in range(len(cuts) + 1) if cut[p] < cut[p + 1]])

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        runs = [run_of(x, b) for b, x in zip(t.column("block").to_pylist(), t.column("data").to_pylist(), strict=True)]
        out: dict[int, list] = {}

        def settle(found):
            for b, *rest in found:
                out.setdefault(b, []).append(rest)
                if len(out[b]) >= 10_000:
                    packed.append((b, 0, 3, np.array(out.pop(b), np.int64).tobytes()))

        group: list = []
        waiting: list = []
        packed: list = []
        for same, entry in merged(runs):
            if same < GRAM and group:
                if 1 < len(group) <= PAIRWISE:
                    settle(few_windows(group))
                elif len(group) > PAIRWISE:
                    waiting += group
                    if len(waiting) > WAITING:
                        settle(many_windows(waiting))
                        waiting = []
                group = []
            group.append((same, entry))
        if len(group) > 1:
            waiting += group
        if waiting:
            settle(many_windows(waiting))
        return _rows(packed + [(b, 0, 3, np.array(x, np.int64).tobytes()) for b, x in out.items()])

    runs = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(sort, PACKED)
    told = staged(runs.groupBy("part").applyInArrow(merge, PACKED), "repeats")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_bytes long, n_removed long, n_spans long, kept binary"
    whole = docs.withColumn(place, salt)
    id_at, text_at = names.index(doc_id), names.index(text)

    def mark(key: tuple, t: pa.Table, more: pa.Table) -> pa.Table:
        ids = [None if x is None else int(x) for x in t.column(id_at).to_pylist()]
        kept = encoded(t.column(text_at))
        size = [len(x) for x in kept]
        gone, spans = [0] * len(ids), [0] * len(ids)
        if ids:
            b = narrowed(Block(ids, kept), more)
            parts = [np.frombuffer(x, np.int64).reshape(-1, 4) for k, x in zip(more.column("kind").to_pylist(), more.column("data").to_pylist(), strict=True) if k == 3]
            told_ = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
            goes = b.covered(told_[:, 0], told_[:, 1], told_[:, 2], told_[:, 3])
            for j, i in enumerate(b.rows):
                mine = goes[b.starts[j] : b.ends[j]]
                k = int(mine.sum())
                if k:
                    gone[i], spans[i] = k, int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum())
                    kept[i] = b.raw[b.starts[j] : b.ends[j]][~mine].tobytes()
                    if whole_characters:
                        kept[i] = kept[i].decode("utf-8", "ignore").encode()
        columns = [t.column(i) for i in range(len(names))]
        return pa.Table.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    replies = shared.unionByName(told)
    return whole.groupBy(place).cogroup(replies.groupBy(F.col("block").alias(place))).applyInArrow(mark, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with what stays of each text; bytes of a character that was cut go with it."""
    names = docs.columns
    hidden = {c: unused(docs, c) for c in names if c.lower() in ("n_bytes", "n_removed", "n_spans", "kept")}
    hidden = {c: f"{x}{i}" for i, (c, x) in enumerate(hidden.items())}
    out = repeated_removed(docs.withColumnsRenamed(hidden), whole_characters=True)
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in names])


ORACLE = """
WITH t AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents),
b AS (SELECT doc_id, unnest(l) AS y, unnest(range(0, len(l))) AS i FROM t),
x AS (SELECT doc_id, i, y, CASE WHEN count(*) OVER w = 50 THEN string_agg(y, '') OVER w END AS x FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
f AS (SELECT doc_id, i, y, x IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY x) AS starts FROM x),
c AS (SELECT doc_id, i, y, max(starts::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
d AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
e AS (SELECT doc_id, count(*) AS n, sum(gone::INT) AS n_removed, sum(opens::INT) AS n_spans, coalesce(string_agg(y, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM d GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents LEFT JOIN e ON documents.doc_id = e.doc_id
"""
