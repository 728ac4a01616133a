"""Cross-entropy difference of documents under a target and a background bigram model.

Both models have one vocabulary, the words that the corpus has LEAST times at least, with
one sign for all others, and one form:
P(w | h) = L c(h, w) / c(h) + (1 - L) (c(w) + A) / (N + A V), without the first term
where c(h) is 0. A document is its words between a start and an end sign. The target
model counts the target documents, the background model all; either leaves out what the
document to be scored has itself counted in it, so that no document is judged by a copy of
its own words, and one whose text the corpus holds twice stands out by a low background
loss. A document's score is its loss per token under the target model less that under the
background model: low scores look like the target.

Documents are dealt into blocks of about BLOCK bytes, whatever the size of the corpus. A
block sends its distinct words, then its distinct bigrams, with their counts to the hash
range they belong to; a range for every RANGE bytes of text. Ranges add up and send back
only the totals that differ from the block's own. Nothing grows on the driver: it gets
five numbers a range. Counts cover every document, whole.

Cases: null and empty texts and texts without words have no tokens and null losses; a
null id is scored, and is no target; rows that share a target's id are all targets;
without target documents the target model is uniform; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import shingles
from lacuna.llm.common import mix64, partitions, pieces, staged

#: Least count of a word of the vocabulary; weight of the bigram; added to counts of words.
LEAST, L, A = 2, 0.7, 0.5
#: Bytes of text in a block, and for which there is one hash range.
BLOCK, RANGE = 8_000_000, 16_000_000
START, END, OTHER = (np.uint64(x) for x in (1, 2, 3))
_FIRST, _SECOND = mix64(np.array([11, 12], np.uint64)) | np.uint64(1)
ZIP = pa.Codec("zstd", compression_level=1)
PACKED = "block int, part int, kind int, data binary"
SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def zipped(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, each of 8-byte numbers, column after column of bytes."""
    table = np.stack([x.astype(np.uint64) for x in arrays])
    planes = np.ascontiguousarray(table.view(np.uint8).reshape(len(arrays), -1, 8).transpose(0, 2, 1))
    return len(arrays[0]).to_bytes(8, "little") + ZIP.compress(planes.tobytes(), asbytes=True)


def unzipped(raw: bytes, count: int) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(ZIP.decompress(raw[8:], 8 * n * count, asbytes=True), np.uint8).reshape(count, 8, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64).reshape(count, n)


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table({"block": pa.array(columns[0], pa.int32()), "part": pa.array(columns[1], pa.int32()), "kind": pa.array(columns[2], pa.int32()), "data": pa.array(columns[3], pa.binary())})


class Counted:
    """Distinct keys of a block in ascending order, with how often all and target documents have them."""

    def __init__(self, keys: np.ndarray, target: np.ndarray):
        self.keys, self.which = np.unique(keys, return_inverse=True)
        self.background = np.bincount(self.which, minlength=len(self.keys))
        self.target = np.bincount(self.which[target], minlength=len(self.keys))

    def dealt(self, block: int, n: int, kind: int) -> list[tuple]:
        part = self.part(n)
        cut = np.searchsorted(part, np.arange(n + 1))
        return [(block, p, kind, zipped(self.keys[a:b], self.background[a:b], self.target[a:b])) for p, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if a < b]

    def part(self, n: int) -> np.ndarray:
        return (((self.keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)

    def told(self, n: int, replies: list[tuple[int, bytes]]) -> None:
        """Takes over the totals that the ranges sent back."""
        first = np.searchsorted(self.part(n), np.arange(n))
        for p, raw in replies:
            at, background, target = unzipped(raw, 3).astype(np.int64)
            self.background[first[p] + at], self.target[first[p] + at] = background, target


class Block:
    """Tokens of a block's documents."""

    def __init__(self, t: pa.Table, more: pa.Table, n: int):
        self.n = n
        self.ids = t.column("doc_id").to_pylist()
        self.block = t.column("block")[0].as_py() if t.num_rows else 0
        kinds = more.column("kind").to_pylist()
        self.sent = list(zip(kinds, more.column("part").to_pylist(), more.column("data").to_pylist(), strict=True))
        wanted = {int.from_bytes(x, "little", signed=True) for k, _, x in self.sent if k == 7}
        words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for block in shingles.blocks(x.as_py() for x in t.column("text")):
            w, c = shingles.word_hashes(block)
            words.append(w)
            counts.append(c)
        words, self.size = np.concatenate(words), np.concatenate(counts)
        ends = np.cumsum(self.size)
        full = self.size > 0
        self.word = np.insert(words, ends[full], END)  # END behind the words of every document that has some
        self.doc = np.repeat(np.arange(len(self.size)), self.size + full)
        self.is_target = np.array([x in wanted for x in self.ids], bool)
        self.target = self.is_target[self.doc]
        self.starts = np.concatenate([[True], self.doc[1:] != self.doc[:-1]]) if len(self.doc) else np.zeros(0, bool)
        self.words = Counted(np.concatenate([self.word, np.full(int(full.sum()), START)]), np.concatenate([self.target, self.is_target[full]]))

    def own(self, kind: np.ndarray, kinds: int) -> np.ndarray:
        """For each token, how many of its kind its document has."""
        _, which, count = np.unique(self.doc * kinds + kind, return_inverse=True, return_counts=True)
        return count[which]

    def learn_words(self, least: int) -> None:
        self.words.told(self.n, [(p, x) for k, p, x in self.sent if k == 1])
        rare = self.words.background < least
        rare[np.isin(self.words.keys, [START, END])] = False
        self.rare = rare
        self.place = self.words.which[: len(self.word)]
        word = np.where(rare[self.place], OTHER, self.word)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.starts] = START
        self.context = before
        self.pairs = Counted(mix64(before * _FIRST + word * _SECOND), self.target)

    def scores(self, all_words: dict, weight: float, added: float) -> pa.Table:
        self.pairs.told(self.n, [(p, x) for k, p, x in self.sent if k == 2])
        start = np.searchsorted(self.words.keys, START)
        kind = np.where(self.rare[self.place], len(self.words.keys), self.place)
        before, own_word = np.empty_like(self.place), self.own(kind, len(self.words.keys) + 1)
        before[1:], own_before = self.place[:-1], np.empty_like(own_word)
        before[self.starts], own_before[1:] = start, own_word[:-1]
        own_before[self.starts] = 1
        own_pair = self.own(self.pairs.which, len(self.pairs.keys))
        size = np.bincount(self.doc, minlength=len(self.size))[self.doc]
        losses = []
        for known, pair, model, mine in ((self.words.target, self.pairs.target, "target", self.target.astype(np.int64)), (self.words.background, self.pairs.background, "background", 1)):
            single = np.where(self.rare, all_words[f"rare_{model}"], known).astype(np.float64)
            word = (single[self.place] - mine * own_word + added) / (all_words[f"n_{model}"] - mine * size + added * all_words["vocabulary"])
            context = single[before] - mine * own_before
            both = weight * (pair[self.pairs.which] - mine * own_pair) / np.maximum(context, 1) + (1 - weight) * word
            losses.append(np.bincount(self.doc, -np.log(np.where(context > 0, both, word)), len(self.size)))
        tokens = np.bincount(self.doc, minlength=len(self.size))
        none = tokens == 0
        target, background = (x / np.maximum(tokens, 1) for x in losses)
        column = lambda x: pa.array(x, pa.float64(), mask=none)
        return pa.table({"doc_id": pa.array(self.ids, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "loss_target": column(target), "loss_background": column(background), "score": column(target - background)})


def scored(docs: DataFrame, targets: DataFrame, least: int = LEAST, weight: float = L, added: float = A) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score of every row of docs; targets: the target documents' doc_id."""
    tasks = partitions(docs.sparkSession)
    blocks = pieces(docs, "text", BLOCK, 2 * tasks)
    n = max(tasks, -(-blocks * BLOCK // RANGE))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.col("text"), F.lit(""))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", salt(key).alias("block"))
    eight = F.unhex(F.concat(*[F.substring(F.lpad(F.hex(F.col("doc_id")), 16, "0"), i, 2) for i in range(15, 0, -2)]))
    ids = targets.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    marks = ids.select(salt(F.col("doc_id").cast("string")).alias("block"), F.lit(0).alias("part"), F.lit(7).alias("kind"), eight.alias("data"))

    def meet(kind: int):
        def run(key: tuple, t: pa.Table) -> pa.Table:
            of, lists = t.column("block").to_pylist(), [unzipped(x, 3) for x in t.column("data").to_pylist()]
            keys = np.concatenate([x[0] for x in lists])
            distinct, which = np.unique(keys, return_inverse=True)
            own = [np.concatenate([x[i] for x in lists]).astype(np.int64) for i in (1, 2)]
            total = [np.bincount(which, x, len(distinct)).astype(np.int64) for x in own]
            differs = (total[0][which] != own[0]) | (total[1][which] != own[1])
            rows, at = [], 0
            me = key[0].as_py()
            for b, x in zip(of, lists, strict=True):
                some = np.flatnonzero(differs[at : at + x.shape[1]])
                if len(some):
                    mine = which[at + some]
                    rows.append((b, me, kind, zipped(some, total[0][mine], total[1][mine])))
                at += x.shape[1]
            if kind == 1:
                counted = distinct != START
                rare = counted & (total[0] < least) & (distinct != END)
                sums = [(counted & ~rare).sum(), total[0][counted].sum(), total[1][counted].sum(), total[0][rare].sum(), total[1][rare].sum()]
                rows.append((-1, me, 9, np.array(sums, np.int64).tobytes()))
            return _rows(rows)

        return run

    def count_words(key: tuple, t: pa.Table, more: pa.Table) -> pa.Table:
        return _rows(Block(t, more, n).words.dealt(t.column("block")[0].as_py(), n, 1) if t.num_rows else [])

    def count_pairs(key: tuple, t: pa.Table, more: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows([])
        b = Block(t, more, n)
        b.learn_words(least)
        return _rows(b.pairs.dealt(b.block, n, 2))

    def dealt_with(side: DataFrame, run, schema: str) -> DataFrame:
        return dealt.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(run, schema)

    words = staged(dealt_with(marks, count_words, PACKED).groupBy("part").applyInArrow(meet(1), PACKED), "words")
    sums = np.zeros(5, np.int64)
    for row in words.filter("kind = 9").select("data").collect():  # one row a range
        sums += np.frombuffer(row.data, np.int64)
    vocabulary, n_background, n_target, rare_background, rare_target = sums.tolist()
    all_words = {"vocabulary": vocabulary + 1, "n_background": n_background, "n_target": n_target, "rare_background": rare_background, "rare_target": rare_target}
    side = marks.unionByName(words.filter("kind = 1"))
    pairs = staged(dealt_with(side, count_pairs, PACKED).groupBy("part").applyInArrow(meet(2), PACKED), "pairs")

    def score(key: tuple, t: pa.Table, more: pa.Table) -> pa.Table:
        b = Block(t, more, n)
        b.learn_words(least)
        return b.scores(all_words, weight, added)

    return dealt_with(side.unionByName(pairs), score, SCORES)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS target,
         list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
raw AS (SELECT doc_id, target, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM t),
v AS (SELECT w FROM raw GROUP BY w HAVING count(*) >= 2),
k AS (
  SELECT doc_id, target, i, CASE WHEN v.w IS NULL THEN ' other' ELSE raw.w END AS w FROM raw LEFT JOIN v ON raw.w = v.w
  UNION ALL SELECT doc_id, target, len(w) + 1, ' end' FROM t WHERE len(w) > 0),
h AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), ' start') AS h FROM k),
p AS (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS ow, count(*) OVER (PARTITION BY doc_id, h, w) AS o2, count(*) OVER (PARTITION BY doc_id, h) AS oh, count(*) OVER (PARTITION BY doc_id) AS od, target::INT AS y FROM h),
one AS (SELECT w, count(*) AS b, sum(y) AS t FROM p GROUP BY w),
two AS (SELECT h, w, count(*) AS b, sum(y) AS t FROM p GROUP BY h, w),
ctx AS (SELECT h, count(*) AS b, sum(y) AS t FROM p GROUP BY h),
n AS (SELECT count(*) AS b, sum(y) AS t, (SELECT count(*) + 2 FROM v) AS size FROM p),
s AS (
  SELECT p.doc_id, (one.t - y * ow + 0.5) / (n.t - y * od + 0.5 * n.size) AS t1, (one.b - ow + 0.5) / (n.b - od + 0.5 * n.size) AS b1, two.t - y * o2 AS t2, two.b - o2 AS b2, ctx.t - y * oh AS t0, ctx.b - oh AS b0
  FROM p JOIN one ON p.w = one.w JOIN two ON p.h = two.h AND p.w = two.w JOIN ctx ON p.h = ctx.h CROSS JOIN n),
l AS (
  SELECT doc_id, count(*) AS n, avg(-ln(CASE WHEN t0 > 0 THEN 0.7 * t2 / t0 + 0.3 * t1 ELSE t1 END)) AS t, avg(-ln(CASE WHEN b0 > 0 THEN 0.7 * b2 / b0 + 0.3 * b1 ELSE b1 END)) AS b FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(l.n, 0)::BIGINT AS n_tokens, round(l.t, 6) AS loss_target, round(l.b, 6) AS loss_background, round(l.t - l.b, 6) + 0.0 AS score
FROM t LEFT JOIN l ON t.doc_id = l.doc_id
"""
