"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram of lower-cased letters, with one
mark for any run of other characters, binds its three letters' vectors, permuted by their
place. A text bundles (adds) the vectors of its trigrams; a language's prototype bundles
the texts that carry its label. A text gets the language whose prototype has the largest
cosine with it. Bundling is a sum, so each task adds up its own texts and sends one vector
a language; what reaches the driver is languages x DIMENSIONS numbers at any input size.

Cases: null text, text without a letter and a model without languages give `und` and 0;
ties go to the first language by code point; repeated rows give repeated rows; a null id
is never learnt from and not held out; whole texts count, however long; an empty table
gives an empty result; columns beside doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import spread

DIMENSIONS, SEED, UNKNOWN = 1024, 20260101, "und"
#: Trigram vectors that a worker keeps; texts bundled by one matrix product.
KEPT, TOGETHER = 40_000, 48


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 for all but letters."""
    out = np.zeros(0x110000, np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text, packed in 64 bits, and their counts."""
    x = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    x = np.concatenate([[np.uint64(0)], x, [np.uint64(0)]])
    x = x[np.r_[True, (x[1:] != 0) | (x[:-1] != 0)]]
    if len(x) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique((x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:], return_counts=True)


class Vectors:
    """Vectors of the trigrams met so far."""

    def __init__(self):
        self.letter: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.known, self.rows, self.made = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.int8)

    def of_letters(self, codes: np.ndarray) -> np.ndarray:
        for c in set(codes.tolist()) - self.letter.keys():
            self.letter[c] = np.random.default_rng([SEED, c]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
        return np.stack([self.letter[c] for c in codes.tolist()])

    def bind(self, grams: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << 21) - 1)
        out = np.ones((len(grams), DIMENSIONS), np.int8)
        for place, shift in ((2, 42), (1, 21), (0, 0)):
            distinct, which = np.unique((grams >> np.uint64(shift)) & low, return_inverse=True)
            out *= np.roll(self.of_letters(distinct), place, axis=1)[which]
        return out

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct trigrams."""
        if len(self.known) > KEPT:
            self.forget()
        new = np.setdiff1d(grams, self.known, assume_unique=True)
        if len(new):
            known = np.concatenate([self.known, new])
            self.made = np.concatenate([self.made, self.bind(new)])
            rows = np.concatenate([self.rows, len(self.rows) + np.arange(len(new))])
            order = np.argsort(known)
            self.known, self.rows = known[order], rows[order]
        return self.made[self.rows[np.searchsorted(self.known, grams)]]

    def bundle(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One bundled vector a text."""
        grams, which = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
        weights = np.zeros((len(counted), len(grams)), np.float32)
        text = np.repeat(np.arange(len(counted)), [len(g) for g, _ in counted])
        weights[text, which] = np.concatenate([c for _, c in counted])
        out = np.zeros((len(counted), DIMENSIONS))
        for lo in range(0, len(grams), 2048):
            out += weights[:, lo : lo + 2048] @ self.of(grams[lo : lo + 2048]).astype(np.float32)
        return out


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """Prototype of each language of the labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, counts = Vectors(), {}
        for batch in batches:
            for label, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = counts.setdefault(label, [])
                mine.append(trigrams(x.as_py()))
                if len(mine) >= 512:
                    counts[label] = [merged(mine)]
        for label, mine in counts.items():
            grams, n = merged(mine)
            if len(grams):
                total = np.zeros(DIMENSIONS)
                for lo in range(0, len(grams), 8192):
                    total += n[lo : lo + 8192] @ vectors.bind(grams[lo : lo + 8192]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([label] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS), pa.int32()), pa.array(total, pa.float64())], ["lang", "place", "value"])

    def merged(parts):
        grams, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(which, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)

    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sums = labelled.mapInArrow(run, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    model: dict[str, np.ndarray] = {}
    for row in sums.collect():  # languages x DIMENSIONS numbers
        model.setdefault(row.lang, np.zeros(DIMENSIONS))[row.place] = row.value
    return model


def predict(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the cosine with the best prototype (0 at least)."""
    names = sorted(model)
    prototypes = np.stack([model[x] / max(np.linalg.norm(model[x]), 1e-300) for x in names]) if names else np.zeros((0, DIMENSIONS))
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at, keep = docs.columns.index(text), [docs.columns.index(c) for c in columns]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            best, score, waiting = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, []

            def settle():
                made = vectors.bundle([x for _, x in waiting])
                cosine = made @ prototypes.T / np.maximum(np.linalg.norm(made, axis=1), 1e-300)[:, None]
                for (i, _), row in zip(waiting, cosine, strict=True):
                    k = int(np.argmax(row))
                    best[i], score[i] = names[k], min(1.0, max(0.0, float(row[k])))
                waiting.clear()

            for i, x in enumerate(batch.column(at)):
                counted = trigrams(x.as_py() or "")
                if len(counted[0]) and names:
                    waiting.append((i, counted))
                    if len(waiting) == TOGETHER:
                        settle()
            if waiting:
                settle()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(best, pa.string()), pa.array(score, pa.float64())], [*columns, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame, *columns: str) -> DataFrame:
    """docs (or doc_id and the columns named) with held_out, lang_pred and score, learnt from all that is not held out."""
    rest = F.coalesce(remainder(F.col("doc_id")), F.lit(-1))
    model = learn(spread(docs.select("doc_id", "text", "lang")).filter(F.coalesce(remainder(F.col("doc_id")) != 2, F.lit(False))))
    kept = docs.select("doc_id", "text", *columns)
    return predict(spread(kept), model).withColumn("held_out", rest == 2)
