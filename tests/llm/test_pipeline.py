"""The pipeline, and language ID, against plain Python."""

import collections
import functools
import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import language, mixing
from tests.llm.helpers import corpus, frame
from tests.llm.test_duplicates import components, jaccard, shingle_set

LABELS = "doc_id long, quality int, toxic int"


@functools.lru_cache(maxsize=None)
def letter(c):
    low = c.lower() if c.isalpha() else ""
    code = ord(low if len(low) == 1 else c) if low else 0
    return np.random.default_rng([language.SEED, code]).integers(0, 2, language.DIMENSIONS, dtype=np.int8).astype(int) * 2 - 1


def bundled(text):
    """One vector a text, letter by letter."""
    marks = " "
    for c in text or "":
        if c.isalpha() or marks[-1].isalpha():
            marks += c if c.isalpha() else " "
    marks += " " if marks[-1].isalpha() else ""
    out = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(marks, marks[1:], marks[2:], strict=False):
        out += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return out


def model_of(rows):
    made = collections.defaultdict(lambda: np.zeros(language.DIMENSIONS))
    for _, text, lang in rows:
        if lang is not None and text is not None and any(c.isalpha() for c in text):
            made[lang] += bundled(text)
    return {k: v / np.linalg.norm(v) for k, v in made.items() if v.any()}


def guess(text, model):
    v = bundled(text)
    if not v.any() or not model:
        return "und", 0.0
    cosines = {k: float(v @ p / np.linalg.norm(v)) for k, p in model.items()}
    best = min(cosines, key=lambda k: (-cosines[k], k))
    return best, min(1.0, max(0.0, cosines[best]))


def learns(doc_id):
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2


def short_corpus(seed):
    """The corpus without its longest text, which plain Python takes long for."""
    return [r for r in corpus(seed) if len(r[1] or "") < 3000]


def test_languages_equal_brute_force(spark):
    rows = [(d, t, lang) for d, t, lang, _ in short_corpus(8)]
    rows += [(900 + i, "the same words in two languages", x) for i, x in enumerate(["xx", "ww"] * 4)]  # a tie: two prototypes alike
    model = model_of([(d, t, "xx" if lang == "ww" else lang) for d, t, lang in rows if learns(d)])
    got = {r.doc_id: r for r in language.identified(frame(spark, [(d, t, "xx" if lang == "ww" else lang, None) for d, t, lang in rows])).collect()}
    for d, t, _ in rows:
        want, score = guess(t, model)
        assert got[d].held_out == (not learns(d)) and got[d].score == pytest.approx(score, abs=1e-6)
        assert got[d].lang_pred == want or abs(score - float(bundled(t) @ model[got[d].lang_pred] / np.linalg.norm(bundled(t)))) < 1e-6
    alike = {"zz": np.ones(language.DIMENSIONS), "aa": np.ones(language.DIMENSIONS)}
    assert {r.lang_pred for r in language.predict(frame(spark, [(1, "some words", None, None)]), alike).collect()} == {"aa"}


def cut(texts):
    """Texts without the bytes that a document before has too, whole characters only."""
    first, out = {}, {}
    for d, t in sorted(texts.items()):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], d) < d:
                gone[i : i + 50] = b"\1" * 50
        out[d] = bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else t
    return out


def mixed(docs, quality):
    """How often each document is taken. docs: id to (text, source)."""
    by = collections.defaultdict(list)
    for d, (t, source) in docs.items():
        size = len((t or "").encode().split())
        u = (int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        by[source].append((-math.log(u) / (0.5 + 1.5 * quality[d] if d in quality else 1.0), d, size))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    sizes = {s: sum(x[2] for x in by[s]) for s in by}
    full = set()
    while True:
        left, w = sum(sizes.values()) - sum(3 * sizes[s] for s in full), sum(weight[s] for s in by if s not in full)
        share = {s: 3 * sizes[s] if s in full else left * weight[s] / w for s in by}
        over = {s for s in by if s not in full and share[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    out = {}
    for s, rows in by.items():
        epochs = math.floor(share[s] / sizes[s] + 1e-12) if sizes[s] else 0
        rest, before = share[s] - epochs * sizes[s], 0
        for _, d, size in sorted(rows):
            out[d] = epochs + (size > 0 and before + size / 2 <= rest)
            before += size
    return out


def documents(rows):
    return {d: (t, lang, s) for d, t, lang, s in rows}


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All stages over a table with copies, passages, odd texts and user columns that have the operators' names."""
    from tokenizers import Tokenizer

    rows = short_corpus(9) + [(700, "zq " * 400, None, "a"), (701, "plain words of a kind", None, "b")]
    names = ("score", "held_out", "lang_pred", "block", "copies", "n_removed", "gone", "own0", "ids")
    table = frame(spark, rows).withColumns({c: F.lit(c) for c in names})
    table.write.parquet(f"{tmp_path}/documents.parquet")
    quality = {d: d % 2 for d, *_ in rows if d % 3 == 0}
    spark.createDataFrame([(d, q, 0) for d, q in quality.items()], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs, model = documents(rows), model_of([r[:3] for r in rows if learns(r[0])])
    said = {d: guess(t, model) for d, (t, *_) in docs.items()}
    kept = {d: x for d, x in docs.items() if said[d][0] != "und" and (said[d][1] >= corpus_pipeline.SCORE or sum(c.isalpha() for c in x[0]) < corpus_pipeline.LETTERS)}
    assert 700 not in kept and 701 in kept
    first = components(sorted((d, shingle_set(t)) for d, (t, *_) in kept.items()), jaccard)
    kept = {d: x for d, x in kept.items() if first[d] == d}
    texts = cut({d: t for d, (t, *_) in kept.items()})
    times = mixed({d: (texts[d], kept[d][2]) for d in kept}, quality)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: library.encode(texts[d] or "", add_special_tokens=False).ids for d in kept}
    want = sorted((d, len(ids[d]), hashlib.sha256(",".join(map(str, ids[d])).encode()).hexdigest()) for d in kept for _ in range(times[d]))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got.collect()) == want
    out = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == table.columns, name
        assert out.filter(" OR ".join(f"`{c}` != '{c}'" for c in names)).count() == 0 and out.filter("lang IS NULL").count() == 0
        out = spark.createDataFrame(out.collect(), out.schema)
    assert {r.doc_id: r.lang for r in out.collect() if r.doc_id == 701} in ({}, {701: said[701][0]})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_nulls_empty_texts_and_empty_tables(spark, tmp_path, name, stage):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None, None, None), (2, "", "en", None), (3, " \n", None, "a"), (None, "words without an id", None, None), (4, "words here", "en", "a"), (4, "words here", "en", "a"), (5, "other words", None, "a")]
    got = collections.Counter(r.doc_id for r in stage(spark, frame(spark, rows), str(tmp_path)).collect())
    every = collections.Counter(d for d, *_ in rows)
    if name == "language_id":
        assert got == {None: 1, 4: 2, 5: 1}
    elif name == "mix":
        assert {None, 4, 5} <= set(got) <= set(every) and max(got.values()) <= 6  # texts without words come along with complete epochs
    else:
        assert got == every
    assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0
    assert mixing.plan(mixing.weighed(frame(spark, rows), spark.createDataFrame([], LABELS))).count() == len(rows)
