import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import bpe, token_files
from tests.llm.helpers import corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "aaaaaaaa aaa  a\n\n\n x", "a<|endoftext|>b<|endoftext|>", "\x1c\x1d x \x85 　 y​ z", "日本語テキスト 한국어 ١٢٣ ½", "  lead\t\ttabs \r\n", "x" * 5000, "don't I'LL we've", "é́🎉👩‍👩‍👧", "\x00\x01", "<|endoftext|", "''s'll"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("kind", [bpe.Codec, token_files.LibraryCodec])
def test_codec_equals_the_library(library, kind):
    texts = ODD + [t or "" for _, t, _, _ in corpus()]
    codec, got = kind(PATH), []
    for block in codec.blocks(texts):
        got += [codec.ids(w).tolist() for w in block]
    for text, ids in zip(texts, got, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_trimming_the_word_table_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 40)
    monkeypatch.setattr(bpe, "FIRST_WORDS", 10)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 200)
    codec = bpe.Codec(PATH)
    texts = [t or "" for _, t, _, _ in corpus()]
    got = [codec.ids(w).tolist() for block in codec.blocks(texts) for w in block]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip_digests(spark, library):
    rows = corpus() + [(5, "again", None, None), (None, "no id", "en", "a")]
    got = sorted(map(tuple, bpe.round_trip(frame(spark, rows), PATH).collect()), key=str)
    want = []
    for d, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_and_decode_columns(spark):
    docs = frame(spark, corpus()).withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert out.filter("decoded != coalesce(text, '')").count() == 0 and out.count() == docs.count()


def test_files_hold_what_was_written(spark, library, tmp_path):
    rows = corpus() + [(None, "no id", "en", "a"), (3, "repeated id", "en", "a")]
    manifest = token_files.write(frame(spark, rows), PATH, f"file://{tmp_path}", length=32)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read(manifest).collect()))
    start, want = 0, []
    for d, t, _, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    stream = pa.ipc.open_stream(next(tmp_path.glob("*.ids.arrow")).read_bytes())
    assert stream.schema.field("ids").type == pa.list_(pa.uint16(), 32) and stream.schema.field("mask").type == pa.list_(pa.bool_(), 32)


def test_sequences_are_read_at_random_and_without_a_copy(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_ROWS", 4)
    rows = sorted((d, t or "") for d, t, *_ in corpus())
    ids = np.concatenate([library.encode(t, add_special_tokens=False).ids + [0] for _, t in rows])
    with open(tmp_path / "x.ids.arrow", "wb") as f:
        codec = token_files._Sequences(f, 32, np.dtype(np.uint16))
        for lo in range(0, len(ids), 100):
            codec.add(ids[lo : lo + 100])
        codec.close()
    file = token_files.Sequences(f"file://{tmp_path}/x")
    mapped = file.source.size()
    file.source.seek(0)
    begin = file.source.read_buffer(mapped).address
    order = list(range(-(-len(ids) // 32)))
    np.random.default_rng(0).shuffle(order)
    for i in order:
        got, mask = file[i]
        want = ids[i * 32 : i * 32 + 32]
        assert got[: len(want)].tolist() == want.tolist() and mask.to_pylist() == [k < len(want) for k in range(32)]
        assert begin <= got.ctypes.data < got.ctypes.data + got.nbytes <= begin + mapped  # bytes of the mapped file itself
    assert file.step * (len(order) // 4) < mapped
    for start, n in ((0, 5), (127, 2), (130, 400), (len(ids) - 3, 3), (64, 0)):
        assert file.span(start, n).tolist() == ids[start : start + n].tolist()
    with pytest.raises((IndexError, EOFError, OSError, pa.ArrowInvalid)):
        file[len(order) + 40]


@pytest.mark.parametrize("uri,path", [("abfss://c@a.dfs.core.windows.net/x/y", "c/x/y"), ("wasbs://c@a.blob.core.windows.net/x", "c/x"), ("file:///tmp/z", "/tmp/z")])
def test_uris_as_spark_has_them(uri, path):
    assert token_files.filesystem(uri)[1] == path


def test_s3a_is_s3(monkeypatch):
    seen = []
    monkeypatch.setattr(token_files.pafs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda uri: seen.append(uri))}))
    token_files.filesystem("s3a://bucket/a.blob.core.b")
    token_files.filesystem("s3n://bucket/a")
    assert seen == ["s3://bucket/a.blob.core.b", "s3://bucket/a"]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert bpe.round_trip(none, PATH).count() == 0
    assert token_files.read(token_files.write(none, PATH)).count() == 0
