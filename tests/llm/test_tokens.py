"""Token ids, counts and pieces against their libraries."""
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from coldwatch.llm import pieces, token_counts, token_records
from coldwatch.llm.queries import QUERIES
from coldwatch.session import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = "aBlsre''.,!?    \t\n\x0b\0\x1c\x85\xa0 　éÉßİς1½<|日本😀▁"


def odd_texts(count, seed=5):
    draw = random.Random(seed)
    for _ in range(count):
        text = "".join(draw.choice(ODD) for _ in range(draw.randint(0, 24)))
        yield text + (" <|endoftext|> x<|endoftext|>y </s><0x0A>" if draw.random() < 0.1 else "")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def texts(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    return [(r.doc_id, r.text) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(3, None, 1), (1, "", 2), (2, "same twice", 3), (2, "same twice", 4), (None, "no id", 5), (9, "long word " * 30000, 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, part int")


def test_word_ids(library):
    words = token_records.encoder(WORDS)
    for text in odd_texts(1500):
        assert np.frombuffer(words.encode(text), "<u2").tolist() == library[0].encode(text, add_special_tokens=False).ids


def test_records(spark, small, library, texts):
    got = {r.doc_id: r for r in QUERIES["op4_token_records"](spark, small).collect()}
    start = 0
    for doc_id, text in texts:
        ids = [*library[0].encode(text or "", add_special_tokens=False).ids, 2]
        assert got[doc_id].asDict() == {"doc_id": doc_id, "start": start, "n_tokens": len(ids),
                                        "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)
    assert len(got) == len(texts)


def test_odd_records(spark, odd, library):
    manifest = token_records.write(odd, scratch_path(spark, "odd"), WORDS)
    rows = token_records.read_digests(manifest, 2).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 9]
    assert [r.n_tokens for r in rows[:5]] == [3, 1, 3, 3, 1]
    shuffled = token_records.read_shuffled(manifest, 2, 1).collect()
    assert sorted(len(r.ids) for r in shuffled) == sorted(r.n_tokens for r in rows)
    assert [r.ids for r in shuffled if r.doc_id == 9] == [[*library[0].encode("long word " * 30000, add_special_tokens=False).ids, 2]]


def test_no_records(spark, odd):
    manifest = token_records.write(odd.limit(0), scratch_path(spark, "none"), WORDS)
    assert token_records.read_digests(manifest, 2).count() == 0


def test_broken_record(spark, odd):
    manifest = token_records.write(odd, scratch_path(spark, "broken"), WORDS)
    path = manifest.first().path.removeprefix("file://").removeprefix("file:")
    with open(path, "r+b") as file:
        file.seek(20)
        file.write(b"\xff\xfe")
    with pytest.raises(Exception, match="doesn't match its check"):
        token_records.read_digests(manifest, 2).collect()


def test_prefix_counts(library):
    words = token_counts.counter(BYTES)
    size = lambda t: len(library[1].encode(t, add_special_tokens=False).ids)
    for text in odd_texts(400):
        assert words.total(text) == size(text)
        assert words.prefix_counts(text) == [size(text[:i]) for i in range(len(text) + 1)]


def test_counts(spark, small, library, texts):
    got = {r.doc_id: r for r in QUERIES["op5_token_counts"](spark, small).collect()}
    words = token_counts.counter(BYTES)
    for doc_id, text in texts:
        n = len(library[1].encode(text or "", add_special_tokens=False).ids)
        r = got[doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 1024)
        assert words.total((text or "")[:r.fit_chars]) <= 1024
        assert r.fit_chars == len(text or "") or n > 1024


def test_odd_counts(spark, odd):
    rows = token_counts.count_tokens(odd, BYTES, 3).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows)[:5] == [(0, 2), (1, 0), (2, 2), (2, 2), (3, 0)]
    kept = token_counts.with_prefix_counts(odd.where("doc_id = 2"), BYTES).first()
    assert kept.prefix_tokens == [0, 1, 2, 2, 1, 1, 2, 2, 2, 2, 2] or kept.prefix_tokens[-1] == 2
    assert token_counts.count_tokens(odd.limit(0), BYTES, 3).count() == 0


def test_piece_ids():
    words = pieces.encoder(PIECES)
    for text in odd_texts(1500):
        assert words.encode(text) == words.library.encode(text)


def test_pieces(spark, small, texts):
    got = {r.doc_id: r for r in QUERIES["op7_pieces"](spark, small).collect()}
    library = pieces.encoder(PIECES).library
    for doc_id, text in texts:
        ids = [*library.encode(text or ""), 2]
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_pieces(spark, odd):
    back = pieces.decode(pieces.encode(odd, PIECES), PIECES).collect()
    assert all((r.text or "") == r.decoded and r.ids[-1] == 2 for r in back)
    assert pieces.digests(odd, PIECES).count() == 6
    assert pieces.digests(odd.limit(0), PIECES).count() == 0
