import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from foliant.llm import piece_codec
from foliant.llm.piece_codec import Codec, Normalizer, default_model, fields

TEXTS = ["", " ", "  ", "a", " a  b ", "Hello world", "naïve café ▁ x", "日本語 テキスト", "emoji 👩‍👩‍👧 \U0001f9ff", "tab\tand\nlines\r\n\n", "\x00\x01 control", "<s> </s> <unk> <0x41>", "ﬁ ① Ａ　Ｂ Å é ｶﾞ 각 한", "ㅤ  wide​", "x" * 3000, "a b " * 4000, "ß ΐ İ ſ", "̈́̈́ 각", "﻿ start", "  lead　　trail  "]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    pool = "ab ZÉ é ȩ́ ﬁ①ｶﾞ゙がㅤ 각각 \t\n ▁😀<s>"
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    return Codec(default_model())


def bytes_of(text, at):
    return len(text[:at].encode())


def test_ids_spans_and_decoding_equal_the_library(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = TEXTS + random_texts(600)
    found = codec.encode([t.encode() for t in texts])
    decoded = codec.decode([x.ids for x in found])
    for text, x, back in zip(texts, found, decoded, strict=True):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert x.ids.tolist() == ids and back == library.decode(ids)
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(x.start.tolist(), x.end.tolist(), strict=True)) == [(0, 0), *spans, (len(text.encode()),) * 2]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf", "nfkc", "identity"])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
def test_compiled_maps_and_spaces(rule, prefix, squeeze):
    """The map is the library's own compiled one, read here; text and source of each character against its normaliser."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    spec = dict(next(v for n, v in map_fields(library.serialized_model_proto()) if n == 3))
    own = Normalizer(spec)
    assert (own.prefix, own.squeeze, own.escape) == (prefix, squeeze, True)
    for text in TEXTS + random_texts(300, 7):
        x = own(text.encode())
        expected, offsets = library.normalize(text, with_offsets=True)
        assert x.text.tobytes().decode() == expected, text
        starts = [i for i, b in enumerate(x.text) if b & 0xC0 != 0x80] + [len(x.text)]
        places = np.array([bytes_of(text, at) for at in offsets])
        assert x.source[starts].tolist() == places.tolist(), text


def map_fields(proto):
    for number, value in fields(proto):
        yield number, fields(value) if number == 3 else value


def test_brute_force_of_the_map():
    """Every key by trying all prefixes of a text, longest first."""
    library = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
    spec = dict(next(v for n, v in map_fields(library.serialized_model_proto()) if n == 3))
    m = piece_codec.CharMap(spec[2])

    def walk(key):
        node = int(m._offset(m.units[:1])[0])
        for byte in key:
            node ^= byte
            if node >= len(m.units) or int(m.units[node]) & 0x800000FF != byte:
                return None
            unit = m.units[node : node + 1]
            node ^= int(m._offset(unit)[0])
            leaf = int(unit[0]) >> 8 & 1
        return int(m.units[node]) & 0x7FFFFFFF if leaf else None

    for text in TEXTS[:14] + random_texts(60, 9):
        raw = text.encode()
        starts = np.array([i for i, b in enumerate(raw) if b & 0xC0 != 0x80], np.int64)
        length, value = m.longest(np.frombuffer(raw, np.uint8), starts)
        for s, n, v in zip(starts, length, value, strict=True):
            best = next(((k, walk(raw[s : s + k])) for k in range(min(60, len(raw) - s), 0, -1) if walk(raw[s : s + k]) is not None), (0, 0))
            assert (n, v if n else 0) == best


def test_user_symbols_go_before_the_map():
    own = Normalizer({3: 0, 4: 0}, symbols=[b"<a b>", b"<a"])
    x = own(b"x <a b> <a")
    assert x.text.tobytes().decode() == "x▁<a b>▁<a".replace("<a b>", "<a▁b>") and x.source[-1] == 10


def test_wrong_bytes_become_replacement_characters(codec):
    good, bad = codec.encode(["a�b".encode(), b"a\xffb"])
    assert good.ids.tolist() == bad.ids.tolist() and bad.end[-1] == 3
    assert codec.encode([b"\xe2\x82"])[0].ids.tolist() == codec.encode(["��".encode()])[0].ids.tolist()


def test_documents(spark, table):
    rows = [(1, "Hello world"), (2, None), (2, ""), (None, "Hello world"), (3, "x" * 100_000), (3, "x" * 100_000)]
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def expected(text):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())

    got = piece_codec.digests(table(rows)).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == sorted(((d, *expected(t)) for d, t in rows), key=str)
    both = piece_codec.decode_documents(piece_codec.encode_documents(table(rows).selectExpr("*", "0 AS ids", "'' AS decoded"))).collect()
    for r in both:
        assert r.decoded == (r.text or "") and len(r.ids) == len(r.starts) == len(r.ends) and r.digest == "x"
        inner = list(zip(r.starts, r.ends, strict=True))[1:-1]
        assert "".join((r.text or "")[a:b] for a, b in inner) == (r.text or "")  # ASCII here: bytes are characters
    assert piece_codec.digests(table([])).count() == 0


def test_query_covers_the_table(spark):
    got = piece_codec.query(spark, "/root/testdata/sf0.001").collect()
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
