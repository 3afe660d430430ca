import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from cloakframe.llm.packing import pack  # noqa: E402
from cloakframe.llm.tokenfile import decode_values, encode_values, read_token_ids, token_digest, write_token_files  # noqa: E402
from cloakframe.llm.tokens import Encoder  # noqa: E402

ODD = [
    None, "", "  a  b", "a  b   c\n\nd \n e", "x<|endoftext|> y <|ENDOFTEXT|>z", "it's I'LL don't'", "é×. ÷. à.b\r\n\tq",
    "日本語 テキスト。 1234 a1b2", "\x1c a \x85  b    c", "don't.stop,now!x", "é É\n\n", "long " * 5000, "same", "same",
]


def noise(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice("aB éß.,' \n\t1<|  Σσ’") for _ in range(60)) for _ in range(n)]


@pytest.mark.parametrize("name,lower", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_pieces_encode_as_whole_texts(name, lower):
    import pyarrow as pa

    code, texts = Encoder(public_tokenizers.path(name), lower, cached=500), ODD + noise(800)
    for lo, hi, ids, at in code.encode(pa.array(texts)):
        for i in range(lo, hi):
            assert code.tokenizer.encode(texts[i] or "", add_special_tokens=False).ids == ids[at[i - lo] : at[i - lo + 1]].tolist()


def test_values_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (r.integers(0, 2**32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        assert np.array_equal(decode_values(*encode_values(v), n), v)


def expected(texts, name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def test_token_files_equal_the_library(spark, frame, tmp_path):
    texts = ODD + noise(200)
    ids = expected(texts, "word_bpe_49k.json", 2)
    docs = frame([(3 * i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in token_digest(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    at = 0
    for i, x in enumerate(ids):
        r = got[3 * i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    assert len(got) == len(texts)
    write_token_files(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.ids for r in read_token_ids(spark, str(tmp_path / "t")).collect()} == {3 * i: x for i, x in enumerate(ids)}


def test_token_files_of_nothing_and_of_null_ids(spark, frame):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_digest(frame(["a"]).limit(0), path).count() == 0
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_digest(frame([(None, "a b"), (1, "c"), (1, "c")]), path).collect())
    assert got == [(0, None, 3), (3, 1, 2), (5, 1, 2)]


@pytest.mark.parametrize("most_open,fan_in", [(4, 2), (64, 64)])
def test_packing_keeps_every_id_once(frame, most_open, fan_in):
    texts = ODD + noise(300)
    ids = expected(texts, "byte_bpe_50k.json", 0)
    rows = pack(frame(texts), public_tokenizers.path("byte_bpe_50k.json"), most_open=most_open, fan_in=fan_in).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, x in enumerate(ids):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = np.array(x[at : at + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(x)
    waste = 0
    for part in by_seq.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        waste += 0 if at & (at - 1) == 0 else 1024 - at
    assert waste == 0
    assert pack(frame(["a"]).limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
