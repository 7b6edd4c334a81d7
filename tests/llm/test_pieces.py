import random
import struct

import pytest

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from linkloom.llm import pieces  # noqa: E402

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        model = f.read()
    return pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def numbers(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def texts(sp):
    rnd = random.Random(3)
    names = [sp.id_to_piece(i) for i in range(259, sp.vocab_size())]
    yield from ["", " ", "  ", "\n", "\t a", "▁", "▁▁a b", "<s> </s> <unk> <0x41>", "\0", "a\0b", "日本語 テスト", "𝔘🙂🙂", "​﻿� x",
                "a" * 3000, " " * 300 + "x", "ab" * 700, "x" * 700 + "\r\n\x85 z", "É" * 600]
    for _ in range(6000):
        k = rnd.random()
        if k < 0.4:
            yield "".join(rnd.choice(names).replace("▁", rnd.choice([" ", "▁", ""])) for _ in range(rnd.randint(1, 8)))
        elif k < 0.8:
            yield "".join(rnd.choice("abcdeilnorst  \n") for _ in range(rnd.randint(0, 60)))
        else:
            yield "".join(rnd.choice("aàéñ ß日本語中🙂▁ \0ea ") for _ in range(rnd.randint(0, 40)))


def test_ids_and_texts_are_those_of_the_library(both):
    own, sp = both
    for t in texts(sp):
        ids = own.encode(t)
        assert numbers(ids) == sp.encode(t, add_bos=True, add_eos=True), repr(t)
        assert own.decode(ids) == sp.decode(numbers(ids)), repr(t)
        assert numbers(own.encode(t, False, False)) == sp.encode(t)


def test_any_ids_decode_as_in_the_library(both):
    own, sp = both
    rnd = random.Random(5)
    for _ in range(4000):
        x = [rnd.choice([rnd.randrange(32000), rnd.randrange(259), rnd.randint(195, 235)]) for _ in range(rnd.randint(0, 9))]
        assert own.decode(struct.pack(f"<{len(x)}I", *x)) == sp.decode(x), x


def test_pairs_fit_exactly_when_merging_keeps_them_apart(both):
    own, _ = both
    rnd = random.Random(7)
    names = [p for p in own.score if len(p) > 1]
    short = [p for p in names if len(p) < 4]
    for _ in range(20000):
        a, b = rnd.choice(short if rnd.random() < 0.6 else names), rnd.choice(short if rnd.random() < 0.6 else names)
        assert own.compatible(a, b) == (own.merged(a + b)[0] == [a, b]), (a, b)


def test_backtracking_over_failed_positions_equals_merging(both):
    own, _ = both
    rnd = random.Random(9)
    for _ in range(3000):
        t = "".join(rnd.choice("ea tn▁") for _ in range(rnd.randint(1, 40)))
        assert own.tokens(t) == own.merged(t)[0]


def test_documents(spark, docs, both):
    own, sp = both
    frame = docs.selectExpr("*", "'mine' as ids", "'mine' as decoded")
    got = pieces.decode_documents(pieces.encode_documents(frame, PATH), PATH)
    assert got.columns == [*docs.columns, "ids", "decoded"]
    rows = got.collect()
    assert len(rows) == frame.count()
    for r in rows:
        want = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert numbers(r["ids"]) == want and r["decoded"] == sp.decode(want)
    assert got.drop("ids", "decoded").exceptAll(docs).count() == 0
    at_once = pieces.encode_documents(frame, PATH, decoded="decoded")
    assert at_once.columns == got.columns and at_once.exceptAll(got).count() == 0
    assert pieces.encode_documents(docs.limit(0), PATH).count() == 0
    spaced = docs.withColumnRenamed("text", "my text")
    assert pieces.encode_documents(spaced, PATH, "my text").count() == len(rows)
