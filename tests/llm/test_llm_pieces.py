"""SentencePiece encoding and decoding against the library."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece

from tagmill.llm import pieces, queries

DOCS = "doc_id long, text string, ids string, decoded int"


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(queries.pieces_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.pieces_path())


def drawn(own, rng):
    names = [*own.ids]
    makers = [lambda: "".join(rng.choice("abcdeinst ,.") for _ in range(rng.randrange(40))),
              lambda: "".join(rng.choice(names) for _ in range(rng.randrange(8))).replace(pieces.BLANK, " "),
              lambda: "".join(rng.choice(" \n\tab" + pieces.BLANK) for _ in range(rng.randrange(60))),
              lambda: "".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x3000, 0x9FFF), 0x1F600])) for _ in range(20)),
              lambda: " " * rng.randrange(70) + rng.choice(names) + " " * rng.randrange(40),
              lambda: "".join(rng.choice(names) for _ in range(30)).replace(pieces.BLANK, "") + "." * rng.randrange(9)]
    return rng.choice(makers)()


def test_ids_and_text_are_the_librarys(own, library):
    rng = random.Random(1)
    texts = [None, "", " ", "\0", "<s> <0x0A> <unk>", *[drawn(own, rng) for _ in range(4000)]]
    for text, ids in zip(texts, own.encode(texts)):
        expected = library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert own.decode(ids) == library.decode(expected)


def test_any_ids_are_decoded_as_the_library_does(own, library):
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32_000), rng.choice([0, 1, 2, 259])]) for _ in range(rng.randrange(9))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_compatible_pairs_are_those_that_merging_leaves(own):
    rng = random.Random(3)
    names = [*own.ids]
    for _ in range(5000):
        a, b = rng.choice(names), rng.choice(names)
        assert own.compatible(own.ids[a], own.ids[b]) == (own.merged(a + b)[0] == [a, b]), (a, b)


def test_a_long_unsplit_text_takes_a_byte_a_character(own, library):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgé漢\t😀") for _ in range(60_000))
    assert np.frombuffer(own.encode([text], ends=False)[0], "<u4").tolist() == library.encode(text)


def test_a_small_table_of_chunks_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED", 40)
    small = pieces.Pieces(queries.pieces_path())
    texts = [" ".join(f"w{i % 90}x." for i in range(j, j + 400)) for j in range(5)]
    assert small.encode(texts, ends=False) == [np.array(library.encode(t), "<u4").tobytes() for t in texts]
    assert len(small.known) <= 400


def test_the_query_over_whole_texts(spark, folder, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op11_pieces"](spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest())


def test_odd_rows(spark, library):
    rows = [(None, None, "x", 1), (1, "", None, None), (2, "same", "x", 1), (2, "same", "x", 1), (3, "z" * 100_000, "", 0)]
    table = spark.createDataFrame(rows, DOCS)
    found = pieces.encode_pieces(table, queries.pieces_path())
    got = found.collect()
    assert Counter(r["doc_id"] for r in got) == {None: 1, 1: 1, 2: 2, 3: 1}
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == [1, 2] for r in got if r["doc_id"] in (None, 1))
    assert {r["decoded"] for r in pieces.decode_pieces(found, queries.pieces_path()).collect()} == {"", "same", "z" * 100_000}
    assert pieces.encode_pieces(table.limit(0), queries.pieces_path()).collect() == []
