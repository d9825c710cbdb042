"""Cross-tokenizer alignment against loops over bytes."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tagmill.llm import alignment, queries

DOCS = "doc_id long, text string, groups int, n_best string, row int, key int"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(queries.bytes_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.pieces_path())


def spelled(tokenizers, text):
    """(ids and bytes of A, ids and bytes of B), or None where the bytes differ."""
    a, b = tokenizers
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    # The places of byte-level tokens in the text give their bytes, but for parts of one character.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(i): i for i in shown} | {chr(256 + n): i for n, i in enumerate(i for i in range(256) if i not in shown)}
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a.ids]
    bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    return ((ids_a.ids, bytes_a), (ids_b, bytes_b)) if text and b"".join(bytes_a) == whole == b"".join(bytes_b) else None


def plain(tokenizers, texts):
    """The contract's row for each text, by loops."""
    found, met = [], Counter()
    for text in texts:
        both = spelled(tokenizers, text or "")
        if both is None:
            found.append(None)
            continue
        spans = []
        for ids, parts in both:
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append([(i, end - len(p), end) for i, p, end in zip(ids, parts, ends)])
        owner = {byte: n for n, (_, low, high) in enumerate(spans[1]) for byte in range(low, high)}
        linked = [(spans[0][m][0], spans[1][n][0]) for m, (_, low, high) in enumerate(spans[0])
                  for n in sorted({owner[byte] for byte in range(low, high)})]
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [[[i for i, _, end in side if low < end <= high] for side in spans] for low, high in zip([0, *cuts], cuts)]
        found.append((len(both[0][0]), len(both[1][0]), groups, linked))
        met.update(set(linked))
    best = defaultdict(int)
    for (a, _), n in met.items():
        best[a] = max(best[a], n)
    for row in found:
        if row is None:
            yield (0, 0, 0, 0, 0, 0, "", 0)
            continue
        n_a, n_b, groups, linked = row
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        yield (n_a, n_b, len(groups), len(linked), sum(met[p] == best[p[0]] for p in linked), sum(met[p] for p in linked),
               sha256(text.encode()).hexdigest(), sum(len(x) * len(y) for x, y in groups))


def texts_of(rng):
    made = ["".join(rng.choice(["th", "er", "ing ", "s", "é", "漢", "😀", " ", "  ", "\n", "1", "23", ".", "'s", "\t"]) for _ in range(rng.randrange(40)))
            for _ in range(60)]
    return [None, "", " ", "a", "x▁y", "<|endoftext|> <s></s>", "\0", "it's  fine ", " lead", "same text", "same text", *made]


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], DOCS)


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def test_products_are_those_of_dense_matrices():
    rng = np.random.default_rng(1)
    for _ in range(30):
        dense = [(rng.random(shape) < 0.4) * rng.integers(1, 5, shape) for shape in ((7, 9), (9, 5))]
        a, b = (alignment.Csr(np.concatenate([[0], np.cumsum((d > 0).sum(axis=1))]), np.nonzero(d)[1].astype(np.int32), d[d > 0], d.shape[1])
                for d in dense)
        expected = dense[0] @ dense[1]
        rows, columns, values = alignment.product(a, b)
        got = np.zeros_like(expected)
        got[rows, columns] = values
        assert (got == expected).all() and len(rows) == (expected > 0).sum()
        assert alignment.row_products(a, b).sum() == ((dense[0] > 0).astype(int) @ (dense[1] > 0)).sum()
        back = alignment.transposed(alignment.transposed(a))
        assert all((x == y).all() for x, y in zip(back[:3], a[:3]))


def test_the_query_against_loops(spark, folder, tokenizers):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op12_alignment"](spark, folder).collect()}
    assert got == {i: row for (i, _), row in zip(docs, plain(tokenizers, [t for _, t in docs]))}


@pytest.mark.parametrize("hot", [1 << 18, 40, 0])
def test_odd_texts_and_rare_pairs(spark, tokenizers, hot):
    texts = texts_of(random.Random(5))
    table = rows_of(spark, [*enumerate(texts)]).repartition(5)
    aligned = alignment.align(table, queries.bytes_path(), queries.pieces_path())
    got = {r["doc_id"]: r for r in alignment.with_counts(aligned, hot).collect()}
    assert len(got) == len(texts)
    for i, row in enumerate(plain(tokenizers, texts)):
        own = got[i].asDict()
        own["groups_sha256"] = sha256(own["groups"].encode()).hexdigest() if own["groups"] else ""
        assert tuple(own[c] for c in COLUMNS) == row and own["row"] == 2 and own["key"] == 3, texts[i]


def test_parts_and_blocks_change_nothing(spark, tokenizers, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta!", "Ünï", "x" * 30, "", "1\n2"]) for _ in range(300)), "y" * 900, " ".join(["word"] * 400)]
    own = alignment.Aligner(queries.bytes_path(), queries.pieces_path())
    whole = own.facts(texts)
    monkeypatch.setattr(alignment, "CUT", 50)
    monkeypatch.setattr(alignment, "BLOCK", 120)
    monkeypatch.setattr(alignment, "LEAF", 16)
    assert len([*alignment.parts_of(texts[0])]) > 10
    for a, b in zip(own.facts(texts), whole):
        assert a[:6] == b[:6] and (a[6] == b[6]).all() and (a[7] == b[7]).all()


def test_links_one_by_one(spark, tokenizers):
    texts = ["it's  a tokenizer", "漢字 and 😀", None]
    table = rows_of(spark, [*enumerate(texts)])
    facts = {r["doc_id"]: r for r in alignment.align(table, queries.bytes_path(), queries.pieces_path()).collect()}
    for shared, column in ((False, "n_links"), (True, "n_shared")):
        got = alignment.links(table, queries.bytes_path(), queries.pieces_path(), shared, most=3).collect()
        for i, text in enumerate(texts):
            own = [r for r in got if r["doc_id"] == i]
            assert len(own) == len({(r["a_at"], r["b_at"]) for r in own}) == facts[i][column]
            assert sum(r["n_bytes"] for r in own) == (len((" " + text).encode()) if text else 0)


def test_no_rows_repeats_and_null_ids(spark):
    table = rows_of(spark, [(None, "a b"), (1, "a b"), (1, "a b")])
    run = lambda t: alignment.with_counts(alignment.align(t, queries.bytes_path(), queries.pieces_path())).collect()
    got = run(table)
    assert len(got) == 3 and {r["count_sum"] for r in got} == {6} and {r["n_best"] for r in got} == {2}
    assert run(table.limit(0)) == []


def test_units_are_encoded_once_and_as_in_their_text(tokenizers, monkeypatch):
    both = alignment.Aligner(queries.bytes_path(), queries.pieces_path())
    seen, plain_a = [], both.encode_a
    monkeypatch.setattr(both, "encode_a", lambda parts: seen.extend(parts) or plain_a(parts))
    monkeypatch.setattr(alignment, "UNIT_CHARS", 2000)
    assert both.facts(["alpha beta gamma " * 500 + "delta"])[0][0] > 0 and sum(map(len, seen)) < 100
    rng = random.Random(3)
    words = ["the", "don't", "Ünï", "x▁", "▁y", "a​b", " ", "日本", "é", "́", "ﬁn", "12", "...", "<|endoftext|>", "</s>",
             "\x1c", "\x85", "　", "🙂", "a\tb", "c\nd", "'s", "▁", "\0", *(f"w{i}" for i in range(400))]
    texts = [rng.choice(["", " ", "\n"]) + "".join(rng.choice(words) + rng.choice([" "] * 8 + ["  ", "\n", ""]) for _ in range(rng.randrange(1, 8))) for _ in range(1500)]
    good = 0
    for at in range(0, len(texts), 100):
        for text, found in zip(texts[at:at + 100], both.facts(texts[at:at + 100])):
            want = spelled(tokenizers, text)
            written = [int(i) for i in found[5].replace("|", ",").replace(";", ",").split(",")] if found[5] else []
            good += want is not None
            assert sorted(written) == (sorted([*want[0][0], *want[1][0]]) if want else []), text
            assert found[:2] == ((len(want[0][0]), len(want[1][0])) if want else (0, 0)), text
    assert good > 500 and both.chars < 6000
