"""The pipeline operators against brute force and on odd input."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from tagmill.llm import bpe, components, language, minhash, mixing, pseudonyms, queries, search, substrings, urls, vectors, warc
from tagmill.llm.words import WORD, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, taken int"
KEY = b"k" * 16


def table(spark, texts):
    """Documents with clashing extra columns."""
    rows = [(i, t, ("en", None)[i % 2 if i else 0], ("a", "b", None)[(i or 0) % 3], None, "x", 1) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    return table(spark, [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (4, "!!! 12"), (5, long), (6, long), (7, "x" * 5000)])


def words_of(text):
    return WORD.findall((text or "").encode())


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = [b"a bb  a", None, b"", b" \n", b"bb a\ta " * 50]
    whole = [h.tolist() for h in word_hashes(texts)]
    assert whole[0][0] == whole[0][2] != whole[0][1] and [len(h) for h in whole] == [3, 0, 0, 0, 150]
    monkeypatch.setattr("tagmill.llm.words._BLOCK", 7)
    assert [h.tolist() for h in word_hashes(texts)] == whole


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(5, 5), (None, 7)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {i: i for i in range(300)}
    for _ in range(300):
        for a, b in links[:-2]:
            root[a] = root[b] = min(root[a], root[b])
    met = {x for a, b in links[:-2] if a != b for x in (a, b)}
    assert got == {x: root[x] for x in met}


def test_repeats_against_brute_force(spark):
    rng = random.Random(1)
    runs = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(15, 60))] for _ in range(6)]
    texts = [(i, " ".join(w for _ in range(rng.randrange(1, 5)) for w in
                          (rng.choice(runs) if rng.random() < .6 else [str(rng.random())] * rng.randrange(30)))) for i in range(40)]
    got = {r["doc_id"]: r for r in substrings.repeats(table(spark, texts).repartition(5)).collect()}
    first = {}
    for i, text in texts:
        w, gone = words_of(text), set()
        for s in range(len(w) - 19):
            if first.setdefault(tuple(w[s:s + 20]), (i, s)) != (i, s):
                gone.update(range(s, s + 20))
        assert got[i]["n_words"] == len(w)
        assert {p for r in got[i]["removed"] for p in range(r["start"], r["stop"])} == gone
        assert got[i]["kept"] == b" ".join(x for p, x in enumerate(w) if p not in gone).decode()


def test_repeats_on_odd_input(spark):
    got = {r["doc_id"]: r for r in substrings.repeats(odd(spark).union(table(spark, [(None, "w1 " * 40)]))).collect()}
    assert got[0]["n_words"] == 0 and got[3]["kept"] == "one" and got[None]["removed"] == []
    assert got[5]["removed"][0]["start"] == 700 and got[6]["kept"] == ""
    assert substrings.repeats(table(spark, [])).count() == 0


def test_bpe_is_the_librarys(spark):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(2)
    texts = [None, "", " \u3000 ", "Ärger's <|endoftext|>x", "ΑΣ İ e\u0301\u0301", "a" * 9000, "".join(rng.choice("abe'sé1!漢") for _ in range(7000)),
             "the cat " * 900 + "z" * 3000 + "<|startoftext|>" + "thin" * 900, "the cat " * 900]
    rows = table(spark, [*enumerate(texts), (8, texts[8])])
    for spread in (200_000, 1000):
        got = bpe.tokenize(rows, queries.tokenizer_path(), spread).collect()
        assert Counter(r["doc_id"] for r in got) == Counter({**{i: 1 for i in range(8)}, 8: 2})
        for r in got:
            ids = own.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids, (spread, r["doc_id"])
            assert r["decoded"] == own.decode(ids, skip_special_tokens=False)
    assert bpe.tokenize(table(spark, []), queries.tokenizer_path()).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for group in range(6):
        base = [f"g{group}w{rng.randrange(60)}" for _ in range(60)]
        for _ in range(12):
            edit = list(base)
            for _ in range(rng.randrange(0, 12)):
                edit[rng.randrange(60)] = str(rng.randrange(1000))
            texts.append((len(texts), " ".join(edit)))
    texts += [(100, None), (101, " "), (102, "One"), (103, "one"), (104, "ONE two")]
    for words in (2, 5):
        got = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, texts), words).collect()}
        sets = {}
        for i, text in texts:
            w = words_of((text or "").lower())
            sets[i] = {tuple(w[j:j + words]) for j in range(max(len(w) - words + 1, 1 if w else 0))}
        root = {i: i for i in sets}
        for _ in range(len(sets)):
            for a in sets:
                for b in sets:
                    if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
        assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {
            i: (len(sets[i]), root[i], root[i] == i) for i in sets}
        assert {r["doc_id"] for r in minhash.keep_one(table(spark, texts), words).collect()} == {i for i in root if root[i] == i}


def test_near_duplicates_on_odd_input(spark):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in
                 minhash.near_duplicates(odd(spark).union(table(spark, [(None, "one")])), 2).collect())
    assert (False, 6, 5, False) in got and got.count((False, 3, 3, True)) == 2 and (True, 0, 0, True) in got
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_pseudonyms(spark):
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pseudonyms.permute(i, size, KEY, "t") for i in range(size)) == list(range(size))
    text = ("pay 4111 1111 1111 1111, not 4111 1111 1111 1112; GB82 WEST 1234 5698 7654 32; 2024-02-29, 31/12/1999, 12/31/1999, "
            "30.02.2020; 10.0.0.1 but 300.1.1.1 and version 2.0; 078-05-1120, 000-12-1234; +1 (974) 555-3436; und.34@mail7.example.com")
    new, spans = pseudonyms.rewrite(text, KEY)
    assert [k for _, _, k in spans] == ["card", "iban", "date", "date", "date", "ip", "ssn", "phone", "email"]
    for kept in ("4111 1111 1111 1112", "30.02.2020", "300.1.1.1", "2.0", "000-12-1234", "@mail7.example.com", "+1 ("):
        assert kept in new
    again, same = pseudonyms.rewrite(new, KEY)  # what was valid stays valid
    assert [k for _, _, k in same] == [k for _, _, k in spans] and again != new
    assert not any(text[s:s + n] in new for s, n, _ in spans)
    rows = table(spark, [(0, None), (1, ""), (2, "to +1 (974) 555-3436 x"), (3, "+1 (974) 555-3436!"), (None, "no")]).withColumn("pii", F.lit(1))
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymize(rows, KEY).collect()}
    assert got[2]["text"][3:20] == got[3]["text"][:17] and got[0]["text"] is None and got[None]["pii"] == [] and got[2]["n_words"] == "x"
    assert pseudonyms.pseudonymize(table(spark, []), KEY).count() == 0


def test_rows_of_numbers_stay():
    """Tables of random numbers hold digits that pass as cards or phones by chance; none is rewritten."""
    rng = random.Random(9)
    for sign in " -":
        for width in (4, 3, 2):
            for _ in range(500):
                line = sign.join(str(rng.randrange(10 ** width)) for _ in range(12))
                assert pseudonyms.rewrite(line, KEY) == (line, []), line


def test_planted_cards_and_phones_in_bulk():
    """Each card keeps its shape, sign, issuer and check digit, and equal ones stay equal in any shape."""
    rng = random.Random(10)
    for n in range(400):
        body = rng.choice(["4", "51", "34", "6011", "2221"])
        body += "".join(rng.choice("0123456789") for _ in range(15 - len(body)))
        digits = body + str(-pseudonyms.luhn(body + "0") % 10)
        sign = rng.choice(["", " ", "-"])
        card = sign.join(digits[i:i + 4] for i in range(0, 16, 4))
        text = f"paid {n} with {card}, thanks"
        new, spans = pseudonyms.rewrite(text, KEY)
        assert [(s[0], s[2]) for s in spans] == [(text.index(card), "card")], text
        made = new[spans[0][0]:spans[0][0] + spans[0][1]]
        assert [c for c in made if not c.isdigit()] == [c for c in card if not c.isdigit()]
        plain = pseudonyms.rewrite(digits, KEY)[0]
        assert pseudonyms._digits(made) == plain and not pseudonyms.luhn(plain) % 10 and pseudonyms._ISSUER.match(plain)


def test_values_beside_other_digits_and_capitals_get_pseudonyms():
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    for text, value, kind in [
            (f"{card} 12/26", card, "card"), (f"{card} 123", card, "card"), (f"{card} 12", card, "card"), (f"7 {card}", card, "card"),
            (f"paid 2024 {card}", card, "card"), (f"paid 2024 {card} 2025 17", card, "card"), ("2024-99-99 4111-1111-1111-1111", "4111-1111-1111-1111", "card"),
            (f"{iban} BIC", iban, "iban"), (f"{iban} KREDBEBB", iban, "iban"), (f"ABCD12 {iban} 2024", iban, "iban"), ("XX99 BE68 5390 0754 7034", iban, "iban"),
            ("at 2024-01-15T10:00:00Z", "2024-01-15", "date"), ("call (415) 555-2671 now", "(415) 555-2671", "phone"),
            ("415-555-2671", "415-555-2671", "phone"), ("1-415.555.2671 or 415.555.2671", "415.555.2671", "phone"),
            ("06 12 34 56 78", "06 12 34 56 78", "phone"), ("(030) 1234 5678", "(030) 1234 5678", "phone"), ("020 7946 0958 2024", "020 7946 0958", "phone")]:
        new, spans = pseudonyms.rewrite(text, KEY)
        at = text.rindex(value)
        assert (at, len(value), kind) in spans and value not in new, text
        if len(spans) == 1:  # what stands beside the value stays
            assert new[:at] == text[:at] and new[at + len(value):] == text[at + len(value):], text
    two, spans = pseudonyms.rewrite(f"{card} 5500 0000 0000 0004", KEY)
    assert [s[:2] for s in spans] == [(0, 19), (20, 19)]
    for text in ("4111 1111 1111 1112 12/26", "BE68 5390 0754 7035 BIC", "2024-13-15T10:00", "115-055-2671", "1 2 3 4 5 6", "page 12 of 2024", "2024-01-15Tx"):
        assert pseudonyms.rewrite(text, KEY) == (text, [])


def test_mixing(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(str(rng.random()) for _ in range(rng.randrange(400)))) for i in range(300)] + [(400, None), (401, " ")]
    docs = table(spark, texts)
    plan, pieces = mixing.mix_sources(docs, block=16, shard=64)
    rows = plan.collect()
    assert rows == mixing.mix_sources(docs.repartition(7), block=16, shard=64)[0].collect() or sorted(rows) == sorted(
        mixing.mix_sources(docs.repartition(7), block=16, shard=64)[0].collect())
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for rows_of in by.values():
        assert abs(sum(r["taken"] for r in rows_of) - rows_of[0]["target"]) <= 32
        assert sum(r["size"] for r in rows_of) == rows_of[0]["source_size"]
    assert pieces.groupBy("shard", "slot").agg(F.countDistinct("source", "block").alias("n")).where("n > 1").count() == 0
    taken = {r["doc_id"]: r["taken"] for r in rows}
    mixed = {r["doc_id"]: len(words_of(r["text"])) for r in mixing.mixed_documents(docs, block=16, shard=64).collect()}
    assert mixed == {i: n for i, n in taken.items() if n}
    assert mixing.mix_sources(table(spark, []))[0].count() == 0
    assert mixing.targets([10, 100, 0], [5, 2, 1], 165, 2) == [20, 145, 0.0]
    for size in (1, 5, 1000):
        assert sorted(mixing.permuted(np.arange(size), size, 9).tolist()) == list(range(size))


def test_mixing_meets_targets_of_any_size(spark):
    sizes = [1, 2, 5, 40, 100, 127, 128, 129, 130, 200, 257, 1000]
    rows = [(100 * s + i, " ".join(f"s{s}w{j}" for j in range(i, n, 3)), None, f"{s:02d}", 0) for s, n in enumerate(sizes) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for weights, share in ((mixing.WEIGHTS, 1.5), ((1.0,), .4), ((1.0, 50.0), .7), ((3.0, 1.0), 2.0)):
        plan, pieces = mixing.mix_sources(docs, weights=weights, share=share)
        by = defaultdict(list)
        for r in plan.collect():
            by[r["source"]].append(r)
            assert r["taken"] <= 2 * r["size"]
        assert len(by) == len(sizes)
        for name, of in by.items():
            assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= .5, (name, weights)
        assert pieces.where("stop <= start").count() == 0
    for size in (1, 2, 9, 1000):
        assert [mixing.place(v, size, 5) for v in mixing.permuted(np.arange(size), size, 5).tolist()] == list(range(size))


def test_rows_without_and_with_shared_ids_are_mixed_as_documents_of_their_own(spark):
    text = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    rows = [(None, text("a", 300)), (None, text("b", 200)), (7, text("c", 250)), (7, text("c", 250)), (8, text("d", 150)), (8, text("e", 400))]
    docs = table(spark, rows).withColumn("source", F.lit("a"))
    got = [r["text"].split() for r in mixing.mixed_documents(docs, share=2.0).collect()]
    assert sorted(sorted(w) for w in got) == sorted(sorted(2 * t.split()) for _, t in rows)
    part = mixing.mixed_documents(docs, share=.5, block=16).collect()
    assert sum(len(r["text"].split()) for r in part) == 775
    assert all(len({w[0] for w in r["text"].split()}) == 1 for r in part)


def test_one_of_equal_rows_is_kept(spark):
    rows = [(3, "one two"), (3, "one two"), (4, "three"), (4, "four"), (5, "one two"), (6, None), (6, None), (None, "one two"), (None, "one two")]
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in minhash.keep_one(table(spark, rows).withColumn("lang", F.lit("en"))).collect())
    assert got == [("3", "one two"), ("4", "four"), ("4", "three"), ("6", "None"), ("None", "one two"), ("None", "one two")]


def test_language(spark):
    en, de = "the cat and the dog are in the house with that thing ", "der hund und die katze sind nicht mit dem haus "
    docs = table(spark, [(i, en * (i % 3 + 1)) for i in range(0, 20, 2)]).withColumn("lang", F.lit("en")).union(
        table(spark, [(i, de * (i % 3 + 1)) for i in range(1, 20, 2)]).withColumn("lang", F.lit("de")))
    profiles = language.learn(docs)
    assert sorted(profiles) == ["de", "en"] and len(profiles["en"]) <= language.TOP
    asked = table(spark, [(0, "The house and THE dog"), (1, "das haus und der hund"), (2, None), (3, "12 !?"), (4, ""), (None, en * 3000)])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(asked, profiles).collect()}
    assert [got[i][0] for i in (0, 1, 2, 3, 4, None)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[2][1] == 0
    assert language.learn(table(spark, [])) == {} and language.identify(asked, {}).where("lang_pred != 'und'").count() == 0


def test_pipeline_keeps_unlabelled_documents(spark, folder):
    import corpus_pipeline as P
    texts = [(0, "the cat"), (1, "das Haus"), (2, None), (3, ""), (4, "12 !?"), (5, "漢字"), (None, "no id"), (5, "漢字")]
    for docs in (table(spark, texts).withColumn("lang", F.lit(None).cast("string")), table(spark, texts).where(f"not {queries.TRAINED} != 0")):
        got = sorted((str(r["doc_id"]), r["text"], r["lang"]) for r in P.in_language(spark, docs, folder).collect())
        assert got == sorted((str(r["doc_id"]), r["text"], r["lang"]) for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"]))
        assert P.in_language(spark, docs, folder).columns == list(P.COLUMNS)


def test_urls(spark):
    pages = spark.createDataFrame([(0, "http://A.Example.NET/en/x?q#f"), (1, "https://net"), (2, "https://xnet/"), (3, None), (4, "nothing"),
                                   (5, "http://a.org/fr/"), (5, "http://a.org/fr/"), (None, "http://b.net/#a://c"), (6, "http://example.com/de/a")],
                                  "page_id long, url string").withColumn("rule", F.lit(1))
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
                                   ("org", "/fr/", "allow"), ("org", "/fr", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = [tuple(r) for r in urls.judge_urls(pages, rules).collect()]
    assert sorted(got, key=str) == sorted([
        (0, "a.example.net", "/en/x", "example.net/en/", "allow"), (1, "net", "", None, "allow"), (2, "xnet", "/", None, "allow"),
        (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "a.org", "/fr/", "org/fr/", "allow"), (5, "a.org", "/fr/", "org/fr/", "allow"),
        (None, "b.net", "/", "net/", "block"), (6, "example.com", "/de/a", "example.com/de/", "block")], key=str)
    assert urls.judge_urls(pages.limit(0), rules).count() == 0 and urls.judge_urls(pages, rules.limit(0)).where("rule is not null").count() == 0


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 12))
    x[50:100] = x[:50] + rng.normal(size=(50, 12)) * 0.25
    x[100:120] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 12), (202, [float("nan")] * 12), (203, [1.0]), (204, [])]
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = n @ n.T >= 0.95
    root = np.arange(150)
    for _ in range(150):
        root = np.array([root[link[i]].min() for i in range(150)])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(1))
    for tile in (4096, 20):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(frame, tile=tile).collect()}
        assert got == {**{i: (int(link[i].sum()) - 1, int(root[i]), bool(root[i] == i)) for i in range(150)}, **{i: (0, i, True) for i in range(200, 205)}}
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "FIRST_BLOCKS", 1)
    monkeypatch.setattr(search, "SHARD_POSTINGS", 300)
    monkeypatch.setattr(search, "BLOCK_DOCS", 4)
    rng = random.Random(7)
    texts = [(i, " ".join(rng.choice(["the", "of"] + [f"r{rng.randrange(60)}"]) for _ in range(rng.randrange(40)))) for i in range(120)] + [(200, None)]
    got = defaultdict(list)
    for r in search.search(table(spark, [*texts, (None, "the")]), F.col("doc_id") % 20 == 0, 5).orderBy("place").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    bags = {i: Counter(words_of(t)) for i, t in texts}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    idf = {t: np.log(1 + (len(bags) - d + .5) / (d + .5)) for t, d in df.items()}
    for q in (i for i in bags if i % 20 == 0 and bags[i]):
        scores = {i: round(float(sum(idf[t] * b[t] * 2.2 / (b[t] + 1.2 * (.25 + .75 * sum(b.values()) / mean)) for t in bags[q] if t in b)), 6)
                  for i, b in bags.items() if b.keys() & bags[q].keys()}
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in best], abs=2e-6) and got[q][0][0] == best[0][0]
    assert 200 not in got and search.search(table(spark, []), F.lit(True)).count() == 0


def test_revisits(spark):
    h = lambda **kw: [Row(name=k.replace("_", "-"), value=v) for k, v in kw.items()]
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    log = [(1, "response", "http://www.A.com/x/#f", day(1), 200, h(ETag='"1"', Type="t", Date="1"), "d1"),
           (2, "revisit", "https://a.com/x", day(2), 304, h(etag='W/"1"', Date="2", Type="u"), None),
           (3, "revisit", "https://a.com/x", day(3), 304, h(etag='"9"'), None), (4, "revisit", "https://a.com/x", day(4), 304, None, None),
           (5, "revisit", "https://a.com/x", day(1), 304, h(etag='"1"'), "d1"), (5, "revisit", "https://a.com/x", day(1), 304, h(etag='"1"'), "d1"),
           (0, "revisit", "https://a.com/x", day(1), 304, h(etag='"1"'), "d1"), (6, "revisit", None, day(1), 304, None, None),
           (7, "response", "https://a.com/x", day(5), 404, h(etag='"7"'), "d7"), (8, "revisit", "https://a.com/x?utm_a=1", day(6), 304, None, "d1"),
           (9, "response", None, None, None, None, None), (10, "revisit", "https://a.com/x", None, 304, None, None)]
    frame = spark.createDataFrame(log, "record_id long, kind string, url string, at string, status int, headers array<struct<name:string,value:string>>, digest string")
    got = [(r["record_id"], r["response_id"], r["outcome"]) for r in warc.resolve_revisits(frame).collect()]
    assert sorted(got) == [(0, None, "missing"), (2, 1, "resolved"), (3, 1, "mismatch"), (4, 1, "unchecked"), (5, 1, "resolved"), (5, 1, "resolved"),
                           (6, None, "missing"), (8, 1, "resolved"), (10, None, "missing")]
    merged = [r["headers"] for r in warc.resolve_revisits(frame).where("record_id = 2").collect()][0]
    assert [(x["name"], x["value"]) for x in merged] == [("date", "2"), ("etag", 'W/"1"'), ("type", "t")]
    assert warc.resolve_revisits(frame.limit(0)).count() == 0


def test_pipeline(spark, folder):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(80).cache()
    clean = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, step in P.STAGES[:-1]:
        kept = step(spark, docs, folder).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
        docs = kept
    last = {r["doc_id"]: r for r in P.STAGES[-1][1](spark, docs, folder).collect()}
    assert set(last) <= set(clean) and len(last) == docs.count()
    for r in docs.collect():
        assert last[r["doc_id"]]["ids_sha256"] == sha256(last[r["doc_id"]]["ids"]).hexdigest()


def plain_grams(text):
    words, n = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(), Counter()
    for i, w in enumerate(words):
        padded = f" {w} "
        n.update(w)
        n.update(padded[j:j + 3] for j in range(len(padded) - 2))
        n.update(padded[j:j + 2] for j in range(len(padded) - 1))
    return n


def plain_rank(n):
    return {g: i for i, (g, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:300])}


def test_queries_without_sql_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer
    from zlib import crc32
    rng = random.Random(11)
    stock = {"en": "the cat and dog are in house with that thing over there", "de": "der hund und die katze sind nicht mit dem haus über straße"}
    rows = [(i, " ".join(rng.choice(stock[lang].split()) for _ in range(rng.randrange(1, 90))) + (f" am 2024-01-{i % 28 + 1:02d}" if i % 3 else ""),
             lang if i % 7 else None, f"s{i % 4}", 0) for i in range(60) for lang in [("en", "de")[i % 2]]]
    rows += [(100, None, "en", "s0", 0), (101, "", None, None, 0), (102, "12 !?", "de", "s1", 0), (5, *rows[5][1:]), (5, *rows[5][1:]),
             (103, "the house and " * 4000, "en", "s2", 0), (None, "the dog", "en", "s3", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]

    own = Tokenizer.from_file(queries.tokenizer_path())
    ids = {t: own.encode(t, add_special_tokens=False).ids for t in {r[1] or "" for r in rows}}
    assert Counter(run("op2_bpe")) == Counter((r[0], len(ids[r[1] or ""]), sha256(np.array(ids[r[1] or ""], "<u4").tobytes()).hexdigest(),
        sha256(own.decode(ids[r[1] or ""], skip_special_tokens=False).encode()).hexdigest()) for r in rows)

    learned = defaultdict(Counter)
    for i, text, lang, *_ in rows:
        if None not in (i, text, lang) and crc32(str(i).encode()) % 5:
            learned[lang].update(plain_grams(text))
    profiles, expected = {lang: plain_rank(n) for lang, n in sorted(learned.items()) if n}, Counter()
    for i, text, *_ in rows:
        mine = plain_rank(plain_grams(text))
        costs = {lang: sum(min(abs(known[g] - at), 300) if g in known else 300 for g, at in mine.items()) for lang, known in profiles.items()}
        best = min(costs, key=costs.get) if mine else "und"
        expected[i, i is not None and crc32(str(i).encode()) % 5 == 0, best, round(1 - costs[best] / (300 * len(mine)), 9) if mine else 0.0] += 1
    assert Counter((*r[:3], round(r[3], 9)) for r in run("op10_language")) == expected

    got = run("op9_pii")
    assert Counter((r[0], r[2]) for r in got) == Counter((r[0], int("2024" in (r[1] or ""))) for r in rows)
    for i, text, _, pii in got:
        given = next(r[1] for r in rows if r[0] == i)
        assert len(pii) == 0 and text == given or text[:-10] == given[:-10] and tuple(pii[0]) == (len(given) - 10, 10, "date")

    sizes, takes, got = Counter(), Counter(), run("op7_mixing")
    for _, size, _, _, taken, source in got:
        sizes[source] += size
        takes[source] += taken
    assert Counter((r[0], r[1], r[5]) for r in got) == Counter((r[0], len(words_of(r[1])), r[3]) for r in rows)
    names = ["s0", "s1", "s2", "s3", None]
    aims = mixing.targets([sizes[n] for n in names], [5., 2., 1., 5., 2.], 1.5 * sum(sizes.values()), 2.0)
    assert all(abs(takes[n] - aim) <= .5 for n, aim in zip(names, aims))
    assert {(r[5], r[2], round(r[3], 6)) for r in got} == {(n, sizes[n], round(a, 6)) for n, a in zip(names, aims)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, folder, name):
    import check
    got = queries.QUERIES[name](spark, folder).toArrow()
    assert check.compare(got, check.connect(folder).execute(queries.ORACLES[name]).to_arrow_table()).startswith("ok")


def _opened(bags):
    """A shard over the given bags of (word number -> frequency)."""
    docs = np.arange(len(bags), dtype=np.int64)
    lengths = np.array([sum(b.values()) for b in bags], np.int64)
    triples = sorted((t, d, f) for d, b in enumerate(bags) for t, f in b.items())
    keys, sizes = np.unique([t for t, _, _ in triples], return_counts=True)
    parts = [docs.tobytes(), lengths.tobytes(), keys.astype(np.int64).tobytes(), search._narrow(sizes),
             search._narrow(np.array([d for _, d, _ in triples])), search._narrow(np.array([f for _, _, f in triples]))]
    return search.Shard(float(lengths.mean()), *(pa.py_buffer(p) for p in parts)), float(lengths.mean())


@pytest.mark.parametrize("seed", range(6))
def test_pruned_shard_is_exhaustive_scoring(seed):
    rng = np.random.default_rng(seed)
    bags = [{int(t): int(rng.integers(1, 300 if t == 3 else 9)) for t in np.unique(rng.zipf(1.4, rng.integers(1, 30)) % 500)} for _ in range(3000)]
    shard, mean = _opened(bags)
    for _ in range(20):
        keys = np.unique(rng.integers(0, 520, rng.integers(1, 12)))
        weights = rng.random(len(keys)) * 8 + 0.01
        scores = []
        for d, b in enumerate(bags):
            norm = 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)
            s = sum(w * b[t] * 2.2 / (b[t] + norm) for t, w in zip(keys.tolist(), weights.tolist()) if t in b)
            if s:
                scores.append((-round(s, 6), d))
        docs, got = shard.top(keys, weights, 10)
        assert [(-g, d) for g, d in zip(got.round(6).tolist(), docs.tolist())] == sorted(scores)[:10]


def test_blocks_that_cannot_reach_the_threshold_are_skipped(monkeypatch):
    bags = [{1: 1, 2: 1, 3: 1} if d < 64 else {1: 1, d + 10: 5} for d in range(6400)]
    shard, _ = _opened(bags)
    met = []
    plain = search.Shard._add
    monkeypatch.setattr(search.Shard, "_add", lambda self, score, cells, weights, wanted: (
        met.append(int(self.count[cells[wanted]].sum())), plain(self, score, cells, weights, wanted))[1])
    docs, _ = shard.top(np.array([1, 2, 3]), np.array([0.1, 6.0, 6.0]), 10)
    assert docs.tolist() == list(range(10)) and sum(met) < 640


def test_runs_of_slots_are_dealt_whole():
    rng = random.Random(11)
    slots = [rng.randrange(3000) for _ in range(7)] + [0, 1]
    for run, shard in ((1 << 28, 64), (2000, 64), (500, 128)):
        runs, shards = mixing.plan_runs(sum(slots), len(slots), shard, run)
        at = np.zeros(len(slots), np.int64)
        for number in range(runs * shards):
            first, counts = mixing.draws(slots, shard, shards, number, 7, runs)
            assert first.tolist() == at.tolist() and counts.min() >= 0 and counts.sum() <= shard
            at += counts
        assert at.tolist() == slots
    # Sizes of 100 TB: draws stay in the range of the generator, shards are full but for the last of a run.
    huge = [90_000_000_000, 60_000_000_000, 13]
    runs, shards = mixing.plan_runs(sum(huge), 3, mixing.SHARD)
    for number in (0, shards * (runs // 2) + 5, shards * (runs - 1)):
        counts = mixing.draws(huge, mixing.SHARD, shards, number, 7, runs)[1]
        assert counts.sum() == mixing.SHARD and abs(counts[0] - .6 * mixing.SHARD) < 200


def test_mixing_in_short_runs_and_with_reserved_names(spark):
    docs = table(spark, [(i, " ".join(f"d{i}w{j}" for j in range(37 * i % 400))) for i in range(60)])
    whole, runs = (mixing.mix_sources(docs, block=16, shard=8, run=run) for run in (mixing.RUN, 100))
    assert sorted(map(str, whole[0].collect())) == sorted(map(str, runs[0].collect()))
    assert runs[1].groupBy("shard", "slot").agg(F.countDistinct("source", "block", "use").alias("n")).where("n > 1").count() == 0
    named = docs.withColumns({"_key": F.col("doc_id") + 77, "_spans": F.lit("s"), "key": F.lit(1), "s": F.lit(2)})
    got = mixing.mixed_documents(named, block=16)
    assert got.columns == named.columns
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(r["doc_id"], r["text"]) for r in mixing.mixed_documents(docs, block=16).collect()}
    assert got.where("_key != doc_id + 77 or _spans != 's' or key != 1 or s != 2").count() == 0


def test_revisits_of_a_hot_url_beside_odd_dates(spark):
    rng = random.Random(4)
    log = [(1, "response", "a.com/hot", "1970-01-01 00:00:00", "x"), (2, "revisit", "a.com/hot", "9999-12-31 00:00:00", None)]
    for i in range(3, 1500):
        url = "a.com/hot" if rng.random() < .6 else f"a.com/{rng.randrange(40)}"
        kind = "response" if rng.random() < .5 else "revisit"
        log.append((i, kind, url, f"2024-03-{rng.randrange(1, 29):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00", f"d{rng.randrange(2)}"))
    frame = spark.createDataFrame(log, "record_id long, kind string, url string, at string, digest string").withColumns(
        {"status": F.lit(200), "headers": F.lit(None).cast("array<struct<name:string,value:string>>"), "slice": F.lit(5), "_part": F.lit(6)})
    expected = {}
    for i, kind, url, at, digest in log:
        if kind == "revisit":
            before = [r for r in log if r[1] == "response" and r[2] == url and (r[3], r[0]) < (at, i)]
            expected[i] = max(before, key=lambda r: (r[3], r[0]))[0] if before else None
    for slices in (4, warc.SLICES):
        assert {r["record_id"]: r["response_id"] for r in warc.resolve_revisits(frame, slices=slices).collect()} == expected


def test_lots_of_long_queries_over_several_shards(monkeypatch):
    monkeypatch.setattr(search, "LOT_DOCS", 16)
    monkeypatch.setattr(search, "LOT", 7)
    monkeypatch.setattr(search, "FREQUENT_IMPACTS", 4000)  # fewer terms than are frequent
    rng = np.random.default_rng(5)
    bags = [{int(t): int(rng.integers(1, 9)) for t in np.unique(rng.zipf(1.3, 60) % 400)} for _ in range(400)]
    bags[30:60] = [bags[3]] * 30  # copies: equal scores go by the smaller id
    shards = [_opened(bags)[0], _opened(bags)[0]]
    shards[1].docs = shards[1].docs + 400
    keys = [np.array(sorted({*bags[i], 1000 + i})) for i in range(0, 400, 20)] + [np.array(sorted(bags[3]))]
    weights = [rng.random(len(k)) + 0.01 for k in keys]
    sent = pa.table({"query": np.repeat(np.arange(len(keys)), [len(k) for k in keys]), "query_id": np.repeat(np.arange(len(keys)), [len(k) for k in keys]),
                     "key": np.concatenate(keys), "w": np.concatenate(weights)})
    asked, best = search._queries(type("Sent", (), {"value": sent})), search.Best(len(keys), 10)
    for shard in shards:
        shard.top_of_lots(asked, np.arange(len(keys)), best)
    for n, (key, weight) in enumerate(zip(keys, weights)):
        scores = []
        for shard in shards:
            for d, bag in enumerate(bags):
                found = shard.impacts[shard.places == d][np.argsort(shard.owner[shard.places == d], kind="stable")]
                held = dict(zip(sorted(bag), found.tolist()))
                if s := sum(w * held[t] for t, w in zip(key.tolist(), weight.tolist()) if t in held):
                    scores.append((-round(s, 6), int(shard.docs[d])))
        order = np.lexsort((best.docs[n], -best.scores[n]))
        want = sorted(scores)[:10]
        assert best.docs[n][order].tolist() == [d for _, d in want]
        assert best.scores[n][order] == pytest.approx([-s for s, _ in want], abs=2e-6)
    # What cannot reach the best known scores is not looked at again.
    monkeypatch.setattr(search.Shard, "_picked", lambda self, known, *rest, f=search.Shard._picked: (got := f(self, known + 1e6, *rest), found.append(len(got[0])))[0])
    found = []
    shards[0].top_of_lots(asked, np.arange(len(keys)), best)
    assert found and sum(found) == 0


def test_sets_in_no_pair_are_not_shuffled(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(40 + i % 2))) for i in range(60)]
    docs = table(spark, rows)
    plans, plain = [], minhash.stage

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, name)

    monkeypatch.setattr(minhash, "stage", noted)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 2).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {i: i - i % 2 for i in range(60)}
    assert "repeated" in [name for name, _ in plans]  # bands are counted once
    confirmed = [plan for name, plan in plans if name == "confirmed"]
    assert confirmed and all("LeftSemi" in plan for plan in confirmed)
