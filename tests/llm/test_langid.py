import math
import random
import zlib

from kinweave.llm import langid, queries

SAMPLES = {"en": "the quick brown fox jumps over the lazy dog and the cat", "fr": "le renard brun saute par dessus le chien paresseux été"}


def brute(parser, text):
    """(phrases, symbols) of a text for each language, by searching the sample text for the longest phrase."""
    symbols = parser.symbols(text).tolist()
    out = []
    for lang in parser.langs:
        own = bytes(parser.symbols(SAMPLES[lang]).tolist())
        n = 0
        for a in range(0, len(symbols), langid.BLOCK):
            block = symbols[a : a + langid.BLOCK]
            i = 0
            while i < len(block):
                j = i + 1
                while j <= len(block) and bytes(block[i:j]) in own:
                    j += 1
                i = max(i + 1, j - 1)
                n += 1
        out.append(n)
    return out, len(symbols)


def test_phrases_equal_a_search_of_the_text(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 16)
    parser = langid.CrossParser(SAMPLES)
    texts = ["the fox", "le chien saute", "zzz qqq", "été 123 !!", "x", "the quick brown fox jumps over the lazy dog " * 3, "日本語 fox", ""]
    counts, lengths = parser.phrases(texts)
    for text, got, n in zip(texts, counts.tolist(), lengths.tolist(), strict=True):
        assert (got, n) == brute(parser, text)


def test_prediction_is_the_smallest_normalised_count():
    parser = langid.CrossParser(SAMPLES)
    texts = ["the lazy brown dog", "le chien brun", "fox été le"]
    found, score = parser.predict(texts)
    for text, lang, s in zip(texts, found, score, strict=True):
        counts, n = brute(parser, text)
        costs = [c * math.log2(len(parser.symbols(SAMPLES[x])) + 2) / n for c, x in zip(counts, parser.langs, strict=True)]
        assert lang == parser.langs[costs.index(min(costs))]
        assert abs(s - (1 - min(costs) / max(costs))) < 1e-12 and 0 <= s <= 1


def test_no_letters_and_nulls():
    parser = langid.CrossParser(SAMPLES)
    assert parser.predict([None, "", "123 !!", "é", "日本"])[0][:3] == ["und"] * 3
    assert parser.predict(["é", "日本"])[0] != ["und", "und"]
    assert langid.CrossParser({}).predict(["abc"])[0] == ["und"]


def test_odd_rows(odd_docs, no_docs):
    samples = langid.learn(odd_docs.where("lang is not null"), "text", "lang", 2000)
    assert set(samples) == {"en", "fr", "de"}
    got = langid.identify(odd_docs, samples)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == odd_docs.count()
    by_id = {r.doc_id: r.lang_pred for r in got.collect()}
    assert by_id[3] == by_id[4] == by_id[5] == "und" and by_id[6] == "fr"
    assert langid.learn(no_docs, "text", "lang") == {} and langid.identify(no_docs, {}).count() == 0


def test_a_skewed_language_is_learned(spark):
    long = "lungo " * 100_000
    rows = [(i, f"breve testo numero {i} " * 4, "it") for i in range(20)] + [(99, long, "it")]
    rows += [(200 + i, f"{i} " + f"langer text {i} " * 5000, "de") for i in range(12)]
    rows += [(300 + i, "1234 " * 5000, "sv") for i in range(50)] + [(400, "svenska ord", "sv")]
    rows += [(500 + i, "same words " * 20, "en") for i in range(200)] + [(900 + i, f"other words {chr(97 + i)}", "en") for i in range(3)]
    rows += [(1000, "123", "xx")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.learn(frame, "text", "lang", 1000)
    assert set(samples) == {"it", "de", "sv", "en"}
    assert all(1000 <= len(samples[x]) <= 1001 for x in ("it", "de"))
    assert "svenska ord" in samples["sv"] and all(f"other words {c}" in samples["en"] for c in "abc")


def language(rnd, letters, n=500):
    """A maker of texts over the letters."""
    words = ["".join(rnd.choices(letters, k=rnd.randrange(2, 7))) for _ in range(n)]
    return lambda k: " ".join(rnd.choices(words, k=k))


def test_alphabets_of_hundreds_of_letters(spark):
    rnd = random.Random(5)
    alphabets = {"en": "abcdefghijklmnopqrstuvwxyz", "ru": [chr(0x430 + i) for i in range(32)], "el": [chr(0x3B1 + i) for i in range(17)], "x1": [chr(0x4E00 + i) for i in range(300)], "x2": [chr(0x5E00 + i) for i in range(300)]}
    make = {k: language(rnd, v) for k, v in alphabets.items()}
    frame = spark.createDataFrame([(i, make[k](60), k) for i, k in enumerate(list(make) * 20)], "doc_id long, text string, lang string")
    parser = langid.CrossParser(langid.learn(frame, "text", "lang", 5000))
    assert parser.width > 600
    texts = [(k, make[k](30)) for k in make for _ in range(100)]
    assert parser.predict([t for _, t in texts])[0] == [k for k, _ in texts]
    # letters that no sample has: every phrase is one symbol long, so words of known letters decide
    assert parser.predict(["日本 " + make["ru"](5)])[0] == ["ru"]


def test_sparse_rows_equal_the_automaton():
    rnd = random.Random(8)
    for letters, n in (("ab", 200), ([chr(0x4E00 + i) for i in range(400)], 900)):
        samples = {k: "".join(rnd.choices([*letters, " "], k=n)) for k in "pq"}
        parser = langid.CrossParser(samples)
        for k, lang in enumerate(parser.langs):
            rows = langid.suffix_automaton(parser.symbols(samples[lang]).tolist())
            place = {0: None}
            start, todo = parser.first[k], [(0, c, to) for c, to in rows[0].items()]
            for c in range(2, parser.width):
                assert (int(start[c]) != parser.fresh[k]) == (c in rows[0])
            while todo:
                state, c, to = todo.pop()
                cell = int(start[c]) if state == 0 else int(parser.next[place[state] + c])
                if to not in place:
                    place[to] = cell
                    for symbol in range(parser.width):
                        assert (parser.owner[cell + symbol] == cell) == (symbol in rows[to])
                    todo += [(to, d, nxt) for d, nxt in rows[to].items()]
                assert place[to] == cell
            assert len(place) == len(rows)


def test_a_language_of_few_long_texts_is_never_lost(spark):
    for seed in range(20):
        rnd = random.Random(seed)
        long, short = language(rnd, "abcdefgh"), language(rnd, "ijklmnop")
        rows = [(i, long(230_000 if seed == 0 else 23_000), "long") for i in range(3)] + [(9 + i, short(20), "short") for i in range(300)]
        samples = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", 2000)
        assert 2000 <= len(samples["long"]) <= 2001 and 2000 <= len(samples["short"]) <= 2001


def test_long_texts_are_read_whole():
    parser = langid.CrossParser(SAMPLES)
    text = "the lazy dog " * 100 + "le chien paresseux été " * 200_000
    assert parser.predict([text, None, text[:1300]])[0] == ["fr", "und", "en"]


def test_repeated_texts_are_learned_once(spark):
    rows = [(1, "the same words again", "en")] * 500 + [(2, "and some others", "en"), (3, "mots", "fr"), (None, "nil", "de"), (4, "keine", None), (5, None, "it")]
    samples = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", 1000)
    assert sorted(samples["en"].strip().split("\n")) == ["and some others", "the same words again"] and set(samples) == {"en", "fr", "de"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    for r in rows[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert len(held) > 100 and sum(held) / len(held) > 0.95
