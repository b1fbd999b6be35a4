import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexitide.llm import languages, lookalike, sentences
from lexitide.llm.lookalike import look_form

SAME = [
    ("A​b", "Ab"), ("ﬁn", "fin"), ("ガ", "ガ"), ("ё", "ë"), ("K", "K"), ("a　b", "a b"), ("ｶﾞ", "ガ"), ("é", "é"), ("a­b͏", "ab"), ("Ｈｅｌｌｏ！", "Hello!"),
    ("well‑known", "well-known"), ("ѕсоре", "scope"), ("ΑΒΕ", "ABE"), (" a\n", "a"), ("​", ""), ("ί", "ί"), ("ї", "ï"), ("ㅤx", "x"),
]
DIFFERENT = [("m²", "m2"), ("H₂O", "H2O"), ("①", "1"), ("½", "1/2"), ("👨‍🌾", "👨🌾"), ("A", "a"), ("é", "e"), ("a", "b"), ("a b", "ab"), ("👨‍👩‍👧", "👨👩👧"), ("क्‍ष", "क्ष"), ("می‌خ", "میخ")]


@pytest.mark.parametrize("a, b", SAME)
def test_equal_looks_are_equal(a, b):
    assert look_form(a) == look_form(b) and look_form(look_form(a)) == look_form(a)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_visible_differences_stay(a, b):
    assert look_form(a) != look_form(b)


def test_table_is_checked(monkeypatch):
    monkeypatch.setattr(lookalike, "LOOK_ALIKE", (*lookalike.LOOK_ALIKE, ("е", "x")))
    with pytest.raises(ValueError, match="two images"):
        lookalike.compiled_table()
    with pytest.raises(ValueError, match="own image"):
        lookalike.Transducer({"е": "ж", "ж": "x"})
    with pytest.raises(ValueError, match="signs that stay"):
        lookalike.Transducer({"a": "ж"})


def test_the_longest_key_wins():
    table = {"и": "u", "и\u0306": "n"}
    assert lookalike.Transducer(table)("йиѝ") == "nuù"
    assert max(map(len, lookalike.compiled_table())) > 3  # flags; most keys of two signs are contexts of joiners


def test_every_key_gives_its_image():
    for like, look in lookalike.LOOK_ALIKE:
        for key, image in zip(like, look):
            assert look_form(key) == look_form(image) == image


def test_emoji_sequences():
    same = [("\u2764\ufe0f\u200d", "\u2764\ufe0f"), ("👩\u200d\u2764\ufe0f\u200d👨", "👩\u200d\u2764\u200d👨"), ("👍🏽\u200d", "👍🏽"), ("a\u200d👩", "a👩")]
    flag = "🏴" + "".join(chr(0xE0000 + ord(c)) for c in "gbsct") + "\U000e007f"
    other = ["\u2764", "\u2764\ufe0f", "👩\u200d👨", "👩👨", "👍", "👍🏽", "🏴", flag, flag.replace("\U000e0073", "\U000e0077")]
    assert all(look_form(a) == look_form(b) for a, b in same)
    assert len({look_form(x) for x in other[:-1]}) == len(other) - 1


def test_random_texts_have_a_fixed_form():
    rng = random.Random(4)
    signs = [chr(c) for c in (*range(32, 127), *range(0x300, 0x310), *range(0x400, 0x460), *range(0x391, 0x3CA), *range(0x200B, 0x2010), *range(0xFF01, 0xFF9F), 0x1F468, 0x200D, 0x1F33E, 0xFE0F, 0x94D, 0x915, 10, 0xA0)]
    for _ in range(400):
        form = look_form("".join(rng.choices(signs, k=rng.randrange(1, 30))))
        assert look_form(form) == form


SCHEMA = "id bigint, full_text string, look_form string, form string"


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        base = rng.choice(["one  two", "сад и", "three 3", "x"])
        text = "".join(c + rng.choice(["", "", "​"]) for c in base).replace(" ", rng.choice([" ", " "]))
        rows.append((k, text, "clash", "clash"))
    rows += [(100, None, "", ""), (None, "x", "", ""), (101, "", "", ""), (102, "​", "", ""), (1, rows[1][1], "again", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {(k, t) for k, t, *_ in rows if k is not None and t is not None}
    want = {(a, b) for a, s in kept for b, t in kept if a < b and s != t and look_form(s) == look_form(t)}
    got = [tuple(r) for r in lookalike.same_look_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (101, 102) in want
    assert lookalike.same_look_pairs(df.limit(0)).count() == 0
    lookalike_block, lookalike.CLASS_BLOCK = lookalike.CLASS_BLOCK, 2
    assert {tuple(r) for r in lookalike.same_look_pairs(df).collect()} == want  # texts of one look in several blocks
    lookalike.CLASS_BLOCK = lookalike_block
    links = Counter(x for pair in want for x in pair)
    classes = [tuple(r) for r in lookalike.look_classes(df).collect()]
    one_text = {k for k, _ in kept if sum(k == j for j, _ in kept) == 1}
    assert {k for k, *_ in classes} == {k for k, _ in kept}
    for k, least, n in classes:
        form = {look_form(t) for j, t in kept if j == k}
        assert least in {min(j for j, t in kept if look_form(t) == f) for f in form}
        if k in one_text and not any(look_form(t) in form and j not in one_text for j, t in kept):
            assert n == links[k]
    out = lookalike.with_look_form(df.repartition(7))
    assert out.count() == len(rows) and out.columns == df.columns and out.where("id = 100").first().look_form is None
    long = spark.createDataFrame([(1, "а" * 300_000)], "id bigint, full_text string")
    assert lookalike.with_look_form(long).select(F.length("look_form")).first()[0] == 300_000


def cut(text):
    return [s for _, s in sentences.split_sentences(text)]


CASES = [
    ("Mr. Smith met Dr. B. C. Brown. He left at 10.30.", ["Mr. Smith met Dr. B. C. Brown.", "He left at 10.30."]),
    ("He said, “Go. Now!” Then he went.", ["He said, “Go. Now!”", "Then he went."]),
    ("“Would. It?” she said to him. Yes", ["“Would. It?” she said to him.", "Yes"]),
    ("Wait... and see. What?! No", ["Wait... and see.", "What?!", "No"]),
    ("See http://a.b/c.html now.Next one #tag 🎉", ["See http://a.b/c.html now.", "Next one #tag 🎉"]),
    ("@me one two. #t http://x.y 🎉 Three", ["@me one two. #t http://x.y 🎉", "Three"]),
    ("again it was here? then a COMMON one. end", ["again it was here?", "then a COMMON one.", "end"]),
    ("편지를 또 이. 매우 먼", ["편지를 또 이.", "매우 먼"]),
    ("a line\nanother line", ["a line", "another line"]),
    ("was it. it was! yes", ["was it.", "it was!", "yes"]),
    ("Ich wohne in der Goethestr. 5 in Berlin. Am 3. Mai kam er.", ["Ich wohne in der Goethestr. 5 in Berlin.", "Am 3. Mai kam er."]),
    ("Ver pág. 3. Luego sal.", ["Ver pág. 3.", "Luego sal."]),
    ("Es war z. B. schön. Gut", ["Es war z. B. schön.", "Gut"]),
    ("Pão aldeia no p.ex. Figadave se", ["Pão aldeia no p.ex. Figadave se"]),
    ("สวัสดี ครับ", ["สวัสดี", "ครับ"]),
    ("met u. r. lebus today. then home", ["met u. r. lebus today.", "then home"]),
    ("川で！庭に「冬。窓。」と言った。夏", ["川で！", "庭に「冬。窓。」と言った。", "夏"]),
    ("他她说“夏天。们的。”信号。", ["他她说“夏天。们的。”", "信号。"]),
    ("ภูเขา ของแม่น้ำ 🔥", ["ภูเขา", "ของแม่น้ำ 🔥"]),
    ("बगीचा है। “खाली। है।” उसने कहा सपना? नदी", ["बगीचा है।", "“खाली। है।” उसने कहा सपना?", "नदी"]),
    ("Και το ποτάμι; Να η αγορά.", ["Και το ποτάμι;", "Να η αγορά."]),
    ("Er kam am 3. Mai und ging. Das war der Tag.", ["Er kam am 3. Mai und ging.", "Das war der Tag."]),
    ("Gold, silver, etc. Then home in the U.S. We won.", ["Gold, silver, etc.", "Then home in the U.S.", "We won."]),
    ("Ｏｎｅ． Two", ["Ｏｎｅ．", "Two"]),
    ("В саду на ул. Садовой он был. И её", ["В саду на ул. Садовой он был.", "И её"]),
    ("It is (approx. Two) here. Ok", ["It is (approx. Two) here.", "Ok"]),
    ("Mr​. Smith is in.", ["Mr​. Smith is in."]),
    ("", []), ("  \n ", []), (None, []), ("...", ["..."]), ("no end", ["no end"]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_sentences(text, want):
    assert cut(text) == want


def test_positions_are_of_the_text_as_stored():
    text = " ​Оne​ twо.  Ｔｈｒee é. Four"
    for at, s in sentences.split_sentences(text):
        assert text[at : at + len(s)] == s and not s[0].isspace()
    assert [a for a, _ in sentences.split_sentences("a. B")] == [0, 3] or [a for a, _ in sentences.split_sentences("Aa. B")] == [0, 4]


def test_sentence_rows(spark):
    rows = [(1, "One. Two", 7, "x"), (1, "One. Two", 7, "x"), (2, None, 7, "x"), (3, "", 7, "x"), (4, " \n", 7, "x"), (5, "word. Next " * 20_000, 7, "x")]
    df = spark.createDataFrame(rows, "id bigint, full_text string, start_pos int, sentence string")
    got = sentences.with_sentences(df)
    assert got.columns == ["id", "full_text", "sentence_no", "start_pos", "sentence"]
    assert sorted((r.sentence_no, r.start_pos, r.sentence) for r in got.where("id = 1").collect()) == [(1, 0, "One.")] * 2 + [(2, 5, "Two")] * 2
    assert got.where("id in (2, 3, 4)").count() == 0 and got.where("id = 5").count() == 20_001
    assert sentences.with_sentences(df.limit(0)).count() == 0


LINES = {
    "en": "the river and the garden were quiet when she came to the old house with a letter",
    "de": "der Fluss und der Garten waren ruhig als sie mit einem Brief zu dem alten Haus kam",
    "fr": "la rivière et le jardin étaient calmes quand elle arriva dans la vieille maison avec une lettre",
    "ru": "река и сад были тихими когда она пришла в старый дом с письмом и книгой",
    "uk": "річка і сад були тихими коли вона прийшла до старого будинку з листом і книгою",
    "zh": "河流花园很安静当她来到古老的房子带着书信和书",
    "ja": "彼女が手紙を持って古い家に来たとき川と庭は静かでした",
    "th": "แม่น้ำและสวนเงียบเมื่อเธอมาที่บ้านเก่าพร้อมกับจดหมาย",
}


def _corpus(n=40):
    rng, rows, k = random.Random(1), [], 0
    for lang, line in LINES.items():
        words = line.split()
        for _ in range(n):
            mixed = " ".join(rng.sample(words, len(words))) if len(words) > 3 else line
            rows.append((k, mixed.capitalize() + ".", rng.choice([lang, lang, lang, languages.NAMES[lang].split()[0], None, "en"]), k))
            k += 1
    return rows, k


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("en", " EN ", "en-GB", "pt_BR", "Spanish", "deu", "xx", "", None, "und")], "l string")
    assert [r[0] for r in df.select(languages.label_code(F.col("l"))).collect()] == ["en", "en", "en", "pt", "es", "de", None, None, None, None]


def test_language_segments(spark):
    rows, k = _corpus()
    # held out: other word orders, and mixtures
    held = {k + i: lang for i, lang in enumerate(LINES)}
    rows += [(i, LINES[lang] + ".", "xx", 0) for i, lang in held.items()]
    mixed, quoted, none = k + 100, k + 101, k + 102
    rows += [
        (mixed, f"{LINES['en'].capitalize()}. {LINES['de'].capitalize()}.\n{LINES['th']}", "en", 0),
        (quoted, f"The old “{' '.join(LINES['ru'].split()[:3])}” river and the garden were quiet. She came to the house with the letter.", "en", 0),
        (none, "12 — 😂 http://x.example/a", "en", 0), (none + 1, "", None, 0), (none + 2, None, None, 0), (none + 3, "the river " * 30_000, None, 0), (0, rows[0][1], rows[0][2], 0),
        (none + 4, "ყველა ადამიანი იბადება თავისუფალი და თანასწორი", None, 0), (none + 5, f"{LINES['en'].capitalize()}. כל בני האדם נולדו בני חורין ושווים.", None, 0),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_segments int")
    got = languages.language_segments(df)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.segment_no, r.lang, r.start_pos, r.end_pos, r.confidence))
    assert all([s[1] for s in by[i]] == [lang] for i, lang in held.items())
    assert [s[1] for s in sorted(by[mixed])] == ["en", "de", "th"] and [s[1] for s in by[quoted]] == ["en"]
    for i in (none, none + 1, none + 2):
        assert [s[:2] for s in by[i]] == [(0, None)]
    assert [(s[1], s[4]) for s in by[none + 4]] == [("und", 0.0)]  # none of the languages
    assert [s[1] for s in sorted(by[none + 5])][0] == "en"
    assert by[none + 3][0][1] == "en" and len(by[0]) == 2
    assert all(0 <= s[4] <= 1 for rows_ in by.values() for s in rows_)
    first = sorted(by[mixed])
    assert first[0][2] == 0 and all(a[3] == b[2] for a, b in zip(first, first[1:]))
    assert languages.language_segments(df.limit(0)).count() == 0
