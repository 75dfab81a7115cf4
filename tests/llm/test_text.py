"""Tokens, encodings, languages and residue."""

from __future__ import annotations

import random

import numpy as np
import pytest

from bhashaloom.llm import encoding as G
from bhashaloom.llm import language_model as M
from bhashaloom.llm import languages as L
from bhashaloom.llm import residue as R
from bhashaloom.llm import residue_neighbours as RN
from bhashaloom.llm import tokenizer as T

ODD = [None, "", " ", "\n \t", "a", "It's   two\n\nlines ", "ക്ഷേത്രം ದೇವಸ್ಥಾನ", "😀😀 <|endoftext|> \x1c\x85 end", "x" * 100_000, "क " * 20_000, "ab​c\xa0d　e", "a"]


@pytest.fixture(scope="module")
def encoder():
    return T.encoder(f"{T.TOKENIZERS}/{T.DEFAULT}")


def test_chunks_encode_like_whole_texts(encoder):
    rng = random.Random(0)
    signs = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　a'sbत्ते1१.,!😀ೝ​")
    texts = [x for x in ODD if x] + ["".join(rng.choices(signs, k=rng.randint(0, 15))) for _ in range(3000)]
    values, ends = encoder.encode(texts)
    for i, t in enumerate(texts):
        ids = values[ends[i] : ends[i + 1]].tolist()
        assert ids == encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert encoder.decode(ids) == t
    assert encoder.count(texts).tolist() == np.diff(ends).tolist()


def test_full_chunk_table(encoder):
    small = T.Encoder(f"{T.TOKENIZERS}/{T.DEFAULT}", max_chunks=3)
    for text in ("one two three four", "five six", "one two"):
        assert small.encode([text])[0].tolist() == encoder.encode([text])[0].tolist()


def test_spans_and_split_characters(encoder):
    text = "aत्त😀 b"
    ids, starts, ends = encoder.spans(text)
    assert starts[0] == 0 and ends[-1] == len(text) and all(a < b for a, b in zip(starts, ends)) and len(ids) == len(starts)
    assert set(range(len(text))) == {c for a, b in zip(starts, ends) for c in range(a, b)}
    cut = encoder.encode(["😀"])[0].tolist()[:-1]
    assert "�" in encoder.decode(cut) and encoder.decode(None) is None and encoder.decode([]) == ""


def test_ids_of_odd_texts(spark, encoder):
    frame = spark.createDataFrame([(i if i != 4 else None, t, [1], "k") for i, t in enumerate(ODD)], "doc_id long, text string, ids array<int>, key string")
    got = {r["doc_id"]: r["ids"] for r in T.encode_texts(frame, "doc_id", "text").collect()}
    assert got[0] == [] and got[1] == [] and got[2] == encoder.tokenizer.encode(" ").ids and len(got) == len(ODD)
    back = {r["doc_id"]: r["text"] for r in T.decode_ids(T.encode_texts(frame, "doc_id", "text"), "doc_id").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD) if i != 4)
    assert T.token_spans(frame, "doc_id", "text").count() == len(ODD)
    assert T.encode_texts(frame.limit(0), "doc_id", "text").count() == 0


def test_other_vocabulary(spark):
    frame = spark.createDataFrame([(1, "Hello World"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in T.encode_texts(frame, "doc_id", "text", vocabulary="word_bpe_49k.json").collect()}
    assert len(got[1]) == 2 and got[2] == []


def test_budget(spark):
    rows = [("s", "a", "d", "one two"), ("s", "b", None, " "), (None, "a", "d", None), ("s", "a", "d", "one two")]
    frame = spark.createDataFrame(rows, "source string, lang string, domain string, text string")
    counted = T.count_tokens(frame, "text", ["source", "lang", "domain"])
    assert sorted(r["n_tokens"] for r in counted.collect()) == [0, 0, 2, 2]
    cube = T.token_budget(counted, ["source", "lang", "domain"])
    top = cube.where("level = 7").first()
    assert (top["n_rows"], top["n_texts"], top["n_tokens"]) == (4, 2, 4)
    assert cube.where("level = 3 AND source IS NULL").first()["n_rows"] == 1
    assert T.token_budget(counted.limit(0), ["source"]).count() == 0


CLEAN = [f"{a} {b} है और {c} में {n}" for a in ("नदी", "गाँव", "पानी") for b in ("सड़क", "बारिश", "जंगल") for c in ("शहर", "स्कूल", "घर") for n in (1, 27, 1990)] + [
    f"the {a} was {b} – near the café of São {c}" for a in ("river", "road", "shop") for b in ("opened", "closed") for c in ("Tivo", "Mola")
]


def test_rereading_inverts_garbling():
    for codec in G.CODECS:
        for text in ("नदी", "é – ’", "ಕನ್ನಡ ½"):
            assert G.reread(G.garble(text, codec), codec)[0] == text


def test_repairs(spark):
    rng = random.Random(1)
    rows, whole = [], {}
    for i, line in enumerate(CLEAN * 3):
        if i % 3 == 0:
            whole[i] = line
            codec = rng.choice(G.CODECS[:8])
            line = G.garble(line, codec)
            if i % 2 == 0 and codec == "cp1252":
                line = G.garble(line, "cp1252")
        rows.append((i, line))
    extra = [(1000, "Đồng ṛṣi Ãlvaro €45 Трамка Ωρία naïve │ ½ ×3"), (1001, None), (1002, ""), (1003, "lost � sign"), (1004, "x" * 100_000), (None, G.garble("नदी", "cp1252"))]
    frame = spark.createDataFrame([(*r, "g") for r in rows + extra], "line_id long, line string, gain string")
    got = {r["line_id"]: r for r in G.repairs(frame, "line_id", "line").collect()}
    assert set(got) == {i for i in whole if not whole[i].isascii()} | {1003, None}
    right = [i for i in whole if i in got and got[i]["restored"] == whole[i]]
    assert len(right) > 0.95 * len(whole) and not got[1003]["whole"]
    assert G.repairs(frame.limit(0), "line_id", "line").count() == 0


LANGUAGES = [L.Language("hindi", 0x900, 0x97F, ("hi", "hindi")), L.Language("marathi", 0x900, 0x97F, ("mr",)), L.Language("kannada", 0xC80, 0xCFF, ("kn", "kannada")), L.Language("english", 65, 591, ("en",))]
WORDS = {
    "hindi": "है और में के को से पर यह था लेकिन नहीं बारिश गाँव सड़क पानी लोग किया मिला".split(),
    "marathi": "आहे आणि मध्ये हे ते पण नाही पाऊस गाव रस्ता लोकांना झाले मिळाली म्हणून त्यांनी".split(),
    "kannada": "ಮತ್ತು ಇದು ಒಂದು ಆದರೆ ಮಳೆ ನದಿ ಹಳ್ಳಿ ಶಾಲೆ ನೀರು ಮನೆ ಈ ಜನರು ಬಂದರು ನೋಡಿದರು".split(),
    "english": "the of and was but not river road people water school with from opened".split(),
}


def labelled(rng, n=1200):
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        other = rng.choice([x for x in WORDS if x != lang])
        say = lambda w, k: " ".join(rng.choice(WORDS[w]) for _ in range(k))
        label = {"hindi": " Hindi", "marathi": "MR", "kannada": "kn", "english": "en"}
        kind = rng.choices(["plain", "wrong", "missing", "mixed", "borrowed"], [70, 8, 8, 8, 6])[0]
        text, given, want = say(lang, rng.randint(7, 14)), label[lang], set()
        if kind == "wrong":
            given, want = label[other], {lang}
        elif kind == "missing":
            given, want = rng.choice([None, " ", "und"]), {lang}
        elif kind == "mixed":
            text, want = text + " — " + say(other, rng.randint(6, 12)), {lang, other}
        elif kind == "borrowed":
            text = text + " " + say(other, 1)
        rows.append((i, text, given, want))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled(random.Random(7))
    frame = spark.createDataFrame([(i, t, g, "x") for i, t, g, _ in rows], "line_id long, line string, language string, lang string")
    table = spark.createDataFrame([(x.name, x.lo, x.hi, list(x.aliases)) for x in LANGUAGES], "lang string, lo int, hi int, aliases array<string>")
    got = {(r["line_id"], r["lang"]) for r in L.mislabelled(L.identify(frame, "line_id", "line", "language", table), "line_id").collect()}
    want = {(i, x) for i, _, _, w in rows for x in w}
    assert len(got & want) > 0.95 * len(want) and len(got - want) < 0.05 * len(want)


def test_language_edges(spark):
    rows = labelled(random.Random(8), 200)
    odd = [(900, None, "hi"), (901, "", None), (902, "123 456", "hi"), (903, "की " * 30_000, "hi"), (None, "the road of water was opened", "hi"), (904, "short one", "hi")]
    frame = spark.createDataFrame([(i, t, g) for i, t, g, _ in rows] + odd, "line_id long, line string, language string")
    table = spark.createDataFrame([(x.name, x.lo, x.hi, list(x.aliases)) for x in LANGUAGES] + [(None, 1, 2, None)], "lang string, lo int, hi int, aliases array<string>")
    got = {r["line_id"]: r for r in L.identify(frame, "line_id", "line", "language", table).collect()}
    assert got[900]["lang"] is None and got[902]["lang"] is None and got[902]["n_words"] == 0 and got[None]["lang"] == "english"
    assert all(r["confidence"] is None or 0 < r["confidence"] <= 1 for r in got.values())
    assert 904 not in {r["line_id"] for r in L.mislabelled(L.identify(frame, "line_id", "line", "language", table), "line_id").collect()}
    assert L.identify(frame.limit(0), "line_id", "line", "language", table).count() == 0
    assert L.identify(frame, "line_id", "line", "language", table.limit(0)).where("labelled IS NOT NULL").count() == 0


def test_ngrams_and_romanised():
    hashes, counts = M.ngrams(["ab", "", "abcdef"])
    assert counts.tolist() == [4 + 3 + 2 + 1, 2 + 1, 8 + 7 + 6 + 5 + 1] and len(hashes) == counts.sum() and hashes.max() < M.FEATURES
    assert M.ngrams(["xy", "ab"])[0][10:].tolist() == M.ngrams(["ab"])[0].tolist()
    assert [M.romanised(w) for w in ("बारिश", "महीना", "ಮಳೆ", "अपने", "plain")] == ["baarish", "maheenaa", "male", "apane", "plain"]


RESIDUE = [
    "नदी {{ first_name }} पानी", "x ${city} y", "{% include 'name' %} a", "a %(date)s b", "a %s b", "a __TITLE__ b", "@@name@@", "##name##", "[Insert name Here] a", "[नाम] है", "«title» a", "<<name>> b", "[[x_y]] a", "<?= $x ?>", "<%= x %>", "#{x.y} a", "{$x} a", "{0} a", "%NAME% a",
    "यह undefined है", "a N/A N/A b", "a ??? b", "#REF! a", "a [object Object] b", "a NaN b",
    "Lorem ipsum dolor sit amet", "blah blah blah", "Your heading here", "Sample text goes here!", "यह एक नमूना पाठ है",
    "404 Not Found", "Home | Contact | Search\nJavaScript is disabled. Switch it on and reload\nनदी पानी।", "Traceback (most recent call last):\n  File \"app.py\", line 4, in render\nKeyError: 'body'", "पृष्ठ सापडले नाही",
]
CONTENT = [
    None, "", " \n", "A plain text. It has sentences.", "In the template one writes `{{ first_name }}` and the engine puts the reader's value there.", "Typesetters have used the words “lorem ipsum” as dummy text for a long time.",
    "Please fill [your name] in the first box of the paper form, as shown in picture 3.", "The value was undefined in the old rule book, so the committee wrote a new one.", 'In Python f"{city}" prints the value, while "%city" belongs to the older style.', "a{1, 2, 3}b 50% $20 #1 c[1] [2]d <b>e</b>",
    "The course teaches JavaScript, and pupils learn to enable scripts. A second sentence follows here. And a third one stands here, too.", "x" * 50_000,
]


def test_residue(spark):
    assert [x for x in RESIDUE if not R.residue_kind(x)] == []
    assert [x for x in CONTENT if R.residue_kind(x)] == []
    frame = spark.createDataFrame([(i, t, "k") for i, t in enumerate(RESIDUE + CONTENT)] + [(0, RESIDUE[0], "k"), (None, RESIDUE[1], "k")], "doc_id long, text string, kind string")
    assert R.residue(frame, "doc_id", "text").count() == len(RESIDUE) + 2
    assert R.residue(frame.limit(0), "doc_id", "text").count() == 0


def test_residue_spreads_to_neighbours(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"{body} {{{{ name }}}}"), (2, f"{body} name"), (3, f"{body}, NAME"), (4, "another text of its own"), (5, None), (6, "")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, class_id int")
    got = {r["doc_id"]: r for r in RN.classes(frame, "doc_id", "text").collect()}
    assert set(got) == {1, 2, 3, 4} and {got[i]["class_id"] for i in (1, 2, 3)} == {1} and all(got[i]["is_residue"] for i in (1, 2, 3)) and not got[4]["is_residue"]
    assert [got[i]["trusted"] for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert RN.classes(frame.limit(0), "doc_id", "text").count() == 0
