"""Sentence units: structure, quotations, abbreviations, scripts and edge cases."""

import pytest

import numpy as np

from frameloom.llm import sentences
from frameloom.llm.sentences import Scan, composed, fit_maximum_entropy, split_sentences, training_share

STARTS = "The gate was open. Once more the lens was wiped. After two tries it worked. Near the gate it rained. Then it stopped! Keep it. At noon we left. Near noon it rained. "
GERMAN = "Die Maske deckt alles ab. Auch die Kacheln wurden verworfen. Im Juni war Ruhe. Am Ende im Juni regnete es. Und alles blieb gleich! Die Serie vom 14. bis zum Ende im Juni bleibt. "
CHINESE = "请不要移动机位！共有三张缩略图吗？请不要移动机位。相似度高于阈值。共有两张吗？备注是空的。共有一张吗？相似度很低。"
# Where abbreviations get their evidence from: dots before small letters, commas and what never begins a sentence.
SHORT = "It took the No. 7 lens, e.g. IMG5.JPG, from the U.S. site at 7 p.m. local time, etc. and on to the gate! Near the No. 9 gate, e.g. IMG6.JPG, it rained at 8 p.m. after noon. "
KURZ = "Es galt bis zum 3. Juni, z. B. IMG7.JPG, alles. Auch vom 8. bis 9. Juni, z. B. IMG8.JPG, war Ruhe. "
CASES = [
    ["Heading without mark", "The list of lenses, mounts, etc. was checked.", "Once more the lens was wiped."],
    ["The export used rule No. 2, e.g. IMG54078.JPG, without conflicts.", "Then it stopped!"],
    ["At 5 p.m. local time the U.S. site sent 3.5 clips.", "Near the gate it rained."],
    ["The second pass said “Too dark. Shoot it again.” and moved on.", "The shift wrote “Keep it.”", "Once more the lens was wiped."],
    ["The puddle (see the log. It is short.) covered 70% of the tile."],
    ["(It rained. Again.)", "Then it stopped!"],
    ["Was it late… or early?", "Why?!", "Once more the lens was wiped."],
    ["Die Serie vom 14. bis 16. Juni bleibt.", "Auch die Kacheln, z. B. IMG1.JPG, wurden verworfen."],
    ["共有三张缩略图吗？", "「请不要移动机位！」相似度高于阈值。"],
    ["请不要移动机位！", "共有三张缩略图吗？"],
]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, " \n\n".join(["".join(u + (" " if u[-1].isascii() or u[-1] in "”…" else "") for u in case)]) if i else case[0] + "\n \n" + " ".join(case[1:])) for i, case in enumerate(CASES)]
    rows += [(100 + i, STARTS) for i in range(30)] + [(200 + i, GERMAN) for i in range(30)] + [(300 + i, CHINESE) for i in range(30)] + [(600 + i, SHORT) for i in range(30)] + [(700 + i, KURZ) for i in range(30)]
    rows += [(500, None), (501, ""), (502, " 　\n\t"), (503, "x" * 200_000), (504, "1. one. Two.\n- three! Four?\n\nfive.Six"), (505, "ภาพมืด กล้อง cam-1 ขยับ ฝนตก"), (506, "“never closed. Then it stopped! \"'"), (507, "...!!?? ( . ) 。。")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id int, text string, start_char string")
    out = {}
    texts = dict(rows)
    for r in sorted(map(tuple, split_sentences(df).collect())):
        out.setdefault(r[0], []).append((r[1], r[2]))
    for doc, spans in out.items():
        text = texts[doc]
        covered = [False] * len(text)
        end = 0
        for a, b in spans:
            assert end <= a < b and not text[a].isspace() and not text[b - 1].isspace()
            end = b
            covered[a:b] = [True] * (b - a)
        assert all(c or x.isspace() for c, x in zip(covered, text, strict=True))
    return {doc: [texts[doc][a:b] for a, b in spans] for doc, spans in out.items()}


@pytest.mark.parametrize("i", [i for i in range(len(CASES)) if i != 8])
def test_cases(got, i):
    assert got[i] == CASES[i]


def test_blank_texts_have_no_unit(got):
    assert not {500, 501, 502} & set(got)


def test_long_text_without_marks(got):
    assert len(got[503]) == 1


def test_lists_and_missing_blanks(got):
    assert got[504][:2] == ["1. one. Two.", "- three! Four?"]


def test_thai(got):
    assert got[505] == ["ภาพมืด", "กล้อง cam-1 ขยับ", "ฝนตก"]


def test_no_documents(spark):
    assert split_sentences(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_blocks():
    text = "a\r\nb\n\t\n- c\n12. x\n3.5\nd\n\n\n"
    scan = Scan(text)
    at = lambda p: int(scan.places[p])
    found = [(text[at(a) : at(b)], bool(listed)) for a, b, listed in zip(scan.first, scan.last, scan.listed, strict=True)]
    assert found == [("a\r\nb", False), ("- c", True), ("12. x", True), ("3.5\nd", False)]


def test_no_candidate_inside_names_and_numbers():
    assert not len(Scan("v2.5.18 3.2 clip.3256.mp4 D:\\a\\clip.1.mp4 00:827.39 .5 U.S.A x").at)


def test_spans_hash_as_their_text():
    text = "Near the gate 12345 it rained. 共有三张缩略图吗？ Ende 𠀀x"
    scan = Scan(text)
    rng = np.random.default_rng(1)
    a = rng.integers(0, scan.n - 5, 200)
    b = a + rng.integers(0, 5, 200)
    assert scan.spans.of(a, b).tolist() == [sentences._hash(scan.text[i:j]) for i, j in zip(a, b, strict=True)]


def test_composed_places():
    text = "e\u0301a\u0308\u0323x \u1112\u1161\u11ab!"
    short, places = composed(text)
    import unicodedata

    assert short == unicodedata.normalize("NFC", text)
    assert len(places) == len(short) and places.tolist() == sorted(places.tolist()) and places[-1] == len(text) - 1


def test_long_texts_are_parted_at_blank_lines(monkeypatch):
    texts = [" ".join(["It rained. Then it stopped!"] * 20) + "\n\n", None, "x" * 400 + "\n \nCafe\u0301 shut. So we left."] * 7 + [""]
    counts, weights = sentences.Counts(np.zeros(0, np.uint64), np.zeros((0, 6))), sentences.prior()
    whole = [x.tolist() for x in sentences.units(texts, counts, weights)]
    monkeypatch.setattr(sentences, "CHUNK", 100)
    assert [x.tolist() for x in sentences.units(texts, counts, weights)] == whole
    assert texts[2][whole[1][-1] : whole[2][-1]] == "So we left." and whole[0][-1] == 20


def test_the_training_sample_is_never_empty_or_unbounded(spark):
    for n in (0, 1, 4000, 5_000_000_000, 10**15):
        assert 0 <= training_share(n) < 1 << 63
    assert training_share(5_000_000_000) > (1 << 63) // 5_000_000_000
    # One text that occurs very often is drawn by its documents, not all or none of it.
    df = spark.range(20_000).selectExpr("id as doc_id", "'It rained. Then it stopped!' as text")
    model = sentences.fit_sentences(df)
    assert model.weights[0] > 0 and split_sentences(df, model=model).count() == 40_000


def test_other_terminal_marks(spark):
    df = spark.createDataFrame([(1, "Մեկ երկու։ Երեք։"), (2, "ក ខ។ គ។"), (3, "က ခ။ ဂ။")], "doc_id int, text string")
    assert split_sentences(df).groupBy("doc_id").count().where("count = 2").count() == 3


def test_long_blocks_take_time_in_proportion():
    import time

    began = time.process_time()
    for text in ("(" * 200_000 + "”" * 200_000, "“a.” " * 100_000, "(a.) B " * 100_000, ".” " * 150_000, "a. " * 200_000, "x\n" * 200_000):
        scan = Scan(text)
        scan.right(scan.next, scan.block)
        scan.left(scan.at, scan.block)
    assert time.process_time() - began < 30


def test_maximum_entropy_recovers_a_model():
    rng = np.random.default_rng(0)
    x = np.hstack([np.ones((20_000, 1)), rng.normal(size=(20_000, 2))])
    w = np.array([0.5, 2.0, -1.0])
    y = (rng.random(20_000) < 1 / (1 + np.exp(-x @ w))).astype(float)
    assert np.abs(fit_maximum_entropy(x, y) - w).max() < 0.15
