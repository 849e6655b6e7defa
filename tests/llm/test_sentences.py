from __future__ import annotations

import pytest

from helixframe.llm import sentences as S

MODEL = S.Model([("*latin", "never", w, 50) for w in ("Dr", "Mr", "No", "i.e", "K", "R", "z.B", "3")] + [("*latin", "ends", w, 50) for w in ("etc", "p.m", "usw")] + [("*latin", "start", "mRNA", 9), ("*cyrillic", "never", "г", 30), ("*cyrillic", "ends", "др", 30)])

# one sentence a piece; what stands between two pieces is blank
CASES = [
    ("en", ["Dr. Stan came.", "He saw 33,933.1 plain things?", "Then No. 4 left!!"]),
    ("en", ["It ended at 5 p.m.", "Then all went etc. and so on.", "mRNA was there."]),
    ("en", ["‘Mash the ball.’", "He said “Go away!”, and went on (why not?) with it.", "(A whole one.)", "Next"]),
    ("en", ["This goes on… and on... and on.", "This ends…", "New one."]),
    ("en", ["See mask27.bed or v36.2.1 i.e. the file.", "K. R. Velmo came."]),
    ("fr", ["Il va bien ?", "« Oui mon ami ! » dit il encore.", "« Tout est dit ! »", "Fin."]),
    ("de", ["Er sagte „Komm her!“, und ging.", "»Nein doch!« rief er am 3. Mai usw.", "Das z.B. Haus steht."]),
    ("es", ["¿Qué es esto?", "¡Vaya!", "Nada."]),
    ("ru", ["В г. Москве жили и др. люди.", "Там были и др.", "Он ушёл."]),
    ("el", ["Τι είναι αυτό;", "Τίποτα."]),
    ("hi", ["यह क्या है (सच में?) बताओ।", "ठीक है ।", "\"चलो!\", वह बोला।"]),
    ("am", ["ሰላም ነው።", "ለምን፧", "«ና!», አለ።"]),
    ("ar", ["كيف الحال؟", "جيد.", "«نعم!»، قال."]),
    ("th", ["สวัสดีครับ", "วันนี้ 57.7 องศา", "เขาๆ ไปกับ Velmo แล้ว"]),
]


@pytest.mark.parametrize("lang,pieces", CASES)
def test_cases(lang, pieces):
    text = "  " + " ".join(pieces) + " "
    got = [text[a:b] for a, b in S.split(text, lang, MODEL)]
    assert got == pieces
    assert [text[a:b] for a, b in S.split(text, "xx", MODEL)] == pieces  # also where the language code is wrong


def test_scripts_without_blanks():
    text = "家野麦草。雪上青“青外？”的村夏？「言海、語。」と山言。K. R. Velmo犬秋下，23.5日！言……、金ます……花した｡3.13日．"
    want = ["家野麦草。", "雪上青“青外？”的村夏？", "「言海、語。」と山言。", "K. R. Velmo犬秋下，23.5日！", "言……、金ます……", "花した｡", "3.13日．"]
    assert [text[a:b] for a, b in S.split(text, "ja", MODEL)] == want


def test_lines_and_missing_blanks():
    text = "One line\n\nthe next.Another one.\r\n… ?\n \t\nLast (open. Never closed"
    assert [text[a:b] for a, b in S.split(text, None, MODEL)] == ["One line", "the next.", "Another one.", "… ?", "Last (open.", "Never closed"]
    assert S.split("", "en", MODEL) == [] and S.split(" \n　", "en", MODEL) == []


def test_what_is_far_from_a_mark_counts():
    greek = "Πες μου αν το βιβλίο " + "A" * 300 + "; Ναι το έχω."
    assert len(S.split(greek, "el", MODEL)) == 2 and len(S.split("See here; not there. Done", "el", MODEL)) == 2
    assert S.script_of("a" + "b" * 500 + "漢" * 502) == "cjk" and S.script_of("漢" * 501 + "b" * 502) == "latin" and S.script_of("12 !") == "latin"
    count, pieces = S.Counter(), []
    S._contexts("He met Prof." + " " * 500 + "Velmo. End", pieces, count)
    assert count["Prof", "p"] == 1 and count["Prof", "e"] == 0 and count["Prof Velmo", "c"] == 1


def test_starters_after_abbreviations():
    learned = S.Model([("*latin", "never", "Jr", 50), ("*latin", "opens", "then", 40), ("*latin", "opens", "velmo", 40), ("*latin", "pair", "Jr Velmo", 30)])
    cut = lambda text: [text[a:b] for a, b in S.split(text, "en", learned)]
    assert cut("It was Smith Jr. Then he left.") == ["It was Smith Jr.", "Then he left."]
    assert cut("It was plan B. Then he left.") == ["It was plan B.", "Then he left."]
    assert len(cut("It was Jr. Velmo who left.")) == 1 and len(cut("It was Jr. then. Some")) == 2 and len(cut("It was Jr. Somebody.")) == 1


def test_marks_of_a_long_line_are_linear():
    import time

    for text in ("(" * 200_000 + "a.", "( a." * 60_000, '" a ' * 60_001, "«a. " * 60_000, "a; " * 80_000):
        at = time.time()
        S.split(text, "en", MODEL)
        assert time.time() - at < 20


def test_long_text_is_split_whole():
    text = "Word and word. " * 40_000
    got = S.split(text, "en", MODEL)
    assert len(got) == 40_000 and got[-1] == (len(text) - 15, len(text) - 1)


def test_learning(spark):
    texts = []
    for i in range(300):
        texts.append((i, f"Some pl{i * 7 % 25} wo{i % 40} of pl{i * 3 % 25} came to Dr. Bran{i % 9} pl{i % 25}. Then ca{i % 50} went by etc.\nEach na{i % 30} said i.e. nothing more etc. Now re{i % 20} left", "en", 1))
    texts += [(1000, None, "en", 1), (1001, "", None, 1), (1002, "Plain text. More", None, 1), (None, "No id here. Two", "en", 1), (1, "One. Two", "en", 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, id int").repartition(3)
    kinds = {(r.model, r.type): r.kind for r in S.learn(df).collect()}
    assert kinds["en", "Dr"] == "never" and kinds["en", "i.e"] == "never" and kinds["*latin", "etc"] == "ends" and ("en", "pl3") not in kinds
    got = {}
    for r in S.sentences(df).collect():
        got.setdefault(r.doc_id, []).append((r.sent_start, r.sent_end))
    assert len(got[7]) == 4 and len(got[1002]) == 2 and len(got[None]) == 2 and 1000 not in got and 1001 not in got
    assert len(got[1]) == 6  # two rows of one id are split each by itself
    assert S.sentences(df.where("false")).count() == 0
