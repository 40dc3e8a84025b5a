import unicodedata

import pytest

from folioscope.llm import confusables as C

PAIRS = [
    ("Ｔｏｔａｌ：", "Total:"), ("Bill To:", "Bill To:"), ("Da​te:﻿", "Date:"), ("Invo­ice", "Invoice"), ("INV‐2024‑1", "INV-2024-1"), ("oﬃce", "office"),
    (unicodedata.normalize("NFD", "Numéro"), "Numéro"), ("Тоtal", "Total"), ("ЅО-2023", "SO-2023"), ("Τοtal", "Total"), ("СЧЁT", "СЧЁТ"), ("２０２４．５", "2024.5"),
    ("金⁠額", "金額"), ("（１）", "(1)"), ("T\u0585tal", "Total"), ("\u13aamount", "Amount"), ("\u0261ross", "gross"), ("Zahl\U000e0101", "Zahl"), ("x\ufe01y", "xy"), ("a\u200db", "ab"),
]
SAME = ["m² ½ §4", "a – b — c", "“quoted” ‘it’", "СЧЁТ", "Дата выдачи", "Δ Budget", "a  b ", "", "Ø 15", "plain", "Δοκιμή", "№ 5 ™", "品名", "НЕТ дата", "می\u200cخواهم", "क्\u200dष", "👨\u200d👩\u200d👧", "\u0585\u0585 \u0578\u0582\u0576"]


@pytest.fixture(scope="module")
def done(spark):
    rows = [(i, t, [1], {"k": 1.5}) for i, t in enumerate([a for a, _ in PAIRS] + SAME + [None])]
    df = spark.createDataFrame(rows, "i int, text string, canonical array<int>, o map<string,double>")
    return {r.i: r for r in C.normalise(df).collect()}


@pytest.mark.parametrize("i", range(len(PAIRS)))
def test_same_form(done, i):
    assert done[i].plain == PAIRS[i][1] and done[i].plain != done[i].text


@pytest.mark.parametrize("i", range(len(SAME)))
def test_left_alone(done, i):
    r = done[len(PAIRS) + i]
    assert r.plain == r.text and r.canonical == " ".join(r.text.split(" ")).strip() if "  " not in r.text else r.canonical == "a b"


def test_null_and_other_columns(done):
    last = done[len(PAIRS) + len(SAME)]
    assert last.plain is None and last.canonical is None and last.o == {"k": 1.5}


def test_idempotent(spark, done):
    df = spark.createDataFrame([(r.i, r.plain) for r in done.values()], "i int, text string")
    assert all(r.plain == r.text for r in C.normalise(df).collect())


def test_found(spark):
    df = spark.createDataFrame([("span", 1, 0, "Da​te"), ("span", 1, 0, "Da​te"), ("anchor", 2, 1, "Date"), ("span", 3, 0, None), ("span", 4, 0, "x​" * 50_000)], "src string, doc_id long, pos int, text string")
    assert sorted((r.src, r.doc_id) for r in C.find_variants(df).collect()) == [("span", 1), ("span", 4)]
    assert C.find_variants(df, df.select("src", "doc_id", "pos")).count() == 0
    assert C.find_variants(df.limit(0)).count() == 0
