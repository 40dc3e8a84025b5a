from folioscope.llm import mojibake as M

SCHEMA = "src string, doc_id long, pos int, text string, word string, form string"


def frame(spark, texts):
    return spark.createDataFrame([("span", i, 0, t, None, "x") for i, t in enumerate(texts)], SCHEMA)


CLEAN = ["Numéro de café", "Größe nach Maß", "Дата выдачи", "Résumé «à» part", "£12", "€7", "金額 合計", "dzień"] * 30


def garble(text, *steps):
    for enc, dec in steps:
        data = text.encode(enc)
        text = data.decode(dec, "replace") if dec in ("utf-8", "ascii") else M._read(data, dec)
    return text


BAD = {
    "Numéro": [("utf-8", "cp1252")], "Größe": [("utf-8", "latin-1")], "Дата": [("utf-8", "cp1251")], "Résumé": [("utf-8", "cp1252"), ("utf-8", "cp1252")],
    "café": [("cp437", "cp1252")], "Maß": [("cp1252", "mac_roman")], "выдачи": [("cp1251", "koi8-r")], "金額": [("shift_jis", "cp1252")], "dzień": [("cp1250", "cp1252")], "€": [("utf-8", "mac_roman")],
}


def test_found_and_restored(spark):
    bad = [garble(w, *steps) + " 17" for w, steps in BAD.items()]
    lossy = [garble("café", ("cp1252", "utf-8")), garble("Größe", ("utf-8", "ascii"))]
    other = ["plain words", "", None, "x", "~^~^~^", "pay$by$card", "²½ §4", "Zu​satz"]
    texts = frame(spark, CLEAN + bad + lossy + other + [None])
    n = len(CLEAN)
    found = {r.doc_id - n for r in M.find_garbled(texts).collect()}
    assert found == set(range(len(bad) + len(lossy)))
    fixed = {r.doc_id - n: r.restored for r in M.repair(texts).collect()}
    assert [fixed[i] for i in range(len(bad))] == [w + " 17" for w in BAD]
    assert fixed[len(bad)] is None and fixed[len(bad) + 1] is None


def test_repeated_rows_and_empty(spark):
    texts = frame(spark, CLEAN + ["NumÃ©ro"])
    assert M.find_garbled(texts.unionByName(texts)).count() == 1
    assert M.find_garbled(frame(spark, [])).count() == 0 and M.repair(frame(spark, [])).count() == 0


def test_long_text(spark):
    long_ = " ".join(["word"] * 200_000) + " NumÃ©ro"
    out = M.repair(frame(spark, CLEAN + [long_])).collect()
    assert len(out) == 1 and out[0].restored.endswith(" Numéro")


def test_reports(spark):
    spans = spark.createDataFrame([(1, 0, "Numéro")] * 9, "doc_id long, span_idx int, text string")
    reports = spark.createDataFrame([(1, {0: ["near: NumÃ©ro", None], 2: ["scanned"]}), (2, None), (3, {})], "doc_id long, reasons_by_page map<int,array<string>>")
    assert [(r.src, r.doc_id, r.pos) for r in M.find_garbled(M.text_pieces(spans, reports)).collect()] == [("report", 1, 0)]


def test_forms_lead_back():
    for word in ("Numéro", "Größe", "Дата", "金額", "Łącznie"):
        for (form, chain), (_, _, lossless) in M.garbled_forms(word).items():
            if lossless:
                steps = chain.split(">")
                back = form
                for enc, dec in zip(reversed(steps[1::2]), reversed(steps[0::2])):
                    if enc in M.READ_AS_PAIRS:
                        back = back.encode(enc).decode(dec)
                        continue
                    table = {v: k for k, v in enumerate(M._reader(enc, "keep")[0])}
                    if len(table) < 256 or any(c not in table for c in back):
                        break
                    back = bytes(table[c] for c in back).decode(dec)
                else:
                    assert back == word


def test_readers_of_pairs_and_third_pass(spark):
    words = ["Numéro", "Größe", "выдачи", "請求書番号"]
    bad = [garble("Numéro", *[("utf-8", "cp1252")] * 3)] + ["выдачи".encode().decode(r, "replace") for r in ("gbk", "euc_kr")] + ["請求書番号".encode("shift_jis").decode("gbk", "replace")]
    texts = frame(spark, CLEAN + words * 9 + bad)
    n = len(CLEAN) + 36
    assert {r.doc_id - n for r in M.find_garbled(texts).collect()} == set(range(len(bad)))
    assert {r.doc_id - n: r.restored for r in M.repair(texts).collect()}[0] == "Numéro"


def test_originals_too_many_to_broadcast(spark, monkeypatch):
    texts = frame(spark, CLEAN + ["NumÃ©ro 17"] * 40)
    want = sorted(r.restored for r in M.repair(texts).collect())
    monkeypatch.setattr(M, "BROADCAST_WORDS", 0)
    assert sorted(r.restored for r in M.repair(texts).collect()) == want == ["Numéro 17"] * 40


def test_accuracy(spark):
    got = {r.chain: r for r in M.accuracy(frame(spark, CLEAN)).collect()}
    assert set(got) <= {">".join(t) for t in M.TRIALS} and sum(r.n for r in got.values()) == 8
    assert sum(r.n_restored for r in got.values()) >= 5 and M.accuracy(frame(spark, [])).count() == 0
