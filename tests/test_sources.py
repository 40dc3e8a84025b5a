import os

import pytest

from folioscope import cli, config
from folioscope.operators import extract, quality
from folioscope.sources import pdf, tables
from folioscope.streaming import watch

PAGE = [(50, 750, 20, "INVOICE", True), (50, 700, 12, "Invoice Number:", True), (180, 700, 12, "INV-(7)\\x", False), (50, 680, 12, "Date:", False), (180, 680, 12, "2026-05-23", False), (400, 400, 12, "Total:", False), (500, 400, 12, "$500.50", False)]
SECOND = [(50, 700, 12, "Page two", False)]


@pytest.fixture()
def folder(tmp_path):
    for name, pages, packed in (("a", [PAGE, SECOND], True), ("b", [[(x + 9, y - 40, s, t, b) for x, y, s, t, b in PAGE], [], SECOND], False)):
        (tmp_path / f"{name}.pdf").write_bytes(pdf.write_pdf(pages, packed))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    (tmp_path / "blank.pdf").write_bytes(pdf.write_pdf([[]]))
    (tmp_path / "other.PDF").write_bytes(b"%PDF")
    return str(tmp_path)


def test_spans_and_pages(spark, folder):
    spans, failed = pdf.read_spans(spark, folder)
    rows = spans.where("path LIKE '%a.pdf'").orderBy("span_idx").collect()
    assert [r.text for r in rows] == [t for _, _, _, t, _ in [*PAGE, *SECOND]] and rows[0].is_bold and rows[7].y0 == 700 + 370 + 50
    assert spans.where("path LIKE '%b.pdf' AND page = 3").count() == 1
    assert sorted(os.path.basename(r.path) for r in failed.collect()) == ["bad.pdf", "blank.pdf"]
    pages = pdf.parse_files(pdf.list_files(spark, folder), "pages").where("error IS NULL").withColumnRenamed("path", "doc_id")
    kinds = {os.path.basename(r.doc_id): r.pdf_type for r in quality.classify_pages(pages).collect()}
    assert kinds["blank.pdf"] == "scanned" and kinds["a.pdf"] == "text"


def test_data_source(spark, folder):
    spark.dataSource.register(pdf.PdfSource)
    spans, _ = pdf.read_spans(spark, folder)
    read = spark.read.format("pdf_spans").load(folder)
    assert read.where("error IS NULL").count() == spans.count()
    assert sorted(os.path.basename(r.path) for r in read.where("error IS NOT NULL").collect()) == ["bad.pdf", "blank.pdf"]
    pages = spark.read.format("pdf_spans").option("kind", "pages").load(folder)
    assert pages.where("error IS NULL").count() == 6 and pages.where("error IS NOT NULL").count() == 1


def test_content_counts():
    c = pdf.scan_content(b"BT /F1 12 Tf 72 712 Td (Invoice \\(1\\)) Tj ET q /Im1 Do Q [ (a) -3 (b) ] TJ 1 2 m 3 4 l S << /A (x) >> % c\n <41> Tj ) ]")
    assert (c["text_ops"], c["images"], c["font_changes"], c["path_ops"]) == (3, 1, 1, 3)
    assert pdf.scan_content(b"") == {"text_ops": 0, "font_changes": 0, "images": 0, "path_ops": 0, "unique_chars": 0, "unique_alnum": 0}
    for junk in (b"((((", b"<<<<", b"[[[", b"\\", bytes(range(256)) * 3):
        pdf.scan_content(junk)


def test_stream_once_per_file(spark, folder):
    out, ck = folder + "/out", folder + "/ck"
    for _ in range(2):
        watch.watch(spark, folder, out, ck, files_per_batch=2, available_now=True).awaitTermination()
    got = spark.read.parquet(out + "/records").collect()
    assert len(got) == 2 and all('"total":"$500.50"' in r.fields for r in got)
    assert spark.read.parquet(out + "/failures").count() == 2


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([(1, {"a": 'x"y'}), (2, {"b": None})], "doc_id long, fields map<string,string>")
    for form in ("parquet", "json", "csv"):
        tables.write_records(r, f"{tmp_path}/{form}", form)
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 2
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").where("doc_id = '1'").first().fields == '{"a":"x\\"y"}'
    import pyarrow.ipc as ipc

    assert tables.to_arrow_file(r, f"{tmp_path}/x.arrow", 10) == 2 and ipc.open_file(f"{tmp_path}/x.arrow").read_all().num_rows == 2
    with pytest.raises(ValueError):
        tables.to_arrow_file(r, f"{tmp_path}/y.arrow", 1)


def test_call_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"model":"m","latency_ms":3,"success":true,"timestamp":"2"}\nbroken\n{"model":"n","timestamp":"1"}\n')
    calls = tables.read_call_log(spark, str(tmp_path / "log.jsonl"))
    assert sorted(r.model for r in calls.collect()) == ["m", "n"]
    assert tables.read_call_log(spark, str(tmp_path / "log.jsonl"), 1).first().model == "m"


def test_ground_truth(spark, folder):
    with open(f"{folder}/a.ground_truth.json", "w") as f:
        f.write('{"fields": ["total"],\n "kv": [["Total", "$500.50"]]}')
    rows = tables.read_ground_truth(spark, folder).collect()
    assert [(r.stem, r.fields) for r in rows] == [("a", ["total"])]


def test_layout_table(spark, tmp_path):
    t = spark.createDataFrame([("a", 3), ("b", 2), ("c", 3)], "layout_id string, cache_version int")
    tables.store_layouts(t, f"{tmp_path}/l")
    tables.remove_layouts(spark, f"{tmp_path}/l", f"{tmp_path}/m", t.where("layout_id = 'a'"))
    assert sorted(r.layout_id for r in spark.read.parquet(f"{tmp_path}/m").collect()) == ["b", "c"]


def test_settings(tmp_path):
    f = tmp_path / "s.toml"
    f.write_text('[core]\nx_bucket = 4\nmax_spans = "7"\n[router]\nanchor_keywords = ["po"]\n')
    s = config.load(str(f), {"FOLIOSCOPE_MAX_SPANS": "9", "FOLIOSCOPE_PRECOMPILE": "yes"}, x_bucket=2.5)
    assert (s.x_bucket, s.max_spans, s.precompile, s.anchor_keywords) == (2.5, 9, True, ("po",))
    f.write_text("not toml [")
    assert config.load(str(f), {"FOLIOSCOPE_MAX_SPANS": "many"}) == config.Settings()


def test_command_line(spark, folder, capsys):
    assert cli.main(["batch", folder, folder + "/o", "--format", "json"], spark) == 0
    assert '"failed": 2' in capsys.readouterr().out
    assert spark.read.json(folder + "/o/records").count() == 2
    cli.main(["ingest", folder, "--layouts", folder + "/layouts"], spark)
    cli.main(["ingest", folder, "--layouts", folder + "/layouts"], spark)
    assert '{"new_layouts": 0}' in capsys.readouterr().out
    cli.main(["grid", folder, folder + "/grid"], spark)
    cli.main(["classify", folder, folder + "/kinds"], spark)
    cli.main(["cache", "list", "--layouts", folder + "/layouts"], spark)
    cli.main(["cache", "clear", "--layouts", folder + "/layouts"], spark)
    cli.main(["status"], spark)
    cli.main(["benchmark", folder], spark)
    assert spark.read.parquet(folder + "/grid").where("line LIKE '%INVOICE%'").count() == 2


def test_schema_with_arrays():
    scalars, arrays = extract.compile_schema('{"bill_to":"string","rows":{"type":"array","columns":{"B":"b","A":"a"}}}')
    assert scalars == [("bill_to", "Bill To:")] and arrays[0]["columns"] == [("A", "a"), ("B", "b")]
    assert [f for f, _ in extract.compile_schema("{}")[0]] == ["date", "invoice_number", "total"]


def test_texts_of_codes_and_widths():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0004> <00660069> endbfchar 2 beginbfrange <0024> <0026> <0041> <0030> <0031> [<0431> <0432>] endbfrange"
    assert pdf.code_texts(cmap) == {3: " ", 4: "fi", 0x24: "A", 0x25: "B", 0x26: "C", 0x30: "б", 0x31: "в"}
    stream = b"BT /F1 10 Tf 50 700 Td <002400250030> Tj ET BT /F2 10 Tf 50 600 Td [ (AB) -1000 (A) ] TJ ET"
    data = b"".join([
        b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Count 1 /Kids [3 0 R] >>\nendobj\n",
        b"3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R /F2 8 0 R >> >> >>\nendobj\n",
        b"4 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(stream), stream),
        b"5 0 obj\n<< /Type /Font /Subtype /Type0 /BaseFont /X-BoldItalic /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>\nendobj\n",
        b"6 0 obj\n<< /Type /Font /Subtype /CIDFontType2 /DW 300 /W [36 [600 700] 48 49 900] >>\nendobj\n",
        b"7 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(cmap), cmap),
        b"8 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 65 /Widths [600 400] >>\nendobj\n",
    ])
    a, b = pdf.file_spans(data)
    assert a[1] == "ABб" and a[4] - a[2] == pytest.approx(22.0) and a[8] and a[9]
    assert b[1] == "AB A" and b[4] - b[2] == pytest.approx(6 + 4 + 10 + 6)
