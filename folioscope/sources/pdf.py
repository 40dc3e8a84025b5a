"""A small PDF reader: text spans and page counters, as a Spark data source.

It understands classic and object streams, FlateDecode, inherited page attributes and the text
operators; widths are estimated from the font size. ``write_pdf`` makes files for tests.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPAN_SCHEMA = "path string, span_idx int, text string, x0 double, y0 double, x1 double, y1 double, page int, font_size double, is_bold boolean, is_italic boolean"
PAGE_SCHEMA = "path string, page int, text_ops int, images int, has_images boolean, has_template boolean, unique_chars int, unique_alnum int, path_ops int, identity_h boolean, type3_only boolean, decodable boolean, font_changes int"
# Fixed value: operators that build or paint paths.
PATH_OPS = frozenset(b"m l c v y h re f F S s B B* b b* n".split())
PAGE_GAP = 50.0
_WHITE, _DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)endobj", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}


class NoSpans(ValueError):
    """The file is a PDF without any text span."""


class Ref(int):
    """Number of an indirect object."""


class Name(str):
    """A PDF name."""


class Operator(bytes):
    """An operator of a content stream."""


# ---------------------------------------------------------------- tokens


def _string_end(data: bytes, at: int) -> int:
    depth = 1
    while at < len(data) and depth:
        c = data[at : at + 1]
        if c == b"\\":
            at += 1
        elif c == b"(":
            depth += 1
        elif c == b")":
            depth -= 1
        at += 1
    return at


def _unescape(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m.group(1)
        if x.isdigit():
            return bytes([int(x, 8) & 255])
        return _ESCAPES.get(x, b"" if x in b"\r\n" else x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.S)


def tokens(data: bytes) -> Iterator:
    """Values and operators of PDF syntax: dicts, lists, bytes (strings), Name, numbers, Operator."""
    stack: list[list] = []
    at, n = 0, len(data)

    def closed(kind: str):
        while stack:
            top = stack.pop()
            if top[0] == kind:
                return top
        return None

    while at < n:
        c = data[at : at + 1]
        value = None
        if c in (b"\x00", b"\t", b"\n", b"\x0c", b"\r", b" "):
            at += 1
            continue
        if c == b"%":
            while at < n and data[at] not in b"\r\n":
                at += 1
            continue
        if c == b"(":
            end = _string_end(data, at + 1)
            value, at = _unescape(data[at + 1 : end - 1]), end
        elif data[at : at + 2] == b"<<":
            stack.append(["dict"])
            at += 2
            continue
        elif data[at : at + 2] == b">>":
            at += 2
            top = closed("dict")
            if top is None:
                continue
            items = top[1:]
            value = {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}
        elif c == b"<":
            end = data.find(b">", at)
            end = n if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            value, at = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
        elif c == b"[":
            stack.append(["list"])
            at += 1
            continue
        elif c == b"]":
            at += 1
            top = closed("list")
            if top is None:
                continue
            value = top[1:]
        elif c == b"/":
            end = at + 1
            while end < n and data[end] not in _WHITE and data[end] not in _DELIMITERS:
                end += 1
            value, at = Name(data[at + 1 : end].decode("latin-1")), end
        elif c in (b")", b">", b"{", b"}"):
            at += 1
            continue
        else:
            end = at
            while end < n and data[end] not in _WHITE and data[end] not in _DELIMITERS:
                end += 1
            word, at = data[at:end], end
            try:
                value = float(word) if b"." in word else int(word)
            except ValueError:
                if word == b"R" and stack and len(stack[-1]) >= 3 and all(isinstance(x, int) for x in stack[-1][-2:]):
                    top = stack[-1]
                    top[-2:] = [Ref(top[-2])]
                    continue
                value = {b"true": True, b"false": False, b"null": None}.get(word, Operator(word))
        if stack:
            stack[-1].append(value)
        else:
            yield value


# ---------------------------------------------------------------- documents


class Document:
    """Objects of a PDF file by number; streams are decoded when asked for."""

    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.values: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for m in _OBJECT.finditer(data):
            self._add(int(m.group(1)), m.group(3))
        for num, value in list(self.values.items()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._unpack(num, value)

    def _add(self, num: int, body: bytes) -> None:
        cut = re.search(rb">>\s*stream\r?\n", body)
        head = body[: cut.start() + 2] if cut else body
        value = next(iter(tokens(b"[" + head + b"]")), [None])
        self.values[num] = value[0] if value else None
        if cut:
            raw = body[cut.end() :]
            end = raw.rfind(b"endstream")
            self.streams[num] = raw[:end] if end >= 0 else raw

    def _unpack(self, num: int, head: dict) -> None:
        data = self.stream(num)
        first, count = int(self.get(head.get("First")) or 0), int(self.get(head.get("N")) or 0)
        numbers = [int(x) for x in data[:first].split()[: 2 * count]]
        starts = [*numbers[1::2], len(data) - first]
        for obj, lo, hi in zip(numbers[::2], starts, starts[1:]):
            value = next(iter(tokens(b"[" + data[first + lo : first + hi] + b"]")), [None])
            self.values.setdefault(obj, value[0] if value else None)

    def get(self, value):
        for _ in range(16):
            if not isinstance(value, Ref):
                return value
            value = self.values.get(int(value))
        return None

    def stream(self, num: int) -> bytes:
        raw, head = self.streams.get(num, b""), self.values.get(num)
        filters = self.get(head.get("Filter")) if isinstance(head, dict) else None
        for f in filters if isinstance(filters, list) else [filters]:
            if f == "FlateDecode":
                try:
                    raw = zlib.decompressobj().decompress(raw)
                except zlib.error:
                    return b""
        return raw

    def pages(self) -> list[dict]:
        """Page dictionaries in reading order, with what they inherit."""
        out: list[dict] = []
        seen: set[int] = set()

        def visit(ref, inherited: dict) -> None:
            if isinstance(ref, Ref):
                if int(ref) in seen:
                    return
                seen.add(int(ref))
            node = self.get(ref)
            if not isinstance(node, dict):
                return
            have = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if node.get("Type") == "Page" or "Kids" not in node:
                out.append(have | node)
            else:
                for kid in self.get(node["Kids"]) or []:
                    visit(kid, have)

        catalog = next((v for v in self.values.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if catalog:
            visit(catalog.get("Pages"), {})
        return out or [v for v in self.values.values() if isinstance(v, dict) and v.get("Type") == "Page"]

    def content(self, page: dict) -> bytes:
        c = page.get("Contents")
        parts = c if isinstance(c, list) else self.get(c) if isinstance(self.get(c), list) else [c]
        return b"\n".join(self.stream(int(p)) for p in parts if isinstance(p, Ref))

    def resources(self, page: dict, kind: str) -> dict:
        res = self.get(page.get("Resources"))
        found = self.get(res.get(kind)) if isinstance(res, dict) else None
        return found if isinstance(found, dict) else {}


def _multiply(a: tuple, b: tuple) -> tuple:
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


class Font:
    """How a font's codes read and how wide they are, in thousandths of its size."""

    def __init__(self, doc: Document, ref):
        font = doc.get(ref)
        font = font if isinstance(font, dict) else {}
        self.bold, self.italic = font_style(doc, ref)
        self.pairs = font.get("Subtype") == "Type0"
        self.widths: dict[int, float] = {}
        self.usual = 500.0
        to_unicode = font.get("ToUnicode")
        self.texts = code_texts(doc.stream(int(to_unicode))) if isinstance(to_unicode, Ref) else {}
        if self.pairs:
            inner = doc.get((doc.get(font.get("DescendantFonts")) or [None])[0])
            inner = inner if isinstance(inner, dict) else {}
            self.usual = _number(doc.get(inner.get("DW")), 1000.0)
            self._spread(doc, doc.get(inner.get("W")) or [])
        else:
            first = int(_number(doc.get(font.get("FirstChar")), 0))
            for k, w in enumerate(doc.get(font.get("Widths")) or []):
                self.widths[first + k] = _number(doc.get(w), self.usual)

    def _spread(self, doc: Document, items: list) -> None:
        """Widths of a composite font: a code and a list of widths, or two codes and one width."""
        at = 0
        while at + 1 < len(items):
            low, second = doc.get(items[at]), doc.get(items[at + 1])
            if isinstance(second, list):
                for k, w in enumerate(second):
                    self.widths[int(_number(low, 0)) + k] = _number(doc.get(w), self.usual)
                at += 2
            elif at + 2 < len(items):
                last = min(int(_number(second, 0)), 0xFFFF)
                for code in range(int(_number(low, 0)), last + 1):
                    self.widths[code] = _number(doc.get(items[at + 2]), self.usual)
                at += 3
            else:
                break

    def read(self, raw: bytes) -> tuple[str, float]:
        """(text, width in sizes) of a shown string."""
        if raw[:2] == b"\xfe\xff" and not self.texts:
            text = raw[2:].decode("utf-16-be", "replace")
            return text, len(text) * self.usual / 1000
        codes = [raw[k] << 8 | raw[k + 1] for k in range(0, len(raw) - 1, 2)] if self.pairs else list(raw)
        width = sum(self.widths.get(c, self.usual) for c in codes) / 1000
        if self.texts:
            return "".join(self.texts.get(c) or ("" if self.pairs else bytes([c]).decode("cp1252", "replace")) for c in codes), width
        return raw.decode("utf-16-be" if self.pairs else "cp1252", "replace"), width


def _number(value, other: float) -> float:
    return float(value) if isinstance(value, (int, float)) else other


def code_texts(cmap: bytes) -> dict[int, str]:
    """The texts of codes that a ToUnicode table gives, one by one or in ranges."""
    out: dict[int, str] = {}
    values: list = []
    read = lambda b: b.decode("utf-16-be", "replace")
    for t in tokens(cmap):
        if not isinstance(t, Operator):
            values.append(t)
            continue
        if t == b"endbfchar":
            for code, text in zip(values[::2], values[1::2]):
                if isinstance(code, bytes) and isinstance(text, bytes):
                    out[int.from_bytes(code, "big")] = read(text)
        elif t == b"endbfrange":
            for low, high, text in zip(values[::3], values[1::3], values[2::3]):
                if not (isinstance(low, bytes) and isinstance(high, bytes)):
                    continue
                codes = range(int.from_bytes(low, "big"), min(int.from_bytes(high, "big"), 0xFFFF) + 1)
                if isinstance(text, list):
                    out.update((c, read(x)) for c, x in zip(codes, text) if isinstance(x, bytes))
                elif isinstance(text, bytes) and len(text) >= 2:
                    for k, c in enumerate(codes):
                        last = int.from_bytes(text[-2:], "big") + k
                        out[c] = read(text[:-2] + min(last, 0xFFFF).to_bytes(2, "big"))
        values = []
    return out


def page_spans(doc: Document, page: dict) -> list[tuple]:
    """(text, x0, y0, x1, y1, size, bold, italic) of the shown strings, in order."""
    fonts = {k: Font(doc, v) for k, v in doc.resources(page, "Font").items()}
    none = Font(doc, None)
    spans, args = [], []
    matrix = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, saved = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), []
    size, lead, font = 0.0, 0.0, none

    def show(parts: list) -> None:
        """Strings shown one after the other; numbers between them move back by thousandths of the size."""
        nonlocal matrix
        text, width = "", 0.0
        for part in parts:
            if isinstance(part, bytes):
                t, w = font.read(part)
                text, width = text + t, width + w * size
            elif isinstance(part, (int, float)):
                text, width = text + (" " if part < -250 else ""), width - part / 1000 * size
        m = _multiply(matrix, ctm)
        scale = abs(m[3]) or abs(m[1]) or 1.0
        if text.strip():
            spans.append((text, m[4], m[5], m[4] + width * (abs(m[0]) or scale), m[5] + size * scale, size * scale, font.bold, font.italic))
        matrix = _multiply((1.0, 0.0, 0.0, 1.0, width, 0.0), matrix)

    for t in tokens(doc.content(page)):
        if not isinstance(t, Operator):
            args.append(t)
            continue
        try:
            if t == b"BT":
                matrix = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            elif t == b"Tf":
                size, font = float(args[-1]), fonts.get(args[-2], none)
            elif t in (b"Td", b"TD"):
                lead = -float(args[-1]) if t == b"TD" else lead
                matrix = line = _multiply((1.0, 0.0, 0.0, 1.0, float(args[-2]), float(args[-1])), line)
            elif t == b"Tm":
                matrix = line = tuple(float(x) for x in args[-6:])
            elif t == b"TL":
                lead = float(args[-1])
            elif t in (b"T*", b"'", b'"'):
                matrix = line = _multiply((1.0, 0.0, 0.0, 1.0, 0.0, -lead), line)
                if t != b"T*":
                    show([args[-1]])
            elif t == b"Tj":
                show([args[-1]])
            elif t == b"TJ":
                show(args[-1])
            elif t == b"cm":
                ctm = _multiply(tuple(float(x) for x in args[-6:]), ctm)
            elif t == b"q":
                saved.append(ctm)
            elif t == b"Q" and saved:
                ctm = saved.pop()
        except (IndexError, TypeError, ValueError):
            pass
        args = []
    return spans


def font_style(doc: Document, ref) -> tuple[bool, bool]:
    font = doc.get(ref)
    base = str(font.get("BaseFont", "")).lower() if isinstance(font, dict) else ""
    return "bold" in base, "italic" in base or "oblique" in base


def file_spans(data: bytes) -> list[tuple]:
    """(span_idx, text, x0, y0, x1, y1, page, size, bold, italic); each page lies above the ones
    before it, which take their height and a gap. Pages that can't be read are skipped."""
    doc, out, offset = Document(data), [], 0.0
    for number, page in enumerate(doc.pages(), 1):
        try:
            spans = page_spans(doc, page)
        except (ValueError, RecursionError):
            continue
        if not spans:
            continue
        height = max(0.0, max(s[4] for s in spans)) - min(s[2] for s in spans)
        for text, x0, y0, x1, y1, size, bold, italic in spans:
            out.append((len(out), text, x0, y0 + offset, x1, y1 + offset, number, size, bold, italic))
        if height > 0:
            offset += height + PAGE_GAP
    if not out:
        raise NoSpans("no text spans")
    return out


def scan_content(content: bytes) -> dict[str, int]:
    """Counts of a content stream. Strings inside arrays add no signs, as only whole operands count."""
    ops = {"text_ops": 0, "font_changes": 0, "images": 0, "path_ops": 0}
    signs: set[int] = set()
    for t in tokens(content):
        if isinstance(t, Operator):
            kind = {b"Tj": "text_ops", b"TJ": "text_ops", b"Tf": "font_changes", b"Do": "images"}.get(bytes(t))
            if kind:
                ops[kind] += 1
            elif bytes(t) in PATH_OPS:
                ops["path_ops"] += 1
        elif isinstance(t, bytes):
            signs.update(t)
    signs -= set(_WHITE)
    alnum = sum(48 <= s <= 57 or 65 <= s <= 90 or 97 <= s <= 122 for s in signs)
    return ops | {"unique_chars": len(signs), "unique_alnum": alnum}


def file_pages(data: bytes) -> list[tuple]:
    """The page counters that classification works on."""
    doc, out = Document(data), []
    for number, page in enumerate(doc.pages(), 1):
        c = scan_content(doc.content(page))
        box = doc.get(page.get("MediaBox"))
        sides = [float(x) for x in box] if isinstance(box, list) and len(box) == 4 and all(isinstance(x, (int, float)) for x in box) else [0, 0, 612, 792]
        area = abs(sides[2] - sides[0]) * abs(sides[3] - sides[1])
        pictures = [o for o in map(doc.get, doc.resources(page, "XObject").values()) if isinstance(o, dict) and o.get("Subtype") == "Image"]
        template = any(float(doc.get(o.get("Width")) or 0) * float(doc.get(o.get("Height")) or 0) >= area / 2 > 0 for o in pictures)
        fonts = [f for f in map(doc.get, doc.resources(page, "Font").values()) if isinstance(f, dict)]
        shown = c["text_ops"] > 0
        type0 = [f for f in fonts if f.get("Subtype") == "Type0"]
        blind = [f for f in type0 if f.get("Encoding") in ("Identity-H", "Identity-V") and "ToUnicode" not in f]
        type3 = [f for f in fonts if f.get("Subtype") == "Type3"]
        readable = len(blind) < len(type0) or any("ToUnicode" in f for f in type3) or any(f.get("Subtype") in ("Type1", "TrueType", "MMType1", "Type1C") for f in fonts)
        only3 = bool(type3) and len(type3) == len(fonts) and not any("ToUnicode" in f for f in type3)
        out.append((number, c["text_ops"], c["images"], bool(pictures), template, c["unique_chars"], c["unique_alnum"], c["path_ops"], shown and bool(blind), shown and only3, shown and readable, c["font_changes"]))
    return out


# ---------------------------------------------------------------- Spark


def _read(kind: str):
    def read(batches):
        import pandas as pd

        for pdf in batches:
            rows, bad = [], []
            for path, content in zip(pdf.path, pdf.content):
                try:
                    got = file_spans(bytes(content)) if kind == "spans" else file_pages(bytes(content))
                    rows += [(path, *r, None) for r in got]
                except Exception as e:  # noqa: BLE001 - any damage of a file ends in the dead letters
                    bad.append((path, f"{type(e).__name__}: {e}"))
            names = [c.split(" ")[0] for c in (SPAN_SCHEMA if kind == "spans" else PAGE_SCHEMA).split(", ")]
            width = len(names)
            rows += [(p, *[None] * (width - 1), e) for p, e in bad]
            yield pd.DataFrame(rows, columns=[*names, "error"]).astype(object)

    return read


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """The PDF files of a folder (names end in .pdf, in this case) as path and content; none where
    the folder has none."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", recursive)
    try:
        return reader.load(folder if recursive else f"{folder}/*.pdf").select("path", "content")
    except AnalysisException:
        return spark.createDataFrame([], "path string, content binary")


def parse_files(files: DataFrame, kind: str = "spans") -> DataFrame:
    """files(path, content) as spans or page counters, with ``error`` for files that can't be read."""
    schema = SPAN_SCHEMA if kind == "spans" else PAGE_SCHEMA
    return files.select("path", "content").mapInPandas(_read(kind), schema + ", error string")


def parse_times(files: DataFrame) -> DataFrame:
    """(path, ms) of files(path, content): how long each takes to read, for files that can be read."""

    def timed(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, data in zip(pdf.path, pdf.content):
                began = time.perf_counter()
                try:
                    file_spans(bytes(data))
                except Exception:  # noqa: BLE001 - told by parse_files
                    continue
                rows.append((path, (time.perf_counter() - began) * 1000))
            yield pd.DataFrame(rows, columns=["path", "ms"])

    return files.select("path", "content").mapInPandas(timed, "path string, ms double")


def made_pdfs(pages: DataFrame, key: str) -> DataFrame:
    """(path, content) of PDF files made of pages(key, page, spans), ``spans`` an array of
    struct(x, y, size, text, bold); pages in their order, ``path`` the key as text."""

    def make(batches):
        import pandas as pd

        for pdf in batches:
            content = [write_pdf([[tuple(s[k] for k in ("x", "y", "size", "text", "bold")) for s in p["spans"]] for p in ps]) for ps in pdf["pages"]]
            yield pd.DataFrame({"path": pdf["path"], "content": content})

    whole = pages.groupBy(F.col(key).cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("page", "spans"))).alias("pages"))
    return whole.mapInPandas(make, "path string, content binary")


def read_spans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(spans with doc_id from the path, dead letters (path, stage, error))."""
    rows = parse_files(list_files(spark, folder))
    good = rows.where("error IS NULL").drop("error").withColumn("doc_id", F.xxhash64("path"))
    return good, rows.where("error IS NOT NULL").select("path", F.lit("ingestion").alias("stage"), "error")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.kind = options.get("path", ""), options.get("kind", "spans")

    def partitions(self):
        import glob
        import os

        folder = self.folder.removeprefix("file:")
        return [_File(p) for p in sorted(glob.glob(os.path.join(folder, "*.pdf")))]

    def read(self, partition):
        schema = SPAN_SCHEMA if self.kind == "spans" else PAGE_SCHEMA
        try:
            with open(partition.path, "rb") as f:
                data = f.read()
            for r in file_spans(data) if self.kind == "spans" else file_pages(data):
                yield (partition.path, *r, None)
        except Exception as e:  # noqa: BLE001 - a damaged file is a dead letter, whatever is wrong with it
            yield (partition.path, *[None] * schema.count(","), f"{type(e).__name__}: {e}")


class PdfSource(DataSource):
    """``spark.read.format("pdf_spans").option("kind", "spans"|"pages").load(folder)``; for folders
    that every executor sees under one path; files that can't be read have a row with ``error``, as in
    ``parse_files``. ``list_files`` reads any file system."""

    @classmethod
    def name(cls) -> str:
        return "pdf_spans"

    def schema(self) -> str:
        return (PAGE_SCHEMA if self.options.get("kind") == "pages" else SPAN_SCHEMA) + ", error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


# ---------------------------------------------------------------- writer for tests


def write_pdf(pages: list[list[tuple[float, float, float, str, bool]]], compress: bool = True) -> bytes:
    """A PDF of pages of (x, y, size, text, bold)."""
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    catalog, tree = add(b""), add(b"")
    plain = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    strong = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>")
    kids = []
    for spans in pages:
        lines = []
        for x, y, size, text, bold in spans:
            raw = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            lines.append(b"BT /%s %g Tf %g %g Td (%s) Tj ET" % (b"F2" if bold else b"F1", size, x, y, raw))
        data = b"\n".join(lines)
        data, how = (zlib.compress(data), b" /Filter /FlateDecode") if compress else (data, b"")
        stream = add(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), how, data))
        kids.append(add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 612 792] /Contents %d 0 R /Resources << /Font << /F1 %d 0 R /F2 %d 0 R >> >> >>" % (tree, stream, plain, strong)))
    objects[catalog - 1] = b"<< /Type /Catalog /Pages %d 0 R >>" % tree
    objects[tree - 1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, starts = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        starts.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % s for s in starts)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, catalog, len(out))
