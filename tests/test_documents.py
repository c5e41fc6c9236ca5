import hashlib

import pytest
from pdf_writer import build, document, lines, stream
from pyspark.sql import functions as F

import __spark_entry__
from vellum.operators.content import Evaluator, operators, page_text
from vellum.operators.fonts import CMap, Font, read_afm
from vellum.plans import relational, tables
from vellum.sources import security
from vellum.sources.document import Document
from vellum.streaming.files import arriving_files


def text_of(data, n=0):
    d = Document(data)
    return page_text(d, d.pages()[n])


# Worked values of the painter: three Courier runs, size, leading, left margin.
@pytest.mark.parametrize(("size", "leading", "left", "text"), [
    (12, 12, 0, " abcdef"), (12, 14.4, 0, " ab\ncd\nef"), (12, 14.4, 72, "\n".join(" " * 9 + t for t in ("ab", "cd", "ef"))),
    (11, 13.2, 72, "\n".join(" " * 10 + t for t in ("ab", "cd", "ef"))), (12, 26.4, 0, " ab\n\ncd\n\nef"),
])
def test_painter(size, leading, left, text):
    assert text_of(document([lines(["ab", "cd", "ef"], size, leading, left)], junk=b"junk\n")) == text


def test_space_rule():
    for gap, want in ((-181, "a b"), (-180, "ab"), (-179, "ab")):
        content = b"BT /F1 12 Tf 72 700 Td [(a) %d (b)] TJ ET" % gap
        assert text_of(document([content])).strip() == want


def test_forms_and_artifacts():
    form = stream(b"BT /F1 12 Tf 72 600 Td (inside) Tj ET /X1 Do", "/Type /XObject /Subtype /Form /Resources <</Font <</F1 3 0 R>> /XObject <</X1 20 0 R>>>>")
    data = document([b"/Artifact BMC BT /F1 12 Tf 72 700 Td (hidden) Tj ET EMC q /X1 Do Q BI /W 1 ID xEIx EI BT /F1 12 Tf 72 500 Td (after) Tj ET"], more={20: form})
    d = Document(data)
    page = d.pages()[0]
    page["page"]["Resources"] = {"XObject": {"X1": d.xref and __import__("vellum.sources.syntax", fromlist=["Ref"]).Ref(20, 0)}}
    runs = Evaluator(d, page).run()
    assert "hidden" not in {r["text"] for r in runs} and {"inside", "after"} <= {r["text"] for r in runs}


def test_operators_run_together():
    assert [o for o, _, _ in operators(b"q BT(x)Tj ET Q f*")] == ["q", "BT", "Tj", "ET", "Q", "f*"]


def test_cross_reference_kinds():
    objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Count 0 /Kids []>>"}
    plain = build(objects)
    newer = plain + b"1 0 obj\n<</Type /Catalog /Pages 2 0 R /Lang (new)>>\nendobj\n"
    at = newer.rfind(b"1 0 obj")
    start = len(newer)
    newer += b"xref\n1 1\n%010d 00000 n \ntrailer\n<</Size 3 /Root 1 0 R /Prev %d>>\nstartxref\n%d\n%%%%EOF" % (at, plain.rfind(b"xref\n0"), start)
    d = Document(newer)
    assert d.root["Lang"] == b"new" and not d.repaired and {r for _, _, r, _, _ in d.revisions} == {0, 1}
    broken = Document(plain.replace(b"startxref", b"startxxxx"))
    assert broken.repaired and broken.root["Type"] == "Catalog"
    members = b"1 0 2 32 " + b"<</Type /Catalog /Pages 2 0 R>>".ljust(32) + b"<</Type /Pages /Count 0 /Kids []>>"
    body = b"%PDF-1.5\n"
    where = {5: len(body)}
    body += b"5 0 obj\n" + stream(members, "/Type /ObjStm /N 2 /First 9") + b"\nendobj\n"
    where[6] = len(body)
    table = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([e]) for k, a, e in ((0, 0, 0), (2, 5, 0), (2, 5, 1), (0, 0, 0), (0, 0, 0), (1, where[5], 0), (1, where[6], 0)))
    rows = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(table[i : i + 4], (bytes(4) + table)[i : i + 4], strict=True)) for i in range(0, len(table), 4))
    body += b"6 0 obj\n" + stream(rows, "/Type /XRef /Size 7 /W [1 2 1] /Root 1 0 R /DecodeParms <</Predictor 12 /Columns 4>>") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % where[6]
    d = Document(body)
    assert not d.repaired and d.object(2)["Count"] == 0


@pytest.mark.parametrize("revision", [2, 3, 4])
def test_encryption(revision):
    password, owner, first = b"", b"secret", b"0123456789abcdef"
    bits, v = (40, 1) if revision == 2 else (128, 2) if revision == 3 else (128, 4)
    n = bits // 8

    def digest(data, rounds):
        k = hashlib.md5(data).digest()
        for _ in range(rounds):
            k = hashlib.md5(k[:n]).digest()
        return k[:n]

    okey = digest((owner + security.PADDING)[:32], 50 if revision > 2 else 0)
    o = (password + security.PADDING)[:32]
    for i in range(20 if revision > 2 else 1):
        o = security.rc4(bytes(b ^ i for b in okey), o)
    key = digest((password + security.PADDING)[:32] + o + (0xFFFFFFFC).to_bytes(4, "little") + first, 50 if revision > 2 else 0)
    if revision == 2:
        u = security.rc4(key, security.PADDING)
    else:
        u = hashlib.md5(security.PADDING + first).digest()
        for i in range(20):
            u = security.rc4(bytes(b ^ i for b in key), u)
        u = u.ljust(32, b"\0")

    def shut(raw, num):
        k = hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if revision == 4 else b"")).digest()[: min(16, n + 5)]
        pad = 16 - len(raw) % 16
        return bytes(16) + security.aes_cbc(k, bytes(16), raw + bytes([pad]) * pad, True) if revision == 4 else security.rc4(k, raw)

    raw = shut(lines(["private"], 12, 14.4, 72), 5)
    more = {5: b"<</Length %d>>\nstream\n" % len(raw) + raw + b"\nendstream"}
    crypt = " /CF <</StdCF <</CFM /AESV2>>>> /StmF /StdCF /StrF /StdCF" if revision == 4 else ""
    data = document([b""], more=more, trailer=f"/ID [<{first.hex()}> <00>] /Encrypt <</Filter /Standard /V {v} /R {revision} /Length {bits} /P -4 /O <{o.hex()}> /U <{u.hex()}>{crypt}>>")
    d = Document(data)
    assert page_text(d, d.pages()[0]).strip() == "private" and d.security.role == "user"
    assert Document(data, ["secret"]).security.role == "user"
    assert d.security.as_owner(b"secret") == key and d.security.as_owner(b"other") is None


def test_cmap_and_fonts():
    m = CMap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfrange <00ff> <00fb> <0102> <0200> <0201> [<0041> <00660069>] endbfrange 1 beginbfchar <0300> <D83DDE00> endbfchar")
    assert m.get(2, 0xFC) == "ă" and m.get(2, 0x201) == "fi" and m.get(2, 0x300) == "😀" and m.get(2, 0x400) is None
    d = Document(document([b""]))
    f = Font(d, {"Subtype": "Type1", "BaseFont": "ABCDEF+Helvetica"})
    assert f.characters(b"A ")[0][:2] == ("A", 667.0) and f.characters(b" ")[0][2]
    afm = read_afm("FontName X\nItalicAngle -12\nIsFixedPitch true\nC 65 ; WX 700 ; N A ; B 0 0 1 1 ;\nKPX A V -70\n")
    assert afm["widths"] == {"A": 700.0} and afm["kerns"] == {("A", "V"): -70.0} and Font(d, {"BaseFont": "X"}, {"X": afm}).flags == 0x41


RICH = {90: b"<</First 91 0 R>>", 91: b"<</Title (One) /Dest [6 0 R /XYZ 1 null 2] /Next 91 0 R>>", 92: b"<</Producer (me) /CreationDate (D:20200102) /ModDate (bad)>>", 93: b"<</Type /Filespec /F (a.txt) /EF <</F 94 0 R>>>>", 94: stream(b"attached"), 95: b"<</FT /Sig /T (s) /P 4 0 R /V <</Type /Sig /SubFilter /adbe.pkcs7.detached /ByteRange [0 5 7 3] /M (D:2020) /Contents <00>>>>>"}
CATALOG = "/PageLabels <</Nums [0 <</S /r>> 1 <</S /D /P (A-) /St 5>>]>> /Outlines 90 0 R /Names <</EmbeddedFiles <</Names [(a) 93 0 R]>>>> /AcroForm <</SigFlags 1 /Fields [95 0 R]>>"


def test_tables(spark):
    pdf = document([lines(["Hello (x)", "World"], left=72)] * 2, catalog=CATALOG, more=RICH, trailer="/Info 92 0 R")
    files = spark.createDataFrame([("a.pdf", bytearray(pdf)), ("bad.pdf", bytearray(b"nothing")), ("null.pdf", None)], "path string, content binary")
    docs = {r.path: r for r in tables.documents(files).collect()}
    assert docs["a.pdf"].page_count == 2 and docs["a.pdf"].has_signature and docs["bad.pdf"].error and docs["null.pdf"].error
    assert [r.label for r in tables.pages(files).orderBy("page_no").collect()] == ["i", "A-5"]
    assert [r.text.split() for r in tables.page_text(files).where("error is null").collect()] == [["Hello", "(x)", "World"]] * 2
    assert {r.key for r in tables.info(files).collect()} == {"Producer", "CreationDate"}
    o = tables.outlines(files).collect()
    assert len(o) == 1 and o[0].title == "One" and o[0].dest_page == 2 and list(o[0]["values"]) == [1, 0, 2]
    assert tables.attachments(files).first().content == b"attached"
    s = tables.signatures(files).first()
    assert s.fqt == "s" and s.page_no == 1 and s.sha256 == hashlib.sha256(pdf[:5] + pdf[7:10]).hexdigest() and not s.covers_file
    assert tables.fonts(files).first().missing_width == 600 and tables.page_labels(files).count() == 2
    assert tables.edges(files).where("from_num = 1 and key = 'Pages'").first().to_num == 2
    assert tables.text_runs(files).count() == 4 and tables.content_operators(files).where("op = 'Tj'").count() == 4
    assert tables.objects(files, streams=True).where("num = 94").first().data == b"attached"
    x = relational.newest_wins(tables.xref(files), ["path", "num"], "rev")
    assert x.count() == 96


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(document([lines(["streamed"], left=72)]))
    q = tables.page_text(arriving_files(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("arrived").first().text.strip() == "streamed"
    assert tables.pdf_files(spark, str(tmp_path / "in")).count() == 1


def test_relational(spark):
    rows = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    ranges = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c")], "k int, s int, v string")
    assert {(r.k, r.t, r.v) for r in relational.as_of(rows, ranges, ["k"], "t", "s", ["v"]).collect()} == {(1, 5, "b"), (1, 1, None), (2, 9, None)}
    bands = spark.createDataFrame([(1, 3, "x"), (8, 9, "y")], "lo int, hi int, v string")
    got = relational.in_range(rows, bands, "t", "lo", "hi", {"v": F.lit("-")}).collect()
    assert {(r.t, r.v) for r in got} == {(5, "-"), (1, "x"), (9, "y")}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
