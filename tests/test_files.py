"""Odd and damaged files, bounds, hooks, fonts and security beyond what the driver queries cover."""

import hashlib
import shutil
import subprocess
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.functions import filters, scalars
from vellum.operators import content
from vellum.operators.content import Evaluator, grouped, page_text
from vellum.operators.fonts import Font, core_widths, kern, read_afm
from vellum.plans import relational, tables
from vellum.sources import certificates, document, security
from vellum.sources.document import BadFile, Document
from vellum.sources.syntax import Name, Parser, Ref, Stream
from vellum.sources.writer import COURIER, Encryption, RecipientEncryption, Writer, certificate, fixture_key, flate, key_file, pages_pdf, pem, rsa_sign, signed_data, signed_pdf, text_pdf, utf16


def text_of(pdf, **options):
    d = Document(pdf)
    e = Evaluator(d, d.pages()[0], **options)
    return content.paint(e.run(), e.profile).strip()


def files_of(spark, **contents):
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in contents.items()], "path string, content binary")


def test_bad_files_give_rows(spark, tmp_path, monkeypatch):
    bomb = Writer()
    bomb.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(bytes(300 << 20), 9)))
    deep = pages_pdf([b"q " * 10 + b"[" * 400])
    files = files_of(spark, good=text_pdf("fine"), huge=text_pdf("x", size="9" * 400), far=text_pdf("x", after=b" 0 -20000000 Td (y) Tj"), wide=text_pdf("x", after=b" 90000000 0 Td (y) Tj"), none=None, empty=b"", deep=deep, junk=b"\xff" * 100, late=text_pdf("late", junk=b"z" * 5000), root=text_pdf("x").replace(b"/Root", b"/Rooo"))
    rows = {r.path: r for r in tables.page_text(files).collect()}
    assert {k for k, r in rows.items() if r.error is None} == {"good", "late", "root"} and rows["late"].text.strip() == "late"
    assert "too large" in rows["far"].error and "too large" in rows["wide"].error and "missing" in rows["none"].error
    with pytest.raises(filters.TooLarge):
        filters.flate(bomb.objects[1].raw)
    monkeypatch.setattr(filters, "MOST_BYTES", 1000)
    for name, data in (("RL", bytes([129, 0]) * 100), ("LZW", __import__("vellum.queries", fromlist=["x"]).lzw_encode(bytes(5000)))):
        with pytest.raises(filters.TooLarge):
            filters.decode(data, [name])
    (tmp_path / "a.pdf").write_bytes(text_pdf(" ".join(map(str, range(3000)))))
    (tmp_path / "b.pdf").write_bytes(text_pdf("b"))
    got = {r.path[-5:]: r.error for r in tables.page_text(tables.pdf_files(spark, str(tmp_path), most_bytes=1500)).collect()}
    assert got["b.pdf"] is None and "too large" in got["a.pdf"]


def test_trees_have_bounds(monkeypatch):
    w = Writer()
    root, tree = w.add(), w.add()
    kids = [w.add({"Type": Name("Page"), "Parent": tree}) for _ in range(20)]
    items = [w.add() for _ in range(20)]
    for i, r in enumerate(items):  # each below the one before, and back to the first
        w.put(r, {"Title": b"t%d" % i, "First": items[(i + 1) % 20]})
    w.put(tree, {"Type": Name("Pages"), "Kids": [*kids, tree], "Count": 20})
    w.put(root, {"Type": Name("Catalog"), "Pages": tree, "Outlines": {"First": items[0]}, "Names": {"EmbeddedFiles": {"Kids": [root]}}})
    d = Document(w.pdf({"Root": root}))
    assert len(d.pages()) == 20 and len(d.outlines()) == 20 and d.outlines()[-1]["path"] == [1] * 20 and d.attachments() == []
    monkeypatch.setattr(document, "MOST_NODES", 10)
    for read in (d.pages, d.outlines):
        with pytest.raises(BadFile):
            read()
    monkeypatch.setattr(content, "MOST_FORMS", 3)
    w = Writer()
    forms = [w.add() for _ in range(6)]
    for i, r in enumerate(forms):
        w.put(r, flate(b"/X Do", Subtype=Name("Form"), Resources={"XObject": {"X": forms[min(i + 1, 5)]}}))
    with pytest.raises(ValueError, match="nested"):
        text_of(pages_pdf([b"/X Do"], writer=w, resources={"XObject": {"X": forms[0]}}))


def test_filters_of_the_rest():
    raw = b"some text " * 300
    bits = ""
    for code in (256, 65, 66, 258, 257):
        bits += f"{code:09b}"
    out = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert filters.decode(out, ["LZWDecode"], [{"EarlyChange": 0}]) == b"ABAB"
    z = zlib.compress(raw)
    assert filters.flate(z[:-4] + b"\0\0\0\0") == raw and raw.startswith(filters.flate(z[: len(z) // 2])) and filters.flate(zlib.compress(raw)[2:-4]) == raw
    assert filters.decode(z.hex().encode() + b">", ["AHx", "Fl"], until="FlateDecode") == z and filters.decode(b"x", ["DCT"]) == b"x"
    for name in ("JBIG2Decode", "CCF", "Unheard"):
        with pytest.raises(filters.UnsupportedFilter):
            filters.decode(b"", [name])


def test_hooks():
    shown = []

    def twice(e, args, state):
        shown.append(args)
        state["size"] *= 2
        return False

    pdf = pages_pdf([b"BT /F1 10 Tf 72 700 Td (abc) Tj ET"])
    assert text_of(pdf, handlers={"Tj": twice}) == "abc" and shown == [[b"abc"]] and text_of(pdf, handlers={"Tj": lambda e, a, s: True}) == ""
    assert text_of(pdf, encodings={"Type1": lambda names, info: [n.upper() for n in names]}) == "ABC"
    assert Parser(b"foo bar 1", words={b"foo": 7, b"bar": lambda w: w * 2}).value() == 7 and Parser(b"bar", words={b"bar": lambda w: w * 2}).value() == b"barbar"
    assert [(o, p) for o, _, _, p in grouped(b"q BT (a)Tj ET Q Q n")] == [("q", None), ("BT", 0), ("Tj", 1), ("ET", 1), ("Q", 0), ("Q", None), ("n", None)]


def test_core_fonts():
    d = Document(pages_pdf([b""]))

    def widths(base, raw, **more):
        return [w for _, w, _ in Font(d, {"Subtype": Name("Type1"), "BaseFont": Name(base), **more}).characters(raw)]

    assert widths("Helvetica-Bold", b"b'") == [611, 278] and widths("Helvetica", b"\xe9'", Encoding=Name("WinAnsiEncoding")) == [556, 191]
    assert widths("Times-Italic", b"A") == [611] and widths("ABCDEF+Times-BoldItalic", b"A") == [667] and widths("Courier-Bold", b"x") == [600] and widths("Arial,Bold", b"a") == [556]
    assert widths("Symbol", b"a") == [631] and widths("ZapfDingbats", b"\x21") == [974] and core_widths("Other") == {}
    assert [t for t, _, _ in Font(d, {"Subtype": Name("Type1"), "BaseFont": Name("Symbol")}).characters(b"abS")] == ["α", "β", "Σ"]
    expert = Font(d, {"Subtype": Name("Type1"), "BaseFont": Name("X"), "Encoding": Name("MacExpertEncoding")})
    assert "".join(t for t, _, _ in expert.characters(b"\x61\x31\x2e\xda\xbc\x87\x56\x7d")) == "a1.¹₀áﬀRp"
    assert [scalars.glyph_text(g) for g in ("afii10017", "afii10071", "universal", "dcroat", "Aacutesmall", "threesuperior", "twoinferior", "sevenoldstyle")] == ["А", "ё", "∀", "đ", "á", "³", "₂", "7"]
    assert [scalars.glyph_text(g) for g in ("becyrillic", "Zhecyrillic", "alefhebrew", "kahiragana", "akatakana", "nothing")] == ["б", "Ж", "א", "か", "ア", ""]
    afm = read_afm("FontName X\nKPX A V -70\nKPX V A -60\n")
    assert kern(afm, list("AVA")) == -130 and kern(afm, []) == 0


def test_documents_share_their_fonts(monkeypatch):
    made = []
    monkeypatch.setattr(content, "Font", lambda *a: made.append(1) or Font(*a))
    d = Document(text_pdf("a\n" * 200))
    assert len([page_text(d, p) for p in d.pages()]) == 6 and len(made) == 1


def test_aes_by_library_and_by_hand(monkeypatch):
    key, data = bytes(range(32)), bytes(range(256))
    both = []
    for native in (security._native(), None):
        monkeypatch.setattr(security, "_native", lambda native=native: native)
        shut = [security.aes_cbc(key[:n], bytes(16), data, True) for n in (16, 24, 32)]
        both.append(shut + [security.aes_cbc(key[:n], bytes(16), s, False) for n, s in zip((16, 24, 32), shut, strict=True)])
    assert both[0] == both[1] and both[0][3:] == [data] * 3
    assert security.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and security.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"


@pytest.mark.parametrize("revision", [5, 6])
def test_permissions_that_were_changed(revision):
    e = Encryption(revision, "", "own")
    assert text_of(text_pdf("private", encryption=e)) == "private"
    e.info["P"] = -1
    with pytest.raises(security.WrongPassword, match="changed"):
        Document(text_pdf("private", encryption=e))
    with pytest.raises(security.WrongPassword):
        Document(text_pdf("x", encryption=Encryption(revision, "user", "own")), ["nothing"])
    other = Encryption(3, "", "own")
    other.info["Filter"] = Name("Unheard")
    with pytest.raises(security.WrongPassword, match="not supported"):
        Document(text_pdf("x", encryption=other))


openssl = pytest.mark.skipif(not shutil.which("openssl"), reason="fixtures are made by openssl")


@openssl
@pytest.mark.parametrize("ciphers", [[], ["-keypbe", "PBE-SHA1-3DES", "-certpbe", "PBE-SHA1-3DES", "-macalg", "sha1"], ["-keypbe", "AES-128-CBC", "-certpbe", "AES-192-CBC"]])
def test_key_files_and_recipients(spark, tmp_path, ciphers):
    def run(*args):
        return subprocess.run(["openssl", *args], cwd=tmp_path, check=True, capture_output=True).stdout

    run("req", "-x509", "-newkey", "rsa:2048", "-nodes", "-keyout", "me.key", "-out", "me.pem", "-subj", "/CN=Me", "-days", "3000")
    run("pkcs12", "-export", "-inkey", "me.key", "-in", "me.pem", "-out", "me.p12", "-passout", "pass:secret", *ciphers)
    raw = (tmp_path / "me.p12").read_bytes()
    key, certs = certificates.read_pkcs12(raw, "secret")
    assert certs[0].cn == "Me" and key.modulus == certs[0].modulus
    with pytest.raises(ValueError):
        certificates.read_pkcs12(raw, "wrong")
    (tmp_path / "data").write_bytes(b"content")
    for cipher in ("-aes-128-cbc", "-aes-256-cbc", "-des3"):
        shut = run("cms", "-encrypt", "-binary", "-in", "data", "-outform", "DER", cipher, "me.pem")
        assert certificates.open_envelope(shut, key, certs) == b"content" and certificates.open_envelope(shut, key, []) is None
    pdf = text_pdf("for me", encryption=RecipientEncryption([certs[0].raw]))
    rows = tables.page_text(files_of(spark, a=pdf), [tables.KeyFile(raw, "secret")]).collect()
    assert rows[0].text.strip() == "for me" and tables.page_text(files_of(spark, a=pdf)).first().error


def test_chains():
    root, middle, leaf = (fixture_key(i) for i in (1, 2, 3))
    anchor = certificates.Certificate(certificate("Root", root, "Root", root, True))
    old = certificates.Certificate(certificate("Root", root, "Root", root, True, extensions=False))
    issuer, plain = (certificates.Certificate(certificate("Middle", middle, "Root", root, True, 2, extensions=x)) for x in (True, False))
    mine = certificates.Certificate(certificate("Me", leaf, "Middle", middle, False, 3))
    at = certificates.asn1_time(next(certificates.nodes(b"\x18\x0f20240101000000Z")))
    for anchors in ([anchor], [old], [issuer]):
        certificates.trusted(mine, [issuer], anchors, at)
    assert anchor.self_signed and not mine.self_signed
    for others, anchors in (([plain], [anchor]), ([issuer], []), ([], [anchor])):
        with pytest.raises(certificates.BadSignature):
            certificates.trusted(mine, others, anchors, at)
    assert len(certificates.pem_certificates(pem(anchor.raw) + "-----BEGIN CERTIFICATE-----\nAAAA\n-----END CERTIFICATE-----\n")) == 1
    assert isinstance(certificates.system_anchors(), str)
    sign = lambda data: signed_data(data, mine.raw, leaf, [issuer.raw], None)
    s = Document(signed_pdf(sign, {"T": b"s"}, {"SubFilter": Name("adbe.pkcs7.detached")})).signatures()[0]
    assert certificates.check_cms(s["contents"], s["signed"], at, [anchor])["verified_at"] == at
    value = rsa_sign(leaf, "1.3.14.3.2.26", hashlib.sha1(b"data").digest())
    assert certificates.check_pkcs1([mine.raw, issuer.raw], b"\x04\x81\x80" + value, b"data", at, [anchor])["certs"][0]["cn"] == "Me"
    with pytest.raises(certificates.BadSignature):
        certificates.check_pkcs1([mine.raw, issuer.raw], value, b"other", at, [anchor])


def test_sinks_and_accessors(spark, tmp_path):
    w = Writer()
    a, b, c = w.add(), w.add(), w.add()
    for r, title, more in ((a, b"one", {"First": b, "Next": c}), (b, b"below", {}), (c, b"two", {})):
        w.put(r, {"Title": title, **more})
    pdf = pages_pdf([b"BT /F1 10 Tf 72 700 Td (x) Tj ET"] * 2, writer=w, catalog={"Outlines": {"First": a}, "Names": {"Dests": {"Names": [b"d", [Ref(5, 0), Name("Fit")]]}}})
    files = files_of(spark, **{"/in/a.pdf": pdf, "/other/a.pdf": text_pdf("else"), "bad": b""})
    items = tables.outlines(files)
    assert [r.title for r in tables.outline_children(items, []).collect()] == ["one", "two"] and [r.title for r in tables.outline_children(items, [1]).collect()] == ["below"]
    assert tables.names(files).first().name == "d" and {r.path for r in tables.catalog(files).collect()} == {"/in/a.pdf", "/other/a.pdf"}
    assert [r.content for r in tables.page_contents(files.where("path = '/in/a.pdf'")).collect()] == [b"BT /F1 10 Tf 72 700 Td (x) Tj ET"] * 2
    tables.write_texts(tables.page_text(files).where("error is null"), f"{tmp_path}/texts")
    back = spark.read.parquet(f"{tmp_path}/texts")
    assert back.count() == 3 and {(r.path, r.file) for r in back.collect()} == {("/in/a.pdf", "a.pdf"), ("/other/a.pdf", "a.pdf")}
    key = fixture_key(1)
    certs = spark.createDataFrame([(pem(certificate("Root", key, "Root", key, True)),)], "text string")
    tables.write_pem(certs, f"{tmp_path}/pem")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/pem").collect())
    assert certificates.pem_certificates(text)[0].cn == "Root"
    assert key_file(key, certificate("A", key, "A", key, False))[:1] == b"\x30" and utf16("a") == b"\xfe\xff\0a" and COURIER["BaseFont"] == "Courier"


def test_ranges_in_quantiles(spark, monkeypatch):
    rows = spark.range(0, 200).select((F.col("id") * 7 % 200).cast("int").alias("t"))
    bands = spark.createDataFrame([(i * 10, i * 10 + (3 if i % 2 else 9), f"b{i}") for i in range(18)], "lo int, hi int, v string")
    want = {t: f"b{t // 10}" if t < 180 and t % 10 <= (3 if t // 10 % 2 else 9) else "-" for t in range(200)}
    for most in (10_000_000, 0):
        monkeypatch.setattr(relational, "MOST_COPIES", most)
        got = relational.in_range(rows, bands, "t", "lo", "hi", {"v": F.lit("-")}).collect()
        assert {r.t: r.v for r in got} == want and len(got) == 200


def test_as_of_in_slices(spark):
    rows = spark.range(0, 400).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 401).alias("t"))
    ranges = spark.range(0, 60).select((F.col("id") % 2).alias("k"), (F.col("id") * 13 % 390).alias("s"), F.concat(F.lit("v"), "id").alias("v"))
    plain, cut = (relational.as_of(rows, ranges, ["k"], "t", "s", ["v"], n) for n in (1, 7))
    assert cut.count() == 400 and plain.exceptAll(cut).count() == 0 and plain.where("v is not null").count() > 200
    when = lambda c: F.timestamp_seconds(F.col(c) * 1000).alias(c)
    timed = [relational.as_of(rows.select("k", when("t")), ranges.select("k", when("s"), "v"), ["k"], "t", "s", ["v"], n) for n in (1, 5)]
    assert timed[0].exceptAll(timed[1]).count() == 0


@pytest.mark.parametrize("name", ["revision_files", "object_dump", "page_tree_files", "encrypted_files", "recipient_files"])
def test_files_are_read_once(spark, name):
    """No query joins tables of files with each other: that built and read every file again and shuffled or broadcast all rows."""
    from vellum import file_queries

    df = file_queries.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 2


def test_tables_together(spark):
    w = Writer()
    good = pages_pdf([b"BT /F1 9 Tf (a) Tj ET", b""], writer=w, trailer={"Info": w.add({"Title": b"t", "Author": b"x"})})
    files = files_of(spark, good=good, far=text_pdf("x", after=b" 0 -20000000 Td (y) Tj"), junk=b"no")
    got = {r.path: r for r in tables.together(files, {"docs": tables.DOCUMENTS, "info": tables.INFO, "xref": tables.XREF, "pages": tables.PAGES, "texts": tables.text_part(), "objects": tables.object_part(nums=[1, 99]), "edges": tables.edge_part()}).collect()}
    assert [p.page_no for p in got["good"].pages] == [1, 2] and got["good"].texts[0].text.strip() == "a" and got["good"].texts_error is None
    assert {i.key: i.text for i in got["good"].info} == {"Title": "t", "Author": "x"} and [o.num for o in got["good"].objects] == [1]
    assert len(got["good"].xref) == tables.xref(files).where("path = 'good'").count() and len(got["good"].edges) == tables.edges(files).where("path = 'good'").count()
    assert got["far"].texts is None and "too large" in got["far"].texts_error and got["far"].docs[0].pages == 1 and got["far"].docs_error is None
    assert got["junk"].docs is None and "BadFile" in got["junk"].docs_error and got["junk"].edges_error == got["junk"].docs_error


def test_batches_are_bounded():
    """Small files share a batch of rows, large ones don't pile up; a slice of texts is small."""
    import pyarrow as pa
    from pyspark.sql.types import _parse_datatype_string

    from vellum import queries

    files = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(3000)], "content": [b""] * 3000})
    schema = _parse_datatype_string("path string, data binary")
    sizes = lambda n: [b.num_rows for b in tables._in_batches(iter([files]), schema, lambda p, c: [{"path": p, "data": bytes(n)}])]
    assert sizes(1) == [2000, 1000] and max(sizes(1 << 18)) <= 16
    texts = pa.RecordBatch.from_pydict({"k": list(range(1000)), "t": ["x" * (50_000 if i % 2 else 10) for i in range(999)] + [None]})
    cut = list(queries.parts(texts, 1))
    assert pa.Table.from_batches(cut).to_pylist() == texts.to_pylist() and max(c.num_rows for c in cut) <= 50 and list(queries.parts(texts.slice(0, 0), 1)) == []
