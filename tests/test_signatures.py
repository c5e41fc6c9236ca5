import re
import shutil
import subprocess

import pytest
from pdf_writer import document, lines

from vellum.plans import tables
from vellum.sources import writer
from vellum.sources.document import Document

pytestmark = pytest.mark.skipif(not shutil.which("openssl"), reason="fixtures are signed by openssl")


def signed_pdf(folder):
    def openssl(*args, **kw):
        return subprocess.run(["openssl", *args], cwd=folder, check=True, capture_output=True, **kw).stdout

    openssl("req", "-x509", "-newkey", "rsa:2048", "-nodes", "-keyout", "ca.key", "-out", "ca.pem", "-subj", "/CN=Root", "-days", "3000")
    openssl("req", "-newkey", "rsa:2048", "-nodes", "-keyout", "me.key", "-out", "me.csr", "-subj", "/CN=Signer/O=Some")
    openssl("x509", "-req", "-in", "me.csr", "-CA", "ca.pem", "-CAkey", "ca.key", "-CAcreateserial", "-out", "me.pem", "-days", "3000")
    hole = b"<" + b"0" * 8000 + b">"
    field = b"<</FT /Sig /T (s) /P 4 0 R /V <</Type /Sig /SubFilter /adbe.pkcs7.detached /ByteRange [0000000000 0000000000 0000000000 0000000000] /Contents " + hole + b">>>>"
    pdf = document([lines(["signed"], left=72)], catalog="/AcroForm <</SigFlags 1 /Fields [95 0 R]>>", more={95: field})
    at = pdf.index(hole)
    spans = (0, at, at + len(hole), len(pdf) - at - len(hole))
    pdf = re.sub(rb"\[0{10}.*?\]", b"[" + b" ".join(b"%010d" % x for x in spans) + b"]", pdf, count=1)
    (folder / "data").write_bytes(pdf[: spans[1]] + pdf[spans[2] :])
    cms = openssl("cms", "-sign", "-binary", "-in", "data", "-signer", "me.pem", "-inkey", "me.key", "-outform", "DER", "-md", "sha256")
    pdf = pdf.replace(hole, b"<" + cms.hex().encode().ljust(8000, b"0") + b">")
    return pdf, (folder / "ca.pem").read_text()


def test_signature(spark, tmp_path):
    pdf, root = signed_pdf(tmp_path)
    files = spark.createDataFrame([("good", bytearray(pdf)), ("changed", bytearray(pdf.replace(b"/Courier", b"/Courxer")))], "path string, content binary")
    rows = {r.path: r for r in tables.signatures(files, trust_pem=root).collect()}
    assert rows["good"].passed and rows["good"].covers_file and rows["good"].certs[0].cn == "Signer" and rows["good"].error_message is None
    assert not rows["changed"].passed and "changed" in rows["changed"].error_message
    alone = tables.signatures(files).where("path = 'good'")
    assert "no trusted issuer" in alone.first().error_message
    assert tables.certificates(tables.signatures(files, trust_pem=root)).first().issuer == "CN=Root"


@pytest.mark.parametrize("key", [11111, 22222, 33333, 133333])
def test_byte_range_beside_equal_digits(key):
    pdf = writer.signed_pdf(lambda data: data[:9], {"T": b"s%d" % key}, {"SubFilter": writer.Name("adbe.pkcs7.detached"), "Name": b"Customer#%09d" % key})
    (s,) = Document(pdf).signatures()
    assert s["fqt"] == f"s{key}" and s["name"] == f"Customer#{key:09d}" and s["covers_file"] and len(s["signed"]) == len(pdf) - 12002
