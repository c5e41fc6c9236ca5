"""A small PDF writer for tests: pages of content, plain objects, cross-reference tables or streams, encryption left out."""

from __future__ import annotations

import zlib


def build(objects: dict[int, bytes], trailer: str = "", junk: bytes = b"") -> bytes:
    out, at = bytearray(b"%PDF-1.4\n"), {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d 00000 %s \n" % (at.get(n, 0), b"n" if n in at else b"f")
    out += b"trailer\n<</Size %d /Root 1 0 R %s>>\nstartxref\n%d\n%%%%EOF\n" % (size, trailer.encode(), start)
    return junk + bytes(out)


def stream(data: bytes, extra: str = "", flate: bool = True) -> bytes:
    raw = zlib.compress(data) if flate else data
    return b"<</Length %d %s %s>>\nstream\n" % (len(raw), b"/Filter /FlateDecode" if flate else b"", extra.encode()) + raw + b"\nendstream"


def document(contents: list[bytes], catalog: str = "", more: dict[int, bytes] | None = None, trailer: str = "", junk: bytes = b"", font: str = "/Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding", flate: bool = True) -> bytes:
    """One page for each content; objects: 1 catalog, 2 page tree, 3 font, then page and content in turn."""
    objects = {1: f"<</Type /Catalog /Pages 2 0 R {catalog}>>".encode(), 3: f"<<{font}>>".encode()}
    kids = []
    for i, c in enumerate(contents):
        page = 4 + 2 * i
        kids.append(f"{page} 0 R")
        objects[page] = f"<</Type /Page /Parent 2 0 R /Contents {page + 1} 0 R>>".encode()
        objects[page + 1] = stream(c, flate=flate)
    objects[2] = f"<</Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] /MediaBox [0 0 612 792] /Resources <</Font <</F1 3 0 R>>>>>>".encode()
    return build(dict(sorted((objects | (more or {})).items())), trailer, junk)


def lines(texts: list[str], size: float = 12, leading: float = 14.4, left: float = 0, top: float = 700) -> bytes:
    rows = "".join(f"({t.replace(chr(92), chr(92) * 2).replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj T*\n" for t in texts)
    return f"BT /F1 {size} Tf {leading} TL {left} {top} Td\n{rows}ET".encode("cp1252", "replace")
