"""A small PDF writer, for round trips of tables: objects as Python values, all cross-reference forms, standard encryption, signatures."""

from __future__ import annotations

import base64
import hashlib
import zlib
from functools import lru_cache

from .certificates import Certificate, PrivateKey
from .security import PADDING, _legacy_check, aes_cbc, hash_r6, rc4
from .syntax import Name, Ref, Stream, show


def literal(raw: bytes) -> bytes:
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def flate(data: bytes, **info) -> Stream:
    return Stream({"Filter": Name("FlateDecode"), **info}, zlib.compress(data, 1))


def utf16(text: str) -> bytes:
    return b"\xfe\xff" + text.encode("utf-16-be")


@lru_cache(maxsize=64)
def _owner_entry(u: bytes, o: bytes, n: int, rounds: int) -> bytes:
    k = hashlib.md5((o + PADDING)[:32]).digest()
    for _ in range(rounds):
        k = hashlib.md5(k).digest()
    other = (u + PADDING)[:32]
    for i in range(20 if rounds else 1):
        other = rc4(bytes(b ^ i for b in k[:n]), other)
    return other


class Encryption:
    """The standard handler for writing: revisions 2 to 6, RC4 or AES, and which crypt filters strings and streams take."""

    def __init__(self, revision: int, user: str, owner: str, aes: bool = True, permissions: int = -4, first_id: bytes = b"0123456789abcdef", strings: str = "StdCF", streams: str = "StdCF"):
        self.revision, self.first_id = revision, first_id
        self.v = {2: 1, 3: 2, 4: 4}.get(revision, 5)
        self.kind = "AESV3" if self.v == 5 else "AESV2" if aes and self.v == 4 else "V2"
        self.filters = (strings, streams) if self.v >= 4 else ("StdCF", "StdCF")
        p, u, o = permissions & 0xFFFFFFFF, user.encode(), (owner or user).encode()
        self.info = {"Filter": Name("Standard"), "V": self.v, "R": revision, "P": permissions}
        if self.v == 5:
            self.key = hashlib.sha256(first_id).digest()
            salt = hashlib.sha256(b"salt" + first_id).digest()
            own = hash_r6(u, salt[:8], b"", revision) + salt[:16]
            other = hash_r6(o, salt[16:24], own, revision) + salt[16:32]
            keys = {"UE": aes_cbc(hash_r6(u, salt[8:16], b"", revision), bytes(16), self.key, True), "OE": aes_cbc(hash_r6(o, salt[24:32], own, revision), bytes(16), self.key, True)}
            perms = aes_cbc(self.key, bytes(16), p.to_bytes(4, "little") + b"\xff" * 4 + b"Tadb" + b"rest", True)
            self.info |= {"Length": 256, "U": own, "O": other, **keys, "Perms": perms}
        else:
            n, rounds = (5, 0) if revision == 2 else (16, 50)
            other = _owner_entry(u, o, n, rounds)
            k = hashlib.md5((u + PADDING)[:32] + other + p.to_bytes(4, "little") + first_id).digest()
            for _ in range(rounds):
                k = hashlib.md5(k[:n]).digest()
            self.key = k[:n]
            own = _legacy_check(self.key, first_id, revision)
            self.info |= {"Length": 8 * n, "U": own.ljust(32, b"\0"), "O": other}
        if self.v >= 4:
            self.info |= {"CF": {"StdCF": {"CFM": Name(self.kind)}}, "StrF": Name(strings), "StmF": Name(streams)}

    def shut(self, raw: bytes, num: int, string: bool) -> bytes:
        if self.filters[0 if string else 1] == "Identity":
            return raw
        k = self.key
        if self.v < 5:
            k = hashlib.md5(k + num.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if self.kind == "AESV2" else b"")).digest()[: min(16, len(k) + 5)]
        if self.kind == "V2":
            return rc4(k, raw)
        iv, pad = hashlib.md5(raw + num.to_bytes(3, "little")).digest(), 16 - len(raw) % 16
        return iv + aes_cbc(k, iv, raw + bytes([pad]) * pad, True)

    def value(self, v, num: int):
        if isinstance(v, bytes):
            return self.shut(v, num, True)
        if isinstance(v, list):
            return [self.value(x, num) for x in v]
        if isinstance(v, dict):
            return {k: self.value(x, num) for k, x in v.items()}
        return Stream(self.value(v.info, num), self.shut(v.raw, num, False)) if isinstance(v, Stream) else v


class Writer:
    """Collects objects and writes them as one file; ``kind`` is table, stream (with packed objects) or hybrid."""

    def __init__(self):
        self.objects: dict[int, object] = {}

    def add(self, value=None) -> Ref:
        self.objects[len(self.objects) + 1] = value
        return Ref(len(self.objects), 0)

    def put(self, ref: Ref, value) -> Ref:
        self.objects[ref.num] = value
        return ref

    @staticmethod
    def body(num: int, value) -> bytes:
        if isinstance(value, Stream):
            return b"%d 0 obj\n" % num + show({**value.info, "Length": len(value.raw)}).encode() + b"\nstream\n" + value.raw + b"\nendstream\nendobj\n"
        return b"%d 0 obj\n" % num + (value if isinstance(value, RawBody) else show(value).encode()) + b"\nendobj\n"

    def pdf(self, trailer: dict, kind: str = "table", junk: bytes = b"", encryption: Encryption | None = None) -> bytes:
        objects, trailer = dict(self.objects), dict(trailer)
        if encryption:
            objects = {n: encryption.value(v, n) for n, v in objects.items()}
            objects[len(objects) + 1] = encryption.info
            trailer |= {"Encrypt": Ref(len(objects), 0), "ID": [encryption.first_id, b""]}
        packed = [n for n, v in objects.items() if not isinstance(v, (Stream, RawBody))] if kind != "table" else []
        out, at, inside = bytearray(b"%PDF-1.5\n"), {}, {}
        if packed:
            texts = [show(objects[n]).encode() + b" " for n in packed]
            head, where = b"", 0
            for n, t in zip(packed, texts, strict=True):
                head, where = head + b"%d %d " % (n, where), where + len(t)
            holder = len(objects) + 1
            objects[holder] = flate(head + b"".join(texts), Type=Name("ObjStm"), N=len(packed), First=len(head))
            inside = {n: (holder, i) for i, n in enumerate(packed)}
        for n, v in objects.items():
            if n not in inside:
                at[n] = len(out)
                out += self.body(n, v)
        size = len(objects) + 1
        start = len(out)
        if kind != "table":
            rows = [(0, 0, 255)] + [(2, *inside[n]) if n in inside else (1, at[n], 0) for n in range(1, size)] + [(1, start, 0)]
            first, own = (0, rows) if kind == "stream" else (1, rows[1:-1])
            data = b"".join(bytes([k]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for k, a, b in own)
            table = flate(data, Type=Name("XRef"), Size=size + 1, W=[1, 4, 2], Index=[first, len(own)], **(trailer if kind == "stream" else {}))
            out += self.body(size, table)
        if kind != "stream":
            main = len(out)
            out += b"xref\n0 %d\n0000000000 65535 f \n" % size
            out += b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(1, size)) if kind == "table" else b""
            if kind == "hybrid":
                out = out[:main] + b"xref\n0 1\n0000000000 65535 f \n"
                trailer["XRefStm"] = start
            out += b"trailer\n" + show({"Size": size, **trailer}).encode() + b"\n"
            start = main
        return junk + bytes(out) + b"startxref\n%d\n%%%%EOF\n" % start

    @staticmethod
    def update(pdf: bytes, num: int, value, trailer: dict) -> bytes:
        """An incremental update of one object, as a section behind the file."""
        previous = int(pdf[pdf.rfind(b"startxref") + 9 :].split()[0])
        body = Writer.body(num, value)
        at = len(pdf)
        return pdf + body + b"xref\n%d 1\n%010d 00000 n \ntrailer\n" % (num, at) + show({**trailer, "Prev": previous}).encode() + b"\nstartxref\n%d\n%%%%EOF\n" % (at + len(body))


class RawBody(bytes):
    """The body of an object as it shall be written."""


COURIER = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding")}


def pages_pdf(contents: list[bytes], font: dict | None = None, catalog: dict | None = None, resources: dict | None = None, writer: Writer | None = None, **options) -> bytes:
    """One page for each content, in one font called F1."""
    w = writer or Writer()
    root, tree, f = w.add(), w.add(), w.add(font or COURIER)
    kids = []
    for c in contents:
        kids.append(w.add({"Type": Name("Page"), "Parent": tree, "Contents": w.add(flate(c))}))
    w.put(tree, {"Type": Name("Pages"), "Count": len(kids), "Kids": kids, "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": f}, **(resources or {})}})
    w.put(root, {"Type": Name("Catalog"), "Pages": tree, **(catalog or {})})
    return w.pdf({"Root": root, **options.pop("trailer", {})}, **options)


def text_pdf(text: str, lines_per_page: int = 40, size: str = "12", leading: float = 14.4, after: bytes = b"", **options) -> bytes:
    """Lines in one font, pages of a fixed number of lines; ``after`` follows on the last page."""
    lines = text.split("\n")
    contents = []
    for at in range(0, len(lines), lines_per_page):
        rows = b"\n".join(literal(x.encode("cp1252", "replace")) + b" Tj T*" for x in lines[at : at + lines_per_page])
        last = after if at + lines_per_page >= len(lines) else b""
        contents.append(b"BT /F1 %s Tf %g TL 72 700 Td\n" % (size.encode(), leading) + rows + last + b"\nET")
    return pages_pdf(contents, **options)


# Keys and certificates for signed fixtures: made by rule, of no secrecy whatever.
def der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))) + body


def der_int(n: int) -> bytes:
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def der_oid(text: str) -> bytes:
    a, b, *rest = map(int, text.split("."))
    out = bytes([40 * a + b])
    for x in rest:
        part = [x & 127]
        while x := x >> 7:
            part.append(x & 127 | 128)
        out += bytes(reversed(part))
    return der(6, out)


SHA256, RSA, RSA_SHA256 = "2.16.840.1.101.3.4.2.1", "1.2.840.113549.1.1.1", "1.2.840.113549.1.1.11"


def der_algorithm(oid: str) -> bytes:
    return der(0x30, der_oid(oid), der(5))


@lru_cache(maxsize=8)
def fixture_key(seed: int, bits: int = 1024) -> tuple[int, int]:
    """(modulus, private exponent) of an RSA key whose primes follow numbers made from ``seed``."""

    def prime(k: int) -> int:
        n = int.from_bytes(hashlib.shake_256(b"%d %d" % (seed, k)).digest(bits // 16), "big") | 1 | 3 << (bits // 2 - 2)
        while pow(2, n - 1, n) != 1 or pow(3, n - 1, n) != 1 or (n - 1) % 65537 == 0:
            n += 2
        return n

    p, q = prime(0), prime(1)
    return p * q, pow(65537, -1, (p - 1) * (q - 1))


def rsa_sign(key: tuple[int, int], digest_oid: str, digest: bytes) -> bytes:
    n, d = key
    info = der(0x30, der_algorithm(digest_oid), der(4, digest))
    size = (n.bit_length() + 7) // 8
    return pow(int.from_bytes(b"\0\1" + b"\xff" * (size - 3 - len(info)) + b"\0" + info, "big"), d, n).to_bytes(size, "big")


def certificate(name: str, key: tuple[int, int], issuer: str, issuer_key: tuple[int, int], authority: bool, serial: int = 1, years: tuple[str, str] = ("20200101000000Z", "20400101000000Z"), extensions: bool = True) -> bytes:
    def named(x: str) -> bytes:
        return der(0x30, der(0x31, der(0x30, der_oid("2.5.4.3"), der(0x0C, x.encode()))))

    public = der(0x30, der_algorithm(RSA), der(3, b"\0", der(0x30, der_int(key[0]), der_int(65537))))
    basic = der(0x30, der_oid("2.5.29.19"), der(1, b"\xff"), der(4, der(0x30, der(1, b"\xff")) if authority else der(0x30)))
    usage = der(0x30, der_oid("2.5.29.15"), der(4, der(3, b"\1", b"\x06" if authority else b"\x80")))
    more = der(0xA3, der(0x30, basic, usage)) if extensions else b""
    body = der(0x30, der(0xA0, der_int(2)), der_int(serial), der_algorithm(RSA_SHA256), named(issuer), der(0x30, *(der(0x18, y.encode()) for y in years)), named(name), public, more)
    return der(0x30, body, der_algorithm(RSA_SHA256), der(3, b"\0" + rsa_sign(issuer_key, SHA256, hashlib.sha256(body).digest())))


def pem(cert: bytes) -> str:
    return f"-----BEGIN CERTIFICATE-----\n{base64.encodebytes(cert).decode()}-----END CERTIFICATE-----\n"


def signed_data(data: bytes, cert: bytes, key: tuple[int, int], others: list[bytes] = (), time: str | None = "20240102030405Z", content: tuple[str, bytes] | None = None, unsigned: bytes = b"") -> bytes:
    """A CMS signature over ``data``: detached, or with ``content`` (its type and bytes) inside."""
    c = Certificate(cert)
    kind, inner = content or ("1.2.840.113549.1.7.1", None)
    attributes = [der(0x30, der_oid("1.2.840.113549.1.9.3"), der(0x31, der_oid(kind))), der(0x30, der_oid("1.2.840.113549.1.9.4"), der(0x31, der(4, hashlib.sha256(data if inner is None else inner).digest())))]
    if time:
        attributes.append(der(0x30, der_oid("1.2.840.113549.1.9.5"), der(0x31, der(0x18, time.encode()))))
    signature = rsa_sign(key, SHA256, hashlib.sha256(der(0x31, *attributes)).digest())
    signer = der(0x30, der_int(1), der(0x30, c.issuer_raw, der_int(c.serial)), der_algorithm(SHA256), der(0xA0, *attributes), der_algorithm(RSA), der(4, signature), unsigned)
    holder = der(0x30, der_oid(kind), *([der(0xA0, der(4, inner))] if inner is not None else []))
    body = der(0x30, der_int(1), der(0x31, der_algorithm(SHA256)), holder, der(0xA0, cert, *others), der(0x31, signer))
    return der(0x30, der_oid("1.2.840.113549.1.7.2"), der(0xA0, body))


def time_stamp(data: bytes, cert: bytes, key: tuple[int, int], others: list[bytes] = (), time: str = "20230506070809Z") -> bytes:
    """An RFC 3161 token over ``data``."""
    info = der(0x30, der_int(1), der_oid("1.2.3"), der(0x30, der_algorithm(SHA256), der(4, hashlib.sha256(data).digest())), der_int(7), der(0x18, time.encode()))
    return signed_data(info, cert, key, others, None, ("1.2.840.113549.1.9.16.1.4", info))


def signed_pdf(sign, field: dict, value: dict, room: int = 6000, **options) -> bytes:
    """A file with one signature field; ``sign`` makes the contents from the signed bytes."""
    w = Writer()
    hole, spans = b"\0" * room, [0, 1111111111, 2222222222, 3333333333]
    mark = w.add({**field, "FT": Name("Sig"), "P": Ref(6, 0), "V": {"Type": Name("Sig"), "ByteRange": spans, "Contents": hole, **value}})
    pdf = pages_pdf([b"BT /F1 12 Tf 72 700 Td (signed) Tj ET"], writer=w, catalog={"AcroForm": {"SigFlags": 3, "Fields": [mark]}}, **options)
    digits = show(hole).encode()
    at = pdf.index(digits)
    own = (0, at, at + len(digits), len(pdf) - at - len(digits))
    # The whole array: other values may hold the digits of one of its numbers, as a hex string of 33333 does.
    pdf = pdf.replace(show(spans).encode(), b"[0 %010d %010d %010d]" % own[1:], 1)
    made = sign(pdf[: own[1]] + pdf[own[2] :])
    return pdf.replace(digits, b"<" + made.hex().upper().encode().ljust(len(digits) - 2, b"0") + b">", 1)


def private_key(key: tuple[int, int]) -> PrivateKey:
    return PrivateKey(*key)


def key_file(key: tuple[int, int], cert: bytes) -> bytes:
    """A PKCS#12 file without encryption or checksum."""
    n, d = key
    data = lambda body: der(0x30, der_oid("1.2.840.113549.1.7.1"), der(0xA0, der(4, body)))
    private = der(0x30, der_int(0), der_algorithm(RSA), der(4, der(0x30, der_int(0), der_int(n), der_int(65537), der_int(d))))
    bags = [der(0x30, der_oid("1.2.840.113549.1.12.10.1.1"), der(0xA0, private)), der(0x30, der_oid("1.2.840.113549.1.12.10.1.3"), der(0xA0, der(0x30, der_oid("1.2.840.113549.1.9.22.1"), der(0xA0, der(4, cert)))))]
    return der(0x30, der_int(3), data(der(0x30, data(der(0x30, *bags)))))


def envelope(content: bytes, certs: list[bytes]) -> bytes:
    """Enveloped data under AES-128 for the holders of certificates."""
    secret, iv, recipients = hashlib.sha256(content).digest()[:16], bytes(16), []
    for c in map(Certificate, certs):
        size = (c.modulus.bit_length() + 7) // 8
        block = b"\0\2" + b"\x5a" * (size - 3 - len(secret)) + b"\0" + secret
        recipients.append(der(0x30, der_int(0), der(0x30, c.issuer_raw, der_int(c.serial)), der_algorithm(RSA), der(4, pow(int.from_bytes(block, "big"), c.exponent, c.modulus).to_bytes(size, "big"))))
    pad = 16 - len(content) % 16
    shut = aes_cbc(secret, iv, content + bytes([pad]) * pad, True)
    inner = der(0x30, der_oid("1.2.840.113549.1.7.1"), der(0x30, der_oid("2.16.840.1.101.3.4.1.2"), der(4, iv)), der(0x80, shut))
    return der(0x30, der_oid("1.2.840.113549.1.7.3"), der(0xA0, der(0x30, der_int(0), der(0x31, *recipients), inner)))


class RecipientEncryption(Encryption):
    """Encryption to the holders of certificates, by AES with 128 or 256 bits."""

    def __init__(self, certs: list[bytes], bits: int = 128, permissions: int = 0xFFFFF0C4, first_id: bytes = b"0123456789abcdef"):
        seed = hashlib.sha1(b"seed" + first_id).digest()
        made = envelope(seed + permissions.to_bytes(4, "big"), certs)
        self.first_id, self.v, self.kind, self.filters = first_id, 4 if bits == 128 else 5, "AESV2" if bits == 128 else "AESV3", ("DefaultCryptFilter",) * 2
        self.key = (hashlib.sha1 if bits == 128 else hashlib.sha256)(seed + made).digest()[: bits // 8]
        own = {"CFM": Name(self.kind), "Recipients": [made], "EncryptMetadata": True}
        self.info = {"Filter": Name("Adobe.PubSec"), "SubFilter": Name("adbe.pkcs7.s5"), "V": self.v, "Length": bits, "CF": {"DefaultCryptFilter": own}, "StmF": Name("DefaultCryptFilter"), "StrF": Name("DefaultCryptFilter")}
