"""Certificates and signed data: a DER reader, RSA checks, X.509 chains, CMS and PKCS#1 signatures.

Only what signature fields and recipients of documents need: RSA with PKCS#1 v1.5 padding, chains up to given trust
anchors at the signing time, time stamps, PKCS#12 files, enveloped data; no revocation.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import re
from contextlib import suppress
from datetime import datetime, timedelta
from typing import NamedTuple

# Object identifiers.
DIGESTS = {"1.3.14.3.2.26": "sha1", "2.16.840.1.101.3.4.2.1": "sha256", "2.16.840.1.101.3.4.2.2": "sha384", "2.16.840.1.101.3.4.2.3": "sha512"}
RSA_DIGESTS = {"1.2.840.113549.1.1.5": "sha1", "1.2.840.113549.1.1.11": "sha256", "1.2.840.113549.1.1.12": "sha384", "1.2.840.113549.1.1.13": "sha512"}
NAMES = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU", "1.2.840.113549.1.9.1": "emailAddress"}
MESSAGE_DIGEST, SIGNING_TIME = "1.2.840.113549.1.9.4", "1.2.840.113549.1.9.5"
BASIC_CONSTRAINTS, KEY_USAGE = "2.5.29.19", "2.5.29.15"
TIME_STAMP, TIME_STAMP_INFO = "1.2.840.113549.1.9.16.2.14", "1.2.840.113549.1.9.16.1.4"
MOST_CHAIN = 16


class BadSignature(ValueError):
    pass


class Node(NamedTuple):
    tag: int
    body: bytes
    raw: bytes

    @property
    def kids(self) -> list[Node]:
        return list(nodes(self.body))

    def oid(self) -> str:
        first, *rest = self.body
        out, acc = [min(2, first // 40), first - 40 * min(2, first // 40)], 0
        for b in rest:
            acc = acc << 7 | b & 0x7F
            if b < 0x80:
                out.append(acc)
                acc = 0
        return ".".join(map(str, out))

    def number(self) -> int:
        return int.from_bytes(self.body, "big", signed=True)


def nodes(data: bytes):
    """The DER values of a byte string, one after the other; bytes after a zero tag are padding."""
    at = 0
    while at + 2 <= len(data) and data[at]:
        n, head = data[at + 1], 2
        if n & 0x80:
            head += n & 0x7F
            n = int.from_bytes(data[at + 2 : at + head], "big")
        if at + head + n > len(data):
            raise BadSignature("value is longer than its data")
        yield Node(data[at], data[at + head : at + head + n], data[at : at + head + n])
        at += head + n


def asn1_time(node: Node) -> datetime:
    """UTCTime (years from 50 on are in the last century) or GeneralizedTime as UTC; fractions are dropped."""
    text = node.body.decode("ascii")
    if node.tag == 0x17:
        text = ("19" if int(text[:2]) >= 50 else "20") + text
    m = re.match(r"(\d{12})(\d\d)?(?:[.,]\d+)?(?:Z|([+-])(\d\d)(\d\d))?", text)
    if not m:
        raise BadSignature("unreadable time")
    out = datetime.strptime(m[1] + (m[2] or "00"), "%Y%m%d%H%M%S")
    shift = timedelta(hours=int(m[4] or 0), minutes=int(m[5] or 0))
    return out + shift if m[3] == "-" else out - shift


def _name(node: Node) -> tuple[str, str]:
    parts = [(NAMES.get(a.kids[0].oid(), a.kids[0].oid()), a.kids[1].body.decode("utf-16-be" if a.kids[1].tag == 0x1E else "utf-8", "replace")) for rdn in node.kids for a in rdn.kids]
    return ", ".join(f"{k}={v}" for k, v in parts), next((v for k, v in parts if k == "CN"), "")


class Certificate:
    def __init__(self, raw: bytes):
        top = next(nodes(raw))
        body, algorithm, signature = top.kids
        fields = [k for k in body.kids if k.tag != 0xA0]
        self.raw, self.signed, self.signature = top.raw, body.raw, signature.body[1:]
        self.digest = RSA_DIGESTS.get(algorithm.kids[0].oid())
        self.serial = fields[0].number()
        self.issuer_raw, self.subject_raw = fields[2].raw, fields[4].raw
        self.issuer, self.issuer_cn = _name(fields[2])
        self.subject, self.cn = _name(fields[4])
        self.not_before, self.not_after = map(asn1_time, fields[3].kids)
        self.modulus = self.exponent = 0
        key = fields[5].kids
        if key[0].kids[0].oid() == "1.2.840.113549.1.1.1":
            n, e = next(nodes(key[1].body[1:])).kids
            self.modulus, self.exponent = n.number(), e.number()
        self.extensions = {e.kids[0].oid(): next(nodes(e.kids[-1].body)) for k in fields[6:] if k.tag == 0xA3 for e in k.kids[0].kids}

    @property
    def self_signed(self) -> bool:
        return self.subject_raw == self.issuer_raw and rsa_signed(self, self.digest, self.signed, self.signature)

    def may_issue(self, below: int, anchor: bool = False) -> bool:
        """Whether it may sign a certificate that has ``below`` issued authorities under it: an authority by its basic constraints, and by its key usage if it has one.

        Of the anchors, which the caller trusts, old ones without any extension may.
        """
        if not self.extensions:
            return anchor
        limits = self.extensions[BASIC_CONSTRAINTS].kids if BASIC_CONSTRAINTS in self.extensions else []
        if not limits or limits[0].tag != 1 or not any(limits[0].body):
            return False
        if len(limits) > 1 and below > limits[1].number():
            return False
        usage = self.extensions.get(KEY_USAGE)
        return usage is None or (len(usage.body) > 1 and bool(usage.body[1] & 0x04))

    def row(self) -> dict:
        pem = base64.encodebytes(self.raw).decode()
        return {"subject": self.subject, "issuer": self.issuer, "cn": self.cn, "not_before": self.not_before, "not_after": self.not_after, "text": f"-----BEGIN CERTIFICATE-----\n{pem}-----END CERTIFICATE-----\n"}


def recovered_digest(cert: Certificate, signature: bytes) -> tuple[str, bytes]:
    """The digest name and digest inside an RSA signature with PKCS#1 v1.5 padding."""
    size = (cert.modulus.bit_length() + 7) // 8
    value = int.from_bytes(signature, "big")
    if not cert.modulus or value >= cert.modulus:
        raise BadSignature("no RSA signature of this key")
    block = pow(value, cert.exponent, cert.modulus).to_bytes(size, "big")
    m = re.fullmatch(rb"\x00\x01\xff{8,}\x00(.*)", block, re.S)
    if not m:
        raise BadSignature("bad padding")
    info = next(nodes(m[1]))
    if info.raw != m[1]:
        raise BadSignature("bytes after the digest")
    algorithm, digest = info.kids
    return DIGESTS.get(algorithm.kids[0].oid(), ""), digest.body


def rsa_signed(cert: Certificate, name: str | None, data: bytes, signature: bytes) -> bool:
    try:
        found, digest = recovered_digest(cert, signature)
    except (BadSignature, ValueError, IndexError, StopIteration):
        return False
    return bool(name) and found == name and hmac.compare_digest(digest, hashlib.new(name, data).digest())


def pem_certificates(text: str) -> list[Certificate]:
    """The certificates of a PEM text; what cannot be read is left out."""
    out = []
    for m in re.findall(r"-----BEGIN CERTIFICATE-----(.*?)-----END", text, re.S):
        with suppress(ValueError, IndexError, StopIteration):
            out.append(Certificate(base64.b64decode(m)))
    return out


def system_anchors() -> str:
    """The PEM text of the anchors that this machine trusts; empty if it has none."""
    import ssl
    from pathlib import Path

    paths = ssl.get_default_verify_paths()
    files = [Path(paths.cafile)] if paths.cafile else sorted(Path(paths.capath).glob("*.pem")) if paths.capath else []
    return "\n".join(f.read_text(errors="replace") for f in files if f.is_file())


def trusted(cert: Certificate, others: list[Certificate], anchors: list[Certificate], at: datetime) -> None:
    """Raise unless a chain of valid certificates leads from ``cert`` to an anchor at that time; all issuers must be authorities."""
    for below in range(MOST_CHAIN):
        if not cert.not_before <= at <= cert.not_after:
            raise BadSignature(f"certificate of {cert.cn or cert.subject} is not valid at {at}")
        if any(cert.raw == a.raw for a in anchors):
            return
        above = [c for c in (*anchors, *others) if c.subject_raw == cert.issuer_raw and rsa_signed(c, cert.digest, cert.signed, cert.signature)]
        if not above:
            raise BadSignature(f"no trusted issuer of {cert.cn or cert.subject}")
        if above[0].raw == cert.raw:
            raise BadSignature("self-signed certificate is not trusted")
        fit = next((c for c in above if c.may_issue(below, any(c.raw == a.raw for a in anchors))), None)
        if fit is None:
            raise BadSignature(f"{above[0].cn or above[0].subject} may not issue certificates")
        cert = fit
    raise BadSignature("chain is too long")


def _stamped(token: bytes, data: bytes, anchors: list[Certificate]) -> tuple[datetime, dict]:
    """The time of an RFC 3161 time stamp token over ``data``, checked as signed data of its own; raises BadSignature."""
    content = next(nodes(token)).kids[1].kids[0].kids
    inner = next(k for k in content if k.tag == 0x30)
    if inner.kids[0].oid() != TIME_STAMP_INFO:
        raise BadSignature("no time stamp")
    info = next(nodes(next(nodes(inner.kids[1].body)).body))
    algorithm, imprint = info.kids[2].kids
    name = DIGESTS.get(algorithm.kids[0].oid())
    if name is None or not hmac.compare_digest(imprint.body, hashlib.new(name, data).digest()):
        raise BadSignature("the time stamp is of other data")
    at = asn1_time(next(k for k in info.kids[3:] if k.tag == 0x18))
    return at, check_cms(token, info.raw, at, anchors, at_time=at)


def check_stamp(token: bytes, data: bytes, anchors: list[Certificate]) -> dict:
    """Check a document time stamp (``ETSI.RFC3161``)."""
    at, got = _stamped(token, data, anchors)
    return got | {"verified_at": at}


def check_cms(cms: bytes, data: bytes, fallback: datetime | None, anchors: list[Certificate], sha1_content: bool = False, at_time: datetime | None = None) -> dict:
    """Check a detached CMS signature over ``data`` (its SHA-1 is the content with ``sha1_content``); raises BadSignature.

    The time is ``at_time``, else the signing-time attribute, else that of a valid time stamp of the signature, else
    ``fallback``, else now.
    """
    content = next(nodes(cms)).kids[1].kids[0].kids
    certs = [Certificate(c.raw) for k in content if k.tag == 0xA0 for c in k.kids if c.tag == 0x30]
    infos = [k for k in content if k.tag == 0x31][-1].kids
    if not infos:
        raise BadSignature("no signer")
    encapsulated = next(k for k in content if k.tag == 0x30)
    inner = encapsulated.kids[1].kids[0].body if len(encapsulated.kids) > 1 else None
    if sha1_content:
        if inner is None or not hmac.compare_digest(inner, hashlib.sha1(data).digest()):
            raise BadSignature("the document has changed")
        data = inner
    parts = infos[0].kids
    issuer, serial = parts[1].kids[:2] if parts[1].tag == 0x30 else (None, None)
    signer = next((c for c in certs if issuer is None or (c.issuer_raw == issuer.raw and c.serial == serial.number())), None)
    if signer is None:
        raise BadSignature("the signer's certificate is missing")
    name = DIGESTS.get(parts[2].kids[0].oid())
    if name is None:
        raise BadSignature("unknown digest")
    attributes = parts[3] if parts[3].tag == 0xA0 else None
    signature = parts[5 if attributes else 4].body
    at = None
    if attributes:
        values = {a.kids[0].oid(): a.kids[1].kids[0] for a in attributes.kids}
        if MESSAGE_DIGEST not in values or not hmac.compare_digest(values[MESSAGE_DIGEST].body, hashlib.new(name, data).digest()):
            raise BadSignature("the document has changed")
        at = asn1_time(values[SIGNING_TIME]) if SIGNING_TIME in values else at
        data = b"\x31" + attributes.raw[1:]
    if not rsa_signed(signer, name, data, signature):
        raise BadSignature("the signature does not fit the certificate")
    unsigned = next((k for k in parts[5:] if k.tag == 0xA1), None)
    token = next((a.kids[1].kids[0].raw for a in (unsigned.kids if unsigned else []) if a.kids[0].oid() == TIME_STAMP), None)
    if at is None and token is not None:
        at = _stamped(token, signature, anchors)[0]
    at = at_time or at or fallback or datetime.now()
    trusted(signer, certs, anchors, at)
    return {"certs": [c.row() for c in [signer, *(c for c in certs if c is not signer)]], "verified_at": at}


def check_pkcs1(certs: list[bytes], signature: bytes, data: bytes, at: datetime | None, anchors: list[Certificate]) -> dict:
    """Check a PKCS#1 signature (``adbe.x509.rsa_sha1``): an octet string with the RSA value, the certificates apart."""
    chain = [Certificate(c) for c in certs]
    if not chain:
        raise BadSignature("no certificate")
    value = next(nodes(signature)).body if signature[:1] == b"\x04" else signature
    name, digest = recovered_digest(chain[0], value)
    if not name or not hmac.compare_digest(digest, hashlib.new(name, data).digest()):
        raise BadSignature("the document has changed")
    at = at or datetime.now()
    trusted(chain[0], chain[1:], anchors, at)
    return {"certs": [c.row() for c in chain], "verified_at": at}


# Private keys: PKCS#12 files and enveloped data.
PBES2, PBE_3DES = "1.2.840.113549.1.5.13", "1.2.840.113549.1.12.1.3"
CIPHERS = {"2.16.840.1.101.3.4.1.2": ("aes", 16), "2.16.840.1.101.3.4.1.22": ("aes", 24), "2.16.840.1.101.3.4.1.42": ("aes", 32), "1.2.840.113549.3.7": ("3des", 24)}
MACS = {"1.2.840.113549.2.7": "sha1", "1.2.840.113549.2.9": "sha256", "1.2.840.113549.2.10": "sha384", "1.2.840.113549.2.11": "sha512"}
KEY_BAG, SHUT_KEY_BAG, CERT_BAG = "1.2.840.113549.1.12.10.1.1", "1.2.840.113549.1.12.10.1.2", "1.2.840.113549.1.12.10.1.3"


class PrivateKey(NamedTuple):
    modulus: int
    exponent: int

    def open(self, value: bytes) -> bytes | None:
        """The message of an RSA value with PKCS#1 v1.5 padding."""
        size = (self.modulus.bit_length() + 7) // 8
        n = int.from_bytes(value, "big")
        m = re.fullmatch(rb"\x00\x02[^\x00]{8,}\x00(.*)", pow(n, self.exponent, self.modulus).to_bytes(size, "big"), re.S) if n < self.modulus else None
        return m[1] if m else None


def _open_with(kind: str, key: bytes, iv: bytes, data: bytes) -> bytes:
    from .security import cbc_open

    plain = cbc_open(kind, key, iv, data)
    pad = plain[-1] if plain else 0
    if not 1 <= pad <= len(iv) or plain[-pad:] != bytes([pad]) * pad:
        raise BadSignature("wrong password or key")
    return plain[:-pad]


def pkcs12_key(digest: str, password: str, salt: bytes, rounds: int, purpose: int, size: int) -> bytes:
    """The key derivation of PKCS#12."""
    block = 128 if digest in ("sha384", "sha512") else 64
    secret = password.encode("utf-16-be") + b"\0\0"
    fill = lambda b: (b * (block * -(-len(b) // block) // len(b) + 1))[: block * -(-len(b) // block)] if b else b""
    start, pool, out = bytes([purpose]) * block, fill(salt) + fill(secret), b""
    while len(out) < size:
        a = hashlib.new(digest, start + pool).digest()
        for _ in range(rounds - 1):
            a = hashlib.new(digest, a).digest()
        out += a
        add = int.from_bytes((a * block)[:block], "big") + 1
        pool = b"".join(((int.from_bytes(pool[i : i + block], "big") + add) % (1 << 8 * block)).to_bytes(block, "big") for i in range(0, len(pool), block))
    return out[:size]


def _decrypted(algorithm: Node, data: bytes, password: str) -> bytes:
    name, parameters = algorithm.kids[0].oid(), algorithm.kids[1]
    if name == PBE_3DES:
        salt, rounds = parameters.kids[0].body, parameters.kids[1].number()
        return _open_with("3des", pkcs12_key("sha1", password, salt, rounds, 1, 24), pkcs12_key("sha1", password, salt, rounds, 2, 8), data)
    if name != PBES2:
        raise BadSignature(f"key file cipher {name} is not supported")
    derive, cipher = parameters.kids
    settings = derive.kids[1].kids
    digest = next((MACS.get(k.kids[0].oid()) for k in settings[2:] if k.tag == 0x30), "sha1")
    kind, size = CIPHERS[cipher.kids[0].oid()]
    return _open_with(kind, hashlib.pbkdf2_hmac(digest, password.encode(), settings[0].body, settings[1].number(), size), cipher.kids[1].body, data)


def _private_key(info: bytes) -> PrivateKey:
    numbers = next(nodes(next(nodes(info)).kids[2].body)).kids
    return PrivateKey(numbers[1].number(), numbers[3].number())


def read_pkcs12(data: bytes, password: str) -> tuple[PrivateKey | None, list[Certificate]]:
    """The RSA key and the certificates of a PKCS#12 file; a wrong password raises BadSignature."""
    top = next(nodes(data)).kids
    safe = next(nodes(top[1].kids[1].body)).body
    if len(top) > 2:
        info, salt = top[2].kids[:2]
        rounds = top[2].kids[2].number() if len(top[2].kids) > 2 else 1
        digest = DIGESTS.get(info.kids[0].kids[0].oid(), "sha1")
        size = hashlib.new(digest).digest_size
        if not hmac.compare_digest(hmac.new(pkcs12_key(digest, password, salt.body, rounds, 3, size), safe, digest).digest(), info.kids[1].body):
            raise BadSignature("wrong password of the key file")
    key, certs = None, []
    for part in next(nodes(safe)).kids:
        inner = next(nodes(part.kids[1].body))
        if inner.tag == 0x04:
            bags = inner.body
        else:
            shut = inner.kids[1].kids
            bags = _decrypted(shut[1], shut[2].body, password)
        for bag in next(nodes(bags)).kids:
            kind, value = bag.kids[0].oid(), bag.kids[1].kids[0]
            if kind == KEY_BAG:
                key = _private_key(value.raw)
            elif kind == SHUT_KEY_BAG:
                key = _private_key(_decrypted(value.kids[0], value.kids[1].body, password))
            elif kind == CERT_BAG:
                certs.append(Certificate(value.kids[1].kids[0].body))
    return key, certs


def open_envelope(cms: bytes, key: PrivateKey, certs: list[Certificate]) -> bytes | None:
    """The content of enveloped data for the recipient that one of ``certs`` names; None if it is for others."""
    content = next(nodes(cms)).kids[1].kids[0].kids
    shut = next(k for k in content if k.tag == 0x30).kids
    for r in next(k for k in content if k.tag == 0x31).kids:
        if r.tag != 0x30 or r.kids[1].tag != 0x30:
            continue
        issuer, serial = r.kids[1].kids
        if any(c.issuer_raw == issuer.raw and c.serial == serial.number() for c in certs) and (secret := key.open(r.kids[3].body)) is not None:
            kind, size = CIPHERS.get(shut[1].kids[0].oid(), ("", 0))
            if len(secret) == size:
                return _open_with(kind, secret, shut[1].kids[1].body, shut[2].body)
    return None
