"""The standard security handler: passwords to keys, and decryption with RC4 and AES."""

from __future__ import annotations

import ctypes
import hashlib
from functools import lru_cache

PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class WrongPassword(ValueError):
    pass


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@lru_cache(maxsize=1)
def _boxes() -> tuple[bytes, bytes, dict[int, bytes]]:
    """The S-box, its inverse and multiplication rows, made from the field's arithmetic."""
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(b for b in range(1, 256) if _times(a, b) == 1)
            inverse[a], inverse[b] = b, a
    box = bytearray(256)
    for a, x in enumerate(inverse):
        y = x
        for k in range(1, 5):
            y ^= ((x << k) | (x >> (8 - k))) & 255
        box[a] = y ^ 0x63
    back = bytearray(256)
    for a, x in enumerate(box):
        back[x] = a
    return bytes(box), bytes(back), {m: bytes(_times(a, m) for a in range(256)) for m in (2, 3, 9, 11, 13, 14)}


@lru_cache(maxsize=64)
def _round_keys(key: bytes) -> list[bytes]:
    box, n = _boxes()[0], len(key) // 4
    words, rcon = [key[i : i + 4] for i in range(0, len(key), 4)], 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes([box[w[1]] ^ rcon, box[w[2]], box[w[3]], box[w[0]]])
            rcon = _times(rcon, 2)
        elif n > 6 and i % n == 4:
            w = bytes(box[x] for x in w)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], w, strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(16, "big")


ROWS = [(i + 4 * (i % 4)) % 16 for i in range(16)]
ROWS_BACK = [(i - 4 * (i % 4)) % 16 for i in range(16)]


def _encrypt_block(keys: list[bytes], block: bytes) -> bytes:
    box, _, m = _boxes()
    s = _xor(block, keys[0])
    for r, k in enumerate(keys[1:], 1):
        t = bytes(box[s[i]] for i in ROWS)
        if r < len(keys) - 1:
            t = b"".join(bytes((m[2][a] ^ m[3][b] ^ c ^ d, a ^ m[2][b] ^ m[3][c] ^ d, a ^ b ^ m[2][c] ^ m[3][d], m[3][a] ^ b ^ c ^ m[2][d])) for a, b, c, d in (t[i : i + 4] for i in range(0, 16, 4)))
        s = _xor(t, k)
    return s


def _decrypt_block(keys: list[bytes], block: bytes) -> bytes:
    _, back, m = _boxes()
    s = _xor(block, keys[-1])
    for r in range(len(keys) - 2, -1, -1):
        s = _xor(bytes(back[s[i]] for i in ROWS_BACK), keys[r])
        if r:
            s = b"".join(bytes((m[14][a] ^ m[11][b] ^ m[13][c] ^ m[9][d], m[9][a] ^ m[14][b] ^ m[11][c] ^ m[13][d], m[13][a] ^ m[9][b] ^ m[14][c] ^ m[11][d], m[11][a] ^ m[13][b] ^ m[9][c] ^ m[14][d])) for a, b, c, d in (s[i : i + 4] for i in range(0, 16, 4)))
    return s


@lru_cache(maxsize=1)
def _native():
    """The AES of the crypto library that Python's hashes come from; None where it cannot be reached."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        for name in ("EVP_CIPHER_CTX_new", "EVP_aes_128_cbc", "EVP_aes_192_cbc", "EVP_aes_256_cbc", "EVP_des_ede3_cbc"):
            getattr(lib, name).restype = ctypes.c_void_p
        lib.EVP_CIPHER_CTX_free.argtypes = [ctypes.c_void_p]
        lib.EVP_CIPHER_CTX_set_padding.argtypes = [ctypes.c_void_p, ctypes.c_int]
        lib.EVP_CipherInit_ex.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_void_p, ctypes.c_char_p, ctypes.c_char_p, ctypes.c_int]
        lib.EVP_CipherUpdate.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.POINTER(ctypes.c_int), ctypes.c_char_p, ctypes.c_int]
    except (ImportError, OSError, AttributeError):
        return None
    return lib


def _native_cbc(lib, cipher: str, key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes | None:
    made = lib.EVP_CIPHER_CTX_new()
    try:
        kind = getattr(lib, f"EVP_{cipher}_cbc")()
        if not lib.EVP_CipherInit_ex(made, kind, None, key, iv, int(encrypt)):
            return None
        lib.EVP_CIPHER_CTX_set_padding(made, 0)
        out, n = ctypes.create_string_buffer(len(data) + 32), ctypes.c_int(0)
        return out.raw[: n.value] if lib.EVP_CipherUpdate(made, out, ctypes.byref(n), data, len(data)) else None
    finally:
        lib.EVP_CIPHER_CTX_free(made)


def aes_cbc(key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes:
    """CBC over whole blocks, without padding; a partial last block is left out."""
    data = data[: len(data) // 16 * 16]
    if data and len(key) in (16, 24, 32) and len(iv) == 16 and (lib := _native()) is not None and (done := _native_cbc(lib, f"aes_{8 * len(key)}", key, iv, data, encrypt)) is not None:
        return done
    keys, out = _round_keys(key), []
    for at in range(0, len(data) // 16 * 16, 16):
        block = data[at : at + 16]
        if encrypt:
            iv = _encrypt_block(keys, _xor(block, iv))
            out.append(iv)
        else:
            out.append(_xor(_decrypt_block(keys, block), iv))
            iv = block
    return b"".join(out)


def cbc_open(kind: str, key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC decryption by ``aes`` or ``3des``, padding left on; the latter needs the crypto library."""
    if kind == "aes":
        return aes_cbc(key, iv, data, False)
    done = _native_cbc(lib, "des_ede3", key, iv, data, False) if (lib := _native()) is not None else None
    if done is None:
        raise ValueError("triple DES is not at hand")
    return done


def aes_open(key: bytes, data: bytes) -> bytes:
    """Data as PDF stores it: the initial vector first, PKCS padding at the end."""
    plain = aes_cbc(key, data[:16], data[16:], False)
    return plain[: -plain[-1]] if plain and 1 <= plain[-1] <= 16 else plain


# Keys depend on these values only: files of one series that share them derive each key once.
@lru_cache(maxsize=256)
def hash_r6(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    k = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return k
    i = 0
    while True:
        e = aes_cbc(k[:16], k[16:32], (password + k + user) * 64, True)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Security:
    """What all handlers share: crypt filters and the decryption of strings and streams with the document's ``key``."""

    key: bytes
    role: str | None

    def __init__(self, encrypt: dict):
        self.v = int(encrypt.get("V", 0))
        if self.v < 1 or self.v > 5:
            raise WrongPassword(f"encryption version {self.v} is not supported")
        self.bits = int(encrypt.get("Length", 40)) if self.v in (2, 3) else 128 if self.v == 4 else 256 if self.v == 5 else 40
        self.meta = encrypt.get("EncryptMetadata", True)
        self.filters = encrypt.get("CF", {})
        self.stream_filter = encrypt.get("StmF", "Identity") if self.v >= 4 else "RC4"
        self.string_filter = encrypt.get("StrF", "Identity") if self.v >= 4 else "RC4"
        self.file_filter = encrypt.get("EFF", self.stream_filter)
        self.raw, self.role = encrypt, None

    def method(self, name: str) -> str:
        if name == "RC4":
            return "V2"
        return "None" if name == "Identity" else str(self.filters.get(name, {}).get("CFM", "None"))

    def decrypt(self, data: bytes, num: int, gen: int, name: str) -> bytes:
        kind = self.method(name)
        if kind == "None":
            return data
        if kind == "AESV3":
            return aes_open(self.key, data)
        k = self.key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (b"sAlT" if kind == "AESV2" else b"")
        k = hashlib.md5(k).digest()[: min(16, len(self.key) + 5)]
        return aes_open(k, data) if kind == "AESV2" else rc4(k, data)


@lru_cache(maxsize=256)
def _legacy_key(password: bytes, o: bytes, p: int, first_id: bytes, r: int, n: int, meta: bool) -> bytes:
    k = hashlib.md5((password + PADDING)[:32] + o + p.to_bytes(4, "little") + first_id + (b"\xff" * 4 if r >= 4 and not meta else b"")).digest()
    for _ in range(50 if r >= 3 else 0):
        k = hashlib.md5(k[:n]).digest()
    return k[:n]


@lru_cache(maxsize=256)
def _legacy_check(k: bytes, first_id: bytes, r: int) -> bytes:
    """What /U begins with under the key."""
    if r == 2:
        return rc4(k, PADDING)
    check = hashlib.md5(PADDING + first_id).digest()
    for i in range(20):
        check = rc4(bytes(b ^ i for b in k), check)
    return check


@lru_cache(maxsize=256)
def _legacy_user(password: bytes, o: bytes, r: int, n: int) -> bytes:
    """The user's password, padded, that /O holds under the owner's."""
    k = hashlib.md5((password + PADDING)[:32]).digest()
    for _ in range(50 if r >= 3 else 0):
        k = hashlib.md5(k).digest()
    user = o
    for i in range(19, -1, -1) if r >= 3 else (0,):
        user = rc4(bytes(b ^ i for b in k[:n]), user)
    return user


class StandardSecurity(Security):
    """Opens a document with the first of ``passwords`` (the empty one is tried before them) that fits as user or owner."""

    def __init__(self, encrypt: dict, first_id: bytes, passwords: list[str] = ()):
        super().__init__(encrypt)
        self.r = int(encrypt.get("R", 2))
        self.o, self.u, self.p, self.id = encrypt.get("O", b""), encrypt.get("U", b""), int(encrypt.get("P", 0)) & 0xFFFFFFFF, first_id
        from ..functions.scalars import pdfdoc_bytes

        for password in ["", *passwords]:
            raw = password.encode()[:127] if self.r >= 5 else pdfdoc_bytes(password)
            for role, key in (("owner", self.as_owner(raw)), ("user", self.as_user(raw))):
                if key:
                    self.key, self.role = key, role
                    if self.r >= 5:
                        self._check_permissions()
                    return
        raise WrongPassword("no password fits")

    @property
    def permissions(self) -> int:
        return 0xFFFFFFFF if self.role == "owner" else self.p

    def _legacy_key(self, password: bytes) -> bytes:
        n = self.bits // 8 if self.r >= 3 else 5
        return _legacy_key(password, self.o[:32], self.p, self.id, self.r, n, self.meta)

    def as_user(self, password: bytes) -> bytes | None:
        if self.r >= 5:
            if hash_r6(password, self.u[32:40], b"", self.r) == self.u[:32]:
                return aes_cbc(hash_r6(password, self.u[40:48], b"", self.r), bytes(16), self.raw.get("UE", b"")[:32], False)
            return None
        k = self._legacy_key(password)
        check = _legacy_check(k, self.id, self.r)
        return k if check == self.u[: len(check)] else None

    def as_owner(self, password: bytes) -> bytes | None:
        if self.r >= 5:
            if hash_r6(password, self.o[32:40], self.u[:48], self.r) == self.o[:32]:
                return aes_cbc(hash_r6(password, self.o[40:48], self.u[:48], self.r), bytes(16), self.raw.get("OE", b"")[:32], False)
            return None
        n = self.bits // 8 if self.r >= 3 else 5
        return self.as_user(_legacy_user(password, self.o[:32], self.r, n))

    def _check_permissions(self) -> None:
        """Revision 6 and 5 keep the permissions a second time, encrypted: where these don't agree, the file was changed."""
        perms = self.raw.get("Perms")
        if isinstance(perms, bytes) and len(perms) == 16:
            plain = aes_cbc(self.key, bytes(16), perms, False)  # a single block: as without chaining
            if plain[9:12] != b"adb" or int.from_bytes(plain[:4], "little") != self.p or plain[8:9] != (b"T" if self.meta else b"F"):
                raise WrongPassword("the permissions were changed")


class PublicKeySecurity(Security):
    """Opens a document for the recipient whose key and certificates are given: the seed and permissions are in an envelope."""

    def __init__(self, encrypt: dict, key, certs: list):
        from .certificates import open_envelope

        super().__init__(encrypt)
        if encrypt.get("SubFilter") not in ("adbe.pkcs7.s3", "adbe.pkcs7.s4", "adbe.pkcs7.s5"):
            raise WrongPassword(f"public-key format {encrypt.get('SubFilter')} is not supported")
        own = self.filters.get(self.stream_filter) or self.filters.get(self.string_filter) or {}
        envelopes = encrypt.get("Recipients") or own.get("Recipients") or []
        envelopes = envelopes if isinstance(envelopes, list) else [envelopes]
        self.meta = own.get("EncryptMetadata", self.meta)
        opened = next((x for e in envelopes if (x := open_envelope(e, key, certs))), None) if key else None
        if opened is None or len(opened) < 20:
            raise WrongPassword("no key of a recipient is given")
        digest = hashlib.sha256 if self.v == 5 else hashlib.sha1
        made = digest(opened[:20] + b"".join(envelopes) + (b"" if self.meta else b"\xff" * 4)).digest()
        self.key, self.role, self.p = made[: self.bits // 8], "recipient", int.from_bytes(opened[20:24], "big")

    @property
    def permissions(self) -> int:
        return self.p


def security_handler(encrypt: dict, first_id: bytes, passwords: list[str] = (), recipient: tuple | None = None) -> Security:
    """The handler that an encryption dictionary names. ``recipient`` is (private key, certificates)."""
    if encrypt.get("Filter") == "Standard":
        return StandardSecurity(encrypt, first_id, passwords)
    if str(encrypt.get("SubFilter", "")).startswith("adbe.pkcs7."):
        return PublicKeySecurity(encrypt, *(recipient or (None, [])))
    raise WrongPassword(f"security handler {encrypt.get('Filter')} is not supported")
