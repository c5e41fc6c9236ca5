"""Stream filters of PDF: decoders by name, applied in order with their parameters."""

from __future__ import annotations

import re
import zlib

import numpy as np

PASS_THROUGH = {"DCTDecode", "DCT", "JPXDecode"}
UNSUPPORTED = {"CCITTFaxDecode", "CCF", "JBIG2Decode"}
SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode"}
BLANK = re.compile(rb"[\x00\t\n\x0c\r ]+")


#: Bytes that one stream may decode to.
MOST_BYTES = 1 << 28


class UnsupportedFilter(ValueError):
    pass


class TooLarge(ValueError):
    """A stream that decodes to more than MOST_BYTES."""


def _checked(n: int) -> None:
    if n > MOST_BYTES:
        raise TooLarge(f"a stream decodes to more than {MOST_BYTES} bytes")


def flate(data: bytes) -> bytes:
    """zlib, gzip or raw deflate; a corrupt tail keeps what came before it."""
    for window in (47, -15):
        z, out, size = zlib.decompressobj(window), [], 0
        try:
            for at in range(0, len(data), 1 << 18):
                piece = data[at : at + (1 << 18)]
                while piece:
                    out.append(z.decompress(piece, 1 << 24))
                    piece = z.unconsumed_tail
                    size += len(out[-1])
                    _checked(size)
            out.append(z.flush())
            return b"".join(out)
        except zlib.error:
            got = b"".join(out)
            got += _tail(data, got, window)
            if got:
                return got
    return b""


def _tail(data: bytes, got: bytes, window: int) -> bytes:
    """What a corrupt stream still gives byte by byte beyond the whole chunks."""
    z, n, out = zlib.decompressobj(window), 0, []
    try:
        for b in data:
            piece = z.decompress(bytes([b]))
            n += len(piece)
            if n > len(got):
                out.append(piece[max(0, len(piece) - (n - len(got))) :])
    except zlib.error:
        pass
    return b"".join(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    """Variable-width LZW, 9 to 12 bits, clear 256 and end 257; codes widen ``early`` entries ahead."""
    out, table, width, previous, acc, bits = bytearray(), {}, 9, b"", 0, 0
    nxt = 258
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        while bits >= width:
            code = (acc >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            acc &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, previous, nxt = {}, 9, b"", 258
                continue
            if code < 256:
                entry = bytes([code])
            elif code in table:
                entry = table[code]
            elif code == nxt and previous:
                entry = previous + previous[:1]
            else:
                return bytes(out)
            out += entry
            _checked(len(out))
            if previous and nxt < 4096:
                table[nxt] = previous + entry[:1]
                nxt += 1
            previous = entry
            width = 9 + (nxt + early >= 512) + (nxt + early >= 1024) + (nxt + early >= 2048)
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    data = BLANK.sub(b"", data).removeprefix(b"<~").partition(b"~")[0]
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group) - 1
        group += [84] * (5 - len(group))
        out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[:n]
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        _checked(len(out))
    return bytes(out)


def unpredict(data: bytes, parms: dict) -> bytes:
    """Undo the TIFF predictor (8 bits) or the PNG predictors, whose tag stands in front of each row."""
    kind, colors = int(parms.get("Predictor", 1)), int(parms.get("Colors", 1))
    depth, columns = int(parms.get("BitsPerComponent", 8)), int(parms.get("Columns", 1))
    if kind < 2:
        return data
    pixel, row = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    if kind == 2:
        full = np.frombuffer(data[: len(data) // row * row], np.uint8).reshape(-1, columns, colors) if depth == 8 else None
        if full is None:
            raise UnsupportedFilter("TIFF predictor of another depth")
        return np.cumsum(full, axis=1, dtype=np.uint8).tobytes()
    if len(data) % (row + 1) == 0 and set(data[:: row + 1]) <= {2}:  # rows that only differ from the one above
        return np.cumsum(np.frombuffer(data, np.uint8).reshape(-1, row + 1)[:, 1:], axis=0, dtype=np.uint8).tobytes()
    out, above = bytearray(), bytearray(row)
    for at in range(0, len(data), row + 1):
        tag, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        for i in range(len(line)):
            a, b = line[i - pixel] if i >= pixel else 0, above[i]
            c = above[i - pixel] if i >= pixel else 0
            if tag == 1:
                line[i] = (line[i] + a) & 255
            elif tag == 2:
                line[i] = (line[i] + b) & 255
            elif tag == 3:
                line[i] = (line[i] + (a + b) // 2) & 255
            elif tag == 4:
                p = a + b - c
                line[i] = (line[i] + min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]) & 255
        out += line
        above = line + bytearray(row - len(line))
    return bytes(out)


def decode(data: bytes, filters: list[str], parms: list[dict | None] | None = None, until: str | None = None) -> bytes:
    """All filters in order, or those before the first one called ``until``. Image filters pass their data on; unknown and unsupported ones raise ``UnsupportedFilter``."""
    for i, name in enumerate(filters):
        p = (parms[i] if parms and i < len(parms) else None) or {}
        name = SHORT.get(name, name)
        if until is not None and name == SHORT.get(until, until):
            break
        if name == "FlateDecode":
            data = unpredict(flate(data), p)
        elif name == "LZWDecode":
            data = unpredict(lzw(data, int(p.get("EarlyChange", 1))), p)
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "ASCII85Decode":
            data = ascii85(data)
        elif name == "RunLengthDecode":
            data = run_length(data)
        elif name in PASS_THROUGH or name == "Crypt":
            continue
        else:
            raise UnsupportedFilter(name)
    return data
