"""The object syntax of PDF: a tokenizer over bytes that builds Python values.

Names are ``Name``, references ``Ref``, strings ``bytes``, null is None; arrays and dictionaries are lists and dicts.
"""

from __future__ import annotations

import re
from typing import NamedTuple

SPACE = b"\0\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
TOKEN = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
REFERENCE = re.compile(rb"(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
IN_STRING = re.compile(rb"[\\()\r]")
# One lexeme with the blanks before it: plain name, reference, word, string and hex string without anything to resolve, sign. What fits none goes the long way.
_REGULAR = rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]"
_NAME = rb"/([^\0\t\n\x0c\r ()<>\[\]{}/%#]*+)(?!#)"
_REFERENCE = rb"(\d++)[\0\t\n\x0c\r ]++(\d++)[\0\t\n\x0c\r ]++R(?!" + _REGULAR + rb")"
_REST = rb"(" + _REGULAR + rb"++)|\(([^\\()\r]*+)\)|<((?:[0-9A-Fa-f]{2})*+)>|(<<|>>|[\[\]{})>]))"
LEXEME = re.compile(rb"[\0\t\n\x0c\r ]*+(?:" + _NAME + rb"|" + _REFERENCE + rb"|" + _REST)
BARE_LEXEME = re.compile(rb"[\0\t\n\x0c\r ]*+(?:" + _NAME + rb"|(?!)()()|" + _REST)
NAME_AT, REFERENCE_AT, WORD_AT, STRING_AT, HEX_AT, SIGN_AT = 1, 3, 4, 5, 6, 7
# A key with a name, a reference, a whole number or a hex string as its value.
ENTRY = re.compile(rb"[\0\t\n\x0c\r ]*+" + _NAME + rb"[\0\t\n\x0c\r ]*+(?:" + _NAME + rb"|" + _REFERENCE + rb"|([+-]?\d++)(?=[\0\t\n\x0c\r ()<>\[\]{}/%])|<((?:[0-9A-Fa-f]{2})*+)>)")
INTEGERS = re.compile(rb"([\t\n\x0c\r 0-9]*+)\]")
BLANKS, LINE_END = re.compile(rb"[\0\t\n\x0c\r ]*+"), re.compile(rb"[\r\n]")
ESCAPES = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
MOST_DEPTH = 200


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream(NamedTuple):
    info: dict
    raw: bytes


class Keyword(str):
    """A bare word that is no constant: an operator of a content stream, or ``obj``, ``stream`` and the like."""

    __slots__ = ()


class SyntaxProblem(ValueError):
    pass


END = Keyword("")
SIGNS = {b: Keyword(b.decode()) for b in (b"]", b"{", b"}", b")")} | {b">": Keyword(">>"), b">>": Keyword(">>")}


class _Known(dict):
    """Values of bytes seen before, up to a number of them."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, raw: bytes):
        v = self.make(raw)
        if len(raw) <= 32:
            if len(self) >= 20_000:
                self.clear()
            self[raw] = v
        return v


def _word(word: bytes):
    """A number, a constant or a ``Keyword``."""
    if NUMBER.match(word):
        return float(word) if b"." in word else int(word)
    if word[:1] in b"+-.0123456789" and (number := _odd_number(word)) is not None:
        return number
    return CONSTANTS[word] if word in CONSTANTS else Keyword(word.decode("latin-1"))


CONSTANTS = {b"true": True, b"false": False, b"null": None}
NAMES = _Known(lambda raw: Name(raw.decode("utf-8", "surrogateescape")))
KEYS = _Known(lambda raw: raw.decode("utf-8", "surrogateescape"))
WORDS = _Known(_word)


class Parser:
    """``words`` maps further bare words to values; a function of the word is called for its value."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True, words: dict[bytes, object] | None = None):
        self.data, self.at, self.references, self.words = data, at, references, words

    def skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            self.at = BLANKS.match(data, self.at).end()
            if self.at >= n or data[self.at] != 0x25:
                return
            m = LINE_END.search(data, self.at)
            self.at = m.start() if m else n

    def value(self, depth: int = 0):
        """The next value or ``Keyword``; ``END`` at the end of the data."""
        if depth > MOST_DEPTH:
            raise SyntaxProblem("nested too deeply")
        m = (LEXEME if self.references else BARE_LEXEME).match(self.data, self.at)
        if m is None:
            return self._value(depth)
        kind = m.lastindex
        if kind == WORD_AT:
            if self.words:
                return self._value(depth)
            self.at = m.end()
            return WORDS[m[WORD_AT]]
        self.at = m.end()
        if kind == NAME_AT:
            return NAMES[m[NAME_AT]]
        if kind == REFERENCE_AT:
            return Ref(int(m[2]), int(m[3]))
        if kind == STRING_AT:
            return m[STRING_AT]
        if kind == HEX_AT:
            return bytes.fromhex(m[HEX_AT].decode())
        sign = m[SIGN_AT]
        if sign == b"<<":
            self.at -= 2
            return self.dictionary(depth)
        return self.array(depth) if sign == b"[" else SIGNS[sign]

    def array(self, depth: int) -> list:
        if (m := INTEGERS.match(self.data, self.at)) and depth < MOST_DEPTH:
            self.at = m.end()
            return list(map(int, m[1].split()))
        out = []
        while True:
            v = self.value(depth + 1)
            if isinstance(v, Keyword):
                if v == "]" or v is END:
                    return out
                continue
            out.append(v)

    def _value(self, depth: int):
        """The same for whatever is no plain lexeme: comments, escapes, further words, the end."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            return END
        c = data[at]
        if c == 0x2F:
            return self.name()
        if c == 0x28:
            return self.string()
        if c == 0x5B:
            self.at += 1
            return self.array(depth)
        if c == 0x3C:
            return self.dictionary(depth) if data[at + 1 : at + 2] == b"<" else self.hex_string()
        if c in b"]{})":
            self.at += 1
            return Keyword(chr(c))
        if c == 0x3E:
            self.at += 2 if data[at + 1 : at + 2] == b">" else 1
            return Keyword(">>")
        if self.references and 0x30 <= c <= 0x39 and (m := REFERENCE.match(data, at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        m = TOKEN.match(data, at)
        self.at = m.end()
        word = m[0]
        v = WORDS[word]
        if self.words and word in self.words and (isinstance(v, Keyword) or word in CONSTANTS):
            found = self.words[word]
            return found(word) if callable(found) else found
        return v

    def name(self) -> Name:
        m = TOKEN.match(self.data, self.at + 1)
        raw = m[0] if m else b""
        self.at += 1 + len(raw)
        raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw)
        return Name(raw.decode("utf-8", "surrogateescape") if not raw.isascii() else raw.decode())

    def string(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(data):
            m = IN_STRING.search(data, at)
            stop = m.start() if m else len(data)
            out += data[at:stop]
            at = min(stop + 1, len(data))
            if m is None:
                break
            c = data[stop]
            if c == 0x5C and at < len(data):
                c = data[at]
                at += 1
                if 0x30 <= c <= 0x37:
                    stop = at
                    while stop < at + 2 and stop < len(data) and 0x30 <= data[stop] <= 0x37:
                        stop += 1
                    out.append(int(data[at - 1 : stop], 8) & 255)
                    at = stop
                elif c in b"\r\n":
                    at += c == 13 and data[at : at + 1] == b"\n"
                else:
                    out.append(ESCAPES.get(c, c))
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            if c == 13:
                at += data[at : at + 1] == b"\n"
                c = 10
            out.append(c)
        self.at = at
        return bytes(out)

    def hex_string(self) -> bytes:
        stop = self.data.find(b">", self.at)
        stop = len(self.data) if stop < 0 else stop
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : stop])
        self.at = stop + 1
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def dictionary(self, depth: int) -> dict:
        self.at += 2
        out, data, nulls = {}, self.data, False
        while True:
            # At the deepest level a value is an error, so there the long way is taken.
            while self.references and depth < MOST_DEPTH and (m := ENTRY.match(data, self.at)):
                self.at, kind = m.end(), m.lastindex
                out[KEYS[m[1]]] = NAMES[m[2]] if kind == 2 else Ref(int(m[3]), int(m[4])) if kind == 4 else WORDS[m[5]] if kind == 5 else bytes.fromhex(m[6].decode())
            k = self.value(depth + 1)
            if k is END or (isinstance(k, Keyword) and k == ">>"):
                return {a: b for a, b in out.items() if b is not None} if nulls else out
            if isinstance(k, Name):
                before = self.at
                v = self.value(depth + 1)
                if isinstance(v, Keyword):
                    self.at = before if v == ">>" else self.at
                    continue
                out[str(k)] = v
                nulls = nulls or v is None


def _odd_number(word: bytes) -> float | None:
    """Numbers with doubled signs or signs inside, as some writers leave them."""
    m = re.match(rb"[+-]*(\d*\.?\d*)", word)
    try:
        v = float(m[1])
    except ValueError:
        return None
    return -v if word.startswith(b"-") else v


SHOWN = _Known(lambda v: "/" + re.sub(r"[^!-~]|[#()<>\[\]{}/%]", lambda m: "".join(f"#{b:02X}" for b in m[0].encode("utf-8", "surrogateescape")), v))


def show(v) -> str:
    """A value in PDF syntax."""
    kind = type(v)
    if kind is Name:
        return SHOWN[v]
    if kind is int:
        return str(v)
    if kind is Ref:
        return f"{v.num} {v.gen} R"
    if kind is dict:
        return "<<" + " ".join([f"{SHOWN[k]} {show(x)}" for k, x in v.items()]) + ">>"
    if kind is list:
        return "[" + " ".join(map(show, v)) + "]"
    if isinstance(v, bytes):
        return f"<{v.hex().upper()}>"
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, Stream):
        return show(v.info) + " stream"
    return str(v)
