"""Text encodings, glyph names, dates and numerals: Python kernels and, where Spark can say it, column expressions."""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charsets

# Code points of PDFDocEncoding that differ from Latin-1.
PDFDOC = {0x18 + i: c for i, c in enumerate("˘ˇˆ˙˝˛˚˜")} | {0x80 + i: c for i, c in enumerate("•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž")} | {0xA0: "€"}
# StandardEncoding beyond ASCII, by code.
STANDARD = {0x27: "’", 0x60: "‘"} | {0xA1 + i: c for i, c in enumerate("¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ")} | {0xB1 + i: c for i, c in enumerate("–†‡·")} | {0xB6 + i: c for i, c in enumerate("¶•‚„”»…‰")} | {0xBF: "¿"}
STANDARD |= {0xC1 + i: c for i, c in enumerate("`´ˆ˜¯˘˙¨")} | {0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß"}
# Glyph names that no rule gives.
GLYPHS = dict(zip(
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash "
    "zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright "
    "asciicircum underscore grave braceleft bar braceright asciitilde quoteleft quoteright quotedblleft quotedblright quotesinglbase quotedblbase "
    "endash emdash bullet ellipsis dagger daggerdbl perthousand guilsinglleft guilsinglright guillemotleft guillemotright fi fl florin fraction "
    "exclamdown questiondown cent sterling yen currency Euro section paragraph copyright registered trademark degree plusminus minus multiply divide "
    "mu logicalnot brokenbar ordfeminine ordmasculine periodcentered macron acute dieresis cedilla circumflex tilde breve dotaccent ring hungarumlaut "
    "ogonek caron AE ae OE oe Oslash oslash Lslash lslash Eth eth Thorn thorn germandbls dotlessi onehalf onequarter threequarters "
    "onesuperior twosuperior threesuperior ff ffi ffl".split(),
    " !\"#$%&'()*+,-./" "0123456789:;<=>?@[\\]" "^_`{|}~‘’“”‚„" "–—•…†‡‰‹›«»ﬁﬂƒ⁄" "¡¿¢£¥¤€§¶©®™°±−×÷" "µ¬¦ªº·¯´¨¸ˆ˜˘˙˚˝" "˛ˇÆæŒœØøŁłÐðÞþßı½¼¾" "¹²³ﬀﬃﬄ", strict=True,
))
# Suffixes of accented letters and their combining marks.
ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌", "breve": "̆", "macron": "̄", "dotaccent": "̇", "ogonek": "̨", "hungarumlaut": "̋", "commaaccent": "̦"}
# Further glyph names, those of the Symbol font among them.
GLYPHS |= dict(zip(
    "universal existential suchthat congruent therefore perpendicular minute second lessequal greaterequal infinity club diamond heart spade arrowboth arrowleft arrowup arrowright arrowdown "
    "proportional partialdiff notequal equivalence approxequal arrowdblboth arrowdblleft arrowdblup arrowdblright arrowdbldown aleph Ifraktur Rfraktur weierstrass circlemultiply circleplus "
    "emptyset intersection union propersuperset reflexsuperset notsubset propersubset reflexsubset element notelement angle gradient product radical dotmath logicaland logicalor lozenge "
    "angleleft angleright summation integral similar asteriskmath theta1 sigma1 phi1 omega1 Upsilon1 carriagereturn radicalex "
    "oneeighth threeeighths fiveeighths seveneighths onethird twothirds onedotenleader twodotenleader figuredash colonmonetary threequartersemdash "
    "parenleftsuperior parenrightsuperior parenleftinferior parenrightinferior "
    "dcroat Dcroat hbar Hbar tbar Tbar eng Eng kgreenlandic longs IJ ij napostrophe nbspace nonbreakingspace softhyphen sfthyphen middot overscore estimated litre numero peseta franc".split(),
    "∀∃∋≅∴⊥′″≤≥∞♣♦♥♠↔←↑→↓" "∝∂≠≡≈⇔⇐⇑⇒⇓ℵℑℜ℘⊗⊕" "∅∩∪⊃⊇⊄⊂⊆∈∉∠∇∏√⋅∧∨◊" "〈〉∑∫∼∗ϑςϕϖϒ↵‾" "⅛⅜⅝⅞⅓⅔․‥‒₡—" "⁽⁾₍₎" "đĐħĦŧŦŋŊĸſĲĳŉ\u00a0\u00a0\u00ad\u00ad·¯℮ℓ№₧₣", strict=True,
)) | {"rupiah": "Rp"}
# Suffixes of small capitals, old-style, raised and lowered figures.
VARIANTS = re.compile("(.+)(small|oldstyle|superior|inferior|fitted)")
RAISED, LOWERED = dict(zip("0123456789n", "⁰¹²³⁴⁵⁶⁷⁸⁹ⁿ", strict=True)), dict(zip("0123456789", "₀₁₂₃₄₅₆₇₈₉", strict=True))
GREEK = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron Pi Rho Sigma Tau Upsilon Phi Chi Psi Omega".split()


def _numbered(n: int) -> str:
    """The Cyrillic and Hebrew letters that have numbers for names."""
    for first, letters in ((10017, "АБВГДЕЁ"), (10065, "абвгдеё")):
        if first <= n < first + 7:
            return letters[n - first]
    for first, last, start in ((10024, 10049, 0x416), (10072, 10097, 0x436), (57664, 57690, 0x5D0)):
        if first <= n <= last:
            return chr(start + n - first)
    return ""


# Scripts whose letters have glyph names of the letter's own name and the script's.
SCRIPTS = re.compile("(.+?)(cyrillic|hebrew|arabic|hiragana|katakana|bopomofo)")


def _letter(name: str, script: str) -> str:
    case = "CAPITAL " if name[0].isupper() else "SMALL "
    for kind in (case if script == "cyrillic" else "", "SMALL " if name.endswith("small") else ""):
        try:
            return unicodedata.lookup(f"{script.upper()} {kind}LETTER {name.removesuffix('small').upper()}")
        except KeyError:
            continue
    return ""


def glyph_text(name: str) -> str:
    """The text of a glyph name: the part before a dot, joined parts, ``uniXXXX`` and ``uXXXX`` forms, listed and rule-made names; else empty."""
    out = []
    for part in name.partition(".")[0].split("_"):
        if part in GLYPHS:
            out.append(GLYPHS[part])
        elif len(part) == 1:
            out.append(part)
        elif m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", part):
            out.append(bytes.fromhex(m[1]).decode("utf-16-be", "ignore"))
        elif m := re.fullmatch(r"u([0-9A-F]{4,6})", part):
            code = int(m[1], 16)
            out.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "")
        elif part[1:] in ACCENTS and part[0].isalpha():
            out.append(unicodedata.normalize("NFC", part[0] + ACCENTS[part[1:]]))
        elif part.capitalize() in GREEK:
            out.append(unicodedata.lookup(f"GREEK {'CAPITAL' if part[0].isupper() else 'SMALL'} LETTER {part.upper().replace('LAMBDA', 'LAMDA')}"))
        elif m := re.fullmatch(r"afii(\d{5})", part):
            out.append(_numbered(int(m[1])))
        elif (m := SCRIPTS.fullmatch(part)) and (letter := _letter(m[1], m[2])):
            out.append(letter)
        elif m := VARIANTS.fullmatch(part):
            base = glyph_text(m[1]) or glyph_text(m[1].lower())
            if m[2] == "small":
                base = base.lower() if m[1].lower() not in ACCENTS else glyph_text(m[1].lower())
            out.append({"superior": RAISED, "inferior": LOWERED}.get(m[2], {}).get(base, base))
    return "".join(out)


def _table(kind: str) -> list[str]:
    if kind == "WinAnsiEncoding":
        return [bytes([i]).decode("cp1252", "ignore") or "•" if i > 31 else chr(i) for i in range(256)]
    if kind == "MacRomanEncoding":
        return [bytes([i]).decode("mac_roman").replace("€", "¤").replace("Ω", "Ω") for i in range(256)]
    if kind == "PDFDocEncoding":
        return [PDFDOC.get(i, chr(i)) for i in range(256)]
    if kind == "MacExpertEncoding":
        glyphs = charsets.mac_expert_glyphs()
        return [glyph_text(glyphs[i]) if i in glyphs else "" for i in range(256)]
    if kind == "Symbol":
        return charsets.symbol_table()
    if kind == "ZapfDingbats":
        return charsets.dingbats_table()
    return [STANDARD.get(i, chr(i) if 31 < i < 127 else "") for i in range(256)]


ENCODINGS = {k: _table(k) for k in ("StandardEncoding", "WinAnsiEncoding", "MacRomanEncoding", "MacExpertEncoding", "PDFDocEncoding", "Symbol", "ZapfDingbats")}
TO_PDFDOC = {c: i for i, c in enumerate(ENCODINGS["PDFDocEncoding"])}


def text_string(raw: bytes) -> str:
    """A PDF text string: UTF-16 or UTF-8 by its mark, else PDFDocEncoding."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if raw[:2] == b"\xff\xfe":
        return raw[2:].decode("utf-16-le", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    table = ENCODINGS["PDFDocEncoding"]
    return "".join(table[b] for b in raw)


def hex_text(digits: str) -> str:
    """The text of a hex string; one that starts with 00 is read as UTF-16 as well."""
    raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
    return raw.decode("utf-16-be", "replace") if raw[:1] == b"\0" and len(raw) % 2 == 0 else text_string(raw)


def pdfdoc_bytes(text: str) -> bytes:
    return bytes(TO_PDFDOC.get(c, 0) for c in text)


DATE = re.compile(r"D:(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:(Z)|([+-])(\d\d)(?:'(\d\d)?'?)?)?")


def parse_date(text: str | None) -> tuple[datetime, int] | None:
    """(local time, minutes ahead of UTC) of a PDF date; missing parts are the first month and day and zero; None if it is no date."""
    m = DATE.search(text or "")
    if not m:
        return None
    y, mo, d, h, mi, s = (int(x) if x else least for x, least in zip(m.groups()[:6], (0, 1, 1, 0, 0, 0), strict=True))
    ahead = (int(m[9]) * 60 + int(m[10] or 0)) * (-1 if m[8] == "-" else 1) if m[8] else 0
    try:
        return datetime(y, mo, d, h, mi, s), ahead
    except ValueError:
        return None


def utc_date(text: str | None) -> datetime | None:
    got = parse_date(text)
    return got[0] - timedelta(minutes=got[1]) if got else None


def format_date(local: datetime, ahead: int | None) -> str:
    zone = "Z" if not ahead else f"{'+' if ahead > 0 else '-'}{abs(ahead) // 60:02d}'{abs(ahead) % 60:02d}"
    return f"D:{local:%Y%m%d%H%M%S}{zone}"


def date_columns(text: Column) -> tuple[Column, Column]:
    """The same as expressions: local time (no zone) and minutes ahead of UTC; null for what is no date."""
    pattern = r"D:(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:(Z)|([+-])(\d\d)(?:'(\d\d)?'?)?)?"

    def group(i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    parts = [F.when(group(i) == "", F.lit(least)).otherwise(group(i)) for i, least in zip(range(2, 7), ("01", "01", "00", "00", "00"), strict=True)]
    local = F.try_to_timestamp(F.concat(group(1), *parts), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    minutes = F.coalesce(group(9).try_cast("int"), F.lit(0)) * 60 + F.coalesce(group(10).try_cast("int"), F.lit(0))
    ahead = F.when(group(1) != "", F.when(group(8) == "-", -minutes).otherwise(minutes))
    return F.when(group(1) != "", local), ahead


ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: int) -> str:
    out = []
    for value, digits in ROMAN:
        out.append(digits * (n // value))
        n %= value
    return "".join(out)


def page_label(style: str | None, prefix: str | None, number: int) -> str:
    """One page label: D, R, r, A, a, or no style for the prefix alone."""
    body = ""
    if style == "D":
        body = str(number)
    elif style in ("R", "r"):
        body = roman(number) if style == "r" else roman(number).upper()
    elif style in ("A", "a") and number > 0:
        body = chr((number - 1) % 26 + ord(style)) * ((number - 1) // 26 + 1)
    return (prefix or "") + body


def roman_column(n: Column) -> Column:
    """Lower-case Roman numerals as an expression."""
    out, rest = F.lit(""), n
    for value, digits in ROMAN:
        out = F.concat(out, F.repeat(F.lit(digits), F.floor(rest / value).cast("int")))
        rest = rest % value
    return out


def label_column(style: Column, prefix: Column, n: Column) -> Column:
    alpha = F.repeat(F.char(F.lit(97) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))
    body = F.when(style == "D", n.cast("string")).when(style == "r", roman_column(n)).when(style == "R", F.upper(roman_column(n))).when(style == "a", alpha).when(style == "A", F.upper(alpha)).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), body)
