"""Fixed values of the fourteen core fonts: widths, and the code charts of Symbol, ZapfDingbats and MacExpert."""

from __future__ import annotations

# Widths of the printable ASCII characters, from the space on.
ASCII_WIDTHS = {
    "Helvetica": "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584",
    "Helvetica-Bold": "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584",
    "Times-Roman": "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541",
    "Times-Bold": "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520",
    "Times-Italic": "250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541",
    "Times-BoldItalic": "250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570",
}
# Further characters of the Latin fonts, and their widths in the same order.
OTHERS = "‘’“”‚„«»‹›¡¿¢£¥ƒ§¤€⁄ﬁﬂ–—†‡·¶•…‰´ˆ˜¯˘˙¨˚¸˝˛ˇÆæŒœØøŁłÐðÞþßıªº÷×−±¬¦©®™°µ½¼¾¹²³"
OTHER_WIDTHS = {
    "Helvetica": "222 222 333 333 222 333 556 556 333 333 333 611 556 556 556 556 556 556 556 167 500 500 556 1000 556 556 278 537 350 1000 1000 333 333 333 333 333 333 333 333 333 333 333 333 1000 889 1000 944 778 611 556 222 722 556 667 556 611 278 370 365 584 584 584 584 584 260 737 737 1000 400 556 834 834 834 333 333 333",
    "Helvetica-Bold": "278 278 500 500 278 500 556 556 333 333 333 611 556 556 556 556 556 556 556 167 611 611 556 1000 556 556 278 556 350 1000 1000 333 333 333 333 333 333 333 333 333 333 333 333 1000 889 1000 944 778 611 611 278 722 611 667 611 611 278 370 365 584 584 584 584 584 280 737 737 1000 400 611 834 834 834 333 333 333",
    "Times-Roman": "333 333 444 444 333 444 500 500 333 333 333 444 500 500 500 500 500 500 500 167 556 556 500 1000 500 500 250 453 350 1000 1000 333 333 333 333 333 333 333 333 333 333 333 333 889 667 889 722 722 500 611 278 722 500 556 500 500 278 276 310 564 564 564 564 564 200 760 760 980 400 500 750 750 750 300 300 300",
    "Times-Bold": "333 333 500 500 333 500 500 500 333 333 333 500 500 500 500 500 500 500 500 167 556 556 500 1000 500 500 250 540 350 1000 1000 333 333 333 333 333 333 333 333 333 333 333 333 1000 722 1000 722 778 500 667 278 722 500 611 556 556 278 300 330 570 570 570 570 570 220 747 747 1000 400 556 750 750 750 300 300 300",
    "Times-Italic": "333 333 556 556 333 556 500 500 333 333 389 500 500 500 500 500 500 500 500 167 500 500 500 889 500 500 250 523 350 889 1000 333 333 333 333 333 333 333 333 333 333 333 333 889 667 944 667 722 500 556 278 722 500 611 500 500 278 276 310 675 675 675 675 675 275 760 760 980 400 500 750 750 750 300 300 300",
    "Times-BoldItalic": "333 333 500 500 333 500 500 500 333 333 389 500 500 500 500 500 500 500 500 167 556 556 500 1000 500 500 250 500 350 1000 1000 333 333 333 333 333 333 333 333 333 333 333 333 944 722 944 722 722 500 611 278 722 500 611 500 500 278 266 300 570 570 606 570 606 220 747 747 1000 400 576 750 750 750 300 300 300",
}
# Letters with a caron at their side, whose width is not the letter's own.
SIDE_CARONS = {"Helvetica": (643, 299, 317), "Times-Italic": (544, 300, 300), "Times-BoldItalic": (608, 382, 366)}
# The Symbol font from code 0x20 and 0xA0 on (a blank stands for no character), and its widths.
SYMBOL_LOW = " !∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_‾αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼"
SYMBOL_HIGH = "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…⏐⎯↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈®©™∑⎛⎜⎝⎡⎢⎣⎧⎨⎩⎪ 〉∫⌠⎮⌡⎞⎟⎠⎤⎥⎦⎫⎬⎭"
SYMBOL_WIDTHS = (
    "250 333 713 500 549 833 778 439 333 333 500 549 250 549 250 278 500 500 500 500 500 500 500 500 500 500 278 278 549 549 549 444 549 722 667 722 612 611 763 603 722 333 631 722 686 889 722 722 768 741 556 592 611 690 439 768 645 795 611 333 863 333 658 500 500 631 549 549 494 439 521 411 603 329 603 549 549 576 521 549 549 521 549 603 439 576 713 686 493 686 494 480 200 480 549",
    "750 620 247 549 167 713 500 753 753 753 753 1042 987 603 987 603 400 549 411 549 549 713 494 460 549 549 549 549 1000 603 1000 658 823 686 795 987 768 768 823 768 768 713 713 713 713 713 713 713 768 713 790 790 890 823 549 250 713 603 603 1042 987 603 987 603 494 329 790 790 786 713 384 384 384 384 384 384 494 494 494 494 0 329 274 686 686 686 384 384 384 384 384 384 494 494 494",
)
# The codes of ZapfDingbats that leave the run of U+2700 on, and its widths from 0x20, 0x80 and 0xA1 on.
DINGBATS = {0x20: " ", 0x25: "☎", 0x2A: "☛", 0x2B: "☞", 0x48: "★", 0x6C: "●", 0x6E: "■", 0x73: "▲", 0x74: "▼", 0x75: "◆", 0x77: "◗", 0xA8: "♣", 0xA9: "♦", 0xAA: "♥", 0xAB: "♠", 0xD5: "→", 0xD6: "↔", 0xD7: "↕", 0xF0: ""}
DINGBAT_WIDTHS = {
    0x20: "278 974 961 974 980 719 789 790 791 690 960 939 549 855 911 933 911 945 974 755 846 762 761 571 677 763 760 759 754 494 552 537 577 692 786 788 788 790 793 794 816 823 789 841 823 833 816 831 923 744 723 749 790 792 695 776 768 792 759 707 708 682 701 826 815 789 789 707 687 696 689 786 787 713 791 785 791 873 761 762 762 759 759 892 892 788 784 438 138 277 415 392 392 668 668",
    0x80: "390 390 317 317 276 276 509 509 410 410 234 234 334 334",
    0xA1: "732 544 544 910 667 760 760 776 595 694 626 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 894 838 1016 458 748 924 748 918 927 928 928 834 873 828 924 924 917 930 931 463 883 836 836 867 867 696 696 874 0 874 760 946 771 865 771 888 967 888 831 873 927 970 918",
}
# The glyphs of MacExpert by code.
MAC_EXPERT = """32 space exclamsmall Hungarumlautsmall centoldstyle dollaroldstyle dollarsuperior ampersandsmall Acutesmall parenleftsuperior parenrightsuperior twodotenleader onedotenleader comma hyphen period fraction zerooldstyle oneoldstyle twooldstyle threeoldstyle fouroldstyle fiveoldstyle sixoldstyle sevenoldstyle eightoldstyle nineoldstyle colon semicolon
61 threequartersemdash 63 questionsmall 68 Ethsmall 71 onequarter onehalf threequarters oneeighth threeeighths fiveeighths seveneighths onethird twothirds 86 ff fi fl ffi ffl parenleftinferior
93 parenrightinferior Circumflexsmall hypheninferior Gravesmall Asmall Bsmall Csmall Dsmall Esmall Fsmall Gsmall Hsmall Ismall Jsmall Ksmall Lsmall Msmall Nsmall Osmall Psmall Qsmall Rsmall Ssmall Tsmall Usmall Vsmall Wsmall Xsmall Ysmall Zsmall colonmonetary onefitted rupiah Tildesmall 129 asuperior centsuperior
135 Aacutesmall Agravesmall Acircumflexsmall Adieresissmall Atildesmall Aringsmall Ccedillasmall Eacutesmall Egravesmall Ecircumflexsmall Edieresissmall Iacutesmall Igravesmall Icircumflexsmall Idieresissmall Ntildesmall Oacutesmall Ogravesmall Ocircumflexsmall Odieresissmall Otildesmall Uacutesmall Ugravesmall Ucircumflexsmall Udieresissmall
161 eightsuperior fourinferior threeinferior sixinferior eightinferior seveninferior Scaronsmall 169 centinferior twoinferior 172 Dieresissmall 174 Caronsmall osuperior fiveinferior 178 commainferior periodinferior Yacutesmall 182 dollarinferior 185 Thornsmall 187 nineinferior zeroinferior Zcaronsmall AEsmall Oslashsmall questiondownsmall oneinferior Lslashsmall
201 Cedillasmall 207 OEsmall figuredash hyphensuperior 214 exclamdownsmall 216 Ydieresissmall 218 onesuperior twosuperior threesuperior foursuperior fivesuperior sixsuperior sevensuperior ninesuperior zerosuperior 228 esuperior rsuperior tsuperior 233 isuperior ssuperior dsuperior 241 lsuperior Ogoneksmall Brevesmall Macronsmall bsuperior nsuperior msuperior commasuperior periodsuperior Dotaccentsmall Ringsmall"""


def symbol_table() -> list[str]:
    out = [""] * 256
    for first, row in ((0x20, SYMBOL_LOW), (0xA0, SYMBOL_HIGH)):
        for i, c in enumerate(row):
            out[first + i] = c if c != " " or first + i == 0x20 else ""
    return out


def dingbats_table() -> list[str]:
    """By rule: most codes run along U+2700 on, in four stretches."""
    out = [""] * 256
    for first, last, start in ((0x21, 0x7E, 0x2701), (0x80, 0x8D, 0x2768), (0xA1, 0xA7, 0x2761), (0xAC, 0xB5, 0x2460), (0xB6, 0xD4, 0x2776), (0xD8, 0xFE, 0x2798)):
        for code in range(first, last + 1):
            out[code] = chr(start + code - first)
    for code, c in DINGBATS.items():
        out[code] = c
    return out


def mac_expert_glyphs() -> dict[int, str]:
    out, code = {}, 0
    for word in MAC_EXPERT.split():
        if word.isdigit():
            code = int(word)
        else:
            out[code] = word
            code += 1
    return out


def code_widths(name: str) -> dict[int, float]:
    """Widths by code of the two fonts with a code chart of their own."""
    rows = dict(zip((0x20, 0xA0), SYMBOL_WIDTHS, strict=True)) if name == "Symbol" else DINGBAT_WIDTHS
    return {first + i: float(w) for first, row in rows.items() for i, w in enumerate(row.split()) if w != "0"}


def latin_font(name: str) -> str | None:
    """The core font that a font name stands for; oblique is as wide as upright."""
    family = "Helvetica" if name.startswith(("Helvetica", "Arial")) else "Times" if name.startswith("Times") else None
    if family is None:
        return None
    bold, slant = "Bold" in name, "Italic" in name or "Oblique" in name
    if family == "Helvetica":
        return "Helvetica-Bold" if bold else "Helvetica"
    return "Times-" + ("BoldItalic" if bold and slant else "Bold" if bold else "Italic" if slant else "Roman")


def latin_widths(name: str) -> dict[str, float]:
    """Widths by character; an accented letter is as wide as its letter, an accented small i as the dotless one."""
    import unicodedata

    out = {chr(32 + i): float(w) for i, w in enumerate(ASCII_WIDTHS[name].split())} | dict(zip(OTHERS, map(float, OTHER_WIDTHS[name].split()), strict=True))
    for code in range(0xC0, 0x180):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0] in out:
            out.setdefault(c, out["ı" if base[0] == "i" else base[0]])
    if name in SIDE_CARONS:
        out |= dict(zip("ďľť", map(float, SIDE_CARONS[name]), strict=True))
    return out | {"\xa0": out[" "], "\xad": out["-"]}
