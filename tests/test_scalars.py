import base64
import zlib
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum import queries
from vellum.functions import filters, scalars
from vellum.sources import security, syntax


def test_strings_and_comments():
    assert scalars.hex_text("0041") == "A" and scalars.hex_text("4241") == "BA"
    assert syntax.Parser(b"10 0 R\n").value() == syntax.Ref(10, 0)
    assert syntax.Parser(b"% This is a comment\r\n 5").value() == 5
    assert syntax.Parser(b"(a(b)\\)\\101\\\r\nc)").value() == b"a(b))Ac"
    assert syntax.Parser(b"<</A#20B [1 -2.5 true null] /A 3 /A 4>>").value() == {"A B": [1, -2.5, True, None], "A": 4}
    assert syntax.Parser(b"<48656C6C6F7>").value() == b"Hellop"
    assert syntax.show(syntax.Parser(b"[/x#20y (ab) 3 0 R]").value()) == "[/x#20y <6162> 3 0 R]"


def test_dates():
    assert scalars.format_date(*scalars.parse_date("D:199812231952-08'30 ")) == "D:19981223195200-08'30"
    assert scalars.parse_date("not a date") is None and scalars.parse_date("D:209") is None
    first = scalars.utc_date("D:20090101000000Z")
    assert all(scalars.utc_date(x) == first for x in ("D:2009", "D:200901", "D:20090101", "D:2009010100+00'00", "D:20090101000000-00"))
    days = [scalars.utc_date(x) for x in ("D:20090202010203+00'01", "D:20090202010203", "D:20090202010204", "D:20090202010204-00'01")]
    assert days == sorted(days) and len(set(days)) == 4
    assert scalars.utc_date("D:2009020208+06") == scalars.utc_date("D:2009020204+02")
    assert scalars.utc_date("D:20190425173659+05'30'") == datetime(2019, 4, 25, 12, 6, 59)


def test_date_columns(spark):
    texts = ["D:20190425173659+05'30'", "D:2009", "nothing", None, "D:20091399", "D:199812231952-08'30 "]
    local, ahead = scalars.date_columns(F.col("d"))
    rows = spark.createDataFrame([(t,) for t in texts], "d string").select("d", local.alias("l"), ahead.alias("a")).collect()
    for r in rows:
        got = scalars.parse_date(r.d)
        assert r.l == (got[0] if got else None)
        if got:
            assert r.a == got[1]


def test_labels(spark):
    n = [1, 4, 9, 26, 27, 42, 1994, 3999]
    rows = spark.createDataFrame([(s, i) for s in "DRrAa" for i in n], "s string, n int")
    out = rows.select("s", "n", scalars.label_column(F.col("s"), F.lit("x"), F.col("n")).alias("l")).collect()
    assert all(r.l == scalars.page_label(r.s, "x", r.n) for r in out)
    assert scalars.page_label("r", "", 1994) == "mcmxciv" and scalars.page_label("A", "", 28) == "BB"


@pytest.mark.parametrize("name", list(queries.ENCODERS))
@given(st.binary(max_size=400))
@settings(max_examples=40, deadline=None)
def test_filters(name, raw):
    assert filters.decode(queries.ENCODERS[name](raw), [name]) == raw


def test_filter_edges():
    assert filters.ascii85(b"zzz!!!~>") == bytes(14)
    long = bytes(range(256)) * 300
    assert filters.lzw(queries.lzw_encode(long)) == long
    damaged = zlib.compress(long)[:-40]
    assert long.startswith(filters.flate(damaged)) and len(filters.flate(damaged)) > 0
    with pytest.raises(filters.UnsupportedFilter):
        filters.decode(b"", ["JBIG2Decode"])
    assert filters.ascii85(base64.a85encode(b"ab c", wrapcol=3)) == b"ab c"
    rows = b"\x00\x01\x02\x01\x01\x01\x03\x02\x04\x04\x00\x01"  # one row for each of the tags 0, 1, 3, 4
    assert filters.unpredict(rows, {"Predictor": 15, "Columns": 2}) == bytes([1, 2, 1, 2, 2, 6, 2, 7])


def test_lzw_ends_at_every_width():
    raw = bytes((i * i * 7 + i // 3) % 251 for i in range(2200))
    for n in (*range(240, 270), *range(740, 1000), *range(1700, 2200)):
        assert filters.lzw(queries.lzw_encode(raw[:n])) == raw[:n]


def test_ciphers():
    assert security.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert security.aes_cbc(bytes(range(16)), bytes(16), block, True).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert security.aes_cbc(bytes(range(32)), bytes(16), block, True).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert security.aes_cbc(bytes(range(32)), bytes(16), bytes.fromhex("8ea2b7ca516745bfeafc49904b496089"), False) == block


def test_glyph_names():
    names = {"Aacute": "Á", "f_i": "fi", "uni20AC": "€", "u1F600": "😀", "alpha": "α", "one.alt": "1", "germandbls": "ß", "nothing": ""}
    assert {n: scalars.glyph_text(n) for n in names} == names
    assert scalars.text_string(b"\xa0\x8d") == "€“" and scalars.text_string(b"\xfe\xff\x00A") == "A"
