"""Driver queries: each kernel of the reader applied to a whole table, with the DuckDB SQL that gives the same rows.

Queries named ``*_roundtrip`` encode a table by a fixture, run the engine's decoder and compare with the original; their
oracle is the original. The others compute the same thing in two ways.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import entries, filters, scalars
from .plans import relational, tables
from .sources import security, syntax
from .sources.writer import text_pdf


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART_ROWS, PART_BYTES = 200, 1 << 20


def parts(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of PART_ROWS rows at most whose column has PART_BYTES at most (or one row), so that a worker holds the results of a slice and not of 10,000 rows."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(b.column(column)).to_pylist()):
        if i > start and (i - start >= PART_ROWS or size + (n or 0) > PART_BYTES):
            yield b.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if b.num_rows:
        yield b.slice(start)


def _mapped(df: DataFrame, key: str, value: str, f: Callable[[str], bytes]) -> DataFrame:
    """(key, out) with f applied to each value in Arrow batches; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, 1):
                out = [f(v.as_py() or "") for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=[key, "out"])

    # The test tables are single row groups, which one task would read.
    narrow = df.select(F.col(key).cast("long").alias(key), F.col(value).cast("string").alias(value)).repartition(df.sparkSession.sparkContext.defaultParallelism)
    return narrow.mapInArrow(run, f"{key} long, out binary")


def _as_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _mapped(_read(spark, sf_dir, "documents"), "doc_id", "text", text_pdf)
    return made.select(F.col("doc_id").cast("string").alias("path"), F.col("out").alias("content"))


def doc_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files, extracted again: the words of all pages in order."""
    pages = tables.page_text(_as_pdfs(spark, sf_dir))
    whole = pages.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n").alias("t"))
    words = F.trim(F.regexp_replace("t", r"[ \n\r\t]+", " "))
    return whole.select(F.col("path").cast("long").alias("doc_id"), F.md5(words.cast("binary")).alias("words_md5"), F.length(words).cast("long").alias("n_chars"))


def doc_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.documents(_as_pdfs(spark, sf_dir))
    return d.select(F.col("path").cast("long").alias("doc_id"), "page_count", "pages")


def content_op_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = tables.content_operators(_as_pdfs(spark, sf_dir))
    return ops.groupBy(F.col("path").cast("long").alias("doc_id")).agg(*[F.count_if(F.col("op") == op).alias(n) for op, n in (("Tj", "n_show"), ("T*", "n_next"), ("BT", "n_begin"), ("Tf", "n_font"))])


def run_length_encode(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = 1
        while n < 128 and at + n < len(raw) and raw[at + n] == raw[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n, raw[at]])
        else:
            while n < 128 and at + n < len(raw) and raw[at + n] != raw[at + n - 1]:
                n += 1
            out += bytes([n - 1]) + raw[at : at + n]
        at += n
    return bytes(out) + b"\x80"


def lzw_encode(raw: bytes) -> bytes:
    table, nxt, width, acc, bits, out, w = {bytes([i]): i for i in range(256)}, 258, 9, 0, 0, bytearray(), b""

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            out.append((acc >> (bits - 8)) & 255)
            bits -= 8
        acc &= (1 << bits) - 1

    put(256)
    for b in raw:
        c = w + bytes([b])
        if c in table:
            w = c
            continue
        put(table[w])
        table[c] = nxt
        nxt += 1
        width = 9 + (nxt + 0 >= 512) + (nxt + 0 >= 1024) + (nxt + 0 >= 2048)
        if nxt >= 4094:
            put(256)
            table, nxt, width = {bytes([i]): i for i in range(256)}, 258, 9
        w = bytes([b])
    if w:
        put(table[w])
        nxt += 1  # the reader makes an entry for the last code too, and its widths count it
        width = 9 + (nxt >= 512) + (nxt >= 1024) + (nxt >= 2048)
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


ENCODERS = {
    "ASCIIHexDecode": lambda b: b.hex().encode() + b">",
    "ASCII85Decode": lambda b: base64.a85encode(b, wrapcol=72) + b"~>",
    "FlateDecode": zlib.compress,
    "RunLengthDecode": run_length_encode,
    "LZWDecode": lzw_encode,
}


def _filter_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _mapped(_read(spark, sf_dir, "documents"), "doc_id", "text", lambda t: filters.decode(ENCODERS[name](t.encode()), [name]))
        return out.select("doc_id", F.md5("out").alias("out_md5"), F.length("out").cast("long").alias("n_bytes"))

    return run


def filter_chain_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flate with the PNG Up predictor over rows of 16 bytes, then ASCII85."""

    def both(t: str) -> bytes:
        raw = t.encode()
        rows = [raw[i : i + 16].ljust(16, b" ") for i in range(0, len(raw), 16)]
        coded = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(r, p, strict=True)) for r, p in zip(rows, [bytes(16), *rows], strict=False))
        return filters.decode(base64.a85encode(zlib.compress(coded)) + b"~>", ["ASCII85Decode", "FlateDecode"], [None, {"Predictor": 12, "Columns": 16}])[: len(raw)]

    out = _mapped(_read(spark, sf_dir, "documents"), "doc_id", "text", both)
    return out.select("doc_id", F.md5("out").alias("out_md5"), F.length("out").cast("long").alias("n_bytes"))


DIGEST_SQL = "SELECT doc_id, md5(coalesce(text, '')) AS out_md5, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents"


def string_syntax_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as literal strings and as escaped names, read back by the tokenizer."""

    def there_and_back(t: str) -> bytes:
        raw = t.encode()
        quoted = b"(" + b"".join(b"\\%03o" % b if b in b"()\\\r" or b > 126 else bytes([b]) for b in raw) + b")"
        named = ("/" + "".join(f"#{b:02X}" if b < 33 or b > 126 or b in b"#()<>[]{}/%" else chr(b) for b in raw)).encode()
        a, b = syntax.Parser(quoted).value(), syntax.Parser(named).value()
        return a if a == b.encode("utf-8", "surrogateescape") else b"different"

    out = _mapped(_read(spark, sf_dir, "documents"), "doc_id", "text", there_and_back)
    return out.select("doc_id", F.md5("out").alias("out_md5"), F.length("out").cast("long").alias("n_bytes"))


def decode_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first filter of a chain taken off alone, then the rest."""

    def twice(t: str) -> bytes:
        first = filters.decode(base64.a85encode(zlib.compress(t.encode())) + b"~>", ["A85", "Fl"], until="FlateDecode")
        return filters.decode(first, ["FlateDecode"])

    out = _mapped(_read(spark, sf_dir, "documents"), "doc_id", "text", twice)
    return out.select("doc_id", F.md5("out").alias("out_md5"), F.length("out").cast("long").alias("n_bytes"))


def dict_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as dictionaries: entries set and removed, composed with another map, turned round."""
    own = F.create_map(F.lit("a"), F.col("c_mktsegment"), F.lit("b"), F.col("c_name"), F.lit("c"), F.col("c_mktsegment"))
    forms = {
        "added": entries.with_entry(own, F.lit("d"), F.lit("x")), "removed": entries.with_entry(own, F.lit("a"), F.lit(None).cast("string")), "dropped": entries.without_entry(own, F.lit("b")),
        "mapped": entries.composed(own, F.create_map(F.col("c_name"), F.lit("N")), F.lit("none")), "turned": entries.reversed_map(own),
    }
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return _read(spark, sf_dir, "customer").select("c_custkey", *[shown(m).alias(n) for n, m in forms.items()])


def text_string_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as UTF-16 text strings with a mark, decoded again."""
    out = _mapped(_read(spark, sf_dir, "documents"), "doc_id", "text", lambda t: scalars.text_string(b"\xfe\xff" + t.encode("utf-16-be")).encode())
    return out.select("doc_id", F.md5("out").alias("out_md5"), F.length("out").cast("long").alias("n_bytes"))


def crypt_aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls encrypted by Spark's AES, opened by the engine's."""
    key = bytes(range(16))
    pages = _read(spark, sf_dir, "pages")
    shut = F.aes_encrypt(F.col("url"), F.lit(key), F.lit("CBC"), F.lit("PKCS"))
    out = _mapped(pages.select("page_id", F.hex(shut).alias("shut")), "page_id", "shut", lambda h: security.aes_open(key, bytes.fromhex(h)))
    return out.select("page_id", F.col("out").cast("string").alias("url"))


def pdf_date_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as local PDF dates with a zone from the user, parsed and brought back to UTC."""
    e = _read(spark, sf_dir, "events")
    minutes = (F.pmod(F.col("user_id"), F.lit(27)) - 13) * 30
    local = F.date_trunc("second", "ts") + F.make_dt_interval(mins=minutes)
    zone = F.format_string("%s%02d'%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)
    text = F.concat(F.lit("D:"), F.date_format(local, "yyyyMMddHHmmss"), zone)
    got, ahead = scalars.date_columns(F.col("d"))
    return e.select("event_id", text.alias("d")).select("event_id", "d", (got - F.make_dt_interval(mins=ahead)).alias("utc"))


def date_partial_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates cut to year, month, day, hour, minute or second by the key; missing parts take their least value."""
    o = _read(spark, sf_dir, "orders")
    cut = F.array(*[F.lit(n) for n in (4, 6, 8, 10, 12, 14)])[F.pmod(F.col("o_orderkey"), F.lit(6)).cast("int")]
    got, ahead = scalars.date_columns(F.concat(F.lit("D:"), F.substring(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit(1), cut)))
    return o.select("o_orderkey", got.alias("local"), ahead.alias("minutes"))


def page_label_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    n = F.pmod(F.col("o_orderkey"), F.lit(3999)).cast("int") + 1
    style = F.array(*map(F.lit, ("D", "R", "r", "A", "a")))[F.pmod(F.col("o_custkey"), F.lit(5)).cast("int")]
    return o.select("o_orderkey", scalars.label_column(style, F.lit("p-"), n).alias("label"))


def _roman_sql(n: str) -> str:
    out, rest = [], n
    for value, digits in scalars.ROMAN:
        out.append(f"repeat('{digits}', CAST(({rest}) // {value} AS INT))")
        rest = f"({rest}) % {value}"
    return " || ".join(out)


def page_label_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the last event of the customer's number at or before the order: a backward as-of join."""
    events = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("o_custkey"), "ts").agg(F.max("event_id").alias("event_id"))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderdate") + F.expr("INTERVAL 27 YEARS")).alias("order_ts"))
    return relational.as_of(orders, events, ["o_custkey"], "order_ts", "ts", ["event_id"]).withColumn("event_id", F.coalesce("event_id", F.lit(-1)))


def xref_newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("user_id", "event_type", (-F.col("event_id")).alias("rev"), "value")
    return relational.newest_wins(e, ["user_id", "event_type"], "rev")


def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (_read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    out = relational.resolve(relational.resolve(c, n, [("c_nationkey", "n_nationkey")]), r, [("n_regionkey", "r_regionkey")])
    return out.select("c_custkey", "n_name", "r_name")


def inherit_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (_read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    out = relational.resolve(relational.resolve(c, n, [("c_nationkey", "n_nationkey")]), r, [("n_regionkey", "r_regionkey")])
    own = F.when(F.col("c_acctbal") > 5000, F.col("c_name"))
    return out.select("c_custkey", relational.inherited(own, F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.col("r_name")).alias("value"))


BANDS = ((1, 9, "S"), (10, 19, "M"), (25, 39, "L"))


def cmap_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame(BANDS, "lo int, hi int, name string")
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_size")
    return relational.in_range(parts, bands, "p_size", "lo", "hi", {"name": F.lit("none")}).select("p_partkey", "p_size", "name")


def height_profile_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_suppkey", F.round(F.col("l_quantity") * 10).cast("long").alias("height"), F.col("l_linenumber").cast("long").alias("n"))
    return relational.mode_by(rows, ["l_suppkey"], "height", "n")


def cert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("source", "lang", F.col("doc_id").alias("rev"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    return relational.newest_wins(d, ["source", "lang"], "rev")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: _filter_query(f) for n, f in FILTER_QUERIES.items()}
    own = (doc_text_roundtrip, doc_page_count, content_op_stats, filter_chain_roundtrip, string_syntax_roundtrip, decode_until, dict_helpers, text_string_roundtrip, crypt_aes_roundtrip, pdf_date_events, date_partial_default, page_label_numerals, page_label_asof, xref_newest_wins, resolve_refs, inherit_attr, cmap_range_lookup, height_profile_mode, cert_dedup)
    return {f.__name__: f for f in own} | out


FILTER_QUERIES = {"hex_filter_roundtrip": "ASCIIHexDecode", "a85_filter_roundtrip": "ASCII85Decode", "flate_filter_roundtrip": "FlateDecode", "rle_filter_roundtrip": "RunLengthDecode", "lzw_filter_roundtrip": "LZWDecode"}
LINES = "len(string_split(coalesce(text, ''), chr(10)))"
N = "(o_orderkey % 3999 + 1)"
ALPHA = f"repeat(chr(CAST(97 + ({N} - 1) % 26 AS INT)), CAST(({N} - 1) // 26 + 1 AS INT))"
MINUTES = "((user_id % 27 - 13) * 30)"


def oracle_sql() -> dict[str, str]:
    words = "trim(regexp_replace(coalesce(text, ''), '[ \\n\\r\\t]+', ' ', 'g'))"
    return {n: DIGEST_SQL for n in (*FILTER_QUERIES, "filter_chain_roundtrip", "string_syntax_roundtrip", "decode_until", "text_string_roundtrip")} | {
        "doc_text_roundtrip": f"SELECT doc_id, md5({words}) AS words_md5, length({words}) AS n_chars FROM documents",
        "doc_page_count": f"SELECT doc_id, CAST(ceil({LINES} / 40.0) AS BIGINT) AS page_count, CAST(ceil({LINES} / 40.0) AS BIGINT) AS pages FROM documents",
        "content_op_stats": f"SELECT doc_id, CAST({LINES} AS BIGINT) AS n_show, CAST({LINES} AS BIGINT) AS n_next, CAST(ceil({LINES} / 40.0) AS BIGINT) AS n_begin, CAST(ceil({LINES} / 40.0) AS BIGINT) AS n_font FROM documents",
        "dict_helpers": "SELECT c_custkey, 'a=' || c_mktsegment || ',b=' || c_name || ',c=' || c_mktsegment || ',d=x' AS added, 'b=' || c_name || ',c=' || c_mktsegment AS removed, 'a=' || c_mktsegment || ',c=' || c_mktsegment AS dropped, 'a=none,b=N,c=none' AS mapped, CASE WHEN c_mktsegment < c_name THEN c_mktsegment || '=c,' || c_name || '=b' ELSE c_name || '=b,' || c_mktsegment || '=c' END AS turned FROM customer",
        "crypt_aes_roundtrip": "SELECT page_id, url FROM pages",
        "pdf_date_events": f"SELECT event_id, 'D:' || strftime(date_trunc('second', ts) + to_minutes(CAST({MINUTES} AS INT)), '%Y%m%d%H%M%S') || CASE WHEN {MINUTES} < 0 THEN '-' ELSE '+' END || printf('%02d', CAST(abs({MINUTES}) // 60 AS INT)) || '''' || printf('%02d', CAST(abs({MINUTES}) % 60 AS INT)) AS d, CAST(date_trunc('second', ts) AS TIMESTAMP) AS utc FROM events",
        "date_partial_default": "SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN date_trunc('year', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate) WHEN 2 THEN date_trunc('day', o_orderdate) WHEN 3 THEN date_trunc('hour', o_orderdate) WHEN 4 THEN date_trunc('minute', o_orderdate) ELSE date_trunc('second', o_orderdate) END AS TIMESTAMP) AS local, CAST(0 AS INT) AS minutes FROM orders",
        "page_label_numerals": f"SELECT o_orderkey, 'p-' || CASE o_custkey % 5 WHEN 0 THEN CAST({N} AS VARCHAR) WHEN 1 THEN upper({_roman_sql(N)}) WHEN 2 THEN {_roman_sql(N)} WHEN 3 THEN upper({ALPHA}) ELSE {ALPHA} END AS label FROM orders",
        "page_label_asof": "WITH e AS (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY ALL), o AS (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 27 YEAR AS order_ts FROM orders) SELECT o_orderkey, o_custkey, order_ts, e.ts, coalesce(e.event_id, -1) AS event_id FROM o ASOF LEFT JOIN e ON o.o_custkey = e.user_id AND o.order_ts >= e.ts",
        "xref_newest_wins": "SELECT user_id, event_type, -max(event_id) AS rev, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
        "resolve_refs": "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
        "inherit_attr": "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_name END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS value FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
        "cmap_range_lookup": "SELECT p_partkey, p_size, coalesce(name, 'none') AS name FROM part LEFT JOIN (VALUES (1, 9, 'S'), (10, 19, 'M'), (25, 39, 'L')) b(lo, hi, name) ON p_size BETWEEN lo AND hi",
        "height_profile_mode": "WITH s AS (SELECT l_suppkey, CAST(round(l_quantity * 10) AS BIGINT) AS height, CAST(sum(l_linenumber) AS BIGINT) AS weight FROM lineitem GROUP BY ALL) SELECT l_suppkey, height, weight FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, height) = 1",
        "cert_dedup": "SELECT source, lang, min(doc_id) AS rev, md5(coalesce(arg_min(text, doc_id), '')) AS text_md5 FROM documents GROUP BY source, lang",
    }
