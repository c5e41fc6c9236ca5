"""Driver queries over whole files: each builds PDF files from a table, reads them with the engine's tables, and has DuckDB SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import charsets, scalars
from .operators.fonts import kern, read_afm
from .plans import tables
from .sources.certificates import Certificate, asn1_time, nodes
from .sources.syntax import Name, Ref, Stream
from .sources.writer import COURIER, Encryption, RawBody, RecipientEncryption, Writer, certificate, der, fixture_key, flate, key_file, literal, pages_pdf, pem, rsa_sign, signed_data, signed_pdf, text_pdf, time_stamp, utf16

SHA1 = "1.3.14.3.2.26"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _built(rows: DataFrame, key: str, build: Callable[[dict], bytes]) -> DataFrame:
    """(path, content): a file for each row, named by its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                some, paths, made, size = b.slice(at, 200).to_pylist(), [], [], 0
                for r in some:
                    paths.append(str(r[key]))
                    made.append(build(r))
                    size += len(made[-1])
                    if size >= tables.BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(made, pa.binary())], names=["path", "content"])
                        paths, made, size = [], [], 0
                if paths:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(made, pa.binary())], names=["path", "content"])

    # The test tables are single row groups, which one task would read.
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "path string, content binary")


def _key(name: str) -> Column:
    return F.col("path").cast("long").alias(name)


def _title() -> Column:
    """The title among the rows of ``tables.INFO``; null without one."""
    return F.filter("info", lambda x: x["key"] == "Title")[0]["text"].alias("title")


# Files that are damaged, or odd in ways that must not matter.
def damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files damaged in ways that go with the id: what can be read is read, the rest gives an error row."""

    def build(r: dict) -> bytes:
        text, kind = r["text"] or "", r["doc_id"] % 9
        if kind == 0:
            return text_pdf(text, junk=b"no header here\n" * 200)
        if kind == 1:
            return text_pdf(text).replace(b"startxref", b"startxxxx")
        if kind == 2:
            return text_pdf(text).replace(b"%PDF-", b"%PXF-")
        if kind == 3:
            return text_pdf(text, size="9" * 400)
        if kind == 4:
            return text_pdf(text, after=b" 0 -20000000 Td (far) Tj")
        if kind == 5:
            return text_pdf(text)[:8]
        if kind == 6:
            return text_pdf(text).replace(b"/Kids [", b"/Kids [3 0 R ")
        if kind == 7:
            return text_pdf(text).replace(b"/Type /Catalog", b"/Deep " + b"[" * 500 + b" /Type /Catalog")
        return text_pdf(text)

    pages = tables.page_text(_built(_read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", build))
    words = F.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n"), r"[ \n\r\t]+", " "))
    out = pages.groupBy("path").agg(F.count("error").alias("errors"), F.md5(words.cast("binary")).alias("md5"))
    return out.select(_key("doc_id"), (F.col("errors") > 0).alias("failed"), F.when(F.col("errors") == 0, F.col("md5")).alias("words_md5"))


def revision_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in files with each form of cross-reference data; an update replaces the title, and the newest one counts."""

    def build(r: dict) -> bytes:
        w = Writer()
        info = w.add({"Title": utf16(r["o_orderstatus"])})
        pdf = pages_pdf([b""], writer=w, kind=("table", "stream", "hybrid", "table")[r["o_orderkey"] % 4], trailer={"Info": info})
        return Writer.update(pdf, 1, {"Title": utf16(r["o_orderpriority"])}, {"Root": Ref(2, 0), "Info": info}) if r["o_orderkey"] % 4 == 3 else pdf

    files = _built(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", build)
    read = tables.together(files, {"info": tables.INFO, "xref": tables.XREF})
    of_one = read.select("path", _title(), F.transform(F.filter("xref", lambda x: x["num"] == 1), lambda x: F.struct(x["rev"].alias("rev"), x["kind"].alias("kind"))).alias("own"))
    return of_one.where("title is not null and size(own) > 0").select(_key("o_orderkey"), "title", F.size("own").alias("entries"), F.array_min("own")["kind"].alias("kind"))


def filter_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as streams under each predictor and the less usual filter settings, decoded through the object table."""

    def paeth(a: int, b: int, c: int) -> int:
        p = a + b - c
        return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]

    def png(raw: bytes, tag: int | None) -> bytes:
        out, above = bytearray(), bytes(24)
        for n, at in enumerate(range(0, len(raw), 24)):
            line, kind = raw[at : at + 24], n % 5 if tag is None else tag
            left = bytes(3) + line
            corner = bytes(3) + above
            before = {0: lambda i: 0, 1: lambda i: left[i], 2: lambda i: above[i], 3: lambda i: (left[i] + above[i]) // 2, 4: lambda i: paeth(left[i], above[i], corner[i])}[kind]
            out += bytes([kind]) + bytes((line[i] - before(i)) & 255 for i in range(len(line)))
            above = line
        return bytes(out)

    def build(r: dict) -> bytes:
        import zlib

        raw, kind = (r["text"] or "").encode(), r["doc_id"] % 9
        whole = raw.ljust(-(-len(raw) // 24) * 24)
        parms = {"Predictor": 15, "Colors": 3, "Columns": 8}
        if kind < 5:
            s = Stream({"Filter": [Name("FlateDecode")], "DecodeParms": [parms | {"Predictor": 10 + kind}]}, zlib.compress(png(whole, kind), 1))
        elif kind == 5:
            s = Stream({"Filter": Name("Fl"), "DecodeParms": parms}, zlib.compress(png(whole, None), 1))
        elif kind == 6:
            rows = b"".join(bytes((whole[i] - (whole[i - 3] if i % 24 > 2 else 0)) & 255 for i in range(at, at + 24)) for at in range(0, len(whole), 24))
            s = Stream({"Filter": Name("FlateDecode"), "DecodeParms": parms | {"Predictor": 2}}, zlib.compress(rows, 1))
        elif kind == 7:
            s = Stream({"Filter": [Name("AHx"), Name("Fl")], "DecodeParms": [None, None]}, zlib.compress(raw, 1).hex(" ").encode() + b">")
        else:  # a broken tail keeps what came before; the text is stored, so that all of it comes before
            s = Stream({"Filter": Name("FlateDecode")}, zlib.compress(raw, 0)[:-4] + b"\0\0\0\0")
        w = Writer()
        w.add(s)
        return pages_pdf([b""], writer=w)

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    got = tables.objects(_built(docs, "doc_id", build), streams=True).where("num = 1").select(_key("doc_id"), "data")
    sizes = docs.select("doc_id", F.length(F.coalesce("text", F.lit("")).cast("binary")).alias("n"))
    out = got.join(sizes, "doc_id").withColumn("data", F.substring("data", F.lit(1), F.col("n")))
    return out.select("doc_id", F.md5("data").alias("out_md5"), F.length("data").cast("long").alias("n_bytes"))


# Page content.
def painted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items of an order as text scattered over a page, in reading order: lines from the top, then from the left."""

    def build(r: dict) -> bytes:
        shown = "".join(f"1 0 0 1 {40 + 10 * x['q']:g} {750 - 40 * x['line']} Tm ({x['token']}) Tj\n" for x in sorted(r["items"], key=lambda x: (x["n"], x["token"])))
        return pages_pdf([f"BT /F1 10 Tf\n{shown}ET".encode()])

    token = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.floor(F.col("l_extendedprice") / 10000).alias("line"), token.alias("token"))
    orders = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    return tables.page_text(_built(orders, "l_orderkey", build)).select(_key("l_orderkey"), F.regexp_replace("text", r"\s+", "").alias("text"))


def shown_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings with shifts, spacings and scaling: the space rule of TJ and the width of every run."""

    def build(r: dict) -> bytes:
        rows = []
        for i, x in enumerate(sorted(r["items"], key=lambda x: tuple(x.values()))):
            rows.append(f"/F1 {8 + x['n']} Tf {x['tc']} Tc {x['tw']} Tw {x['tz']} Tz 1 0 0 1 {100 + i} {700 - 20 * i} Tm [({x['a']}) 999 {x['gap']} ({x['b']} o) 5] TJ\n")
        return pages_pdf([("BT\n" + "".join(rows) + "ET").encode()])

    item = F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), (F.col("l_quantity") % 4).cast("int").alias("tc"), (F.col("l_quantity") % 7).cast("int").alias("tw"), F.when(F.col("l_quantity") % 2 == 0, 100).otherwise(200).alias("tz"),
        F.round(F.col("l_discount") * -3000).cast("int").alias("gap"),
    )
    orders = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    runs = tables.text_runs(_built(orders, "l_orderkey", build), columns=["seq", "text", "lbx", "lby", "rbx"])
    return runs.select(_key("l_orderkey"), "seq", "text", F.round((F.col("rbx").cast("double") - F.col("lbx").cast("double")) * 1000).cast("long").alias("width"), F.col("lby").cast("long").alias("y"))


def graphics_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text positions under saved states, matrices and all positioning operators."""

    def build(r: dict) -> bytes:
        content = ""
        for x in r["items"]:
            n, q = x["n"], int(x["q"])
            content += f"q {1 + n % 3} 0 0 2 {q} {n} cm q 9 0 0 9 9 9 cm Q BT /F1 10 Tf 12 TL {1 + q % 2} 0 0 2 {n} {q} Tm {q} {n} Td (x{n}) Tj T* (y{n}) Tj {q} {n} TD (z{n}) Tj (w{n}) ' 3 1 (v{n}) \" ET Q BT /F1 10 Tf 5 5 Td (u{n}) Tj ET\n"
        return pages_pdf([content.encode()])

    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    orders = rows.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), "q")).alias("items"))
    runs = tables.text_runs(_built(orders, "l_orderkey", build), columns=["text", "lbx", "lby"])
    return runs.select(_key("l_orderkey"), "text", F.round("lbx").cast("long").alias("x"), F.round("lby").cast("long").alias("y"))


def forms_and_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names in page content, in a form and in a form inside it; artifacts and images show nothing."""

    def build(r: dict) -> bytes:
        w = Writer()
        root, tree, page, font, one, two, image = (w.add() for _ in range(7))
        w.put(font, COURIER)
        form = {"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 10, 10]}
        segment = literal(r["c_mktsegment"].encode())
        w.put(two, flate(b"BT /F1 10 Tf 1 2 Td " + segment + b" Tj ET /X1 Do", **form, Matrix=[1, 0, 0, 1, 5, 6], Resources={"Font": {"F1": font}, "XObject": {"X1": one}}))
        w.put(one, flate(b"BT /F1 10 Tf 3 4 Td (form) Tj ET /X2 Do", **form, Matrix=[2, 0, 0, 2, 10, 20], Resources={"Font": {"F1": font}, "XObject": {"X2": two}}))
        w.put(image, Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 1, "Height": 1}, b"(no) Tj"))
        name = literal(r["c_name"].encode())
        content = [b"/Artifact BMC BT /F1 10 Tf (hidden) Tj ET EMC /Span <</MCID 0>> BDC BT/F1 10 Tf 7 8 Td", name, b"Tj ET EMC BI /W 1 /H 1 ID (a) Tj EIx\nEI q 3 0 0 3 0 0 cm /X1 Do /Im Do Q BT /F1 10 Tf 9 9 Td (end)Tj ET"]
        parts = [w.add(flate(c)) for c in content]
        w.put(page, {"Type": Name("Page"), "Parent": tree, "Contents": parts, "Resources": {"Font": {"F1": font}, "XObject": {"X1": one, "Im": image}}})
        w.put(tree, {"Type": Name("Pages"), "Count": 1, "Kids": [page]})
        w.put(root, {"Type": Name("Catalog"), "Pages": tree})
        return w.pdf({"Root": root})

    runs = tables.text_runs(_built(_read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", build), columns=["seq", "text", "lbx", "lby"])
    return runs.select(_key("c_custkey"), "seq", "text", F.round("lbx").cast("long").alias("x"), F.round("lby").cast("long").alias("y"))


def operator_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operators of a page with their groups and operands, run together as far as the syntax lets them."""

    def build(r: dict) -> bytes:
        return pages_pdf([b"q 1 0 0 1 0 0 cm/GS1 gs BT[%s -5(b)]TJ(c)Tj ETQ /T/P DP BMC f*EMCW*n %d %d m" % (literal(r["s_name"].encode()), r["s_suppkey"], r["s_nationkey"])])

    ops = tables.content_operators(_built(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey", build))
    return ops.select(_key("s_suppkey"), "seq", "op", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), F.array_join("operands", "|").alias("operands"))


# The document.
def page_tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as pages below a node for each status: numbers, labels, inherited boxes, contents in parts."""

    def build(r: dict) -> bytes:
        w = Writer()
        root, tree, font = w.add(), w.add(), w.add(COURIER)
        nodes_ = []
        for status in sorted({o["status"] for o in r["orders"]}):
            node, kids = w.add(), []
            for o in sorted((o for o in r["orders"] if o["status"] == status), key=lambda o: o["key"]):
                page = {"Type": Name("Page"), "Parent": node}
                if o["key"] % 5:
                    text = literal(o["priority"].encode())
                    page["Contents"] = [w.add(flate(b"BT /F1 12 Tf 72 700 Td")), w.add(flate(text + b" Tj ET"))]
                if o["key"] % 2 == 0:
                    page["CropBox"] = [0, 0, 100 + o["key"] % 7, 50]
                kids.append(w.add(page))
            w.put(node, {"Type": Name("Pages"), "Parent": tree, "Kids": [*kids, None], "Count": len(kids), **({"MediaBox": [0, 0, 700, 800], "Rotate": 90} if status == "F" else {})})
            nodes_.append(node)
        w.put(tree, {"Type": Name("Pages"), "Kids": nodes_, "Count": len(r["orders"]), "MediaBox": [0, 0, 600, 800], "Resources": {"Font": {"F1": font}}})
        labels = {"Kids": [w.add({"Limits": [0, 0], "Nums": [0, {"S": Name("D")}]}), w.add({"Limits": [3, 6], "Nums": [3, {"S": Name("r"), "P": b"p-", "St": 5}, 6, w.add({"P": b"x"})]})]}
        w.put(root, {"Type": Name("Catalog"), "Pages": tree, "PageLabels": w.add(labels)})
        return w.pdf({"Root": root}, "stream")

    order = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    files = _built(_read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(order).alias("orders")), "o_custkey", build)
    # Both tables have the pages of a file in the same order; a file that either cannot read has none.
    read = tables.together(files, {"pages": tables.PAGES, "texts": tables.text_part()}).where("pages is not null and texts is not null")
    every = read.select("path", F.explode(F.arrays_zip("pages", "texts")).alias("x")).select("path", "x.pages.*", F.trim("x.texts.text").alias("text"))
    out = every.select("path", "page_no", "label", F.col("media_box")[2].cast("int").alias("media"), F.col("crop_box")[2].cast("int").alias("crop"), "rotate", "is_empty", "text")
    return out.select(_key("o_custkey"), "page_no", "label", "media", "crop", "rotate", "is_empty", "text")


LAYOUTS = (("XYZ", (1, None, 3)), ("Fit", ()), ("FitH", (5,)), ("FitV", (6,)), ("FitR", (1, 2, 3, 4)), ("FitB", ()), ("FitBH", (7,)), ("FitBV", (8,)))


def _outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as files, with their nations as outline items."""

    def build(r: dict) -> bytes:
        w = Writer()
        root, tree, outline, top = (w.add() for _ in range(4))
        pages = [w.add({"Type": Name("Page"), "Parent": tree}) for _ in r["nations"]]
        nations = sorted(r["nations"], key=lambda n: n["key"])
        named, old, items = [], {}, [w.add() for _ in nations]
        for i, (n, item) in enumerate(zip(nations, items, strict=True)):
            layout, values = LAYOUTS[n["key"] % 8]
            there = [pages[i], Name(layout), *values]
            way = n["key"] % 5
            entry = {"Title": utf16(n["name"]), "Parent": top, "F": n["key"] % 4, "Next": items[i + 1] if i + 1 < len(items) else None}
            if way == 0:
                entry |= {"Dest": there, "C": [1, 0.5, 0]}
            elif way == 1:
                entry["A"] = {"S": Name("GoTo"), "D": w.add(there)}
            elif way == 2:
                entry["Dest"] = b"n%03d" % n["key"]
                named += [b"n%03d" % n["key"], {"D": there}]
            elif way == 3:
                entry["Dest"] = Name(f"o{n['key']}")
                old[f"o{n['key']}"] = there
            else:
                entry["A"] = {"S": Name("GoToR"), "F": {"F": b"other.pdf"}, "D": [7, Name(layout), *values]}
            w.put(item, {k: v for k, v in entry.items() if v is not None})
        w.put(top, {"Title": r["r_name"].encode(), "Parent": outline, "First": items[0], "Last": items[-1], "Count": -len(items), "Dest": [pages[0], Name("Fit")]})
        w.put(outline, {"Type": Name("Outlines"), "First": top, "Last": top, "Count": 1})
        w.put(tree, {"Type": Name("Pages"), "Kids": pages, "Count": len(pages), "MediaBox": [0, 0, 9, 9]})
        w.put(root, {"Type": Name("Catalog"), "Pages": tree, "Outlines": outline, "Dests": old, "Names": {"Dests": {"Kids": [w.add({"Limits": [b"a", b"z"], "Names": named})]}}})
        return w.pdf({"Root": root}, "stream")

    nation = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    regions = _read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(nation).alias("nations")).join(_read(spark, sf_dir, "region"), "r_regionkey")
    return _built(regions, "r_regionkey", build)


def outline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline items that point to pages in every layout, by name, by action or to another file."""
    o = tables.outlines(_outlined(spark, sf_dir))
    values = F.array_join(F.transform("values", lambda v: v.cast("int").cast("string")), ",")
    return o.select(_key("r_regionkey"), F.array_join("path_ids", ".").alias("place"), "title", "count", F.coalesce("dest_page", F.lit(-1)).alias("dest_page"), "layout", values.alias("vals"), F.round(F.col("color")[1].cast("double"), 1).alias("green"), "flags", F.coalesce("filepath", F.lit("-")).alias("filepath"))


def named_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the same files, from the name tree and from the older dictionary."""
    n = tables.names(_outlined(spark, sf_dir))
    return n.select(_key("r_regionkey"), "tree", "name", F.regexp_extract("value", r"R /(\w+)", 1).alias("layout"))


def document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' numbers as marks of the catalog: tagging, labels, signatures; with the version and what lies before the header."""

    def build(r: dict) -> bytes:
        k = r["s_suppkey"]
        extra = {}
        if k % 3:
            extra["MarkInfo"] = {"Marked": True, **({"Suspects": True} if k % 3 == 2 else {})}
        if k % 4 == 0:
            extra["PageLabels"] = {"Nums": [0, {"S": Name("D")}]}
        if k % 5 < 2:
            extra["AcroForm"] = {"SigFlags": 3 if k % 5 == 1 else 2, "Fields": []}
        pdf = pages_pdf([b""] * (k % 4), catalog=extra, kind=("table", "stream")[k % 2], junk=b"x" * (k % 50) + b"\n", trailer={"ID": [b"%d" % k, b""]})
        return pdf.replace(b"/Count %d" % (k % 4), b"/Count 9", 1) if k % 2 == 0 else pdf

    d = tables.documents(_built(_read(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", build))
    return d.select(_key("s_suppkey"), "version", "page_count", "pages", "tagged", "has_signature", "has_labels", "repaired", "header_offset", F.col("ids")[0].alias("first_id"))


def info_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as information dictionaries: texts in each encoding, dates with zones, and bad dates, which are left out."""

    def build(r: dict) -> bytes:
        w = Writer()
        when = r["ts"].strftime("%Y%m%d%H%M%S")
        bad = r["event_id"] % 3 == 0
        info = {"Title": utf16(f"é {r['event_type']} \U0001f600"), "Author": f"user {r['user_id']}".encode(), "CreationDate": f"D:{when}-05'30".encode(), "ModDate": b"bad" if bad else f"D:{when}Z".encode(), "Trapped": Name("True"), "Count": r["event_id"]}
        return pages_pdf([], writer=w, trailer={"Info": w.add(info)})

    out = tables.info(_built(_read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id"), "event_id", build))
    utc = F.col("local") - F.make_dt_interval(mins=F.col("tz_minutes"))
    return out.select(_key("event_id"), "key", F.when(F.col("local").isNull(), F.col("text")).alias("text"), utc.alias("utc"))


def font_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' numbers as font flags, weights and names; a page's own font hides one of the same name above it."""

    def build(r: dict) -> bytes:
        k = r["o_orderkey"]
        w = Writer()
        root, tree, page = w.add(), w.add(), w.add()
        flags = k * 7919 % 524288
        own = w.add({"Type": Name("FontDescriptor"), "Flags": flags, "FontName": Name("ABCDEF+Some" + ("-Bold" if k % 5 == 0 else "")), "FontWeight": 700 if k % 7 == 0 else 400})
        font = {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name(f"ABCDEF+Font{k}"), "FirstChar": 65, "LastChar": 66, "Widths": [k % 900, 0], "FontDescriptor": own}
        w.put(page, {"Type": Name("Page"), "Parent": tree, "Resources": {"Font": {"F1": w.add(font)}}})
        w.put(tree, {"Type": Name("Pages"), "Kids": [page], "Count": 1, "Resources": {"Font": {"F1": COURIER, "F2": {**COURIER, "BaseFont": Name("Courier-Oblique")}}}})
        w.put(root, {"Type": Name("Catalog"), "Pages": tree})
        return w.pdf({"Root": root})

    f = tables.fonts(_built(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", build))
    return f.select(_key("o_orderkey"), "resource", "name", "subtype", "is_bold", "is_italic", "is_fixed", "is_all_cap", "is_small_cap", F.coalesce(F.element_at("widths", 65), F.lit(-1.0)).cast("int").alias("width_a"), F.col("missing_width").cast("int").alias("missing"))


CORE_ROWS = ("Helvetica", "Helvetica-Bold", "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic")


def string_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names in each of the core fonts, in a font with widths of its own, and in one of two-byte codes: the widths of the runs."""

    def build(r: dict) -> bytes:
        k, name = r["p_partkey"] % 8, r["p_name"].encode("latin-1", "replace")
        font, shown = {"Type": Name("Font"), "Subtype": Name("Type1"), "Encoding": Name("WinAnsiEncoding")}, literal(name)
        if k < 6:
            font["BaseFont"] = Name(CORE_ROWS[k])
        elif k == 6:
            font |= {"BaseFont": Name("Own"), "FirstChar": 32, "LastChar": 126, "Widths": [100 + 5 * i for i in range(95)]}
        else:
            child = {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Cid"), "DW": 300, "W": [97, [401, 402, 403], 100, 110, 500]}
            font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Cid"), "Encoding": Name("Identity-H"), "DescendantFonts": [child]}
            shown = b"<" + b"".join(b"%04X" % b for b in name) + b">"
        return pages_pdf([b"BT /F1 10 Tf 72 700 Td " + shown + b" Tj ET"], font=font)

    runs = tables.text_runs(_built(_read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", build), columns=["lbx", "rbx"])
    return runs.select(_key("p_partkey"), F.round((F.col("rbx").cast("double") - F.col("lbx").cast("double")) * 100).cast("long").alias("width"))


def encoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code in each of the encodings: base encodings, differences by name, maps to Unicode before an encoding, code charts of their own."""

    def build(r: dict) -> bytes:
        code, k = 33 + r["p_partkey"] % 94, r["p_partkey"] // 94 % 8
        font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Own"), "FirstChar": 0, "Widths": [500] * 256}
        shown = b"<%02X>" % code
        if k == 0:
            font["Encoding"] = Name("WinAnsiEncoding")
            shown = b"<%02X>" % (code + 128)
        elif k == 1:
            font["Encoding"] = Name("MacRomanEncoding")
            shown = b"<%02X>" % (code + 128)
        elif k == 2:
            font["Encoding"] = {"BaseEncoding": Name("WinAnsiEncoding"), "Differences": [code, Name(f"uni{code + 0x400:04X}"), Name("x.alt")]}
        elif k == 3:
            cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <21> <7E> <0421> endbfrange"
            font |= {"Encoding": Name("WinAnsiEncoding"), "ToUnicode": flate(cmap)}
        elif k == 4:
            cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <%04X> <D83DDE00> <FFFF> <0041> endbfchar" % (code + 256)
            font = {"Type": Name("Font"), "Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [{"Subtype": Name("CIDFontType2")}], "ToUnicode": flate(cmap)}
            shown = b"<%04X>" % (code + 256)
        elif k == 5:
            font["BaseFont"] = Name("ZapfDingbats")
        elif k == 6:
            font["Encoding"] = {"Differences": [code, Name(f"afii{10017 + code % 6}"), Name("a")]}
        w = Writer()
        if isinstance(font.get("ToUnicode"), Stream):
            font["ToUnicode"] = w.add(font["ToUnicode"])
        return pages_pdf([b"BT /F1 10 Tf 72 700 Td " + shown + b" Tj ET"], font=font, writer=w)

    runs = tables.text_runs(_built(_read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", build), columns=["text"])
    return runs.select(_key("p_partkey"), F.col("text"))


def kern_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kern sums of parts' names by the pairs of an AFM file."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    afm = read_afm("FontName X\n" + "".join(f"KPX {a} {b} {(7 * i + 3 * j) % 40 - 20}\n" for i, a in enumerate(letters) for j, b in enumerate(letters) if (i + j) % 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(kern(afm, list(x or ""))) for x in b.column(1).to_pylist()], pa.int64())], names=["p_partkey", "kern"])

    return _read(spark, sf_dir, "part").select("p_partkey", "p_name").mapInArrow(run, "p_partkey long, kern long")


def object_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object of every type, written by hand with comments and escapes, printed again; and the references it holds."""

    def build(r: dict) -> bytes:
        k = r["o_orderkey"]
        raw = rb"/R -1.50/N/a#20b/S(a\(\101)/H<4 1 4>/A[true false null +7<</X(y)>>]/Z null"
        w = Writer()
        w.add(RawBody(b"<</I %d %%a comment\n" % k + raw + b"/I %d/L 1 0 R>>" % (k + 1)))
        return pages_pdf([b""], writer=w)

    files = _built(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", build)
    read = tables.together(files, {"objects": tables.object_part(nums=[1]), "edges": tables.edge_part(nums=[1])})
    values = read.select("path", "edges", F.explode("objects").alias("o")).select("path", "edges", "o.value", F.size("o.entries").alias("n"))
    links = values.select("path", "value", "n", F.explode("edges").alias("e"))
    return links.select(_key("o_orderkey"), "value", "n", F.concat_ws(">", "e.key", F.col("e.to_num").cast("string")).alias("link"))


def attached_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as embedded files of a name tree and as file annotations of a page."""

    def build(r: dict) -> bytes:
        w = Writer()
        data = (r["text"] or "").encode()
        spec = lambda name: w.add({"Type": Name("Filespec"), "F": name, "UF": utf16(name.decode() + " é"), "EF": {"F": w.add(flate(data, Type=Name("EmbeddedFile")))}})
        leaf = w.add({"Limits": [b"a", b"b"], "Names": [b"a", spec(b"one.txt"), b"b", spec(b"two.txt")]})
        note = w.add({"Type": Name("Annot"), "Subtype": Name("FileAttachment"), "FS": spec(b"note.txt")})
        root, tree, page = w.add(), w.add(), w.add()
        w.put(page, {"Type": Name("Page"), "Parent": tree, "Annots": [note, w.add({"Subtype": Name("Link")})]})
        w.put(tree, {"Type": Name("Pages"), "Kids": [page], "Count": 1})
        w.put(root, {"Type": Name("Catalog"), "Pages": tree, "Names": {"EmbeddedFiles": {"Kids": [leaf]}}, "MarkInfo": {"Marked": True}})
        return w.pdf({"Root": root})

    got = tables.attachments(_built(_read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", build))
    return got.select(_key("doc_id"), F.coalesce("page_no", F.lit(0)).alias("page_no"), "name", F.md5("content").alias("md5"))


# Security.
CRYPTS = ((2, True), (3, True), (4, False), (4, True), (5, True), (6, True))


def encrypted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls in files of each revision of the standard handler, opened as user, as owner or without a password; and some that no password opens."""

    def build(r: dict) -> bytes:
        k = r["page_id"]
        revision, aes = CRYPTS[k % 6]
        user, owner = (("", "own"), ("user", "own"), ("other", "own"), ("no", "way"))[k // 6 % 4]
        w = Writer()
        info = w.add({"Title": utf16(r["url"] or "")})
        strings = "Identity" if revision >= 4 and k // 24 % 2 else "StdCF"
        return pages_pdf([b"BT /F1 12 Tf 72 700 Td " + literal((r["url"] or "").encode("cp1252", "replace")) + b" Tj ET"], writer=w, trailer={"Info": info}, encryption=Encryption(revision, user, owner, aes, strings=strings))

    files = _built(_read(spark, sf_dir, "pages").select("page_id", "url"), "page_id", build)
    words = ["user", "own"]
    read = tables.together(files, {"documents": tables.DOCUMENTS, "info": tables.INFO, "texts": tables.text_part()}, words)
    one = read.select("path", F.col("documents_error").isNotNull().alias("failed"), F.col("documents")[0].alias("d"), _title(), F.explode_outer("texts").alias("t"))
    return one.select(_key("page_id"), "failed", F.coalesce("d.encrypted", F.lit(False)).alias("encrypted"), F.coalesce("d.permissions", F.lit(-1)).alias("permissions"), "title", F.trim("t.text").alias("text"))


def recipient_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names encrypted to the holders of certificates, opened with a key file; those meant for another stay shut."""
    mine, other = fixture_key(3), fixture_key(4)
    own, foreign = certificate("Reader", mine, "Reader", mine, False, 8), certificate("Other", other, "Other", other, False, 9)

    def build(r: dict) -> bytes:
        k = r["s_suppkey"]
        to = ([own], [foreign, own], [foreign])[k % 3]
        w = Writer()
        info = w.add({"Title": utf16(r["s_name"])})
        return pages_pdf([b"BT /F1 12 Tf 72 700 Td " + literal(r["s_name"].encode()) + b" Tj ET"], writer=w, trailer={"Info": info}, encryption=RecipientEncryption(to, (128, 256)[k % 2]))

    files, keys = _built(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", build), [tables.KeyFile(key_file(mine, own), "")]
    read = tables.together(files, {"documents": tables.DOCUMENTS, "info": tables.INFO, "texts": tables.text_part()}, keys)
    one = read.select("path", F.coalesce(F.col("documents")[0]["permissions"], F.lit(-1)).alias("permissions"), F.col("documents_error").isNull().alias("opened"), _title(), F.explode_outer("texts").alias("t"))
    return one.select(_key("s_suppkey"), "permissions", "opened", "title", F.trim("t.text").alias("text"))


def signature_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names signed in each format, some changed afterwards, some by a signer whose issuer is no authority, expired or not trusted."""
    root, middle, me, stranger = (fixture_key(i) for i in range(1, 5))
    anchor = certificate("Root", root, "Root", root, True)
    issuer = certificate("Middle", middle, "Root", root, True, 2)
    signer = certificate("Signer", me, "Middle", middle, False, 3)
    chains = {
        "good": (signer, [issuer]), "changed": (signer, [issuer]), "unknown": (certificate("Signer", me, "Stranger", stranger, False, 4), []),
        "leaf": (certificate("Forged", stranger, "Signer", me, False, 5), [signer, issuer]), "expired": (certificate("Signer", me, "Middle", middle, False, 6, ("20200101000000Z", "20210101000000Z")), [issuer]),
    }
    cases = list(chains)

    def build(r: dict) -> bytes:
        k = r["c_custkey"]
        case, form = cases[k % 5], k // 5 % 5
        cert, others = chains[case]
        key = stranger if case == "leaf" else me
        value = {"SubFilter": Name(("adbe.pkcs7.detached", "adbe.pkcs7.sha1", "ETSI.CAdES.detached", "adbe.x509.rsa_sha1", "ETSI.RFC3161")[form]), "Name": utf16(r["c_name"]), "M": b"D:20240203040506Z"}

        def sign(data: bytes) -> bytes:
            if form == 1:
                return signed_data(data, cert, key, others, content=("1.2.840.113549.1.7.1", hashlib.sha1(data).digest()))
            if form == 3:
                return der(4, rsa_sign(key, SHA1, hashlib.sha1(data).digest()))
            return time_stamp(data, cert, key, others, "20240102030405Z") if form == 4 else signed_data(data, cert, key, others)

        if form == 3:
            value["Cert"] = [cert, *others]
        pdf = signed_pdf(sign, {"T": b"s%d" % k}, value)
        return pdf.replace(b"/BaseFont /Courier", b"/BaseFont /Courxer") if case == "changed" else pdf

    files = _built(_read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", build)
    s = tables.signatures(files, trust_pem=pem(anchor))
    why = F.regexp_extract("error_message", r"(no trusted issuer|may not issue|not valid at|changed|other data)", 1)
    return s.select(_key("c_custkey"), "fqt", "page_no", "name", "subfilter", "covers_file", "passed", F.when(F.col("passed"), F.lit("")).otherwise(why).alias("why"), F.when(F.col("passed"), F.col("certs")[0]["cn"]).alias("cn"), F.when(F.col("passed"), F.col("verified_at")).alias("verified_at"))


def signer_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The certificates of signed files, one for each subject and issuer."""
    key = fixture_key(1)
    made = {k: certificate(f"Signer {k}", key, "Root", key, False, 10 + k) for k in range(25)}

    def build(r: dict) -> bytes:
        cert = made[r["s_nationkey"] % 25]
        return signed_pdf(lambda data: signed_data(data, cert, key, [made[0]]), {"T": b"s"}, {"SubFilter": Name("adbe.pkcs7.detached")})

    files = _built(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", build)
    anchor = certificate("Root", key, "Root", key, True)
    return tables.certificates(tables.signatures(files, trust_pem=pem(anchor))).select("subject", "issuer", "not_before", F.col("text").startswith("-----BEGIN").alias("is_pem"))


# Scalars.
def _scalar(df: DataFrame, key: str, value: str, f: Callable[[object], str | None], name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f(v) for v in b.column(1).to_pylist()], pa.string())], names=[key, name])

    return df.select(F.col(key).cast("long").alias(key), value).mapInArrow(run, f"{key} long, {name} string")


def hex_text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as hex strings, with a mark, as UTF-16 without one, and in the document encoding."""

    def back(name: str) -> str:
        forms = ["FEFF" + name.encode("utf-16-be").hex(), name.encode("utf-16-be").hex(), scalars.pdfdoc_bytes(name).hex()]
        return "|".join(map(scalars.hex_text, forms))

    return _scalar(_read(spark, sf_dir, "part"), "p_partkey", "p_name", back, "text")


def date_print_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates printed again in full, with their zone."""
    e = _read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHH"), F.when(F.col("event_id") % 3 == 0, "+05'30'").when(F.col("event_id") % 3 == 1, "-08").otherwise("Z")).alias("d"))
    return _scalar(e, "event_id", "d", lambda d: scalars.format_date(*scalars.parse_date(d)), "printed")


def asn1_time_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times in both forms of certificates, with fractions and zones."""

    def back(v: str) -> str:
        return asn1_time(next(nodes(der(0x17 if len(v) < 15 else 0x18, v.encode())))).isoformat(" ")

    forms = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyMMddHHmmss'Z'")).when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lit(".25Z"))).otherwise(F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+0130")))
    return _scalar(_read(spark, sf_dir, "events").select("event_id", forms.alias("t")), "event_id", "t", back, "utc")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (damaged_files, revision_files, filter_variants, painted_lines, shown_strings, graphics_states, forms_and_marks, operator_groups, page_tree_files, outline_files, info_files, font_files, string_widths, encoded_text, kern_pairs, object_dump, attached_files, named_destinations, document_flags, encrypted_files, recipient_files, signature_files, signer_certificates, hex_text_parts, date_print_events, asn1_time_events)
    return {f.__name__: f for f in own}


WORDS = "trim(regexp_replace(coalesce(text, ''), '[ \\n\\r\\t]+', ' ', 'g'))"
DIGEST = "SELECT doc_id, md5(coalesce(text, '')) AS out_md5, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents"


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


def _roman(n: str) -> str:
    out, rest = [], n
    for value, digits in scalars.ROMAN:
        out.append(f"repeat('{digits}', CAST(({rest}) // {value} AS INT))")
        rest = f"({rest}) % {value}"
    return " || ".join(out)


def oracle_sql() -> dict[str, str]:
    a_line = "coalesce(regexp_matches(text, '[^\\n]'), false)"
    bad = f"doc_id % 9 IN (2, 3, 5, 7) OR (doc_id % 9 = 4 AND {a_line})"
    core = " ".join(f"WHEN {k} THEN [{', '.join(charsets.ASCII_WIDTHS[n].split())}][c - 31]" for k, n in enumerate(CORE_ROWS))
    win, mac = ([bytes([i]).decode(codec, "ignore") for i in range(161, 255)] for codec in ("cp1252", "mac_roman"))
    mac = [c.replace("€", "¤") for c in mac]
    ops = "(0, 'q', 0, -1, ''), (1, 'cm', 1, 0, '1|0|0|1|0|0'), (2, 'gs', 1, 0, '/GS1'), (3, 'BT', 1, 0, ''), (4, 'TJ', 2, 3, NULL), (5, 'Tj', 2, 3, '<63>'), (6, 'ET', 1, 3, ''), (7, 'Q', 0, 0, ''), (8, 'DP', 0, -1, '/T|/P'), (9, 'BMC', 0, -1, ''), (10, 'f*', 1, 9, ''), (11, 'EMC', 0, 9, ''), (12, 'W*', 0, -1, ''), (13, 'n', 0, -1, ''), (14, 'm', 0, -1, NULL)"
    layout = "[" + ", ".join(f"'{n}'" for n, _ in LAYOUTS) + "]"
    values = "[" + ", ".join("'" + ",".join(str(v or 0) for v in vs) + "'" for _, vs in LAYOUTS) + "]"
    number = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey)"
    return {
        "damaged_files": f"SELECT doc_id, {bad} AS failed, CASE WHEN NOT ({bad}) THEN md5(CASE WHEN doc_id % 9 = 4 THEN 'far' ELSE {WORDS} END) END AS words_md5 FROM documents",
        "revision_files": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN o_orderpriority ELSE o_orderstatus END AS title, CAST(CASE WHEN o_orderkey % 4 = 3 THEN 2 ELSE 1 END AS INT) AS entries, CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'm' ELSE 'n' END AS kind FROM orders",
        "filter_variants": DIGEST,
        "painted_lines": "SELECT l_orderkey, string_agg(l_returnflag || l_linestatus || l_linenumber, '' ORDER BY floor(l_extendedprice / 10000), l_quantity, l_linenumber, l_returnflag || l_linestatus || l_linenumber) AS text FROM lineitem GROUP BY l_orderkey",
        "shown_strings": "WITH x AS (SELECT *, CAST(round(l_discount * -3000) AS INT) AS gap, CAST(l_quantity AS INT) AS q FROM lineitem), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, q, l_returnflag, l_linestatus, gap) - 1 AS INT) AS seq, CASE WHEN q % 2 = 0 THEN 100 ELSE 200 END AS tz FROM x) SELECT l_orderkey, seq, l_returnflag || CASE WHEN -gap > 180 THEN ' ' ELSE '' END || l_linestatus || ' o' AS text, CAST(round(((2400 - gap) * (8 + l_linenumber) / 1000.0 + 3 * (q % 4) + q % 7) * tz * 10) AS BIGINT) AS width, CAST(700 - 20 * seq AS BIGINT) AS y FROM y",
        "graphics_states": "WITH r AS (SELECT l_orderkey, l_linenumber AS n, CAST(min(l_quantity) AS INT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber), p AS (SELECT *, unnest([{t: 'x', k: 1, y: 2 * n + q}, {t: 'y', k: 1, y: 2 * n + q - 24}, {t: 'z', k: 2, y: 4 * n + q - 24}, {t: 'w', k: 2, y: 6 * n + q - 24}, {t: 'v', k: 2, y: 8 * n + q - 24}]) AS s FROM r) SELECT l_orderkey, s.t || n AS text, CAST((s.k * q * (1 + q % 2) + n) * (1 + n % 3) + q AS BIGINT) AS x, CAST(s.y * 2 + n AS BIGINT) AS y FROM p UNION ALL SELECT l_orderkey, 'u' || n, 5, 5 FROM r",
        "forms_and_marks": "WITH r AS (SELECT c_custkey, unnest([{seq: 0, text: c_name, x: 7, y: 8}, {seq: 1, text: 'form', x: 48, y: 84}, {seq: 2, text: c_mktsegment, x: 66, y: 108}, {seq: 3, text: 'end', x: 9, y: 9}]) AS s FROM customer) SELECT c_custkey, CAST(s.seq AS INT) AS seq, s.text AS text, CAST(s.x AS BIGINT) AS x, CAST(s.y AS BIGINT) AS y FROM r",
        "operator_groups": f"SELECT s_suppkey, CAST(seq AS INT) AS seq, op, CAST(depth AS INT) AS depth, CAST(parent AS INT) AS parent, CASE seq WHEN 4 THEN '[<' || upper(hex(s_name)) || '> -5 <62>]' WHEN 14 THEN s_suppkey || '|' || s_nationkey ELSE operands END AS operands FROM supplier, (VALUES {ops}) o(seq, op, depth, parent, operands)",
        "page_tree_files": f"WITH p AS (SELECT *, {number} AS page_no, CASE WHEN o_orderstatus = 'F' THEN 700 ELSE 600 END AS media FROM orders) SELECT o_custkey, CAST(page_no AS INT) AS page_no, CASE WHEN page_no <= 3 THEN CAST(page_no AS VARCHAR) WHEN page_no <= 6 THEN 'p-' || {_roman('page_no + 1')} ELSE 'x' END AS label, CAST(media AS INT) AS media, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 100 + o_orderkey % 7 ELSE media END AS INT) AS crop, CAST(CASE WHEN o_orderstatus = 'F' THEN 90 ELSE 0 END AS INT) AS rotate, o_orderkey % 5 = 0 AS is_empty, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS text FROM p",
        "outline_files": f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) SELECT CAST(n_regionkey AS BIGINT) AS r_regionkey, '1.' || i AS place, n_name AS title, CAST(0 AS INT) AS count, CAST(CASE WHEN n_nationkey % 5 = 4 THEN 8 ELSE i END AS INT) AS dest_page, {layout}[n_nationkey % 8 + 1] AS layout, {values}[n_nationkey % 8 + 1] AS vals, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS green, CAST(n_nationkey % 4 AS INT) AS flags, CASE WHEN n_nationkey % 5 = 4 THEN 'other.pdf' ELSE '-' END AS filepath FROM n UNION ALL SELECT CAST(r_regionkey AS BIGINT), '1', r_name, CAST(-count(*) AS INT), 1, 'Fit', '', 0, 0, '-' FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name",
        "named_destinations": f"SELECT CAST(n_regionkey AS BIGINT) AS r_regionkey, 'Dests' AS tree, CASE WHEN n_nationkey % 5 = 2 THEN 'n' || printf('%03d', n_nationkey) ELSE 'o' || n_nationkey END AS name, {layout}[n_nationkey % 8 + 1] AS layout FROM nation WHERE n_nationkey % 5 IN (2, 3)",
        "document_flags": "SELECT s_suppkey, '1.5' AS version, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 9 ELSE s_suppkey % 4 END AS BIGINT) AS page_count, CAST(s_suppkey % 4 AS BIGINT) AS pages, ['none', 'tagged', 'suspect'][s_suppkey % 3 + 1] AS tagged, s_suppkey % 5 = 1 AS has_signature, s_suppkey % 4 = 0 AS has_labels, false AS repaired, CAST(s_suppkey % 50 + 1 AS BIGINT) AS header_offset, lower(hex(CAST(s_suppkey AS VARCHAR))) AS first_id FROM supplier",
        "recipient_files": "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 3 < 2 THEN 4294963396 ELSE -1 END AS BIGINT) AS permissions, s_suppkey % 3 < 2 AS opened, CASE WHEN s_suppkey % 3 < 2 THEN s_name END AS title, CASE WHEN s_suppkey % 3 < 2 THEN s_name END AS text FROM supplier",
        "info_files": "SELECT event_id, 'Title' AS key, 'é ' || event_type || ' ' || chr(128512) AS text, CAST(NULL AS TIMESTAMP) AS utc FROM events UNION ALL SELECT event_id, 'Author', 'user ' || user_id, NULL FROM events UNION ALL SELECT event_id, 'Trapped', 'True', NULL FROM events UNION ALL SELECT event_id, 'Count', CAST(event_id AS VARCHAR), NULL FROM events UNION ALL SELECT event_id, 'CreationDate', NULL, date_trunc('second', ts) + INTERVAL 330 MINUTE FROM events UNION ALL SELECT event_id, 'ModDate', NULL, date_trunc('second', ts) FROM events WHERE event_id % 3 <> 0",
        "font_files": "WITH f AS (SELECT o_orderkey AS k, o_orderkey * 7919 % 524288 AS g FROM orders) SELECT k AS o_orderkey, 'F1' AS resource, 'ABCDEF+Font' || k AS name, 'TrueType' AS subtype, k % 5 = 0 OR k % 7 = 0 AS is_bold, g & 64 <> 0 AS is_italic, g & 1 <> 0 AS is_fixed, g & 65536 <> 0 AS is_all_cap, g & 131072 <> 0 AS is_small_cap, CAST(CASE WHEN k % 900 = 0 THEN -1 ELSE k % 900 END AS INT) AS width_a, CAST(1000 AS INT) AS missing FROM f UNION ALL SELECT k, 'F2', 'Courier-Oblique', 'Type1', false, true, true, false, false, -1, 600 FROM f",
        "string_widths": f"WITH c AS (SELECT p_partkey, p_partkey % 8 AS k, unnest(list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1)))) AS c FROM part) SELECT p_partkey, CAST(sum(CASE k {core} WHEN 6 THEN 100 + 5 * (c - 32) ELSE CASE WHEN c BETWEEN 97 AND 99 THEN c + 304 WHEN c BETWEEN 100 AND 110 THEN 500 ELSE 300 END END) AS BIGINT) AS width FROM c GROUP BY p_partkey",
        "encoded_text": f"WITH c AS (SELECT p_partkey, 33 + p_partkey % 94 AS c, p_partkey // 94 % 8 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN {_list(win)}[c - 32] WHEN 1 THEN {_list(mac)}[c - 32] WHEN 2 THEN chr(CAST(c + 1024 AS INT)) WHEN 3 THEN chr(CAST(c + 1024 AS INT)) WHEN 4 THEN chr(128512) WHEN 5 THEN {_list(scalars.ENCODINGS['ZapfDingbats'][33:127])}[c - 32] WHEN 6 THEN chr(CAST(1040 + c % 6 AS INT)) ELSE CASE c WHEN 39 THEN '’' WHEN 96 THEN '‘' ELSE chr(CAST(c AS INT)) END END AS text FROM c",
        "kern_pairs": "WITH c AS (SELECT p_partkey, unnest(list_transform(range(1, length(p_name) + 1), lambda i: [ascii(substr(p_name, i, 1)) - 97, CASE WHEN i < length(p_name) THEN ascii(substr(p_name, i + 1, 1)) - 97 ELSE -1 END])) AS p FROM part) SELECT p_partkey, CAST(sum(CASE WHEN p[1] BETWEEN 0 AND 25 AND p[2] BETWEEN 0 AND 25 AND (p[1] + p[2]) % 3 <> 0 THEN (7 * p[1] + 3 * p[2]) % 40 - 20 ELSE 0 END) AS BIGINT) AS kern FROM c GROUP BY p_partkey",
        "object_dump": "SELECT o_orderkey, '<</I ' || (o_orderkey + 1) || ' /R -1.5 /N /a#20b /S <612841> /H <4140> /A [true false null 7 <</X <79>>>] /L 1 0 R>>' AS value, CAST(7 AS INT) AS n, 'L>1' AS link FROM orders",
        "attached_files": "SELECT doc_id, CAST(p AS INT) AS page_no, n || ' é' AS name, md5(coalesce(text, '')) AS md5 FROM documents, (VALUES (0, 'one.txt'), (0, 'two.txt'), (1, 'note.txt')) f(p, n)",
        "encrypted_files": "SELECT page_id, page_id // 6 % 4 = 3 AS failed, page_id // 6 % 4 <> 3 AS encrypted, CAST(CASE page_id // 6 % 4 WHEN 3 THEN -1 WHEN 2 THEN 4294967295 ELSE 4294967292 END AS BIGINT) AS permissions, CASE WHEN page_id // 6 % 4 <> 3 THEN coalesce(url, '') END AS title, CASE WHEN page_id // 6 % 4 <> 3 THEN trim(coalesce(url, '')) END AS text FROM pages",
        "signature_files": "WITH c AS (SELECT *, c_custkey % 5 AS k, c_custkey // 5 % 5 AS f FROM customer) SELECT c_custkey, 's' || c_custkey AS fqt, CAST(1 AS INT) AS page_no, c_name AS name, ['adbe.pkcs7.detached', 'adbe.pkcs7.sha1', 'ETSI.CAdES.detached', 'adbe.x509.rsa_sha1', 'ETSI.RFC3161'][f + 1] AS subfilter, true AS covers_file, k = 0 AS passed, CASE k WHEN 0 THEN '' WHEN 1 THEN CASE WHEN f = 4 THEN 'other data' ELSE 'changed' END WHEN 2 THEN 'no trusted issuer' WHEN 3 THEN 'may not issue' ELSE 'not valid at' END AS why, CASE WHEN k = 0 THEN 'Signer' END AS cn, CASE WHEN k = 0 THEN CASE WHEN f = 3 THEN TIMESTAMP '2024-02-03 04:05:06' ELSE TIMESTAMP '2024-01-02 03:04:05' END END AS verified_at FROM c",
        "signer_certificates": "SELECT DISTINCT 'CN=Signer ' || k AS subject, 'CN=Root' AS issuer, TIMESTAMP '2020-01-01 00:00:00' AS not_before, true AS is_pem FROM (SELECT s_nationkey % 25 AS k FROM supplier UNION ALL SELECT 0)",
        "hex_text_parts": "SELECT p_partkey, p_name || '|' || p_name || '|' || p_name AS text FROM part",
        "date_print_events": "SELECT event_id, 'D:' || strftime(ts, '%Y%m%d%H') || '0000' || CASE event_id % 3 WHEN 0 THEN '+05''30' WHEN 1 THEN '-08''00' ELSE 'Z' END AS printed FROM events",
        "asn1_time_events": "SELECT event_id, strftime(date_trunc('second', ts) - CASE WHEN event_id % 3 = 2 THEN INTERVAL 90 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%d %H:%M:%S') AS utc FROM events",
    }
