"""Tables over collections of PDF files.

A file is parsed in one Arrow task, an unreadable one gives an ``error`` instead of failing the job. Each table asks the
parser only for what it holds, so listing labels does not evaluate page content. ``files`` has (path, content).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.filters import UnsupportedFilter
from ..functions.scalars import date_columns, text_string, utc_date
from ..operators.content import Evaluator, grouped, paint
from ..operators.fonts import ALL_CAP, BOLD, FIXED, ITALIC, SMALL_CAP, Font
from ..sources.certificates import check_cms, check_pkcs1, check_stamp, pem_certificates, read_pkcs12
from ..sources.document import BadFile, Document
from ..sources.syntax import Ref, Stream, show


def pdf_files(spark: SparkSession, path: str, pattern: str = "*.pdf", most_bytes: int = 1 << 30) -> DataFrame:
    """(path, modificationTime, length, content) of the files below ``path``; one over ``most_bytes`` has a null content, which the tables report as an error."""
    every = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    large = every.where(F.col("length") > most_bytes).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    return every.where(F.col("length") <= most_bytes).unionByName(large)


class KeyFile(NamedTuple):
    """A PKCS#12 file and its password, for documents that are encrypted to recipients; given among the passwords."""

    data: bytes
    password: str


#: Rows, and bytes of texts and contents, that a batch of rows is cut at: many small files share one, a large file takes several.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def _reader(passwords: list[str | KeyFile]) -> Callable[[], Callable]:
    """A function that gives, once in a task, the function from a file's content to its ``Document``."""
    words, key_files = [p for p in passwords if isinstance(p, str)], [p for p in passwords if isinstance(p, KeyFile)]

    def opened() -> Callable:
        recipient = read_pkcs12(*key_files[0]) if key_files else None

        def read(content: pa.BinaryScalar) -> Document:
            if not content.is_valid:
                raise BadFile("the file is missing or too large")
            return Document(content.as_py(), words, recipient)

        return read

    return opened


def _in_batches(batches: Iterator[pa.RecordBatch], schema: StructType, rows_of: Callable) -> Iterator[pa.RecordBatch]:
    """The rows of every file (a list from its path and content) in batches bounded by rows and bytes."""
    arrow, sized = to_arrow_schema(schema), [f.name for f in schema if f.dataType.typeName() in ("string", "binary")]
    held, size = [], 0
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            for r in rows_of(path, content):
                held.append(r)
                for c in sized:
                    size += len(r.get(c) or "")
                if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def _table(files: DataFrame, ddl: str, rows: Callable[[Document], Iterator[dict]], passwords: list[str | KeyFile], reports: bool = False) -> DataFrame:
    """``path`` and the rows that each file yields. With ``reports`` a bad file gives one row that has only ``error``."""
    opened = _reader(passwords)
    schema: StructType = _parse_datatype_string(f"path string, {ddl}" + (", error string" if reports else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = opened()

        def rows_of(path, content) -> list[dict]:
            try:
                out = list(rows(read(content)))
            except Exception as e:  # whatever is wrong with a file is that file's error
                out = [{"error": f"{type(e).__name__}: {e}"}] if reports else []
            for r in out:
                r["path"] = path
            return out

        yield from _in_batches(batches, schema, rows_of)

    return files.select("path", "content").mapInArrow(run, schema)


def together(files: DataFrame, parts: dict[str, tuple[str, Callable[[Document], Iterator[dict]]]], passwords: list[str | KeyFile] = ()) -> DataFrame:
    """Several tables from one reading of each file: path, and for each part (``DOCUMENTS``, ``INFO`` and so on) an array of its rows and ``<part>_error``, of which one is null. Stands for joins of these tables by path."""
    opened = _reader(list(passwords))
    schema: StructType = _parse_datatype_string("path string, " + ", ".join(f"{n} array<struct<{_fields(ddl)}>>, {n}_error string" for n, (ddl, _) in parts.items()))
    errors = [f"{n}_error" for n in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = opened()

        def rows_of(path, content) -> list[dict]:
            try:
                d = read(content)
            except Exception as e:
                return [{"path": path, **dict.fromkeys(errors, f"{type(e).__name__}: {e}")}]
            out = {"path": path}
            for n, (_, rows) in parts.items():
                try:
                    out[n] = list(rows(d))
                except Exception as e:
                    out[f"{n}_error"] = f"{type(e).__name__}: {e}"
            return [out]

        yield from _in_batches(batches, schema, rows_of)

    return files.select("path", "content").mapInArrow(run, schema)


def _fields(ddl: str) -> str:
    return _parse_datatype_string(ddl).simpleString().removeprefix("struct<").removesuffix(">")


def _document_rows(d: Document) -> Iterator[dict]:
    form = d.get(d.root.get("AcroForm")) or {}
    ids = d.get(d.trailer.get("ID")) or []
    yield {"version": d.version, "page_count": d.get((d.get(d.root.get("Pages")) or {}).get("Count")), "pages": len(d.pages()), "encrypted": d.security is not None, "permissions": d.security.permissions if d.security else None, "tagged": d.tagged(), "has_signature": bool(int(d.get(form.get("SigFlags")) or 0) & 1), "has_labels": d.root.get("PageLabels") is not None, "repaired": d.repaired, "header_offset": d.start, "ids": [i.hex() for i in ids if isinstance(i, bytes)]}


DOCUMENTS = ("version string, page_count long, pages long, encrypted boolean, permissions long, tagged string, has_signature boolean, has_labels boolean, repaired boolean, header_offset long, ids array<string>", _document_rows)


def documents(files: DataFrame, passwords: list[str] = ()) -> DataFrame:
    """One row a file: version, page_count (as the root of the page tree says), pages, encrypted, tagged, has_signature, has_labels, repaired, ids, error."""
    return _table(files, *DOCUMENTS, list(passwords), True)


XREF = ("num long, gen long, rev long, kind string, position long", lambda d: ({"num": n, "gen": g, "rev": r, "kind": k, "position": w} for n, g, r, k, w in d.revisions))


def xref(files: DataFrame, passwords: list[str] = ()) -> DataFrame:
    """All cross-reference entries with their revision, 0 the newest; see ``relational.newest_wins``."""
    return _table(files, *XREF, list(passwords))


def object_part(streams: bool = False, nums: list[int] | None = None) -> tuple[str, Callable]:
    """The part of ``objects`` for ``together``."""

    def rows(d: Document):
        for num in sorted(d.xref) if nums is None else [n for n in sorted(nums) if n in d.xref]:
            v = d.object(num)
            if v is None:
                continue
            info = v.info if isinstance(v, Stream) else v if isinstance(v, dict) else {}
            data = None
            if streams and isinstance(v, Stream):
                try:
                    data = d.decoded(v)
                except UnsupportedFilter:
                    data = None
            yield {"num": num, "kind": type(v).__name__, "value": show(v), "entries": [(k, show(x)) for k, x in info.items()], "filters": d.filters(v)[0] if isinstance(v, Stream) else [], "length": len(v.raw) if isinstance(v, Stream) else None, "data": data}

    return "num long, kind string, value string, entries map<string,string>, filters array<string>, length long, data binary", rows


def objects(files: DataFrame, passwords: list[str] = (), streams: bool = False, nums: list[int] | None = None) -> DataFrame:
    """Every object, or those of the given numbers: num, kind, value in PDF syntax, top-level entries of a dictionary, filters, and with ``streams`` the decoded bytes."""
    return _table(files, *object_part(streams, nums), list(passwords))


def edge_part(nums: list[int] | None = None) -> tuple[str, Callable]:
    """The part of ``edges`` for ``together``."""

    def rows(d: Document):
        def walk(v, key):
            if isinstance(v, Ref):
                yield key, v
            elif isinstance(v, (list, dict, Stream)):
                inner = v.info if isinstance(v, Stream) else v
                for k, x in inner.items() if isinstance(inner, dict) else enumerate(inner):
                    yield from walk(x, f"{key}/{k}" if key else str(k))

        for num in sorted(d.xref) if nums is None else [n for n in sorted(nums) if n in d.xref]:
            for key, r in walk(d.object(num), ""):
                yield {"from_num": num, "key": key, "to_num": r.num, "to_gen": r.gen}

    return "from_num long, key string, to_num long, to_gen long", rows


def edges(files: DataFrame, passwords: list[str] = (), nums: list[int] | None = None) -> DataFrame:
    """References between objects, all or those from the given numbers: from_num, key (top-level entry or position), to_num, to_gen."""
    return _table(files, *edge_part(nums), list(passwords))


def catalog(files: DataFrame, passwords: list[str] = ()) -> DataFrame:
    """The entries of each document's catalog in PDF syntax."""
    return _table(files, "entries map<string,string>", lambda d: iter([{"entries": [(k, show(v)) for k, v in d.root.items()]}]), list(passwords))


def names(files: DataFrame, passwords: list[str] = ()) -> DataFrame:
    """Every entry of the catalog's name trees, and of its dictionary of destinations: tree, name, value in PDF syntax."""

    def rows(d: Document):
        for tree, node in (d.get(d.root.get("Names")) or {}).items():
            for k, v in d.tree(node, "Names"):
                yield {"tree": tree, "name": text_string(d.get(k) or b""), "value": show(d.get(v))}
        for k, v in (d.get(d.root.get("Dests")) or {}).items():
            yield {"tree": "Dests", "name": k, "value": show(d.get(v))}

    return _table(files, "tree string, name string, value string", rows, list(passwords))


def page_contents(files: DataFrame, passwords: list[str] = ()) -> DataFrame:
    """page_no and the decoded content of every page."""
    return _table(files, "page_no int, content binary", lambda d: ({"page_no": i, "content": d.contents(p)} for i, p in enumerate(d.pages(), 1)), list(passwords))


def _box(d: Document, p: dict, key: str):
    v = d.inherited(p, key)
    return [float(d.get(x)) for x in v] if isinstance(v, list) and len(v) == 4 else None


def _page_rows(d: Document) -> Iterator[dict]:
    every = d.pages()
    labels = d.labels(len(every))
    for i, p in enumerate(every):
        media, n = _box(d, p, "MediaBox"), len(d.contents(p))
        yield {"page_no": i + 1, "num": p["num"], "label": labels[i], "media_box": media, "crop_box": _box(d, p, "CropBox") or media, "rotate": int(d.inherited(p, "Rotate") or 0), "is_empty": p["page"].get("Contents") is None, "content_bytes": n}


PAGES = ("page_no int, num long, label string, media_box array<float>, crop_box array<float>, rotate int, is_empty boolean, content_bytes long", _page_rows)


def pages(files: DataFrame, passwords: list[str] = ()) -> DataFrame:
    """page_no, num, label, media_box, crop_box (the media box by default), rotate, is_empty, content_bytes."""
    return _table(files, *PAGES, list(passwords))


def text_part(metrics: dict[str, dict] | None = None, handlers: dict[str, Callable] | None = None, encodings: dict[str, Callable] | None = None) -> tuple[str, Callable]:
    """The part of ``page_text`` for ``together``."""

    def rows(d: Document):
        for i, p in enumerate(d.pages(), 1):
            e = Evaluator(d, p, metrics, handlers, encodings)
            yield {"page_no": i, "text": paint(e.run(), e.profile)}

    return "page_no int, text string", rows


def page_text(files: DataFrame, passwords: list[str] = (), metrics: dict[str, dict] | None = None, handlers: dict[str, Callable] | None = None, encodings: dict[str, Callable] | None = None) -> DataFrame:
    """page_no and text of every page; a bad file gives one row with ``error``. ``handlers`` and ``encodings`` are for ``Evaluator``."""
    return _table(files, *text_part(metrics, handlers, encodings), list(passwords), True)


CORNERS = "lbx lby rbx rby rtx rty ltx lty".split()


def text_runs(files: DataFrame, passwords: list[str] = (), metrics: dict[str, dict] | None = None, handlers: dict[str, Callable] | None = None, encodings: dict[str, Callable] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The shown strings of every page with their boxes, in the order of the content; all columns, or the path and those named, which leaves the others in the worker."""

    def rows(d: Document):
        for i, p in enumerate(d.pages(), 1):
            for r in Evaluator(d, p, metrics, handlers, encodings).run():
                r["page_no"] = i
                yield r

    every = {"page_no": "int", "seq": "int", "text": "string", "fontname": "string", "fontflags": "long", "size": "float", **dict.fromkeys(CORNERS, "float")}
    return _table(files, ", ".join(f"{c} {every[c]}" for c in columns or every), rows, list(passwords))


def content_operators(files: DataFrame, passwords: list[str] = ()) -> DataFrame:
    """page_no, seq, depth, parent (seq of the operator that opens the group around it), op, operands (PDF syntax) of every page's content."""

    def rows(d: Document):
        for i, p in enumerate(d.pages(), 1):
            for seq, (op, args, depth, parent) in enumerate(grouped(d.contents(p))):
                yield {"page_no": i, "seq": seq, "depth": depth, "parent": parent, "op": op, "operands": [show(a) for a in args]}

    return _table(files, "page_no int, seq int, depth int, parent int, op string, operands array<string>", rows, list(passwords))


def fonts(files: DataFrame, passwords: list[str] = (), metrics: dict[str, dict] | None = None) -> DataFrame:
    """The fonts that each page can name, the nearest page node's first: resource, name, subtype, flags and what they say, widths, missing_width."""

    def rows(d: Document):
        for i, p in enumerate(d.pages(), 1):
            seen = {}
            for node in (p["page"], *p["above"]):
                group = d.get((d.get(node.get("Resources")) or {}).get("Font")) or {}
                for k, v in group.items():
                    seen.setdefault(k, v)
            for k, v in sorted(seen.items()):
                info = d.get(v)
                if isinstance(info, dict):
                    f = Font(d, info, metrics)
                    yield {"page_no": i, "resource": k, "name": f.name, "subtype": f.subtype, "flags": f.flags, "is_bold": f.flags & BOLD > 0, "is_italic": f.flags & ITALIC > 0, "is_fixed": f.flags & FIXED > 0, "is_all_cap": f.flags & ALL_CAP > 0, "is_small_cap": f.flags & SMALL_CAP > 0, "widths": sorted(f.widths.items()), "missing_width": f.missing}

    return _table(files, "page_no int, resource string, name string, subtype string, flags long, is_bold boolean, is_italic boolean, is_fixed boolean, is_all_cap boolean, is_small_cap boolean, widths map<int,float>, missing_width float", rows, list(passwords))


def _info_rows(d: Document) -> Iterator[dict]:
    for k, v in d.info().items():
        if isinstance(v, bytes):
            yield {"key": k, "text": text_string(v)}
        elif v is not None and not isinstance(v, (dict, list, Stream)):
            yield {"key": k, "text": str(v)}


INFO = ("key string, text string", _info_rows)


def info(files: DataFrame, passwords: list[str] = ()) -> DataFrame:
    """key, text, local, tz_minutes of the information dictionary; entries whose value cannot be read are left out."""
    out = _table(files, *INFO, list(passwords))
    local, ahead = date_columns(F.col("text"))
    dated = F.col("key").isin("CreationDate", "ModDate")
    return out.withColumn("local", F.when(dated, local)).withColumn("tz_minutes", F.when(dated, ahead)).where(~dated | F.col("local").isNotNull())


def page_labels(files: DataFrame, passwords: list[str] = ()) -> DataFrame:
    """The label ranges: start_index (from 0), style, prefix, start."""
    return _table(files, "start_index int, style string, prefix string, start int", lambda d: ({"start_index": a, "style": s, "prefix": p, "start": n} for a, s, p, n in d.label_ranges()), list(passwords))


def outlines(files: DataFrame, passwords: list[str] = ()) -> DataFrame:
    """Outline items in order: path of positions, title, count, destination, colour, flags, file of a remote target."""
    return _table(files, "path_ids array<int>, title string, count int, dest_page int, layout string, values array<float>, color array<float>, flags int, filepath string", lambda d: ({("path_ids" if k == "path" else k): v for k, v in o.items()} for o in d.outlines()), list(passwords))


def outline_children(items: DataFrame, path_ids: list[int]) -> DataFrame:
    """The items of an ``outlines`` table directly below the one at ``path_ids``, in order."""
    n = len(path_ids)
    below = F.slice("path_ids", 1, n) == F.array(*map(F.lit, path_ids)).cast("array<int>") if n else F.lit(True)
    return items.where((F.size("path_ids") == n + 1) & below).orderBy("path", F.col("path_ids")[n])


def attachments(files: DataFrame, passwords: list[str] = ()) -> DataFrame:
    """Embedded files (page_no null) and file annotations: name, content."""
    return _table(files, "page_no int, name string, content binary", lambda d: ({"page_no": p, "name": n, "content": c} for p, n, c in d.attachments()), list(passwords))


FORMATS = ("adbe.pkcs7.detached", "adbe.pkcs7.sha1", "ETSI.CAdES.detached")


def signatures(files: DataFrame, passwords: list[str] = (), trust_pem: str = "") -> DataFrame:
    """Signature fields: digests of their byte ranges, and whether they hold against the anchors of ``trust_pem``.

    ``passed`` needs an unchanged document, a fitting RSA signature and a chain to an anchor at the signing time (the
    attribute, else /M); otherwise ``error_message`` says why. ``certs`` are those of the signature.
    """

    def rows(d: Document):
        anchors = pem_certificates(trust_pem)
        for s in d.signatures():
            at, raw, cert = utc_date(s["signed_at"]), s.pop("signed"), s.pop("cert")
            got, why = {"certs": [], "verified_at": None}, None
            try:
                if s["subfilter"] == "adbe.x509.rsa_sha1":
                    got = check_pkcs1([cert] if isinstance(cert, bytes) else [d.get(c) for c in cert or []], s["contents"], raw, at, anchors)
                elif s["subfilter"] == "ETSI.RFC3161":
                    got = check_stamp(s["contents"], raw, anchors)
                elif s["subfilter"] in FORMATS:
                    got = check_cms(s["contents"], raw, at, anchors, s["subfilter"] == "adbe.pkcs7.sha1")
                else:
                    why = f"signature format {s['subfilter']} is not supported"
            except (ValueError, IndexError, StopIteration, TypeError) as e:
                why = str(e) or type(e).__name__
            yield s | got | {"passed": why is None, "error_message": why}

    cert = "array<struct<subject:string,issuer:string,cn:string,not_before:timestamp_ntz,not_after:timestamp_ntz,text:string>>"
    return _table(files, f"fqt string, page_no int, name string, signed_at string, subfilter string, byte_range array<long>, covers_file boolean, sha1 string, sha256 string, contents binary, passed boolean, error_message string, verified_at timestamp_ntz, certs {cert}", rows, list(passwords))


def certificates(signed: DataFrame) -> DataFrame:
    """The certificates of a ``signatures`` table, one row for each subject and issuer."""
    every = signed.select(F.explode("certs").alias("c")).select("c.*")
    return every.groupBy("subject", "issuer").agg(F.min(F.struct("not_before", "not_after", "text")).alias("m")).select("subject", "issuer", "m.*")


def write_pem(certs: DataFrame, path: str) -> None:
    """The texts of a ``certificates`` table as PEM files."""
    certs.select(F.regexp_replace("text", r"\n$", "")).write.mode("overwrite").text(path)


def write_texts(texts: DataFrame, path: str) -> None:
    """Page texts as Parquet with the name of their file, sorted by path and page within each part, so that one file's pages are read together."""
    name = F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1)
    texts.withColumn("file", name).sortWithinPartitions("path", "page_no").write.mode("overwrite").parquet(path)
