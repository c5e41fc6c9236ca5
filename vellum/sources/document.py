"""One PDF file in memory: header, cross-reference data, objects, page tree and the document's dictionaries."""

from __future__ import annotations

import re

from ..functions.filters import UnsupportedFilter, decode
from ..functions.scalars import page_label, text_string
from .security import security_handler
from .syntax import END, Keyword, Name, Parser, Ref, Stream

OBJECT = re.compile(rb"(?<!\d)(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+obj")
HEAD = re.compile(rb"[\0\t\n\x0c\r ]*+(\d++)[\0\t\n\x0c\r ]++(\d++)[\0\t\n\x0c\r ]++obj(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
ROW = re.compile(rb"[\0\t\n\x0c\r ]*+(\d++)[\0\t\n\x0c\r ]++(\d++)[\0\t\n\x0c\r ]++([nf])(?=[\0\t\n\x0c\r ])")
END_STREAM = re.compile(rb"[\0\t\n\x0c\r ]*endstream")
MOST_NODES = 1_000_000


class BadFile(ValueError):
    pass


class Document:
    def __init__(self, data: bytes, passwords: list[str] = (), recipient: tuple | None = None):
        m = re.search(rb"%PDF-(\d)\.(\d)", data)
        if not m:
            raise BadFile("no PDF header")
        self.data, self.start, self.version = data, m.start(), f"{int(m[1])}.{int(m[2])}"
        self.xref: dict[int, tuple] = {}
        self.revisions: list[tuple[int, int, int, str, int]] = []
        self.trailer: dict = {}
        self.cache: dict[int, object] = {}
        self.members: dict[int, list] = {}
        self.fonts: dict[int, tuple] = {}
        self.named: dict[bytes, object] | None = None
        self.security = None
        self.repaired = False
        try:
            self._read_xref()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise BadFile("no catalog")
        except (BadFile, ValueError, IndexError, KeyError, TypeError):
            self._rebuild()
        if (e := self.trailer.get("Encrypt")) is not None:
            e = self._deep(e)
            ids = self.get(self.trailer.get("ID")) or [b""]
            self.cache.clear()
            self.members.clear()
            self.security = security_handler(e, ids[0], passwords, recipient)
            self.encrypt_ref = self.trailer["Encrypt"]
        self.root = self.get(self.trailer.get("Root"))
        if not isinstance(self.root, dict):
            raise BadFile("no catalog")

    # Cross-reference data: newest first, the first entry of an object wins.
    def _read_xref(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise BadFile("no startxref")
        todo, seen, rev = [Parser(self.data, at + 9).value()], set(), 0
        while todo:
            at = todo.pop(0)
            if not isinstance(at, int) or at in seen:
                continue
            seen.add(at)
            p = Parser(self.data, at + self.start)
            p.skip()
            info = self._table(p, rev) if self.data.startswith(b"xref", p.at) else self._stream_table(p, rev)
            for k, v in info.items():
                self.trailer.setdefault(k, v)
            todo = [x for x in (info.get("XRefStm"), info.get("Prev")) if x is not None] + todo
            rev += 1

    def _entry(self, num: int, gen: int, kind: str, where: int, extra: int, rev: int) -> None:
        self.revisions.append((num, gen, rev, kind, where))
        self.xref.setdefault(num, (kind, where, extra))

    def _table(self, p: Parser, rev: int) -> dict:
        p.at += 4
        while True:
            v = p.value()
            if isinstance(v, Keyword):
                if v != "trailer":
                    raise BadFile("xref table")
                return p.value()
            for num in range(v, v + p.value()):
                if m := ROW.match(p.data, p.at):
                    p.at = m.end()
                    where, gen, kind = int(m[1]), int(m[2]), "n" if m[3] == b"n" else "f"
                else:
                    where, gen, kind = p.value(), p.value(), p.value()
                if kind == "n":
                    self._entry(num, gen, "n", where + self.start, gen, rev)
                elif kind == "f":
                    self._entry(num, gen, "f", 0, gen, rev)

    def _stream_table(self, p: Parser, rev: int) -> dict:
        _, _, obj = self._object_at(p.at, False)
        if not isinstance(obj, Stream) or obj.info.get("Type") != "XRef":
            raise BadFile("xref stream")
        raw, widths = self.decoded(obj), [int(x) for x in obj.info["W"]]
        ranges = obj.info.get("Index") or [0, obj.info["Size"]]
        at = 0
        for first, count in zip(ranges[::2], ranges[1::2], strict=False):
            for num in range(first, first + count):
                parts = []
                for w in widths:
                    parts.append(int.from_bytes(raw[at : at + w], "big"))
                    at += w
                kind = parts[0] if widths[0] else 1
                if kind == 1:
                    self._entry(num, parts[2], "n", parts[1] + self.start, parts[2], rev)
                elif kind == 2:
                    self._entry(num, 0, "m", parts[1], parts[2], rev)
                else:
                    self._entry(num, parts[2], "f", 0, 0, rev)
        return obj.info

    def _rebuild(self) -> None:
        """A file whose cross-reference data is unusable: all objects are found by their headers, the last one wins."""
        self.repaired, self.xref = True, {}
        self.cache.clear()
        for m in OBJECT.finditer(self.data):
            self.xref[int(m[1])] = ("n", m.start(), int(m[2]))
        for m in re.finditer(rb"trailer", self.data):
            t = Parser(self.data, m.end()).value()
            if isinstance(t, dict):
                self.trailer |= t
        for num in list(self.xref):
            try:
                o = self.object(num)
            except (ValueError, IndexError, TypeError):
                continue
            if isinstance(o, Stream) and o.info.get("Type") == "ObjStm":
                for i, (k, _) in enumerate(self._members(num)):
                    self.xref.setdefault(k, ("m", num, i))
            if isinstance(o, Stream) and o.info.get("Type") == "XRef":
                self.trailer = {k: v for k, v in o.info.items() if k in ("Root", "Info", "ID", "Encrypt")} | self.trailer
            if isinstance(o, dict) and o.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(num, 0))
        if "Root" not in self.trailer:
            raise BadFile("no catalog")

    # Objects.
    def _object_at(self, at: int, decrypt: bool = True):
        p = Parser(self.data, at)
        if m := HEAD.match(self.data, at):
            p.at = m.end()
            num, gen, word = int(m[1]), int(m[2]), "obj"
        else:
            num, gen, word = p.value(), p.value(), p.value()
        if word != "obj" or not isinstance(num, int):
            raise BadFile(f"no object at byte {at}")
        value = p.value()
        if isinstance(value, dict):
            p.skip()
            if self.data.startswith(b"stream", p.at):
                body = p.at + 6
                body += 2 if self.data[body : body + 2] == b"\r\n" else 1 if self.data[body : body + 1] in (b"\n", b"\r") else 0
                n = self.get(value.get("Length"))
                if not isinstance(n, int) or n < 0 or not END_STREAM.match(self.data, body + n, body + n + 40):
                    stop = self.data.find(b"endstream", body)
                    stop = len(self.data) if stop < 0 else stop
                    n = len(self.data[body:stop].removesuffix(b"\n").removesuffix(b"\r"))
                value = Stream(value, self.data[body : body + n])
        if decrypt and self.security and not (isinstance(value, Stream) and value.info.get("Type") == "XRef") and Ref(num, gen) != self.encrypt_ref:
            value = self._decrypt(value, num, gen)
        return num, gen, value

    def _decrypt(self, v, num: int, gen: int):
        s = self.security
        if isinstance(v, bytes):
            return s.decrypt(v, num, gen, s.string_filter)
        if isinstance(v, list):
            return [self._decrypt(x, num, gen) for x in v]
        if isinstance(v, dict):
            signed = v.get("Type") in ("Sig", "DocTimeStamp") or "ByteRange" in v
            return {k: x if signed and k == "Contents" else self._decrypt(x, num, gen) for k, x in v.items()}
        if isinstance(v, Stream):
            name = s.file_filter if v.info.get("Type") == "EmbeddedFile" else s.stream_filter
            if v.info.get("Type") == "Metadata" and not s.meta:
                name = "Identity"
            filters, parms = self.filters(v)
            if "Crypt" in filters:
                name = str((parms[filters.index("Crypt")] or {}).get("Name", "Identity"))
            return Stream(self._decrypt(v.info, num, gen), s.decrypt(v.raw, num, gen, name))
        return v

    def object(self, num: int):
        """The object of a number; None for a missing or free one."""
        if num in self.cache:
            return self.cache[num]
        kind, where, extra = self.xref.get(num, ("f", 0, 0))
        self.cache[num] = None
        out = None
        if kind == "n":
            found, _, out = self._object_at(where)
            if found != num:
                out = None
        elif kind == "m":
            out = next((v for k, v in self._members(where) if k == num), None)
        self.cache[num] = out
        return out

    def _members(self, num: int) -> list:
        if num not in self.members:
            stream = self.object(num)
            self.members[num] = []
            if isinstance(stream, Stream):
                raw, first = self.decoded(stream), self.get(stream.info["First"])
                head = Parser(raw[:first], references=False)
                pairs = []
                for _ in range(self.get(stream.info["N"])):
                    k, at = head.value(), head.value()
                    if k is END or at is END:
                        break
                    pairs.append((k, Parser(raw, first + at).value()))
                self.members[num] = pairs
        return self.members[num]

    def get(self, v, depth: int = 0):
        """The value behind references."""
        while isinstance(v, Ref) and depth < 32:
            v, depth = self.object(v.num), depth + 1
        return None if isinstance(v, Ref) else v

    def _deep(self, v, depth: int = 0):
        """A value with all references in it replaced."""
        v = self.get(v)
        if depth < 8 and isinstance(v, dict):
            return {k: self._deep(x, depth + 1) for k, x in v.items()}
        return [self._deep(x, depth + 1) for x in v] if depth < 8 and isinstance(v, list) else v

    def filters(self, s: Stream) -> tuple[list[str], list[dict]]:
        names, parms = self.get(s.info.get("Filter", s.info.get("F") if "FFilter" not in s.info else None)), self.get(s.info.get("DecodeParms", s.info.get("DP")))
        names = [names] if isinstance(names, Name) else [self.get(x) for x in names] if isinstance(names, list) else []
        parms = [parms] if isinstance(parms, dict) else [self.get(x) for x in parms] if isinstance(parms, list) else []
        parms = [{k: self.get(v) for k, v in (p or {}).items()} for p in parms]
        return [str(n) for n in names], parms + [{}] * (len(names) - len(parms))

    def decoded(self, s: Stream) -> bytes:
        return decode(s.raw, *self.filters(s))

    # The document.
    def pages(self) -> list[dict]:
        """Leaves of the page tree in order: num, page, ancestors (nearest first). Cycles and null kids are passed over; over MOST_NODES nodes are an error."""
        out, seen = [], set()
        stack = [(self.root.get("Pages"), ())]
        while stack:
            if len(seen) > MOST_NODES:
                raise BadFile("the page tree is too large")
            ref, above = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            seen.add(ref if isinstance(ref, Ref) else id(node))
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                stack += [(k, (node, *above)) for k in reversed(kids)]
            else:
                out.append({"num": ref.num if isinstance(ref, Ref) else None, "page": node, "above": above})
        return out

    def inherited(self, page: dict, key: str):
        return next((v for n in (page["page"], *page["above"]) if (v := self.get(n.get(key))) is not None), None)

    def resource(self, page: dict, kind: str, name: str):
        """A named resource of the nearest page node that has it."""
        for n in (page["page"], *page["above"]):
            group = self.get((self.get(n.get("Resources")) or {}).get(kind))
            if isinstance(group, dict) and name in group:
                return self.get(group[name])
        return None

    def contents(self, page: dict) -> bytes:
        c = self.get(page["page"].get("Contents"))
        out = []
        for s in c if isinstance(c, list) else [c]:
            s = self.get(s)
            if isinstance(s, Stream):
                try:
                    out.append(self.decoded(s))
                except UnsupportedFilter:
                    continue
        return b"\n".join(out)

    def tree(self, node, leaf: str) -> list[tuple]:
        """The pairs of a number tree (leaf ``Nums``) or name tree (``Names``), in order. Cycles are passed over; over MOST_NODES nodes are an error."""
        out, stack, seen, n = [], [node], set(), 0
        while stack:
            ref, n = stack.pop(), n + 1
            if n > MOST_NODES:
                raise BadFile("a tree is too large")
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            v = self.get(ref)
            if isinstance(v, dict):
                own, kids = self.get(v.get(leaf)), self.get(v.get("Kids"))
                if isinstance(own, list):
                    out += list(zip(own[::2], own[1::2], strict=False))
                if isinstance(kids, list):
                    stack += reversed(kids)
        return out

    def info(self) -> dict[str, object]:
        found = self.get(self.trailer.get("Info"))
        return {k: self.get(v) for k, v in found.items()} if isinstance(found, dict) else {}

    def label_ranges(self) -> list[tuple[int, str | None, str, int]]:
        out = []
        for k, v in self.tree(self.root.get("PageLabels"), "Nums"):
            v = self.get(v)
            if isinstance(k, int) and isinstance(v, dict):
                out.append((k, v.get("S"), text_string(self.get(v.get("P")) or b""), int(self.get(v.get("St")) or 1)))
        return sorted(out, key=lambda r: r[0])

    def labels(self, count: int) -> list[str]:
        out, ranges = [], self.label_ranges()
        for i in range(count):
            r = next((r for r in reversed(ranges) if r[0] <= i), None)
            out.append(page_label(r[1], r[2], r[3] + i - r[0]) if r else str(i + 1))
        return out

    def destination(self, d, numbers: dict) -> dict:
        """A destination: page, layout, values; named ones are looked up in both places."""
        for _ in range(8):
            d = self.get(d)
            if isinstance(d, dict):
                d = d.get("D")
            elif isinstance(d, (Name, bytes)):
                old = self.get(self.root.get("Dests")) or {}
                key = str(d) if isinstance(d, Name) else d
                d = old.get(key if isinstance(key, str) else key.decode("latin-1"))
                if d is None:
                    if self.named is None:
                        self.named = {}
                        for k, v in self.tree((self.get(self.root.get("Names")) or {}).get("Dests"), "Names"):
                            self.named.setdefault(self.get(k), v)
                    d = self.named.get(key if isinstance(key, bytes) else key.encode())
            else:
                break
        if not isinstance(d, list) or not d:
            return {"dest_page": None, "layout": None, "values": []}
        page = numbers.get(d[0].num) if isinstance(d[0], Ref) else d[0] + 1 if isinstance(d[0], int) else None
        return {"dest_page": page, "layout": str(d[1]) if len(d) > 1 else "Fit", "values": [float(v) if isinstance(v, (int, float)) else 0.0 for v in map(self.get, d[2:])]}

    def outlines(self) -> list[dict]:
        numbers = {p["num"]: i for i, p in enumerate(self.pages(), 1)}
        out, seen = [], set()
        todo = [((self.get(self.root.get("Outlines")) or {}).get("First"), [], 1)]
        while todo:
            ref, above, k = todo.pop()
            if not isinstance(ref, Ref) or ref in seen:
                continue
            if len(out) >= MOST_NODES:
                raise BadFile("the outline is too large")
            seen.add(ref)
            item, path = self.get(ref) or {}, [*above, k]
            action = self.get(item.get("A")) or {}
            target = item.get("Dest") if item.get("Dest") is not None else action.get("D") if action.get("S") in ("GoTo", "GoToR") else None
            file = self.get(action.get("F")) if action.get("S") == "GoToR" else None
            file = self.get(file.get("UF", file.get("F"))) if isinstance(file, dict) else file
            color = self.get(item.get("C")) or [0, 0, 0]
            out.append({"path": path, "title": text_string(self.get(item.get("Title")) or b""), "count": int(self.get(item.get("Count")) or 0), **self.destination(target, numbers), "color": [float(c) for c in color], "flags": int(self.get(item.get("F")) or 0), "filepath": text_string(file) if isinstance(file, bytes) else None})
            todo += [(item.get("Next"), above, k + 1), (item.get("First"), path, 1)]
        return out

    def _file(self, spec) -> tuple[str, bytes] | None:
        spec = self.get(spec)
        if not isinstance(spec, dict):
            return None
        name = self.get(spec.get("UF", spec.get("F"))) or b""
        files = self.get(spec.get("EF")) or {}
        s = self.get(files.get("UF", files.get("F")))
        return (text_string(name), self.decoded(s)) if isinstance(s, Stream) else None

    def attachments(self) -> list[tuple[int | None, str, bytes]]:
        """Embedded files of the document (no page) and of file annotations (their page)."""
        names = (self.get(self.root.get("Names")) or {}).get("EmbeddedFiles")
        out = [(None, *f) for _, v in self.tree(names, "Names") if (f := self._file(v))]
        for i, p in enumerate(self.pages(), 1):
            for a in self.get(p["page"].get("Annots")) or []:
                a = self.get(a)
                if isinstance(a, dict) and a.get("Subtype") == "FileAttachment" and (f := self._file(a.get("FS"))):
                    out.append((i, *f))
        return out

    def tagged(self) -> str:
        mark = self.get(self.root.get("MarkInfo")) or {}
        return "suspect" if mark.get("Suspects", mark.get("Suspect")) else "tagged" if mark.get("Marked") else "none"

    def signatures(self) -> list[dict]:
        """Signature fields with inherited names and pages, and digests over their byte ranges."""
        import hashlib

        form = self.get(self.root.get("AcroForm")) or {}
        numbers = {p["num"]: i for i, p in enumerate(self.pages(), 1)}
        out, seen = [], set()

        todo = [(f, "", None, None) for f in reversed(self.get(form.get("Fields")) or [])]
        while todo:
            ref, name, page, kind = todo.pop()
            f = self.get(ref)
            if not isinstance(f, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            if len(seen) > MOST_NODES:
                raise BadFile("the form is too large")
            seen.add(ref if isinstance(ref, Ref) else id(f))
            own = text_string(self.get(f.get("T")) or b"")
            name = f"{name}.{own}" if name and own else name or own
            page, kind = f.get("P", page), f.get("FT", kind)
            v = self.get(f.get("V"))
            if kind == "Sig" and isinstance(v, dict):
                spans = self.get(v.get("ByteRange")) or []
                data = b"".join(self.byte_range(a, n) for a, n in zip(spans[::2], spans[1::2], strict=False))
                out.append({"fqt": name, "page_no": numbers.get(page.num) if isinstance(page, Ref) else None, "name": text_string(self.get(v.get("Name")) or b""), "signed_at": text_string(self.get(v.get("M")) or b""), "subfilter": v.get("SubFilter"), "byte_range": spans, "covers_file": bool(spans) and spans[0] == 0 and spans[-2] + spans[-1] == len(self.data), "sha1": hashlib.sha1(data).hexdigest(), "sha256": hashlib.sha256(data).hexdigest(), "contents": self.get(v.get("Contents")) or b"", "signed": data, "cert": self.get(v.get("Cert"))})
            todo += [(k, name, page, kind) for k in reversed(self.get(f.get("Kids")) or [])]
        return out

    def byte_range(self, start: int, length: int) -> bytes:
        """Bytes of the file as it lies there, counted from its beginning."""
        return self.data[max(0, start) : max(0, start) + max(0, length)]
