"""Documents in containers: one block walker for three XML dialects, and a tokenizer for RTF.

These formats are opaque to Catalyst: bytes come from binaryFile, an Arrow stage turns each file into rows of blocks,
and all that follows (sections, chunks, ids) is built of columns again. A file that breaks a rule yields no block but
a state and a reason, never an exception.
"""

from __future__ import annotations

import io
import posixpath
import re
import sys
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ..functions.vocabulary import MAX_BLOCK_CHARS

cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])


class Refused(Exception):
    """state and reason of a file that isn't extracted."""

    def __init__(self, state: str, reason: str):
        super().__init__(reason)
        self.state, self.reason = state, reason


DENIED, BROKEN, OUTSIDE = ("denied", "ineligible_source"), ("unavailable", "dependency_unavailable"), ("denied", "ineligible_source")


def local(tag) -> str:
    """A tag's name without its namespace; comments and instructions have none."""
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def attribute(element, name: str):
    return next((v for k, v in element.attrib.items() if local(k) == name), None)


@dataclass(frozen=True)
class Dialect:
    """How a format names what the walker looks for."""

    paragraphs: frozenset
    headings: Callable  #: element -> level, or None for a paragraph; only asked for heading and paragraph tags
    heading_tags: frozenset = frozenset()
    lists: frozenset = frozenset()
    items: frozenset = frozenset()
    tables: frozenset = frozenset()
    row_groups: frozenset = frozenset()
    rows: frozenset = frozenset()
    cells: frozenset = frozenset()
    containers: frozenset = frozenset()
    breaks: dict = field(default_factory=dict)  #: tag -> text it stands for
    leaf_text: frozenset = frozenset()  #: only these tags hold text, if any are named
    denied: frozenset = frozenset()
    squeeze: bool = True
    kind_of: Callable = lambda e: "paragraph"
    cell_blocks: bool = True  #: a cell's text is its paragraphs', else all of its text
    strict: bool = True  #: text in an unknown element is an error


def text_of(element, d: Dialect) -> str:
    out: list[str] = []

    def gather(e, top: bool) -> None:
        name = local(e.tag)
        if not top and name in d.breaks:
            n = attribute(e, "c")
            out.append(d.breaks[name] * (int(n) if n and n.isdigit() else 1))
        else:
            if e.text and name and (not d.leaf_text or name in d.leaf_text):
                out.append(e.text)
            for child in e:
                gather(child, False)
        if not top and e.tail and not d.leaf_text:
            out.append(e.tail)

    gather(element, True)
    joined = "".join(out)
    return " ".join(joined.replace("\u00a0", " ").split()) if d.squeeze else joined.strip()


def walk(container, d: Dialect) -> Iterator[tuple[str, str, int | None]]:
    """(kind, text, level) of a container's blocks in order; nested lists and tables are refused."""
    nested = d.lists | d.tables
    for e in container:
        name = local(e.tag)
        if not name:
            continue
        if name in d.containers:
            if any(local(c.tag) in d.containers | d.heading_tags | d.paragraphs | nested for c in e):
                yield from walk(e, d)
            elif text := text_of(e, d):
                yield "paragraph", text, None
        elif name in d.heading_tags | d.paragraphs:
            if text := text_of(e, d):
                level = d.headings(e)
                yield ("heading", text, level) if level else (d.kind_of(e), text, None)
        elif name in d.lists:
            for item in (x for x in e if local(x.tag) in d.items):
                if any(local(x.tag) in nested for x in item.iter() if x is not item):
                    raise Refused(*OUTSIDE)
                inner = [text_of(x, d) for x in item if local(x.tag) in d.paragraphs] if d.cell_blocks else [text_of(item, d)]
                if text := "\n".join(x for x in inner if x).strip():
                    yield "list", text, None
        elif name in d.tables:
            if text := table_text(e, d):
                yield "table", text, None
        elif d.strict and text_of(e, d):
            raise Refused(*OUTSIDE)


def table_text(table, d: Dialect) -> str:
    """Rows on lines, cells between bars, a cell's paragraphs between slashes."""
    rows = [r for c in table for r in ([c] if local(c.tag) in d.rows else c if local(c.tag) in d.row_groups else ()) if local(r.tag) in d.rows]
    out = []
    for row in rows:
        cells = []
        for cell in (c for c in row if local(c.tag) in d.cells):
            if any(local(x.tag) in d.tables | d.lists for x in cell.iter() if x is not cell):
                raise Refused(*OUTSIDE)
            inner = [text_of(x, d) for x in cell if local(x.tag) in d.paragraphs | d.heading_tags] if d.cell_blocks else [text_of(cell, d)]
            cells.append(" / ".join(x for x in inner if x).strip())
        if line := " | ".join(cells).strip():
            out.append(line)
    return "\n".join(out).strip()


def _style_level(e) -> int | None:
    style = _style(e)
    m = re.fullmatch("heading([1-8])", style)
    return int(m[1]) if m else None


def _style(e) -> str:
    found = next((x for p in e if local(p.tag) == "pPr" for x in p if local(x.tag) == "pStyle"), None)
    return (attribute(found, "val") or "").replace(" ", "").lower() if found is not None else ""


def _listed(e) -> str:
    numbered = any(local(x.tag) == "numPr" for p in e if local(p.tag) == "pPr" for x in p)
    return "list" if numbered or _style(e).startswith("list") else "paragraph"


def _outline(e) -> int | None:
    level = attribute(e, "outline-level") if local(e.tag) == "h" else None
    return int(level) if level and re.fullmatch("[1-8]", level) else None


# Tag names of the three formats (fixed values).
DOCX = Dialect(paragraphs=frozenset(["p"]), headings=_style_level, tables=frozenset(["tbl"]), rows=frozenset(["tr"]), cells=frozenset(["tc"]), breaks={"tab": "\t", "br": "\n", "cr": "\n"}, leaf_text=frozenset(["t"]), denied=frozenset("ins del moveFrom moveTo commentRangeStart commentRangeEnd commentReference".split()), squeeze=False, kind_of=_listed, strict=False)
ODT = Dialect(paragraphs=frozenset(["p"]), headings=_outline, heading_tags=frozenset(["h"]), lists=frozenset(["list"]), items=frozenset(["list-item"]), tables=frozenset(["table"]), rows=frozenset(["table-row"]), cells=frozenset(["table-cell", "covered-table-cell"]), containers=frozenset(["section"]), breaks={"s": " ", "tab": "\t", "line-break": "\n"}, denied=frozenset("annotation tracked-changes change change-start change-end object object-ole image plugin applet frame".split()))
EPUB = Dialect(paragraphs=frozenset(["p"]), headings=lambda e: int(local(e.tag)[1]) if re.fullmatch("h[1-6]", local(e.tag)) else None, heading_tags=frozenset(["h1", "h2", "h3", "h4", "h5", "h6"]), lists=frozenset(["ol", "ul"]), items=frozenset(["li"]), tables=frozenset(["table"]), row_groups=frozenset(["tbody", "tfoot", "thead"]), rows=frozenset(["tr"]), cells=frozenset(["td", "th"]), containers=frozenset("article aside body div footer header main section".split()), breaks={"br": "\n"}, denied=frozenset("audio button canvas embed form iframe img input math nav object picture script select source svg textarea video".split()), cell_blocks=False)


def parsed(archive: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(archive.read(name))
    except (KeyError, ElementTree.ParseError):
        raise Refused(*BROKEN) from None


def first(root, name: str):
    found = next((e for e in root.iter() if local(e.tag) == name), None)
    if found is None:
        raise Refused(*BROKEN)
    return found


def refuse_denied(root, d: Dialect) -> None:
    if any(local(e.tag) in d.denied for e in root.iter()):
        raise Refused(*DENIED)


def docx(content: bytes) -> list[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = parsed(z, "word/document.xml")
        refuse_denied(root, DOCX)
        if "word/comments.xml" in z.namelist() and any(local(e.tag) == "comment" for e in parsed(z, "word/comments.xml").iter()):
            raise Refused(*DENIED)
        return list(walk(first(root, "body"), DOCX))


def odt(content: bytes) -> list[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "mimetype" in z.namelist() and z.read("mimetype").strip() not in (b"", b"application/vnd.oasis.opendocument.text"):
            raise Refused(*DENIED)
        root = parsed(z, "content.xml")
        refuse_denied(root, ODT)
        return list(walk(first(first(root, "body"), "text"), ODT))


def member(base: str, href: str) -> str:
    """An archive path, resolved against its package's folder; what leaves the archive is refused."""
    raw = re.split("[#?]", href, maxsplit=1)[0].strip()
    path = posixpath.normpath(posixpath.join(base, raw))
    if not raw or raw.startswith("/") or path == "." or path.startswith("../") or path == "..":
        raise Refused(*BROKEN)
    return path


def epub(content: bytes) -> list[tuple]:
    """JOIN-18: the spine's members in order, each found in the manifest by its id."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "mimetype" not in names:
            raise Refused(*BROKEN)
        if z.read("mimetype").strip() != b"application/epub+zip":
            raise Refused(*DENIED)
        roots = [e for e in parsed(z, "META-INF/container.xml").iter() if local(e.tag) == "rootfile" and attribute(e, "media-type") in (None, "application/oebps-package+xml")]
        if len(roots) != 1:
            raise Refused(*BROKEN)
        package = member("", attribute(roots[0], "full-path") or "")
        root = parsed(z, package)
        items: dict[str, tuple] = {}
        for e in (x for x in first(root, "manifest") if local(x.tag) == "item"):
            key, href, media = (attribute(e, k) for k in ("id", "href", "media-type"))
            if not (key and href and media) or key in items:
                raise Refused(*BROKEN)
            items[key] = (member(posixpath.dirname(package), href), media, (attribute(e, "properties") or "").split())
        out: list[tuple] = []
        refs = [x for x in first(root, "spine") if local(x.tag) == "itemref"]
        linear = [x for x in refs if (attribute(x, "linear") or "yes").strip().lower() != "no"]
        if not linear or any((attribute(x, "linear") or "yes").strip().lower() != "yes" or attribute(x, "idref") not in items for x in linear):
            raise Refused(*BROKEN)
        for path, media, properties in (items[attribute(x, "idref")] for x in linear):
            if "nav" in properties or media != "application/xhtml+xml":
                raise Refused(*DENIED)
            page = parsed(z, path)
            refuse_denied(page, EPUB)
            for e in page.iter():
                if any(local(k).lower().startswith("on") or (local(k).lower() in ("href", "src") and v.strip().lower().startswith("javascript:")) for k, v in e.attrib.items()):
                    raise Refused(*DENIED)
            out += walk(first(page, "body"), EPUB)
        return out


# Destinations of RTF groups: those that refuse the file, and those whose text is left out (fixed values).
RTF_DENIED = frozenset("annotation comment atnid atnauthor pict object objdata field fldinst fldrslt footnote endnote header footer shp sp".split())
RTF_SKIPPED = frozenset("fonttbl colortbl stylesheet info generator filetbl listtable listoverridetable revtbl rsidtbl".split())
_RTF_TOKEN = re.compile(r"\\(?:'(?P<hex>[0-9a-fA-F]{2})|(?P<word>[A-Za-z]+)(?P<number>[+-]?\d+)? ?|(?P<sign>.))|(?P<brace>[{}])|(?P<text>[^\\{}]+)", re.DOTALL)


def rtf(content: bytes) -> list[tuple]:
    """Paragraphs of an RTF text: tokens drive a stack of groups that are shown or skipped."""
    source = content.decode("latin-1")
    if not source.lstrip().startswith("{\\rtf"):
        raise Refused(*BROKEN)
    out: list[tuple] = []
    now: list[str] = []
    shown, opening, starred, drop = [True], False, False, 0

    def close() -> None:
        if text := " ".join("".join(now).replace("\u00a0", " ").split()):
            out.append(("paragraph", text, None))
        now.clear()

    for m in _RTF_TOKEN.finditer(source):
        if m["brace"] == "{":
            shown.append(shown[-1])
            opening, starred, drop = True, False, 0
            continue
        if m["brace"]:
            if len(shown) == 1:
                raise Refused(*BROKEN)
            shown.pop()
            starred, drop = False, 0
            continue
        if m["word"]:
            word, drop = m["word"], 0
            if starred or (opening and word in RTF_DENIED | RTF_SKIPPED):
                if word in RTF_DENIED:
                    raise Refused(*DENIED)
                shown[-1] = shown[-1] and word not in RTF_SKIPPED
            elif shown[-1]:
                if word in ("par", "sect", "page"):
                    close()
                elif word in ("line", "tab"):
                    now.append("\n" if word == "line" else "\t")
                elif word == "u":
                    if m["number"] is None:
                        raise Refused(*BROKEN)
                    now.append(chr(int(m["number"]) % 65536))
                    drop = 1
            opening = starred = False
            continue
        if m["sign"] == "*":
            starred = True
            continue
        if m["sign"] == "'":
            raise Refused(*BROKEN)
        text = bytes.fromhex(m["hex"]).decode("cp1252", "replace") if m["hex"] else {"~": " ", "_": "-"}.get(m["sign"], m["sign"] if m["sign"] in "{}\\" else "") if m["sign"] else re.sub("[\r\n]", "", m["text"])
        if drop:  # one fallback character stands behind a \u
            text, drop = text[1:], 0
        if shown[-1]:
            now.append(text)
        opening = opening and not (m["hex"] or m["sign"] or (m["text"] or "").strip())
    if len(shown) != 1:
        raise Refused(*BROKEN)
    close()
    return out


READERS: dict[str, Callable[[bytes], list[tuple]]] = {"docx_text": docx, "odt_text": odt, "epub_text": epub, "rtf_text": rtf}


def read_container(lane: str, content: bytes | None, readers: dict | None = None) -> tuple[list[tuple], str, str | None]:
    """Blocks, state and reason of one file."""
    try:
        if content is None:
            raise Refused(*BROKEN)
        found = (readers or READERS)[lane](content)
        if any(len(text) > MAX_BLOCK_CHARS for _, text, _ in found):
            raise Refused(*OUTSIDE)
        return (found, "ready", None) if found else ([], "denied", "unsupported_source_type")
    except Refused as e:
        return [], e.state, e.reason
    except (zipfile.BadZipFile, KeyError, ValueError, OSError, EOFError):
        return [], *BROKEN


def container_blocks(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """SRC-04..07, UDF-03, UDF-04, UDF-31, PRED-22, STR-38: files (path, lane, content) as (path, lane, state, reason, blocks).

    blocks: array<struct<pos, kind, text, level>>, as operators.extraction makes them. readers: further lanes' readers,
    such as an injected PDF extractor; a lane without a reader is unavailable.
    """
    known = READERS | (readers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_container(lane, content, known) for lane, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            blocks = [[{"pos": k, "kind": x[0], "text": x[1], "level": x[2]} for k, x in enumerate(r[0])] for r in rows]
            kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("level", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.string()), pa.array(blocks, kind)], ["path", "lane", "state", "reason", "blocks"])

    return files.select("path", "lane", "content").mapInArrow(run, "path string, lane string, state string, reason string, blocks array<struct<pos:int,kind:string,text:string,level:int>>")
