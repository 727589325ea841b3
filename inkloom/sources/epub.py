"""E-book archives: reading them into tables, and writing translated ones.

An archive is a file and is read or written by one task; the chapters inside are rows from then on.
"""

from __future__ import annotations

import hashlib
import io
import os
import posixpath
import struct
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.session import ship
from inkloom.sources import markup

#: Media types and namespaces of the format.
XHTML_TYPES = {"application/xhtml+xml", "text/html"}
NCX_TYPE = "application/x-dtbncx+xml"
DC = "{http://purl.org/dc/elements/1.1/}"
OPF = "{http://www.idpf.org/2007/opf}"
NCX = "{http://www.daisy.org/z3986/2005/ncx/}"
#: Name, id and title of the appendix.
GLOSSARY_FILE = "apendice-glossario.xhtml"
GLOSSARY_ID = "apendice-glossario"
GLOSSARY_TITLE = "Glossário"


class BookError(Exception):
    """A book that cannot be read: ``kind`` is not_epub, malformed or drm."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def resolve(base: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href)))


def xml(data: bytes, name: str) -> ET.Element:
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise BookError("malformed", f"{name}: {e}") from None


def open_archive(content: bytes) -> zipfile.ZipFile:
    if not content.startswith(b"PK\x03\x04"):
        raise BookError("not_epub", "no archive")
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise BookError("not_epub", str(e)) from None
    infos = z.infolist()
    if not infos or infos[0].filename != "mimetype" or infos[0].compress_type != zipfile.ZIP_STORED:
        raise BookError("malformed", "the first entry is no stored mimetype")
    if z.read("mimetype").strip() != b"application/epub+zip":
        raise BookError("malformed", "another mimetype")
    if "META-INF/encryption.xml" in z.namelist() or any(i.flag_bits & 1 for i in infos):
        raise BookError("drm", "encrypted")
    for i in infos:
        if i.flag_bits & 8 or span(i)[1] > len(content):
            raise BookError("malformed", f"{i.filename}: its range is not known")
    return z


def span(i: zipfile.ZipInfo) -> tuple[int, int]:
    """Byte range of an entry, as its header tells."""
    return i.header_offset, i.header_offset + 30 + len(i.filename.encode()) + len(i.extra) + i.compress_size


def read_book(content: bytes) -> dict:
    """Everything in a book that has a table; raises BookError."""
    z = open_archive(content)
    names = set(z.namelist())
    if "META-INF/container.xml" not in names:
        raise BookError("malformed", "no container.xml")
    roots = [e.get("full-path") for e in xml(z.read("META-INF/container.xml"), "container.xml").iter() if local(e.tag) == "rootfile"]
    if not roots or roots[0] not in names:
        raise BookError("malformed", "no package file")
    opf_path = roots[0]
    package = xml(z.read(opf_path), opf_path)
    manifest: dict[str, dict] = {}
    for pos, e in enumerate(x for x in package.iter() if local(x.tag) == "item"):
        manifest[e.get("id", "")] = {
            "pos": pos,
            "item_id": e.get("id", ""),
            "href": e.get("href", ""),
            "media_type": e.get("media-type", ""),
            "properties": e.get("properties", ""),
        }
    if any("encrypted" in m["properties"].split() for m in manifest.values()):
        raise BookError("drm", "an encrypted item")
    spine, chapters, seen = [], [], set()
    for e in (x for x in package.iter() if local(x.tag) == "itemref"):
        m = manifest.get(e.get("idref", ""))
        if m is None or m["media_type"] not in XHTML_TYPES:
            continue
        path = resolve(opf_path, m["href"])
        if path not in names:
            raise BookError("malformed", f"{path} is missing")
        spine.append({"pos": len(spine), "idref": m["item_id"], "path": path, "linear": e.get("linear") != "no"})
        if path not in seen:
            seen.add(path)
            chapters.append({"chapter_idx": len(chapters), "path": path, "html": z.read(path).decode("utf-8", "replace")})
    nav = ncx = None
    for m in manifest.values():
        path = resolve(opf_path, m["href"])
        if path in names and "nav" in m["properties"].split():
            nav = path
        if path in names and m["media_type"] == NCX_TYPE:
            ncx = path
    first = lambda name: next((e.text for e in package.iter() if e.tag == DC + name), None)
    modified = next((e.text for e in package.iter() if local(e.tag) == "meta" and e.get("property") == "dcterms:modified"), None)
    labels = markup.link_labels(z.read(nav).decode("utf-8", "replace")) if nav else ncx_labels(z.read(ncx)) if ncx else []
    entries = [
        {
            "pos": k,
            "name": i.filename,
            "method": i.compress_type,
            "flags": i.flag_bits,
            "start": span(i)[0],
            "stop": span(i)[1],
            "crc": i.CRC,
            "size": i.file_size,
        } for k, i in enumerate(z.infolist())
    ]
    return {
        "book_id": hashlib.sha256(content).hexdigest(),
        "opf_path": opf_path,
        "title": first("title") or "",
        "language": first("language"),
        "modified": modified or first("date"),
        "nav_path": nav,
        "ncx_path": ncx,
        "manifest": list(manifest.values()),
        "spine": spine,
        "chapters": chapters,
        "labels": labels,
        "entries": entries,
        "error_class": None,
        "message": None,
    }


def ncx_labels(data: bytes) -> list[str]:
    return [t.text or "" for t in ncx_texts(xml(data, "ncx"))]


ENTRY = pa.struct(
    [
        ("pos", pa.int32()),
        ("name", pa.string()),
        ("method", pa.int32()),
        ("flags", pa.int32()),
        ("start", pa.int64()),
        ("stop", pa.int64()),
        ("crc", pa.int64()),
        ("size", pa.int64()),
    ],
)
ITEM = pa.struct([("pos", pa.int32()), ("item_id", pa.string()), ("href", pa.string()), ("media_type", pa.string()), ("properties", pa.string())])
PLACE = pa.struct([("pos", pa.int32()), ("idref", pa.string()), ("path", pa.string()), ("linear", pa.bool_())])
CHAPTER = pa.struct([("chapter_idx", pa.int32()), ("path", pa.string()), ("html", pa.string())])
BOOK = pa.schema(
    [
        *[
            (k, pa.string()) for k in (
                "file",
                "book_id",
                "opf_path",
                "title",
                "language",
                "modified",
                "nav_path",
                "ncx_path",
                "error_class",
                "message",
            )
        ],
        ("manifest", pa.list_(ITEM)),
        ("spine", pa.list_(PLACE)),
        ("chapters", pa.list_(CHAPTER)),
        ("labels", pa.list_(pa.string())),
        ("entries", pa.list_(ENTRY)),
    ],
)
BOOK_DDL = """file string, book_id string, opf_path string, title string, language string, modified string, nav_path string, ncx_path string, error_class string, message string,
manifest array<struct<pos:int,item_id:string,href:string,media_type:string,properties:string>>, spine array<struct<pos:int,idref:string,path:string,linear:boolean>>,
chapters array<struct<chapter_idx:int,path:string,html:string>>, labels array<string>,
entries array<struct<pos:int,name:string,method:int,flags:int,start:bigint,stop:bigint,crc:bigint,size:bigint>>"""


def read_archives(files: DataFrame) -> DataFrame:
    """One row per archive of (path, content); unreadable ones carry an error class instead of failing the job."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    row = read_book(content or b"")
                except BookError as e:
                    row = dict.fromkeys(BOOK.names) | {
                        "book_id": hashlib.sha256(content or b"").hexdigest(),
                        "error_class": e.kind,
                        "message": str(e),
                    }
                yield pa.RecordBatch.from_pylist([row | {"file": path}], BOOK)

    return files.select("path", "content").mapInArrow(run, BOOK_DDL)


def read_epubs(spark: SparkSession, folder: str) -> DataFrame:
    return read_archives(
        spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]").option("recursiveFileLookup", "true").load(folder),
    )


SEGMENTS = "book_id string, chapter_idx int, path string, pos int, kind string, text string, protected boolean, saved map<int,string>"


def segment_chapters(chapters: DataFrame, policy: markup.Policy = markup.DEFAULT_POLICY) -> DataFrame:
    """(book_id, chapter_idx, path, html) to rows of blocks, numbered within their chapter."""
    ship(chapters.sparkSession)
    schema = pa.schema(
        [
            ("book_id", pa.string()),
            ("chapter_idx", pa.int32()),
            ("path", pa.string()),
            ("pos", pa.int32()),
            ("kind", pa.string()),
            ("text", pa.string()),
            ("protected", pa.bool_()),
            ("saved", pa.map_(pa.int32(), pa.string())),
        ],
    )

    def run(batches):
        for batch in batches:
            for book, idx, path, source in zip(*[batch.column(k).to_pylist() for k in ("book_id", "chapter_idx", "path", "html")]):
                rows = [
                    b | {
                        "book_id": book,
                        "chapter_idx": idx,
                        "path": path,
                        "saved": list(b["saved"].items()),
                    } for b in markup.segment(source or "", policy)
                ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return chapters.select("book_id", "chapter_idx", "path", "html").mapInArrow(run, SEGMENTS)


def book_chapters(books: DataFrame) -> DataFrame:
    return books.select("book_id", F.explode("chapters").alias("c")).select("book_id", "c.*")


def repaired(content: bytes) -> bytes:
    """A damaged archive built anew from what can be read of it: the mimetype first and stored, each name once (the last
    one counts, as for readers of archives), entries that cannot be read left out. Raises BookError where that does not
    give a book, or it is protected."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError) as e:
        raise BookError("not_epub", str(e)) from None
    kept: dict[str, tuple[zipfile.ZipInfo, bytes]] = {}
    for i in z.infolist():
        try:
            kept[i.filename] = i, z.read(i)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error, EOFError):
            if i.flag_bits & 1:
                raise BookError("drm", "encrypted") from None
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as out:
        head = zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0))
        out.writestr(head, "application/epub+zip", zipfile.ZIP_STORED)
        for name, (i, data) in kept.items():
            if name != "mimetype" and not name.endswith("/"):
                out.writestr(zipfile.ZipInfo(name, i.date_time), data, zipfile.ZIP_DEFLATED)
    read_book(buf.getvalue())
    return buf.getvalue()


# --- writing -----------------------------------------------------------------------------------------------------


def rewrite(content: bytes, changed: dict[str, bytes], added: dict[str, bytes] | None = None) -> bytes:
    """The archive with some entries replaced and others added; bytes of untouched entries are copied as they are."""
    z = zipfile.ZipFile(io.BytesIO(content))
    infos = z.infolist()
    if len({i.filename for i in infos}) != len(infos) or set(added or {}) & set(z.namelist()):
        raise BookError("malformed", "an entry's name is there twice")
    out, central = bytearray(), bytearray()
    spans = sorted((*span(i), k) for k, i in enumerate(infos))
    for (_, stop, _), (start, _, _) in zip(spans, spans[1:]):
        if stop != start:
            raise BookError("malformed", "a gap between entries")
    for start, stop, k in spans:
        i = infos[k]
        at = len(out)
        if i.filename not in changed:
            out += content[start:stop]
            central += directory_record(i, at, i.flag_bits, i.CRC, i.compress_size, i.file_size, i.extra)
        else:
            put(out, central, i, changed[i.filename])
    for name, data in (added or {}).items():
        i = zipfile.ZipInfo(name, infos[0].date_time)
        i.compress_type = zipfile.ZIP_DEFLATED
        put(out, central, i, data)
    n, at = len(infos) + len(added or {}), len(out)
    return bytes(out + central + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, n, n, len(central), at, len(z.comment)) + z.comment)


def put(out: bytearray, central: bytearray, i: zipfile.ZipInfo, data: bytes) -> None:
    """An entry with new content, stored or deflated as before."""
    if i.compress_type == zipfile.ZIP_STORED:
        body = data
    elif i.compress_type == zipfile.ZIP_DEFLATED:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
    else:
        raise BookError("malformed", f"{i.filename}: method {i.compress_type}")
    at, flags, crc, name = len(out), i.flag_bits & ~8, zlib.crc32(data), i.filename.encode()
    date, time = dos_stamp(i.date_time)
    out += struct.pack("<4s5H3L2H", b"PK\3\4", 20, flags, i.compress_type, time, date, crc, len(body), len(data), len(name), 0) + name + body
    central += directory_record(i, at, flags, crc, len(body), len(data), i.extra)


def dos_stamp(t: tuple) -> tuple[int, int]:
    return (t[0] - 1980) << 9 | t[1] << 5 | t[2], t[3] << 11 | t[4] << 5 | t[5] // 2


def directory_record(i: zipfile.ZipInfo, at: int, flags: int, crc: int, packed: int, size: int, extra: bytes) -> bytes:
    date, time = dos_stamp(i.date_time)
    name, note = i.filename.encode(), i.comment or b""
    head = struct.pack(
        "<4s4B4H3L5H2L",
        b"PK\1\2",
        i.create_version,
        i.create_system,
        i.extract_version,
        i.reserved,
        flags,
        i.compress_type,
        time,
        date,
        crc,
        packed,
        size,
        len(name),
        len(extra),
        len(note),
        0,
        i.internal_attr,
        i.external_attr,
        at,
    )
    return head + name + extra + note


def updated_package(data: bytes, language: str, title: str | None, stamp: str | None) -> bytes:
    """The package file with language, title and dates set."""
    for prefix, uri in (("dc", DC[1:-1]), ("", OPF[1:-1])):
        ET.register_namespace(prefix, uri)
    root = xml(data, "package")
    meta = next((e for e in root if local(e.tag) == "metadata"), None)
    if meta is None:
        raise BookError("malformed", "no metadata")

    def put_text(tag: str, text: str | None, **attrs):
        if text is None:
            return
        e = next((x for x in meta if x.tag == tag and all(x.get(k) == v for k, v in attrs.items())), None)
        if e is None:
            e = ET.SubElement(meta, tag, attrs)
        e.text = text

    put_text(DC + "language", language)
    put_text(DC + "title", title)
    put_text(DC + "date", stamp)
    put_text(OPF + "meta", stamp, property="dcterms:modified")
    return ET.tostring(root, "utf-8", xml_declaration=True)


def relabelled(source: str, labels: list[str]) -> str:
    """A navigation document with new link texts; another number of links is an error."""
    root = markup.parse(source)
    links = [n for n in root.walk() if n.tag == "a"]
    if len(links) != len(labels):
        raise ValueError(f"{len(links)} links, but {len(labels)} labels")
    for n, label in zip(links, labels):
        n.children = [markup.html.escape(label, quote=False)]
    return "".join(markup.outer(c) for c in root.children)


def ncx_texts(root: ET.Element) -> list[ET.Element]:
    """The elements that hold the labels of an NCX, in document order."""
    return [t for e in root.iter() if local(e.tag) == "navLabel" for t in e if local(t.tag) == "text"]


def ncx_relabelled(data: bytes, labels: list[str]) -> bytes:
    """An NCX with new labels, targets kept; another number of labels is an error."""
    ET.register_namespace("", NCX[1:-1])
    root = xml(data, "ncx")
    found = ncx_texts(root)
    if len(found) != len(labels):
        raise ValueError(f"{len(found)} labels, but {len(labels)} new ones")
    for e, label in zip(found, labels):
        e[:] = []
        e.text = label
    return ET.tostring(root, "utf-8", xml_declaration=True)


def new_contents(z: zipfile.ZipFile, book: dict, labels: list[str]) -> dict[str, bytes]:
    """Both tables of contents with new labels. The one the book's labels were read from must have as many; the other one
    is left as it is where it has another number."""
    out = {}
    if book["nav_path"]:
        out[book["nav_path"]] = relabelled(z.read(book["nav_path"]).decode("utf-8", "replace"), labels).encode()
    if book["ncx_path"]:
        data = z.read(book["ncx_path"])
        if not book["nav_path"] or len(ncx_labels(data)) == len(labels):
            out[book["ncx_path"]] = ncx_relabelled(data, labels)
    return out


def appendix(pairs: list[tuple[str, str]], title: str = GLOSSARY_TITLE) -> bytes:
    """A chapter that lists terms and their translations."""
    e = markup.html.escape
    rows = "".join(f"<dt>{e(a, quote=False)}</dt><dd>{e(b, quote=False)}</dd>" for a, b in pairs)
    head = f'<head><meta charset="utf-8"/><title>{e(title)}</title></head>'
    return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml">{head}<body><h1>{e(title)}</h1><dl>{rows}</dl></body></html>'.encode()


def with_chapter(data: bytes, item_id: str, href: str) -> bytes:
    """The package file with one more chapter at the end; an item of this id that is there already is an error."""
    root = xml(data, "package")
    parts = {local(e.tag): e for e in root}
    if "manifest" not in parts or "spine" not in parts:
        raise ValueError("no manifest or no spine")
    if any(e.get("id") == item_id for e in parts["manifest"]):
        raise ValueError(f"the item {item_id} is there already")
    ET.SubElement(parts["manifest"], OPF + "item", {"id": item_id, "href": href, "media-type": "application/xhtml+xml"})
    ET.SubElement(parts["spine"], OPF + "itemref", {"idref": item_id})
    return ET.tostring(root, "utf-8", xml_declaration=True)


def translated(
    content: bytes,
    texts: dict[str, list[str | None]],
    language: str,
    title: str | None = None,
    stamp: str | None = None,
    labels: list[str] | None = None,
    glossary: list[tuple[str, str]] | None = None,
) -> bytes:
    """The book with translated chapters (by path, a text or null for every block), metadata, labels and an appendix of
    its glossary. Chapters without any new text are copied byte by byte."""
    book = read_book(content)
    changed = {
        c["path"]: markup.render(c["html"], texts[c["path"]]).encode() for c in book["chapters"] if any(t is not None for t in texts.get(c["path"], ()))
    }
    z = zipfile.ZipFile(io.BytesIO(content))
    package = updated_package(z.read(book["opf_path"]), language, title, stamp)
    if labels is not None:
        changed |= new_contents(z, book, labels)
    added = {}
    if glossary:
        package = with_chapter(package, GLOSSARY_ID, GLOSSARY_FILE)
        added[posixpath.join(posixpath.dirname(book["opf_path"]), GLOSSARY_FILE)] = appendix(glossary)
    return rewrite(content, changed | {book["opf_path"]: package}, added)


def save_archives(files: DataFrame, folder: str, sources: str | None = None) -> DataFrame:
    """Writes the archives of (path, content) below ``folder``, a file each; gives (path, file, bytes).

    A file is written beside its place and renamed, so that a repeated task leaves a whole file. A file that is not
    this archive already, or that would be one of ``sources``, the folder of the originals, is never overwritten: that
    is an error."""
    ship(files.sparkSession)
    if sources is not None and os.path.realpath(folder) == os.path.realpath(sources):
        raise ValueError("the originals would be overwritten")
    os.makedirs(folder, exist_ok=True)

    def put_file(path: str, content: bytes) -> tuple[str, str, int]:
        place = os.path.join(folder, os.path.basename(path))
        if os.path.exists(place):
            with open(place, "rb") as f:
                if f.read() != content:
                    raise FileExistsError(place)
        else:
            part = f"{place}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(content)
            os.replace(part, place)
        return path, place, len(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [put_file(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["path", "file", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, file string, bytes long")


def new_archive(title: str, language: str, chapters: list[tuple[str, str]], ncx: list[str] | None = None) -> bytes:
    """A small valid book from (path below OEBPS, html) pairs, with an NCX of the given labels beside the navigation."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        stamp = (2020, 1, 1, 0, 0, 0)

        def add(name: str, data: str, method: int = zipfile.ZIP_DEFLATED):
            i = zipfile.ZipInfo(name, stamp)
            i.compress_type = method
            z.writestr(i, data)

        add("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        add(
            "META-INF/container.xml",
            '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        )
        items = "".join(f'<item id="c{k}" href="{p}" media-type="application/xhtml+xml"/>' for k, (p, _) in enumerate(chapters))
        refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
        e = markup.html.escape
        if ncx is not None:
            items += f'<item id="ncx" href="toc.ncx" media-type="{NCX_TYPE}"/>'
            points = "".join(
                f'<navPoint id="n{k}"><navLabel><text>{e(label, quote=False)}</text></navLabel><content src="{p}"/></navPoint>' for k, (label, (p, _)) in enumerate(zip(ncx, chapters))
            )
            add("OEBPS/toc.ncx", f'<?xml version="1.0"?><ncx xmlns="{NCX[1:-1]}" version="2005-1"><navMap>{points}</navMap></ncx>')
        add(
            "OEBPS/content.opf",
            f'<?xml version="1.0"?><package xmlns="{OPF[1:-1]}" version="3.0"><metadata xmlns:dc="{DC[1:-1]}"><dc:title>{e(title)}</dc:title><dc:language>{e(language)}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{refs}</spine></package>',
        )
        links = "".join(f'<li><a href="{p}">{k + 1}</a></li>' for k, (p, _) in enumerate(chapters))
        add("OEBPS/nav.xhtml", f"<html><body><nav><ol>{links}</ol></nav></body></html>")
        for p, source in chapters:
            add(f"OEBPS/{p}", source)
    return buf.getvalue()


def chapter_html(rows: list[tuple[str, str, bool]]) -> str:
    """A chapter from (kind, inner markup, protected) rows."""
    tags = {"titulo": "h1", "item_lista": "li", "citacao": "blockquote", "codigo": "pre"}
    body = "".join(f"<{t}>{text}</{t}>" for kind, text, _ in rows for t in [tags.get(kind, "p")])
    return f'<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html><head><title/></head><body>{body}</body></html>'


def archives_from_blocks(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """(path, content): an archive per book. Chapters are put together in parallel; only their markup meets in a book."""
    ship(blocks.sparkSession)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block_id", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("protected", F.lit(False)).alias("protected")))), lambda x: F.struct(x["kind"], x["text"], x["protected"]))
    chapters = blocks.groupBy("book_id", "chapter_idx").agg(parts.alias("rows"))

    def build(batches):
        for batch in batches:
            html_rows = [chapter_html([tuple(r.values()) for r in rows]) for rows in batch.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("book_id"), batch.column("chapter_idx"), pa.array(html_rows)],
                ["book_id", "chapter_idx", "html"],
            )

    sources = chapters.mapInArrow(build, "book_id string, chapter_idx int, html string")
    meta = books.where("book_id is not null").groupBy("book_id").agg(F.max("title").alias("title"), F.max("language").alias("language"))
    whole = sources.groupBy("book_id").agg(
        F.sort_array(F.collect_list(F.struct("chapter_idx", "html"))).alias("chapters"),
    ).join(meta, "book_id", "left")

    def pack(batches):
        for batch in batches:
            for book, chapters, title, lang in zip(*[batch.column(k).to_pylist() for k in ("book_id", "chapters", "title", "language")]):
                data = new_archive(title or "", lang or "und", [(f"text/ch{c['chapter_idx']:04d}.xhtml", c["html"]) for c in chapters])
                yield pa.RecordBatch.from_pylist([{"path": f"{book}.epub", "content": data}])

    return whole.mapInArrow(pack, "path string, content binary")
