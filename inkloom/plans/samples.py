"""What the queries over archives and runs need beside the tables: damaged archives, translators that fail as told."""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators.run import Context, Definitive, Prefix
from inkloom.session import ship
from inkloom.sources import epub

#: What the refusing translator does not take.
REFUSED = "(refused)"


@dataclass(frozen=True)
class Refusing(Prefix):
    """Refuses batches with a marked text."""

    def translate(self, texts: list[str], context: Context) -> list[str]:
        if any(t.endswith(REFUSED) for t in texts):
            raise Definitive("refused")
        return super().translate(texts, context)


def marked(blocks: DataFrame, which: Column) -> DataFrame:
    """Blocks of which some translatable ones are refused; they have as many words as before."""
    text = F.col("text")
    return blocks.withColumn("text", F.when(which & T.translatable(text, F.col("protected")), F.concat(text, F.lit(REFUSED))).otherwise(text))


@dataclass(frozen=True)
class Lexicon(Prefix):
    """Answers to the passes before a run: two entries of a glossary, a style."""

    def translate(self, texts: list[str], context: Context) -> list[str]:
        if context.task == "glossary":
            return [f"lamp -> L{len(t)}\n\n-> none\nkey: chave" for t in texts]
        if context.task == "priming":
            return [f"  Plain. \n\n Of {len(t)} characters.\n" for t in texts]
        return super().translate(texts, context)


def number(path: str) -> int:
    return int(re.search(r"(\d+)\.epub$", path).group(1))


def rebuilt(content: bytes, change: dict[str, bytes | None], last: str | None = None) -> bytes:
    """An archive with entries changed, left out (null) or put last."""
    z, buf = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
    names = [n for n in z.namelist() if n != last] + ([last] if last else [])
    with zipfile.ZipFile(buf, "w") as out:
        for n in [*names, *(n for n in change if n not in names)]:
            data = change.get(n, z.read(n) if n in names else None) if n in change else z.read(n)
            if data is not None:
                out.writestr(zipfile.ZipInfo(n, (2020, 1, 1, 0, 0, 0)), data)
    return buf.getvalue()


def damage(content: bytes, case: int) -> bytes:
    package = zipfile.ZipFile(io.BytesIO(content)).read("OEBPS/content.opf")
    chapter = next(n for n in zipfile.ZipFile(io.BytesIO(content)).namelist() if n.endswith(".xhtml") and "nav" not in n)
    again = package.replace(b"</spine>", b'<itemref idref="c0"/></spine>')
    unknown = package.replace(b"</spine>", b'<itemref idref="nobody"/></spine>')
    return {
        1: lambda: content[:3], 2: lambda: rebuilt(content, {"mimetype": b"text/plain"}), 3: lambda: rebuilt(content, {}, last="mimetype"),
        4: lambda: rebuilt(content, {"META-INF/container.xml": None}), 5: lambda: rebuilt(content, {"META-INF/encryption.xml": b"<x/>"}),
        6: lambda: rebuilt(content, {"OEBPS/content.opf": again}), 7: lambda: rebuilt(content, {chapter: None}), 8: lambda: rebuilt(content, {"OEBPS/content.opf": unknown}),
    }.get(case, lambda: content)()


def damaged(files: DataFrame) -> DataFrame:
    """(path, content), each archive damaged in the way its number says."""
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                yield pa.RecordBatch.from_pylist([{"path": path, "content": damage(content, number(path) % 9)}])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")


def mended(files: DataFrame) -> DataFrame:
    """(book_id, mended): whether an archive can be rebuilt into a book."""
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    epub.repaired(content)
                    ok = "META-INF/encryption.xml" not in zipfile.ZipFile(io.BytesIO(content)).namelist()
                except epub.BookError:
                    ok = False
                yield pa.RecordBatch.from_pylist([{"book_id": path.removesuffix(".epub"), "mended": ok}])

    return files.select("path", "content").mapInArrow(run, "book_id string, mended boolean")


def relabelled(files: DataFrame) -> DataFrame:
    """Archives with a second table of contents (short of a label in every other one), given new labels, metadata and an
    appendix, and read again."""
    ship(files.sparkSession)
    schema = (
        "book_id string, chapters long, labels string, second_changed boolean, appendix string, term string, translation string,"
        " title string, language string, modified string"
    )

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                old, name = epub.read_book(content), path.removesuffix(".epub")
                chapters = [(c["path"].removeprefix("OEBPS/"), c["html"]) for c in old["chapters"]]
                short = number(path) % 2
                book = epub.new_archive(old["title"], "de", chapters, ["Old"] * (len(chapters) - short))
                labels = [f"Label {k + 1}" for k in range(len(chapters))]
                done = epub.translated(book, {}, "pt", f"Title of {name}", "2024-05-06T07:08:09Z", labels, [("lamp", "lâmpada")])
                got = epub.read_book(done)
                second = epub.ncx_labels(zipfile.ZipFile(io.BytesIO(done)).read(got["ncx_path"]))
                added = [b["text"] for b in epub.markup.segment(got["chapters"][-1]["html"])]
                row = {
                    "book_id": name,
                    "chapters": len(got["chapters"]),
                    "labels": "|".join(got["labels"]),
                    "second_changed": second == labels,
                    "appendix": added[0],
                    "term": added[1],
                    "translation": added[2],
                    "title": got["title"],
                    "language": got["language"],
                    "modified": got["modified"],
                }
                yield pa.RecordBatch.from_pylist([row])

    return files.select("path", "content").mapInArrow(run, schema)
