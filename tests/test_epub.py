from __future__ import annotations

import io
import zipfile

import pytest

from inkloom.plans import samples
from inkloom.sources import epub, markup

#: A chapter of our own: a heading, markup, protected parts inline and as blocks, lists and a table.
CHAPTER = """<?xml version="1.0" encoding="utf-8"?>
<!DOCTYPE html>
<html><head><title>x</title></head><body><h2>The <em>Gull</em></h2><p>Set <code>sail = 2</code> before <code>wind</code>, or <code>sail = 2</code>.</p>
<ul><li>rope<li>tar</ul>stray text<pre class="log">a &lt;b&gt; <i>c</i>\n d</pre><table><tr><td>1<td>2</table><p>&nbsp;</p></body></html>"""


def book(**change):
    return samples.rebuilt(epub.new_archive("Gulls", "en", [("1.xhtml", CHAPTER), ("2.xhtml", "<p>End</p>")], ["One", "Two"]), change)


def test_segments():
    got = [(b["kind"], b["protected"], b["text"]) for b in markup.segment(CHAPTER)]
    assert got == [
        ("titulo", False, "The <em>Gull</em>"), ("paragrafo", False, "Set {{0}} before {{1}}, or {{0}}."), ("item_lista", False, "rope"), ("item_lista", False, "tar"),
        ("codigo", True, "a &lt;b&gt; <i>c</i>\n d"), ("celula_tabela", False, "1"), ("celula_tabela", False, "2"), ("paragrafo", False, "&nbsp;"),
    ]
    assert markup.chapter_title(CHAPTER) == "The Gull" and markup.chapter_title("<p>x</p>") == "" and markup.segment("") == []
    assert [b["text"] for b in markup.segment("<p>x<!-- y -->z<p>w")] == ["x<!-- y -->z", "w"]


def test_policy_with_attributes():
    policy = {"span": {"class": "math"}, "pre": {}}
    text = '<p>a <span class="math">b</span> <span>c</span> <code>d</code></p><pre>e</pre>'
    got = markup.segment(text, policy)
    assert [(b["text"], b["protected"]) for b in got] == [("a {{0}} <span>c</span> <code>d</code>", False), ("e", True)]


def test_rendering_is_strict():
    texts = ["A Gaivota", "Antes de {{1}}: {{0}}.", None, " ", "lost", "um", None, None]
    out = markup.render(CHAPTER, texts)
    assert "<h2>A Gaivota</h2>" in out and "<p>Antes de <code>wind</code>: <code>sail = 2</code>.</p>" in out and out.startswith("<?xml")
    assert "<li>rope</li><li>tar</li>" in out and "stray text" in out and "a &lt;b&gt; <i>c</i>" in out and "<td>um</td>" in out
    for wrong in (texts[:-1], [*texts, None], []):
        with pytest.raises(ValueError):
            markup.render(CHAPTER, wrong)
    assert [b["text"] for b in markup.segment(markup.render(CHAPTER, [None] * 8))] == [b["text"] for b in markup.segment(CHAPTER)]


@pytest.mark.parametrize(
    ("content", "kind"),
    [
        (b"", "not_epub"), (b"PK\x03\x04 and no more", "not_epub"), (book(mimetype=b"text/html"), "malformed"), (samples.damage(book(), 3), "malformed"),
        (book(**{"META-INF/container.xml": None}), "malformed"), (book(**{"META-INF/container.xml": b"<container/>"}), "malformed"), (book(**{"OEBPS/content.opf": b"<package>"}), "malformed"),
        (book(**{"OEBPS/2.xhtml": None}), "malformed"), (book(**{"META-INF/encryption.xml": b"<e/>"}), "drm"),
    ],
)
def test_bad_books(content, kind):
    with pytest.raises(epub.BookError) as e:
        epub.read_book(content)
    assert e.value.kind == kind


def test_encrypted_and_open_ended_entries():
    for flag, kind in ((1, "drm"), (8, "malformed")):
        data = bytearray(book())
        at = data.rindex(b"PK\x01\x02")
        data[at + 8] |= flag
        with pytest.raises(epub.BookError) as e:
            epub.read_book(bytes(data))
        assert e.value.kind == kind


def test_book_without_metadata():
    package = zipfile.ZipFile(io.BytesIO(book())).read("OEBPS/content.opf")
    bare = package[: package.index(b"<dc:title>")] + package[package.index(b"</metadata>") :]
    got = epub.read_book(book(**{"OEBPS/content.opf": bare}))
    assert got["title"] == "" and got["language"] is None and [c["path"] for c in got["chapters"]] == ["OEBPS/1.xhtml", "OEBPS/2.xhtml"]


def test_rebuilding():
    assert len(epub.read_book(epub.repaired(samples.damage(book(), 3)))["chapters"]) == 2
    assert epub.read_book(epub.repaired(book(mimetype=b"x")))["title"] == "Gulls"
    for content in (b"x", book(**{"META-INF/container.xml": None})):
        with pytest.raises(epub.BookError):
            epub.repaired(content)


def test_rewriting_touches_only_what_changes():
    a = book()
    assert epub.rewrite(a, {}) == a
    b = epub.rewrite(a, {"OEBPS/2.xhtml": b"<p>new</p>"}, {"OEBPS/3.xhtml": b"x"})
    z = zipfile.ZipFile(io.BytesIO(b))
    assert z.testzip() is None and z.read("OEBPS/2.xhtml") == b"<p>new</p>" and z.read("OEBPS/3.xhtml") == b"x"
    start, stop = epub.span(zipfile.ZipFile(io.BytesIO(a)).getinfo("OEBPS/1.xhtml"))
    assert a[start:stop] in b
    with pytest.raises(epub.BookError):
        epub.rewrite(a, {}, {"mimetype": b""})


def test_translated_book():
    texts = {"OEBPS/1.xhtml": ["A Gaivota", *[None] * 7], "OEBPS/2.xhtml": [None]}
    done = epub.translated(book(), texts, "pt", "Gaivotas", "2024-01-01T00:00:00Z", ["Um & meio", "Dois"], [("gull", "gaivota <ave>")])
    t = epub.read_book(done)
    assert (t["title"], t["language"], t["modified"], t["labels"]) == ("Gaivotas", "pt", "2024-01-01T00:00:00Z", ["Um & meio", "Dois"])
    z, old = zipfile.ZipFile(io.BytesIO(done)), zipfile.ZipFile(io.BytesIO(book()))
    assert epub.ncx_labels(z.read("OEBPS/toc.ncx")) == ["Um & meio", "Dois"] and b'src="1.xhtml"' in z.read("OEBPS/toc.ncx")
    assert z.read("OEBPS/2.xhtml") == old.read("OEBPS/2.xhtml")
    assert [b["text"] for b in markup.segment(t["chapters"][-1]["html"])] == ["Glossário", "gull", "gaivota &lt;ave&gt;"]
    with pytest.raises(ValueError):
        epub.translated(done, {}, "pt", glossary=[("a", "b")])  # an appendix is there already
    with pytest.raises(ValueError):
        epub.translated(book(), {}, "pt", labels=["one"])


def test_second_contents_stay_where_they_differ():
    a = epub.new_archive("T", "en", [("1.xhtml", CHAPTER), ("2.xhtml", CHAPTER)], ["Only"])
    z = zipfile.ZipFile(io.BytesIO(epub.translated(a, {}, "pt", labels=["Um", "Dois"])))
    assert epub.ncx_labels(z.read("OEBPS/toc.ncx")) == ["Only"] and markup.link_labels(z.read("OEBPS/nav.xhtml").decode()) == ["Um", "Dois"]


def test_archives_carry_errors(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    (tmp_path / "b.EPUB").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {r.file[-6:]: r.error_class for r in epub.read_epubs(spark, str(tmp_path)).collect()}
    assert got == {"a.epub": None, "b.EPUB": "not_epub"}


def test_saving_overwrites_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a.epub", bytearray(book()))], "path string, content binary")
    assert epub.save_archives(rows, str(tmp_path)).head().bytes == len(book()) and epub.save_archives(rows, str(tmp_path)).count() == 1
    assert [p.name for p in tmp_path.iterdir()] == ["a.epub"]
    other = spark.createDataFrame([("a.epub", bytearray(b"x"))], rows.schema)
    with pytest.raises(Exception, match="a.epub"):
        epub.save_archives(other, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        epub.save_archives(rows, str(tmp_path), sources=str(tmp_path))
