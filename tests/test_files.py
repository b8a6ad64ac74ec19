"""Book files made here, read back, damaged, exported; streams replayed."""

import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from folioscope.functions import html as H
from folioscope.operators import nodes
from folioscope.sinks import files
from folioscope.sources import archive, books, formats
from folioscope.streaming import events

EPUB = files.epub_bytes("urn:x:1", "Tide & Salt", "en", [("One", "first text\nsecond"), ("Two", "more")])


def zipped(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return out.getvalue()


def test_epub_comes_back():
    b = formats.parse("x.epub", EPUB)
    assert b.format == "epub" and b.metadata["title"] == ["Tide & Salt"] and b.metadata["identifier"] == ["urn:x:1"]
    assert [t[1] for t in b.toc] == ["One", "Two"] and len(b.sections) == 2 and "first text" in b.sections[0][3]
    assert [t[2] for t in b.toc] == [s[0] for s in b.sections]


def test_damaged_archives_are_scanned():
    good = zipped({"a.txt": "hello " * 50, "b.txt": "bye"})
    for bad in (good[:-30], b"junk" * 10 + good[: good.rindex(b"PK\x05\x06")], good.replace(b"PK\x01\x02", b"XXXX", 1)):
        z = archive.Archive(bad)
        assert z.read("a.txt") == b"hello " * 50


def test_fb2_and_cbz():
    fb2 = """<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://x"><description><title-info><genre>sea</genre><author><first-name>A</first-name><last-name>B</last-name></author><book-title>T</book-title><lang>en</lang></title-info></description>
    <body><section id="c1"><title><p>Ch</p></title><p>Some <emphasis>text</emphasis>.</p></section></body><body name="notes"><section><p>n</p></section></body></FictionBook>"""
    b = formats.parse("x.fb2", fb2.encode())
    assert b.metadata["author"] == ["A B"] and b.metadata["author_sort"] == ["B, A"] and [s[1] for s in b.sections] == [None, "no"] and b.toc == [(0, "Ch", "c1")]
    assert [x["block_type"] for x in H.blocks(b.sections[0][3])] == ["chapter", "paragraph"]
    assert formats.parse("x.fbz", zipped({"a.fb2": fb2})).metadata["title"] == ["T"]
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 4)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("b.png", png)
        z.writestr("a.jpg", b"")
        z.writestr("ComicInfo.xml", "<ComicInfo><Title>C</Title><Writer>W</Writer></ComicInfo>")
    c = formats.parse("x.cbz", out.getvalue())
    assert [s[0] for s in c.sections] == ["a.jpg", "b.png"] and c.metadata == {"title": ["C"], "author": ["W"]} and 'width="3"' in c.sections[1][3]


def mobi_bytes(text: bytes, packed: bytes, how: int) -> bytes:
    title = b"Title"
    head = bytearray(16 + 232)
    struct.pack_into(">HHIHH", head, 0, how, 0, len(text), 1, 4096)
    head[16:20] = b"MOBI"
    struct.pack_into(">IIII", head, 20, 232, 2, 65001, 0)
    struct.pack_into(">I", head, 36, 6)
    exth = b"EXTH" + struct.pack(">II", 12 + 2 * 9, 2) + struct.pack(">II", 100, 9) + b"A" + struct.pack(">II", 100, 9) + b"B"
    struct.pack_into(">II", head, 84, len(head) + len(exth), len(title))
    struct.pack_into(">I", head, 128, 0x40)
    records = [bytes(head) + exth + title, packed]
    pdb = bytearray(78) + bytearray(8 * len(records))
    pdb[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", pdb, 76, len(records))
    at = len(pdb)
    for i, r in enumerate(records):
        struct.pack_into(">I", pdb, 78 + 8 * i, at)
        at += len(r)
    return bytes(pdb) + b"".join(records)


def test_mobi():
    text = b"<html><body><p>one</p><mbp:pagebreak/><p>two</p></body></html>"
    b = formats.parse("x.mobi", mobi_bytes(text, text, 1))
    assert b.metadata["author"] == ["A", "B"] and b.metadata["title"] == ["Title"] and len(b.sections) == 2
    assert formats.palmdoc(b"abc" + struct.pack(">H", 0x8000 | 3 << 3 | 0) + b"\xe1\x02\x01\x02") == b"abcabc a\x01\x02"


def test_pdf():
    content = zlib.compress(b"BT /F1 12 Tf (Hello) Tj 0 -14 Td [(Wor) -10 (ld) -300 (x\\)y)] TJ ET")
    body = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R /PageLabels << /Nums [0 << /S /r /St 3 >>] >> >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n"
    body += b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj\n4 0 obj << /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n5 0 obj << /Title <FEFF00540069> >> endobj\n" % (len(content), content)
    b = formats.parse("x.pdf", body)
    assert b.sections[0][3] == "Hello\nWorld x)y" and b.pages == [("iii", "page:0")] and b.metadata["title"] == ["Ti"]


def test_reading_files_with_spark(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(EPUB)
    (tmp_path / "b.epub").write_bytes(b"broken")
    (tmp_path / "c.bin").write_bytes(b"?")
    got = {r.path.rpartition("/")[2]: r for r in books.read_books(spark, str(tmp_path)).collect()}
    assert got["a.epub"].error is None and got["b.epub"].error and got["c.bin"].error
    one = books.read_books(spark, str(tmp_path), "a.epub")
    assert books.sections_of(one).count() == 2 and books.toc_of(one).filter("label = 'Two'").count() == 1
    rows = nodes.html_blocks(books.sections_of(one), ["path", "section_index"], "content")
    assert [r.text for r in rows.orderBy("section_index", "block_index").collect()] == ["One", "first text", "second", "Two", "more"]


def test_nodes_and_edits(spark):
    page = '<h1 id="t">T</h1><div class="a b"><p>x<br/>y</p><img src="i.PNG"><img></div><script>no</script><ol type="i"><li>l<ul><li>m</li></ul></li></ol><table><tr><td>1</td><td>2</td></tr></table><aside epub:type="footnote">f</aside>'
    n = nodes.html_nodes(spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, h string"), ["k"], "h")
    assert nodes.select(n, tag="div", cls="b").count() == 1 and nodes.select(n, id="t").count() == 1 and nodes.select(n, has="src").count() == 1
    assert [(r.image_id, r.mime_type) for r in nodes.images(n, ["k"]).collect()] == [("img-0", "image/png")]
    assert nodes.node_text(n, ["k"]).first().text.startswith("Txy")
    got = [(b["block_type"], b["text"]) for b in H.blocks(page)]
    assert got == [("chapter", "T"), ("paragraph", "x\ny"), ("image", ""), ("image", ""), ("listItem", "i. l"), ("listItem", "• m"), ("table", "1 2")]
    t = H.tree("<p>a</p><p>b</p>")
    H.edit(t, (0,), remove=True)
    H.edit(t, (0, 0), text="c")
    H.edit(t, (0,), attrs={"id": "z"})
    H.edit(t, (0,), insert=H.Node("hr", ()))
    assert H.serialize(t) == '<hr/><p id="z">c</p>' and t.children[1].children[0].path == (1, 0)
    assert H.matches(H.Node("p", (), {"class": "a b", "id": "q"}), "p.a#q") and not H.matches(H.Node("p", ()), "[id]")


def test_export(spark, tmp_path):
    b = spark.createDataFrame([(1, "u", "Book", None)], "book_id long, identifier string, title string, lang string")
    s = spark.createDataFrame([(1, 0, None, "A", "x"), (1, 1, "no", "N", "hidden"), (1, 2, None, "B", "y")], "book_id long, section_index int, linear string, label string, body string")
    files.write_files(files.export_rows(b, s, "epub", first=1), str(tmp_path))
    back = formats.parse("1.epub", (tmp_path / "1.epub").read_bytes())
    assert [t[1] for t in back.toc] == ["A"]
    assert b"hidden" not in files.export_rows(b, s, "html").first().content and files.export_rows(b, s, "cbz").count() == 1


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2030-01-01 00:00:00"), (1, "a", "2030-01-01 00:00:01"), (2, "b", "2030-01-01 00:01:00")], "book long, block string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.new_windows(live, ["book", "block"], "ts").writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable(), q.stop()
    assert spark.table("seen").count() == 2
    q = live.writeStream.foreachBatch(events.upsert(str(tmp_path / "out"), ["book"], "ts")).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable(), q.stop()
    got = {r.book: str(r.ts) for r in events.upserted(spark, str(tmp_path / "out"), ["book"], "ts").collect()}
    assert got == {1: "2030-01-01 00:00:01", 2: "2030-01-01 00:01:00"}


def indx(entries: list[tuple[bytes, int, bytes]], tags: list[tuple[int, int, int]], labels: bytes = b"") -> list[bytes]:
    """Records of an index: entries as name, control byte and values; tags as tag, numbers a value, mask."""
    tagx = b"TAGX" + struct.pack(">II", 12 + 4 * (len(tags) + 1), 1) + b"".join(bytes((*t, 0)) for t in tags) + bytes((0, 0, 0, 1))
    head = bytearray(56)
    head[:4] = b"INDX"
    struct.pack_into(">I", head, 4, 56)
    struct.pack_into(">III", head, 20, 0, 1, 65001)
    struct.pack_into(">I", head, 52, int(bool(labels)))
    body, places = bytearray(56), []
    for name, control, values in entries:
        places.append(len(body))
        body += bytes((len(name),)) + name + bytes((control,)) + values
    body[:4] = b"INDX"
    struct.pack_into(">II", body, 20, len(body), len(places))
    body += b"IDXT" + struct.pack(f">{len(places)}H", *places)
    return [bytes(head) + tagx, bytes(body), *([labels] if labels else [])]


def test_fragments_go_into_their_skeletons():
    v = lambda *n: b"".join(bytes((x >> 7, x & 127 | 128)) for x in n)
    shell, parts = b"<html><body></body></html>", [b"<p>one</p>", b"<p>two</p>", b"<p>three</p>"]
    text = shell + parts[0] + parts[1] + shell + parts[2]
    second = len(shell) + len(parts[0]) + len(parts[1])
    skel = indx([(b"S0", 3, v(2) + v(0, len(shell))), (b"S1", 3, v(1) + v(second, len(shell)))], [(1, 1, 1), (6, 2, 2)])
    # The last entry gives the bytes of its values in place of their number.
    frag = indx([(b"0000000012", 4, v(0, 10)), (b"0000000022", 4, v(10, 10)), (b"%010d" % (second + 12), 12, bytes((132,)) + v(0, 12))], [(6, 2, 12)])
    labels = b"".join(bytes((len(x) | 128,)) + x for x in (b"A &amp; B", b"Sub", b"Last"))
    ncx = indx([(b"0", 23, v(0) + v(0) + v(0, 0) + v(1)), (b"1", 15, v(10) + v(1) + v(1, 3) + v(0)), (b"2", 7, v(14) + v(0) + v(2, 0))], [(3, 1, 1), (4, 1, 2), (6, 2, 4), (21, 1, 8), (22, 1, 16)], labels)
    head = bytearray(16 + 264)
    struct.pack_into(">HHIHH", head, 0, 1, 0, len(text), 1, 4096)
    head[16:20] = b"MOBI"
    struct.pack_into(">IIII", head, 20, 264, 2, 65001, 0)
    struct.pack_into(">I", head, 36, 8)
    struct.pack_into(">III", head, 244, 2 + len(skel) + len(frag), 2 + len(skel), 2)
    records = [bytes(head), text, *skel, *frag, *ncx]
    pdb = bytearray(78) + bytearray(8 * len(records))
    pdb[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", pdb, 76, len(records))
    for i in range(len(records)):
        struct.pack_into(">I", pdb, 78 + 8 * i, len(pdb) + sum(map(len, records[:i])))
    b = formats.parse("x.azw3", bytes(pdb) + b"".join(records))
    assert [s[3] for s in b.sections] == ["<html><body><p>one</p><p>two</p></body></html>", "<html><body><p>three</p></body></html>"]
    assert b.toc == [(0, "A & B", "0#kindle:pos:fid:0000:off:0000000000"), (1, "Sub", "0#kindle:pos:fid:0001:off:0000000003"), (0, "Last", "1#kindle:pos:fid:0002:off:0000000000")]


def pdf_page(filters: bytes, content: bytes, font: bytes, more: bytes = b"") -> bytes:
    body = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj\n"
    return body + b"4 0 obj << %s /Length %d >> stream\n%s\nendstream endobj\n5 0 obj << /Type /Font %s >> endobj\n" % (filters, len(content), content, font) + more


def test_pdf_filters_and_font_maps():
    assert formats.unfilter(bytes.fromhex("800B6050220C0C8501"), "LZWDecode") == bytes((45, 45, 45, 45, 45, 65, 45, 45, 45, 66))
    shown = b"BT /F1 12 Tf (Hello) Tj ET"
    codes = [256, *shown, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big")
    b = formats.parse("x.pdf", pdf_page(b"/Filter /LZWDecode", packed, b"/Subtype /Type1"))
    assert b.sections[0][3] == "Hello" and b.error is None
    rows, before = b"", bytes(13)
    for at in (0, 13):
        line = shown[at : at + 13]
        rows += b"\x02" + bytes((x - y) & 255 for x, y in zip(line, before))
        before = line
    b = formats.parse("x.pdf", pdf_page(b"/Filter [/FlateDecode] /DecodeParms [<< /Predictor 12 /Columns 13 >>]", zlib.compress(rows), b"/Subtype /Type1"))
    assert b.sections[0][3] == "Hello"
    assert formats.unpredict(bytes((1, 1, 1, 5, 1, 1)), b"<< /Predictor 2 /Columns 3 >>") == bytes((1, 2, 3, 5, 6, 7))
    wide = b"BT /F1 12 Tf <000100020011> Tj [<0012> -300 <0020>] TJ ET"
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <041F> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<D83DDE00> <0062>] endbfrange"
    map_at = b"6 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    b = formats.parse("x.pdf", pdf_page(b"", wide, b"/Subtype /Type0 /ToUnicode 6 0 R", map_at))
    assert b.sections[0][3] == "Пfibc 😀" and b.error is None


def test_what_of_a_pdf_cannot_be_read_is_an_error():
    no_map = books.row("x.pdf", pdf_page(b"", b"BT /F1 12 Tf <00010002> Tj ET", b"/Subtype /Type0"))
    assert "font" in no_map["error"] and len(no_map["sections"]) == 1
    for name, content in ((b"/Crypt", b"x"), (b"/FlateDecode", b"damaged"), (b"/LZWDecode", b"\xff\xff\xff")):
        r = books.row("x.pdf", pdf_page(b"/Filter " + name, content, b"/Subtype /Type1"))
        assert r["error"] and r["sections"][0]["content"] == "", name


def test_references_stay_inside_the_archive():
    assert formats.under("OEBPS/a.opf", "./b.x#f") == "OEBPS/b.x#f" and formats.under("a.opf", ".well/x") == ".well/x" and formats.under("a/b.opf", "../../.hidden/x") == ".hidden/x"


def test_archives_say_what_they_cannot_unpack(monkeypatch):
    import pytest

    z = archive.Archive(zipped({"a.txt": "hello " * 50})[:-30])
    assert z.read("a.txt") and archive.is_zip(b"PK\x03\x04") and not archive.is_zip(b"%PDF")
    monkeypatch.setattr(archive, "MOST", 20)
    for data in (zipped({"a.txt": "hello " * 50}), zipped({"a.txt": "hello " * 50})[:-30]):
        with pytest.raises(ValueError):
            archive.Archive(data).read("a.txt")
    assert isinstance(archive.unpacked(b"", 12), ValueError)


def test_readers_are_asked_by_priority():
    assert formats.registered() == ["pdf", "epub", "mobi", "fb2", "cbz"]
    formats.register("txt", lambda data: formats.Book("txt"), lambda low, head: low.endswith(".pdf"), 30)
    try:
        assert formats.detect("x.pdf", b"") == "txt" and formats.parse("x.pdf", b"").format == "txt"
    finally:
        assert formats.unregister("txt") and not formats.unregister("txt")
    assert formats.detect("x.pdf", b"") == "pdf"


def test_mobi_links_lead_to_their_sections():
    sections = [b"<p>section %d</p>" % k for k in range(40)]
    page = b"<mbp:pagebreak/>"
    toc = b"<blockquote>" + b"".join(b"<a filepos=%010d>S%d</a>" % (0, k) for k in range(40)) + b"</blockquote>"
    head = len(toc) + len(page) * 2  # an empty section follows the contents
    at, links = head, []
    for k, s in enumerate(sections):
        links.append(b"<a filepos=%010d>S%d</a>" % (at, k))
        at += len(s) + len(page)
    text = b"<blockquote>" + b"".join(links) + b"</blockquote>" + page + page + page.join(sections)
    b = formats.parse("x.mobi", mobi_bytes(text, text, 1))
    assert len(b.sections) == 41 and [(d, label, href.split("#")[0]) for d, label, href in b.toc] == [(0, f"S{k}", str(k + 1)) for k in range(40)]


def test_damaged_ncx_and_landmarks():
    ncx = "<ncx><navMap><navPoint><navLabel><text>One &amp; all</text></navLabel><content src='a.x'/><navPoint><navLabel><text>Sub</text></navLabel><content src='a.x#s'/></navPoint></navPoint><navPoint><navLabel><text>Two</text></navLabel><content src='b.x'></navMap><pageList><pageTarget><navLabel><text>iv</text></navLabel><content src='a.x#p'/></pageTarget>"
    assert formats.ncx_entries(ncx) == ([(0, "One & all", "a.x"), (1, "Sub", "a.x#s"), (0, "Two", "b.x")], [("iv", "a.x#p")])
    opf = '<package xmlns="http://x"><metadata/><manifest><item id="n" href="n.x" media-type="a" properties="nav"/></manifest><spine/></package>'
    nav = '<nav epub:type="toc"><ol><li><a href="a.x">A</a></li></ol></nav><nav epub:type="landmarks"><ol><li><a href="c.x">Cover</a></li></ol></nav>'
    b = formats.epub(zipped({"p.opf": opf, "n.x": nav}))
    assert b.landmarks == [("Cover", "c.x")] and [t[1] for t in b.toc] == ["A"]


def test_pdf_outline_runs_and_links(spark, tmp_path):
    content = b"BT /F1 10 Tf 1 0 0 1 50 700 Tm (Hello) Tj ( there) Tj 0 -14 Td (Next) Tj ET q 2 0 0 2 0 0 cm BT /F1 5 Tf 20 100 Td (Big) Tj ET Q"
    body = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R /Outlines 6 0 R /Names << /Dests 9 0 R >> >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R 10 0 R] /Count 2 /MediaBox [0 0 600 800] >> endobj\n"
    body += b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R /Annots [11 0 R 12 0 R] >> endobj\n4 0 obj << /Length %d >> stream\n%s\nendstream endobj\n10 0 obj << /Type /Page /Parent 2 0 R >> endobj\n" % (len(content), content)
    body += b"6 0 obj << /First 8 0 R /Last 7 0 R >> endobj\n7 0 obj << /Title (B) /Parent 6 0 R /Prev 8 0 R /A << /S /GoTo /D (there) >> >> endobj\n8 0 obj << /Title (A\x85) /Parent 6 0 R /Next 7 0 R /First 13 0 R /Dest [3 0 R /Fit] >> endobj\n"
    body += b"9 0 obj << /Names [(there) [10 0 R /Fit]] >> endobj\n11 0 obj << /Subtype /Link /A << /S /URI /URI (http://x.example) >> >> endobj\n12 0 obj << /Subtype /Link /Dest (there) >> endobj\n13 0 obj << /Title (Sub) /Parent 8 0 R /Dest [10 0 R /Fit] >> endobj\n"
    b = formats.parse("x.pdf", body)
    assert b.toc == [(0, "A–", "page:0"), (1, "Sub", "page:1"), (0, "B", "page:1")] and b.links == [(0, "http://x.example"), (0, "page:1")]
    assert [(r[1], r[2], r[4], r[5]) for r in b.runs] == [("Hello there", [10.0, 0.0, 0.0, 10.0, 50.0, 100.0], 10.0, True), ("Next", [10.0, 0.0, 0.0, 10.0, 50.0, 114.0], 10.0, True), ("Big", [10.0, 0.0, 0.0, 10.0, 40.0, 600.0], 5.0, True)]
    (tmp_path / "x.pdf").write_bytes(body)
    rows = books.runs_of(books.read_books(spark, str(tmp_path))).orderBy("run_index").collect()
    assert [r.text for r in rows] == ["Hello there", "Next", "Big"] and rows[0].transform_matrix[5] == 100.0


PNG = "data:image/png;base64,iVBORw0KGgo="


def test_packages_hold_each_image_once_and_nested_contents():
    body = f'<html><head><title>x</title></head><body><p>a <img src="{PNG}"/><img src="{PNG}"/><a href="http://x">l</a><img src="data:image/gif;base64,R0lG"/></p></body></html>'
    data = files.epub_bytes("i", "T", "en", [("One", body), ("Two", "plain"), ("Three", "x")], [(0, "One", 0), (1, "Dropped", None), (2, "Two", 1), (0, "Gone", None), (1, "Three", 2)])
    z = archive.Archive(data)
    assert [n for n in z.names if "images/" in n] == ["OEBPS/images/resource-1.png", "OEBPS/images/resource-2.gif"] and z.read("OEBPS/images/resource-2.gif") == b"GIF"
    first = z.text("OEBPS/s0000.xhtml")
    assert first.count('src="images/resource-1.png"') == 2 and 'href="http://x"' in first and "<title>x" not in first
    assert formats.parse("x.epub", data).toc == [(0, "One", "OEBPS/s0000.xhtml"), (1, "Two", "OEBPS/s0001.xhtml"), (0, "Three", "OEBPS/s0002.xhtml")]
    c = archive.Archive(files.cbz_bytes("i", "T", "en", [("One", body), ("Two", "plain")]))
    assert c.names == ["ComicInfo.xml", "page0001-img01.png", "page0001-img02.png", "page0001-img03.gif", "0002.txt"]
    assert files.txt_bytes("i", "T", "en", [("One", body), ("Two", "plain")]).decode().startswith("T\n----")
    assert files.rewritten("<a href='x&amp;y' data=\"z\">", lambda u, a: u + "!" if a == "href" else None) == '<a href="x&amp;y!" data="z">'
    assert files.projected([]) == [] and files.nested([]) == "<ol></ol>" and files.data_image("data:image/png;base64,?") is None
    assert b"#s1" in files.html_text("i", "T", "en", [("A", "x"), ("B", "y")], [(0, "B", 1)])


def test_writers_are_registered(spark, tmp_path):
    files.register("none", lambda *a: b"x")
    try:
        b = spark.createDataFrame([(1, "i", "T", "en")], "book_id long, identifier string, title string, lang string")
        s = spark.createDataFrame([(1, 0, None, "One", "text")], "book_id long, section_index int, linear string, label string, body string")
        rows = files.export_rows(b, s, "none")
        assert bytes(rows.first().content) == b"x"
        files.write_files(rows, str(tmp_path / "out"))
        assert (tmp_path / "out" / "1.none").read_bytes() == b"x"
    finally:
        assert files.unregister("none")
    uses = spark.createDataFrame([(1, "b", 3), (1, "a", 1), (1, "b", 0)], "book_id int, url string, position int")
    assert {(r.url, r.number) for r in files.numbered_resources(uses).collect()} == {("b", 1), ("a", 2)}


def test_upserts_are_brought_together(spark, tmp_path):
    put = events.upsert(str(tmp_path / "s"), ["k"], "v", every=3)
    for n in range(8):
        put(spark.createDataFrame([(n % 2, n, f"t{n}")], "k int, v int, text string"), n)
    put(spark.createDataFrame([(1, 7, "t7")], "k int, v int, text string"), 7)
    assert {(r.k, r.v) for r in events.upserted(spark, str(tmp_path / "s"), ["k"], "v").collect()} == {(0, 6), (1, 7)}
    names = {p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")}
    assert names == {"batch=3", "batch=4", "batch=5", "base=5", "batch=6", "batch=7"} or names == {"base=2", "batch=3", "batch=4", "batch=5", "base=5", "batch=6", "batch=7"}


def test_texts_are_written_by_section(spark, tmp_path):
    from folioscope.sinks import text

    s = spark.createDataFrame([(1, 0, None, "A", None, "a"), (1, 1, None, None, "B", "b"), (2, 0, "no", "C", None, "c")], "book_id long, section_index int, linear string, toc_label string, title string, section_id string")
    b = spark.createDataFrame([(1, 1, 0, 0, "x"), (2, 1, 1, 0, "y")], "block_uid long, book_id long, unit_index int, block_index int, text string")
    text.write_texts(s, b, str(tmp_path / "t"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "t" / "book_id=1").glob("*.txt")))
    assert whole == f"{text.DIVIDER}\nA\nx\n{text.DIVIDER}\nB\ny\n"


def test_disguised_fonts():
    plain, key = zlib.compress(b"OTTO" * 900), b"0123456789abcdefghij"
    mixed = bytes(c ^ key[i % 20] if i < 1040 else c for i, c in enumerate(plain))
    record = b"FONT" + struct.pack(">IIIII", 3600, 3, 44, 20, 24) + key + mixed
    assert formats.font(record) == b"OTTO" * 900
    assert formats.font(b"FONT" + struct.pack(">IIIII", 4, 0, 24, 0, 24) + b"OTTO") == b"OTTO"
