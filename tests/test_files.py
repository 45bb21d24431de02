import base64
import io
import struct
import zipfile

from pyspark.sql import functions as F

from quire.functions import images as I
from quire.functions import text as T
from quire.operators import cleaner as L
from quire.operators import legacy as E
from quire.sources import archive as A
from quire.sources import docx as D
from quire.sources.catalogue import read_catalogue


def zipped(entries):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for n, b in entries.items():
            z.writestr(n, b)
    return buf.getvalue()


def jpeg(w, h):
    return (b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 6) + b"\xff\xc0\xff\xff" + b"\x00\x00"  # filler and two stray bytes
            + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, h, w) + b"\x03" + b"\x00" * 20)


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 2, 3) + b"\x08\x06"
    gif = b"GIF89a" + struct.pack("<HH", 300, 7)
    bmp = b"BM" + b"\x00" * 16 + struct.pack("<ii", 5, -6)
    rows = [("png", png), ("gif", gif), ("bmp", bmp), ("jpg", jpeg(640, 480)), ("jpg", b"\xff\xd8\xff"), ("png", b"x")]
    d = spark.createDataFrame([(i, k, bytearray(b)) for i, (k, b) in enumerate(rows)], "i int, k string, b binary")
    got = [(r.s.width, r.s.height) if r.s else None for r in d.select("i", I.image_size(F.col("b"), F.col("k")).alias("s")).orderBy("i").collect()]
    assert got == [(2, 3), (300, 7), (5, 6), (640, 480), None, None]
    url = "data:image/jpeg;base64," + base64.b64encode(jpeg(9, 8)).decode()
    s = spark.createDataFrame([(url,)], "u string").select(I.data_url_size(F.col("u")).alias("s")).first().s
    assert (s.width, s.height) == (9, 8)


def test_scalar_edges(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(T.fnv1a(F.lit("abc"))) == "1a47e90b"
    assert one(T.fnv1a(F.lit(""))) == "811c9dc5"
    assert one(T.unescape_xml(F.lit("&#x1F600;&#38;lt;"))) == "😀<"
    assert one(T.video_link(F.lit("https://www.youtube-nocookie.com/embed/ab?x"))) == "https://www.youtube.com/watch?v=ab"
    assert one(T.resource_name(F.lit("./resources/a/b%20c+d.png"))) == "b c+d.png"
    assert one(T.collapse(F.lit(" a  b "))) == "a b"
    assert one(T.attr(F.lit("""<a class='x' href="a&amp;b" data-href=z>"""), "href")) == "a&b"


def test_archives(spark):
    files = {"w.docx": zipped({"word/document.xml": "<w:document/>", "docProps/core.xml": "<a><dc:title>T &amp; U</dc:title></a>"}),
             "bad.docx": b"no zip", "deep.zip": zipped({"r/s/config.xml": "c", "r/s/x/style.css": "d", "r/": ""})}
    d = spark.createDataFrame([(p, bytearray(b)) for p, b in files.items()], "path string, content binary")
    assert {(r.path, r.entry) for r in A.entries(d, r"core\.xml$").collect()} == {("w.docx", "docProps/core.xml")}
    assert D.core_properties(D.parts(d, D.CORE)).first().title == "T & U"
    hurt = bytearray(zipped({"a": "x" * 50, "b": "y"}))
    hurt[33] ^= 0xFF  # within the packed bytes of the first entry
    bad = spark.createDataFrame([("hurt.zip", hurt), ("bad.docx", bytearray(b"no zip")), ("none.zip", None)], "path string, content binary")
    assert {tuple(r) for r in A.failures(bad).collect()} == {("hurt.zip", "a", A.NO_ENTRY), ("bad.docx", None, A.NO_ARCHIVE), ("none.zip", None, A.NO_ARCHIVE)}
    assert [(r.entry, r.entry_ord) for r in A.entries(bad).collect()] == [("b", 1)]
    deep = A.entries(d.filter("path = 'deep.zip'"))
    assert {r.entry for r in A.unwrap_root(deep).collect()} == {"s/config.xml", "s/x/style.css"}
    assert {r.entry for r in A.unwrap_root(deep, deep=True).collect()} == {"config.xml", "x/style.css"}
    assert A.package_status(deep).first().error.startswith("No se ha encontrado contentv3.xml")


def test_word_to_blocks(spark):
    p = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    doc = ("<w:document><w:body>" + p("Normal", "Portada") + p("T2", "Uno") + p("xejemplo", "ejemplo") + p("xejemplo", "&lt;&lt; a")
           + p("xejemplo", "b &gt;&gt;") + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>" + p("T3", "Dos") + "</w:body></w:document>")
    sty = "".join(f'<w:style w:type="paragraph" w:styleId="T{n}"><w:name w:val="heading {n}"/></w:style>' for n in (2, 3))
    x = lambda t: spark.createDataFrame([(1, t)], "doc bigint, xml string")
    raw, styles = D.raw_blocks(x(doc)).withColumnRenamed("doc", "doc_id"), D.styles(x(sty)).withColumnRenamed("doc", "doc_id")
    b = L.blocks_of(raw, styles)
    assert [(r.kind, r.role) for r in b.orderBy("i").collect()] == [
        ("cover", "remove"), ("heading", "h1"), ("box", "box:ejemplo"), ("box", "box:ejemplo"), ("box", "box:ejemplo"),
        ("table", "table:horizontal"), ("heading", "h2")]
    out = [r.text for r in L.apply_roles(b).orderBy("i", "part").collect()]
    assert out == ["Uno", "[ejemplo]", "a", "b", "[fin]", "[horizontal]", "Tabla 1 · c", "Dos"]


def test_legacy_package(spark):
    w = lambda ref, html: (f'<instance class="x.JsIdevice" reference="{ref}"><dictionary><string role="key" value="_iDeviceDir"/><string value="text"/>'
                           f'<string role="key" value="fields"/><list><instance class="x.TextAreaField" reference="{ref}0"><dictionary>'
                           f'<string role="key" value="content_w_resourcePaths"/><unicode value="{html}"/></dictionary></instance></list></dictionary></instance>')
    node = lambda ref, title, items, kids: (f'<instance class="exe.engine.node.Node" reference="{ref}"><dictionary><string role="key" value="_title"/>'
                                            f'<unicode value="{title}"/><string role="key" value="idevices"/><list>{items}</list><string role="key" value="children"/><list>{kids}</list></dictionary></instance>')
    kid = node(11, "Unidad 1", w(2, "&lt;p&gt;c&lt;/p&gt;"), '<reference key="12"/>')
    xml = ('<instance class="exe.engine.package.Package" reference="2"><dictionary><string role="key" value="root"/>' + node(10, "Presentación", w(1, ""), kid)
           + '<string role="key" value="o"/><list>' + node(12, "", "", '<reference key="10"/>') + "</list></dictionary></instance>")
    n = E.xml_nodes(spark.createDataFrame([(1, xml)], "doc_id bigint, xml string"))
    p = E.pages(n)
    assert [(r.depth, r.title) for r in p.orderBy("page_ord").collect()] == [(0, "Presentación"), (1, "Unidad 1"), (2, "Página sin título")]
    items, warn = E.items(n, p)
    assert [(r.page_ord, r.type, r.html) for r in items.collect()] == [(1, "text", "<p>c</p>")]
    assert [r.warning for r in warn.collect()] == ["En la página «Presentación»: iDevice «text» sin texto extraíble, omitido."]


def test_word_blocks_nested(spark):
    p = lambda inner: f"<w:p>{inner}</w:p>"
    t = lambda text: f"<w:r><w:t>{text}</w:t></w:r>"
    link = lambda a: f'<w:hyperlink w:anchor="{a}">{t(a)}</w:hyperlink>'
    table = lambda inner: f"<w:tbl><w:tr><w:tc>{inner}</w:tc></w:tr></w:tbl>"
    doc = ("<w:document><w:body>" + p(t("one")) + table(p(t("a")) + table(p(t("b"))) + p(t("c"))) + "<w:p/>"
           + p(t("box") + "<w:txbxContent>" + p(t("in")) + "</w:txbxContent>" + t("end")) + p(link("other") + link("_Toc7"))
           + "<w:sdt><w:sdtContent>" + p(t("toc")) + "</w:sdtContent></w:sdt>" + '<w:p w:x="1"><w:pPr/>' + t("last") + "</w:p><w:sectPr/></w:body></w:document>")
    d = spark.createDataFrame([(1, doc), (2, "<w:document><w:body></w:body></w:document>"), (3, None)], "doc bigint, xml string")
    got = [(r.i, r.node, r.text, r.anchor) for r in D.raw_blocks(d).orderBy("i").collect()]
    assert got == [(0, "p", "one", None), (1, "tbl", None, None), (2, "p", "", None), (3, "p", "boxinend", None), (4, "p", "other_Toc7", "_Toc7"),
                   (5, "sdt", None, None), (6, "p", "last", None)]


def test_image_containers_of_one_kind(spark):
    inner = '<wp:anchor><wp:extent cx="9525" cy="9525"/></wp:anchor>'
    doc = f'<wp:inline><wp:extent cx="19050" cy="28575"/>{inner}<a:blip r:embed="r"/></wp:inline><w:pict><v:imagedata r:id="x"/></w:pict>'
    d = spark.createDataFrame([(1, doc)], "doc bigint, xml string")
    assert [(r.img_ord, r.w, r.h) for r in D.image_sizes(d).orderBy("img_ord").collect()] == [(0, 2, 3), (1, None, None)]


def test_old_escapes(spark):
    rows = ["plain", "a\\xe9\\x41\\x01\\xzz \\ b", "\\x0A", None]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    assert [r.v for r in d.orderBy("i").select(E.repair_escapes(F.col("s")).alias("v")).collect()] == ["plain", "aéA\\x01\\xzz \\ b", "\n", None]


def test_fields_behind_a_nested_widget(spark):
    """A field after a closed inner widget belongs to the outer one, a field of the inner widget to both."""
    area = lambda v: (f'<instance class="x.TextAreaField"><dictionary><string role="key" value="content"/><unicode value="{v}"/></dictionary></instance>')
    wid = lambda inner: f'<instance class="x.Idevice"><dictionary><string role="key" value="fields"/><list>{inner}</list></dictionary></instance>'
    held = f'<instance class="y"><dictionary><string role="key" value="idevices"/><list>{wid(area("in"))}</list></dictionary></instance>'
    xml = f'<instance class="n"><dictionary><string role="key" value="idevices"/><list>{wid(area("a") + held + area("b"))}</list></dictionary></instance>'
    n = E.xml_nodes(spark.createDataFrame([(1, xml)], "doc_id bigint, xml string"))
    got = [(r.target, r.html) for r in E.text_areas(n).orderBy("target", "pos").collect()]
    outer, inner = got[0][0], got[-1][0]
    assert got == [(outer, "a"), (outer, "in"), (outer, "b"), (inner, "in")] and outer < inner


def test_package_errors(spark):
    d = spark.createDataFrame([(1, "<instance class='z'/>"), (2, '<instance class="exe.engine.package.Package"/>')], "doc_id bigint, xml string")
    got = {r.doc_id: (r.title, r.author, r.error) for r in E.package_info(E.xml_nodes(d)).collect()}
    assert got == {1: ("Documento", "", "El contentv3.xml no contiene un paquete de eXeLearning reconocible."),
                   2: ("Documento", "", "El paquete no contiene ninguna página.")}


def test_catalogue_file(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"themes": [{"id": "a", "name": "A"}]}', encoding="utf-8")
    assert [r.id for r in read_catalogue(spark, str(f)).collect()] == ["a"]
    assert read_catalogue(spark, str(tmp_path / "none.json")).count() == 0


def zip_of(entries):
    import io
    import zipfile
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in entries:
            z.writestr(name, content)
    return out.getvalue()


def test_archive_files_are_cut_and_errors_are_rows(spark, tmp_path):
    from quire.sources import files as FS
    big = zip_of([(f"d/{i:03d}.txt", bytes([i]) * 1000) for i in range(100)])
    rows = [("big.zip", big), ("sub/small.zip", zip_of([("a.xml", b"x"), ("b.txt", b"")])), ("broken.zip", big[:500]), ("empty", None)]
    where = str(tmp_path / "z")
    FS.write_files(spark.createDataFrame(rows, "path string, content binary"), where)
    got = FS.read_archive_files(spark, where, split=20_000)
    assert got.rdd.getNumPartitions() >= 5
    assert {(r.path, r.error) for r in got.filter("error is not null").collect()} == {("broken.zip", "not an archive"), ("empty", "not an archive")}
    mine = sorted((r.entry_ord, r.entry, bytes(r.content)) for r in got.filter("path = 'big.zip'").collect())
    assert mine == [(i, f"d/{i:03d}.txt", bytes([i]) * 1000) for i in range(100)]
    assert [r.entry for r in got.filter("entry = 'a.xml'").collect()] == ["a.xml"]
    assert FS.read_archive_files(spark, str(tmp_path / "none")).count() == 0


def test_written_files_are_replaced_as_a_whole_or_not_at_all(spark, tmp_path):
    import os

    import pytest
    from quire.sources import files as FS
    where = str(tmp_path / "out")
    first = spark.createDataFrame([(f"p/{i}.zip", zip_of([("a", str(i))])) for i in range(6)], "path string, content binary")
    FS.write_files(first.repartition(3), where)
    seen = lambda: sorted((r.path, bytes(r.content)) for r in FS.read_archive_files(spark, where).collect())
    before = seen()
    assert before == [(f"p/{i}.zip", str(i).encode()) for i in range(6)]
    with pytest.raises(Exception, match="not a path below"):
        FS.write_files(spark.createDataFrame([("p/0.zip", b"new"), ("../x", b"")], "path string, content binary").repartition(2), where)
    assert seen() == before
    FS.write_files(first.limit(2), where)
    assert len(seen()) == 2 and len([n for n in os.listdir(where) if n.startswith("run-")]) == 1


def test_related_elements_in_broken_packages(spark):
    xml = '</x><!--c--><instance class="p" reference="1"><dictionary><string role="key" value="a"/><reference key="2"/></dictionary><instance reference="2"/>'
    rows = spark.createDataFrame([(1, xml), (2, ""), (3, None)], "doc_id bigint, xml string")
    got = [(r.tag, r.depth, r.key, r.close_pos is None, r.target) for r in E.xml_nodes(rows).orderBy("doc_id", "pos").collect()]
    assert got == [("instance", 1, None, True, 2), ("dictionary", 2, None, False, None), ("string", 3, None, False, None),
                   ("reference", 3, "a", False, 7), ("instance", 2, None, False, 7)]
