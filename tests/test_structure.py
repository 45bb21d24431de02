from pyspark.sql import functions as F

from quire.operators import content as Q
from quire.operators import heading_tags as H
from quire.operators import nav as N
from quire.operators import structure as R
from quire.operators import tokens as K


def built(d):
    p, b = R.build(d, K.elements(d))
    pages = [(r.doc_id, r.page_idx, r.title, r.level, r.parent_idx) for r in p.orderBy("doc_id", "page_idx").collect()]
    blocks = [(r.doc_id, r.page_idx, r.title, r.html) for r in b.orderBy("doc_id", "page_idx", "block_idx").collect()]
    return pages, blocks


def test_golden_documents(docs):
    d = docs(
        "<h1>Tema</h1><p>intro</p><h2>Apartado</h2><p>cuerpo</p><h3>Detalle</h3><p>fino</p><h4>Más</h4>",
        "<p>Hola</p><p>Mundo entero</p>",
        "",
        "<p>previo</p><h1></h1><h1>A</h1><p>a</p><h1>B</h1><p>b</p>",
        "<h1></h1><h1>P1</h1><p>uno</p><h2></h2><h2>S</h2><p>sub</p><h1>  </h1><h1>P2</h1><p>dos</p>",
    )
    pages, blocks = built(d)
    assert [p[:3] for p in pages] == [
        (0, 0, "Tema"), (1, 0, "Contenido"), (2, 0, "Contenido"), (3, 0, "Contenido"), (3, 1, "A"), (3, 2, "B"),
        (4, 0, "P1"), (4, 1, "P2")]
    assert blocks == [
        (0, 0, "", "<p>intro</p>\n<h2>Apartado</h2>\n<p>cuerpo</p><h3>Detalle</h3><p>fino</p><h4>Más</h4>"),
        (1, 0, "", "<p>Hola</p><p>Mundo entero</p>"), (2, 0, "", "<p></p>"),
        (3, 0, "", "<p>previo</p>"), (3, 1, "", "<p>a</p>"), (3, 2, "", "<p>b</p>"),
        (4, 0, "", "<p>uno</p>\n<h2>S</h2>\n<p>sub</p>"), (4, 1, "", "<p>dos</p>")]


def test_panels_and_parents(docs):
    tag = lambda k: f' data-structure-tag="{k}"'
    d = docs(
        f"<h1>T</h1><h2{tag('acordeon')}>A</h2><p>a</p><h2{tag('acordeon')}>B</h2><p>b</p><p>[fin acordeón]</p><p>fuera</p>"
        f"<h2{tag('pestanas')}>C</h2><h2{tag('titulo-idevice')}>D</h2><p>d</p>",
        f"<h1>1</h1><h1{tag('subpagina')}>2</h1><h1>3</h1><h1{tag('3er-nivel')}>4</h1>",
    )
    pages, blocks = built(d)
    assert blocks[0][3] == ('<div class="exe-fx exe-accordion">\n<h2>A</h2>\n<p>a</p>\n<h2>B</h2>\n<p>b</p>\n</div>\n<p>fuera</p>\n'
                            '<div class="exe-fx exe-tabs">\n<h2>C</h2>\n<p></p>\n</div>')
    assert blocks[1][2:] == ("D", "<p>d</p>")
    # the structured route keeps the older level-2 parent; the other one resets it
    assert [p[4] for p in pages[1:]] == [None, 0, None, 1]
    h = "<h1>1</h1><h2>2</h2><h1>3</h1><h3>4</h3>"
    p2, _ = R.heading_mode_pages(K.elements(docs(h)), docs(h), h2="page", h3="page")
    assert [r.parent_idx for r in p2.orderBy("page_idx").collect()] == [None, 0, None, 2]


def test_page_count_equals_section_count(docs):
    d = docs("<h2>x</h2><h1>A</h1>", "<p><img src='a'></p><h1>B</h1>", "<h1>C</h1>", "<h5>t</h5>")
    fl = R.flow(K.elements(d))
    s = R.sections(fl, d)
    assert s.count() == R.pages(s).count() == 6


def test_heading_tags(docs):
    d = docs("<h1>Normativa [2024]</h1>", "<h2>Uno <b>[Acordeón]</b>.</h2>", "<h2>Dos [acordion]</h2>", "<h2>Tres [Subpágina]</h2>",
             "<h1>[Subpágina]</h1>", "<h1>Cuatro [3º nivel]&nbsp;</h1>")
    r = H.parse(d).orderBy("doc_id").collect()
    assert [x.html for x in r] == [
        "<h1>Normativa [2024]</h1>", '<h2 data-structure-tag="acordeon">Uno<b></b></h2>', "<h2>Dos [acordion]</h2>", "<h2>Tres</h2>",
        "<h1>[Subpágina]</h1>", '<h1 data-structure-tag="3er-nivel">Cuatro</h1>']
    assert [[i.kind for i in x.issues] for x in r] == [[], [], ["heading-tag-typo"], ["heading-tag-wrong-level"], ["heading-tag-only"], []]


def test_page_hrefs_with_natural_numbers(spark):
    titles = ["Inicio", "Tema", "Tema 2", "Tema", "Tema", "???", "Tema 2"]
    p = spark.createDataFrame([(1, i, t, 1, None) for i, t in enumerate(titles)], "doc_id bigint, page_idx int, title string, level int, parent_idx int")
    got = [r.href for r in N.page_hrefs(p).orderBy("page_idx").collect()]
    assert got == ["index.html", "html/tema.html", "html/tema-2.html", "html/tema-3.html", "html/tema-4.html", "html/pagina-6.html", "html/tema-2-2.html"]


def test_sanitize(docs):
    d = docs('<p><b>x</b><span style="a">y</span><i></i></p>', '<div class="sem_pie k"><p>z</p></div><div>w</div>',
             '<ol start="3" class="q"><li>1</li></ol><a>no</a><a href="http://e.com">si</a>', "<h1>t</h1><img><img src='a&amp;b' width='x' height='4'>")
    got = [r.html for r in Q.sanitize_docs(d).orderBy("doc_id").collect()]
    assert got == ["<p><strong>x</strong>y</p>", '<div class="sem_pie"><p>z</p></div>w',
                   '<ol start="3"><li>1</li></ol>no<a href="http://e.com" target="_blank" rel="noopener noreferrer">si</a>',
                   't<img src="a&amp;b" height="4" />']


def test_rows_do_not_depend_on_partitioning(spark, docs):
    from quire.operators import issues as S
    d = docs(*[f"<p>[ejemplo]</p><h2>h{i}</h2><p>[fin]</p><p>[fin]</p>" for i in range(20)])
    a = S.detect(d.repartition(1)).exceptAll(S.detect(d.repartition(7, F.rand(1))))
    assert a.count() == 0


def test_structure_is_one_flow(spark):
    """Pages, blocks and texts read the documents once, tokenise once and shuffle once."""
    import __spark_entry__ as entry
    for name in ("default_fill", "heading_mode_blocks", "sink_page_html", "sink_print_html", "render_summary", "parse_structure", "structure_choices"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and plan.count("Exchange ") == 1 and plan.count(K.TOKEN) == 1, name


def test_outline_and_its_parts_agree(docs):
    """Both ways to the same pages: straight from documents, and from elements with the documents beside them."""
    d = docs("<h3><img src='a'></h3><h1>A</h1><h2>x</h2>", "", None, "<h1></h1>", "<h1>A</h1><h2 data-structure-tag='acordeon'>x</h2><p>y</p>", "<h2>x</h2>")
    rows = R.outline_of(d)
    pages, blocks = R.build(d, K.elements(d))
    cols = ["doc_id", "page_idx", "title", "level", "h1_ord", "parent_idx"]
    assert sorted(map(tuple, rows.select(cols).collect())) == sorted(map(tuple, pages.select(cols).collect()))
    assert sorted(map(tuple, R.page_blocks(rows).collect())) == sorted(map(tuple, blocks.collect()))
    assert [(r.doc_id, r.title) for r in pages.orderBy("doc_id", "page_idx").collect()] == [
        (0, "Contenido"), (0, "A"), (1, "Contenido"), (2, "Contenido"), (3, "Contenido"), (4, "A"), (5, "Contenido")]
    p, b = R.heading_mode_pages(K.elements(d), d, h2="page", h3="page")
    q = R.heading_outline(K.elements(d, own=F.col("filename")), h2="page", h3="page")
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, q.drop("blocks").collect()))
    assert sorted(map(tuple, b.collect())) == sorted(map(tuple, R.page_blocks(q).collect()))
    assert {(r.doc_id, r.title) for r in p.collect()} >= {(1, "f1"), (2, "f2"), (3, "f3")}


def test_many_colliding_pages_are_named_in_linear_time(spark):
    titles = ["Inicio"] + ["Tema", "Tema 2"] * 5000
    p = spark.createDataFrame([(1, i, t, 1, None) for i, t in enumerate(titles)], "doc_id bigint, page_idx int, title string, level int, parent_idx int")
    got = [r.href for r in N.page_hrefs(p).orderBy("page_idx").collect()]
    assert got[:6] == ["index.html", "html/tema.html", "html/tema-2.html", "html/tema-3.html", "html/tema-2-2.html", "html/tema-4.html"]
    assert len(set(got)) == len(titles)


def test_blocks_of_headings_come_from_one_flow(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["heading_media_place"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange ") == 1 and plan.count(K.TOKEN) == 1


def test_texts_read_as_before(spark):
    """White space and tags, whatever their characters: shorter ways to the same texts."""
    import re
    from quire import fixed
    from quire.functions import text as T
    ws = re.sub(r"\\x\{(....)\}", r"\\u\1", fixed.WS).replace(r"\s", " \\t\\n\\x0b\\f\\r")
    texts = ["", " ", "  a", "a \n", "\u00a0a\u3000 b", "a b", "a\tb", "a  b", "é ñ\u2003\ufeffç ", "𝄞 \u2028𝄞", "\x1c a\x85", "a & b", "x\u200bx"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", T.collapse(F.col("t")).alias("c"), T.strip(F.col("t")).alias("s"), T.is_blank(F.col("t")).alias("b")).orderBy("i").collect()
    for r, t in zip(got, texts):
        assert r.c == re.sub(ws + "+", " ", t).strip(" ") and r.s == re.sub(f"^{ws}+|{ws}+$", "", t) and r.b == (r.s == ""), repr(t)
    tags = spark.createDataFrame([("<DIV CLASS='a'>",), ("</Li>",), ("<BR>",), ("<x/>",), ("<3>",), ("<",), ("[a]",), ("[a\nb]",), ("a",), ("<!DOCTYPE x>",)], "t string")
    kind, tag = K.classify(F.col("t"))
    assert [tuple(r) for r in tags.select(kind, tag).collect()] == [
        ("open", "div"), ("close", "li"), ("void", "br"), ("void", "x"), ("text", None), ("text", None), ("bracket", None), ("text", None), ("text", None), ("open", "!doctype")]
