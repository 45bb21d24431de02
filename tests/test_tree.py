"""The element stack and the lines written back from nested markup."""

import pytest

from quire.operators import legacy, tree

CASES = [
    ("<ul><li><p>a</p>tail</li></ul>", ["li:atail"]),
    ("<table><tr><td><p>c</p>x</td></tr></table>", ["marker:[horizontal]", "p:c", "p:x"]),
    ("<ul><li>a<ul><li>b<li>c</ul>d</li><li>e</ul>", ["li:ad", "li:b", "li:c", "li:e"]),
    ("<table class='sem_tabla_vertical'><tr><th>a<td>b<tr><td>c</table>d", ["marker:[vertical]", "th:a", "td:b", "td:c", "p:d"]),
    ("<blockquote>a<p>b</p>c</blockquote>d", ["p:a", "p:b", "p:c", "p:d"]),
    ("a <b>b</b> c &amp; [d] e", ["p:a", "p:b", "p:c & [d] e"]),
    ("<div>a <b>b</b></div><div>c<p>d</p></div>", ["p:a b", "p:c", "p:d"]),
    ("<div class='sem_ejemplo'><div class='sem_pie'>a</div></div><p>b", ["marker:[ejemplo]", "marker:[pie]", "p:a", "marker:[fin]", "marker:[fin]", "p:b"]),
    ("<div class='sem_ejemplo'><p>a", ["marker:[ejemplo]", "p:a", "marker:[fin]"]),
    ("</p></div>a</li>b<p>c</div>d</p>e", ["p:ab", "p:cd", "p:e"]),
    ("<h1>a</h2>b<h3>c<h4>d", ["heading 2:a", "p:b", "heading 3:c", "heading 4:d"]),
    ("<ul>lost<li>a</li><p>lost</p></ul>", ["li:a"]),
    ("<pre>a\n  <b>b &lt;</b>\r\n\nc</pre>", ["pre:a", "pre:  b <", "pre:", "pre:c"]),
    ("<p>a<iframe src='u'></iframe>b</p><iframe src='u'>x</iframe><object></object>",
     ["p:ab", "marker:[Contenido incrustado omitido: u]", "marker:[Contenido incrustado omitido: sin URL]"]),
    ("<table><tr><td><table><tr><td>a</table>b</table>", ["marker:[horizontal]", "marker:[horizontal]", "td:a", "p:b"]),
    ("<ul><li class='sem_recurso_enlace'>a</li></ul><p class='x sem_recurso_video'>b</p><p class='sem_recurso_video'> </p>", ["li:[enlace:] a", "p:[vídeo:] b"]),
    ("", []), (None, []), ("<p></p><td></td></table>", []),
]


def test_lines_written_back(spark, docs):
    d = docs(*[h for h, _ in CASES])
    got = {}
    for r in legacy.marked_lines(d).orderBy("doc_id", "pos", "sub").collect():
        got.setdefault(r["doc_id"], []).append(f"{r['style']}:{r['text']}")
    for i, (html, want) in enumerate(CASES):
        assert got.get(i, []) == want, html


def test_every_text_keeps_its_owner(spark, docs):
    """Owners are open where the text stands, and elements lie within their parents."""
    d = docs(*[h for h, _ in CASES if h], "<div>" * 300 + "x" + "</div>" * 299)
    for doc in {r["doc_id"] for r in d.collect()}:
        rows = tree.element_tree(d.where(f"doc_id = {doc}")).orderBy("pos").collect()
        by_pos = {r["pos"]: r for r in rows}
        for r in rows:
            if r["owner"] != tree.ROOT:
                assert r["owner"] <= r["pos"] <= by_pos[r["owner"]]["close"]
            if r["kind"] == "open" and r["parent"] != tree.ROOT:
                assert by_pos[r["parent"]]["pos"] < r["pos"] and r["close"] <= by_pos[r["parent"]]["close"]


@pytest.mark.parametrize("html, tags", [("<p>a<p>b", ["p", "p"]), ("<table><tr><td><p>a<td>b", ["td", "td"])])
def test_implied_ends(spark, docs, html, tags):
    rows = [r for r in tree.element_tree(docs(html)).orderBy("pos").collect() if r["tag"] in tags and r["kind"] == "open"]
    assert rows[0]["close"] == rows[1]["pos"] and rows[0]["parent"] == rows[1]["parent"]


def test_lines_are_made_within_the_row(spark):
    """Documents are dealt once; only those that share an id are dealt again, and no token is."""
    import re

    import __spark_entry__ as entry
    plan = entry.queries()["sink_marked_nested"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"hashpartitioning\(doc_id#\d+L?, pos", plan) and "MapInArrow" not in plan
    assert plan.count("Window [row_number") == 1


def test_documents_of_one_id_write_on_the_same_lines(spark):
    one = "<p>a</p><ul><li>b<ul><li>c</ul>d</ul><div class='sem_pie'>e</div><pre>x\ny</pre>"
    rows = [(1, one), (2, one), (2, one), (None, one), (None, "<p>a</p>"), (None, None), (3, "")]
    got = {}
    for r in legacy.marked_lines(spark.createDataFrame(rows, "doc_id bigint, html string")).orderBy("doc_id", "ord").collect():
        got.setdefault(r["doc_id"], []).append((r["ord"], f"{r['style']}:{r['text']}"))
    want = ["p:a", "li:bd", "li:c", "marker:[pie]", "p:e", "marker:[fin]", "pre:x", "pre:y"]
    assert got[1] == list(enumerate(want)) and 3 not in got
    assert got[2] == list(enumerate(["p:aa", "li:bbdd", "li:cc", "marker:[pie][pie]", "p:ee", "marker:[fin][fin]", "pre:x", "pre:yx", "pre:y"]))
    assert got[None] == list(enumerate(["p:aa", *want[1:]]))
