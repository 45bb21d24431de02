from quire.operators import issues as S
from quire.operators import markers as M
from quire.operators import tokens as K


def html_of(df):
    return [r.html for r in df.orderBy("doc_id").collect()]


def test_normalize_golden_and_idempotent(docs):
    cases = {
        '<p>[ejem<a id="b1"></a>plo]</p>': "<p>[ejemplo]</p>",
        "<p>[<em>pie</em>]</p>": "<p>[pie]</p>",
        "<p><strong><em>[fin]</em></strong></p>": "<p>[fin]</p>",
        "<p>[ejemplo] Texto [fin]</p>": "<p>[ejemplo]</p><p>Texto</p><p>[fin]</p>",
        '<p style="x:1">[horizontal]<br />resto</p>': '<p>[horizontal]</p><p style="x:1">resto</p>',
        "<p>[nota <b>1</b>]</p>": "<p>[nota <b>1</b>]</p>",
        "<p>línea<br />[vídeo:] t</p>": "<p>línea<br />[vídeo:] t</p>",
        '<p style="x">[ejemplo][fin]</p>': "<p>[ejemplo]</p><p>[fin]</p>",
        "<p>  [ FIN ]  </p>": "<p>  [ FIN ]  </p>",
    }
    once = M.normalize_markers(docs(*cases))
    assert html_of(once) == list(cases.values())
    assert html_of(M.normalize_markers(once)) == list(cases.values())


def test_boxes(docs):
    d = docs(
        "<p>[ejemplo]</p><p>A</p><p>[fin]</p>",
        "<p>[ejemplo]</p><h2>x</h2><p>[pie]</p><p>B</p><p>[fin]</p>",       # a heading is a wall
        "<p>[ejemplo]</p><p>[pie]</p><p>A</p><p>[fin]</p>",                 # the first opening wins
        "<ul><li>[ejemplo] dentro [fin]</li></ul>",                          # inline
        "<ul><li>[ejemplo] uno</li><li>dos [fin]</li></ul>",                 # crosses a block: none
        "<pre>[ejemplo]</pre><p>[fin]</p>",
        "<blockquote><p>[pie]</p><p>q</p><p>[fin]</p></blockquote>",
    )
    assert html_of(K.untokenize(M.form_boxes(K.tokens(d)))) == [
        '<div class="sem_ejemplo"><p>A</p></div>',
        '<p>[ejemplo]</p><h2>x</h2><div class="sem_pie"><p>B</p></div>',
        '<div class="sem_ejemplo"><p>[pie]</p><p>A</p></div>',
        '<ul><li><div class="sem_ejemplo"> dentro </div></li></ul>',
        "<ul><li>[ejemplo] uno</li><li>dos [fin]</li></ul>",
        "<pre>[ejemplo]</pre><p>[fin]</p>",
        '<blockquote><div class="sem_pie"><p>q</p></div></blockquote>',
    ]


def test_issue_kinds(docs):
    cases = [
        ("<p>[ejemplo]</p><p>A</p><p>[fin]</p><p>[definicion]</p><p>B</p><p>[fin]</p>", []),
        ("<p>[ejemplo]</p><p>A</p><p>[definicion]</p><p>B</p><p>[fin]</p>", ["unclosed-box"]),
        ("<p>Texto</p><p>[fin]</p><p>Más texto</p>", ["stray-fin"]),
        ("<p>[ejem<a id='b1'></a>plo]</p><p>A</p><p>[fin]</p>", []),
        ("<p>[pie]</p><h3>T</h3><p>[fin]</p>", ["heading-inside-box"]),
        ("<ul><li>[ejemplo] uno</li><li>dos [fin]</li></ul>", ["box-not-formable"]),
        ("<p>[horizontal]</p><p>no</p><table><tr><td>x</td></tr></table>", ["table-marker"]),
        ("<table><tr><td>x</td></tr></table>", ["table-without-marker"]),
        ("<p>[vertical]</p><table><tr><td><table><tr><td>y</td></tr></table></td></tr></table>", []),
        ("<ul><li>[fin-acordeon]</li></ul>", ["accordion-marker"]),
        ("<p>[FIN ACORDEÓN]</p>", []),
        ("<p>[vídeo:]</p>", ["resource-marker"]),
        ("<p>mira [enlace:] esto</p>", ["resource-marker"]),
        ("<p>a<br />[video:] t</p>", []),
        ("<p><code>[fin]</code></p>", []),
        ("", []),
    ]
    found = {}
    for r in S.detect(docs(*[h for h, _ in cases])).orderBy("doc_id", "family", "ord").collect():
        found.setdefault(r.doc_id, []).append(r.kind)
    assert [found.get(i, []) for i in range(len(cases))] == [k for _, k in cases]


def test_tables_lists_resources(docs):
    d = docs(
        '<p>[vertical]</p><table class="t"><tbody><tr><td>a</td><td>b</td></tr></tbody></table>',
        "<table><thead><tr><th>a</th></tr></thead><tr><td colspan=\"2\"><table><tr><td>n</td></tr></table></td></tr></table>",
        "<ol><li>1</li><li>2</li></ol><p>x</p><ol><li>3</li></ol><h2>r</h2><ol><li>1</li></ol>",
        '<ol start="5"><li>1</li></ol><p>x</p><ol><li>2</li></ol><ul><li>u</li></ul><ol><li>1</li></ol>',
        "<p>[documento:] Guía</p><ul><li>[Vídeo:] uno</li></ul><p>[enlace] no</p>",
    )
    out = html_of(M.apply_passes(d))
    assert out[0] == ('<table class="t sem_tabla_vertical"><tbody><tr><th scope="row">a</th><td>b</td></tr></tbody></table>')
    assert out[1] == ('<table class="sem_tabla_horizontal"><thead><tr><th scope="col">a</th></tr></thead><tbody><tr><td colspan="2">'
                      '<table class="sem_tabla_horizontal"><thead><tr><th scope="col">n</th></tr></thead></table></td></tr></tbody></table>')
    assert out[2] == '<ol><li>1</li><li>2</li></ol><p>x</p><ol start="3"><li>3</li></ol><h2>r</h2><ol><li>1</li></ol>'
    assert out[3] == '<ol start="5"><li>1</li></ol><p>x</p><ol start="6"><li>2</li></ol><ul><li>u</li></ul><ol><li>1</li></ol>'
    assert out[4] == ('<p class="sem_recurso sem_recurso_documento">Guía</p><ul><li class="sem_recurso sem_recurso_video">uno</li></ul>'
                      "<p>[enlace] no</p>")
    again = M.structure_tables(K.tokens(M.apply_passes(d)))
    assert html_of(K.untokenize(again))[:1] == out[:1]
