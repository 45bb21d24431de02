"""The token passes in a document's row, beside the same passes as windows over all tokens."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.operators import fold
from quire.operators import legacy as E
from quire.operators import markers as M

SF = "/root/testdata/sf0.001"
MARKERS = ["[ejemplo]", "[Definición]", "[ pie ]", "[fin]", "[FIN]", "[fin\n]", "[fın]", "[horizontal]", "[Vertical]", "[horizontal\n]", "[vídeo:]", "[ENLACE :]", "[", "]", "[a b]", "[www.q.r]"]
TAGS = """<p>|</p>|<p class="k">|<P>|<p/>|<pé>|<h1>|</h1>|<div>|</div>|<ul>|</ul>|<ol>|</ol>|<ol start="5">|<ol start=' 7 '>|<ol start=x>|<li>|</li>|<li²>|<table>|</table>|<table class="sem_tabla_vertical">|
<table class="ésem_tabla_vertical">|<tr>|</tr>|<td>|</td>|<td colspan="2" rowspan='3'>|<td class=c scope=row>|<th scope="col" x>|</th>|<td/>|<thead>|</tbody>|<br>|<br />|<pre>|</pre>|<code>|</code>|<a href="http://e.x/?a=1&amp;b">|
</a>|<a href=" HTTPS://q" target='z'>|<img>|<img data-w="12" data-h='7' />|<img data-w=5 class="u" data-h=0>|<img src="data:image/png;base64,iVBORw0KGgoAAAANSUhEUgAAAAUAAAAHCAYAAADAp4fuAAAA" style="a:b">|
<img src="data:image/png;base64,!!">|</img>|<hr>|<blockquote>|</blockquote>|<section>|< 3>|<|<!-- c -->|<script>a<b</script>|<tablé>""".replace("\n", "").split("|")
TEXTS = ["a", "p", "/p", "hola ", " ", "\n", " ", "\u0085", "&nbsp;", "&amp;", "http://a.b/c?d=1&amp;e;", "https://x.y/&lt;z", "www.s.t.", "http://k.l\u0085", "é"]
WHOLE = ["<p>%s</p>", "<li>%s</li>", "<p>[ejemplo]</p>%s<p>[fin]</p>", "<p>[vertical]</p>%s<table><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></table>", "<p>a<br />[vídeo:] %s</p>", "<ol><li>%s</li></ol>"]


def odd(r: random.Random) -> str:
    x = r.random()
    if x < 0.4:
        return r.choice(WHOLE) % r.choice(MARKERS + TEXTS + TAGS)
    return r.choice(MARKERS if x < 0.55 else TEXTS if x < 0.7 else TAGS)


@pytest.mark.parametrize("copies", [1, 2])
def test_fold_is_the_windows(spark, copies):
    r = random.Random(copies)
    rows = [(i, "".join(odd(r) for _ in range(i % 37))) for i in range(1, 400)] * copies + [(1000, None), (1001, "")] + [(None, "<p>[pie]</p><ol><li>x</li></ol><p>[fin]</p>")] * copies
    docs = spark.createDataFrame(rows, "doc_id bigint, html string").coalesce(1)
    windows = M.apply_passes(docs, token_passes=[*M.TOKEN_PASSES, ("same", lambda t: t)])
    said = lambda d: {x.doc_id: x.html for x in d.collect()}
    was, now = said(windows), said(M.apply_passes(docs))
    assert len(was) > 350 and None in was and set(was) == set(now)
    assert [k for k in was if was[k] != now[k]] == []


@pytest.mark.parametrize("name", ["html_passes", "sink_marked_text"])
def test_passes_sort_no_tokens(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort [" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_lines_of_folded_documents(spark):
    docs = spark.createDataFrame([(1, '<p>[vertical]</p><table><tr><td>a</td></tr></table><p>[enlace:] see http://x.org.</p>'), (2, "<p>[pie]</p><p>b</p><p>[fin]</p>"),
                                  (2, "<p>[pie]</p><p>b</p><p>[fin]</p>"), (3, "")], "doc_id bigint, html string")
    lines = E.marked_lines(M.apply_passes(docs).withColumn("copies", F.lit(1))).orderBy("doc_id", "ord")
    assert [(r.doc_id, r.ord, r.style, r.text) for r in lines.collect() if r.doc_id == 1] == [
        (1, 0, "marker", "[vertical]"), (1, 1, "th", "a"), (1, 2, "p", "[enlace:] see http://x.org.")]
    windows = M.apply_passes(docs, token_passes=[*M.TOKEN_PASSES, ("same", lambda t: t)]).withColumn("copies", F.lit(1))
    assert lines.collect() == E.marked_lines(windows).orderBy("doc_id", "ord").collect()
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_passes_take_time_in_proportion():
    url = re.compile("http://[a-z]+")
    one = "<p>[ejemplo]</p> <p> x</p>\n<ol><li>y</li></ol><table><tr><td>1</td></tr></table><p>[fin]</p>"
    html, asked = fold.passes([one * 20_000], "sem_", url, url)
    assert asked == [] and html[0].count('<div class="sem_ejemplo">') == 20_000 and html[0].count(" start=") == 0
