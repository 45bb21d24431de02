"""Inputs outside the generated corpus: long tags, attributes, entities, nested blocks, deep trees, tables in several files."""

from pyspark.sql import functions as F

from quire.functions import images as I
from quire.operators import legacy as E
from quire.operators import markers as M
from quire.operators import nav as N
from quire.plans.stream_queries import stream_structure_memory


def passes(docs, *htmls):
    return [r.html for r in M.apply_passes(docs(*htmls)).orderBy("doc_id").collect()]


def test_passes_on_odd_markup(docs):
    long = f'<p style="{"x" * 500}">[fin]</p>'
    got = passes(
        docs, long, "<p>a [pie]x<br />[enlace:] y[fin] b</p>",
        '<table><tr><td>1</td><td class="c">2</td></tr><tr><td class="c" style="b" scope="row">3</td><th class="q" colspan="2">4</th></tr></table>',
        "<p>&lt;http://x.com&gt; http://x.com&nbsp;next http://c/?q&amp;</p>",
        '<li><p>txt</p><img width="1" style="a:b" data-w="12" data-h="7"></li>',
        '<p class="k">a<br />[enlace:] y<br />z</p><p><br />[vídeo:] q</p>', "", None)
    assert got[0] == long
    assert '<div class="sem_pie">' in got[1] and 'class="sem_recurso sem_recurso_enlace"' in got[1]
    assert '<td class="c" style="b">3</td><td colspan="2">4</td>' in got[2]
    assert '&lt;<a href="http://x.com" ' in got[3] and "</a>&gt; " in got[3] and "</a>&nbsp;next" in got[3] and ">http://c/?q&amp;</a>" in got[3]
    assert got[4] == '<li><p>txt</p><img class="sem_img_inline" width="12" height="7" style="a:b;width:12px;height:7px" /></li>'
    assert got[5] == '<p class="k">a</p><p class="k sem_recurso sem_recurso_enlace">y<br />z</p><p class="sem_recurso sem_recurso_video">q</p>'


def test_jpeg_frame_after_64_kb(spark):
    segment = b"\xff\xe1\xff\xff" + b"\x00" * 65533
    jpeg = b"\xff\xd8" + segment * 2 + b"\xff\xc0\x00\x11\x08\x00\x05\x00\x09\x03" + b"\x00" * 12
    d = spark.createDataFrame([(bytearray(jpeg),)], "b binary")
    size = d.select(I.image_size(F.col("b"), F.lit("jpg")).alias("s"), I.image_size(F.col("b"), F.lit("jpg"), 65536).alias("t")).first()
    assert (size.s.width, size.s.height, size.t) == (9, 5, None)


def test_page_order_of_a_large_and_deep_package():
    import pyarrow as pa
    edges = [{"owner": 0, "sib": i, "target": i + 1} for i in range(2500)] + [{"owner": 5, "sib": 0, "target": 9000}, {"owner": 9000, "sib": 0, "target": 5}]
    edges += [{"owner": n, "sib": 1, "target": n + 1} for n in range(9000, 12000)]
    kind = pa.list_(pa.struct([("owner", pa.int32()), ("sib", pa.int32()), ("target", pa.int32())]))
    ints, roots = pa.list_(pa.int32()), pa.list_(pa.struct([("owner", pa.int32()), ("target", pa.int32())]))
    known = [*range(2501), *range(9000, 12001)]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array([edges, [], []], kind), pa.array([[{"owner": 20000, "target": 0}], [], []], roots),
                                        pa.array([known, [4, 2], []], ints), pa.array([20000, None, None], pa.int32())],
                                       names=["doc_id", "edge", "root", "node", "package"])
    (out,) = E._walk([batch])
    big, flat, none = out.column(1).to_pylist()
    assert len(big) == 1 + 2500 + 3001 and max(p["depth"] for p in big) == 3002
    assert [p["node"] for p in big[:8]] == [0, 1, 2, 3, 4, 5, 9000, 9001] and [p["page_ord"] for p in big] == list(range(len(big)))
    assert [(p["node"], p["depth"]) for p in flat] == [(2, 0), (4, 0)] and none == []


def test_menu_paths_are_never_cut(spark):
    p = spark.createDataFrame([(1, 0, None, "a"), (1, 1, 0, "b")], "doc_id long, page_idx int, parent_idx int, title string")
    assert [r.path for r in N.nav_tree(p).orderBy("path").collect()] == ["000000", "000000/000001"]


def test_streams_read_tables_of_several_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(f"{tmp_path}/one/documents.parquet")
    docs.repartition(3, "doc_id").write.parquet(f"{tmp_path}/three/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    one, three, none = (sorted(map(tuple, stream_structure_memory(spark, f"{tmp_path}/{n}").select("owner", "shape").collect())) for n in ("one", "three", "none"))
    assert len(one) > 0 and len(three) > 0 and none == []
