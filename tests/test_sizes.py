"""What a worker or a task holds does not grow with the rows it is given."""

import pyarrow as pa

from quire.operators import legacy as E


def test_elements_of_many_packages_leave_the_worker_in_parts():
    xml = '<instance class="p" reference="1"><dictionary>' + '<string role="key" value="a"/><unicode>x &amp; y</unicode>' * 200 + "</dictionary></instance>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array([xml] * 499 + [None])], names=["doc_id", "xml"])
    out = list(E._relate(iter([batch])))
    assert len(out) > 5 and max(b.num_rows for b in out) < E.FLUSH_ELEMENTS + 402
    assert sum(b.num_rows for b in out) == 499 * 402 and out[0].column("doc_id").to_pylist()[401:403] == [0, 1]
    assert out[0].column("key").to_pylist()[:5] == [None, None, None, "a", None]


def test_packages_reach_python_by_bytes(spark):
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m"


def test_references_meet_their_instances_in_one_reading(spark):
    xml = ('<instance class="p" reference="1"><dictionary><string role="key" value="a"/><reference key="2"/><string role="key" value="b"/><reference key="2"/>'
           '<string role="key" value="c"/><reference key="9"/><string role="key" value="d"/><instance reference="2"/></dictionary></instance>')
    rows = spark.createDataFrame([(1, xml), (2, xml), (2, xml), (None, xml)], "doc_id bigint, xml string")
    found = E.references(E.xml_nodes(rows))
    assert sorted((r.doc_id, r.ref_key, r["class"]) for r in found.collect()) == [(1, "2", None)] * 2 + [(2, "2", None)] * 8
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_documents_are_dealt_by_bytes_before_they_become_tokens(spark, tmp_path):
    from pyspark.sql import functions as F
    from quire.plans import corpus as C
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.sha2((F.col("id") * 1000 + i).cast("string"), 256)), "\n")
    spark.range(800).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    parts = C.placed(spark, str(tmp_path)).withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.sum(F.length("text")).alias("n"))
    assert parts.agg(F.max("n")).first()[0] < 4e6


def test_entries_leave_the_worker_in_parts():
    import io
    import zipfile

    from quire.sources import archive as A
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for i in range(8):
            z.writestr(f"{i}.txt", bytes(1 << 20))
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "none"]), pa.array([buf.getvalue(), None], pa.binary())], names=["path", "content"])
    out = list(A._reader(None)(iter([batch])))
    assert max(b.nbytes for b in out) < 3 << 20 and sum(b.num_rows for b in out) == 9
    assert out[-1].to_pylist()[-1] == {"path": "none", "entry": None, "entry_ord": None, "content": None, "error": A.NO_ARCHIVE}


def test_neighbours_need_no_second_placing(spark):
    import __spark_entry__ as entry
    df = entry.queries()["page_prev_next"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert "_before" not in df.columns


def _plan(spark, name):
    import __spark_entry__ as entry
    return entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_ranges_of_sections_come_from_one_flow(spark):
    from quire.operators import tokens as K
    plan = _plan(spark, "section_ranges")
    assert plan.count(K.TOKEN) == 1 and plan.count("Exchange ") == 1


def test_list_items_come_from_one_tokenising(spark):
    from quire.operators import content as Q
    from quire.operators import tokens as K
    assert _plan(spark, "list_flatten").count(K.TOKEN) == 1
    codes = [Q.OL, Q.ITEM, 0, Q.UL, Q.ITEM, Q.OL, Q.END, Q.END, Q.END, Q.OL]
    assert Q.walk_lists(range(10), codes)[2::2] == [(1, 1, 1), (2, 0, 4), (2, 0, 4), (0, 0, None)]
    assert Q.walk_lists([0, 0, 1, 1], [Q.OL, Q.OL, Q.ITEM, Q.ITEM]) == [(1, 1, None), (1, 1, None), (1, 1, 1), (1, 1, 1)]


def test_recalled_choices_need_no_second_tokenising(spark):
    from quire.operators import tokens as K
    assert _plan(spark, "recall_applied").count(K.TOKEN) == 0  # the sections are stored


def test_a_heading_tag_is_looked_up_once(spark):
    from pyspark.sql import functions as F
    from quire.operators import heading_tags as H
    assert str(H.parse_heading(F.col("h"))).lower().count("levenshtein") == 1


def test_roles_are_applied_in_one_reading(spark):
    assert _plan(spark, "apply_roles").count("Scan parquet") == 2  # the lines and the style sheets


def test_list_starts_sort_a_document_once(spark):
    assert _plan(spark, "list_continue").count("Sort [") == 1
