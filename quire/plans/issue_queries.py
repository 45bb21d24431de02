"""Queries over author markers: normalisation, issues, heading tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import heading_tags as H
from ..operators import issues as S
from ..operators import markers as M
from . import corpus as C
from .registry import query

# --- checks -----------------------------------------------------------------------------

# text after and before each element's marker; `html_split` is the element after lines
# with resource markers have been set apart
CTX_SQL = C.EL_SQL + """,
sp as (
  select *, replace(replace(html, '<br />[documento:]', '</p><p>[documento:]'), '<p></p><p>[documento:]', '<p>[documento:]') as html_split,
    case when tag = 'p' and mark is not null then mark end as lone
  from el
),
ctx as (
  select *, substr(html, strpos(html, ']') + 1) || coalesce(string_agg(html, '') over nx, '') as after_src,
    substr(html_split, strpos(html_split, ']') + 1) || coalesce(string_agg(html_split, '') over nx, '') as after_split,
    coalesce(string_agg(html_split, '') over pv, '') || substr(html_split, 1, strpos(html_split, '[') - 1) as before_split,
    substr(html, 8) || coalesce(string_agg(html, '') over nx, '') as after_table,
    lead(k) over w as next_k, lag(k) over w as prev_k
  from sp
  window w as (partition by doc_id order by pos),
         nx as (partition by doc_id order by pos rows between 1 following and 80 following),
         pv as (partition by doc_id order by pos rows between 80 preceding and 1 preceding)
)"""

BOX_SQL = CTX_SQL + f""",
bm as (
  select doc_id, pos, mark, {C.context_after('after_src')} as ctx,
    (row_number() over w - 1)::INT as ord, lag(mark) over w as prev, lead(mark) over w as nxt, lead(pos) over w as nxt_pos
  from ctx where mark is not null window w as (partition by doc_id order by pos)
),
hb as (
  select b.doc_id, b.ord, b.mark, arg_min(e.html, e.pos) as head
  from bm b join el e on e.doc_id = b.doc_id and e.pos > b.pos and e.pos < b.nxt_pos and e.level is not null
  where b.mark <> 'fin' and b.nxt = 'fin' group by all
),
box_issues as (
  select doc_id, (ord + 1)::INT as ord, 'unclosed-box' as kind, mark as label, ctx as context
  from bm where mark <> 'fin' and (nxt is null or nxt <> 'fin')
  union all
  select doc_id, ord, 'stray-fin', null, ctx from bm where mark = 'fin' and (prev is null or prev = 'fin')
  union all
  select doc_id, (ord + 1)::INT, 'heading-inside-box', mark, substr({C.untagged('head')}, 1, 60) from hb
)"""

# boxes: a closing paragraph and the first opening one after the last boundary before it
FORM_SQL = """,
edges as (
  select *, coalesce(max(case when level is not null or lone = 'fin' then pos end) over (
      partition by doc_id order by pos rows between unbounded preceding and 1 preceding), -1) as edge
  from sp
),
formed as (
  select f.doc_id, f.pos as close_pos, min(o.pos) as open_pos
  from edges f join edges o on o.doc_id = f.doc_id and o.pos > f.edge and o.pos < f.pos and o.lone <> 'fin'
  where f.lone = 'fin' group by f.doc_id, f.pos
),
form_el as (
  select e.*, o.open_pos is not null as opens, c.close_pos is not null as closes,
    case when o.open_pos is not null then '<div class="sem_' || strip_accents(e.mark) || '">'
         when c.close_pos is not null then '</div>' else e.html end as html_formed
  from sp e left join formed o on o.doc_id = e.doc_id and o.open_pos = e.pos
            left join formed c on c.doc_id = e.doc_id and c.close_pos = e.pos
)"""

LEFT_SQL = FORM_SQL + f""",
left_ctx as (
  select *, substr(html_formed, strpos(html_formed, ']') + 1) || coalesce(string_agg(html_formed, '') over (
      partition by doc_id order by pos rows between 1 following and 80 following), '') as after_formed
  from form_el where doc_id not in (select doc_id from box_issues)
),
left_issues as (
  select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::INT as ord, 'box-not-formable' as kind,
    mark as label, {C.context_after('after_formed')} as context
  from left_ctx where mark <> 'fin' and not opens
)"""

TABLE_SQL = f""",
tm as (
  select *, case k when 10 then 'horizontal' else 'vertical' end as marker,
    (row_number() over (partition by doc_id order by pos) - 1)::INT as ord
  from ctx where k in (10, 12)
),
table_issues as (
  select doc_id, ord, 'table-marker' as kind, marker, {C.context_after('after_src')} as context
  from tm where next_k is null or next_k <> 11
),
tb as (
  select *, max(case when k in (10, 12) then pos end) over p as last_mark, max(case when k = 11 then pos end) over p as last_table,
    sum(case when k = 11 then 1 else 0 end) over p as n_before
  from ctx window p as (partition by doc_id order by pos rows between unbounded preceding and 1 preceding)
),
unmarked_issues as (
  select doc_id, coalesce(n_before, 0)::INT as ord, 'table-without-marker' as kind, {C.context_after('after_table')} as context
  from tb where k = 11 and (last_mark is null or coalesce(last_table, -1) > last_mark)
)"""


def _either(after, before):
    return f"case when {C.context_after(after)} <> '' then {C.context_after(after)} else {C.context_before(before)} end"


END_SQL = f""",
ge as (select *, (row_number() over (partition by doc_id order by pos) - 1)::INT as ord from ctx where k = 17),
end_issues as (
  select doc_id, ord, 'accordion-marker' as kind, 'fin acordeón' as marker, {_either('after_src', 'before_split')} as context
  from ge where pos % 3 = 0
),
rm as (select *, (row_number() over (partition by doc_id order by pos) - 1)::INT as ord from ctx where k = 13),
resource_issues as (
  select doc_id, ord, 'resource-marker' as kind, case when pos % 4 = 0 then 'enlace' else 'vídeo' end as marker,
    {_either('after_split', 'before_split')} as context
  from rm where pos % 4 = 0 or (pos % 4 in (2, 3) and txt = '')
)"""

ALL_SQL = """,
all_issues as (
  select doc_id, 0 as family, ord, kind, label, null::VARCHAR as marker, context from box_issues
  union all select doc_id, 1, ord, kind, label, null, context from left_issues
  union all select doc_id, 2, ord, kind, null, marker, context from table_issues
  union all select doc_id, 3, ord, kind, null, null, context from unmarked_issues
  union all select doc_id, 4, ord, kind, null, marker, context from end_issues
  union all select doc_id, 5, ord, kind, null, marker, context from resource_issues
)"""

FULL_SQL = BOX_SQL + LEFT_SQL + TABLE_SQL + END_SQL + ALL_SQL


def _family(name, *cols):
    return lambda spark, sf: S.detect(C.marked_docs(spark, sf) if name == "unformable" else C.marked_rows(spark, sf), [name], placed=True).select("doc_id", "ord", *cols)


def _box(kind):
    return lambda spark, sf: (S.detect(C.marked_rows(spark, sf), ["box"]).filter(F.col("kind") == kind)
                              .select("doc_id", "ord", "label", "context"))


for key, kind in (("issue_unclosed_box", "unclosed-box"), ("issue_stray_fin", "stray-fin"),
                  ("issue_heading_in_box", "heading-inside-box")):
    query(key, C.with_sql(BOX_SQL) + f"select doc_id, ord, label, context from box_issues where kind = '{kind}'")(_box(kind))

query("issue_box_not_formable", C.with_sql(BOX_SQL + LEFT_SQL) + "select doc_id, ord, label, context from left_issues")(
    _family("unformable", "label", "context"))
query("issue_table_marker", C.with_sql(CTX_SQL + TABLE_SQL) + "select doc_id, ord, marker, context from table_issues")(
    _family("table", "marker", "context"))
query("issue_table_unmarked", C.with_sql(CTX_SQL + TABLE_SQL) + "select doc_id, ord, context from unmarked_issues")(
    _family("unmarked", "context"))
query("issue_group_end", C.with_sql(CTX_SQL + END_SQL) + "select doc_id, ord, marker, context from end_issues")(
    _family("group-end", "marker", "context"))
query("issue_resource_marker", C.with_sql(CTX_SQL + END_SQL) + "select doc_id, ord, marker, context from resource_issues")(
    _family("resource", "marker", "context"))


@query("issue_counts", C.with_sql(BOX_SQL) + "select kind, label, count(*) as n from box_issues group by kind, label")
def issue_counts(spark, sf):
    return S.detect(C.marked_rows(spark, sf), ["box"]).groupBy("kind", "label").agg(F.count("*").alias("n"))


def _message_sql():
    q = lambda x: x.replace("'", "''")
    near = "(case when context <> '' then ' (cerca de «' || context || '»)' else '' end)"
    near_text = "(case when context <> '' then ' (cerca del texto «' || context || '»)' else '' end)"
    whens = []
    for kind, msg in fixed.ISSUE_MESSAGES.items():
        expr = f"'{q(msg)}'"
        for slot, val in (("%1$s", "coalesce(label, '')"), ("%2$s", "coalesce(marker, '')"), ("%3$s", near),
                          ("%5$s", near_text), ("%4$s", "context")):
            if slot in msg:
                a, b = expr.split(slot, 1)
                expr = f"{a}' || {val} || '{b}"
        whens.append(f"when '{kind}' then {expr}")
    return "case kind " + " ".join(whens) + " end"


@query("issue_messages", C.with_sql(FULL_SQL) + f"select doc_id, family, ord, {_message_sql()} as message from all_issues")
def issue_messages(spark, sf):
    return S.describe(S.detect(C.marked_docs(spark, sf), placed=True)).select("doc_id", "family", "ord", "message")


@query("has_issues", C.with_sql(FULL_SQL) + """select doc_id, doc_id in (select doc_id from all_issues) as has_issues
from documents""")
def has_issues(spark, sf):
    d = C.marked_docs(spark, sf)
    return S.has_issues(d, S.detect(d, placed=True))


# --- heading tags ---------------------------------------------------------------------

FORMS_VALUES = ", ".join(f"('{f}', '{k}', '{lb}', {h}, {i})" for f, k, lb, h, i in H.FORMS)
N_FORMS = len(H.FORMS)
_FORM_LIST = ", ".join(f"'{f}'" for f, *_ in H.FORMS)

TAG_CASE = f"""'<h' || CAST(k - 6 AS STRING) || '>' || (case when line_no % 11 = 0 then '' else
    replace(replace(replace(txt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') end) || ' [' || written || ']</h' || CAST(k - 6 AS STRING) || '>'"""
# every other form loses one letter; every fifth bracket holds a year instead
WRITTEN = """case when (doc_id + line_no) % 5 = 4 then '2024' when line_no % 2 = 0 then form
    else substr(form, 1, CAST(line_no % length(form) AS INT)) || substr(form, CAST(line_no % length(form) AS INT) + 2) end"""


def tagged_docs(spark, sf):
    rows = C.lines(spark, sf).filter("k in (7, 8, 9)")
    rows = rows.withColumn("form", F.expr(f"element_at(array({_FORM_LIST}), cast((doc_id + line_no) % {N_FORMS} as int) + 1)"))
    rows = rows.withColumn("written", F.expr(WRITTEN)).withColumn("h", F.expr(TAG_CASE))
    return rows.groupBy("doc_id", "source").agg(F.expr("listagg(h, '') within group (order by line_no)").alias("html"))


TAG_SQL = C.LINES_SQL + f""",
forms(form, key, label, heading, rank) as (values {FORMS_VALUES}),
tg as (
  select *, {WRITTEN} as written, (row_number() over (partition by doc_id order by line_no) - 1)::INT as ord
  from (select *, list_extract([{_FORM_LIST}], ((doc_id + line_no) % {N_FORMS})::INT + 1) as form from lines where k in (7, 8, 9))
),
near as (
  select t.doc_id, t.line_no, arg_min(f.label, levenshtein(t.written, f.form) * 100 + f.rank) as near_label
  from tg t, forms f
  where length(t.written) >= 5 and levenshtein(t.written, f.form) <= 2 and levenshtein(t.written, f.form) * 3 <= length(f.form)
  group by all
),
tags as (
  select t.*, f.key, f.label, f.heading, n.near_label,
    case when line_no % 11 = 0 then '' else {C.plain(C.escape_text('txt'))} end as title
  from tg t left join forms f on f.form = t.written left join near n using (doc_id, line_no)
),
tag_out as (
  select *, case when key is null then case when near_label is not null then 'heading-tag-typo' end
    when title = '' then 'heading-tag-only' when heading <> k - 6 then 'heading-tag-wrong-level' end as kind
  from tags
)"""


@query("heading_tag_parse", C.with_sql(TAG_SQL) + """
select doc_id, ord, kind, written, coalesce(label, near_label) as label, (k - 6)::INT as heading,
  case kind when 'heading-tag-typo' then trim(title || ' [' || written || ']') when 'heading-tag-only' then '' else title end as context
from tag_out where kind is not null""")
def heading_tag_parse(spark, sf):
    return H.parse(tagged_docs(spark, sf)).select("doc_id", F.inline_outer("issues")).filter("kind is not null")


@query("heading_tag_keys", C.with_sql(TAG_SQL) + """
select doc_id, key, count(*) as n from tag_out where key is not null and title <> '' and heading = k - 6 group by all""")
def heading_tag_keys(spark, sf):
    keys = F.regexp_extract_all("html", F.lit(f'{fixed.HEADING_TAG_ATTR}="([^"]+)"'), F.lit(1))
    return (H.parse(tagged_docs(spark, sf)).select("doc_id", F.explode_outer(keys).alias("key")).filter("key is not null")
            .groupBy("doc_id", "key").agg(F.count("*").alias("n")))


@query("heading_tag_typo", C.with_sql(TAG_SQL) + """
select doc_id, ord, written, near_label as label from tag_out where kind = 'heading-tag-typo'""")
def heading_tag_typo(spark, sf):
    return heading_tag_parse(spark, sf).filter("kind = 'heading-tag-typo'").select("doc_id", "ord", "written", "label")


@query("issues_union", C.with_sql(FULL_SQL + TAG_SQL.replace(C.LINES_SQL, "")) + """
select doc_id, family, ord, kind from all_issues
union all select doc_id, 6, ord, kind from tag_out where kind is not null""")
def issues_union(spark, sf):
    found = S.detect(C.marked_docs(spark, sf), placed=True)
    heads = S.heading_issue_rows(H.parse(tagged_docs(spark, sf)))
    return S.union_all(found, heads).select("doc_id", "family", "ord", "kind")
