"""Queries over archives, Word parts and legacy packages.

The files are made by Spark from the given tables, so their number and size grow with
them; the readers see nothing but bytes or XML.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .. import fixed
from ..functions import text as T
from ..operators import content as Q
from ..operators import legacy as E
from ..operators import markers as M
from ..operators import memory as Y
from ..operators import tokens as K
from ..sources import archive as A
from ..sources import docx as D
from ..sources import files as FS
from ..streaming import workspace
from . import corpus as C
from .issue_queries import CTX_SQL, FORM_SQL
from .registry import query, table
from .pass_queries import clean_docs

ESC = "replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _zip(names, bodies):
    """Archives from parallel lists of entry names and texts (a function made here travels
    to the workers whole, so they need not have this package)."""
    def pack(ns: pa.Array, bs: pa.Array) -> pa.Array:
        import io
        import zipfile
        out = []
        for entry_names, texts in zip(ns, bs):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                for n, b in zip(entry_names.as_py(), texts.as_py()):
                    z.writestr(n, b)
            out.append(buf.getvalue())
        return pa.array(out, pa.binary())
    return F.arrow_udf(pack, BinaryType())(names, bodies)


# --- word files -----------------------------------------------------------------------------

PARA = """'<w:p><w:pPr><w:pStyle w:val="S' || cast({i} % 4 as string) || '"/>' || (case when {i} % 5 = 1 then '<w:numPr/>' else '' end) ||
  '<w:ind w:left="' || cast({i} * 37 as string) || '" w:firstLine="' || cast({i} * 11 as string) || '"' || (case when {i} % 3 = 0 then ' w:hanging="' || cast({i} * 13 as string) || '"' else '' end) || '/></w:pPr>' ||
  (case when {i} % 6 = 2 then '<w:hyperlink w:anchor="_Toc' || cast({i} as string) || '&quot; x"><w:r><w:t>link</w:t></w:r></w:hyperlink>' else '' end) ||
  (case when {i} % 7 = 3 then '<mc:Fallback><wp:inline><a:blip r:embed="r"/></wp:inline></mc:Fallback><w:drawing><wp:inline><wp:extent cx="' || cast({i} * 95250 as string) || '" cy="19050"/><a:blip r:embed="rId1"/></wp:inline></w:drawing>' else '' end) ||
  '<w:r><w:t xml:space="preserve">' || """ + ESC + """ || '</w:t></w:r></w:p>'"""
TBL = "'<w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>' || cast({i} as string) || '</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'"


def word_xml(spark, sf):
    """(doc, xml): body parts, one paragraph per line and a table after every tenth."""
    one = (PARA.format(i="i", t="trim(t)") + " || (case when i % 10 = 9 then " + TBL.format(i="i") + " else '' end)")
    return C.placed(spark, sf).select(F.col("doc_id").alias("doc"), F.concat(
        F.lit('<?xml version="1.0"?><w:document><w:body>'), F.array_join(F.expr(f"transform(split(text, '\\n'), (t, i) -> {one})"), ""),
        F.lit("<w:sectPr/></w:body></w:document>")).alias("xml"))


PARAS_SQL = C.LINES_SQL + """,
pp as (select doc_id as doc, line_no::INT as line_no, (line_no + line_no // 10)::INT as i, txt from lines)"""
WP = C.with_sql(PARAS_SQL)


@query("src_docx_paragraphs", WP + """select doc, i, 'p' as node, 'S' || (line_no % 4) as style_id, (case when line_no % 6 = 2 then 'link' else '' end) || txt as text, line_no % 7 = 3 as has_image,
  line_no % 5 = 1 as is_list, case when line_no % 6 = 2 then '_Toc' || line_no || '" x' end as anchor, null as cells from pp
union all select doc, i + 1, 'tbl', null, null, false, false, null, 'A/' || line_no from pp where line_no % 10 = 9""")
def src_docx_paragraphs(spark, sf):
    b = D.raw_blocks(word_xml(spark, sf))
    return b.select("doc", "i", "node", "style_id", "text", "has_image", "is_list", "anchor", F.array_join("first_row", "/").alias("cells"))


@query("docx_link_repair", WP + "select doc, i, '_Toc' || line_no as anchor from pp where line_no % 6 = 2")
def docx_link_repair(spark, sf):
    b = D.raw_blocks(word_xml(spark, sf)).filter("anchor is not null")
    return b.select("doc", "i", D.cut_at_quote(F.col("anchor")).alias("anchor"))


HALF = "floor({x} / 20.0 + 0.5)::INT"


@query("docx_indent", WP + f""", p as (select *, {HALF.format(x='line_no * 37')} as l, case when line_no % 3 = 0 then {HALF.format(x='line_no * 13')} else 0 end as h, {HALF.format(x='line_no * 11')} as f from pp),
q as (select *, case when h > 0 then -h else f end as ti from p)
select doc, i, case when line_no % 5 = 1 or (txt = '' and line_no % 6 <> 2) then '' else concat_ws(';', case when l <> 0 then 'margin-left:' || l || 'pt' end, case when ti <> 0 then 'text-indent:' || ti || 'pt' end) end as css from q""")
def docx_indent(spark, sf):
    b = D.raw_blocks(word_xml(spark, sf)).filter("node = 'p'")
    return b.select("doc", "i", D.indent_style(F.col("ind_start"), F.col("ind_hanging"), F.col("ind_first"), F.col("is_list"), F.col("text")).alias("css"))


@query("docx_image_sizes", WP + "select doc, (row_number() over (partition by doc order by i) - 1)::INT as img_ord, (line_no * 10)::INT as w, 2 as h from pp where line_no % 7 = 3")
def docx_image_sizes(spark, sf):
    return D.image_sizes(word_xml(spark, sf))


@query("docx_core_props", f"""select doc_id as doc, {C.collapse("text")} as title, case when doc_id % 3 <> 0 then source end as author, case when doc_id % 4 = 0 then 'a b & <é>' end as description from documents""")
def docx_core_props(spark, sf):
    x = F.expr("'<cp:coreProperties><dc:title xml:lang=\"es\"> ' || " + ESC.format(t="text") + " || '</dc:title><dc:creator>' || (case when doc_id % 3 <> 0 then source else '  ' end) || '</dc:creator>' || "
               "(case when doc_id % 4 = 0 then '<dc:description>a_x000D_b &amp; &lt;&#xE9;&gt;</dc:description>' else '' end) || '</cp:coreProperties>'")
    return D.core_properties(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), x.alias("xml")))


_NAMES = [n for k, n, _t in fixed.STYLE_TO_TAG if k == "paragraph"] + ["Normal"]


@query("docx_style_to_tag", "with n as (select p_partkey, list_extract([" + ", ".join(f"'{n}'" for n in _NAMES) + f"], (p_partkey % {len(_NAMES)})::INT + 1) as name from part) " +
       "select p_partkey, name, case " + " ".join(f"when name = '{n}' then '{t}'" for k, n, t in fixed.STYLE_TO_TAG if k == "paragraph") + " end as out_tag from n")
def docx_style_to_tag(spark, sf):
    names = F.array(*[F.lit(n) for n in _NAMES])
    n = table(spark, sf, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(_NAMES)).cast("int")).alias("name"))
    return D.style_tags(n)


@query("parser_hooks", WP + "select doc, i, upper(replace((case when line_no % 6 = 2 then 'link' else '' end) || txt, 'ß', 'SS')) as text from pp where line_no % 5 <> 1")
def parser_hooks(spark, sf):
    raw = D.with_hooks(D.raw_blocks(word_xml(spark, sf)), lambda d: d.filter("node = 'p' and not is_list"), lambda d: d.withColumn("text", F.upper("text")))
    return raw.select("doc", "i", "text")


@query("join_image_sizes", C.with_sql(C.EL_SQL) + """, im as (select *, row_number() over (partition by doc_id order by pos) - 1 as o from el where k = 18)
select e.doc_id, string_agg(case when e.k = 18 and e.doc_id % 5 <> 0 and i.o % 3 <> 2 then replace(e.html, ' />', ' data-w="' || (i.o + 1) || '" data-h="9" />') else e.html end, '' order by e.pos) as html
from el e left join im i using (doc_id, pos) group by e.doc_id""")
def join_image_sizes(spark, sf):
    docs = clean_docs(spark, sf)
    n = F.size(F.regexp_extract_all("html", F.lit("<img"), F.lit(0))) - F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    sizes = docs.select("doc_id", F.explode(F.sequence(F.lit(0), n)).alias("img_ord"), n.alias("n")).filter("img_ord < n")
    sizes = sizes.select("doc_id", "img_ord", F.when(F.col("img_ord") % 3 != 2, F.col("img_ord") + 1).alias("w"), F.lit(9).alias("h"))
    return D.assign_sizes(docs, sizes)


# --- archives -------------------------------------------------------------------------------------

def archives(spark, sf):
    """(path, content): one archive per document with three entries, some below a folder."""
    d = table(spark, sf, "documents")
    root = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("top"), F.col("doc_id"), F.lit("/"))).otherwise("")
    names = F.array(F.concat(root, F.lit("config.xml")), F.concat(root, F.lit("a/b.txt")), F.concat(root, F.lit("pic.png")))
    bodies = F.array(F.col("source"), F.col("text"), F.col("lang"))
    return d.select(F.concat(F.lit("z"), "doc_id").alias("path"), _zip(names, bodies).alias("content"))


ENT = """ent as (select doc_id, 'z' || doc_id as path, case when doc_id % 2 = 0 then 'top' || doc_id || '/' else '' end as root, v.n as n, v.o as o, case v.o when 0 then source when 1 then text else lang end as body
from documents, (values (0, 'config.xml'), (1, 'a/b.txt'), (2, 'pic.png')) v(o, n))"""


@query("src_archive_entries", f"with {ENT} select path, root || n as entry, o as entry_ord, sha256(body) as sha from ent where n <> 'pic.png'")
def src_archive_entries(spark, sf):
    e = A.entries(archives(spark, sf), r"\.(xml|txt)$")
    return e.select("path", "entry", "entry_ord", F.sha2("content", 256).alias("sha"))


@query("src_archive_files", f"with {ENT} select path, root || n as entry, o as entry_ord, sha256(body) as sha from ent where n <> 'pic.png'")
def src_archive_files(spark, sf):
    """Archives written as files with a commit, and read back entry by entry from the files."""
    where = workspace(spark, "archives")
    FS.write_files(archives(spark, sf), where)
    e = FS.read_archive_files(spark, where, r"\.(xml|txt)$").filter("error is null")
    return e.select("path", "entry", "entry_ord", F.sha2("content", 256).alias("sha"))


@query("src_archive_errors", "select 'z' || doc_id as path, 'not an archive' as error from documents where doc_id % 7 = 3")
def src_archive_errors(spark, sf):
    """Every seventh archive is cut off before its directory."""
    cut = F.when(F.substring("path", 2, 20).cast("long") % 7 == 3, F.substring("content", 1, 40)).otherwise(F.col("content"))
    return A.failures(archives(spark, sf).select("path", cut.alias("content"))).select("path", "error")


@query("archive_unwrap_root", f"with {ENT} select path, n as entry from ent")
def archive_unwrap_root(spark, sf):
    return A.unwrap_root(A.entries(archives(spark, sf)).select("path", "entry")).select("path", "entry")


@query("archive_user_files", "select 'z' || doc_id as path, 'pic.png' as entry from documents")
def archive_user_files(spark, sf):
    f = A.unwrap_root(A.entries(archives(spark, sf)).select("path", "entry"))
    return A.user_files(A.without_system_files(f)).select("path", "entry")


# --- legacy packages ----------------------------------------------------------------------------

WIDGET = """'<instance class="exe.engine.jsidevice.JsIdevice" reference="' || cast({r} + 1 as string) || '"><dictionary><string role="key" value="_title"></string><unicode value="' || (case when {i} % 2 = 0 then 'w' || cast({i} as string) else '' end) || '"></unicode>
<string role="key" value="_iDeviceDir"></string><string value="' || (case when {i} % 3 = 0 then '' else 'text' end) || '"></string><string role="key" value="_typeName"></string><unicode value="Text"></unicode>
<string role="key" value="fields"></string><list><instance class="exe.engine.field.TextAreaField" reference="' || cast({r} + 2 as string) || '"><dictionary><string role="key" value="content_w_resourcePaths"></string><unicode content="true" value="' ||
(case when {i} % 4 = 1 then ' ' else '&lt;p&gt;' || cast({i} as string) || '&lt;/p&gt;' end) || '"></unicode></dictionary></instance></list></dictionary></instance>'"""
LEGACY_NODE = """'<instance class="exe.engine.node.Node" reference="' || cast({r} as string) || '"><dictionary><string role="key" value="' || (case when {i} % 7 = 3 then 'title' else '_title' end) || '"></string>' ||
(case when {i} % 7 = 5 then '<unicode value=""></unicode>' else '<unicode>T' || cast({i} as string) || ' &amp; co</unicode>' end) || '<string role="key" value="idevices"></string><list>' || {w} || '</list><string role="key" value="children"></string><list>' || {kids} || '</list></dictionary></instance>'"""


def _node(i, r, kids):
    return LEGACY_NODE.format(i=i, r=r, w=WIDGET.format(i=i, r=r), kids=kids)


def packages(spark, sf):
    """(doc_id, xml): a root page and one child per line; every third child has a child of
    its own, every fifth is stored elsewhere and listed by reference."""
    grand = "(case when i % 3 = 0 then " + _node("(i + 1000)", "(i * 10 + 100005)", "''") + " else '' end)"
    child = _node("i", "(i * 10 + 100)", grand)
    inline = f"(case when i % 5 = 2 then '<reference key=\"' || cast(i * 10 + 100 as string) || '\"/>' else {child} end)"
    apart = f"(case when i % 5 = 2 then {child} else '' end)"
    kids = f"array_join(transform(split(text, '\\n'), (t, i) -> {inline}), '')"
    extra = f"array_join(transform(split(text, '\\n'), (t, i) -> {apart}), '')"
    root = _node("(0)", "(10)", kids)
    has_root = "(case when doc_id % 9 = 8 then 'noroot' else 'root' end)"
    xml = (f"'<?xml version=\"1.0\"?><instance class=\"exe.engine.package.Package\" reference=\"2\"><dictionary><string role=\"key\" value=\"' || {has_root} || '\"></string>' || {root} || "
           f"'<string role=\"key\" value=\"extra\"></string><list>' || {extra} || '</list></dictionary></instance>'")
    return C.placed(spark, sf).select("doc_id", F.expr(xml).alias("xml"))


PKG_SQL = C.LINES_SQL + """,
kid as (select doc_id, line_no as i, line_no as o, 0 as g from lines union all select doc_id, line_no + 1000, line_no, 1 from lines where line_no % 3 = 0
  union all select doc_id, 0, -1, 0 from documents),
pg as (select *, (row_number() over (partition by doc_id order by case when doc_id % 9 = 8 and o % 5 = 2 then o + 1000000 else o end, g) - 1)::INT as page_ord,
  (case when doc_id % 9 = 8 or o = -1 then 0 else 1 + g end)::INT as depth,
  case when i % 7 = 5 then 'Página sin título' else 'T' || i || ' & co' end as title from kid)"""
PKG = C.with_sql(PKG_SQL)


def nodes(spark, sf):
    return E.xml_nodes(packages(spark, sf), placed=True)


@query("legacy_page_tree", PKG + "select doc_id, page_ord, depth, title from pg")
def legacy_page_tree(spark, sf):
    return E.pages(nodes(spark, sf)).select("doc_id", "page_ord", "depth", "title")


@query("legacy_items", PKG + """select doc_id, page_ord, case when i % 3 = 0 then 'Text' else 'text' end as type, case when i % 2 = 0 then 'w' || i else '' end as title, '<p>' || i || '</p>' as html
from pg where i % 4 <> 1""")
def legacy_items(spark, sf):
    n = nodes(spark, sf)
    return E.items(n, E.pages(n))[0].select("doc_id", "page_ord", "type", "title", "html")


@query("legacy_warnings", PKG + """select doc_id, 'En la página «' || title || '»: iDevice «' || (case when i % 2 = 0 then 'w' || i when i % 3 = 0 then 'Text' else 'text' end) || '» sin texto extraíble, omitido.' as warning from pg where i % 4 = 1""")
def legacy_warnings(spark, sf):
    n = nodes(spark, sf)
    return E.items(n, E.pages(n))[1].select("doc_id", "warning")


@query("legacy_summary", PKG + """select doc_id, count(*) as pages, count(*) filter (where i % 4 <> 1) as items, 1 as images, count(*) filter (where i % 4 = 1) as warnings from pg group by doc_id""")
def legacy_summary(spark, sf):
    n = nodes(spark, sf)
    p = E.pages(n)
    i, w = E.items(n, p)
    res = table(spark, sf, "documents").select("doc_id", F.lit("foto.png").alias("path"))
    return E.summary(p, i, res, w)


@query("src_legacy_package", PKG + """select doc_id, 'exe.engine.node.Node' as class, count(*) as n from pg group by doc_id
union all select doc_id, 'exe.engine.jsidevice.JsIdevice', count(*) from pg group by doc_id union all select doc_id, 'exe.engine.field.TextAreaField', count(*) from pg group by doc_id
union all select doc_id, 'exe.engine.package.Package', 1 from documents""")
def src_legacy_package(spark, sf):
    return E.instances(nodes(spark, sf)).groupBy("doc_id", "class").agg(F.count("*").alias("n"))


@query("join_references", PKG + "select doc_id, (i * 10 + 100)::VARCHAR as ref_key, 'exe.engine.node.Node' as class from kid where o >= 0 and g = 0 and i % 5 = 2")
def join_references(spark, sf):
    return E.references(nodes(spark, sf)).select("doc_id", "ref_key", "class")


@query("legacy_package_info", """select doc_id, case when doc_id % 4 = 0 then 'Documento' else 'Título de ' || source end as title, 'Autor ' || lang as author,
  lang as language, case when doc_id % 11 = 5 then 'El paquete no contiene ninguna página.' end as error from documents""")
def legacy_package_info(spark, sf):
    """Metadata of packages; titles carry an escape of the old writer, some packages have no page."""
    d = table(spark, sf, "documents").filter("doc_id is not null")
    key = lambda k, v: F.concat(F.lit(f'<string role="key" value="{k}"></string><unicode value="'), v, F.lit('"></unicode>'))
    title = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("T\\xedtulo de "), F.col("source")))
    page = F.when(F.col("doc_id") % 11 != 5, F.concat(F.lit('<string role="key" value="root"></string><instance class="exe.engine.node.Node" reference="3"><dictionary>'),
                                                      key("_title", F.lit("other")), F.lit("</dictionary></instance>"))).otherwise("")
    xml = F.concat(F.lit('<instance class="exe.engine.package.Package" reference="2"><dictionary>'), key("_title", title), key("_author", F.concat(F.lit("Autor "), "lang")),
                   key("_lang", F.col("lang")), page, F.lit("</dictionary></instance>"))
    return E.package_info(E.xml_nodes(d.select("doc_id", xml.alias("xml"))))


SRC = """case line_no % 6 when 0 then 'https://e.com/a.png' when 1 then 'data:image/png;base64,AAAA' when 2 then 'resources/my%20pic' || cast(line_no as string) || '.png' when 3 then './none.png'
  when 4 then 'resources/v' || cast(line_no as string) || '.svg' else 'p' || cast(line_no as string) || '.JPG' end"""
RES = """case line_no % 6 when 2 then 'my_pic' || cast(line_no as string) || '.png' when 4 then 'v' || cast(line_no as string) || '.svg' when 5 then 'p' || cast(line_no as string) || '.JPG' end"""


@query("join_resources", C.with_sql(C.LINES_SQL) + f"""select doc_id, line_no, case line_no % 6 when 0 then 'external' when 1 then 'embedded' when 3 then 'missing' when 4 then 'unsupported' else 'found' end as status,
  {RES} as found, case line_no % 6 when 0 then '[Imagen externa: https://e.com/a.png]' when 3 then '[Imagen no encontrada: ./none.png]' when 4 then '[Imagen omitida: ' || ({SRC}) || ']' end as notice from lines""")
def join_resources(spark, sf):
    ln = C.lines(spark, sf)
    refs = ln.select("doc_id", "line_no", F.expr(SRC).alias("src"))
    res = ln.select("doc_id", F.expr(RES).alias("path")).filter("path is not null")
    r = E.join_resources(refs, res)
    return r.select("doc_id", "line_no", "status", "found", E.notice(F.col("status"), F.col("src")).alias("notice"))


@query("box_class_markers", C.with_sql(CTX_SQL + FORM_SQL) + "select doc_id, mark as marker, count(*) as n from form_el where opens group by all")
def box_class_markers(spark, sf):
    t = M.form_boxes(K.tokens(clean_docs(spark, sf), placed=True)).filter("tag = 'div' and kind = 'open'")
    return t.select("doc_id", E.marker_of(F.col("tok"), "box").alias("marker")).filter("marker is not null").groupBy("doc_id", "marker").agg(F.count("*").alias("n"))


MARKED_SQL = CTX_SQL + FORM_SQL + f""",
ml as (
  select doc_id, pos, 0 as s, case when closes then '[fin]' else '[' || mark || ']' end as text, 'marker' as style from form_el where opens or closes
  union all select doc_id, pos, 0, '[' || (case when prev_k = 12 then 'vertical' else 'horizontal' end) || ']', 'marker' from ctx where k = 11
  union all select doc_id, pos, 1 + r * 3 + c, 'c' || r || c || ' ' || substr(md5(txt), (r * 3 + c + 1)::INT, 4), case when (prev_k is distinct from 12 and r = 0) or (prev_k = 12 and c = 0) then 'th' else 'td' end
    from ctx, (values (0), (1), (2)) a(r), (values (0), (1), (2)) b(c) where k = 11
  union all select doc_id, pos, i, 'x', 'li' from (select doc_id, pos, unnest(range(1 + length(txt) % 5)) as i from form_el where k in (14, 15))
  union all select doc_id, pos, 0, case when k = 13 and pos % 4 > 1 and txt <> '' then '[vídeo:] ' || {C.plain(C.escape_text('txt'))} else text end,
      case when tag = 'ul' then 'li' when level is not null then 'heading ' || greatest(2, level) else 'p' end
    from form_el f where not opens and not closes and k not in (11, 14, 15) and text <> '' and not (k = 13 and pos % 4 = 1)
      and not (k in (10, 12) and exists (select 1 from el n where n.doc_id = f.doc_id and n.pos = f.pos + 1 and n.k = 11))
  union all select doc_id, pos, 0, {C.plain(C.escape_text('txt'))}, 'p' from el where k = 13 and pos % 4 = 1 and txt <> ''
  union all select doc_id, pos, 1, '[documento:] doctail', 'p' from el where k = 13 and pos % 4 = 1
)"""


@query("sink_marked_text", C.with_sql(MARKED_SQL) + "select doc_id, row_number() over (partition by doc_id order by pos, s) - 1 as ord, style, text from ml")
def sink_marked_text(spark, sf):
    """Back to marker lines from the fully transformed documents."""
    done = M.apply_passes(C.marked_docs(spark, sf), placed=True).withColumn("copies", F.lit(1))
    return E.marked_lines(done).select("doc_id", "ord", "style", "text")


# every line of a document as a piece of nested HTML: blocks in items, cells, quotes and boxes, loose text beside them, missing end tags
def nested_docs(spark, sf):
    line = "transform(split(text, '\\n'), (x, i) -> " + NEST.format(a=C.escape_text("trim(x)"), t="('w' || cast(i as string))", m="((doc_id + i) % 9)") + ")"
    d = C.placed(spark, sf).select("doc_id", "text", E.copies().alias("copies"))
    return d.select("doc_id", F.array_join(F.expr(line), "").alias("html"), "copies")


NEST = """case {m} when 0 then '<ul><li><p>' || {a} || '</p>' || {t} || '</li><li>' || {t} || '<ul><li>' || {a} || '</ul>z</ul>'
  when 1 then '<table class="sem_tabla_vertical"><tr><td><p>' || {a} || '</p>' || {t} || '<td>' || {t} || ' <b>' || {a} || '</b></table>'
  when 2 then '<blockquote>' || {t} || '<p>' || {a} || '</p>z<b>' || {a} || '</b></blockquote>'
  when 3 then '<div>' || {t} || '<p>' || {a} || '</div>z</span>y'
  when 4 then '<div class="x sem_ejemplo">' || {t} || '<ol><li>' || {a} || '<blockquote>' || {t} || '</blockquote></ol><div class="sem_pie"><h1>' || {a} || '</div></div>'
  when 5 then '<p>' || {t} || '<p class="sem_recurso_video">' || {a} || '<h3>' || {t} || '<i>' || {a} || '</i></h4>'
  when 6 then '<section><span>' || {a} || '</span><span>' || {t} || '</span></section><article>' || {t} || '<section>' || {a} || '</section></article>'
  when 7 then '<pre>' || {t} || '<b>' || chr(10) || '  ' || {a} || '</b>' || chr(10) || '</pre><object data="u"><p>n</p></object>'
  else '<table><caption>c</caption><tbody><tr><th>' || {t} || '<td>' || {a} || '<tr><td><ul><li>' || {a} || '</ul>' || {t} || '</tbody></table><hr>' end"""

NESTED_SQL = f""",
n0 as (select doc_id, line_no, txt, {C.escape_text('txt')} as a, 'w' || line_no as t, (doc_id + line_no) % 9 as m from lines),
n1 as (
  select doc_id, line_no, unnest(case m
    when 0 then [{{'style': 'li', 'text': a || t}}, {{'style': 'li', 'text': t || 'z'}}, {{'style': 'li', 'text': a}}]
    when 1 then [{{'style': 'marker', 'text': '[vertical]'}}, {{'style': 'p', 'text': a}}, {{'style': 'p', 'text': t}}, {{'style': 'td', 'text': t || ' ' || a}}]
    when 2 then [{{'style': 'p', 'text': t}}, {{'style': 'p', 'text': a}}, {{'style': 'p', 'text': 'z'}}, {{'style': 'p', 'text': a}}]
    when 3 then [{{'style': 'p', 'text': t}}, {{'style': 'p', 'text': a}}, {{'style': 'p', 'text': 'zy'}}]
    when 4 then [{{'style': 'marker', 'text': '[ejemplo]'}}, {{'style': 'p', 'text': t}}, {{'style': 'li', 'text': a || t}}, {{'style': 'marker', 'text': '[pie]'}},
      {{'style': 'heading 2', 'text': a}}, {{'style': 'marker', 'text': '[fin]'}}, {{'style': 'marker', 'text': '[fin]'}}]
    when 5 then [{{'style': 'p', 'text': t}}, {{'style': 'p', 'text': case when {C.plain('a')} <> '' then '[vídeo:] ' || a else '' end}}, {{'style': 'heading 3', 'text': t || a}}]
    when 6 then [{{'style': 'p', 'text': a || t}}, {{'style': 'p', 'text': t}}, {{'style': 'p', 'text': a}}]
    when 7 then [{{'style': 'pre', 'text': t}}, {{'style': 'pre', 'text': '  ' || txt}}, {{'style': 'pre', 'text': ''}}, {{'style': 'marker', 'text': '[Contenido incrustado omitido: u]'}}]
    else [{{'style': 'marker', 'text': '[horizontal]'}}, {{'style': 'th', 'text': t}}, {{'style': 'td', 'text': a}}, {{'style': 'li', 'text': a}}, {{'style': 'p', 'text': t}}] end) as x,
    unnest(range(7)) as s
  from n0),
n2 as (select doc_id, line_no, s, x.style as style, case x.style when 'pre' then x.text else {C.plain('x.text')} end as text from n1 where x is not null)
"""


@query("sink_marked_nested", C.with_sql(C.LINES_SQL + NESTED_SQL) + """select doc_id, row_number() over (partition by doc_id order by line_no, s) - 1 as ord, style, text
from n2 where text <> '' or style = 'pre'""")
def sink_marked_nested(spark, sf):
    """Back to marker lines from nested markup with loose text and implied end tags."""
    return E.marked_lines(nested_docs(spark, sf)).select("doc_id", "ord", "style", "text")


@query("sink_marked_pages", PKG + "select doc_id, page_ord, title || (case depth when 0 then '' when 1 then ' [Subpágina]' else ' [3er nivel]' end) as text from pg")
def sink_marked_pages(spark, sf):
    return E.page_lines(E.pages(nodes(spark, sf))).select("doc_id", "page_ord", "text")


@query("storage_injection", """select doc_id, case doc_id % 4 when 0 then 'same' else 'similar' end as kind,
  (case doc_id % 4 when 0 then '1' else '2' end) || ',' || (1 + length(coalesce(text, '')) % 3) as levels, case length(coalesce(text, '')) % 2 when 0 then 'tabs' else 'html' end as options
from documents where doc_id % 5 > 1""")
def storage_injection(spark, sf):
    """Recall against a memory handed in as stored JSON of each document's own owner: two entries, the older one with the titles that some ask for."""
    entry = ("'{\"shape\":\"1,0\",\"titles\":\"%s\",\"levels\":[%d,' || (1 + length(coalesce(text, '')) %% 3) || '],\"options\":[\"' || "
             "case length(coalesce(text, '')) %% 2 when 0 then 'tabs' else 'html' end || '\"],\"at\":%d}'")
    d = table(spark, sf, "documents")
    text = f"'[' || {entry % ('ab', 1, 1)} || ',' || {entry % ('cd', 2, 2)} || ']'"
    store = d.filter("doc_id % 5 > 1").select(F.col("doc_id").alias("owner"), F.expr(text).alias("value"))
    s = d.select("doc_id", F.col("doc_id").alias("owner"), F.lit("1,0").alias("shape"), F.expr("case doc_id % 4 when 0 then 'ab' else 'zz' end").alias("titles"),
                 F.lit("").alias("tags"), F.lit(2).alias("n_sections"), F.lit(1).alias("n_items"))
    return Y.recall(s, Y.parse_entries(store)).select("doc_id", "kind", F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels"),
                                                      F.array_join("options", ",").alias("options"))
