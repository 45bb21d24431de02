"""Vocabularies, patterns, formats and messages the results depend on.

Everything here is data. The patterns are written for Java's regex engine; `WS` is
the ECMAScript white-space class, which is wider than Java's.
"""

from __future__ import annotations

import unicodedata

# --- white space ---------------------------------------------------------------
WS = (r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")

# --- author markers (fixed values) ---------------------------------------------
BOX_LABELS = {"ejemplo": "ejemplo", "definicion": "definición",
              "importante": "importante", "pie": "pie"}
BOX_WORDS = r"ejemplo|definici[oó]n|importante|pie"
GROUP_END_WORDS = rf"fin(?:{WS}|-)*acorde[oó]n"
TABLE_WORDS = r"horizontal|vertical"
RESOURCE_WORDS = r"v[ií]deo|documento|enlace"

BOX_MARKER = rf"\[{WS}*(?:{BOX_WORDS}|fin){WS}*\]"
BOX_OPEN = rf"\[{WS}*(?:{BOX_WORDS}){WS}*\]"
GROUP_END = rf"\[{WS}*{GROUP_END_WORDS}{WS}*\]"
TABLE_MARKER = rf"\[{WS}*(?:{TABLE_WORDS}){WS}*\]"
RESOURCE_MARKER = rf"\[{WS}*(?:{RESOURCE_WORDS}){WS}*:{WS}*\]"
LINE_MARKER = rf"\[{WS}*(?:{BOX_WORDS}|{GROUP_END_WORDS}|fin|{TABLE_WORDS}){WS}*\]"
ANY_MARKER = rf"(?:{LINE_MARKER}|{RESOURCE_MARKER})"
P_OPEN = r"<p(?:\s[^>]*)?>"
BR = rf"<br\s*/?>"
FORMAT_TAGS = "strong|em|u|del|sup|sub|span|a"
BLOCK_BOUNDARY = (r"</?(?:p|li|ul|ol|dl|dt|dd|h[1-6]|table|thead|tbody|tfoot|tr|td|th"
                  r"|div|blockquote|pre|section|article|aside|figure|figcaption|hr)\b")
NBSP_OR_WS = rf"(?:&nbsp;|{WS})"

# Class names written by the passes. The prefix is ours to choose and an argument of
# every pass that writes one.
CLASS_PREFIX = "sem_"

# --- heading tags (fixed values): key, label, heading, value, accepted forms ----
HEADING_TAGS = [
    ("pagina-principal", "Página principal", 1, "1", ["paginaprincipal", "paginasprincipales"]),
    ("subpagina", "Subpágina", 1, "2", ["subpagina", "subpaginas"]),
    ("3er-nivel", "3er nivel", 1, "3", ["3ernivel", "3onivel", "3nivel", "tercernivel"]),
    ("titulo-idevice", "Título de iDevice", 2, "idevice-title",
     ["titulodeidevice", "titulosdeidevice", "tituloidevice", "titulodeidevices"]),
    ("cabecera-2", "Cabecera 2 en texto", 2, "html",
     ["cabecera2entexto", "cabeceras2entexto", "cabecera2"]),
    ("acordeon", "Acordeón", 2, "accordion", ["acordeon", "acordeones"]),
    ("pestanas", "Pestañas", 2, "tabs", ["pestanas", "pestana"]),
]
HEADING_TAG_ATTR = "data-structure-tag"

H2_OPTIONS = ["idevice-title", "html", "accordion", "tabs"]
PAGE_LEVELS = [1, 2, 3]
MEMORY_LIMIT = 20

# --- titles ----------------------------------------------------------------------
GENERATOR_DESCRIPTIONS = ["generated by python-docx"]
DEFAULT_DOC_TITLE = "Documento importado"
DEFAULT_PROJECT_STEM = "proyecto"
DEFAULT_BLOCK_TITLE = "Contenido"
EMPTY_DOC_HTML = "<p>Documento importado sin encabezados detectados.</p>"
DEFAULT_SUBTITLE = {"es": "Biblioteca Universitaria", "ca": "Biblioteca Universitària",
                    "en": "University Library"}
KNOWN_LANGS = ["es", "ca", "en"]
TOC_HEADING = {"es": "Índice", "ca": "Índex", "en": "Table of Contents"}

# --- word style names to output elements (fixed values) --------------------------
STYLE_TO_TAG = [
    ("paragraph", "Code", "pre"), ("paragraph", "Código", "pre"), ("paragraph", "Codigo", "pre"),
    ("paragraph", "HTML", "pre"), ("paragraph", "Preformatted", "pre"),
    ("paragraph", "Preformatted Text", "pre"),
    ("run", "Code", "code"), ("run", "Código", "code"), ("run", "Codigo", "code"),
    ("run", "HTML", "code"),
    ("paragraph", "Lista con viñetas", "ul > li"), ("paragraph", "Lista con viñetas 2", "ul > li"),
    ("paragraph", "Lista con viñetas 3", "ul > li"),
    ("paragraph", "Lista numerada", "ol > li"), ("paragraph", "Lista numerada 2", "ol > li"),
    ("paragraph", "Lista numerada 3", "ol > li"),
    ("paragraph", "Párrafo de lista", "ul > li"),
]

# --- html vocabularies -----------------------------------------------------------
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "source", "track", "wbr"]
# containers that always carry an end tag; p, li and inline tags do not nest blocks
CONTAINER_TAGS = ["div", "article", "section", "nav", "aside", "header", "footer", "main",
                  "figure", "ul", "ol", "dl", "table", "blockquote", "pre", "form", "details",
                  "h1", "h2", "h3", "h4", "h5", "h6", "video", "audio", "object", "iframe"]
# tag, written tag, kept when empty
SANITIZE_TAGS = [
    ("b", "strong", False), ("i", "em", False), ("strike", "del", False),
    ("p", "p", True), ("ul", "ul", False), ("ol", "ol", False), ("li", "li", False),
    ("table", "table", False), ("th", "th", True), ("td", "td", True),
    ("thead", "thead", False), ("tbody", "tbody", False), ("tr", "tr", False),
    ("strong", "strong", False), ("em", "em", False), ("u", "u", False),
    ("sup", "sup", False), ("sub", "sub", False), ("blockquote", "blockquote", False),
    ("pre", "pre", False), ("code", "code", False),
    ("h3", "h3", False), ("h4", "h4", False), ("h5", "h5", False), ("h6", "h6", False),
    ("br", "br", True), ("a", "a", True), ("img", "img", True), ("iframe", "iframe", True),
    ("div", "div", False),
]
EMBED_TAGS = ["iframe", "video", "audio", "object", "embed"]
PREVIEW_DROPPED = ["script", "iframe", "object", "embed"]
PREVIEW_PLACEHOLDER = "Contenido incrustado omitido en la vista previa."
IMAGE_EXT = {"jpeg": "jpg", "jpg": "jpg", "png": "png", "gif": "gif", "webp": "webp",
             "svg+xml": "svg", "bmp": "bmp"}
WORD_IMAGE_EXT = {"png": "png", "jpg": "jpg", "jpeg": "jpg", "gif": "gif", "bmp": "bmp"}
RESOURCE_DIR = "content/resources"

# --- legacy package: fixed values ----------------------------------------------------
CLASS_PACKAGE = "exe.engine.package.Package"
CLASS_NODE = "exe.engine.node.Node"
INTERNAL_FILES = ["contentv3.xml", "contentv2.xml", "content.data", "content.xsd", "content.xml"]
ERR_MODERN = ("Este archivo es un paquete del eXeLearning moderno (.elpx), no del clásico. "
              "Ábrelo directamente con eXeLearning.")
ERR_NO_PACKAGE = "El contentv3.xml no contiene un paquete de eXeLearning reconocible."
ERR_NO_PAGES = "El paquete no contiene ninguna página."
PACKAGE_TITLE = "Documento"
PAGE_WITHOUT_TITLE = "Página sin título"
ERR_NO_CONTENT = ("No se ha encontrado contentv3.xml: el archivo no parece un .elp del "
                  "eXeLearning clásico (2.x).")

# --- catalogue ---------------------------------------------------------------------
THEMES_DIR = "public/themes"
THEMES_CONFIG_PATH = "public/themes-config.json"
REQUIRED_THEME_FILES = ["config.xml", "style.css"]
LANG_TOKENS = ["es", "ca", "en", "val", "cat", "eng", "spa", "castellano", "espanol", "spanish",
               "valenciano", "valencia", "catalan", "catala", "ingles", "english"]
LANG_RANK = {"es": 0, "ca": 1, "en": 2}
CHECKSUM_PARTS = ["content.xml", "ode.xml", "META-INF/manifest.xml"]

# --- cleaner -------------------------------------------------------------------------
TOC_TITLES = ["contenido", "contenidos", "índice", "indice", "tabla de contenido",
              "tabla de contenidos", "table of contents", "contents", "sumario"]
# paragraph style ids that end in one of these words are boxes
BOX_STYLE_ENDS = {"importante": "importante", "definicion": "definición", "ejemplo": "ejemplo"}
COVER_STYLES = ["Ttulo", "FrameContents"]

# --- messages (fixed values) -----------------------------------------------------------
# %1$s label, %2$s marker, %3$s " (cerca de «…»)", %4$s context, %5$s near text
ISSUE_MESSAGES = {
    "unclosed-box": "Falta el [fin] de la caja [%1$s]%3$s. Escríbelo donde quieras que termine la caja.",
    "stray-fin": "Sobra un [fin]%5$s: no cierra ninguna caja. Bórralo, o escribe antes la etiqueta que abre la caja.",
    "heading-inside-box": "La caja [%1$s] sigue abierta al llegar al título «%4$s», y un título no puede ir dentro de una caja. Escribe [fin] antes de ese título o revisa dónde debería terminar la caja.",
    "box-not-formable": "No se puede crear la caja [%1$s]%3$s: la etiqueta y su [fin] están en elementos distintos de una lista o en bloques distintos. Ponlas en el mismo párrafo, o cada una en un párrafo propio. Si no, se verán como texto en el curso.",
    "accordion-marker": "La etiqueta [fin acordeón]%3$s tiene que ir sola en un párrafo, fuera de cualquier lista. Si no, el acordeón no se cierra ahí y todo lo que va después queda dentro del último desplegable.",
    "table-marker": "La etiqueta [%2$s]%3$s no está justo encima de una tabla. Escríbela sola en el párrafo que va inmediatamente antes de la tabla; si no, se verá como texto en el curso.",
    "table-without-marker": "Una tabla%3$s no indica dónde está su cabecera. Escribe [horizontal] (cabecera en la primera fila) o [vertical] (cabecera en la primera columna), solo, en el párrafo justo antes de la tabla. Si no lo haces, la primera fila hará de cabecera.",
    "resource-marker": "La etiqueta [%2$s:]%3$s tiene que ir al principio de la línea, seguida del texto del recurso. Tal como está, se verá como texto en el curso.",
}
# %1$s written, %2$s label, %3$s heading name, %4$s place, %5$s valid tags
HEADING_MESSAGES = {
    "heading-tag-typo": "«[%1$s]»%4$s parece una etiqueta mal escrita. ¿Querías poner [%2$s]? Corrígela en el Word; tal como está, se verá como parte del título.",
    "heading-tag-only": "Hay un %3$s que solo tiene la etiqueta [%1$s] y le falta el texto. Escribe el título delante de la etiqueta; si no, en el curso aparecerá «[%1$s]» como título.",
    "heading-tag-first-page": "No se ha aplicado la etiqueta [%2$s]%4$s: el primer Título 1 del documento es siempre una página principal. Puedes quitarla o cambiarla por [Página principal].",
    "heading-tag-wrong-level": "La etiqueta [%2$s] no sirve en un %3$s, así que no se ha aplicado%4$s.%5$s",
}
HEADING_VALID = {
    1: " En un Título 1 puedes usar [Página principal], [Subpágina] o [3er nivel].",
    2: " En un Título 2 puedes usar [Título de iDevice], [Cabecera 2 en texto], [Acordeón] o [Pestañas].",
    0: " Estas etiquetas solo funcionan en párrafos con el estilo Título 1 o Título 2.",
}
RULE_LEVEL = "level-jump"
RULE_TITLE = "title-not-last"


def accent_table() -> tuple[str, str]:
    """Accented letters and their base letters, from canonical decomposition.

    Covers the letters whose decomposition is one base letter plus combining marks in
    Latin-1, Latin Extended A/B and Latin Extended Additional.
    """
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        nfd = unicodedata.normalize("NFD", chr(cp))
        base = [c for c in nfd if not 0x300 <= ord(c) <= 0x36F]
        if len(base) == 1 and base[0] != chr(cp):
            src.append(chr(cp))
            dst.append(base[0])
    return "".join(src), "".join(dst)
