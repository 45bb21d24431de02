"""The token passes of `markers.TOKEN_PASSES` on one document at a time, as lists.

As windows the passes sort every token of the corpus some twenty times. Here a document is cut into tokens within its row and each pass walks
its list, linear in the tokens; only markup comes in and goes out. The passes are those of `markers`, step by step and in the same order, and a
test holds the two side by side. Regular expressions are Java's written for Python: `\\s`, ignored case without (?u) and letters after (?i) are
ASCII, `$` also stands before a last line end of any kind, word borders are `_word`.

Documents that share an id are one token list, ordered by place, as in the windows: until the line breaks are split (where tokens are numbered
anew) tokens of one place count together.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

from .. import fixed
from ..fixed import NBSP_OR_WS, WS

OPEN, CLOSE, VOID, TEXT, BRACKET = "open", "close", "void", "text", "bracket"
#: tokens above this length are not remembered
SHORT = 200
IMAGE_BLOCKS = ["p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre",
                "figcaption", "dt", "dd"]


def java(pattern: str) -> str:
    """A pattern of `fixed`: its white space class and its `$`, for Python."""
    pattern = pattern.replace(WS, _WS)
    return pattern[:-1] + _END if pattern.endswith("$") else pattern


_WS = "[" + re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", WS[1:-1]).replace(r"\s", r" \t\n\x0b\f\r") + "]"
_END = r"(?=(?:\r\n|(?<!\r)\n|[\r\x85\u2028\u2029])?\Z)"
_ASCII = re.A | re.I
TOKEN = re.compile(r"<[^>]+>|\[[^\[\]<>]*\]|[^<\[]+|[<\[]")
_PIECE = re.compile(r"<[^>]+>|[^<]+|<")
_TAG = re.compile(r"</?([a-zA-Z!][a-zA-Z0-9:!-]*)")
_NAME = re.compile(r"</?([a-zA-Z0-9]+)")
_GROUP = re.compile(java(r"\[[^\n\r\x85\u2028\u2029]*\]$"))
_BLANK = re.compile(java(rf"{WS}*$"))
_BLANK_ASCII = re.compile(java(r"[ \t\n\x0b\f\r]*$"))
_EMPTY = re.compile(java(rf"{NBSP_OR_WS}*$"))
_LEADING_BLANK = re.compile(java(rf"{NBSP_OR_WS}+"))
_FIN = re.compile(java(r"\[fin\]$"), re.I)
_BOX_OPEN = re.compile(java(rf"{fixed.BOX_OPEN}$"), re.I)
_ORIENT = re.compile(java(rf"\[{WS}*({fixed.TABLE_WORDS}){WS}*\]$"), re.I)
_RESOURCE = re.compile(java(rf"\[{WS}*({fixed.RESOURCE_WORDS}){WS}*:{WS}*\]$"), re.I)
_RESOURCE_LEADING = re.compile(java(rf"{NBSP_OR_WS}*\[{NBSP_OR_WS}*(?:{fixed.RESOURCE_WORDS}){NBSP_OR_WS}*:{NBSP_OR_WS}*\]{NBSP_OR_WS}*"), re.I)
_LABEL = re.compile(java(rf"\[{WS}*|{WS}*\]"))
_MARKS = re.compile("[\u0300-\u036f]")
_PLAIN = str.maketrans(*fixed.accent_table())
_HAS_CLASS = re.compile(r"""\sclass=["'][^"']*["']""", _ASCII)
_CLASS = re.compile(r"""(\sclass=)["']([^"']*)["']""", _ASCII)
_VOID_END = re.compile(java(r"(.*?)[ \t\n\x0b\f\r]*/?>$"), re.S)
_TAG_END = re.compile(java(r"(.*?)>$"), re.S)
_SCOPE = re.compile(r"""\sscope=("[^"]*"|'[^']*'|[^\s>]+)""", _ASCII)
_HAS_START = re.compile(rf"\sstart(?:[\s=>/]|{_END})", _ASCII)
_INT = re.compile(r"[\x00-\x20\x7f]*([+-]?[0-9]+)[\x00-\x20\x7f]*\Z")
_EXTERNAL = re.compile(java(rf"{WS}*https?://"), _ASCII)
_TARGET = re.compile(r"""\s(target|rel)=("[^"]*"|'[^']*')""", _ASCII)
_DATA_SIZE = re.compile(r"""\sdata-[wh]=("[^"]*"|'[^']*')""", _ASCII)
_SIZE = re.compile(r"""\s(width|height|style)=("[^"]*"|'[^']*'|[^\s>"']+)""", _ASCII)
_ANY_TAG = re.compile("<[^>]+>")
_NBSP = re.compile("&nbsp;|&#160;|&#xa0;", _ASCII)
_WHITE = re.compile(f"{_WS}+")
_NUMBER = re.compile("&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));")
_BLOCKS = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th div blockquote pre section article aside figure figcaption hr".split())
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_CONTAINERS, _VOIDS, _IMAGE_BLOCKS = frozenset(fixed.CONTAINER_TAGS), frozenset(fixed.VOID_TAGS), frozenset(IMAGE_BLOCKS)


def _word(c: str) -> bool:
    """Whether a character continues a word."""
    return c == "_" or c.isalnum() if c < "\x80" else unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Mn")


def _begins(tok: str, names) -> bool:
    """Whether a token begins as a start or end tag of one of these names."""
    m = _NAME.match(tok)
    return bool(m) and m[1].lower() in names and not (m.end() < len(tok) and _word(tok[m.end()]))


def _holds_word(tok: str, word: str) -> bool:
    at = tok.find(word)
    while at >= 0:
        end = at + len(word)
        if not (at and _word(tok[at - 1])) and not (end < len(tok) and _word(tok[end])):
            return True
        at = tok.find(word, at + 1)
    return False


def _read_tag(tok: str) -> tuple[str, str | None, bool]:
    m = _TAG.match(tok)
    if not m:
        return TEXT, None, _begins(tok, _BLOCKS)
    tag = m[1].lower()
    kind = CLOSE if tok.startswith("</") else VOID if tag in _VOIDS or tok.endswith("/>") else OPEN
    return kind, tag, _begins(tok, _BLOCKS)


_read_short_tag = lru_cache(maxsize=1 << 13)(_read_tag)


def read(tok: str) -> tuple[str, str | None, bool]:
    """(kind, tag, whether it is a border of blocks) of a token, see `tokens.classify`."""
    if tok[0] == "<":
        return _read_short_tag(tok) if len(tok) <= SHORT else _read_tag(tok)
    return BRACKET if tok[0] == "[" and _GROUP.match(tok) else TEXT, None, False


def blank(tok: str) -> bool:
    return not " " < tok[0] < "\x7f" and _BLANK.match(tok) is not None


def strip_diacritics(text: str) -> str:
    return _MARKS.sub("", text.translate(_PLAIN))


def _character(m: re.Match) -> str:
    n = int(m[1], 16) if m[1] else int(m[2])
    return chr(n) if n < 0xD800 or 0xDFFF < n < 0x110000 else "\ufffd"


@lru_cache(maxsize=None)
def _attribute(name: str) -> re.Pattern:
    return re.compile(rf"""\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", _ASCII | re.S)


def attr(tok: str, name: str) -> str | None:
    """`text.attr` of one tag."""
    m = _attribute(name).search(tok)
    if not m:
        return None
    raw = m[1]
    bare = raw[1:-1] if raw[0] in "\"'" else raw
    if "&" in bare:
        bare = _NUMBER.sub(_character, bare)
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            bare = bare.replace(entity, char)
    return bare


def to_int(text: str | None) -> int | None:
    m = _INT.match(text) if text is not None else None
    n = int(m[1]) if m and len(m[1]) < 4000 else None
    return n if n is not None and -0x80000000 <= n <= 0x7FFFFFFF else None


def has_text(tok: str) -> bool:
    """Whether `text.plain_text` of a token is not empty."""
    if " " < tok[0] < "\x7f" and tok[0] not in "&<":
        return True
    if "<" in tok:
        tok = _ANY_TAG.sub("", tok)
    if "&" in tok:
        tok = _NBSP.sub(" ", tok)
    return _WHITE.sub("", tok) != ""


def _before(pattern: re.Pattern, tok: str) -> str:
    """What a tag has before its end, '' where it has none."""
    m = pattern.match(tok)
    return m[1] if m else ""


def add_class(tok: str, cls: str) -> str:
    if _HAS_CLASS.search(tok):
        return _CLASS.sub(lambda m: f'{m[1]}"{m[2]} {cls}"', tok)
    return f'{_before(_VOID_END, tok)} class="{cls}"{" />" if tok.endswith("/>") else ">"}'


class Tokens:
    """The tokens of a document: their places and texts, kinds and tags beside them."""

    __slots__ = ("pos", "tok", "kind", "tag", "edge", "tied")

    def __init__(self, pos: list[int], tok: list[str], tied: bool):
        self.pos, self.tied = pos, tied
        self.retell(tok)

    def retell(self, tok: list[str]) -> None:
        """Takes these texts and reads their kinds and tags anew."""
        self.tok = tok
        self.kind, self.tag, self.edge = map(list, zip(*map(read, tok), strict=True)) if tok else ([], [], [])

    def drop_empty(self) -> None:
        if not all(self.tok):
            kept = [i for i, t in enumerate(self.tok) if t]
            for name in ("pos", "tok", "kind", "tag", "edge"):
                held = getattr(self, name)
                setattr(self, name, [held[i] for i in kept])

    def order(self, keys: list) -> None:
        at = sorted(range(len(keys)), key=keys.__getitem__)
        for name in ("pos", "tok", "kind", "tag", "edge"):
            held = getattr(self, name)
            setattr(self, name, [held[i] for i in at])


class Neighbours:
    """The nearest tokens that are not blank: `of(i, -1)` before token i, `of(i, 1)` after it, None where there is none; paragraph tags as p and /p."""

    def __init__(self, d: Tokens):
        self.d, self.solid, self.rank = d, [], []
        for i, t in enumerate(d.tok):
            self.rank.append(len(self.solid))
            if not blank(t):
                self.solid.append(i)

    def of(self, i: int, k: int) -> str | None:
        at = self.rank[i] + k
        if k > 0 and not (self.rank[i] < len(self.solid) and self.solid[self.rank[i]] == i):
            at -= 1
        if not 0 <= at < len(self.solid):
            return None
        j = self.solid[at]
        return self.d.tok[j] if self.d.tag[j] != "p" else "p" if self.d.kind[j] == OPEN else "/p"


def cut(texts: list[str]) -> Tokens:
    """The tokens of the documents of one id."""
    if len(texts) == 1:
        tok = TOKEN.findall(texts[0])
        return Tokens(list(range(len(tok))), tok, False)
    both = sorted(((i, n, t) for n, x in enumerate(texts) for i, t in enumerate(TOKEN.findall(x))), key=lambda t: t[:2])
    return Tokens([i for i, _, _ in both], [t for _, _, t in both], True)


def in_code(d: Tokens) -> list[bool]:
    run, out = 0, []
    for kind, tag in zip(d.kind, d.tag):
        code = tag == "pre" or tag == "code"
        if code:
            run += 1 if kind == OPEN else -1 if kind == CLOSE else 0
        out.append(run > 0 or code)
    return out


def _pair(d: Tokens, ends: set[int], opens: set[int], walls: set[int], into: dict[int, str]) -> None:
    """Marks the first opening of each stretch and the end it goes to, as `form_boxes` pairs them."""
    start, first = 0, None
    for i in sorted(ends | opens | walls):
        if i in opens and first is None:
            first = i
        if i in ends or i in walls:
            if i in ends and first is not None and d.pos[i] > d.pos[first]:
                for j in _tied(d, first, start, i):
                    into[j] = strip_diacritics(_LABEL.sub("", d.tok[j]).lower())
                for j in _tied(d, i, start, i):
                    into[j] = "/"
            start, first = i + 1, None


def _tied(d: Tokens, i: int, start: int, end: int) -> list[int]:
    """The tokens of token i's place from `start` to `end`."""
    if not d.tied:
        return [i]
    a = b = i
    while a > start and d.pos[a - 1] == d.pos[i]:
        a -= 1
    while b < end and d.pos[b + 1] == d.pos[i]:
        b += 1
    return list(range(a, b + 1))


def form_boxes(d: Tokens, prefix: str) -> None:
    marks = [i for i, k in enumerate(d.kind) if k == BRACKET]
    fins = {i for i in marks if _FIN.match(d.tok[i])}
    openings = {i for i in marks if i not in fins and _BOX_OPEN.match(d.tok[i])}
    if not fins or not openings:
        return
    code = in_code(d)
    fins, openings = {i for i in fins if not code[i]}, {i for i in openings if not code[i]}
    near = Neighbours(d)
    alone = {i for i in fins | openings if near.of(i, -1) == "p" and near.of(i, 1) == "/p"}
    headings = {i for i, t in enumerate(d.tag) if t in _HEADINGS and d.kind[i] == OPEN and not code[i]}
    box: dict[int, str] = {}
    _pair(d, fins & alone, openings & alone, headings, box)
    inline: dict[int, str] = {}
    formed = box.keys()
    _pair(d, fins - formed, openings - formed, {i for i, e in enumerate(d.edge) if e and not code[i]} | formed, inline)
    if not box and not inline:
        return
    tok = d.tok[:]
    for i in box:
        # the paragraph tags around a formed marker go with it
        if i and d.tag[i - 1] == "p" and d.kind[i - 1] == OPEN:
            tok[i - 1] = ""
        if i + 1 < len(tok) and d.tag[i + 1] == "p" and d.kind[i + 1] == CLOSE:
            tok[i + 1] = ""
    for i, mark in (inline | box).items():
        tok[i] = "</div>" if mark == "/" else f'<div class="{prefix}{mark}">'
        d.kind[i], d.tag[i], d.edge[i] = CLOSE if mark == "/" else OPEN, "div", True
    d.tok = tok
    d.drop_empty()


def orient_tables(d: Tokens, prefix: str) -> None:
    words = {i: m[1].lower() for i, k in enumerate(d.kind) if k == BRACKET and (m := _ORIENT.match(d.tok[i]))}
    if not words:
        return
    near = Neighbours(d)
    used = {}
    for i, word in words.items():
        if near.of(i, -1) == "p" and near.of(i, 1) == "/p" and (after := near.of(i, 2)) is not None and after[1:2] != "/" and _begins(after, ("table",)):
            used[i] = word
    if not used:
        return
    tok, last, seen = d.tok[:], None, False
    for i, (kind, tag) in enumerate(zip(d.kind, d.tag)):
        if i in used:
            tok[i] = ""
        elif tag == "p" and ((kind == OPEN and i + 1 in used) or (kind == CLOSE and i - 1 in used)):
            tok[i] = ""
        table = kind == OPEN and tag == "table"
        if table and seen and i not in used and near.of(i, -1) == "/p" and (p2 := near.of(i, -2)) is not None and _ORIENT.match(p2):
            tok[i] = add_class(d.tok[i], f"{prefix}tabla_{last}")
        if i in used:
            last, seen = used[i], True
        elif table:
            seen = False
    d.tok = tok
    d.drop_empty()


def structure_tables(d: Tokens, prefix: str) -> None:
    if not d.tied and not any(t == "table" and k == OPEN for t, k in zip(d.tag, d.kind)):
        return
    upright, either = f"{prefix}tabla_vertical", (f"{prefix}tabla_horizontal", f"{prefix}tabla_vertical")
    run, table, rows, cols, at = 0, {}, {}, {}, []
    for i, (kind, tag) in enumerate(zip(d.kind, d.tag)):
        depth = run
        if tag == "table":
            if kind == OPEN:
                run = depth = run + 1
                table[depth] = (d.pos[i], "vertical" if _holds_word(d.tok[i], upright) else "horizontal")
            elif kind == CLOSE:
                run -= 1
        if depth <= 0 and not d.tied:
            at.append(None)
            continue
        name, orient = table.get(depth, (-1, None))
        key = (depth, name)
        if tag == "tr" and kind == OPEN:
            rows[key] = rows.get(key, -1) + 1
        row = rows.get(key, -1)
        cell = (depth, name, row)
        if kind == OPEN and (tag == "td" or tag == "th"):
            cols[cell] = cols.get(cell, -1) + 1
        at.append((key, orient, row, cols.get(cell, -1)))
    for i, x in enumerate(at):
        if x is None or x[0][0] <= 0:
            continue
        key, orient, row, col = x
        tag, kind, tok, flat = d.tag[i], d.kind[i], d.tok[i], orient == "horizontal"
        if tag == "thead" or tag == "tbody" or tag == "tfoot":
            d.tok[i] = ""
        elif tag == "td" or tag == "th":
            head = row == 0 if flat else col == 0
            want = "th" if head else "td"
            if kind == OPEN:
                scope = (' scope="col"' if flat else ' scope="row"') if head else ""
                if tag == want:
                    d.tok[i] = f"{_before(_TAG_END, _SCOPE.sub('', tok))}{scope}>"
                else:
                    spans = "".join(f' {a}="{v}"' for a in ("colspan", "rowspan") if (v := attr(tok, a)))
                    d.tok[i] = f"<{want}{spans}{scope}>"
            elif kind == CLOSE:
                d.tok[i] = f"</{want}>"
            d.tag[i] = want
        elif tag == "tr":
            if kind == OPEN:
                d.tok[i] = ("<thead>" if row == 0 and flat else "<tbody>" if row == (1 if flat else 0) else "") + tok
            else:
                d.tok[i] = tok + ("</thead>" if row == 0 and flat else "</tbody>" if row == rows.get(key, -1) else "")
        elif tag == "table" and kind == OPEN and not any(_holds_word(tok, w) for w in either):
            d.tok[i] = add_class(tok, f"{prefix}tabla_horizontal")
    if d.tied:
        d.order([(p, *x[0], x[2]) for p, x in zip(d.pos, at)])
    d.drop_empty()


def split_resource_lines(d: Tokens) -> None:
    n = len(d.tok)
    breaks = [i for i, t in enumerate(d.tag) if t == "br"]
    cuts: dict[int, str] = {}
    if breaks:
        near = Neighbours(d)
        marked, after, p = [False] * n, None, None
        for i in range(n - 1, -1, -1):
            marked[i] = after is not None and d.tag[i] == "br" and _RESOURCE_LEADING.match(d.tok[after]) is not None
            if not _EMPTY.match(d.tok[i]):
                after = i
        for i, (kind, tag) in enumerate(zip(d.kind, d.tag)):
            if tag == "p" and kind != VOID:
                p = d.tok[i] if kind == OPEN else ""
            elif marked[i] and p:
                cuts[i] = p
    pieces = []
    if cuts:
        following = None
        for i in range(n - 1, -1, -1):
            if i in cuts:
                parts = [cuts[i]] if near.of(i, -1) == "p" else ["</p>", cuts[i]]
            else:
                parts = [] if d.tag[i] == "p" and d.kind[i] == OPEN and following in cuts else [d.tok[i]]
            pieces.append(parts)
            if not blank(d.tok[i]):
                following = i
        pieces.reverse()
        rows = [(d.pos[i], k, t) for i, parts in enumerate(pieces) for k, t in enumerate(parts)]
        if d.tied:
            rows.sort(key=lambda r: r[:2])
        d.retell([t for _, _, t in rows])
    else:
        d.retell(d.tok)
    d.pos, d.tied = [], False


def resource_lines(d: Tokens, prefix: str) -> None:
    found = {i: m[1] for i, k in enumerate(d.kind) if k == BRACKET and (m := _RESOURCE.match(d.tok[i]))}
    if not found:
        return
    near = Neighbours(d)
    kinds: dict[int, str] = {}
    for i, word in found.items():
        p1, n1 = near.of(i, -1), near.of(i, 1)
        if p1 is not None and n1 is not None and (p1 == "p" or (p1[1:2] != "/" and _begins(p1, ("li",)))) and n1 != "/p" and n1[:5].lower() != "</li>":
            kinds[i] = strip_diacritics(word.lower())
    if not kinds:
        return
    tok, following = d.tok[:], None
    for i in range(len(tok) - 1, -1, -1):
        kind, tag = d.kind[i], d.tag[i]
        if i in kinds:
            tok[i] = ""
        elif (tag == "p" or tag == "li") and kind == OPEN and following in kinds:
            tok[i] = add_class(tok[i], f"{prefix}recurso {prefix}recurso_{kinds[following]}")
        elif kind == TEXT and i - 1 in kinds:
            tok[i] = tok[i][m.end():] if (m := _LEADING_BLANK.match(tok[i])) else tok[i]
        if not _BLANK_ASCII.match(d.tok[i]):
            following = i
    d.tok = tok
    d.pos = [0] * len(tok)
    d.drop_empty()


def continue_lists(d: Tokens) -> None:
    if sum(t == "ol" and k == OPEN for t, k in zip(d.tag, d.kind)) < 2:
        return
    # depth before each token: stray end tags push neither below zero
    run = low = in_p = items = lists = 0
    in_list, at_items, at_lists, base = False, 0, 0, 0
    for i, (kind, tag) in enumerate(zip(d.kind, d.tag)):
        if tag is None:
            continue
        depth, container, opens = run - low, tag in _CONTAINERS, kind == OPEN
        top = depth == 0
        starts = top and ((opens and (container or tag == "p")) or (tag in ("img", "hr", "embed") and not in_p))
        ol = starts and tag == "ol"
        if starts:
            in_list = ol
        if ol:
            own = _HAS_START.search(d.tok[i]) is not None
            given = to_int(attr(d.tok[i], "start"))
        if (starts and (tag in _HEADINGS or tag == "ul")) or (ol and own):
            at_items, at_lists = items, lists
            base = (1 if given is None else given) - 1 if ol else 0
        if ol:
            start = items - at_items + base
            if not own and lists != at_lists and start > 0:
                d.tok[i] = f'{_before(_TAG_END, d.tok[i])} start="{start + 1}">'
            lists += 1
        if tag == "li" and opens and depth == 1 and in_list:
            items += 1
        if top:
            if tag == "p":
                in_p = 1 if opens else 0 if kind == CLOSE else in_p
            elif container and opens:
                in_p = 0
        if container:
            run += 1 if opens else -1 if kind == CLOSE else 0
        low = min(low, run)


def autolink(d: Tokens, url: re.Pattern, tail: re.Pattern) -> None:
    def link(m: re.Match) -> str:
        bare = tail.sub("", m[0])
        return f'<a href="{"https://" if bare.startswith("www.") else ""}{bare}">{bare}</a>{m[0][len(bare):]}'

    run, new = 0, {}
    for i, (kind, tag) in enumerate(zip(d.kind, d.tag)):
        if tag == "a":
            run += 1 if kind == OPEN else -1 if kind == CLOSE else 0
        elif run <= 0 and tag is None and ("www." in d.tok[i] or "http" in d.tok[i]):
            linked = url.sub(link, d.tok[i])
            if linked != d.tok[i]:
                new[i] = _PIECE.findall(linked) if kind == TEXT else [linked]
    if new:
        d.retell([t for i, tok in enumerate(d.tok) for t in (new[i] if i in new else (tok,))])


def external_links(d: Tokens) -> None:
    for i, tag in enumerate(d.tag):
        if tag == "a" and d.kind[i] == OPEN and (href := attr(d.tok[i], "href")) is not None and _EXTERNAL.match(href):
            d.tok[i] = f'{_before(_TAG_END, _TARGET.sub("", d.tok[i]))} target="_blank" rel="noopener noreferrer">'


def inline_images(d: Tokens, prefix: str) -> list[tuple[int, tuple[str, str, str, str]]]:
    """Images among text get their class and size. Where only the image's own header can tell the size, (place, (tag, what comes before the
    size, style, the tag without a size)) is left to the caller."""
    images = [i for i, t in enumerate(d.tag) if t == "img"]
    if not images:
        return []
    run = texts = seen = 0
    opened: dict[int, int] = {}
    held: dict[tuple[int, int], list[int]] = {}
    block: dict[int, tuple[int, int]] = {}
    for i, (kind, tag) in enumerate(zip(d.kind, d.tag)):
        depth = run
        if tag in _IMAGE_BLOCKS:
            if kind == OPEN:
                run = depth = run + 1
                opened[depth] = i
            elif kind == CLOSE:
                run -= 1
        elif tag is None:
            texts += has_text(d.tok[i])
        elif tag == "img":
            seen += 1
        key = (depth, opened[depth] if depth > 0 else -1)
        if tag == "img":
            block[i] = key
        h = held.get(key)
        if h is None:
            held[key] = [texts, seen, texts, seen]
        else:
            h[2], h[3] = texts, seen
    asked = []
    for i in images:
        tok, key = d.tok[i], block[i]
        bare = _DATA_SIZE.sub("", tok)
        first_text, first_seen, last_text, last_seen = held[key]
        if key[1] < 0 or not (last_text > first_text or last_seen - first_seen > 1):
            d.tok[i] = bare
            continue
        cls = add_class(bare, f"{prefix}img_inline")
        own = attr(tok, "style")
        before = _before(_VOID_END, _SIZE.sub("", cls))
        w, h = to_int(attr(tok, "data-w")), to_int(attr(tok, "data-h"))
        d.tok[i] = cls
        if w is not None and h is not None:
            if w >= 1 and h >= 1:
                px = f"width:{w}px;height:{h}px"
                d.tok[i] = f'{before} width="{w}" height="{h}" style="{f"{own};{px}" if own else px}" />'
        elif "data:image/" in tok:
            asked.append((i, (tok, before, f"{own};" if own else "", cls)))
    return asked


_IMAGE = pa.struct([("tok", pa.string()), ("before", pa.string()), ("style", pa.string()), ("plain", pa.string())])
MADE = "html array<string>, images array<struct<tok:string,before:string,style:string,plain:string>>"


def passes(texts: list[str], prefix: str, url: re.Pattern, tail: re.Pattern) -> tuple[list[str], list[tuple]] | None:
    """The markup of the documents of one id after all passes, cut at the images whose size is still to be read, and these images; None
    without any token."""
    d = cut(texts)
    form_boxes(d, prefix)
    orient_tables(d, prefix)
    structure_tables(d, prefix)
    split_resource_lines(d)
    resource_lines(d, prefix)
    continue_lists(d)
    autolink(d, url, tail)
    external_links(d)
    asked = inline_images(d, prefix)
    if not d.tok:
        return None
    ends = [-1, *(i for i, _ in asked), len(d.tok)]
    return ["".join(d.tok[a + 1:b]) for a, b in zip(ends, ends[1:])], [x for _, x in asked]


def run(prefix: str, url: str, tail: str):
    """`passes` for Arrow batches of (doc_id, texts of that id)."""
    url, tail = re.compile(java(url)), re.compile(java(tail))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, html, images = [], [], []
            for row, texts in enumerate(batch.column(1)):
                made = passes(texts.as_py() or [], prefix, url, tail)
                if made:
                    rows.append(row)
                    html.append(made[0])
                    images.append([dict(zip(("tok", "before", "style", "plain"), x, strict=True)) for x in made[1]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(html, pa.list_(pa.string())),
                                              pa.array(images, pa.list_(_IMAGE))], names=["doc_id", "html", "images"])

    return each
