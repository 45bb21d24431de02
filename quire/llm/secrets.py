"""Secret scan: base patterns, and a linear-chain conditional random field that tags tokens as secret begin, inside or outside.

Base spans: per kind the leftmost non-overlapping matches that are long enough. The field adds spans; base spans always stay.

Tokens are runs of letters, digits and a few joining marks, or one other mark. Features: the token's own shape (length, digits,
case, hex, mixture), the shapes and key words of its neighbours, and two of the whole file. It is trained here on at most `SAMPLE`
texts, with the base spans as the tags, by maximum likelihood with a ridge penalty; words themselves are no features, so unseen
secrets of a known shape are found.

Tagging is exact Viterbi. Most tokens are plain words: a token whose outside score leads both secret tags by more than the transitions
can make up for is outside on the best path, so the chain is cut there and only what lies between such tokens is decoded. As inside
can't follow outside, an inside after such a token would turn into a begin, and the lead makes up for that loss too.

Defined cases: a null or empty text has no tokens and no spans; very long texts are scanned whole; repeated rows are scanned each; a
null doc_id is allowed; without any base span to learn from the field adds nothing; empty tables give no rows; columns of the input
stay, one named like an output column is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
ASSIGN_CHARS = 6

SAMPLE, LEARN_BYTES, STEPS, RIDGE = 400, 8_192, 120, 0.3
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
TOKEN = re.compile(r"[\w+/-]+|[^\s\w+/-]")
#: training chains lie around tokens with one of these: a digit, a key word, an assignment mark or great length
NOTABLE = re.compile(r"[0-9:=]|[A-Za-z0-9+/_-]{16,}|password|passwd|secret|token|api_?key", re.I | re.A)
SHAPES = ("one", "long8", "long16", "long24", "digit", "digits", "upper", "lower", "mixed", "hex", "joins", "keyword", "assigns", "quote", "plain")
WORDS_KEPT = 400_000
FILE = ("file_keyword", "file_long")


def has_keyword(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in KEYWORDS)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if has_keyword(text):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def shape(token: str) -> list[int]:
    """The numbers of the token's shape features."""
    n, digits = len(token), sum(c.isdigit() for c in token)
    upper, lower = any("A" <= c <= "Z" for c in token), any("a" <= c <= "z" for c in token)
    held = (n == 1, n >= 8, n >= 16, n >= 24, digits > 0, 4 * digits >= n, upper, lower, upper + lower + (digits > 0) >= 2,
            n >= 8 and all(c in "0123456789abcdef" for c in token), any(c in "+/_-" for c in token), has_keyword(token),
            token in ":=", token in "\"'", n < 16 and digits == 0)
    return [i for i, x in enumerate(held) if x]


#: a token's features: its own shape, those of two neighbours on each side, the file's and a constant
OFFSETS = (-2, -1, 0, 1, 2)
WIDTH = len(OFFSETS) * len(SHAPES) + len(FILE) + 1


def features(shapes: list[list[int]], file: list[int], at: int) -> list[int]:
    out = [len(OFFSETS) * len(SHAPES) + f for f in file]
    out.append(WIDTH - 1)
    for k, offset in enumerate(OFFSETS):
        if 0 <= at + offset < len(shapes):
            out += [k * len(SHAPES) + s for s in shapes[at + offset]]
    return out


def file_features(shapes) -> list[int]:
    """Whether any of a text's shapes has a key word, or great length."""
    return [i for i, name in enumerate(("keyword", "long24")) if any(SHAPES.index(name) in s for s in shapes)]


@dataclass(frozen=True)
class Field:
    emit: tuple[tuple[float, ...], ...]   # WIDTH x 3
    move: tuple[tuple[float, ...], ...]   # 3 x 3, from and to; outside to inside is barred
    start: tuple[float, ...]


def chain_sums(emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of tags and of tag pairs, and the log partition sum, by forward and backward sums in logs."""
    n = len(emit)
    ahead, back = np.empty((n, 3)), np.zeros((n, 3))
    ahead[0] = emit[0] + start
    for t in range(1, n):
        ahead[t] = emit[t] + np.logaddexp.reduce(ahead[t - 1][:, None] + move, axis=0)
    for t in range(n - 2, -1, -1):
        back[t] = np.logaddexp.reduce(move + (emit[t + 1] + back[t + 1])[None, :], axis=1)
    total = float(np.logaddexp.reduce(ahead[-1]))
    pairs = np.exp(ahead[:-1, :, None] + move[None] + (emit[1:] + back[1:])[:, None, :] - total).sum(0) if n > 1 else np.zeros((3, 3))
    return np.exp(ahead + back - total), pairs, total


BARRED = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]], dtype=float)  # an inside needs a begin before it


def windows_of(text: str) -> list[tuple[list[list[int]], list[int], list[int]]]:
    """Training chains: the tokens around the notable ones of a text, with tags from the base spans."""
    tokens, spans = list(TOKEN.finditer(text)), base_spans(text)
    shapes, tags, at = [shape(m[0]) for m in tokens], [], 0
    spans.sort(key=lambda s: s[1])
    before = None
    for m in tokens:
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        span = spans[at] if at < len(spans) and spans[at][1] <= m.start() < spans[at][2] else None
        secret = span is not None and (span[0] != "assign" or not (has_keyword(m[0]) or m[0] in ":=\"'"))
        tags.append(OUTSIDE if not secret else INSIDE if before == span else BEGIN)
        before = span if secret else None
    file, near = file_features(shapes), set()
    for i, m in enumerate(tokens):
        if NOTABLE.search(m[0]):
            near.update(range(max(0, i - 3), min(len(tokens), i + 4)))
    chains, chain = [], []
    for i in sorted(near):
        if chain and i != chain[-1] + 1:
            chains.append(chain)
            chain = []
        chain.append(i)
    if chain:
        chains.append(chain)
    return [([features(shapes, file, i) for i in c], file, [tags[i] for i in c]) for c in chains]


def train(texts: list[str]) -> Field | None:
    """The field of most likelihood with a ridge penalty, by RPROP steps over all chains; None without a secret to learn."""
    chains = [(f, np.array(tags)) for t in texts for f, _, tags in windows_of(t)]
    if not any((tags != OUTSIDE).any() for _, tags in chains):
        return None
    dense = []
    for f, tags in chains:
        x = np.zeros((len(f), WIDTH))
        for i, on in enumerate(f):
            x[i, on] = 1
        dense.append((x, tags))
    emit, move, start = np.zeros((WIDTH, 3)), np.zeros((3, 3)), np.zeros(3)
    params, steps, last = [emit, move, start], [np.full(p.shape, 0.05) for p in (emit, move, start)], [np.zeros(p.shape) for p in (emit, move, start)]
    seen_x = np.zeros((WIDTH, 3))
    seen_move, seen_start = np.zeros((3, 3)), np.zeros(3)
    for x, tags in dense:
        one = np.eye(3)[tags]
        seen_x += x.T @ one
        np.add.at(seen_move, (tags[:-1], tags[1:]), 1)
        seen_start[tags[0]] += 1
    for _ in range(STEPS):
        want = [RIDGE * p for p in params]
        want[0] -= seen_x
        want[1] -= seen_move
        want[2] -= seen_start
        for x, _ in dense:
            tag, pair, _ = chain_sums(x @ emit, move + BARRED, start + BARRED[0])
            want[0] += x.T @ tag
            want[1] += pair
            want[2] += tag[0]
        for p, g, s, old in zip(params, want, steps, last, strict=True):
            agree = np.sign(g) * np.sign(old)
            s *= np.where(agree > 0, 1.2, np.where(agree < 0, 0.5, 1.0))
            np.clip(s, 1e-6, 1.0, out=s)
            p -= np.sign(g) * s
            old[...] = g
    return Field(tuple(map(tuple, emit.tolist())), tuple(map(tuple, move.tolist())), tuple(start.tolist()))


def needed_leads(move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For begin and inside: what the transitions around a token can lose at most by making it outside, where the next tag is not
    inside or there is none, and where it is inside and becomes begin."""
    into = np.vstack([move, start])  # from a tag or the chain's start
    after = np.hstack([move, np.zeros((3, 1))])  # to a tag or the chain's end
    ahead = [(into[:, x] - into[:, OUTSIDE]).max() for x in (BEGIN, INSIDE)]
    stays = [(after[x] - after[OUTSIDE])[[OUTSIDE, BEGIN, 3]].max() for x in (BEGIN, INSIDE)]
    turns = [move[x, INSIDE] - move[OUTSIDE, BEGIN] + (after[INSIDE] - after[BEGIN]).max() for x in (BEGIN, INSIDE)]
    return np.add(ahead, stays), np.add(ahead, turns)


class Tagger:
    """Spans of a text by Viterbi. A token's scores are sums of table rows by the shape classes of it and its neighbours."""

    def __init__(self, field: Field):
        self.emit, free = np.array(field.emit), np.array(field.move)
        self.move, self.start = free + BARRED, np.array(field.start) + BARRED[0]
        #: by so much the transitions can favour begin and inside over outside at most: if what follows stays, and if an inside
        #: that follows turns into a begin
        self.stays, self.turns = needed_leads(self.move, self.start)
        self.classes: dict[tuple[int, ...], int] = {}
        self.known: dict[str, int] = {}
        self.rows: list[list[np.ndarray]] = [[] for _ in OFFSETS]

    def class_of(self, token: str) -> int:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > WORDS_KEPT:
                self.known.clear()
            held = tuple(shape(token))
            if held not in self.classes:
                self.classes[held] = len(self.classes)
                for k, rows in enumerate(self.rows):
                    rows.append(self.emit[[k * len(SHAPES) + i for i in held]].sum(0))
            got = self.known[token] = self.classes[held]
        return got

    def scores(self, tokens: list[str]) -> np.ndarray:
        ids = np.fromiter(map(self.class_of, tokens), dtype=np.int64, count=len(tokens))
        names = list(self.classes)
        file = file_features([names[i] for i in np.unique(ids)])
        out = np.tile(self.emit[WIDTH - 1] + self.emit[[len(OFFSETS) * len(SHAPES) + f for f in file]].sum(0), (len(tokens), 1))
        for offset, rows in zip(OFFSETS, self.rows, strict=True):
            table, n = np.array(rows), len(tokens) - abs(offset)
            if n > 0 and offset < 0:
                out[-offset:] += table[ids[:n]]
            elif n > 0:
                out[:n] += table[ids[offset:]]
        return out

    def sure(self, emit: np.ndarray) -> np.ndarray:
        """Which tokens are outside on the best path of the whole chain, whatever tags the others have."""
        lead = emit[:, OUTSIDE, None] - emit[:, 1:]
        loss = np.append(emit[1:, INSIDE] - emit[1:, BEGIN], -np.inf)  # of the next token, if it turns from inside to begin
        return ((lead > self.stays + 1e-9) & (lead > self.turns + loss[:, None] + 1e-9)).all(1)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        words = TOKEN.findall(text)
        if not words:
            return []
        emit = self.scores(words)
        open_tokens = np.flatnonzero(~self.sure(emit))
        if not len(open_tokens):
            return []
        tags = np.full(len(words), OUTSIDE)
        for part in np.split(open_tokens, np.flatnonzero(np.diff(open_tokens) > 1) + 1):
            a, b = part[0], part[-1] + 1
            tags[a:b] = self.viterbi(emit[a:b], a == 0, b < len(words))
        if not tags.any():
            return []
        spans, begun = [], None
        for m, tag in zip(TOKEN.finditer(text), tags.tolist(), strict=True):
            if begun is not None and tag != INSIDE:
                spans.append(("crf", *begun))
                begun = None
            if tag == BEGIN:
                begun = m.span()
            elif tag == INSIDE and begun is not None:
                begun = (begun[0], m.end())
        if begun is not None:
            spans.append(("crf", *begun))
        return spans

    def viterbi(self, emit: np.ndarray, first: bool, closed: bool) -> np.ndarray:
        """The best tags of a stretch; outside stands before it unless it is first, and after it if it is closed."""
        best = emit[0] + (self.start if first else self.move[OUTSIDE])
        back = np.zeros((len(emit), 3), dtype=int)
        for t in range(1, len(emit)):
            ways = best[:, None] + self.move
            back[t] = ways.argmax(0)
            best = ways.max(0) + emit[t]
        if closed:
            best = best + self.move[:, OUTSIDE]
        tags = np.empty(len(emit), dtype=int)
        tags[-1] = best.argmax()
        for t in range(len(emit) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


_taggers: dict = {}


def tagger_of(field: Field) -> Tagger:
    """One a worker process."""
    if field not in _taggers:
        _taggers.clear()
        _taggers[field] = Tagger(field)
    return _taggers[field]


def learn(docs: DataFrame) -> Field | None:
    """docs(doc_id, text) -> a field trained on a bounded sample: texts that hold a key word, a long hex run or an access key."""
    text = F.col("text")
    likely = text.rlike("(?i)password|passwd|secret|token|api_?key") | text.rlike("AKIA[A-Z0-9]{16}") | text.rlike("[0-9a-f]{24}")
    rows = docs.where(text.isNotNull() & (F.octet_length(text) <= LEARN_BYTES) & likely)
    got = rows.select(F.xxhash64("text").alias("_order"), "text").orderBy("_order", "text").limit(SAMPLE).collect()
    return train([r["text"] for r in got])


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """docs(text, ...) with base and spans: arrays of (kind, start, end) in code points; spans holds the base spans and the field's."""
    def run(batch: pa.RecordBatch):
        tagger = tagger_of(field) if field else None
        base, spans = [], []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            own = base_spans(text or "")
            more = tagger.spans(text) if tagger and text else []
            base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in own])
            every = sorted({*own, *more}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in every])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return [pa.array(base, kind), pa.array(spans, kind)]

    spans = "array<struct<kind:string,start:int,end:int>>"
    return map_columns(docs, [("base", spans), ("spans", spans)], run)
