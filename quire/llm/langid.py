"""Language identification by cross-parsing: a text is cut greedily into the longest phrases that a language's labelled text holds;
the language that needs the fewest phrases, weighed by the bits that point to a place in its text, wins.

Each language's suffix automaton becomes an array of its transitions alone, so the alphabet has no limit: every learned letter is a
symbol. A missing transition starts the next phrase. All texts of a batch walk their arrays in step, in stretches of `STRETCH` code points that start a phrase of their own.

Learned from a bounded sample: per language at most `SAMPLE_DOCS` labelled documents in the order of a hash of their ids, of which
as many as give `SAMPLE_CHARS` code points. Whole texts are scored.

Defined cases: `und` with score 0 if a text is null or has no letter, or if nothing could be learned; equal languages: the smaller
name; repeated rows are scored each; a null doc_id is in fold 0; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns

SAMPLE_DOCS, SAMPLE_CHARS, SHORT_BYTES = 64, 32_000, 8_192
STRETCH, LANES = 1024, 4096
UNKNOWN, BLANK, PAD = 0, 1, 2
UND = "und"

_models: dict = {}


def automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a text, by state; 0 is the start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in symbols.tolist():
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and c not in go[at]:
            go[at][c] = new
            at = link[at]
        if at >= 0:
            to = go[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(go)
                go.append(dict(go[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                link[to] = link[new] = twin
                while at >= 0 and go[at].get(c) == to:
                    go[at][c] = twin
                    at = link[at]
        last = new
    return go


def plain(text: str) -> str:
    return text.lower()


def packed(go: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """An automaton's transitions in one array, and those of its start. A state is the number from which its transitions are laid:
    place state + symbol holds (state, next state, 0), rows of several states interleaved. The start is 0 and has no places, as what
    a state lacks is found in the second array: by symbol (next state, 1), the mark of a new phrase."""
    places = 1 << (3 * sum(map(len, go)) + width).bit_length()
    owner, to, base = [-1] * places, [0] * places, [0] * len(go)
    used, at = {0}, 0
    for state in sorted(range(1, len(go)), key=lambda s: (-len(go[s]), s)):
        row = go[state]
        for _ in range(64):  # a sequence that meets every number
            at = (at * 0x5851F42D + 0x3C6EF35F) % places
            if at not in used and at + width <= len(owner) and all(owner[at + c] < 0 for c in row):
                break
        else:
            at = len(owner)
            owner += [-1] * width
            to += [0] * width
        used.add(at)
        base[state] = at
        for c, target in row.items():
            owner[at + c], to[at + c] = at, target
        at %= places
    base = np.array(base, dtype=np.int64)
    table = np.array(owner + [-1] * width, dtype=np.int64) << 32 | base[np.array(to + [0] * width)] << 1
    start = np.ones(width, dtype=np.int64)  # a symbol the language lacks is a phrase, then a new start
    for c, target in go[0].items():
        start[c] = base[target] << 1 | 1
    start[PAD] = 0  # ends a stretch, without a phrase
    return table, start


class Model:
    """samples: (language, text), sorted. Every letter of the samples has a symbol of its own; UNKNOWN is any other letter, BLANK
    what is no letter."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [name for name, _ in samples]
        letters = sorted({c for _, text in samples for c in plain(text) if c.isalpha()})
        width = PAD + 1 + len(letters)
        self.code = np.where(np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000), UNKNOWN, BLANK).astype(np.min_scalar_type(width))
        self.code[np.array([ord(c) for c in letters], dtype=np.int64)] = np.arange(PAD + 1, width)
        self.tables, self.bits = [], []
        for _, text in samples:
            symbols = self.symbols(text)
            self.tables.append(packed(automaton(symbols), width))
            self.bits.append(np.log2(max(len(symbols), 2)))

    def symbols(self, text: str) -> np.ndarray:
        got = self.code[np.frombuffer(plain(text).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        return got[~((got == BLANK) & (np.concatenate(([BLANK], got[:-1])) == BLANK))]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases by text and language. A phrase is counted where it starts: at a stretch's first symbol (the start's
        transitions carry the mark) and at each missing transition."""
        runs = [self.symbols(t) for t in texts]
        out = np.zeros((len(texts), len(self.languages)))
        owner = np.repeat(np.arange(len(texts)), [-(-len(r) // STRETCH) for r in runs])
        cut = [r[i:i + STRETCH] for r in runs for i in range(0, len(r), STRETCH)]
        order = np.argsort([-len(c) for c in cut], kind="stable")
        for at in range(0, len(cut), LANES):
            lanes = order[at:at + LANES]
            size = np.array([len(cut[i]) for i in lanes])
            block = np.full((len(lanes), size[0]), PAD, dtype=self.code.dtype)
            for j, i in enumerate(lanes):
                block[j, :size[j]] = cut[i]
            steps = np.ascontiguousarray(block.T).astype(np.int32)
            live = [int(np.searchsorted(-size, -t, side="left")) for t in range(len(steps))]  # lanes longer than t
            for k, (table, start) in enumerate(self.tables):
                state, count = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
                for t, n in enumerate(live):
                    v = table[state[:n] + steps[t, :n]]
                    v = np.where(v >> 32 == state[:n], v & 0xFFFFFFFF, start[steps[t, :n]])
                    count[:n] += v & 1
                    np.right_shift(v, 1, out=state[:n])
                np.add.at(out[:, k], owner[lanes], count)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts))
        cost = self.phrases(texts) * np.array(self.bits)
        best = cost.argmin(1)
        score = 1 / np.exp2(np.maximum(cost.min(1)[:, None] - cost, -1000)).sum(1)
        known = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
        return [self.languages[b] if k else UND for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def model_of(samples: tuple) -> Model:
    """One a worker process."""
    if samples not in _models:
        _models.clear()
        _models[samples] = Model(samples)
    return _models[samples]


def learn(docs: DataFrame, held_out: Column) -> tuple[tuple[str, str], ...]:
    """docs(doc_id, text, lang) -> a bounded sample (language, text) for each language, short documents first."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & ~held_out)
    first = Window.partitionBy("lang").orderBy(F.octet_length("text") > SHORT_BYTES, F.xxhash64("doc_id"), "text")
    rows = rows.select("lang", "text", F.row_number().over(first).alias("_n")).where(F.col("_n") <= SAMPLE_DOCS)
    texts: dict[str, str] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["_n"])):
        if len(texts.get(r["lang"], "")) < SAMPLE_CHARS:
            texts[r["lang"]] = (texts.get(r["lang"], "") + r["text"] + "\n")[:2 * SAMPLE_CHARS]
    return tuple(sorted(texts.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """Adds lang_pred and score to docs(text, ...)."""
    def score(batch: pa.RecordBatch):
        texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        model, names, scores, at = model_of(samples), [], [], 0
        while at < len(texts):
            end, held = at + 1, len(texts[at])
            while end < len(texts) and held + len(texts[end]) <= LANES * STRETCH:
                held += len(texts[end])
                end += 1
            got, sure = model.predict(texts[at:end])
            names += got
            scores.append(sure)
            at = end
        return [pa.array(names, pa.string()), pa.array(np.concatenate(scores), pa.float64())]

    return map_columns(docs, [("lang_pred", "string"), ("score", "double")], score)
