"""Toxicity by a counterfactual-regularised classifier: a logistic model over words and word beginnings, fitted with a penalty on how
much a labelled sentence's score changes when its identity terms are swapped for others of their kind.

Few labelled texts may hold such a term, or none, while its beginnings speak for a label all the same. So the penalty also has a counterfactual for
every term that fewer than `LEAST_MENTIONS` of them hold: labelled sentences with the term put in, against the same with its swap. No label
is needed for it, and in a model that adds up words the rest of the sentence cancels, so one row a term stands for them all. The model
tells how many texts held a term (`mentions`) and how many terms were put in (`put_in`).

Fitted on the driver on at most `SAMPLE` labelled texts of at most `LEARN_BYTES` each; whole texts of all rows are scored.

Defined cases: a null or empty text has no words and gets the score of the intercept; without labels of both kinds the score is the
smoothed share of label 1; repeated rows are scored each; a null doc_id is in fold 0 and never learned from; columns of the input
stay, one named like an output column is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

SAMPLE, LEARN_BYTES = 5_000, 16_384
#: of the words and beginnings in so many texts, those whose share in toxic texts is higher by so many standard errors, the strongest first
LEAST_DOCS, STRENGTH, FEATURES = 3, 4.0, 1_024
STEMS = (4, 5, 6, 7, 8)
RIDGE, SWAP, STEPS = 5e-4, 5.0, 1_000
LEAST_MENTIONS = 20
WORDS_KEPT = 400_000
WORD = re.compile(r"[^\W\d_]+")

# Terms of one line are swapped for each other.
IDENTITY = """
women men | woman man | girls boys | girl boy | female male | mother father | wife husband
muslims christians jews hindus buddhists atheists | muslim christian jewish hindu buddhist atheist
black white asian latino arab | africans europeans asians americans | gay straight lesbian bisexual | transgender cisgender
immigrants refugees foreigners locals | disabled blind deaf | elderly young
frauen männer | frau mann | muslime christen juden | ausländer einheimische | schwule lesben
femmes hommes | femme homme | musulmans chrétiens juifs | étrangers immigrés réfugiés
mujeres hombres | mujer hombre | musulmanes cristianos judíos | inmigrantes extranjeros refugiados
"""

_memo: dict = {}


def swaps() -> dict[str, str]:
    """Each identity term's next one of its kind."""
    groups = [g.split() for line in IDENTITY.strip().splitlines() for g in line.split("|")]
    return {a: b for g in groups for a, b in zip(g, g[1:] + g[:1], strict=True)}


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked as such."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


@dataclass(frozen=True)
class ToxicityModel:
    base: float
    weights: tuple[tuple[str, float], ...]
    mentions: int = 0
    put_in: int = 0

    def scorer(self):
        """Texts -> scores; the weight of a word is kept once known."""
        if _memo.get("model") != self:
            _memo.update(model=self, weights=dict(self.weights), words={})
        weights, known = _memo["weights"], _memo["words"]

        def weight(word: str) -> float:
            got = known.get(word)
            if got is None:
                if len(known) > WORDS_KEPT:
                    known.clear()
                got = known[word] = sum(weights.get(f, 0.0) for f in features_of(word))
            return got

        # sorted, so that equal texts get equal sums wherever they are scored
        return lambda text: 1 / (1 + np.exp(-np.clip(self.base + sum(sorted(map(weight, words_of(text)))), -40, 40)))


def counts(words: set[str]) -> Counter:
    return Counter(f for w in words for f in features_of(w))


def fit_texts(texts: list[str], y: np.ndarray, swap: float = SWAP, least: int = LEAST_MENTIONS) -> ToxicityModel:
    """swap: the weight of the penalty; least: terms that fewer texts hold are put in (0: none)."""
    y = np.asarray(y, dtype=float)
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return ToxicityModel(float(np.log(share / (1 - share))), ())
    bags = [words_of(t) for t in texts]
    # only what toxic texts hold can speak for toxicity, so only that is counted
    toxic = Counter(f for bag, label in zip(bags, y, strict=True) if label for f in counts(bag))
    toxic = {f: c for f, c in toxic.items() if c >= LEAST_DOCS}
    clean = Counter(f for bag, label in zip(bags, y, strict=True) if not label for f in counts(bag) if f in toxic)
    n = np.array([(y == 0).sum(), (y == 1).sum()])

    def strength(f: str) -> float:
        a, b = clean[f] / n[0], toxic[f] / n[1]
        p = (clean[f] + toxic[f]) / n.sum()
        return (b - a) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-9)

    usual = {f: strength(f) for f in toxic}
    names = sorted((f for f, s in usual.items() if s >= STRENGTH), key=lambda f: (-usual[f], f))[:FEATURES]
    at = {f: i for i, f in enumerate(names)}

    def rows(bags: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(bags), len(names) + 1))
        out[:, -1] = 1
        for i, bag in enumerate(bags):
            for f, c in counts(bag).items():
                if f in at:
                    out[i, at[f]] = c
        return out

    x, to = rows(bags), swaps()
    mentions = [i for i, bag in enumerate(bags) if not to.keys().isdisjoint(bag)]
    change = x[mentions] - rows([{to.get(w, w) for w in bags[i]} for i in mentions])
    held = Counter(w for i in mentions for w in bags[i] if w in to)
    rare = [(a, b) for a, b in to.items() if held[a] < least]
    change = np.concatenate([change, rows([{a} for a, _ in rare]) - rows([{b} for _, b in rare])])
    scale = np.sqrt((x ** 2).mean(0))  # rare words move as fast as frequent ones
    x, change = x / scale, change / scale
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 0
    top = np.linalg.norm(x, 2) ** 2 / (4 * len(y)) + RIDGE
    if len(change):
        top += 2 * swap * np.linalg.norm(change, 2) ** 2 / len(change)
    w = v = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(STEPS):
        pull = x.T @ (1 / (1 + np.exp(-np.clip(x @ v, -40, 40))) - y) / len(y) + ridge * v
        if len(change):
            pull += 2 * swap * change.T @ (change @ v) / len(change)
        new, later = v - pull / top, (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / later * (new - w), later
    w = w / scale
    return ToxicityModel(float(w[-1]), tuple(zip(names, w[:-1].tolist(), strict=True)), len(mentions), len(rare))


def fit(rows: DataFrame, swap: float = SWAP) -> ToxicityModel:
    """rows(text, _label, _order): the bounded sample, see common.learning_sample."""
    short = rows.where(F.octet_length(F.coalesce("text", F.lit(""))) <= LEARN_BYTES).select("_order", "_label", F.coalesce("text", F.lit("")).alias("text"))
    got = sorted((tuple(r) for r in short.collect()))
    return fit_texts([t for _, _, t in got], np.array([label for _, label, _ in got]), swap)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs(text, ...) with score (0 to 1) and predicted (1 if score >= 0.5)."""
    def run(batch: pa.RecordBatch):
        scorer = model.scorer()
        got = np.array([scorer(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
        return [pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32), pa.int32())]

    return map_columns(docs, [("score", "double"), ("predicted", "int")], run)
