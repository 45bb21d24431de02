"""Each stage of the pipeline on a small table against a plain restatement, and the whole run."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from quire.llm import linededup, packing, rules
from quire.llm.common import learning_sample
from quire.llm.queries import word_bpe

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _order int, _label int, _drops int, _id int, _null int, row string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def bench_text(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]


@pytest.fixture(scope="module")
def rows(bench_text):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    shared = [" ".join(word() for _ in range(6)) + " Shared line" for _ in range(6)]
    made = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(rng.randrange(3, 40))) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            lines.insert(0, " " + shared[i % 6].upper() + "\t")
        if i % 7 == 0:
            lines += bench_text[i % len(bench_text)].split("\n")
        made.append((i, "\n".join(lines)))
    for i in range(60, 90):
        words = made[rng.randrange(20)][1].split(" ")
        if i % 3:
            words[rng.randrange(len(words))] = "changed"
        made.append((i, " ".join(words)))
    made += [(90, None), (91, ""), (92, " \n "), (93, "x " * 20_000), (93, "other text of this id"), (None, "no id"), (None, None)]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 7, 1, 1, 1, 1, 1, "r") for i, t in rows], FIELDS).repartition(5)


def texts(df):
    assert df.columns == pipe.COLUMNS
    return sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in df.collect()), key=repr)


def test_quality_keeps_what_the_score_accepts(spark, docs, rows):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = rules.fit(learning_sample(docs, labels, "quality", 3, 1, rules.SAMPLE))
    want = [(r["doc_id"], r["text"], 7) for r in rules.score(docs, model).collect() if r["predicted"] == 1]
    assert texts(pipe.quality(spark, docs, SF)) == sorted(want, key=repr)
    assert pipe.quality(spark, docs.limit(0), SF).count() == 0


def test_a_filter_does_not_repeat_the_statistics(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    def calls(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("split("), plan.count("regexp_replace(")
    model = rules.fit(learning_sample(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality", 3, 1, rules.SAMPLE))
    assert calls(pipe.quality(spark, docs, SF)) == calls(rules.score(docs, model))


def test_lines(spark, docs, rows):
    ids, keys = {}, lambda t: [lower(x.strip(" \t\n\v\f\r")) for x in t.split("\n")]
    for i, t in rows:
        for k in keys(t or ""):
            if i is not None and len(k) >= linededup.MIN_CHARS:
                ids.setdefault(k, set()).add(i)
    gone = {(k, i) for k, s in ids.items() if len(s) >= linededup.MIN_DOCS for i in s if i != max(s)}
    assert gone
    want = []
    for i, t in rows:
        kept = None if t is None else "\n".join(x for x, k in zip(t.split("\n"), keys(t), strict=True) if (k, i) not in gone)
        want.append((i, kept, 7 if t is None else len(kept)))
    assert texts(pipe.lines(spark, docs, SF)) == sorted(want, key=repr)


def test_near(spark, docs, rows):
    def shingles(t):
        w = [x for x in re.split("[ \t\n\v\f\r]+", lower(t or "")) if x]
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    sets = [(i, s) for i, t in rows if i is not None and (s := shingles(t))]
    near = {i: {i} for i, _ in sets}
    for a, x in sets:
        for b, y in sets:
            if 100 * len(x & y) >= 80 * len(x | y):
                near[a].add(b)
    for _ in near:
        near = {i: set().union(*(near[j] for j in s)) for i, s in near.items()}
    want = [(i, t, 7) for i, t in rows if i is None or i not in near or min(near[i]) == i]
    assert len(want) < len(rows)
    assert texts(pipe.near(spark, docs, SF)) == sorted(want, key=repr)


def test_benchmark(spark, docs, rows, bench_text):
    words = lambda t: [x for x in re.split("[\x00-/:-`{-\x7f]+", lower(t or "")) if x]
    grams = set()
    for t in bench_text:
        w = words(t)
        n = min(13, len(w))
        grams |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
    widths = {len(g) for g in grams}
    want = []
    for i, t in rows:
        w, hit = words(t), set()
        for n in widths:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in grams:
                    hit |= set(range(p, p + n))
        if not (hit and 20 * len(hit) >= len(w)):
            want.append((i, t, 7))
    assert len(want) < len(rows)
    assert texts(pipe.benchmark(spark, docs, SF)) == sorted(want, key=repr)


def test_pack(spark, docs, rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(word_bpe())
    tok.encode_special_tokens = True
    sizes = sorted(((i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows), key=repr)
    pieces = pipe.pack(spark, docs, SF).collect()
    seqs = {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in seqs.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[0][0] == 0
        total = sum(n for _, n in s)
        assert total == packing.CAPACITY or total & (total - 1) == 0
    assert sum(p["length"] for p in pieces) == sum(n for _, n in sizes)
    assert sorted({(p["doc_id"], p["doc_tokens"]) for p in pieces}, key=repr) == sorted(set(sizes), key=repr)


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for _, stage in pipe.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    assert 0 < docs.count() < n
    assert docs.select("doc_id").distinct().orderBy("doc_id").collect() == pipe.run(spark, SF).select("doc_id").distinct().orderBy("doc_id").collect()
    tokens = pipe.run(spark, SF).agg(F.sum("length")).first()[0]
    assert tokens == packing.pack(docs, word_bpe()).agg(F.sum("length")).first()[0]
