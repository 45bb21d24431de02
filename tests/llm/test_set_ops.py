"""Near-duplicates, decontamination, line dedup and search against brute force, with skew and odd rows."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quire.llm import decontam, linededup, neardup, vafile

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "x " * 20_000)]


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgh", k=4)) for _ in range(n)]


def brute_components(rows, width=4, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_neardup_equals_brute_force(docs_of):
    rng, rows = random.Random(5), list(ODD)
    base = words(1, 120)
    for i in range(60):  # a group whose members reach each other only over others
        w = base[:]
        for k in rng.sample(range(120), rng.randint(0, 8)):
            w[k] = f"new{i}x{k}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, " ".join(words(100 + i, 40))) for i in range(20)] + [(300 + i, " ".join(base)) for i in range(30)]
    chain = words(7, 100)
    rows += [(400 + i, " ".join(chain[:100 - 2 * i] + words(500 + i, 2 * i))) for i in range(8)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.group(docs_of(rows), width=4).collect()}
    assert got == brute_components(rows)
    assert neardup.group(docs_of([])).count() == 0
    assert neardup.group(docs_of([(None, "a b"), (None, None)])).where("component_id is null").count() == 2


def test_neardup_texts_of_one_repeated_word(docs_of):
    """A text of exactly `width` words has the hash of that shingle in longer texts."""
    rows = [(1, "x x x x"), (2, "x x x x x x"), (3, "x x x"), (4, "y y y y y"), (5, "Y y y y")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.group(docs_of(rows), width=4).collect()}
    assert got == brute_components(rows) and [got[i][1] for i in range(1, 6)] == [1, 1, 3, 4, 4]


def test_neardup_ids_that_repeat(docs_of):
    """An id stands for all its rows: each of its texts has links of its own."""
    one, two, three = (words(s, 60) for s in (21, 22, 23))
    near = lambda w, i: " ".join([*w[:57], f"other{i}"])
    rows = [(8, " ".join(one)), (8, " ".join(two)), (2, near(one, 1)), (9, near(two, 2)), (11, near(two, 3)),  # 8 ties two groups
            (5, " ".join(three)), (7, " ".join(three)), (7, " ".join(words(24, 60))), (3, " ".join(words(25, 60)))]
    got = {(r["doc_id"], r["component_id"]) for r in neardup.group(docs_of(rows), width=4).collect()}
    assert got == {(8, 2), (2, 2), (9, 2), (11, 2), (5, 5), (7, 5), (3, 3)}


def test_sketches_merge_and_estimate():
    a, b = (neardup.shingles(" ".join(words(s, 400)).encode(), 4) for s in (1, 2))
    both = np.unique(np.concatenate([a, b]))
    assert (neardup.merge(neardup.sketch(a), neardup.sketch(b)) == neardup.sketch(both)).all()
    near = neardup.estimate(neardup.sketch(a)[None], neardup.sketch(both)[None], np.array([len(a)]), np.array([len(both)]))
    assert abs(near[0] - len(a) / len(both)) < 0.15


def test_decontamination_equals_brute_force(docs_of, spark):
    rng, item = random.Random(6), words(3, 40)
    items = [(1, " ".join(item)), (2, "short one"), (10, " ".join(item[20:])), (3, None), (4, "..."), (None, "ignored item"), (2, "short one"), (5, "the " * 15)]
    rows = list(ODD) + [(20 + i, " ".join(words(900 + i, 30) + item[k:k + n] + words(950 + i, 5))) for i, (k, n) in enumerate(
        [(0, 40), (5, 12), (5, 13), (27, 13), (20, 20), (0, 1)])]
    rows += [(40, "It is a SHORT, one; thing"), (41, "the " * 14), (42, "the " * 12), (None, " ".join(item)), (43, " ".join(item + item))]
    rows += [(60 + i, " ".join(rng.choices(item, k=60))) for i in range(10)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    import re
    split = lambda t: [w for w in re.split(decontam.SEPARATOR, (t or "").lower()) if w]
    wins = defaultdict(set)
    for i, t in items:
        w = split(t)
        if i is not None and w:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                wins[tuple(w[k:k + n])].add(str(i))
    want = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k:k + n])]
        want.append((str(i), len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = [(str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontam.scan(docs_of(rows), bench).collect()]
    assert sorted(got) == sorted(want)
    assert decontam.scan(docs_of([]), bench).count() == 0
    assert decontam.scan(docs_of(rows), bench.limit(0)).where("n_hit > 0").count() == 0


def brute_lines(rows):
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        out[i] = "\n".join(x for x in lines if len(held[key(x)]) < 3 or i == max(held[key(x)]))
    return out


def test_lines_can_be_undone(docs_of, spark):
    common, pair = "This line is common to MANY documents", "a line that only two documents share"
    rows = ODD + [(10 + i, f"start {i}\n {common.upper() if i % 2 else common}\t\n{pair if i < 2 else 'own line of this document ' + str(i)}\nend") for i in range(8)]
    base, more = [r for r in rows if r[0] < 16], [r for r in rows if r[0] >= 16]
    kept = lambda docs, index: {r["doc_id"]: r["text"] for r in linededup.apply(docs, index).collect()}
    index = linededup.build(docs_of(base))
    assert kept(docs_of(base), index) == brute_lines(base)
    grown = linededup.insert(index, docs_of(more))
    assert kept(docs_of(rows), grown) == brute_lines(rows)
    back = linededup.delete(grown, docs_of(more))
    assert kept(docs_of(base), back) == brute_lines(base)
    few = [r for r in base if r[0] not in (10, 11, 12, 13)]
    gone = linededup.delete(back, docs_of([r for r in base if r[0] in (10, 11, 12, 13)]))
    assert kept(docs_of(few), gone) == brute_lines(few)
    twice = docs_of([(1, common), (1, common), (2, common), (None, common)])
    assert linededup.apply(twice, linededup.build(twice)).where("n_dropped > 0").count() == 0
    assert linededup.apply(docs_of([]), linededup.build(docs_of([]))).count() == 0
    assert "score" in linededup.apply(twice, index).columns


def test_cuckoo_filter_has_no_false_negatives():
    rng = np.random.default_rng(8)
    h1, h2 = rng.integers(-(1 << 63), 1 << 63, (2, 5000))
    made = linededup.Cuckoo(5000)
    made.insert(h1, h2)
    made = linededup.Cuckoo.loads(made.dumps())
    assert made.holds(h1, h2).all()
    made.delete(h1[:2500], h2[:2500])
    assert made.holds(h1[2500:], h2[2500:]).all() and made.holds(h1[:2500], h2[:2500]).mean() < 0.05
    small = linededup.Cuckoo(1)
    small.insert(h1[:100], h2[:100])
    assert small.kept and small.holds(h1[:100], h2[:100]).all()


def test_bounds_hold_beyond_exact_sums():
    rng = np.random.default_rng(6)
    for scale in (1 << 10, 1 << 24, 1 << 29):
        v, q = rng.integers(-scale, scale, (60, 16)), rng.integers(-scale, scale, (20, 16))
        marks = vafile.Marks(v.min(0), v.max(0), 1 << 31)  # a cell a value: the bounds are the scores, but for rounding
        marks.quantise = lambda x, m=marks: (x - m.low) // m.width
        low, high = marks.bounds(marks.quantise(v), q)
        for i in range(20):
            for j in range(60):
                score = sum(int(a) * int(b) for a, b in zip(q[i], v[j], strict=True))
                assert int(low[i, j]) <= score <= int(high[i, j])
                assert scale > 1 << 10 or low[i, j] == score == high[i, j]


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    vecs = {i: rng.normal(size=8).round(2).tolist() for i in range(1, 200)}
    vecs |= {i: vecs[7] for i in range(200, 260)} | {300: [1.0], 301: [], 350: [0.5] * 8}
    bad = [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (450, [float("inf")] * 8), (None, [1.0])]
    rows = [(i, v) for i, v in vecs.items()] + [(1, vecs[1])] + bad
    got = vafile.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 50 == 0).collect()
    whole = {i: np.array([np.floor(256 * x) for x in v] + [0] * (8 - len(v))) for i, v in vecs.items()}
    want = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    none = spark.createDataFrame(bad, "vec_id bigint, embedding array<double>")
    assert vafile.top_k(none, F.col("id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in vafile.top_k(few, F.col("id") % 50 == 0).collect()] == [(0, 1, 1, 131072)]
