"""Manifest, token counts and periodic runs against plain restatements."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import manifest, periodic, tokencount
from quire.llm.queries import CHECKS, digest_merkle, digest_runs, piece_bpe
from tools.check import rows_of

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "B c"), (None, None), (5, "wörd " * 3000), (6, "\x00É　z"), (4, "A"), (3, "x"), (9, "T")]


def against_sql(docs, got, name):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    cur = con.execute(CHECKS[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(cols, cur.fetchall())


# --- manifest ---------------------------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute_manifest(rows):
    """rows(doc_id, source, lang, n_chars, text, id) -> root and for each id its leaf, subroot and sibling digests."""
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r[5]))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    lower = [brute_levels([x[2] for x in sorted(trees[t])]) for t in order]
    upper = brute_levels([x[-1][0] for x in lower])
    out = {}
    for t, (name, levels) in enumerate(zip(order, lower, strict=True)):
        for i, x in enumerate(sorted(trees[name])):
            proof = []
            for place, side in [(i, levels), (t, upper)]:
                for level in side[:-1]:
                    run = place // 8 * 8
                    proof += [d for k, d in enumerate(level[run:run + 8], run) if k != place]
                    place //= 8
            out[x[3]] = (x[2], levels[-1][0], proof)
    return upper[-1][0] if rows else None, out


def manifest_rows(sizes, seed=3):
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        ids = [rng.randrange(max(1, n)) if rng.random() < 0.98 else None for _ in range(n)]
        rows += [(i, rng.choice([None, "s", "ü"]), lang, rng.choice([None, 7]), rng.choice([None, "", "Ab", "c" * 50])) for i in ids]
    rng.shuffle(rows)
    return [(*r, k) for k, r in enumerate(rows)]


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {None: 1, "b": 1}, {"en": 8}, {"en": 9}, {"en": 700, "de": 1, None: 65, "": 8},
                                   {f"l{i}": 1 + i % 3 for i in range(70)} | {"big": 530}])
def test_manifest_is_the_brute_one(spark, sizes):
    rows = manifest_rows(sizes)
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string, node bigint").withColumn("digest", F.lit("x"))
    made = manifest.build(docs, carry=[F.col("node").alias("node"), F.col("digest").alias("grp")])
    root, want = brute_manifest(rows)
    assert made.root == root
    got = made.rows.select(F.col("carried.node").alias("id"), manifest.hexed(F.col("digest")).alias("leaf"), "subroot", made.proof_digest().alias("proof"),
                           made.folded(F.col("digest")).alias("folded")).collect()
    assert len(got) == len(rows)
    same = {r[5]: r[:5] for r in rows}
    # equal rows may change places among themselves
    assert sorted((same[r["id"]].__repr__(), r["leaf"], r["subroot"], r["proof"]) for r in got) == sorted(
        (same[i].__repr__(), leaf, sub, sha("".join(proof))) for i, (leaf, sub, proof) in want.items())
    assert {r["folded"] for r in got} <= {root}


def test_manifest_query(spark, docs_of):
    docs = docs_of(ODD).withColumn("lang", F.when(F.col("doc_id") > 3, F.lit("de"))).select(*manifest.FIELDS)
    docs = docs.where("doc_id is not null")
    got = digest_merkle(docs).cache()
    against_sql(docs, got, "op11_merkle_pointer_jumping")
    rows = {(r["doc_id"], r["leaf"]): r["verified"] for r in got.collect()}
    touched = [i for i, t in ODD if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and t and t != t.lower()]
    assert sum(not v for v in rows.values()) == len(touched) > 0


# --- token counts -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def whole():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe())


def texts_for_counts():
    rng = random.Random(5)
    usual = " ".join(rng.choice(["le", "oiseau", "straße", "naïve", "x1", "</s>", "<unk>", "日本", "😀"]) for _ in range(900))
    return [*(t for _, t in ODD), usual, "a" * 3000, "ab" * 1500, "=" * 2500, " " * 2000, "日本語" * 700, "😀" * 900, "\n" * 1500, "\x00" * 700,
            "".join(rng.choice("abc ") for _ in range(4000)), "aaaa" * 400 + usual, "e" * 64, "e" * 65]


def test_counts_are_those_of_the_whole_text(spark, whole):
    texts = texts_for_counts()
    texts += texts[-3:]
    docs = spark.createDataFrame([(i, t, 1, "row") for i, t in enumerate(texts)], "doc_id bigint, text string, n_bytes int, row string")
    got = tokencount.count(docs, piece_bpe(), keep=["doc_id", "row", "n_bytes"], limit=600, huge=64, chunk=48, overlap=8).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        n = len(whole.encode(text))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"], r["row"]) == (n, len(text.encode()), n > 600, "row"), text[:40]
    assert tokencount.count(docs.limit(0), piece_bpe()).count() == 0


def test_overlaps_are_widened(spark):
    """Rows of one letter: pieces of eight shift with the cut, so the first overlap holds no common boundary."""
    code, text = tokencount.codec(piece_bpe()), "a" * 1000
    _, tails = tokencount.ends_of(code, text[:211 + 9], [(211, False)], 9)
    _, heads = tokencount.ends_of(code, text[211 - 9:], [(9, True)], 9)
    sides = [dict(zip(["at", "before", "other", "proven", "around"], x[0], strict=True)) for x in (tails, heads)]
    assert sides[0]["at"] and sides[1]["at"] and tokencount.splice(code, *sides) is None
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert tokencount.count(docs, piece_bpe(), huge=300, chunk=211, overlap=9).first()["n_tokens"] == code.counts([text])[0]


def test_a_proof_is_needed():
    code = tokencount.codec(piece_bpe())
    assert code.apart("e", " ") and not code.apart("h", "e")
    assert not code.stays("th", "e") and code.stays(" the", " the")


# --- periodic runs ----------------------------------------------------------------------------------------------------------------


def brute_runs(words, shortest):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def word_rows(count, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        kinds, n = rng.choice([1, 2, 2, 3, 6]), rng.randrange(60)
        words = [rng.choice("abcdef"[:kinds]) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange((n - a) // 3 + 1)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        out.append(words)
    return out


def test_lyndon_lengths_under_both_orders():
    for words in word_rows(300, 1):
        ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
        symbols = [ids[w] for w in words]
        for got, s in zip(periodic.both_orders(symbols, len(ids)), (symbols, [-x for x in symbols]), strict=True):
            assert got == [next(j for j in range(i + 1, len(s) + 1) if s[j:] < s[i:]) - i for i in range(len(s))]


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_are_the_brute_ones(spark, shortest):
    rows = word_rows(400, 2)
    docs = spark.createDataFrame([(i, " \n".join(w), i) for i, w in enumerate(rows)], "doc_id bigint, text string, runs bigint")
    for r in periodic.find(docs, shortest).collect():
        words = rows[r["doc_id"]]
        want = brute_runs(words, shortest)
        assert [tuple(x) for x in r["runs"]] == sorted(want, key=lambda x: (x[0], x[2]))
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone) and r["n_words"] == len(words)


def test_runs_query(spark, docs_of):
    rows = ODD + [(i, " ".join(w)) for i, w in enumerate(word_rows(200, 7), 20)] + [(300, ("a b c " * 9 + "d ") * 40)]
    docs = docs_of([r for r in dict(rows).items() if r[0] is not None])
    against_sql(docs, digest_runs(docs.select("doc_id", "text")), "op13_periodic_runs_baier")
    assert digest_runs(docs.select("doc_id", "text").limit(0)).count() == 0
    odd = {r["collapsed"] for r in periodic.find(docs_of(ODD)).collect()}
    assert odd == {"", "a", "B c", "wörd", "\x00É　z", "A", "x", "T"}
