"""Chat, secrets, packing, language and classifiers on small inputs, against plain restatements."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import chat, langid, packing, rules, secrets, toxicity
from quire.llm.common import learning_sample
from quire.llm.queries import digest_chat, word_bpe

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "b c"), (5, "wörd " * 30_000), (6, "\x00é　z")]


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "### a: <b>\\h\\"), (1, 1, "user", None), (1, 2, "assistant", "</turn>\n### assistant: x"), (1, 3, "user", "q"),
            (1, 4, "assistant", ""), (1, 5, "user", "rest"), (2, None, None, "only"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    talk = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.expand(talk)
    got = {(r["conv_id"], r["example"]): r for r in out.collect()}
    assert [k for k in sorted(got) if k[0] == 1] == [(1, 1), (1, 2), (1, 3)]
    assert got[1, 3]["loss_start"] is None and got[2, 1]["loss_end"] is None
    assert got[1, 2]["formatted"].startswith(got[1, 1]["formatted"])
    turns = out.where("conv_id = 1 and example = 3").select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in turns] == [(r[2], r[3] or "") for r in rows[:6]]
    loss = out.select("conv_id", "example", chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("l"))
    assert {(r["conv_id"], r["example"]): r["l"] for r in loss.collect()} == {
        (1, 1): rows[2][3], (1, 2): "", (1, 3): None, (2, 1): None, (3, 1): "a", (3, 2): "a", (3, 3): "b"}
    assert digest_chat(chat.expand(talk.limit(0))).count() == 0


def test_secret_base_spans():
    assert secrets.base_spans("token = token = abcdefgh") == []
    assert secrets.base_spans('API_KEY: "abc=def" PASSWD=12345') == [("assign", 0, 17)]
    key = "AKIA" + "A1" * 8
    assert secrets.base_spans(f"é {key} {'0f' * 12} {'0f' * 11}") == [("access", 2, 22), ("hex", 23, 47)]


@pytest.fixture(scope="module")
def field():
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    return secrets.train([f"some plain words here, and\ntoken = {word(32)} then more of it 12" for _ in range(30)])


def brute_viterbi(emit, move, start):
    """The best of all tag sequences."""
    import itertools
    best = max(itertools.product(range(3), repeat=len(emit)),
               key=lambda t: start[t[0]] + sum(emit[i][x] for i, x in enumerate(t)) + sum(move[a][b] for a, b in zip(t, t[1:], strict=False)))
    return list(best)


def test_viterbi_is_the_best_path(field):
    tagger = secrets.Tagger(field)
    rng = np.random.default_rng(2)
    for _ in range(20):
        emit = rng.normal(size=(5, 3))
        assert tagger.viterbi(emit, True, False).tolist() == brute_viterbi(emit, tagger.move, tagger.start)


def test_cut_chains_decode_as_whole_ones(field):
    tagger = secrets.Tagger(field)
    text = "plain words, token = 0123456789abcdef0123456789abcdef and pass -> 99aa88bb77cc66dd55ee44ff33aa22bb end"
    words = secrets.TOKEN.findall(text)
    whole = tagger.viterbi(tagger.scores(words), True, False)
    inside = sum(e - s for _, s, e in tagger.spans(text))
    assert (whole != 0).any() and inside >= 32
    tags = [t for t in whole if t]
    assert len(tags) == sum(len(secrets.TOKEN.findall(text[s:e])) for _, s, e in tagger.spans(text))


def test_cut_tokens_are_outside_on_the_best_path():
    """On random fields and emissions, also where the next token is far better as inside than as begin."""
    rng, cut = np.random.default_rng(4), 0
    for n in range(3000):
        move, start = rng.normal(size=(3, 3)), rng.normal(size=3)
        tagger = secrets.Tagger(secrets.Field(tuple(map(tuple, np.zeros((secrets.WIDTH, 3)))), tuple(map(tuple, move)), tuple(start)))
        emit = rng.normal(size=(7, 3)) * (2, 5, 15)[n % 3]
        sure = tagger.sure(emit)
        cut += int(sure.sum())
        assert not tagger.viterbi(emit, True, False)[sure].any()
    assert cut > 1000
    zero = secrets.Field(tuple(map(tuple, np.zeros((secrets.WIDTH, 3)))), ((0.0,) * 3,) * 3, (0.0,) * 3)
    emit = np.array([[0, 9, 0], [1, 0, 0.5], [0, -50, 30.0]])  # the middle token leads as outside, but an inside follows
    assert secrets.Tagger(zero).viterbi(emit, True, False).tolist() == [1, 2, 2] and not secrets.Tagger(zero).sure(emit)[1]


def test_secret_scan_of_odd_texts(docs_of, field):
    got = {(r["doc_id"], r["text"]): r for r in secrets.scan(docs_of(ODD), field).collect()}
    assert got[1, None]["spans"] == [] and got[2, ""]["base"] == []
    assert secrets.scan(docs_of([]), field).count() == 0 and secrets.scan(docs_of(ODD), None).count() == len(ODD)
    assert secrets.train(["nothing to learn from"]) is None and secrets.train([]) is None


def test_encoder_equals_the_tokenizer():
    import pyarrow as pa
    enc = packing.Encoder(word_bpe())
    texts = ["a\x1cb  c", "ΑΣ Σ", "é x", "İstanbul!", "don't, it's. x,, 3.14", "\xa0é.　z", "", "漢字 かな. ไทย", "The THE the, the."]
    assert enc.encode(pa.array([*texts, None])) == enc.ids([*texts, ""])


def test_packing_is_whole_and_tight(docs_of):
    rng = np.random.default_rng(3)
    rows = ODD + [(100 + i, "word " * int(n)) for i, n in enumerate(rng.integers(0, 9000, 60))]
    pieces = packing.pack(docs_of(rows), word_bpe(), ids=True).collect()
    enc, want, got, seqs = packing.Encoder(word_bpe()), [], {}, {}
    import pyarrow as pa
    for i, text in rows:
        ids = enc.encode(pa.array([text], pa.string()))[0] + np.array([2], "<u4").tobytes()
        want.append((i, ids))
    for p in pieces:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"] > 0
        got.setdefault(p["doc_id"], []).append(p)
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, ids in want:
        if sum(i == j for j, _ in want) == 1:
            own = sorted(got[i], key=lambda p: p["start"])
            assert np.array([x for p in own for x in p["ids"]], "<u4").tobytes() == ids
    assert sum(p["length"] for p in pieces) == sum(len(x) // 4 for _, x in want)
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        total = sum(n for _, n in parts)
        assert total == 4096 or total & (total - 1) == 0
    assert packing.pack(docs_of([]), word_bpe()).count() == 0


def test_fill_finds_the_least_slack():
    import itertools
    rng = np.random.default_rng(4)
    for _ in range(30):
        items = rng.integers(5, 60, 9).tolist()
        counts = {n: items.count(n) for n in items}
        chosen = packing.fill(counts, 100)
        assert all(chosen[n] <= counts[n] for n in chosen)
        rest = sorted(items)[:-1]
        best = max(sum(c) + max(items) for k in range(9) for c in itertools.combinations(rest, k) if sum(c) + max(items) <= 100)
        assert sum(n * k for n, k in chosen.items()) == best


def brute_phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(end - 1, at + 1)
        n += 1
    return n


def test_phrases_by_brute_force():
    samples = (("xx", "abracadabra banana cabana"), ("yy", "the quick brown fox jumps over it"))
    model = langid.Model(samples)
    texts = ["abra banana quick", "zzz!", "a", "", "brown cabana fox the the the dabra " * 20]
    plain = lambda t: [s for s in model.symbols(t).tolist()]
    as_text = lambda t: "".join(map(chr, plain(t)))
    want = [[brute_phrases(as_text(t), as_text(s)) for _, s in samples] for t in texts]
    assert model.phrases(texts).tolist() == want


def test_every_learned_letter_has_a_symbol():
    """Two languages of large scripts: letters far beyond one byte's worth stay apart."""
    rng = np.random.default_rng(5)
    run = lambda low, n: "".join(map(chr, rng.integers(low, low + 3000, n)))
    latin, han, hangul = "the quick brown fox jumps over it " * 9, run(0x4E00, 6000), run(0xAC00, 6000)
    model = langid.Model((("en", latin), ("ko", hangul), ("zh", han)))
    letters = sorted({c for c in latin + han + hangul if c.isalpha()})
    assert len({int(model.code[ord(c)]) for c in letters} - {langid.UNKNOWN, langid.BLANK, langid.PAD}) == len(letters) > 5000
    assert model.code[ord("\u042f")] == langid.UNKNOWN and {model.code[ord(c)] for c in " 7\u3002\U0001f600"} == {langid.BLANK}
    texts = [han[100:160], hangul[700:760], han[5:9] + hangul[3:8] + "\u042f fox", hangul[::-1][:300]]
    as_text = lambda t: "".join(map(chr, model.symbols(t).tolist()))
    want = [[brute_phrases(as_text(t), as_text(s)) for s in (latin, hangul, han)] for t in texts]
    assert model.phrases(texts).tolist() == want
    assert model.predict(texts)[0][:2] == ["zh", "ko"]


def test_language_of_odd_texts(docs_of):
    samples = (("de", "der die das und ist nicht ein eine mit von " * 5), ("en", "the and of to in is that it was for " * 5))
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(docs_of([*ODD, (8, "that is the one and only"), (9, "12 34 !!")]), samples).collect()}
    assert got[1, None]["lang_pred"] == got[2, ""]["lang_pred"] == got[9, "12 34 !!"]["lang_pred"] == "und"
    assert got[8, "that is the one and only"]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(docs_of(ODD), ()).collect()} == {"und"}
    assert langid.learn(docs_of([]), F.lit(False)) == ()


def test_rules_compile_to_what_they_say(spark, docs_of):
    good = [(i, f"plain words number and more of them again {chr(97 + i % 26)} fine text here.") for i in range(60)]
    bad = [(100 + i, f"bad!! | text!! | {chr(97 + i % 26)} ### $$$ | x!!") for i in range(60)]
    rows = docs_of(good + bad).withColumn("_label", (F.col("doc_id") < 100).cast("int")).withColumn("_order", F.col("doc_id"))
    model = rules.fit(rows)
    assert model.rules
    got = {(r["doc_id"], r["text"]): r for r in rules.score(docs_of(good + bad + ODD), model).collect()}
    assert all(got[k]["predicted"] == (k[0] < 100) for k in got if k[1] and (k[0] or 0) >= 0 and k in {*good, *bad})
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1, None]["score"] == got[2, ""]["score"]
    stats = {r["doc_id"]: r for r in docs_of(good[:5]).select("doc_id", *rules.statistics(F.col("text"))).collect()}
    for i, r in stats.items():
        x = {n: np.array([r[f"_{n}"]]) for n in rules.STATS}
        total = model.base + sum(w for rule, w in model.rules if rule.holds(x)[0])
        assert got[(i, good[i][1])]["score"] == pytest.approx(1 / (1 + np.exp(-total)))
    assert rules.fit(rows.limit(0)).rules == () and rules.score(docs_of([]), model).count() == 0


def test_swaps_lower_scores_of_neutral_mentions(docs_of):
    toxic = [f"muslims are scum and trash {c}" for c in "abcdefghijkl"] + [f"what a moron {c}" for c in "abcdefghijkl"]
    clean = [f"the weather is fine {c}" for c in "abcdefghijklmnopqrstuvwx"] + ["christians met today"]
    y = np.array([1] * len(toxic) + [0] * len(clean))
    plain, fair = toxicity.fit_texts(toxic + clean, y, swap=0.0), toxicity.fit_texts(toxic + clean, y, swap=5.0)
    mention = "muslims met today"
    assert fair.scorer()(mention) < plain.scorer()(mention)
    assert fair.scorer()("you are scum and trash") > 0.5 > fair.scorer()(mention)
    got = {(r["doc_id"], r["text"]): r for r in toxicity.score(docs_of(ODD), fair).collect()}
    assert got[1, None]["score"] == got[2, ""]["score"] < 0.5
    assert toxicity.fit_texts([], np.array([])).weights == () and toxicity.score(docs_of([]), fair).count() == 0


def test_terms_no_labelled_text_holds_are_put_in():
    """Beginnings of a toxic word are those of an identity term: neutral mentions suffer, though no text to learn from holds a term."""
    toxic = [f"muslimhater trash w{c}" for c in range(30)] + [f"what a moron w{c}" for c in range(30)]
    clean = [f"the weather is fine w{c}" for c in range(60)]
    y = np.array([1] * len(toxic) + [0] * len(clean))
    plain, fair = toxicity.fit_texts(toxic + clean, y, least=0), toxicity.fit_texts(toxic + clean, y)
    assert (plain.mentions, plain.put_in) == (0, 0) and fair.mentions == 0 and fair.put_in == len(toxicity.swaps())
    assert toxicity.fit_texts(toxic + clean, y, swap=0.0, least=0).weights == plain.weights  # without rows the penalty says nothing
    mentions = ["muslims met today", "the muslim family next door", "a muslim and a christian talk"]
    before, after = [[m.scorer()(t) for t in mentions] for m in (plain, fair)]
    assert all(a < b for a, b in zip(after, before, strict=True)) and sum(b >= 0.5 for b in before) > sum(a >= 0.5 for a in after) == 0
    assert min(fair.scorer()(t) for t in toxic) > 0.5


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(learning_sample(docs.select("doc_id", "text"), labels, "toxic", 5, 0, toxicity.SAMPLE))
    held = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 and toxic is not null").select("doc_id", "toxic")
    got = toxicity.score(docs.select("doc_id", "text"), model).join(held, "doc_id").select("toxic", "predicted").collect()
    assert len(got) > 50 and sum(r["toxic"] == r["predicted"] for r in got) >= 0.95 * len(got)
