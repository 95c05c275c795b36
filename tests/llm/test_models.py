"""Token counts, encoding, language ID, toxicity and mixing."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import CLASHES, ODD, SMALL, make_docs  # noqa: F401  a fixture

from pagoscope.llm import language_id, mixing, sentencepiece_codec, sentencepiece_model, token_counts, toxicity
from pagoscope.llm.queries import QUERIES

PATH = sentencepiece_model.default_path()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def random_texts(alphabet, n, longest, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(n)]


# ------------------------------------------------------------------ tokens
def test_counts_equal_the_library(spark, texts):
    model = sentencepiece_model.load(PATH)
    for r in QUERIES["op6_token_counts"](spark, SMALL).collect():
        text = texts[r.doc_id].text or ""
        assert r.n_tokens == len(model.encode(text)) and r.n_bytes == len(text.encode())
        assert r.over_limit == (r.n_tokens > 4096)


def test_counts_of_odd_texts(make_docs):
    model = sentencepiece_model.load(PATH)
    odd = [*ODD, "<s> </s> <unk>", "▁ ▁▁a", " lead", "trail ", "0 ", *random_texts("ab \n\t▁é<s>漢\x00🙂  the0,", 400, 14)]
    rows = {r.doc_id: r for r in token_counts.count_tokens(make_docs(*odd, clash=CLASHES)).collect()}
    for i, text in enumerate(odd):
        assert rows[i].n_tokens == len(model.encode(text or "")), repr(text)
    assert token_counts.count_tokens(make_docs("x").limit(0)).count() == 0


def test_memory_of_counts_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", token_counts.Counter(PATH).known.__len__() + 5)
    counter, model = token_counts.Counter(PATH), sentencepiece_model.load(PATH)
    for i in range(50):
        text = f"qzxv{i} wvzq{i} the"
        assert counter.count(text) == len(model.encode(text))
    assert len(counter.known) <= len(counter.whole) + 20


# ------------------------------------------------------------------ encoding
def every_segmentation(codec, text):
    found = []

    def walk(at, score, ids):
        if at == len(text):
            found.append((score, tuple(ids)))
            return
        for end, (pieces, s) in codec.edges(text, at):
            walk(end, score + s, [*ids, *pieces])

    walk(0, 0.0, [])
    return sorted(found, key=lambda x: -x[0])


def test_nbest_equals_enumeration():
    codec = sentencepiece_codec.codec(PATH)
    for text in filter(None, random_texts("the an▁é🙂\n0in er  on", 200, 11)):
        best = every_segmentation(codec, " " + text)[:5]
        found = codec.nbest(text, 5)
        assert np.allclose([s for s, _ in found], [s for s, _ in best]), text
        ids, total, _, _ = codec.encode(text)
        assert total == pytest.approx(best[0][0]) and codec.decode([i for p in ids for i in p]) == text


def test_encoding_is_an_exact_round_trip(spark, texts, make_docs):
    rows = QUERIES["op1_sentencepiece"](spark, SMALL).collect()
    assert len(rows) == len(texts) and all(r.restored for r in rows)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(spark.createDataFrame(rows)).collect()}
    assert all(back[i] == texts[i].text for i in texts)
    odd = sentencepiece_codec.encode(make_docs(*ODD, " ▁ ", clash=CLASHES)).collect()
    assert all(r.restored for r in odd)
    assert all(r.nbest_scores == sorted(r.nbest_scores, reverse=True) for r in odd if r.nbest_scores)
    by_id = {r.doc_id: r for r in odd}
    assert by_id[0].pieces == [] and by_id[0].nbest_scores == [0.0] and by_id[1].pieces is None
    assert sentencepiece_codec.encode(make_docs("x").limit(0)).count() == 0


def test_segmentations_decode_to_the_text(make_docs):
    text = "under the other interesting thing"
    rows = sentencepiece_codec.segmentations(make_docs(text, None, ""), n_best=6).collect()
    own = [r for r in rows if r.doc_id == 0]
    assert [r["rank"] for r in own] == [1, 2, 3, 4, 5, 6] and len({tuple(r.pieces) for r in own}) == 6
    codec = sentencepiece_codec.codec(PATH)
    assert all(codec.decode(r.pieces) == text for r in own)
    assert [(r.doc_id, r["rank"], r.pieces) for r in rows if r.doc_id] == [(2, 1, [])]


# ------------------------------------------------------------------ language
def test_language_on_held_out_documents(spark, texts):
    rows = QUERIES["op8_language_id"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == texts[r.doc_id].lang for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(make_docs):
    a, b = "the thing and that other thing with them ", "der die das nicht und auch mit ein "
    train = make_docs(*[(i, (a if i % 2 else b) * (1 + i % 7), "en" if i % 2 else "de") for i in range(40)], (99, a, None))
    net = language_id.fit(train)
    assert net.languages == ["de", "en"]
    rows = {r.doc_id: r for r in language_id.identify(make_docs(*ODD, a, a, "123 $$", clash=CLASHES[:-3]), net).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and rows[len(ODD) + 2].lang_pred == "und"
    assert rows[len(ODD)].lang_pred == "en" and rows[len(ODD)].score == rows[len(ODD) + 1].score
    none = language_id.identify(make_docs("a"), language_id.fit(make_docs("x").limit(0))).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)
    assert language_id.identify(make_docs("x").limit(0), net).count() == 0


# ------------------------------------------------------------------ samples
def test_samples_hold_every_label_and_each_text_once(spark, make_docs, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 60)
    monkeypatch.setattr(language_id, "SAMPLE_LEAST", 10)
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 30)
    monkeypatch.setattr(mixing, "SAMPLE_DOCS", 60)
    # by rows the smallest hash of all has 500 copies; one label has 3 texts of 1,000
    own = [f"text number {i} of its own" for i in range(1000)]
    rows = spark.createDataFrame([(t,) for t in own], "t STRING").selectExpr("t", "xxhash64(t) AS h").orderBy("h").collect()
    own = [r.t for r in rows]
    rare = {i for i in (400, 700, 999)}
    docs = make_docs(*[(i, t, "xx" if i in rare else "en") for i, t in enumerate(own)],
                     *[(2000 + i, own[0], "en") for i in range(500)])
    cuts, langs = language_id.sample(docs)
    assert len(cuts) == len(set(cuts)) == 60 and langs.count("xx") == 3
    assert set(cuts) == {own[i] for i in {*range(57), *rare}}
    ids = [*range(1000), *range(2000, 2500)]
    labels = spark.createDataFrame([(i, 1, int(i in rare)) for i in ids], "doc_id BIGINT, quality INT, toxic INT")
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, rest: seen.update(toxic=(texts, toxic, rest)))
    toxicity.fit(docs, labels)
    texts, toxic, rest = seen["toxic"]
    assert len(texts) == len(set(texts)) == 33 and sum(toxic) == 3 and rest == pytest.approx(997 / 30)
    plain = mixing.train
    monkeypatch.setattr(mixing, "train", lambda texts, domains: seen.update(mix=(texts, domains)) or plain([], []))
    model = mixing.fit(docs, labels)
    texts, domains = seen["mix"]
    assert len(texts) == len(set(texts)) == 60 and domains.count(2) == 3
    assert model.offset[0] == pytest.approx(np.log(997 / 57)) and model.offset[2] == -50


def test_posteriors_equal_a_direct_convolution():
    net = language_id.train(
        ["the plain words of one tongue stand here " * 3, "die einfachen worte der anderen sprache " * 3,
         "les mots simples de la langue troisième " * 3] * 6, ["en", "de", "fr"] * 6)
    texts = ["the words", "", "x", "die Sprache über Ämter " * 40, "été " * 200]
    rng = np.random.default_rng(3)
    texts += [bytes(rng.integers(32, 127, n).tolist()).decode() for n in (1, 7, 300)]
    windows = np.concatenate([language_id.windows_of(t)[0] for t in texts])
    got = net.prepared().posteriors(windows)
    for row, window in enumerate(windows):
        values = []
        for f in range(net.bias.size):
            width = language_id.WIDTHS[f // language_id.FILTERS]
            best = max(sum(float(net.tables[k, window[at + k], f]) for k in range(width))
                       for at in range(len(window) - max(language_id.WIDTHS) + 1))
            values.append(max(0.0, best + float(net.bias[f])))
        z = [sum(v * float(w) for v, w in zip(values, net.weights[:, k])) + float(net.offset[k]) for k in range(3)]
        e = [np.exp(v - max(z)) for v in z]
        np.testing.assert_allclose(got[row], np.array(e) / sum(e), atol=1e-4)


# ------------------------------------------------------------------ toxicity
def plain_kernel(a, b):
    """The subsequence kernel of two units, triple by triple."""
    def triples(unit):
        text = unit.translate(toxicity.STAND_INS)
        found = []
        for i in range(len(text)):
            for j in range(i + 1, len(text)):
                for k in range(j + 1, min(len(text), i + toxicity.SPAN)):
                    if all(text[x].isascii() and text[x].isalpha() for x in (i, j, k)):
                        found.append((text[i] + text[j] + text[k], toxicity.DECAY ** (k - i + 1)))
        return found

    x, y = triples(a), triples(b)
    both = sum(v * w for t, v in x for u, w in y if t == u)
    return both / max(1e-9, sum(v * v for _, v in x)) ** 0.5 / max(1e-9, sum(v * v for _, v in y)) ** 0.5


def test_kernel_equals_a_plain_one():
    units = ["idiot", "i.d.i.o.t", "id1ot", "idxxiot", "iixxxdxxxo", "banana", "the", "ab", "...", "a" * 24, "0dd"]
    units += [u for u in random_texts("abio.", 30, 12) if len(u) >= 3]
    got = toxicity.kernel(units, toxicity.features(units))
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            assert got[i, j] == pytest.approx(plain_kernel(a, b), abs=1e-4), (a, b)
    assert plain_kernel("idiot", "i.d.i.o.t") > 3 * plain_kernel("idiot", "editor")


def test_sentences_of_a_text():
    found = toxicity.sentences("You i.d.i.o.t, go. Then i d i o t!  Next\nline of it\n\n. . a")
    assert found == [["i.d.i.o.t", "you"], ["idiot", "then"], ["next"], ["line"]]
    assert toxicity.sentences("") == [] and [len(s) for s in toxicity.sentences(" ".join(f"word{i}" for i in range(90)))] == [40, 40, 10]


def test_telling_units_need_evidence_not_a_share():
    with1, with0 = Counter(rare=30, common=900, even=40, lucky=4), Counter(rare=0, common=600, even=38, lucky=0)
    # thirty of 100,000 toxic texts tell, four do not, and a frequent word with odds of 1.5 does not
    assert toxicity._telling(with1, with0, 1500, 1500) == ["rare"]
    assert toxicity._telling(with1, with0, 100_000, 100_000) == ["rare"]
    assert toxicity._telling(Counter(a=3, b=1), Counter(b=1, c=3), 3, 3) == ["a"]


def test_only_sentences_with_a_telling_unit_are_labelled():
    texts, toxic = [], []
    r = random.Random(4)
    plain = ["".join(r.choice("bcdefghlmnprstu") + r.choice("aeo") for _ in range(3)) for _ in range(300)]
    for i in range(200):
        lines = [" ".join(r.choice(plain) for _ in range(8)) for _ in range(6)]
        if i % 2:
            lines[i % 6] += " zwijk"
            lines[(i + 1) % 6] += " friendly" if i % 4 == 1 else ""
        else:
            lines[0] += " friendly" if i % 4 == 2 else ""
        texts.append("\n".join(lines))
        toxic.append(i % 2)
    machine = toxicity.train(texts, toxic)
    values = toxicity.margins(["zwijk", "zw.ijk", "friendly", *plain], machine.table, machine.offset)
    assert values[0] > 0.5 and values[1] > 0 and max(values[2:]) < 0
    found = toxicity.Scorer(machine).scores([" ".join(plain[:60]), " ".join([*plain[:60], "zw-ijk"])])
    assert found[0] < 0.5 < found[1]


def test_toxicity_on_held_out_documents(spark):
    sf = SMALL.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[i], t) for i, t in labels.items() if i in rows and rows[i].held_out and t is not None]
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows.values())
    assert np.mean([r.predicted == t for r, t in held]) >= 0.9
    clean = [r.predicted for r, t in held if t == 0]
    assert np.mean(clean) <= 0.03
    found = sum(r.predicted for r, t in held if t == 1)
    assert found >= 0.7 * sum(t for _, t in held) and found >= 0.9 * sum(r.predicted for r, _ in held)


def toxic_table(make_docs, spark):
    base = "the thing and other words of plain prose stand here with them "
    rows = [(i, base * 3 + f"row{i} " + ("you idiot and stupid moron " if i % 3 == 0 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id BIGINT, quality INT, toxic INT")
    return make_docs(*rows), labels, base


def test_gapped_insults(make_docs, spark):
    docs, labels, base = toxic_table(make_docs, spark)
    machine = toxicity.fit(docs, labels)
    plain, gapped = (toxicity.margins([w], machine.table, machine.offset)[0] for w in ("idiot", "i.d.i.o.t"))
    other = toxicity.margins(["plain"], machine.table, machine.offset)[0]
    assert plain > 0.5 and gapped > 0 > other
    assert "idiot" in toxicity.spelled_out("you i d i o t there".split())
    rows = {r.doc_id: r for r in toxicity.score(make_docs(*ODD, base + "st-upid idi0t mor.on", base, base, clash=CLASHES), machine).collect()}
    n = len(ODD)
    assert rows[n].predicted == 1 and rows[n + 1].predicted == 0 and rows[n + 1].score == rows[n + 2].score
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[0].score == rows[1].score < 0.5
    assert toxicity.score(make_docs("x").limit(0), machine).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert toxicity.score(make_docs("x"), None).first().score == 0.0


# ------------------------------------------------------------------ mixing
def test_expected_tokens_meet_the_targets(spark):
    rows = QUERIES["op10_mixing"](spark, SMALL.replace("0.001", "0.01")).toPandas()
    total = rows.n_tokens.sum()
    assert (rows.rate >= 0).all()
    for domain, share in mixing.TARGETS.items():
        assert abs((rows.n_tokens * rows[domain] * rows.rate).sum() / total - share) < 2e-3
        assert abs((rows.n_tokens * rows[domain] * rows.copies).sum() / total - share) < 0.05
    np.testing.assert_allclose(rows[list(mixing.DOMAINS)].sum(axis=1), 1)


def test_rates_equal_a_dense_solver(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    n = rng.integers(0, 500, 300)
    table = spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(n, p)], "n_tokens BIGINT, p0 DOUBLE, p1 DOUBLE, p2 DOUBLE")
    targets = {"clean": 0.8, "low_quality": 0.1, "toxic": 0.1}
    moves = mixing.fit_rates(table, targets)
    got = np.array([r[0] for r in table.selectExpr(f"{mixing.rate_text(moves)} AS r").collect()])
    rates = np.ones(300)
    inverse = np.linalg.pinv((p * n[:, None]).T @ p / n.sum(), rcond=1e-9, hermitian=True)
    for _ in moves:
        miss = (n * rates) @ p / n.sum() - np.array([0.8, 0.1, 0.1])
        rates = np.maximum(0, rates - p @ (inverse @ miss))
    np.testing.assert_allclose(got, rates, atol=1e-9)
    assert (got == 0).any() and np.abs((n * got) @ p / n.sum() - [0.8, 0.1, 0.1]).max() < 5e-3


def nonnegative_least_squares(a, b):
    """Lawson and Hanson's active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while True:
        pull = a.T @ (b - a @ x)
        pull[free] = -np.inf
        if pull.max() <= 1e-10:
            return x
        free[pull.argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z[free].min() > 0:
                x = z
                break
            low = free & (z <= 0)
            x += min(x[low] / (x[low] - z[low])) * (z - x)
            free &= x > 1e-12


@pytest.mark.parametrize("alpha,reached", [([0.3, 0.3, 0.3], True), ([1.0, 0.5, 0.2], True), ([9.0, 9.0, 9.0], False)])
def test_rates_are_as_good_as_an_independent_solver(spark, caplog, alpha, reached):
    rng = np.random.default_rng(5)
    p, n = rng.dirichlet(alpha, 200), rng.integers(1, 500, 200)
    table = spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(n, p)], "n_tokens BIGINT, p0 DOUBLE, p1 DOUBLE, p2 DOUBLE")
    wanted = np.array([0.8, 0.1, 0.1])
    moves = mixing.fit_rates(table, dict(zip(mixing.DOMAINS, wanted)))
    rates = np.array([r[0] for r in table.selectExpr(f"{mixing.rate_text(moves)} AS r").collect()])
    a = (p * n[:, None]).T / n.sum()
    root = np.linalg.cholesky(np.linalg.inv((p * n[:, None]).T @ p / n.sum())).T  # the weights of misses
    best = nonnegative_least_squares(root @ a, root @ wanted)

    def miss(x):
        return float(np.square(root @ (a @ x - wanted)).sum())

    assert (rates >= 0).all() and (miss(best) < 1e-8) == reached
    if reached:
        assert miss(rates) <= miss(best) + 1e-5
    else:  # no nonnegative rates meet the targets; the steps end before the best ones, and say so
        assert miss(best) < miss(rates) < miss(np.ones(200)) and "targets not met" in caplog.text


def test_mixing_of_odd_tables(make_docs, spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (3, None, None), (77, 0, 1), (4, 0, 0)], "doc_id BIGINT, quality INT, toxic INT")
    docs = make_docs(*ODD, (None, "no id"), (3, "one"), clash=CLASHES)
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == len(ODD) + 2 and all(r.rate >= 0 and r.copies >= 0 for r in rows)
    assert mixing.mix(docs.limit(0), labels).count() == 0
    assert mixing.mix(docs, labels.limit(0)).count() == len(rows)
    again = mixing.resample(docs, labels)
    assert again.columns == docs.columns and again.count() >= 0


def test_resampled_rows_equal_the_copies(spark, make_docs, monkeypatch, caplog):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(make_docs(*ODD, (None, "no id")))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    want = Counter()
    for r in mixing.mix(docs, labels).collect():
        want[r.doc_id, r.text_hash] += r.copies
    got = Counter((r.doc_id, r.h) for r in mixing.resample(docs, labels).selectExpr("doc_id", "xxhash64(text) AS h").collect())
    assert got == +want and max(got.values()) > 1
    assert "targets not met" not in caplog.text
    monkeypatch.setattr(mixing, "STEPS", 0)
    mixing.mix(docs, labels)
    assert "targets not met in 0 steps" in caplog.text


def test_chunks_worked_out_together_equal_single_ones(texts):
    own = sentencepiece_codec.Codec(sentencepiece_model.default_path())
    rng = random.Random(4)
    odd = ["".join(rng.choice("abethinrs  \n012ñ日本🙂▁.,") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    chunks = {c for t in [*odd, *(r.text or "" for r in texts.values())] if t for c in own.chunks(t)}
    own.learn(chunks)
    kept = {c for c in chunks if len(c) <= sentencepiece_codec.LONGEST_KEPT}
    assert set(own.known) == kept and len(kept) > 2000
    assert all(own.known[c] == own.chunk(c) for c in kept)


def test_a_full_memory_changes_nothing(texts, monkeypatch):
    rows = [r.text for r in texts.values() if r.text][:40]
    plain = sentencepiece_codec.Codec(sentencepiece_model.default_path())
    expected = [plain.nbest(t) for t in rows]
    monkeypatch.setattr(sentencepiece_codec, "MEMORY", 50)
    small = sentencepiece_codec.Codec(sentencepiece_model.default_path())
    assert [small.nbest(t) for t in rows] == expected


def test_a_full_memory_keeps_the_frequent_chunks(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "MEMORY", 400)
    rng, plain = random.Random(8), sentencepiece_codec.Codec(sentencepiece_model.default_path())
    own = sentencepiece_codec.Codec(sentencepiece_model.default_path())
    often = [f"w{k}" for k in range(20)] + ["ñandú", "日本"]
    for _ in range(40):
        rare = ["".join(rng.choice("abcdeñ日🙂") for _ in range(rng.randrange(4, 12))) for _ in range(60)]
        text = " ".join([*often, *rare, "x" * 60])
        asked = own.chunks(text)
        own.learn(set(asked))
        ids, total, losses = own.flat(text, asked)
        wanted = [plain.chunk(c) for c in asked]
        assert ids.tolist() == [i for w in wanted for i in w[0]] and own.decode(ids.tolist()) == text
        assert total == pytest.approx(sum(w[1] for w in wanted)) and losses.tolist() == [w[2] for w in wanted]
        assert len(own.known) <= 400
    own.known.forget(200, set())
    assert all(" " + word in own.known for word in often) and len(own.known) <= 200
