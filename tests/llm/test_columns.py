"""Row-wise operators: media, BPE, language, toxicity, quality."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scholion.llm import bpe, langid, media, quality, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "  \n\n a\t", "it's 12 o'clock, they'll", "<|endoftext|>x<|endoftext|>", "é́ 🤦🏽‍♂️ا½²٣Ⅷ", "ab" * 400, "a" * 3000, "\x85 \x1c　b\x00"]
DOCS = "doc_id long, text string, lang string, score string, stats string"


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    lib, codec = Tokenizer.from_file(TOKENIZER), bpe.Codec(bpe.load(TOKENIZER))
    rng = np.random.default_rng(3)
    texts = ODD + ["".join(rng.choice(list("abé \n't1.😀ñ"), size=rng.integers(1, 600))) for _ in range(200)]
    for t in texts:
        e = lib.encode(t, add_special_tokens=False)
        assert codec.encode(t) == e.ids
        assert codec.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)
        raw = t.encode()
        if raw:
            assert codec.scan(raw)[0] == codec.heap(raw)


def test_bpe_query_cases(spark):
    out = {r["doc_id"]: r for r in bpe.encode_decode(spark, frame(spark, [None, "", "it's", "it's"]), TOKENIZER).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert out[0]["n_tokens"] == out[1]["n_tokens"] == 0 and out[0]["ids_sha256"] == empty == out[1]["decoded_sha256"]
    assert out[2]["ids_sha256"] == out[3]["ids_sha256"] and out[2]["decoded_sha256"] == hashlib.sha256(b"it's").hexdigest()
    assert bpe.encode_decode(spark, frame(spark, []), TOKENIZER).count() == 0


def test_media_round_trip_and_cases(spark):
    texts = [None, "", "abc" * 500, "abc" * 500, "é" * 288, "x" * 100_000]
    out = {r["doc_id"]: r for r in media.media_features(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_bytes"] == len(payload) + 44 and r["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest()
    assert out[2]["feature"] == out[3]["feature"] != out[4]["feature"] and out[0]["feature"] == out[1]["feature"]
    assert media.media_features(frame(spark, [])).count() == 0


def brute_fingerprints(samples):
    """The same from the definition: discrete Fourier transform by sums, maxima by comparison."""
    n, found = media.FRAME, []
    window = [0.5 - 0.5 * np.cos(2 * np.pi * t / (n - 1)) for t in range(n)]
    turns = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    every = []
    for start in range(0, len(samples) - n + 1, media.HOP):
        x = [(samples[start + t] - 128) * window[t] for t in range(n)]
        m = [round(abs(sum(row * x)) * 1024) for row in turns]
        tops = [k for k in range(1, n // 2) if m[k] > m[k - 1] and m[k] >= m[k + 1] and m[k] > 0]
        every.append(sorted(tops, key=lambda k: (-m[k], k))[: media.PEAKS])
    for at, own in enumerate(every):
        for d in range(1, media.SPAN + 1):
            found += [(at << 26) | (a << 16) | (b << 6) | d for a in own for b in (every[at + d] if at + d < len(every) else [])]
    return len(every), sorted(found)


def test_fingerprints_equal_brute_force():
    rng = np.random.default_rng(4)
    for raw in (b"", "Some words of a text, é and so on. ".encode() * 40, bytes(rng.integers(0, 256, 3000).tolist()), b"a" * 1152):
        samples = media.pad(raw)
        n, marks = media.fingerprints(samples)
        assert (n, marks.tolist()) == brute_fingerprints(samples)


def test_null_ids_and_equal_rows(spark):
    docs = frame(spark, ["ab", "ab", None, "ab"], [None, None, None, 4])
    for out in (media.media_features(docs), bpe.encode_decode(spark, docs, TOKENIZER)):
        rows = out.drop("fingerprints").collect()
        assert sorted(r["doc_id"] or -1 for r in rows) == [-1, -1, -1, 4]
        assert len({tuple(r)[1:] for r in rows}) == 2


def test_fingerprints_find_a_tone_and_its_delay():
    t = np.arange(20_000)
    tone = (127 + 60 * np.sin(2 * np.pi * t * 20 / media.FRAME) + 50 * np.sin(2 * np.pi * t * 55 / media.FRAME)).astype(np.uint8)
    first = next(media.stft(tone.tobytes()))
    assert set(media.peaks(first)[0][:2].tolist()) == {20, 55}
    rng = np.random.default_rng(0)
    song = rng.integers(0, 256, 40_000).astype(np.uint8)
    late = np.concatenate([rng.integers(0, 256, 10 * media.HOP).astype(np.uint8), song])
    votes = media.match_offsets(media.fingerprints(song.tobytes())[1], media.fingerprints(late.tobytes())[1])
    assert max(votes, key=votes.get) == 10


def brute_phrases(text, sample):
    """Phrases of one parse from end to end: a letter that the sample lacks ends a phrase and begins none."""
    count, held = 1, ""
    for c in text:
        if held + c in sample:
            held += c
        else:
            count, held = count + 1, c if c in sample else ""
    return count


@pytest.mark.parametrize("segment", [1, 3, 50, langid.SEGMENT])
@pytest.mark.parametrize("dense_bytes", [0, langid.DENSE_BYTES])
def test_phrases_equal_brute_force(monkeypatch, segment, dense_bytes):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    monkeypatch.setattr(langid, "DENSE_BYTES", dense_bytes)
    rng = np.random.default_rng(1)
    train = {"x": "".join(rng.choice(list("abc "), 300)), "y": "".join(rng.choice(list("bcd "), 300)), "z": "ab" * 150}
    model = langid.Model(train)
    folded = {k: langid.fold(v) for k, v in train.items()}
    texts = [langid.fold("".join(rng.choice(list("abcd e"), rng.integers(0, 400)))) for _ in range(25)] + [langid.fold("ab" * 130), langid.fold("ab" * 70 + "c" + "ab" * 70)]
    got = model.phrases([model.codes(t) for t in texts])
    for k, lang in enumerate(model.langs):
        assert got[k].tolist() == [brute_phrases(t, folded[lang]) for t in texts]


def test_phrases_of_a_very_long_text():
    model = langid.Model({"aa": "abcab" * 3000, "bb": "acbcb" * 3000})
    text = langid.fold("abcab" * 200_000)
    assert model.phrases([model.codes(text), model.codes(text[:5000])])[0].tolist() == [brute_long(text, 15_000), 1]


def brute_long(text, size):
    """``abcab`` again and again, in a sample of so many characters of it: a phrase is as long as the sample allows."""
    sample, count, at = langid.fold("abcab" * (size // 5)), 1, 0
    while at < len(text):
        lo, hi = 1, min(len(sample), len(text) - at)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if text[at : at + mid] in sample else (lo, mid - 1)
        at += lo
        count += at < len(text)
    return count


def test_langid_cases_and_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 ?!", "en", "s", 0), (9003, "", None, None, 0)], docs.schema)
    out = langid.identify(docs.union(extra)).cache()
    assert out.count() == docs.count() + 3
    assert {tuple(r) for r in out.filter("doc_id > 9000").select("lang_pred", "score").collect()} == {("und", 0.0)}
    held = out.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.filter("lang = lang_pred").count() / held.count() > 0.95
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.limit(5).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("dense_bytes", [0, langid.DENSE_BYTES])
def test_langid_learns_every_script_and_every_language(monkeypatch, dense_bytes):
    monkeypatch.setattr(langid, "DENSE_BYTES", dense_bytes)
    rng = np.random.default_rng(7)
    scripts = {"zh": range(0x4E00, 0x5200), "ja": range(0x3041, 0x3091), "el": range(0x3B1, 0x3C9), "ru": range(0x430, 0x450), "xx": range(0x20000, 0x20100)}
    words = {k: ["".join(rng.choice([*map(chr, v)], 3)) for _ in range(300)] for k, v in scripts.items()}
    say = lambda k: "".join(rng.choice(words[k], 1000))
    samples = {k: say(k) for k in scripts}
    many = {f"a{k:03}": "".join(rng.choice(list("abcdefgh"), 3000)) for k in range(70)}  # more than 64 before the scripts
    model = langid.Model(samples | many)
    assert [x[0] for x in langid.predict(model, [say(k) for k in scripts])] == [*scripts]


def test_langid_learns_from_an_over_long_text(spark):
    long = {k: " ".join(w * n for w in words for n in range(1, 4)) for k, words in (("aa", ("ab", "ba", "bb")), ("cc", ("cd", "dc", "dd")))}
    rows = [(1, (long["aa"] + " ") * 2000, "aa"), (2, "abba baab", "aa"), (3, (long["cc"] + " ") * 2000, "cc")]
    assert min(len(rows[0][1]), len(rows[2][1])) > langid.CHARS_PER_LANG
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "cc"] and [x[0] for x in langid.predict(model, list(long.values()))] == ["aa", "cc"]


def test_samples_are_bounded(spark, monkeypatch):
    """One text of each id, and no more characters than the bound, whatever the rows."""
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 2000)
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, ys, share=None: seen.update(texts=texts, ys=ys) or toxicity.Model(None, 0.0))
    docs = frame(spark, ["x" * 5000] + ["y" * 100] * 60 + ["z" * 90] * 30, [0] + [5] * 30 + list(range(100, 130)) + [6] * 30)
    marks = spark.createDataFrame([(i, None, i % 2) for i in [0, 5, 6, *range(100, 130)]], "doc_id long, quality int, toxic int")
    toxicity.fit(toxicity.narrow(docs), marks)
    assert sum(map(len, seen["texts"])) <= 2000 and len(seen["texts"]) == len(seen["ys"]) > 10 and "x" * 5000 not in seen["texts"]
    many = spark.createDataFrame([(1, "ab " * 100, "aa")] * 500 + [(k, "cd " * 30_000, "cc") for k in range(90)] + [(None, "ef", "ee")], "doc_id long, text string, lang string")
    model = langid.fit(many)
    assert model.langs == ["aa", "cc", "ee"] and model.bits[1] < 16.1


def test_quality_cases_and_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, 0), (9002, "", "en", "s", 0), (9002, "", "en", "s", 0), (None, "z" * 50_000, "en", "s", 0)], docs.schema)
    out = quality.classify(docs.union(extra), labels).cache()
    assert out.count() == docs.count() + 4 and out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    held = out.filter("held_out").join(labels, "doc_id")
    assert held.filter("predicted = quality").count() / held.count() > 0.93
    none = quality.classify(docs.limit(3), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_normal_equations_and_isotonic():
    x, y = quality.isotonic([0.0, 0.1, 0.2, 0.3], [0, 3, 1, 4], [4, 4, 4, 4])
    assert (x, y) == ([0.0, 0.1, 0.2, 0.3], [0.0, 0.5, 0.5, 1.0])
    assert np.all(quality.statistics(b"") == 0) and len(quality.statistics(b"a")) == quality.N_STATS
    s = np.random.default_rng(0).normal(size=(500, quality.N_STATS))
    z = quality.fourier(s, np.zeros(quality.N_STATS), np.ones(quality.N_STATS))[:, :-1]
    near = z[0] @ z[0]
    assert 0.8 < near < 1.2 and abs(z[0] @ z[1]) < 0.9


def test_ridge_equals_a_direct_solution(spark):
    """Sums over partitions give the weights of one solution over all rows; the scores are the isotonic shares."""
    rng = np.random.default_rng(3)
    stats = rng.normal(size=(300, quality.N_STATS))
    y = (stats[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    rows = spark.createDataFrame([([float(v) for v in s], int(k)) for s, k in zip(stats, y)], "stats array<double>, label int").repartition(5)
    model = quality.fit(rows)
    z = quality.fourier(stats, stats.mean(0), np.maximum(stats.std(0), 1e-3))
    penalty = quality.RIDGE * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    want = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)
    score = model.score(stats)
    assert ((score >= 0) & (score <= 1)).all() and ((score > 0.5) == y).mean() > 0.9


def test_toxicity_on_the_tables(spark):
    """Held-out labels: scores rank toxic documents above others, and few others are flagged."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = toxicity.score(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = (np.array([r["score"] for r in held if r["toxic"] == k]) for k in (1, 0))
    print("ranked", (toxic[:, None] > clean[None, :]).mean())
    assert (toxic[:, None] > clean[None, :]).mean() > 0.9
    assert (toxic >= 0.7).mean() > 0.5 and (clean >= 0.7).mean() < 0.02


def test_very_long_text(spark):
    text = "Ein sehr langer Text, der nie endet. " * 30_000
    docs = frame(spark, [text])
    assert bpe.encode_decode(spark, docs, TOKENIZER).first()["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert langid.predict(langid.Model({"de": text[:3000], "en": "the long text never ends " * 100}), [text])[0][0] == "de"
    assert 0 <= toxicity.train(*toxic_sample()[1:]).scorer()(text) <= 1


def toxic_sample():
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("etaoinshr"), rng.integers(3, 9))) for _ in range(300)]
    texts, labels = [], []
    for k in range(400):
        words = list(rng.choice(plain, 60))
        if k % 2:
            words[int(rng.integers(60))] = str(rng.choice(["stupid", "idiot", "worthless"]))
        texts.append(" ".join(words))
        labels.append(k % 2)
    return plain, texts, labels


def test_toxicity_learns_and_spots_misspellings():
    plain, texts, labels = toxic_sample()
    model = toxicity.train(texts, labels)
    score = model.scorer()
    clean = " ".join(plain[:60])
    assert score(clean) < 0.5 < score(clean + " stupid")
    assert score(clean + " stupidd") > score(clean) and score(clean + " idiott") > score(clean)
    assert 0 <= score(None) == score("") == score("!!") <= 1


def test_toxicity_cases(spark):
    _, texts, labels = toxic_sample()
    docs = frame(spark, [*texts, None, "", "a" * 200_000], [*range(len(texts)), None, 9002, 9003])
    marks = spark.createDataFrame([(i, None, t) for i, t in enumerate(labels)] + [(None, None, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, marks).cache()
    assert out.count() == docs.count() and out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    held = out.filter("held_out AND doc_id < 400").collect()
    toxic, clean = ([r["score"] for r in held if labels[r["doc_id"]] == k] for k in (1, 0))
    assert np.mean([x > y for x in toxic for y in clean]) > 0.75 and all(r["predicted"] == (r["score"] >= 0.7) for r in held)
    assert toxicity.score(docs.limit(0), marks).count() == 0
    assert {round(r["score"], 3) for r in toxicity.score(docs.limit(2), marks.limit(0)).collect()} == {0.0}


def test_held_out_rule(spark):
    from scholion.llm.common import remainder

    rows = spark.range(50).select("id", remainder(F.col("id"), 4).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in rows)


@pytest.mark.parametrize("text", ODD)
def test_statistics_are_finite(text):
    assert np.isfinite(quality.statistics(text.encode())).all()


def test_toxicity_equals_a_plain_model():
    """Scores: the softmax of the mean of word vectors, each the mean of its n-grams' embeddings. The gradient: differences of the loss."""
    rng = np.random.default_rng(3)
    e, w, b = rng.normal(size=(toxicity.BUCKETS, toxicity.DIMS)) * 0.02, rng.normal(size=(toxicity.DIMS, 2)), rng.normal(size=2)
    score = toxicity.folded(e, w, b).scorer()
    for text in ("one two two three", "Ein Wört, ein WÖRT!", "x", "", None, "a_b " * 50, "long" * 40):
        total, weights = np.zeros(toxicity.DIMS), toxicity.PADDING
        for word in set(toxicity.words_of(text)):
            share = 1 if (c := toxicity.words_of(text).count(word)) == 1 else 1 + 0.3 * np.log(c)
            marked = f"<{word}>"
            grams = {marked} | {marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1)}
            total += share * np.mean([e[zlib.crc32(g.encode()) % toxicity.BUCKETS] for g in grams], axis=0)
            weights += share
        z = toxicity.SCALE * total / weights @ w + b
        assert score(text) == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), abs=1e-9)
    texts, y = ["a b", "b c c", "", "d a"], np.array([1, 0, 0, 1])
    width = 11
    rows = [toxicity.bag_of(t, {}) for t in texts]
    dense = np.zeros((4, width))
    for k, (columns, weight) in enumerate(rows):
        np.add.at(dense[k], columns % width, weight.astype(float) * toxicity.SCALE)
    bags = toxicity.Bags([np.flatnonzero(r) if r.any() else np.array([0]) for r in dense], [(r[r != 0] if r.any() else np.zeros(1)).astype(np.float32) for r in dense], width)
    m = rng.normal(size=(width, 3)).astype(np.float32)
    assert np.allclose(bags.dot(m), dense @ m, atol=1e-4) and np.allclose(bags.t_dot(rng.normal(size=(4, 2)).astype(np.float32) * 0 + 1), dense.T @ np.ones((4, 2)), atol=1e-4)
    loss = toxicity.objective(bags, y)
    x = rng.normal(size=width * toxicity.DIMS + toxicity.DIMS * 2 + 2) * 0.3
    value, g = loss(x)
    for k in range(len(x)):
        step = np.zeros(len(x))
        step[k] = 1e-3
        assert g[k] == pytest.approx((loss(x + step)[0] - loss(x - step)[0]) / 2e-3, abs=2e-3 * max(1, np.abs(g).max()))


def test_samples_of_very_many_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "TOTAL_CHARS", 400)
    word = lambda k: "abcdefghij"[k] * 3 + "wort"
    rows = [(20 * k + n, f"{word(k)} " * 30, f"l{k}") for k in range(10) for n in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 10 and all(2**b <= 2 + 42 for b in model.bits)
    assert [langid.predict(model, [f"{word(k)} {word(k)}"])[0][0] for k in (3, 7)] == ["l3", "l7"]
