"""Quality, language and toxicity: awkward rows, what they never learn from, and held-out accuracy."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folianth.llm import crf_quality, kernels, langid, toxicity

from .common import HAVE, documents, empty, rows, words

DATA = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    score, trans, begin = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 3, 4, 7])
    p, pair, log_z = crf_quality.marginals(score, begin, trans)
    total, pairs, want = 0.0, np.zeros((2, 2)), []
    for a, b in zip(begin[:-1], begin[1:]):
        z, mass, pp = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for k in range(1 << (b - a)):
            y = [k >> i & 1 for i in range(b - a)]
            w = np.exp(sum(score[a + i] * v for i, v in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:])))
            z += w
            mass += w * np.array(y)
            for u, v in zip(y, y[1:]):
                pp[u, v] += w
        want.extend(mass / z)
        pairs += pp / z
        total += np.log(z)
    assert np.allclose(p, want) and np.allclose(pair, pairs) and np.isclose(log_z, total)


def test_messages_cross_pieces_of_any_size():
    rng = np.random.default_rng(2)
    begin = np.concatenate([[0], np.cumsum([1, 700, 64, 65, 3, 128, 1])])
    score, trans = rng.normal(size=begin[-1]) * 3, rng.normal(size=(2, 2))
    whole = crf_quality.marginals(score, begin, trans, piece=10**6)
    for piece in (1, 2, 64, 100):
        got = crf_quality.marginals(score, begin, trans, piece)
        assert np.allclose(got[0], whole[0]) and np.allclose(got[1], whole[1]) and np.isclose(got[2], whole[2])


def plain_quality(text, weights, trans):
    """A document's score, line by line, with neighbours and messages spelt out."""
    lines = (text or "").split("\n")
    own = []
    for x in lines:
        b = x.encode()
        n = len(b)
        count = lambda chars: sum(c in chars for c in b)  # noqa: E731, B023
        upper, lower, digit, high = (sum(lo <= c <= hi for c in b) for lo, hi in ((65, 90), (97, 122), (48, 57), (128, 255)))
        space, stop, punct, bang, pipe = map(count, (b" \t\r\x0b\x0c\n", b".?", b",;:'\"-()", b"!", b"|"))
        other = n - upper - lower - digit - high - space - stop - punct - bang - pipe
        solid = max(1, n - space)
        w = words(x)
        fresh = len(set(w)) / len(w) if w else 1.0
        twice = sum(p == q for p, q in zip(w, w[1:])) / max(1, len(w))
        own.append([
            n == 0, min(1, n / 20), min(1, n / 200), min(1, len(w) / 8), min(1, 1.25 * upper / max(1, upper + lower)), min(1, 4 * digit / solid), min(1, 10 * other / solid),
            min(1, 20 * bang / solid), min(1, 20 * pipe / solid), min(1, 10 * punct / solid), min(1, 20 * stop / solid), min(1, 2 * twice),
            max(0, 1 - fresh * 1.4) if len(w) >= 12 else 0, 1 - fresh if len(w) < 12 else 0, min(1, (upper + lower + high) / max(1, len(w)) / 12), b[-1:] in (b".", b"?"), min(1, 2 * (other + bang + pipe) / solid),
        ])
    k = crf_quality.OWN
    odds = []
    for i, here in enumerate(own):
        z = np.dot(here, weights[:k]) + weights[-3] + (i == 0) * weights[-2] + (i == len(own) - 1) * weights[-1]
        z += np.dot(own[i - 1], weights[k : 2 * k]) if i else 0
        odds.append(z + (np.dot(own[i + 1], weights[2 * k : 3 * k]) if i + 1 < len(own) else 0))
    ahead = [np.array([1.0, np.exp(odds[0])])]
    for z in odds[1:]:
        a = ahead[-1] @ np.exp(trans) * np.array([1.0, np.exp(z)])
        ahead.append(a / a.sum())
    back = [np.ones(2)]
    for z in odds[:0:-1]:
        b = np.exp(trans) @ (back[-1] * np.array([1.0, np.exp(z)]))
        back.append(b / b.sum())
    good = [a[1] * b[1] / (a @ b) for a, b in zip(ahead, back[::-1])]
    size = [len(x.encode()) + 1e-3 for x in lines]
    return float(np.dot(good, size) / sum(size))


def test_quality_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    model = rng.normal(size=crf_quality.N_WEIGHTS), rng.normal(size=(2, 2))
    got = crf_quality.score(documents(spark), model, keep=("doc_id", "text")).collect()
    for r in got:
        assert np.isclose(r.score, plain_quality(r.text, *model), atol=1e-5), r.doc_id


@pytest.mark.skipif(not HAVE, reason="needs the driver's tables")
def test_equal_texts_score_alike_whatever_stands_beside_them(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(300).toPandas()["text"].tolist()
    again = [t for t in docs[::7] for _ in range(2)] + ["word " * 300_000, "", None, "x\n" * 100_000] + docs
    alone = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").coalesce(1)
    beside = spark.createDataFrame([(i, t) for i, t in enumerate(again)], "doc_id long, text string").coalesce(1)
    known = spark.read.parquet(f"{DATA}/labels.parquet")
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    names, matrix = langid.train(whole)
    for score in (
        lambda d, m=crf_quality.train(whole, known): crf_quality.score(d, m, keep=("text",)),
        lambda d, m=toxicity.train(whole, known): toxicity.score(d.withColumn("t", d["text"]), m, keep=("t",)).withColumnRenamed("t", "text"),
        lambda d: langid.predict(d.withColumn("t", d["text"]), (names, matrix), keep=("t",)).withColumnRenamed("t", "text"),
    ):
        first = {r.text: r.score for r in score(alone).collect()}
        for r in score(beside).collect():
            assert first.setdefault(r.text, r.score) == r.score


def test_fit_climbs():
    rng = np.random.default_rng(1)
    x = np.hstack([rng.normal(size=(400, 3)), np.ones((400, 1))])
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    w, t = crf_quality.fit(x, y, np.arange(0, 401, 4))
    p, _, _ = crf_quality.marginals(x @ w, np.arange(0, 401, 4), t)
    assert ((p >= 0.5) == y).mean() > 0.9


def test_words_equal_python():
    import pyarrow as pa

    from .common import TEXTS, words

    data, at = kernels.string_bytes(pa.array(TEXTS))
    hashes, start, end, begin = kernels.words(data, at)
    seen = {}
    for k, t in enumerate(TEXTS):
        got = [bytes(kernels.LOWER[data[a:b]]).decode() for a, b in zip(start[begin[k] : begin[k + 1]], end[begin[k] : begin[k + 1]])]
        assert got == words(t)
        for w, h in zip(got, hashes[begin[k] : begin[k + 1]]):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(20)] + [(7, 0, 1), (None, 1, 1), (500, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_of_awkward_rows(spark):
    model = crf_quality.train(documents(spark), labels(spark))
    got = crf_quality.score(documents(spark), model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert crf_quality.score(empty(spark), model).count() == 0
    assert crf_quality.train(documents(spark), labels(spark).where("quality = 1")) is None
    assert {r.score for r in crf_quality.score(documents(spark), None).collect()} == {0.5}


def test_toxicity_of_awkward_rows(spark):
    model = toxicity.train(documents(spark), labels(spark))
    got = toxicity.score(documents(spark), model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty(spark), model).count() == 0
    assert {r.score for r in toxicity.score(documents(spark), None).collect()} == {0.0}


def test_toxic_sentence_is_located(spark):
    clean = ["the cat sat on the mat. it was warm and quiet there"] * 30
    toxic = ["the cat sat on the mat. you are a dreadful idiot. it was warm"] * 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean + toxic)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i >= 30)) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.train(df, lab)).collect()}
    assert all(got[i].predicted == int(i >= 30) for i in range(60))
    r = got[40]
    assert "idiot" in toxic[10].encode()[r.worst_at : r.worst_at + r.worst_len].decode()


def plain_toxicity(text, weights, bias):
    """1 - (1 - leak) x the product over sentences, spelt out."""
    clean, top = 1.0, 0.0
    for sentence in re.split(rb"[\n!.?]", (text or "").encode()):
        z, before = 0.0, None
        for w in (x.encode() for x in words(sentence.decode())):
            if w != before:
                for part, n in ((w, 0), *((w[:n], n) for n in (4, 5, 6) if len(w) > n)):
                    z += weights[toxic_bucket(part, n)]
            before = w
        p = 1 / (1 + np.exp(-z - bias)) if z > 0 else 0.0
        clean *= 1 - p if p >= toxicity.FLOOR else 1
        top = max(top, p)
    return 1 - (1 - toxicity.LEAK) * min(clean, 1 - top)


def toxic_bucket(part, n):
    h = sum((b + 1) * pow(kernels._BASE, i, 1 << 64) for i, b in enumerate(part)) % (1 << 64)
    mixed = int(kernels.mix(np.array([h], np.uint64))[0])
    return ((mixed + n * 0x51ED2701) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 46


@pytest.mark.filterwarnings("ignore:overflow")
def test_toxicity_equals_a_plain_version(spark):
    rng = np.random.default_rng(6)
    weights = np.where(rng.random(toxicity.BUCKETS) < 0.2, rng.random(toxicity.BUCKETS) * 6, 0.0)
    texts = [r[1] for r in rows()] + ["Some words. Others here! " * 50, "a b c d e f g " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(df, (weights, -9.0)).collect():
        assert np.isclose(r.score, plain_toxicity(texts[r.doc_id], weights, -9.0), atol=1e-9)


@pytest.mark.skipif(not HAVE, reason="needs the driver's tables")
def test_clean_sentences_do_not_add_up(spark):
    whole, known = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(whole, known)
    scored = toxicity.score(whole, model, keep=("doc_id",)).join(known, "doc_id").join(whole.select("doc_id", "text"), "doc_id")
    clean = [r.text for r in scored.where("toxic = 0 and predicted = 0").select("text").collect()]
    one = clean[0].replace("\n", " ").split(".")[0] + ". "
    long = ["\n".join(clean * 2), one * 6000, one * 20_000, "word\n" * 20_000]
    assert long[0].count(".") > 20_000
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert all(r.score < 0.5 and r.predicted == 0 for r in toxicity.score(df, model).collect())
    toxic = [r.text for r in scored.where("toxic = 1 and score > 0.9").select("text").limit(5).collect()]
    df = spark.createDataFrame([(i, long[2] + t) for i, t in enumerate(toxic)], "doc_id long, text string")
    assert all(r.predicted == 1 for r in toxicity.score(df, model).collect())


def test_language_of_awkward_rows(spark):
    model = langid.train(documents(spark))
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(documents(spark), model).collect()}
    assert {(0, "und"), (1, "und"), (3, "und")} <= got and (6, "en") in got
    assert langid.predict(empty(spark), model).count() == 0
    assert {r.lang_pred for r in langid.predict(documents(spark), langid.train(empty(spark))).collect()} == {"und"}


def plain_buckets(text):
    chars = [ord(c) for c in " ".join(("", *text.lower().split(), ""))]
    for n in langid.ORDERS:
        for i in range(len(chars) - n + 1):
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for c in chars[i : i + n]:
                h = (h ^ c) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 15
            yield h % langid.BUCKETS


@pytest.mark.parametrize("piece", [3, 50, 1 << 18])
def test_language_counts_and_scores_equal_plain_bayes(spark, monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    known = [(i, t, lang) for i, (t, lang) in enumerate([("el gato negro", "es"), ("the  black cat\n", "en"), ("der schwarze Kater ÄÖÜ", "de"), ("The cat", "en")])]
    names, matrix = langid.train(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    for k, name in enumerate(names):
        count = np.bincount([b for _, t, lang in known if lang == name for b in plain_buckets(t)], minlength=langid.BUCKETS) + 0.1
        assert np.allclose(matrix[k, :-1], np.log(count / count.sum()))
    texts = [r[1] for r in rows()] + ["the cat " * 200, "İstanbul\u3000x", "gato"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in langid.predict(df, (names, matrix)).collect():
        t = texts[r.doc_id]
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            total = matrix[:, -1] + matrix[:, list(plain_buckets(t))].sum(1)
            best = int(np.argmax(total))
            assert names[best] == r.lang_pred and np.isclose(r.score, 1 / np.exp(total - total[best]).sum())


@pytest.mark.skipif(not HAVE, reason="needs the driver's tables")
def test_language_of_a_text_of_a_million_characters(spark):
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    names, matrix = langid.train(whole)
    text = ("\n".join(r.text for r in whole.where("lang = 'es'").select("text").collect() if r.text) * 9)[:1_000_003]
    (r,) = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), (names, matrix)).collect()
    chars, at = langid.characters([text])
    total = matrix[:, -1] + sum(matrix[:, langid.hashed(chars, n, langid.BUCKETS)].sum(1) for n in langid.ORDERS)
    assert len(text) > 1_000_000 and names[int(np.argmax(total))] == r.lang_pred == "es" and np.isclose(r.score, 1 / np.exp(total - total.max()).sum())


def test_language_scores_equal_plain_bayes(spark):
    df = spark.createDataFrame([(1, "el gato negro", "es"), (2, "the black cat", "en"), (3, "der schwarze Kater", "de")], "doc_id long, text string, lang string")
    names, matrix = langid.train(df)
    for r in langid.predict(df, (names, matrix)).collect():
        text = {1: "el gato negro", 2: "the black cat", 3: "der schwarze Kater"}[r.doc_id]
        total = matrix[:, -1] + matrix[:, langid.buckets(text)].sum(1)
        assert names[int(np.argmax(total))] == r.lang_pred
        assert np.isclose(r.score, 1 / np.exp(total - total.max()).sum(), atol=1e-3)


@pytest.mark.skipif(not HAVE, reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    from folianth.llm import queries

    labels_ = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    for name, label, least in (("op3_quality_classifier", "quality", 0.97), ("op10_toxicity", "toxic", 0.9)):
        out = queries.QUERIES[name](spark, DATA).toPandas()
        assert crf_quality.accuracy(out, labels_, label)["all"] >= least
        n = {"op3_quality_classifier": (3, 1), "op10_toxicity": (5, 0)}[name]
        assert (out["held_out"] == [zlib.crc32(str(i).encode()) % n[0] == n[1] for i in out["doc_id"]]).all()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas()
    both = queries.QUERIES["op6_language_id"](spark, DATA).toPandas().merge(docs, on="doc_id")
    both = both[both["held_out"]]
    assert (both["lang"] == both["lang_pred"]).mean() >= 0.97


def test_samples_are_bounded(spark):
    """By rows and by cost, in an order that ids alone decide; repeated rows count once, and costly documents keep none out."""
    from folianth.llm.sampling import labelled

    data = [(i, f"text {i} " * (i % 5 + 1)) for i in range(300)] + [(7, "text 7 " * 3)] * 500 + [(400, "x" * 5000), (None, "y")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(401)], "doc_id long, y int")
    cost = F.char_length("text")
    chosen = lambda d, rows, most: sorted(tuple(r) for r in labelled(d, known, "s", rows, cost, most).collect())
    assert 20 < len(chosen(docs, 50, 10**6)) <= 50 and len(set(chosen(docs, 1000, 10**6))) == len(chosen(docs, 1000, 10**6)) == 301
    some = chosen(docs, 1000, 2000)
    assert 1000 < sum(len(t) for _, t in some) <= 2000 and all(len(t) <= 100 for _, t in some)
    assert chosen(docs.repartition(5, "text"), 1000, 2000) == some and chosen(docs, 1000, 10) == []
