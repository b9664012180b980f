"""Each operator against brute force, a round trip, or what it must be able to learn."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from twinsift.llm import bpe, langid, licenses, mixing, pii, quality, sharding, simhash, topk, toxicity
from twinsift.llm.queries import CATEGORIES, RANKS

SHAPE = "doc_id long, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# -- 1


def test_mix_comes_near_targets(spark):
    random.seed(2)
    rows = [(i, "w " * random.randint(1, 40), random.choice(["a", "b", "c", "d", None])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(df).toPandas()
    again = mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "repeats"]
    assert found[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    found["taken"] = found["size"] * found["repeats"]
    by = found.groupby(found["source"].fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 20).all() and found.repeats.max() <= 3
    assert abs(by.target.sum() - by["size"].sum()) < 1e-6


def test_targets_stop_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90)], "source string, source_size long")
    got = {x["source"]: x["target"] for x in mixing.targets(sizes, (5, 2, 1)).collect()}
    # a stops at 30; b and c share 1070 by 2 and 1, so that c stops at 270
    assert got["a"] == 30 and got["c"] == 270 and got["b"] == pytest.approx(800)


def test_thresholds_are_nested(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(500)], "doc_id long, text string, source string")
    less = {x[0]: x[1] for x in mixing.mix(df, (1, 3)).select("doc_id", "repeats").where("source = 'b'").collect()}
    more = {x[0]: x[1] for x in mixing.mix(df, (1, 9)).select("doc_id", "repeats").where("source = 'b'").collect()}
    assert all(less[k] <= more[k] for k in less)


def test_equal_rows_share_a_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 8)
    rows = [(1, "w " * 10, "a")] * 50 + [(2, "v " * 10, "b")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(df).toPandas()
    assert len(found) == 100
    taken = (found["size"] * found["repeats"]).groupby(found["source"]).sum()
    target = found.groupby("source").target.first()
    assert (abs(taken - target) <= 5).all()
    documents = mixing.mixed_documents(df).groupBy("source").count().toPandas().set_index("source")["count"]
    assert (documents.sort_index() * 10 == taken.sort_index()).all()


# -- 2


@pytest.fixture(scope="module")
def encoder():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_equals_tiktoken(encoder):
    random.seed(1)
    parts = ["'", " ", "\n", "\t", "s", "t", "re", "ll", "d", "1", "23", "!", " ", "é", "日本", "\x1c", " ", "'s", "''", "\r\n", "😀", "'LL", "word"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2500, " " * 4000, "".join(random.choice("abcdefgh") for _ in range(20_000)), "x" * 63 + "é" * 40]
    words = bpe.vocabulary(RANKS)
    for text, ids in zip(texts, words.encode(texts)):
        assert encoder.encode_ordinary(text) == ids.tolist()
        assert words.decode(ids) == text.encode()


def test_bpe_cuts_long_texts_where_tokens_begin(encoder, monkeypatch):
    rng = random.Random(2)
    parts = ["'", " ", "\n", "s", "ll", "12", "!", " ", "é", "日本", "\x1c", "word", "\u3000", "  "]
    text = "".join(rng.choice(parts) for _ in range(20_000))
    words = bpe.vocabulary(RANKS)
    for most in (1, 7, 100, 4000):
        monkeypatch.setattr(bpe, "LONGEST", most)
        assert "".join(bpe.portions(text)) == text and max(map(len, bpe.portions(text))) <= most + 200
        ids = words.encode(["a", text, "", "b c"])
        assert [x.tolist() for x in ids] == [encoder.encode_ordinary(x) for x in ("a", text, "", "b c")]
        assert words.decode(ids[1]) == text.encode()


def test_bpe_on_all_classes(encoder):
    texts = [f"a{chr(c)}a 1{chr(c)}1" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    for text, ids in zip(texts, bpe.vocabulary(RANKS).encode(texts)):
        assert encoder.encode_ordinary(text) == ids.tolist()


def test_bpe_spans_and_query(spark, encoder):
    text = "Hello there, général don't"
    df = spark.createDataFrame([(1, text)], SHAPE)
    row = bpe.encode(df, RANKS).first()
    ids, ends = np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["ends"], "<u4")
    assert bpe.vocabulary(RANKS).decode_span(ids, ends, 3, 14) == text.encode()[3:14]
    assert bpe.decode(bpe.encode(df, RANKS), RANKS).first()["decoded"] == text.encode()
    found = bpe.round_trip(df, RANKS).first()
    packed = np.array(encoder.encode_ordinary(text), "<u4").tobytes()
    assert found["ids_sha256"] == hashlib.sha256(packed).hexdigest()
    assert found["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# -- 3


def test_language_accuracy(spark, small):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").toPandas()
    out = found[found.held_out]
    assert len(out) > 200 and (out.lang == out.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all() and found.rejected.mean() < 0.01
    assert found.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]


def test_language_rejects_what_is_far():
    model = langid.fit([("en", f"the cat and the dog number {i} are here") for i in range(50)])
    labels, score, rejected = model.predict(["the cat and the dog", "жщъ ыэю", "123 !!", None, "", "\u0301\u0302"])
    assert labels == ["en", "en", "und", "und", "und", "und"] and rejected.tolist() == [False] + [True] * 5


def test_language_sample_is_bounded_and_distinct(spark):
    rows = [(i, f"word{i % 50} the cat", "en") for i in range(2000)] + [(5000 + i, "le chat noir", "fr") for i in range(3000)]
    rows += [(9000, "x", None), (9001, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    model = langid.train(df, sample=10)
    assert set(model.labels) == {"en", "fr"} and model.predict(["le chat", "the cat"])[0] == ["fr", "en"]


def test_language_by_plain_centroids(spark):
    """Predictions held against cosines of dense vectors, gram by gram."""
    model = langid.fit([(k, f"{a} {b} {a}") for k, ws in {"en": "the cat and dog".split(), "fr": "le chat et chien".split()}.items() for a in ws for b in ws])
    for text in ("the cat", "le chien et", "cat chien", "and the", "é"):
        points = [ord(c.lower()) if c.isalpha() else 0 for c in text]
        row = np.zeros(langid.WIDTH)
        for n in (1, 2, 3):
            for i in range(len(points) - n + 1):
                gram = points[i] * 0x9E3779B1 % 2**32
                for p in points[i + 1 : i + n]:
                    gram = ((gram ^ (gram >> 15)) * 0x85EBCA77 + p) % 2**32
                row[gram * 0xC2B2AE3D % 2**32 >> 19] += 1
        row = np.log1p(row) * model.idf
        cosines = model.centroids @ (row / np.linalg.norm(row))
        labels, score, _ = model.predict([text])
        assert labels[0] == model.labels[int(cosines.argmax())] and score[0] == pytest.approx(max(0, cosines.max()), abs=1e-5)


def test_language_rejects_other_languages_on_real_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(df, langid.usable_rows())
    rng = random.Random(3)
    strange = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "人人生而自由 在尊严和权利上一律平等 他们赋有理性和良心 并应以兄弟关系的精神相对待",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "Bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar",
        "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(400)),
    ]
    assert model.predict(strange + [x * 20 for x in strange])[2].all()
    texts = [x["text"] for x in df.where(langid.held_out()).select("text").collect()]
    labels, _, rejected = model.predict(texts)
    assert rejected.mean() < 0.002
    short = [gone for text, gone in zip(texts, rejected) if len(text) <= 32]
    assert len(short) > 10 and not any(short)
    assert np.diff(model.reach).max() <= 0 and model.reach[:, -1].max() < 0.8


# -- 4


def test_toxic_words_are_learned(spark):
    random.seed(4)
    words = [f"w{random.randint(0, 300)}x" for _ in range(4000)]
    rows, labels = [], []
    for i in range(600):
        text = random.sample(words, 30)
        if i % 4 == 0:
            for k in range(3):
                text.insert(random.randint(0, len(text)), random.choice(["nasty", "vile", "grufflish", "gruffled"]))
        rows.append((i, " ".join(text)))
        labels.append((i, i % 2, int(i % 4 == 0)))
    df, y = spark.createDataFrame(rows, SHAPE), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.classify(df, y.where("doc_id < 400"), CATEGORIES).toPandas()
    late = found[found.doc_id >= 400]
    assert (late.toxic == (late.doc_id % 4 == 0)).mean() > 0.98
    assert {"p_poor", "p_toxic"} <= set(found.columns)


def test_chain_against_a_plain_fit(spark, small):
    """The query's probabilities from its vocabulary by dense logistic regressions, fold by fold."""
    df, labels = (spark.read.parquet(f"{small}/{x}.parquet") for x in ("documents", "labels"))
    chain = toxicity.train(df, labels, CATEGORIES)
    texts = {x["doc_id"]: x["text"] for x in df.collect()}
    draw = {x["doc_id"]: x["d"] for x in df.select("doc_id", F.xxhash64("text").alias("d")).collect()}
    seen = {}
    for x in labels.collect():
        seen[draw[x["doc_id"]], 1 - x["quality"], x["toxic"]] = x["doc_id"]
    rows = sorted(seen)
    features = sorted(chain.vocabulary, key=chain.vocabulary.get)

    def plain(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        return [math.log1p(sum(w.startswith(f[:-1]) and len(w) >= len(f) - 1 if f.endswith("*") else w == f for w in words)) for f in features]

    x = np.array([plain(texts[seen[r]]) for r in rows], np.float32).astype(float).reshape(len(rows), len(features))
    y = np.array([r[1:] for r in rows], float)
    fold = np.array([r[0] % toxicity.FOLDS for r in rows])
    ones = np.ones((len(rows), 1))
    first = np.zeros(len(rows))
    for f in range(toxicity.FOLDS):
        use = fold != f
        first[~use] = toxicity.probability(np.hstack([x, ones])[~use], toxicity.logistic(np.hstack([x, ones])[use], y[use, 0]))
    w0 = toxicity.logistic(np.hstack([x, ones]), y[:, 0])
    w1 = toxicity.logistic(np.hstack([x, first[:, None], ones]), y[:, 1])
    for got in toxicity.predict(df, chain).collect():
        row = np.array(plain(texts[got["doc_id"]]))
        p0 = toxicity.probability(np.append(row, 1), w0)
        assert got["p_poor"] == pytest.approx(p0, abs=1e-4)
        assert got["p_toxic"] == pytest.approx(toxicity.probability(np.append(row, [p0, 1]), w1), abs=1e-4)


def test_toxic_sample_is_bounded_by_texts(spark):
    rows = [(i, "same words here") for i in range(3000)] + [(5000 + i, f"w{i} other") for i in range(300)]
    df = spark.createDataFrame(rows, SHAPE)
    labels = df.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    chosen = toxicity.sampled(df, labels, CATEGORIES, sample=100)
    assert chosen.count() <= 100 and chosen.select("text").distinct().count() == 100


def test_later_models_learn_from_out_of_fold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = np.stack([x[:, 0] > 0, x[:, 0] > 0.2], 1).astype(float)
    y[:10, 1] = np.nan
    chain = toxicity.fit_chain(toxicity.Chain(["a", "b"]), x, y, np.arange(400) % toxicity.FOLDS)
    assert [len(w) for w in chain.weights] == [4, 5]
    assert ((chain.predict(x)[:, 1] > 0.5) == (x[:, 0] > 0.2)).mean() > 0.95


# -- 5


def test_quality_measures():
    random.seed(5)
    for _ in range(300):
        text = "".join(random.choice(["a", "b", "a b c", "\n", " ", "#", "é", "x|y", "\n\n", " "]) + random.choice(["", " "]) for _ in range(random.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert quality.measure(text)[:5] == expected


def test_binomial_bound_is_exact():
    from math import comb

    for bad, n, alpha in ((0, 50, 0.05), (3, 100, 0.01), (10, 40, 0.001)):
        p = quality.upper_bound(bad, n, alpha)
        assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(bad + 1)) == pytest.approx(alpha, rel=1e-6)


def test_cutoffs_keep_their_promise():
    good = {"symbols": {v: 100 for v in range(20)} | {60: 1}, "long_words": {0: 1000, 9: 1001}}
    poor = {"symbols": {64: 5, 60: 50, 3: 10}, "long_words": {0: 60, 9: 5}}
    order = quality.cutoff_order(good, poor)
    assert order[0] == ("symbols", 64) and all(rule == "symbols" for rule, _ in order)
    assert [v for _, v in order] == sorted((v for _, v in order), reverse=True)
    assert quality.accepted({}, 216, 4, 0.05 / 4, 0.02) == 0 and quality.accepted({}, 220, 4, 0.05 / 4, 0.02) == 4
    assert quality.accepted({1: 1, 2: 40}, 400, 4, 0.05 / 4, 0.02) == 2
    rng = np.random.default_rng(0)  # a true risk of 0.03 is accepted in one of twenty holdouts at most
    wrong = sum(quality.accepted({0: int(rng.binomial(600, 0.03))}, 600, 1, 0.05, 0.02) for _ in range(400))
    assert wrong <= 30


def test_verdicts_against_plain_rules(spark):
    """The query's verdicts worked out row by row from its labels."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(3000):
        words = [word() for _ in range(rng.randint(45, 90))]
        poor = i % 5 == 0
        if poor or i % 97 == 0:
            words = [x + rng.choice("#|$&*") * 3 for x in words]
        rows.append((i, " ".join(words), ("en", "de", None)[i % 3]))
        if i % 3 or i < 900:
            labels.append((i, int(not poor)))
    rows += [(5000 + i, *rows[i][1:]) for i in range(200)]
    df, y = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    found = {x["doc_id"]: x for x in quality.judge(df, y).collect()}
    names = list(quality.rules())
    value = {}
    for i, text, _ in rows:
        words, chars, symbols, dup, repeat, lines = quality.measure(text)
        share = (symbols / max(chars, 1), repeat / max(words, 1), dup / max(lines, 1), max(max(chars, 1) / max(words, 1) - 4, 0) / 16, 50.0 / max(words, 50))
        value[i] = [min(math.ceil(x * 64), 64) for x in share]
    draw = {x["doc_id"]: x["d"] for x in df.select("doc_id", F.xxhash64("text").alias("d")).collect()}
    part = {x["doc_id"]: x["t"] for x in df.select("doc_id", (F.pmod(F.xxhash64(F.xxhash64("text")), F.lit(1000)) < 250).alias("t")).collect()}
    texts = {}
    for i, good in labels:
        if not found[i]["base_failed"]:
            texts[rows[i][2], draw[i]] = (i, good)
    counted = {True: {}, False: {}}
    for i, good in texts.values():
        for rule, v in zip(names, value[i]):
            if part[i]:
                own = counted[good == 1].setdefault(rule, {})
                own[v] = own.get(v, 0) + 1
    order = quality.cutoff_order(counted[True], counted[False])
    hits = lambda i, steps: [r for r, v in zip(names, value[i]) if any(x == r and v >= c for x, c in order[:steps])]
    taken = {}
    for lang in ("en", "de", None):
        own = [i for (s, _), (i, good) in texts.items() if s == lang and good and not part[i]]
        taken[lang] = 0
        for step in range(1, len(order) + 1):
            bad = sum(bool(hits(i, step)) for i in own)
            if bad > 0.02 * len(own) or quality.upper_bound(bad, len(own), 0.05 / 3) > 0.02:
                break
            taken[lang] = step
    assert max(taken.values()) > 0
    for i, _, lang in rows:
        assert found[i]["failed_rules"] == ",".join(hits(i, taken[lang]))
        assert found[i]["kept"] == (not found[i]["base_failed"] and not hits(i, taken[lang]))


# -- 6


def test_licenses_against_brute_force():
    random.seed(6)
    parts = ["mit", "license", "apache", "general", "public", "License", "-", " ", "x", "é", "\n", "MIT License", "lesser"]
    for _ in range(500):
        text = "".join(random.choice(parts) + random.choice([" ", "", "."]) for _ in range(random.randint(0, 40)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        starts, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            own = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            starts += hits
            labels |= {label} if hits else set()
        got = licenses.scan_text(text)
        assert got[:5] == (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(got[5].split(",")) | {""}


def test_expressions():
    postfix = licenses.parse("MIT OR Apache-2.0 AND GPL-2.0 WITH Classpath-exception-2.0")
    assert postfix == ["mit", "apache-2.0", "gpl-2.0", "classpath-exception-2.0", "with", "and", "or"]
    assert licenses.evaluate(postfix)[1] == set()
    assert licenses.parse("(MIT") is None and licenses.parse("and MIT") is None and licenses.parse("") is None
    assert licenses.parse("(MIT or ISC) with x") is None and licenses.parse("MIT with (x)") is None and licenses.parse("a with b with c") is None
    found = licenses.scan_text("// SPDX-License-Identifier: (MIT or ISC)\ncode")
    assert found[5] == "isc,mit" and found[8] == "" and found[6] == pytest.approx(1 - 0.4**2)
    both = licenses.scan_text("/* spdx-license-identifier: MIT and ISC */\n" * 3)
    assert both[5] == both[8] == "isc,mit" and both[6] == pytest.approx(1 - 0.1**2) and len(both[7]) == 3
    assert licenses.scan_text("SPDX license identifier: MIT")[5] == ""
    assert len(licenses.evaluate(licenses.parse(" and ".join(f"(a{i} or b{i})" for i in range(5000))))[0]) == 10_000


def test_expressions_against_all_choices():
    """Required licences, labels and scores from every set of licences that one can hold."""
    rng, names = random.Random(8), ["a", "b", "c", "d", "a with x"]

    def grown(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(names)
        return f"({grown(depth - 1)} {rng.choice(['and', 'or'])} {grown(depth - 1)})"

    for _ in range(150):
        expression = grown(4)
        postfix = licenses.parse(expression.upper())
        named = set(re.findall(r"a with x|\b[a-d]\b", expression))
        sets = [{x for k, x in enumerate(names) if bits >> k & 1} for bits in range(32)]
        plain = lambda held: eval(re.sub(r"a with x|\b[a-d]\b", lambda m: str(m[0] in held), expression))  # noqa: E731, B023
        good = [held for held in sets if plain(held)]
        assert [held for held in sets if licenses.satisfied(postfix, held)] == good
        required = set.intersection(*good)
        found = licenses.scan_text(f"x\n# SPDX-License-Identifier: {expression}\r\nmit license y")
        assert found[5] == ",".join(sorted(named | {"mit"})) and found[8] == ",".join(sorted(required))
        doubt = 0.3 * 0.1 ** len(required) * 0.4 ** len(named - required)
        assert found[6] == pytest.approx(1 - doubt)


# -- 7


def test_sharding(spark):
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(4000)], SHAPE)
    found = sharding.shard(df, parts=16).toPandas()
    for _, own in found.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
        assert abs(len(own) - 500) < 120
    moved = found[found["shard"] != found.grown_shard]
    assert set(moved.grown_shard) == {8} and abs(len(moved) - 4000 / 9) < 120
    assert found.text_crc32.tolist() == [zlib.crc32(f"text {i % 7}".encode()) for i in found.doc_id]


def test_shards_against_plain_scores(spark, monkeypatch):
    """Each row's shards by scores worked out in Python, hot and missing keys among them."""
    monkeypatch.setattr(sharding, "PIECE", 60)
    rows = [(i, f"text {i % 7}") for i in range(300)] + [(7, "hot")] * 500 + [(None, None)] * 20
    found = sharding.shard(spark.createDataFrame(rows, SHAPE), (2, 1, 1), parts=4).toPandas()

    def best(key, weights):
        unit = [(int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for k in range(len(weights))]
        return max(range(len(weights)), key=lambda k: -weights[k] / math.log(unit[k]))

    for x in found.itertuples():
        key = "null" if x.doc_id != x.doc_id else int(x.doc_id)
        assert (x.shard, x.grown_shard) == (best(key, (2, 1, 1)), best(key, (2, 1, 1, 1)))
    assert len(found) == len(rows) and all(sorted(own.slot) == list(range(len(own))) for _, own in found.groupby("shard"))


def test_weighted_shards(spark):
    df = spark.createDataFrame([(i, "") for i in range(4000)], SHAPE)
    counts = sharding.shard(df, (3, 1, 0)).groupBy("shard").count().toPandas().set_index("shard")["count"]
    assert abs(counts[0] - 3000) < 150 and 2 not in counts


# -- 8


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_blocks():
    text = "Some Words\there é and\x0bthere " * 40 + "end"
    assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(text, block=7) == brute_fingerprint(text)
    for short in ("", "one", "one TWO", None, " \n"):
        assert simhash.fingerprint(short) == brute_fingerprint(short)


@pytest.mark.parametrize("most_pairs", [1 << 16, 20])
def test_components_against_brute_force(spark, most_pairs):
    random.seed(3)
    known = {b ^ m for b in [random.getrandbits(64) for _ in range(8)] for m in (sum(1 << random.randrange(64) for _ in range(random.randint(0, 3))) for _ in range(25))}
    known = sorted(x - (1 << 64) if x >> 63 else x for x in (v & (1 << 64) - 1 for v in known))
    root = {x: x for x in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(known):
        for b in known[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    df = simhash.checkpointed(spark.createDataFrame([(x,) for x in known], "fp long"))
    got = {x["node"]: x["root"] for x in simhash.components(simhash.links(df, most_pairs)).collect()}
    assert all(got.get(x, x) == find(x) for x in known)


def brute_shape(text):
    """The set of five-word shingles, and the fingerprint of the distinct words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    known = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in set(words)]
    return known, sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_copy(a, b):
    """Whether two shapes link: four in five shingles common, fingerprints within the fetch."""
    common = len(a[0] & b[0])
    return 5 * common >= 4 * (len(a[0]) + len(b[0]) - common) and (a[1] ^ b[1]).bit_count() <= simhash.NEAR


def roots_of(shapes):
    root = {i: i for i in shapes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(shapes)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if near_copy(shapes[a], shapes[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_shapes():
    for text in ("Some Words\there é and\x0bthere " * 30 + "end", "", "one", "one TWO", None, "a b c d", "a b c d e", "a a a a a a a a"):
        known, print_ = brute_shape(text)
        for block in (9, 8 << 20):
            want = sorted(xxhash.xxh64_intdigest(x.encode(), 42) for x in known)
            assert simhash.shingle_set(text, block).tolist() == want
            assert simhash.word_print(text, block) == print_


def families(seed=7, n=240):
    """Texts that differ from one of six, or from another such text, by a few words: some pairs are close, some just not."""
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(120)) for _ in range(6)]
    while len(texts) < n:
        words = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("n, most_pairs, block, set_block", [(10, 1 << 16, 8192, 1 << 22), (10, 0, 8192, 1 << 22), (10, 0, 16, 900), (1 << 25, 1, 7, 1 << 22)])
def test_near_copies_against_brute_force(spark, monkeypatch, n, most_pairs, block, set_block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SET_BLOCK", set_block)
    texts = families()
    shapes = {i: brute_shape(x) for i, x in enumerate(texts)}
    want = roots_of(shapes)
    assert 6 < len(set(want.values())) < 200
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, signed(fp), len(known), i) for i, (known, fp) in shapes.items()]
    nodes = simhash.checkpointed(spark.createDataFrame(rows, "node long, fp long, size long, key long"))
    own = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "key long, text string")
    got = {x["node"]: x["root"] for x in simhash.near_copies(nodes, own, simhash.segments(n), most_pairs=most_pairs).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_copies_below_the_similarity_stay(spark):
    """A crowd of texts whose fingerprints are close but whose sets aren't: none goes."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(300)]
    texts = set()
    while len(texts) < 80:
        words = list(base)
        for at in range(0, 300, 12):  # each fifth-word window of every dozen differs
            words[at], words[at + 6] = (f"w{rng.randrange(300)}" for _ in range(2))
        texts.add(" ".join(words))
    df = spark.createDataFrame(list(enumerate(sorted(texts))), SHAPE)
    assert simhash.representatives(df).count() == 80


def test_sketches_rule_out_no_link(spark):
    rng = np.random.default_rng(5)
    for n in (0, 1, 40, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, "u8"))
        for changed in (0, 1, n // 9, n // 2):
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, min(n, changed), "u8")]))
            apart = int(np.bitwise_count(simhash.sketch(a) ^ simhash.sketch(b)).sum())
            assert apart <= len(np.setxor1d(a, b))
    texts = families()
    known = {i: simhash.shingle_set(x) for i, x in enumerate(texts)}
    pairs = [(i, j) for i in known for j in range(i)]
    common = {(i, j): len(np.intersect1d(known[i], known[j])) for i, j in pairs}
    links = {(i, j) for (i, j), n in common.items() if 5 * n >= 4 * (len(known[i]) + len(known[j]) - n)}
    sets = simhash.sets(spark.createDataFrame(list(enumerate(texts)), "node long, text string"))
    left = {tuple(x) for x in simhash._alike(spark.createDataFrame(pairs, "a long, b long"), sets, len(texts)).collect()}
    assert links and links <= left and len(left) < len(pairs) / 5


def tasks_of(spark, run):
    """How many tasks the stages of a run have, with 64 partitions for a shuffle."""
    context, group, before = spark.sparkContext, f"tasks-{random.random()}", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup(group, "")
    try:
        out = run()
        tracker = context.statusTracker()
        jobs = [tracker.getJobInfo(x) for x in tracker.getJobIdsForGroup(group)]
        stages = [tracker.getStageInfo(x) for x in {x for job in jobs if job for x in job.stageIds}]
        return out, sum(x.numCompletedTasks for x in stages if x)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_components_of_few_edges_take_few_tasks(spark):
    """Each shuffle of a round left small files of all its tasks on disk, however few the edges were."""
    edges = spark.createDataFrame([x for i in range(40) for x in ((i, i + 1), (i + 1, i))], "a long, b long")
    rows, n = tasks_of(spark, lambda: simhash.components(edges.repartition(64)).collect())
    assert {x["root"] for x in rows} == {0} and len(rows) == 41
    assert n < 64 * 8


def test_near_duplicates_query(spark):
    base = " ".join(f"word{i}" for i in range(400))
    df = spark.createDataFrame([(5, base), (3, base), (9, base.upper()), (1, "other text here"), (2, None), (4, "")], SHAPE)
    got = {x["doc_id"]: x for x in simhash.near_duplicates(df).collect()}
    assert [got[i]["component_id"] for i in (5, 3, 9, 1, 2, 4)] == [3, 3, 3, 1, 2, 2]
    assert got[3]["fingerprint"] == f"{brute_fingerprint(base):016x}" and got[2]["fingerprint"] == "0" * 16


# -- 9


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(700, 12)).astype(np.float32)
    vectors[100:200] = vectors[0]  # ties
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    whole = np.floor(vectors.astype(np.float64) * 1024).astype(np.int64)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0).toPandas()
    for q in range(0, 700, 100):
        scores = whole @ whole[q]
        best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert list(zip(own.vec_id, own.score)) == [(i, -s) for s, i in best]


def test_search_stops_early():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.exponential(size=(4000, 3)) ** 3 * 100)
    found = topk.search(np.array([[5.0, 1.0, 0.0]]), np.array([-1]), rows, np.arange(4000), np.ones(4000, int), 5)
    assert found[3][0] < 1
    assert found[2] == sorted((rows @ [5, 1, 0]).astype(int).tolist(), reverse=True)[:5]


def test_huge_components_stay_exact(spark):
    rows = np.array([[2.0**40, 1.0], [2.0**40, 0.0]])
    assert topk.search(rows[:1], np.array([-1]), rows, np.array([0, 1]), np.array([1, 1]), 2)[2] == [2**80 + 1, 2**80]
    df = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id long, embedding array<double>")
    found = [(x["vec_id"], x["score"]) for x in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert found == [(1, 2**63 - 1), (2, -(2**63))]


def test_rows_are_told_apart_by_themselves(spark):
    """Repeated and missing ids against brute force over rows."""
    rng = np.random.default_rng(5)
    ids = [0, 0, 0, 100, None, None, 3, 3, 4] + list(range(200, 230))
    vectors = rng.integers(-3, 4, size=(len(ids), 4)) / 4
    vectors[1], vectors[7], vectors[5] = vectors[0], vectors[6], vectors[4]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")
    whole = np.floor(vectors * 1024).astype(int)
    want = []
    for q, i in enumerate(ids):
        if i is not None and i % 100 == 0:
            order = sorted((-int(whole[r] @ whole[q]), ids[r] is None, ids[r] or 0) for r in range(len(ids)) if r != q)
            want += [(i, n + 1, None if gone else r, -s) for n, (s, gone, r) in enumerate(order[:10])]
    found = [tuple(x) for x in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))


# -- 10

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def fits(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(x) <= 255 for x in match.split("."))
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if fits(k, m[0])]


def brute_own_spans(text):
    """The method's own kinds, character by character."""
    size = {c: n for n, names in pii.IBAN_LENGTHS.items() for c in names.split()}
    plain, found, at = lambda c: c.isascii() and c.isalnum(), [], 0
    while at < len(text):
        head, stop = text[at : at + 4], at + 4
        if re.fullmatch("[A-Z]{2}[0-9]{2}", head) and head[:2] in size and not (at and plain(text[at - 1])):
            chars = head
            while len(chars) < size[head[:2]]:
                stop += text[stop : stop + 1] == " "
                if not re.fullmatch("[A-Z0-9]", text[stop : stop + 1]):
                    break
                chars, stop = chars + text[stop], stop + 1
            if len(chars) == size[head[:2]] and not plain(text[stop : stop + 1]):
                if int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1:
                    found.append(f"iban:{at}:{stop}")
                at = stop
                continue
        at += 1
    for m in re.finditer(r"(?<![0-9-])(\d{3})-(\d{2})-(\d{4})(?![0-9-])", text, re.ASCII):
        before = re.split(r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9-])", text[: m.start()], flags=re.ASCII)[-1][-40:]
        if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000" and re.search(r"(?i)\bssn", before):
            found.append(f"ssn:{m.start()}:{m.end()}")
    return found


def test_spans_against_brute_force(spark):
    random.seed(5)
    parts = ["a", "@", "b.c", ".", "1", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "-", "+", "+1 (555) 555-1234", "é", "😀", "x@y.z", "1.2.3.4", "0001.2.3.4", "_", "\n", "DE89 3704 0044 0532 0130 00", "BE68 5390 0754 7034", "BE68539007547034", " CALL", "ssn ", "123-45-6789", "000-12-3456"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(1500)]
    texts += ["1." * 900, "x@y.z " * 400, "+1" + " " * 3000, "a@" + "b." * 3000 + "c", "12" * 3000]
    found = pii.digest(spark.createDataFrame(list(enumerate(texts)), SHAPE)).collect()
    for row in found:
        spans = brute_spans(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        own = row["spans"].split(",") if row["spans"] else []
        assert own == spans + brute_own_spans(texts[row["doc_id"]])


def test_work_grows_with_the_spans(spark):
    took = []
    for n in (60_000, 120_000):
        text = "1.2.3.4 " * n
        df = spark.createDataFrame([(1, text)], SHAPE)
        began = time.perf_counter()
        assert pii.digest(df).first()["n_ip"] == n
        assert pii.redact(df).first()["text"] == "<IP> " * n
        took.append(time.perf_counter() - began)
    assert took[1] < 3 * took[0] + 2


def test_checksums_context_and_redaction(spark):
    texts = [
        "Konto DE89 3704 0044 0532 0130 00.", "DE88 3704 0044 0532 0130 00", "mail me: a@b.cd or +1 (555) 555-1234!",
        "BE68 5390 0754 7034 CALL NOW", "ssn: 123-45-6789, part 123-45-6789",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), SHAPE)
    rows = {x["id"]: x["spans"] for x in pii.scan(df).collect()}
    assert [(x["kind"], x["start"], x["stop"], x["score"]) for x in rows[0]] == [("iban", 6, 33, 1.0)]
    assert rows[1] == [] and [x["score"] for x in rows[2]] == [1.0, 0.5]
    redacted = {x["doc_id"]: x["text"] for x in pii.redact(df).collect()}
    assert [(x["kind"], x["stop"]) for x in rows[3]] == [("iban", 19)] and [(x["start"], x["score"]) for x in rows[4]] == [(5, 0.7)]
    assert redacted[4] == "ssn: <SSN>, part 123-45-6789" and redacted[0] == "Konto <IBAN>." and redacted[2] == "mail me: <EMAIL> or <PHONE>!" and redacted[1] == texts[1]
