"""The pipeline against a plain version of all its stages."""

import hashlib
import re
from collections import Counter

import numpy as np
import tiktoken
from public_tokenizers import PATTERN
from test_operators import brute_own_spans, brute_shape, brute_spans, roots_of

import corpus_pipeline
from twinsift.llm import bpe, langid


def redacted(text):
    marks = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in brute_spans(text) + brute_own_spans(text)))
    out, at = [], 0
    for start, stop, kind in marks:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def mixed(rows):
    """(id, text, repeats) by a full sort of each source."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, list(sources), float(sum(total.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 3 * total[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= target[s]
            free.remove(s)
    target |= {s: weight[s] * level for s in free}
    out = []
    for s in sources:
        times = min(3, int(target[s] // total[s])) if total[s] else 0
        budget = target[s] - times * total[s] if times < 3 else 0
        key = lambda r: hashlib.md5(f"{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()[:15]
        before = 0
        for row in sorted((r for r in rows if r[2] == s), key=key):
            n = size[row[0]]
            more = before + n <= budget or (before <= budget and 2 * (budget - before) >= n)
            before += n
            out.append((row[0], row[1], times + more if n else 0))
    return out


def test_pipeline_equals_the_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(x["doc_id"], x["text"], x["source"]) for x in docs.collect()]
    model = langid.train(docs, langid.usable_rows())
    rejected = model.predict([t for _, t, _ in rows])[2]
    rows = [r for r, gone in zip(rows, rejected) if not gone]

    root = roots_of({i: brute_shape(t) for i, t, _ in rows})
    rows = [(i, redacted(t), s) for i, t, s in rows if root[i] == i]

    encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(corpus_pipeline.RANKS), special_tokens={})
    want = Counter()
    for i, text, repeats in mixed(rows):
        packed = np.array(encoder.encode_ordinary(text), "<u4").tobytes()
        if repeats:
            want[i, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += repeats
    got = Counter((x["doc_id"], x["ids_sha256"], x["decoded_sha256"]) for x in corpus_pipeline.run(spark, small).collect())
    assert got == want


def test_stages_keep_columns_and_edges(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the cat sat on the mat", "en", "a", 22), (1, "the cat sat on the mat", "en", "a", 22), (None, "un chat", "fr", None, 7), (2, None, None, "b", None), (3, "", "en", "b", 0)]
    for docs in (spark.createDataFrame(rows, shape), spark.createDataFrame([], shape)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, docs, "")
            if name != "bpe":
                assert kept.columns == docs.columns
                docs = corpus_pipeline.simhash.checkpointed(kept)
            assert kept.count() <= 3 * n
            if name == "near_dedup" and n:
                assert sorted(str(x["doc_id"]) for x in docs.collect()) == ["1", "None"]


def test_near_dedup_keeps_a_row_of_each_component(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, word(k), "en", "a", k) for k in range(20)]  # components without an id
    rows += [(7, word(k), "en", "a", k) for k in range(20, 40)]  # one id over different texts
    rows += [(3, word(50), "en", "a", 1), (5, word(50), "en", "a", 2), (5, word(51), "en", "b", 3)]  # 5 is a copy of 3, and alone
    rows += [(9, word(60), "en", "a", 4)] * 3 + [(9, word(60), "fr", "b", 4), (None, word(60), "en", "a", 4)]  # equal, nearly equal
    found = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, shape).repartition(5), "")
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = Counter((x["doc_id"], x["text"]) for x in found.collect())
    assert kept == Counter([x[:2] for x in rows[:40]] + [(3, word(50)), (5, word(51)), (9, word(60))])
