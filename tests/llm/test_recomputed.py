"""Learned scores and the whole pipeline against plain re-computations."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zlib

from shelfmark.llm import bpe, dartminhash, hmm, mixing, secretscan, toxicity
from shelfmark.llm.common import new_path


def test_toxicity_is_what_counts_and_the_curve_make_it(spark):
    rng = random.Random(7)
    plain = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me", "no", "pa", "ri") for b in ("lan", "tor", "ves", "mun", "gol", "sip", "kad", "fer")]
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(plain, k=rng.randint(8, 30))
        toxic = i % 3 == 0
        if toxic:
            words[2], words[5] = rng.choice(["zorgle", "Z0RGLE", "zorglest"]), "bluxnit"
        elif i % 5 == 0:
            words[3:5] = ["mild", "bluxnit"]  # an exception: harmless behind this word
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.trained(docs, marks)
    scores = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in toxicity.scored(docs, lexicon).collect()}

    learned = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    fold = lambda t: t.lower().replace("0", "o").split()
    has = lambda words: {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in (4, 5, 6) if len(w) > n}
    k1, k0 = Counter(), Counter()
    for i, text, _ in rows:
        if i in learned:
            (k1 if i % 3 == 0 else k0).update(has(set(fold(text))))
    n1, n0 = sum(i % 3 == 0 for i in learned), sum(i % 3 != 0 for i in learned)
    candidates = [f for f, n in k1.items() if n >= 3]
    ll = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n - k else 0)
    weights = {}
    for f in candidates:
        w = math.log((k1[f] + 0.5) / (n1 + 1)) - math.log((k0[f] + 0.5) / (n0 + 1))
        p = (k1[f] + k0[f]) / (n1 + n0)
        sure = 2 * (ll(k1[f], n1, k1[f] / n1) + ll(k0[f], n0, k0[f] / n0) - ll(k1[f], n1, p) - ll(k0[f], n0, p))
        if w >= 1 and sure >= 2 * math.log(max(2, len(candidates))) + 4:
            weights[f] = w
    assert lexicon.weights == pytest.approx(weights) and " zorg" in weights and " bluxni" in weights
    assert " mild bluxnit " in lexicon.exceptions

    def total(words):
        out = 0.0
        for k, w in enumerate(words):
            near = {f" {words[k - 1]} {w} "} if k else set()
            near |= {f" {w} {words[k + 1]} "} if k + 1 < len(words) else set()
            if not near & set(lexicon.exceptions):
                out += max([0.0, *(weights.get(f, 0.0) for f in has({w}))])
        return out

    bias, per_sum, per_density = lexicon.curve
    gradient = np.zeros(3)
    for i, text, _ in rows:
        words = fold(text)
        a, b = math.log1p(total(words)), math.log1p(1000 * total(words) / len(words))
        z = bias + per_sum * a + per_density * b
        p = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert scores[i][1] == pytest.approx(p, abs=1e-9) and scores[i][0] == (i not in learned) and scores[i][2] == int(p >= 0.3)
        if i in learned:
            gradient += ((i % 3 == 0) - p) * np.array([1, a, b])
    assert np.abs(gradient - 1e-2 * np.array(lexicon.curve)).max() < 1e-3  # the curve is the most likely one
    assert all(s[2] == int(i % 3 == 0) for i, s in scores.items())


def test_hidden_markov_scores_end_to_end(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["The", "THE", "été"]
    texts = [" ".join(rng.choices(words[k % 5 : k % 5 + 8], k=rng.randint(1, 25))) for k in range(30)] + ["", None, " \t", " ".join(rng.choices(words, k=600)), "unseen words here", "w1 w1 w1"]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(5, texts[5], 1.0)], "doc_id long, text string, score double")
    found = defaultdict(list)
    for r in hmm.scored(docs, rounds=2).collect():
        found[r["doc_id"]].append(r)

    split = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 1}
    training = [split(t) for i, t in [*enumerate(texts), (5, texts[5])] if i not in held]
    counts = Counter(w for t in training for w in t)
    ends, n = len(training), sum(counts.values()) + len(training)
    distinct = len(counts) + 1
    order = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    symbol = {w: k for k, w in enumerate(order)}
    class_of = lambda w: zlib.crc32(w.encode()[-2:]) % hmm.TAIL
    END = hmm.HEAD + hmm.TAIL
    coded = lambda t: [*(symbol.get(w, hmm.HEAD + class_of(w)) for w in t), END]
    every = np.zeros(END + 1)
    every[[symbol[w] for w in order]] = [counts[w] for w in order]
    every[END] = ends
    chain = hmm.Chain.first(every)
    start, resume, move, emit = chain.start, chain.resume, chain.move, chain.emit
    share = (every + 0.5) / (every + 0.5).sum()
    for _ in range(2):  # Baum-Welch, a window at a time
        new = [np.zeros_like(start), np.zeros_like(resume), np.zeros_like(move), np.zeros_like(emit)]
        for t in training:
            seq = coded(t)
            for at in range(0, len(seq), hmm.WINDOW):
                part = seq[at : at + hmm.WINDOW]
                alpha, beta = [], [np.ones(len(start))]
                for k, x in enumerate(part):
                    a = ((resume if at else start) if k == 0 else alpha[-1] @ move) * emit[x]
                    alpha.append(a / a.sum())
                for x in reversed(part[1:]):
                    b = move @ (emit[x] * beta[0])
                    beta.insert(0, b / b.sum())
                for k, x in enumerate(part):
                    g = alpha[k] * beta[k]
                    g /= g.sum()
                    new[3][x] += g
                    if k == 0:
                        new[1 if at else 0] += g
                    else:
                        xi = alpha[k - 1][:, None] * move * (emit[x] * beta[k])[None]
                        new[2] += xi / xi.sum()
        start, resume, move, emit = new[0] + 0.1, new[1] + 0.1, new[2] + 0.1, new[3] + hmm.PRIOR * share[:, None]
        start, resume, move, emit = start / start.sum(), resume / resume.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
    for i, t in enumerate(texts):
        own = split(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (distinct + 1))) for w in own) + math.log10((ends + 0.5) / (n + 0.5 * (distinct + 1)))
        a, score = None, 0.0
        for w, x in zip([*own, None], coded(own), strict=True):
            a = (start if a is None else a @ move) * emit[x]
            score += math.log10(a.sum())
            a = a / a.sum()
            if w is not None and w not in symbol:  # an unseen word: its share of an empty class
                score += math.log10(0.5) - math.log10(0.5)
        for r in found[i]:
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(own) + 1, sum(w in counts for w in own) + 1, n)
            assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["score"] == pytest.approx(score, abs=1e-6)
    assert len(found[5]) == 2


def test_pipeline_stage_by_stage(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = spark.read.parquet(f"{tiny}/labels.parquet")
    predicted = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, toxicity.trained(docs, marks)).collect()}
    held = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, held, tiny).write.parquet(path)
        before, held = held, spark.read.parquet(path)
        kept[name] = held.collect()
        ids = [r["doc_id"] for r in kept[name]]
        if name == "toxicity":
            assert sorted(ids) == sorted(i for i, p in predicted.items() if not p)
        elif name == "minhash_near_dedup":
            shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((r["doc_id"], (r["text"] or "").lower().split()) for r in before.collect())}
            gone = set(shingles) - set(ids)
            assert len(ids) == len(set(ids)) and gone  # who goes has a near copy of smaller id; two that stay are no near copies
            near = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
            assert all(any(near(i, j) for j in shingles if j != i) for i in gone)
            assert not [(i, j) for i in ids for j in ids if i < j and len(shingles[i]) > 1 and near(i, j)]
        elif name == "secret_scan":
            base = re.compile(r"AKIA[A-Z0-9]{16,}")
            assert sorted(ids) == sorted(r["doc_id"] for r in before.collect()) and not [r for r in kept[name] if base.search(r["text"] or "")]
        elif name == "source_mixing":
            taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mixed(before).collect() if r["size"]}
            assert Counter(ids) == Counter({i: n for i, n in taken.items() if n}) and max(taken.values()) <= 3
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(bpe.word_bpe_path())
            wanted = Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in before.collect())
            assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in kept[name]) == wanted
    digest = lambda rows: Counter((r["doc_id"], hashlib.md5(bytes(r["ids"])).hexdigest()) for r in rows)
    assert digest(corpus_pipeline.run(spark, tiny).collect()) == digest(kept["bpe_encoding"])
    assert set(texts) >= {r["doc_id"] for r in kept["bpe_encoding"]} and dartminhash and secretscan


def test_very_long_texts_and_clashing_columns(spark):
    long = ("the quick fox jumps over a lazy dog " * 12_000) + "password = hunter2222 " + "z " * 50_000
    docs = spark.createDataFrame([(1, long, "a", "b"), (2, long, "c", "d"), (3, "short", None, None)], "doc_id long, text string, ids string, words string")
    rows = {r["doc_id"]: r for r in secretscan.scanned(docs, secretscan.trained(docs)).collect()}
    assert rows[1]["n_assign"] == 1 and rows[1]["spans"] == rows[2]["spans"] and rows[3]["n_assign"] == 0
    classes = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 3}
    scores = {r["doc_id"]: r["n_tokens"] for r in hmm.scored(docs, rounds=1).collect()}
    assert scores[1] == len(long.split()) + 1
    assert {r["doc_id"]: len(r["ids"]) for r in bpe.encoded(docs, bpe.word_bpe_path()).collect()}[3] == 4
