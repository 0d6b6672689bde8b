"""Quality and toxicity scores against plain versions: features by regular expressions, models by dictionaries of counts."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_text import text_of
from test_models import noisy

from tabspark.llm import quality, toxicity
from tabspark.llm.words import blocks

UPPER, LETTER, DIGIT = rb"[A-Z]", rb"[A-Za-z\x80-\xff]", rb"[0-9]"
MARK, STOP, OTHER = rb"[!\"'(),\-.:;?]", rb"[!.?]", rb"[^A-Za-z\x80-\xff0-9!\"'(),\-.:;?\x09-\x0d ]"


def plain_features(text):
    raw = (text or "").encode()
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", raw), re.findall(rb"[^\n]+", raw)
    count = lambda kind, x: len(re.findall(kind, x))
    n, size, n_lines = max(len(words), 1), max(len(raw), 1), max(len(lines), 1)
    shout = lambda w: count(UPPER, w) >= 2 and count(UPPER, w) == count(LETTER, w)
    odd = lambda w: count(OTHER, w) > 0
    low = [w.lower() for w in words]
    again = sum(w in low[:i] for i, w in enumerate(low))
    pairs = list(zip(low, low[1:]))
    pair_again = sum(p in pairs[:i] for i, p in enumerate(pairs))
    worst = {k: 0.0 for k in "ous"}
    same = sum(a == b for a, b in pairs)
    last = None
    for line in lines:
        own = re.findall(rb"[^\x20\x09-\x0D]+", line)
        sames = 0
        for w in own:
            sames += w.lower() == last
            last = w.lower()
        for k, m in (("o", sum(map(odd, own))), ("u", sum(map(shout, own))), ("s", sames)):
            worst[k] = max(worst[k], m / max(len(own), 5))
    others, uppers = sum(map(odd, words)), sum(map(shout, words))
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, math.log1p(len(lines)), math.log1p(len(words) / n_lines), count(UPPER, raw) / size, count(DIGIT, raw) / size,
        count(MARK, raw) / size, count(OTHER, raw) / size, count(STOP, raw) / size, uppers / n, others / n, sum(count(MARK, w) >= 2 for w in words) / n,
        again / n, same / n, 1 - math.log1p(n - again) / math.log1p(n), sum(x in lines[:i] for i, x in enumerate(lines)) / n_lines, pair_again / n,
        worst["o"], worst["u"], worst["s"], math.log1p(others), math.log1p(uppers), math.log1p(same),
    ]


def odd_texts():
    rng = random.Random(5)
    parts = ["the", "The", "AB", "ÉA", "x1", "a.b.", "--", "$$", "##x", "\n", "\n\n", "\t", "Wow!", "naïve", "(ok)", "the the", "it's", "9", "\x00", "A1B"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", " ", "\n", "word", text_of(1, 300)]


def test_quality_features_equal_regular_expressions():
    texts = odd_texts()
    got = np.concatenate([quality.features(b) for b in blocks(pa.array(texts, pa.string()), 200)])
    want = np.array([plain_features(t) for t in texts])
    for k, name in enumerate(quality.FEATURES):
        assert got[:, k] == pytest.approx(want[:, k], abs=1e-12), name


def test_quality_scores_equal_a_plain_scorer(rows):
    docs = [(k, noisy(k)[0]) for k in range(150)] + [(500 + k, t) for k, t in enumerate(odd_texts())]
    labels = rows("doc_id long, quality int", *((k, noisy(k)[1]) for k in range(100)))
    table = quality.feature_table(rows("doc_id long, text string", *docs))
    model = quality.fit(table, labels)
    got = {r.doc_id: r for r in quality.score(table, model).collect()}
    for k, t in docs:
        x = [float(np.float32(v)) for v in plain_features(t)]
        z = (sum(a * b for a, b in zip(x, model.weights)) - model.threshold) * model.scale
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert got[k].score == pytest.approx(want, abs=1e-6) and got[k].predicted == int(got[k].score >= 0.5)
    held = [(got[k].predicted, noisy(k)[1]) for k in range(100, 150)]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


class PlainModels:
    """Dictionaries of counts; runs are tuples of bytes."""

    def __init__(self, top, order, toxic_each, ordinary_each):
        self.order, self.top = order, top  # {run: (toxic, ordinary)}
        tables, longer = {}, set(top)
        for n in range(order - 1, 0, -1):
            kinds = {}
            for run in longer:
                kinds[run[1:]] = kinds.get(run[1:], 0) + 1
            tables[n], longer = kinds, set(kinds)
        self.levels = {n: self.level(t, {}) for n, t in tables.items()}
        self.of = [self.level({r: c[y] for r, c in top.items()}, {}) for y in (0, 1)]
        pooled = {r: t + o for r, (t, o) in top.items()}
        self.shared = self.level(pooled, {r: (t * toxic_each + o * ordinary_each) / (t + o) for r, (t, o) in top.items()})

    @staticmethod
    def level(counts, each):
        of = [max(1, sum(c == k for c in counts.values())) for k in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1])
        raw = [1 - 2 * y * of[1] / of[0], 2 - 3 * y * of[2] / of[1], 3 - 4 * y * of[3] / of[2]]
        d = [min(max(x, 0.1), k - 0.05) for k, x in enumerate(raw, 1)]
        less = lambda c: 0.0 if c == 0 else d[min(c, 3) - 1]
        total, gone = {}, {}
        for run, c in counts.items():
            e = each.get(run, 1.0)
            total[run[:-1]] = total.get(run[:-1], 0.0) + c * e
            gone[run[:-1]] = gone.get(run[:-1], 0.0) + less(c) * e
        return counts, each, total, gone, less

    @staticmethod
    def step(level, run, lower):
        counts, each, total, gone, less = level
        all_, c = total.get(run[:-1], 0.0), counts.get(run, 0)
        if all_ <= 0:
            return lower
        return (c - less(c)) * each.get(run, 1.0) / max(all_, 1) + gone[run[:-1]] / max(all_, 1) * lower

    def ratio(self, run):
        p = 1 / 256
        for n in range(1, self.order):
            p = self.step(self.levels[n], run[-n:], p)
        shared = self.step(self.shared, run, p)
        out = []
        for counts, _, total, gone, less in self.of:
            all_, c = total.get(run[:-1], 0.0), counts.get(run, 0)
            out.append((c - less(c) + (gone.get(run[:-1], 0.0) if all_ > 0 else 0.0) * shared + toxicity.STRENGTH * shared) / (all_ + toxicity.STRENGTH))
        return math.log(out[0] / out[1])

    def evidence(self, text):
        words = plain_words(text)
        total = [math.log(1 - toxicity.RATE + toxicity.RATE * math.exp(min(sum(self.ratio(r) for r in plain_runs(w, self.order)), 50))) for w in words]
        return sum(total) / max(len(words), 1), len(words)


def plain_words(text):
    raw = (text or "").encode()
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw))


def plain_runs(word, order):
    line = [32] * (order - 1) + list(word) + [32]
    return [tuple(line[k : k + order]) for k in range(len(word) + 1)]


def test_toxicity_scores_equal_a_plain_scorer(spark, rows):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    bad = ["zorgul", "vexnar", "plitch", "grumoz", "dratlek"]
    docs = []
    for k in range(160):
        w = text_of(k, rng.randint(3, 30)).split()
        if k % 3 == 0:
            w.insert(rng.randint(0, len(w)), rng.choice(bad) + rng.choice(["", "s", "er"]))
        docs.append((k, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "!?"), (903, "ÜBER Zorgul naïve")]
    labels = rows("doc_id long, toxic int", *((k, int(k % 3 == 0)) for k in range(160)))
    table = rows("doc_id long, text string", *docs)
    model = toxicity.fit(table, labels)
    uniform = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    learnt = {r.doc_id for r in labels.where(uniform >= toxicity.CALIBRATION).collect()}
    order, top = len(model.models.levels), {}
    for k, t in docs:
        if k in learnt:
            for w in plain_words(t):
                for run in plain_runs(w, order):
                    have = top.get(run, (0, 0))
                    top[run] = (have[0] + (k % 3 == 0), have[1] + (k % 3 != 0))
    plain = PlainModels(top, order, 1.0, 1.0)
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    by_mean, by_total, by_length, constant = model.curve
    for k, t in docs:
        mean, n = plain.evidence(t)
        assert got[k].evidence == pytest.approx(mean, abs=1e-9)
        z = mean * by_mean + math.copysign(math.log1p(abs(mean) * n), mean) * by_total + math.log1p(n) * by_length + constant
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs=1e-9)
    assert sum(got[k].predicted == (k % 3 == 0) for k in range(160)) >= 150
