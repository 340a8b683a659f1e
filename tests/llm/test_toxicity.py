import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import bigru
from foliant.llm import toxicity as toxicity_module
from foliant.llm.toxicity import toxicity

BAD = ["grobian", "fiesling", "grobianx", "ekelhaft"]


@pytest.fixture(scope="module")
def corpus(prose):
    rng = random.Random(8)
    rows = []
    for i in range(500):
        w, toxic = prose(rng.randrange(5, 160), i).split(), i % 5 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy(spark, table, corpus, prose):
    odd = [(1001, None), (1002, ""), (1003, prose(30_000, 1)), (1004, prose(30_000, 1) + " grobian fiesling " + prose(50, 2)), (None, "null id"), (7, corpus[7][1])]
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus] + [(None, 1), (3, None)], "doc_id bigint, toxic int").selectExpr("*", "1 AS text")
    found = toxicity(table([r[:2] for r in corpus] + odd), labels).collect()
    truth = {i: y for i, _, y in corpus}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    by = {r.doc_id: r for r in found}
    assert by[1001].predicted == by[1002].predicted == by[1003].predicted == 0 and by[1004].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found) and len(found) == len(corpus) + len(odd)
    assert not by[None].held_out


def test_without_labels_of_both_classes(spark, table):
    labels = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity(table([(1, "a"), (2, None)]), labels).collect()] == [0, 0]
    assert toxicity(table([]), labels.where("false")).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = bigru.Network.new(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = bigru.inputs(pa.array(["alpha beta gamma delta beta", "gamma alpha", "delta epsilon zeta eta"]))
    _, begin, size = x.windows()
    grid, mask = x.grid(begin, size)
    distinct, inverse = np.unique(grid, return_inverse=True)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.logits(net.word_vectors(x, distinct), inverse.reshape(grid.shape), mask, train=True)
        return float(np.sum(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))), z

    _, z = loss()
    g = net.gradients(bigru.sigmoid(z) - y, x.bucket[distinct])
    for k, v in net.p.items():
        places = np.argwhere(np.abs(g[k]) > 1e-5)
        for at in places[rng.permutation(len(places))[:4]]:
            at = tuple(at)
            old = v[at]
            v[at] = old + 1e-3
            up, _ = loss()
            v[at] = old - 1e-3
            down, _ = loss()
            v[at] = old
            assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), k


def test_windows_overlap_and_cover():
    for n in (0, 1, 47, 48, 49, 84, 85, 500):
        x = bigru.inputs(pa.array([" ".join(f"w{i}" for i in range(n))]))
        _, begin, size = x.windows()
        assert {p for b, s in zip(begin, size, strict=True) for p in range(b, b + s)} == set(range(n))
        assert all(b < a + s for a, b, s in zip(begin, begin[1:], size, strict=False))


def naive_logit(net, words):
    """Of one window, by loops over words, gates and states."""
    vectors = []
    for w in words:
        x = bigru.inputs(pa.array([w]))
        vectors.append(net.p["words"][x.bucket[0]] + np.mean([net.p["chars"][c] for c in x.char], axis=0))
    sides, n = {}, bigru.HIDDEN
    for d, order in (("f", range(len(words))), ("b", reversed(range(len(words))))):
        h, sides[d] = np.zeros(n), {}
        for t in order:
            into, back = vectors[t] @ net.p[f"in_{d}"] + net.p[f"b_{d}"], h @ net.p[f"u_{d}"]
            z, r = (1 / (1 + np.exp(-(into[k * n : k * n + n] + back[k * n : k * n + n]))) for k in (0, 1))
            h = (1 - z) * np.tanh(into[2 * n :] + r * back[2 * n :]) + z * h
            sides[d][t] = h
    states = [np.concatenate([sides["f"][t], sides["b"][t]]) for t in range(len(words))]
    ask = np.exp([np.tanh(s @ net.p["look"]) @ net.p["ask"] for s in states])
    return sum(a * s for a, s in zip(ask / ask.sum(), states, strict=True)) @ net.p["out"] + net.p["bias"][0]


def test_scores_are_the_worst_of_all_windows_by_hand(prose):
    net = bigru.Network.new(3)
    net.scale, net.shift, net.empty = 1.3, 0.2, 0.3
    texts = [prose(n, n) for n in (1, 5, 48, 49, 130)] + ["", None]
    found = net.scores(pa.array(texts))
    for text, score in zip(texts[:5], found, strict=False):
        w = text.split()
        begins = [*range(0, max(len(w) - bigru.WINDOW, 0), bigru.STRIDE), max(len(w) - bigru.WINDOW, 0)]
        worst = max(naive_logit(net, w[b : b + bigru.WINDOW]) for b in begins)
        assert abs(score - 1 / (1 + np.exp(-(1.3 * worst + 0.2)))) < 1e-4
    assert found[5] == found[6] == 0.3


def test_sample_has_long_texts_and_a_bound(spark, table, prose):
    long = prose(9000, 1)  # more than 32 KB
    docs = table([(i, long if i == 1 else prose(20, i)) for i in range(40)])
    known = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    every = toxicity_module.sample(docs, known, 100, 1 << 20).collect()
    assert len(every) == 40 and long in {r.text for r in every}
    few = toxicity_module.sample(docs, known, 100, 1 << 10).collect()
    assert all(0 < sum(len(r.text) for r in few if r.toxic == c) <= 1 << 10 for c in (0, 1))
    assert toxicity_module.sample(docs, known, 3, 1 << 20).count() == 6


def test_odds_do_not_depend_on_how_many_texts_are_counted_at_once(prose, monkeypatch):
    x = bigru.inputs(pa.array([prose(30, i) for i in range(40)]))
    n_char, label = np.diff(np.r_[x.char_at, len(x.char)]), (np.arange(40) % 3 == 0).astype(float)
    whole = bigru.known_odds(x, n_char, label)
    monkeypatch.setattr(bigru, "AT_ONCE", 7)
    for a, b in zip(whole, bigru.known_odds(x, n_char, label), strict=True):
        assert all(np.array_equal(p, q) for p, q in zip(a, b, strict=True))


def test_half_a_window_lies_whole_in_one_at_every_offset():
    from foliant.llm.bigru import STRIDE, WINDOW, inputs

    for n in (30, 60, 97, 150):
        _, begin, size = inputs(pa.array([" ".join(f"w{i}" for i in range(n))])).windows()
        for at in range(n - STRIDE):
            assert any(b <= at and at + STRIDE + 1 <= b + s for b, s in zip(begin, size, strict=True)), (n, at)
        assert size.max() <= WINDOW
