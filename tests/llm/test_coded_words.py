"""Toxicity: words are coded once, and a gradient step takes its texts together."""

import numpy as np
import pyarrow as pa

from lakefind.llm import toxicity

TEXTS = ["", "one", "two words", "ein Satz, der nicht zu lang ist und der mit dem Wort ist", "^^^^^ ^^^^^^ ^a .^bcd , . ..", "the cat (and) the dog of the house to go in", None, "la casa que los niños y la madre con una flor", "filthy trash filthy trash go away"]


def _coded(texts):
    vocab = toxicity.Vocabulary()
    ids, at = vocab.read(pa.array(texts, pa.string()))
    return vocab, vocab.coded()[ids], at


def test_codes_hold_features_and_languages():
    vocab, codes, at = _coded(TEXTS)
    words = [(t or "").lower().split() for t in TEXTS]
    for w, f in zip([w for own in words for w in own], toxicity.unpacked(codes), strict=True):
        assert [int(x) for x in f if x < toxicity.BUCKETS] == toxicity.features(w)
    assert toxicity.languages(codes, at).tolist() == [toxicity.language(w) for w in words]


def test_words_that_begin_alike_are_hashed_once_each(monkeypatch):
    """Features of every new word took three hashes before, of which two were of its beginning."""
    n = 0

    def counted(x, real=toxicity.xxhash.xxh3_64_intdigest):
        nonlocal n
        n += 1
        return real(x)

    monkeypatch.setattr(toxicity.xxhash, "xxh3_64_intdigest", counted)
    monkeypatch.setattr(toxicity, "hashed", counted, raising=False)
    vocab = toxicity.Vocabulary()
    for k in range(1000):
        vocab[f"begin{k}"]
    assert n <= 1002


def _plain(m, texts, y, weight, rate):
    """The step's gradients, window by window, in double precision."""
    grads = [np.zeros(f.shape) for f in m.filters], [np.zeros(toxicity.FILTERS) for _ in m.filters], np.zeros(len(m.out)), np.zeros(m.embed.shape)
    g_b = 0.0
    for ids, label in zip(texts, y, strict=True):
        e, top, at = m.embed[ids].astype(float).sum(1) if len(ids) else np.zeros((0, toxicity.DIM)), [], []
        for f, b in zip(m.filters, m.bias, strict=True):
            for k in range(toxicity.FILTERS):
                c = [sum(e[i + j] @ f[j][:, k].astype(float) for j in range(len(f))) + b[k] for i in range(len(ids) - len(f) + 1)]
                top.append(max([0.0, *c]))
                at.append(int(np.argmax(c)) if top[-1] > 0 else -1)
        g = (1 / (1 + np.exp(-(np.array(top) @ m.out + m.b))) - label) * weight[label]
        grads[2][:] += g * np.array(top)
        g_b += g
        for n, i in enumerate(at):
            j, k = divmod(n, toxicity.FILTERS)
            for d in range(len(m.filters[j]) if i >= 0 else 0):
                grads[0][j][d][:, k] += g * m.out[n] * e[i + d]
                np.add.at(grads[3], ids[i + d], g * m.out[n] * m.filters[j][d][:, k] * 4)
            grads[1][j][k] += g * m.out[n] * (i >= 0)
    t, d = len(texts), toxicity.DECAY
    embed = m.embed - rate * grads[3] / t
    embed[toxicity.BUCKETS] = 0
    return embed, [f - rate * (g / t + d * f) for f, g in zip(m.filters, grads[0], strict=True)], [b - rate * g / t for b, g in zip(m.bias, grads[1], strict=True)], m.out - rate * (grads[2] / t + d * m.out), m.b - rate * g_b / t


def test_a_step_is_the_gradient_over_all_windows(monkeypatch):
    _, codes, at = _coded(TEXTS)
    y, weight = np.array([0, 1, 0, 0, 1, 0, 1, 0, 1]), np.array([0.6, 3.0], np.float32)
    rows = [toxicity.unpacked(codes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    for windows in (1, 12, 1 << 15):
        monkeypatch.setattr(toxicity, "WINDOWS", windows)
        m = toxicity.Model(3)
        embed, filters, bias, out, b = _plain(m, rows, y, weight, 0.5)
        m.step(codes, at, y, weight, 0.5)
        for got, want in zip([m.embed, *m.filters, *m.bias, m.out, m.b], [embed, *filters, *bias, out, b], strict=True):
            assert np.allclose(got, want, atol=1e-6)


def test_coded_rows_have_no_texts(spark):
    """A pass read and cut the texts again before."""
    rows = spark.createDataFrame([(k, t or "", k % 2) for k, t in enumerate(TEXTS)], "h long, text string, y int")
    got = toxicity.coded(rows)
    assert got.columns == ["h", "y", "w"]
    _, codes, at = _coded(TEXTS)
    assert {r.h: bytes(r.w) for r in got.collect()} == {k: codes[a:b].tobytes() for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))}
