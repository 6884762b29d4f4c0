import random
import zlib

import numpy as np

from tidewell.llm import language_id, quality

LETTERS = {"aa": "abcde fg", "bb": "vwxyz uéè"}


def text(rng, lang, size=200):
    return "".join(rng.choice(LETTERS[lang]) for _ in range(size))


def language_rows(n=160):
    rng = random.Random(2)
    return [(i, text(rng, lang), lang, "s", 1) for i in range(n) for lang in [rng.choice(["aa", "bb"])]]


LANG_SCHEMA = "doc_id long, text string, lang string, score string, has int"


def test_gradients():
    model = language_id.ByteGRU.start(["a", "b", "c"], 4)
    model = language_id.ByteGRU(model.languages, *[w.astype(np.float64) for w in model.weights()])
    rng = np.random.default_rng(1)
    x, valid, labels = rng.integers(0, 256, (5, 9)).astype(np.uint8), rng.random((5, 9)) < 0.8, np.array([0, 1, 2, 1, 0])
    _, gradients = model.loss_and_gradients(x, valid, labels)
    for k, (w, g) in enumerate(zip(model.weights(), gradients)):
        for _ in range(8):
            i = tuple(int(rng.integers(0, s)) for s in w.shape)
            if k == 0:
                i = (*i[:2], int(x[rng.integers(5), rng.integers(9)]))
            old, losses = w[i], []
            for step in (1e-5, -1e-5):
                w[i] = old + step
                losses.append(model.loss_and_gradients(x, valid, labels)[0])
            w[i] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - g[i]) < 1e-6


def test_every_position_is_labelled_and_pooled():
    rng = random.Random(7)
    words = {"aa": "the cat sat on a mat of this house".split(), "bb": "le chat noir est dans la maison été".split()}
    sample = [(" ".join(rng.choice(words[lang]) for _ in range(60)).encode(), lang) for lang in ("aa", "bb") * 40]
    model = language_id.train([t for t, _ in sample], [lang for _, lang in sample], steps=60)
    mixed = [rng.choice(words["aa" if rng.random() < 0.6 else "bb"]) for _ in range(1500)]
    texts = [" ".join(mixed).encode(), b"", b"xy", " ".join(mixed[:90]).encode(), " ".join(rng.choice(words["bb"]) for _ in range(300)).encode()]
    whole = model.documents(texts)
    assert np.allclose(whole[1], 0) and len(texts[3]) <= language_id.WINDOW < len(texts[4])
    for text, share, near in zip(texts, whole, (2e-2, 1, 1e-6, 1e-6, 2e-2)):
        if text:  # as in one uncut run, nearly so where it is cut
            uncut = model.positions(np.frombuffer(text, np.uint8)[None])[:, :, 0].mean(axis=1)
            assert np.allclose(share.sum(), 1) and np.abs(share - uncut).max() < near
    assert np.allclose(model.documents(texts[::-1]), whole[::-1], atol=1e-6)


def test_training_draws_from_whole_texts():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(300)) + " " + " ".join(rng.choice(end) for _ in range(300)) for end in ("xy", "vw") * 30]
    model = language_id.train([t.encode() for t in texts], ["x", "v"] * 30, steps=80)
    tails = model.documents([t[-300:].encode() for t in texts])  # the languages differ in the second half alone
    assert np.mean(tails.argmax(axis=1) == np.array([1, 0] * 30)) > 0.95


def test_language_held_out_accuracy(spark):
    rows = language_rows()
    odd = [(1000, None, "aa", "", 0), (1001, "", "bb", "", 0), (1002, "12 !?", None, "", 0), (1003, "abc " * 30_000, None, "", 0), (None, "abcde", "aa", "", 0), (1004, "vwx", "bb", "", 0), (1004, "vwx", "bb", "", 0)]
    got = [tuple(r) for r in language_id.identify(spark.createDataFrame(rows + odd, LANG_SCHEMA)).collect()]
    assert len(got) == len(rows) + len(odd)
    by_id = {r[0]: r for r in got}
    tested = [(by_id[i][2], lang) for i, _, lang, _, _ in rows if by_id[i][1]]
    assert len(tested) > 20 and np.mean([a == b for a, b in tested]) > 0.95
    assert all(by_id[i][1] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert all(by_id[i][2:] == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by_id[1003][2] == "aa" and None in by_id and all(0 <= r[3] <= 1 for r in got)


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None, "", 0)], LANG_SCHEMA)
    assert [tuple(r)[2:] for r in language_id.identify(df).collect()] == [("und", 0.0)]
    assert language_id.identify(df.limit(0)).collect() == []


QUALITY_SCHEMA = "doc_id long, text string, score double, ids string"


def quality_rows(n=300):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(10, 60))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), 0.0, "x"))
        labels.append((i, int(good), 9))
    return rows, labels


def test_quality_held_out_accuracy(spark):
    rows, labels = quality_rows()
    odd = [(900, None, 0.0, ""), (901, "", 0.0, ""), (902, "AB!! " * 30_000, 0.0, ""), (None, "abc def", 0.0, ""), (903, "abc", 0.0, ""), (903, "abc", 0.0, "")]
    marks = spark.createDataFrame([*labels, (5, 1 - labels[5][1], 0), (7, None, 0), (None, 1, 0), (8, 3, 0)], "doc_id long, quality int, text int")
    got = [tuple(r) for r in quality.score(spark.createDataFrame(rows + odd, QUALITY_SCHEMA), marks).collect()]
    assert len(got) == len(rows) + len(odd) and all(0 <= r[2] <= 1 and r[3] == (r[2] >= 0.3) for r in got)
    by_id = {r[0]: r for r in got}
    tested = [(by_id[i][3], y) for i, y, _ in labels if by_id[i][1]]
    assert len(tested) > 30 and np.mean([a == b for a, b in tested]) > 0.97
    assert by_id[902][3] == 0 and by_id[900][2] == by_id[901][2]


def test_quality_of_nothing(spark):
    df = spark.createDataFrame([(1, "abc", 0.0, "")], QUALITY_SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(r)[2:] for r in quality.score(df, none).collect()] == [(0.5, 1)]
    assert quality.score(df.limit(0), none).collect() == []


def test_log_count_ratios_by_hand():
    rows = [np.array([0, 1]), np.array([0]), np.array([2])]
    r = quality.log_count_ratios(rows, np.array([1, 1, 0]))
    p, q = np.ones(quality.SLOTS), np.ones(quality.SLOTS)
    p[[0, 1]] += [2, 1]
    q[2] += 1
    assert np.allclose(r, np.log((p / p.sum()) / (q / q.sum())))


def test_dual_coordinate_descent_meets_the_optimum():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((40, 3)), np.sign(rng.standard_normal(40))
    ids = [np.arange(3)] * 40
    w = quality.dual_coordinate_descent(ids, list(x), y, np.full(40, 0.5), 3, epochs=500)

    def loss(v):
        return 0.5 * v @ v + 0.5 * (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()

    assert all(loss(w) <= loss(w + d) + 1e-6 for d in 0.01 * rng.standard_normal((200, 3)))


def test_repeats():
    f = quality.Features()
    base = quality.BYTE_SLOTS + quality.CLASS_SLOTS
    assert [i - base for i in f.of(b"a a a b") if i >= base and i < base + 16] == [1, 2]
    assert not [i for i in f.of(b"a b c d e f") if base <= i < base + 16]


def test_plain_hinge_reaches_its_optimum():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 4))
    y = np.where(x @ np.array([1.0, -2.0, 0.5, 0.0]) + 0.5 * rng.standard_normal(60) > 0, 1.0, -1.0)
    rows, values, cost = [np.arange(4)] * 60, list(x), np.full(60, 0.7)
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w = quality.dual_coordinate_descent(rows, values, y, cost, 4, epochs=3000, squared=False)
    assert all(loss(w) <= loss(w + d) + 1e-3 for d in 0.05 * rng.standard_normal((200, 4)))
    best, v = loss(w), np.zeros(4)
    for step in range(1, 20_000):  # subgradient descent ends near the same loss
        v -= (v - x.T @ (cost * y * (y * (x @ v) < 1))) / (step + 10)
    assert abs(best - loss(v)) < 0.02 * best


def test_quality_sample_is_bounded_and_ordered(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i % 60, "".join(rng.choice("ab c") for _ in range(rng.randrange(30)))) for i in range(180)] + [(None, "x"), (61, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)] + [(None, 1), (3, 0)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 250)
    taken = []
    monkeypatch.setattr(quality, "train", lambda rows, labels: taken.append(([r.tolist() for r in rows], labels.tolist())))
    quality.fit(df, labels)
    quality.fit(df.repartition(6), labels.repartition(3))
    assert taken[0] == taken[1] and 0 < len(taken[0][1]) <= 20
    sizes = {}
    for i, t in rows:
        if i is not None:
            sizes[i] = max(sizes.get(i, 0), len(t or ""))
    assert len(taken[0][1]) < sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in sizes)
