import collections
import random
import re
import zlib

import numpy as np
import pytest

from tidewell.llm import collocations, toxicity

SCHEMA = "text string, lang string, score double, rank int"


def brute_force(rows, least, top, absorbed):
    """Each language's phrases by plain counting."""
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, 6):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    candidates = {k: n for k, n in counts.items() if n >= least and len(k[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        longer = [n for (other, w), n in candidates.items() if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))]
        if any(100 * n >= absorbed * a for n in longer):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang].append((score, a, " ".join(words), counts[lang, words[:k]], counts[lang, words[k:]], totals[lang]))
    return {
        (lang, i + 1, phrase, a, l, r, n, score)
        for lang, found in out.items()
        for i, (score, a, phrase, l, r, n) in enumerate(sorted(found, key=lambda x: (-x[0], -x[1], x[2].encode()))[:top])
    }


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "été", "x\x00y", "new", "york", "CITY", "Ünder", "a b", "\U0001f600"]
    out = []
    for _ in range(n):
        picked = []
        for _ in range(rng.randrange(0, 25)):
            picked += ["new", "york", "city"] if rng.random() < 0.1 else [rng.choice(words)]
        joined = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ;"]) for w in picked)
        out.append((joined, rng.choice(["en", "fr", None])))
    return out + [(None, "en"), ("", None), (" . ,", "de"), (out[0][0], out[0][1])] + [("same piece here again",  "en")] * 15


@pytest.mark.parametrize("least, top, absorbed", [(5, 2000, 100), (3, 7, 100), (4, 2000, 60), (1, 40, 100)])
def test_collocations_equal_brute_force(spark, least, top, absorbed):
    rows = texts(least)
    df = spark.createDataFrame([(t, lang, 0.5, 1) for t, lang in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in collocations.collocations(df, least, top, absorbed).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_force(rows, least, top, absorbed)


def test_no_documents(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_memory_gives_the_same_result(spark, monkeypatch):
    rows = texts(9)
    for name in ("HELD", "HELD_PAIRS", "REMEMBERED", "MANY_LANGUAGES", "BLOCK_CHARS"):
        monkeypatch.setattr(collocations, name, 2)
    of = spark.createDataFrame([(t, lang, 0.5, 1) for t, lang in rows], SCHEMA)
    batches = collocations.pieces(of).toArrow().to_batches(max_chunksize=7)
    every = np.full(1 << (collocations.FILTER_BITS - 3), 255, np.uint8)
    want = collections.Counter()
    for b in batches:
        for r in b.to_pylist():
            words = r["piece"].split(" ")
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    want[n > 1, r["lang"], " ".join(words[i : i + n])] += r["copies"]
    for longer, run in ((False, collocations.count_words), (True, collocations.count_longer(every, every))):
        got = collections.Counter()
        for b in run(iter(batches)):
            for r in b.to_pylist():
                got[longer, r["lang"], r["gram"]] += r["f"]
        assert got == {k: n for k, n in want.items() if k[0] == longer}
    hashes = collections.Counter()
    for b in collocations.count_pairs(every)(iter(batches)):
        for r in b.to_pylist():
            hashes[r["h"]] += r["f"]
    assert sorted(hashes.values()) == sorted(n for k, n in want.items() if k[2].count(" ") == 1)


def test_filter_holds_every_word(spark):
    words = [("en", f"w{i}é") for i in range(3000)]
    rows = spark.createDataFrame(words, "lang string, gram string")
    bits = collocations.filter_of(rows.select(collocations.gram_hash(rows.lang, rows.gram).alias("h")))
    known = collocations.Known(bits, "en")
    assert all(known[w] for _, w in words) and sum(known[f"no{i}"] > 0 for i in range(3000)) < 5
    assert int(np.unpackbits(bits).sum()) <= 2 * len(words)
    hashes = np.array([known[w] for _, w in words], np.uint64)
    assert collocations.passes(bits, hashes).all() and collocations.passes(bits, hashes + np.uint64(1)).sum() < 5


def test_scores_beyond_64_bits(spark):
    a, l, r, n = 9 * 10**12, 10**13, 3 * 10**13, 8 * 10**15
    row = spark.range(1).select(collocations.score_of(*(collocations.F.lit(x).cast("long") for x in (a, l, r, n))).alias("s")).first()
    assert row["s"] == 1000 * a * n // (l * r)


def kneser_ney(docs, labels, folds, without, shared_docs):
    """Difference of a word's log-likelihoods by dictionaries of beginnings."""

    def words(text):
        return {w[: toxicity.LONGEST_WORD] + "$" for w in re.findall(r"[^\W\d_]+", text.lower())}

    def counts(texts):
        out = collections.Counter()
        for t in texts:
            out.update(w[:k] for w in words(t) for k in range(len(w) + 1))
        return out

    shared, models = counts(shared_docs), []
    for c in (1, 0):
        every = counts(d for d, y in zip(docs, labels) if y == c)
        of = [sum(n == i for n in every.values()) for i in (1, 2, 3, 4)]
        own = counts(d for d, y, f in zip(docs, labels, folds) if y == c and f != without)
        models.append((own, toxicity.discounts(of)))

    def likelihoods(word):
        p = [1.0, 1.0]
        for k in range(1, len(word) + 1):
            g, h = word[:k], word[: k - 1]
            for i, (own, cut) in enumerate(models):
                back = shared[g] / shared[h] if shared[h] else 0
                if not own[h]:
                    p[i] *= back
                    continue
                children = [x for x in own if len(x) == k and x[: k - 1] == h]
                kept = sum(max(own[x] - cut[min(own[x], 3)], 0) for x in children)
                p[i] *= max(own[g] - cut[min(own[g], 3)], 0) / own[h] + (1 - kept / own[h]) * back
        return np.log(p[0]) - np.log(p[1])

    return likelihoods, words


def toxic_rows(n=240):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdeéö") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    out = []
    for i in range(n):
        toxic = rng.random() < 0.25
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zonk", "zonker", "Zonks", "grbl"]))
        out.append((i, " ".join(words) + rng.choice([".", "!?", " 12"]), int(toxic)))
    return out


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_learns_and_keeps_folds(spark):
    rows = toxic_rows()
    df = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(900, None, 1.0), (901, "", 1.0), (None, "zonk zonk", 1.0), (0, rows[0][1], 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (5, None, 0), (7, 3, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, labels)
    flipped = spark.createDataFrame([(i, 1 - y if held_out(i) else y, 0) for i, _, y in rows], "doc_id long, toxic int, quality int")
    again = toxicity.fit(df.repartition(7), flipped)
    assert np.array_equal(model.model.ids, again.model.ids) and np.allclose(model.weights, again.weights)
    found = toxicity.score(df, model=model).collect()
    assert len(found) == len(rows) + 4
    by_id = {r["doc_id"]: r for r in found}
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in found if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert by_id[900]["score"] == by_id[901]["score"] and by_id[None]["predicted"] == 1
    unseen = [(by_id[i]["predicted"], y) for i, _, y in rows if held_out(i)]
    assert sum(p == y for p, y in unseen) >= 0.95 * len(unseen)


def test_differences_equal_dictionaries(spark):
    rows = toxic_rows(120)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    fold = {i: f for i, _, f in toxicity.sample_ids(df, labels)}
    train = [(i, t, y) for i, t, y in rows if not held_out(i)]
    assert set(fold) == {i for i, _, _ in train}
    likelihoods, words = kneser_ney([t for _, t, _ in train], [y for _, _, y in train], [fold[i] for i, _, _ in train], None, [t for _, t, _ in train])
    model = toxicity.fit(df, labels).model
    seen = sorted(set().union(*(words(t) for _, t, _ in train)))
    assert np.allclose(model.of(seen), [likelihoods(w) for w in seen], atol=1e-9)
    beyond = ["zonkest$", "q$", "abé$"]  # letters that no document of the corpus has there differ by what the classes hand to the shared counts
    assert model.of(["zonk$"])[0] > 2 > abs(model.of(beyond[1:2])[0]) and np.isfinite(model.of(beyond)).all()


def test_toxicity_without_usable_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(3, 40)], "doc_id long, toxic int")
    more = spark.createDataFrame([(i, "a b") for i in range(3, 40)], "doc_id long, text string")
    assert all(r["score"] > 0.9 for r in toxicity.score(more, one).collect())
    assert toxicity.score(df.limit(0), none).count() == 0


def test_sample_is_bounded_whatever_the_rows(spark, monkeypatch):
    rows = [(i % 50, "word " * (i % 7 + 1), i % 50 % 2) for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 6)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", {1: 100, 0: 60})
    found = toxicity.sample_ids(df, labels)
    assert found == toxicity.sample_ids(df.repartition(3), labels.repartition(2))
    size = {i: max(len(t) for j, t, _ in rows if j == i) for i, _, _ in found}
    for c, room in ((1, 100), (0, 60)):
        own = [i for i, y, _ in found if y == c]
        assert 0 < len(own) <= 6 and sum(size[i] for i in own) <= room
