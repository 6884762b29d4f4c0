import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewell.llm import neighbours, packing, pieces, sharding, shared
from tidewell.llm.shared import few_rows

SCHEMA = "doc_id long, text string, slot int, ids string, sig int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "é" * 3000), (5, " \n"), (6, "日本語 \U0001f600 ▁x"), (7, "<|endoftext|> don't İ 12%")]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_and_inverse(n):
    shuffle = sharding.RowShuffle(n, seed=n)
    out = shuffle.forward(np.arange(n))
    assert sorted(out.tolist()) == list(range(n)) and (shuffle.inverse(out) == np.arange(n)).all()
    assert n < 100 or abs(np.corrcoef(out, np.arange(n))[0, 1]) < 0.2
    assert shuffle.row_at(0, 0, 4) == int(np.flatnonzero(out == 0)[0])


def brute_shards(rows, shards, seed):
    """Plain integer arithmetic, row by row."""
    listed = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    shuffle, out = sharding.RowShuffle(len(rows), seed), []
    for number, (key, crc, size) in enumerate(listed):
        x = number
        while True:
            left, right = x >> shuffle.half, x & shuffle.mask
            for a, b, c in shuffle.keys:
                t = (right * a + b) % sharding.PRIME
                left, right = right, left ^ ((((t * t) % sharding.PRIME + (t ^ c)) * 40503 >> 7) & shuffle.mask)
            x = left << shuffle.half | right
            if x < len(rows):
                break
        out.append((key[1] if key[0] else None, size, crc, number, "rows", x % shards, x // shards, None))
    return sorted(out, key=lambda r: r[3])


@pytest.mark.parametrize("rows", [ODD, [(i, f"t{i % 7}") for i in range(500)], []])
def test_shards(spark, rows):
    got = sorted((tuple(r) for r in sharding.shard_rows(frame(spark, rows).repartition(3), 16, 5).collect()), key=lambda r: r[3])
    assert got == brute_shards(rows, 16, 5)
    for s in range(16):
        assert sorted(r[6] for r in got if r[5] == s) == list(range(sum(r[5] == s for r in got)))


VECTORS = "vec_id long, embedding array<float>, label int, vector int, list int, rep int"


def brute_neighbours(rows, k, every):
    clean = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and len(v) == 8}
    out = {}
    for i, v in clean.items():
        if i % every == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in clean.items() if j != i)
            out[i] = near[:k]
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 8))
    rows = [(i, (centres[i % 5] + 0.3 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(i, rows[10][1]) for i in range(700, 730)] + [(740, None), (741, [0.0] * 8), (742, [float("nan")] * 8), (743, [None] * 8), (744, [1.0]), (750, rows[10][1])]
    df = spark.createDataFrame([(i, v, 0, 0, 0, 0) for i, v in rows], VECTORS)
    want, got = brute_neighbours(rows, 10, 10), {}
    for r in neighbours.nearest_neighbours(df, k=10, every=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(got) == set(want)
    hits = 0
    for i, near in want.items():
        ranked = sorted(got[i])
        assert [r for r, _, _ in ranked] == list(range(1, 11))
        assert [(s, v) for _, s, v in ranked] == sorted((s, v) for _, s, v in ranked)
        hits += len({v for _, _, v in ranked} & {j for _, j in near})
    assert hits / (10 * len(want)) >= 0.97
    assert [v for _, _, v in sorted(got[750])][:10] == [10, *range(700, 709)]


def test_neighbours_of_few(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert neighbours.nearest_neighbours(empty).collect() == []
    three = spark.createDataFrame([(i, [1.0 + i, 2.0], 0, 0, 0, 0) for i in range(3)], VECTORS)
    assert [tuple(r)[:3] for r in neighbours.nearest_neighbours(three).collect()] == [(0, 1, 1), (0, 2, 2)]


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((500, 48)), rng.standard_normal((5, 48))
    coarse = neighbours.fit_coarse(x, 500)
    centre = x.mean(0)
    middle, error = neighbours.Codes.of(x, centre, coarse.rotation).estimates(q, centre, coarse.rotation)
    exact = ((x[None] - q[:, None]) ** 2).sum(2)
    assert np.mean(np.abs(exact - middle) <= error) > 0.97 and np.abs(np.mean(exact - middle)) < 0.5


PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_are_encoded_as_the_library_does():
    library, mine = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    rng = random.Random(0)
    texts = [t or "" for _, t in ODD] + ["É È ñandú STRASSE", "a_b <|endoftext|>x", "ΑΣ Σ", "v2.0 (c) --- ...", "é ́x", "\x1c\x1dab\x85 c\xa0d", "'s 't it's", "x" * 200]
    texts += [" ".join("".join(rng.choice("abcdeABéüÿß.,!|'0$") for _ in range(rng.randrange(1, 14))) for _ in range(60)) for _ in range(40)]
    flat, sizes = mine.encode([t.encode() for t in texts])
    for t, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert mine.encode([b"", b" \n"])[1].tolist() == [0, 0] and mine.encode([])[1].tolist() == []
    assert mine.table is not None


@pytest.mark.parametrize("shard_tokens", [1 << 21, 600])
def test_packing_holds_every_id_once(spark, shard_tokens):
    library, rng = Tokenizer.from_file(PATH), random.Random(1)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(200)]
    rows = [(100 + i, " ".join(rng.choices(words, k=rng.choice([3, 30, 90])))) for i in range(60)] + [(200 + i, "same text") for i in range(40)]
    rows += [(i, t) for i, t in ODD if i != 3] + [(99, "long word " * 400)]
    pieces_of, sequences, window = {}, {}, 128
    for r in packing.pack(frame(spark, rows), PATH, 2, window, shard_tokens).collect():
        pieces_of.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces_of) == {i for i, _ in rows}
    for i, t in rows:
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces_of[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[at : at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    if shard_tokens > 1000:
        total = sum(r["length"] for own in sequences.values() for r in own)
        assert total / (window * len(sequences)) > 0.97


def test_packing_of_nothing(spark):
    assert packing.with_digest(packing.pack(frame(spark, []), PATH)).collect() == []


def test_bm25_ranks_the_alike_first():
    docs = [[1, 2, 3], [1, 2, 9], [7, 8, 9], [2, 3, 1, 4]]
    ids, owner = np.concatenate(docs), np.repeat(np.arange(4), [len(d) for d in docs])
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=10)
    idf = np.log(1 + (4 - frequency + 0.5) / (frequency + 0.5))
    scores = packing.Bm25.build(ids.astype(np.uint16), owner, 4, idf, len(ids) / 4).scores(0, 4)
    for d in range(4):
        norm = packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / (len(ids) / 4))
        assert scores[d] == pytest.approx(sum(idf[t] * (packing.K1 + 1) / (1 + norm) for t in docs[0] if t in docs[d]))
    assert np.argsort(-scores).tolist()[:2] == [0, 3] and scores[2] == 0


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_without_dropout_are_the_models_own():
    import sentencepiece

    model, mine = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceCoder(MODEL)
    rng = random.Random(3)
    texts = ["a  b", " a", "a\nb\t c ", "", "\x00x", "<s> </s> <unk> <0x41>", "a" * 80, "   ", "\n\n", "\U0001f600 z", "日本語 x"]
    texts += ["".join(rng.choice("abcde éü\n.,1") for _ in range(200)) for _ in range(40)]
    assert [mine.encode(t).tolist() for t in texts] == [model.encode(t) for t in texts]


@pytest.mark.parametrize("rate", [0.1, 0.6])
def test_merging_side_by_side_is_the_agenda_of_each_unit(rate):
    coder, rng, limit = pieces.PieceCoder(MODEL), random.Random(4), int(rate * (1 << 32))
    inner = {t[i : i + 2] for t in coder.ranks for i in range(len(t) - 1)}
    for variant in (0, 3):
        text = "".join(rng.choice("thea inor  éü,.\n1▁Ж字") for _ in range(1500)) + "ab" * 40
        want, unit = [], ""
        for c in " " + text:
            if unit and unit[-1] + c not in inner:
                want += coder.one(unit, 7, variant, limit)
                unit = ""
            unit += c
        want += coder.one(unit, 7, variant, limit)
        assert coder.encode(text, rate, 7, variant).tolist() == want and coder.decode(want) == text


def test_pieces_decode_losslessly_and_vary(spark):
    rows = [*ODD, (8, "the quick brown fox " * 50), (9, "▁▁ a ▁b")]
    seen = {}
    for seed in (1, 2):
        encoded = pieces.encode_texts(frame(spark, rows), MODEL, rate=0.3, seed=seed)
        again = {(r["doc_id"], r["text"]) for r in pieces.decode_ids(encoded, MODEL).collect()}
        assert again == set(rows)
        found = encoded.collect()
        assert len(found) == len(rows) and all(r["lossless"] in (True, None) for r in found)
        assert all((r["ids"] is None) == (r["lossless"] is None) for r in found)
        seen[seed] = {r["doc_id"]: r["ids"] for r in found}
    assert seen[1][8] != seen[2][8]
    repeat = {r["doc_id"]: r["ids"] for r in pieces.encode_texts(frame(spark, rows).repartition(4), MODEL, rate=0.3, seed=1).collect()}
    assert repeat == seen[1]
    assert pieces.encode_texts(frame(spark, []), MODEL).collect() == []


def test_forms_of_a_word_grow_with_its_occurrences(spark):
    rows = [(i, "international " * 40) for i in range(40)]
    found = [r["ids"] for r in pieces.encode_texts(frame(spark, rows), MODEL, rate=0.3, seed=1).collect()]
    assert len({tuple(ids) for ids in found}) == 40
    coder = pieces.PieceCoder(MODEL)
    forms = set()
    for ids in found:
        at, unit = [], []
        for i in ids:
            if coder.raw[i].startswith(b" ") and unit:
                at.append(tuple(unit))
                unit = []
            unit.append(i)
        assert len(set(at)) > 1
        forms |= set(at)
    assert len(forms) > 8


def test_bm25_scores_with_all_terms_of_a_long_seed():
    docs = [list(range(60)), *([t] for t in range(60))]
    ids, sizes = np.array([t for d in docs for t in d]), [len(d) for d in docs]
    index = packing.Bm25.build(ids, np.repeat(np.arange(len(docs)), sizes), len(docs), np.ones(60), 2.0)
    assert (index.scores(0, len(docs)) > 0).all()


def brute_fill(docs, window, idf, mean):
    """The packing of one shard, by scores over lists of tokens."""
    left, start, out, sequence = [len(d) for d in docs], [0] * len(docs), [], 0
    for i, d in enumerate(docs):
        while left[i] >= window:
            out.append((i, start[i], window, sequence, 0))
            start[i], left[i], sequence = start[i] + window, left[i] - window, sequence + 1

    def score(seed, i):
        norm = packing.K1 * (1 - packing.B + packing.B * len(docs[i]) / mean)
        return sum(idf[t] * docs[i].count(t) * (packing.K1 + 1) / (docs[i].count(t) + norm) for t in set(docs[seed]))

    rest = None
    while any(left):
        seed = rest if rest is not None else next(i for i, n in enumerate(left) if n)
        order = sorted((i for i in range(len(docs)) if left[i] and i != seed), key=lambda i: (-round(score(seed, i), 9), i))
        gap, rest = window, None
        for i in [seed, *order]:
            n = min(left[i], gap)
            if n:
                out.append((i, start[i], n, sequence, window - gap))
                start[i], left[i], gap = start[i] + n, left[i] - n, gap - n
                rest = i if left[i] else None
        sequence += 1
    return out


def test_placement_against_a_brute_force_fill():
    rng = random.Random(5)
    docs = [[rng.randrange(40) for _ in range(rng.choice([1, 5, 9, 20, 70]))] for _ in range(60)] + [[7, 8, 9]] * 5
    sizes = np.array([len(d) for d in docs])
    idf = np.array([rng.random() + 0.1 for _ in range(40)])
    ids = np.array([t for d in docs for t in d])
    index = packing.Bm25.build(ids, np.repeat(np.arange(len(docs)), sizes), len(docs), idf, sizes.mean())
    got = [tuple(r) for r in packing.plan_shard(sizes, index, 32).tolist()]
    assert got == brute_fill(docs, 32, idf, sizes.mean())


@pytest.mark.parametrize("shard_tokens", [700, 1 << 21])
def test_packing_again_gives_the_same_rows(spark, shard_tokens):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(90)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([3, 30, 90])))) for i in range(150)] + [(200 + i, "same text") for i in range(90)] + [(7, "same text")] * 80
    found = [sorted(map(tuple, packing.pack(frame(spark, rows), PATH, 2, 128, shard_tokens).collect()), key=str) for _ in range(2)]
    assert found[0] == found[1]


def test_shards_are_cut_by_tokens():
    rng = random.Random(2)
    buckets = [(b, rng.choice([1, 5, 40, 250])) for b in range(200)]
    cut, shards = packing.cut_shards(buckets, 100)
    held = {}
    for (_, n), (_, first, parts) in zip(buckets, cut):
        for k in range(parts):
            held[first + k] = held.get(first + k, 0) + n / parts
    assert sorted(held) == list(range(shards)) and max(held.values()) <= 100 and packing.cut_shards([], 100) == ([], 0)


def test_rows_that_repeat_spread_over_shards(spark):
    rows = [(1, "the same text again and again")] * 3000 + [(2, "other words")] * 10
    found = packing.pack(frame(spark, rows), PATH, 2, 64, 1000).collect()
    held = {}
    for r in found:
        held[r["sequence_id"] >> 32] = held.get(r["sequence_id"] >> 32, 0) + r["length"]
    assert len(held) > 5 and max(held.values()) < 0.4 * sum(held.values()) and len(found) >= 3010



def test_encoding_holds_few_times_its_stream():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3000)] + ["it's", "naïve", "σοφός", "42", "(x)"]
    texts = [" ".join(rng.choice(words) for _ in range(4000)).encode() for _ in range(100)]
    coder = packing.WordEncoder(PATH)
    coder.encode(texts[:1])
    tracemalloc.start()
    try:
        ids, sizes = coder.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sizes.sum() == len(ids) and peak < 40 * sum(map(len, texts))


def test_run_hashes_do_not_depend_on_the_blocks(monkeypatch):
    sizes = np.array([1, 3, 200, 2, 2, 7, 90, 1])
    letters = np.random.default_rng(1).integers(0, 256, sizes.sum()).astype(np.uint8)
    found = []
    for block in (1, 5, 64, 1 << 17):
        monkeypatch.setattr(packing, "HASHED_BYTES", block)
        found.append(np.stack(packing._run_hashes(letters, sizes)))
    assert all(np.array_equal(f, found[0]) for f in found)
    end = int(sizes[:2].sum())
    assert found[0][1, 1] == sum((int(x) + 1) * int(packing._POWERS[1, i]) for i, x in enumerate(letters[1:end])) + 3 * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    assert packing._run_hashes(letters[:0], sizes[:0])[0].shape == (0,)


def test_few_rows_need_no_python_workers(spark):
    df = few_rows(spark, [(1, 2), (1 << 40, 3)], "doc_id long, part int")
    assert df.schema.simpleString() == "struct<doc_id:bigint,part:int>" and sorted(map(tuple, df.collect())) == [(1, 2), (1 << 40, 3)]
    assert "LocalRelation" in df._jdf.queryExecution().optimizedPlan().toString()
    assert few_rows(spark, [], "doc_id long").collect() == []


def test_tasks_give_freed_memory_back(monkeypatch):
    class Frame:
        sparkSession = None

        def mapInArrow(self, run, schema):
            return run

    class Pool:
        def release_unused(self):
            done.append("released")

    done: list = []
    monkeypatch.setattr(shared, "ship", lambda session: None)
    for name in ("default_memory_pool", "system_memory_pool"):
        monkeypatch.setattr(shared.pa, name, Pool)
    assert [done.append(x) or x for x in shared.in_arrow(Frame(), lambda batches: (2 * b for b in batches), "")(iter([1, 2]))] == [2, 4]
    assert done == [2, 4, "released", "released"]
