import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import components as comps, exact_dedup, simhash
from tidewell.llm.components import components

SCHEMA = "doc_id long, text string, digest string, fp string, file string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        clean = re.sub("[\x20\x09-\x0d]", "", t or "")
        best = min(groups[clean])
        out.append((i, best[1], len(groups[clean]), i == best[1], hashlib.sha256(clean.encode()).hexdigest()))
    return sorted(out)


def got_dedup(df, **options):
    return sorted(tuple(r) for r in exact_dedup.exact_dedup(df, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


ROWS = [
    (1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \r\v\f"), (7, "é" * 50_000), (8, "É" * 50_000), (9, "a b"), (10, "a b "),
    (11, "  ab "), (12, "\U0001f600"), (13, "\U0001f600"),
]


def test_groups_of_equal_texts(spark):
    assert got_dedup(frame(spark, ROWS)) == brute_dedup(ROWS)


def test_groups_from_files(spark, tmp_path):
    frame(spark, ROWS).repartition(3).write.parquet(str(tmp_path / "t"))
    assert got_dedup(spark.read.parquet(str(tmp_path / "t"))) == brute_dedup(ROWS)


def test_colliding_digests_are_told_apart(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 6)))) for i in range(80)]
    assert got_dedup(frame(spark, rows), digest=lambda c: F.substring(F.sha2(c, 256), 1, 1)) == brute_dedup(rows)


def test_repeated_rows_and_empty_table(spark):
    got = got_dedup(frame(spark, [(1, "a"), (1, "a"), (2, "b")]))
    assert [r[3] for r in got] in ([True, False, True], [False, True, True])
    assert got_dedup(frame(spark, [(None, "b")])) == [(None, None, 1, True, hashlib.sha256(b"b").hexdigest())]
    assert got_dedup(frame(spark, [])) == []


def test_state_continues_over_later_files(spark, tmp_path):
    keys, state = str(tmp_path / "keys"), str(tmp_path / "state")
    for part in ([(5, "a b"), (6, "c")], [(1, "ab"), (2, "a  b"), (3, "d")]):
        texts = exact_dedup.stored(frame(spark, part))
        exact_dedup.key_rows(texts).write.mode("append").parquet(keys)
        found = exact_dedup.run_state(spark, keys, state)
    assert sorted((r["doc_id"], r["hits"]) for r in found.collect()) == [(2, 3), (3, 1), (6, 1)]


def brute_components(fps, max_bits=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    listed = sorted(fps)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= max_bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def brute_fingerprint(text, words=3):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("limit", [64, 0])
def test_simhash_against_brute_force(spark, limit):
    rng = random.Random(5)
    base = [[rng.choice(["Ab", "c", "dé", "e", "F"]) for _ in range(40)] for _ in range(6)]
    rows = [(i, " ".join(rng.choice("xyz") if rng.random() < 0.01 else w for w in rng.choice(base))) for i in range(100, 190)]
    rows += [(1, None), (2, ""), (3, "one"), (4, "one two"), (5, "one  two\t"), (6, "word " * 9000), (7, " x"), (7, " x")]
    got = sorted(tuple(r) for r in simhash.simhash_groups(frame(spark, rows), bucket_limit=limit).collect())
    fps = {i: brute_fingerprint(t) for i, t in rows}
    roots, least = brute_components(set(fps.values())), {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert got == sorted((i, f"{fps[i]:016x}", least[roots[fps[i]]]) for i, _ in rows)


@pytest.mark.parametrize("bits, limit", [(1, 4), (1, 0), (2, 4), (2, 0)])
def test_links_of_crowded_fingerprints(spark, bits, limit):
    rng = random.Random(bits)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for c in centres for _ in range(60)}
    df = spark.createDataFrame([(0, simhash._signed(f)) for f in fps], "view int, fp long")
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(simhash.links(df, bits, limit)).collect()}
    want = brute_components(fps, bits)
    mine = {f: found.get(f, f) for f in fps}
    assert {frozenset(f for f in fps if mine[f] == r) for r in mine.values()} == {frozenset(f for f in fps if want[f] == r) for r in want.values()}


@pytest.mark.parametrize("limit", [64, 0])
def test_views_link_what_any_of_them_links(spark, limit):
    rng = random.Random(9)
    base = [[rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(60)] for _ in range(5)]
    rows = [(i, " ".join("new" if rng.random() < 0.02 else w for w in rng.choice(base))) for i in range(70)]
    hashes = {i: simhash.shingle_hashes(t.encode(), 3) for i, t in rows}
    fps = {i: [simhash.fingerprint(simhash.view_hashes(h, v)) for v in range(3)] for i, h in hashes.items()}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fps:
        for j in fps:
            if i < j and any((a ^ b).bit_count() <= 2 for a, b in zip(fps[i], fps[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(frame(spark, rows), views=3, bucket_limit=limit).collect()}
    assert got == {i: find(i) for i in fps}
    assert len({find(i) for i in fps}) < len({(f[0]) for f in fps.values()})


def test_simhash_of_nothing(spark):
    assert simhash.simhash_groups(frame(spark, [])).collect() == []
    assert [r["component_id"] for r in simhash.simhash_groups(frame(spark, [(None, "a"), (4, "a")])).collect()] == [4, 4]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (7, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in found} == {(i, 0) for i in range(201)}


@pytest.mark.parametrize("whole", [64, 2])
def test_near_copies_are_those_of_exact_similarity(spark, whole):
    rng = random.Random(3)
    rows, want, at = [], set(), 0
    for n in (60, 150, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for changed in (0, 1, 2, 4, 8, 16):
            rows.append((at, " ".join(w if k % (n // max(1, changed)) != 7 or not changed else f"c{at}x{k}" for k, w in enumerate(base))))
            at += 1
    rows += [(90, None), (91, ""), (92, "one two"), (93, "three"), (None, "all alone")]
    sets = {i: {" ".join((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for i, t in rows}
    for i in sorted(sets, key=lambda i: (i is None, i or 0)):
        if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets if j is not None and (i is None or j < i)):
            want.add(i)
    got = [r["doc_id"] for r in simhash.without_near_copies(frame(spark, rows), views=16, whole=whole).collect()]
    assert len(got) == len(set(got)) and want <= set(got) and not {13, 14, 15, 91} & set(got)
    # texts that a common passage makes alike to the fingerprints only
    common = "again and again the same " * 300
    rows = [(i, common + " ".join(f"u{i}v{k}" for k in range(40))) for i in range(5)]
    assert len({r["component_id"] for r in simhash.simhash_groups(frame(spark, rows), views=16).collect()}) == 1
    assert sorted(r["doc_id"] for r in simhash.without_near_copies(frame(spark, rows), views=16, whole=whole).collect()) == [0, 1, 2, 3, 4]


def jaccard(a, b, words=5):
    a, b = ({" ".join(t.split()[k : k + words]) for k in range(len(t.split()) - words + 1)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_from_the_threshold_on_are_found(spark):
    rng, rows, near = random.Random(8), [], []
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    for i in range(240):
        base = [rng.choice(vocabulary[: 200 if i % 3 else 3000]) for _ in range(rng.randrange(60, 300))]
        copy = [rng.choice(vocabulary) if rng.random() < 0.017 else w for w in base]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        if 0.8 <= (found := jaccard(rows[-2][1], rows[-1][1])):
            near.append((2 * i + 1, found))
    kept = {r["doc_id"] for r in simhash.without_near_copies(frame(spark, rows)).collect()}
    hard = [i for i, j in near if j < 0.88]
    assert len(hard) > 60 and sum(i not in kept for i in hard) >= 0.9 * len(hard)
    assert sum(i not in kept for i, _ in near) >= 0.95 * len(near)
    assert {i for i, _ in rows} - kept <= {i for i, _ in near}  # nothing below the threshold goes


def test_view_links_against_brute_force(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(48) for _ in range(5)]
    fps = sorted({c ^ sum(1 << b for b in {rng.randrange(48) for _ in range(rng.randrange(4))}) for c in centres for _ in range(120)})
    rows = [(v, f, 1000 * v + i) for v in range(2) for i, f in enumerate(fps)]
    got = {frozenset((r["a"], r["b"])) for r in simhash.view_links(spark.createDataFrame(rows, "view int, fp long, first long")).collect()}
    want = {frozenset((1000 * v + i, 1000 * v + j)) for v in range(2) for i, f in enumerate(fps) for j in range(i) if (f ^ fps[j]).bit_count() == 1}
    assert got == want


@pytest.mark.parametrize("words", [1, 2, 5])
def test_ngram_hashes_tell_runs_of_words_apart(words):
    text = "A b\tc é  a B c\x0bé " + "x" * 9000 + " y " * 3
    found = [w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]
    runs = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)]
    hashes = simhash.ngram_hashes(text.encode(), words).tolist()
    assert len(hashes) == len(runs) and len(set(zip(runs, hashes))) == len(set(runs)) == len(set(hashes))
    assert len(simhash.ngram_hashes(b" \n", words)) == 0 and len(simhash.ngram_hashes(b"one", words)) == 1
    assert simhash.view_fingerprints(simhash.ngram_hashes(b"", 2), 3).tolist() == [0, 0, 0]


def members_of(spark, sets, roots=None):
    rows = [((roots or {}).get(i, 0), i, sorted(s)) for i, s in sets.items()]
    return spark.createDataFrame(rows, "root long, node long, hashes array<long>")


def grouped(spark, edges, nodes):
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    return {n: root.get(n, n) for n in nodes}


def by_pairs(sets, roots=None):
    """Least member of each component of all pairs with a similarity of 0.8."""
    own = {n: n for n in sets}
    again = True
    while again:
        again = False
        for a, b in itertools.combinations(sets, 2):
            if (roots or {}).get(a, 0) == (roots or {}).get(b, 0) and own[a] != own[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((own[a], own[b]))
                own = {n: low if c == high else c for n, c in own.items()}
                again = True
    return own


def test_links_between_members_of_two_leaders(spark):
    # a leader with copies and A beside it, others with B beside them; only A and B tie the two halves together
    base = list(range(100))
    sets = {0: set(base), 1: set(base[:90]) | set(range(1000, 1010))}
    sets |= {2 + i: set(base) - {i} | {2000 + i} for i in range(40)}
    b = set(base[:90]) | {1000, *range(3000, 3019)} - {3018}
    sets[50] = set(sorted(sets[1])[:90]) | set(range(3000, 3010))
    far = set(sorted(sets[50])[:80]) | set(range(3000, 3010)) | set(range(4000, 4010))
    sets |= {60 + i: (far - {i}) | {5000 + i} for i in range(40)}
    assert len(sets) == 83 and b
    want = by_pairs(sets)
    for whole in (8, 64, 200):
        assert grouped(spark, simhash.verified_links(members_of(spark, sets), 0.8, whole), sets) == want


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_prefix_links_equal_all_pairs(spark, rounds):
    rng = random.Random(rounds)
    sets, roots = {}, {}
    for g in range(6):  # chains of copies of copies, with unrelated texts between and shingles that all share
        common = set(range(90000, 90000 + 10 * g))
        at = set(rng.sample(range(g * 1000, g * 1000 + 900), 60))
        for i in range(50):
            n = 100 * g + i
            roots[n] = g // 3
            kind = rng.random()
            if kind < 0.5:
                at = set(rng.sample(sorted(at), len(at) - rng.randrange(0, 8))) | set(rng.sample(range(g * 1000, g * 1000 + 900), rng.randrange(0, 8)))
                sets[n] = at | common
            elif kind < 0.8:
                sets[n] = set(rng.sample(range(g * 1000, g * 1000 + 900), rng.randrange(1, 70))) | common
            elif kind < 0.9:
                sets[n] = set()
            else:
                sets[n] = set(sets[rng.choice(sorted(sets))]) | {n + 500000}
    got = grouped(spark, simhash.prefix_links(members_of(spark, sets, roots), 0.8, rounds), sets)
    want = by_pairs(sets, roots)
    assert got == want and 20 < len(set(want.values())) < len(sets)


def test_a_star_is_dealt_to_several_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20k")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "10k")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        star = spark.range(1, 30001).select(F.lit(0).cast("long").alias("b"), F.col("id").alias("a"), F.rand(1).alias("r")).repartition(8, "r").drop("r").unionByName(spark.createDataFrame([(50000, 50001)], "a long, b long"))
        joined = comps._small_star(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        assert len(joined.collect()) > 30000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["root"] for r in components(star.limit(30000)).collect()} == {0}


def test_parity_marks_never_exceed_the_shingles_that_differ(spark):
    rng = random.Random(6)
    pool = [rng.randrange(-(2**63), 2**63) for _ in range(3000)]
    sets = {i: set(rng.sample(pool, rng.randrange(1, 900))) for i in range(30)} | {30: set()}
    got = {r["node"]: [r[f"m{i}"] for i in range(simhash.MARKS)] for r in simhash.parity_marks(members_of(spark, sets)).collect()}
    want = {}
    for n, held in sets.items():
        bits = [0] * simhash.MARKS
        for h in held:
            bits[(h >> 6) % simhash.MARKS] ^= 1 << (h & 63)
        want[n] = [b - (1 << 64) if b >> 63 else b for b in bits]
    assert got == want
    assert all(sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(got[a], got[b])) <= len(sets[a] ^ sets[b]) for a in sets for b in sets)


def test_texts_of_a_group_that_are_not_alike_enough_are_not_compared(spark, monkeypatch):
    # a group of texts with a similarity of two thirds that share their rare shingles; and near copies of some
    rng = random.Random(7)
    base, rare = [rng.randrange(2**62) for _ in range(150)], [rng.randrange(2**62) for _ in range(800)]
    sets = {i: set(rng.sample(base, 134)) | set(rng.sample(rare, 16)) for i in range(150)}
    sets |= {1000 + i: (sets[i] - {min(sets[i])}) | {i} for i in range(0, 150, 3)}
    compared = []
    kept = simhash._compared

    def counting(pairs, members, similarity):
        compared.append(pairs.count())
        return kept(pairs, members, similarity)

    monkeypatch.setattr(simhash, "_compared", counting)
    want = by_pairs(sets)
    assert grouped(spark, simhash.prefix_links(members_of(spark, sets), 0.8), sets) == want and len(set(want.values())) < len(sets)
    assert compared[-1] < 200, compared
