"""Phrase collocations of each language.

Identical pieces of text become one row with a multiplicity. N-grams are counted with these weights: tasks add up what they see, the
sums are dealt by a hash of language and n-gram, and every hash bucket is summed by duckdb, which goes to disk beyond its memory.
An n-gram reaches the least count only if all its words and word pairs do, so counting goes in three steps: words, hashes of pairs, and the
n-grams themselves. Filters of a fixed size carry the frequent words and pairs to the next step. They let some others through, which the
exact counts end, and never hold back a frequent one.

A candidate asks for the counts of its parts: requests are shuffled to the parts' counts and the answers back to the candidate.
"""

from __future__ import annotations

import shutil
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.shared import in_arrow, text_or_empty, written
from tidewell.operators.joins import small

LEAST, LONGEST, TOP, ABSORBED = 100, 5, 2000, 100
FILTER_BITS = 26  #: a filter has 2 ** FILTER_BITS bits, 8 MiB, whatever the input
HELD, HELD_PAIRS = 400_000, 2_000_000  #: sums, and hashes of pairs, that a task holds before it gives them away
BLOCK_CHARS = 1_000_000  #: characters of pieces that a task handles at once, besides the last piece
REMEMBERED, MANY_LANGUAGES = 200_000, 50  #: words of a language, and languages, that a task remembers
BUCKET_MEMORY = "400MB"
WORD_SALTS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS = "[.,;:!?\\x0A-\\x0D]"
KIND = "lang string, gram string, f long"


def pieces(df: DataFrame) -> DataFrame:
    """lang, piece (words with one space between) and copies of the distinct pieces with a word of df (text, lang)."""
    text = F.regexp_replace(F.translate(text_or_empty(), UPPER, LOWER), "[\\x20\\x09]+", " ")
    each = df.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, ENDS)).alias("piece"))
    each = each.select("lang", F.trim("piece").alias("piece")).filter("piece <> ''")
    return each.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("copies"))


def gram_hash(lang: Column, gram: Column) -> Column:
    return F.xxhash64(F.concat(lang, F.lit("\x00"), gram))


def filter_of(hashes: DataFrame) -> np.ndarray:
    """Bits of a filter that holds every row of hashes (h)."""
    size = F.lit(1 << FILTER_BITS)
    places = F.array(F.pmod("h", size), F.pmod(F.shiftright("h", 32), size))
    place = hashes.select(F.explode(places).alias("place")).select((F.col("place") + 1).alias("place"))
    parts = place.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in parts.collect():  # the whole filter at most
        bits = np.frombuffer(row["bits"], np.uint8)
        at = (row["part"] - 1) * len(bits)
        out[at : at + len(bits)] |= bits
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) a filter lets through."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    found = np.ones(len(hashes), bool)
    for place in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        found &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


class Known(dict):
    """The hash of each word of a language that a filter lets through, 0 of others; remembers those seen last."""

    def __init__(self, bits: np.ndarray, lang: str):
        super().__init__()
        self.bits, self.prefix = bits.tobytes(), f"{lang}\x00".encode()

    def __missing__(self, word: str) -> int:
        h, mask = xxhash.xxh64_intdigest(self.prefix + word.encode(), 42), (1 << FILTER_BITS) - 1
        p, q = h & mask, h >> 32 & mask
        found = h if self.bits[p >> 3] >> (p & 7) & 1 and self.bits[q >> 3] >> (q & 7) & 1 else 0
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each two neighbours, 0 where one of them is 0."""
    a, b = words[:-1], words[1:]
    turned = (b << np.uint64(21)) | (b >> np.uint64(43))
    return np.where((a != 0) & (b != 0), a ^ turned, np.uint64(0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], np.ndarray]]:
    """lang, words and the copies of each word, of many pieces of a language at a time; a line feed stands between pieces."""
    for batch in batches:
        held: dict[str, tuple[list[str], list[int]]] = {}
        size = 0
        for lang, piece, copies in zip(*(c.to_pylist() for c in batch.columns)):
            own = held.setdefault(lang, ([], []))
            own[0].append(piece)
            own[1].append(copies)
            size += len(piece)
            if size >= BLOCK_CHARS:
                yield from _flat(held)
                held, size = {}, 0
        yield from _flat(held)


def _flat(held: dict[str, tuple[list[str], list[int]]]) -> Iterator[tuple[str, list[str], np.ndarray]]:
    for lang, (texts, copies) in held.items():
        sizes = np.fromiter((t.count(" ") + 2 for t in texts), np.int64, len(texts))
        yield lang, " \n ".join(texts).split(" "), np.repeat(np.array(copies, np.int64), sizes)[:-1]


class Sums:
    """N-grams of languages with their counts, given away as batches when there are many."""

    def __init__(self):
        self.by_lang: dict[str, Counter] = {}

    def add(self, lang: str, single: list[str], repeated: list[tuple[str, int]]) -> None:
        """Count single once each, repeated as often as they say."""
        own = self.by_lang.setdefault(lang, Counter())
        own.update(single)
        for gram, n in repeated:
            own[gram] += n

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        """All sums if there are `least` or more; none is held afterwards."""
        if sum(map(len, self.by_lang.values())) >= least:
            langs = [lang for lang, own in self.by_lang.items() for _ in own]
            grams, counts = [g for own in self.by_lang.values() for g in own], [n for own in self.by_lang.values() for n in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "f"])
            self.by_lang = {}


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of pieces, summed by task."""
    sums = Sums()
    for lang, words, copies in _blocks(batches):
        once = (copies == 1).tolist()
        single = [w for w, one in zip(words, once) if one and w != "\n"]
        sums.add(lang, single, [(words[i], int(copies[i])) for i in np.flatnonzero(copies != 1).tolist() if words[i] != "\n"])
        yield from sums.batches(HELD)
    yield from sums.batches(1)


class Hashes:
    """Hashes of words of many languages; memory stays bounded whatever the language column holds."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.known = bits, {}

    def of(self, lang: str, words: list[str]) -> np.ndarray:
        if lang not in self.known:
            if len(self.known) >= MANY_LANGUAGES:
                self.known.clear()
            self.known[lang] = Known(self.bits, lang)
            self.known[lang]["\n"] = 0
        known = self.known[lang]
        out = np.array([known[w] if w != "\n" else 0 for w in words], np.uint64)
        return out


def count_pairs(bits: np.ndarray):
    """A function that sums the hashes of the pairs of frequent words of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = Hashes(bits), [], 0

        def summed() -> Iterator[pa.RecordBatch]:
            if held:
                keys, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, at, np.concatenate([n for _, n in held]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], names=["h", "f"])

        for lang, words, copies in _blocks(batches):
            pairs = pair_hashes(hashes.of(lang, words))
            there = np.flatnonzero(pairs)
            held.append((pairs[there], copies[there]))
            size += len(there)
            if size >= HELD_PAIRS:
                yield from summed()
                held, size = [], 0
        yield from summed()

    return run


def count_longer(words_bits: np.ndarray, pair_bits: np.ndarray):
    """A function that sums the n-grams of two words and more whose words and pairs are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = Hashes(words_bits), Sums()
        for lang, words, copies in _blocks(batches):
            pairs = pair_hashes(hashes.of(lang, words))
            there = np.flatnonzero(pairs)
            good = np.zeros(len(pairs) + 2, np.int8)
            good[there[passes(pair_bits, pairs[there])] + 1] = 1
            edge = np.diff(good)
            single: list[str] = []
            repeated: list[tuple[str, int]] = []
            for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):  # pairs i to j - 1 are good, words i to j
                n = int(copies[i])
                if n == 1 and j == i + 1:
                    single.append(f"{words[i]} {words[j]}")
                    continue
                grams = words[i : j + 1]
                found: list[str] = []
                for size in range(2, min(LONGEST, j - i + 1) + 1):
                    grams = [f"{g} {w}" for g, w in zip(grams, words[i + size - 1 : j + 1])]
                    found += grams
                if n == 1:
                    single += found
                else:
                    repeated += [(g, n) for g in found]
            sums.add(lang, single, repeated)
            yield from sums.batches(HELD)
        yield from sums.batches(1)

    return run


def in_buckets(parts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The keys of parts (keys, f) with their sum, where it reaches `least`.

    Parts are dealt by the keys' hash, and every bucket is summed by duckdb, with bounded memory and a folder of its own for the rest.
    """
    schema = parts.schema
    names = ", ".join(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        own = pa.schema([(f.name, pa.string() if f.dataType.typeName() == "string" else pa.int64()) for f in schema])
        folder = tempfile.mkdtemp(prefix="grams-")
        try:
            with duckdb.connect(config={"memory_limit": BUCKET_MEMORY, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False}) as duck:
                duck.register("parts", pa.RecordBatchReader.from_batches(own, (b.cast(own) for b in batches)))
                found = duck.sql(f"SELECT {names}, sum(f)::BIGINT AS f FROM parts GROUP BY {names} HAVING sum(f) >= $least", params={"least": least})
                yield from (b.cast(own) for b in found.to_arrow_reader(1 << 16))
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return in_arrow(parts.repartition(*keys), run, schema)


def gram_counts(of: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, gram, f and size of all n-grams of one to LONGEST words of pieces with `least` occurrences or more.

    Pairs are first counted by a 64-bit hash alone: one that reaches the least count does so by its hash, too.
    """
    rows = of.select("lang", "piece", "copies")
    sized = lambda df, name: written(df.withColumn("size", F.size(F.split("gram", " "))), name)
    words = sized(in_buckets(in_arrow(rows, count_words, KIND), ["lang", "gram"], least), "collocation-words")
    single = filter_of(words.select(gram_hash(F.col("lang"), F.col("gram")).alias("h")))
    pairs = written(in_buckets(in_arrow(rows, count_pairs(single), "h long, f long"), ["h"], least), "collocation-pairs")
    longer = in_buckets(in_arrow(rows, count_longer(single, filter_of(pairs)), KIND), ["lang", "gram"], least)
    return words.unionByName(sized(longer, "collocation-longer"))


def _part(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def score_of(a: Column, l: Column, r: Column, n: Column) -> Column:
    """floor(1000 * a * n / (l * r)) without rounding before the division; products may have 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a * 1000) * wide(n), wide(l) * wide(r))


def scored(counts: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of every candidate, by its lowest-scoring cut.

    counts has lang, gram, f and size, words has lang and n. Common words are asked for by many candidates, so their counts are
    dealt out under WORD_SALTS salts.
    """
    asked = counts.filter("size > 1").select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), "size", F.split("gram", " ").alias("words"))
    asked = asked.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    sides = F.array(F.struct(F.lit("l").alias("side"), _part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))
    asked = asked.select("lang", "phrase", "a", "k", F.inline(sides))
    salt = F.when(F.contains("part", F.lit(" ")), F.lit(0)).otherwise(F.pmod(F.xxhash64("phrase"), F.lit(WORD_SALTS)).cast("int"))
    salts = F.when(F.col("size") > 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(WORD_SALTS - 1)))
    held = counts.select("lang", F.col("gram").alias("part"), F.col("f").alias("count"), F.explode(salts).alias("salt"))
    answers = asked.withColumn("salt", salt).join(held, ["lang", "part", "salt"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("count"))).alias(s)
    cuts = answers.repartition("lang", "phrase").groupBy("lang", "phrase", "k").agg(F.first("a").alias("a"), side("l"), side("r"))
    cuts = cuts.join(small(words), "lang").withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r"), F.col("n")))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    least = cuts.groupBy("lang", "phrase", "a", "n").agg(best)
    return least.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def absorbing(counts: DataFrame) -> DataFrame:
    """lang, phrase and inside: the largest count of the longer candidates that hold the phrase's words contiguously."""
    longer = counts.filter("size > 2").select("lang", "f", "size", F.split("gram", " ").alias("words"))
    longer = longer.withColumn("k", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)))
    return longer.groupBy("lang", _part(F.col("i"), F.col("k")).alias("phrase")).agg(F.max("f").alias("inside"))


def collocations(df: DataFrame, least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's best `top` phrases of df (text, lang).

    Candidates have 2 to LONGEST words and occur `least` times (at least 1) within pieces. A candidate goes whose words lie inside
    a longer one with at least `absorbed` percent of its count. Ties in score go to the larger count, then to the phrase first by bytes. Null
    and empty texts have no pieces; a null lang is `und`; repeated rows count each; very long texts are read whole; other columns
    are ignored; an empty df gives an empty result.
    """
    of = written(pieces(df), "collocation-pieces")
    words = of.groupBy("lang").agg(F.sum(F.col("copies") * F.size(F.split("piece", " "))).alias("n"))
    counts = gram_counts(of, least)
    rated = scored(counts, words).join(absorbing(counts), ["lang", "phrase"], "left")
    kept = rated.filter(F.col("inside").isNull() | (F.col("inside") * 100 < F.col("a") * absorbed))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # tasks keep `top` rows of a language before the shuffle
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
