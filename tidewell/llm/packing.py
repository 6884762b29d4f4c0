"""Packing documents into windows by lexical retrieval.

Documents are tokenised and dealt to shards of about SHARD_TOKENS tokens by ranges of the least hash of their token pairs, so that documents
that share it come together; many with one hash are dealt to several shards by a digest. A task holds one shard in memory at a time. Each shard holds an inverted index over its documents' tokens with BM25 weights,
whose document frequencies and mean length are those of the whole corpus. A seed document opens a window; all its
terms query the index, and the unused neighbours fill the window in order of their scores. A neighbour that no longer
fits is cut at the window's end, and its rest opens the next window. A document longer than a window first fills whole
windows alone. Only the last window of a shard is short.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.merging import PAD, PairTable, merge_rows
from tidewell.llm.shared import few_rows, in_arrow, text_or_empty, written

WINDOW = 4096
SHARD_TOKENS = 1 << 21
MOST_TASKS = 1 << 14
BUCKETS = 1 << 16  #: of sig, 2048 for each power of two
K1, B = 1.2, 0.75
STREAM_BYTES = 1 << 22  #: texts are tokenised together up to this size
LIBRARY_WORDS = 1 << 11  #: words whose results of the library are held at once
HASHED_BYTES = 1 << 17  #: bytes of runs whose places and hashes are held at once

_encoders: dict = {}


# Kinds of bytes to the splitter; the letters from U+00C0 to U+00FF join their two bytes later.
_SPACE, _LETTER, _MARK, _DIGIT, _ODD = range(5)


def _kinds() -> np.ndarray:
    out = np.full(256, _ODD, np.uint8)
    out[33:127] = _MARK
    out[[*range(65, 91), *range(97, 123)]] = _LETTER
    out[48:58] = _DIGIT
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[[ord("'"), ord("<")]] = _ODD  # contractions and special tokens
    return out


_KIND, _LOWER = _kinds().tobytes(), bytes(range(256)).lower()
LONGEST = 60  #: bytes of a run that is merged here
_POWERS = np.array([[pow(base, i, 1 << 64) for i in range(LONGEST)] for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)], np.uint64)


class MergeTable:
    """A byte-level merge tokenizer with a word-end suffix, applied to many runs of bytes at once."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocabulary, end, shown = model["vocab"], model["end_of_word_suffix"], _byte_letters()
        self.inner = np.array([vocabulary[shown[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[shown[b] + end] for b in range(256)], np.int32)
        pairs, merged = [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs.append(vocabulary[a] << 16 | vocabulary[b])
            merged.append(vocabulary[a + b])
        self.table = PairTable(np.array(pairs, np.uint32), np.arange(len(pairs), dtype=np.int32), np.array(merged, np.int32))

    @classmethod
    def of(cls, path: str) -> MergeTable | None:
        """None where the tokenizer is of another kind than this class applies."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], json.dumps(spec.get("pre_tokenizer"))
        fits = model.get("type", "BPE") == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout") and not model.get("ignore_merges")
        fits = fits and len(model["vocab"]) <= 1 << 16 and "|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in split and "ByteLevel" in split
        return cls(spec) if fits and "Lowercase" in json.dumps(spec.get("normalizer")) else None

    def merge(self, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of runs of bytes, one run after the other, with each run's first place and number of ids."""
        order, found, first, counts, at_id = np.argsort(sizes, kind="stable"), [], np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
        for at in range(0, len(order), 2048):
            part = order[at : at + 2048]
            places = np.arange(int(sizes[part[-1]]))[None, :]
            letters = low[np.minimum(starts[part][:, None] + places, len(low) - 1)]
            symbols = np.where(places < sizes[part][:, None], self.inner[letters], PAD)
            rows = np.arange(len(part))
            symbols[rows, sizes[part] - 1] = self.last[letters[rows, sizes[part] - 1]]
            ids, number = merge_rows(self.table, symbols)
            found.append(ids)
            counts[part] = number
            first[part] = at_id + np.cumsum(number) - number
            at_id += len(ids)
        return np.concatenate(found) if found else np.empty(0, np.int32), first, counts


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers show for each byte: itself if printable, else the next from U+0100 on."""
    shown = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    hidden = (b for b in range(256) if b not in shown)
    shown.update({b: chr(256 + i) for i, b in enumerate(hidden)})
    return [shown[b] for b in range(256)]


class WordEncoder:
    """Token ids of whole texts.

    Where the tokenizer fits MergeTable, texts are read as one stream of bytes and cut as its pre-tokenizer cuts: at white
    space, then into runs of letters, single digits and runs of marks. Distinct runs are merged once for the whole stream.
    Words with any other byte (apostrophes, most letters beyond Latin, special tokens) and very long runs go to the library
    as they are, which is exact since no token spans white space. Other tokenizers go to the library altogether.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        self.table = MergeTable.of(path)

    def _library(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(words), LIBRARY_WORDS):  # the library's own results are far larger than the ids
            out += [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[at : at + LIBRARY_WORDS]], add_special_tokens=False)]
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and their number in each text."""
        if self.table is None:
            found = self._library(texts)
            return np.array([i for ids in found for i in ids], self.dtype), np.fromiter(map(len, found), np.int64, len(found))
        stream = b"\n".join([*texts, b""])
        raw = np.frombuffer(stream, np.uint8)
        kind, low = (np.frombuffer(bytearray(stream.translate(table)), np.uint8) for table in (_KIND, _LOWER))
        lead = np.flatnonzero(raw == 0xC3)
        follow = raw[lead + 1]
        fine = (follow >= 0x80) & (follow != 0x97) & (follow != 0xB7)
        lead, follow = lead[fine], follow[fine]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead[follow <= 0x9E] + 1] += 0x20
        solid = kind != _SPACE
        before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
        begins = solid & ((kind != before) | (kind == _DIGIT))
        word_begins = np.flatnonzero(solid & (before == _SPACE))
        # words that hold an odd byte, or a run that is too long, are one run for the library
        runs = np.flatnonzero(begins)
        ends = np.flatnonzero(solid & np.concatenate((begins[1:] | ~solid[1:], [True]))) + 1
        odd = np.concatenate((np.flatnonzero(kind == _ODD), runs[ends - runs > LONGEST]))
        odd_words = np.unique(np.searchsorted(word_begins, odd, side="right") - 1)
        odd_at = word_begins[odd_words]
        if len(odd_at):
            next_begin = np.append(word_begins, len(raw))[odd_words + 1]
            for a, b in zip(odd_at.tolist(), next_begin.tolist()):
                begins[a + 1 : b] = False
            runs = np.flatnonzero(begins)
            ends = np.flatnonzero(solid & np.concatenate((begins[1:] | ~solid[1:], [True]))) + 1
        if not len(runs):
            return np.empty(0, self.dtype), np.zeros(len(texts), np.int64)
        sizes = ends - runs
        library = np.zeros(len(runs), bool)
        library[np.searchsorted(runs, odd_at)] = True
        hashes, check = _run_hashes(low[solid], sizes)
        hashes[library] = np.arange(int(library.sum()), dtype=np.uint64)  # never merged; each gets a code of its own below
        codes, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        library |= check != check[first[codes]]  # a run whose first hash is another's by chance
        plain = np.flatnonzero(~library[first])
        ids, at, counts = np.empty(0, np.int32), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        ids, at[plain], counts[plain] = self.table.merge(low, runs[first[plain]], sizes[first[plain]])
        at, counts = at[codes], counts[codes]
        if library.any():
            rows = np.flatnonzero(library)
            found = self._library([stream[a:b] for a, b in zip(runs[rows].tolist(), ends[rows].tolist())])
            counts[rows] = [len(f) for f in found]
            at[rows] = len(ids) + np.cumsum(counts[rows]) - counts[rows]
            ids = np.concatenate((ids, np.array([i for f in found for i in f], np.int32)))
        done = np.cumsum(counts)
        places = np.repeat(at - (done - counts), counts)
        places += np.arange(len(places))
        flat = ids.astype(self.dtype)[places]
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        upto = np.concatenate(([0], done))[np.searchsorted(runs, text_ends)]
        return flat, np.diff(np.concatenate(([0], upto)))


def _run_hashes(letters: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each of the runs that letters holds one after the other, made for about HASHED_BYTES at a time."""
    offsets = np.cumsum(sizes) - sizes
    out = [np.empty(len(sizes), np.uint64) for _ in _POWERS]
    cuts = np.unique(np.append(np.searchsorted(offsets, np.arange(0, len(letters), HASHED_BYTES)), len(sizes)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        own, n = offsets[a:b] - offsets[a], sizes[a:b]
        part = letters[offsets[a] : offsets[a] + n.sum()].astype(np.uint64) + np.uint64(1)
        place = np.minimum(np.arange(len(part)) - np.repeat(own, n), LONGEST - 1)
        for hashes, powers in zip(out, _POWERS):
            hashes[a:b] = np.add.reduceat(part * powers[place], own) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return out


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _spans(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about STREAM_BYTES together; a longer text has a range of its own."""
    a = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and total + n > STREAM_BYTES:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def tokenise(df: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, ids (packed), tokens and sig of every row, and one row per task with its document frequencies.

    kind is 0 for documents and 1 for the frequencies, which ids holds as packed 64-bit counts by token id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        df_counts = np.zeros(max(coder.vocabulary, end_id + 1), np.int64)
        seen = np.zeros(len(df_counts), bool)
        for whole in batches:
            ids_of, texts_of = whole.column(0), whole.column(1)
            for a, b in _spans(np.array(pc.binary_length(texts_of).to_numpy(zero_copy_only=False))):
                flat, sizes = coder.encode(texts_of.slice(a, b - a).to_pylist())
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                ids = np.full(int(ends[-1]), end_id, coder.dtype)
                inner = np.ones(len(ids), bool)
                inner[ends - 1] = False
                ids[inner] = flat
                pairs = ids.astype(np.uint32)
                pairs[:-1] = (pairs[:-1] * np.uint32(65599) + pairs[1:]) * np.uint32(2654435761)
                pairs ^= pairs >> np.uint32(15)
                pairs[ends[:-1] - 1] = 0xFFFFFFFF  # the pair of a text's last id and the next text's first
                sigs = np.minimum.reduceat(pairs, ends - sizes).astype(np.int64)
                for start, stop in zip((ends - sizes).tolist(), ends.tolist()):
                    own = ids[start:stop]
                    seen[own] = True
                    distinct = np.flatnonzero(seen)
                    seen[distinct] = False
                    df_counts[distinct] += 1
                width = coder.dtype.itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], ends * width)).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(sizes), np.int32)), ids_of.slice(a, b - a), packed, pa.array(sizes), pa.array(sigs)],
                    names=["kind", "doc_id", "ids", "tokens", "sig"],
                )
        yield pa.RecordBatch.from_arrays(
            [pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([df_counts.tobytes()], pa.binary()), pa.array([0], pa.int64()), pa.array([0], pa.int64())],
            names=["kind", "doc_id", "ids", "tokens", "sig"],
        )

    narrow = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return in_arrow(narrow, run, "kind int, doc_id long, ids binary, tokens long, sig long")


def document_frequencies(tokenised: DataFrame) -> np.ndarray:
    """Document frequency by token id over all documents; one row per token of the vocabulary comes to the driver."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = sum(np.frombuffer(x.as_py(), np.int64) for x in batch.column(0))
            if np.ndim(total):
                ids = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["token", "n"])

    rows = in_arrow(tokenised.filter("kind = 1").select("ids"), spread, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["token"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r["token"]] = r["n"]
    return out


@dataclass
class Bm25:
    """An inverted index over token ids of one shard's documents."""

    weights: np.ndarray  # by posting, ordered by document
    terms: np.ndarray
    bounds: np.ndarray  # of each document in the above
    docs: np.ndarray  # by posting, ordered by term
    by_term: np.ndarray  # the same postings' weights
    starts: np.ndarray  # of each term in the above

    @classmethod
    def build(cls, ids: np.ndarray, owner: np.ndarray, documents: int, idf: np.ndarray, mean_tokens: float) -> Bm25:
        keys = owner.astype(np.uint64)  # changed in place: it is the largest array of a shard
        keys <<= np.uint64(32)
        keys |= ids.astype(np.uint64)
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        tf = np.diff(np.append(first, len(keys)))
        docs, terms = (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sizes = np.bincount(owner, minlength=documents)
        weights = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[docs] / mean_tokens))
        order = np.argsort(terms, kind="stable")
        return cls(weights, terms, np.searchsorted(docs, np.arange(documents + 1)), docs[order], weights[order], np.searchsorted(terms[order], np.arange(len(idf) + 1)))

    def scores(self, document: int, documents: int) -> np.ndarray:
        """BM25 scores of all documents for all terms of one."""
        a, b = self.bounds[document], self.bounds[document + 1]
        terms = self.terms[a:b]
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in terms]
        if not spans:
            return np.zeros(documents)
        return np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.by_term[s] for s in spans]), documents)


def ranked(scores: np.ndarray, first: int = 32) -> Iterator[int]:
    """Documents with a score, highest first, ties in order; sorts beyond the first few only when asked."""
    found = np.flatnonzero(scores > 0)
    if len(found) > first:
        least = np.partition(scores[found], len(found) - first)[len(found) - first]
        top = found[scores[found] > least]
        yield from top[np.argsort(-scores[top], kind="stable")].tolist()
        found = found[scores[found] <= least]
    yield from found[np.argsort(-scores[found], kind="stable")].tolist()


def plan_shard(sizes: np.ndarray, index: Bm25, window: int) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) that cover every token of a shard's documents once."""
    n = len(sizes)
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for d in np.flatnonzero(sizes >= window):
        for start in range(0, int(sizes[d]) // window * window, window):
            out.append((int(d), start, window, sequence, 0))
            sequence += 1
    left = sizes % window
    unused = left > 0
    at, rest = 0, -1

    def place(d: int, gap: int) -> int:
        length = min(int(left[d]), gap)
        out.append((d, int(sizes[d] - left[d]), length, sequence, window - gap))
        left[d] -= length
        if not left[d]:
            unused[d] = False
        return gap - length

    while True:
        if rest < 0:
            while at < n and not unused[at]:
                at += 1
            if at == n:
                break
        seed, rest = (rest if rest >= 0 else at), -1
        gap = place(seed, window)
        if gap:
            scores = index.scores(seed, n)
            scores[~unused] = 0
            for d in ranked(scores):
                gap = place(int(d), gap)
                if not gap:
                    rest = int(d) if left[d] else -1
                    break
        while gap:  # nothing alike is left: the next unused documents
            while at < n and not unused[at]:
                at += 1
            if at == n:
                break
            gap = place(at, gap)
            if not gap and left[at]:
                rest = at
        sequence += 1
    return np.array(out, np.int64).reshape(-1, 5)


def cut_shards(buckets: list[tuple[int, int]], shard_tokens: int) -> tuple[list[tuple[int, int, int]], int]:
    """(bucket, first shard, shards) for each of (bucket, tokens), and the number of shards.

    Neighbouring buckets share a shard as long as it holds them; one with more tokens than a shard is dealt to several of its own.
    """
    out, shard, filled = [], 0, 0
    for bucket, tokens in sorted(buckets):
        if filled and filled + tokens > shard_tokens:
            shard, filled = shard + 1, 0
        if tokens > shard_tokens:
            parts = -(-tokens // shard_tokens)
            out.append((bucket, shard, parts))
            shard += parts
        else:
            out.append((bucket, shard, 1))
            filled += tokens
    return out, shard + (filled > 0)


def with_shards(docs: DataFrame, shard_tokens: int) -> tuple[DataFrame, int]:
    """docs with shard, digest and place, and the number of shards.

    Shards are ranges of sig in BUCKETS fixed buckets, cut by the buckets' tokens alone; documents of a bucket that needs several go by their
    digest and place, the number of their part and row in the table of tokens. So a document's shard, and its order in it, depend on the
    documents and their order in the input only.
    """
    bucket = F.floor(F.log2(F.col("sig") + 1) * (BUCKETS // 32)).cast("int").alias("bucket")
    place = F.xxhash64(F.regexp_extract("_metadata.file_name", "^part-[0-9]+", 0), "_metadata.row_index").alias("place")
    known = docs.select(bucket, "sig", F.xxhash64("doc_id", "ids").alias("digest"), place, "doc_id", "ids", "tokens")
    sizes = docs.groupBy(bucket).agg(F.sum("tokens").alias("n")).collect()  # BUCKETS rows at most
    cut, shards = cut_shards([(r["bucket"], r["n"]) for r in sizes], shard_tokens)
    where = F.broadcast(few_rows(docs.sparkSession, cut, "bucket int, first long, parts long"))  # BUCKETS rows at most
    shard = (F.col("first") + F.pmod(F.xxhash64("digest", "place"), F.col("parts"))).alias("shard")
    return known.join(where, "bucket").select(shard, "sig", "digest", "place", "doc_id", "ids", "tokens"), shards


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of every row of df (doc_id, text): doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and end_id; ids holds a piece's as little-endian unsigned 32-bit
    integers. A null text counts as empty, so its document is end_id alone. Every id lies in exactly one piece, offsets
    in a sequence are gapless from 0, and no sequence is longer than the window. Repeated rows and rows with a null
    doc_id are packed like any other. Neighbours with equal scores come in the order of their place in the shard. Packing the same df again
    gives the same rows. Texts are read whole; one longer than a shard takes one alone or with few others. An empty df gives an empty
    result. Other columns are ignored.
    """
    tokenised = written(tokenise(df, tokenizer_path, end_id), "tokens")
    dtype = encoder(tokenizer_path).dtype.str
    frequency = document_frequencies(tokenised)
    docs = tokenised.filter("kind = 0")
    total, count = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    idf = np.log(1 + (count - frequency + 0.5) / (frequency + 0.5))
    mean_tokens = total / max(1, count)
    placed, shards = with_shards(docs, shard_tokens)
    tasks = min(max(1, shards), MOST_TASKS)
    ordered = placed.repartitionByRange(tasks, "shard").sortWithinPartitions("shard", "sig", "digest", "place")

    def fill_windows(doc_ids: pa.Array, packed: list[bytes], sizes: np.ndarray, base: int) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(packed), dtype)
        starts = np.cumsum(sizes) - sizes
        index = Bm25.build(ids, np.repeat(np.arange(len(sizes)), sizes), len(sizes), idf, mean_tokens)
        d, start, length, sequence, offset = plan_shard(sizes, index, window).T
        first = starts[d] + start
        pieces = [ids[a : a + n].astype("<u4").tobytes() for a, n in zip(first, length)]
        columns = {
            "doc_id": doc_ids.take(pa.array(d)),
            "start": pa.array(start),
            "length": pa.array(length),
            "ids": pa.array(pieces, pa.binary()),
            "doc_tokens": pa.array(sizes[d]),
            "sequence_id": pa.array(base + sequence),
            "offset": pa.array(offset),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc_ids, packed, sizes = -1, [], [], []
        for batch in batches:
            for shard, doc_id, value, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now and sizes:
                    yield fill_windows(pa.array(doc_ids, pa.int64()), packed, np.array(sizes, np.int64), now << 32)
                    doc_ids, packed, sizes = [], [], []
                now = shard
                doc_ids.append(doc_id)
                packed.append(value)
                sizes.append(tokens)
        if sizes:
            yield fill_windows(pa.array(doc_ids, pa.int64()), packed, np.array(sizes, np.int64), now << 32)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return in_arrow(ordered.select("shard", "doc_id", "ids", "tokens"), run, schema)


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
