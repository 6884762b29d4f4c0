"""Encoding to and decoding from the pieces of a SentencePiece merge model, with seeded merge-dropout.

A text is cut into units wherever no piece of the model holds the two characters side by side, so no merge can cross
such a place. In a unit, candidate merges wait in an agenda ordered by score, then position. With dropout, a candidate
that is taken from the agenda is skipped where a keyed hash of the seed, the variant, the unit and the candidate's span
falls below the rate. In encode_texts every occurrence of a unit has a variant of its own, a hash of the document's identifier and
the unit's place in it, so that the forms of a word grow with its occurrences, reproducibly. Many texts are cut as one stream
of characters, and units of equal variant are merged once.

Without dropout the ids are those of the model's own encoder. Characters outside the vocabulary become byte pieces, as
does a literal U+2581, so that decoding restores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.merging import NONE, PAD, PairTable, merge_rows
from tidewell.llm.shared import in_arrow

SPACE = "▁"
STREAM_CHARS = 1 << 21  #: texts are encoded together up to this size
LONGEST = 48  #: longer units are merged one at a time
NEAR = 512  #: pairs of characters below this code point have a table of their own
_M64 = (1 << 64) - 1

_POWERS = np.array([[pow(base, i, 1 << 64) for i in range(LONGEST)] for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)], np.uint64)

_coders: dict = {}


class PieceCoder:
    """Encoder and decoder over the pieces of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.raw: list[bytes] = []
        self.bytes: list[int] = [0] * 256
        scores: dict[str, float] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                text = piece.replace(SPACE, " ")
                if " " in text.lstrip(" ") or "\n" in text:
                    raise ValueError(f"piece {piece!r} crosses units")
                self.ids[text] = i
                scores[text] = model.get_score(i)
                self.raw.append(text.encode())
        order = sorted(scores, key=lambda t: (-scores[t], self.ids[t]))
        self.ranks, rank, before = {}, -1, None
        for text in order:  # equal scores share a rank, so that position decides
            rank += scores[text] != before
            before = scores[text]
            self.ranks[text] = rank
        inner = {t[i : i + 2] for t in self.ranks for i in range(len(t) - 1)}
        # symbols of the merging engine: pieces by id, other characters of merges after them
        self.symbols = dict(self.ids)
        for c in sorted({c for t in self.ranks for c in t} - self.symbols.keys()):
            self.symbols[c] = size + len(self.symbols.keys() - self.ids.keys())
        self.symbol_of = np.full((1 << 16) + 1, PAD, np.int32)  # the last place is that of all further characters
        for c, i in self.symbols.items():
            if len(c) == 1 and ord(c) < len(self.symbol_of) - 1:
                self.symbol_of[ord(c)] = i
        pairs, ranks, merged = [], [], []
        for text, r in self.ranks.items():
            if text.startswith("  "):  # runs of spaces have equal scores; units with one are merged alone
                continue
            for i in range(1, len(text)):
                x, y = self.symbols.get(text[:i]), self.symbols.get(text[i:])
                if x is not None and y is not None:
                    pairs.append(x << 16 | y)
                    ranks.append(r)
                    merged.append(self.ids[text])
        self.table = PairTable(np.array(pairs, np.uint32), np.array(ranks, np.int32), np.array(merged, np.int32))
        cells = [(self.symbols.get(t[0]), self.symbols.get(t[1]), t) for t in inner]
        pairs = np.array([x << 16 | y for x, y, _ in cells if x is not None and y is not None], np.uint32)
        self.inner = PairTable(pairs, np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int32))
        self.near = np.zeros((NEAR, NEAR), bool)
        for _, _, t in cells:
            if ord(t[0]) < NEAR and ord(t[1]) < NEAR:
                self.near[ord(t[0]), ord(t[1])] = True
        self.size = size

    def cut(self, unit: str, key: int = 0, limit: int = 0) -> list[str]:
        """The pieces of a unit; a span is skipped where its keyed 32-bit hash is below limit."""
        n = len(unit)
        ranks = self.ranks
        agenda = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(unit[i : i + 2])) is not None]
        if not agenda:
            return list(unit)
        heapify(agenda)
        ends, starts = list(range(1, n + 1)), list(range(-1, n))
        ends.append(0)
        while agenda:
            _, left, right = heappop(agenda)
            middle = ends[left]
            if not 0 < middle < right or ends[middle] != right:
                continue
            if limit:
                mixed = ((key ^ (left * 0x9E3779B97F4A7C15 + right * 0xC2B2AE3D27D4EB4F)) * 0xD6E8FEB86659FD93) & _M64
                if ((mixed ^ (mixed >> 29)) * 0xD6E8FEB86659FD93 & _M64) >> 32 < limit:
                    continue
            ends[left], ends[middle], starts[right] = right, 0, left
            if left:
                before = starts[left]
                if (r := ranks.get(unit[before:right])) is not None:
                    heappush(agenda, (r, before, right))
            if right < n:
                after = ends[right]
                if (r := ranks.get(unit[left:after])) is not None:
                    heappush(agenda, (r, left, after))
        out, at = [], 0
        while at < n:
            out.append(unit[at : ends[at]])
            at = ends[at]
        return out

    def one(self, unit: str, seed: int = 0, variant: int = 0, limit: int = 0) -> list[int]:
        """Ids of a unit, merged by itself."""
        key = 0
        if limit:
            letters = np.array([ord(c) for c in unit], np.uint64)
            key = int(_keys(_sums(letters, np.arange(len(letters)), np.zeros(1, np.int64), np.array([len(letters)]), 0), seed, np.array([variant]))[0])
        out = []
        for p in [unit] if unit == SPACE else self.cut(unit, key, limit):
            i = self.ids.get(p) if p != SPACE else None
            out.extend([i] if i is not None else [self.bytes[b] for b in p.encode()])
        return out

    def encode_many(self, texts: list[str], rate: float = 0.0, seed: int = 0, variants: list[int] | None = None, each: bool = False) -> list[np.ndarray]:
        """Ids of whole texts; variants holds that of each text, from which with each every unit derives its own."""
        limit = int(rate * (1 << 32))
        stream = "".join([" " + t if t else "" for t in texts])
        if not stream:
            return [np.empty(0, np.int32) for _ in texts]
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        letters = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
        symbols = self.symbol_of[np.minimum(letters, len(self.symbol_of) - 1)]
        begins = np.ones(len(letters), bool)
        small = np.minimum(letters, NEAR - 1).astype(np.int64)
        begins[1:] = ~self.near[small[:-1], small[1:]]
        far = np.flatnonzero((letters[1:] >= NEAR - 1) | (letters[:-1] >= NEAR - 1))
        begins[far + 1] = self.inner.find(symbols[far], symbols[far + 1]) == NONE
        text_begins = (np.cumsum(lengths) - lengths)[lengths > 0]
        begins[text_begins] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(letters)))
        place = np.minimum(np.arange(len(letters)) - np.repeat(starts, sizes), LONGEST - 1)
        wide = letters.astype(np.uint64)
        hashes, check = (_sums(wide, place, starts, sizes, which) for which in (0, 1))
        variant = np.zeros(len(starts), np.int64)
        if limit and variants is not None:
            firsts = np.searchsorted(starts, text_begins)
            units = np.diff(np.append(firsts, len(starts)))
            variant = np.repeat(np.array(variants, np.int64)[lengths > 0], units)
            if each:
                variant = _occurrences(variant, np.arange(len(starts)) - np.repeat(firsts, units))
                variant[sizes == 1] = 0  # nothing to skip
        codes, distinct = pd.factorize(hashes + variant.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        # what is merged alone: characters of no merge, long units, runs of spaces, and hashes that are equal by chance
        alone = (symbols[starts] == PAD) | (sizes > LONGEST) | ((sizes > 1) & (letters[starts] == 32) & (letters[np.minimum(starts + 1, len(letters) - 1)] == 32))
        alone |= (check != check[first[codes]]) | (variant != variant[first[codes]])
        ids, at, counts = np.empty(0, np.int32), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        plain = np.flatnonzero(~alone[first])
        ids, at[plain], counts[plain], fine = self._merge(symbols, starts[first[plain]], sizes[first[plain]], _keys(hashes[first[plain]], seed, variant[first[plain]]) if limit else None, limit)
        broken = np.zeros(len(distinct), bool)
        broken[plain] = ~fine  # a character outside the vocabulary is left
        alone |= broken[codes]
        at, counts = at[codes], counts[codes]
        if alone.any():
            rows, memo, more, known = np.flatnonzero(alone), {}, [], len(ids)
            for i in rows.tolist():
                key = stream[starts[i] : starts[i] + sizes[i]], int(variant[i])
                if key not in memo:
                    own = self.one(key[0], seed, key[1], limit)
                    memo[key] = known, len(own)
                    more.extend(own)
                    known += len(own)
                at[i], counts[i] = memo[key]
            ids = np.concatenate((ids, np.array(more, np.int32)))
        done = np.cumsum(counts)
        flat = ids[np.repeat(at - (done - counts), counts) + np.arange(int(done[-1]))]
        upto = np.concatenate(([0], done))[np.searchsorted(starts, np.cumsum(lengths))]
        return np.split(flat, upto[:-1])

    def _merge(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None, limit: int) -> tuple:
        """Ids of units, one unit after the other, with each unit's first place, number of ids and whether all are pieces."""
        order, found, at_id = np.argsort(sizes, kind="stable"), [], 0
        first, counts, fine = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), np.ones(len(sizes), bool)
        for at in range(0, len(order), 2048):
            part = order[at : at + 2048]
            places = np.arange(int(sizes[part[-1]]))[None, :]
            square = np.where(places < sizes[part][:, None], symbols[np.minimum(starts[part][:, None] + places, len(symbols) - 1)], PAD)
            ids, number = merge_rows(self.table, square, keys[part] if limit else None, limit)
            found.append(ids)
            counts[part] = number
            first[part] = at_id + np.cumsum(number) - number
            fine[part] = np.logical_and.reduceat(ids < self.size, np.cumsum(number) - number)
            at_id += len(ids)
        return np.concatenate(found) if found else np.empty(0, np.int32), first, counts, fine

    def encode(self, text: str, rate: float = 0.0, seed: int = 0, variant: int = 0) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_many([text], rate, seed, [variant])[0]

    def decode(self, ids) -> str:
        """The text of ids."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _sums(letters: np.ndarray, place: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: int) -> np.ndarray:
    """A hash of each unit's characters, from their places in it."""
    terms = (letters + np.uint64(1)) * _POWERS[which][np.minimum(place, LONGEST - 1)]
    return np.add.reduceat(terms, starts) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _occurrences(variant: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The variant of a text's unit by its place among the text's units."""
    mixed = (variant.astype(np.uint64) ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def _keys(hashes: np.ndarray, seed: int, variant: np.ndarray) -> np.ndarray:
    """Keys of the agenda's skips."""
    keys = hashes ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _M64) ^ (variant.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return keys ^ (keys >> np.uint64(32))


def _spans(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about STREAM_CHARS together; a longer text has a range of its own."""
    a = total = 0
    for i, t in enumerate(texts):
        if i > a and total + len(t or "") > STREAM_CHARS:
            yield a, i
            a, total = i, 0
        total += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def coder(path: str) -> PieceCoder:
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode_texts(df: DataFrame, model_path: str, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """doc_id, ids (array of int) and lossless (the ids decode to the text) of every row of df (doc_id, text).

    An empty text has no ids; a null text has null ids and a null lossless. Repeated rows are encoded alike; rows with a null doc_id share
    a key. Candidates of equal score merge from the left. A very long text is encoded whole, by itself. An empty df gives an empty
    result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model_path)
        for whole in batches:
            every = whole.column(1).to_pylist()
            for a, b in _spans(every):
                batch, texts = whole.slice(a, b - a), every[a:b]
                ids = batch.column(0).to_pylist()
                chosen = [0 if i is None else xxhash.xxh64_intdigest(str(i), seed & _M64) >> 1 for i in ids]
                found = own.encode_many([t or "" for t in texts], rate, seed, chosen, each=True)
                rows = [None if t is None else r for t, r in zip(texts, found)]
                lossless = [None if t is None else own.decode(r.tolist()) == t for t, r in zip(texts, found)]
                sizes = np.array([0 if r is None else len(r) for r in rows], np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                values = np.concatenate([r for r in rows if r is not None] or [np.empty(0, np.int32)])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([r is None for r in rows]))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(lossless, pa.bool_())], names=["doc_id", "ids", "lossless"])

    return in_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>, lossless boolean")


def decode_ids(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of every row of df (doc_id, ids).

    Null ids give a null text, no ids an empty one; ids are decoded whole, however many. Repeated rows stay repeated, a null doc_id is
    kept, an empty df gives an empty result, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [None if ids.as_py() is None else own.decode(ids.values.to_numpy(zero_copy_only=False).tolist()) for ids in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return in_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")
