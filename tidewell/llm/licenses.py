"""Licence scan: MinHash bands over overlapping text windows, then exact shingle containment.

Words are runs of letters and digits, lower-cased; shingles are WORDS of them in a row. Templates fall in classes by
their number of shingles, (M / 4, M]. For a class, windows of 3 * M shingles start every M shingles of each text, so some window
holds any whole occurrence that inserted words stretch over no more than 2 * M shingles. An occurrence with containment c of a template
with m shingles then has a Jaccard similarity of at least c * m / (3 * M + (1 - c) * m) with its window. Bands are single
MinHash values; their number is chosen so that the worst case of the class collides in at least one band with probability COLLIDE.

A template that a window of a text retrieves is verified over the whole text, by the exact share of its shingles. A place is a run of
its shingles within 2 * M shingles of the text that reaches the containment, without leading ones that return in it; of places that
overlap the first, the one with the greatest containment counts, then the shortest, and the search goes on behind it. So two
notices in a row are two places, and the result doesn't depend on how texts are dealt to tasks or batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.license_templates import TEMPLATES
from tidewell.llm.shared import in_arrow, text_or_empty

WORDS = 5
CONTAINMENT = 0.8
COLLIDE = 0.9995
WINDOWS = 3  #: size of a window, in the greatest number of shingles of its class
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.array([pow(16777619, i, 1 << 32) for i in range(4096)], np.uint32)


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a text."""
    low = _LOWER[np.frombuffer(text, np.uint8)]
    inside = _IN_WORD[low]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint32)
    owner = np.repeat(starts, np.diff(np.append(starts, len(low))))
    place = (np.arange(starts[0], len(low)) - owner) & 4095
    part = np.where(inside[starts[0] :], low[starts[0] :].astype(np.uint32) * _POWERS[place], np.uint32(0))
    hashes = np.add.reduceat(part, starts - starts[0], dtype=np.uint32)
    return starts, ends, _mix(hashes)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    if len(words) < size:
        return np.empty(0, np.uint32)
    out = np.zeros(len(words) - size + 1, np.uint32)
    for i in range(size):
        out = out * np.uint32(0x9E3779B1) + words[i : len(words) - size + 1 + i]
    return _mix(out)


class TemplateIndex:
    """Templates by class with the MinHash values of their bands."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT, collide: float = COLLIDE):
        self.containment = containment
        self.names = sorted(templates)
        self.sets: list[frozenset] = []
        self.bytes = {name: len(" ".join(t.split())) for name, t in templates.items()}
        hashes = []
        for name in self.names:
            text = templates[name].encode()
            words = WORD.findall(text.lower())
            if len(words) < WORDS:
                raise ValueError(f"template {name} has fewer than {WORDS} words")
            self.sets.append(frozenset(tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)))
            hashes.append(shingle_hashes(word_spans(text)[2]))
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            top = 1
            while top < len(s):
                top *= 4
            classes.setdefault(top, []).append(i)
        self.classes = []
        for top, members in sorted(classes.items()):
            least = min(len(self.sets[i]) for i in members)
            similarity = containment * least / (WINDOWS * top + (1 - containment) * least)
            self.classes.append((top, members, ceil(log(1 - collide) / log(1 - similarity))))
        rng = np.random.default_rng(7)
        most = max((bands for _, _, bands in self.classes), default=0)
        self.factors = (rng.integers(0, 1 << 31, most, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.masks = rng.integers(0, 1 << 32, most, dtype=np.uint32)
        self.hashes = [np.unique(h) for h in hashes]
        self.reach = {i: (WINDOWS - 1) * top for top, members, _ in self.classes for i in members}
        self.values = [np.array([self._hash(h, j).min() for j in range(most)], np.uint32) for h in hashes]
        self.tables = []
        for _, members, bands in self.classes:
            table = np.zeros((bands, 1 << 16), bool)
            for i in members:
                table[np.arange(bands), self.values[i][:bands] >> np.uint32(16)] = True
            self.tables.append(table)

    def _hash(self, h: np.ndarray, j: int) -> np.ndarray:
        return (h ^ self.masks[j]) * self.factors[j]

    def candidates(self, shingles: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(text, template) of windows that share a band with a template; the texts' shingles begin and number as given."""
        out: set[tuple[int, int]] = set()
        if not counts.sum():
            return out
        apart = np.ones(len(shingles), bool)
        edges, owners = [], []
        for top, _, _ in self.classes:
            windows = -(-counts // top)
            owner = np.repeat(np.arange(len(counts)), windows)
            edges.append(begins[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * top)
            owners.append(owner)
        inner = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        apart[inner] = False
        spans = np.flatnonzero(apart)
        none = np.uint32(0xFFFFFFFF)
        for j in range(len(self.factors)):
            hashed = self._hash(shingles, j)
            hashed[spans] = none  # shingles that span two texts
            for (top, members, bands), edge, owner, table in zip(self.classes, edges, owners, self.tables):
                if j >= bands:
                    continue
                part = np.minimum.reduceat(hashed, edge)
                least = part.copy()
                for step in range(1, WINDOWS):
                    np.minimum(least[:-step], np.where(owner[step:] == owner[:-step], part[step:], none), out=least[:-step])
                for w in np.flatnonzero(table[j, least >> np.uint32(16)]):
                    for i in members:
                        if self.values[i][j] == least[w]:
                            out.add((int(owner[w]), i))
        return out

    def places(self, hits: list[tuple[int, tuple]], template: int) -> list[tuple[float, int, int]]:
        """(containment, first shingle, last shingle) of the places among the template's shingles (place, words) in a text."""
        out: list[tuple[float, int, int]] = []
        need, reach = self.containment * len(self.sets[template]), self.reach[template]
        start = 0
        while start < len(hits):
            held: dict[tuple, int] = {}
            left, first, best = start, None, None
            for right in range(start, len(hits)):
                at, words = hits[right]
                held[words] = held.get(words, 0) + 1
                while held[hits[left][1]] > 1 or at - hits[left][0] > reach:
                    held[hits[left][1]] -= 1
                    if not held[hits[left][1]]:
                        del held[hits[left][1]]
                    left += 1
                if first is not None and left > first:
                    break
                if len(held) >= need:
                    first = right if first is None else first
                    rank = -len(held), at - hits[left][0], left, right
                    best = rank if best is None else min(best, rank)
            if best is None:
                break
            out.append((-best[0] / len(self.sets[template]), hits[best[2]][0], hits[best[3]][0]))
            start = best[3] + 1
        return out

    def best_of_place(self, hits: list[tuple[str, float, int, int]]) -> list[bool]:
        """For each hit of a text whether no overlapping one is more like its template: shared bytes by those of either.

        Of equals the longest wins, then the first by name.
        """

        def rank(hit: tuple[str, float, int, int]) -> tuple:
            name, share, a, b = hit
            shared = share * self.bytes[name]
            return -round(shared / (self.bytes[name] + max(b - a, shared) - shared), 3), a - b, name

        ranks = [rank(h) for h in hits]
        return [not any(o[2] < h[3] and h[2] < o[3] and s < r for o, s in zip(hits, ranks)) for h, r in zip(hits, ranks)]

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, float, int, int]]]:
        """(template, containment, first byte, end byte) of the templates' places in each text, by template and place."""
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        stream = b"\n".join(texts)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        first_byte = np.cumsum(sizes) - sizes
        starts, ends, words = word_spans(stream)
        bounds = np.searchsorted(starts, np.append(first_byte, len(stream) + 1))
        counts = np.maximum(np.diff(bounds) - WORDS + 1, 0)
        shingles = shingle_hashes(words)
        for doc, i in sorted(self.candidates(shingles, bounds[:-1], counts)):
            first, n = int(bounds[doc]), int(counts[doc])
            hits = []
            for k in np.flatnonzero(np.isin(shingles[first : first + n], self.hashes[i])).tolist():
                own = tuple(stream[a:b].lower() for a, b in zip(starts[first + k : first + k + WORDS].tolist(), ends[first + k : first + k + WORDS].tolist()))
                if own in self.sets[i]:
                    hits.append((k, own))
            for share, a, b in self.places(hits, i):
                out[doc].append((self.names[i], share, int(starts[first + a] - first_byte[doc]), int(ends[first + b + WORDS - 1] - first_byte[doc])))
        return out


STREAM_BYTES = 1 << 20  #: texts are scanned together up to this size; a longer text is scanned alone


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, start_byte, end_byte and best of every notice found in the whole texts of df (doc_id, text).

    One row for each template and place; best marks the row that is most like its template among those that overlap it, since
    licences of one family share wordings. A text without a match, a null or an empty one gives no row. Very long texts are read
    whole, each by itself. Repeated rows give repeated results; a null doc_id is kept; an empty df gives an empty result; other
    columns are ignored.
    """
    index = TemplateIndex(templates or TEMPLATES, containment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, texts, held = [], [], [], 0
            pairs = zip(batch.column(0).to_pylist(), batch.column(1))
            for doc_id, value in [*pairs, (None, None)]:
                text = b"" if value is None else value.as_py()
                if texts and (value is None or held + len(text) > STREAM_BYTES):
                    for d, hits in zip(ids, index.scan(texts)):
                        rows.extend((d, *hit, best) for hit, best in zip(hits, index.best_of_place(hits)))
                    ids, texts, held = [], [], 0
                if value is not None:
                    ids.append(doc_id)
                    texts.append(text)
                    held += len(text)
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            names = ["doc_id", "license", "containment", "start_byte", "end_byte", "best"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    narrow = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return in_arrow(narrow, run, "doc_id long, license string, containment double, start_byte long, end_byte long, best boolean")
