"""SimHash near-duplicates: fingerprints, pigeonring candidates, Hamming links and components.

A fingerprint has one bit for the majority of each bit of the hashes of a text's word shingles. Two distinct
fingerprints link when at most max_bits bits differ. The 64 bits are cut into a ring of 3 * max_bits segments. By the
pigeonring principle a linked pair has a start from which every chain of l consecutive segments differs in at
most l * max_bits / segments bits, so at least the first two segments of that chain are equal. Pairs are joined on
(start, value of these two segments), pruned by the budget of every longer chain and then checked in full.

A bucket of that join which holds more than bucket_limit distinct fingerprints is not paired. Its members get an
exact linear path: each emits itself and its neighbours within half of max_bits, and fingerprints that share such
a point are linked to the least of them. With two bits this is complete (a pair at distance 2 shares a point at
distance 1 from both) and sound (two members at distance 1 from a point differ in 2 bits at most).

Two bits of one fingerprint find few of the texts with a similarity of 0.8, so without_near_copies takes many short views: VIEW_BITS
bits each over two-word shingles, on a ring of three segments with a budget of one bit. By the pigeonring two neighbouring
segments are then equal, and a bucket of these holds 2 ** 16 fingerprints at most, whatever the texts; with the chain's next half
segment 2 ** 8, which are paired and checked in full. What the views link are candidates only: texts become copies by the exact
similarity of their five-word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.components import components
from tidewell.llm.shared import in_arrow, text_or_empty, written

BITS = 64
SEED = 42
PART_BITS = 44  #: at least the width of two segments
NEAR_WORDS = 5
VIEWS, VIEW_WORDS, VIEW_BITS = 48, 2, 48
SEGMENT = VIEW_BITS // 3
HALF = SEGMENT // 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.multiply.accumulate(np.full(256, _BASE, np.uint64))
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
PIVOT_ROUNDS = 4
MARKS = 8  #: longs of the parity marks of a set of shingles


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased text, repeats included; fewer words than asked for: all as one."""
    found = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    n = len(found)
    if n == 0:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    hashed = xxhash.xxh64_intdigest
    if n <= words:
        return np.array([hashed(line, SEED)], np.uint64)
    ends = list(accumulate(map(len, found), lambda at, size: at + 1 + size))
    starts = [0, *(e + 1 for e in ends[: n - words])]
    return np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])), np.uint64, n - words + 1)


def ngram_hashes(text: bytes, words: int) -> np.ndarray:
    """64-bit hashes of every run of so many words, cut as shingle_hashes cuts them, by array operations on the whole text."""
    global _powers
    low = np.frombuffer(text.lower(), np.uint8)
    inside = ~_BLANK[low]
    edge = np.diff(np.concatenate((np.zeros(1, np.int8), inside.view(np.int8), np.zeros(1, np.int8))))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    if (longest := int(sizes.max())) > len(_powers):
        _powers = np.multiply.accumulate(np.full(2 * longest, _BASE, np.uint64))
    offsets = np.cumsum(sizes) - sizes
    place = np.arange(int(offsets[-1] + sizes[-1])) - np.repeat(offsets, sizes)
    own = np.add.reduceat((low[inside].astype(np.uint64) + np.uint64(1)) * _powers[place], offsets)
    own = _mixed(own + sizes.astype(np.uint64), np.uint64(0))
    words = min(words, len(own))
    out = np.zeros(len(own) - words + 1, np.uint64)
    for i in range(words):
        out = _mixed(out + own[i : len(own) - words + 1 + i], np.uint64(i + 1))
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """The majority bits of the hashes as an unsigned integer; zero without hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    if n <= 255:
        counts = np.add.reduce(bits, axis=0, dtype=np.uint8).astype(np.int64)
    else:
        counts = np.zeros(BITS, np.int64)
        for at in range(0, n, 255):
            counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def view_hashes(hashes: np.ndarray, view: int) -> np.ndarray:
    """The hashes as an independent view sees them; view 0 sees them as they are."""
    return hashes if view == 0 else _mixed(hashes, np.uint64(view))


def _mixed(hashes: np.ndarray, view) -> np.ndarray:
    mixed = (hashes + view) * np.multiply(_BASE, np.asarray(2 * view + np.uint64(1)).reshape(np.shape(view) or 1))
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xA24BAED4963EE407)
    return mixed


def view_fingerprints(hashes: np.ndarray, views: int) -> np.ndarray:
    """The VIEW_BITS majority bits of the hashes in each view, as signed longs; zeros without hashes."""
    n, width = len(hashes), VIEW_BITS // 8
    counts = np.zeros(views * VIEW_BITS, np.int64)
    for at in range(0, n, 255):
        mixed = _mixed(hashes[at : at + 255, None], np.arange(1, views + 1, dtype=np.uint64)[None, :])
        raw = np.ascontiguousarray(mixed).view(np.uint8).reshape(-1, views, 8)[:, :, :width]
        bits = np.unpackbits(raw.reshape(len(raw), views * width), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    packed = np.packbits(2 * counts > n, bitorder="little").reshape(views, width)
    return np.pad(packed, ((0, 0), (0, 8 - width))).view(np.int64)[:, 0]


def _node():
    """The node of a row: a 64-bit hash of its text, so that equal texts are one node."""
    return F.xxhash64(text_or_empty()).alias("node")


def with_fingerprints(df: DataFrame, words: int = 3, views: int = 1) -> DataFrame:
    """doc_id, node, fp (the first of fps) and fps (for each view the fingerprint's 64 bits as a signed long) of every row of df (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty((batch.num_rows, views), np.uint64)
            for i, t in enumerate(batch.column(1)):
                hashes = shingle_hashes(t.as_py(), words)
                found[i] = [fingerprint(view_hashes(hashes, v)) for v in range(views)]
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * views)
            fps = pa.ListArray.from_arrays(offsets, pa.array(found.view(np.int64).ravel()))
            first = pa.array(np.ascontiguousarray(found.view(np.int64)[:, 0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), first, fps], names=["doc_id", "node", "fp", "fps"])

    narrow = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), _node())
    return in_arrow(narrow, run, "doc_id long, node long, fp long, fps array<long>")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def ring(segments: int) -> list[int]:
    """Masks of consecutive segments of near-equal width that cover the 64 bits."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _chains(max_bits: int, segments: int) -> list[list[tuple[int, int]]]:
    """For each start, (mask, budget) of the chains whose budget the next longer chain does not imply."""
    masks, out = ring(segments), []
    for start in range(segments):
        chain, total = [], 0
        for length in range(1, segments + 1):
            total |= masks[(start + length - 1) % segments]
            budget = length * max_bits // segments
            if length == segments or budget < (length + 1) * max_bits // segments:
                chain.append((_signed(total), budget))
        out.append(chain)
    return out


def _bucket(segments: int, start: int):
    """One number for a view, a start and the value of its two segments: the slot above PART_BITS bits of the part."""
    low, width = BITS * start // segments, BITS * (start + 2) // segments - BITS * start // segments
    part = F.shiftrightunsigned("fp", low)
    if low + width > BITS:
        part = part.bitwiseOR(F.shiftleft("fp", BITS - low))
    return F.shiftleft((F.col("view") * segments + start).cast("long"), PART_BITS).bitwiseOR(part.bitwiseAND(F.lit((1 << width) - 1)))


def links(fps: DataFrame, max_bits: int = 2, bucket_limit: int = 64) -> DataFrame:
    """Edges (view, a, b) whose components are those of all pairs of distinct fps (view, fp) within max_bits bits."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2: the exact path of full buckets covers these")
    segments = 3 * max_bits
    chains = _chains(max_bits, segments)
    keyed = fps.select("fp", F.explode(F.array(*(_bucket(segments, i) for i in range(segments)))).alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    buckets = written(buckets.filter("n > 1"), "simhash-buckets")

    def slot(column: str):
        return F.shiftright(column, PART_BITS)

    def within(slot, a, b):
        differ, out = a.bitwiseXOR(b), F.lit(True)
        for at in range(len(chains[0])):
            mask = F.element_at(F.array(*(F.lit(c[at][0]) for c in chains)), (slot % segments + 1).cast("int"))
            out = out & (F.bit_count(differ.bitwiseAND(mask)) <= chains[0][at][1])
        return out

    view = F.floor(slot("key") / segments).cast("int").alias("view")
    twos = buckets.filter((F.col("n") == 2) & (bucket_limit >= 2)).filter(within(slot("key"), F.col("low"), F.col("high")))
    twos = twos.select(view, F.col("low").alias("a"), F.col("high").alias("b"))
    paired = keyed.join(buckets.filter((F.col("n") > 2) & (F.col("n") <= bucket_limit)).select("key"), "key", "left_semi")
    same = (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp"))
    near = paired.alias("l").join(paired.alias("r"), same & within(slot("l.key"), F.col("l.fp"), F.col("r.fp")))
    near = near.select(F.floor(slot("l.key") / segments).cast("int").alias("view"), F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    crowded = keyed.join(buckets.filter(F.col("n") > bucket_limit).select("key"), "key", "left_semi")
    return twos.unionByName(near).distinct().unionByName(_stars(crowded.select(view, "fp").distinct(), max_bits))


def _stars(fps: DataFrame, max_bits: int) -> DataFrame:
    """Each fp linked to the least one that shares a point with it; a point is shared by BITS + 1 fps at most."""
    if max_bits == 2:
        points = [F.struct(F.lit(-1).alias("bit"), (F.col("fp").bitwiseXOR(F.lit(_signed(1 << j))) if j < BITS else F.col("fp")).alias("point")) for j in range(BITS + 1)]
    else:
        points = [F.struct(F.lit(j).alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed(((1 << BITS) - 1) ^ (1 << j)))).alias("point")) for j in range(BITS)]
    spread = fps.select("view", "fp", F.explode(F.array(*points)).alias("p")).select("view", "fp", "p.*")
    least = F.min("fp").over(Window.partitionBy("view", "bit", "point"))
    return spread.select("view", F.col("fp").alias("a"), least.alias("b")).filter("a <> b").distinct()


def _linked(df: DataFrame, words: int, max_bits: int, bucket_limit: int, views: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, node, fp, fps), the nodes (node, fps, least doc_id) and the components (node, root) of linked nodes."""
    docs = written(with_fingerprints(df, words, views), "simhash-docs")
    nodes = written(docs.groupBy("node", "fps").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    seen = nodes.select("node", F.posexplode("fps").alias("view", "fp"))
    firsts = written(seen.groupBy("view", "fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-firsts")
    shared = seen.join(firsts.filter("n > 1"), ["view", "fp"]).select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = links(firsts.select("view", "fp"), max_bits, bucket_limit)
    for end in ("a", "b"):
        found = found.join(firsts.select("view", F.col("fp").alias(end), F.col("first").alias(f"node_{end}")), ["view", end])
    edges = shared.unionByName(found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    return docs, nodes, components(edges)


def _least(nodes: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with their roots, and the least doc_id of each root.

    Both come from tables, so that the join of the two by root deals a root that holds many nodes over several tasks.
    """
    rooted = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "simhash-rooted")
    return rooted, written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")


def simhash_groups(df: DataFrame, words: int = 3, max_bits: int = 2, bucket_limit: int = 64, views: int = 1) -> DataFrame:
    """doc_id, fingerprint (16 hex digits, of the first view) and component_id of every row of df (doc_id, text).

    component_id is the smallest doc_id that can be reached over links, the row's own included. Texts without words,
    null texts among them, have fingerprint zero and link like any other; rows with equal fingerprints share a
    component. Further views fingerprint the same shingles with other hashes, and two texts link when they do in any view,
    which finds more of the copies whose one fingerprint differs by a bit too many. Repeated rows stay repeated; null
    doc_ids are kept and never the smallest unless alone. An empty df gives an empty result. Other columns are ignored.
    """
    docs, nodes, roots = _linked(df, words, max_bits, bucket_limit, views)
    rooted, least = _least(nodes, roots)
    labels = written(rooted.join(least, "root").select("node", "component_id"), "simhash-labels")
    return docs.join(labels, "node").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_shingles(df: DataFrame, words: int = NEAR_WORDS) -> DataFrame:
    """root, node and hashes (of the text's distinct word shingles) of every row of df (root, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(ngram_hashes(t.as_py(), words)).view(np.int64) for t in batch.column(2)]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hashes], names=["root", "node", "hashes"])

    return in_arrow(df.select("root", "node", text_or_empty().cast("binary").alias("text")), run, "root long, node long, hashes array<long>")


def with_views(df: DataFrame, views: int = VIEWS) -> DataFrame:
    """doc_id, node and fps (VIEW_BITS bits for each view) of every row of df (doc_id, text).

    Each distinct shingle counts once, as in the similarity that verifies: long texts of one vocabulary would else be alike in their common shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [view_fingerprints(np.unique(ngram_hashes(t.as_py(), VIEW_WORDS)), views) for t in batch.column(1)]
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * views)
            fps = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*found, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fps], names=["doc_id", "node", "fps"])

    narrow = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), _node())
    return in_arrow(narrow, run, "doc_id long, node long, fps array<long>")


def view_links(firsts: DataFrame) -> DataFrame:
    """Edges (a, b) between the nodes of distinct firsts (view, fp, first) whose fingerprints differ in one bit of a view.

    A bucket is a view, the start of two neighbouring segments and their value; its fingerprints differ in the third segment alone. The
    chain goes on by half segments: one half of the third is equal too, so 2 ** HALF fingerprints at most are paired and checked in full.
    """
    keys = []
    for start in range(3):
        low = SEGMENT * start
        part = F.shiftrightunsigned("fp", low)
        if start == 2:
            part = part.bitwiseOR(F.shiftleft("fp", SEGMENT))
        slot = F.shiftleft((F.col("view") * 3 + start).cast("long"), 2 * SEGMENT)
        keys.append(slot.bitwiseOR(part.bitwiseAND(F.lit((1 << 2 * SEGMENT) - 1))))
    keyed = firsts.select("fp", "first", F.explode(F.array(*keys)).alias("key"))
    counted = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    shared = written(counted.filter("n > 1").drop("n"), "view-buckets")
    third = (F.shiftright("key", 2 * SEGMENT) + 2) % 3 * SEGMENT  # where the third segment begins
    part = F.call_function("shiftrightunsigned", F.col("fp"), third.cast("int"))
    halves = [F.struct(F.lit(i).alias("half"), F.shiftrightunsigned(part, HALF * i).bitwiseAND(F.lit((1 << HALF) - 1)).alias("same")) for i in (0, 1)]
    halved = shared.select("key", "fp", "first", F.inline(F.array(*halves)))
    alike = (F.col("l.key") == F.col("r.key")) & (F.col("l.half") == F.col("r.half")) & (F.col("l.same") == F.col("r.same"))
    near = alike & (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) == 1)
    return halved.alias("l").join(halved.alias("r"), near).select(F.greatest("l.first", "r.first").alias("a"), F.least("l.first", "r.first").alias("b"))


def candidate_links(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the nodes of rows (node, fps) which link in any view, about one for each node.

    Every node is linked to its least neighbour, and its other smaller neighbours too; it has 49 a view at most.
    """
    seen = rows.select("node", F.posexplode("fps").alias("view", "fp"))
    firsts = seen.groupBy("view", "fp").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts, "view-firsts")
    equal = firsts.filter("first <> last")
    ends = equal.select(F.col("last").alias("a"), F.col("first").alias("b"))
    more = seen.join(equal.filter("n > 2").select("view", "fp", "first"), ["view", "fp"]).select(F.col("node").alias("a"), F.col("first").alias("b"))
    edges = ends.unionByName(more.filter("a <> b")).unionByName(view_links(firsts.select("view", "fp", "first")))
    smaller = edges.groupBy("a").agg(F.collect_set("b").alias("bs")).select("a", "bs", F.array_min("bs").alias("b"))
    others = smaller.select(F.explode("bs").alias("a"), "b").filter("a <> b")
    return smaller.select("a", "b").unionByName(others).distinct()


def _similar(x, y, similarity: float):
    """Two arrays of distinct shingles have the Jaccard similarity; two empty ones are alike."""
    n, m = F.size(x), F.size(y)
    both = F.size(F.array_intersect(x, y))
    return (F.least(n, m) >= similarity * F.greatest(n, m)) & (both >= similarity * (n + m - both))


def _compared(pairs: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles in members (node, hashes) have the similarity."""
    for end, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(members.select(F.col("node").alias(end), F.col("hashes").alias(name)), end)
    return pairs.filter(_similar(F.col("x"), F.col("y"), similarity)).select("a", "b")


def prefix_keys(members: DataFrame, similarity: float) -> DataFrame:
    """(root, key, node, n, pos): the shingles by which the members (root, node, hashes) of a root can meet, the set's size and their place in it.

    In one order of a root's shingles, here from the rarest in it, two sets of that similarity share one of the first
    n - ceil(similarity * n) + 1 of each. Shingles that no other member has are of no use and left out. Empty sets meet under a key of their own.
    """
    each = members.select("root", "node", F.explode("hashes").alias("key"))
    often = each.groupBy("root", "key").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(often, ["root", "key"]).groupBy("root", "node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("s"))
    length = F.size("s") - F.ceil(F.size("s") * F.lit(similarity) - F.lit(1e-9)).cast("int") + 1
    keys = ordered.select("root", "node", F.size("s").alias("n"), F.posexplode(F.slice("s", F.lit(1), length)).alias("pos", "k"))
    keys = keys.filter("k.n > 1").select("root", F.col("k.key").alias("key"), "node", "n", "pos")
    empty = members.filter(F.size("hashes") == 0)
    return keys.unionByName(empty.select("root", F.lit(0).cast("long").alias("key"), "node", F.lit(0).alias("n"), F.lit(0).alias("pos")))


def _can_reach(room, other_room, low, other_low, similarity: float):
    """Two sets whose first common shingle leaves them `room` shingles from it on can have the overlap that their sizes ask for."""
    return F.least(room, other_room) >= F.lit(similarity / (1 + similarity)) * (low + other_low) - F.lit(1e-6)


def parity_marks(members: DataFrame) -> DataFrame:
    """node and marks m0 .. of the members (node, hashes): each bit tells whether the set has an odd number of the shingles that fall on it.

    Every bit that two sets differ in stands for a shingle that only one of them has, so the differing bits never outnumber these.
    """
    each = members.select("node", F.explode("hashes").alias("h"))
    word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(MARKS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    marks = each.groupBy("node").agg(*(F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(MARKS)))
    return members.select("node").join(marks, "node", "left").na.fill(0, [f"m{i}" for i in range(MARKS)])


def _few_differ(l: str, r: str, most, similarity: float):
    """Groups of sets with `most` shingles in a pair can hold a pair of that similarity by their marks.

    all_ has the bits that every set of a group has, any_ those that some have. Bits that all of one and none of the other have differ in
    each pair; two sets of n + m shingles and that similarity differ in (1 - similarity) / (1 + similarity) * (n + m) shingles at most.
    """
    own = lambda side, kind, i: F.col(f"{side}{kind}_{i}")
    sure = lambda a, b, i: F.bit_count(own(a, "all", i).bitwiseAND(F.bitwise_not(own(b, "any", i))))
    differ = sum((sure(l, r, i) + sure(r, l, i) for i in range(1, MARKS)), sure(l, r, 0) + sure(r, l, 0))
    return differ <= F.lit((1 - similarity) / (1 + similarity)) * most + F.lit(1e-6)


def _components_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes; a node without an edge is its own component."""
    return nodes.join(components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("comp"))


def prefix_links(members: DataFrame, similarity: float, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """Edges (a, b) whose components are those of all links within the roots of members (root, node, hashes).

    Members that share a prefix key may link, others can't. At first every member is compared with one such pivot of another
    component, drawn anew each round, which joins dense groups in a few rounds of linear work. Then all pairs that share a key and are still in
    different components are compared if their sizes, the shingles from the key on and their parity marks let them have the similarity,
    whatever the rounds have left, so no link between two components is missed.
    """
    keys = written(prefix_keys(members, similarity), "near-keys")
    nodes = keys.select("node").distinct()
    comps, edges = nodes.withColumn("comp", F.col("node")), None
    for turn in range(rounds):
        placed = written(keys.join(comps, "node"), "near-placed")
        mine = F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), F.col("node").alias("pivot"), F.col("comp").alias("of"))
        mixed = placed.groupBy("root", "key").agg(F.min(mine).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("root", "key", "p")
        wanted = placed.join(mixed, ["root", "key"]).filter("comp <> p.of").groupBy("node").agg(F.min("p").alias("p"))
        found = written(_compared(wanted.select(F.col("node").alias("a"), F.col("p.pivot").alias("b")), members, similarity), "near-edges")
        if found.isEmpty():
            break
        edges = found if edges is None else edges.unionByName(found)
        comps = written(_components_of(nodes, edges), "near-comps")
    placed = written(keys.join(comps, "node"), "near-placed")
    apart = placed.groupBy("root", "key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most").select("root", "key")
    marks = written(parity_marks(members.select("node", "hashes")), "near-marks")
    placed = written(placed.join(apart, ["root", "key"], "left_semi").join(marks, "node"), "near-apart")
    # of a component at a key, what its best member can reach and what marks its members share; then the same for the members themselves
    room = F.col("n") - F.col("pos")
    shared = [f(f"m{i}").alias(f"{kind}_{i}") for i in range(MARKS) for kind, f in (("all", F.bit_and), ("any", F.bit_or))]
    each = placed.groupBy("root", "key", "comp").agg(F.max(room).alias("room"), F.min("n").alias("low"), F.max("n").alias("high"), *shared)
    each = written(each, "near-parts")
    sizes = (F.col("l.high") >= similarity * F.col("r.low")) & (F.col("r.high") >= similarity * F.col("l.low"))
    able = _can_reach(F.col("l.room"), F.col("r.room"), F.col("l.low"), F.col("r.low"), similarity)
    alike = _few_differ("l.", "r.", F.col("l.high") + F.col("r.high"), similarity)
    same = (F.col("l.root") == F.col("r.root")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") < F.col("r.comp"))
    two = each.alias("l").join(each.alias("r"), same & sizes & able & alike)
    two = two.select("l.root", "l.key", F.col("l.comp").alias("comp"), F.col("r.comp").alias("other"))
    own = lambda side: [F.col(f"m{i}").alias(f"{side}{kind}_{i}") for i in range(MARKS) for kind in ("all", "any")]
    left = two.join(placed, ["root", "key", "comp"])
    left = left.select("root", "key", F.col("other").alias("comp"), F.col("node").alias("a"), F.col("n").alias("n_a"), room.alias("room_a"), *own("a_"))
    right = placed.select("root", "key", "comp", F.col("node").alias("b"), F.col("n").alias("n_b"), room.alias("room_b"), *own("b_"))
    fit = (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")) & _can_reach(F.col("room_a"), F.col("room_b"), F.col("n_a"), F.col("n_b"), similarity)
    met = left.join(right, ["root", "key", "comp"])
    pairs = met.filter(fit & _few_differ("a_", "b_", F.col("n_a") + F.col("n_b"), similarity)).select("a", "b").distinct()
    last = written(_compared(pairs, members, similarity), "near-edges")
    return last if edges is None else edges.unionByName(last)


def verified_links(members: DataFrame, similarity: float = 0.8, whole: int = 64) -> DataFrame:
    """Edges (a, b) within each root of members (root, node, hashes) whose exact Jaccard similarity is the given one or more.

    Their components are those of all such pairs. Roots of up to `whole` members have all their pairs compared, larger ones are joined by
    prefix keys, which gives the same components with less work.
    """
    sizes = written(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "near-sizes")
    small = members.join(sizes.filter(F.col("n") <= whole).select("root"), "root", "left_semi")
    same = (F.col("l.root") == F.col("r.root")) & (F.col("l.node") < F.col("r.node"))
    pairs = small.alias("l").join(small.alias("r"), same).filter(_similar(F.col("l.hashes"), F.col("r.hashes"), similarity))
    edges = written(pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")), "near-edges")
    if sizes.filter(F.col("n") > whole).isEmpty():
        return edges
    large = written(members.join(sizes.filter(F.col("n") > whole).select("root"), "root", "left_semi"), "near-large")
    return edges.unionByName(prefix_links(large, similarity))


def without_near_copies(df: DataFrame, similarity: float = 0.8, views: int = VIEWS, whole: int = 64) -> DataFrame:
    """The least doc_id of each group of near copies in df (doc_id, text), one row for each group.

    Texts that link in any view are candidates; in the components of these, texts link when their distinct five-word shingles
    have the similarity exactly, and groups are the components of these links. A text of fewer than five words is one shingle;
    null and empty texts have none and are copies of each other. A null doc_id stands for a group only where it has no other. Equal
    texts are one group, repeated rows among them. Long texts are read whole. An empty df gives an empty result; other columns are ignored.
    """
    docs = written(with_views(df, views), "view-docs")
    roots = components(candidate_links(docs))
    texts = df.select(_node(), "text").join(roots, "node").dropDuplicates(["node"])
    members = written(with_shingles(texts), "near-members")
    nodes = docs.groupBy("node").agg(F.min("doc_id").alias("least"))
    _, least = _least(nodes, components(verified_links(members, similarity, whole)))
    return least.select(F.col("component_id").alias("doc_id"))
