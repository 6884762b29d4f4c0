"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of TRAINED bytes, drawn from anywhere in the whole
texts of a bounded sample of labelled documents. It labels every byte position; a document's probabilities are the mean over
all its positions. Texts are read whole. Those of up to WINDOW bytes run uncut; longer ones are cut, and each window runs on for MARGIN
bytes of its neighbours on both sides, so that both directions' states have nearly settled where its own positions begin and a cut
within a character has its bytes on both sides. Memory doesn't grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.shared import few_rows, in_arrow

WINDOW, MARGIN = 512, 64
TRAINED = 128
HIDDEN = 8
LANES = 512  #: windows that run side by side
UNKNOWN = "und"
SAMPLE_DOCS = 6000  #: bound of the training sample, in documents; every language gets its share
SAMPLE_BYTES = 1 << 25  #: bound of their texts together
LONGEST = 1 << 20  #: bytes of the longest text that is sampled
STEPS, BATCH, RATE = 500, 192, 0.02
PAD = 32


@dataclass
class ByteGRU:
    """Weights; axis 0 of inputs and recurrent is the direction. Gates are ordered update, reset, candidate."""

    languages: list[str]
    inputs: np.ndarray  # (2, 3 * hidden, 256)
    recurrent: np.ndarray  # (2, 3 * hidden, hidden)
    output: np.ndarray  # (languages, 2 * hidden)
    bias: np.ndarray  # (languages, 1)

    @classmethod
    def start(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 0) -> ByteGRU:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(languages, draw(0.3, 2, 3 * hidden, 256), draw(0.3, 2, 3 * hidden, hidden), draw(0.1, len(languages), 2 * hidden), np.zeros((len(languages), 1), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.output, self.bias]

    def _states(self, windows: np.ndarray, keep: list | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
        """Hidden states (length, 2, hidden, lanes) by byte position; keep gets what a backward pass needs.

        With sizes, positions from a lane's size on are padding, which the direction from the end doesn't see.
        """
        lanes, length = windows.shape
        hidden = self.recurrent.shape[2]
        steps = np.stack([windows.T, windows.T[::-1]], axis=1).astype(np.intp)
        states = np.empty((length, 2, hidden, lanes), self.inputs.dtype)
        h = np.zeros((2, hidden, lanes), self.inputs.dtype)
        x = np.empty((2, 3 * hidden, lanes), self.inputs.dtype)
        u = np.empty_like(x)
        shortest = length if sizes is None else int(sizes.min(initial=length))
        for t in range(length):
            np.take(self.inputs[0], steps[t, 0], axis=1, out=x[0], mode="clip")
            np.take(self.inputs[1], steps[t, 1], axis=1, out=x[1], mode="clip")
            np.matmul(self.recurrent, h, out=u)
            gates = x[:, : 2 * hidden] + u[:, : 2 * hidden]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            candidate = gates[:, hidden:] * u[:, 2 * hidden :]
            candidate += x[:, 2 * hidden :]
            np.tanh(candidate, out=candidate)
            after = h - candidate
            after *= gates[:, :hidden]
            after += candidate
            if keep is not None:
                keep.append((h, gates, candidate, u[:, 2 * hidden :].copy(), steps[t]))
            if sizes is not None and length - 1 - t >= shortest:
                after[1][:, sizes <= length - 1 - t] = 0
            h = after
            states[t, 0], states[length - 1 - t, 1] = h[0], h[1]
        return states

    def positions(self, windows: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (languages, length, lanes) of every byte position of windows (lanes, length), padded from sizes on."""
        return self._softmax(self._states(windows, sizes=sizes))

    def _softmax(self, states: np.ndarray) -> np.ndarray:
        length, _, hidden, lanes = states.shape
        logits = np.matmul(self.output, states.reshape(length, 2 * hidden, lanes))
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.transpose(1, 0, 2)

    def loss_and_gradients(self, windows: np.ndarray, valid: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over valid positions (lanes, length) and its gradient for weights()."""
        keep: list = []
        states = self._states(windows, keep)
        length, _, hidden, lanes = states.shape
        share = self._softmax(states).transpose(1, 0, 2).copy()
        count = max(1, valid.sum())
        of_label = share[:, labels, np.arange(lanes)]
        loss = float(-(np.log(np.maximum(of_label, 1e-30)) * valid.T).sum() / count)
        share[:, labels, np.arange(lanes)] -= 1
        share *= (valid.T / count)[:, None, :].astype(share.dtype)
        flat = states.reshape(length, 2 * hidden, lanes)
        d_output = np.einsum("tkb,thb->kh", share, flat, optimize=True)
        d_bias = share.sum(axis=(0, 2))[:, None]
        d_states = np.matmul(self.output.T, share).reshape(length, 2, hidden, lanes)
        d_recurrent = np.zeros_like(self.recurrent)
        d_x = np.empty((length, 2, 3 * hidden, lanes), self.inputs.dtype)
        back = np.zeros((2, hidden, lanes), self.inputs.dtype)
        for t in range(length - 1, -1, -1):
            before, gates, candidate, u_n, _ = keep[t]
            back[0] += d_states[t, 0]
            back[1] += d_states[length - 1 - t, 1]
            z, r = gates[:, :hidden], gates[:, hidden:]
            d_n = back * (1 - z) * (1 - candidate * candidate)
            d_x[t, :, :hidden] = back * (before - candidate) * z * (1 - z)
            d_x[t, :, hidden : 2 * hidden] = d_n * u_n * r * (1 - r)
            d_x[t, :, 2 * hidden :] = d_n
            d_u = d_x[t].copy()
            d_u[:, 2 * hidden :] *= r
            d_recurrent += np.matmul(d_u, before.transpose(0, 2, 1))
            back = back * z + np.matmul(self.recurrent.transpose(0, 2, 1), d_u)
        d_inputs = np.empty_like(self.inputs)
        for way in range(2):
            codes = np.concatenate([k[4][way] for k in keep])
            rows = d_x[:, way].transpose(1, 0, 2).reshape(3 * hidden, -1)
            for i in range(3 * hidden):
                d_inputs[way, i] = np.bincount(codes, rows[i], 256)
        return loss, [d_inputs, d_recurrent, d_output.astype(self.inputs.dtype), d_bias.astype(self.inputs.dtype)]

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean position probabilities (texts, languages) of whole texts; zeros for an empty text."""
        out = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), counts)
        own = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW  # a window's own positions
        until = np.minimum(own + WINDOW, sizes[owner])
        first, last = np.maximum(own - MARGIN, 0), np.minimum(until + MARGIN, sizes[owner])
        bytes_ = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        base = (np.cumsum(sizes) - sizes)[owner]
        order = np.argsort(first - last, kind="stable")  # windows of like size run side by side
        for at in range(0, len(order), LANES):
            part = order[at : at + LANES]
            n = (last - first)[part]
            place = np.arange(int(n[0]))
            taken = np.minimum((base + first)[part][:, None] + place[None, :], len(bytes_) - 1)
            lanes = np.where(place[None, :] < n[:, None], bytes_[taken], np.uint8(PAD))
            share = self.positions(lanes, n)
            counted = (place[:, None] >= (own - first)[part][None, :]) & (place[:, None] < (until - first)[part][None, :])
            sums = (share * counted).sum(axis=1, dtype=np.float64)
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(owner[part], sums[k], len(texts))
        return out / np.maximum(sizes, 1)[:, None]


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 0) -> ByteGRU:
    """Adam on random batches of byte windows, each at most TRAINED bytes long, with classes drawn evenly.

    All windows of the texts, cut one after the other from a random place on, can be drawn.
    """
    languages = sorted(set(labels))
    model = ByteGRU.start(languages, hidden, seed)
    rng = np.random.default_rng(seed)
    pieces: list[bytes] = []
    of_text: list[int] = []
    for i, text in enumerate(texts):
        cut = 0 if len(text) <= TRAINED else int(rng.integers(1, TRAINED))
        found = [p for p in (text[:cut], *(text[at : at + TRAINED] for at in range(cut, len(text), TRAINED))) if p]
        pieces += found
        of_text += [i] * len(found)
    sizes = np.array([len(p) for p in pieces], np.int64)
    stream, starts = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes
    codes = np.array([languages.index(labels[i]) for i in of_text])
    weight = 1 / np.bincount(codes)[codes]
    weight = np.cumsum(weight / weight.sum())
    first, second = [np.zeros_like(w) for w in model.weights()], [np.zeros_like(w) for w in model.weights()]
    place = np.arange(TRAINED)[None, :]
    for step in range(1, steps + 1):
        rows = np.minimum(np.searchsorted(weight, rng.random(BATCH)), len(weight) - 1)
        valid = place < sizes[rows][:, None]
        windows = np.where(valid, stream[np.minimum(starts[rows][:, None] + place, len(stream) - 1)], np.uint8(PAD))
        _, gradients = model.loss_and_gradients(windows, valid, codes[rows])
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(model.weights(), gradients, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def held_out(column: str = "doc_id"):
    """Documents that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(df: DataFrame) -> ByteGRU | None:
    """A model of df's languages (doc_id, text, lang), from whole texts of at most SAMPLE_DOCS documents; None without usable rows.

    Documents of up to LONGEST bytes are taken in the order of a hash of their doc_id, each language up to its share, as long as
    their texts have SAMPLE_BYTES together. Of rows that repeat a doc_id the least (lang, text) is used.
    """
    size = F.octet_length("text")
    usable = df.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out() & (size <= LONGEST))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not counts:
        return None
    quota = max(1, SAMPLE_DOCS // len(counts))
    while True:  # small languages leave room to the others
        spare = SAMPLE_DOCS - sum(min(n, quota) for n in counts.values())
        open_ended = sum(n > quota for n in counts.values())
        if not open_ended or spare < open_ended:
            break
        quota += spare // open_ended
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    taken = F.lit(False)
    for lang, n in sorted(counts.items()):
        taken = taken | ((F.col("lang") == lang) & (draw < int(min(1, quota / n) * (1 << 30))))
    drawn = usable.filter(taken).select(F.col("doc_id").cast("long").alias("doc_id"), draw.alias("draw"), size.alias("size"))
    chosen, room = [], SAMPLE_BYTES
    for r in drawn.dropDuplicates(["doc_id"]).orderBy("draw", "doc_id").limit(SAMPLE_DOCS).collect():
        if r["size"] <= room and r["doc_id"] is not None:
            chosen.append((r["doc_id"],))
            room -= r["size"]
    ids = few_rows(df.sparkSession, chosen, "doc_id long")
    rows = usable.join(F.broadcast(ids), "doc_id", "left_semi")  # SAMPLE_DOCS rows at most
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("s")).select("s.*").collect()
    rows = sorted((r["lang"], r["text"].encode()) for r in rows)
    if not rows:
        return None
    return train([text for _, text in rows], [lang for lang, _ in rows])


def predict(df: DataFrame, model: ByteGRU | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in carry, lang_pred and lang_score of every row of df (doc_id, text).

    Of languages with equal probabilities the first by name is predicted.
    """
    out = [*dict.fromkeys(["doc_id", *carry])]
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return df.select(*out, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("lang_score"))
    narrow = df.select(*out, has.alias("_has"), *([] if "text" in out else [F.col("text").alias("_text")]))  # a carried text is sent once
    at_text = out.index("text") if "text" in out else len(out) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                has = np.array(batch.column(len(out)).to_pylist(), bool)
                texts = [t if ok else b"" for t, ok in zip(batch.column(at_text).cast(pa.binary()).to_pylist(), has)]
                share = model.documents(texts)
                best = share.argmax(axis=1)
                names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, has)]
                scores = np.where(has, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(out)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*out, "lang_pred", "lang_score"])

    return in_arrow(narrow, run, T.StructType([*narrow.schema.fields[: len(out)], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def identify(df: DataFrame, model: ByteGRU | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row of df (doc_id, text, lang).

    Without a model one is fitted on the rows of df that are not held out. lang_pred is a learned language, or
    `und` with score 0 where the text is null or has no letter, and for all rows where nothing could be learned. Rows
    with a null doc_id are predicted too, but never learned from; repeated rows stay repeated; of languages with equal
    probabilities the first by name is predicted; very long texts are read whole, window by window; an empty df gives an empty
    result; other columns are ignored.
    """
    model = model or fit(df)
    found = predict(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
