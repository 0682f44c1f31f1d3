"""Language of texts by a bidirectional gated recurrent network over bytes.

One network reads the bytes of a segment forwards, one backwards; at every byte both
states give the probabilities of the languages.  A document's probabilities are the means
of the log probabilities over all its bytes, so every byte of a text of any length counts,
and memory is bounded by the segments read at once.  The network is trained in numpy by
backpropagation through time.

It is trained on at most ``TRAIN_DOCUMENTS`` labelled documents for each language, those
with the smallest hash of id and text, one segment from each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronlens.llm.words import row_ranges

SEGMENT = 96
HIDDEN = 8
TRAIN_DOCUMENTS = 1000
EPOCHS = 8
BATCH = 128
RATE = 0.02
# Segments read at once; a text's segments may be read in several turns.
READ_AT_ONCE = 2048
UNKNOWN = "und"

_LETTER = r"\p{L}"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class Direction:
    """A gated recurrent layer: input weights by byte (update, reset, candidate), recurrent weights."""

    byte: np.ndarray
    gates: np.ndarray
    candidate: np.ndarray

    @classmethod
    def drawn(cls, rng: np.random.Generator, hidden: int) -> Direction:
        def draw(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)

        return cls(draw(256, 3 * hidden), draw(hidden, 2 * hidden), draw(hidden, hidden))

    def run(self, steps: np.ndarray, inside: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step; ``steps`` is (time, rows) bytes, ``inside`` marks real ones."""
        time, rows = steps.shape
        hidden = len(self.candidate)
        state = np.zeros((rows, hidden), np.float32)
        states = np.empty((time, rows, hidden), np.float32)
        for t in range(time):
            given = self.byte[steps[t]]
            gates = _sigmoid(given[:, : 2 * hidden] + state @ self.gates)
            update, reset = gates[:, :hidden], gates[:, hidden:]
            held = reset * state
            new = np.tanh(given[:, 2 * hidden:] + held @ self.candidate)
            if keep is not None:
                keep.append((state, update, reset, held, new))
            # Beyond a row's end the state stands still.
            state = state + update * (new - state) * inside[t][:, None]
            states[t] = state
        return states

    def read(self, steps: np.ndarray, inside: np.ndarray, out: np.ndarray) -> np.ndarray:
        """``run(...) @ out``, with every buffer used again at the next step."""
        time, rows = steps.shape
        hidden = len(self.candidate)
        half = np.float32(0.5)
        # sigmoid(x) is (tanh(x / 2) + 1) / 2: the inner half goes into the weights.
        byte = self.byte * np.repeat(np.array([half, half, 1], np.float32), hidden)
        gates = self.gates * half
        state, given = np.zeros((rows, hidden), np.float32), np.empty((rows, 3 * hidden), np.float32)
        both, held, new = np.empty((rows, 2 * hidden), np.float32), np.empty_like(state), np.empty_like(state)
        result = np.empty((time, rows, out.shape[1]), np.float32)
        whole = inside.all(1)
        for t in range(time):
            np.take(byte, steps[t], axis=0, out=given, mode="clip")
            np.matmul(state, gates, out=both)
            both += given[:, : 2 * hidden]
            np.tanh(both, out=both)
            both += 1
            both *= half
            np.multiply(both[:, hidden:], state, out=held)
            np.matmul(held, self.candidate, out=new)
            new += given[:, 2 * hidden:]
            np.tanh(new, out=new)
            new -= state
            new *= both[:, :hidden]
            if not whole[t]:
                new *= inside[t][:, None]
            state += new
            np.matmul(state, out, out=result[t])
        return result

    def backward(self, steps: np.ndarray, inside: np.ndarray, kept: list, grads: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights from those of all states, last step first."""
        hidden = len(self.candidate)
        d_byte, d_gates, d_candidate = np.zeros_like(self.byte), np.zeros_like(self.gates), np.zeros_like(self.candidate)
        carried = np.zeros_like(grads[0])
        for t in range(len(steps) - 1, -1, -1):
            state, update, reset, held, new = kept[t]
            total = grads[t] + carried
            own = total * inside[t][:, None]
            d_new = own * update * (1 - new * new)
            d_update = own * (new - state) * update * (1 - update)
            d_held = d_new @ self.candidate.T
            d_reset = d_held * state * reset * (1 - reset)
            both = np.concatenate([d_update, d_reset], 1)
            carried = total - own * update + d_held * reset + both @ self.gates.T
            d_gates += state.T @ both
            d_candidate += held.T @ d_new
            np.add.at(d_byte, steps[t], np.concatenate([both, d_new], 1))
        return [d_byte, d_gates, d_candidate]


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def drawn(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        out = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        return cls(languages, Direction.drawn(rng, hidden), Direction.drawn(rng, hidden), out, np.zeros(len(languages), np.float32))

    def log_probabilities(self, segments: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(time, rows, languages) for (rows, time) bytes."""
        steps, inside = _steps(segments, lengths)
        hidden = len(self.out) // 2
        scores = self.forward.read(steps, inside, self.out[:hidden])
        scores += self.backward.read(steps[::-1], inside[::-1], self.out[hidden:])[::-1]
        return _log_softmax(scores + self.bias)

    def weights(self) -> list[np.ndarray]:
        f, b = self.forward, self.backward
        return [f.byte, f.gates, f.candidate, b.byte, b.gates, b.candidate, self.out, self.bias]

    def gradients(self, segments: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss per byte, every byte carrying its text's label, and its gradients."""
        steps, inside = _steps(segments, lengths)
        kept: tuple[list, list] = ([], [])
        ahead = self.forward.run(steps, inside, kept[0])
        behind = self.backward.run(steps[::-1], inside[::-1], kept[1])[::-1]
        both = np.concatenate([ahead, behind], 2)
        log_p = _log_softmax(both @ self.out + self.bias)
        weight = (inside / max(inside.sum(), 1)).astype(np.float32)
        loss = -float((log_p[:, np.arange(len(labels)), labels] * weight).sum())
        error = np.exp(log_p)
        error[:, np.arange(len(labels)), labels] -= 1
        error *= weight[:, :, None]
        flat = both.reshape(-1, both.shape[2])
        d_out, d_bias = flat.T @ error.reshape(-1, error.shape[2]), error.sum((0, 1))
        d_both = error @ self.out.T
        hidden = ahead.shape[2]
        f = self.forward.backward(steps, inside, kept[0], d_both[:, :, :hidden])
        b = self.backward.backward(steps[::-1], inside[::-1], kept[1], d_both[::-1, :, hidden:])
        return loss, [*f, *b, d_out, d_bias]


def _steps(segments: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.arange(segments.shape[1])[:, None] < lengths[None, :]
    return np.ascontiguousarray(segments.T), inside.astype(np.float32)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def train(samples: list[tuple[bytes, str]], *, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Adam on shuffled batches; languages are weighted alike by their samples being drawn alike."""
    languages = sorted({lang for _, lang in samples})
    network = Network.drawn(languages, hidden, seed)
    segments, lengths = _laid_out([text[:SEGMENT] for text, _ in samples])
    labels = np.array([languages.index(lang) for _, lang in samples], np.int64)
    rng = np.random.default_rng(seed)
    by_label = [np.flatnonzero(labels == i) for i in range(len(languages))]
    most = max(map(len, by_label), default=0)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in network.weights()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(np.concatenate([rng.choice(own, most) if len(own) < most else own for own in by_label])) if most else []
        for at in range(0, len(order), BATCH):
            rows = order[at: at + BATCH]
            _, grads = network.gradients(segments[rows], lengths[rows], labels[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for weight, grad, (first, second) in zip(network.weights(), grads, moments):
                grad = grad * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
                first += np.float32(0.1) * (grad - first)
                second += np.float32(0.001) * (grad * grad - second)
                weight -= np.float32(rate) * (first / np.float32(1 - 0.9**step)) / (np.sqrt(second / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return network


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts of at most ``SEGMENT`` bytes as rows, and their lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = np.frombuffer(b"".join(t.ljust(SEGMENT, b" ") for t in texts), np.uint8).reshape(-1, SEGMENT)
    return rows, lengths


def document_means(network: Network, texts: list[bytes]) -> np.ndarray:
    """Mean log probabilities over all bytes of each text (zeros for an empty one)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    parts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), parts)
    padded = b"".join(t.ljust(int(p) * SEGMENT, b" ") for t, p in zip(texts, parts))
    segments = np.frombuffer(padded, np.uint8).reshape(-1, SEGMENT)
    lengths = np.full(len(segments), SEGMENT)
    ends = np.cumsum(parts) - 1
    lengths[ends[parts > 0]] = (sizes - (parts - 1) * SEGMENT)[parts > 0]
    sums = np.zeros((len(texts), len(network.languages)))
    for at in range(0, len(segments), READ_AT_ONCE):
        part = slice(at, at + READ_AT_ONCE)
        own = lengths[part]
        log_p = network.log_probabilities(segments[part], own)
        inside = np.arange(SEGMENT)[:, None] < own[None, :]
        np.add.at(sums, owner[part], np.einsum("trl,tr->rl", log_p, inside.astype(np.float32)))
    return sums / np.maximum(sizes, 1)[:, None]


def training_sample(docs: DataFrame, limit: int = TRAIN_DOCUMENTS) -> list[tuple[bytes, str]]:
    """One segment of each of at most ``limit`` labelled documents a language, chosen by hash; at most that many rows reach the driver."""
    letters = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(_LETTER))
    data = F.encode("text", "UTF-8")
    room = F.greatest(F.octet_length("text") - SEGMENT, F.lit(0)) + 1
    begin = F.pmod(F.xxhash64("text", F.lit(7)), room) + 1
    segment = F.substring(data, begin.cast("int"), F.lit(SEGMENT))
    drawn = letters.select("lang", F.xxhash64("doc_id", "text").alias("draw"), segment.alias("segment"))
    # Up to a thousand rows a group, Spark keeps each task's own smallest draws before it moves any.
    smallest = Window.partitionBy("lang").orderBy("draw", "segment")
    few = drawn.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= limit)
    return [(bytes(r["segment"]), r["lang"]) for r in few.select("segment", "lang").orderBy("lang", "draw").collect()]


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(5)) == 0


def identify_languages(docs: DataFrame, network: Network, *, key: str = "doc_id") -> DataFrame:
    """``key, lang_pred, score`` for every row of ``docs`` (key, text).

    A null text, and one without letters, is ``und`` with score 0, and so is everything
    if no language was learned.  The score is the probability of the predicted language
    after pooling: the mean log probabilities, scaled to sum to one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(network)
    kind = docs.schema[key].dataType.simpleString()
    has_letters = F.coalesce(F.col("text").rlike(_LETTER), F.lit(False))
    rows = docs.select(F.col(key).alias("key"), F.col("text").alias("text"), has_letters.alias("letters"))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array(own.languages, object)
        for batch, texts in row_ranges(batches, limit=SEGMENT * READ_AT_ONCE):
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if len(names):
                p = np.exp(_log_softmax(document_means(own, texts)))
                best = p.argmax(1)
                said = np.where(letters, names[best], UNKNOWN)
                score = np.where(letters, p[np.arange(len(p)), best], 0.0)
            else:
                said, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(score.astype(float))], ["key", "lang_pred", "score"])

    return rows.mapInArrow(identify, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
