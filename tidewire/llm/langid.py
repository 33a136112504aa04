"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers read a window of bytes, one from each end; both states at a byte give the
languages' probabilities there. A document's probabilities are the mean of its letters' log
probabilities, renormalised. The network is trained in numpy by backpropagation through time on a
bounded sample: per language, one window of each of up to PER_LANGUAGE hash classes of its
documents. Prediction reads every byte of every text, cut into windows for all of a block's texts
at once, so that a step works on thousands of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .tokens import blocks

#: Documents a language that give one training window each, and the window's characters.
PER_LANGUAGE, SAMPLE_CHARS = 256, 200
#: State of each direction; bytes a window; windows a step when predicting.
HIDDEN, WINDOW, ROWS = 12, 96, 4096
EPOCHS, BATCH, RATE = 15, 64, 0.01
UNKNOWN = "und"
_SPACES = np.zeros(256, dtype=bool)
_SPACES[:65] = True  # bytes below the letters: blanks, digits and most punctuation say little and are not pooled
_SPACES[[91, 92, 93, 94, 95, 96, 123, 124, 125, 126, 127]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Gru:
    """One direction. Gates z and r, candidate c: h' = (1 - z) h + z tanh(x_c + r (U_c h)); x is a row of a table by byte."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.n = hidden

    def step(self, byte: np.ndarray, h: np.ndarray) -> tuple:
        n = self.n
        x, g = self.table[byte], h @ self.u
        zr = _sigmoid(x[:, : 2 * n] + g[:, : 2 * n])
        c = np.tanh(x[:, 2 * n :] + zr[:, n:] * g[:, 2 * n :])
        return h + zr[:, :n] * (c - h), zr, c, g[:, 2 * n :]

    def run(self, data: np.ndarray) -> list[tuple]:
        """All steps over columns of bytes: (state before, state after, gates, candidate, its recurrent part)."""
        h, out = np.zeros((len(data), self.n), dtype=np.float32), []
        for t in range(data.shape[1]):
            new = self.step(data[:, t], h)
            out.append((h, *new))
            h = new[0]
        return out

    def back(self, data: np.ndarray, steps: list[tuple], grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and u, given those of every state."""
        n = self.n
        d_table, d_u, d_h = np.zeros_like(self.table), np.zeros_like(self.u), np.zeros((len(data), n), dtype=np.float32)
        for t in range(data.shape[1] - 1, -1, -1):
            h, _, zr, c, gc = steps[t]
            z, r = zr[:, :n], zr[:, n:]
            d_h = d_h + grad[:, t]
            d_c = d_h * z * (1 - c * c)
            d_z = d_h * (c - h) * z * (1 - z)
            d_r = d_c * gc * r * (1 - r)
            d_x = np.concatenate((d_z, d_r, d_c), axis=1)
            d_g = np.concatenate((d_z, d_r, d_c * r), axis=1)
            np.add.at(d_table, data[:, t], d_x)
            d_u += h.T @ d_g
            d_h = d_h * (1 - z) + d_g @ self.u.T
        return d_table, d_u


class Net:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forward, self.backward = Gru(hidden, rng), Gru(hidden, rng)
        self.w = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        self.b = np.zeros(len(languages), dtype=np.float32)

    def _states(self, data: np.ndarray) -> tuple:
        f, b = self.forward.run(data), self.backward.run(data[:, ::-1])
        both = np.concatenate((np.stack([s[1] for s in f], axis=1), np.stack([s[1] for s in b], axis=1)[:, ::-1]), axis=2)
        return f, b, both

    def gradients(self, data: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over the masked positions, and its gradients in the order of parameters()."""
        f, b, both = self._states(data)
        logits = both @ self.w + self.b
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        n = self.forward.n
        rows = np.arange(len(data))
        loss = -np.log(np.maximum(p[rows, :, label], 1e-12))[mask].mean()
        p[rows, :, label] -= 1
        d = p * (mask[:, :, None] / mask.sum())
        d_both = (d @ self.w.T).astype(np.float32)
        d_w = np.einsum("btk,btl->kl", both, d)
        ft, fu = self.forward.back(data, f, d_both[:, :, :n])
        bt, bu = self.backward.back(data[:, ::-1], b, d_both[:, ::-1, n:])
        return float(loss), [ft, fu, bt, bu, d_w, d.sum(axis=(0, 1))]

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.u, self.backward.table, self.backward.u, self.w, self.b]

    def fit(self, data: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Net:
        """Adam over shuffled batches of equal windows (zero: no byte)."""
        rng, p = np.random.default_rng(seed), self.parameters()
        m, v, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
        for epoch in range(epochs):
            order, rate = rng.permutation(len(data)), RATE * (1 - epoch / epochs) + 1e-4
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                mask = ~_SPACES[data[some]]
                if not mask.any():
                    continue
                t += 1
                for i, g in enumerate(self.gradients(data[some], label[some], mask)[1]):
                    g = np.clip(g, -1, 1)
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per window: sum of its letters' log probabilities, a column a language, and their number."""
        n, rows = self.forward.n, len(data)
        columns = np.ascontiguousarray(data.T)
        states = np.empty((len(columns), rows, n), dtype=np.float32)
        h = np.zeros((rows, n), dtype=np.float32)
        for t, byte in enumerate(columns):
            states[t] = h = self.forward.step(byte, h)[0]
        total, h = np.zeros((rows, len(self.languages)), dtype=np.float32), np.zeros((rows, n), dtype=np.float32)
        letters = ~_SPACES[columns]
        for t in range(len(columns) - 1, -1, -1):
            h = self.backward.step(columns[t], h)[0]
            logits = states[t] @ self.w[:n] + h @ self.w[n:] + self.b
            logits -= logits.max(axis=1, keepdims=True)
            logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
            total += logits * letters[t][:, None]
        return total, letters.sum(axis=0)

    def probabilities(self, raw: list[bytes]) -> np.ndarray:
        """A row a text: the languages' pooled probabilities; equal ones for a text without letters."""
        owner, cuts = [], []
        for i, t in enumerate(raw):
            parts = [t[a : a + WINDOW] for a in range(0, len(t), WINDOW)]
            cuts += parts
            owner += [i] * len(parts)
        owner = np.array(owner, dtype=np.int64)
        size = np.array([len(c) for c in cuts])
        total, n = np.zeros((len(raw), len(self.languages))), np.zeros(len(raw))
        order = np.argsort(size, kind="stable")  # windows of like length share a step
        for at in range(0, len(order), ROWS):
            some = order[at : at + ROWS]
            width = int(size[some].max())
            data = np.frombuffer(b"".join(cuts[i].ljust(width, b"\0") for i in some), np.uint8).reshape(-1, width)
            sums, letters = self.pooled(data)
            np.add.at(total, owner[some], sums)
            np.add.at(n, owner[some], letters)
        mean = total / np.maximum(n, 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most per_language windows of each language of (doc_id, text, lang): by hash class the one of least hash, from a place that the hash tells."""
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    place = F.lit(1) + F.pmod(h, F.greatest(F.length("text") - chars, F.lit(1))).cast("int")
    cut = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", F.pmod(F.xxhash64(h), F.lit(per_language)).alias("k"), h.alias("h"), F.substring("text", place, F.lit(chars)).alias("part"))
    return cut.groupBy("lang", "k").agg(F.min_by("part", F.struct("h", "part")).alias("part")).select("lang", "k", "part")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, chars: int = SAMPLE_CHARS) -> Net | None:
    """A network fitted on the sample; None where it is empty. Its rows are bounded by languages times per_language."""
    rows = sorted((r.lang, r.k, r.part) for r in sample(docs, per_language, chars).collect())
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    raw = [r[2].encode()[: 2 * WINDOW] for r in rows]
    cuts = [(c, r[0]) for t, r in zip(raw, rows, strict=True) for c in (t[a : a + WINDOW] for a in range(0, len(t), WINDOW))]
    data = np.frombuffer(b"".join(c.ljust(WINDOW, b"\0") for c, _ in cuts), np.uint8).reshape(-1, WINDOW)
    return Net(languages).fit(data, np.array([languages.index(x) for _, x in cuts]))


def predict(docs: DataFrame, modulus: int = 4, held: int = 2, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a row of docs: doc_id, held_out, lang_pred, score.

    The network learns from documents that are not held out and have a text and a language.
    A null text, one without letters, or any text where there was nothing to learn from, is
    UNKNOWN with score 0. A null id counts as an empty text. Every byte of a text is read, however long it is; repeated rows are told alike.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), (fold(F.col(key), modulus) == held).alias("held_out"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    net = train(d.filter("NOT held_out"))
    told = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return d.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for block in blocks(batch, 3):
                known = np.flatnonzero(block.column(2).to_numpy(zero_copy_only=False))
                best, score = [UNKNOWN] * block.num_rows, np.zeros(block.num_rows)
                if len(known):
                    p = net.probabilities([t.encode() for t in block.column(3).take(pa.array(known)).to_pylist()])
                    for i, k in zip(known.tolist(), p.argmax(axis=1).tolist(), strict=True):
                        best[i] = net.languages[k]
                    score[known] = p.max(axis=1)
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return d.select("doc_id", "held_out", told.alias("told"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
