"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads windows of a text: whole words of a line, as many as WINDOW_BYTES holds (longer words are cut
between characters). Its states run through a window forwards and backwards and label every byte there; a
document's probabilities are the mean over the bytes of its windows with a letter. A window is what a label
depends on, so a window that stands in a corpus again (copies, repeated lines) is read once a worker.
Training is backpropagation through time over a bounded, stratified sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall.llm.common import hold, learn_split, slices

WINDOW_BYTES = 96
UNDETERMINED = "und"
#: The bound of the training sample: documents of a language, and windows of a document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 4
EMBEDDING, HIDDEN = 16, 16
REMEMBERED_WINDOWS = 60_000
#: Windows that go through the network together.
TOGETHER = 1024
#: A document stays in the corpus if its language is known with this probability.
CONFIDENT = 0.3


def windows_of(data: bytes) -> list[bytes]:
    """The windows of a text: lines with one blank between words, cut at blanks to at most WINDOW_BYTES; a word that
    alone is longer is cut between characters."""
    out = []
    for line in data.split(b"\n"):
        line = b" ".join(line.split())
        at, n = 0, len(line)
        while n - at > WINDOW_BYTES:
            end = line.rfind(b" ", at, at + WINDOW_BYTES + 1)
            if end > at:
                out.append(line[at:end])
                at = end + 1
                continue
            end = at + WINDOW_BYTES
            while end > at + WINDOW_BYTES - 4 and line[end] & 0xC0 == 0x80:  # inside a character
                end -= 1
            out.append(line[at:end])
            at = end
        if at < n:
            out.append(line[at:])
    return out


def has_letter(window: bytes) -> bool:
    return any(map(str.isalpha, window.decode(errors="ignore")))


def padded(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, windows) of bytes with zeros behind each window; the lengths; and for each place the place that it has
    in the window read backwards (for places behind the end: themselves)."""
    size = np.array([len(w) for w in windows])
    steps = int(size.max())
    x = np.frombuffer(b"".join(w.ljust(steps, b"\0") for w in windows), np.uint8).reshape(len(windows), steps).T.astype(np.intp)
    t = np.arange(steps)[:, None]
    return x, size, np.where(t < size, size - 1 - t, t)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteGru:
    """Weights: embedding E; for each direction input W, recurrent U, bias b, output V; output bias c."""

    def __init__(self, classes: list[str], embedding: int = EMBEDDING, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.classes, self.hidden = classes, hidden
        self.p = {"E": w(256, embedding) * 4, "c": np.zeros(len(classes), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": w(embedding, 3 * hidden), f"U{d}": w(hidden, 3 * hidden), f"b{d}": np.zeros(3 * hidden, np.float32), f"V{d}": w(hidden, len(classes))}

    def scores(self, x: np.ndarray, d: str) -> np.ndarray:
        """(steps, windows, classes): what one direction, reading x (steps, windows) from the first step on, adds to each byte's classes.

        A gate's sigmoid is half a hyperbolic tangent of half its input and a half; the halves are in the weights."""
        H, U, V = self.hidden, self.p[f"U{d}"], self.p[f"V{d}"]
        table = self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]
        gates, inner, U_gates, U_inner = 0.5 * table[:, : 2 * H], np.ascontiguousarray(table[:, 2 * H :]), 0.5 * U[:, : 2 * H], 0.5 * U[:, 2 * H :]
        h, out = np.zeros((x.shape[1], H), U.dtype), np.empty((*x.shape, len(self.classes)), U.dtype)
        for t in range(len(x)):
            g = gates.take(x[t], axis=0)
            g += h @ U_gates
            np.tanh(g, out=g)
            g += 1
            c = h @ U_inner
            c *= g[:, H:]
            c += inner.take(x[t], axis=0)
            np.tanh(c, out=c)
            c -= h
            c *= g[:, :H]
            c *= 0.5
            h = h + c
            np.matmul(h, V, out=out[t])
        return out

    def probabilities(self, windows: list[bytes]) -> np.ndarray:
        """(windows, classes): the sums of the labels' probabilities over the bytes of each window."""
        x, size, turned = padded(windows)
        s = np.take_along_axis(self.scores(np.take_along_axis(x, turned, 0), "b"), turned[:, :, None], 0)
        s += self.scores(x, "f")
        s += self.p["c"]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        s *= (np.arange(len(x))[:, None] < size)[:, :, None]
        return s.sum(0)

    def states(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """The states of one direction over x, and what each step computed."""
        h, H = np.zeros((x.shape[1], self.hidden), self.p["E"].dtype), self.hidden
        table, U = self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"], self.p[f"U{d}"]
        out, steps = np.empty((*x.shape, H), h.dtype), []
        for t in range(len(x)):
            a, u = table[x[t]], h @ U
            zr = _sigmoid(a[:, : 2 * H] + u[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(a[:, 2 * H :] + r * u[:, 2 * H :])
            steps.append((h, z, r, c, u[:, 2 * H :]))
            h = h + z * (c - h)
            out[t] = h
        return out, steps

    def gradients(self, windows: list[bytes], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all bytes of the windows, which have the labels y, and its gradients through time."""
        H, g = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        x, size, turned = padded(windows)
        there = np.arange(len(x))[:, None] < size
        back_x = np.take_along_axis(x, turned, 0)
        (hf, sf), (hb, sb) = self.states(x, "f"), self.states(back_x, "b")
        s = hf @ self.p["Vf"] + np.take_along_axis(hb @ self.p["Vb"], turned[:, :, None], 0) + self.p["c"]
        e = np.exp(s - s.max(axis=2, keepdims=True))
        p = e / e.sum(axis=2, keepdims=True)
        n = int(size.sum())
        loss = -(np.log(p[:, np.arange(len(y)), y] + 1e-9) * there).sum() / n
        p[:, np.arange(len(y)), y] -= 1
        p *= there[:, :, None] / n
        g["c"] = p.sum((0, 1))
        for d, at, h, steps, dp in (("f", x, hf, sf, p), ("b", back_x, hb, sb, np.take_along_axis(p, turned[:, :, None], 0))):
            g[f"V{d}"] = h.reshape(-1, H).T @ dp.reshape(-1, dp.shape[2])
            dh_all = dp @ self.p[f"V{d}"].T
            back, U = np.zeros((x.shape[1], H), h.dtype), self.p[f"U{d}"]
            into = np.empty((*x.shape, 3 * H), h.dtype)
            for t in range(len(x) - 1, -1, -1):
                before, z, r, c, u = steps[t]
                dh = dh_all[t] + back
                dc = dh * z * (1 - c * c)
                dz = dh * (c - before) * z * (1 - z)
                dr = dc * u * r * (1 - r)
                into[t] = np.concatenate([dz, dr, dc], axis=1)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"U{d}"] += before.T @ du
                back = dh * (1 - z) + du @ U.T
            # the inputs' gradients, summed for each byte value at once
            flat, each = at.reshape(-1), into.reshape(-1, 3 * H)
            order = np.argsort(flat, kind="stable")
            values, first = np.unique(flat[order], return_index=True)
            of_byte = np.add.reduceat(each[order], first, axis=0)
            g[f"b{d}"] = of_byte.sum(0)
            g[f"W{d}"] = self.p["E"][values].T @ of_byte
            g["E"][values] += of_byte @ self.p[f"W{d}"].T
        return float(loss), g

    def train(self, windows: list[bytes], labels: np.ndarray, epochs: int = 3, batch: int = 128, rate: float = 0.02, seed: int = 11) -> ByteGru:
        """Adam over batches of windows of about one length."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        size, step = np.array([len(w) for w in windows]), 0
        for epoch in range(epochs):
            mixed = rng.permutation(len(windows))
            by_size = mixed[np.argsort(size[mixed] // 16, kind="stable")]
            batches = np.array_split(by_size, -(-len(by_size) // batch)) if len(by_size) else []
            for k in rng.permutation(len(batches)):
                _, g = self.gradients([windows[i] for i in batches[k]], labels[batches[k]])
                step += 1
                lr = rate * (0.5**epoch) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name, d in g.items():
                    np.clip(d, -1, 1, out=d)
                    m[name] += 0.1 * (d - m[name])
                    s[name] += 0.001 * (d * d - s[name])
                    self.p[name] -= (lr * m[name] / (np.sqrt(s[name]) + 1e-8)).astype(np.float32)
        return self


class _Read(dict):
    """Numbers of windows; the labels' sums over each window's bytes, and the bytes (none without a letter)."""

    def __init__(self, model: ByteGru):
        super().__init__()
        self.model, self.new = model, []
        self.sums, self.size = np.zeros((1 << 14, len(model.classes)), np.float32), np.zeros(1 << 14, np.float32)

    def __missing__(self, window: bytes) -> int:
        n = self[window] = len(self)
        self.new.append(window)
        return n

    def learn(self) -> None:
        windows, self.new = self.new, []
        first = len(self) - len(windows)
        while len(self) > len(self.size):
            self.sums, self.size = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.size, np.zeros_like(self.size)])
        lengths = np.array([len(w) if has_letter(w) else 0 for w in windows], dtype=np.int64)
        at = np.argsort(lengths, kind="stable")[int((lengths == 0).sum()) :]
        for part in np.array_split(at, -(-len(at) // TOGETHER)) if len(at) else []:
            self.sums[first + part] = self.model.probabilities([windows[i] for i in part])
        self.size[first : first + len(windows)] = lengths


_read: dict[str, _Read] = {}


def _reader(key: str, model: ByteGru) -> _Read:
    hold("language_id", _read.clear)
    if key not in _read or len(_read[key]) > REMEMBERED_WINDOWS:
        _read.clear()
        _read[key] = _Read(model)
    return _read[key]


def _predict(key: str, model: ByteGru):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            reader = _reader(key, model)
            windows = [windows_of((t or "").encode(errors="replace")) for t in b.column("text").to_pylist()]
            n = np.array([len(r) for r in windows])
            at = np.fromiter(map(reader.__getitem__, chain.from_iterable(windows)), np.int64, int(n.sum()))
            reader.learn()
            total, size = np.zeros((len(n), len(model.classes))), np.zeros(len(n))
            if len(at):
                starts = (np.cumsum(n) - n)[n > 0]
                total[n > 0], size[n > 0] = np.add.reduceat(reader.sums[at], starts, dtype=np.float64), np.add.reduceat(reader.size[at], starts, dtype=np.float64)
            mean = total / np.maximum(size, 1)[:, None]
            best = mean.argmax(1)
            lang = [model.classes[k] if s else UNDETERMINED for k, s in zip(best, size, strict=True)]
            score = np.where(size > 0, np.minimum(mean.max(1), 1.0), 0.0)
            keep = [b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(lang), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    return predict


def _some_windows(k: int):
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for h, t in zip(b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True):
                windows = [w for w in windows_of(t.encode(errors="replace")) if has_letter(w)]
                at = np.random.default_rng(h & 0x7FFFFFFF).integers(0, len(windows), k) if windows else []
                out.append([windows[i] for i in at])
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(out, pa.list_(pa.binary()))], ["lang", "windows"])

    return some


def training_windows(docs: DataFrame, sample_docs: int, sample_windows: int) -> tuple[list[bytes], list[str]]:
    """Windows and their languages from about sample_docs learning documents of each language, chosen by the hash of
    the id, and sample_windows windows of each; so many and no more reach the driver."""
    learn = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null").filter(~learn_split("doc_id"))
    counts = learn.groupBy("lang").count().withColumnRenamed("lang", "l")  # a row for each language
    h = F.xxhash64("doc_id", F.lit("sample"))
    dealt = learn.join(F.broadcast(counts), F.col("lang") == F.col("l")).filter(F.pmod(h, F.lit(1 << 40)) < F.lit(sample_docs) / F.col("count") * (1 << 40))
    windows, langs = [], []
    for row in dealt.select(h.alias("h"), "lang", "text").mapInArrow(_some_windows(sample_windows), "lang string, windows array<binary>").collect():
        windows += row["windows"]
        langs += [row["lang"]] * len(row["windows"])
    return [bytes(w) for w in windows], langs


def train_language_model(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> ByteGru:
    """The network for the languages of docs (doc_id, text, lang), learned from rows that aren't held out."""
    windows, langs = training_windows(docs, sample_docs, sample_windows)
    order = sorted(range(len(windows)), key=lambda i: (langs[i], windows[i]))  # the same whatever order rows come in
    windows, langs = [windows[i] for i in order], [langs[i] for i in order]
    classes = sorted(set(langs)) or [UNDETERMINED]
    number = {c: i for i, c in enumerate(classes)}
    return ByteGru(classes).train(windows, np.array([number[x] for x in langs], dtype=np.int64))


def predict_language(docs: DataFrame, model: ByteGru) -> DataFrame:
    """docs (any columns, among them text) with lang_pred and score; columns of those names are replaced.

    A text that is null, empty or without a letter is UNDETERMINED with score 0. Every byte of every
    text counts. Null ids and repeated rows keep their rows; empty tables give none.
    """
    import uuid

    from pyspark.sql import types as T

    rows = docs.drop("lang_pred", "score")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(uuid.uuid4().hex, model), schema)
