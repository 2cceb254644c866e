"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters with a learned vector of its own if it is in the vocabulary, with the mean of learned vectors of its
character n-grams, and with how much its word and its n-grams lean to toxic documents in the training sample. Windows
of ``WINDOW`` words, each overlapping the next, are run through a GRU in both directions; attention weighs the states
and a linear layer scores the window. A document's score is that of its highest window, calibrated on documents that
the network was not fitted on. What depends on a word alone is computed once for each distinct word of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied, whole_row
from .quality import sampled
from .textops import _powers, mix

#: Labelled rows of either label that the network is fitted on at most.
SAMPLE = 3000
#: Bytes of text of either label that are brought to the driver for it.
SAMPLE_BYTES = 32 << 20
THRESHOLD = 0.3
WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 4, 4
BUCKETS = 1 << 15
VOCABULARY = 4096
_WORD = re.compile(r"\w+")
_GRAMS = (3, 4, 5, 6, 7)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of ^word$ for every word, word after word, and how many each word has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-8", "replace"), np.uint8)
    begin = np.flatnonzero(np.r_[True, data[:-1] == 36])  # "$" is in no word
    end = np.r_[begin[1:], len(data)]
    left = np.repeat(end, end - begin) - np.arange(len(data))  # bytes to the word's end
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    owner = np.repeat(np.arange(len(begin)), end - begin)
    keys, owners = [], []
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        for n in _GRAMS:
            at = np.flatnonzero(left >= n)
            keys.append(mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n)) & np.uint64(BUCKETS - 1))
            owners.append(owner[at])
    keys, owners = np.concatenate(keys).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.bincount(owners, minlength=len(words))


def leaning(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-odds of being seen in toxic documents, pulled to 0 by one standard error."""
    a, b = toxic + 0.5, clean + 0.5 * max(1.0, n_clean / max(1, n_toxic))
    odds = np.log(a / (n_toxic + 1)) - np.log(b / (n_clean + 1))
    return (np.sign(odds) * np.maximum(0, np.abs(odds) - np.sqrt(1 / a + 1 / b))).astype(np.float32)


def windows(n: int) -> list[tuple[int, int]]:
    """Every window of n words, each overlapping the next; none for no words."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - WINDOW + STRIDE), STRIDE)] if n else []


class _Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """The network's arrays; ``fit`` trains them, ``raw`` scores texts."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        d, h = 4 + WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *s, scale=0.3: (scale * rng.standard_normal(s)).astype(np.float32)
        self.p = {"word": draw(VOCABULARY + 1, WORD_DIM, scale=0.05), "char": draw(BUCKETS, CHAR_DIM, scale=0.05), "att": draw(2 * h), "out": draw(2 * h), "bias": np.zeros(1, np.float32)}
        for k in ("f", "b"):
            self.p |= {f"w{k}": draw(d, 3 * h), f"u{k}": draw(h, 3 * h), f"c{k}": np.zeros(3 * h, np.float32)}
        self.words: dict[str, int] = {}
        self.word_lean, self.char_lean = np.zeros(VOCABULARY + 1, np.float32), np.zeros(BUCKETS, np.float32)
        self.a, self.b = 1.0, 0.0

    # --- what depends on a word alone
    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        ids = np.fromiter((self.words.get(w, VOCABULARY) for w in words), np.int64, len(words))
        keys, counts = grams(words)
        starts = np.cumsum(counts) - counts
        n = np.maximum(counts, 1).astype(np.float32)[:, None]
        lean = self.char_lean[keys]
        some = counts > 0
        high, mean = np.zeros(len(words), np.float32), np.zeros(len(words), np.float32)
        chars = np.zeros((len(words), CHAR_DIM), np.float32)
        if some.any():
            high[some] = np.maximum.reduceat(lean, starts[some])
            mean[some] = np.add.reduceat(lean, starts[some]) / n[some, 0]
            chars[some] = np.add.reduceat(self.p["char"][keys], starts[some]) / n[some]
        lens = np.fromiter(map(len, words), np.float32, len(words)) / 10
        return np.concatenate([self.word_lean[ids][:, None], high[:, None], mean[:, None], lens[:, None], self.p["word"][ids], chars], 1), (ids, keys, counts, n)

    def _run(self, gates: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: bool):
        """States by place, [windows, places, HIDDEN]; gates are the inputs' share of [windows, places, 3 HIDDEN]."""
        many, length, _ = gates.shape
        h, state, tape = HIDDEN, np.zeros((many, HIDDEN), np.float32), []
        out = np.zeros((many, length, h), np.float32)
        for t in range(length - 1, -1, -1) if back else range(length):
            g, m = gates[:, t], mask[:, t, None]
            rec = state @ u
            zr = _sigmoid(g[:, : 2 * h] + rec[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            cand = np.tanh(g[:, 2 * h :] + r * rec[:, 2 * h :])
            new = state + m * z * (cand - state)
            if keep:
                tape.append((t, state, z, r, cand, rec[:, 2 * h :], m))
            state = new
            out[:, t] = state
        return out, tape

    def forward(self, per_word: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Raw window scores. per_word: the gates' inputs of each distinct word; at: words of each window."""
        f, tf = self._run(per_word["f"][at], mask, self.p["uf"], False, keep)
        b, tb = self._run(per_word["b"][at], mask, self.p["ub"], True, keep)
        states = np.concatenate([f, b], 2)
        e = np.where(mask > 0, states @ self.p["att"], np.float32(-1e9))
        e = np.exp(e - e.max(1, keepdims=True))
        weight = e / e.sum(1, keepdims=True)
        pooled = np.matmul(weight[:, None], states)[:, 0]
        return pooled @ self.p["out"] + self.p["bias"], (states, weight, pooled, tf, tb)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {k: x @ self.p[f"w{k}"] + self.p[f"c{k}"] for k in ("f", "b")}

    def _backward(self, dy: np.ndarray, saved, at: np.ndarray, mask: np.ndarray, x: np.ndarray, parts) -> dict[str, np.ndarray]:
        states, weight, pooled, tf, tb = saved
        h, g = HIDDEN, {"out": pooled.T @ dy, "bias": np.array([dy.sum()], np.float32)}
        dpool = dy[:, None] * self.p["out"]
        dweight = (states * dpool[:, None]).sum(2)
        de = weight * (dweight - (weight * dweight).sum(1, keepdims=True)) * (mask > 0)
        g["att"] = np.einsum("bl,blh->h", de, states)
        dstates = weight[:, :, None] * dpool[:, None] + de[:, :, None] * self.p["att"]
        dx = np.zeros_like(x)
        for k, tape, part in (("f", tf, slice(0, h)), ("b", tb, slice(h, 2 * h))):
            u, du = self.p[f"u{k}"], np.zeros_like(self.p[f"u{k}"])
            dgates = np.zeros((*at.shape, 3 * h), np.float32)
            carry = np.zeros((len(at), h), np.float32)
            for t, state, z, r, cand, rec, m in reversed(tape):
                d = carry + dstates[:, t, part]
                dm = d * m
                dz, dc = dm * (cand - state), dm * z
                dct = dc * (1 - cand**2)
                dr = dct * rec
                dg = np.concatenate([dz * z * (1 - z), dr * r * (1 - r), dct], 1)
                drec = dg.copy()
                drec[:, 2 * h :] *= r
                du += state.T @ drec
                carry = d - dm * z + drec @ u.T
                dgates[:, t] = dg
            flat = np.zeros((len(x), 3 * h), np.float32)
            np.add.at(flat, at.ravel(), dgates.reshape(-1, 3 * h))
            g |= {f"u{k}": du, f"w{k}": x.T @ flat, f"c{k}": flat.sum(0)}
            dx += flat @ self.p[f"w{k}"].T
        ids, keys, counts, n = parts
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(g["word"], ids, dx[:, 4 : 4 + WORD_DIM])
        np.add.at(g["char"], keys, np.repeat(dx[:, 4 + WORD_DIM :] / n, counts, 0))
        return g

    # --- training
    def fit(self, texts: list[str | None], y: np.ndarray, shares: tuple[float, float], epochs: int = 8, seed: int = 2, rate: float = 0.01) -> "Network":
        """Fits texts and labels; shares: the part that labels 0 and 1 have among all labelled rows."""
        y = np.asarray(y, np.float32)
        if not len(y) or y.min() == y.max():
            p = float(np.clip(shares[1], 1e-3, 1 - 1e-3)) if len(y) else 0.5
            self.a, self.b = 0.0, float(np.log(p / (1 - p)))
            return self
        number: dict[str, int] = {}
        docs = [np.fromiter((number.setdefault(w, len(number)) for w in tokens(t)), np.int32) for t in texts]
        vocabulary = list(number)
        rng = np.random.default_rng(seed)
        own = rng.random(len(y)) >= 0.25  # the others calibrate
        n = {k: int(((y == k) & own).sum()) for k in (1, 0)}
        counts = np.zeros((2, len(vocabulary)))
        for d, label in zip((d for d, o in zip(docs, own, strict=True) if o), y[own], strict=True):
            counts[int(label), np.unique(d)] += 1
        lean = leaning(counts[1], counts[0], n[1], n[0])
        chosen = sorted(np.flatnonzero(counts.sum(0)).tolist(), key=lambda i: (-abs(lean[i]) - 0.01 * np.log1p(counts[:, i].sum()), vocabulary[i]))[:VOCABULARY]
        self.words = {vocabulary[i]: k for k, i in enumerate(chosen)}
        self.word_lean[: len(chosen)] = lean[chosen]
        # each n-gram counts once a document
        hits = np.zeros((2, BUCKETS))
        blocks = [grams(vocabulary[i : i + 10_000]) for i in range(0, len(vocabulary), 10_000)]
        keys = np.concatenate([k.astype(np.uint16) for k, _ in blocks] or [np.zeros(0, np.uint16)])
        per = np.concatenate([c for _, c in blocks] or [np.zeros(0, np.int64)])
        del blocks
        ends = np.cumsum(per)
        for d, label in zip((d for d, o in zip(docs, own, strict=True) if o), y[own], strict=True):
            if len(d):
                u = np.unique(d)
                edge = np.cumsum(per[u])
                hits[int(label), np.unique(keys[np.arange(edge[-1]) + np.repeat(ends[u] - edge, per[u])])] += 1
        del keys
        self.char_lean = leaning(hits[1], hits[0], n[1], n[0])
        lean = np.where(np.isin(np.arange(len(vocabulary)), chosen), lean, 0)

        spans = [windows(len(d)) for d in docs]
        train = [i for i in np.flatnonzero(own) if spans[i]]
        adam = _Adam(self.p, rate)
        for epoch in range(epochs):
            best = self._window_scores(docs, vocabulary, train) if epoch else None
            chosen_windows = []
            for k, i in enumerate(train):
                scores = best[k] if best is not None else np.array([max(lean[docs[i][a:b]].max(), 0) for a, b in spans[i]])
                order = np.argsort(-scores, kind="stable")
                take = order[:1] if y[i] else [*order[:2], *rng.choice(len(scores), 1)]
                chosen_windows += [(i, *spans[i][j], y[i]) for j in dict.fromkeys(int(j) for j in take)]
            rng.shuffle(chosen_windows)
            adam.rate = rate * (1 - epoch / epochs) ** 0.5
            for k in range(0, len(chosen_windows), 128):
                part = chosen_windows[k : k + 128]
                words, at, mask = self._batch([[vocabulary[j] for j in docs[int(i)][int(a) : int(b)]] for i, a, b, _ in part])
                x, extra = self.inputs(words)
                s, saved = self.forward(self.gates(x), at, mask, keep=True)
                target = np.array([label for *_, label in part], np.float32)
                p = _sigmoid(s)
                w = np.where(target > 0, 1.0, 0.5).astype(np.float32)
                adam.step(self._backward(((p - target) * w / len(part)).astype(np.float32), saved, at, mask, x, extra))
        held = [i for i in np.flatnonzero(~own) if spans[i]]
        s = np.array([v.max() for v in self._window_scores(docs, vocabulary, held)]) if held else np.zeros(0)
        self._calibrate(s, y[held], shares)
        return self

    def _calibrate(self, s: np.ndarray, y: np.ndarray, shares: tuple[float, float]) -> None:
        """Platt's two numbers, by Newton steps; rows weigh as their label's part of all labelled rows."""
        if not len(y) or y.min() == y.max():
            return
        weight = np.where(y > 0, shares[1] / max(1, (y > 0).sum()), shares[0] / max(1, (y == 0).sum()))
        weight = weight / weight.mean()
        z, beta = np.stack([np.clip(s, -12, 12), np.ones(len(s))], 1), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ beta))
            grad = z.T @ (weight * (p - y)) + 1e-2 * (beta - [1.0, 0.0])
            hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
            beta = beta - np.linalg.solve(hess, grad)
        self.a, self.b = float(max(beta[0], 0.05)), float(beta[1])

    # --- scoring
    @staticmethod
    def _batch(parts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        at, mask = np.zeros((len(parts), WINDOW), np.int64), np.zeros((len(parts), WINDOW), np.float32)
        for row, m, p in zip(at, mask, parts, strict=True):
            row[: len(p)] = [number.setdefault(w, len(number)) for w in p]
            m[: len(p)] = 1
        return list(number), at, mask

    def _window_scores(self, docs: list[np.ndarray], vocabulary: list[str], rows: list[int]) -> list[np.ndarray]:
        out = []
        for k in range(0, len(rows), 64):
            out += self._scores([[vocabulary[j] for j in docs[i]] for i in rows[k : k + 64]])
        return out

    def _scores(self, docs: list[list[str]], most: int = 2048) -> list[np.ndarray]:
        """Raw scores of all windows of each document."""
        number: dict[str, int] = {}
        flat = [np.fromiter((number.setdefault(w, len(number)) for w in d), np.int64, len(d)) for d in docs]
        gates = self.gates(self.inputs(list(number))[0])
        spans = [windows(len(d)) for d in docs]
        n = sum(map(len, spans))
        at, mask, k = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.float32), 0
        for ids, own in zip(flat, spans, strict=True):
            for a, b in own:
                at[k, : b - a], mask[k, : b - a] = ids[a:b], 1
                k += 1
        raw = np.concatenate([self.forward(gates, at[i : i + most], mask[i : i + most])[0] for i in range(0, n, most)] or [np.zeros(0, np.float32)])
        return np.split(raw, np.cumsum([len(s) for s in spans])[:-1]) if docs else []

    def score(self, texts: list[str | None], words: int = 30_000) -> np.ndarray:
        """The calibrated score of every text's highest window; without words, of a window of score -3."""
        out, some, size = [], [], 0
        todo = [tokens(t) for t in texts]
        for k, d in enumerate(todo):
            some.append(d)
            size += len(d)
            if size >= words or k == len(todo) - 1:
                out += [s.max() if len(s) else -3.0 for s in self._scores(some)]
                some, size = [], 0
        return 1 / (1 + np.exp(-(self.a * np.clip(np.array(out, float), -12, 12) + self.b)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: "F.Column | None" = None, sample: int = SAMPLE) -> Network:
    """A network from at most ``sample`` ids of either label with ``SAMPLE_BYTES`` of text, of those that ``learn`` lets through."""
    learn = F.lit(True) if learn is None else learn
    totals = {r[0]: r[1] for r in labels.filter(learn & F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect()}
    n = max(1, sum(totals.values()))
    rows = []
    for k in (0, 1):
        rows += [(r["doc_id"], r["text"], k) for r in sampled(docs, labels.filter(F.col(label) == k), label, learn, sample, SAMPLE_BYTES).collect()]
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    return Network().fit([r[1] for r in rows], np.array([r[2] for r in rows]), (totals.get(0, 0) / n, totals.get(1, 0) / n))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and score (0 to 1) of every row.

    Only the text is looked at, whole. Null and empty texts get a low score; a network fitted on no rows, or on one
    label only, scores every row alike. Repeated rows are scored each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                s = network.score(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, score double")


def kept(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whatever their names, whose text scores below ``threshold``.

    Null and empty texts have a score too; repeated rows share one; a very long text scores as its worst window; a score
    equal to ``threshold`` rejects; an empty table gives no rows.
    """
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                fields = whole.slice(at, 256).column("row").flatten()
                yield pa.RecordBatch.from_arrays(fields, names).filter(pa.array(network.score(fields[place].to_pylist()) < threshold))

    return docs.select(whole_row(docs).alias("row")).mapInArrow(tidied(run), docs.schema)
