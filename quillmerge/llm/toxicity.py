"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs.

A word enters as the sum of a word embedding (row 0 for words too rare in the
sample) and the mean of its hashed character-trigram embeddings; one input tells
how unevenly the word's starts (the whole word the longest) fall on the classes.  A window of words runs through a GRU in either
direction; attention pools the states into one vector and a logistic unit scores
the window.  A document is scored over all its overlapping windows and keeps the
highest.  Training is plain numpy (manual gradients, Adam) on a bounded sample of
labelled documents; scoring runs in Arrow batches on the executors, where each
distinct word's gate inputs are computed once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmerge.llm.arrow import plus, steps, texts


#: Longest word, and the hop between the parts of a longer one.
PART, HOP = 24, 16


@dataclass(frozen=True)
class Settings:
    """Sizes and bounds of the model; the training sample is the only bounded input."""

    window: int = 40  #: words in a window
    stride: int = 20  #: words between window starts: half a window, so that a run of 20 words lies whole in one
    dim: int = 12  #: width of word and character embeddings
    hidden: int = 8  #: GRU width in each direction
    attention: int = 4  #: width of the attention layer
    word_rows: int = 1 << 15  #: words with an embedding of their own at most
    word_docs: int = 5  #: sampled documents that such a word (or word start) is in at least
    head_buckets: int = 1 << 17
    head_bytes: int = 12  #: longest word start that is told apart
    char_buckets: int = 1 << 12
    char_bytes: int = PART  #: bytes that the character input takes; a longer word enters as overlapping parts of so many
    sample_docs: int = 1200  #: labelled documents of each class that training uses at most
    sample_doc_bytes: int = 1 << 16  #: a longer labelled document isn't learnt from
    windows_per_doc: int = 3
    epochs: int = 4
    batch: int = 96
    rate: float = 0.02
    decay: float = 0.02  #: pull of the embeddings towards their start, times the rate
    char_rate: float = 0.02  #: learning rate of the character embeddings, times the rate
    char_start: float = 0.03
    few: int = 5_000  #: windows that training sees at least, by more epochs over small samples
    seed: int = 7


#: Parts of the training sample that see each other's word statistics.
FOLDS = 4
#: Bytes that separate words: all ASCII that is neither letter nor digit; A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


#: Spaces, punctuation and symbols beyond ASCII, which separate words too.
MARKS = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u1680\u2000-\u200a\u2010-\u205f\u2190-\u2bff\u2e00-\u2e7f\u3000-\u3004\u3008-\u3020\u30fb\ufe30-\ufe6f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case, also beyond ASCII; one of over PART bytes as its parts, each overlapping the next."""
    if not text.isascii():
        text = MARKS.sub(" ", text.decode().lower()).encode()
    words = text.translate(FOLD).split()
    if max(map(len, words), default=0) <= PART:
        return words
    return [w[i : i + PART] for w in words for i in range(0, max(1, len(w) - PART + HOP), HOP)]


def window_starts(n: int, s: Settings) -> np.ndarray:
    """Starts of the windows that cover n words with overlap; one (empty) window for no words."""
    if n <= s.window:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - s.window, s.stride), n - s.window)


def features(words: list[bytes], known: dict[bytes, int], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word row, character-trigram buckets, buckets of its starts) of each word; -1 marks an absent trigram."""
    n = len(words)
    ids = np.fromiter((known.get(w, 0) for w in words), np.int64, n)
    raw = np.frombuffer(b"".join((b"<" + w[: s.char_bytes] + b">").ljust(s.char_bytes + 2, b"\0") for w in words), np.uint8).reshape(n, -1).astype(np.int64)
    tri = (raw[:, :-2] * 961 + raw[:, 1:-1] * 31 + raw[:, 2:]) * 2654435761 % (1 << 32) % s.char_buckets
    return ids, np.where(raw[:, 2:] > 0, tri, -1), heads(raw, s)


def heads(raw: np.ndarray, s: Settings) -> np.ndarray:
    """Buckets of the starts of 2 to head_bytes bytes of each word, its end mark included; -1: no such start."""
    out = np.full((len(raw), s.head_bytes - 1), -1)
    h = raw[:, 1].copy()
    for i in range(2, s.head_bytes + 1):
        h = (h * 1000003 + raw[:, i]) & 0xFFFFFFFF
        out[:, i - 2] = np.where(raw[:, i] > 0, (h ^ h >> 15) % s.head_buckets, -1)
    return out


def most_telling(telling: np.ndarray, head: np.ndarray) -> np.ndarray:
    return np.where(head >= 0, telling[head], 0).max(axis=1)


def telling_of(heads_of: list[np.ndarray], labels: np.ndarray, s: Settings) -> np.ndarray:
    """Log ratio of each start's shares in toxic and clean documents, as far as it is beyond chance."""
    held = {y: np.zeros(s.head_buckets) for y in (0, 1)}
    for buckets, y in zip(heads_of, labels.tolist(), strict=True):
        held[y][buckets[buckets >= 0]] += 1
    n = {y: max(int((labels == y).sum()), 1) for y in (0, 1)}
    every = held[0] + held[1]
    both = every / max(len(labels), 1)
    z = (held[1] / n[1] - held[0] / n[0]) / np.sqrt(both * (1 - both) * (1 / n[1] + 1 / n[0]) + 1e-9)
    ratio = np.log((held[1] + 0.5) / (n[1] + 0.5)) - np.log((held[0] + 0.5) / (n[0] + 0.5))
    return np.where(every >= s.word_docs, ratio * np.minimum(1, z * z / 30), 0).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    s: Settings
    known: dict[bytes, int] = field(default_factory=dict)
    p: dict[str, np.ndarray] = field(default_factory=dict)
    telling: np.ndarray | None = None  #: of each bucket of word starts

    @classmethod
    def fresh(cls, s: Settings, known: dict[bytes, int]) -> Model:
        r = np.random.default_rng(s.seed)
        f = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        p = {"word": f(len(known) + 1, s.dim, scale=0.05), "char": f(s.char_buckets, s.dim, scale=s.char_start)}
        for d in "fb":
            p |= {f"W{d}": f(s.dim, 3 * s.hidden, scale=s.dim**-0.5), f"U{d}": f(s.hidden, 3 * s.hidden, scale=s.hidden**-0.5), f"c{d}": np.zeros(3 * s.hidden, np.float32)}
        p |= {"A": f(2 * s.hidden, s.attention, scale=(2 * s.hidden) ** -0.5), "v": f(s.attention, scale=0.5), "o": f(2 * s.hidden, scale=0.5), "o0": np.full(1, -1.0, np.float32)}
        return cls(s, known, p, np.zeros(s.head_buckets, np.float32))

    def inputs(self, ids: np.ndarray, tri: np.ndarray, told: np.ndarray) -> np.ndarray:
        """The input vector of each word."""
        there = (tri >= 0)[..., None]
        chars = (self.p["char"][tri] * there).sum(axis=1) / np.maximum(there.sum(axis=1), 1)
        vec = (self.p["word"][ids] + chars).astype(np.float32)
        vec[:, 0] += 0.4 * told
        return vec

    def told(self, head: np.ndarray) -> np.ndarray:
        """The most telling of each word's starts."""
        return most_telling(self.telling, head)

    def _cell(self, x: np.ndarray, h: np.ndarray, d: str):
        k = self.s.hidden
        u = h @ self.p[f"U{d}"]
        zr = sigmoid(x[:, : 2 * k] + u[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        c = np.tanh(x[:, 2 * k :] + r * u[:, 2 * k :])
        return c + z * (h - c), (z, r, c, u[:, 2 * k :])

    def states(self, gates: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """gates[d]: (T, n, 3 hidden); the (T, n, 2 hidden) states, padding carried through."""
        T, n = mask.shape
        k = self.s.hidden
        out, memo = np.empty((T, n, 2 * k), np.float32), {}
        for d, order, at in (("f", range(T), 0), ("b", range(T - 1, -1, -1), k)):
            h, steps_of = np.zeros((n, k), np.float32), []
            for t in order:
                new, parts = self._cell(gates[d][t], h, d)
                if keep:
                    steps_of.append((t, h, parts))
                h = h + (new - h) * mask[t][:, None]
                out[t, :, at : at + k] = h
            memo[d] = steps_of
        return out, memo

    def pooled(self, out: np.ndarray, mask: np.ndarray):
        a = np.tanh(out @ self.p["A"])
        e = a @ self.p["v"] + (mask - 1) * 30
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        return (out * w[..., None]).sum(axis=0), a, w

    def logits(self, gates: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        out, _ = self.states(gates, mask)
        pool, _, _ = self.pooled(out, mask)
        return pool @ self.p["o"] + self.p["o0"][0]

    def gradients(self, at: np.ndarray, ids: np.ndarray, tri: np.ndarray, told: np.ndarray, mask: np.ndarray, y: np.ndarray, heavy: float):
        """at: (T, n) rows of ids, tri and told, the batch's distinct words; the gradients. heavy: weight of label 1."""
        p, k = self.p, self.s.hidden
        vec = self.inputs(ids, tri, told)
        x = vec[at]
        gates = {d: x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}
        out, memo = self.states(gates, mask, keep=True)
        pool, a, w = self.pooled(out, mask)
        prob = sigmoid(pool @ p["o"] + p["o0"][0])
        g = {n: np.zeros_like(v) for n, v in p.items()}
        dl = ((prob - y) * np.where(y > 0, heavy, 1) / len(y)).astype(np.float32)
        g["o"], g["o0"][0] = pool.T @ dl, dl.sum()
        dpool = np.outer(dl, p["o"])
        dout = dpool[None] * w[..., None]
        dw = (out * dpool[None]).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.tensordot(de, a, ((0, 1), (0, 1)))
        da = de[..., None] * p["v"] * (1 - a * a)
        g["A"] = np.tensordot(out, da, ((0, 1), (0, 1)))
        dout = dout + da @ p["A"].T
        dx = np.zeros_like(x)
        for d, lo in (("f", 0), ("b", k)):
            U, dh = p[f"U{d}"], np.zeros((mask.shape[1], k), np.float32)
            for t, h, (z, r, c, uc) in reversed(memo[d]):
                dh = dh + dout[t, :, lo : lo + k]
                m = mask[t][:, None]
                dn, back = dh * m, dh * (1 - m)
                dz, dc = dn * (h - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
                dr = dc * uc * r * (1 - r)
                dgate = np.concatenate([dz, dr, dc], axis=1)
                drec = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"U{d}"] += h.T @ drec
                g[f"W{d}"] += x[t].T @ dgate
                g[f"c{d}"] += dgate.sum(axis=0)
                dx[t] += dgate @ p[f"W{d}"].T
                dh = back + dn * z + drec @ U.T
        dvec = np.zeros_like(vec)
        np.add.at(dvec, at.ravel(), dx.reshape(-1, dx.shape[2]))
        np.add.at(g["word"], ids, dvec)
        there = tri >= 0
        share = dvec / np.maximum(there.sum(axis=1), 1)[:, None]
        row, col = np.nonzero(there)
        np.add.at(g["char"], tri[row, col], share[row])
        return g


def laid_out(docs: list[tuple[np.ndarray, np.ndarray]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(T, n) word rows and mask of windows given as (word rows of the document, starts)."""
    cols, masks = [], []
    for rows, starts in docs:
        width = min(len(rows), s.window)
        span = starts[:, None] + np.arange(width)
        full = np.zeros((len(starts), s.window), np.int64)
        there = np.zeros((len(starts), s.window), np.float32)
        full[:, :width] = rows[span] if width else 0
        there[:, :width] = 1
        if not width:
            there[:, 0] = 1  # an empty text: one window of the padding word
        cols.append(full)
        masks.append(there)
    return np.concatenate(cols).T.copy(), np.concatenate(masks).T.copy()


def train(rows: list[tuple[bytes, int]], s: Settings) -> Model:
    """A model from (text, label) rows: fitted on four fifths, its cut placed on the rest.

    A document has the highest of many window scores, so the bias that suits single
    windows is too high for documents; it is moved to where the fewest of the
    documents kept aside are misjudged (the middle of the best stretch).
    """
    model = _fit_windows([x for i, x in enumerate(rows) if i % 5], s)
    aside = [x for i, x in enumerate(rows) if i % 5 == 0] if len(rows) >= 500 else rows
    if aside and len({y for _, y in aside}) == 2:
        scorer, logit = Scorer(model), []
        for i in range(0, len(aside), 64):
            logit.append(scorer.logits([t for t, _ in aside[i : i + 64]]))
        x, y = np.concatenate(logit), np.array([y for _, y in aside])
        order = np.argsort(x)
        x, y = np.clip(x[order], -6, 6), y[order]  # what lies far out says nothing about the cut
        wrong = np.concatenate(([0], np.cumsum(y))) + np.concatenate(([0], np.cumsum((1 - y)[::-1])))[::-1]
        edge = np.concatenate(([x[0] - 2], x, [x[-1] + 2]))
        best = np.flatnonzero(wrong == wrong.min())
        best = best[np.argmax(edge[best + 1] - edge[best])]
        model.p["o0"] = (model.p["o0"] - (edge[best] + edge[best + 1]) / 2).astype(np.float32)
    return model


def _fit_windows(rows: list[tuple[bytes, int]], s: Settings) -> Model:
    """The network itself.

    Labels belong to documents, so the windows to learn from are chosen first: of
    a labelled document those around its most telling words, of a
    clean one also spread windows.
    """
    r = np.random.default_rng(s.seed)
    split = [(words_of(t), y) for t, y in rows]
    docs_of = Counter(w for ws, _ in split for w in set(ws))
    often = sorted((w for w, c in docs_of.items() if c >= s.word_docs), key=lambda w: (-docs_of[w], w))[: s.word_rows]
    known = {w: i + 1 for i, w in enumerate(often)}
    model = Model.fresh(s, known)
    n = Counter(y for _, y in split)
    if len(n) < 2:  # nothing to tell apart
        model.p["o"][:] = 0
        model.p["o0"][0] = 4.0 if n[1] else -4.0
        return model
    # What a document's words tell is learnt from other documents while training, else the
    # network would trust it too far: fold k of the documents sees what the other folds tell.
    heads_of = [np.unique(features(sorted(set(ws)), known, s)[2]) if ws else np.empty(0, np.int64) for ws, _ in split]
    labels = np.array([y for _, y in split])
    fold = np.arange(len(split)) % FOLDS
    tells = [telling_of([h for h, f in zip(heads_of, fold, strict=True) if f != k], labels[fold != k], s) for k in range(FOLDS)]
    model.telling = telling_of(heads_of, labels, s)
    chosen: list[tuple[list[tuple[bytes, int]], int]] = []
    for (ws, y), k in zip(split, fold.tolist(), strict=True):
        starts = window_starts(len(ws), s)
        weight = most_telling(tells[k], features(ws, known, s)[2]) if ws else np.zeros(1)
        top = np.array([weight[i : i + s.window].max() for i in starts])
        best = starts[np.argsort(-top, kind="stable")[: s.windows_per_doc]]
        if y:
            best = starts[np.argsort(-top, kind="stable")[: 2 * s.windows_per_doc]]
            best = best[: max(1, int((top > 0.5 * top.max()).sum()))]
        else:  # where a clean document looks worst, and anywhere
            best = np.union1d(best, r.choice(starts, min(len(starts), s.windows_per_doc), replace=False))
        chosen += [([(w, k) for w in ws[i : i + s.window]], y) for i in best.tolist()]
    table: dict[tuple[bytes, int], int] = {(b"", 0): 0}
    for ws, _ in chosen:
        for w in ws:
            table.setdefault(w, len(table))
    ids, tri, head = features([w for w, _ in table], known, s)
    of = np.array([k for _, k in table])
    told = np.choose(of, [most_telling(t, head) for t in tells])
    at, mask = laid_out([(np.array([table[w] for w in ws], np.int64), np.zeros(1, np.int64)) for ws, _ in chosen], s)
    y = np.array([z for _, z in chosen], np.float32)
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step, heavy = 0, float(np.sqrt((y < 1).sum() / max(y.sum(), 1)))
    epochs = max(s.epochs, min(60, 1 + s.few // max(len(y), 1)))  # small samples get as many updates
    start = {k: model.p[k].copy() for k in ("word", "char")}
    for epoch in range(epochs):
        rate = s.rate * (1 - 0.9 * epoch / epochs)
        order = r.permutation(len(y))
        for i in range(0, len(y), s.batch):
            take = order[i : i + s.batch]
            used, rows_at = np.unique(at[:, take], return_inverse=True)
            g = model.gradients(rows_at.reshape(at.shape[0], -1), ids[used], tri[used], told[used], mask[:, take], y[take], heavy)
            step += 1
            for k, v in g.items():
                if k in ("word", "char"):  # only the rows of this batch
                    sel = np.unique(ids[used]) if k == "word" else np.unique(tri[used][tri[used] >= 0])
                    m1[k][sel] = 0.9 * m1[k][sel] + 0.1 * v[sel]
                    m2[k][sel] = 0.99 * m2[k][sel] + 0.01 * v[sel] ** 2
                    model.p[k][sel] -= rate * (s.char_rate if k == "char" else 1.0) * (m1[k][sel] / (np.sqrt(m2[k][sel]) + 1e-6) + s.decay * (model.p[k][sel] - start[k][sel]))
                else:
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    model.p[k] -= rate * 0.5 * fix * m1[k] / (np.sqrt(m2[k]) + 1e-6)
    return model


class Scorer:
    """Scores texts; keeps the gate inputs of the words seen, up to a bound."""

    def __init__(self, model: Model, most_words: int = 200_000):
        self.model, self.s, self.most = model, model.s, most_words
        self.row: dict[bytes, int] = {}
        self.passing: list[bytes] = []  # words beyond the bound, kept for one batch
        self.gate = np.zeros((1024, 6 * self.s.hidden), np.float32)
        self._add([b""])

    def _add(self, new: list[bytes]) -> None:
        first = len(self.row)
        self.row.update(zip(new, range(first, first + len(new)), strict=True))
        while len(self.gate) < len(self.row):
            self.gate = np.concatenate([self.gate, np.zeros_like(self.gate)])
        for i in range(0, len(new), 8192):
            ids, tri, head = features(new[i : i + 8192], self.model.known, self.s)
            vec = self.model.inputs(ids, tri, self.model.told(head))
            p, at = self.model.p, slice(first + i, first + i + len(vec))
            self.gate[at] = np.concatenate([vec @ p["Wf"] + p["cf"], vec @ p["Wb"] + p["cb"]], axis=1)

    def _rows(self, batch: list[bytes]) -> list[np.ndarray]:
        """The gate rows of each text's words."""
        split = [words_of(t) for t in batch]
        for w in self.passing:
            del self.row[w]
        new = list({w for ws in split for w in ws}.difference(self.row))
        self.passing = new if len(self.row) + len(new) > self.most else []
        self._add(new)
        get = self.row.__getitem__
        return [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in split]

    def logits(self, batch: list[bytes]) -> np.ndarray:
        """The highest window logit of each text."""
        docs, k, width = self._rows(batch), 3 * self.s.hidden, self.s.window
        top = np.full(len(docs), -np.inf)
        short = [i for i, rows in enumerate(docs) if len(rows) < width]
        for i in range(0, len(short), 512):
            part = short[i : i + 512]
            at, mask = laid_out([(docs[j], np.zeros(1, np.int64)) for j in part], self.s)
            gates = self.gate[at]
            top[part] = self.model.logits({"f": gates[..., :k], "b": gates[..., k:]}, mask)
        long = [i for i, rows in enumerate(docs) if len(rows) >= width]
        if long:
            begin = np.cumsum([0] + [len(docs[i]) for i in long])
            words = np.concatenate([docs[i] for i in long])
            starts = [window_starts(len(docs[i]), self.s) for i in long]
            owner = np.repeat(long, [len(x) for x in starts])
            first = np.concatenate([x + b for x, b in zip(starts, begin[:-1].tolist(), strict=True)])
            for i in range(0, len(first), 512):
                at = first[i : i + 512] + np.arange(width)[:, None]
                np.maximum.at(top, owner[i : i + 512], self._whole(words[at]))
        return top

    def _whole(self, at: np.ndarray) -> np.ndarray:
        """Logits of full windows: Model.logits without masks, one row for each feature."""
        p, k = self.model.p, self.s.hidden
        T, n = at.shape
        x = np.ascontiguousarray(self.gate[at].transpose(0, 2, 1))
        half = np.repeat(np.float32([0.5, 1.0]), [2 * k, k])[:, None]
        out = np.empty((T, 2 * k, n), np.float32)
        u, zr, c, h2 = (np.empty((m * k, n), np.float32) for m in (3, 2, 1, 1))
        for d, order, lo in (("f", range(T), 0), ("b", range(T - 1, -1, -1), 1)):
            U = np.ascontiguousarray(p[f"U{d}"].T * half)
            x[:, 3 * k * lo : 3 * k * lo + 2 * k] *= 0.5
            h = np.zeros((k, n), np.float32)
            for t in order:
                g = x[t, 3 * k * lo : 3 * k * (lo + 1)]
                np.matmul(U, h, out=u)
                np.add(g[: 2 * k], u[: 2 * k], out=zr)
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                np.multiply(zr[k:], u[2 * k :], out=c)
                c += g[2 * k :]
                np.tanh(c, out=c)
                np.subtract(h, c, out=h2)
                h2 *= zr[:k]
                h = np.add(c, h2, out=out[t, k * lo : k * (lo + 1)])
        e = np.tensordot(p["v"], np.tanh(np.matmul(p["A"].T, out)), (0, 1))
        value = np.matmul(p["o"], out)
        w = np.exp(e - e.max(axis=0))
        return (w * value).sum(axis=0) / w.sum(axis=0) + p["o0"][0]

    def __call__(self, batch: list[bytes]) -> np.ndarray:
        return sigmoid(self.logits(batch).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, s: Settings, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on at most ``s.sample_docs`` documents of each class, the ones of smallest id hash.

    Held-out documents, rows with a null label, labels without a document and texts of
    over ``s.sample_doc_bytes`` teach nothing; a null text counts as empty; of several
    rows with one id the one of least text hash is learnt from, so that twice
    ``s.sample_docs`` rows come to the driver at most.  The sample is chosen by ids alone
    and only its texts are read.
    """
    marked = labels.where(F.col(label_col).isin(0, 1)).where(~is_held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    there = marked.join(docs.select(F.col(id_col).alias("id")).distinct(), "id").distinct().withColumn("h", F.xxhash64("id"))
    chosen = [r for y in (0, 1) for r in there.where(F.col("y") == y).orderBy("h", "id").limit(s.sample_docs).collect()]
    if not chosen:
        return train([], s)
    sample = docs.sparkSession.createDataFrame([(r["id"], r["y"], r["h"]) for r in chosen], there.schema)
    short = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.coalesce(F.octet_length("t"), F.lit(0)) <= s.sample_doc_bytes)
    found = short.join(F.broadcast(sample), "id")  # bounded by sample_docs and sample_doc_bytes
    one = found.groupBy("id", "y", "h").agg(F.min(F.struct(F.xxhash64("t").alias("k"), "t"))["t"].alias("t"))  # combined before the shuffle
    rows = sorted(one.collect(), key=lambda r: (r["h"], r["id"], r["t"] or ""))
    return train([((r["t"] or "").encode(), r["y"]) for r in rows], s)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col`` (double, 0 to 1) over the whole text.

    Every row is scored by its own text alone, whatever ids repeat or are null; a null
    text counts as empty, equal texts have equal scores, and a column named as
    ``out_col`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by Settings

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in steps(parts, text_col, 1 << 20):
            values = pa.array(scorer(texts(part, text_col)), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, out_col])

    plain = docs.drop(out_col)
    return plain.mapInArrow(run, plus(plain, f"`{out_col}` double"))


def is_held_out(col: str):
    """Whether a row is in the fifth that nothing is learnt from (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
