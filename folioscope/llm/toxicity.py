"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 6 bytes, with word marks), hashed into 2^BITS
embeddings, so unseen misspellings and inflections share vectors with known words.  A passage of WIDTH
words is the mean of its n-gram embeddings, put into a linear softmax.  A document's score is that of its worst
passage (overlapping), so a few toxic words in a long text count as much as in a short one.

Training is on a bounded sample (``max_train`` labelled documents of each class outside the held-out
fold) of whole texts: first on whole documents, then on the worst passages under the model so far.  Embeddings and
softmax are learned together by minibatch AdaGrad; n-grams of few documents have none.  A few models from different starts are
averaged, and the decision point is set on a part of the sample that none of them has seen.

A trained model is linear in n-grams, so scoring needs one number for each bucket: a passage's log-odds is
the mean of its n-grams' numbers plus a bias.

Defined cases: null and wordless texts get the model's score of no evidence, below 0.5; no labels (or one
class) give all documents a low constant score; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored, and passed on by ``drop_toxic``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, column, fold, labelled_sample, utf8
from .wordops import _GRAM, Words, byte_class, mix, tokenize

FOLDS = 5
BITS = 18
WIDTH, STEP = 2, 1
#: A passage's mean is over this many n-grams at least, so one odd word alone is little evidence.
LEAST = 40
#: An n-gram has an embedding if this share of the sample's documents have it; others are evidence of nothing.
FEWEST = 0.01
#: Letters, digits, all that is not ASCII, and signs that stand for letters in misspellings.
CHARS = byte_class([b for b in range(256) if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128] + [ord(c) for c in "@$*"])
SIZES = (3, 4, 5, 6)


@dataclass
class Model:
    value: np.ndarray  # of each bucket
    bias: float
    empty: float  # log-odds without evidence


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): n-gram buckets of the given words, word after word; first has one more entry at the end."""
    n = ends - starts
    size = n + 2
    at = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    word = np.repeat(np.arange(len(n)), size)
    inside = np.arange(at[-1]) - at[word]
    text = np.where(inside == 0, 60, 62).astype(np.uint64)
    letter = (inside > 0) & (inside <= n[word])
    text[letter] = data[(starts[word] + inside - 1)[letter]]
    left = size[word] - inside  # characters from here to the word's end
    found, owner = [], []
    g = mix(text + np.uint64(1))
    have = np.zeros(len(text), dtype=np.uint64)
    for j in range(max(SIZES)):
        m = len(text) - j
        if m <= 0:
            break
        have = have[:m] * _GRAM + g[j:]
        if j + 1 in SIZES:
            ok = np.flatnonzero(left[:m] >= j + 1)
            found.append((mix(have[ok] + np.uint64(j)) & np.uint64((1 << BITS) - 1)).astype(np.int64))
            owner.append(word[ok])
    buckets, owners = np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(owners, kind="stable")
    first = np.searchsorted(owners[order], np.arange(len(n) + 1))
    return buckets[order], first


def collapsed(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Words and their hashes; a word that repeats its predecessor is left out."""
    words = tokenize(texts, CHARS)
    h = words.hashes()
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    keep = np.flatnonzero(~same)
    first = np.searchsorted(keep, words.first)
    return Words(words.data, words.starts[keep], words.ends[keep], words.doc[keep], first, words.offsets), h[keep]


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, stop) of overlapping passages of WIDTH words."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - WIDTH) // STEP) + 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = first[doc] + at * STEP
    return doc, start, np.minimum(start + WIDTH, first[doc + 1])


def log_odds(texts: list[bytes], model: Model) -> np.ndarray:
    words, h = collapsed(texts)
    out = np.full(len(texts), model.empty)
    if not len(words):
        return out
    _, some, back = np.unique(h, return_index=True, return_inverse=True)
    buckets, first = subwords(words.data, words.starts[some], words.ends[some])
    total = np.zeros(len(buckets) + 1)
    np.cumsum(model.value[buckets], out=total[1:])
    v, n = (total[first[1:]] - total[first[:-1]])[back], np.diff(first)[back]
    cv, cn = np.zeros(len(v) + 1), np.zeros(len(v) + 1)
    np.cumsum(v, out=cv[1:])
    np.cumsum(n, out=cn[1:])
    doc, start, stop = passages(words.first)
    score = model.bias + (cv[stop] - cv[start]) / np.maximum(cn[stop] - cn[start], LEAST)
    at = np.flatnonzero(np.diff(doc, prepend=-1))
    out[doc[at]] = np.maximum.reduceat(score, at)
    return out


class _Trainer:
    """Sums of n-gram embeddings, gradient steps and worst passages over the sample's distinct words."""

    def __init__(self, texts: list[bytes]):
        parts, sizes, ids, seen = [], [], [], []
        self.first = [0]
        known, place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)  # sorted hashes of distinct words, their numbers
        for _, some in chunks(texts):
            words, h = collapsed(some)
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            spot = np.searchsorted(known, u)
            new = np.ones(len(u), dtype=bool)
            inside = spot < len(known)
            new[inside] = known[spot[inside]] != u[inside]
            number = np.zeros(len(u), dtype=np.int32)
            number[~new] = place[spot[~new]]
            number[new] = len(known) + np.arange(new.sum())
            if new.any():
                b, f = subwords(words.data, words.starts[at[new]], words.ends[at[new]])
                parts.append(b.astype(np.int32))
                sizes.append(np.diff(f).astype(np.int32))
                known, place = np.concatenate([known, u[new]]), np.concatenate([place, number[new]])
                order = np.argsort(known)
                known, place = known[order], place[order]
            ids.append(number[back])
            seen.append((np.unique(words.doc.astype(np.int64) << 32 | number[back]) & 0xFFFFFFFF).astype(np.int32))  # once for each document
            self.first += (words.first[1:] + self.first[-1]).tolist()
        self.first = np.array(self.first)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.buckets = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int32)
        self.at = np.zeros(len(self.sizes) + 1, dtype=np.int64)
        np.cumsum(self.sizes, out=self.at[1:])
        spread = np.zeros(len(self.sizes), dtype=np.int64)  # documents of each word
        for some in seen:
            spread += np.bincount(some, minlength=len(spread))
        self.common = np.bincount(self.buckets, np.repeat(spread, self.sizes), 1 << BITS) >= FEWEST * len(texts)

    def start(self, dim: int, seed: int) -> None:
        rng = self.rng = np.random.default_rng(seed)
        self.e = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32) * self.common[:, None]
        self.w = np.zeros((2, dim))
        self.w[1] = rng.uniform(-1, 1, dim)
        self.b = np.zeros(2)
        self.ge, self.gw, self.gb = np.full_like(self.e, 1e-6), np.full_like(self.w, 1e-6), np.full_like(self.b, 1e-6)

    def epoch(self, start: np.ndarray, stop: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, batch: int = 256) -> None:
        order = self.rng.permutation(len(y))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            rows, word = _ranges(start[some], stop[some])
            ids = self.ids[word]
            inner, grams = _ranges(self.at[ids], self.at[ids + 1])
            owner, bucket = rows[inner], self.buckets[grams]
            n = np.maximum(np.bincount(owner, minlength=len(some)), LEAST)
            dim = self.e.shape[1]
            x = np.stack([np.bincount(owner, self.e[bucket, d], len(some)) for d in range(dim)], axis=1) / n[:, None]
            z = x @ self.w.T + self.b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p *= weight[some][:, None] / len(some)
            gw, gb, gx = p.T @ x, p.sum(0), (p @ self.w) / n[:, None]
            touched, back = np.unique(bucket, return_inverse=True)
            ge = np.stack([np.bincount(back, gx[owner, d], len(touched)) for d in range(dim)], axis=1)
            ge *= self.common[touched][:, None]
            self.ge[touched] += ge * ge
            self.gw += gw * gw
            self.gb += gb * gb
            self.e[touched] -= rate * ge / np.sqrt(self.ge[touched])
            self.w -= rate * gw / np.sqrt(self.gw)
            self.b -= rate * gb / np.sqrt(self.gb)

    def picked(self, m: Model, used: np.ndarray, y: np.ndarray, docs: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, doc) of the worst passage of each used document, and twice as many random ones of clean documents.

        A few documents are scored at a time, so memory does not grow with their lengths.
        """
        value = np.add.reduceat(m.value[self.buckets].astype(np.float32), self.at[:-1]) if len(self.buckets) else np.zeros(0)
        clean = int(np.diff(self.first)[used & (y == 0)].sum())
        rate = min(1.0, 2 * int(used.sum()) / max(clean, 1))
        out = []
        for i in range(0, len(used), docs):
            own = np.arange(i, min(i + docs, len(used)))
            base = self.first[own[0]]
            ids = self.ids[base : self.first[own[-1] + 1]]
            doc, start, stop = passages(self.first[own[0] : own[-1] + 2] - base)
            if not len(doc):
                continue
            cum, num = np.append(0, np.cumsum(value[ids], dtype=np.float64)), np.append(0, np.cumsum(self.sizes[ids], dtype=np.int64))
            score = m.bias + (cum[stop] - cum[start]) / np.maximum(num[stop] - num[start], LEAST)
            heads = np.flatnonzero(np.diff(doc, prepend=-1))
            best = np.repeat(np.maximum.reduceat(score, heads), np.diff(np.append(heads, len(doc))))
            keep = ((score >= best) | ((y[own[doc]] == 0) & (self.rng.random(len(doc)) < rate))) & used[own[doc]]
            out.append((start[keep] + base, stop[keep] + base, own[doc[keep]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def model(self) -> Model:
        w = self.w[1] - self.w[0]
        return Model(self.e @ w, float(self.b[1] - self.b[0]), 0.0)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, value) of all values of all ranges."""
    n = stop - start
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def train(texts: list[bytes], y: np.ndarray, *, dim: int = 8, rounds: int = 6, epochs: int = 3, rate: float = 0.3, members: int = 4, seed: int = 8) -> Model:
    """The mean of ``members`` models that start from different embeddings: each is linear in n-grams, so their mean is one too.

    The decision point is set on a fifth of the sample that none of them has seen.
    """
    y = np.asarray(y, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), -3.0, -3.0)
    calm = np.random.default_rng(seed).random(len(y)) < 0.2
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    t = _Trainer(texts)
    some = np.diff(t.first) > 0
    used = ~calm & some
    whole = np.flatnonzero(used & (np.diff(t.first) <= 4 * WIDTH))
    if len(np.unique(y[whole])) < 2:
        whole = np.flatnonzero(used)
    value, bias = np.zeros(1 << BITS), 0.0
    for member in range(members):
        t.start(dim, seed + member)
        for _ in range(epochs):
            t.epoch(t.first[whole], t.first[whole + 1], y[whole], share[whole], rate)
        for _ in range(rounds):
            start, stop, doc = t.picked(t.model(), used, y)
            for _ in range(epochs):
                t.epoch(start, stop, y[doc], share[doc], rate)
        m = t.model()
        value += m.value / members
        bias += m.bias / members
    m = Model(value, bias, 0.0)
    at = np.flatnonzero(calm & some) if len(np.unique(y[calm & some])) == 2 else np.flatnonzero(some)
    if len(at):
        m.bias -= _cut(np.concatenate([log_odds(x, m) for _, x in chunks([texts[i] for i in at])]), y[at])
    m.empty = min(-1.0, float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))) - 2.0)
    return m


def _cut(score: np.ndarray, y: np.ndarray, recall_weight: float = 1.25) -> float:
    """The middle of the gap at which most of F-beta is reached (beta: ``recall_weight``)."""
    order = np.argsort(-score, kind="stable")
    s, t = score[order], y[order]
    hit, beta = np.cumsum(t), recall_weight**2
    f = (1 + beta) * hit / (np.arange(1, len(t) + 1) + beta * t.sum())
    i = int(np.argmax(f))
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = 2000, **options) -> Model:
    """A model from at most ``max_train`` labelled documents of each class, none of the held-out fold."""
    rows = labelled_sample(docs, labels, "toxic", max_train, FOLDS).select("y", "text").toPandas()  # bounded by max_train
    rows = rows.assign(text=rows["text"].fillna("")).sort_values(["text", "y"], kind="stable")
    return train([t.encode() for t in rows["text"]], rows["y"].to_numpy(), **options)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            s = [log_odds(texts, m) for _, texts in chunks(utf8(column(batch, "text")))]
            p = sigmoid(np.concatenate(s)) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select("doc_id", "text", (fold("doc_id", FOLDS) == 0).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not reject, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            s = [log_odds(texts, m) for _, texts in chunks(utf8(column(batch, "text")))]
            keep = sigmoid(np.concatenate(s)) < 0.5 if s else np.ones(0, dtype=bool)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
