"""Quality rules: boosted trees over document statistics, with fixed base rules.

Statistics are exact and taken over whole texts.  The trees are trained on a bounded sample of labelled
documents (``max_train`` of each class); their scores must not rise with repetition, duplicate lines or
symbol density (monotonic constraints).

Defined cases: a null text has no words; a text without words fails the base rules; repeated rows
give repeated results; no labels (or one class only) leave the base rules alone; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting
from .common import column, labelled_sample, utf8

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
FEATURES = (
    "log_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "digit_rate",
    "upper_rate", "ascii_rate", "punct_rate", "words_per_line", "longest_word", "top_word_rate", "short_rate", "top_pair_rate",
)
#: A document must not look better for being more repetitive or fuller of symbols.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "top_word_rate": -1, "top_pair_rate": -1}


def base_counts(text: bytes) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words."""
    words = text.split()  # bytes split at exactly \x20 and \x09-\x0D
    n = len(words)
    blanks = len(text) - len(text.translate(None, BLANKS))
    chars = len(text.decode("utf-8", "replace")) - blanks
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    repeat = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            first: dict[tuple, int] = {}
            hit = np.zeros(n + 1, dtype=np.int64)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    hit[[i, j]] += 1
                    hit[[i + 5, j + 5]] -= 1
            repeat = int(np.count_nonzero(np.cumsum(hit[:n])))
    return n, chars, symbols, dup, repeat, words


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    n, chars, symbols, dup, repeat, words = base_counts(text)
    base = [n, chars, symbols, dup, repeat]
    if not n:
        return base, [0.0] * len(FEATURES)
    lines = text.count(b"\n") + 1
    size = len(text)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs: dict[tuple, int] = {}
    for p in zip(words, words[1:], strict=False):
        pairs[p] = pairs.get(p, 0) + 1
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    punct = int(hist[33:48].sum() + hist[58:65].sum())
    return base, [
        float(np.log1p(n)), chars / n, symbols / size, dup / lines, repeat / n, len(counts) / n, float(hist[48:58].sum()) / size,
        float(hist[65:91].sum()) / size, float(hist[:128].sum()) / size, punct / size, n / lines, float(max(map(len, words))),
        max(counts.values()) / n, sum(v for w, v in counts.items() if len(w) < 3) / n, max(pairs.values(), default=0) / n,
    ]


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = 4000, trees: int = 60, depth: int = 4) -> boosting.Forest:
    """Trees from at most ``max_train`` labelled documents of each class, over their whole texts."""

    def features(batches):
        for batch in batches:
            rows = [statistics(t)[1] for t in utf8(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "y").cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    # Small on the driver: 2 * max_train rows of len(FEATURES) numbers.
    got = labelled_sample(docs, labels, "quality", max_train).mapInArrow(features, "y int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    order = np.lexsort([*x.T, got["y"].to_numpy()])
    return boosting.fit(x[order], got["y"].to_numpy()[order], monotone=[MONOTONE.get(f, 0) for f in FEATURES], trees=trees, depth=depth)


def judge(docs: DataFrame, model: boosting.Forest, *, cut: float = 0.5) -> DataFrame:
    """Per document: base counts, base_failed, the trees' score (1: good) and kept."""
    flat = boosting.Forest(model.feature, model.threshold, model.leaf, model.bias, model.depth)
    learned = len(model.feature) > 0

    def run(batches):
        for batch in batches:
            base, x = [], []
            for t in utf8(column(batch, "text")):
                b, f = statistics(t)
                base.append(b)
                x.append(f)
            b = np.array(base, dtype=np.int64).reshape(-1, 5)
            failed = (b[:, 0] < 10) | (100 * b[:, 4] > 20 * b[:, 0])
            score = flat.score(np.array(x, dtype=float).reshape(-1, len(FEATURES)))
            kept = ~failed & ((score >= cut) | (not learned))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(b[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(score)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double",
    )


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return judge(docs, fit(docs, labels, **options))
