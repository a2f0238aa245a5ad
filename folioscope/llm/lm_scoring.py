"""Brown class-based n-gram scoring: exchange clustering of words, class transitions, word emissions.

Tokens are the words of a text and one end mark.  All counts are over all training documents.

Classes, for every word of the training documents, by exchange in two steps:

1. The ``heads`` most frequent words, the end mark and ``groups`` spelling groups (a word's last three bytes, hashed) that stand for
   all other words are units.  Exchange moves one unit at a time to the class that raises the class-bigram
   likelihood most, until no unit moves (``sweeps`` passes at most), on the unit-bigram table of the whole corpus.
2. Each other word is then exchanged on its own: its neighbours' classes, summed over the whole corpus, go against the
   class-bigram counts, and it takes the class of the largest likelihood.  These words are as many as the corpus has; their
   context counts and classes are distributed tables, never collected.

Only a word that no training document has keeps the class of its spelling group.

Model.  log10 p(text) = sum of log10 p(class | previous class) + log10 p(word | class), with transitions counted anew under the
final classes of all words.  Transitions are smoothed with the class's own frequency (Dirichlet, weight ``prior``); an
emission is (count + 1) / (class count + class vocabulary + 1), which leaves the rest for unseen words.

Distribution: words are 64-bit hashes.  The counts and classes of the ``hot`` most frequent words are a table of fixed size that
every task holds; all other words meet the class table by a join of (word, document, places) rows, and go back to their
document, which then has the classes of all its words as one byte each.  A word so frequent that it would make a
hot key is in the fixed table.  No vocabulary is collected or broadcast.

Defined cases: a null text is empty: its only token is the end mark; without training documents all words are
unknown; a null doc_id is in no fold and trains; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, column, fold, utf8, written
from .wordops import SPACED, Words, mix, tokenize

FOLDS, HELD = 7, 2
HEADS, GROUPS, HOT = 1024, 1024, 1 << 18
CLASSES, SWEEPS, PRIOR = 64, 30, 20.0  # at most 256 classes
#: Context counts that a task sums up before it gives them out.
WINDOW = 800_000
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end mark


def spelling(words: Words, at: np.ndarray, groups: int) -> np.ndarray:
    """The spelling group of the words at ``at``: their last three bytes."""
    end, size = words.ends[at], (words.ends - words.starts)[at]
    code = np.zeros(len(at), dtype=np.uint64)
    for j in range(1, 4):
        some = size >= j
        code[some] = code[some] * np.uint64(257) + words.data[end[some] - j].astype(np.uint64) + np.uint64(1)
    return (mix(code) % np.uint64(groups)).astype(np.int64)


def units(words: Words, h: np.ndarray, heads: np.ndarray, groups: int) -> np.ndarray:
    """The unit of each word."""
    _, at, back = np.unique(h, return_index=True, return_inverse=True)
    unit = len(heads) + spelling(words, at, groups)
    if len(heads):
        order = np.argsort(heads)
        spot = np.minimum(np.searchsorted(heads[order], h[at]), len(heads) - 1)
        known = heads[order][spot] == h[at]
        unit[known] = order[spot[known]]
    return unit[back]


def _counted(docs: DataFrame) -> DataFrame:
    """(h, c): counts of words over the given documents, pre-aggregated by task."""

    def run(batches):
        keys, counts, held = [], [], 0

        def merged():
            u, back = np.unique(np.concatenate(keys), return_inverse=True)
            return u, np.bincount(back, np.concatenate(counts), len(u)).astype(np.int64)

        def out(u, c):
            for i in range(0, len(u), 100_000):
                j = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(u[j].view(np.int64)), pa.array(c[j])], ["h", "c"])

        for batch in batches:
            for _, texts in chunks(utf8(column(batch, "text")), 1 << 21):
                u, c = np.unique(tokenize(texts, SPACED).hashes(), return_counts=True)
                keys += [u, np.array([END])]
                counts += [c, np.array([len(texts)])]
                held += len(u)
                if held > 1_500_000:  # bounded memory: what is merged goes out when it stays large
                    u, c = merged()
                    keys, counts, held = [u], [c], len(u)
                    if held > 750_000:
                        yield from out(u, c)
                        keys, counts, held = [], [], 0
        if keys:
            yield from out(*merged())

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _bigrams(docs: DataFrame, heads: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit-bigram counts [previous, next] over the given documents."""
    size = len(heads) + groups + 1

    def run(batches):
        table, codes, held = np.zeros(size * size, dtype=np.int64), [], 0
        for batch in batches:
            for _, texts in chunks(utf8(column(batch, "text"))):
                words = tokenize(texts, SPACED)
                unit = units(words, words.hashes(), heads, groups)
                # The end mark stands between texts: it starts and ends each of them.
                line = np.insert(unit, words.first[1:], size - 1)
                before = np.concatenate([[size - 1], line[:-1]])
                codes.append(before * size + line)
                held += len(line)
                if held > 1_000_000:
                    table += np.bincount(np.concatenate(codes), minlength=size * size)
                    codes, held = [], 0
        if codes:
            table += np.bincount(np.concatenate(codes), minlength=size * size)
        at = np.flatnonzero(table)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(table[at[i : i + 100_000]])], ["code", "c"])

    rows = docs.select("text").mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))
    table = np.zeros(size * size, dtype=np.int64)
    got = rows.toArrow()  # at most size * size rows: fixed by the parameters
    table[got["code"].to_numpy()] = got["c"].to_numpy()
    return table.reshape(size, size)


def exchange(n: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit, by the exchange algorithm on unit-bigram counts; the end mark (last) keeps a class of its own."""
    size = len(n)
    n = n.astype(float)
    total = n.sum(1) + n.sum(0)
    order = np.argsort(-total[:-1], kind="stable")
    free = classes - 1
    cls = np.zeros(size, dtype=np.int64)
    cls[order] = np.arange(size - 1) % free
    cls[-1] = free

    def f(x):
        return x * np.log(np.maximum(x, 1e-300))

    onehot = np.zeros((size, classes))
    onehot[np.arange(size), cls] = 1
    right, left = n @ onehot, n.T @ onehot  # of a unit, by the neighbour's class
    m = onehot.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not total[u]:
                continue
            a, r, lf, own = cls[u], right[u].copy(), left[u].copy(), n[u, u]
            # Take the unit out of its class; its bigram with itself is then added apart.
            r[a] -= own
            lf[a] -= own
            m[a] -= right[u]
            m[:, a] -= left[u]
            m[a, a] += own
            row, col = m.sum(1), m.sum(0)
            new_row, new_col = m + r[None, :], m + lf[:, None]
            gain = (f(new_row) - f(m)).sum(1) + (f(new_col) - f(m)).sum(0)
            diag = m.diagonal()
            gain += f(diag + r + lf + own) - f(diag + r) - f(diag + lf) + f(diag)
            full_row, full_col = row + lf, col + r  # with what goes to and comes from the unit, wherever it is
            gain -= f(full_row + r.sum() + own) - f(full_row) + f(full_col + lf.sum() + own) - f(full_col)
            gain[free] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            cls[u] = b
            m[b] += r
            m[:, b] += lf
            m[b, b] += own
            if b != a:
                moved += 1
                right[:, a] -= n[:, u]
                right[:, b] += n[:, u]
                left[:, a] -= n[u]
                left[:, b] += n[u]
        if not moved:
            break
    return cls


@dataclass
class Vocabulary:
    heads: np.ndarray
    groups: int
    cls: np.ndarray  # of units
    hot: np.ndarray  # sorted hashes
    hot_count: np.ndarray
    hot_cls: np.ndarray
    sizes: np.ndarray  # tokens and words of each class
    words: np.ndarray
    tokens: int
    vocabulary: int
    ends: int  # count of the end mark

    def local(self, words: Words, u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, class) of distinct hashes: count -1 and the class of the spelling group where the fixed table has none."""
        c, k = np.full(len(u), -1, dtype=np.int64), self.cls[len(self.heads) + spelling(words, at, self.groups)]
        if len(self.hot):
            spot = np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)
            known = self.hot[spot] == u
            c[known], k[known] = self.hot_count[spot[known]], self.hot_cls[spot[known]]
        return c, k


@dataclass
class Model:
    vocabulary: Vocabulary
    step: np.ndarray  # log10 p(next class | previous class)
    below: np.ndarray  # log10 of the emission's denominator, by class


def _contexts(docs: DataFrame, heads: np.ndarray, groups: int, cls: np.ndarray, classes: int) -> DataFrame:
    """(h, codes, counts): of words that are no heads, the classes of their next words (from 0) and previous words (from ``classes``)."""

    def run(batches):
        hs, codes, held = [], [], 0

        def out():
            u, back = np.unique(np.concatenate(hs), return_inverse=True)
            key, n = np.unique(back * (2 * classes) + np.concatenate(codes), return_counts=True)
            word, code = key // (2 * classes), (key % (2 * classes)).astype(np.uint8)
            first = np.searchsorted(word, np.arange(len(u) + 1))
            n = n.astype("<u4")
            for i in range(0, len(u), 20_000):
                some = range(i, min(i + 20_000, len(u)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(u[i : i + 20_000].view(np.int64)), pa.array([code[first[j] : first[j + 1]].tobytes() for j in some], pa.binary()),
                        pa.array([n[first[j] : first[j + 1]].tobytes() for j in some], pa.binary()),
                    ],
                    ["h", "codes", "counts"],
                )

        for batch in batches:
            for _, texts in chunks(utf8(column(batch, "text"))):
                words = tokenize(texts, SPACED)
                h = words.hashes()
                unit = units(words, h, heads, groups)
                line = np.insert(cls[unit], words.first[1:], cls[-1])
                place = np.arange(len(h)) + words.doc  # of each word in line: an end mark stands after each text before
                before = np.concatenate([[cls[-1]], line[:-1]])
                rest = unit >= len(heads)
                hs += [h[rest], h[rest]]
                codes += [line[place[rest] + 1], classes + before[place[rest]]]
                held += 2 * int(rest.sum())
                if held > WINDOW:
                    yield from out()
                    hs, codes, held = [], [], 0
        if held:
            yield from out()

    return docs.select("text").mapInArrow(run, "h long, codes binary, counts binary")


def _assigned(contexts: DataFrame, m: np.ndarray) -> DataFrame:
    """(h, c, cls): count and class of each word by its summed contexts, against class-bigram counts ``m``."""
    classes = len(m)
    soft = m + 0.5
    weight = np.concatenate([np.log(soft.T / soft.sum(1)), np.log(soft / soft.sum(0))])  # [context, own class]

    def run(batches):
        rest = None

        def out(h, codes, counts, size):
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            word = np.repeat(np.cumsum(np.append(True, h[1:] != h[:-1])) - 1, size)
            total = np.bincount(word * (2 * classes) + codes, counts, len(first) * 2 * classes).reshape(len(first), 2 * classes)
            best = np.argmax((total @ weight)[:, :-1], axis=1)  # the last class is the end mark's
            return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(total[:, :classes].sum(1).astype(np.int64)), pa.array(best.astype(np.int32))], ["h", "c", "cls"])

        for batch in batches:
            h = column(batch, "h").to_numpy()
            binary = column(batch, "codes").to_pylist()
            size = np.array([len(x) for x in binary], dtype=np.int64)
            codes, counts = np.frombuffer(b"".join(binary), dtype=np.uint8).astype(np.int64), np.frombuffer(b"".join(column(batch, "counts").to_pylist()), dtype="<u4")
            if rest is not None:
                h, codes, counts, size = (np.concatenate(x) for x in zip(rest, (h, codes, counts, size), strict=True))
            if not len(h):
                continue
            last = int(np.searchsorted(h, h[-1]))
            cut = int(size[:last].sum())
            if last:
                yield out(h[:last], codes[:cut], counts[:cut], size[:last])
            rest = (h[last:], codes[cut:], counts[cut:], size[last:])
        if rest is not None:
            yield out(*rest)

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, c long, cls int")


def _most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """At most ``most`` of the most frequent words, in order: those above a count that a histogram gives, so nothing is sorted in one task."""
    level = F.floor(F.log2("c") * 64)
    room, least = most, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # a few thousand rows at most
        room -= r.n
        if room < 0:
            break
        least = r.level
    some = counts.where(level >= least) if least is not None else counts.limit(0)
    return some.toArrow().sort_by([("c", "descending"), ("h", "ascending")])


def learn(docs: DataFrame, *, heads: int = HEADS, groups: int = GROUPS, hot: int = HOT, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[Vocabulary, DataFrame]:
    """What every task holds, and the table (h, c, cls) of all words, from all rows of ``docs``."""
    counts = written(_counted(docs))
    head = _most_frequent(counts, heads + 1)["h"].to_numpy().view(np.uint64)
    head = head[head != END][:heads].copy()
    n = _bigrams(docs, head, groups)
    cls = exchange(n, classes, sweeps)
    onehot = np.zeros((len(cls), classes))
    onehot[np.arange(len(cls)), cls] = 1
    rest = _assigned(_contexts(docs, head, groups, cls, classes), onehot.T @ n @ onehot)
    spark = docs.sparkSession
    fixed = np.append(head, END).view(np.int64).tolist(), [*cls[: len(head)].tolist(), classes - 1]
    kept = counts.join(F.broadcast(spark.createDataFrame(list(zip(*fixed, strict=True)), "h long, cls int")), "h").select("h", "c", "cls")  # heads + 1 rows
    table = written(rest.unionAll(kept))
    sizes, words = np.zeros(classes), np.zeros(classes)
    for r in table.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # a row for each class
        sizes[r.cls], words[r.cls] = r.c, r.v
    top = _most_frequent(table, hot).sort_by("h")
    h = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    end = table.where(F.col("h") == int(END.view(np.int64))).first()
    return Vocabulary(head, groups, cls, h[order].copy(), top["c"].to_numpy()[order].copy(), top["cls"].to_numpy()[order].copy(), sizes, words, int(sizes.sum()), int(words.sum()), end.c if end else 0), table


def classed(docs: DataFrame, known: Vocabulary, table: DataFrame, held=None) -> DataFrame:
    """(doc_id, held_out, n, classes, n_known, plus): the classes of a text's tokens as bytes, its known tokens, the sum of log10(count + 1).

    Rows of one doc_id and text are one row; ``n`` is their number.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(known)  # its arrays have the sizes of the parameters
    held = F.lit(False) if held is None else held

    def run(batches):
        m = shared.value
        for batch in batches:
            ids, rids, flags = column(batch, "doc_id"), column(batch, "rid").to_numpy(), column(batch, "held_out")
            _, fresh = np.unique(rids, return_index=True)  # repeated rows send their rare words once
            for start, texts in chunks(utf8(column(batch, "text"))):
                words = tokenize(texts, SPACED)
                n, doc = len(texts), words.doc
                u, at, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
                c, k = m.local(words, u, at)
                line = np.insert(k[back], words.first[1:], m.cls[-1]).astype(np.uint8)
                ends = words.first[1:] + np.arange(1, n + 1)
                known = np.bincount(doc, (c > 0)[back], n).astype(np.int64) + (m.ends > 0)
                plus = np.bincount(doc, np.log10(np.maximum(c, 0) + 1.0)[back], n) + np.log10(m.ends + 1.0)
                rare = np.flatnonzero((c < 0)[back] & np.isin(start + doc, fresh))
                order = rare[np.lexsort([back[rare], doc[rare]])]
                d, w = doc[order], back[order]
                new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (w[1:] != w[:-1]))) if len(order) else order
                place = (order - words.first[d]).astype("<u4")
                stop = np.append(new[1:], len(order)) if len(order) else new
                rows = len(new)
                mine = pa.array(np.concatenate([np.arange(start, start + n), start + d[new]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rids).take(mine), ids.take(mine), flags.take(mine),
                        pa.array([line[s:e].tobytes() for s, e in zip([0, *ends[:-1]], ends, strict=True)] + [None] * rows, pa.binary()),
                        pa.concat_arrays([pa.array(known), pa.nulls(rows, pa.int64())]), pa.concat_arrays([pa.array(plus), pa.nulls(rows, pa.float64())]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(u[w[new]].view(np.int64))]),
                        pa.array([None] * n + [place[s:e].tobytes() for s, e in zip(new, stop, strict=True)], pa.binary()),
                    ],
                    ["rid", "doc_id", "held_out", "classes", "n_known", "plus", "h", "at"],
                )

    def fill(batches):
        """The classes of rare words put in their places."""
        for batch in batches:
            base = column(batch, "classes").to_pylist()
            size = np.array([len(x) for x in base], dtype=np.int64)
            line = np.frombuffer(b"".join(base), dtype=np.uint8).copy()
            first = np.cumsum(size) - size
            rare = column(batch, "rare")
            some = rare.flatten()
            owner = np.repeat(np.arange(len(base)), np.array([len(x) if x is not None else 0 for x in rare], dtype=np.int64)) if len(some) else np.zeros(0, np.int64)
            at = some.field("at").to_pylist()
            length = np.array([len(x) // 4 for x in at], dtype=np.int64)
            c = some.field("c").to_numpy(zero_copy_only=False)
            line[np.repeat(first[owner], length) + np.frombuffer(b"".join(at), dtype="<u4")] = np.repeat(some.field("cls").to_numpy(zero_copy_only=False), length)
            known = column(batch, "n_known").to_numpy() + np.bincount(owner, length, len(base)).astype(np.int64)
            plus = column(batch, "plus").to_numpy() + np.bincount(owner, length * np.log10(c + 1.0), len(base))
            whole = line.tobytes()
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), column(batch, "n"), pa.array([whole[a : a + s] for a, s in zip(first.tolist(), size.tolist(), strict=True)], pa.binary()), pa.array(known), pa.array(plus)],
                ["doc_id", "held_out", "n", "classes", "n_known", "plus"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("rid"), held.alias("held_out")).mapInArrow(
        run, f"rid long, doc_id {kind}, held_out boolean, classes binary, n_known long, plus double, h long, at binary"
    )
    rows = written(rows)
    rare = rows.where("h IS NOT NULL").select("rid", "doc_id", "h", "at").join(table, "h")
    none = F.lit(None)
    own = rows.where("h IS NULL").select("rid", "doc_id", "held_out", "classes", "n_known", "plus", none.cast("struct<at: binary, cls: int, c: bigint>").alias("word"))
    both = own.unionAll(rare.select("rid", "doc_id", none.cast("boolean"), none.cast("binary"), none.cast("long"), none.cast("double"), F.struct("at", "cls", "c")))
    one = both.groupBy("rid", "doc_id").agg(
        F.max("held_out").alias("held_out"), F.count("classes").alias("n"), F.max("classes").alias("classes"), F.max("n_known").alias("n_known"), F.max("plus").alias("plus"), F.collect_set("word").alias("rare")
    )
    return one.select("doc_id", "held_out", "n", "classes", "n_known", "plus", "rare").mapInArrow(fill, f"doc_id {kind}, held_out boolean, n long, classes binary, n_known long, plus double")


def _joined(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each token, text of each token, first token of each text)."""
    base = column(batch, "classes").to_pylist()
    size = np.array([len(x) for x in base], dtype=np.int64)
    return np.frombuffer(b"".join(base), dtype=np.uint8).astype(np.int64), np.repeat(np.arange(len(base)), size), np.cumsum(size) - size


def _before(line: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    out = np.empty_like(line)
    out[1:] = line[:-1]
    out[first] = end
    return out


def transitions(rows: DataFrame, known: Vocabulary, *, prior: float = PRIOR) -> Model:
    """The model of the class bigrams in ``rows`` of ``classed``."""
    classes, end = len(known.sizes), int(known.cls[-1])

    def run(batches):
        table = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            line, doc, first = _joined(batch)
            if len(line):
                table += np.bincount(_before(line, first, end) * classes + line, column(batch, "n").to_numpy()[doc], classes * classes).astype(np.int64)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["code", "c"])

    m = np.zeros(classes * classes)
    got = rows.select("classes", "n").mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).toArrow()  # at most classes * classes rows
    m[got["code"].to_numpy()] = got["c"].to_numpy()
    m = m.reshape(classes, classes)
    share = (m.sum(0) + 1) / (m.sum() + classes)
    step = np.log10((m + prior * share[None, :]) / (m.sum(1, keepdims=True) + prior))
    return Model(known, step, np.log10(known.sizes + known.words + 1))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    known, end = model.vocabulary, int(model.vocabulary.cls[-1])
    step, below = model.step, model.below

    def run(batches):
        for batch in batches:
            line, doc, first = _joined(batch)
            n = batch.num_rows
            tokens, plus = np.bincount(doc, minlength=n), column(batch, "plus").to_numpy()
            path = np.bincount(doc, step[_before(line, first, end), line] - below[line], n) if len(line) else np.zeros(n)
            copies = pa.array(np.repeat(np.arange(n), column(batch, "n").to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [
                    x.take(copies)
                    for x in (
                        column(batch, "doc_id"), column(batch, "held_out"), pa.array(tokens, pa.int64()), column(batch, "n_known"), pa.array([known.tokens] * n, pa.int64()),
                        pa.array(plus - tokens * np.log10(float(known.tokens + known.vocabulary + 1))), pa.array(plus + path),
                    )
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def fit(docs: DataFrame, *, prior: float = PRIOR, **options) -> tuple[Model, DataFrame]:
    """The model and the table (h, c, cls) of all words, from all rows of ``docs``."""
    known, table = learn(docs, **options)
    return transitions(classed(docs, known, table), known, prior=prior), table


def score(docs: DataFrame, model: Model, table: DataFrame, held=None) -> DataFrame:
    """``scored`` of any documents."""
    return scored(classed(docs, model.vocabulary, table, held), model)


def brown_scores(docs: DataFrame, *, prior: float = PRIOR, **options) -> DataFrame:
    """Scores of all documents under a model of those outside the held-out fold."""
    remainder = fold("doc_id", FOLDS)
    known, table = learn(docs.where(remainder != HELD), **options)
    rows = written(classed(docs, known, table, remainder == HELD))
    return scored(rows, transitions(rows.where("NOT held_out"), known, prior=prior))
