"""Packing documents into token sequences in the order of a space-filling curve.

Each document is a vector: its hashed byte 4-grams, as root frequencies.  A fixed random matrix projects it to four dimensions,
whose places over the corpus (normal scores about its mean) are cells of a grid.  The Hilbert key of the cell orders the documents, so neighbours in the
order are alike, and exact copies lie side by side.  Documents are laid end to end along the curve and cut every ``size`` ids.

Distribution.  One light pass takes the projections' mean and spread (a row of numbers) and a bounded random sample of (key, size) as range bounds,
as Spark's own range sort does; the sample decides where ranges end, never what is packed.  The second pass encodes each document once, deals it to its
range and sorts the range.  Equal keys are dealt by a hash of the document and its row, so any number of copies is spread.  Each range
starts a sequence of its own, and what is left of it at its end goes into sequences whose lengths are powers of two, which need no
padding: no range waits for another, and nothing is padded.

Defined cases: a null or empty text is the end id alone; a null doc_id is an id like others; repeated rows are documents of their own;
equal keys are in the order of a hash of doc_id and row; a very long text goes through the encoder in slices; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, column, written
from .wordops import LOWER, blank_cut, same_bytes, words_of

SIZE, END = 2048, 1
BUCKETS, DIMS, BITS = 256, 4, 11
#: Bits below the Hilbert key by which equal keys are dealt.
TIE = 63 - DIMS * BITS
#: Ids of a range, about, and rows of the sample that bounds the ranges: for each range, and in all.
RANGE_IDS, SAMPLE_EACH, SAMPLE = 4_000_000, 200, 1_000_000
#: Bytes of texts whose words are told apart together.
BUFFER_BYTES, BATCH = 1 << 22, 2000
#: Distinct pieces that an encoder keeps, and twice the words.
KEPT = 700_000

_RNG = np.random.default_rng(12)
PROJECTION = _RNG.normal(size=(BUCKETS, DIMS))
_FOUR = np.uint32(0x9E3779B1)

#: How the tokenizer of short cuts makes words of a text (its file states them).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Accented Latin letters that are one character each, have no other composed form, and keep their length in lower case; with ASCII the characters of plain words.
LETTERS = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x180)]))
#: The tokenizer's rule on lower-case plain words, and what makes a word not plain: other characters, and beginnings of special tokens.
CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|\n|[^a-z0-9{LETTERS}\n]+")
ODD = re.compile(rf"[^\x21-\x7e{LETTERS}]|<\|")


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ragged:
    """Lists of numbers end to end, appended in bulk and gathered by code."""

    def __init__(self, kind):
        self.flat, self.first, self.count = np.zeros(1 << 12, dtype=kind), np.zeros(1 << 12, dtype=np.int64), 0

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        ends = self.first[self.count] + np.cumsum(sizes)
        for name, need in (("flat", int(ends[-1]) if len(ends) else 0), ("first", self.count + len(sizes) + 1)):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(len(have), need - len(have)), dtype=have.dtype)]))
        if len(ends):
            self.flat[self.first[self.count] : ends[-1]] = flat
            self.first[self.count + 1 : self.count + 1 + len(sizes)] = ends
            self.count += len(sizes)

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the lists of the codes end to end, their sizes)."""
        start = self.first[codes]
        size = self.first[codes + 1] - start
        upto = np.cumsum(size)
        return self.flat[np.repeat(start - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)], size


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


class Encoder:
    """Token ids of texts, as the tokenizer's own ``encode(text, add_special_tokens=False)`` gives them.

    Where the tokenizer drops blanks and never joins words across them, a text is a list of words, a plain word a list of pieces (as the
    tokenizer's rule cuts them), and each distinct piece is encoded once and kept.  The words of a buffer are told apart by their hashes, confirmed by
    their bytes, so each distinct one is looked up once.  Words with rare characters, and whole texts for any other tokenizer, go through the tokenizer as they are.
    """

    def __init__(self, path: str | None = None, kept: int = KEPT):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or vocabulary_file())
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        state = json.loads(self.tokenizer.to_str())
        steps = ((state.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        suffix = state["model"].get("end_of_word_suffix")
        forms = [n.get("type") for n in (state.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = bool(suffix) and steps.get("pattern") == {"Regex": PIECES} and forms == ["NFC", "Replace", "Lowercase"]
        self.kept = kept
        if self.by_word:
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
            self.ends[[i for s, i in self.tokenizer.get_vocab().items() if s.endswith(suffix)]] = True
            # Letters as the model sees them: the signs that stand for their bytes.
            signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.signs = {ord(c): "".join(s for s, _ in signs.pre_tokenize_str(c)) for c in LETTERS}
        self._forget(True)

    def _forget(self, pieces: bool) -> None:
        self.words: dict[bytes, int] = {}  # codes rise in the dictionary's order
        self.parts, self.seen = Ragged(np.int64), np.zeros(1 << 12, dtype=np.int32)
        if pieces:
            self.pieces = {"\n": 0}  # what parts words in a run over many; no ids
            self.ids = Ragged(self.width)
            self.ids.append(np.zeros(0, dtype=self.width), np.zeros(1, dtype=np.int64))

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        out = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype=self.width) for e in out]

    def _keep(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = self.ids.count
        self.ids.append(ids, sizes)
        self.pieces.update(zip(keys, range(first, first + len(keys)), strict=True))

    def _learn_pieces(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            text = " ".join(some)
            ids = np.array(self.plain.encode(text if text.isascii() else text.translate(self.signs), add_special_tokens=False).ids, dtype=self.width)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                self._keep(some, ids, np.diff(stops, prepend=0))
            else:  # a piece without an end of its own
                each = self._whole([p.encode() for p in some])
                self._keep(some, np.concatenate(each), np.array([len(i) for i in each]))

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Codes of new words: their pieces are cut in one run over all of them."""
        text = b"\n".join(words).decode("utf-8", "replace")
        each = text.split("\n")
        odd = np.array([ODD.search(t) is not None for t in each]) if ODD.search(text.replace("\n", "")) else np.zeros(len(words), dtype=bool)
        plain = list(compress(each, (~odd).tolist()))
        codes, first = np.zeros(len(words), dtype=np.int64), self.parts.count
        if plain:
            cut = CUT.findall("\n".join(plain).lower())
            part = np.fromiter(map(self.pieces.get, cut, repeat(-1)), dtype=np.int64, count=len(cut))
            if (part < 0).any():
                self._learn_pieces(list(dict.fromkeys(compress(cut, (part < 0).tolist()))))
                part = np.fromiter(map(self.pieces.__getitem__, cut), dtype=np.int64, count=len(cut))
            breaks = np.concatenate([[-1], np.flatnonzero(part == 0), [len(part)]])
            self.parts.append(part[part > 0], np.diff(breaks) - 1)
        if odd.any():
            rare = list(compress(each, odd.tolist()))
            new = list(dict.fromkeys(t for t in rare if "\0" + t not in self.pieces))
            if new:
                ids = self._whole([t.encode() for t in new])
                self._keep(["\0" + t for t in new], np.concatenate(ids), np.array([len(i) for i in ids]))
            self.parts.append(np.array([self.pieces["\0" + t] for t in rare], dtype=np.int64), np.ones(len(rare), dtype=np.int64))
        codes[~odd], codes[odd] = np.arange(first, first + len(plain)), np.arange(first + len(plain), first + len(words))
        self.words.update(zip(compress(words, (~odd).tolist()), range(first, first + len(plain)), strict=True))
        self.words.update(zip(compress(words, odd.tolist()), range(first + len(plain), first + len(words)), strict=True))
        return codes

    def _thin(self) -> None:
        """Keep the words of more than one buffer; hardly any of the others come again."""
        again = self.seen[: len(self.words)] > 1
        if 2 * again.sum() > len(again):
            self._forget(False)
            return
        words, (flat, sizes) = list(compress(self.words, again.tolist())), self.parts.gather(np.flatnonzero(again))
        self._forget(False)
        self.parts.append(flat, sizes)
        self.words.update(zip(words, range(len(words)), strict=True))

    def _codes(self, words: list[bytes]) -> np.ndarray:
        """Codes of distinct words."""
        if len(self.pieces) > self.kept:
            self._forget(True)
        elif len(self.words) > self.kept // 2:
            self._thin()
        codes = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        lost = np.flatnonzero(codes < 0)
        if len(lost):
            codes[lost] = self._learn([words[i] for i in lost.tolist()])
        if len(self.words) > len(self.seen):
            self.seen = np.concatenate([self.seen, np.zeros(len(self.words), dtype=np.int32)])
        self.seen[codes] += 1
        return codes

    def encode(self, data: np.ndarray, offsets: np.ndarray, buffer_bytes: int = BUFFER_BYTES) -> list[np.ndarray]:
        """The ids of each text of a buffer (bytes, offsets)."""
        if not self.by_word:
            return self._whole([data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        out: list[np.ndarray] = []
        i = 0
        while i < len(offsets) - 1:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + buffer_bytes, side="right")) - 1)
            if offsets[j] - offsets[i] <= buffer_bytes:
                out += self._encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            else:  # one long text
                pieces = [self._encode(p, np.array([0, len(p)]))[0] for p in blank_cut(data[offsets[i] : offsets[j]], buffer_bytes)]
                out.append(np.concatenate(pieces))
            i = j
        return out

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        raw = data.tobytes()
        if b"<|" not in raw:  # special tokens are case-sensitive, all else is not
            data = LOWER[data]
            raw = data.tobytes()
        words = words_of(data, offsets)
        if not len(words):
            return [np.zeros(0, dtype=self.width)] * (len(offsets) - 1)
        size = words.ends - words.starts
        _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        like = first[which]
        cut = lambda some: [raw[a:b] for a, b in zip(words.starts[some].tolist(), words.ends[some].tolist(), strict=True)]
        if (size == size[like]).all() and same_bytes(data, words.starts, words.starts[like], size).all():
            every = cut(first)
        else:  # two words of one hash: told apart by their bytes alone
            each = cut(np.arange(len(words)))
            number = {w: k for k, w in enumerate(dict.fromkeys(each))}
            which, every = np.array([number[w] for w in each]), list(number)
        codes = self._codes(every)[which]
        parts, per_word = self.parts.gather(codes)
        ids, per_part = self.ids.gather(parts)
        return np.split(ids, np.cumsum(_sums(_sums(per_part, per_word), words.counts()))[:-1])


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this process: what it has learned serves all tasks of the process."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def projected(texts: pa.Array) -> np.ndarray:
    """A row for each text: its hashed 4-grams' root frequencies in ``DIMS`` directions."""
    data, offsets = buffer_of(texts)
    out = np.zeros((len(texts), DIMS))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 19), side="right")) - 1)
        each = np.zeros((j - i, BUCKETS))
        bounds = offsets[i : j + 1] - offsets[i]
        for at in range(0, int(bounds[-1]), 1 << 20):  # more than one turn for a single long text only
            part = LOWER[data[offsets[i] + at : min(offsets[j], offsets[i] + at + (1 << 20) + 3)]]
            n = len(part) - 3
            if n <= 0:
                continue
            grams = np.ndarray(n, dtype="<u4", buffer=part, strides=(1,))
            bucket = ((grams * _FOUR) >> np.uint32(24)).astype(np.uint8)
            if j - i == 1:
                each[0] += np.bincount(bucket, minlength=BUCKETS)
                continue
            for k, (first, last) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if last - first > 3:  # grams of one text
                    each[k] = np.bincount(bucket[first : last - 3], minlength=BUCKETS)
        out[i:j] = np.sqrt(each / np.maximum(each.sum(axis=1, keepdims=True), 1)) @ PROJECTION
        i = j
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of grid cells (below 2**bits): neighbours along the curve are neighbours in the grid."""
    x = [c.astype(np.int64) for c in cells.T]
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns and mirrorings of each level, from the coarsest
        low = q - 1
        for i in range(len(x)):
            hit = (x[i] & q) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[i]
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[-1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | (((c ^ turn) >> b) & 1)
    return out


def curve_keys(points: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Hilbert keys of projected points: cells are equal shares of a logistic curve about the corpus's mean."""
    z = (points - centre) / np.maximum(spread, 1e-12)
    share = 1 / (1 + np.exp(-1.702 * np.clip(z, -12, 12)))
    return hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _placed(keys: np.ndarray, tie: np.ndarray) -> np.ndarray:
    return (keys << TIE) | (tie & ((1 << TIE) - 1))


def _with_tie(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(F.lit("curve"), "doc_id", F.monotonically_increasing_id()).alias("tie"))


def ranges(docs: DataFrame, range_ids: int = RANGE_IDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, spread, bounds): mean and spread of all projections, and the order values at which ranges of about ``range_ids`` ids end."""
    names = [f"x{i}" for i in range(DIMS)]

    def run(batches):
        for batch in batches:
            texts = column(batch, "text")
            x = projected(texts)
            sizes = np.diff(buffer_of(texts)[1])
            yield pa.RecordBatch.from_arrays([column(batch, "tie"), pa.array(sizes), *(pa.array(x[:, i]) for i in range(DIMS))], ["tie", "bytes", *names])

    light = written(_with_tie(docs).mapInArrow(run, "tie long, bytes long, " + ", ".join(f"{n} double" for n in names)))
    got = light.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), *(f(n).alias(f"{k}{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not got["n"]:
        return np.zeros(DIMS), np.ones(DIMS), np.zeros(0, dtype=np.int64)
    centre, spread = (np.array([got[f"{k}{n}"] for n in names]) for k in "ms")
    count = int(-(-((got["bytes"] or 0) * 0.4 + got["n"]) // range_ids))
    most = min(SAMPLE, SAMPLE_EACH * count)
    some = light if got["n"] <= most else light.where(F.pmod(F.xxhash64(F.lit("sample"), "tie"), F.lit(got["n"])) < most)
    rows = some.limit(2 * most).toPandas()  # bounded: it only places the ranges
    place = _placed(curve_keys(rows[names].to_numpy(), centre, spread), rows["tie"].to_numpy())
    order = np.argsort(place)
    weight = np.cumsum(rows["bytes"].to_numpy()[order] * 0.4 + 1)
    at = np.searchsorted(weight, weight[-1] * np.arange(1, count) / count) if len(weight) else np.zeros(0, dtype=np.int64)
    return centre, spread, np.unique(place[order][np.minimum(at, len(order) - 1)])


def laid(starts: np.ndarray, total: int, room: int, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """(document, first id, id behind the last, sequence, offset) of the pieces of documents laid end to end, from ``room`` ids into sequence 0.

    ``starts`` are the places of the documents' first ids among ``total``; a piece ends where its document or its sequence does.
    """
    cuts = np.unique(np.concatenate([starts, np.arange(size - room, total, size)]))
    ends = np.append(cuts[1:], total)
    return np.searchsorted(starts, cuts, side="right") - 1, cuts, ends, (room + cuts) // size, (room + cuts) % size


def powers(n: int) -> list[int]:
    """``n`` as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, *, path: str | None = None, size: int = SIZE, end: int = END, range_ids: int = RANGE_IDS, with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` its ids.

    ``path`` is the tokenizer's file; sequences have ``size`` ids, but for the powers of two at a range's end.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    centre, spread, bounds = ranges(docs, range_ids)

    def encoded(batches):
        coder = encoder(path)
        for batch in batches:
            texts = column(batch, "text")
            place = _placed(curve_keys(projected(texts), centre, spread), column(batch, "tie").to_numpy())
            dealt = np.searchsorted(bounds, place, side="right").astype(np.int32)
            data, offsets = buffer_of(texts)
            for first in range(0, len(texts), BATCH):
                stop = min(first + BATCH, len(texts))
                some = range(first, stop)
                ids = [np.append(i, coder.width(end)) for i in coder.encode(data, offsets[first : stop + 1])]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id").slice(first, len(some)), column(batch, "tie").slice(first, len(some)), pa.array(dealt[first:stop]), pa.array(place[first:stop]), pa.array([i.astype("<u4" if coder.width == np.uint32 else "<u2").tobytes() for i in ids], pa.binary()), pa.array([coder.width().itemsize] * len(some), pa.int32())],
                    ["doc_id", "tie", "range", "place", "ids", "wide"],
                )

    def sequences(batches):
        """Lays out a range; pieces of the last, open sequence are held back and cut anew at the end."""
        room, number, base, open_ = 0, 0, 0, None

        def batch_of(docs, start, tokens, sequence, offset, pieces):
            crcs = [zlib.crc32(x) for x in pieces]
            numbers = [start, [len(x) for x in pieces], crcs, tokens, (base << 40) + np.asarray(sequence, dtype=np.int64), offset]
            lists = [pa.array([x.astype(np.int64) for x in pieces], pa.list_(pa.int64()))] if with_ids else []
            return pa.RecordBatch.from_arrays([docs, *(pa.array(n, pa.int64()) for n in numbers), *lists], names)

        for batch in batches:
            if not len(batch):
                continue
            if not room and not number:
                base = column(batch, "range")[0].as_py()  # ranges of one task are nobody else's
            raw, wide = column(batch, "ids"), "<u4" if column(batch, "wide")[0].as_py() == 4 else "<u2"
            every, offsets = buffer_of(raw)
            ids = every[offsets[0] : offsets[-1]].view(wide).astype("<u4")
            starts = (offsets - offsets[0]) // np.dtype(wide).itemsize
            doc, first, last, step, offset = laid(starts[:-1], len(ids), room, size)
            tokens, sequence = np.diff(starts)[doc], number + step
            total = room + len(ids)
            whole = int(np.searchsorted(step, total // size))  # pieces of sequences that are full now
            docs = column(batch, "doc_id").take(pa.array(doc))
            pieces = [ids[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            inside = first - starts[doc]
            if open_ is not None and total >= size:
                yield batch_of(*open_)
                open_ = None
            if whole:
                yield batch_of(docs[:whole], inside[:whole], tokens[:whole], sequence[:whole], offset[:whole], pieces[:whole])
            rest = [docs[whole:], inside[whole:], tokens[whole:], sequence[whole:], offset[whole:], [x.copy() for x in pieces[whole:]]]
            open_ = rest if open_ is None else [pa.concat_arrays([open_[0], rest[0]]), *(np.concatenate([x, y]) for x, y in zip(open_[1:5], rest[1:5], strict=True)), open_[5] + rest[5]]
            number, room = number + total // size, total % size
        if open_ is None or not room:
            return
        out, left, used = [], powers(room), 0
        for k, (start, tokens, piece) in enumerate(zip(open_[1].tolist(), open_[2].tolist(), open_[5], strict=True)):
            at = 0
            while at < len(piece):
                take = min(len(piece) - at, left[0] - used)
                out.append((k, start + at, tokens, number, used, piece[at : at + take]))
                at, used = at + take, used + take
                if used == left[0]:
                    left, used, number = left[1:], 0, number + 1
        k, start, tokens, sequence, offset, pieces = zip(*out, strict=True)
        yield batch_of(open_[0].take(pa.array(k)), start, tokens, sequence, offset, pieces)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    coded = _with_tie(docs).mapInArrow(encoded, f"doc_id {kind}, tie long, range int, place long, ids binary, wide int")
    dealt = coded.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "place", "tie")
    return dealt.mapInArrow(sequences, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + (", ids array<bigint>" if with_ids else ""))
