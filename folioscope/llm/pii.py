"""Personal data: format rules always redact; boosted trees add what looser generators propose.

Base spans are the fixed formats with their checks.  High-recall generators also propose overlapping spans of looser form:
e-mail addresses written out, spaced or bracketed quads and IPv6, cards with other separators, phone numbers
without a plus sign, and secrets (keys, tokens, passwords), a kind that has no base format.  Boosted trees score a proposal by
its format and its context.

There are no labels for personal data, so labelled rows are made: ``plant`` puts invented spans and look-alikes into word gaps of
a bounded sample of documents (``max_docs``, chosen by hash), and their proposals are the training rows: 1 for invented
personal data, 0 for look-alikes and for the sample's own proposals that a check refuses (a digit group of a card's length that
fails Luhn, a quad with a part above 255).  Other proposals of the sample are of unknown kind and left out.  The threshold of each kind
is set on held-out documents: the lowest one at which at least ``precision`` of what passes is personal data; ``Detector.report``
has the held-out precision and recall.  Proposals at or above it are added, best first, where they overlap nothing chosen before.

Defined cases: a null text is empty; no documents in the sample leave the base rules alone; repeated rows give
repeated results; texts are scanned whole and in linear time (digit runs are entered at their start only);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import column, written

KINDS = ("email", "ip", "card", "phone", "secret")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behind keeps long digit runs linear: a match that fails at a run's start fails inside it too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_HOST = r"[A-Za-z0-9-]{1,63}"
_AT, _DOT = r"(?:@|[\[({]\s?at\s?[\])}])", r"(?:\.|[\[({]\s?dot\s?[\])}])"
_WRITTEN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}"
#: Looser forms, one or more for each kind: (what must occur, pattern, group of the span).
_LOOSE = {
    "email": [
        (re.compile(_AT, re.I), re.compile(rf"{_WRITTEN}\s?{_AT}\s?{_HOST}(?:\s?{_DOT}\s?{_HOST}){{1,8}}", re.I), 0),
        (re.compile(r"\sdot\s", re.I), re.compile(rf"{_WRITTEN}\sat\s{_HOST}(?:\sdot\s{_HOST}){{1,8}}", re.I), 0),
    ],
    "ip": [
        (re.compile(r"[0-9]"), re.compile(r"(?<![0-9])[0-9]{1,4}(?:\s?(?:\.|\[\.\])\s?[0-9]{1,4}){3}(?![0-9])"), 0),
        (re.compile(r":"), re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])"), 0),
    ],
    "card": [(re.compile(r"[0-9]"), re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){11,18}(?![0-9])"), 0)],
    "phone": [(re.compile(r"[0-9]"), re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[ ().\-/]{0,3}[0-9]){6,14}(?![0-9])"), 0)],
    "secret": [
        (re.compile(r"[0-9]"), re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]{0,63}[0-9])[A-Za-z0-9_+/=-]{16,512}(?![A-Za-z0-9_+/=-])"), 0),
        (re.compile(r"[:=]"), re.compile(r"""(?:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access|private)[ _-]?key)["']?\s?[:=]\s?["']?([^\s"',;<>]{4,128})""", re.I), 1),
    ],
}
_HINT = {
    "email": re.compile(r"mail|contact|write|correo|@", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr", re.I),
    "card": re.compile(r"card|visa|karte|carte|tarjeta|credit", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobil|\+", re.I),
    "secret": re.compile(r"key|token|secret|pass|pwd|auth|bearer|credential", re.I),
}
#: Words before numbers that are no personal data.
_OTHER = re.compile(r"isbn|issn|version|page|vol|date|order|item|serial|sha|md5|commit|checksum|digest|total|section|chapter|id\b|no\.|nr\.|#", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats, in order of start, then kind."""
    out: list[tuple[int, int, int]] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    digits = False
    for m in _CARD.finditer(text):
        digits = True
        d = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 60 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if digits or "." in text:
        for m in _IP.finditer(text):
            if all(int(p) <= 255 for p in (q.lstrip("0")[:4] or "0" for q in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of looser forms."""
    out, seen = set(), {}
    for k, kind in enumerate(KINDS):
        for need, form, group in _LOOSE[kind]:
            if need.pattern not in seen:
                seen[need.pattern] = need.search(text) is not None
            if seen[need.pattern]:
                out.update((m.start(group), k, m.end(group)) for m in form.finditer(text))
    return sorted(out)


FEATURES = 30


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    s = text[start:end]
    d = _NOT_DIGIT.sub("", s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    parts = [int(g) for g in re.findall(r"[0-9]{1,9}", s)]
    letters = sum(c.isalpha() for c in s)
    counts = Counter(s)
    spread = -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values())
    quiet = before.rstrip(" \"'`")
    return [
        float(kind), len(s), len(d), len(groups), max(groups, default=0), min(groups, default=0), s.count("."), s.count("-"), s.count(" "),
        s.count("(") - s.count(")"), float(s[0] == "+"), float("@" in s), float(bool(re.search(r"[\[({]\s?(?:at|dot)|\sdot\s", s, re.I))), letters,
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ("+", "@", ".", "-", "_", "/", "=")), float(after[:1] in ("@", "-", "_", "/", "=")),
        float(bool(_HINT[KINDS[kind]].search(before))), float(max(parts, default=0) <= 255), float(luhn(d)) if d else 0.0, float(s[-1:].isalnum()),
        spread, float(bool(_OTHER.search(before))), float(quiet[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'", "`")),
        sum(c in "0123456789abcdefABCDEF" for c in s) / len(s), float(any(c.islower() for c in s) and any(c.isupper() for c in s)), s.count(":"), float(d[:2] in ("19", "20")),
    ]


def _checked(s: str, alphabet: str = "0123456789") -> str:
    """Digits with a last one that passes Luhn."""
    return next(s + c for c in alphabet if luhn(s + c))


def _pick(r: random.Random, alphabet: str, least: int, most: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(r.randint(least, most)))


def _grouped(r: random.Random, digits: str) -> str:
    """Digits in fours, with one separator or several."""
    one, signs = r.choice(["", "", ".", "_", "  ", "/", " ", "-", None]), [".", " ", "-", "_", "/"]
    return "".join((("" if not i else r.choice(signs) if one is None else one) + digits[i : i + 4]) for i in range(0, len(digits), 4))


_DIGITS, _LETTERS, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
_MIXED = _LETTERS + _LETTERS.upper() + _DIGITS


def invent(r: random.Random, kind: int, real: bool) -> tuple[str, str, str]:
    """(words before, span, sign after) of invented personal data of a kind, or of a look-alike."""
    name, host, top = _pick(r, _LETTERS, 3, 9), _pick(r, _LETTERS, 3, 9), r.choice(["com", "org", "net", "io", "de", "fr", "es"])
    lead = r.random() < 0.5
    if kind == 0:
        if real:
            at, dot = r.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), ("(at)", "(dot)"), (" at ", " dot "), (" @ ", "."), (" {at} ", " {dot} "), (" @ ", " . ")])
            return r.choice(["mail ", "contact: ", "write to ", "e-mail "]) if lead else "", f"{name}{r.choice(['', '.', '_'])}{_pick(r, _LETTERS, 2, 8)}{at}{host}{dot}{top}", ""
        return "", r.choice([f"{name} @ {host}. {_pick(r, _LETTERS, 2, 8).title()}", f"{name}@{host} . {_pick(r, _LETTERS, 4, 8)}", f"{_pick(r, 'ABWXYZ', 1, 1)} @ {_pick(r, 'ABWXYZ', 1, 1)}.T", f"{r.randint(2, 99)} @ {r.randint(2, 99)}.{r.randint(10, 99)}"]), ""
    if kind == 1:
        if real:
            part = [str(r.randint(0, 255)) for _ in range(4)]
            span = r.choice([" . ", "[.]", " .", ". "]).join(part) if r.random() < 0.7 else ":".join(_pick(r, _HEX, 1, 4) for _ in range(8))
            return r.choice(["host ", "server ", "ip ", "address "]) if lead else "", span, ""
        return r.choice(["version ", "section ", ""]), r.choice([". ".join(str(r.randint(1, 12) + i) for i in range(4)), ".".join([str(r.randint(256, 2999)), *(str(r.randint(0, 999)) for _ in range(3))]), ":".join(f"{r.randint(0, 59):02d}" for _ in range(4))]), ""
    if kind == 2:
        body = _pick(r, "3456", 1, 1) + _pick(r, _DIGITS, r.choice([11, 12, 14]), 14)
        if real:
            d = _checked(body[: r.choice([12, 14, 15])])
            return r.choice(["card ", "visa ", "credit card ", "karte "]) if lead else "", _grouped(r, d), ""
        d = _pick(r, _DIGITS, 12, 19)
        while luhn(d):
            d = _pick(r, _DIGITS, 12, 19)
        return r.choice(["order ", "id ", "serial ", "card ", "", ""]), _grouped(r, d), ""
    if kind == 3:
        if real:
            a, b, c = _pick(r, _DIGITS, 3, 3), _pick(r, _DIGITS, 3, 3), _pick(r, _DIGITS, 4, 4)
            span = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a[:2]} {b}{c}", f"00{r.randint(20, 59)} {a} {b} {c}", f"({a}){b} {c}", f"0{a[:2]}/{b}{c}"])
            return r.choice(["tel. ", "phone: ", "call ", "fax ", "mobile "]) if lead else "", span, ""
        y = r.randint(1900, 2029)
        return r.choice(["isbn ", "date ", "pages ", "total ", ""]), r.choice([
            f"978-{r.randint(0, 9)}-{_pick(r, _DIGITS, 2, 5)}-{_pick(r, _DIGITS, 4, 6)}-{r.randint(0, 9)}", f"{y}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}", f"{y}-{y + r.randint(1, 30)}",
            " ".join(str(r.randint(0, 99)) for _ in range(r.randint(4, 7))), f"{r.randint(1, 99)}.{_pick(r, _DIGITS, 6, 11)}", _pick(r, _DIGITS, 7, 12), f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{y}",
        ]), ""
    if real:
        value = r.choice([
            _pick(r, _HEX, 32, 32), _pick(r, _HEX, 40, 40), _pick(r, _HEX, 64, 64), "AKIA" + _pick(r, _MIXED.upper(), 16, 16), "ghp_" + _pick(r, _MIXED, 36, 36), "sk-" + _pick(r, _MIXED, 24, 48),
            "eyJ" + _pick(r, _MIXED, 20, 40), _pick(r, _MIXED + "+/", 24, 44), _pick(r, _MIXED + "!$%&?", 8, 16),
        ])
        lead = r.choice(["token = ", "api_key: ", "password=", "secret = ", "access_key=", "passwd: ", "private key = "])
        quote = r.choice(["", '"', "'"])
        return r.choice([lead.upper(), lead, lead]) + quote, value, quote
    return r.choice(["sha1 ", "commit ", "checksum ", "md5 ", "", ""]), r.choice([
        _pick(r, _HEX, 32, 40), f"{_pick(r, _LETTERS, 6, 12)}-{_pick(r, _LETTERS, 6, 12)}-{r.randint(1, 99)}", f"{_pick(r, _LETTERS, 4, 9)}/{_pick(r, _LETTERS, 4, 9)}/{_pick(r, _LETTERS, 4, 9)}{r.randint(1, 9)}",
        f"{r.randint(1900, 2029)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}-{_pick(r, _LETTERS, 5, 12)}", "=" * r.randint(10, 30) + "1" + "=" * r.randint(8, 30), _pick(r, _LETTERS, 14, 24).title() + str(r.randint(1, 99)),
    ]), ""


def plant(text: str, r: random.Random, spans: int = 6, width: int = 2_000) -> tuple[str, list[tuple[int, int, int, int]]]:
    """A stretch of the text with invented spans in word gaps, and their (start, kind, end, label)."""
    at = r.randrange(max(1, len(text) - width))
    words = text[at : at + width].split(" ")
    marks = {r.randrange(len(words) + 1): (k, real) for _ in range(spans) for k, real in [(r.randrange(len(KINDS)), r.random() < 0.5)]}
    out, size, found = [], 0, []
    for i in range(len(words) + 1):
        if i in marks:
            kind, real = marks[i]
            lead, span, tail = invent(r, kind, real)
            found.append((size + len(lead), kind, size + len(lead) + len(span), int(real)))
            out.append(lead + span + tail + " ")
            size += len(out[-1])
        if i < len(words):
            out.append(words[i] + " ")
            size += len(out[-1])
    return "".join(out), found


def refused(s: str, kind: int) -> bool:
    """Whether a format check says that the text is not of this kind."""
    d = _NOT_DIGIT.sub("", s)
    if kind == 1 and ":" not in s:
        return any(int(p) > 255 for p in re.findall(r"[0-9]+", s))
    return kind == 2 and 14 <= len(d) <= 19 and not luhn(d)


def examples(text: str, r: random.Random, natural: int = 10) -> list[tuple[list[float], int]]:
    """(features, label) of the proposals on one planted stretch of a text; at most ``natural`` of the text's own."""
    told, marks = plant(text, r)
    out, own = [], []
    for c in proposals(told):
        s, k, e = c
        label = next((y for a, kind, b, y in marks if (kind == k or not y) and min(e, b) - max(s, a) > 0 and 2 * (min(e, b) - max(s, a)) >= max(e - s, b - a)), None)
        if label is not None:
            out.append((describe(told, *c), label))
        elif refused(told[s:e], k) and not any(s < b and a < e for a, _, b, _ in marks):
            own.append((describe(told, *c), 0))
    return out + r.sample(own, min(natural, len(own)))


@dataclass
class Detector:
    forest: boosting.Forest
    cuts: tuple[float, ...]
    report: dict = field(default_factory=dict)  # kind -> (held-out precision, recall of proposed, personal data, look-alikes)


def fit(docs: DataFrame, *, max_docs: int = 2_000, stretches: int = 4_000, precision: float = 0.98) -> Detector:
    """Trees and thresholds from about ``stretches`` planted stretches of at most ``max_docs`` documents."""
    ids = written(docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id", F.lit("pii")), "doc_id").limit(max_docs).distinct(), few=True)
    turns = max(1, min(100, -(-stretches // max(1, ids.count()))))
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))

    def run(batches):
        for batch in batches:
            rows, ys, folds = [], [], []
            for text in column(batch, "text").to_pylist():
                key = hashlib.md5((text or "").encode("utf-8", "replace")).digest()
                for turn in range(turns):
                    got = examples(text or "", random.Random(key + bytes([turn])))
                    rows += [x for x, _ in got]
                    ys += [y for _, y in got]
                    # By document; a handful of documents is split by stretch.
                    folds += [(key[0] if turns < 50 else turn) % 3] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(ys, pa.int32()), pa.array(folds, pa.int32())], ["x", "y", "fold"])

    # Bounded by stretches: at most 6 planted spans and 10 others each, of FEATURES numbers.
    got = chosen.select("text").mapInArrow(run, "x array<double>, y int, fold int").toArrow()
    x = np.array(got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(got.num_rows, FEATURES)
    y, held = got["y"].to_numpy(), got["fold"].to_numpy() == 0
    order = np.lexsort([*x.T, y, held])
    x, y, held = x[order], y[order], held[order]
    forest = boosting.fit(x[~held], y[~held], trees=60, depth=5)
    cuts, report = [], {}
    p = forest.score(x[held]) if held.any() else np.zeros(0)
    for k, kind in enumerate(KINDS):
        mine = x[held][:, 0] == k
        s, t = p[mine], y[held][mine]
        cut = 2.0  # none of this kind is added
        if t.sum() >= 10:
            by = np.argsort(-s, kind="stable")
            ratio = np.cumsum(t[by]) / np.arange(1, len(by) + 1)
            ends = np.flatnonzero((ratio >= precision) & np.append(np.diff(s[by]) != 0, True))
            if len(ends):
                cut = max(0.5, float(s[by][ends[-1]]))
        passed = s >= cut
        report[kind] = (float(t[passed].mean()) if passed.any() else None, float(passed[t == 1].mean()) if t.any() else None, int(t.sum()), int((t == 0).sum()))
        cuts.append(cut)
    return Detector(forest, tuple(cuts), report)


def add_spans(text: str, base: list[tuple[int, int, int]], model: Detector) -> list[tuple[int, int, int]]:
    """Base spans and, best first, proposals at or above their kind's threshold that overlap nothing chosen before."""
    if min(model.cuts) > 1:
        return base
    new = _apart(proposals(text), base)
    if not new:
        return base
    score = model.forest.score(np.array([describe(text, *c) for c in new]))
    chosen: list[tuple[int, int, int]] = []  # by start, without overlaps
    for v, c in sorted(zip((-score).tolist(), new, strict=True)):
        if -v >= model.cuts[c[1]]:
            i = bisect_left(chosen, c)
            if not (i and chosen[i - 1][2] > c[0] or i < len(chosen) and chosen[i][0] < c[2]):
                insort(chosen, c)
    return sorted(base + chosen)


def _apart(new, base):
    """Proposals that overlap no base span, by a sorted sweep."""
    if not base:
        return new
    starts = np.array([s for s, _, _ in base])
    ends = np.maximum.accumulate(np.array([e for _, _, e in base]))
    return [c for c in new if not (i := int(np.searchsorted(starts, c[2]))) or ends[i - 1] <= c[0]]


def _line(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, model: Detector) -> DataFrame:
    """Per document: counts of base spans by kind, base and all spans as text, and the number of added spans by kind."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base_names, more_names = [f"n_{k}" for k in KINDS[:4]], [f"added_{k}" for k in KINDS]

    def run(batches):
        m = shared.value
        for batch in batches:
            counts, base_text, every = [], [], []
            for text in column(batch, "text").to_pylist():
                base = base_spans(text) if text else []
                spans = add_spans(text, base, m) if text else []
                row = [0] * 9
                for _, k, _ in base:
                    row[k] += 1
                    row[4 + k] -= 1
                for _, k, _ in spans:
                    row[4 + k] += 1
                counts.append(row)
                base_text.append(_line(base))
                every.append(_line(spans))
            c = np.array(counts, dtype=np.int64).reshape(-1, 9)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(c[:, i]) for i in range(4)), pa.array(base_text, pa.string()), pa.array(every, pa.string()), *(pa.array(c[:, i]) for i in range(4, 9))],
                ["doc_id", *base_names, "base_spans", "spans", *more_names],
            )

    counts = ", ".join(f"{n} long" for n in base_names)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_spans string, spans string, {', '.join(f'{n} long' for n in more_names)}")


def redact(text: str | None, model: Detector) -> str | None:
    """The text with each span replaced by its kind in brackets."""
    if not text:
        return text
    out, last = [], 0
    for s, k, e in add_spans(text, base_spans(text), model):
        if e <= last:
            continue
        out += [text[last : max(s, last)], f"[{KINDS[k].upper()}]"]
        last = e
    return "".join(out) + text[last:]
