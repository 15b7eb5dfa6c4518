"""Personal data by boosted candidates (operator 9).

The base formats (mail address, IP address, card number, telephone number) are always reported.
High-recall generators propose further spans, which may overlap; gradient-boosted trees over the
format of a span and its context score them, and a calibrated threshold selects. The trees learn from
the corpus itself. Candidates in a checked format, and values that stand behind a word such as
"token" and are as mixed as keys are, are examples; what is neither mixed nor announced is a
counter-example, and all others stay unlabelled. Only texts with one of the characters that any span needs are read
character by character.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm.columnar import buffers, map_arrow, segment_sum
from vecmill.llm.labelled import platt, sigmoid

# The base formats. A mail address is found at its @, an IP address only where a run of
# digits begins; the matches are the same, and long runs are read once.
EMAIL_END = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "secret", "number")

# Forms of secrets that serve as examples.
KNOWN_SECRET = re.compile(
    r"\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"'`]?[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"'`]?[A-Za-z0-9+/_-]{12,}", re.I
)

# Generators: any run without white space that holds a digit, a sign of assignment or an @, the pieces
# of such a run between separators or characters beyond ASCII, the values in a piece, and any row of
# digit groups. Their spans may overlap each other and the base spans.
TOKEN = re.compile(r"(?<!\S)(?=\S*(?:[0-9=@]|:\S))\S+")
PIECE = re.compile(r"[^\s\"'`,;?&(){}\[\]<>|\x80-\U0010ffff]+")
VALUE = re.compile(r"[^=:]+")
ASSIGNED = re.compile(r"[=:][\"'`]?")
SIGN = re.compile(r"[0-9=@:]")
DIGITS = re.compile(r"(?<![0-9])\(?[0-9]{2,}(?:[\x20().-]{1,2}[0-9]{2,})*")
TRIGGER = np.zeros(256, bool)
TRIGGER[[ord(c) for c in "0123456789@=:"]] = True
HINTS = re.compile(r"(?:pass|pwd|secret|token|key|login|user|phone|tel|fax|call|mail|card|account|iban|ssn|ip|addr)\w*\W*$", re.I)

SAMPLE = 20_000
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.2, 32
PRECISION = 0.99
FEATURES = 14
# Values at least this long, of at least this many bits a character, are as mixed as keys are.
MIXED_LENGTH, MIXED_BITS = 16, 3.0


def luhn(digits: str) -> bool:
    total = 0
    for i, char in enumerate(reversed(digits)):
        value = int(char) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_CHARS:
            start -= 1
        if start < at and (end := EMAIL_END.match(text, at + 1)):
            found.append((start, end.end()))
            free = end.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base formats, in code points."""
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    return {
        "email": emails(text),
        "ip": [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(d := digits(m)) <= 19 and luhn(d)],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


def known_secrets(text: str) -> list[tuple[int, int]]:
    """Known forms of secrets, each to the end of its piece."""
    found = []
    for m in KNOWN_SECRET.finditer(text):
        rest = PIECE.match(text, m.end())
        end = rest.end() if rest else m.end()
        while end > m.end() and text[end - 1] in ".,;:!?)]}\"'*$%&#|":
            end -= 1
        found.append((m.start(), end))
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Further spans: tokens with a digit, a sign of assignment or an @, their pieces and values, and
    rows of digit groups."""
    spans: dict[tuple[int, int], None] = {}

    def add(start: int, end: int) -> None:
        while end > start and text[end - 1] in ".,;:!?)]}\"'*$%&#|":
            end -= 1
        while start < end and text[start] in "([{\"'":
            start += 1
        if end - start >= 6:
            spans[start, end] = None

    for m in TOKEN.finditer(text):
        add(*m.span())
        for piece in PIECE.finditer(text, *m.span()):
            start, end = piece.span()
            assigned = ASSIGNED.fullmatch(text, max(m.start(), start - 2), start) or ASSIGNED.fullmatch(text, max(m.start(), start - 1), start)
            if assigned or SIGN.search(text, start, end):
                add(start, end)
            for value in VALUE.finditer(text, start, end):
                if value.start() > start or SIGN.search(text, *value.span()):
                    add(*value.span())
    for span in known_secrets(text):
        spans[span] = None
    found = [("secret", *span) for span in spans]
    found += [("number", *m.span()) for m in DIGITS.finditer(text) if m.end() - m.start() >= 7]
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and its context."""
    own = text[start:end]
    size = max(len(own), 1)
    count = Counter(own)
    entropy = -sum(n / size * math.log2(n / size) for n in count.values())
    digits = sum(c.isdigit() for c in own)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(own, own[1:]))
    value = own.partition("=")[2] or own.partition(":")[2]
    sign = "=" if "=" in own else ":"
    key = own.partition(sign)[0] if sign in own else ""
    only = re.sub(r"[^0-9]", "", own)
    before = text[max(0, start - 16) : start]
    return [
        float(kind == "number"), float(len(own)), digits / size,
        sum(c.isupper() for c in own) / size, sum(c.islower() for c in own) / size, entropy,
        switches / size, float("=" in own or ":" in own), float(len(value)), float("@" in own),
        float(own.count(".")), float(len(only)),
        float(13 <= len(only) <= 19 and luhn(only)), float(bool(HINTS.search(before) or HINTS.search(key[-64:]))),
    ]


def mixed(value: str) -> bool:
    """Whether a value is as mixed as a key: long, with digits, and of many different characters."""
    if len(value) < MIXED_LENGTH or not any(c.isdigit() for c in value):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= MIXED_BITS


def example(text: str, kind: str, start: int, end: int, base: dict[str, list[tuple[int, int]]], known: list[tuple[int, int]]) -> int | None:
    """1 if the span overlaps a base span or a known secret, or is a mixed value behind a hint; 0 if it
    is neither mixed nor behind a hint; else unknown."""
    if any(a < end and start < b for spans in (*base.values(), known) for a, b in spans):
        return 1
    own = text[start:end]
    sign = "=" if "=" in own else ":"
    key, _, value = own.partition(sign)
    hint = bool(HINTS.search(text[max(0, start - 16) : start]) or (value and HINTS.search(key[-64:])))
    is_mixed = kind == "secret" and (mixed(value) if value else mixed(own))
    return int(hint) if hint == is_mixed else None


@dataclass
class Trees:
    """Boosted trees of one depth over binned features; ``nodes`` holds (feature, bin) by level."""

    edges: np.ndarray
    prior: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    slope: float = 1.0
    intercept: float = 0.0
    threshold: float = 2.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[:, j], x[:, j], "right") for j in range(x.shape[1])], axis=1)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.prior)
        rows = np.arange(len(bins))
        for feature, cut, leaves in self.trees:
            node = np.zeros(len(bins), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            total += leaves[node - (2**DEPTH - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margins(self.binned(x)) + self.intercept)


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting on the logistic loss; every split is the best of all features and bins."""
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(share / (1 - share))), [])
    bins = model.binned(x)
    margin = np.full(len(y), model.prior)
    for _ in range(ROUNDS):
        p = sigmoid(margin)
        gradient, curve = p - y, p * (1 - p)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
        node = np.zeros(len(y), np.int64)
        for at in range(2**DEPTH - 1):
            own = np.flatnonzero(node == at)
            best = 1e-6
            for j in range(x.shape[1] if len(own) > 1 else 0):
                g = np.cumsum(np.bincount(bins[own, j], gradient[own], BINS))
                h = np.cumsum(np.bincount(bins[own, j], curve[own], BINS))
                gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1)
                if gain[:-1].max() > best:
                    best, feature[at], cut[at] = gain[:-1].max(), j, int(gain[:-1].argmax())
            node[own] = 2 * at + 1 + (bins[own, feature[at]] > cut[at])
        leaf = node - (2**DEPTH - 1)
        g, h = np.bincount(leaf, gradient, 2**DEPTH), np.bincount(leaf, curve, 2**DEPTH)
        leaves = -RATE * g / (h + 1)
        model.trees.append((feature, cut, leaves))
        margin += leaves[leaf]
    return model


def _readable(batch: pa.RecordBatch) -> list[int]:
    """Rows whose text holds a character that every span needs, or the letters of a known form."""
    return _readable_texts(batch.column("text"))


def _readable_texts(texts: pa.Array) -> list[int]:
    data, offsets = buffers(texts)
    letters = pc.fill_null(pc.match_substring(texts, "akia", ignore_case=True), False).to_numpy(zero_copy_only=False)
    return np.flatnonzero((segment_sum(TRIGGER[data], offsets) > 0) | letters).tolist()


def fit(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Trees:
    """Trees from at most ``sample`` labelled candidates, chosen by hash from those of all texts; a
    fifth of them calibrates the probability and sets the threshold. A first scan counts the labelled
    candidates, so that tasks pass on little more than the sample. With too little to learn from,
    every candidate has the share of examples."""

    def labelled(text: str) -> Iterator[tuple[int, str, int, int]]:
        base, known = base_spans(text), known_secrets(text)
        for kind, start, end in candidates(text):
            if (label := example(text, kind, start, end, base, known)) is not None:
                yield label, kind, start, end

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        n = sum(1 for row in _readable(batch) for _ in labelled(texts[row].as_py()))
        return pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for row in _readable(batch):
            text = batch.column("text")[row].as_py()
            for label, kind, start, end in labelled(text):
                mark = int.from_bytes(hashlib.blake2b(f"{start}:{text[max(0, start - 24):end]}".encode(), digest_size=8).digest(), "little")
                if mark <= cut:
                    rows.append((mark - (1 << 63), label, features(text, kind, start, end)))
        if not rows:
            return None
        columns = list(zip(*rows))
        types = [pa.int64(), pa.int32(), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["mark", "label", "features"])

    source = docs.select(F.col(text_col).cast("string").alias("text"))
    total = map_arrow(source, count, "n long").agg(F.sum("n")).first()[0] or 0
    cut = int(min(1.0, (sample + 6 * sample**0.5) / max(total, 1)) * ((1 << 64) - 1))
    found = map_arrow(source, run, "mark long, label int, features array<double>")
    rows = found.orderBy("mark", "label", "features").limit(sample).toPandas()
    y = rows["label"].to_numpy(float)
    if len(y) < 50 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Trees(np.zeros((BINS - 1, FEATURES)), float(np.log(share / (1 - share))), [], threshold=PRECISION)
    x = np.stack(rows["features"].to_numpy())
    fold = np.arange(len(y)) % 5 == 0
    model = boost(x[~fold], y[~fold])
    model.slope, model.intercept = platt(model.margins(model.binned(x[fold])), y[fold], np.ones(fold.sum()))
    scores = model.probability(x[fold])
    order = np.argsort(-scores, kind="stable")
    precision = np.cumsum(y[fold][order]) / np.arange(1, fold.sum() + 1)
    good = np.flatnonzero(precision >= PRECISION)
    model.threshold = max(0.5, float(scores[order[good[-1]]])) if len(good) else 2.0
    return model


def find(text: str, model: Trees | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and known secrets and selected candidates that overlap neither these nor a better
    candidate; without a model only base spans."""
    base = base_spans(text)
    listed = [(kind, *span) for kind in KINDS[:4] for span in base[kind]]
    more: list[tuple[str, int, int]] = []
    proposed = candidates(text) if model else []
    if proposed:
        scores = model.probability(np.array([features(text, *c) for c in proposed]))
        known = set(known_secrets(text))
        sure = [(start, end) in known for _, start, end in proposed]
        taken = bytearray(len(text))
        for _, a, b in listed:
            taken[a:b] = b"\1" * (b - a)
        for i in sorted(range(len(proposed)), key=lambda i: (not sure[i], -scores[i], proposed[i][1], -proposed[i][2])):
            kind, start, end = proposed[i]
            if (sure[i] or scores[i] >= model.threshold) and taken.find(1, start, end) < 0:
                taken[start:end] = b"\1" * (end - start)
                more.append(proposed[i])
    return listed, sorted(more, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the union goes."""
    out, last = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += [text[last:start], f"[{kind}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def detect(docs: DataFrame, model: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans, redacted`` of every whole text.

    ``base`` and ``spans`` list ``kind:start:end`` in code points by kind, then start; counts are of
    base spans. A null or empty text has none, and its redacted text is itself. One scan, no shuffle.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        counts = np.zeros((4, rows), np.int64)
        base, spans, texts = [""] * rows, [""] * rows, batch.column("text")
        changed: dict[int, str] = {}
        for row in _readable(batch):
            text = texts[row].as_py()
            listed, more = find(text, model)
            if listed or more:
                for k, kind in enumerate(KINDS[:4]):
                    counts[k, row] = sum(s[0] == kind for s in listed)
                base[row], spans[row] = joined(listed), joined([*listed, *more])
                changed[row] = redacted(text, [*listed, *more])
        if changed:
            whole = texts.to_pylist()
            for row, text in changed.items():
                whole[row] = text
            texts = pa.array(whole, pa.string())
        columns = [batch.column("doc_id"), *[pa.array(c) for c in counts], pa.array(base), pa.array(spans), texts]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS[:4]], "base", "spans", "redacted"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    return map_arrow(kept, run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, redacted string")


def redact(docs: DataFrame, model: Trees | None, text_col: str = "text") -> DataFrame:
    """The same rows and columns with the found spans of ``text_col`` replaced by their kinds; a
    column ``n_chars`` gets the new lengths."""
    place = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(place)
        found = {}
        for row in _readable_texts(texts):
            text = texts[row].as_py()
            listed, more = find(text, model)
            if listed or more:
                found[row] = redacted(text, [*listed, *more])
        if not found:
            return batch
        whole = texts.to_pylist()
        for row, text in found.items():
            whole[row] = text
        return batch.set_column(place, batch.schema.field(place), pa.array(whole, texts.type))

    changed = map_arrow(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.coalesce(F.length(text_col).cast(kind), F.col("n_chars")))
    return changed
