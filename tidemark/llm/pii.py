"""Personal data and secrets: fixed patterns, widened by a semi-Markov conditional random field.

The patterns find e-mail addresses, IP addresses, payment cards and phone numbers, and what they find
stays. Around every place with a digit, an at sign or a cue word, the random field then segments the
words into entities and other words: a segment of up to MAX_TOKENS words is scored as a whole (its
shape, length, checksum, mix of characters, the word before it), neighbouring labels are scored
together, and dynamic programming over segments picks boundaries and kinds jointly. Its segments that
no pattern span touches are added; the kind `secret` (access keys, tokens, passwords) comes from it
alone.

The field is trained on windows of at most TRAIN_DOCS documents, chosen by a hash of doc_id: patterns
give their kinds there, and assignments of long random strings to a cue word, or well-known key
formats, give `secret`. Windows of over TRAIN_CHARS characters are not learnt from (they are segmented
like all others). Weights start from, and are pulled to, the plain expectations in PRIOR, so
few or no windows still leave a usable model.

Defined cases: null and empty texts have no spans; positions count code points, end exclusive;
repeated rows each get a result; spans of different patterns may overlap, and all are reported; a
word may be of any length; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MAX_TOKENS = 5
TRAIN_DOCS = 2_000
TRAIN_WINDOWS = 300
TRAIN_CHARS = 1_000
EPOCHS = 6
#: Words that announce a secret or a number.
CUES = {
    "secret": {"token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "bearer", "auth"},
    "phone": {"phone", "tel", "telephone", "mobile", "call", "fax"},
    "email": {"email", "mail", "e-mail"},
    "card": {"card", "visa", "mastercard"},
    "ip": {"ip", "host", "address"},
}

# The runs are possessive and never start inside a run, so that each text is scanned once.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KEY_FORMAT = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,}")
CUE_WORD = re.compile(r"\b(?:" + "|".join(sorted(CUES["secret"])) + r")\b", re.IGNORECASE)
TRIGGER = re.compile(r"[0-9@]+")
TOKEN = re.compile(r"[^\s\"'=:,;<>]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append(("email", start, end))
        else:
            end = at + 1  # a later local part cannot reach over this sign
        at = text.find("@", end)
    if not any(d in text for d in "0123456789"):
        return found
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of words, as (start, end), around each place that may hold an entity.

    A window takes two words before a trigger and MAX_TOKENS after; those that meet are one.
    """
    marks = sorted({m.start() for m in TRIGGER.finditer(text)} | {m.start() for m in CUE_WORD.finditer(text)})
    if not marks:
        return
    held: list[tuple[int, int]] = []
    last = -1
    reach = 48  # characters read before a mark to find its two words
    position = 0
    for mark in marks:
        if mark < last:
            continue
        position = max(last, mark - reach, 0)
        while position > max(last, 0) and not text[position - 1].isspace():
            position -= 1  # a word is not cut
        before = [(m.start(), m.end()) for m in TOKEN.finditer(text, position, mark)]
        start = before[-3][0] if len(before) > 2 else position
        if held and start > held[-1][1] + 2:
            yield held
            held = []
        after = 0
        for m in TOKEN.finditer(text, start):
            if held and m.start() < held[-1][1]:
                continue
            held.append((m.start(), m.end()))
            if m.end() > mark:
                after += 1
                if after > MAX_TOKENS:
                    break
        last = held[-1][1] if held else mark + 1
    if held:
        yield held


FEATURES = (
    "bias", "email", "bare_at", "ip", "dotted", "luhn", "digits16", "plus", "phone_digits", "brackets", "few_digits",
    "hex", "key_format", "upper_digits", "mixed", "random", "long", "letters", "words2", "blank_only", "cue", "assigned", "quoted",
)
EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP_SHAPE = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")
NUMBER_SHAPE = re.compile(r"[0-9 ()+.\-/]+")
#: What each kind is expected to look like before training.
PRIOR = {
    "email": {"bias": -4, "email": 9, "words2": -4, "cue": 1},
    "ip": {"bias": -4, "ip": 9, "words2": -4, "cue": 1},
    "card": {"bias": -6, "luhn": 11, "digits16": 0, "cue": 1},
    "phone": {"bias": -7, "plus": 5, "phone_digits": 5, "brackets": 2, "few_digits": -5, "letters": -6, "cue": 2},
    "secret": {
        "bias": -7, "hex": 3, "key_format": 12, "upper_digits": 3, "mixed": 2, "random": 2, "cue": 3, "assigned": 2,
        "quoted": 1, "letters": -6, "words2": -6, "few_digits": -2, "email": -6, "ip": -6, "digits16": -4, "plus": -4,
    },
}


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the sentence marks around it."""
    while end > start and text[end - 1] in ".!?)]}":
        end -= 1
    while start < end and text[start] in "[{":
        start += 1
    return start, end


def span_features(text: str, start: int, end: int, tokens: int, before: str) -> list[int]:
    """Numbers of the features that a whole span has; `cue` is judged by kind."""
    s = text[start:end]
    digits = sum(c in "0123456789" for c in s)
    letters = sum(c.isalpha() for c in s)
    found = ["bias"]
    if "@" in s:
        found.append("email" if EMAIL_SHAPE.fullmatch(s) else "bare_at")
    if IP_SHAPE.fullmatch(s) and all(int(p) <= 255 for p in s.split(".")):
        found.append("ip")
    elif "." in s and digits and not letters:
        found.append("dotted")
    if digits and not letters and NUMBER_SHAPE.fullmatch(s):
        if 16 <= digits <= 19:
            found.append("digits16")
            if luhn("".join(c for c in s if c in "0123456789")):
                found.append("luhn")
        if s[0] == "+":
            found.append("plus")
        if 8 <= digits <= 15:
            found.append("phone_digits")
        if "(" in s:
            found.append("brackets")
    if digits < 4:
        found.append("few_digits")
    if tokens == 1:
        if len(s) >= 16 and all(c in "0123456789abcdefABCDEF" for c in s) and letters:
            found.append("hex")
        if KEY_FORMAT.fullmatch(s):
            found.append("key_format")
        if len(s) >= 16 and digits and letters and s.isalnum() and s.upper() == s:
            found.append("upper_digits")
        if len(s) >= 12 and digits >= 2 and letters >= 2 and "@" not in s:
            found.append("mixed")
            counts = Counter(s)
            if -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values()) > 2.7:
                found.append("random")
    else:
        found.append("words2")
        if " " in s and letters:
            found.append("blank_only")
    if len(s) >= 32:
        found.append("long")
    if not digits:
        found.append("letters")
    left = text[max(0, start - 2) : start]
    if left[-1:] in ("=", ":") or left in ("= ", ": ", '="', ':"', "='"):
        found.append("assigned")
    if left[-1:] in ("'", '"'):
        found.append("assigned" if "=" in text[max(0, start - 4) : start] else "quoted")
    return sorted({_NUMBER[f] for f in found} | ({_NUMBER["cue"]} if before else set()))


_NUMBER = {name: i for i, name in enumerate(FEATURES)}


def candidates(text: str, window: list[tuple[int, int]]) -> list[list[tuple[int, int, int, str, list[int]]]]:
    """For each word of a window, the segments that start there: (words, start, end, cue, features)."""
    out = []
    for i, (first, _) in enumerate(window):
        word = text[window[i - 1][0] : window[i - 1][1]].lower() if i else ""
        cue = next((kind for kind, words in CUES.items() if word in words), "")
        own = []
        for k in range(1, min(MAX_TOKENS, len(window) - i) + 1):
            start, end = trimmed(text, first, window[i + k - 1][1])
            if start >= end:
                continue
            if k > 1 and not NUMBER_SHAPE.fullmatch(text, start, end):
                continue  # only numbers are written in several words
            own.append((k, start, end, cue, span_features(text, start, end, k, cue)))
        out.append(own)
    return out


class Field:
    """Weights of span features by kind, and of neighbouring labels (0: other)."""

    def __init__(self) -> None:
        self.prior = np.zeros((len(KINDS), len(FEATURES)))
        for kind, weights in PRIOR.items():
            for name, weight in weights.items():
                self.prior[KINDS.index(kind), _NUMBER[name]] = weight
        self.spans = self.prior.copy()
        self.pairs = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def score(self, segment: tuple) -> list[float]:
        """Of each kind, for one segment; a cue counts only for its own kind."""
        own = self.spans[:, segment[4]].sum(axis=1)
        if segment[3]:
            for k, kind in enumerate(KINDS):
                if kind != segment[3]:
                    own[k] -= self.spans[k, _NUMBER["cue"]]
        return own.tolist()

    def arcs(self, segments: list) -> list[list[tuple[int, int, float, object]]]:
        """Arcs out of each word: (words, label, score, segment); other words go one at a time."""
        return [
            [(1, 0, 0.0, None), *((s[0], k + 1, x, s) for s in own for k, x in enumerate(self.score(s)) if x > -12)]
            for own in segments
        ]

    def best(self, segments: list) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the best segmentation."""
        n, labels = len(segments), len(KINDS) + 1
        score = [[-math.inf] * labels for _ in range(n + 1)]
        back: list[list] = [[None] * labels for _ in range(n + 1)]
        score[0][0] = 0.0
        pairs = self.pairs.tolist()
        for i, out in enumerate(self.arcs(segments)):
            for words, label, x, segment in out:
                p = max(range(labels), key=lambda q: score[i][q] + pairs[q][label])
                total = score[i][p] + pairs[p][label] + x
                if total > score[i + words][label]:
                    score[i + words][label] = total
                    back[i + words][label] = (i, p, segment)
        found, i = [], n
        label = max(range(labels), key=lambda q: score[n][q])
        while i:
            j, p, segment = back[i][label]
            if segment is not None:
                found.append((label - 1, segment[1], segment[2]))
            i, label = j, p
        return found[::-1]

    def learn(self, examples: list[tuple[list, dict[tuple[int, int], int]]], epochs: int = EPOCHS) -> None:
        """Stochastic gradient ascent on the likelihood of the labelled segmentations."""
        for epoch in range(epochs):
            rate = 0.5 / (1 + epoch)
            for segments, gold in examples:
                span_step, pair_step = self.gradient(segments, gold)
                self.spans += rate * (span_step - 0.02 * (self.spans - self.prior))
                self.pairs += rate * (pair_step - 0.02 * self.pairs)

    def gradient(self, segments: list, gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
        """Features of the labelled segmentation less those expected under the model."""
        n, labels = len(segments), len(KINDS) + 1
        arcs = self.arcs(segments)
        ahead = np.full((n + 1, labels), -np.inf)
        ahead[0, 0] = 0.0
        for i, out in enumerate(arcs):
            reach = np.logaddexp.reduce(ahead[i][:, None] + self.pairs, axis=0)
            for words, label, x, _ in out:
                ahead[i + words, label] = np.logaddexp(ahead[i + words, label], reach[label] + x)
        behind = np.full((n + 1, labels), -np.inf)
        behind[n] = 0.0
        for i in range(n - 1, -1, -1):
            for words, label, x, _ in arcs[i]:
                behind[i] = np.logaddexp(behind[i], self.pairs[:, label] + x + behind[i + words, label])
        total = np.logaddexp.reduce(ahead[n])
        span_step, pair_step = np.zeros_like(self.spans), np.zeros_like(self.pairs)
        for i, out in enumerate(arcs):
            for words, label, x, segment in out:
                by = np.exp(ahead[i] + self.pairs[:, label] + x + behind[i + words, label] - total)
                pair_step[:, label] -= by
                if segment is not None:
                    span_step[label - 1, self.own(segment, label - 1)] -= by.sum()
        i, last = 0, 0
        while i < n:
            hit = next(((s, gold[s[1], s[2]]) for s in reversed(segments[i]) if (s[1], s[2]) in gold), None)
            label = 0 if hit is None else hit[1] + 1
            pair_step[last, label] += 1
            if hit is not None:
                span_step[hit[1], self.own(hit[0], hit[1])] += 1
            i, last = i + (1 if hit is None else hit[0][0]), label
        return span_step, pair_step

    @staticmethod
    def own(segment: tuple, kind: int) -> list[int]:
        skip = _NUMBER["cue"] if segment[3] and KINDS[kind] != segment[3] else -1
        return [f for f in segment[4] if f != skip]


def labelled(text: str) -> list[tuple[list, dict[tuple[int, int], int]]]:
    """Windows of a text with the spans that the patterns, key formats and assignments mark.

    Windows with numbers run together, too long for a pattern, are left out: what they hold is unknown.
    """
    joined = [m.start() for pattern, most in ((PHONE, 15), (CARD, 19)) for m in pattern.finditer(text) if sum(map(str.isdigit, m[0])) > most]
    gold = {(a, b): KINDS.index(kind) for kind, a, b in base_spans(text)}
    for m in KEY_FORMAT.finditer(text):
        gold[m.start(), m.end()] = KINDS.index("secret")
    out = []
    for window in windows(text):
        if any(window[0][0] <= at < window[-1][1] for at in joined):
            continue
        segments = candidates(text, window)
        for own in segments:
            for s in own:
                names = {FEATURES[f] for f in s[4]}
                if s[3] == "secret" and {"assigned", "mixed", "random"} <= names:
                    gold.setdefault((s[1], s[2]), KINDS.index("secret"))
        out.append((segments, gold))
    return out


def train(docs: DataFrame, most_docs: int = TRAIN_DOCS, most_windows: int = TRAIN_WINDOWS) -> Field:
    """A field trained on windows of at most most_docs documents; no more leaves the cluster."""
    field = Field()
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    marked = docs.where(F.col("text").rlike("[0-9@]")).join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text")

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc_id, start, text[max(0, window[0][0] - 8) : window[-1][1] + 8])
                for doc_id, text in zip(batch["doc_id"], batch["text"])
                for window in windows(text)
                if window[-1][1] - window[0][0] <= TRAIN_CHARS
                for start in (window[0][0],)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "text"])

    schema = T.StructType([docs.schema["doc_id"]]).add("start", T.LongType()).add("text", T.StringType())
    rows = marked.mapInPandas(seen, schema).orderBy(F.xxhash64("doc_id"), "doc_id", "start", "text").limit(most_windows).collect()
    field.learn([example for row in rows for example in labelled(row["text"])])
    return field


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Segments of the field that touch no pattern span, by kind as listed, then start."""
    starts, ends = [], []  # of the stretches that pattern spans cover, apart and in order
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    found = []
    for window in windows(text):
        for kind, start, end in field.best(candidates(text, window)):
            i = bisect_left(starts, end)  # stretches that begin before the segment ends
            if not i or ends[i - 1] <= start:
                found.append((KINDS[kind], start, end))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


SPANS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType()))


def all_spans(text: str | None, field: Field) -> tuple[list, list]:
    """Pattern spans, and all spans by kind as listed, then start."""
    base = base_spans(text) if text else []
    more = added_spans(text, base, field) if text else []
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, base (pattern spans), spans (with those of the field): one row for each row of docs."""
    field = train(docs)
    span = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType()))

    @F.pandas_udf(T.StructType().add("base", span).add("spans", span))
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("kind", "start", "end")
        for batch in texts:
            rows = [[[dict(zip(names, s)) for s in part] for part in all_spans(t, field)] for t in batch]
            yield pd.DataFrame(rows, columns=["base", "spans"])

    return docs.select("doc_id", find("text").alias("f")).select("doc_id", "f.base", "f.spans")


def written(spans_column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in angle brackets, all columns; n_chars follows."""
    field = train(docs)

    @F.pandas_udf(T.StringType())
    def mask(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([_masked(t, field) for t in batch], dtype="object")

    out = docs.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _masked(text: str | None, field: Field) -> str | None:
    if not text:
        return text
    out, end = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in all_spans(text, field)[1]):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]
