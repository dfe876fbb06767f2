"""Personal data by candidate gradient boosting.

Base spans follow fixed patterns. Beyond them, high-recall generators propose overlapping spans (addresses written out,
telephone numbers without a plus sign, oddly separated cards and addresses); boosted trees score each candidate by the
features of its format and context, and a threshold calibrated on rows that were not trained on selects what to add.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

KINDS = ("email", "ip", "card", "phone")
#: Different texts that the trees are trained on, at most: whole ones, a fifth of them for each kind that has base spans
#: there and a fifth without any, each with the smallest hashes.
SAMPLE = 1500
#: The share of selected candidates that have to be right on the calibration rows.
PRECISION = 0.98
#: Times that each base span of the sample is disguised for training.
DISGUISES = 6
SEED = 3

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind changes no match: inside a run of digits a match fails where it fails at the run's start.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and domain, found from the @ signs so that the time is linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        # A failed match leaves the text before the sign to no other one.
        done = max(done, at + 1) if not match else done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns, by start, then kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


_AT = r" ?(?:\(at\)|\[at\]|\{at\}| at |@) ?"
_DOT = r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.)"
#: High-recall generators by kind. Runs are bounded, so a long text costs time in proportion to its length.
GENERATORS = (
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.I), re.compile(r"@|\(at\)|\[at\]|\{at\}| at ", re.I)),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}(?![0-9.]*[0-9])"), re.compile(r"[0-9] ?[\[(.]")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,3}[0-9]{4,6}){2}(?:[ ./_-]{1,3}[0-9]{1,7})?(?![0-9])"), re.compile(r"[0-9]{4}[ ./_-]")),
    ("phone", re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{1,4})?(?![0-9])"), re.compile(r"[0-9][ ./)-]")),
)


_GROUP = re.compile(r"[0-9A-Za-z]+")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose. Each goes on after the first group of what it found, so spans of one kind overlap too."""
    out = []
    for kind, pattern, hint in GENERATORS:
        found = pattern.search(text) if hint.search(text) else None
        while found:
            out.append((kind, found.start(), found.end()))
            group = _GROUP.search(text, found.start(), found.end())
            found = pattern.search(text, group.end() if group else found.end())
    return out


_CONTEXT = re.compile(r"\b(?:mail|e-mail|email|contact|phone|tel|call|mobile|fax|ip|address|host|server|card|visa|credit|pay|version|isbn|id|no|nr|number)\b", re.I)


#: Context words that number things rather than name a person's data.
_NUMBERING = frozenset(("version", "isbn", "id", "no", "nr", "number"))
#: Words that lead personal data in training.
_LEAD = {"email": ("email", "mail", "contact"), "ip": ("ip", "address", "host"), "card": ("card", "visa", "pay"), "phone": ("tel", "call", "phone")}


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span, before, after = text[start:end], text[max(0, start - 30) : start], text[end : end + 10]
    digits = _digits(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    parts = [int(g) for g in re.findall(r"[0-9]{1,6}", span)[:6]]
    words = [w.lower() for w in _CONTEXT.findall(before)]
    low = span.lower()
    tail = re.findall(r"[a-z0-9-]+", low)[-1:] or [""]
    return [
        float(KINDS.index(kind)), len(span), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1],
        float(luhn(digits)) if digits else 0.0, float(bool(parts) and max(parts) <= 255), span.count("@"),
        float(any(m in low for m in ("(at)", "[at]", "{at}"))), float(any(m in low for m in ("(dot)", "[dot]", "{dot}"))),
        span.count("."), span.count(" "), span.count("-"), span.count("("), float(low.startswith("00")),
        float(len(tail[0])), float(tail[0] in ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")),
        float(any(w not in _NUMBERING for w in words)), float(any(w in _NUMBERING for w in words)), float(before[-1:].isspace() or not before),
        float(after[:1].isspace() or not after), float(before[-1:].isdigit() or before[-1:] in "=_/#" and bool(before)),
        float(span[:1] == "(" and span[4:5] == ")"), float(groups[-3:] == [3, 3, 4]), span.count("[.]") + span.count("(.)"),
        float(groups == [4, 4, 4, 4]), float(sum(c.isalpha() for c in span)), float(sum(c.isdigit() for c in before[-12:])),
    ]


@dataclass
class Trees:
    """Boosted trees of depth 3 on binned features: per tree, 7 (feature, cut) and 8 values."""

    edges: list[np.ndarray]
    splits: np.ndarray
    values: np.ndarray
    prior: float
    threshold: float = 0.5

    def probability(self, rows: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, rows[:, f], "right") for f, e in enumerate(self.edges)], axis=1)
        score = np.full(len(rows), self.prior)
        every = np.arange(len(rows))
        for split, value in zip(self.splits, self.values):
            node = np.zeros(len(rows), np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (bins[every, split[node, 0]] > split[node, 1])
            score += value[node - 7]
        return 1 / (1 + np.exp(-score))


def _cuts(column: np.ndarray) -> np.ndarray:
    """Up to 16 cuts between the different values of a feature, so that rare values keep a bin."""
    values = np.unique(column)
    middle = (values[1:] + values[:-1]) / 2
    return middle if len(middle) <= 16 else np.unique(np.quantile(middle, np.linspace(0, 1, 16), method="nearest"))


def boost(rows: np.ndarray, labels: np.ndarray, rounds: int = 60, rate: float = 0.3, reg: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss with exact greedy splits over at most 16 bins a feature."""
    edges = [_cuts(rows[:, f]) for f in range(rows.shape[1])]
    bins = np.stack([np.searchsorted(e, rows[:, f], "right") for f, e in enumerate(edges)], axis=1)
    rate0 = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    prior = float(np.log(rate0 / (1 - rate0)))
    score, splits, values = np.full(len(rows), prior), [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = labels - p, p * (1 - p) + 1e-6
        split = np.zeros((7, 2), np.int64)
        node = np.zeros(len(rows), np.int64)
        for n in range(7):
            mine = node == n
            best = (0.0, 0, 99)
            if mine.any():
                g, h = grad[mine], hess[mine]
                base = g.sum() ** 2 / (h.sum() + reg)
                for f in range(rows.shape[1]):
                    sums_g = np.bincount(bins[mine, f], g, 18).cumsum()
                    sums_h = np.bincount(bins[mine, f], h, 18).cumsum()
                    gain = sums_g**2 / (sums_h + reg) + (g.sum() - sums_g) ** 2 / (h.sum() - sums_h + reg) - base
                    cut = int(gain.argmax())
                    if gain[cut] > best[0] + 1e-9:
                        best = (float(gain[cut]), f, cut)
            split[n] = best[1:]
            node = np.where(mine, 2 * n + 1 + (bins[:, best[1]] > best[2]), node)
        leaf = node - 7
        value = rate * np.bincount(leaf, grad, 8) / (np.bincount(leaf, hess, 8) + reg)
        splits.append(split)
        values.append(value)
        score = score + value[leaf]
    return Trees(edges, np.array(splits), np.array(values), prior)


def _invented(kind: str, random: np.random.Generator) -> str:
    """Another span of the kind, so that the trees do not learn the habits of one corpus' data."""
    digits = lambda k: "".join(map(str, random.integers(0, 10, k)))
    word = lambda: "".join(chr(97 + c) for c in random.integers(0, 26, int(random.integers(2, 10))))
    if kind == "email":
        name = (word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}{digits(2)}")[int(random.integers(4))]
        host = (word(), f"{word()}.{word()}", f"{word()}-{word()}")[int(random.integers(3))]
        return f"{name}@{host}.{('com', 'org', 'net', 'edu', 'io', 'de', 'fr', 'es', 'co')[int(random.integers(9))]}"
    if kind == "ip":
        return ".".join(map(str, random.integers(0, 256, 4)))
    if kind == "card":
        head = digits(15)
        return next(head + c for c in "0123456789" if luhn(head + c))
    return "+" + digits(int(random.integers(11, 14)))


def _disguise(kind: str, span: str, random: np.random.Generator) -> str:
    """A true span as people write it where the base patterns do not reach."""
    pick = lambda *x: x[int(random.integers(len(x)))]
    span = pick(span, _invented(kind, random))
    if kind == "email":
        name, _, host = span.partition("@")
        at, dot = pick(("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), (" @ ", "."))
        return f"{name}{at}{host.replace('.', dot)}"
    if kind == "ip":
        return span.replace(".", pick("[.]", " . ", "(.)"))
    digits = _digits(span)
    if kind == "card":
        return pick(".", "/", " - ", "_", "  ").join(digits[i : i + 4] for i in range(0, 16, 4)) if len(digits) == 16 else span
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"001 {a} {b} {c}", f"00{digits[:-10] or 1} {a} {b}-{c}")


def _decoy(random: np.random.Generator) -> str:
    """Numbers and words that a generator may propose and that are nobody's data."""
    n = lambda a, b: int(random.integers(a, b))
    d = lambda k: "".join(map(str, random.integers(0, 10, k)))
    word = lambda: "".join(chr(97 + c) for c in random.integers(0, 26, n(3, 9)))
    return (
        f"version {n(1, 20)}.{n(0, 30)}.{n(0, 999)}.{n(256, 999)}", f"ISBN {d(3)}-{d(3)}-{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(3)}1",
        f"{word()} at {word()}. {word().title()} {word()}", f"{word()} at {word()}.{word()}", f"{n(1900, 2100)}-{d(4)}-{d(4)}",
        f"id {d(2)}-{d(4)}-{d(4)}", f"{d(3)}.{d(3)}.{n(300, 999)}.{d(3)}", f"{n(256, 999)} . {n(256, 999)} . {d(2)} . {d(2)}",
        f"no {d(3)} {d(3)} {d(3)}", f"{d(4)}.{d(4)}.{d(4)}.{d(4)}",
    )[n(0, 11)]


def train(texts: list[str], precision: float = PRECISION) -> Trees | None:
    """Trees from a bounded list of texts; None if they hold no personal data to learn from.

    Right answers are base spans, as they are and disguised in place; wrong ones are what the generators propose elsewhere
    in the texts or for decoys put there. A third of the texts only calibrates: the threshold is the lowest at which the
    asked share of selected candidates is right.
    """
    random = np.random.default_rng(SEED)
    rows, labels, hold = [], [], []
    for i, text in enumerate(texts):
        spans = base_spans(text)
        versions = [(text, {(k, s, e) for k, s, e in spans})]
        for kind, s, e in [x for x in spans[:20] for _ in range(DISGUISES)]:
            shown = _disguise(kind, text[s:e], random)
            lead = ("", f"{_LEAD[kind][int(random.integers(3))]} ")[int(random.integers(2))]
            around = (text[max(0, s - 200) : s] + lead, text[e : e + 200])
            versions.append((around[0] + shown + around[1], {(kind, len(around[0]), len(around[0]) + len(shown))}))
        at = int(random.integers(len(text) + 1))
        for _ in range(2):
            versions.append((f"{text[max(0, at - 200) : at]} {_decoy(random)} {text[at : at + 200]}", set(base_spans(text[max(0, at - 200) : at + 200]))))
        for shown, right in versions:
            for c in candidates(shown):
                near = any(c[0] == k and min(c[2], e) - max(c[1], s) >= 0.8 * (max(c[2], e) - min(c[1], s)) for k, s, e in right)
                rows.append(features(shown, *c))
                labels.append(near)
                hold.append(i % 3 == 0)
    x, y, test = np.array(rows, np.float64), np.array(labels, np.float64), np.array(hold, bool)
    if not len(y) or not y[~test].any() or y[~test].all() or not y[test].any():
        return None
    trees = boost(x[~test], y[~test])
    p = trees.probability(x[test])
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[test][order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= precision)
    trees.threshold = max(0.5, float(p[order][good[-1]])) if len(good) else 1.1
    return trees


def all_spans(text: str, base: list[tuple[str, int, int]], trees: Trees | None) -> list[tuple[str, int, int]]:
    """Base spans and the selected candidates that overlap no base span, nor a better candidate.

    The more probable candidate is better, of equal ones the longer, then the earlier.
    """
    proposed = candidates(text) if trees else []
    if not proposed:
        return base
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    proposed = [c for c in proposed if not len(starts) or (i := int(np.searchsorted(starts, c[2]))) == 0 or ends[i - 1] <= c[1]]
    if not proposed:
        return base
    p = trees.probability(np.array([features(text, *c) for c in proposed], np.float64))
    likely = [(-p[i], proposed[i][1] - proposed[i][2], proposed[i][1], proposed[i]) for i in np.flatnonzero(p >= trees.threshold)]
    chosen: list[tuple[int, int, str]] = []
    for _, _, start, (kind, _, end) in sorted(likely):
        at = bisect.bisect_left(chosen, (start,))
        if (at == 0 or chosen[at - 1][1] <= start) and (at == len(chosen) or chosen[at][0] >= end):
            chosen.insert(at, (start, end, kind))
    return sorted([*base, *((k, s, e) for s, e, k in chosen)], key=lambda c: (c[1], KINDS.index(c[0]), c[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _finder(trees: Trees | None):
    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            rows = []
            for text in part:
                base = base_spans(text or "")
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*counts, digest, joined(all_spans(text or "", base, trees))))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def _kinds(text: str) -> int:
    """Which kinds have base spans in the text, a bit each."""
    return sum(1 << KINDS.index(k) for k in {k for k, _, _ in base_spans(text)})


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"h": batch["h"], "kinds": [_kinds(t) for t in batch["text"]]})


def learn(docs: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees from at most ``sample`` different texts with a digit or @; only those reach the driver.

    All rows are searched for base spans first, so that every kind has its share of the sample however rare it is, and
    copies of a text count once. A warning says which kinds the corpus has no examples of, and if nothing was learned.
    """
    telling = docs.filter(F.col("text").rlike(r"[0-9@]")).select(F.xxhash64("text").alias("h"), "text")
    marked = settled(telling.mapInPandas(_marked, "h long, kinds int").groupBy("h").agg(F.max("kinds").alias("kinds")))
    classes = [F.col("kinds").bitwiseAND(1 << k) != 0 for k in range(len(KINDS))] + [F.col("kinds") == 0]
    parts = [marked.filter(c).orderBy("h").limit(max(3, sample // len(classes))).select("h") for c in classes]
    picked = parts[0]
    for part in parts[1:]:
        picked = picked.unionByName(part)
    rows = telling.join(F.broadcast(picked.distinct()), "h", "left_semi").distinct().collect()
    # Texts with the same kinds follow each other, so each third has some.
    found = sorted((_kinds(r["text"]), r["h"], r["text"]) for r in rows)
    trees = train([t for _, _, t in found])
    missing = [kind for k, kind in enumerate(KINDS) if not any(x[0] >> k & 1 for x in found)]
    if trees is None or trees.threshold > 1:
        warnings.warn(f"personal data: nothing learned from {len(found)} texts, only base spans are given", RuntimeWarning, stacklevel=2)
    elif missing:
        warnings.warn(f"personal data: no examples of {', '.join(missing)} to learn from", RuntimeWarning, stacklevel=2)
    return trees


def with_personal_data(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card and n_phone (base spans), base_sha256 and ``spans`` (base and selected ones).

    Spans are kind:start:end in code points, end exclusive. A NULL or empty text has none. Every row is judged by its whole
    text alone, so repeated rows agree and ids may be NULL. Columns of ``docs`` with the new names are replaced.
    """
    new = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rest = docs.drop(*new)
    found = rest.select(F.struct(*rest.columns).alias("row"), _finder(trees or learn(docs))(F.col("text")).alias("found"))
    return found.select("row.*", "found.*")
