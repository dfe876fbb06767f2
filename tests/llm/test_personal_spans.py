"""Personal data: overlapping proposals, the choice among them, base spans against the plain patterns, held-out quality."""

import random
import re

import numpy as np

from mnemospark.llm import pii


def test_proposals_overlap():
    text = "call 2019 555 123 4567 now"
    phones = {text[s:e] for k, s, e in pii.candidates(text) if k == "phone"}
    assert {"2019 555 123 4567", "555 123 4567"} <= phones
    assert pii.candidates("") == [] and pii.candidates("1 2 3 @") == []


def test_each_proposal_once_and_in_one_pass():
    text = "555 123 4567 " * 20_000
    found = pii.candidates(text)
    assert len(found) == len(set(found)) and len(found) < 20 * 20_000


class Given:
    """Trees that give each candidate the probability that stands for its length here."""

    threshold = 0.5

    def __init__(self, by_length):
        self.by_length = by_length

    def probability(self, rows):
        return np.array([self.by_length.get(int(r[1]), 0.0) for r in rows])


def test_the_better_of_overlapping_proposals_wins():
    text = "2019 555 123 4567"
    chosen = lambda odds: [text[s:e] for _, s, e in pii.all_spans(text, [], Given(odds))]
    assert chosen({17: 0.6, 12: 0.9}) == ["555 123 4567"]
    assert chosen({17: 0.9, 12: 0.6}) == ["2019 555 123 4567"]
    assert chosen({17: 0.7, 12: 0.7}) == ["2019 555 123 4567"]
    assert chosen({17: 0.4, 12: 0.4}) == []
    assert pii.all_spans(text, [("phone", 0, 17)], Given({12: 0.9})) == [("phone", 0, 17)]


def plain(text):
    """The base patterns as they are stated."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda c: (c[1], pii.KINDS.index(c[0]), c[2]))


def test_base_spans_are_those_of_the_plain_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice("0123456789055 .-+()@ab_%,\né") for _ in range(r.randrange(40)))
        assert pii.base_spans(text) == plain(text), text


def test_learned_spans_on_texts_of_other_forms():
    """Held-out texts with disguised data and decoys: most data found, most of what is added right."""
    made, r = np.random.default_rng(17), random.Random(4)
    filler = lambda: " ".join(r.choice("we met them later near a river and spoke of many things".split()) for _ in range(r.randrange(8, 30)))
    texts = [f"{filler()} {pii._LEAD[k][0]} {pii._invented(k, made)} {filler()}" for k in pii.KINDS for _ in range(80)]
    trees = pii.train(r.sample(texts, len(texts)))
    found = right = wanted = 0
    for k in ("email", "ip", "phone"):
        for _ in range(60):
            shown = {"email": f"{r.choice(['tim', 'ana'])}{r.randrange(99)} [at] site{r.randrange(99)} [dot] org", "ip": "[.]".join(str(r.randrange(256)) for _ in range(4)), "phone": f"({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}"}[k]
            head = f"{filler()} {pii._LEAD[k][1]} "
            spans = pii.all_spans(f"{head}{shown} {filler()}", [], trees)
            wanted += 1
            found += len(spans)
            right += (k, len(head), len(head) + len(shown)) in spans
    for _ in range(100):
        found += len(pii.all_spans(f"{filler()} ISBN {r.randrange(100, 999)}-{r.randrange(100, 999)}-{r.randrange(1000, 9999)} {filler()}", [], trees))
    assert right >= 0.8 * wanted and right >= 0.8 * found, (right, found, wanted)
