"""A linear recogniser of names of people by their context, for names that no list holds.

Candidates are two or three words in a row that begin with a capital letter (an initial may stand between). The model
sees what stands around a candidate and how it is built (endings, lengths, marks), but neither which names it holds;
it is trained on the candidates of a bounded sample of texts, of which those that the rules of ``pii`` take for names
are examples of names and all others are not. The threshold is the lowest that reaches ``PRECISION`` on held-out texts.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

HASH_BITS = 16
PRECISION = 0.995
SEED = 5
_NAME = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
CANDIDATE = re.compile(rf"(?<![\w'’@./-])({_NAME}) (?:([A-Z])\.? )?({_NAME})(?: ({_NAME}))?(?![\w@-])")
_WORD = re.compile(r"[^\W\d_]+|\d+")


def candidates(text: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, words) of capitalised sequences of two words, and of three where a third one follows."""
    out, at = [], 0
    while m := CANDIDATE.search(text, at):
        words = tuple(w for w in m.groups() if w)
        if all(len(w) > 1 for w in (m[1], m[3])):
            out.append((m.start(), m.end(), words))
            at = m.end()
        else:
            at = m.end(1)
    return out


def features(text: str, start: int, end: int, words: tuple[str, ...]) -> np.ndarray:
    before = _WORD.findall(text[max(0, start - 40) : start].lower())[-2:]
    after = _WORD.findall(text[end : end + 40].lower())[:2]
    near, then = text[start - 2 : start].strip() if start else "^", text[end : end + 1].strip()
    b1, b2 = before[-1] if before else "^", before[0] if len(before) > 1 else "^"
    a1, a2 = after[0] if after else "$", after[1] if len(after) > 1 else "$"
    begins = not start or near[-1:] in (".", "!", "?", "\n", ":", "")  and not before
    keys = [f"b{b1}", f"bb{b2} {b1}", f"a{a1}", f"aa{a1} {a2}", f"c{b1}|{a1}", f"m{near[-1:]}", f"t{then}", f"n{len(words)}", f"s{begins}", f"sb{begins}{b1}"]
    for place, w in (("f", words[0]), ("l", words[-1])):
        low = w.lower()
        keys += [f"{place}{low[-2:]}", f"{place}{low[-3:]}", f"{place}n{min(len(w), 12)}", f"{place}u{w.isupper()}", f"{place}-{'-' in w}"]
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(k) >> (64 - HASH_BITS) for k in keys), np.int64, len(keys)))


class Recogniser:
    """Logistic regression over hashed features, trained by AdaGrad; says no to everything until it is trained."""

    def __init__(self) -> None:
        self.w, self.threshold = np.zeros(1 << HASH_BITS, np.float32), np.inf

    def fit(self, x: list[np.ndarray], y: list[bool], epochs: int = 5) -> None:
        rng = np.random.default_rng(SEED)
        hold = rng.random(len(x)) < 0.3
        acc, train = np.full(1 << HASH_BITS, 1e-2, np.float32), np.flatnonzero(~hold)
        for _ in range(epochs):
            for i in rng.permutation(train):
                err = 1 / (1 + np.exp(-np.clip(self.w[x[i]].sum(), -30, 30))) - y[i]
                acc[x[i]] += err * err
                self.w[x[i]] -= 0.3 * err / np.sqrt(acc[x[i]])
        held = np.flatnonzero(hold)
        score = np.array([self.w[x[i]].sum() for i in held])
        hit = np.array([y[i] for i in held], bool)
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(hit[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero((right >= PRECISION) & (np.arange(1, len(order) + 1) >= 50))
        if len(good):
            self.threshold = float(score[order[good[-1]]])
            self.recall = float(hit[order[: good[-1] + 1]].sum() / max(1, hit.sum()))

    def likely(self, text: str, start: int, end: int, words: tuple[str, ...]) -> bool:
        return self.threshold < np.inf and bool(self.w[features(text, start, end, words)].sum() >= self.threshold)
