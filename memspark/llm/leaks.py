"""Evaluation texts that appear, fully or partly, inside corpus documents, by the q-gram lemma.

Texts are reduced to their words (maximal runs of letters and digits of the lower-cased text), single blanks between.
If a stretch of an evaluation text of at least ``L`` characters occurs in a document with at most ``edits`` edits, the
two share at least L + 1 - Q * (edits + 1) character q-grams, all on diagonals (document position less evaluation
position) at most ``edits`` apart. Shared q-grams are counted in overlapping diagonal bands, each twice as wide as
the distance needed; bands that reach the bound are kept with the region their q-grams span, and each region is
verified by an alignment inside its band. Evaluation texts are worked on in blocks of at most ``BLOCK_CHARS``
characters, whose q-gram index goes to every executor and is built once in each worker; the documents are read once
for a block and are never shuffled. Documents are searched many at a time: one by one only their regions are looked at.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Q = 10
EDITS = 1
BAND = 8
RUN_WORDS = 8
#: Characters of evaluation texts that are broadcast at a time (and one text more at most).
BLOCK_CHARS = 16 << 20
#: Characters of documents that are searched at a time, which bounds a worker's memory (and one document more at most).
PORTION = 1 << 20
#: Added to diagonals to keep them positive.
_ZERO = 1 << 36
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def normalise(text: str | None) -> str:
    """The words with single blanks between and one at either end."""
    return " " + " ".join(_WORD.findall(text.lower())) + " " if text else ""


def qgrams(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(codes) - Q + 1, np.uint64)
        for i in range(Q):
            out = (out ^ codes[i : len(out) + i]) * _MIX
            out ^= out >> np.uint64(31)
    return out


class Index:
    """All q-grams of the evaluation texts with their text and place, and each text's words."""

    def __init__(self, texts: list[str], run: int = RUN_WORDS):
        self.texts = texts
        self.words = [t.split() for t in texts]
        grams = [qgrams(t) for t in texts]
        code = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        text = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.text, self.place = code[order], text[order].astype(np.int64), place[order].astype(np.int64)
        self.code_once, self.first, self.times = np.unique(self.code, return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.code >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        # shortest stretch of `run` words of each text, with the blanks around it; shorter texts cannot leak
        self.least = np.full(len(texts), 1 << 30, np.int64)
        for k, ws in enumerate(self.words):
            if len(ws) >= run:
                n = np.cumsum([0, *(len(w) + 1 for w in ws)])
                self.least[k] = int((n[run:] - n[:-run]).min()) + 1
        self.runs = [{tuple(ws[i : i + run]) for i in range(len(ws) - run + 1)} for ws in self.words]
        self.run = run

    def bound(self, edits: int) -> np.ndarray:
        """Shared q-grams that a leaked stretch has at least (1 where the lemma gives no bound)."""
        return np.maximum(1, self.least + 1 - Q * (edits + 1))


def straight(doc: str, item: str, diagonal: int, width: int) -> int:
    """Longest run of equal characters on one diagonal of the band: an alignment without edits."""
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (doc, item))
    at = np.arange(len(a)) - np.arange(diagonal - width, diagonal + width + 1)[:, None]
    differ = np.ones((len(at), len(a) + 1), bool)
    differ[:, :-1] = (at < 0) | (at >= len(b)) | (a != b[np.clip(at, 0, len(b) - 1)])
    off = np.flatnonzero(differ)
    return int(max(off[0], (off[1:] - off[:-1]).max(initial=1) - 1))


def align(doc: str, item: str, diagonal: int, width: int) -> tuple[int, int, int]:
    """Best local alignment with |document place - item place - diagonal| <= width: (matches, edits, document end)
    of the alignment that maximises matches less three times the edits."""
    size, end = 2 * width + 1, len(item)
    score, match, edit = [0] * size, [0] * size, [0] * size
    best = (0, 0, 0, 0)
    for i, c in enumerate(doc):
        new_score, new_match, new_edit = [0] * size, [0] * size, [0] * size
        start = i - diagonal + width  # item place on the lowest diagonal of the band
        for k in range(min(size - 1, start), max(-1, start - end), -1):
            if item[start - k] == c:
                s, m, e = score[k] + 1, match[k] + 1, edit[k]
            else:
                s, m, e = score[k] - 3, match[k], edit[k] + 1
            if k and score[k - 1] - 3 > s:  # a document character left out
                s, m, e = score[k - 1] - 3, match[k - 1], edit[k - 1] + 1
            if k < size - 1 and new_score[k + 1] - 3 > s:  # an item character left out
                s, m, e = new_score[k + 1] - 3, new_match[k + 1], new_edit[k + 1] + 1
            if s > 0:
                new_score[k], new_match[k], new_edit[k] = s, m, e
                if s > best[0]:
                    best = (s, m, e, i + 1)
        score, match, edit = new_score, new_match, new_edit
    return best[1:]


def _dense(at: np.ndarray, index: Index, edits: int) -> np.ndarray:
    """Which of the ascending places of q-grams that stand in any text lie in a window as dense as the lemma asks for.

    A leaked stretch holds one of the shortest length that can leak, with at most ``edits`` edits; by the lemma that
    one's q-grams, at most as many as fit in the window, have the bound's number in common with the text."""
    least = int(index.least.min(initial=1 << 30))
    need, width = max(1, least + 1 - Q * (edits + 1)), least + edits - Q + 1
    if need < 2 or len(at) < need:
        return np.full(len(at), need < 2)
    # places k .. k + need - 1 within one window
    first = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < width)
    mark = np.zeros(len(at) + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, first + need, -1)
    return np.cumsum(mark[:-1]) > 0


def regions(docs: list[str], index: Index, edits: int = EDITS) -> dict[int, list[tuple[int, int, int, int]]]:
    """By number of the normalised document, (text, start, end, diagonal) of its bands that reach the lemma's bound."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    g = qgrams("".join(docs))
    if not len(g) or not len(index.code):
        return out
    end = np.cumsum([len(d) for d in docs])
    at = np.flatnonzero(index.maybe[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    doc = np.searchsorted(end, at, "right")
    inside = at + Q <= end[doc]
    at, doc = at[inside], doc[inside]
    known = np.searchsorted(index.code_once, g[at])
    held = index.code_once[np.minimum(known, len(index.code_once) - 1)] == g[at]
    at, doc, known = at[held], doc[held], known[held]
    near = _dense(at, index, edits)
    at, doc, known = at[near], doc[near], known[near]
    if not len(at):
        return out
    lo, n = index.first[known], index.times[known]
    hits = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    size, need = len(index.texts), index.bound(edits)
    # a text with too few shared q-grams in all has no band with enough
    pair = np.repeat(doc, n) * size + index.text[hits]
    if len(docs) * size <= 1 << 24:
        some = (np.bincount(pair, minlength=len(docs) * size) >= np.tile(need, len(docs)))[pair]
    else:
        each, inv, count = np.unique(pair, return_inverse=True, return_counts=True)
        some = (count >= need[each % size])[inv]
    pair, hits, where = pair[some], hits[some], np.repeat(at, n)[some]
    if not len(pair):
        return out
    start = end[pair // size] - np.array([len(d) for d in docs])[pair // size]
    where = where - start
    diag = where - index.place[hits] + _ZERO
    each, pair = np.unique(pair, return_inverse=True)
    bands: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for shift in (0, BAND // 2):
        key = (pair << 38) | ((diag + shift) // BAND)
        order = np.argsort(key, kind="stable")
        key, places = key[order], where[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        least = need[each[key[first] >> 38] % size]
        for f, m, most in zip(*(x[count >= least].tolist() for x in (first, count, least))):
            mine = places[f : f + m]  # ascending, as the sort is stable and the hits come in document order
            band = (int(key[f]) & ((1 << 38) - 1)) * BAND - shift + BAND // 2 - _ZERO
            d, t = divmod(int(each[key[f] >> 38]), size)
            # one band may hold several stretches far apart
            cuts = np.flatnonzero(mine[1:] - mine[:-1] > 2 * Q + edits + 40).tolist()
            for a, b in zip([0, *(c + 1 for c in cuts)], [*(c + 1 for c in cuts), m]):
                if b - a >= most:
                    bands.setdefault((d, t, band), []).append((int(mine[a]), int(mine[b - 1]) + Q))
    for (d, t, band), spans in bands.items():
        out.setdefault(d, []).extend((t, a, b, band) for a, b in spans)
    return out


_held: dict[str, Index] = {}


def _index(token: str, texts: list[str], run: int) -> Index:
    """The index of a block, built once in a worker; only the last one is kept."""
    if token not in _held:
        _held.clear()
        _held[token] = Index(texts, run)
    return _held[token]


def _blocks(items: DataFrame) -> Iterator[dict[str, set[tuple[int, str]]]]:
    """Normalised evaluation texts with the (item, part) that have them, in blocks of bounded size."""
    block: dict[str, set[tuple[int, str]]] = {}
    size = 0
    for r in items.select("item_id", "passage", "question").toLocalIterator():
        for part in ("passage", "question"):
            text = normalise(r[part])
            if text.strip():
                size += len(text) + 64
                block.setdefault(text, set()).add((r["item_id"], part))
        if size > BLOCK_CHARS:
            yield block
            block, size = {}, 0
    if block:
        yield block


def leaked(docs: list[str], index: Index, edits: int = EDITS, verify: bool = True) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By number of the document, (text, start, end, longest shared run of words, edits) for each evaluation text with a region in it."""
    out, need = {}, index.bound(edits)
    for k, found in regions(docs, index, edits).items():
        best: dict[int, tuple[int, int, int, int]] = {}
        doc = docs[k]
        for t, a, b, d in found:
            a0, b0 = max(0, doc.rfind(" ", 0, a)), doc.find(" ", max(b - 1, 0))
            b0 = len(doc) if b0 < 0 else b0 + 1
            part = doc[a0:b0]
            run, e = _longest(part.split(), index, t), 0
            if verify and t in best and best[t][2] >= run:
                continue
            # an alignment without edits that bears the region out needs no other one
            if verify and straight(part, index.texts[t], d - a0, BAND) < need[t]:
                m, e, _ = align(part, index.texts[t], d - a0, BAND)
                if m < need[t]:
                    continue  # the alignment in the band does not bear the region out
            if t not in best or run > best[t][2]:
                best[t] = (a0, b0, run, e)
        if best:
            out[k] = [(t, *x) for t, x in sorted(best.items())]
    return out


def _longest(ws: list[str], index: Index, t: int) -> int:
    """Words of the longest run shared with text ``t`` if it is at least the index's run, else 0."""
    runs, n, most, i = index.runs[t], index.run, 0, 0
    while i + n <= len(ws):
        if tuple(ws[i : i + n]) in runs:
            j = i
            while j + n <= len(ws) and tuple(ws[j : j + n]) in runs:
                j += 1
            most = max(most, j - i + n - 1)
            i = j
        i += 1
    return most


def find(documents: DataFrame, items: DataFrame, edits: int = EDITS, run: int = RUN_WORDS) -> DataFrame:
    """Documents that contain wording of evaluation items: doc_id, item_id, part (passage or question), run_words
    (longest shared run of words; 0 if below ``run``: a region that is only nearly the same), edits, start, end
    (in the normalised text).

    documents: doc_id, text; items: item_id, passage, question (other columns are ignored). Nulls and texts of fewer than
    ``run`` words cannot leak; items with the same text are each reported; repeated documents give repeated rows; long
    texts are read whole. Evaluation texts of any number are taken, in blocks; each block is one more reading of the documents."""
    parts = [_find(documents, block, edits, run) for block in _blocks(items)]
    return reduce(DataFrame.unionByName, parts) if parts else _find(documents, {}, edits, run)


def _find(documents: DataFrame, owners: dict[str, set[tuple[int, str]]], edits: int, run: int) -> DataFrame:
    texts = sorted(owners)
    held = documents.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, texts, [sorted(owners[t]) for t in texts]))
    names = ["doc_id", "item_id", "part", "run_words", "edits", "start", "end"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, texts, owner = held.value
        index = _index(token, texts, run)
        for batch in batches:
            out = []
            key, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(key):
                docs, first = [], at
                size = 0
                while at < len(key) and size < PORTION:
                    docs.append(normalise(text[at]))
                    size += len(docs[-1])
                    at += 1
                for k, found in leaked(docs, index, edits).items():
                    for t, a, b, words, e in found:
                        out += [(key[first + k], item, part, words, e, a, b) for item, part in owner[t]]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    return documents.select("doc_id", "text").mapInArrow(search, "doc_id bigint, item_id bigint, part string, run_words int, edits int, start int, end int")
