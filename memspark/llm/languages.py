"""Languages of documents and of their one-language stretches, by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1 in ``DIM`` dimensions. An n-gram's vector is the elementwise
product of its letters' vectors, each rotated by its place; a text's profile is the sum of its n-grams' vectors,
and a language's prototype the normalised sum of profiles of texts labelled with it. A text's language is the
prototype of the largest cosine.

The product with a prototype is linear in the profile, so the inner products of all n-grams over the alphabet with
all prototypes are computed once (a table of fixed size) and a profile's products are sums of table rows; its
length follows from its n-gram counts, as different n-grams' vectors are nearly orthogonal.

Prototypes are trained on a sample of at most ``SAMPLE`` labelled documents, twice: documents that the first
prototypes give another language are left out of the second, as labels may be wrong.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.samples import bounded

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "sv")
DIM = 2048
#: Letters of profiles; others count as a blank. Upper case and spacing do not count.
ALPHABET = " abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ'"
SAMPLE = 4000
SEED = 20240601
#: Two- and three-letter codes and English names.
CODES = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish castilian",
    "pt": "pt por portuguese", "it": "it ita italian", "nl": "nl nld dut dutch flemish", "sv": "sv swe swedish",
}
_CODE = {w: k for k, ws in CODES.items() for w in ws.split()}
UNKNOWN = {"", "unknown", "und", "unk", "n/a", "na", "none", "null", "mul", "zxx", "mis", "xx", "?", "-", "other", "undefined", "undetermined"}
_AT = {c: i for i, c in enumerate(ALPHABET)}
_N = len(ALPHABET)


def label(lang: str | None) -> str | None:
    """The language a label names; None if it is missing or a stand-in; the label itself if it names another one."""
    if lang is None:
        return None
    low = lang.strip().lower()
    if low in UNKNOWN:
        return None
    return _CODE.get(re.split(r"[-_ ]", low)[0], low)


# ---------------------------------------------------------------- profiles
_LOOK = np.zeros(0x250, np.int64)
for _c, _i in _AT.items():
    _LOOK[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x250:
        _LOOK[ord(_c.upper())] = _i


def letters(text: str) -> np.ndarray:
    """Alphabet positions, blanks squeezed, one blank at either end. Accents are composed first."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("’", "'")
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.where(codes < 0x250, _LOOK[np.minimum(codes, 0x24F)], 0)
    at = np.concatenate([[0], at, [0]])
    keep = np.ones(len(at), bool)
    keep[1:] = (at[1:] != 0) | (at[:-1] != 0)
    return at[keep]


def ngrams(at: np.ndarray) -> np.ndarray:
    """Codes of the three-letter n-grams, blanks inside the text included."""
    if len(at) < 3:
        return np.empty(0, np.int64)
    return (at[:-2] * _N + at[1:-1]) * _N + at[2:]


def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (_N, DIM)).astype(np.int8) * 2 - 1


def ngram_vectors(codes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Bound vectors: product of the letters' vectors, rotated by two, one and no places."""
    return np.roll(base, 2, 1)[codes // (_N * _N)] * np.roll(base, 1, 1)[codes // _N % _N] * base[codes % _N]


def train(texts: list[str], langs: list[str]) -> tuple[np.ndarray, tuple[str, ...]]:
    """Table (n-grams x languages) of inner products with unit prototypes, over the length of an n-gram's vector."""
    base = letter_vectors()
    grams = [ngrams(letters(t)) for t in texts]
    own = [langs.count(k) for k in LANGUAGES]
    names = tuple(k for k, n in zip(LANGUAGES, own) if n)
    keep = np.ones(len(texts), bool)
    table = np.zeros((_N**3, max(1, len(names))), np.float32)
    if not names:
        return table, names
    for _ in range(2):
        proto = np.zeros((len(names), DIM))
        for i, k in enumerate(names):
            mine = [g for g, lang, ok in zip(grams, langs, keep) if lang == k and ok]
            if mine:
                code, n = np.unique(np.concatenate(mine), return_counts=True)
                # dampened counts: frequent n-grams of frequent phrases do not rule the profile
                proto[i] = np.sqrt(n) @ ngram_vectors(code, base)
        # what all languages share tells none of them apart
        proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)
        proto -= proto.mean(0) * 0.5
        proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)
        for a in range(0, _N**3, 8192):
            code = np.arange(a, min(a + 8192, _N**3))
            table[code] = ngram_vectors(code, base).astype(np.float32) @ proto.T.astype(np.float32) / np.sqrt(DIM)
        if len(names) < 2:
            break
        for i, (g, lang) in enumerate(zip(grams, langs)):
            keep[i] = len(g) == 0 or names[int(np.argmax(table[g].sum(0)))] == lang
    return table, names


# ---------------------------------------------------------------- sentences and segments
_MARK = re.compile(r"\s*(?:(?:[-*•>#]+|\d{1,3}[.)]|(?:[A-Z]|User|Assistant|Speaker ?\d*|[A-Z][a-z]{1,11}):)\s+)+")
_END = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+(?=[\"'“«(\[¿¡]*[^\W\d_])|\s*[\r\n]+\s*")
_QUOTED = re.compile(r"\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|«[^»\n]{1,200}»|„[^“”\n]{1,200}[“”]|(?<!\w)'[^'\n]{3,120}'(?!\w)")
_QUOTE = re.compile("[\"“«„']")
_ABBREV = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Mx|Dr|Prof|St|Ave|No|Nr|bzw|z\.B|etc|e\.g|i\.e|Sr|Sra|Inc|Ltd|Co|Corp|[A-Z])\.)$")
_LETTER = re.compile(r"[^\W\d_]")
_TWELVE, _TWENTY = (re.compile(rf"(?:[^\W\d_][\W\d_]*){{{n}}}") for n in (12, 20))
_NAME = re.compile(r"(?<=[\w,;] )(?:[A-ZÀ-Ý][\w'’-]+)(?: [A-ZÀ-Ý][\w'’-]+)*")
_LARGE = re.compile(" [A-ZÀ-Ý]")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences; a line end also ends one. A list or speaker mark alone is no sentence."""
    out, start = [], 0
    for m in _END.finditer(text):
        gap = m.group()
        if "\n" not in gap and "\r" not in gap and _ABBREV.search(text[max(start, m.start() - 8) : m.start()]):
            continue
        if m.end() > start:
            out.append((start, m.end()))
            start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return [(a, b) for a, b in out if _LETTER.search(text, a, b)]


def bare(sentence: str) -> str:
    """Without marks at its start, words quoted inside it, and, unless the language writes nouns large, names."""
    mark = _MARK.match(sentence)
    out = sentence[mark.end() :] if mark else sentence
    if _QUOTE.search(out):
        cut = _QUOTED.sub(" ", out)
        if _TWELVE.search(cut):
            out = cut
    if _LARGE.search(out) and not out.isupper():
        named = _NAME.findall(out)
        # a language that writes nouns large has many of them; names are few
        if named and len(named) <= 2:
            cut = _NAME.sub(" ", out)
            if _TWENTY.search(cut):
                out = cut
    return out


def piece_sums(pieces: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the table's rows over each piece's n-grams, their numbers, and the n-grams with their pieces.

    All pieces are worked on at once: a mark between two of them counts as the blank at their ends, and n-grams
    across it are left out."""
    n = len(pieces)
    joined = "\0".join(["", *(p.replace("\0", " ") for p in pieces), ""])
    if not joined.isascii():
        joined = unicodedata.normalize("NFC", joined).replace("’", "'")
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    at = np.where(codes < 0x250, _LOOK[np.minimum(codes, 0x24F)], 0)
    own = np.cumsum(codes == 0) - 1
    keep = np.ones(len(at), bool)
    keep[1:] = (at[1:] != 0) | (at[:-1] != 0)
    at, own = at[keep], own[keep]
    if len(at) < 3:
        return np.zeros((n, table.shape[1])), np.zeros(n, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = (at[1:-1] != 0) | (own[:-2] == own[2:])
    inside &= (at[:-2] != 0) | (at[1:-1] != 0)
    g = ((at[:-2] * _N + at[1:-1]) * _N + at[2:])[inside]
    piece = np.where(at[1:-1] != 0, own[1:-1], own[:-2])[inside]
    count = np.bincount(piece, minlength=n)
    some = np.flatnonzero(count)
    sums = np.zeros((n, table.shape[1]))
    if len(some):
        sums[some] = np.add.reduceat(table[g], (np.cumsum(count) - count)[some], axis=0)
    return sums, count, g, piece


def piece_scores(pieces: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of the pieces' profiles with the prototypes, a row each, and their numbers of n-grams."""
    sums, count, g, piece = piece_sums(pieces, table)
    n, length = len(pieces), np.ones(len(pieces))
    if len(g):
        key = np.sort(piece * _N**3 + g)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(new, len(key)))
        length = np.maximum(1, np.bincount(key[new] // _N**3, weights=times.astype(float) ** 2, minlength=n))
    return sums / np.sqrt(length)[:, None], count


def _path(gain: np.ndarray) -> list[int]:
    """The best language of each sentence, in summed gain less ``SWITCH`` for every change."""
    best, back = gain[0].copy(), []
    for row in gain[1:]:
        top = int(np.argmax(best))
        stay = best >= best[top] - SWITCH
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - SWITCH) + row
    path = [int(np.argmax(best))]
    for prev in reversed(back):
        path.append(int(prev[path[-1]]))
    path.reverse()
    return path


def segment_all(texts: list[str], table: np.ndarray, names: tuple[str, ...], temperature: float) -> list[list[tuple[int, int, str, float]]]:
    """For each text (start, end, language, confidence) of the longest runs of whole sentences in one language.

    The runs maximise the sentences' summed scores less ``SWITCH`` for every change of language. Confidence is the
    share of the winner's exponentiated score. A text without letters has no segment."""
    if not names:
        return [[] for _ in texts]
    spans = [sentences(t) for t in texts]
    s, n = piece_scores([bare(t[a:b]) for t, own in zip(texts, spans) for a, b in own], table)
    weight = np.sqrt(n)
    gain = s * weight[:, None]
    top = np.argmax(gain, axis=1) if len(gain) else np.empty(0, np.int64)
    out, at = [], 0
    for own in spans:
        here = slice(at, at + len(own))
        at += len(own)
        mine = top[here].tolist()
        # the same best language all over is the best path
        path = mine if len(set(mine)) < 2 else _path(gain[here])
        segs, i = [], 0
        while i < len(path):
            j = i
            while j < len(path) and path[j] == path[i]:
                j += 1
            total = gain[here][i:j].sum(0) / max(1e-9, weight[here][i:j].sum())
            segs.append((own[i][0], own[j - 1][1], names[path[i]], float(1 / np.exp((total - total[path[i]]) * temperature).sum())))
            i = j
        out.append(segs)
    return out


def segments(text: str, table: np.ndarray, names: tuple[str, ...], temperature: float = 30.0) -> list[tuple[int, int, str, float]]:
    """``segment_all`` of one text."""
    return segment_all([text], table, names, temperature)[0]


#: What a change of language costs, in summed weighted cosine.
SWITCH = 0.35
#: Texts worked on at a time, and letters after which a portion ends, which bound a worker's memory.
ROWS, LETTERS = 512, 1 << 20


def calibrated(texts: list[str], langs: list[str], table: np.ndarray, names: tuple[str, ...]) -> float:
    """The sharpness at which confidences of single sentences fit how often they are right, by log loss over sentences
    of texts that as a whole are of the language they are labelled with."""
    whole, _ = piece_scores(texts, table)
    good = [t for t, k, row in zip(texts, langs, whole) if names and names[int(np.argmax(row))] == k]
    want = [names.index(k) for _, k, row in zip(texts, langs, whole) if names[int(np.argmax(row))] == k]
    spans = [sentences(t) for t in good]
    s, n = piece_scores([bare(t[a:b]) for t, own in zip(good, spans) for a, b in own], table)
    y = np.repeat(want, [len(own) for own in spans]).astype(np.int64)
    s, y = s[n > 0], y[n > 0]
    if not len(y):
        return 30.0

    def loss(t: float) -> float:
        z = s * t
        z -= z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))

    return min((5.0 * 1.25**i for i in range(20)), key=loss)


def model(documents: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, tuple[str, ...], float]:
    """Prototypes' table, their languages and the sharpness of confidences, from at most ``sample`` documents whose
    label names a language, as many for each one; the sharpness from every fifth of them, left out of the prototypes
    it is judged by."""
    wanted = [w for ws in CODES.values() for w in ws.split()]
    code = F.split(F.lower(F.btrim("lang")), "[-_ ]")[0]
    known = F.create_map(*[x for w in wanted for x in (F.lit(w), F.lit(_CODE[w]))])
    labelled = documents.select("doc_id", "text", known[code].alias("k")).filter(F.col("k").isNotNull() & F.col("text").rlike(r"\p{L}"))
    got = bounded(labelled, "doc_id", max(1, sample // len(LANGUAGES)), SEED, "k")
    texts, langs = [r["text"] for r in got], [r["k"] for r in got]
    held = [i % 5 == 0 for i in range(len(got))]
    part = lambda xs, side: [x for x, h in zip(xs, held) if h == side]
    first = train(part(texts, False), part(langs, False))
    sharp = calibrated(part(texts, True), part(langs, True), *first) if first[1] else 30.0
    return *train(texts, langs), sharp


def identify(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Segments of all documents: doc_id, seg_no (from 1), start, end (characters), lang, confidence, n_segments,
    labelled (what the document's label names, or null).

    documents: doc_id, text, lang (others are ignored). Null or letterless texts have no segment; repeated rows give
    the same rows again; long texts are read whole; with no labelled document nothing is assigned."""
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(model(documents, sample))
    names = ["doc_id", "seg_no", "start", "end", "lang", "confidence", "n_segments", "labelled"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, langs, sharp = held.value
        for batch in batches:
            key, text, lang = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(key):
                end, size = at, 0
                while end < len(key) and end - at < ROWS and size < LETTERS:
                    size += len(text[end] or "")
                    end += 1
                out: list[tuple] = []
                for k, x, segs in zip(key[at:end], lang[at:end], segment_all([t or "" for t in text[at:end]], table, langs, sharp)):
                    named = label(x)
                    out += [(k, i + 1, *seg, len(segs), named) for i, seg in enumerate(segs)]
                at = end
                if out:
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    schema = "doc_id bigint, seg_no int, start int, end int, lang string, confidence double, n_segments int, labelled string"
    return documents.select("doc_id", "text", "lang").mapInArrow(run, schema)


def cases(found: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang): all segments of mixed documents; segment 1 of others with no or another label."""
    wrong = F.col("labelled").isNull() | (F.col("labelled") != F.col("lang"))
    return found.filter((F.col("n_segments") > 1) | wrong).select("doc_id", "seg_no", "lang").distinct()
