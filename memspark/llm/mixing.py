"""Mixing documents of several sources to target shares of tokens, by soft-membership least squares.

Every document has a posterior over the domains, the sources of the weights table. A classifier of spellings, fitted on
made spellings of the names, reads ``documents.source``: a spelling equal to a name but for case, blanks and
punctuation is that domain with certainty. A classifier of texts, fitted on a bounded sample of the documents that are
labelled so, reads the words: it decides between the domains that an unsure spelling leaves open, or, with
``membership="text"``, is all that counts, for documents without a source too. By label, a document without a source
belongs to none.

Documents are reduced to classes of equal posterior (rounded to 1/``STEPS``): their tokens, counted by a public
tokenizer, are all that the fit needs. Accelerated projected gradient descent on the squared difference of expected
domain tokens and targets then sets a rate per class, at least 0 and at most the repeats allowed; every step is one
distributed aggregation over the classes. Rates become whole repeats by document: the whole part for all, one more for
the documents whose hash falls below a cut at which the rest of the class's tokens is used up.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.samples import bounded
from memspark.session import cut

#: Fixed by the installed tokenizer files; both are parameters.
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
TOKENIZER_DIR = "/opt/tokenizers"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
STEPS = 16
BINS = 4096
#: Steps after which a fit that still moves is an error, and the relative movement of a domain's tokens that ends it.
ITERATIONS = 300
TOLERANCE = 1e-5
#: Documents of each domain that the classifier of texts is fitted on, at most.
SAMPLE = 600
TEXT_BITS = 15
#: Sources that a weights table may have: it is gathered.
MOST_SOURCES = 10_000
HASH_BITS = 14
#: Below this posterior a spelling is taken to belong to none of the domains.
FLOOR = 0.5


# ---------------------------------------------------------------- posteriors of spellings
def squeeze(name: str) -> str:
    return re.sub(r"[\W_]+", "", name.lower())


def _features(name: str) -> np.ndarray:
    text = f"^{squeeze(name)}$"
    keys = [text[i : i + n] for n in (2, 3, 4) for i in range(len(text) - n + 1)]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(k) >> (64 - HASH_BITS) for k in keys] or [0], np.int64))


def _spellings(name: str, rng: np.random.Generator) -> list[str]:
    """The name and ways to mistype it."""
    out = [name]
    for _ in range(40):
        c = list(squeeze(name))
        for _ in range(int(rng.integers(0, 3))):
            if len(c) < 3:
                break
            i, way = int(rng.integers(0, len(c) - 1)), int(rng.integers(0, 4))
            if way == 0:
                del c[i]
            elif way == 1:
                c.insert(i, c[i])
            elif way == 2:
                c[i], c[i + 1] = c[i + 1], c[i]
            else:
                c[i] = chr(97 + int(rng.integers(0, 26)))
        out.append("".join(c))
    return out


class Classifier:
    """Softmax regression over character n-grams of a source's spelling, with an extra class for none of them."""

    def __init__(self, names: list[str]):
        self.names = names
        rng = np.random.default_rng(11)
        x, y = [], []
        for k, n in enumerate(names):
            for s in _spellings(n, rng):
                x.append(_features(s))
                y.append(k)
        for _ in range(40 * max(1, len(names))):  # letters in no order belong to none
            x.append(_features("".join(chr(97 + int(v)) for v in rng.integers(0, 26, int(rng.integers(3, 18))))))
            y.append(len(names))
        self.w = np.zeros((1 << HASH_BITS, len(names) + 1), np.float32)
        for _ in range(12):
            for i in rng.permutation(len(x)):
                p = self._softmax(x[i])
                p[y[i]] -= 1
                self.w[x[i]] -= 0.5 * p / np.sqrt(len(x[i]))
        self.exact = {squeeze(n): k for k, n in enumerate(names)}

    def _softmax(self, f: np.ndarray) -> np.ndarray:
        s = self.w[f].sum(0) / np.sqrt(len(f))
        e = np.exp(s - s.max())
        return e / e.sum()

    def posterior(self, spelling: str | None) -> np.ndarray:
        """Over the domains; all 0 for what belongs to none of them."""
        out = np.zeros(len(self.names))
        if spelling is None or not squeeze(spelling):
            return out
        k = self.exact.get(squeeze(spelling))
        if k is not None:
            out[k] = 1
            return out
        p = self._softmax(_features(spelling))[:-1]
        return p if p.sum() >= FLOOR else out


def _words(text: str) -> np.ndarray:
    """Hashed words and pairs of words of a text; numbers count as one word."""
    ws = re.findall(r"[^\W\d_]+|\d+", text.lower())
    ws = ["0" if w[0].isdigit() else w for w in ws]
    keys = {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))}
    return np.fromiter((xxhash.xxh3_64_intdigest(k) >> (64 - TEXT_BITS) for k in keys), np.int64, len(keys))


class Texts:
    """Softmax regression over a text's words, with the sharpness at which its posteriors fit held-out labels best."""

    def __init__(self, texts: list[str], labels: list[int], size: int, epochs: int = 6):
        rng = np.random.default_rng(13)
        self.w, self.bias, self.sharp = np.zeros((1 << TEXT_BITS, size), np.float32), np.zeros(size, np.float32), 1.0
        x, hold = [_words(t) for t in texts], rng.random(len(texts)) < 0.2
        seen = np.full((1 << TEXT_BITS, 1), 1e-2, np.float32)
        train = np.flatnonzero(~hold)
        for _ in range(epochs):
            for i in rng.permutation(train):
                p = self._softmax(self._score(x[i]))
                p[labels[i]] -= 1
                step = p / np.sqrt(max(1, len(x[i])))
                seen[x[i]] += float((step * step).sum())
                self.w[x[i]] -= 0.1 * step / np.sqrt(seen[x[i]])
                self.bias -= 0.02 * p
        held = [(self._score(x[i]), labels[i]) for i in np.flatnonzero(hold)]
        if held:
            loss = lambda t: -sum(np.log(max(1e-12, self._softmax(s * t)[k])) for s, k in held)
            self.sharp = min((0.05 * 1.3**i for i in range(20)), key=loss)

    def _score(self, f: np.ndarray) -> np.ndarray:
        return self.w[f].sum(0) / np.sqrt(max(1, len(f))) + self.bias

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max())
        return e / e.sum()

    def posterior(self, text: str) -> np.ndarray:
        return self._softmax(self._score(_words(text)) * self.sharp)


def rounded(p: np.ndarray) -> np.ndarray:
    """In steps of 1/STEPS with the same sum (largest remainders), so that documents fall into few classes."""
    total = p.sum()
    if total <= 0:
        return np.zeros(len(p))
    q = p / total * STEPS
    out = np.floor(q)
    out[np.argsort(out - q, kind="stable")[: int(round(STEPS - out.sum()))]] += 1
    return out / STEPS


# ---------------------------------------------------------------- tokens
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = f"{TOKENIZER_DIR}/{TOKENIZER_FILE}") -> DataFrame:
    """doc_id, source, n_tokens of whole texts (0 for null or empty ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(tokenizer)
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def _plain(source: Column) -> Column:
    return F.regexp_replace(F.lower(source), r"(?U)[\W_]+", "")


def _texts(documents: DataFrame, names: list[str], sample: int) -> Texts:
    """The classifier of texts, from at most ``sample`` documents of each domain whose source is spelt like its name."""
    known = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(squeeze(n)), F.lit(k))])
    labelled = documents.select("doc_id", "text", known[_plain(F.col("source"))].alias("k")).filter(F.col("k").isNotNull() & F.col("text").isNotNull())
    got = bounded(labelled, "doc_id", sample, 17, "k")
    return Texts([r["text"] for r in got], [r["k"] for r in got], len(names))


def members(documents: DataFrame, table: list[tuple[str, float, int]], tokenizer: str, membership: str = "label", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_tokens, class, posterior, cap, domain) of the documents that belong to any domain.

    A document may be used as often as the likeliest of its domains allows."""
    names, caps = [n for n, _, _ in table], [m for _, _, m in table]
    schema = "doc_id bigint, n_tokens bigint, posterior array<double>, cap double, domain string"
    if membership == "label":
        documents = documents.filter("source IS NOT NULL")
        plain = _plain(F.col("source"))
        unsure = documents.filter((plain != "") & ~plain.isin([squeeze(n) for n in names])).limit(1).count() > 0
    else:
        unsure = True
    texts = _texts(documents, names, sample) if unsure and names else None
    held = documents.sparkSession.sparkContext.broadcast((Classifier(names), texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt, texts = held.value
        known: dict[str | None, np.ndarray] = {}
        encoder = _encoder(tokenizer)
        for batch in batches:
            rows = []
            for key, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text or not names:
                    continue
                if membership == "text":
                    post = texts.posterior(text)
                else:
                    if source not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[source] = spelt.posterior(source)
                    post = known[source]
                    if np.count_nonzero(post) > 1 and texts is not None:
                        post = post * texts.posterior(text)
                if post.sum() > 0:
                    top = int(np.argmax(post))
                    rows.append((key, len(encoder.encode_ordinary(text)), rounded(post).tolist(), float(caps[top]), names[top]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_tokens", "posterior", "cap", "domain"])

    docs = documents.select("doc_id", "source", "text").mapInArrow(run, schema)
    return docs.filter("n_tokens > 0").withColumn("class", F.xxhash64(F.col("posterior").cast("string"), "cap"))


# ---------------------------------------------------------------- fit
def _weights(weights: DataFrame) -> list[tuple[str, float, int]]:
    """One row per source, the first in name order of those that are the same but for spelling; shares sum to 1."""
    rows = weights.select("source", "target_share", "max_repeats").filter("source IS NOT NULL").distinct().orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    seen: dict[str, tuple[str, float, int]] = {}
    for r in rows:
        seen.setdefault(squeeze(r["source"]), (r["source"], max(0.0, float(r["target_share"] or 0)), max(0, int(r["max_repeats"] or 0))))
    total = sum(s for _, s, _ in seen.values()) or 1.0
    return [(n, s / total, m) for n, s, m in seen.values()]


def _dot(a: Column, b: list[float]) -> Column:
    return F.aggregate(F.zip_with(a, F.lit(b) if b else F.array(), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fit(classes: DataFrame, table: list[tuple[str, float, int]], total: float) -> tuple[DataFrame, np.ndarray]:
    """classes: class, posterior array<double>, cap, n_tokens -> (classes with rate, expected tokens of domains).

    Minimises the squared differences of expected and target domain tokens, each over the tokens the domain holds, by
    projected gradient steps with momentum, which starts anew where it leads uphill. Preconditioned by the classes'
    tokens the curvature is at most 1, as posteriors sum to 1. Raises if domains' tokens still move at the end."""
    target = np.array([s * total for _, s, _ in table])
    size = len(table)
    classes = classes.withColumns({"rate": F.lit(0.0), "ahead": F.lit(0.0)})

    def domain(df: DataFrame, rate: str) -> np.ndarray:  # `size` rows
        got = df.select(F.posexplode("posterior").alias("k", "p"), "n_tokens", rate).groupBy("k").agg(F.sum(F.col("p") * F.col("n_tokens") * F.col(rate)).alias("t")).collect()
        out = np.zeros(size)
        for r in got:
            out[r["k"]] = r["t"]
        return out

    held = domain(classes.withColumn("one", F.lit(1.0)), "one")
    if not held.sum():
        return classes.drop("ahead"), np.zeros(size)
    scale = np.maximum(held, 1e-9)
    current, reached, seen, momentum, last = classes, np.zeros(size), np.zeros(size), 1.0, float("inf")
    for step in range(ITERATIONS):
        move = np.where(held > 0, (target - seen) / scale, 0.0).tolist()
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        push = (momentum - 1) / grown
        new_rate = F.greatest(F.lit(0.0), F.least(F.col("cap"), F.col("ahead") + _dot(F.col("posterior"), move)))
        current = current.withColumn("new", new_rate).withColumn("ahead", F.col("new") + F.lit(float(push)) * (F.col("new") - F.col("rate"))).withColumn("rate", F.col("new")).drop("new")
        if step % 4 == 3:
            current = cut(current)
        before, reached = reached, domain(current, "rate")
        # the sums are linear in the rates, so those ahead follow from two of them
        seen = reached + push * (reached - before)
        off = float((((target - reached) ** 2) / scale).sum())
        momentum = grown
        if off > last:
            momentum, seen = 1.0, reached
            current = current.withColumn("ahead", F.col("rate"))
        last = off
        if np.max(np.abs(reached - before) / np.maximum(np.where(target > 0, target, held), 1.0)) < TOLERANCE:
            return current.drop("ahead"), reached
    raise RuntimeError(f"mixing: not converged after {ITERATIONS} steps")


def mix(documents: DataFrame, weights: DataFrame, total_tokens: float | None = None, tokenizer: str = f"{TOKENIZER_DIR}/{TOKENIZER_FILE}", membership: str = "label", sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    documents: doc_id, source, text; weights: source, target_share, max_repeats (other columns are ignored).
    mixture: doc_id, source (as in weights, of the largest posterior), n_tokens, repeats (0: not used), one row per
    document of some domain. shares: source, target_share, max_repeats, available_tokens, target_tokens, mixed_tokens, actual_share,
    reachable; tokens are expected ones, each document's by its posterior. The mixture's size is ``total_tokens``, by
    default the tokens of all documents that belong to a domain; a source whose documents repeated as often as allowed
    do not hold its part takes them all, and is not reachable. Its lack is not filled up by others, so actual shares are
    of the tokens mixed. By label, documents without a source or of unknown ones take no part, nor ever those without
    tokens; repeated rows are documents of their own; empty tables give empty mixtures and shares of null."""
    spark = documents.sparkSession
    table = _weights(weights)
    docs = cut(members(documents, table, tokenizer, membership, sample))
    classes = cut(docs.groupBy("class").agg(F.first("posterior").alias("posterior"), F.first("cap").alias("cap"), F.sum("n_tokens").cast("double").alias("n_tokens")))
    total = total_tokens if total_tokens is not None else float(classes.agg(F.sum("n_tokens")).first()[0] or 0)
    rated = cut(fit(classes, table, total)[0].select("class", "rate", "posterior"))
    docs = docs.drop("posterior").join(rated.select("class", "rate"), "class").withColumn("bin", F.pmod(F.xxhash64("doc_id", "class"), F.lit(BINS)))
    # the bin up to which documents are used once more: tokens by class and bin, a table of fixed width
    bins = docs.groupBy("class", "bin").agg(F.sum("n_tokens").alias("in_bin"), F.first("rate").alias("rate"))
    upto = Window.partitionBy("class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("class")
    bins = bins.withColumn("before", F.sum("in_bin").over(upto) - F.col("in_bin") / 2).withColumn("part", (F.col("rate") - F.floor("rate")) * F.sum("in_bin").over(whole))
    extra = bins.select("class", "bin", (F.col("before") <= F.col("part")).cast("int").alias("more"))
    mixture = docs.join(extra, ["class", "bin"]).withColumn("repeats", F.least(F.col("cap"), F.floor(F.col("rate") + 1e-9) + F.when(F.col("rate") - F.floor("rate") > 1e-9, F.col("more")).otherwise(0)).cast("int"))
    mixture = cut(mixture.select("doc_id", F.col("domain").alias("source"), "n_tokens", "repeats", "class"))
    used = mixture.groupBy("class").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("m")).join(rated.select("class", F.posexplode("posterior").alias("k", "p")), "class")
    mixed = used.groupBy("k").agg(F.round(F.sum(F.col("p") * F.col("n"))).cast("bigint").alias("available_tokens"), F.round(F.sum(F.col("p") * F.col("m"))).cast("bigint").alias("mixed_tokens"))
    plan = spark.createDataFrame([(k, n, s, m, s * total) for k, (n, s, m) in enumerate(table)], "k int, source string, target_share double, max_repeats int, target_tokens double")
    shares = plan.join(mixed, "k", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.round("target_tokens").cast("bigint").alias("target_tokens"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens")
    )
    every = float(mixed.agg(F.sum("mixed_tokens")).first()[0] or 0)
    shares = shares.withColumn("actual_share", F.round(F.col("mixed_tokens") / F.lit(every), 6) if every else F.lit(None).cast("double")).withColumn("reachable", F.col("available_tokens") * F.col("max_repeats") >= F.col("target_tokens"))
    return mixture.drop("class"), shares
