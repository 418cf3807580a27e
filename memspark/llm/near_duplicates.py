"""Near-duplicate records with small edits, by a prefix-tree join over globally ordered n-gram sets.

A text is the sequence of its words (maximal runs of letters and digits of the lower-cased text); its set is that
of its ``GRAM``-word sequences. Two texts are linked if their sets' Jaccard similarity is at least a threshold.

1. Texts with the same words are one class; the join runs over classes.
2. First level of the tree. The n-grams of every text are put in one global order, rarest first, and a text enters
   the tree under each n-gram of its prefix, the shortest one that must hold an n-gram shared with any linked text.
   Rarity comes from counts of all n-grams of all texts in a table of fixed size (``CELLS`` one-byte log counts), the
   only thing that is broadcast; the order need not be exact, only the same for all texts. An n-gram that fills its
   cell alone occurs once and leads nowhere. An n-gram of more than about ``HOT`` texts makes no branch by itself
   where a text must share at least two: if the rarest one two texts share is hot, so is the second, and both lie in
   either text's prefix for two shared n-grams; such texts enter under each pair of hot n-grams of that prefix.
3. Pairs under one branch are dropped if the sizes, the n-grams that remain after the branch, or the signatures cannot
   reach the bounds. A signature is the parity of the set's counts in ``BITS`` cells: two sets differ in at least as
   many n-grams as their signatures do in bits.
4. Lower levels. For each left text the partners' n-gram sets, in one global order, are walked as a prefix tree:
   the overlap of a shared prefix is computed once, and a subtree is left as soon as its overlap and what remains
   cannot reach the bound. What survives has exactly the Jaccard similarity asked for.

Every step drops only what cannot be linked, whatever words or phrases a text repeats.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators.graph import components
from memspark.session import cut, drop

GRAM = 3
CELL_BITS = 22
CELLS = 1 << CELL_BITS
#: Texts with one n-gram from about which on branches go one level deeper.
HOT = 1024
#: Bits of a set's signature.
BITS = 256
_SLICE = 1 << 15
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Turns in which all branches are joined, each an equal part of them.
TURNS = 8
#: Branches that are looked at together, about.
ENTRIES = 1_000_000
#: Rows worked on at a time, which bounds a worker's memory.
ROWS = 2000


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Hasher:
    """64-bit hashes of words, kept for the words seen last."""

    def __init__(self, most: int = 200_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes, one text after the other, and each word's text number."""
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for ws in texts:
            for w in ws:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh3_64_intdigest(w)
                out.append(h)
        return np.array(out, dtype=np.uint64), np.repeat(np.arange(len(texts)), [len(ws) for ws in texts])


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences within the texts, in reading order, as int64, and their text numbers."""
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        out = np.full(size, np.uint64(n))
        for i in range(n):
            out = (out ^ hashes[i : size + i]) * _MIX
            out ^= out >> np.uint64(29)
    inside = doc[:size] == doc[n - 1 :]
    return out[inside].view(np.int64), doc[:size][inside]


def distinct(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct values, ordered by text and value, and their text numbers."""
    order = np.lexsort((g, doc))
    gs, ds = g[order], doc[order]
    new = np.ones(len(gs), bool)
    new[1:] = (gs[1:] != gs[:-1]) | (ds[1:] != ds[:-1])
    return gs[new], ds[new]


def signatures(g: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """The parities of the texts' sets in ``BITS`` cells, as rows of 64-bit integers."""
    n = np.bincount(doc * BITS + (g & (BITS - 1)), minlength=texts * BITS) & 1
    return np.packbits(n.astype(np.uint8).reshape(texts, BITS), axis=1).view(np.int64)


def cell(values: np.ndarray) -> np.ndarray:
    return (values.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _level(n: np.ndarray) -> np.ndarray:
    """Counts as eighths of their binary logarithm, from 1 on."""
    return np.minimum(255, 1 + np.floor(8 * np.log2(n))).astype(np.uint8)


def branches(g: np.ndarray, rare: np.ndarray, least: int, hot_level: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ranks) under which a text with n-grams ``g`` (ordered, with rarity levels ``rare``) enters the tree
    if it shares at least ``least`` of them with any partner. A pair of n-grams has the rank of its second, negated."""
    first = np.arange(len(g) - least + 1)
    first = first[rare[first] > 1]
    hot = rare > hot_level
    # a text that may share just one n-gram enters under every one, and under the pairs for those that do not
    cold = first if least < 2 else first[~hot[first]]
    deep = np.flatnonzero(hot[: len(g) - least + 2])
    if len(deep) < 2 or not hot[first].any():
        return g[cold], cold
    i, j = np.triu_indices(len(deep), 1)
    with np.errstate(over="ignore"):
        both = (g[deep[i]].view(np.uint64) * _MIX + g[deep[j]].view(np.uint64)) * _MIX
    return np.concatenate([g[cold], both.view(np.int64)]), np.concatenate([cold, -deep[j]])


def shared(total: int, threshold: float) -> int:
    """Least number of n-grams that two linked texts of together ``total`` n-grams share."""
    return max(1, math.ceil(threshold / (1 + threshold) * total - 1e-9))


def _counts(docs: DataFrame, min_words: int) -> np.ndarray:
    """log2 counts (eighths, at most 255; 0: none, 1: once) of all n-grams by cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hasher = np.zeros(CELLS, np.uint32), Hasher()
        for batch in _portions(batches):
            texts = [ws for ws in map(words, batch.column(0).to_pylist()) if len(ws) >= min_words]
            g, _ = distinct(*grams(*hasher(texts), GRAM))
            np.add.at(total, cell(g), 1)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000].astype(np.int32)), pa.array(total[at[k : k + 100_000]].astype(np.int64))], ["cell", "n"])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        level = np.zeros(_SLICE, np.uint8)
        level[pdf["cell"].to_numpy() % _SLICE] = _level(pdf["n"].to_numpy())
        return pd.DataFrame({"slice": [int(pdf["cell"].iloc[0]) // _SLICE], "level": [level.tobytes()]})

    summed = docs.select("text").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    slices = summed.withColumn("slice", F.expr(f"cell div {_SLICE}").cast("int")).groupBy("slice").applyInPandas(pack, "slice int, level binary")
    out = np.zeros(CELLS, np.uint8)
    for row in slices.toLocalIterator():  # CELLS bytes in all, whatever the data
        out[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["level"], np.uint8)
    return out


def _rows(docs: DataFrame, spark: SparkSession, threshold: float, min_words: int, hot: int) -> DataFrame:
    """Texts (field, id, cls, n, bits, ref): n distinct n-grams, their signature, a number; and blobs (bucket, ref, blob)
    of the branches of up to ``ROWS`` texts from number ``ref`` on, 7 or 9 bytes each: hash, text, rank."""
    counts = _counts(docs, min_words)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(np.exp2((counts[counts > 0] - 1.0) / 8).sum() * (1 - threshold)) // ENTRIES)
    table = spark.sparkContext.broadcast(counts)
    hot_level = 1 + math.floor(8 * math.log2(hot))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, hasher, base = table.value, Hasher(), TaskContext.get().partitionId() << 33
        for batch in _portions(batches):
            read = [(f, i, ws) for f, i, ws in ((f, i, words(t)) for f, i, t in zip(*(batch.column(i).to_pylist() for i in range(3)))) if len(ws) >= min_words]
            if not read:
                continue
            g, doc = distinct(*grams(*hasher([ws for _, _, ws in read]), GRAM))
            n = np.bincount(doc, minlength=len(read))
            bits = signatures(g, doc, len(read))
            rare = level[cell(g)]
            order = np.lexsort((g, rare, doc))
            g, rare = g[order], rare[order]
            at = np.concatenate([[0], np.cumsum(n)])
            keys, ranks = [], []
            for k in range(len(read)):
                # partners have threshold * n n-grams at least
                least = shared(int(n[k]) + math.ceil(threshold * int(n[k]) - 1e-9), threshold)
                key, where = branches(g[at[k] : at[k + 1]], rare[at[k] : at[k + 1]], least, hot_level)
                keys.append(key)
                ranks.append(where)
            texts = len(read)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f for f, _, _ in read]), pa.array([i for _, i, _ in read]), pa.array([xxhash.xxh3_128_digest(" ".join(ws)) for _, _, ws in read], pa.binary()), pa.array(n.astype(np.int32)),
                    pa.array(list(bits), pa.list_(pa.int64())), pa.array(np.arange(base, base + texts)), pa.nulls(texts, pa.int32()), pa.nulls(texts, pa.binary()),
                ],
                _COLUMNS,
            )
            salt = np.repeat(np.array([xxhash.xxh3_64_intdigest(f) for f, _, _ in read], np.uint64), [len(k) for k in keys])
            bucket, blobs = _packed(np.concatenate(keys).view(np.uint64) ^ salt, np.concatenate(ranks), np.repeat(np.arange(texts), [len(k) for k in keys]), buckets)
            m = len(bucket)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int64())), pa.array(np.full(m, base)), pa.array(bucket), pa.array(blobs, pa.binary())], _COLUMNS)
            base += texts

    return docs.select("field", "id", "text").mapInArrow(rows, "field string, id string, cls binary, n int, bits array<bigint>, ref bigint, bucket int, blob binary")


_COLUMNS = ["field", "id", "cls", "n", "bits", "ref", "bucket", "blob"]


def _packed(keys: np.ndarray, ranks: np.ndarray, text: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Branches by bucket: the bytes of a rank, then 32 bits of the hashes in the bucket, the texts, the ranks."""
    deep = ranks < 0
    with np.errstate(over="ignore"):
        h = (keys ^ (deep.astype(np.uint64) << np.uint64(7))) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _MIX
    at = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    rank = np.where(deep, -ranks - 1, ranks)
    width = next(w for w in (1, 2, 4) if rank.max(initial=0) < 1 << 8 * w)
    order = np.argsort(at, kind="stable")
    at, low, text, rank = at[order], h[order].astype(np.uint32), text[order].astype(np.uint16), rank[order].astype(f"u{width}")
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], [bytes([width]) + low[i:j].tobytes() + text[i:j].tobytes() + rank[i:j].tobytes() for i, j in zip(first, [*first[1:], len(at)])]


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """(branch, ref, rank) of the branches of a bucket that more than one text enters; one of a single text leads nowhere.
    Two branches that share 32 bits of their hashes in a bucket are one: that can only add candidates."""
    low, ref, rank = [], [], []
    for base, blob in zip(pdf["ref"], pdf["blob"]):
        width = blob[0]
        m = (len(blob) - 1) // (6 + width)
        low.append(np.frombuffer(blob, np.uint32, m, 1))
        ref.append(base + np.frombuffer(blob, np.uint16, m, 1 + 4 * m).astype(np.int64))
        rank.append(np.frombuffer(blob, f"u{width}", m, 1 + 6 * m).astype(np.int32))
    low, ref, rank = np.concatenate(low), np.concatenate(ref), np.concatenate(rank)
    order = np.argsort(low, kind="stable")
    same = np.concatenate([[False], low[order][1:] == low[order][:-1], [False]])
    order = order[same[1:] | same[:-1]]
    return pd.DataFrame({"branch": (int(pdf["bucket"].iloc[0]) << 32) + low[order].astype(np.int64), "ref": ref[order], "rank": rank[order]})


def _walk(left: np.ndarray, rights: list[np.ndarray], threshold: float) -> list[float]:
    """Similarity of the left set to each right set, or -1 where it is below the threshold.

    All sets are sorted by one order. The rights, sorted as sequences, are walked as a prefix tree."""
    out = [-1.0] * len(rights)
    mine = {int(g): i for i, g in enumerate(left)}
    n = len(left)
    seqs = [r.tolist() for r in rights]
    path: list[int] = []  # the current node's n-grams
    over = [0]  # overlap at each depth
    used = [0]  # how many of the left's n-grams the path has passed
    for k in sorted(range(len(seqs)), key=seqs.__getitem__):
        seq = seqs[k]
        m = len(seq)
        need = math.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
        if m < threshold * n - 1e-9 or n < threshold * m - 1e-9:
            continue
        d = 0
        while d < len(path) and d < m and path[d] == seq[d]:
            d += 1
        # below a cut the bounds are checked again: they hold for the sizes of one right set only
        del path[d:], over[d + 1 :], used[d + 1 :]
        while d < m:
            o, u = over[d], used[d]
            if o + min(m - d, n - u) < need:
                break
            at = mine.get(seq[d])
            over.append(o if at is None else o + 1)
            used.append(u if at is None else at + 1)
            path.append(seq[d])
            d += 1
        if d == m:
            o = over[m]
            s = o / (n + m - o)
            if s >= threshold - 1e-12:
                out[k] = s
    return out


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(ka, kb) with the sets of both -> (field, a, b), a < b, of at least the threshold, with their similarity."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field, a, b = (batch.column(i).to_pylist() for i in range(3))
            # flatten() honours the offsets of a sliced batch
            la, lb = batch.column(3), batch.column(4)
            fa, fb = la.flatten().to_numpy(), lb.flatten().to_numpy()
            oa, ob = np.concatenate([[0], np.cumsum(la.value_lengths().to_numpy())]), np.concatenate([[0], np.cumsum(lb.value_lengths().to_numpy())])
            sims = [-1.0] * len(a)
            i = 0
            while i < len(a):
                j = i
                while j < len(a) and a[j] == a[i] and field[j] == field[i]:
                    j += 1
                sims[i:j] = _walk(fa[oa[i] : oa[i + 1]], [fb[ob[k] : ob[k + 1]] for k in range(i, j)], threshold)
                i = j
            keep = [k for k, s in enumerate(sims) if s >= 0]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([field[k] for k in keep]), pa.array([a[k] for k in keep]), pa.array([b[k] for k in keep]), pa.array([sims[k] for k in keep])], ["field", "a", "b", "similarity"])

    left = sets.select(F.col("k").alias("ka"), "field", F.col("rep").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("k").alias("kb"), F.col("field").alias("other"), F.col("rep").alias("b"), F.col("grams").alias("gb"))
    met = pairs.join(right, "kb").join(left, "ka").filter("field = other AND a <> b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b"), "ga": F.when(F.col("a") < F.col("b"), F.col("ga")).otherwise(F.col("gb")), "gb": F.when(F.col("a") < F.col("b"), F.col("gb")).otherwise(F.col("ga"))}).sortWithinPartitions("field", "a")
    return met.select("field", "a", "b", "ga", "gb").mapInArrow(walk, "field string, a string, b string, similarity double")


def _sets(docs: DataFrame) -> DataFrame:
    """(field, rep, grams): the distinct n-grams in global order (of their hashes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in _portions(batches):
            texts = [words(t) for t in batch.column(2).to_pylist()]
            g, doc = distinct(*grams(*hasher(texts), GRAM))
            sets = np.split(g, np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1]) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["field", "rep", "grams"])

    return docs.select("field", "id", "text").mapInArrow(rows, "field string, rep string, grams array<bigint>")


def links(docs: DataFrame, threshold: float = 0.8, min_words: int = 12, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate links between classes of texts, and the classes' members.

    docs: field, id, text (other columns are ignored). Returns (links, members): links are (field, a, b, similarity),
    a < b, between class representatives (the smallest id of a class); members are (field, rep, id), one row per
    text. Null ids or texts and texts of fewer than ``min_words`` words are left out; repeated rows count once; an
    id given with several texts belongs to several classes; empty input gives empty tables. Texts have no length limit."""
    spark = docs.sparkSession
    docs = docs.select("field", "id", "text").filter("id IS NOT NULL AND text IS NOT NULL")
    rows = cut(_rows(docs, spark, threshold, min_words, hot))
    texts = rows.filter("bucket IS NULL")
    reps = cut(texts.groupBy("field", "cls").agg(F.min(F.struct("id", "ref")).alias("m")).select("field", "cls", F.col("m.id").alias("rep"), "m.ref"))
    members = cut(texts.select("field", "cls", "id").distinct().join(reps.drop("ref"), ["field", "cls"]).select("field", "rep", "id"))
    words_of = [F.col("bits")[i].alias(f"s{i}") for i in range(BITS // 64)]
    own = texts.join(reps.select("ref"), "ref", "left_semi").select("ref", _key("field", "id").alias("k"), "n", *words_of)
    total = F.col("na") + F.col("nb")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * total - F.lit(1e-9))
    differ = sum((F.bit_count(F.col(f"s{i}a").bitwiseXOR(F.col(f"s{i}b"))) for i in range(1, BITS // 64)), F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))))
    met = (F.col("ka") < F.col("kb")) & (F.least(F.col("na") - F.col("ranka"), F.col("nb") - F.col("rankb")) >= need) & (differ <= total - 2 * need)
    parts = []
    for turn in range(TURNS):  # what a turn shuffles goes when its pairs are written
        entries = rows.filter(f"bucket % {TURNS} = {turn}").select("bucket", "ref", "blob").groupBy("bucket").applyInPandas(_met, "branch bigint, ref bigint, rank int")
        branch = entries.join(own, "ref").select("branch", "k", "n", "rank", *(f"s{i}" for i in range(BITS // 64)))
        left, right = (branch.select("branch", *(F.col(c).alias(c + side) for c in branch.columns[1:])) for side in "ab")
        parts.append(cut(left.join(right, (left["branch"] == right["branch"]) & met).select("ka", "kb").distinct()))
    pairs = cut(reduce(DataFrame.unionByName, parts).distinct())
    for table in (rows, reps, *parts):
        drop(table)
    ids = pairs.select(F.col("ka").alias("k")).unionByName(pairs.select(F.col("kb").alias("k"))).distinct()
    wanted = members.filter("rep = id").select("field", "id", _key("field", "id").alias("k")).join(ids, "k", "left_semi").select("field", "id").distinct()
    sets = cut(_sets(docs.join(wanted, ["field", "id"], "left_semi")).distinct().withColumn("k", _key("field", "rep")))
    return _verify(pairs, sets, threshold), members.select("field", "rep", "id").distinct()


def _key(field: str, name: str) -> Column:
    """A number for a text; should two texts share one, both are compared."""
    return F.xxhash64(field, name)


def pairs(found: DataFrame, members: DataFrame) -> DataFrame:
    """All linked pairs of ids (field, left_id, right_id), left_id < right_id, copies included."""
    a, b = members.select("field", F.col("rep").alias("a"), F.col("id").alias("x")), members.select("field", F.col("rep").alias("b"), F.col("id").alias("y"))
    across = found.select("field", "a", "b").join(a, ["field", "a"]).join(b, ["field", "b"])
    many = members.groupBy("field", "rep").count().filter("count > 1").select("field", F.col("rep").alias("a"))
    copies = a.join(many, ["field", "a"], "left_semi").join(b.withColumnRenamed("b", "a"), ["field", "a"])
    both = across.select("field", "x", "y").unionByName(copies.select("field", "x", "y")).filter("x <> y")
    return both.select("field", F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).distinct()


def groups(found: DataFrame, members: DataFrame) -> DataFrame:
    """(field, id, group_id, n_links, n_copies) of every text with a copy or a link: the connected group it belongs
    to (its smallest id), the links of its class to other classes and the number of texts in its class."""
    mark = lambda c: F.concat_ws("\x01", "field", c)
    roots = components(found.select(mark("a").alias("a"), mark("b").alias("b"))).select(F.col("node").alias("key"), F.substring_index("root", "\x01", -1).alias("root"))
    degree = found.select("field", F.explode(F.array("a", "b")).alias("rep")).groupBy("field", "rep").agg(F.count("*").alias("n_links"))
    size = members.groupBy("field", "rep").agg(F.count("*").alias("n_copies"))
    table = members.join(size, ["field", "rep"]).join(degree, ["field", "rep"], "left").withColumn("key", mark("rep")).join(roots, "key", "left")
    return table.filter("n_links IS NOT NULL OR n_copies > 1").select("field", "id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
