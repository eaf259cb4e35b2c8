"""Near duplicates by b-bit MinHash: texts whose sets of consecutive tokens share a given part of their union.

Texts are signed where they are read: HASHES minima, of which the low KEPT bits of ROWS make a band key and the low
BITS bits are packed into a signature. Copies are folded on the hash of their text right there, so a group of
copies costs one row a task, and only signatures are shuffled. Band keys are shuffled once and met in one sorted
stream a task; similarity is estimated from the number of equal b-bit fields, corrected for the 2**-BITS chance
collisions, and pairs within SLACK of the threshold or above are checked exactly.

A band key met by more than HOT representatives (boilerplate) makes no pairs. Keys frequent within a batch leave the
stream before the shuffle, the others in it, and the representatives under them are joined by prefix filtering
instead: shingles in one order, the most frequent last, of which two texts at the threshold share one among the first
n - ceil(threshold * n) + 1. That is exact for any order, so nothing is capped or lost.

With 4 minima a band and 40 bands a pair at similarity 0.6 is missed with probability 0.004, at 0.65 with 0.0004;
SLACK is four standard errors of the estimate.

Defined results
 * Null texts and texts under ``least_tokens`` tokens belong to no pair. Repeats of a row count once.
 * Copies have similarity 1 and are pairs of each other. Ids are compared as numbers; null ids are left out.
 * Whole texts are tokenised, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut, hot_keys, salted_join, spread_scan

TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"
ROWS, BANDS, KEPT, BITS, SLACK, SEED = 4, 40, 12, 2, 0.2, 20_240_607
HASHES = ROWS * BANDS
#: A band key of more representatives is met by prefixes; one of more than HOT / 2 in a batch leaves it before the shuffle.
HOT = 128
#: So many shingles at most are known as frequent, and so many ids at most are broadcast (else they are shuffled).
FREQUENT, BROADCAST_IDS = 65_536, 200_000
_MARK = -(2**63)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that the linear hash family sees well spread values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Token -> 64-bit hash, forgotten when there are too many."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token)
        return h


class Shingler:
    """The set of hashed runs of ``width`` tokens of a text."""

    def __init__(self, token: str = TOKEN, width: int = 3):
        self.split, self.width, self.known = re.compile(token).findall, width, _Hashes()

    def tokens(self, text: str | None) -> list[str]:
        return self.split(text or "")

    def runs(self, tokens: list[str]) -> np.ndarray:
        """A hash of each run, in order."""
        values = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        n = len(values) - self.width + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(self.width):  # Horner's rule, so the order of the tokens counts
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += values[k : k + n]
        return _mix(out)

    def hashed(self, tokens: list[str]) -> np.ndarray:
        return np.unique(self.runs(tokens))


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def minima(hashed: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of each hash function; long sets go through in blocks, so memory stays bounded."""
    return minima_of(hashed, np.zeros(1, dtype=np.int64), family)[0]


def minima_of(hashed: np.ndarray, starts: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minima of several sets that lie one after the other, in blocks of 2,048 values."""
    a, b = family
    words = (hashed >> np.uint64(32)).astype(np.uint32)
    low = np.full((len(starts), HASHES), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(words), 2048):
        x = words[i : i + 2048, None] ^ b  # the values are well mixed already, so one product orders them anew
        x *= a
        first = int(np.searchsorted(starts, i, side="right")) - 1
        last = int(np.searchsorted(starts, i + len(x), side="left"))
        found = np.minimum.reduceat(x, np.maximum(starts[first:last] - i, 0), axis=0)
        low[first:last] = np.minimum(low[first:last], found)
    return low


def folded(low: np.ndarray) -> np.ndarray:
    """The minima with their high bits folded into the low ones, as the lowest bits of a product vary least."""
    return low ^ (low >> np.uint32(15)) ^ (low >> np.uint32(7))


def banded(low: np.ndarray) -> np.ndarray:
    """Rows of minima -> for each a key of ROWS * KEPT bits a band, six bytes each, from the low bits and its number."""
    fields = (folded(low).astype(np.uint64) & np.uint64((1 << KEPT) - 1)).reshape(-1, BANDS, ROWS)
    keys = (fields << (np.arange(ROWS, dtype=np.uint64) * np.uint64(KEPT))).sum(axis=2, dtype=np.uint64)
    keys ^= _mix(np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.uint8).reshape(-1, BANDS, 8)[:, :, :6].reshape(len(keys), -1)


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, 64 / BITS to a long."""
    per = 64 // BITS
    fields = (folded(low).astype(np.uint64) & np.uint64((1 << BITS) - 1)).reshape(*low.shape[:-1], -1, per)
    return (fields << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=-1, dtype=np.uint64).view(np.int64)


def _sign(token: str, width: int, least_tokens: int):
    """id, copy, text -> id, copy, bands, signature; the last two null for short texts."""
    least = max(least_tokens, width)

    def run(batches):
        shingler, family = Shingler(token, width), _family()
        known: dict[bytes, tuple] = {}
        for b in batches:
            copies, fresh, sets = b.column(1).to_pylist(), [], []
            if len(known) > 20_000:
                known.clear()
            for copy, text in zip(copies, b.column(2).to_pylist()):
                if copy not in known:
                    known[copy] = (None, None)
                    tokens = shingler.tokens(text)
                    if len(tokens) >= least:
                        fresh.append(copy)
                        sets.append(shingler.runs(tokens))
            if fresh:
                starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
                low = minima_of(np.concatenate(sets), starts, family)
                for copy, keys, signature in zip(fresh, banded(low), packed(low).tolist()):
                    known[copy] = keys.tobytes(), signature
            got = [known[c] for c in copies]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.list_(pa.int64()))], names=["id", "copy", "bands", "signature"])

    return run


def _spread_keys(batches):
    """rep, bands -> key, rep. Keys frequent in the batch are replaced by one mark each, and the representatives under
    them go on below zero, where no key is."""
    for b in batches:
        if not b.num_rows:
            continue
        raw = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), dtype=np.uint8)
        wide[:, :6] = raw
        keys, reps = wide.view(np.int64).ravel(), np.repeat(b.column(0).to_numpy(), BANDS)
        found, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        often = n > HOT // 2
        if often.any():
            out = often[at]
            hot = np.unique(reps[out])
            marks = found[often]
            keys = np.concatenate([keys[~out], marks, -1 - (hot & 0xFFFFF)])
            reps = np.concatenate([reps[~out], np.full(len(marks), _MARK), hot])
        yield pa.record_batch([pa.array(keys), pa.array(reps)], names=["key", "rep"])


def _meet(most: int | None):
    """Sorted (key, rep) -> (a, b) of the representatives under one key; a mark or more than ``most`` of them give (rep, null)
    each. Without ``most`` every pair is given, in bounded steps."""

    def block(a, b):
        return pa.record_batch([pa.array(a, pa.int64()), b if isinstance(b, pa.Array) else pa.array(b, pa.int64())], names=["a", "b"])

    def alone(reps):
        return block(reps, pa.nulls(len(reps), pa.int64()))

    def within(keys, reps):
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        hot = (keys[starts] < 0) & (most is not None) | (reps[starts] == _MARK)
        if most is not None:
            hot |= sizes > most
        rows = np.repeat(hot, sizes)
        if (single := reps[rows & (reps != _MARK)]).size:
            yield alone(np.unique(single))
        left = np.where(rows, 0, np.repeat(starts + sizes, sizes) - np.arange(len(keys)) - 1)  # rows of the key still to come
        at, lag, found, held = np.flatnonzero(left > 0), 1, [], 0
        while at.size:
            found.append(np.stack([reps[at], reps[at + lag]]))
            held += at.size
            lag += 1
            at = at[left[at] >= lag]
            if held > 200_000 or not at.size:
                both = np.unique(np.concatenate(found, axis=1), axis=1)
                both = both[:, both[0] != both[1]]
                yield block(both.min(axis=0), both.max(axis=0))
                found, held = [], 0

    def run(batches):
        keys, reps, open_hot = np.empty(0, np.int64), np.empty(0, np.int64), None
        for b in batches:
            keys, reps = np.concatenate([keys, b.column(0).to_numpy()]), np.concatenate([reps, b.column(1).to_numpy()])
            if open_hot is not None and keys.size:
                n = int(np.searchsorted(keys, open_hot, side="right"))
                if n:
                    yield alone(np.unique(reps[:n]))
                keys, reps = keys[n:], reps[n:]
            if not keys.size:
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # the run that may go on
            if last:
                yield from within(keys[:last], reps[:last])
                keys, reps = keys[last:], reps[last:]
            if most is not None and (keys[0] < 0 or len(keys) > most or reps[0] == _MARK):
                open_hot = keys[0]
                if (single := reps[reps != _MARK]).size:
                    yield alone(np.unique(single))
                keys, reps = keys[:0], reps[:0]
        if keys.size:
            yield from within(keys, reps)

    return run


def _shingles(token: str, width: int):
    def run(batches):
        shingler = Shingler(token, width)
        for b in batches:
            sets = [shingler.hashed(shingler.tokens(t)).view(np.int64) for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))], names=["rep", "shingles"])

    return run


def _prefixes(threshold: float, held):
    """rep, shingles -> key, rep of the first shingles of each, the frequent ones last."""

    def run(batches):
        often = held.value
        for b in batches:
            keys, reps = [], []
            for rep, s in zip(b.column(0).to_pylist(), b.column(1)):
                s = s.values.to_numpy() if hasattr(s, "values") else np.asarray(s)
                rank = np.searchsorted(often[0], s)
                known = often[0][np.minimum(rank, len(often[0]) - 1)] == s if len(often[0]) else np.zeros(len(s), bool)
                count = np.where(known, often[1][np.minimum(rank, max(len(often[1]) - 1, 0))] if len(often[0]) else 0, 0)
                first = s[np.lexsort((s, count))][: len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + 1]
                keys.append(first)
                reps.append(np.full(len(first), rep))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(reps))], names=["key", "rep"])

    return run


def _by_prefix(hot: DataFrame, texts: DataFrame, token: str, width: int, threshold: float) -> DataFrame:
    """(a, b) of the hot representatives (rep) that share a shingle of their prefixes."""
    spark = hot.sparkSession
    few = hot.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(hot) if few else hot.hint("merge"), "rep", "left_semi").dropDuplicates(["rep"])
    sets = cut(wanted.select("rep", "text").mapInArrow(_shingles(token, width), "rep long, shingles array<long>"))
    often = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).orderBy(F.desc("n"), "s").limit(FREQUENT).collect()
    often = sorted((r["s"], r["n"]) for r in often)
    held = spark.sparkContext.broadcast((np.array([x for x, _ in often], dtype=np.int64), np.array([n for _, n in often], dtype=np.int64)))
    keyed = sets.mapInArrow(_prefixes(threshold, held), "key long, rep long")
    return keyed.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_meet(None), "a long, b long")


def estimate(a: str, b: str):
    """The collision-corrected similarity of two packed signatures, in JVM bit operations."""
    mask = F.lit(sum(1 << i for i in range(0, 63, BITS)))

    def unequal(x, y):
        d = x.bitwiseXOR(y)
        for s in range(1, BITS):
            d = d.bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), s))
        return F.bit_count(d.bitwiseAND(mask))

    missed = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)
    same, chance = 1 - missed / F.lit(float(HASHES)), 2.0**-BITS
    return (same - chance) / (1 - chance)


def _verify(token: str, width: int, threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
    split = re.compile(token).findall

    def shingles(text):
        words = split(text)
        return set(zip(*(words[k:] for k in range(width))))

    def run(batches):
        last, last_set = None, None
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a != last:
                    last, last_set = a, shingles(x)
                other = shingles(y)
                both = len(last_set & other)
                union = len(last_set) + len(other) - both
                if union and both >= threshold * union - 1e-9:
                    out.append((a, b, both / union))
            if out:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.6, token: str = TOKEN, width: int = 3, least_tokens: int = 40) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, members, long): links (a, b, similarity) with a < b between representatives, members (id, rep) of
    every row with a text, and the representatives (rep) of least_tokens tokens or more; the representative of a
    group of copies is its smallest id."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    copy = F.unhex(F.md5("text")).alias("copy")
    signed = spread_scan(rows).select("id", copy, "text").mapInArrow(_sign(token, width, least_tokens), "id long, copy binary, bands binary, signature array<long>")
    first = cut(signed.groupBy("copy").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("signature").alias("signature")))
    members = cut(salted_join(rows.select("id", copy).distinct(), first.select("copy", "rep"), ["copy"], "inner", "id").select("id", "rep"))
    long = first.where(F.col("bands").isNotNull())
    keyed = long.select("rep", "bands").mapInArrow(_spread_keys, "key long, rep long")
    met = cut(keyed.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_meet(HOT), "a long, b long").distinct())
    texts = rows.select(F.col("id").alias("rep"), "text")
    candidates = met.where(F.col("b").isNotNull())
    hot = met.where(F.col("b").isNull()).select(F.col("a").alias("rep"))
    if not hot.isEmpty():
        candidates = candidates.unionByName(_by_prefix(hot, texts, token, width, threshold)).distinct()
    left = long.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    right = long.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))
    likely = candidates.join(left, "a").join(right, "b").where(estimate("sa", "sb") >= threshold - SLACK).select("a", "b")
    # the texts are shuffled once, by id; both look-ups start from that exchange
    texts = texts.repartition("rep").dropDuplicates(["rep"])
    read = likely.join(texts.withColumnsRenamed({"rep": "b", "text": "y"}), "b").join(texts.withColumnsRenamed({"rep": "a", "text": "x"}), "a")
    links = read.select("a", "b", "x", "y").mapInArrow(_verify(token, width, threshold), "a long, b long, similarity double")
    return links, members, long.select("rep")


def pairs(links: DataFrame, members: DataFrame, long: DataFrame) -> DataFrame:
    """(id_a, id_b) of all pairs, copies included: links between representatives carried to their members, and the
    copies of each representative among themselves. long: (rep) of representatives long enough to count. The rows of
    a representative with very many copies are spread by their first member."""
    own = long.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    both = links.select("a", "b").unionByName(own)
    left = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    met = salted_join(both.join(left, "a"), right, ["b"], "inner", "x", hot=hot_keys(members, ["rep"]))
    met = met.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row a text: id, class_id (the smallest representative reached through links) and n_links, the number of
    other representatives it is linked to."""
    links = cut(links.select("a", "b"))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("n_links"))
    labels = connected_components(links).withColumnsRenamed({"node": "rep", "component": "class_id"})
    return (
        members.join(labels, "rep", "left").join(degree, "rep", "left")
        .select("id", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )

