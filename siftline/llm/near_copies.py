"""SimHash near-duplicates at a similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity the fingerprints of two sets differ in 10 bits on average, far more than choices of blocks can bear. The groups
to compare therefore come from the shingles: two such sets share one of the first ``n - ceil(0.8 n) + 1`` shingles of each, in any
order that is the same for all. The order is by a rough frequency, then by hash, so shingles of common lines come last; the
frequency is of all texts, counted in buckets of hashes, and decides on speed alone. Within a group fingerprints are compared bit-sliced, and pairs at
RADIUS bits or fewer are confirmed by their shingles. Of the bits of two sets at 0.8, each differs with a probability of 0.15, and
of 0.19 for sets of five shingles, so a pair is over the radius less often than once in a million.

Two sets that first share a shingle at some place of each must hold what they have in common from there on; where that is too
little, the pair is not similar (positional filter). Equal sets are one. Each set first meets one other, the centre of
one of its groups: the set that has the shingle at the first place, so the one with the fewest shingles of its own, to
which the copies of one original are the likest. Those that are similar become components. Only pairs of different components are then left to compare, so a family of near copies
does not give all its pairs, and no link between components is lost. Large groups are cut into tiles, and each pair of tiles
is a group of its own, so no task holds a group as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, take_rows
from .simhash import FINISH_LINKS, LOWER, by_size, close_pairs, components, fingerprint_from, planes_of, whole_groups, within

SHINGLE_WORDS = 5
#: Bits in which the fingerprints of similar sets differ at most.
RADIUS = 28
#: Buckets of the rough frequencies.
BUCKET_BITS = 20
#: Buckets of a row in which tasks pass on what they counted.
SLICE = 1 << 14
#: Texts that make a shingle hot.
HOT = 1024
#: Sets of a tile.
TILE = 2048
_SIGNATURE = "struct<key: bigint, fp: bigint, n: int, prefix: array<bigint>>"


class _WordHashes(dict):
    """Word -> XXH64, remembered: about 20 MB a worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


_HASH = _WordHashes().__getitem__


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted, distinct hashes of the runs of five words, A-Z lower-cased; of fewer words, of all; of none, nothing."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASH, words), np.uint64, len(words))
    k = min(SHINGLE_WORDS, len(words))
    mixed = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - k + 1 + i]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(factor)
    return np.unique(mixed ^ mixed >> np.uint64(31))


def _key(shingles: np.ndarray) -> int:
    """The set's name, signed; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard >= 4/5, in whole numbers."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _near(n, m):
    """May sets of these sizes be similar?"""
    return (5 * n >= 4 * m) & (5 * m >= 4 * n)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles of each bucket, over the sets of all texts. Tasks pass on slices of counts, 8 MB each before compression."""

    def slices(total: np.ndarray) -> pa.RecordBatch:
        parts = total.reshape(-1, SLICE)
        used = np.flatnonzero(parts.any(axis=1))
        return pa.RecordBatch.from_pydict({"slice": pa.array(used, pa.int32()), "n": pa.array([parts[i].tobytes() for i in used], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(total, _bucket(shingle_set(t)), 1)
        yield slices(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64).reshape(-1, SLICE)
        for b in batches:
            for i, n in zip(b.column("slice").to_pylist(), b.column("n").to_pylist()):
                total[i] += np.frombuffer(n, np.int64)
        yield slices(total.reshape(-1))

    counted = docs.select(text).mapInArrow(count, "slice int, n binary")
    found = counted.repartition(partitions(docs.sparkSession), "slice").mapInArrow(add, "slice int, n binary").toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.int64).reshape(-1, SLICE)
    for i, n in zip(found.column("slice").to_pylist(), found.column("n").to_pylist()):
        out[i] += np.frombuffer(n, np.int64)
    return out.reshape(-1)


def _signatures(docs: DataFrame, doc_id: str, text: str, common: Broadcast[np.ndarray]) -> DataFrame:
    """(id, row_hash, key, fp, n, prefix) of each row: its set's name, fingerprint, size and first shingles."""

    @F.pandas_udf(_SIGNATURE)
    def sign(column: pd.Series) -> pd.DataFrame:
        rows = []
        for t in column:
            s = shingle_set(t)
            n = len(s)
            first = s[np.argsort(common.value[_bucket(s)], kind="stable")[: n - (4 * n + 4) // 5 + 1]] if n else s
            rows.append((_key(s), int(np.uint64(fingerprint_from(s)).view(np.int64)), n, first.view(np.int64)))
        return pd.DataFrame(rows, columns=["key", "fp", "n", "prefix"])

    return materialize(docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("row_hash"), sign(F.col(text)).alias("s")).select("id", "row_hash", "s.*"), "signatures")


def _prefixes(signatures: DataFrame, common: Broadcast[np.ndarray], hot: bool) -> DataFrame:
    """(token, pos, key): the first shingles of each set with their places, those that are hot by their rough frequency or the
    others, at most once a task for equal sets."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys = b.column("key").to_pylist()
            fresh = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            if len(seen) > 1_000_000:
                seen.clear()
            own = b.take(pa.array(fresh, pa.int64()))
            token = own.column("prefix").flatten().to_numpy()
            row, size = pc.list_parent_indices(own.column("prefix")), pc.list_value_length(own.column("prefix")).to_numpy()
            pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            mine = (common.value[_bucket(token.view(np.uint64))] >= HOT) == hot
            yield pa.RecordBatch.from_pydict({"token": token[mine], "pos": pos[mine].astype(np.int32), "key": pc.take(own.column("key"), row).to_numpy()[mine]})

    return signatures.filter("n > 0").select("key", "prefix").mapInArrow(of, "token long, pos int, key long")


def _groups(signatures: DataFrame, common: Broadcast[np.ndarray]) -> DataFrame:
    """(token, pos, key, centre_pos, centre): the tokens that several sets share, each set with the centre of the token: the set that
    has it at the first place (then of the smallest key).

    Most tokens are in one set alone; they meet in a stream of sorted rows, which holds one row of a group. Hot tokens are aggregated
    before they are shuffled and joined with their sets.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # token, place and key of the row before, and place and key of its group's first row
        for b in batches:
            token, pos, key = (b.column(c).to_numpy() for c in ("token", "pos", "key"))
            if not len(token):
                continue
            t, p, k, centre_pos, centre = last or (token[0] + 1 if token[0] < 0 else token[0] - 1, 0, 0, 0, 0)
            begins = np.concatenate([[token[0] != t], token[1:] != token[:-1]])
            alike = ~begins & np.concatenate([[(pos[0], key[0]) == (p, k)], (pos[1:] == pos[:-1]) & (key[1:] == key[:-1])])
            where = np.maximum.accumulate(np.where(begins, np.arange(len(token)), -1))
            centres, places = np.where(where >= 0, key[where], centre), np.where(where >= 0, pos[where], centre_pos).astype(np.int32)
            members = ~begins & ~alike  # the centre itself goes without saying: it is in every row
            yield pa.RecordBatch.from_pydict({"token": token[members], "pos": pos[members], "key": key[members], "centre_pos": places[members], "centre": centres[members]})
            last = token[-1], pos[-1], key[-1], places[-1], centres[-1]

    n = partitions(signatures.sparkSession)
    cold = _prefixes(signatures, common, False).repartition(n, "token").sortWithinPartitions("token", "pos", "key")
    cold = cold.mapInArrow(of, "token long, pos int, key long, centre_pos int, centre long")
    hot = materialize(_prefixes(signatures, common, True).distinct(), "hot")
    least = hot.groupBy("token").agg(F.min(F.struct("pos", "key")).alias("c")).select("token", F.col("c.pos").alias("centre_pos"), F.col("c.key").alias("centre"))
    return materialize(cold.unionByName(hot.join(least, "token").filter("key <> centre")), "groups")


def _bears(n, m, pos, other_pos):
    """May sets of these sizes, whose first common shingle is at these places, be similar? What follows must hold 4/9 of both."""
    least = np.minimum if isinstance(n, np.ndarray) else F.least
    return 9 * least(n - pos, m - other_pos) >= 4 * (n + m)


def _are_near(radius: int = RADIUS) -> Column:
    """Of columns fp_a, fp_b: are the fingerprints within the radius?"""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        unsigned = lambda x: np.ascontiguousarray(x.to_numpy(np.int64)).view(np.uint64)
        return pd.Series(within(unsigned(a), unsigned(b), radius))

    return near("fp_a", "fp_b")


def _stars(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): each set b with one of the centres of its groups whose size, place and fingerprint allow a link: that of the first
    place, as few shingles of its own make it the likest to the others (then of the smallest key)."""
    pairs = groups.groupBy(F.col("centre").alias("a"), F.col("key").alias("b")).agg(F.min("centre_pos").alias("pos_a"), F.min("pos").alias("pos_b"))
    of = lambda c: sets.select(F.col("key").alias(c), F.col("fp").alias(f"fp_{c}"), F.col("n").alias(f"n_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    both = both.filter(_near(F.col("n_a"), F.col("n_b")) & _bears(F.col("n_a"), F.col("n_b"), F.col("pos_a"), F.col("pos_b")))
    return both.filter(_are_near()).groupBy("b").agg(F.min(F.struct("pos_a", "a")).alias("s")).select("s.a", "b")


def compare_groups(rows: dict[str, np.ndarray], radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of keys of a group, of different labels, whose sizes, places and fingerprints allow a link. The groups, of equal
    (token, i, j), stand together; between tiles i and j only pairs across are compared."""
    changes = [rows[c][1:] != rows[c][:-1] for c in ("token", "i", "j")]
    at, left, start, size = by_size(np.logical_or.reduce(changes))
    if not len(size):
        return
    key, label, n, fp, tile, across, pos = (rows[c][at] for c in ("key", "label", "n", "fp", "tile", "across", "pos"))
    n, pos, planes = n.astype(np.int64), pos.astype(np.int64), planes_of(fp.view(np.uint64))
    for d in range(1, int(size[0])):
        last = np.searchsorted(-size, -d, "left") - 1
        m = int(start[last] + size[last])
        x, y = slice(0, m - d), slice(d, m)
        fits = np.zeros(m, bool)
        fits[x] = (left[x] >= d) & (label[x] != label[y]) & _near(n[x], n[y]) & _bears(n[x], n[y], pos[x], pos[y]) & ((tile[x] != tile[y]) | ~across[x])
        if not fits.any():
            continue
        found = close_pairs(planes, d, np.packbits(np.pad(fits, (0, -m % 64)), bitorder="little").view(np.uint64), radius)
        if len(found):
            yield np.minimum(key[found], key[found + d]), np.maximum(key[found], key[found + d])


def _across(groups: DataFrame, sets: DataFrame, labels: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b), a < b: pairs of a group whose components differ and whose sizes and fingerprints allow a link."""
    label = labels.select(F.col("node").alias("key"), "label")
    marked = sets.select("key", "n", "fp").join(label, "key", "left").select("key", "n", "fp", F.coalesce("label", "key").alias("label"))
    marked = materialize(marked, "marked")
    # a group whose sets are all in the component of its centre has nothing to compare
    of_centre = marked.select(F.col("key").alias("centre"), F.col("label").alias("centre_label"))
    known = groups.join(marked, "key").join(of_centre, "centre")
    open_ = known.filter("label <> centre_label").select("token").distinct()
    known = materialize(known.join(open_, "token", "left_semi").select("token", "pos", "key", "n", "fp", "label", "centre_pos", "centre"), "labelled")
    centres = known.select("token", F.col("centre_pos").alias("pos"), F.col("centre").alias("key")).distinct().join(marked, "key")
    known = known.drop("centre_pos", "centre").unionByName(centres.select("token", "pos", "key", "n", "fp", "label"))
    mixed = known.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).filter("low < high")
    tiles = mixed.select("token", F.ceil(F.col("rows") / tile).cast("int").alias("tiles"))
    rows = known.join(tiles, "token").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("token", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "key", "pos", "n", "fp", "label", "tile", (F.col("tile") != F.col("other")).alias("across"))
    # a tile by itself is a group (i, i); with another, one of rows marked as across

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_groups(batches, ["token", "i", "j"]):
            for a, b in compare_groups(some):
                for k in range(0, len(a), 50_000):
                    yield pa.RecordBatch.from_pydict({"a": a[k : k + 50_000], "b": b[k : k + 50_000]})

    n = partitions(groups.sparkSession)
    found = rows.repartition(n, "token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(of, "a long, b long").distinct()
    return materialize(found, "across")


def _similar_pairs(pairs: DataFrame, docs: DataFrame, sets: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar, by a text of each."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def of(t: str) -> np.ndarray:
            if t not in known:
                if len(known) > 500:
                    known.clear()
                known[t] = shingle_set(t)
            return known[t]

        return pd.Series([similar(of(s), of(t)) for s, t in zip(x, y)], dtype=bool)

    wanted = sets.join(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "key")
    wanted = wanted.select("key", F.col("id").alias("i"), F.col("row_hash").alias("h"))
    named = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("row_hash"), F.col(text).alias("text"))
    texts = named.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("row_hash") == F.col("h")))
    texts = materialize(texts.groupBy("key").agg(F.first("text").alias("text")), "texts")
    of = lambda c: texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(alike("text_a", "text_b")).select("a", "b")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", finish: int = FINISH_LINKS) -> DataFrame:
    """One row of docs for each component of near copies, that of the smallest doc_id (nulls last; of equal ids, the smallest
    text hash), with all its columns.

    Null, empty and wordless texts are copies of each other; texts of any length are read whole; of rows alike one stays. An empty
    table gives an empty table. Other columns may have any name.
    """
    common = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, text))  # 8 MB
    signatures = _signatures(docs, doc_id, text, common)
    rows = signatures.groupBy("key", "id", "row_hash", "fp", "n").agg(F.count("*").alias("rows"))
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row_hash", "rows")).alias("r")
    sets = materialize(rows.groupBy("key", "fp", "n").agg(least).select("key", "fp", "n", "r.id", "r.row_hash", "r.rows"), "sets")
    groups = _groups(signatures, common)
    discard(signatures)
    stars = materialize(_stars(groups, sets), "stars")
    links = materialize(_similar_pairs(stars, docs, sets, doc_id, text), "star_links")
    labels = materialize(components(links, finish), "components")
    met = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = materialize(_across(groups, sets, labels).join(met, ["a", "b"], "left_anti"), "across")
    more = materialize(_similar_pairs(across, docs, sets, doc_id, text), "more_links")
    labels = materialize(components(links.unionByName(more), finish), "components")
    kept = sets.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    first = kept.groupBy("label").agg(least).select("r.id", "r.row_hash", F.lit(1).alias("copies"), "r.rows")
    return take_rows(docs, first, F.col(doc_id), F.xxhash64(text))
