"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison.

Two fingerprints at ``radius`` or fewer differing bits agree on ``blocks - radius`` of ``blocks`` blocks of bits. Each
distinct fingerprint therefore goes to one group for each choice of blocks (10 choices of 3 out of 5 at radius 2), and any
link shows in the group of the blocks on which both agree. As 3 of 5 blocks are 38 bits or more, unrelated fingerprints
do not meet, and a large family of near copies spreads over many groups: those in one group differ in two blocks at
most. Exact copies meet only once, as one fingerprint.

Within a partition the fingerprints stand in group order and their 64 bit planes are stored vertically, 64 fingerprints a
word. Comparing each with its d-th follower in the group is one shift of the planes and an XOR; a carry-save counter of as many
bits as the radius needs and a sticky overflow adds up the planes for all fingerprints at once, and words in which all 64
are above the radius are abandoned. A link counts only in the first choice of blocks that shows it.

A group of more than GROUP fingerprints is cut once more in the same way, by choices among the blocks of its remaining bits. What
then agrees leaves 11 bits, so no group holds more than 2,048 distinct fingerprints, whatever the data.

Links become components by contraction: each round every fingerprint takes the neighbour of the smallest (salted) hash,
and links between different labels remain. What is left of at most ``finish`` links is closed by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, take_rows

RADIUS = 2
SHINGLE_WORDS = 3
#: Links that one task may close, about 16 MB.
FINISH_LINKS = 1_000_000
#: Fingerprints in a group beyond which it is cut again.
GROUP = 4096
#: Rows that are compared together: whole groups of about so many.
ROWS = 400_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def shingle_hashes(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of k words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, joined by spaces. Fewer words:
    the whole sequence; none: nothing."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - k + 1)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], stop[: n - 1] + 1]).tolist()
    last = stop[len(words) - n :].tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last)), np.uint64, n)


def fingerprint_from(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes. Unsigned."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[a : a + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: str | None, k: int = SHINGLE_WORDS) -> int:
    return fingerprint_from(shingle_hashes(text, k))


def fingerprint(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed 64-bit integer. Null, empty and wordless texts: 0."""

    @F.pandas_udf("long")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, k) for t in column], np.uint64).view(np.int64))

    return of(text)


def block_masks(blocks: int, radius: int) -> list[int]:
    """The bits of each choice of blocks - radius blocks, unsigned."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 rows of bits, 64 values a word, with a word of zeros behind."""
    padded = np.zeros((len(values) + 63) // 64 * 64 + 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _shifted(planes: np.ndarray, d: int, n: int) -> np.ndarray:
    """Words 0..n of the planes moved down by d values."""
    words, bits = divmod(d, 64)
    width = planes.shape[-1]
    take = lambda k: np.pad(planes[..., k : min(k + n, width)], [(0, 0)] * (planes.ndim - 1) + [(0, max(0, n - max(0, width - k)))])
    low = take(words)
    return low >> np.uint64(bits) | take(words + 1) << np.uint64(64 - bits) if bits else low


def _over(counter: list[np.ndarray], overflow: np.ndarray, radius: int) -> np.ndarray:
    """Where the count, of bits from the lowest up, is above the radius."""
    above, equal = overflow, ~np.zeros_like(overflow)
    for i in range(len(counter) - 1, -1, -1):
        if radius >> i & 1:
            equal = equal & counter[i]
        else:
            above, equal = above | equal & counter[i], equal & ~counter[i]
    return above


def near_words(planes: Callable[[int, slice | np.ndarray], np.ndarray], valid: np.ndarray, radius: int) -> np.ndarray:
    """The positions, among the bits of ``valid``, whose planes of differing bits hold radius or fewer ones. planes(k, at): the
    k-th eight planes, of the words ``at``."""
    n = len(valid)
    alive = np.flatnonzero(valid)
    counter, overflow = [np.zeros(n, np.uint64) for _ in range(max(1, radius.bit_length()))], np.zeros(n, np.uint64)
    for k in range(0, 64, 8):
        at = slice(None) if len(alive) > n // 2 else alive
        own, lost = [c[at] for c in counter], overflow[at]
        for carry in planes(k, at):  # carry-save: what overflows one bit is added to the next
            for i, bit in enumerate(own):
                own[i], carry = bit ^ carry, bit & carry
            lost = lost | carry
        for c, x in zip(counter, own):
            c[at] = x
        overflow[at] = _over(own, lost, radius)  # above the radius once, above it for good
        alive = np.flatnonzero(valid & ~overflow)
        if not len(alive):
            return alive
    return np.flatnonzero(np.unpackbits((valid & ~overflow).view(np.uint8), bitorder="little"))


def close_pairs(planes: np.ndarray, d: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """The positions i, among the bits of ``valid``, whose value differs from that at i + d in radius or fewer bits."""
    n, other = len(valid), _shifted(planes, d, len(valid))
    return near_words(lambda k, at: planes[k : k + 8, :n][:, at] ^ other[k : k + 8][:, at], valid, radius)


def within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Do a[i] and b[i] differ in radius or fewer bits?"""
    out = np.zeros(len(a), bool)
    if len(a):
        planes = planes_of(a ^ b)
        valid = np.packbits(np.pad(np.ones(len(a), np.uint8), (0, -len(a) % 64)), bitorder="little").view(np.uint64)
        out[near_words(lambda k, at: planes[k : k + 8, : len(valid)][:, at], valid, radius)] = True
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[dict[str, np.ndarray]]:
    """The columns of rows that come in group order, some whole groups at a time: ``rows`` rows or a little more, and never the
    partition as a whole."""
    held: list[pa.RecordBatch] = []

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        return {c: np.ascontiguousarray(table.column(c).to_numpy()) for c in table.column_names}

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            change = np.zeros(table.num_rows - 1, bool)
            for c in keys:
                column = table.column(c).to_numpy()
                change |= column[1:] != column[:-1]
            if change.any():
                cut = int(np.flatnonzero(change)[-1]) + 1
                yield columns(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield columns(pa.Table.from_batches(held))


def by_size(change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the groups of two or more, the largest group first, so that at distance d only a prefix is left. change: which rows
    begin a group, but the first. Returns their positions, how many followers each has in its group, and starts and sizes
    of the groups among them."""
    first = np.concatenate([[0], np.flatnonzero(change) + 1])
    size = np.diff(np.concatenate([first, [len(change) + 1]]))
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 1]
    first, size = first[order], size[order]
    start = np.cumsum(size) - size
    at = np.repeat(first - start, size) + np.arange(size.sum())
    return at, np.repeat(start + size, size) - np.arange(size.sum()) - 1, start, size


def _close_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]; a label is the smallest position of its component."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels != (up := labels[labels])).any():
            labels = up


def link_sorted(choice: np.ndarray, key: np.ndarray, value: np.ndarray, masks: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, representative) of groups of equal (choice, key) that stand together; a tree for each component."""
    if not len(value):
        return value, value
    at, left, start, size = by_size((choice[1:] != choice[:-1]) | (key[1:] != key[:-1]))
    if not len(size):
        return value[:0], value[:0]
    choice, value = choice[at] % len(masks), value[at]
    planes = planes_of(value.view(np.uint64))
    labels = np.arange(len(value))
    unsigned, chosen = value.view(np.uint64), np.array(masks, np.uint64)
    for d in range(1, int(size[0])):
        last = np.searchsorted(-size, -d, "left") - 1
        m = int(start[last] + size[last])
        valid = np.packbits(np.pad(left[:m] >= d, (0, -m % 64)), bitorder="little").view(np.uint64)
        i = close_pairs(planes, d, valid, radius)
        if len(i):
            differing = unsigned[i] ^ unsigned[i + d]
            earlier = np.zeros(len(i), bool)
            for t, mask in enumerate(chosen):
                earlier |= (differing & mask == 0) & (choice[i] > t)
            labels = _close_labels(labels, i[~earlier], i[~earlier] + d)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return value[moved], value[labels[moved]]


def _finer(mask: int, blocks: int, radius: int) -> list[int]:
    """The bits of the mask with each choice of blocks - radius blocks of the others."""
    rest = [b for b in range(64) if not mask >> b & 1]
    edges = [len(rest) * i // blocks for i in range(blocks + 1)]
    block = [sum(1 << b for b in rest[x:y]) for x, y in zip(edges, edges[1:])]
    return [mask | sum(c) for c in combinations(block, blocks - radius)]


def links(fingerprints: DataFrame, radius: int = RADIUS, column: str = "fp", group: int = GROUP) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs within the radius (3 at most)."""
    masks = block_masks(radius + 3, radius)
    mask = lambda value, m: value.bitwiseAND(F.lit(_signed(m)))
    spread = fingerprints.select(F.col(column).alias("value"), F.posexplode(F.array(*[mask(F.col(column), m) for m in masks])).alias("choice", "key"))
    n = partitions(fingerprints.sparkSession)
    crowded = materialize(spread.groupBy("choice", "key").count().filter(F.col("count") > group).select("choice", "key"), "crowded")
    if not crowded.isEmpty():
        finer = F.lit(None)
        for i, m in enumerate(masks):
            finer = F.when(F.col("choice") == i, F.array(*[mask(F.col("value"), x) for x in _finer(m, radius + 3, radius)])).otherwise(finer)
        cut = spread.join(crowded, ["choice", "key"], "left_semi").select("value", "choice", F.posexplode(finer).alias("sub", "key"))
        cut = cut.select("value", (F.col("choice") + len(masks) * (F.col("sub") + 1)).alias("choice"), "key")
        spread = spread.join(crowded, ["choice", "key"], "left_anti").select("value", "choice", "key").unionByName(cut)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["choice", "key"]):
            a, b = link_sorted(rows["choice"], rows["key"], rows["value"], masks, radius)
            for i in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_pydict({"a": a[i : i + 50_000], "b": b[i : i + 50_000]})

    return spread.repartition(n, "choice", "key").sortWithinPartitions("choice", "key").mapInArrow(link, "a long, b long")


def _close_in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not pairs:
        return
    a, b = (np.concatenate(x) for x in zip(*pairs))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    labels = _close_labels(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    yield pa.RecordBatch.from_pydict({"node": nodes, "label": nodes[labels]})


def components(edges: DataFrame, finish: int = FINISH_LINKS) -> DataFrame:
    """(node, label) for every node of the edges (a, b); nodes share a label if they are connected.

    Empty edges give no rows; repeated edges and loops change nothing.
    """
    ordered = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, rounds = materialize(ordered(edges), "links"), []
    while left.count() > finish:
        salt = F.lit(len(rounds))
        rank = lambda c: F.struct(F.xxhash64(c, salt).alias("h"), F.col(c).alias("v"))
        both = left.union(left.select("b", "a"))
        label = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
        label = label.select("node", F.least("m", F.struct(F.xxhash64("node", salt).alias("h"), F.col("node").alias("v")))["v"].alias("label"))
        rounds.append(label := materialize(label, "labels"))
        of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        contracted = left.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
        done, left = left, materialize(ordered(contracted), "links")
        discard(done)
    closed = left.repartition(1).mapInArrow(_close_in_one_task, "node long, label long")
    for label in reversed(rounds):
        up = materialize(closed, "closed").select(F.col("node").alias("label"), F.col("label").alias("top"))
        closed = label.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return closed


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, finish: int = FINISH_LINKS) -> DataFrame:
    """Per document: doc_id, fp (signed 64-bit), component_id: the smallest doc_id reachable over links of ``radius`` or
    fewer (at most 3) differing bits, the document's own included.

    Null, empty and wordless texts have fingerprint 0 and are linked like any other. Repeated rows give a row each. A null
    doc_id is kept and is never the smallest, unless its component has no other (then component_id is null). Ties cannot
    arise. An empty table gives an empty table; other columns are ignored.
    """
    return _components_of(_marked(docs, doc_id, text, shingle_words), radius, finish).select(F.col("id").alias(doc_id), "fp", "component_id")


def _marked(docs: DataFrame, doc_id: str, text: str, shingle_words: int) -> DataFrame:
    return materialize(docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("row_hash"), fingerprint(F.col(text), shingle_words).alias("fp")), "fingerprints")


def _components_of(marked: DataFrame, radius: int, finish: int) -> DataFrame:
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    top = materialize(components(links(distinct, radius), finish), "components")
    label = distinct.join(top.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = label.groupBy("label").agg(F.min("least").alias("component_id"))
    found = materialize(label.join(least, "label").select("fp", "label", "component_id"), "found")
    return marked.join(found, "fp")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, finish: int = FINISH_LINKS) -> DataFrame:
    """One row of docs for each component, that of the smallest doc_id (nulls last; of equal ids, the smallest text hash), with
    all its columns."""
    found = _components_of(_marked(docs, doc_id, text, shingle_words), radius, finish)
    rows = found.groupBy("label", "id", "row_hash").agg(F.count("*").alias("rows"))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row_hash", "rows")).alias("r"))
    return take_rows(docs, first.select("r.id", "r.row_hash", F.lit(1).alias("copies"), "r.rows"), F.col(doc_id), F.xxhash64(text))


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
