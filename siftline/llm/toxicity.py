"""Toxicity: two class-conditional Kneser-Ney models of bytes.

Toxic and ordinary training texts have interpolated Kneser-Ney models of order 4: discounted counts of the 4-grams, of each class,
and below them continuation counts of the 3-grams, of each class. Both back off to one model of the pairs of bytes, from the
continuation counts that both classes share, so a rare expression that a class has not seen is as likely in either.
The evidence of a text is the difference of the two log-likelihoods over its length; a logistic curve turns it into a
score. The curve is fitted on texts that a first count leaves out; the model then counts them too.

ORDER, SHARED, DISCOUNT and PRIOR_BYTES were chosen by four-fold cross-validation over the labelled rows that may be learned
from (crc32 remainders 1 to 4).

Counting is distributed: each task sums its n-grams before they are shuffled. The models keep every n-gram of the training
texts with its exact weights, in tables that grow with the corpus and store the keys, so no n-gram takes another's weight. The
tables are cut by the two bytes before the last into parts of PART_GRAMS 4-grams: all that one position needs is in one
part. The driver and a task hold one part at a time, so what is broadcast is bounded however many n-grams there are; the
log-likelihoods are sums over the parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, id_remainder, materialize

ORDER = 4
#: Orders up to this one are shared by the classes.
SHARED = 2
DISCOUNT = 0.75
#: Added to the number of bytes that the evidence is divided by: a few bytes tell little.
PRIOR_BYTES = 300
#: So many rows, at most, fit the score curve.
CALIBRATION_ROWS = 6_000
#: 4-grams in a part of the model, about 250 MB; one pair of bytes, 65,536 4-grams, more at most.
PART_GRAMS = 6_000_000
#: Bytes that are looked up at once.
STRETCH = 1 << 18
_FLUSH = 4_000_000
_PAIRS = 1 << 16

_LOWER = np.array([b + 32 if 65 <= b <= 90 else 32 if b < 32 else b for b in range(256)], np.uint8)


def _bytes(text: str | None) -> np.ndarray:
    """The text's bytes, A-Z lower-cased, control characters as spaces, after a run of spaces as the first context."""
    return _LOWER[np.frombuffer((" " * (ORDER - 1) + (text or "")).encode(), np.uint8)]


def _grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The 4-grams that end at each byte from the ORDER-th on, some at a time."""
    for a in range(0, len(codes) - ORDER + 1, STRETCH):
        part = codes[a : a + STRETCH + ORDER - 1].astype(np.uint64)
        key = np.zeros(len(part) - ORDER + 1, np.uint64)
        for i in range(ORDER):
            key = key << np.uint64(8) | part[i : len(part) - ORDER + 1 + i]
        yield key


class Grams:
    """An exact table of n-grams: open addressing by hash, with the keys, at most half full. It has 2 slots for each n-gram.

    Bytes are 32 or more, so 0 marks an empty slot. An n-gram that the table lacks leads to an empty slot.
    """

    def __init__(self, keys: np.ndarray):
        """keys: the distinct n-grams, sorted."""
        self.size = 2 * len(keys) + 1
        home = self._home(keys.astype(np.uint64))
        order = np.argsort(home, kind="stable")
        place = np.arange(len(keys))
        place = place + np.maximum.accumulate(home[order] - place)  # the first free slot from the own one on
        self.slots = np.zeros(max(self.size, int(place[-1]) + 1 if len(place) else 0) + 1, np.uint32)
        self.slots[place] = keys[order]

    def _home(self, key: np.ndarray) -> np.ndarray:
        h = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return (h * np.uint64(self.size) >> np.uint64(32)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each n-gram, or an empty one."""
        at = self._home(key)
        held = self.slots[at]
        left = np.flatnonzero((held != key) & (held != 0))
        while len(left):
            at[left] += 1
            held = self.slots[at[left]]
            left = left[(held != key[left]) & (held != 0)]
        return at

    def column(self, key: np.ndarray, value: np.ndarray, default: float) -> np.ndarray:
        """The values by slot, the default in all others."""
        out = np.full(len(self.slots), default, np.float32)
        out[self.find(key.astype(np.uint64))] = value
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of (toxic, 4-gram) over the task's texts."""
    known = {c: (np.empty(0, np.uint64), np.empty(0, np.int64)) for c in (0, 1)}
    waiting: dict[int, list[np.ndarray]] = {0: [], 1: []}
    size = {0: 0, 1: 0}

    def merge(c: int) -> None:
        keys, n = np.unique(np.concatenate(waiting[c]), return_counts=True)
        both, at = np.unique(np.concatenate([known[c][0], keys]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, at, np.concatenate([known[c][1], n]))
        known[c], waiting[c], size[c] = (both, total), [], 0

    def rows(c: int) -> Iterator[pa.RecordBatch]:
        keys, n = known[c]
        known[c] = (np.empty(0, np.uint64), np.empty(0, np.int64))
        for i in range(0, len(keys), 100_000):
            k = keys[i : i + 100_000]
            yield pa.RecordBatch.from_pydict({"toxic": np.full(len(k), c, np.int32), "gram": k.astype(np.int64), "n": n[i : i + 100_000]}, pa.schema([("toxic", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())]))

    for batch in batches:
        for text, c in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            codes = _bytes(text)
            for key in _grams(codes):
                waiting[c].append(key)
                size[c] += len(key)
                if size[c] >= _FLUSH:
                    merge(c)
                    if len(known[c][0]) > _FLUSH:  # bounded memory: hand over what has gathered
                        yield from rows(c)
    for c in (0, 1):
        if waiting[c]:
            merge(c)
        yield from rows(c)


@dataclass
class Part:
    """What the positions need whose two bytes before the last are from low up to below high.

    four, three, contexts: tables of n-grams (contexts: of the three bytes before the last), each with a column for each class: the
    discounted share of an n-gram in its context, or the share of the context that is backed off. pair_rest: that of the
    contexts of two bytes; shared: the probabilities of the pairs of bytes.
    """

    low: int
    high: int
    four: tuple[Grams, list[np.ndarray]]
    three: tuple[Grams, list[np.ndarray]]
    contexts: tuple[Grams, list[np.ndarray]]
    pair_rest: list[np.ndarray]
    shared: np.ndarray

    def log_ratio(self, four: np.ndarray) -> np.ndarray:
        """log P(last byte | toxic) - log P(last byte | ordinary) of each 4-gram; 0 for those of other parts."""
        pair = (four >> np.uint64(8) & np.uint64(_PAIRS - 1)).astype(np.int64)
        own = slice(None) if self.high - self.low == _PAIRS else np.flatnonzero((pair >= self.low) & (pair < self.high))
        key, pair = four[own], pair[own]
        base = self.shared[(key & np.uint64(_PAIRS - 1)).astype(np.int64)]
        at3, at4, before = self.three[0].find(key & np.uint64((1 << 24) - 1)), self.four[0].find(key), self.contexts[0].find(key >> np.uint64(8))
        p = []
        for c in (0, 1):
            three = self.three[1][c][at3] + self.pair_rest[c][pair] * base
            p.append(self.four[1][c][at4] + self.contexts[1][c][before] * three)
        out = np.zeros(len(four))
        out[own] = np.log(p[1] / p[0], dtype=np.float64)
        return out

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """The sum over the bytes of each text. Short texts are looked up together."""
        out, first, size = np.zeros(len(texts)), 0, 0
        for i, text in enumerate(texts):
            size += len(text) if text else 0
            if size >= STRETCH or i == len(texts) - 1:
                codes = [_bytes(t) for t in texts[first : i + 1]]
                owner = np.repeat(np.arange(first, i + 1), [len(c) for c in codes])[ORDER - 1 :]
                real = np.concatenate([np.arange(len(c)) >= ORDER - 1 for c in codes])[ORDER - 1 :]  # not the spaces between texts
                at = 0
                for key in _grams(np.concatenate(codes)):
                    here = slice(at, at + len(key))
                    out += np.bincount(owner[here], self.log_ratio(key) * real[here], len(texts))
                    at += len(key)
                first, size = i + 1, 0
        return out


@dataclass
class Model:
    """The parts, broadcast, and the score curve."""

    parts: list[Broadcast[Part]]
    slope: float = 1.0
    shift: float = 0.0

    def evidence(self, text: str | None) -> float:
        """log P(text | toxic) - log P(text | ordinary), over the number of bytes and PRIOR_BYTES."""
        return sum(float(p.value.totals([text])[0]) for p in self.parts) / (len((text or "").encode()) + PRIOR_BYTES)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.evidence(text) + self.shift, -60, 60))))

    def forget(self) -> None:
        for p in self.parts:
            p.destroy()


def count_grams(labelled: DataFrame) -> DataFrame:
    """(toxic, gram, n) of all rows (text, toxic): the whole training corpus."""
    counted = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_count, "toxic int, gram long, n long")
    return counted.groupBy("toxic", "gram").agg(F.sum("n").alias("n"))


def _tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, c0, c1): weights, 0 where a class lacks the n-gram; (context, c0, c1): backed-off shares, 1 where it lacks the context."""
    counts = counts.withColumn("context", F.shiftright("gram", 8))
    contexts = counts.groupBy("toxic", "context").agg(F.sum("n").alias("total"), F.sum(F.least(F.col("n"), F.lit(DISCOUNT))).alias("cut"))
    weight = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")
    by_class = lambda c, x, default: F.coalesce(F.max(F.when(F.col("toxic") == c, x)), F.lit(default)).cast("float").alias(f"c{c}")
    weights = counts.join(contexts, ["toxic", "context"]).groupBy("gram").agg(*[by_class(c, weight, 0.0) for c in (0, 1)])
    rests = contexts.groupBy("context").agg(*[by_class(c, F.col("cut") / F.col("total"), 1.0) for c in (0, 1)])
    return materialize(weights, "weights"), materialize(rests, "rests")


def _shared(threes: DataFrame) -> np.ndarray:
    """The probabilities of the last of each pair of bytes, from the continuation counts of both classes. 65,536 rows at most."""
    pairs = threes.select("gram").distinct().groupBy(F.col("gram").bitwiseAND(F.lit(_PAIRS - 1)).alias("pair")).agg(F.count("*").alias("n"))
    n = np.zeros(_PAIRS)
    for r in pairs.collect():
        n[r["pair"]] = r["n"]
    n = n.reshape(256, 256)
    base = 1.0 + (n > 0).sum(0)
    base /= base.sum()
    total = n.sum(1, keepdims=True)
    own = (np.maximum(n - DISCOUNT, 0) + np.minimum(n, DISCOUNT).sum(1, keepdims=True) * base) / np.maximum(total, 1)
    return np.where(total > 0, own, base).astype(np.float32).reshape(-1)


def _table(rows: pa.Table, key: str, default: float) -> tuple[Grams, list[np.ndarray]]:
    keys = np.sort(rows.column(key).to_numpy())
    grams = Grams(keys)
    return grams, [grams.column(rows.column(key).to_numpy(), rows.column(f"c{c}").to_numpy(), default) for c in (0, 1)]


def _fold(counts: DataFrame) -> Model:
    context = counts.sparkSession.sparkContext
    fours, before = _tables(counts)
    # in how many contexts does each 3-gram occur
    last3 = F.col("gram").bitwiseAND(F.lit((1 << 24) - 1)).alias("gram")
    three_counts = materialize(counts.select("toxic", last3).groupBy("toxic", "gram").agg(F.count("*").alias("n")), "continuations")
    threes, pairs = _tables(three_counts)
    shared = _shared(three_counts)
    pair_rest = [np.ones(_PAIRS, np.float32) for _ in (0, 1)]
    for r in pairs.collect():  # 65,536 rows at most
        for c in (0, 1):
            pair_rest[c][r["context"]] = r[f"c{c}"]
    pair_of = lambda c, shift: F.shiftright(c, shift).bitwiseAND(F.lit(_PAIRS - 1))
    held = np.zeros(_PAIRS, np.int64)
    for r in fours.groupBy(pair_of("gram", 8).alias("pair")).count().collect():
        held[r["pair"]] = r["count"]
    edges = np.flatnonzero(np.diff(np.cumsum(held) // PART_GRAMS, prepend=0)).tolist()
    parts = []
    for low, high in zip([0, *edges], [*edges, _PAIRS]):
        if low == high:
            continue
        rows = lambda df, column, shift: df.filter((pair_of(column, shift) >= low) & (pair_of(column, shift) < high)).toArrow()  # noqa: B023, E731
        part = Part(low, high, _table(rows(fours, "gram", 8), "gram", 0), _table(rows(threes, "gram", 8), "gram", 0), _table(rows(before, "context", 0), "context", 1), pair_rest, shared)
        parts.append(context.broadcast(part))
    for done in (fours, before, threes, pairs, three_counts):
        discard(done)
    return Model(parts)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    A first model counts those of remainders 2 to 4, and remainder 1 fits its score curve (a bounded sample, by the hash of the
    id). The model that is returned counts all of them and takes over that curve. Null ids, texts and labels are not learned
    from; an id with both labels counts as toxic. Repeated rows count as often as they stand, and once for the curve. Texts of any
    length are counted whole. Without rows of both classes to fit the curve (an empty table among them), every score is 0.
    Other columns are ignored, whatever their names.
    """
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("toxic")).filter("toxic in (0, 1) and id is not null")
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    rest = id_remainder(F.col("id"), 5)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text is not null")
    # labels grow with the corpus: they meet the texts by a shuffle at any size
    count = lambda part: materialize(count_grams(rows.filter(part).join(marks.filter(part).hint("merge"), "id")), "grams")
    counts = count(rest > 1)
    model = _fold(counts)
    keen = marks.filter(rest == 1)
    share = min(1.0, CALIBRATION_ROWS / max(1, keen.count()))
    keen = keen.filter(F.xxhash64("id") <= F.lit(min(2**63 - 1, int((share - 0.5) * 2**64))))
    slope, shift = calibrate(model, rows.filter(rest == 1).join(F.broadcast(keen), "id"))  # about CALIBRATION_ROWS pairs of numbers
    model.forget()
    held = count(rest == 1)
    both = materialize(counts.unionByName(held).groupBy("toxic", "gram").agg(F.sum("n").alias("n")), "all_grams")
    whole = _fold(both)
    for done in (counts, held, both):
        discard(done)
    whole.slope, whole.shift = slope, shift
    return whole


def calibrate(model: Model, rows: DataFrame) -> tuple[float, float]:
    """Slope and shift of the logistic curve, fitted on at most CALIBRATION_ROWS distinct rows (id, text, toxic) that were not
    counted, those of the smallest hash."""
    found = with_evidence(rows, model).select("evidence", "row.toxic", F.xxhash64("row.id", "row.text").alias("h")).distinct()
    found = found.orderBy("h").limit(CALIBRATION_ROWS).collect()
    return _logistic(np.array([r.evidence for r in found]), np.array([r.toxic for r in found], float))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and shift of the curve by Newton's method; a flat 0 without both classes."""
    if not len(y) or y.min() == y.max():
        return 0.0, -60.0
    low, middle, high = np.percentile(x, [25, 50, 75])
    scale = max(float(high - low), 1e-6)
    a = np.stack([np.clip((x - middle) / scale, -20, 20), np.ones(len(x))], 1)  # far outliers must not set the scale
    loss = lambda v: float(np.mean(np.logaddexp(0, a @ v) - y * (a @ v)) + ridge / 2 * v[0] ** 2)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        gradient = a.T @ (p - y) / len(y) + ridge * beta * [1, 0]
        hessian = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag([ridge, 1e-9])
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
    return float(beta[0] / scale), float(beta[1] - beta[0] * middle / scale)


def with_evidence(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, evidence): each row of docs as a struct of all its columns, whatever their names, and the evidence of its text.

    A model of one part is a projection. With more, the corpus is read once for each part, which keeps a number for each distinct
    text; a part is in memory by itself.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")

    def total(part: Broadcast[Part]) -> Column:
        @F.pandas_udf("double")
        def of(column: pd.Series) -> pd.Series:
            return pd.Series(part.value.totals(list(column)), dtype="float64")

        return of(F.col(text))

    n_bytes = lambda c: F.coalesce(F.octet_length(c), F.lit(0)) + PRIOR_BYTES
    if len(model.parts) == 1:
        return docs.select(row, (total(model.parts[0]) / n_bytes(F.col(text))).alias("evidence"))
    name = lambda c: F.struct(F.xxhash64(F.lit(1), c).alias("a"), F.xxhash64(F.lit(2), c).alias("b"))
    found = None
    for i, part in enumerate(model.parts):
        one = docs.select(name(F.col(text)).alias("name"), total(part).alias("total")).groupBy("name").agg(F.first("total").alias("total"))
        one = materialize(one.select("name", F.struct(F.lit(i).alias("part"), "total").alias("t")), "evidence")
        found = one if found is None else found.unionByName(one)
    # added up in the order of the parts, so reruns agree to the last bit
    sums = found.groupBy("name").agg(F.aggregate(F.array_sort(F.collect_list("t")), F.lit(0.0), lambda a, x: a + x["total"]).alias("total"))
    marked = docs.select(row, name(F.col(text)).alias("name"), n_bytes(F.col(text)).alias("n"))
    return marked.join(sums, "name").select("row", (F.col("total") / F.col("n")).alias("evidence"))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, score): each row of docs as a struct of all its columns, whatever their names, and its score from 0 to 1.

    Null and empty texts score by the curve's value at no evidence. Texts of any length are read whole. Repeated rows score alike;
    an empty table gives an empty table.
    """
    x = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("evidence") * model.slope + model.shift))
    return with_evidence(docs, model, text).select("row", (1 / (1 + F.exp(-x))).alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 5) == 0, F.lit(False))
