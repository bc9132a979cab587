"""Language identification: a blended-spectrum string kernel, Nystroem landmarks and one-versus-rest kernel ridge regression.

The features of a text are the character n-grams (n = 1 to 3) that occur in it, present or not. The kernel of two texts is
the number of n-grams that both hold over the geometric mean of the numbers that each holds. A bounded, class-balanced
sample of labelled texts trains the model: some are landmarks, and the regression runs on the features
``k(x, landmarks) K^(-1/2)``. As the kernel is a product of presence vectors, landmarks, map and weights fold into one table of
(n-gram, language), and a batch is scored by the product of its presence matrix with that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_remainder

#: Labelled rows to train on and landmarks among them, per language and in all (one of each language at least). The bound on what
#: the driver learns from.
TRAIN_PER_CLASS, TRAIN_ROWS = 300, 24_000
LANDMARKS_PER_CLASS, LANDMARKS = 40, 800
#: Cells of the largest matrix of the model, (n-gram, landmark) or (n-gram, language): 160 MB. Beyond it the n-grams that the fewest
#: landmarks hold are left out of the model.
MODEL_CELLS = 40_000_000
RIDGE = 0.1
ORDERS = 3
BATCH = 128
UNKNOWN = "und"

PREDICTION_TYPE = "struct<lang_pred: string, score: double>"

_FOLDED: np.ndarray | None = None


def share(per_class: int, in_all: int, classes: int) -> int:
    """Rows of each language, where there are so many languages."""
    return max(1, min(per_class, in_all // max(1, classes)))


def _letters() -> np.ndarray:
    """Code point -> itself for a letter, else a space."""
    global _FOLDED
    if _FOLDED is None:
        _FOLDED = np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.int64)
    return _FOLDED


def grams(text: str | None) -> list[np.ndarray] | None:
    """For n = 1 to 3, the distinct n-grams of the lower-cased text as sorted integers; runs of other characters than letters count
    as one space. None if the text has no letter."""
    if not text:
        return None
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[32], codes, [32]])
    space = codes == 32
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
    if len(codes) < 2:
        return None
    out, key = [np.unique(codes)], codes
    for n in range(1, ORDERS):
        key = key[:-1] << 21 | codes[n:]
        out.append(np.unique(key))
    return out


def _locate(tables: list[np.ndarray], offsets: list[int], own: list[np.ndarray]) -> np.ndarray:
    found = []
    for known, offset, g in zip(tables, offsets, own):
        if len(known):
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            found.append(offset + at[known[at] == g])
    return np.concatenate(found)


def _tables(marks: list[list[np.ndarray]], most: int) -> list[np.ndarray]:
    """The landmarks' n-grams by order, sorted; of more than ``most``, those that the most landmarks hold (then the shorter, then
    the smaller)."""
    known = [np.unique(np.concatenate([m[n] for m in marks]), return_counts=True) for n in range(ORDERS)]
    if sum(len(k) for k, _ in known) > most:
        held = np.concatenate([n for _, n in known])
        chosen = np.zeros(len(held), bool)
        chosen[np.argsort(-held, kind="stable")[:most]] = True
        cuts = np.cumsum([len(k) for k, _ in known])[:-1]
        return [k[keep] for (k, _), keep in zip(known, np.split(chosen, cuts))]
    return [k for k, _ in known]


class Model:
    """tables: the landmarks' n-grams by order; table: the regression folded through the landmarks, (n-gram, language)."""

    def __init__(self, rows: list[tuple[list[np.ndarray] | None, str]], per_class: int = LANDMARKS_PER_CLASS, ridge: float = RIDGE, cells: int = MODEL_CELLS):
        """rows: (n-grams, language), those of a language in the order in which they become landmarks."""
        rows = [(g, lang) for g, lang in rows if g is not None]
        self.langs = sorted({lang for _, lang in rows})
        if not rows:
            return
        per_class = share(per_class, LANDMARKS, len(self.langs))
        seen: dict[str, int] = {}
        chosen = []
        for i, (_, lang) in enumerate(rows):
            seen[lang] = seen.get(lang, 0) + 1
            if seen[lang] <= per_class:
                chosen.append(i)
        marks = [rows[i][0] for i in chosen]
        self.tables = _tables(marks, max(1, cells // max(len(marks), len(self.langs))))
        self.offsets = np.cumsum([0, *map(len, self.tables)]).tolist()
        presence, sizes = self._presence(marks)
        landmarks, scale = np.ascontiguousarray(presence.T), 1 / np.sqrt(sizes)
        kernel = lambda p, n: (p @ landmarks) * scale / np.sqrt(n)[:, None]
        values, vectors = np.linalg.eigh(kernel(presence, sizes))
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T
        every = np.concatenate([kernel(*self._presence([g for g, _ in rows[a : a + BATCH]])) for a in range(0, len(rows), BATCH)])
        features = np.concatenate([every @ root, np.ones((len(rows), 1))], 1)
        targets = np.array([[lang == k for k in self.langs] for _, lang in rows], np.float64)
        weights = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ targets)
        self.table, self.bias = (landmarks @ (scale[:, None] * (root @ weights[:-1]))).astype(np.float32), weights[-1]
        assert self.table.size <= max(cells, len(self.langs))

    def _presence(self, own: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        presence = np.zeros((len(own), self.offsets[-1]), np.float32)
        for row, g in zip(presence, own):
            row[_locate(self.tables, self.offsets, g)] = 1
        return presence, np.array([sum(map(len, g)) for g in own], np.float64)

    def scores(self, own: list[list[np.ndarray]]) -> np.ndarray:
        presence, sizes = self._presence(own)
        return presence @ self.table / np.sqrt(sizes)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        for a in range(0, len(texts), BATCH):
            own = [grams(t) if self.langs else None for t in texts[a : a + BATCH]]
            real = [g for g in own if g is not None]
            scores = iter(self.scores(real) if real else ())
            for g in own:
                if g is None:
                    yield UNKNOWN, 0.0
                else:
                    s = next(scores)
                    yield self.langs[int(s.argmax())], float(min(1.0, max(0.0, s.max())))


def training_rows(docs: DataFrame, lang: str, text: str, doc_id: str, per_class: int = TRAIN_PER_CLASS) -> list[tuple[list[np.ndarray] | None, str]]:
    """(n-grams, lang) of at most ``per_class`` distinct labelled rows of each language (fewer where there are many languages), those
    of the smallest hash of id and text.

    The distinct rows of each language are estimated first. A hash threshold then keeps a little over ``per_class`` of them, of
    which equal ones become one and a window takes the first, so only what is learned from is sent to the driver.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("h"), F.col(doc_id).alias("id"))
    rows = rows.filter("lang is not null and text is not null and id is not null").select("lang", "text", "h")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return []
    per_class = share(per_class, TRAIN_ROWS, len(counts))
    limit = [(k, min(2**63 - 1, int((min(1.0, (2 * per_class + 50) / max(1, n)) - 0.5) * 2**64))) for k, n in counts.items()]
    limits = docs.sparkSession.createDataFrame(limit, "lang string, most long")
    kept = rows.join(F.broadcast(limits), "lang").filter("h <= most")  # a row for each language
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    kept = kept.groupBy("lang", "h").agg(F.first("text").alias("text")).withColumn("place", place).filter(F.col("place") <= per_class)

    @F.pandas_udf("array<array<bigint>>")
    def held(column: pd.Series) -> pd.Series:
        return pd.Series([grams(t) for t in column])

    found = kept.select("lang", "place", held("text").alias("g")).toArrow()
    ordered = sorted(zip(found.column("lang").to_pylist(), found.column("place").to_pylist(), range(found.num_rows)))
    g = found.column("g").combine_chunks()
    return [(None if not g[i].is_valid else [np.asarray(x.values, np.int64) for x in g[i].values], k) for k, _, i in ordered]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_class: int = TRAIN_PER_CLASS) -> Model:
    """A model of the labelled rows.

    Rows without text, language or id are not learned from; rows alike in id, text and language are one. Every language that has a
    row is learned, however many there are. Very long texts count whole, by their distinct n-grams. An empty table, or one without
    labelled rows, gives a model that answers ``und``. Other columns are ignored, whatever their names.
    """
    return Model(training_rows(docs, lang, text, doc_id, per_class))


def predict_language(spark: SparkSession, model: Model):
    """A column function: text -> lang_pred (``und`` if null or without letters), score from 0 to 1 (0 for ``und``).

    Equal scores give the language that comes first in code point order. Texts of any length are read whole. Repeated rows are
    judged alike; an empty table gives an empty table. It reads the one column that it is given: other columns may have any name.
    """
    shared = spark.sparkContext.broadcast(model)  # MODEL_CELLS at most, asserted

    @F.pandas_udf(PREDICTION_TYPE)
    def predict(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(shared.value.predict(list(column))), columns=["lang_pred", "score"])

    return predict


def not_held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 4) != 2
