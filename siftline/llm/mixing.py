"""Mixing sources to target weights: pivotal dependent rounding of copy counts.

A source takes ``target / size`` copies of each of its documents: a whole number for all, and one more with a
probability. The probabilities are rounded in pairs. Of two open documents one gives mass and the other takes it, in
proportion to their sizes, in the one direction or the other, so that one becomes 0 or 1; the direction is drawn so
that expectations stay, and the words expected of the pair stay exactly.

Long documents come first. They fall into bands by their share of the source's target. The documents of a source and band are dealt
out to leaves of about ``leaf_docs`` by the hash of their id; each leaf leaves one open document at most, and up to ``fan_in`` of these
meet at each level of a reduction tree, until one is left. It is paired once more, with all shorter documents of the source as one
partner: they have one probability in common, which moves a little for all of them. So what stays open at the end is a document of the
last band, and a source misses its target by less than that, unless its shorter documents are too few to make up for a long one.
Draws follow the hashes of the two documents, so reruns agree however the work is spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, scratch, take_rows

LEAF_DOCS = 512
FAN_IN = 256
#: The weights of the sources, by code point, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives its own size so often at most.
MOST = 3
#: Documents above these shares of their source's target are rounded before shorter ones.
BANDS = (0.05, 0.02, 0.01, 0.005, 0.002)
_EPS = 1e-12


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _row_hash(text: Column, source: Column) -> Column:
    return F.xxhash64(text, source.cast("string"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) of each source of (source, source_size, n_docs).

    Sources in code point order, null last, weigh ``weights``, repeating, and share all sizes; a target stops at ``most``
    times its source's size and the excess is shared anew by weight, until none is above. All is computed on the
    distributed table of sources; one row of sums a round comes to the driver.
    """
    spark = sizes.sparkSession
    n = partitions(spark)
    ranged = sizes.repartitionByRange(n, F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    marked = materialize(ranged.withColumn("mid", F.monotonically_increasing_id()), "sources")
    counts = {r.part: r["count"] for r in marked.groupBy(F.shiftright("mid", 33).alias("part")).count().collect()}
    before, starts = 0, {}
    for part in sorted(counts):
        starts[part] = before
        before += counts[part]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.shiftright("mid", 33)) if starts else F.lit(0)
    place = (start + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place + 1).cast("int"))
    open_ = marked.select("source", "source_size", "n_docs", weight.alias("weight"), F.lit(False).alias("full"))
    while True:
        left = open_.agg(F.sum("source_size").alias("total"), F.sum(F.when(F.col("full"), F.col("source_size") * most)).alias("given"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight"), F.count_if("full").alias("n")).first()
        share = F.lit(float((left.total or 0) - (left.given or 0))) * F.col("weight") / F.lit(float(left.weight or 1))
        more = open_.withColumn("full", F.col("full") | (share > F.col("source_size") * most))
        if more.filter("full").count() == left.n:
            break
        done, open_ = open_, materialize(more, "weights")
        discard(done)
    return open_.select("source", "source_size", "n_docs", F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def _uniform(a: int, b: int) -> float:
    """A draw from (0, 1) that two hashes fix, in either order."""
    x = ((a ^ (b * 0x9E3779B97F4A7C15)) + a + b) & (2**64 - 1)
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 30)) * k) & (2**64 - 1)
    return ((x ^ (x >> 31)) + 0.5) / 2.0**64


def pivot(p: float, size_p: int, q: float, size_q: int, draw: float) -> tuple[float, float]:
    """Two open probabilities after one transfer: one of them is 0 or 1, and p * size_p + q * size_q is what it was."""
    ratio = size_q / size_p
    up, down = min(1 - p, ratio * q), min(p, ratio * (1 - q))
    if draw * (up + down) < down:  # up with probability down / (up + down): the expectations stay
        p, q = p + up, q - up / ratio
    else:
        p, q = p - down, q + down / ratio
    settle = lambda x: 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
    return settle(p), settle(q)


def _round_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order (source, node, ...): each group ends with one open row at most. Rows that are not open pass."""
    schema, group, held = None, None, None
    for batch in batches:
        schema = batch.schema
        source, node, h, chance, size = (schema.get_field_index(c) for c in ("source", "node", "h", "chance", "size"))
        p = batch.column(chance)
        is_open = pc.and_(pc.and_(pc.greater(p, 0.0), pc.less(p, 1.0)), pc.greater(batch.column(size), 0))
        yield batch.filter(pc.invert(is_open))
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.filter(is_open).columns)):
            if (row[source], row[node]) != group:
                if held:
                    out.append(tuple(held))
                group, held = (row[source], row[node]), None
            row = list(row)
            if held is None:
                held = row
            else:
                held[chance], row[chance] = pivot(held[chance], held[size], row[chance], row[size], _uniform(held[h], row[h]))
                out += [tuple(x) for x in (held, row) if x[chance] in (0, 1)]
                held = next((x for x in (held, row) if 0 < x[chance] < 1), None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], names=schema.names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(held, schema)], names=schema.names)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
    leaf_docs: int = LEAF_DOCS, fan_in: int = FAN_IN, bands: tuple[float, ...] = BANDS,
) -> DataFrame:
    """Per document: doc_id, source, row_hash (of text and source), size (words), source_size, target (its source's), copies, taken
    (copies * size).

    Null and empty texts have size 0 and are never taken; a source without words has target 0. A null source is a source
    of its own, the last. Repeated rows, and rows that share an id, are rounded each by itself; rows alike in id, source
    and text are interchangeable. An empty table gives an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), _row_hash(F.col(text), F.col(source)).alias("row_hash"))
    sized = materialize(rows.withColumn("h", F.xxhash64("id", "row_hash", "size")), "sizes")
    share = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most), "targets")
    steps = range(len(bands) + 1)
    named = lambda df: df.withColumnRenamed("source", "s")
    meet = lambda df, by: df.join(named(by), df["source"].eqNullSafe(F.col("s"))).drop("s")
    band = F.lit(len(bands))
    for i in reversed(range(len(bands))):
        band = F.when(F.col("size") > F.lit(bands[i]) * F.col("target"), i).otherwise(band)
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    banded = meet(sized, share).select("id", "source", "size", "row_hash", "h", "source_size", "target", want.alias("want"), F.floor(want + _EPS).cast("long").alias("whole"), band.alias("band"))
    banded = materialize(banded, "banded")
    # one row a source: its probability, the leaves of each band, and the words of all lower bands
    leaves = lambda i: F.ceil(F.count_if((F.col("band") == i) & (F.col("size") > 0)) / leaf_docs).cast("long").alias(f"leaves{i}")
    below = lambda i: F.sum(F.when(F.col("band") > i, F.col("size")).otherwise(0)).alias(f"below{i}")
    chance = F.greatest(F.lit(0.0), F.max(F.col("want") - F.col("whole"))).alias("chance")
    state = materialize(banded.groupBy("source").agg(chance, *map(leaves, steps), *map(below, steps)), "chances")
    most_leaves = state.agg(*[F.max(f"leaves{i}") for i in steps]).first()
    is_open = (F.col("chance") > 0) & (F.col("chance") < 1) & (F.col("size") > 0)
    fields = ["id", "source", "size", "row_hash", "h", "source_size", "target", "whole", "chance", "node"]
    wordless = banded.filter("size = 0").withColumns({"whole": F.lit(0).cast("long"), "chance": F.lit(0.0), "node": F.lit(0).cast("long")}).select(*fields)
    rounded: list[str] = []

    def settle(df: DataFrame, last: bool) -> DataFrame:
        """The rows of df, rounded; a document that has no open partner left at the last level gets a draw of its own."""
        sorted_ = df.repartition(n, "source", "node").sortWithinPartitions("source", "node", F.col("whole") < 0, "h", "id", "size", "row_hash")
        out = sorted_.mapInArrow(_round_groups, df.schema)
        if last:
            lot = (F.xxhash64("h", F.lit("last")).cast("double") / 2.0**64) + 0.5
            out = out.withColumn("chance", F.when(is_open & (F.col("whole") >= 0), F.when(lot < F.col("chance"), 1.0).otherwise(0.0)).otherwise(F.col("chance")))
        rounded.append(scratch(spark, "rounded"))
        out.write.parquet(rounded[-1])
        return spark.read.schema(df.schema).parquet(rounded[-1])

    chances = state.select("source", "chance")
    for i in steps:
        width = most_leaves[i] or 0
        if not width:
            continue
        node = F.when(F.col("leaves") > 1, F.pmod(F.xxhash64("h"), F.col("leaves"))).otherwise(F.lit(0)).cast("long").alias("node")
        now = meet(state.drop("chance"), chances).select("source", "chance", F.col(f"leaves{i}").alias("leaves"), F.col(f"below{i}").alias("below"))
        level = meet(banded.filter((F.col("band") == i) & (F.col("size") > 0)), now.drop("below")).select(*fields[:-1], node)
        while True:
            last = width <= 1
            if last and i < len(bands):
                # all shorter documents of a source, as one partner of one probability, after its own
                rest = now.select(
                    F.lit(None).cast(level.schema["id"].dataType).alias("id"), "source", F.col("below").alias("size"), F.lit(0).cast("long").alias("row_hash"), F.xxhash64("source", F.lit(i)).alias("h"),
                    F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(-1).cast("long").alias("whole"), "chance", F.lit(0).cast("long").alias("node"),
                )
                level = level.unionByName(rest)
            level = settle(level, last)
            if last:
                break
            width = -(-width // fan_in)
            level = level.filter(is_open).withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
        if i < len(bands):
            chances = level.filter("whole = -1").select("source", "chance")
    # a document stands closed in the table of one level alone
    out = wordless
    if rounded:
        out = out.unionByName(spark.read.schema(level.schema).parquet(*rounded).filter(~is_open & (F.col("whole") >= 0)))
    copies = (F.col("whole") + F.col("chance").cast("long")).alias("copies")
    return out.select(F.col("id").alias(doc_id), "source", "row_hash", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, each as often as mixed takes it. Rows alike in id, source and text share their copies."""
    plan = mixed.groupBy(F.col(doc_id).alias("id"), "row_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    return take_rows(docs, plan, F.col(doc_id), _row_hash(F.col(text), F.col(source)))
