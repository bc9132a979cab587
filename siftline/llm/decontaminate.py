"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A benchmark item gives its windows of 13 consecutive words; an item of fewer words, but not none, is one window. The
symbols of the search are words, so a pattern of 13 words has length 13. Patterns are grouped by length. For each
length the compiled table holds

* SHIFT, by the hash of a block of two words: how far the window may move on, as no pattern has that block nearer to its end;
* buckets of the patterns by the hash of their last block, for blocks whose shift is 0;
* the patterns themselves, compared word for word with the text, which alone confirms an occurrence.

Most positions are never looked at: a block that no pattern holds moves the window on by 12 words. The words of a batch of
documents form one sequence, cut into lanes that are searched in lockstep with numpy; a word that no pattern holds
stands between documents, so no window crosses them.

The benchmark is compiled in blocks of at most ``max_block_words`` words; longer items are cut into pieces that share 12 words.
With one block the search is a projection without any shuffle. With more, blocks are compiled, broadcast, searched and destroyed one
after the other, and only hits are kept of each, so neither the driver nor a task holds more than one block. Blocks may
each read the corpus once, as each looks at a benchmark of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW_WORDS = 13
#: A block keeps at most so many benchmark words; with all tables that is about 30 MB.
MAX_BLOCK_WORDS = 250_000
LANE = 256
#: Documents searched as one sequence hold about so many bytes.
CHUNK_BYTES = 4_000_000
PAIRS = 1_000_000
TABLE_BITS = 20

#: A-Z to a-z; all other ASCII but digits and a-z to a space. Bytes from 0x80 up belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: A word before A-Z is lower-cased.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH_TYPE = "struct<n_words: bigint, n_hit: bigint, item_ids: array<string>, spans: array<struct<first: bigint, last: bigint>>>"


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


class Table:
    """Patterns of one length: a row of ``patterns`` each, as word numbers from 1 up."""

    def __init__(self, patterns: np.ndarray, items: list[list[int]]):
        self.patterns, self.length = patterns, patterns.shape[1]
        self.block = min(2, self.length)
        self.shift = np.full(1 << TABLE_BITS, self.length - self.block + 1, np.uint8)
        for last in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self._hash(patterns, last), self.length - 1 - last)
        key = self._hash(patterns, self.length - 1)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.item_start = np.cumsum([0, *map(len, items)])
        self.items = np.array([i for x in items for i in x], np.int64)

    def _hash(self, symbols: np.ndarray, last: int | np.ndarray) -> np.ndarray:
        column = (lambda i: symbols[:, i]) if symbols.ndim == 2 else (lambda i: symbols[i])
        h = column(last).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if self.block == 2:
            h += column(last - 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - TABLE_BITS)

    def find(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(last positions, pattern numbers) of all occurrences."""
        at = np.arange(0, len(text), LANE)
        end = np.minimum(at + LANE, len(text))
        at[0] = self.length - 1
        live = at < end
        at, end = at[live], end[live]
        found = []
        while len(at):
            step = self.shift[self._hash(text, at)]
            hit = step == 0
            found.append(at[hit])
            at = at + np.maximum(step, 1)
            live = at < end
            at, end = at[live], end[live]
        last = np.concatenate(found) if found else np.empty(0, np.int64)
        if not len(last):
            return
        key = self._hash(text, last)
        first, stop = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = stop - first
        cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + PAIRS, PAIRS)[1:], "left") + 1
        for a, b in zip([0, *cuts], [*cuts, len(last)]):
            a, b = min(a, len(last)), min(b, len(last))
            if a >= b:
                continue
            who = np.repeat(np.arange(a, b), n[a:b])
            within = np.arange(len(who)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
            pattern = self.order[first[who] + within]
            position = last[who]
            for j in range(self.length):  # direct comparison, from the last word to the first
                same = text[position - j] == self.patterns[pattern, self.length - 1 - j]
                position, pattern = position[same], pattern[same]
            if len(position):
                yield position, pattern


class Block:
    """Some benchmark items, compiled."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        self.names = [name for name, _ in items]
        self.numbers: dict[bytes, int] = {}
        windows: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for i, (_, item) in enumerate(items):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in item]
            k = min(len(ids), WINDOW_WORDS)
            for a in range(len(ids) - k + 1):
                owners = windows.setdefault(k, {}).setdefault(tuple(ids[a : a + k]), [])
                if not owners or owners[-1] != i:
                    owners.append(i)
        self.tables = [Table(np.array(list(x), np.int32).reshape(len(x), k), list(x.values())) for k, x in sorted(windows.items())]

    def search(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(covered: by word, pairs: rows of (document, item)). starts: of the documents in the sequence."""
        change = np.zeros(len(text) + 1, np.int64)
        pairs = [np.empty((0, 2), np.int64)]
        for table in self.tables:
            for last, pattern in table.find(text):
                np.add.at(change, last - table.length + 1, 1)
                np.add.at(change, last + 1, -1)
                document = np.searchsorted(starts, last, "right") - 1
                both = np.unique(np.stack([document, pattern], 1), axis=0)
                n = table.item_start[both[:, 1] + 1] - table.item_start[both[:, 1]]
                where = np.repeat(table.item_start[both[:, 1]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pairs.append(np.unique(np.stack([np.repeat(both[:, 0], n), table.items[where]], 1), axis=0))
        return np.cumsum(change[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def _items(rows: Iterator[tuple[str | None, str | None]], most: int) -> Iterator[tuple[str | None, list[bytes]]]:
    """(name, words) of the items with words. An item of over ``most`` words comes in pieces that together hold all its windows."""
    for name, value in rows:
        item = words(value)
        step = max(1, most - WINDOW_WORDS + 1)
        for a in range(0, len(item), step) if len(item) > most else [0] * bool(item):
            if a == 0 or len(item) - a >= WINDOW_WORDS:  # else the piece before holds its windows
                yield name, item[a : a + max(most, WINDOW_WORDS)]


def compile_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", max_block_words: int = MAX_BLOCK_WORDS) -> Iterator[Block]:
    """Blocks of the benchmark's items, read one partition at a time. One block is held at a time."""
    items, size = [], 0
    for name, item in _items(benchmark.select(F.col(item_id).cast("string"), text).toLocalIterator(), max_block_words):
        if size and size + len(item) > max_block_words:
            yield Block(items)
            items, size = [], 0
        items.append((name, item))
        size += len(item)
    if items:
        yield Block(items)


def _sorted(names: set[str | None]) -> list[str | None]:
    return sorted(names, key=lambda n: (n is None, n or ""))


def search_chunk(texts: list[str | None], block: Block) -> pd.DataFrame:
    """What SEARCH_TYPE says, for some texts."""
    split = [words(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    starts = np.cumsum(sizes + 1) - sizes - 1
    text, names, get = np.zeros(int(sizes.sum()) + len(split), np.int32), [set() for _ in split], block.numbers.get
    for a, document in zip(starts.tolist(), split):
        text[a : a + len(document)] = np.fromiter(map(get, document, repeat(0)), np.int32, len(document))
    hit, pairs = block.search(text, starts) if len(text) else (np.zeros(0, bool), np.empty((0, 2), np.int64))
    for d, i in pairs.tolist():
        names[d].add(block.names[i])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    spans = [[] for _ in split]
    for a, b in edge.reshape(-1, 2).tolist():
        d = int(np.searchsorted(starts, a, "right")) - 1
        spans[d].append({"first": a - int(starts[d]), "last": b - 1 - int(starts[d])})
    return pd.DataFrame({"n_words": sizes, "n_hit": list(map(_hit, spans)), "item_ids": list(map(_sorted, names)), "spans": spans})


def _hit(spans: list[dict[str, int]]) -> int:
    return sum(x["last"] - x["first"] + 1 for x in spans)


def _searcher(shared: Broadcast[Block]):
    @F.pandas_udf(SEARCH_TYPE)
    def search(column: pd.Series) -> pd.DataFrame:
        out, chunk, size = [], [], 0
        for value in column:
            chunk.append(value)
            size += len(value) if value else 0
            if size >= CHUNK_BYTES:
                out.append(search_chunk(chunk, shared.value))
                chunk, size = [], 0
        out.append(search_chunk(chunk, shared.value))
        return pd.concat(out, ignore_index=True)

    return search


def _merged(spans: list[dict[str, int]]) -> list[dict[str, int]]:
    runs: list[dict[str, int]] = []
    for a, b in sorted((x["first"], x["last"]) for x in spans):
        if runs and a <= runs[-1]["last"] + 1:
            runs[-1]["last"] = max(runs[-1]["last"], b)
        else:
            runs.append({"first": a, "last": b})
    return runs


def _union(spans: str) -> Column:
    """The runs that the spans of several blocks cover together."""

    @F.pandas_udf("array<struct<first: bigint, last: bigint>>")
    def union(column: pd.Series) -> pd.Series:
        return pd.Series(list(map(_merged, column)), dtype=object)

    return union(spans)


def find_contamination(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", doc_text: str = "text", max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """(row, found): each row of docs as a struct of all its columns, whatever their names, and SEARCH_TYPE of its text.

    n_words: words of the text. n_hit: words inside any occurrence of a window. item_ids: the items with occurring windows,
    distinct, in code point order. spans: the runs of hit words, first and last counted from 0.

    Null, empty and wordless texts have no words, hits or items; texts and items of any length are searched whole. Items without
    words are ignored; rows that repeat an item_id are one item, and so are those without one, whose id stays null, the last.
    An empty benchmark hits nothing; repeated rows of docs are judged alike; empty docs give no rows.
    """
    context = docs.sparkSession.sparkContext
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    blocks = compile_blocks(benchmark, item_id, text, max_block_words)
    first = next(blocks, Block([]))
    second = next(blocks, None)
    if second is None:
        return docs.select(row, _searcher(context.broadcast(first))(F.col(doc_text)).alias("found"))
    name = F.struct(F.xxhash64(F.lit(1), doc_text).alias("a"), F.xxhash64(F.lit(2), doc_text).alias("b")).alias("name")
    hits = None
    for block in chain([first, second], blocks):
        shared = context.broadcast(block)
        one = docs.select(name, _searcher(shared)(F.col(doc_text)).alias("found")).filter("found.n_hit > 0")
        one = materialize(one.groupBy("name").agg(F.first("found").alias("found")), "hits")
        shared.destroy()
        hits = one if hits is None else hits.unionByName(one)
    # a number of rows for each text that is hit, at most one for each block
    merged = hits.groupBy("name").agg(F.flatten(F.collect_list("found.item_ids")).alias("items"), F.flatten(F.collect_list("found.spans")).alias("spans"))
    merged = merged.select("name", F.array_distinct("items").alias("items"), _union("spans").alias("spans"))
    joined = docs.select(row, F.regexp_count(F.coalesce(doc_text, F.lit("")), F.lit(_WORD)).cast("long").alias("n_words"), name).join(merged, "name", "left")
    nulls_last = F.filter("items", lambda x: x.isNull())
    items = F.concat(F.array_sort(F.filter("items", lambda x: x.isNotNull())), nulls_last)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    none = lambda kind: F.array().cast(kind)
    found = F.struct(
        "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(items, none("array<string>")).alias("item_ids"),
        F.coalesce("spans", none("array<struct<first: bigint, last: bigint>>")).alias("spans"),
    )
    return joined.select("row", found.alias("found"))


def is_contaminated(found: Column) -> Column:
    """Hit words are a twentieth of the words or more."""
    return (found["n_hit"] > 0) & (found["n_hit"] * 20 >= found["n_words"])
