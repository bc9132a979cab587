"""Token counts: unigram segmentation by dynamic programming over a trie of pre-tokens.

A pre-token is a run of spaces with the non-spaces behind it. Its token count is that of its best segmentation into the
pieces of a public vocabulary: the one of the highest sum of piece scores (of equal ones, of the fewest tokens). A worker
inserts the distinct pre-tokens that are new to it in a trie of their characters. The forward score of a node, the best
over the pieces that end there, depends on the node's prefix alone and is computed once for all pre-tokens that share it; a
node where a pre-token ends stores its count. The counts of a document are sums of these terminal counts. Nothing is
shuffled.

The trie is built level by level, for words of any length: in sorted order the words under a node stand together, so a node
begins where its parent or its character changes. Each level keeps, for every node, the hashes of its last 1 to 16 characters
and the scores of its last 16 ancestors, which is all that the next level needs. Neighbours in sorted order share a trie of up to
MAX_WORDS words; words already counted by the worker are not counted again.

Scores are ``-ln(rank + 1)``, normalised: Zipf's law over the ranks of the vocabulary. A character outside the vocabulary counts
one token for each of its UTF-8 bytes, each a unit below the worst piece.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Pre-tokens whose counts a worker remembers before it starts anew: about 150 MB.
MAX_KNOWN = 1_000_000
#: Words in one trie: a level holds a few hundred bytes for each.
MAX_WORDS = 60_000
#: Texts are counted in slices of so many characters.
SLICE = 8_000_000

COUNT_TYPE = "struct<n_pretokens: bigint, n_tokens: bigint>"

_SPACED = re.compile(r" *[^ ]+| +")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 21


def load_vocabulary(path: str) -> dict[str, float]:
    """Piece (with a plain space for the word mark) -> score, of a SentencePiece model's normal pieces. Control and byte
    pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    size = model.vocab_size()
    normal = -math.log(sum(1 / (r + 1) for r in range(size)))
    out: dict[str, float] = {}
    for rank, i in enumerate(pieces):
        out.setdefault(model.id_to_piece(i).replace("▁", " "), normal - math.log(rank + 1))
    return out


def pretokens(text: str | None) -> list[str]:
    """The pre-tokens of the text with a space put in front, each without its first space."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or "  " in text:
        return [p[1:] for p in _SPACED.findall(" " + text)]
    return text.split(" ")


class Counter:
    """Token counts of texts, remembering those of the pre-tokens seen."""

    def __init__(self, vocabulary: dict[str, float], max_known: int = MAX_KNOWN):
        self.scores, self.max_known, self.known = vocabulary, max_known, {}
        self.longest = max(map(len, vocabulary), default=1)
        self.byte = min(vocabulary.values(), default=0.0) - 1.0
        keyed = sorted((self._hash(p), s) for p, s in vocabulary.items())
        self.keys, self.values = np.array([k for k, _ in keyed], np.uint64), np.array([s for _, s in keyed])
        assert len(set(self.keys.tolist())) == len(self.keys)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.keys)] = True
        self.nodes = 0

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _FILTER_BITS)

    def _trie(self, words: list[str]) -> list[int]:
        """Counts of sorted, distinct, non-empty words, by one trie of all."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.zeros(len(words), np.int64)
        alive = np.arange(len(words))
        node_of = np.zeros(len(words), np.int64)  # of each alive word, in the level before
        tails = np.zeros((0, 1), np.uint64)  # tails[k]: hash of the last k + 1 characters
        best, count = np.zeros((1, 1)), np.zeros((1, 1), np.int64)  # [k]: of the ancestor k levels up
        for depth in range(1, int(sizes.max()) + 1):
            if depth > 1 and len(ended := np.flatnonzero(sizes[alive] < depth)):
                alive, node_of = np.delete(alive, ended), np.delete(node_of, ended)
            character = codes[start[alive] + depth - 1]
            # words under a node stand together: a node begins where the parent or the character changes
            new = np.concatenate([[True], (node_of[1:] != node_of[:-1]) | (character[1:] != character[:-1])])
            parent, character = node_of[new], character[new].astype(np.uint64)
            node_of = np.cumsum(new) - 1
            self.nodes += len(parent)
            tails = np.concatenate([character[None] + np.uint64(1), tails[: self.longest - 1, parent] * _BASE + (character + np.uint64(1))])
            best, count = best[: self.longest, parent], count[: self.longest, parent]
            n_bytes = 1 + (character >= 0x80).astype(np.int64) + (character >= 0x800) + (character >= 0x10000)
            top, tokens = best[0] + n_bytes * self.byte, count[0] + n_bytes
            k, at = np.nonzero(self.filter[self._slot(tails)])
            if len(k):
                place = np.minimum(np.searchsorted(self.keys, tails[k, at]), len(self.keys) - 1)
                real = self.keys[place] == tails[k, at]
                k, at, place = k[real], at[real], place[real]
                score, pieces = self.values[place] + best[k, at], count[k, at] + 1
                order = np.lexsort((-pieces, score, at))  # the last of each node is its best: highest score, then fewest tokens
                order = order[np.concatenate([at[order][1:] != at[order][:-1], [True]])] if len(order) else order
                at, score, pieces = at[order], score[order], pieces[order]
                better = (score > top[at]) | ((score == top[at]) & (pieces < tokens[at]))
                top[at[better]], tokens[at[better]] = score[better], pieces[better]
            best, count = np.concatenate([top[None], best]), np.concatenate([tokens[None], count])
            ends = sizes[alive] == depth
            out[alive[ends]] = tokens[node_of[ends]]
        return out.tolist()

    def learn(self, keys: set[str]) -> None:
        """Count pre-tokens, given without their first space, of any length."""
        own = sorted(keys)
        for i in range(0, len(own), MAX_WORDS):
            part = own[i : i + MAX_WORDS]
            self.known.update(zip(part, self._trie([" " + k for k in part])))

    def of(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        first = size = 0
        for i, text in enumerate(texts):
            size += len(text) if text else 0
            if size >= SLICE or i == len(texts) - 1:
                split = [pretokens(t) for t in texts[first : i + 1]]
                known = self.known
                self.learn({w for words in split for w in words if w not in known})
                get = known.__getitem__
                for words in split:
                    yield len(words), sum(map(get, words))
                first, size = i + 1, 0
                if len(known) > self.max_known:
                    known.clear()


_COUNTERS: dict[tuple[str, int], Counter] = {}


def worker_counter(path: str, max_known: int) -> Counter:
    """The counter of this Python worker: tasks that follow on it find what earlier ones have learned."""
    if (path, max_known) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path, max_known] = Counter(load_vocabulary(path), max_known)
    return _COUNTERS[path, max_known]


def count_tokens(vocabulary_path: str, max_known: int = MAX_KNOWN):
    """A column function: text -> n_pretokens, n_tokens.

    Null and empty texts have none of either. Very long texts and words are counted whole, in bounded memory. Equal scores
    go to the segmentation of fewest tokens. Repeated rows count alike. An empty table gives an empty table. It reads the one
    column that it is given: other columns may have any name.
    """

    @F.pandas_udf(COUNT_TYPE)
    def count(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(worker_counter(vocabulary_path, max_known).of(list(column))), columns=["n_pretokens", "n_tokens"])

    return count
