"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie; each node has a failure link and the number of pieces that are
popped when the link is followed, worked out once. Reading a word moves along trie edges
and failure links, adding popped counts, so a word costs time linear in its length however
long its pieces are, and no piece is built.

Words `[^\\x20\\x09-\\x0D]+` are read with the vocabulary's word mark in front. A word that
the vocabulary can't spell counts as one unknown token. Counts of words are kept in a
worker's table, emptied at CACHE_WORDS; long words are not kept.

Defined results: null or empty text has 0 words and tokens; repeated rows each get a row;
an empty table gives none; extra columns are kept, and one with the
name of an output column gets `_given` behind its name.
"""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MARK = "▁"
CACHE_WORDS, CACHE_CHARS = 200_000, 128
_loaded: dict[tuple[str, str], LongestMatch] = {}


class LongestMatch:
    """edges[node]: character -> node; link[node]: failure node or -1; popped[node]: pieces that go with it."""

    def __init__(self, pieces, mark: str = MARK):
        self.mark = mark
        edges, depth_order, final = [{}], [(0, -1, "")], [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in edges[node]:
                    edges[node][c] = len(edges)
                    edges.append({})
                    final.append(False)
                    depth_order.append((len(edges) - 1, node, c))
                node = edges[node][c]
            if piece:
                final[node] = True
        self.edges = edges
        self.link, self.popped = [-1] * len(edges), [0] * len(edges)
        # by depth: a node's link needs its parent's and shallower ones only
        layer = [0]
        while layer:
            below = []
            for node in layer:
                for c, child in edges[node].items():
                    below.append(child)
                    if final[child]:  # the whole path is one piece
                        self.link[child], self.popped[child] = 0, 1
                        continue
                    at, n = self.link[node], self.popped[node]
                    while at >= 0 and c not in edges[at]:
                        n += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[child], self.popped[child] = edges[at][c], n
            layer = below
        self.cache: dict[str, int] = {}

    def length(self, word: str) -> int:
        """Pieces of the greedy longest match of mark + word; 0 if it can't be spelt."""
        edges, link, popped = self.edges, self.link, self.popped
        at = n = 0
        for c in chain(self.mark, word):
            while c not in edges[at]:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return 0
            at = edges[at][c]
        while at > 0:
            n += popped[at]
            at = link[at]
        return n if at == 0 else 0

    def counts(self, words: list[str]) -> tuple[int, int]:
        """Tokens and unknown words of a text."""
        cache, tokens, unknown = self.cache, 0, 0
        for w in words:
            n = cache.get(w)
            if n is None:
                n = self.length(w)
                if len(w) <= CACHE_CHARS:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = n
            if n:
                tokens += n
            else:
                unknown += 1
        return tokens + unknown, unknown


def sentencepieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = (m.IsControl, m.IsUnknown, m.IsByte, m.IsUnused)
    return [m.IdToPiece(i) for i in range(m.GetPieceSize()) if not any(f(i) for f in skip)]


def automaton(path: str, mark: str = MARK) -> LongestMatch:
    if (path, mark) not in _loaded:
        _loaded[path, mark] = LongestMatch(sentencepieces(path), mark)
    return _loaded[path, mark]


def _count(path: str, mark: str):
    def count(batches):
        a = automaton(path, mark)
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column("text").cast(pa.large_string()).cast(pa.large_binary()):
                words = [w.decode() for w in C.word_list(text.as_py() or b"")]
                tokens, unknown = a.counts(words)
                n_words.append(len(words))
                n_tokens.append(tokens)
                n_unknown.append(unknown)
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], names=[*names, "n_words", "n_tokens", "n_unknown"])

    return count


def count(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, mark: str = MARK) -> DataFrame:
    """keep columns, n_words, n_tokens (unknown words count one each), n_unknown."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    C.bounded(docs)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    shape = "".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    out = rows.mapInArrow(_count(str(path), mark), shape + "n_words long, n_tokens long, n_unknown long")
    return out.withColumnsRenamed(C.beside(keep, out.columns[len(keep) :]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(C.table(spark, sf_dir, "documents"), keep=["doc_id"])
