"""Byte-pair encoding and decoding with a public vocabulary, by one trie of the distinct words.

The split pattern cuts a text into words. The words of a batch that are new to the worker are inserted into its trie in
byte order, which visits the trie depth first. A node is a prefix; its state is the last token of the prefix's encoding:
the one vocabulary suffix that is compatible with the state of the node it starts at (two tokens are compatible if they
are the encoding of their own concatenation). Shared prefixes are so encoded once; a word's tokens are read off backwards
from its node.

Defined cases: a null text has null tokens; an empty text has none; a text of any length, and a word of any length in it,
is encoded whole; repeated rows are encoded alike; a null id is carried as null; an empty table has no rows; further columns
are ignored, one that is named ``doc_id`` beside another id column too. Tokens of special meaning are ordinary text.

The vocabulary is a file that every executor reads under the same path, once a Python worker.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.llm.common import text_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The trie and the words are dropped, and begun anew with the next batch, beyond so many nodes, words, or bytes of words.
#: Words of more than ``LONG_WORD`` bytes have a trie of their own, which goes when they are encoded: their tokens alone stay.
MAX_NODES, MAX_WORDS, MAX_BYTES, LONG_WORD = 800_000, 300_000, 16_000_000, 64
_BATCH = 4_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Coder:
    """A vocabulary with its trie of words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern).findall
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.last = array("i", [-1])
        self.index: dict[str, int] = {}
        self.held = 0
        self.starts, self.sizes, self.flat = array("q"), array("i"), array("i")

    def merged(self, word: bytes) -> list[int]:
        """Tokens of ``word`` by merging the pair of least rank again and again: the definition."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))  # noqa: B905, RUF007
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, before: int, token: int) -> bool:
        """Whether the two (or, with -1, the token alone) are the encoding of their concatenation."""
        key = (before + 1) << 24 | token
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 600_000:
                self.fits.clear()
            own = [token] if before < 0 else [before, token]
            found = self.fits[key] = self.merged(b"".join(self.tokens[t] for t in own)) == own
        return found

    def insert(self, word: bytes) -> list[int]:
        """Tokens of ``word``; the trie gains the nodes of its prefixes that are new."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        child, last = self.child, self.last
        if len(word) > LONG_WORD:
            child, last = {}, array("i", [-1])
        node, path = 0, [0]
        for depth, byte in enumerate(word, 1):
            key = node << 8 | byte
            nxt = child.get(key)
            if nxt is None:
                nxt = child[key] = len(last)
                for length in range(min(depth, self.longest), 0, -1):
                    token = self.ranks.get(word[depth - length : depth])
                    if token is not None and self.compatible(last[path[depth - length]], token):
                        last.append(token)
                        break
            node = nxt
            path.append(node)
        out, at = [], len(word)
        while at:
            out.append(last[path[at]])
            at -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts, and the number of each text's."""
        words = [self.split(t) for t in texts]
        if len(self.index) > MAX_WORDS or self.held > MAX_BYTES or len(self.last) > MAX_NODES:
            self.reset()
        index = self.index
        for word in sorted(set(chain.from_iterable(words)).difference(index)):
            coded = word.encode()
            tokens = self.insert(coded)
            self.held += len(coded)
            index[word] = len(self.starts)
            self.starts.append(len(self.flat))
            self.sizes.append(len(tokens))
            self.flat.extend(tokens)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        which = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        starts, sizes, flat = np.array(self.starts), np.array(self.sizes), np.array(self.flat)
        n = sizes[which].astype(np.int64) if len(which) else which
        ends = np.cumsum(n)
        places = np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0) if len(which) else which
        edges = np.concatenate(([0], np.cumsum(counts)))
        upto = np.concatenate(([0], ends))
        return (flat[places] if len(which) else np.zeros(0, np.int32)), np.diff(upto[edges])

    def decode(self, tokens) -> str:
        return b"".join(map(self.tokens.__getitem__, tokens)).decode("utf-8", "replace")


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str = VOCABULARY, pattern: str = PATTERN) -> Coder:
    """This worker's coder, kept between tasks."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in text_batches(batches, 1, _BATCH):
            texts = batch.column(1).to_pylist()
            flat, sizes = own.encode([t or "" for t in texts])
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            exact = []
            for text, s, e in zip(texts, offsets, offsets[1:], strict=False):
                exact.append(None if text is None else own.decode(flat[s:e].tolist()) == text)
            missing = np.array([t is None for t in texts])
            marks = pa.array(offsets.astype(np.int32), mask=np.append(missing, False)) if missing.any() else pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(marks, pa.array(flat, pa.int32())), pa.array([None if t is None else int(n) for t, n in zip(texts, sizes, strict=True)], pa.int64()), pa.array(exact, pa.bool_())], ["doc_id", "tokens", "n_tokens", "exact"])

    return run


def encoded(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, n_tokens, exact): ``exact`` says that the tokens decode to the text again."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("exact", T.BooleanType())])
    return rows.mapInArrow(_encoder(path, pattern), schema)


def decoded(rows: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, tokens_col: str = "tokens", into: str = "text") -> DataFrame:
    """``rows`` with the text of each list of tokens (null for null) as ``into``."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coder(path, pattern)
        for lists in batches:
            yield pa.array([None if x is None else own.decode(x) for x in lists.to_pylist()], pa.string())

    return rows.withColumn(into, run(F.col(tokens_col)))
