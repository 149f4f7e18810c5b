"""Word-piece token counts by a linear longest-match automaton.

Song et al. 2021: a trie of the vocabulary with failure links. Following a link
pops the pieces that greedy longest match has settled by then; how many is
computed beforehand, so lengths are found without building a piece, in one pass
over a word's bytes. All distinct words of a batch take a step at once.

A word is white-space delimited and starts with the byte of its preceding space, as
the pieces of a byte-level vocabulary do. Defined results: a null or empty text has
no words and no tokens; a word that pieces cannot spell is one unknown token;
rows are counted each for itself. Only ``text`` is read; other columns pass
through, and added ones start with ``wp_`` and replace any of that name.
"""

from __future__ import annotations

import base64
import sys
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewatch.llm import text as tx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAD = b" "


class Automaton:
    """Transitions as sorted (state, byte) keys; per state the failure link and the pieces popped on it."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = {0: False}
        for piece in pieces:
            at = 0
            for byte in piece:
                new = children[at].get(byte)
                if new is None:
                    new = len(children)
                    children[at][byte] = new
                    children.append({})
                    final[new] = False
                at = new
            final[at] = at > 0
        n = len(children)
        link, popped = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        todo = deque([0])
        while todo:
            parent = todo.popleft()
            for byte, node in children[parent].items():
                todo.append(node)
                if final[node]:
                    link[node], popped[node] = 0, 1
                    continue
                z, pops = link[parent], popped[parent]
                while z >= 0 and byte not in children[z]:
                    pops += popped[z]
                    z = link[z]
                if z >= 0:
                    link[node], popped[node] = children[z][byte], pops
        pairs = sorted((state * 256 + byte, node) for state, edges in enumerate(children) for byte, node in edges.items())
        self.keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self.nodes = np.array([v for _, v in pairs], dtype=np.int64)
        self.link, self.popped = link, popped

    def step(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        key = states * 256 + bytes_
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.nodes[at], -1) if len(self.keys) else np.full(len(key), -1)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: bytes = LEAD) -> np.ndarray:
        """Pieces of each word; 0 for a word that cannot be spelt."""
        n = len(starts)
        count, state = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first, so the live ones lead
        long = -np.sort(starts - ends)

        def advance(live: np.ndarray, byte: np.ndarray) -> None:
            while len(live):
                to = self.step(state[live], byte)
                hit = to >= 0
                state[live[hit]] = to[hit]
                live, byte = live[~hit], byte[~hit]
                count[live] += self.popped[state[live]]
                state[live] = self.link[state[live]]
                stuck = state[live] < 0
                live, byte = live[~stuck], byte[~stuck]

        for byte in lead:
            advance(np.arange(n), np.full(n, byte, dtype=np.int64))
        for place in range(int(long[0]) if n else 0):
            live = order[: np.searchsorted(-long, -place, side="left")]
            live = live[state[live] >= 0]
            advance(live, data[starts[live] + place].astype(np.int64))
        live = np.flatnonzero(state > 0)
        while len(live):
            count[live] += self.popped[state[live]]
            state[live] = self.link[state[live]]
            live = live[state[live] > 0]
        return np.where(state == 0, count, 0)


_built: dict[str, Automaton] = {}


def automaton(name: str) -> Automaton:
    """The automaton of an installed public vocabulary, built once per worker."""
    if name not in _built:
        import public_tokenizers

        with open(public_tokenizers.path(name), "rb") as file:
            _built[name] = Automaton([base64.b64decode(line.split()[0]) for line in file])
    return _built[name]


def count_pieces(texts: pa.Array, found: Automaton) -> np.ndarray:
    """Of each text: words, tokens, words that cannot be spelt."""
    data, offsets = tx.buffers(texts)
    starts, ends, rows = tx.segments(~tx.SPACE[data], offsets)
    n = len(offsets) - 1
    _, first, which = np.unique(tx.hashes(data, starts, ends), return_index=True, return_inverse=True)
    pieces = found.lengths(data, starts[first], ends[first])[which]
    unknown = pieces == 0
    return np.column_stack([tx.per_row(x, rows, n) for x in (np.ones(len(rows)), np.maximum(pieces, 1), unknown)])


def count(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``wp_n_words``, ``wp_n_tokens`` and ``wp_n_unknown``."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith("wp_")])
    names = ["n_words", "n_tokens", "n_unknown"]

    @F.arrow_udf("struct<" + ",".join(f"{n}:bigint" for n in names) + ">")
    def of(texts: pa.Array) -> pa.Array:
        parts = [
            pa.StructArray.from_arrays([pa.array(x) for x in count_pieces(tx.column(part, "text"), automaton(vocabulary)).T], names)
            for part in tx.slices(pa.RecordBatch.from_arrays([texts], ["text"]), size=4 << 20)
        ]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, pa.int64()) for n in names]))

    counted = docs.withColumn("wp_all", of(F.col("text").cast("string")))
    return counted.select(*docs.columns, *[F.col(f"wp_all.{n}").alias(f"wp_{n}") for n in names])


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's word-piece tokens."""
    counted = count(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return counted.select("doc_id", *[F.col(f"wp_{n}").alias(n) for n in ("n_words", "n_tokens", "n_unknown")])
