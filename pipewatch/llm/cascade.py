"""Quality rules as a short-circuit cascade.

Counts of whole texts come first. Each rule then sees only the texts that no rule
before it rejected. On a bounded sample every rule is timed on all texts
and its rejections are counted; rules run by rejections per second, the most
first. The order decides what the cascade costs, never what it keeps.

Defined results: a null text is an empty one, has no words and fails; rows are judged each
by itself, so repeats agree; an empty table keeps the written order of
rules. Columns the operator adds start with ``rule_`` and replace any of that name.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewatch.llm import text as tx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents the rules are measured on, at most; drawn by hash of doc_id.
MAX_SAMPLE = 2000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True


def counts(texts: pa.Array) -> np.ndarray:
    """A row of COUNTS per text."""
    data, offsets = tx.buffers(texts)
    n = len(offsets) - 1
    out = np.zeros((n, len(COUNTS)), dtype=np.int64)
    if not len(data):
        return out
    solid = ~tx.SPACE[data]
    starts, ends, rows = tx.segments(solid, offsets)
    out[:, 0] = np.bincount(rows, minlength=n)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    points = total(solid & ((data & 0xC0) != 0x80))
    symbols = total(SYMBOL[data])
    out[:, 1], out[:, 2] = (t[offsets[1:]] - t[offsets[:-1]] for t in (points, symbols))

    l_starts, l_ends, l_rows = tx.segments(data != 10, offsets)
    worded = points[l_ends] > points[l_starts]
    l_starts, l_ends, l_rows = l_starts[worded], l_ends[worded], l_rows[worded]
    line = tx.mix(tx.hashes(data, l_starts, l_ends) + l_rows.astype(np.uint64) * tx.M1)
    _, first = np.unique(line, return_index=True)
    out[:, 3] = np.bincount(l_rows, minlength=n) - np.bincount(l_rows[first], minlength=n)

    if len(starts) >= WINDOW:
        h = tx.hashes(data, starts, ends)
        last = len(h) - WINDOW + 1
        inside = np.flatnonzero(rows[:last] == rows[WINDOW - 1 :])
        joint = rows[inside].astype(np.uint64)
        for k in range(WINDOW):
            joint = tx.mix(joint * tx.M1 + h[inside + k])
        order = np.argsort(joint)
        same = np.zeros(len(joint), dtype=bool)
        equal = joint[order][1:] == joint[order][:-1]
        same[order[1:][equal]] = same[order[:-1][equal]] = True
        cover = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(cover, inside[same], 1)
        np.add.at(cover, inside[same] + WINDOW, -1)
        out[:, 4] = np.bincount(rows[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def base_failed(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] < 10) | (100 * c[:, 4] > 20 * c[:, 0])


Rule = Callable[[pa.Array, np.ndarray], np.ndarray]


def odd_word_lengths(texts: pa.Array, c: np.ndarray) -> np.ndarray:
    """The mean word has fewer than 2 or more than 20 characters."""
    return (c[:, 1] < 2 * c[:, 0]) | (c[:, 1] > 20 * c[:, 0])


def many_symbols(texts: pa.Array, c: np.ndarray) -> np.ndarray:
    """More than a symbol to two words."""
    return 2 * c[:, 2] > c[:, 0]


def many_repeated_lines(texts: pa.Array, c: np.ndarray) -> np.ndarray:
    """More than 30 % of the lines with words repeat earlier ones."""
    data, offsets = tx.buffers(texts)
    solid = np.concatenate([[0], np.cumsum(~tx.SPACE[data])])
    starts, ends, rows = tx.segments(data != 10, offsets)
    lines = np.bincount(rows[solid[ends] > solid[starts]], minlength=len(texts))
    return 100 * c[:, 3] > 30 * lines


def few_letters(texts: pa.Array, c: np.ndarray) -> np.ndarray:
    """Fewer than 60 % of the words have a letter."""
    data, offsets = tx.buffers(texts)
    starts, ends, rows = tx.segments(~tx.SPACE[data], offsets)
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    lettered = np.bincount(rows[letters[ends] > letters[starts]], minlength=len(texts))
    return 100 * lettered < 60 * c[:, 0]


def one_word_over_and_over(texts: pa.Array, c: np.ndarray) -> np.ndarray:
    """One word is more than 40 % of all words."""
    h, rows, _ = tx.words(texts, lower=True)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(most, rows[at], np.diff(np.append(at, len(h))))
    return 100 * most > 40 * c[:, 0]


def all_capitals(texts: pa.Array, c: np.ndarray) -> np.ndarray:
    """More than 70 % of the ASCII letters are capitals."""
    data, offsets = tx.buffers(texts)
    upper = np.concatenate([[0], np.cumsum(UPPER[data])])
    letters = np.concatenate([[0], np.cumsum(LETTER[data] & (data < 128))])
    of = lambda t: t[offsets[1:]] - t[offsets[:-1]]
    return 100 * of(upper) > 70 * of(letters)


RULES: dict[str, Rule] = {
    rule.__name__: rule
    for rule in (odd_word_lengths, many_symbols, many_repeated_lines, few_letters, one_word_over_and_over, all_capitals)
}


def measure(docs: DataFrame, rules: dict[str, Rule] = RULES, bound: int = MAX_SAMPLE) -> list[str]:
    """The rules' names by rejections per second on the sample."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                texts = tx.column(part, "text")
                c = counts(texts)
                spent, bad = [], []
                for rule in rules.values():
                    start = time.perf_counter()
                    bad.append(int(rule(texts, c).sum()))
                    spent.append(time.perf_counter() - start)
                yield pa.RecordBatch.from_arrays([pa.array(list(rules)), pa.array(spent), pa.array(bad, pa.int64())], ["rule", "s", "bad"])

    drawn = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().withColumn("_draw", F.xxhash64("doc_id")).orderBy("_draw", "doc_id").limit(bound)
    # The ids drawn are bounded, so no text is shuffled for them.
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn.select("doc_id")), "doc_id").select("text")
    found = sample.mapInArrow(work, "rule string, s double, bad long").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("bad").alias("bad"))
    rate = {r["rule"]: r["bad"] / max(r["s"], 1e-9) for r in found.collect()}
    return sorted(rules, key=lambda name: -rate.get(name, 0.0))


def verdicts(texts: pa.Array, c: np.ndarray, order: list[str], rules: dict[str, Rule]) -> np.ndarray:
    """Which texts pass the base and every rule; a rule sees those still in only."""
    kept = ~base_failed(c)
    for name in order:
        alive = np.flatnonzero(kept)
        if not len(alive):
            break
        kept[alive[rules[name](texts.take(pa.array(alive)), c[alive])]] = False
    return kept


def judge(docs: DataFrame, rules: dict[str, Rule] = RULES, bound: int = MAX_SAMPLE) -> DataFrame:
    """``docs`` with the counts, ``rule_base_failed`` and ``rule_kept``."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith("rule_")])
    order = measure(docs, rules, bound)
    fields = [*((name, pa.int64()) for name in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_())]

    @F.arrow_udf("struct<" + ",".join(f"{n}:{'boolean' if t == pa.bool_() else 'bigint'}" for n, t in fields) + ">")
    def of(texts: pa.Array) -> pa.Array:
        parts = []
        for part in tx.slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            given = tx.column(part, "text")
            c = counts(given)
            columns = [*c.T, base_failed(c), verdicts(given, c, order, rules)]
            parts.append(pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, fields)], [n for n, _ in fields]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))

    judged = docs.withColumn("rule_all", of(F.col("text").cast("string")))
    return judged.select(*docs.columns, *[F.col(f"rule_all.{n}").alias(f"rule_{n}") for n, _ in fields])


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return judged.select("doc_id", *[F.col(f"rule_{n}").alias(n) for n in (*COUNTS, "base_failed", "kept")])
