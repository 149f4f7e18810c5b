"""Spelling variants of words: pairs at edit distance one, found by pivotal grams.

Words are counted while whole texts are folded, task by task, into tables of
distinct words, which are spilled and summed by word. Every word has its bigrams in a
global order, rarest first. An edit touches at most two bigrams, so the words
of a pair share one of the first three of one of them; and of two disjoint
bigrams an edit leaves one whole (Deng, Li, Feng 2014). So a word picks two disjoint
rare bigrams out of its prefix, by dynamic programming over their counts, and looks them up
in the prefixes of all words. One edit moves a bigram by one place at most, and the
difference in length says which way: place and length are part of the key of the
look-up. What is found is verified by the distance itself inside the join.

A word is found by all bigrams up to the value of the third, so equal bigrams don't hide one another.

Defined results: a null text has no words; a null doc_id is written as an empty string; rows that
repeat a doc_id count each for itself; an empty table gives no words; words of
any length take part. Words are told apart by 64-bit hashes within a task, and by
themselves afterwards. Only ``doc_id`` and ``text`` are read. A text is held in one task, whole.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewatch.llm import text as tx
from pipewatch.sources.scratch import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Code points of a word and its occurrences, at least.
LEAST, OFTEN = 5, 3
#: Edits between the words of a pair, and the code points of a gram.
EDITS, Q = 1, 2
#: Code points up to which words are compared by the built-in distance.
LONG = 64
#: Distinct words a task holds before it hands them on.
SPILL = 1 << 19
#: A run whose number divides by this loses a letter.
TOUCHED = 97

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = crc_table()


def crc32(before: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The checksum of each segment's bytes, going on from the checksum ``before`` it."""
    order = np.argsort(starts - ends, kind="stable")
    at, lengths = starts[order], (ends - starts)[order]
    out = before[order] ^ np.uint32(0xFFFFFFFF)
    live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    for place, n in enumerate(live.tolist()):
        out[:n] = CRC[(out[:n] ^ data[at[:n] + place]) & np.uint32(255)] ^ (out[:n] >> np.uint32(8))
    result = np.empty_like(out)
    result[order] = out ^ np.uint32(0xFFFFFFFF)
    return result


def runs(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, and start, end and row of each run of letters."""
    data, offsets = tx.buffers(texts)
    lead = data == 0xC3  # of all of U+00C0 to U+00FF, and of nothing else
    inside = LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return (tx.LOWER[data], *tx.segments(inside, offsets))


class Folded:
    """Distinct words with their counts, by hash. What is added is merged now and then, not each time."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0
        self.names: dict[int, str] = {}
        self.odd: dict[str, int] = {}

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        h, first, n = np.unique(tx.hashes(data, starts, ends), return_index=True, return_counts=True)
        for x, at in zip(h.tolist(), first.tolist()):
            if x not in self.names:
                self.names[x] = data[starts[at] : ends[at]].tobytes().decode()
        self.parts.append((h, n))
        self.pending += len(h)
        if self.pending > 2 * SPILL:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        h, back = np.unique(np.concatenate([p[0] for p in self.parts] or [np.zeros(0, np.uint64)]), return_inverse=True)
        n = np.concatenate([p[1] for p in self.parts] or [np.zeros(0, np.int64)])
        self.parts = [(h, np.bincount(back, weights=n, minlength=len(h)).astype(np.int64))]
        self.pending = len(h)
        return self.parts[0]

    def __len__(self) -> int:
        return len(self.names) + len(self.odd)

    def batch(self) -> pa.RecordBatch:
        h, n = self.merge()
        words = [self.names[x] for x in h.tolist()] + list(self.odd)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([*n.tolist(), *self.odd.values()], pa.int64())], ["word", "n"])


def occurrences(docs: DataFrame, least: int = LEAST, touched: int = TOUCHED, spill: int = SPILL) -> DataFrame:
    """(word, n): distinct words of tasks with their counts there, not yet summed up."""

    def fold(texts: pa.Array, ids: pa.Array, into: Folded) -> None:
        data, starts, ends, rows = runs(texts)
        if not len(starts):
            return
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], dtype=np.uint32)
        number = crc32(heads[rows], data, starts, ends)
        changed = number % np.uint32(touched) == 0
        for at in np.flatnonzero(changed).tolist():
            word = data[starts[at] : ends[at]].tobytes().decode()
            gone = int(number[at]) % len(word)
            word = word[:gone] + word[gone + 1 :]
            if len(word) >= least:
                into.odd[word] = into.odd.get(word, 0) + 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        whole = ~changed & (points[ends] - points[starts] >= least)
        into.add(data, starts[whole], ends[whole])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = Folded()
        for batch in batches:
            for part in tx.slices(batch):
                fold(tx.column(part, "text"), tx.column(part, "doc_id"), folded)
                if len(folded) >= spill:
                    yield folded.batch()
                    folded = Folded()
        yield folded.batch()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "word string, n long")


def words(docs: DataFrame, least: int = LEAST, often: int = OFTEN, **settings: int) -> DataFrame:
    """(word, n): the words that occur often enough."""
    return occurrences(docs, least, **settings).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def pivots(grams: list[tuple], q: int = Q, edits: int = EDITS) -> list[tuple]:
    """``edits + 1`` of the grams (cost, place), no two of which overlap, with the least sum of costs.

    ``best[i][k]`` is the cheapest choice of k among the first i grams by place; a gram
    goes on from the choices among those that end before it.
    """
    grams = sorted(grams, key=lambda g: g[1])
    best = [[(0, ())] + [(float("inf"), ())] * (edits + 1)]
    before = 0
    for i, (cost, place) in enumerate(grams):
        while grams[before][1] + q <= place:
            before += 1
        row = [best[0][0]]
        for k in range(1, edits + 2):
            so_far, chosen = best[before][k - 1]
            row.append(min(best[i][k], (so_far + cost, (*chosen, (cost, place))), key=lambda x: x[0]))
        best.append(row)
    return list(best[-1][edits + 1][1])


def prefix(ranked: list[tuple], q: int = Q, edits: int = EDITS) -> tuple[list[tuple], list[tuple]]:
    """Of a word's grams (rank, cost, place) in order: those to choose pivots from, and those to be found by.

    The first are ``q * edits + 1`` grams. The second are all grams up to the value of the last of them, since equal grams
    have no order between words. Of one value the first few will do: a pivot is among the first
    ``q * edits + 1`` of its word, and an edit adds q of a value before it.
    """
    first = ranked[: q * edits + 1]
    found, seen = [], {}
    for gram in ranked:
        if gram[0] > first[-1][0]:
            break
        seen[gram[0]] = seen.get(gram[0], 0) + 1
        if seen[gram[0]] <= len(first) + q * edits:
            found.append(gram)
    return first, found


GRAM_SCHEMA = "word string, n long, letters long, len int, place int, pivot boolean"


def letters(word: str) -> int:
    """A bit per letter, set if the letter occurs an odd number of times: one edit changes two bits at most."""
    bits = 0
    for letter in word:
        bits ^= 1 << (ord(letter) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def gram_order(counted: DataFrame, q: int = Q) -> dict[str, tuple[int, int]]:
    """Of each gram its place in the global order, rarest first, and how often words have it.

    With the letters that words are made of there are 8,100 bigrams at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for word in tx.column(batch, "word").to_pylist():
                seen.update(map("".join, zip(*(word[i:] for i in range(q)))))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["gram", "n"])

    often = counted.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: (place, r["n"]) for place, r in enumerate(sorted(often, key=lambda r: (r["n"], r["gram"])))}


def prefixes(counted: DataFrame, q: int = Q, edits: int = EDITS) -> DataFrame:
    """The places of each word's rarest grams, and which of them are its pivots."""
    shared = counted.sparkSession.sparkContext.broadcast(gram_order(counted, q))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for word, n in zip(*(tx.column(batch, c).to_pylist() for c in ("word", "n"))):
                ranked = sorted((*order[word[i : i + q]], i) for i in range(len(word) - q + 1))
                first, found = prefix(ranked, q, edits)
                chosen = {place for _, place in pivots([g[1:] for g in first], q, edits)}
                bits = letters(word)
                for _, _, place in found:
                    for column, value in zip(out, (word, n, bits, len(word), place, place in chosen)):
                        column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["word", "n", "letters", "len", "place", "pivot"])

    return counted.mapInArrow(work, GRAM_SCHEMA)


def one_edit(a: Column, b: Column) -> Column:
    """Whether two different words are one edit apart, by the length of what they begin with in common.

    That length is found by halving, so the time hardly grows faster than the words.
    """
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))

    def halve(found: Column, step: Column) -> Column:
        upto = found + step
        return F.when((upto <= shorter) & (F.left(a, upto) == F.left(b, upto)), upto).otherwise(found)

    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    common = F.aggregate(steps, F.lit(0), halve)
    rest = longer - common - 1
    return (longer - shorter <= 1) & (F.right(a, rest) == F.right(b, rest))


def near_pairs(grams: DataFrame, q: int = Q) -> DataFrame:
    """(a, a_n, b, b_n), a < b: every pair of words at distance one, once.

    A pivot that an edit leaves whole has the edit on one side, so it stands at the same place from
    the other side's end of the word, and the word is the same up to there. For each difference
    in length and each side that gives the place, the length and the piece of word to look up.
    """
    end = F.col("place") + q
    head, tail = F.substring("word", F.lit(1), end), F.substring("word", F.col("place") + 1, F.col("len"))

    def key(side: str, longer: int):
        """Where to look for words ``longer`` by so much, with the edit behind (or before) the gram."""
        place = F.col("place") + (longer if side == "before" else 0)
        return F.struct(F.lit(side).alias("side"), (F.col("len") + longer).alias("l"), place.alias("p"), F.xxhash64(tail if side == "before" else head).alias("piece"))

    listed = grams.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("letters").alias("b_letters"), F.explode(F.array(key("before", 0), key("behind", 0))).alias("k"))
    places = F.array(*[key(side, longer) for side in ("before", "behind") for longer in (-1, 0, 1)])
    asked = grams.filter("pivot").select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("letters").alias("a_letters"), F.explode(places).alias("k")).filter("k.p >= 0")
    sides = ["side", "l", "p", "piece"]
    asked = asked.select("a", "a_n", "a_letters", *[F.col(f"k.{c}").alias(f"a_{c}") for c in sides])
    listed = listed.select("b", "b_n", "b_letters", *[F.col(f"k.{c}").alias(f"b_{c}") for c in sides])
    # Letters are compared first: most words that meet differ in more of them than one edit can change.
    same = (F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= EDITS * 2) & (F.col("a") != F.col("b"))
    for c in sides:
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    # The built-in distance takes the square of the length, which only short words can afford.
    short = asked.join(listed.filter(F.col("b_l") <= LONG), same & (F.levenshtein("a", "b", 1) == 1))
    long = asked.join(listed.filter(F.col("b_l") > LONG), same & one_edit(F.col("a"), F.col("b")))
    found = short.union(long).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "a_n", "b_n")
    swapped = F.col("x") != F.col("a")
    return found.select(
        F.col("x").alias("a"), F.when(swapped, F.col("b_n")).otherwise(F.col("a_n")).alias("a_n"),
        F.col("y").alias("b"), F.when(swapped, F.col("a_n")).otherwise(F.col("b_n")).alias("b_n"),
    ).distinct()


def written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends. Each round doubles the steps taken.

    A form occurs at least twice as often as its word, so no chain returns to itself, and
    none is longer than a count has bits.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = now.join(onward, F.col("root") == F.col("_w"), "left")
        now = written(moved.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "roots")
        if now.filter("_moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, **settings: int) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word that occurs often enough."""
    counted = written(words(docs, least, often, **settings), "words")
    pairs = written(near_pairs(written(prefixes(counted), "grams")), "word-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select("b", "b_n", "a", "a_n")
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= 2 * F.col("n")
    near = written(
        near.select(
            F.col("word").alias("_word"), "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")
        ),
        "near",
    )
    ends = roots(near.filter("form IS NOT NULL").select(F.col("_word").alias("word"), "form")).withColumnRenamed("word", "_end")
    joined = counted.join(near, F.col("word") == F.col("_word"), "left").join(ends, F.col("word") == F.col("_end"), "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every frequent word with its most frequent near word and the root of its group."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
