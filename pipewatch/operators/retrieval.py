"""A search index stored as a table, and the k best documents per query by BM25, exactly.

The corpus is tokenized once. Documents are dealt to shards by hash; a row of the index is
the posting list of one term in one shard, in order of documents, with the list cut into
blocks of documents: per block the largest count and the shortest document, which bound what
the term adds to any score there. The table is bucketed by shard, so a search moves no postings, unless
many queries meet fewer shards than there are cores: then their terms' lists are dealt to several tasks, each with its slice of the queries.

A search scores the most promising blocks of a shard first. Blocks whose bounds add up to less
than the k-th best score so far can't hold a better document and are left unread. A
shard hands on k documents per query at most.

Words that no document holds change no score, so a query is reduced to an ask: the words of it that the
index knows, with their counts. Queries of the same ask are answered once, and asks that differ in short
lists only share the search of their long ones.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipewatch.sources.scratch import scratch_path

# Executors get these functions with the task, without this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# BM25's saturation and length weight.
K1, B = 1.2, 0.75
#: Documents of a shard and of a block, about.
SHARD_DOCS, BLOCK_DOCS = 4096, 64
#: Buckets of the table at most; beyond that, shards share buckets.
MOST_BUCKETS = 4096
#: Terms of queries that are answered by one pass over the index, about; they are sent to every task.
PASS_TERMS = 1 << 18
#: Terms of queries that a task answers from one shard, about, while there are cores for more tasks.
SLICE_TERMS = 1 << 12
#: Lists up to this long are read whole; longer ones are searched block by block, once for all asks that weigh the same long lists.
SHORT_LIST = 16
#: Counts looked up for an ask at most, so that its short lists are read; beyond that all of its lists are searched by blocks.
LOOKUPS = 1 << 12
#: Counts looked up at once, about.
LOOKED_UP = 1 << 20
#: Scores are compared at this many digits.
DIGITS = 6
#: Scored pairs that a task hands on at once, about.
PAIRS = 1 << 16


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@dataclass(frozen=True)
class SearchIndex:
    """A stored index: its postings table and the name of its document column."""

    spark: SparkSession
    name: str
    path: str
    buckets: int
    doc: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def documents(self) -> tuple[int, float]:
        """Documents in the index, and the mean length of those with a text."""
        sizes = self.rows.filter("term IS NULL").agg(F.sum("n_docs"), F.sum("n_texts"), F.sum("n_words")).first()
        return sizes[0] or 0, (sizes[2] or 0) / max(sizes[1] or 0, 1)


def _schema(doc_type: str) -> str:
    return (
        "shard long, term string, blocks array<int>, starts array<int>, most array<int>, least array<int>, "
        f"docs array<{doc_type}>, counts array<int>, lengths array<int>, n_docs long, n_texts long, n_words long"
    )


def _lists(values: pa.Array, opens: np.ndarray) -> pa.Array:
    """A list column that begins a new list at each of ``opens``."""
    return pa.ListArray.from_arrays(pa.array(np.append(opens, len(values)).astype(np.int32)), values)


def invert(group: pa.Table, block_docs: int) -> list[pa.Array]:
    """Columns of the index for the documents (shard, doc, words) of one shard, sizes first as a row without term."""
    group = group.sort_by("doc").combine_chunks()
    words, ids = (group.column(c).chunk(0) if group.num_rows else group.column(c).combine_chunks() for c in ("words", "doc"))
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode(null_encoding="encode")
    n = len(ids)
    # Postings in order of term and document, and where each list and each block of it opens.
    place, counts = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
    term, row = place // max(n, 1), place % max(n, 1)
    block = row // block_docs
    new_list = np.ones(len(place), dtype=bool)
    new_list[1:] = term[1:] != term[:-1]
    new_block = new_list.copy()
    new_block[1:] |= block[1:] != block[:-1]
    lists, cells = np.flatnonzero(new_list), np.flatnonzero(new_block)
    first_cell = np.searchsorted(cells, lists)
    of_list = np.cumsum(new_list)[cells] - 1
    most = np.maximum.reduceat(counts, cells) if len(cells) else counts
    least = np.minimum.reduceat(lengths[row], cells) if len(cells) else counts
    small = lambda a: pa.array(a.astype(np.int32))
    shard = group.column("shard")[0].as_py()

    def with_sizes(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.nulls(1, column.type), column])

    return [
        pa.array([shard] * (len(lists) + 1), pa.int64()),
        with_sizes(coded.dictionary.take(pa.array(term[lists])).cast(pa.string())),
        with_sizes(_lists(small(block[cells]), first_cell)),
        with_sizes(_lists(small(cells - lists[of_list]), first_cell)),
        with_sizes(_lists(small(most), first_cell)),
        with_sizes(_lists(small(least), first_cell)),
        with_sizes(_lists(ids.take(pa.array(row)), lists)),
        with_sizes(_lists(small(counts), lists)),
        with_sizes(_lists(small(lengths[row]), lists)),
        *(pa.array([size] + [None] * len(lists), pa.int64()) for size in (n, n - words.null_count, int(lengths.sum()))),
    ]


def write_index(corpus: DataFrame, path: str | None = None, doc: str = "id", text: str = "content",
                shard_docs: int = SHARD_DOCS, block_docs: int = BLOCK_DOCS) -> SearchIndex:
    """Store the index of ``corpus`` under ``path``: every row is a document, a null text has no words.

    Rows that share an id are documents of their own; a shard is drawn from id and text, so copies spread.
    """
    spark = corpus.sparkSession
    path = path or scratch_path(spark, "search-index")
    shards = max(1, -(-corpus.count() // shard_docs))
    kind = corpus.schema[doc].dataType.simpleString()
    schema = _schema(kind)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def work(group: pa.Table) -> pa.Table:
        return pa.table(invert(group, block_docs), names=names)

    dealt = corpus.select(
        F.pmod(F.xxhash64(doc, text), F.lit(shards)).alias("shard"), F.col(doc).alias("doc"), tokens(F.col(text)).alias("words")
    )
    lists = dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(work, schema)
    buckets = min(shards, MOST_BUCKETS)
    name = f"postings_{uuid.uuid4().hex}"
    lists.write.format("parquet").bucketBy(buckets, "shard").sortBy("term").option("path", path).saveAsTable(name)
    return SearchIndex(spark, name, path, buckets, doc)


def open_index(spark: SparkSession, path: str, buckets: int, doc: str = "id") -> SearchIndex:
    """An index stored by another session."""
    name = f"postings_{uuid.uuid4().hex}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (shard) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return SearchIndex(spark, name, path, buckets, doc)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all stretches, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Shard:
    """One shard's lists of the wanted terms, as flat arrays."""

    def __init__(self, group: pa.Table, mean_length: float):
        group = group.combine_chunks()
        column = lambda c: group.column(c).combine_chunks() if group.column(c).num_chunks != 1 else group.column(c).chunk(0)
        flat = lambda c: column(c).flatten().to_numpy(zero_copy_only=False)
        sizes = lambda c: pc.list_value_length(column(c)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.terms = {t: i for i, t in enumerate(column("term").to_pylist())}
        coded = column("docs").flatten().dictionary_encode(null_encoding="encode")
        self.ids, self.doc = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.order = np.empty(len(self.ids), dtype=np.int64)
        self.order[pc.sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(len(self.ids))

        def gain(count: np.ndarray, length: np.ndarray) -> np.ndarray:
            return count * (K1 + 1) / (count + K1 * ((1 - B) + B * length / mean_length))

        self.gain = gain(flat("counts"), flat("lengths"))
        n_cells, n_postings = sizes("blocks"), sizes("docs")
        self.first_cell, self.n_cells = np.cumsum(n_cells) - n_cells, n_cells
        self.block, self.bound = flat("blocks").astype(np.int64), gain(flat("most"), flat("least"))
        of_term = np.repeat(np.arange(len(n_cells)), n_cells)
        self.cell_start = flat("starts") + (np.cumsum(n_postings) - n_postings)[of_term]
        self.cell_length = np.diff(np.append(self.cell_start, len(self.doc)))
        self.n_blocks = int(self.block.max()) + 1 if len(self.block) else 0
        self.first_posting, self.n_postings = np.cumsum(n_postings) - n_postings, n_postings
        # Lists are in order of documents, so these ascend: (term, place of the document in that order).
        rank = np.empty(len(self.ids), dtype=np.int64)
        rank[pc.sort_indices(self.ids, null_placement="at_end").to_numpy()] = np.arange(len(self.ids))
        self.rank, self.found_at = rank, np.repeat(np.arange(len(n_postings)) * len(rank), n_postings) + rank[self.doc]
        self.repeats = np.zeros(len(n_postings), dtype=bool)
        self.repeats[self.found_at[1:][np.diff(self.found_at) == 0] // max(len(rank), 1)] = True

    def summed(self, postings: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of postings, and what each gains."""
        sums = np.bincount(self.doc[postings], weights=gains, minlength=len(self.ids))
        docs = np.flatnonzero(np.bincount(self.doc[postings], minlength=len(self.ids)))
        return docs, sums[docs]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents (by place in ``ids``) with their scores, and how many postings were read."""
        cells = ragged(self.first_cell[terms], self.n_cells[terms])
        weight = np.repeat(weights, self.n_cells[terms])
        bounds = np.bincount(self.block[cells], weights=weight * self.bound[cells], minlength=self.n_blocks)
        found, scores, read = np.zeros(0, np.int64), np.zeros(0), 0
        waiting = bounds > 0
        slack = 10.0**-DIGITS
        while waiting.any():
            # The most promising eighth of what is left, one block at least.
            left = np.flatnonzero(waiting)
            now = np.zeros_like(waiting)
            now[left[np.argsort(-bounds[left], kind="stable")[: max(1, len(left) // 8)]]] = True
            waiting &= ~now
            mine = now[self.block[cells]]
            at, lengths = cells[mine], self.cell_length[cells[mine]]
            postings = ragged(self.cell_start[at], lengths)
            read += len(postings)
            docs, sums = self.summed(postings, self.gain[postings] * np.repeat(weight[mine], lengths))
            found, scores = np.concatenate([found, docs]), np.concatenate([scores, sums])
            keep = np.lexsort((self.order[found], -np.round(scores, DIGITS)))[:k]
            found, scores = found[keep], scores[keep]
            if len(found) == k:
                waiting &= bounds >= scores[-1] - slack
        return found, scores, read

    def answer(self, of: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score): the k best documents of many queries, given as (query, term, weight) in order of queries.

        A document in none of a query's short lists has the score that its long lists give it. So the k best are
        among those in the short lists and the k best by the long ones, which are searched once for all queries alike.
        """
        opens = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
        n_terms = np.diff(np.append(opens, len(of)))
        row = np.repeat(np.arange(len(opens)), n_terms)
        short = self.n_postings[terms] <= SHORT_LIST
        cost = (np.bincount(row, weights=short * self.n_postings[terms], minlength=len(opens)) + k) * n_terms
        # Rows that share an id make one document of a block, which only a search by blocks brings together.
        repeated = np.bincount(row, weights=self.repeats[terms], minlength=len(opens)) > 0
        short &= ((cost <= LOOKUPS) & ~repeated)[row]
        n_long = np.bincount(row, weights=~short, minlength=len(opens)).astype(np.int64)
        ends = np.cumsum(n_long)
        long_terms, long_weights = terms[~short], weights[~short]
        known: dict[tuple[bytes, bytes], int] = {}
        which, answers = np.zeros(len(opens), dtype=np.int64), [(np.zeros(0, np.int64), np.zeros(0))]
        for i, (a, b) in enumerate(zip((ends - n_long).tolist(), ends.tolist())):
            if a < b:
                same = long_terms[a:b].tobytes(), long_weights[a:b].tobytes()
                if same not in known:
                    known[same] = len(answers)
                    answers.append(self.best(long_terms[a:b], long_weights[a:b], k)[:2])
                which[i] = known[same]
        sizes = np.array([len(d) for d, _ in answers])
        docs, scores = (np.concatenate([a[c] for a in answers]) for c in (0, 1))
        first = np.cumsum(sizes) - sizes

        def by_long(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The rows' best documents by their long lists: (row, place in ``docs``)."""
            return np.repeat(rows, sizes[which[rows]]), ragged(first[which[rows]], sizes[which[rows]])

        whole = n_long == n_terms
        rows, at = by_long(np.flatnonzero(whole))
        out = [(of[opens[rows]], docs[at], scores[at])]
        mixed = np.flatnonzero(~whole)
        batch = np.cumsum(cost[mixed]) // LOOKED_UP
        for rows in np.split(mixed, np.flatnonzero(np.diff(batch)) + 1) if len(mixed) else []:
            lists = ragged(opens[rows], n_terms[rows])
            lists = lists[short[lists]]
            lengths = self.n_postings[terms[lists]]
            mine, at = by_long(rows)
            n = len(self.ids)
            pairs = np.concatenate([
                np.repeat(row[lists], lengths) * n + self.doc[ragged(self.first_posting[terms[lists]], lengths)], mine * n + docs[at]
            ])
            asker, doc = np.divmod(np.unique(pairs), n)
            pair, term = np.repeat(np.arange(len(asker)), n_terms[asker]), ragged(opens[asker], n_terms[asker])
            wanted = terms[term] * n + self.rank[doc][pair]
            at = np.minimum(np.searchsorted(self.found_at, wanted), len(self.found_at) - 1)
            held = self.found_at[at] == wanted
            score = np.bincount(pair[held], weights=self.gain[at[held]] * weights[term[held]], minlength=len(asker))
            ranked = np.lexsort((self.order[doc], -np.round(score, DIGITS), asker))
            opened = np.flatnonzero(np.append(True, asker[1:] != asker[:-1])[: len(asker)])
            place = np.arange(len(asker)) - np.repeat(opened, np.diff(np.append(opened, len(asker))))
            ranked = ranked[place < k]
            out.append((of[opens[asker[ranked]]], doc[ranked], score[ranked]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def every(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents (by place in ``ids``) that hold one of the terms, with their scores."""
        cells = ragged(self.first_cell[terms], self.n_cells[terms])
        lengths = self.cell_length[cells]
        postings = ragged(self.cell_start[cells], lengths)
        weight = np.repeat(np.repeat(weights, self.n_cells[terms]), lengths)
        return self.summed(postings, self.gain[postings] * weight)


def asked_of(shard: Shard, asked: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The queries' keys, and of every query's terms in the shard: its key's place, term and weight."""
    place = np.array([shard.terms.get(t, -1) for t in asked.column("term").to_pylist()], dtype=np.int64)
    coded = asked.column("query").combine_chunks().dictionary_encode(null_encoding="encode")
    here = place >= 0
    of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, of[here], place[here], asked.column("weight").to_numpy()[here]


def slice_of(asked: pa.Table, number: int) -> pa.Table:
    """A slice's queries of a pass."""
    return asked.filter(pc.equal(asked.column("slice"), number))


def answering(shared, mean_length: float, k: int):
    """The function that answers a pass's queries (query, term, weight), sorted by query, from one shard's lists."""

    def work(key: tuple, group: pa.Table) -> pa.Table:
        shard = Shard(group, mean_length)
        keys, of, terms, weights = asked_of(shard, slice_of(shared.value, key[1].as_py()))
        queries, docs, scores = shard.answer(of, terms, weights, k)
        return pa.table([keys.take(pa.array(queries)), shard.ids.take(pa.array(docs)), pa.array(scores)], names=["query", "doc", "score"])

    return work


def scoring(shared, mean_length: float):
    """The function that scores all documents of one shard's lists for a pass's queries, a bounded number of pairs at a time."""

    def work(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(pa.Table.from_batches(list(group)), mean_length)
        keys, of, terms, weights = asked_of(shard, slice_of(shared.value, key[1].as_py()))
        opens = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)]).tolist()
        queries, docs, scores, waiting = [], [], [], 0

        def pairs() -> pa.RecordBatch:
            taken = keys.take(pa.array(np.concatenate(queries))), shard.ids.take(pa.array(np.concatenate(docs)))
            return pa.RecordBatch.from_arrays([*taken, pa.array(np.concatenate(scores))], names=["query", "doc", "score"])

        for a, b in zip(opens, [*opens[1:], len(of)]):
            found, score = shard.every(terms[a:b], weights[a:b])
            queries.append(np.full(len(found), of[a]))
            docs.append(found)
            scores.append(score)
            waiting += len(found)
            if waiting >= PAIRS:
                yield pairs()
                queries, docs, scores, waiting = [], [], [], 0
        if waiting:
            yield pairs()

    return work


def _asked(index: SearchIndex, queries: DataFrame, qid: str, qtext: str, n_docs: int) -> tuple[DataFrame, DataFrame]:
    """(query, ask) of every query with a word in the index, and the asks as queries (query, term, weight); rows that share a query are one."""
    spark = index.spark
    paths = {name: scratch_path(spark, name) for name in ("term-counts", "query-asks", "ask-terms")}
    listed = index.rows.filter("term IS NOT NULL").select("term", F.size("docs").alias("df"))
    # Written, so that its size is known where it is joined.
    listed.groupBy("term").agg(F.sum("df").alias("df")).write.parquet(paths["term-counts"])
    df = spark.read.parquet(paths["term-counts"])
    words = queries.select(F.col(qid).alias("query"), F.explode(tokens(F.col(qtext))).alias("term"))
    counted = words.join(df.select("term"), "term", "left_semi").groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    bags = counted.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("bag"))
    # Terms are letters and digits, so two bags never make one text; asks are told apart by its 128 bits.
    text = F.array_join(F.transform("bag", lambda b: F.concat_ws(" ", b["term"], b["qtf"])), " ")
    bags.select("query", F.md5(text).alias("ask"), "bag").write.parquet(paths["query-asks"])
    asked = spark.read.parquet(paths["query-asks"])
    weight = F.col("qtf") * F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.select("ask", "bag").distinct().select("ask", F.inline("bag")).join(df, "term")
    terms.select(F.col("ask").alias("query"), "term", weight.alias("weight")).write.parquet(paths["ask-terms"])
    return asked.select("query", "ask"), spark.read.parquet(paths["ask-terms"])


def _answers(index: SearchIndex, queries: DataFrame, qid: str, qtext: str, pass_terms: int, work: Callable) -> tuple[DataFrame, DataFrame]:
    """(query, ask) rows, and the (ask, doc, score) rows that ``work(shared, mean_length)`` makes of every shard and pass.

    Asks are answered in passes over the index; what a pass sends to the tasks is bounded by ``pass_terms``,
    whatever their number.
    """
    spark = index.spark
    n_docs, mean_length = index.documents()
    asked, weighted = _asked(index, queries, qid, qtext, n_docs)
    n_terms = weighted.count()
    passes = max(1, -(-n_terms // pass_terms))
    schema = f"query string, doc {index.rows.schema['docs'].dataType.elementType.simpleString()}, score double"
    found = scratch_path(spark, "query-hits")
    # Few shards leave cores idle, so a pass's asks are cut into slices, each answered from every shard.
    shards = index.rows.filter("term IS NULL").count()
    wide = -(-2 * spark.sparkContext.defaultParallelism // max(shards, 1))
    slices = max(1, min(wide, -(-min(n_terms, pass_terms) // SLICE_TERMS)))
    for number in range(passes):
        mine = weighted.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == number)
        # About pass_terms rows: the bound of what is collected and sent.
        sliced = mine.withColumn("slice", F.pmod(F.xxhash64("query", F.lit(1)), F.lit(slices)))
        table = sliced.toArrow().sort_by([("query", "ascending"), ("term", "ascending")])
        shared = spark.sparkContext.broadcast(table)

        terms = F.broadcast(spark.createDataFrame(pa.table({"term": table.column("term").unique()}))) if table.num_rows else mine.select("term")
        lists = index.rows.join(terms, "term", "left_semi")
        dealt = lists.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        dealt = dealt.repartition(shards * slices, "shard", "slice") if slices > 1 else dealt
        dealt.groupBy("shard", "slice").applyInArrow(work(shared, mean_length), schema).write.mode("append").parquet(found)
        shared.unpersist()
    return asked, spark.read.schema(schema).parquet(found).withColumnRenamed("query", "ask")


def answers(index: SearchIndex, queries: DataFrame, k: int = 5, qid: str = "query_id", qtext: str = "query",
            pass_terms: int = PASS_TERMS) -> tuple[DataFrame, DataFrame]:
    """(query, ask), and (ask, document, score, place): the k best documents of each ask, ties to the smaller id."""
    asked, hits = _answers(index, queries, qid, qtext, pass_terms, lambda shared, mean_length: answering(shared, mean_length, k))
    hits = hits.withColumn("score", F.round("score", DIGITS))
    best = Window.partitionBy("ask").orderBy(F.col("score").desc(), F.col("doc").asc())
    ranked = hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return (
        asked.select(F.col("query").alias(qid), F.col("ask").alias("_ask")),
        ranked.select(F.col("ask").alias("_ask"), F.col("doc").alias(index.doc), "score", "place"),
    )


def search(index: SearchIndex, queries: DataFrame, k: int = 5, qid: str = "query_id", qtext: str = "query",
           pass_terms: int = PASS_TERMS) -> DataFrame:
    """(query, document, score, place): the k best documents of each query, ties to the smaller id."""
    asked, ranked = answers(index, queries, k, qid, qtext, pass_terms)
    return asked.join(ranked, "_ask").drop("_ask")


def scores(index: SearchIndex, queries: DataFrame, qid: str = "query_id", qtext: str = "query",
           pass_terms: int = PASS_TERMS) -> DataFrame:
    """(query, document, score) of every document that shares a term with a query; rows that share an id are added up."""
    asked, pairs = _answers(index, queries, qid, qtext, pass_terms, scoring)
    summed = pairs.groupBy("ask", "doc").agg(F.round(F.sum("score"), DIGITS).alias("score"))
    return asked.join(summed, "ask").select(F.col("query").alias(qid), F.col("doc").alias(index.doc), "score")
