"""Near duplicates by bottom-k sketches from one hash function.

Texts with equal shingle sets form one class, so copies are one row from then
on. A class keeps the k smallest shingle hashes. Two sets at the threshold
share most of them; by the prefix principle they also share one of the rarer
ones, so inverted lists are kept for the rarer retained values only. Pairs of a
list are estimated on the sketch of the union, and confirmed on full sets.

A list first links its members to two pivots, one of them its most central
member. What is connected by then needs no further pair. Members of lists that
still span components are compared block by block around their pivot: first on
sketches, which leaves those with a possible partner, then on full sets. Only
confirmed links leave a block, so a group of thousands of near copies, or of
texts around one passage, makes no table of pairs. No list is cut.

Defined results: null and empty texts, and rows without doc_id, are linked
with nothing; a row without doc_id has no component and is kept; rows that
repeat a doc_id and a text are one document. Equal doc_ids with different texts: ``near_duplicates`` takes
them for one document, linked with all that any of its texts is like; ``one_of_each`` for documents of
their own. Only ``doc_id`` and ``text`` are read. A text is held in one task, whole.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewatch.llm import text as tx
from pipewatch.llm.components import components
from pipewatch.sources.scratch import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Values a sketch retains.
K = 32
#: Bits of the filter that picks the texts to read again; 4 MB whatever the table holds.
FILTER_BITS = 1 << 25
#: Members of one group that are compared in one task; larger groups are compared block by block.
BLOCK = 1024
#: Chance that a pair right at the threshold shares too few retained values to be looked at.
MISS = 1e-9


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct 63-bit shingle hashes with their rows, sorted by both; the number of rows."""
    h, rows, n_words = tx.words(texts, lower=True)
    n = len(n_words)
    values, at = [], []
    if len(h) >= size:
        whole = rows[: len(h) - size + 1] == rows[size - 1 :]
        joint = np.full(int(whole.sum()), np.uint64(size), dtype=np.uint64)
        for k in range(size):
            joint = tx.mix(joint * tx.M1 + h[k : len(h) - size + 1 + k][whole])
        values.append(joint)
        at.append(rows[: len(h) - size + 1][whole])
    few = (n_words > 0) & (n_words < size)
    if few.any():
        # The whole sequence as one shingle: hash its words in order, shorter ones end early.
        first = np.concatenate([[0], np.cumsum(n_words)])[:-1][few]
        joint = n_words[few].astype(np.uint64) + np.uint64(1 << 20)
        for k in range(size - 1):
            more = n_words[few] > k
            joint[more] = tx.mix(joint[more] * tx.M1 + h[first[more] + k])
        values.append(joint)
        at.append(np.flatnonzero(few))
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n
    value, row = np.concatenate(values) >> np.uint64(1), np.concatenate(at)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new], n


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list column of the given stretches of ``values``."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    take = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts, lengths)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[take].view(np.int64)))


SKETCH_SCHEMA = "doc_id long, n long, s1 long, s2 long, sketch array<long>"


def sketch_rows(docs: DataFrame, size: int, k: int) -> DataFrame:
    """Per row: size of its set, two sums that identify the set, and its k smallest hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                value, row, n = shingles(tx.column(part, "text"), size)
                counts = np.bincount(row, minlength=n)
                starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
                sums = []
                for seed in (tx.M2, tx.M3):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(value * seed + tx.M1))])
                    sums.append((total[starts + counts] - total[starts]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [tx.column(part, "doc_id"), pa.array(counts.astype(np.int64)), *map(pa.array, sums), ragged(value, starts, np.minimum(counts, k))],
                    ["doc_id", "n", "s1", "s2", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SKETCH_SCHEMA)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(cid, set): the whole sorted set of each text, once for repeated rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                value, row, n = shingles(tx.column(part, "text"), size)
                counts = np.bincount(row, minlength=n)
                starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
                yield pa.RecordBatch.from_arrays([tx.column(part, "cid"), ragged(value, starts, counts)], ["cid", "set"])

    return docs.select("cid", "text").distinct().mapInArrow(work, "cid long, set array<long>")


def written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def surely_common(k: int, threshold: float, miss: float = MISS) -> int:
    """Of k values retained, how many two sets at the threshold share but for a chance of ``miss``; by the binomial tail."""
    below = 0.0
    for shared in range(k + 1):
        below += math.comb(k, shared) * threshold**shared * (1 - threshold) ** (k - shared)
        if below > miss:
            return max(1, shared)
    return k


def least_common(length: Column, k: int, threshold: float) -> Column:
    """Retained values that two sets at the threshold share at least.

    A full sketch shares a binomial number of k; a set smaller than k is
    retained whole, and a partner's sketch lacks few of its values.
    """
    full = surely_common(k, threshold)
    small = F.ceil(length * threshold - 1e-9) - F.greatest(F.lit(0), F.floor(length / threshold + 1e-9) - k)
    return F.when(length >= k, F.lit(full)).otherwise(F.greatest(F.lit(1), small)).cast("int")


def inverted_lists(classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """(v, cid, n, central): a class under each of the rarer values it retains, if others retain them too.

    ``central`` is large for a class whose values many others retain, such as the text
    that a group of near copies was made from.
    """
    values = classes.select("cid", "n", F.size("sketch").alias("len"), F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = values.join(often, "v").groupBy("cid", "n", "len").agg(
        F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared")
    )
    # Values nobody else retains are the rarest, so they fill the prefix first.
    prefix = F.col("len") - least_common(F.col("len"), k, threshold) + 1 - (F.col("len") - F.size("shared"))
    central = F.aggregate("shared", F.lit(0.0), lambda total, e: total + F.log1p(e["df"].cast("double")))
    listed = shared.filter(prefix > 0).select("cid", "n", central.alias("central"), F.slice("shared", F.lit(1), prefix)["v"].alias("prefix"))
    return listed.select(F.explode("prefix").alias("v"), "cid", "n", "central")


def alike_sizes(a: str, b: str, threshold: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * threshold - 1e-9


def likely(pairs: DataFrame, classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity, estimated on the sketch of the union, may reach the threshold."""
    left = classes.select(F.col("cid").alias("a"), F.col("sketch").alias("_sa"))
    right = classes.select(F.col("cid").alias("b"), F.col("sketch").alias("_sb"))
    lowest = F.slice(F.array_sort(F.array_union("_sa", "_sb")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("_sa", "_sb"), lowest))
    # A union of fewer values is retained whole, and its similarity is exact.
    needed = F.when(F.size(lowest) >= k, F.lit(surely_common(k, threshold))).otherwise(F.size(lowest) * threshold - 1e-9)
    found = pairs.join(left, "a").join(right, "b").filter(common >= needed)
    return found.select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    inter = F.size(F.array_intersect("_x", "_y"))
    union = F.size("_x") + F.size("_y") - inter
    both = pairs.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("_y")), "b").join(
        sets.select(F.col("cid").alias("a"), F.col("set").alias("_x")), "a"
    )
    return both.filter(100 * inter >= round(threshold * 100) * union).select("a", "b")


def with_pivots(lists: DataFrame) -> DataFrame:
    """The lists of two members or more, each row with the list's smallest and most central class."""
    ends = lists.groupBy("v").agg(
        F.max(F.struct("central", "cid", "n")).alias("m"), F.min(F.struct("cid", "n")).alias("l"), F.max("cid").alias("high")
    ).filter("l.cid < high")
    return lists.join(ends, "v").select(
        "v", "cid", "n", F.col("l.cid").alias("low"), F.col("l.n").alias("low_n"), F.col("m.cid").alias("middle"), F.col("m.n").alias("middle_n")
    )


def pivot_pairs(lists: DataFrame, threshold: float) -> DataFrame:
    """Each member of a list with both pivots, unless the sizes of their sets rule the threshold out."""
    pivots = F.array(*[F.struct(F.col(p).alias("pivot"), F.col(f"{p}_n").alias("pivot_n")) for p in ("low", "middle")])
    both = lists.select("cid", "n", F.explode(pivots).alias("p")).select("cid", "n", "p.*")
    both = both.filter((F.col("cid") != F.col("pivot")) & alike_sizes("n", "pivot_n", threshold))
    return both.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(cid, text) of the rows whose doc_id is among ``ids``.

    A bitmap of hashed ids, of fixed size, lets most other texts out before the
    join, so few texts are shuffled.
    """
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bitmap = (
        ids.select(hashed("cid").alias("h"))
        .groupBy(F.bitmap_bucket_number("h").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))
    )
    place = F.bitmap_bit_position("_h")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_h) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    passed = (
        docs.withColumn("_h", hashed("doc_id"))
        .join(F.broadcast(bitmap), F.bitmap_bucket_number("_h") == F.col("_bucket"))
        .filter(F.getbit(byte, (place % 8).cast("int")) == 1)
        .select("doc_id", "text")
    )
    return passed.join(ids, passed["doc_id"] == ids["cid"]).select("cid", "text")


def open_groups(lists: DataFrame, joined: DataFrame, threshold: float) -> DataFrame:
    """(g, cid, n, c): members, sizes and components, by the list's central class, of lists that span several.

    The pivots are left out: every pair with one of them has been decided.
    """
    rest = lists.filter("cid != low AND cid != middle")
    placed = rest.join(joined, rest["cid"] == joined["node"], "left").withColumn("c", F.coalesce("component", "cid"))
    # Sets that can be alike lie in the same step of sizes or in neighbouring ones, so a member
    # matters where two neighbouring steps of its list hold several components.
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    placed = placed.withColumn("step", step.cast("int"))
    of_steps = placed.select("v", F.explode(F.array(F.col("step") - 1, "step")).alias("s"), "c").groupBy("v", "s").agg(F.min("c").alias("first"), F.max("c").alias("last"))
    mixed = of_steps.filter("first < last").select(F.col("v").alias("of"), "s")
    # A row of a list is a member once at most.
    members = placed.join(mixed, (F.col("v") == F.col("of")) & F.col("s").between(F.col("step") - 1, F.col("step")), "left_semi")
    return members.select(F.col("middle").alias("g"), "cid", "n", "c").distinct()


def blocks(members: DataFrame) -> DataFrame:
    """Each member once for every pair (i, j) of blocks of its group that it lies in."""
    sizes = members.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n"))
    placed = members.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("cid"), "_n").cast("int"))
    other = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return other.select(*members.columns, "own", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"))


def shared_lowest(mark: np.ndarray, which: np.ndarray, place: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Of each sketch, how many values it has in common with the marked one among the k lowest of their union.

    ``mark`` has the place, from 1, that a value has in the marked sketch, else 0; ``place``, from 0, that of
    each of ``which`` in its own. A common value's place in the union follows from both, and from the
    common ones before it.
    """
    other = mark[which]
    common = other > 0
    before = np.cumsum(common) - common
    before -= np.repeat(before[starts[:-1]], np.diff(starts))
    return np.add.reduceat((common & (other - 1 + place - before < k)).astype(np.int64), starts[:-1])


def matches(members: DataFrame, values: DataFrame, rule: str, k: int, threshold: float) -> DataFrame:
    """What members of a block pair in different components have in common.

    ``members`` has g, cid, n (the size of the set) and c, ``values`` cid and ``values``. Sizes alone rule most pairs out. Rule "sets" compares full
    sets and returns the links (a, b); rule "sketches" returns (g, cid) as (a, b), of members whose sketch lets a pair with some other
    of their group pass as ``likely`` does, since such pairs are still to be confirmed. Members are dealt to blocks before values are joined, so these are moved once.
    """
    bound, full = round(threshold * 100), surely_common(k, threshold)
    wanted = np.array([least_common_of(m, k, threshold) for m in range(k + 1)])

    def compare(g: int, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        cid, c, own, n = (np.array([r[x] for r in rows]) for x in (0, 1, 2, 4))
        size = np.array([len(r[3]) for r in rows])
        names, biggest = np.unique(c, return_counts=True)
        if len(names) < 2:
            return
        which = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(starts[-1]) - np.repeat(starts[:-1], size)
        mark = np.zeros(which.max() + 1, dtype=np.int64)
        two = len(np.unique(own)) > 1
        for u in np.flatnonzero(c != names[biggest.argmax()]):
            at = which[starts[u] : starts[u + 1]]
            mark[at] = np.arange(1, len(at) + 1)
            inter = np.add.reduceat((mark[which] > 0).astype(np.int64), starts[:-1])
            if rule == "sets":
                good = 100 * inter >= bound * (size + size[u] - inter)
            else:
                good = inter >= np.minimum(wanted[size], wanted[size[u]])
            good &= (c != c[u]) & (100 * np.minimum(n, n[u]) >= bound * np.maximum(n, n[u]))
            if two:
                good &= own != own[u]
            if rule == "sketches" and good.any():
                lowest = np.minimum(size + size[u] - inter, k)
                good &= shared_lowest(mark, which, place, starts, k) >= np.where(lowest >= k, full, lowest * threshold - 1e-9)
            mark[at] = 0
            found = np.flatnonzero(good)
            if rule == "sets":
                yield from ((min(cid[u], cid[x]), max(cid[u], cid[x])) for x in found)
            elif len(found):
                yield g, cid[u]
                yield from ((g, cid[x]) for x in found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def finished() -> pa.RecordBatch:
            out = sorted(set(compare(key[0], rows))) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([int(p[x]) for p in out], pa.int64()) for x in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(tx.column(batch, x).to_pylist() for x in ("g", "i", "j"))))
            cid, c, own, n = (tx.column(batch, x).to_pylist() for x in ("cid", "c", "own", "n"))
            lists = tx.column(batch, "values")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for r, now in enumerate(keys):
                if now != key:
                    if rows:
                        yield finished()
                    key, rows = now, []
                rows.append((cid[r], c[r], own[r], flat[offsets[r] : offsets[r + 1]].copy(), n[r]))
        if rows:
            yield finished()

    placed = blocks(members).join(values, "cid").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "cid")
    return placed.mapInArrow(work, "a long, b long").distinct()


def least_common_of(length: int, k: int, threshold: float) -> int:
    """``least_common`` of a plain number."""
    if length >= k:
        return surely_common(k, threshold)
    return max(1, math.ceil(length * threshold - 1e-9) - max(0, math.floor(length / threshold + 1e-9) - k))


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Rows are linked at Jaccard similarity ``threshold`` or more of their sets of
    ``size``-word shingles; a component is named by its smallest doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(sketch_rows(docs, size, k), "sketches")
    known = rows.filter("n > 0 AND doc_id IS NOT NULL")
    key = ["n", "s1", "s2"]
    classes = written(
        known.groupBy(*key).agg(F.min("doc_id").alias("cid"), F.any_value("sketch").alias("sketch")), "classes"
    )
    lists = written(with_pivots(inverted_lists(classes, k, threshold)), "lists")
    near = written(likely(pivot_pairs(lists, threshold), classes, k, threshold), "likely")
    ends = near.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    sets = written(full_sets(among(docs, ends), size), "sets")
    first = written(confirmed(near, sets, threshold), "links")

    groups = written(open_groups(lists, components(first, "a", "b"), threshold), "open")
    # Half of each value's bits will do: equal ones only let more pairs pass to be confirmed.
    halves = F.transform("sketch", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))
    able = written(matches(groups, classes.select("cid", halves.alias("values")), "sketches", k, threshold).select(F.col("a").alias("g"), F.col("b").alias("cid")), "able")
    full = full_sets(among(docs, able.select("cid").distinct()), size).withColumnRenamed("set", "values")
    second = written(matches(groups.join(able, ["g", "cid"], "left_semi"), full, "sets", k, threshold), "links")

    # A doc_id with several texts joins the classes of all of them.
    of_class = known.select("doc_id", *key).join(classes.select(*key, "cid"), key)
    several = known.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y"))
    several = several.filter("x != y").select(F.col("doc_id").alias("a"))
    own = of_class.join(several, of_class["doc_id"] == several["a"]).select("a", F.col("cid").alias("b"))
    joined = components(first.union(second).union(own), "a", "b")

    placed = (
        rows.select("doc_id", *key)
        .join(classes.select(*key, F.col("cid")), key, "left")
        .withColumn("cid", F.coalesce("cid", "doc_id"))
        .join(joined, F.col("cid") == F.col("node"), "left")
    )
    component = F.coalesce("component", "cid")
    return placed.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, and all rows without doc_id.

    Rows that share a doc_id but not their text are documents of their own: they are linked by
    their texts only, and each gets a number of its own below 0 for that. Of rows that agree in doc_id and
    text the first by a hash of all columns stays, so runs agree.
    """
    mine = ["dup_id", "dup_of", "dup_place"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in mine])
    text, known = F.xxhash64(F.coalesce("text", F.lit(""))), docs.filter(F.col("doc_id").isNotNull())
    several = known.groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).filter("lo != hi").select(F.col("doc_id").alias("dup_of"))
    # Written, so that its size is known before texts are joined with it, which happens each time they are read.
    several = written(several, "several")
    drawn = -F.pmod(F.xxhash64("doc_id", text), F.lit((1 << 62) - 1)) - 1
    named = known.join(several, F.col("doc_id") == F.col("dup_of"), "left").withColumn(
        "dup_id", F.when(F.col("dup_of").isNull(), F.col("doc_id").cast("long")).otherwise(drawn)
    )
    found = near_duplicates(named.select(F.col("dup_id").alias("doc_id"), "text"), **settings).select("doc_id", "component_id").distinct()
    drawn_ids = named.filter("dup_of IS NOT NULL").select(F.col("dup_id").alias("of"), F.col("dup_of").cast("long").alias("real")).distinct()
    members = found.join(drawn_ids, found["doc_id"] == F.col("of"), "left")
    first = F.min(F.struct(F.coalesce("real", "doc_id").alias("real"), F.col("doc_id").alias("id")))
    leaders = members.groupBy("component_id").agg(first.alias("first")).select(F.col("first.id").alias("leader"))
    kept = named.join(leaders, F.col("dup_id") == F.col("leader"), "left_semi")
    once = Window.partitionBy("dup_id").orderBy(F.xxhash64(*[F.col(c).cast("string") for c in docs.columns]))
    kept = kept.withColumn("dup_place", F.row_number().over(once)).filter("dup_place = 1")
    return kept.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's component by two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), size=2)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])
                      WHEN len(w) = 1 THEN w ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, s FROM s),
e AS (SELECT doc_id, n, unnest(s) AS x FROM n),
f AS (SELECT doc_id, n, x, count(*) OVER (PARTITION BY x) AS df FROM e),
r AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY df, x) AS place FROM f),
p AS (SELECT doc_id, n, x FROM (SELECT *, n - CAST(ceil(0.8 * n - 1e-9) AS BIGINT) + 1 AS most FROM r) WHERE place <= most),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id
      AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
j AS (SELECT c.a, c.b, x.n AS na, y.n AS nb, len(list_intersect(x.s, y.s)) AS common
      FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b),
l AS (SELECT a, b FROM j WHERE 100 * common >= 80 * (na + nb - common)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (WITH RECURSIVE t(doc_id, reach) AS (
        SELECT doc_id, doc_id FROM n UNION SELECT u.b, t.reach FROM t JOIN u ON u.a = t.doc_id AND t.reach < u.b)
      SELECT doc_id, min(reach) AS component_id FROM t GROUP BY doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, t.component_id, n.doc_id = t.component_id AS kept
FROM n JOIN t USING (doc_id)
"""
