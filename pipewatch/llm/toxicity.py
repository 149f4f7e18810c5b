"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

Features of a whole text: densities of a fixed and of a learned lexicon, how
near the hits stand to second-person words, capitals, punctuation and
obfuscation. The trees and the calibration are fitted on a bounded sample of
labelled rows; neither labels nor any other column is an input of a score.

Defined results: a null text is an empty one and is scored like any other; a
null doc_id is never in the sample and never held out; a label given twice
counts once, as toxic if either says so; null labels are left out. With no
labels of both kinds the score is the share of toxic ones (0 without labels).
Columns the operator adds start with ``tox_`` and replace any of that name.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewatch.llm import text as tx
from pipewatch.sources.scratch import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows the model is fitted on, at most; drawn by hash of doc_id.
MAX_SAMPLE = 20_000
#: Share of the sample that fits the calibration instead of the trees.
CALIBRATION = 0.25
#: Entries of each learned lexicon (words, and word beginnings of STEM bytes), at most.
MAX_LEARNED = 400
STEM = 6

# Common insults and second-person words of the corpus languages.
INSULTS = """
arsehole ass asshole bastard bitch clown creep cretin crap cunt dickhead disgusting douchebag dumb dumbass fool
freak fuck fucker fucking garbage hate idiot idiotic idiots imbecile jerk kill loser losers lowlife moron morons
nazi parasite pathetic pig pussy retard retarded scum scumbag shit shithead shut slut stupid suck sucks trash
ugly vermin whore worthless
arschloch abschaum dummkopf hurensohn idioten schwachkopf schlampe scheisse trottel wichser
abruti batard connard connasse conne debile encule merde ordure pute salaud salope
basura cabron estupido gilipollas idiota imbecil mierda puta tonto zorra
""".split()
SECOND_PERSON = """
you your yours yourself yourselves u ur youre
du dich dir dein deine deiner ihr euch
tu toi te ton ta tes vous votre vos
tus ti contigo usted ustedes vosotros
""".split()

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
ASCII_LETTER = LETTER & (np.arange(256) < 128)
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Signs written for letters, read back as the letters.
READ_AS = tx.LOWER.copy()
READ_AS[[ord(c) for c in "013457@$!"]] = [ord(c) for c in "oieastasi"]

FEATURES = (
    "fixed_density", "learned_density", "stem_density", "fixed_hits", "learned_hits", "stem_hits", "hidden_density", "second_person",
    "hit_near_second_person", "capitals", "shouted_words", "exclamations", "questions", "other_punctuation",
    "mixed_words", "long_runs", "n_words",
)
NEAR = 5


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of letters, in lower case: hash, hash of its first STEM bytes (0 if shorter), row."""
    starts, ends, rows = tx.segments(LETTER[data], offsets)
    low = tx.LOWER[data]
    long = ends - starts >= STEM
    stems = np.where(long, tx.hashes(low, starts, np.minimum(ends, starts + STEM), seed=STEM), np.uint64(0))
    return tx.hashes(low, starts, ends), stems, rows


def features(texts: pa.Array, fixed: np.ndarray, learned: np.ndarray, stems: np.ndarray, person: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; the lexicons are hashes."""
    data, offsets = tx.buffers(texts)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    row_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
    count = lambda flags: np.bincount(row_of(np.flatnonzero(flags)), minlength=n)

    solid = ~tx.SPACE[data]
    starts, ends, rows = tx.segments(solid, offsets)
    n_words = np.bincount(rows, minlength=n)
    letter = LETTER[data]
    terms, beginnings, t_rows = terms_of(data, offsets)
    even = terms & ~np.uint64(1)
    n_terms = np.maximum(np.bincount(t_rows, minlength=n), 1)
    known = lambda h, lexicon: np.isin(h, lexicon) if len(lexicon) else np.zeros(len(h), bool)
    in_fixed, in_learned, in_person = known(terms, fixed), known(even, learned), known(terms, person)
    hit = in_fixed | in_learned
    in_stems = known(beginnings | np.uint64(1), stems) & (beginnings > 0)
    hits = [np.bincount(t_rows[x], minlength=n) for x in (in_fixed, in_learned, in_person, hit, in_stems)]

    # Words with signs for letters or signs between letters, read back.
    read = READ_AS[data]
    kept = (LETTER[read] | ~solid)
    total = np.concatenate([[0], np.cumsum(kept)])
    r_data, r_offsets = read[kept], total[offsets]
    r_starts, r_ends, r_rows = tx.segments(~tx.SPACE[r_data], r_offsets)
    r_hash = tx.hashes(r_data, r_starts, r_ends)
    r_hits = np.bincount(r_rows[known(r_hash, fixed) | known(r_hash & ~np.uint64(1), learned)], minlength=n)

    at_hit, at_person = np.flatnonzero(hit), np.flatnonzero(in_person)
    near = np.zeros(len(at_hit), dtype=bool)
    if len(at_hit) and len(at_person):
        for side in (-1, 0):
            other = at_person[np.clip(np.searchsorted(at_person, at_hit) + side, 0, len(at_person) - 1)]
            near |= (np.abs(other - at_hit) <= NEAR) & (t_rows[other] == t_rows[at_hit])

    ascii_letter, upper = ASCII_LETTER[data], UPPER[data]
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    n_upper, n_letter, n_digit = sums(upper), sums(ascii_letter), sums(DIGIT[data])
    within = lambda total: total[ends] - total[starts]
    shouted = (within(n_upper) >= 2) & (within(n_upper) == within(n_letter))
    inner = np.zeros(len(data), dtype=bool)
    sign = DIGIT[data] | (PUNCTUATION[data] & (data != ord("'")) & (data != ord("-")))
    inner[1:-1] = sign[1:-1] & letter[:-2] & letter[2:]
    mixed = within(sums(inner)) > 0
    triple = np.zeros(len(data), dtype=bool)
    triple[2:] = ascii_letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    words = np.maximum(n_words, 1)
    bang, ask = count(data == ord("!")), count(data == ord("?"))
    every = np.maximum(n_letter[offsets[1:]] - n_letter[offsets[:-1]], 1)
    columns = (
        hits[0] / n_terms, hits[1] / n_terms, hits[4] / n_terms, np.log1p(hits[0]), np.log1p(hits[1]), np.log1p(hits[4]),
        np.maximum(r_hits - hits[3], 0) / words, hits[2] / n_terms,
        np.bincount(t_rows[at_hit[near]], minlength=n) / np.maximum(hits[3], 1),
        (n_upper[offsets[1:]] - n_upper[offsets[:-1]]) / every,
        np.bincount(rows[shouted], minlength=n) / words, bang / words, ask / words,
        (count(PUNCTUATION[data]) - bang - ask) / words, np.bincount(rows[mixed], minlength=n) / words,
        count(triple) / words, np.log1p(n_words),
    )
    return np.column_stack(columns)


@dataclass
class Lexicon:
    """Learned from labelled texts, as hashes."""

    words: np.ndarray
    stems: np.ndarray


def feature_column(text: Column, lexicon: Lexicon) -> Column:
    """FEATURES of a text as array<double>."""
    fixed, person = (tx.hash_strings(sorted(set(words))) for words in (INSULTS, SECOND_PERSON))

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        parts = [
            features(tx.column(part, "text"), fixed, lexicon.words, lexicon.stems, person)
            for part in tx.slices(pa.RecordBatch.from_arrays([texts], ["text"]))
        ]
        flat = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        ends = np.arange(len(flat) + 1, dtype=np.int32) * len(FEATURES)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))

    return of(text)


def term_column(text: Column) -> Column:
    """The distinct hashes of a text's words and word beginnings, the latter with the lowest bit set."""

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        lists = []
        for part in tx.slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            words, stems, rows = terms_of(*tx.buffers(tx.column(part, "text")))
            both = np.concatenate([words & ~np.uint64(1), stems[stems > 0] | np.uint64(1)]).view(np.int64)
            where = np.concatenate([rows, rows[stems > 0]])
            cuts = np.searchsorted(where[order := np.argsort(where, kind="stable")], np.arange(1, part.num_rows))
            lists += [np.unique(x) for x in np.split(both[order], cuts)] if part.num_rows else []
        return pa.array(lists, pa.list_(pa.int64()))

    return of(text)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_SAMPLE) -> DataFrame:
    """Texts of at most ``bound`` labelled rows that are not held out, written once.

    The sample's ids are bounded, so they are broadcast and no text is shuffled.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("double").alias("label"))
    drawn = known.withColumn("_draw", F.xxhash64("_id")).orderBy("_draw", "_id").limit(bound)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(drawn.drop("_draw")), F.col("doc_id") == F.col("_id")
    )
    path = scratch_path(docs.sparkSession, "toxic-sample")
    sample.drop("_id").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def learn_lexicon(sample: DataFrame, bound: int = MAX_LEARNED, share: float = 0.01, ratio: float = 4.0) -> Lexicon:
    """Words and beginnings in ``share`` of the toxic texts or more, ``ratio`` times as common there."""
    none = np.zeros(0, np.uint64)
    totals = sample.agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).first()
    if not totals["bad"] or not totals["good"]:
        return Lexicon(none, none)
    counted = (
        sample.select("label", F.explode(term_column(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    )
    odds = ((F.col("bad") + 0.5) / (totals["bad"] + 1)) / ((F.col("good") + 0.5) / (totals["good"] + 1))
    chosen = counted.filter((F.col("bad") >= max(3.0, share * totals["bad"])) & (odds >= ratio))
    found = []
    for kind in (0, 1):
        top = chosen.filter(F.col("term").bitwiseAND(1) == kind).orderBy(F.desc("bad"), "term").limit(bound)
        found.append(np.array([r["term"] for r in top.collect()], dtype=np.int64).view(np.uint64))
    return Lexicon(*found)


@dataclass
class Model:
    learned: Lexicon
    trees: object = None
    curve: object = None
    constant: float = 0.0


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_SAMPLE, rounds: int = 30, depth: int = 3) -> Model:
    """Trees on most of the sample, the calibration on the rest of it."""
    sample = labelled_sample(docs, labels, bound)
    learned = learn_lexicon(sample)
    path = scratch_path(docs.sparkSession, "toxic-features")
    sample.select(
        "label",
        feature_column(F.col("text"), learned).alias("f"),
        (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1000)) < int(CALIBRATION * 1000)).alias("hold"),
    ).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path).select("label", "hold", array_to_vector("f").alias("tox_features"))
    kinds = {(r["hold"], r["label"]): r["n"] for r in rows.groupBy("hold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any((hold, label) not in kinds for hold in (False, True) for label in (0.0, 1.0)):
        total = sum(kinds.values())
        return Model(learned, constant=sum(n for (_, y), n in kinds.items() if y) / total if total else 0.0)
    boosted = GBTClassifier(
        featuresCol="tox_features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=64,
        minInstancesPerNode=5, seed=7,
    )
    trees = boosted.fit(rows.filter(~F.col("hold")).coalesce(4))
    margin = trees.transform(rows.filter("hold")).select(
        "label", vector_to_array("rawPrediction")[1].alias("tox_margin")
    )
    curve = IsotonicRegression(featuresCol="tox_margin", labelCol="label", predictionCol="tox_score").fit(
        margin.coalesce(1)
    )
    return Model(learned, trees, curve)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``tox_score``, the calibrated probability that the text is toxic."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith("tox_")])
    if model.trees is None:
        return docs.withColumn("tox_score", F.lit(model.constant))
    given = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in given]).alias("_row"),
        array_to_vector(feature_column(F.col("text"), model.learned)).alias("tox_features"),
    )
    raw = model.trees.transform(rows).select("_row", vector_to_array("rawPrediction")[1].alias("tox_margin"))
    scored = model.curve.transform(raw)
    return scored.select("_row.*", F.least(F.greatest("tox_score", F.lit(0.0)), F.lit(1.0)).alias("tox_score"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """The documents that are not toxic, with the columns given."""
    scored = score(docs, fit(docs, labels, **settings))
    return scored.filter(F.col("tox_score") < threshold).drop("tox_score")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"),
    )
