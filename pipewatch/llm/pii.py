"""Personal data by a character BiLSTM-CRF beside fixed patterns.

The patterns find the base spans; they stay as they are. The model learns from
windows labelled with such spans, and from the same windows with the spans written in
ways the patterns don't match (separators spelt out, bracketed, widened or spaced,
digits drawn anew, the plus left out), labelled from the rewriting. It adds
spans where no base span lies.
Every character of every text is read: the states come from stretches of CHUNK
characters with MARGIN more at each side, joined to one sequence per text. The
best tags are those of the whole sequence. A bound on what any span could gain
over none shows most places to be outside of spans; only what it leaves, with
CONTEXT characters at each side, goes through the CRF. Marginals are given that
the tags beyond it are O. Spans are of any length and need neither digit nor at sign.

Defined results: a null text is an empty text without spans; a corpus without
base spans trains no model, which then adds nothing. Offsets are code points, end
exclusive. A row that repeats is tagged each time, and its windows count once in training; an
empty table trains nothing and returns no rows. A text of any length is read whole, a stretch
at a time. Only ``text`` is read; all other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewatch.llm import bilstm
from pipewatch.llm import text as tx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{mark}-{kind}" for kind in KINDS for mark in "BI"))
WINDOW, STRIDE = 96, 48
#: Windows the model is trained on, at most, of each of SORTS sorts.
MAX_WINDOWS = 1000
#: With a base span, with other digits, plain, with rewritten spans, with decoys.
SORTS = 5
#: Groups in which the draws of a sort are cut before they meet.
SHARES = 32
#: Mean marginal probability a proposal needs.
SURE = 0.9
#: Characters of a stretch whose states are kept, and those read beside them at each side.
CHUNK, MARGIN = 992, 48
#: Characters decoded at each side of places that may lie in a span.
CONTEXT = 48
#: Lengths of what goes through the CRF are rounded up to multiples of this.
STEP = 64
#: Stretches decoded at once.
BATCH = 1024
#: Characters whose emissions a task holds until their stretches are decoded; those of others are computed once more.
KEPT = 1 << 20
SYMBOLS = 130

# The patterns of the contract. A look-behind spares starts inside a run
# of digits, which can match nothing that the start of the run does not.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
TRIGGER = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        d = ord(digit) - 48
        total += d if place % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each at sign outwards, so in one pass."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield "email", start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then by start."""
    out = list(emails(text))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group()) if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def symbols(text: str) -> np.ndarray:
    """1..128 for ASCII, 129 for anything else; 0 pads."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < 128, codes + 1, 129).astype(np.int16)


def window_starts(text: str) -> list[int]:
    """Starts of the grid's windows that hold a digit or an at sign."""
    found: set[int] = set()
    for m in TRIGGER.finditer(text):
        last = m.start() // STRIDE
        found.update(range(max(0, last - (WINDOW // STRIDE) + 1), last + 1))
    return [w * STRIDE for w in sorted(found)]


def window(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, dtype=np.int16)
    part = codes[start : start + WINDOW]
    out[: len(part)] = part
    return out


def gold_tags(spans: list[Span], start: int) -> np.ndarray:
    out = np.zeros(WINDOW, dtype=np.int8)
    for kind, a, b in spans:
        if a < start + WINDOW and b > start:
            inner = 2 + 2 * KINDS.index(kind)
            out[max(a - start, 0) : b - start] = inner
            if a >= start:
                out[a - start] = inner - 1
    return out


def proposals(tags: np.ndarray, sure: np.ndarray, start: int, length: int) -> Iterator[tuple[float, Span]]:
    """The spans of a stretch of tags, but for those its borders cut."""
    at, size = 0, len(tags)
    while at < size:
        tag = int(tags[at])
        end = at + 1
        if tag:
            kind = (tag - 1) // 2
            while end < size and int(tags[end]) == 2 + 2 * kind:
                end += 1
            cut = (at == 0 and start > 0) or (end == size and start + size < length)
            if not cut and start + end <= length:
                yield float(sure[at:end].mean()), (KINDS[kind], start + at, start + end)
        at = end


def reconcile(text: str, base: list[Span], offered: list[tuple[float, Span]], needs: re.Pattern | None = TRIGGER) -> list[Span]:
    """Offered spans that are sure, match ``needs`` if given, and are free of base spans and surer offers."""
    taken = sorted((a, b) for _, a, b in base)
    best: dict[Span, float] = {}
    for score, span in offered:
        best[span] = max(score, best.get(span, 0.0))
    added: list[Span] = []
    for span, score in sorted(best.items(), key=lambda x: (-x[1], x[0][1], x[0][2], x[0][0])):
        _, a, b = span
        if score < SURE:
            break
        if (needs is None or needs.search(text, a, b)) and not any(x < b and a < y for x, y in taken):
            added.append(span)
            taken.append((a, b))
    return added


def rounded_up(n: int) -> int:
    return -(-n // STEP) * STEP


def stretch_emissions(model: bilstm.Params, codes: list[np.ndarray], wanted: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, start, emissions) of the CHUNK characters from each wanted (text, start), the longest first."""
    wanted = sorted(wanted, key=lambda x: len(codes[x[0]]) - x[1], reverse=True)
    for k in range(0, len(wanted), BATCH):
        part = wanted[k : k + BATCH]
        pieces = [codes[i][max(0, start - MARGIN) : start + CHUNK + MARGIN] for i, start in part]
        for e, (i, start) in zip(bilstm.emissions_of(model, pieces), part):
            skip = start - max(0, start - MARGIN)
            yield i, start, e[skip : skip + CHUNK]


def open_stretches(gains: np.ndarray, leave: float, entry: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Stretches (a, b), CONTEXT included, outside of which the best tags are O.

    ``gains`` bounds what tagging a character otherwise than O adds to the score
    of a text, ``entry`` what it adds where the character before is O (``gains``, if not
    given), ``leave`` what the step back to O adds. A character is shown to be O if
    no run of characters that holds it gains anything.
    """
    sums = np.cumsum(gains, dtype=np.float64)
    begun = np.maximum.accumulate((gains if entry is None else entry) - sums)
    future = np.maximum.accumulate(sums[::-1])[::-1]
    places = np.flatnonzero(begun + future + leave >= -1e-3)
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) > 2 * CONTEXT + 1)
    first, last = places[np.concatenate([[0], cuts + 1])], places[np.append(cuts, len(places) - 1)]
    return [(max(0, int(a) - CONTEXT), min(len(gains), int(b) + CONTEXT + 1)) for a, b in zip(first, last)]


def tagged_stretches(texts: list[str], model: bilstm.Params) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(text, start, tags, marginals) of all stretches that may hold spans."""
    codes = [symbols(t) for t in texts]
    step = model["A"]
    into, within = (x - step[0, 0] for x in (step[0], step[1:].max(axis=0)))
    leave = max(0.0, float((step[1:, 0] - step[0, 0]).max()))
    gains, entry = ([np.empty(len(c), dtype=np.float32) for c in codes] for _ in range(2))
    kept, held = 0, {}
    for i, start, e in stretch_emissions(model, codes, [(i, a) for i, c in enumerate(codes) for a in range(0, len(c), CHUNK)]):
        over = e[:, 1:] - e[:, :1]
        gains[i][start : start + len(e)] = (over + within[1:]).max(axis=1)
        entry[i][start : start + len(e)] = (over + into[1:]).max(axis=1)
        if kept < KEPT:
            kept, held[i, start] = kept + len(e), e
    todo = [(i, a, b) for i, (g, n) in enumerate(zip(gains, entry)) for a, b in open_stretches(g, leave, n)]
    # Beyond the bound states are computed once more where the CRF needs them, so that those of a long text are never held.
    wanted = {(i, start) for i, a, b in todo for start in range(a // CHUNK * CHUNK, b, CHUNK)}
    held = {x: held[x] for x in wanted if x in held}
    held |= {(i, start): e for i, start, e in stretch_emissions(model, codes, sorted(wanted - held.keys()))}
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for i, a, b in todo:
        by_size.setdefault(rounded_up(b - a + 2), []).append((i, a, b))
    for size, group in by_size.items():
        for k in range(0, len(group), BATCH):
            part = group[k : k + BATCH]
            # O before and after each stretch.
            e = np.full((len(part), size, len(TAGS)), -1e4)
            e[:, :, 0] = 0.0
            for row, (i, a, b) in zip(e, part):
                for start in range(a // CHUNK * CHUNK, b, CHUNK):
                    values = held[i, start]
                    low, high = max(a, start), min(b, start + len(values))
                    row[1 + low - a : 1 + high - a] = values[low - start : high - start]
            for (i, a, b), tags, sure in zip(part, *bilstm.decode_emissions(model, e)):
                yield i, a, tags[1 : 1 + b - a], sure[1 : 1 + b - a]


def find(texts: list[str], model: bilstm.Params | None) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the base spans and the added ones."""
    base = [base_spans(t) for t in texts]
    offered: list[list[tuple[float, Span]]] = [[] for _ in texts]
    if model is not None:
        for i, start, tags, sure in tagged_stretches(texts, model):
            offered[i] += proposals(tags, sure, start, len(texts[i]))
    return [(b, reconcile(t, b, o, needs=None)) for t, b, o in zip(texts, base, offered)]


def fresh_digits(value: str, rng: random.Random) -> str:
    return "".join(str(rng.randrange(10)) if c in "0123456789" else c for c in value)


def disguised(kind: str, value: str, words: list[str], rng: random.Random) -> str:
    """A base span written so that its pattern does not match it."""
    if kind == "email":
        at = rng.choice((" at ", " AT ", " (at) ", "(at)", " [at] ", "[at]", " @ ", "\uff20", "_at_", " {at} "))
        dot = rng.choice((" dot ", " DOT ", " (dot) ", "(dot)", "[dot]", " [dot] ", " . ", "\uff0e", "_dot_", "."))
        local, domain = value.split("@", 1)
        if words and rng.random() < 0.6:
            local = ".".join(rng.choice(words) for _ in range(rng.randint(1, 2)))
        if words and rng.random() < 0.5:
            domain = f"{rng.choice(words)}.{domain.rsplit('.', 1)[1]}"
        return at.join(x.replace(".", dot) for x in (local, domain))
    value = fresh_digits(value, rng)
    if kind == "ip":
        return value.replace(".", rng.choice((" . ", "[.]", "(.)", " dot ", "(dot)", "[dot]", "\uff0e", ". ")))
    if kind == "card":
        digits, gap = NOT_DIGIT.sub("", value), rng.choice((".", "/", "  ", "_", " - ", "\u2013", "\u00a0"))
        return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return rng.choice(("", "00", "\uff0b", "+ ", "plus ")) + value[1:]


def rewritten(text: str, spans: list[Span], start: int, rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """The window at ``start`` with its whole spans disguised, and its tags."""
    parts: list[str] = []
    tags: list[np.ndarray] = []
    words = re.findall("[A-Za-z]{3,10}", text[start : start + 3 * WINDOW])

    def put(value: str, kind: str | None = None, begins: bool = True) -> None:
        parts.append(value)
        inner = 2 + 2 * KINDS.index(kind) if kind else 0
        tags.append(np.full(len(value), inner, dtype=np.int8))
        if kind and begins:
            tags[-1][:1] = inner - 1

    at = start
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= start + WINDOW or b <= at:
            continue
        put(text[at : max(a, at)])
        put(text[at:b], kind, begins=False) if a < at else put(disguised(kind, text[a:b], words, rng), kind)
        at = b
    put(text[at : at + WINDOW])
    out = np.zeros(WINDOW, dtype=np.int8)
    joined = np.concatenate(tags)[:WINDOW]
    out[: len(joined)] = joined
    return window(symbols("".join(parts)), 0), out


def with_decoys(piece: str, rng: random.Random) -> str:
    """A plain window with words, signs and numbers put in that also occur in disguised spans."""
    words = piece.split(" ")
    if rng.random() < 0.3:
        # Junk of one word over and over is no address either.
        words = words[:2] + [rng.choice(words)] * WINDOW
    for _ in range(rng.randint(1, 3)):
        number = str(rng.randrange(10 ** rng.randint(1, 6)))
        words.insert(rng.randrange(len(words) + 1), rng.choice(("at", "dot", "(at)", "@", ".", "AT", "-", number, f"{number}.{rng.randrange(100)}", f"{number} at")))
    return " ".join(words)


def windows_of(text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(sort, symbols, tags) of the windows of a text that may serve in training.

    What is drawn depends on the text alone, so reruns and copies draw alike.
    """
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    starts = window_starts(text)
    none = np.zeros(WINDOW, dtype=np.int8)
    if starts:
        spans, codes = base_spans(text), symbols(text)
        for start in starts:
            # Windows overlap by half and more, so the spans near one are few of a long text's.
            tags = gold_tags(spans, start)
            yield (0 if tags.any() else 1), window(codes, start), tags
            if tags.any():
                yield 3, *rewritten(text, spans, start, rng)
    start = rng.randrange(len(text) // STRIDE + 1) * STRIDE
    piece = text[start : start + WINDOW]
    if not TRIGGER.search(piece):
        yield 2, window(symbols(piece), 0), none
        yield 4, window(symbols(with_decoys(piece, rng)), 0), none


def labelled_windows(docs: DataFrame, bound: int = MAX_WINDOWS) -> list:
    """Distinct windows with their tags, the ``bound`` of each sort with the smallest draws."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task passes on no more than ``bound`` windows of a sort, those with its smallest draws."""
        held: list[dict[bytes, tuple[bytes, bytes]]] = [{} for _ in range(SORTS)]

        def cut(sort: int) -> None:
            held[sort] = {draw: held[sort][draw] for draw in heapq.nsmallest(bound, held[sort])}

        for batch in batches:
            for part in tx.slices(batch):
                for text in tx.column(part, "text").to_pylist():
                    for sort, codes, tags in windows_of(text or ""):
                        pair = codes.tobytes(), tags.tobytes()
                        held[sort][hashlib.blake2b(pair[0] + pair[1], digest_size=8).digest()] = pair
                        if len(held[sort]) > 4 * bound:
                            cut(sort)
        for sort in range(SORTS):
            cut(sort)
            if held[sort]:
                codes, tags = zip(*held[sort].values())
                columns = [pa.array([sort] * len(codes), pa.int32()), pa.array(list(held[sort]), pa.binary()), pa.array(codes, pa.binary()), pa.array(tags, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["sort", "draw", "codes", "tags"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(work, "sort int, draw binary, codes binary, tags binary")
    # Equal windows have equal draws. Shares of a sort are cut by themselves, then what they leave.
    share = F.pmod(F.xxhash64("draw"), F.lit(SHARES))
    single = rows.dropDuplicates(["sort", "draw"]).withColumn("share", share)
    first = single.withColumn("place", F.row_number().over(Window.partitionBy("sort", "share").orderBy("draw"))).filter(F.col("place") <= bound)
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("sort").orderBy("draw")))
    return ranked.filter(F.col("place") <= bound).orderBy("sort", "draw").collect()


def fit(docs: DataFrame, bound: int = MAX_WINDOWS, steps: int = 800) -> bilstm.Params | None:
    """The model trained on a bounded sample of windows of ``docs``."""
    rows = labelled_windows(docs, bound)
    if not any(r["sort"] == 0 for r in rows):
        return None
    ids = np.stack([np.frombuffer(r["codes"], np.int16) for r in rows]).astype(np.int64)
    tags = np.stack([np.frombuffer(r["tags"], np.int8) for r in rows]).astype(np.int64)
    # Half of every batch has spans, however rare they are.
    good, other = (np.flatnonzero([(r["sort"] in (0, 3)) == want for r in rows]) for want in (True, False))
    if len(other):
        size = max(len(good), len(other))
        keep = np.concatenate([np.resize(good, size), np.resize(other, size)])
        ids, tags = ids[keep], tags[keep]
    return bilstm.train(ids, tags, SYMBOLS, len(TAGS), steps=steps)


SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def span_column(text: Column, model: bilstm.Params | None) -> Column:
    """All spans of a text: by kind as listed, then start."""

    @F.arrow_udf(SPAN_TYPE)
    def of(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[]] * len(texts)
        at = 0
        for part in tx.slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            strings = [t or "" for t in tx.column(part, "text").to_pylist()]
            for row, (base, added) in enumerate(find(strings, model)):
                spans = sorted([(KINDS.index(s[0]), s[1], s[2], True) for s in base] + [(KINDS.index(s[0]), s[1], s[2], False) for s in added])
                out[at + row] = [{"kind": KINDS[k], "start": a, "end": b, "base": x} for k, a, b, x in spans]
            at += part.num_rows
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        return pa.array(out, kind)

    return of(text)


def redacted_column(text: Column, model: bilstm.Params | None) -> Column:
    """The text with every span replaced by its kind in angle brackets; null stays null."""

    def masked(text: str, spans: list[Span]) -> str:
        parts, free = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if b > free:
                parts += [text[free : max(a, free)], f"<{kind.upper()}>" if a >= free else ""]
                free = b
        return "".join(parts) + text[free:]

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        pieces = []
        for part in tx.slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            given = tx.column(part, "text")
            strings = [t or "" for t in given.to_pylist()]
            new = {row: masked(t, base + added) for row, (t, (base, added)) in enumerate(zip(strings, find(strings, model))) if base or added}
            if new:
                listed = given.to_pylist()
                for row, value in new.items():
                    listed[row] = value
                given = pa.array(listed, pa.string())
            pieces.append(given.cast(pa.string()))
        return pa.chunked_array(pieces, pa.string()).combine_chunks() if pieces else pa.array([], pa.string())

    return of(text)


def without_personal_data(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with spans masked in ``text``; ``n_chars``, if given, kept true."""
    out = docs.withColumn("text", redacted_column(F.col("text"), fit(docs, **settings)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def sha256_of(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's spans; counts and hash are of the base ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = docs.select("doc_id", span_column(F.col("text"), fit(docs)).alias("found"))
    base = F.filter("found", lambda s: s["base"])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(counted, KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
