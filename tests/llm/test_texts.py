"""Operators that judge, score or cut texts, against plain versions."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cases import SCHEMA, WORD, documents, lower, no_documents, prose, saved
from pipewatch.llm import bilstm, bpe, cascade, maxent, mixing, packing, pii, toxicity, wordpiece

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


# ---- toxicity


def labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(10, 60)).split(" ")
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "you", "moron", "SCUM!", "glarb"])
        rows.append((i, " ".join(words), "en", "a", 0, *["x"] * 7))
        labels.append((i, 1, int(bad)))
    labels += [(7, 1, None), (None, 1, 1), (5, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_texts_are_told_apart_on_held_out_rows(spark, tmp_path):
    docs, labels = labelled(spark)
    got = toxicity.query(spark, saved(spark, tmp_path, documents=docs, labels=labels)).collect()
    assert len(got) == 400
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    right = sum((r.doc_id % 5 == 0) == bool(r.predicted) for r in out)
    assert right >= 0.95 * len(out)


def test_toxicity_of_odd_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    odd = documents(spark)
    scored = toxicity.score(odd, model)
    assert scored.count() == odd.count() and [c for c in scored.columns if c != "tox_score"] == [c for c in odd.columns if c != "tox_score"]
    assert scored.filter("tox_score IS NULL OR tox_score < 0 OR tox_score > 1").count() == 0
    assert toxicity.score(no_documents(spark), model).count() == 0


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 40)
    none = toxicity.score(docs, toxicity.fit(docs, labels.filter("toxic > 5")))
    assert {r.tox_score for r in none.collect()} == {0.0}
    one = toxicity.score(docs, toxicity.fit(docs, labels.filter("toxic = 1")))
    assert {r.tox_score for r in one.collect()} == {1.0}


# ---- mixing


def test_mix_by_its_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    folder = saved(spark, tmp_path, documents=documents(spark))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    expected = sorted(con.execute(mixing.ORACLE).fetchall(), key=key)
    got = sorted((tuple(r) for r in mixing.query(spark, folder).collect()), key=key)
    assert got == expected


def test_mixed_rows_hold_the_words_taken(spark):
    docs = documents(spark)
    taken = {}
    for r in mixing.assign(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.mix_taken
        assert r.mix_taken <= 3 * r.mix_size
        assert sum(c.words for c in r.mix_copies) == r.mix_taken
        assert all(0 <= c.position <= 1 for c in r.mix_copies)
    out = mixing.mixed(docs)
    rows = out.collect()
    assert out.columns == [c for c in docs.columns if not c.startswith("mix_")] + ["mix_position"]
    words = {}
    for r in rows:
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text or ""))
        assert r.n_chars == len(r.text)
    assert words == {s: n for s, n in taken.items() if n}
    assert [r.mix_position for r in rows] == sorted(r.mix_position for r in rows)


def test_targets_are_those_of_resharing(spark):
    sizes = {"a": 10, "b": 500, "c": 40, "d": 3, "e": 900, None: 70}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r._source: r.mix_target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, mix_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    full, left = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        share = {s: (left - sum(full.values())) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            break
        full |= {s: 3 * sizes[s] for s in over}
    assert got == pytest.approx(share | full)
    assert mixing.assign(no_documents(spark)).count() == 0 and mixing.mixed(no_documents(spark)).count() == 0


# ---- language model


@pytest.mark.parametrize("known", [maxent.KNOWN, 30])
def test_language_model_counts_and_base(spark, known):
    docs = documents(spark, n=120)
    model = maxent.fit(docs, known=known)
    rows = [(r.doc_id, [*WORD.findall(lower(r.text)), None]) for r in docs.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, words in rows if not out(i) for w in words)
    total, types = sum(counts.values()), len(counts)
    expected = sorted(
        (str(i), out(i), len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w), 5))
        for i, w in rows
    )
    got = maxent.score(docs, model).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_probabilities_of_all_words_add_up(spark):
    docs = documents(spark, n=120)
    model = maxent.fit(docs)
    v, w = model.vocabulary, model.weights
    rows = model.counts.collect()
    h = np.array([r.h for r in rows], np.int64).view(np.uint64)
    tail = np.array([r.tail for r in rows])
    history = tx_tokens(["an ber co"])
    sums = 0.0
    for a in range(0, len(h), 500):
        each = [maxent.log_probabilities(v, w, np.append(history[0][:3], x), np.append(history[1][:3], t), np.zeros(4, int))[0][-1] for x, t in zip(h[a : a + 500], tail[a : a + 500])]
        sums += float(np.sum(10.0 ** np.array(each)))
    # One unseen word in each tail class has the rest.
    p = maxent.softmax((sum(w.classes[maxent.features(np.append(history[0][:3], h[0]), maxent.look_up(v, np.append(history[0][:3], h[0]), np.append(history[1][:3], 0))[1], np.zeros(4, int))[0][-1][f]] for f in range(4)) + v.class_log)[None, :])[0]
    unseen = float((p[maxent.HEAD :] / v.tail_size).sum())
    empty = float(p[: maxent.HEAD][(v.slot_log < -1e8).all(axis=1)].sum())
    assert sums + unseen + empty == pytest.approx(1.0, abs=1e-3)


def tx_tokens(texts):
    return maxent.tokens(pa.array(texts))


def test_language_model_learns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sums = maxent.score(docs, maxent.fit(docs)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_language_model_without_rows(spark):
    assert maxent.score(no_documents(spark), maxent.fit(no_documents(spark))).count() == 0
    docs = spark.createDataFrame([(23, "held out only")], "doc_id long, text string")
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][0]
    docs = docs.withColumn("doc_id", F.lit(held).cast("long"))
    r = maxent.score(docs, maxent.fit(docs)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (4, 0, 0, 0.0) and math.isfinite(r.score)


# ---- quality rules


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


def test_counts_and_verdicts(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab \n\t#|é") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += [" ".join(rng.choice("abc") for _ in range(60)) for _ in range(40)] + [None, "", "A B C " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(documents(spark).select("doc_id", "text"))
    got = cascade.judge(df).collect()
    assert len(got) == df.count()
    for r in got:
        c = plain_counts(r.text)
        assert [r[f"rule_{n}"] for n in cascade.COUNTS] == c
        assert r.rule_base_failed == (c[0] < 10 or 100 * c[4] > 20 * c[0])
        rejected = any(rule(pa.array([r.text or ""]), np.array([c]))[0] for rule in cascade.RULES.values())
        assert r.rule_kept == (not r.rule_base_failed and not rejected)
    assert cascade.judge(no_documents(spark)).count() == 0


def test_order_does_not_change_verdicts():
    rng = random.Random(8)
    texts = pa.array([prose(rng, rng.randint(5, 50)) + rng.choice(["", " ###" * 40, "\nsame line" * 20]) for _ in range(50)])
    c = cascade.counts(texts)
    names = list(cascade.RULES)
    first = cascade.verdicts(texts, c, names, cascade.RULES)
    assert 0 < first.sum() < 50
    assert (cascade.verdicts(texts, c, names[::-1], cascade.RULES) == first).all()


# ---- word pieces


def greedy(word, pieces):
    at, n = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in pieces:
                at, n = end, n + 1
                break
        else:
            return 0
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(3)
    for _ in range(200):
        some = lambda n: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n)))
        pieces = {some(5) for _ in range(rng.randint(1, 9))} | {b" " + some(3) for _ in range(3)}
        pieces |= {b" "} if rng.random() < 0.7 else set()
        texts = [" ".join(some(11).decode() for _ in range(6)), "", None]
        for text, row in zip(texts, wordpiece.count_pieces(pa.array(texts), wordpiece.Automaton(sorted(pieces)))):
            n = [greedy(b" " + w.encode(), pieces) for w in WORD.findall(text or "")]
            assert row.tolist() == [len(n), sum(max(x, 1) for x in n), sum(x == 0 for x in n)]


def test_word_pieces_of_odd_rows(spark):
    pieces = set()
    import base64

    import public_tokenizers

    with open(public_tokenizers.path(wordpiece.VOCABULARY), "rb") as file:
        pieces = {base64.b64decode(line.split()[0]) for line in file}
    docs = documents(spark).filter("doc_id IS NULL OR doc_id <> 1018")
    for r in wordpiece.count(docs).collect():
        n = [greedy(b" " + w.encode(), pieces) for w in WORD.findall(r.text or "")[:300]]
        if len(n) < 300:
            assert (r["wp_n_words"], r["wp_n_tokens"], r["wp_n_unknown"]) == (len(n), sum(n), 0)
    assert wordpiece.count(no_documents(spark)).count() == 0


# ---- packing


def test_ids_are_those_of_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "é", " ", " ", "'s", "12", "!?", bpe.END, "\x1c", "\x85", "日本", "😀", "\r\n", "<|", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert bpe.ids_of(text).tolist() == own.encode(text, add_special_tokens=False).ids
    assert bpe.ids_of(None).tolist() == []


@pytest.mark.parametrize("fan_in", [32, 1000])
def test_pieces_cover_documents_and_fill_sequences(spark, monkeypatch, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    docs = documents(spark, n=300).repartition(40)
    given = Counter()
    expected = {}
    for r in docs.collect():
        ids = np.append(bpe.ids_of(r.text), 0).astype("<u4")
        given[r.doc_id] += 1
        expected[r.doc_id] = ids
    pieces, sequences = {}, {}
    for r in packing.pack(docs).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == expected.keys()
    for doc, own in pieces.items():
        ids, at = expected[doc], 0
        own.sort(key=lambda r: r.start)
        for r in own[:: given[doc]]:
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert padding < 0.03 * total
    assert packing.pack(no_documents(spark)).count() == 0


def test_cuts_and_classes():
    for tokens in [*range(1, 3000)]:
        lengths = packing.cut(tokens)
        assert sum(lengths) == tokens and min(lengths) > 0
        for n in lengths:
            assert n * packing.class_of(n) <= packing.CAPACITY


# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def good(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(x) <= 255 for x in found.split("."))
        if kind == "card":
            doubled = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if good(k, m.group())]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    parts = list("ab.@-+%_ ()é\n0123456789") + ["a@b.c", "1.2.3.4", "+1 (555) 555-0100", "4111 1111 1111 1111", "300.1.1.1", "@", "..", "4111111111111111"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(0)
    p = bilstm.initial(7, 5, 3, 4)
    p["A"] = rng.normal(size=p["A"].shape) * 0.1
    ids, gold = rng.integers(0, 7, (3, 6)), rng.integers(0, 5, (3, 6))
    _, grad = bilstm.loss_and_gradient(p, ids, gold)
    for name in p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            near = []
            for step in (1e-5, -1e-5):
                q = {k: x.copy() for k, x in p.items()}
                q[name][at] += step
                near.append(bilstm.loss_and_gradient(q, ids, gold)[0])
            assert abs((near[0] - near[1]) / 2e-5 - grad[name][at]) < 1e-6


def personal(spark, n=300):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        words = prose(rng, 40).split(" ")
        card = [rng.randint(0, 9) for _ in range(15)]
        some = [f"{prose(rng, 1)}.{i}@mail.example.com".replace("é", "e"), f"10.{i % 200}.3.{i % 99}", f"+1 (555) 555-{i:04d}", next(c for c in ("".join(map(str, card)) + str(d) for d in range(10)) if pii.luhn(c))]
        words[rng.randrange(40)] = rng.choice([*some, "3.0", str(i)])
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_tagger_learns_spans_of_other_texts(spark):
    df = personal(spark)
    model = pii.fit(df.filter("doc_id % 3 > 0"))
    hit = total = extra = 0
    for r in df.filter("doc_id % 3 = 0").collect():
        base, offered = pii.base_spans(r.text), []
        starts, codes = pii.window_starts(r.text), pii.symbols(r.text)
        if starts:
            tags, sure = bilstm.decode(model, np.stack([pii.window(codes, s) for s in starts]))
            for s, y, p in zip(starts, tags, sure):
                offered += pii.proposals(y, p, s, len(r.text))
        found = {span for score, span in offered if score >= pii.SURE}
        hit, total, extra = hit + sum(s in found for s in base), total + len(base), extra + len(found - set(base))
    assert hit >= 0.8 * total and extra <= 0.2 * total


def test_tagger_finds_disguised_data_in_other_texts(spark):
    df = personal(spark, 600)
    model = pii.fit(df.filter("doc_id % 3 > 0"))
    rng = random.Random(5)
    hit, total, clean, extra = Counter(), Counter(), 0, 0
    for r in df.filter("doc_id % 3 = 0").collect():
        spans = pii.base_spans(r.text)
        if len(spans) != 1:
            (base, added), clean = pii.find([r.text], model)[0], clean + 1
            extra += bool(added)
            continue
        kind, a, b = spans[0]
        new = pii.disguised(kind, r.text[a:b], ["jane", "doe", "example"], rng)
        base, added = pii.find([r.text[:a] + new + r.text[b:]], model)[0]
        total[kind] += 1
        hit[kind] += any(k == kind and x < a + len(new) and a < y for k, x, y in base + added)
    assert set(total) == set(pii.KINDS)
    assert sum(hit.values()) >= 0.75 * sum(total.values()), (hit, total)
    assert clean and extra <= 0.1 * clean


def test_rewritten_windows_are_labelled_where_the_rewriting_stands():
    text = "say a.b@c.org or +1 (555) 555-0100, 10.2.3.4 at " + "word " * 40
    codes, tags = pii.rewritten(text, pii.base_spans(text), 0, random.Random(1))
    assert len(codes) == len(tags) == pii.WINDOW
    begins = [pii.KINDS[(int(t) - 1) // 2] for t in tags if t % 2]
    assert begins[:2] == ["email", "phone"]
    plain = "".join(chr(c - 1) if 0 < c < 129 else "\uff20" for c in codes)
    assert plain.startswith("say ") and not pii.base_spans(plain[: len("say a.b@c.org")])
    again = pii.rewritten(text, pii.base_spans(text), 0, random.Random(1))
    assert (again[0] == codes).all() and (again[1] == tags).all()


def test_sample_of_windows_is_bounded_and_alike_over_partitions(spark):
    df = personal(spark, 200)
    one, many = (pii.labelled_windows(df.repartition(n), bound=20) for n in (1, 7))
    assert [tuple(r) for r in one] == [tuple(r) for r in many]
    assert max(Counter(r["sort"] for r in one).values()) == 20


def test_spans_and_masks_of_odd_rows(spark, tmp_path):
    df = documents(spark).unionByName(personal(spark, 60), allowMissingColumns=True)
    folder = saved(spark, tmp_path, documents=df)
    texts = Counter()
    for r in df.collect():
        spans = plain_spans(r.text or "")
        texts[(r.doc_id, *(sum(k == s[0] for s in spans) for k in pii.KINDS), pii.sha256_of(",".join(f"{k}:{a}:{b}" for k, a, b in spans)))] += 1
    got = pii.query(spark, folder).collect()
    assert Counter(tuple(r)[:6] for r in got) == texts
    masked = pii.without_personal_data(df, steps=20)
    assert masked.columns == df.columns and masked.count() == df.count()
    for r in masked.filter("text IS NOT NULL").collect():
        assert not pii.base_spans(r.text)
    assert masked.filter("text IS NULL").count() == 1
    assert pii.without_personal_data(no_documents(spark)).count() == 0


def test_reconciling_prefers_base_then_sure_spans():
    text = "call 555 1234 or 555 9999"
    offered = [(0.95, ("phone", 5, 13)), (0.99, ("phone", 17, 25)), (0.97, ("card", 17, 20)), (0.5, ("ip", 5, 8)), (0.99, ("email", 0, 4))]
    assert pii.reconcile(text, [], offered) == [("phone", 17, 25), ("phone", 5, 13)]
    assert pii.reconcile(text, [("card", 6, 7)], offered) == [("phone", 17, 25)]


def lettered(p, texts):
    """Emissions for O but on letters q, which are said to be an email's."""
    out = [np.zeros((len(ids), len(pii.TAGS)), np.float32) for ids in texts]
    for e, ids in zip(out, texts):
        e[:, 0] = 6.0
        e[ids == ord("q") + 1, 1:3] = 12.0
    return out


def test_spans_of_any_length_and_letters_are_found(monkeypatch):
    monkeypatch.setattr(bilstm, "emissions_of", lettered)
    model = bilstm.initial(pii.SYMBOLS, len(pii.TAGS))
    model["A"][:, 2::2] = -50.0
    for kind in range(4):
        model["A"][1 + 2 * kind : 3 + 2 * kind, 2 + 2 * kind] = 0.0
    model["A"][1:, 1::2] = -50.0
    places = [(0, 30), (395, 640), (800, 812), (1000, 3000), (3990, 4000)]
    text = list("a" * 4000)
    for a, b in places:
        text[a:b] = "q" * (b - a)
    (base, added), (_, none) = pii.find(["".join(text), "plain words of no kind"], model)
    assert base == [] and none == []
    assert sorted(added) == [("email", a, b) for a, b in places]


def test_open_stretches_hold_all_tags_of_the_whole_text():
    rng = np.random.default_rng(3)
    tags = len(pii.TAGS)
    for _ in range(40):
        p = {"A": rng.normal(0, 1.0, (tags, tags)), "a0": np.zeros(tags)}
        e = rng.normal(0, 1.0, (1, 600, tags))
        e[:, :, 0] += 3.0 + 4.0 * rng.random()
        e[:, [0, -1]] = -1e4
        e[:, [0, -1], 0] = 0.0
        whole = bilstm.viterbi(p, e)[0]
        into = p["A"].max(axis=0) - p["A"][0, 0]
        leave = max(0.0, float((p["A"][1:, 0] - p["A"][0, 0]).max()))
        gains = (e[0, 1:-1, 1:] - e[0, 1:-1, :1] + into[1:]).max(axis=1)
        inside = np.zeros(600, dtype=bool)
        for a, b in pii.open_stretches(gains, leave):
            inside[1 + a : 1 + b] = True
        assert not whole[~inside].any()


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "1" * 2_000_000, " \n\t" * 700_000 + "end", "x " + "\u3000" * 600_000 + "y"])
def test_ids_of_very_long_runs(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert bpe.ids_of(text).tolist() == expected


def test_mix_of_a_source_without_words(spark):
    rows = [(1, None, "b"), (2, "  ", "b"), (3, "one two three", "a")]
    for given in (rows, rows[:2]):
        df = spark.createDataFrame(given, "doc_id long, text string, source string")
        got = {r.doc_id: (r.mix_size, r.mix_taken, r.mix_target) for r in mixing.assign(df).collect()}
        assert got[1] == got[2] == (0, 0, 0.0)
        assert mixing.mixed(df).filter("source = 'b'").count() == 0


def test_model_arrays_against_plain_ones():
    rng = np.random.default_rng(8)
    rows, table = rng.zipf(1.3, 3000) % 50, np.zeros((50, 4), np.float32)
    values = rng.normal(size=(3000, 4)).astype(np.float32)
    order = np.argsort(rows, kind="stable")
    names, first, size = np.unique(rows[order], return_index=True, return_counts=True)
    falling = np.argsort(-size, kind="stable")
    assert size.max() > maxent.REPEATS
    table[names[falling]] = maxent.added_up(values, order, first[falling], size[falling])
    plain = np.zeros((50, 4))
    np.add.at(plain, rows, values)
    assert np.allclose(table, plain, atol=1e-3)
    # Logits too large, or too small, to be raised as they are.
    for shift in (0.0, 500.0, -500.0):
        z = rng.normal(size=(7, 5)).astype(np.float32) * 20
        want = np.exp(z - z.max(axis=1, keepdims=True))
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(maxent.softmax(z + np.float32(shift)), want, atol=1e-4)
        z += np.float32(shift)
        z[3] -= 300
        wide = maxent.Softmax(5)
        got = wide.logs(z, np.arange(7)[:, None], np.zeros(5, np.float32), z.argmax(axis=1))
        assert np.allclose(got, np.log10(want.max(axis=1)), atol=1e-3)


def test_known_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(9)
    for known in (np.zeros(0, np.uint64), np.uint64([0, 1, 2, 3, (1 << 64) - 2]), np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))):
        n = len(known)
        v = maxent.Vocabulary(0, 0, known, np.zeros(n), np.arange(n) % 64, np.arange(n) % 32, np.zeros(64), np.zeros((32, 32)), np.ones(32))
        h = np.concatenate([known, known + np.uint64(1), np.uint64([0, (1 << 64) - 1])])
        at, klass, slot = maxent.look_up(v, h, np.arange(len(h)) % 32)
        place = {x: i for i, x in enumerate(known.tolist())}
        assert at.tolist() == [place.get(x, -1) for x in h.tolist()]
        assert klass.tolist() == [p % 64 if p >= 0 else 32 + i % 32 for i, p in enumerate(at.tolist())]
        assert slot.tolist() == [max(p, 0) % 32 if p >= 0 else 0 for p in at.tolist()]


def test_emissions_of_sequences_of_unlike_lengths():
    rng = np.random.default_rng(4)
    p = bilstm.initial(9, 5, 3, 4)
    texts = [rng.integers(0, 9, n) for n in (3, 0, 70, 1, 70, 12, *range(2, 40))]
    for ids, e in zip(texts, bilstm.emissions_of(p, texts)):
        assert e.shape == (len(ids), 5)
        if len(ids):
            both = np.concatenate([bilstm._run(p, ids[None], side, False)[0][0] for side in "fb"], axis=1)
            assert np.allclose(e, both @ p["Wo"] + p["bo"])


def test_marginals_of_sequences_with_tags():
    rng = np.random.default_rng(6)
    p = {"A": rng.normal(size=(3, 3)), "a0": np.zeros(3)}
    e = rng.normal(size=(6, 8, 3))
    e[::2, :, 0] += 30.0
    tags, sure = bilstm.decode_emissions(p, e)
    alpha, beta, z = bilstm.forward_backward(p, e)
    all_of_them = np.exp(np.take_along_axis(alpha + beta, tags[:, :, None], 2)[:, :, 0] - z[:, None])
    assert not tags[::2].any() and tags[1::2].any(axis=1).all()
    assert np.allclose(sure[1::2], all_of_them[1::2]) and (sure[::2] == 1).all()


def test_states_are_computed_once_where_they_fit(monkeypatch):
    read = []

    def counted(p, texts):
        read.extend(len(x) for x in texts)
        return lettered(p, texts)

    monkeypatch.setattr(bilstm, "emissions_of", counted)
    model = bilstm.initial(pii.SYMBOLS, len(pii.TAGS))
    model["A"][:, 2::2] = -50.0
    model["A"][1, 2] = model["A"][2, 2] = 0.0
    model["A"][1:, 1::2] = -50.0
    texts = ["a" * 900 + "q" * 30 + "a" * 1500, "q" * 20 + "a" * 10]
    found = pii.find(texts, model)
    once = sum(read)
    assert once <= sum(map(len, texts)) + 4 * pii.MARGIN
    monkeypatch.setattr(pii, "KEPT", 0)
    assert pii.find(texts, model) == found and found[0][1] == [("email", 900, 930)] and found[1][1] == [("email", 0, 20)]
    assert sum(read) > 2 * once
