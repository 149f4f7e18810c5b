import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from cases import WORD, documents, lower, no_documents, prose, saved
from pipewatch.llm import pii, sketch, toxicity, warc

PAGES = "page_id long, url string, html string, chunk string, digest string"


def pages(spark):
    rng = random.Random(1)
    big = prose(rng, 400)
    rows = [(i, f"http://x/{i}", prose(rng, rng.randint(1, 300))) for i in range(40)]
    rows += [(100 + i, "http://copy", big) for i in range(30)] + [(200 + i, None, "short") for i in range(3)]
    rows += [(300, "http://é\r\nX: y", "a\r\n\r\nb\r\n\r\n"), (301, "u", "\r\n\r\n" * 500), (302, "u", None), (303, "u", ""), (None, "u", big), (304, "u", "WARC/1.1\r\n\r\n" * 200)]
    rows += [(305, "u", "é😀" * 3000), (129, "http://copy", big), (306, "u", "x" * 5000 + "\r\n"), (307, "u", "\r"), (308, "u", "\n\r\n\r")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


@pytest.mark.parametrize("size", [warc.CHUNK, 7])
def test_round_trip(spark, tmp_path, size):
    df = pages(spark).repartition(3)
    warc.write(df, str(tmp_path / "a"), size=size)
    chunks = warc.read_chunks(spark, str(tmp_path / "a")).collect()
    assert all(c.verified for c in chunks)
    payloads, revisits = Counter(), {}
    parts = {}
    for c in chunks:
        if c.type == "revisit":
            revisits[c.page_id] = c.refers_to
        else:
            parts.setdefault((c.page_id, c.record), {}).setdefault(c.chunk_no, []).append(c)
    for (page, _), by_number in parts.items():
        for copies in zip(*(by_number[n] for n in sorted(by_number))):
            payloads[(page, b"".join(x.chunk for x in copies).decode())] += 1
            assert copies[-1].last and not any(x.last for x in copies[:-1])
    given = [(r.page_id, r.html or "") for r in df.collect()]
    top = {}
    for p, h in given:
        if len(h.encode()) >= 1000:
            top[h] = max(top.get(h, -1), -1 if p is None else p)
    expected, again = Counter(), {}
    for p, h in given:
        if h in top and (p is None or p != top[h]) and top[h] >= 0:
            again[p] = top[h]
        else:
            expected[(p, h)] += 1
    assert payloads == expected and revisits == again
    got = warc.records(warc.read_chunks(spark, str(tmp_path / "a"), payloads=False)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((p, len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for p, h in given)


def test_no_pages(spark, tmp_path):
    folder = saved(spark, tmp_path, pages=spark.createDataFrame([], PAGES))
    assert warc.query(spark, folder).count() == 0


def test_damage_is_seen(spark, tmp_path):
    import gzip
    import os

    warc.write(pages(spark).coalesce(1), str(tmp_path / "a"), size=50)
    file = next(os.path.join(tmp_path, "a", f) for f in os.listdir(tmp_path / "a") if f.endswith(".gz"))
    data = gzip.decompress(open(file, "rb").read())
    at = data.find("é😀".encode())
    os.mkdir(tmp_path / "b")
    with gzip.open(tmp_path / "b" / "part.txt.gz", "wb") as out:
        out.write(data[:at] + "è".encode() + data[at + 2 :])
    chunks = warc.read_chunks(spark, str(tmp_path / "b")).collect()
    assert not all(c.verified for c in chunks) and any(c.verified for c in chunks)


def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 180, 3)], "doc_id long, quality int, toxic int")


def test_stages_do_what_they_say(spark, sf, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "source_mix", "packing"]
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = rows.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, rows, sf).write.parquet(path)
        before, rows = rows, spark.read.parquet(path)
        seen[name] = (before, rows)
        assert name == "packing" or rows.columns == columns
    before, after = seen["toxicity"]
    scored = toxicity.score(before, toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet")))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored.filter("tox_score < 0.5").collect()}
    before, after = seen["near_duplicates"]
    words = {r.doc_id: WORD.findall(lower(r.text)) for r in before.collect()}
    texts = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for d, w in words.items()}
    stay = {r.doc_id for r in after.collect()}
    alike = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    assert not any(alike(texts[a], texts[b]) for a in stay for b in stay if a < b)
    assert all(any(alike(texts[a], texts[b]) for b in texts if b != a) for a in set(texts) - stay)
    before, after = seen["personal_data"]
    assert before.count() == after.count() and not any(pii.base_spans(r.text) for r in after.collect())
    before, after = seen["source_mix"]
    assert sum(len(WORD.findall(r.text)) for r in before.collect()) == pytest.approx(sum(len(WORD.findall(r.text)) for r in after.collect()), rel=0.01)
    before, after = seen["packing"]
    assert Counter(r.doc_id for r in before.collect()) == Counter(r.doc_id for r in after.filter("start = 0").collect())


def test_pipeline_over_odd_rows(spark, tmp_path):
    folder = saved(spark, tmp_path, documents=documents(spark).select("doc_id", "text", "lang", "source", "n_chars"), labels=labels(spark))
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = saved(spark, tmp_path / "none", documents=no_documents(spark).select("doc_id", "text", "lang", "source", "n_chars"), labels=labels(spark))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_sketch_stage_drops_no_lone_document(spark):
    df = documents(spark, n=30)
    groups = sketch.near_duplicates(df).collect()
    kept = {r.doc_id for r in sketch.one_of_each(df).collect()}
    assert {r.component_id for r in groups} == kept
