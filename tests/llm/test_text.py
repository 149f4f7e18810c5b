import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import WORD, lower
from pipewatch.llm import text as tx

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab Z\n\t\r\x0b\x0c\x1cé日 ")), max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    h, rows, n = tx.words(pa.array(texts, pa.string()), lower=True)
    expected = [WORD.findall(lower(t)) for t in texts]
    assert n.tolist() == [len(w) for w in expected]
    flat = [w for words in expected for w in words]
    assert h.tolist() == tx.hash_strings(flat).tolist()
    assert rows.tolist() == [i for i, words in enumerate(expected) for _ in words]


def test_hashes_tell_words_of_all_lengths_apart():
    words = ["a" * n for n in range(1, 60)] + ["a" * n + "b" for n in range(60)] + ["\x00", "\x00\x00"]
    assert len(set(tx.hash_strings(words).tolist())) == len(words)


def test_slices_cover_the_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 50, None, "", "y" * 500, "z"])], ["text"])
    parts = list(tx.slices(batch, size=100))
    assert sum(p.num_rows for p in parts) == 5 and len(parts) > 1
    assert pa.Table.from_batches(parts)["text"].to_pylist() == batch.column(0).to_pylist()
