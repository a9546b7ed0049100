import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axiomill.llm import token_files as T

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano_selects_every_value(steps):
    values = np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
    u = int(values[-1]) if len(values) else 0
    e = T.EliasFano.from_bytes(T.EliasFano.of(values, u).to_bytes())
    assert e.all().tolist() == values.tolist()
    assert [e.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_near_minimal_space():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 5000))
    assert len(T.EliasFano.of(values, int(values[-1])).to_bytes()) * 8 < len(values) * (2 + np.log2(values[-1] / len(values)) + 1) + 300


TEXTS = ["", " ", "  a  b ", "the and of\nthe", "it's 'll we're", "x\n\n y\t z 　 q", "<|endoftext|> x", "日本 é  a", " lead", "trail ", "a\x1cb \x85c", "!!  ?? , . a,b.c"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab ,.'\n\té日1", max_size=40))
def test_encoder_equals_library(text):
    enc = T.encoder(PATH)
    assert enc.encode([text])[0].tolist() == enc.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.'-|\n\t\r\x00\x1cé×Àß\x85\xa0\u180e\u2003\u200b\u2028\u3000’日😀1", max_size=30), max_size=6))
def test_encoder_equals_library_around_every_kind_of_white_space(texts):
    enc = T.encoder(PATH)
    enc.forget()
    assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_library_on_mixed_texts_known_or_new():
    enc = T.Encoder(PATH, cached=5)  # forgets before every group
    texts = TEXTS + [a + b for a in TEXTS for b in TEXTS]
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(texts)] == want == [x.tolist() for x in T.encoder(PATH).encode(texts)] == [x.tolist() for x in T.encoder(PATH).encode(texts)]
    ids, ends = enc.encode_array(pa.array(texts, pa.large_string()).slice(7, 40))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want[7:47]


def test_encoder_learns_a_word_once_whatever_follows_it():
    words, marks = [f"w{chr(97 + i)}{x}" for i in range(26) for x in ("onö", "ing")], ["", ",", ".", ";", ":", "!", "?", ")", "|"]
    enc, texts = T.Encoder(PATH), [" ".join(w + m for m in marks) + "\n" + w for w in words]
    assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert len(enc.known) <= 2 * len(words) + len(marks)  # a word with a space, without one (line starts), the marks and the line break


def test_grouped_batches_keep_every_row():
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": ["x" * (T.GROUP // 3 + 1)]}) for i in range(7)]
    assert [g["doc_id"].to_pylist() for g in T.grouped(batches)] == [[0, 1, 2], [3, 4, 5], [6]] and list(T.grouped([])) == []


def test_file_round_trip_with_nulls_repeats_and_long_texts(spark):
    rows = [(5, TEXTS[3]), (1, None), (None, "null id"), (5, TEXTS[3]), (2, ""), (9, "word " * 60_000)] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as shard", "2 as part")
    out = T.read_tokens(T.write_tokens(df, PATH)).collect()
    tok = T.encoder(PATH).tok
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_shard_random_access():
    ids = [np.arange(n, dtype="<u4") + 70_000 for n in (3, 0, 5)]
    s = T.Shard(T.write_shard([1, None, 7], [3, 0, 5], np.concatenate(ids)))
    assert [s.doc(i).tolist() for i in range(3)] == [x.tolist() for x in ids] and s.nulls.tolist() == [False, True, False]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.read_tokens(T.write_tokens(df, PATH)).count() == 0
