import zlib

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm import packing
from larkspur.llm._common import text_chunks

from .helpers import documents, empty, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_table_gives_the_ids_of_whole_texts():
    import pyarrow as pa

    odd = ["It's ~ a ~tilde~, <|endoftext|>x y z\x85w", "ÀÉ İ ǅ é ́x 日本語 🙂 12345", " \n\t", "", *[t or "" for t in texts()]]
    whole, table = Tokenizer.from_file(PATH), packing.WordTokens(PATH, limit=500)
    for lo, hi, data, offsets in text_chunks(pa.array(odd), max_docs=7):
        ids, bound = table.ids(data, offsets)
        for i in range(hi - lo):
            assert ids[bound[i] : bound[i + 1]].tolist() == whole.encode(odd[lo + i], add_special_tokens=False).ids


def test_hashing_words_takes_little_memory():
    import tracemalloc

    from larkspur.llm._common import span_hashes, spans

    data = np.frombuffer(b"some words of a text " * 50_000, np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]))
    tracemalloc.start()
    span_hashes(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # 31.6 MB with a megabyte at once, 6.0 with 64 KB


def test_word_table_is_small_and_goes_with_its_use():
    import pyarrow as pa

    from larkspur.llm._common import KEPT

    table = packing.WordTokens(PATH)
    _, _, data, offsets = next(text_chunks(pa.array([" ".join(f"word{i}" for i in range(300_000))]), max_bytes=1 << 24))
    ids, _ = table.ids(data, offsets)
    assert ids.dtype == np.uint32
    assert table.pool.nbytes <= 2.5 * table.used + (1 << 21)
    KEPT["here"] = table
    list(text_chunks(pa.array(["a"]), keep=True))
    assert KEPT
    list(text_chunks(pa.array(["a"])))
    assert not KEPT


def test_pieces_and_places(spark):
    docs = documents(spark)
    got = packing.pack(packing.pieces(docs, PATH, capacity=64), capacity=64, group_pieces=50).toPandas()
    whole = Tokenizer.from_file(PATH)
    want = []
    for r in docs.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], np.uint32)
        want += [(r.doc_id, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    key = lambda x: (x[0] is None or x[0] != x[0], x[0] if x[0] == x[0] else None) + tuple(x[1:])
    have = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(map(str, map(key, have))) == sorted(map(str, map(key, want)))
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert g.length.sum() <= 64


def test_few_sequences(spark):
    docs = spark.createDataFrame([(i, "a " * (i % 61)) for i in range(600)], "doc_id long, text string")
    got = packing.pack(packing.pieces(docs, PATH, capacity=64), capacity=64).toPandas()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 2


def test_empty_table(spark):
    assert packing.pack(packing.pieces(empty(spark), PATH)).collect() == []


@given(st.lists(st.integers(1, 40), max_size=120))
def test_best_fit_decreasing_against_a_linear_search(lengths):
    got, _ = packing.best_fit_decreasing(np.array(lengths, np.int64), 40)
    open_, want = [], 0
    for size in sorted(lengths, reverse=True):
        fits = [r for r in open_ if r >= size]
        if fits:
            open_.remove(min(fits))
            open_.append(min(fits) - size)
        else:
            want += 1
            open_.append(40 - size)
    assert len(set(got.tolist())) == want
