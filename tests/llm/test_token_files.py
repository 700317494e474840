import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelframe.llm import separators as S
from reelframe.llm import token_files as T
from reelframe.llm import words as W

PATH = public_tokenizers.path("byte_bpe_50k.json")
with open(PATH, encoding="utf-8") as f:
    DEFINITION = f.read()


@pytest.fixture(scope="module")
def tools():
    return T.TokenEncoder(DEFINITION), Tokenizer.from_str(DEFINITION)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


TEXTS = ["", None, "a b", " a", "a ", "a  b", "a\n\nb", "x  y", "it's 3.14, isn't it?", "été. Ça va?\nOui.", "a<|endoftext|>b", "**bold***'s", "don't.\n'll", "\n", "\t\tx", "word." * 40, "1a2b 3", "漢字 か。　x", "  x", "é×. ü÷."]


def test_units_give_the_ids_of_the_library(tools):
    for _ in range(2):
        got = tools[0].encode(pa.array(TEXTS))
        assert [g.tolist() for g in got] == [ids_of(tools[1], t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aB' \n.,1é× -s<|\t", max_size=20), max_size=5))
def test_random_texts_give_the_ids_of_the_library(tools, texts):
    got = tools[0].encode(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [ids_of(tools[1], t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_text_gives_the_ids_of_the_library(tools, texts):
    got = tools[0].encode(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [ids_of(tools[1], t) for t in texts]


def test_long_rows_go_in_pieces(tools, monkeypatch):
    for module in (W, T):
        monkeypatch.setattr(module, "PIECE", 40)
    texts = ["the quick, brown fox\njumps over it. " * 9, "a  b " + "word and more " * 12, "x" * 130, ""]
    got = tools[0].encode(pa.array(texts))
    assert [g.tolist() for g in got] == [ids_of(tools[1], t) for t in texts]


@given(st.integers(1, 32), st.integers(0, 200), st.integers(0, 2**32))
@settings(max_examples=100, deadline=None)
def test_packing(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n).astype(np.uint32)
    packed = T.pack(ids, bits)
    assert len(packed) == (n * bits + 7) // 8
    assert (T.unpack(packed, bits, 0, n) == ids).all()
    a = n // 3
    assert (T.unpack(packed, bits, a, n - a) == ids[a:]).all()


def test_bits():
    assert [T.bits_of(v) for v in (1, 2, 3, 256, 257, 50257, 1 << 17)] == [1, 1, 2, 8, 9, 16, 17]


@pytest.mark.parametrize("vocabulary", [50257, 100000])
def test_files_hold_every_document_in_order(spark, tools, vocabulary):
    rows = [(7, "b c", "z"), (3, None, None), (5, "", "z"), (9, "long " * 300, "z"), (None, "no id", "z"), (7, "b c", "z"), (7, "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = T.new_folder(spark, "test-tokens")
    T.write_token_files(docs, DEFINITION, folder, vocabulary, block_tokens=4)
    got = sorted(T.read_documents(spark, folder, keep_ids=True).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for g, (doc, text, _) in zip(got, want, strict=True):
        ids = ids_of(tools[1], text) + [0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (doc, start, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = T.new_folder(spark, "test-tokens")
    T.write_token_files(docs, DEFINITION, folder, 50257)
    assert T.read_documents(spark, folder).collect() == []


def files_of(spark, streams, width, block):
    rows = []
    for f, ids in enumerate(streams):
        ids = np.array(ids, f"<u{width}")
        rows += [(f, b, ids[a : a + block].tobytes()) for b, a in enumerate(range(0, len(ids), block))]
    return spark.createDataFrame(rows, "file int, block long, payload binary")


def plain_counts(streams, end):
    out = []
    for f, ids in enumerate(streams):
        start = ordinal = 0
        for i, x in enumerate(ids):
            if x == end:
                out.append((f, ordinal, start, i - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < len(ids):
            out.append((f, ordinal, start, len(ids) - start, False))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_separator_scan(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = np.random.default_rng(block * 10 + chunk)
    streams = [rng.choice([0, 1, 2, 9], 60, p=[0.4, 0.3, 0.2, 0.1]).tolist(), [9, 9, 1, 9], [1] * 30, [1] * 30 + [9], [9] + [2] * 25]
    got = S.count_tokens(files_of(spark, streams, 2, block), 2, 9)
    assert sorted(map(tuple, got.select("file", "ordinal", "start", "n_tokens", "complete").collect())) == plain_counts(streams, 9)


def test_flat_files_of_documents(spark):
    rows = [(1, "héllo", "x"), (2, None, "x"), (3, "", "x"), (4, "y" * 5000, "x"), (None, "z", "x"), (1, "héllo", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string")
    folder = T.new_folder(spark, "test-flat")
    S.write_flat_files(docs, folder, block_ids=7)
    files = spark.read.parquet(folder)
    got = S.named(S.count_tokens(files), files).select("doc_id", "n_tokens").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted([(i, len((t or "").encode())) for i, t, _ in rows], key=key)


def test_row_groups_of_flat_files_are_bounded(spark):
    """A reader holds a row group's blocks at once; texts end on, before and after the pieces they are cut into."""
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    lengths = [0, W.PIECE, 0, 0, W.PIECE + 1, 3 * W.PIECE, *range(300), W.PIECE - 1, 5 * W.PIECE, 0]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long").coalesce(1)
    folder = T.new_folder(spark, "test-groups")
    S.write_flat_files(rows.selectExpr("doc_id", "repeat('y', int(n)) AS text"), folder)
    files = spark.read.parquet(folder)
    got = S.named(S.count_tokens(files), files).where("complete").select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got)) == list(enumerate(lengths))
    groups = []
    for f in files.inputFiles():
        meta = pq.ParquetFile(urlparse(f).path).metadata
        groups += [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]
    assert sum(groups) > 40 and max(groups) * (1 << 20) <= 1 << 24


def test_separators_leave_the_scan_of_a_block_as_rows(spark):
    """Blocks full of separators: no window and no join holds a block's separators in one row."""
    got = S.count_tokens(files_of(spark, [[9] * 5000, [9] * 3000 + [1] * 10], 2, 1000), 2, 9)
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == plain_counts([[9] * 5000, [9] * 3000 + [1] * 10], 9)


def test_names_of_documents_are_not_broadcast(spark):
    folder = T.new_folder(spark, "test-names")
    S.write_flat_files(spark.range(50_000, numPartitions=1).selectExpr("id AS doc_id", "'' AS text"), folder)
    files = spark.read.parquet(folder)
    out = S.named(S.count_tokens(files), files)
    assert out.count() == out.where("complete AND n_tokens = 0").count() == 50_000
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert "SortMergeJoin" in joins[0]


def test_a_repeated_block_may_end_a_file_within_a_document(spark):
    twice = files_of(spark, [[1, 2]], 2, 2)
    assert list(map(tuple, S.count_tokens(twice.union(twice), 2, 9).collect())) == [(0, 0, 0, 4, False)]


def test_odd_blocks(spark):
    ids = lambda *v: np.array(v, "<u2").tobytes()
    once = [(0, 0, ids(1, S.BYTE_END, 2), "x"), (0, 1, None, "x"), (0, 2, b"", "x"), (1, 0, b"", "x")]
    schema = "file int, block long, payload binary, ids string"
    count = lambda rows: sorted(tuple(r) for r in S.count_tokens(spark.createDataFrame(rows, schema)).collect())
    assert count(once) == [(0, 0, 0, 1, True), (0, 1, 2, 1, False)]
    assert count([once[0], *once]) == [(0, 0, 0, 1, True), (0, 1, 2, 2, True), (0, 2, 5, 1, False)]
    assert count([]) == []
