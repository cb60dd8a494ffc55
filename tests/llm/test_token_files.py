"""Token ids: coding, files, slices, and the library's own encoding of every text."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scholiast.llm.elias_fano import U64, EliasFano, encode
from scholiast.llm.queries import op11_token_ids
from scholiast.llm.token_files import MAGIC, TokenFile, TokenFiles, read_ids, write_ids
from scholiast.llm.token_ids import splits_at_space, token_ids, write_token_ids
from tests.llm.helpers import frame

WORDS, BYTES = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
ODD = ["", None, "One. Two, 3; it's 's. é. é. naïve!", "<|endoftext|>. a<|endoftext|>b", ".", "a.", "a .b", "\n\v", "x" * 9000, "日本語。 テキスト.", "z\x85q. r", "the cat " * 4000, "No!? no... NO!", "'S 'S's it'S", "H\u0331e E\u0301 I\u0307x a=\u0338b <\u0338 1\u20e3 X9y8 (The-End)...[a1B2] \u2026,\u2026A", "<|endoftext|>A1<|EndOfText|>B2 <|x", "A\u00c9B1\u00e9 \u00bd1\u0663 don'T3x ''s", "\u03a3\u03a3 ABC\u03a3 K\u212a"]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 511, 512, 513, 20_001])
@pytest.mark.parametrize("top", [0, 1, 1000, 2**40, 2**64 - 1])
def test_coded_numbers_read_back(n, top):
    r = random.Random(n + top)
    values = np.array(sorted(r.randrange(top + 1) for _ in range(n)), dtype=U64)
    data = encode(values)
    coded = EliasFano(data)
    assert len(coded) == n and np.array_equal(coded.slice(0, n), values)
    if n > 512:  # near-minimal: two bits and the low ones for each number, a sixteenth of a bit for samples
        assert len(data) * 8 <= n * (2.1 + max(0, np.log2((top + 1) / n))) + 400
    for i in r.sample(range(n), min(n, 20)):
        j, q = r.randrange(i, n), r.randrange(top + 1)
        assert coded[i] == int(values[i]) and np.array_equal(coded.slice(i, j + 1), values[i : j + 1])
        assert coded.rank(q) == int((values <= U64(q)).sum())


def plain(rows, path):
    """(doc_id, start, n_tokens, crc) of rows in order, by the library on whole texts."""
    model, out, start = Tokenizer.from_file(path), [], 0
    for doc_id, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def digest(df):
    return [tuple(r) for r in df.selectExpr("doc_id", "start", "n_tokens", "crc32(ids)").orderBy("start").collect()]


def test_whole_table_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert [tuple(r) for r in op11_token_ids(spark, "/root/testdata/sf0.001").orderBy("start").collect()] == plain(rows, WORDS)


@pytest.mark.parametrize(("path", "by_word"), [(WORDS, True), (BYTES, False)])
def test_odd_texts_and_both_ways(spark, tmp_path, path, by_word):
    assert splits_at_space(open(path).read()) is by_word
    docs = frame(spark, list(enumerate(ODD)))
    write_token_ids(docs, str(tmp_path), path, 2)
    assert digest(read_ids(spark, str(tmp_path))) == plain(enumerate(ODD), path)


def test_nulls_repeats_and_negative_ids(spark, tmp_path):
    rows = [(None, "gone"), (-5, "minus five"), (-5, "minus five"), (3, "a b"), (3, "c d e"), (2**62, None), (None, "gone")]
    write_token_ids(frame(spark, rows), str(tmp_path), WORDS, 2, file_ids=4)
    got = digest(read_ids(spark, str(tmp_path), slice_ids=3))
    assert [g[0] for g in got] == [None, None, -5, -5, 3, 3, 2**62]
    either = [plain([*rows[:1] * 2, *rows[1:3], *middle, rows[5]], WORDS) for middle in (rows[3:5], rows[4:2:-1])]
    assert got in either
    write_token_ids(frame(spark, rows), str(tmp_path), WORDS, 2, overwrite=True)
    assert digest(read_ids(spark, str(tmp_path))) == got  # a rerun agrees, whatever the files
    with pytest.raises(Exception, match="already"):
        write_token_ids(frame(spark, rows), str(tmp_path), WORDS, 2)


def test_empty_table(spark, tmp_path):
    write_token_ids(frame(spark, []), str(tmp_path), WORDS, 2)
    assert read_ids(spark, str(tmp_path)).count() == 0


def test_without_an_end_texts_may_be_empty(spark, tmp_path):
    write_token_ids(frame(spark, [(i, "" if i % 3 else "one two") for i in range(30)]), str(tmp_path), WORDS)
    assert [(r[0], r[2]) for r in digest(read_ids(spark, str(tmp_path), slice_ids=1))] == [(i, 0 if i % 3 else 2) for i in range(30)]


def test_single_documents_and_single_ids(spark, tmp_path):
    texts = [f"number {i} " * (i % 7) for i in range(500)]
    write_token_ids(frame(spark, list(enumerate(texts))).coalesce(1), str(tmp_path), WORDS, 2)
    model = Tokenizer.from_file(WORDS)
    parts = sorted(tmp_path.glob("*.ids"))
    files = [TokenFile(str(p)) for p in parts]
    assert all(p.read_bytes()[:8] == MAGIC for p in parts) and sum(f.n_docs for f in files) == 500
    for file in files:
        ids = file.doc_ids(0, file.n_docs).to_pylist()
        for i in range(0, file.n_docs, 17):
            expected = [*model.encode(texts[ids[i]], add_special_tokens=False).ids, 2]
            assert file.ids(i).tolist() == expected
            assert {file.holding(k) for k in range(file.start(i), file.start(i) + len(expected))} == {i}


def test_failed_writes_leave_nothing_to_read(spark, tmp_path):
    write_token_ids(frame(spark, [(1, "kept")]), str(tmp_path), WORDS, 2)
    before = digest(read_ids(spark, str(tmp_path)))
    unordered = spark.createDataFrame([(5, b"\1\0\0\0"), (4, b"\2\0\0\0")], "doc_id long, ids binary").coalesce(1)
    too_large = spark.createDataFrame([(5, b"\1\0\1\0")], "doc_id long, ids binary")
    for rows in (unordered, too_large):
        with pytest.raises(Exception, match="ascending order|fit in 2 bytes"):
            write_ids(rows, str(tmp_path), id_bytes=2, overwrite=True)
    assert digest(read_ids(spark, str(tmp_path))) == before
    assert TokenFiles.name() == "token_files"


def test_order_and_other_columns_stay_out(spark):
    docs = spark.createDataFrame([(2, "b", "x", 1), (1, "a", "y", 2)], "doc_id int, text string, ids string, start int").coalesce(1)
    assert [r.doc_id for r in token_ids(docs, open(WORDS).read()).collect()] == [2, 1]
