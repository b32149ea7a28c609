import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factbase.llm import token_counts
from factbase.llm.queries import op13_token_counts
from factbase.llm.token_counts import JsonTokenizer, PieceTokenizer, count_tokens

JSON, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SF_DIR = "/root/testdata/sf0.001"
PIECES = ["a", "don't", "we'll", " ", "  ", "\n", "\t\n ", "1", "23", "!", "...", "'", "\xe9", "中文", "。", "\xa0", "　",
          " ", "\x85", "<|endoftext|>", "<|end", "oftext|>", "\U0001f600", "é", "-", "_x", "\x00", "<s>", "▁"]


@pytest.fixture(scope="module")
def plain():
    whole = Tokenizer.from_file(JSON)
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return {JSON: lambda t: len(whole.encode(t or "", add_special_tokens=False).ids), MODEL: lambda t: len(pieces.encode(t or ""))}


@pytest.fixture(scope="module")
def coders():
    return {JSON: JsonTokenizer(open(JSON, encoding="utf-8").read()), MODEL: PieceTokenizer(open(MODEL, "rb").read())}


@pytest.mark.parametrize("file", [JSON, MODEL])
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_cut_texts_count_as_whole_ones(plain, coders, file, text, step):
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    cut = coders[file].split(data, step)
    assert sum(coders[file].lengths(cut)) == plain[file](text)


def test_long_texts_are_cut(coders):
    data = np.frombuffer(("word " * 1000 + "x" * 500 + "," + "y" * 500).encode(), np.uint8)
    assert max(map(len, coders[JSON].split(data, 64))) <= 64 + 501
    assert max(map(len, coders[MODEL].split(data, 64))) < 1200
    ideographs = np.frombuffer(("文字" * 20 + ",").encode("utf-8") * 50, np.uint8)
    assert len(coders[JSON].split(ideographs, 200)) >= 20


def test_batches_have_equal_bytes(monkeypatch):
    import pyarrow as pa
    sizes = []
    told = JsonTokenizer.lengths
    monkeypatch.setattr(JsonTokenizer, "lengths", lambda self, texts: sizes.append(sum(map(len, texts))) or told(self, texts))
    texts = ["one two "] * 300 + ["three four five " * 400] + ["six"] * 300
    got = token_counts._counter("json", open(JSON, "rb").read())(pa.array(texts), 512)
    assert got[300] == 3 * 400 + 1 and set(got[301:]) == {1}
    assert all(512 <= s <= 1100 for s in sizes[:-1]) and len(sizes) > 10


@pytest.mark.parametrize("file", [JSON, MODEL])
def test_odd_rows(spark, plain, file):
    rows = [(1, None), (2, ""), (3, "plain text"), (3, "plain text"), (None, "a b <|endoftext|> <s>"), (5, "na\xefve \n\n\n  text " * 3000),
            (6, "x" * 50000), (7, " \t ")]
    docs = spark.createDataFrame([(i, t, "z", 7) for i, t in rows], "doc_id long, text string, n_tokens string, n_bytes int")
    got = sorted(map(tuple, count_tokens(docs, file, step=1000).collect()), key=repr)
    want = sorted(((i, len((t or "").encode("utf-8")), plain[file](t)) for i, t in rows), key=repr)
    assert got == want
    assert count_tokens(docs.limit(0), file).count() == 0


def test_query(spark, plain):
    got = op13_token_counts(spark, SF_DIR).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        n = plain[JSON](docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode("utf-8")), n, n > 1024)
    assert {r.over_limit for r in got} == {True, False}
