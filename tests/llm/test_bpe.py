"""Chunked encoding against the tokenizers library on whole texts."""

import hashlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from factbase.llm.bpe import encode_decode  # noqa: E402

FILE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "   \n", "Hello, World!", "it's we've 123 a1b2 don't'll", "á ́x é́", "x" * 5000,
         "ab1-" * 400, "éß" * 900, "a'" * 300 + "s", "Hello, World!", "<|endoftext|> y<|startoftext|>z",
         "<|endoftext|>" * 60, "a b c\x85d", "你好" * 300, "12345" * 100, "\x00\x01 \x1c z", "İ ΣΣ ẞ",
         "\n".join(["the of and"] * 3000), "!?" * 700 + "'s" * 80]


@pytest.mark.parametrize("every", [1, 3, 50])
def test_same_as_whole(spark, every):
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(2)
    tok = Tokenizer.from_file(FILE)
    got = encode_decode(docs, FILE, every=every).collect()
    assert len(got) == len(rows)
    for r in got:
        want = tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want), r.doc_id
        assert r.decoded == tok.decode(want, skip_special_tokens=False)


def test_table_of_chunks_is_renewed(spark, monkeypatch):
    """A task forgets its chunks between steps, never inside one."""
    from factbase.llm import bpe
    monkeypatch.setattr(bpe, "KEPT", 3)
    monkeypatch.setattr(bpe, "STEP", 300)
    test_same_as_whole(spark, 1)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode_decode(docs, FILE).collect() == []


def test_query_over_documents(spark):
    from factbase.llm.queries import op10_bpe, table
    folder = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(FILE)
    texts = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    got = {r.doc_id: r for r in op10_bpe(spark, folder).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(
            tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_passages_are_encoded_once():
    """A passage inside other texts is not encoded again, and its words are known to new passages."""
    import pyarrow as pa

    from factbase.llm import bpe
    shared = " ".join(f"word{i * 7919 % 1000}" for i in range(2000))
    texts = [shared, f"another start {shared} and another end", shared]
    passages = bpe.Passages(bpe.Chunks(Tokenizer.from_file(FILE)))
    made = [passages.made]
    for text in texts:
        bpe._coded(pa.array([text]), passages, bpe.EVERY)
        made.append(passages.made)
    first, second, third = np.diff(made).tolist()
    assert first <= len(shared) and 0 < second < len(shared) / 4 and third == 0
    assert passages.small.made < len(shared)
    start, end = bpe._cuts(bpe.Words(pa.array([shared])), bpe.EVERY)
    assert 20 < len(start) < 200 and end[-1] == len(shared)


def test_repair_goes_on_until_all_joins_agree():
    """Chunks cut at every letter grow back to the tokens of the whole run."""
    import pyarrow as pa

    from factbase.llm import bpe
    tok = Tokenizer.from_file(FILE)
    for text in ["internationalization", "ab12cd", "don't'll", "a!?!b'scd", "éßéß" * 9]:
        data = np.frombuffer(text.encode(), np.uint8)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        start, end = at, np.append(at[1:], len(data))
        glued = np.append(np.ones(len(at) - 1, bool), False)
        chunks = bpe.Chunks(tok)
        start, end = bpe._repair(chunks, data, start, end, glued)
        places = chunks.places(data, start, end)
        ids, _ = bpe._joined(chunks, places, np.array([0, len(start)]))[0]
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, text
