"""The pipeline against plain versions of its stages, applied one after the other."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_decontaminate import brute as overlaps  # noqa: E402
from test_decontaminate import words as plain_words  # noqa: E402
from test_ngram_join import brute as components  # noqa: E402
from test_substrings import brute as repeats  # noqa: E402

from factbase.llm.queries import table  # noqa: E402


def coded(text, tok):
    ids = tok.encode(text, add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def expected(rows, kept_by_language, items, tok):
    """rows: (id, text) in order of ids; the language stage is taken as it is, its accuracy is tested elsewhere."""
    rows = [r for r in rows if r[0] in kept_by_language]
    rows = [r for r, c in zip(rows, components(rows)) if c[2] == r[0]]
    cut = {i: (kept if gone else text, n == gone > 0) for (i, text), (_, n, gone, kept, _) in zip(rows, repeats(rows, 20))}
    rows = [(i, text) for i, (text, empty) in cut.items() if not empty]
    grams = {tuple(w[k:k + 3]) for _, t in items for w in [plain_words(t)] for k in range(len(w) - 2)}
    near = [(i, t) for i, t in rows if any(tuple(w) in grams for v in [plain_words(t)] for w in zip(v, v[1:], v[2:]))]
    bad = {x[0] for x in overlaps(near, items)}
    return sorted((i, *coded(t, tok)) for i, t in rows if i not in bad)


def test_pipeline(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs, items = table(spark, folder, "documents"), [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]
    more = [(9001, None, "en"), (9002, "", "en"), (9003, "12 34 !", "en"), (9004, items[0][1], "en"), (9005, "the of and " * 200, "en"),
            (9006, "the of and " * 200, "en")]
    more = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in more], docs.schema)
    docs.union(more).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, folder, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    first = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    kept = {r.doc_id for r in first.collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    lost = {i for i, _ in rows} - kept
    assert {9001, 9002, 9003} <= lost and len(lost) <= 3 + len(rows) // 100
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    want = expected(rows, kept, items, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert got == want and 0 < len(got) < len(kept) and 9004 not in {r[0] for r in got}


@pytest.mark.parametrize("stage", range(4))
def test_stage_keeps_columns_and_takes_empty_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, k0 string"
    rows = [(1, "der Hund und die Katze", "de", "a", 1, 5, "x"), (2, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        out = corpus_pipeline.STAGES[stage][1](spark, frame, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert (1, "der Hund und die Katze", "de", "a", 1, 5, "x") in map(tuple, out.collect()) or frame is not docs
