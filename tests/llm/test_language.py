"""Language identification: held-out accuracy, a plain recomputation of the scores, defined results of odd rows."""

import math

import numpy as np

from factbase.llm import language
from factbase.llm.queries import op4_language, table

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = op4_language(spark, FOLDER).join(table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == table(spark, FOLDER, "documents").count() and len(out) > 100
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_scores_by_hand(spark):
    docs = spark.createDataFrame([(1, "aaab", "x"), (2, "bbba", "y"), (3, "ab", "y")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    lower = language._letters()

    def features(text):
        p = [int(lower[ord(c)]) for c in text]
        points, first = np.array(p, np.uint32), np.array([0, len(p)])
        return [int(f) for g in language._grams(points, first) for f in g if f < language.FEATURES]

    counts = {"x": features("aaab"), "y": features("bbba") + features("ab")}
    assert len(counts["x"]) == 4 + 3 + 2 + 1
    want = {}
    for k, prior in (("x", 1 / 3), ("y", 2 / 3)):
        want[k] = math.log(prior) + sum(math.log((counts[k].count(f) + 0.5) / (len(counts[k]) + 0.5 * language.FEATURES))
                                        for f in features("Abb"))
    got = language.predict(spark.createDataFrame([(9, "Abb")], "doc_id long, text string"), model).first()
    best = max(want, key=want.get)
    assert got.lang_pred == best
    assert abs(got.score - 1 / sum(math.exp(v - want[best]) for v in want.values())) < 1e-4


def test_odd_rows(spark):
    rows = [(1, None, "en", 5), (2, "", "en", 5), (3, "123 !?", "de", 5), (4, "the cat " * 50_000, "en", 5), (None, "the dog", "en", 5),
            (5, "der Hund", None, 5), (6, "der Hund und die", "de", 5), (6, "der Hund und die", "de", 5), (7, "日本", "ja", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language.fit(docs)
    got = language.predict(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[4].lang_pred == "en" and by[6].lang_pred == "de" and by[7].lang_pred == "ja"
    empty = docs.limit(0)
    assert language.predict(empty, language.fit(empty)).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(empty)).collect()} == {"und"}
