"""Exports read by splits against a plain JSON parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factbase.sources import chats
from factbase.sources.split_exports import split_chat_flat, split_chat_tree, split_conversations


def conversations(rng, n):
    text = lambda: "".join(rng.choices(['"', "\\", "{", "}", "[", "]", ",", "é", "𝄞", "\n", "word ", " "], k=rng.randrange(1, 40)))
    return [{"title": text(), "messages": [{"role": rng.choice(["user", "assistant"]), "content": text(), "tags": [text(), [1, {}]]}
                                           for _ in range(rng.randrange(6))]} for _ in range(n)]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("97", "0")):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, old):
        spark.conf.set(name, value)


def got(spark, folder):
    return {(r.path.rsplit("/", 1)[1], r.conv_no): (r.doc, r.error) for r in split_conversations(spark, str(folder)).collect()}


def test_against_a_json_parser(spark, small_splits, tmp_path):
    rng = random.Random(4)
    files = {}
    for i in range(8):
        value = conversations(rng, rng.choice([0, 1, 3, 30]))
        files[f"{i}.json"] = json.dumps(value, ensure_ascii=i % 2 == 0, indent=[None, 1][i // 2 % 2]), value
    one = conversations(rng, 1)[0]
    files["object.json"] = json.dumps(one), [one]
    files["mixed.json"] = ' [1, "a,]}", {"x": [[], {}]} , null]\n\n', [1, "a,]}", {"x": [[], {}]}, None]
    files["long.json"] = json.dumps([{"t": "x" * 5000}, {"t": "}" * 300}]), [{"t": "x" * 5000}, {"t": "}" * 300}]
    files["blank.json"] = "[" + " " * 300 + "]", []
    files["late.json"] = "\n" * 300 + '[{"a": 1}, 2]', [{"a": 1}, 2]
    files["late_object.json"] = "\n" * 300 + '{"a": {}}' + " " * 300, [{"a": {}}]
    for name, (text, _) in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = got(spark, tmp_path)
    assert all(error is None for _, error in found.values())
    assert {k: json.loads(doc) for k, (doc, _) in found.items()} == {(n, i): c for n, (_, v) in files.items() for i, c in enumerate(v)}


def test_damage_leaves_rows(spark, small_splits, tmp_path):
    value = conversations(random.Random(9), 6)
    text = json.dumps(value)
    files = {"tail.json": text[:-1], "cut.json": text[:-30], "string.json": text[:text.index("title", 400) + 3], "more.json": text + " [1]",
             "gap.json": '[{"a": 1}, {"b": }, {"c": 3}]', "word.json": "word", "one.json": '{"a": {"b": 1}', "empty.json": ""}
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    (tmp_path / "bytes.json").write_bytes(b'[{"a": "\xff\xfe"}, {"b": 1}]')
    found = got(spark, tmp_path)
    errors = {n: sorted((str(k[1]), e) for k, (_, e) in found.items() if k[0] == n and e) for n in [*files, "bytes.json"]}
    assert errors["tail.json"] == [("None", "ends too early")]
    assert [e for _, e in errors["cut.json"]] == ["unreadable", "ends too early"]
    assert [e for _, e in errors["string.json"]][-1] == "ends too early"
    assert errors["more.json"] == [("None", "text after the end")]
    assert errors["gap.json"] == [("1", "unreadable")] and json.loads(found["gap.json", 2][0]) == {"c": 3}
    assert errors["word.json"] == [("0", "unreadable")] and [e for _, e in errors["one.json"]] == ["unreadable", "ends too early"]
    assert errors["empty.json"] == [] and errors["bytes.json"] == []
    for name in ("tail.json", "more.json"):
        assert [json.loads(found[name, i][0]) for i in range(6)] == value
    assert [json.loads(found["cut.json", i][0]) for i in range(5)] == value[:5]


def test_messages_equal_those_of_whole_files(spark, small_splits, tmp_path):
    rng = random.Random(2)
    flat = json.dumps(conversations(rng, 20))
    tree = json.dumps([{"mapping": {f"n{j}": {"message": {"author": {"role": "user"}, "content": {"parts": [f"part {i} {j} }}", {"image": 1}]}}}
                                    for j in range(rng.randrange(4))}} for i in range(20)])
    for name, text, split, whole in (("flat", flat, split_chat_flat, chats.read_chat_flat), ("tree", tree, split_chat_tree, chats.read_chat_tree)):
        folder = tmp_path / name / "owner_id=a b"
        folder.mkdir(parents=True)
        (folder / "x.json").write_text(text)
        want = whole(spark.createDataFrame([("a b", "x.json", text)], "owner_id string, file string, doc string"))
        mine = split(split_conversations(spark, str(tmp_path / name))).withColumn("file", F.element_at(F.split("file", "/"), -1))
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, want.collect())) != []


def test_one_file_is_read_by_many_tasks(spark, small_splits, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(conversations(random.Random(1), 60)))
    from factbase.sources.split_exports import _records
    assert _records(spark, str(tmp_path)).rdd.getNumPartitions() > 20
