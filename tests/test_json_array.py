"""JSON lists read in byte ranges."""

import json
import random

import pytest

from gleaner.sources import corpus, json_array

NASTY = ["plain", "a } b", 'quote " and }', "back\\slash \\\\", "{[", "]}", '\\"}', "é😀}", "", "new\nline }\n{"]


@pytest.fixture(params=[150, 1 << 27])
def ranges(spark, request):
    """Ranges of a few bytes, so objects and strings lie across them, and one range."""
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(seed):
    rng = random.Random(seed)
    thing = lambda d=0: rng.choice([rng.choice(NASTY), rng.randint(-5, 5), None, True, [rng.choice(NASTY)], {rng.choice(NASTY): rng.choice(NASTY)}] + ([thing(d + 1), [thing(d + 1), {}]] if d < 3 else []))
    return [{"id": f"i{i}", "content": rng.choice(NASTY), "x": thing()} if rng.random() < 0.8 else thing() for i in range(16)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("indent", [None, 2])
def test_items(spark, tmp_path, ranges, seed, indent):
    want = made(seed)
    path = tmp_path / "list.json"
    path.write_text(json.dumps(want, indent=indent, ensure_ascii=seed == 1) + "\n", encoding="utf-8")
    got = json_array.items(spark, f"file://{path}").orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(len(want)))
    assert [json.loads(r["item"] or "null") for r in got] == want and [r["is_object"] for r in got] == [isinstance(w, dict) for w in want]
    rows = corpus.read_corpus(spark, f"file://{path}").orderBy("seq").collect()
    assert [(r["seq"], r["id"], r["content"]) for r in rows] == [(i, w.get("id"), w.get("content")) for i, w in enumerate(want) if isinstance(w, dict)]


@pytest.mark.parametrize("text", ["[]", " [ ] \n", "[1, 2]", '["a}b"]', '[{"id": "a"}, 3]', '[[{"id": "a"}], {"id": "b"}]'])
def test_small_lists(spark, tmp_path, ranges, text):
    (tmp_path / "s.json").write_text(text)
    assert json_array.items(spark, f"file://{tmp_path}/s.json").count() == len(json.loads(text))


@pytest.mark.parametrize("text", ["", "{}", '{"a": [1]}\n', "[", "[{}", '[{"a": 1}', '[{"a": 1},', '[{"a": 1},]', '[{"a": 1} {"b": 2}]', '[{"a": 1}]]', '[{"a": "x}]', "[1, oops]", '[{"a": 1}, oops]', '[{"a": 1}] x', "]", '[{"a": 1}}]', '[,{"a": 1}]'])
def test_no_list_is_an_error(spark, tmp_path, ranges, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(ValueError, match="not a JSON list"):
        json_array.items(spark, f"file://{tmp_path}/bad.json")


def test_ranges_are_read_apart(spark, tmp_path):
    """A file of some 8 MB is read by many tasks; an end that is missing is found."""
    path = tmp_path / "large.json"
    body = ",\n".join(json.dumps({"id": f"i{i}", "content": "Điều } " * 40}, ensure_ascii=False) for i in range(15_000))
    path.write_text(f"[{body}]", encoding="utf-8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 512 << 10)
    try:
        assert spark.read.option("lineSep", "}").text(f"file://{path}").rdd.getNumPartitions() > 8
        rows = corpus.read_corpus(spark, f"file://{path}")
        assert rows.count() == 15_000 == rows.select("id").distinct().count()
        path.write_text(f"[{body}", encoding="utf-8")
        with pytest.raises(ValueError, match="JSON list"):
            corpus.read_corpus(spark, f"file://{path}")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
