import json
import os

import pytest

from kindred import defaults as D
from kindred.sources import tables as IO


def lines(path):
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(os.path.join(path, name), encoding="utf-8") as file:
                yield from (json.loads(line) for line in file)


def test_json_lines_have_the_stated_fields(spark, tmp_path):
    path = str(tmp_path / "predictions")
    df = spark.createDataFrame([("u", "b", 3.5)], "user_id string, item_id string, stars double")
    IO.write_json(df, path)
    assert list(lines(path)) == [{"user_id": "u", "business_id": "b", "stars": 3.5}]
    assert IO.read_json(spark, path, D.PREDICTION).collect() == df.collect()


def test_entity_files(spark, tmp_path):
    (tmp_path / "user.json").write_text('{"user_id": "u", "name": "N", "friends": ["v", "w"], "extra": 1}\n')
    (tmp_path / "business.json").write_text('{"business_id": "b", "business_name": "B", "stars": 4, "review_count": 2}\n')
    user = IO.read_json(spark, str(tmp_path / "user.json"), D.USER).first()
    item = IO.read_json(spark, str(tmp_path / "business.json"), D.BUSINESS).first()
    assert user["friends"] == ["v", "w"] and item["item_id"] == "b" and item["latitude"] is None


def test_average_map_of_one_line_and_of_many(spark, tmp_path):
    (tmp_path / "avg.json").write_text('{"u1": 3.5, "u2": 4.0}\n')
    read = IO.read_average_map(spark, str(tmp_path / "avg.json"), "user_id")
    assert sorted(map(tuple, read.collect())) == [("u1", 3.5), ("u2", 4.0)]
    averages = spark.createDataFrame([(k, k / 2) for k in range(50)], "user_id bigint, average_stars double")
    for per_line, expected in ((10_000, 1), (10, 5)):
        path = str(tmp_path / f"map{per_line}")
        IO.write_average_map(averages, "user_id", "average_stars", path, per_line)
        assert len(list(lines(path))) == expected
        assert IO.read_average_map(spark, path, "user_id").count() == 50


def test_profile_lines(spark, tmp_path):
    path = str(tmp_path / "profiles")
    table = spark.createDataFrame([("i", "x"), ("i", "y"), ("j", "z")], "item_id string, word string")
    IO.write_profiles(table, "item_id", "word", path)
    assert sorted(map(str, lines(path))) == ["{'i': ['x', 'y']}", "{'j': ['z']}"]
    assert sorted(map(tuple, IO.read_profiles(spark, path, "item_id", "word").collect())) == sorted(map(tuple, table.collect()))


def test_stopwords(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("the \nand\n")
    assert [r["word"] for r in IO.read_stopwords(spark, str(tmp_path / "stop.txt")).collect()] == ["the", "and"]


def test_views(spark):
    IO.register_views(some_users=spark.range(3))
    assert spark.sql("SELECT count(*) FROM some_users").first()[0] == 3


ODD_KEYS = ["plain", "a,b", "a, \"b\": 3,c", "ends,", ",starts", "back\\", "x,\\", "{brace", "tail}", "colon: 5", "line\nfeed", "\u00e9lan", "", "many,commas,in,one,key", ", \"", "\\\",\\"]


@pytest.mark.parametrize(("separators", "block"), [((", ", ": "), 1 << 20), ((",", ":"), 1 << 20), ((", ", ": "), 64), ((",", ":"), 23)])
def test_maps_of_any_keys_read_in_any_splits(spark, tmp_path, separators, block):
    """Commas, quotes, colons and braces in ids, lines of one and many entries, and splits inside all of them."""
    first = {k: i / 4 for i, k in enumerate(ODD_KEYS)}
    second = {f"u{k},{'x' * (k % 40)}" if k % 7 == 0 else f"u{k}": -1.5 * k for k in range(200)} | {"tiny": 1e-7, "large": 2.5e11}
    text = "\n".join(json.dumps(m, separators=separators, ensure_ascii=False) for m in (first, {}, second, {"one": 1.0})) + "\n"
    (tmp_path / "map.json").write_text(text, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = IO.read_average_map(spark, str(tmp_path / "map.json"), "user_id")
        got = read.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(first) + len(second) + 1
    assert {r["user_id"]: r["average_stars"] for r in got} == first | second | {"one": 1.0}


def test_one_long_line_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({f"user {k}": k / 8 for k in range(200_000)}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
    try:
        raw = spark.read.option("lineSep", ",").text(str(tmp_path / "map.json"))
        assert raw.rdd.getNumPartitions() > 8
        sums = IO.read_average_map(spark, str(tmp_path / "map.json"), "user_id").selectExpr("count(*)", "count(DISTINCT user_id)", "sum(average_stars)").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(sums) == (200_000, 200_000, sum(range(200_000)) / 8)
