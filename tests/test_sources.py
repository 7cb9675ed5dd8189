import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tidemark.sources import rows
from tidemark.sources.yson import YsonError, parse_record


def test_payloads(spark):
    cases = [b'{"title":"t","sev":null,"tags":["a",null]}', b'{"title":"t","se', b"", None, b"\xff\xfe", b"[1]", b'{"other":1}', b'{"title":5}']
    df = spark.createDataFrame([(bytearray(c) if c is not None else None,) for c in cases], "event binary")
    got = [r[0] and tuple(r[0]) for r in df.select(rows.decoded(F.col("event"))).collect()]
    assert got == [("t", None, ["a", None]), None, None, None, None, None, (None, None, None), ("5", None, None)]
    again = df.select(rows.encoded(rows.decoded(F.col("event")))).collect()
    assert bytes(again[0][0]) == cases[0] and again[1][0] is None


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([("hot", n) for n in range(500)] + [("a", 1), ("b", 2), (None, 3)], "k string, n int")
    rows.write_sharded(df, f"{tmp_path}/t", "k", 8)
    one = rows.read_shard(spark, f"{tmp_path}/t", "k", "hot", 8)
    assert one.count() == 500 and one.columns == ["k", "n"]
    assert spark.read.parquet(f"{tmp_path}/t").count() == df.count()
    assert "shard" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]


def test_dump_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": 1, "components": ["x"], "resource_manager_entity": {"type": "team", "slug": "s"}}) + "\n")
    assert rows.read_dump(spark, f"{tmp_path}/a.json").first().asDict()["components"] == ["x"]
    (tmp_path / "b.json").write_text('{"id": 1}\n{"id": 2, "ti')
    with pytest.raises(Py4JJavaError, match="MALFORMED|Malformed"):
        rows.read_dump(spark, f"{tmp_path}/b.json").collect()
    rows.read_dump(spark, f"{tmp_path}/a.json").write.parquet(f"{tmp_path}/p")
    assert rows.read_dump(spark, f"{tmp_path}/p", "parquet").first().id == 1


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('{a=1;"b c"=-2u;};', {"a": 1, "b c": -2}), ("[1;2.5;%true;#;word-x]", [1, 2.5, True, None, "word-x"]), ('<id=7>"x"', "x"), ("{}", {}), ("[];", []),
        (r'"q\"\\\x41\101\n\xd0\x96"', 'q"\\AA\nЖ'), ("{a={b=[{c=%false}]}}", {"a": {"b": [{"c": False}]}}), (" ", None), ("1e3", 1000.0), ("%nan", None),
    ],
)
def test_text_yson(text, value):
    assert parse_record(text) == value


@pytest.mark.parametrize("text", ["{a=1", "{a 1}", "[1 2]", "{a=1};{", '"open', "=", "{1=2}"])
def test_what_is_no_text_yson(text):
    with pytest.raises(YsonError):
        parse_record(text)


def test_dumps_of_joined_tables(spark, tmp_path):
    record = '{"events.id"=5;"events.title"="a \\"b\\"";"events.type"="work";"events.created_at"=17u;"events.components"=["x";"y"];"events.tickets"=%s;"events.is_deleted"=%%true;"services.resource_manager_entity"={type="team";slug="s"};extra=1};\n'
    (tmp_path / "a.yson").write_text(record % '"T-1"' + "\n" + record % '["T-1";"T-2"]' + record % "#")
    got = rows.read_dump(spark, f"{tmp_path}/a.yson", "yson")
    assert [r.tickets for r in got.collect()] == [["T-1"], ["T-1", "T-2"], None]
    one = got.first()
    assert (one.id, one.title, one.event_type, one.created_at, one.components, one.is_deleted, one.severity) == (5, 'a "b"', "work", 17, ["x", "y"], True, None)
    assert one.resource_manager_entity.slug == "s"
    (tmp_path / "b.yson").write_text(record % "#" + "{a=")
    with pytest.raises(Exception, match="cut off"):
        rows.read_dump(spark, f"{tmp_path}/b.yson", "yson").collect()
    (tmp_path / "c.json").write_text(json.dumps({"events.id": 6, "events.type": "t", "services.resource_manager_entity": {"type": "team"}}))
    plain = rows.read_dump(spark, f"{tmp_path}/c.json", prefix=True).first()
    assert (plain.id, plain.event_type, plain.resource_manager_entity.type) == (6, "t", "team")
