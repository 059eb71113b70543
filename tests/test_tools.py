import pytest
from pyspark.sql import functions as F

from textloom import tools
from textloom.functions import json as J


def test_arguments(spark):
    with pytest.raises(ValueError, match="unknown tool"):
        tools.call(spark, "x", {})
    with pytest.raises(ValueError, match="missing: text"):
        tools.call(spark, "distill", {})
    with pytest.raises(ValueError, match="unknown: y"):
        tools.call(spark, "distill", {"text": "", "y": 1})
    with pytest.raises(ValueError, match="one of"):
        tools.call(spark, "render", {"text": "", "font": "huge"})
    assert all(t.schema()["additionalProperties"] is False for t in tools.TOOLS.values())
    assert tools.furniture_tokens(spark) > 100


def test_store_tools(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    text = "start\n" + "\n".join(f"beat {i}" for i in range(30)) + "\napi_key=abcdefgh1234\nend"
    put = tools.call(spark, "stash", {"text": text, "path": path})
    assert put["text"].startswith(f"stashed {put['id']} · ") and "first: start\nlast: end" in put["text"]
    get = lambda **k: tools.call(spark, "fetch", {"path": path, "id": put["id"]} | k)
    assert get(lines="1-2")["text"] == "start\nbeat 0"
    assert get(lines="32-32") == {"text": "api_key=[redacted:named-secret]", "n_redacted": 1}
    assert get(lines="32-32", redact=False)["text"] == "api_key=abcdefgh1234"
    assert get(find="end")["text"].startswith("·find· L31-33 score 3")
    assert "… " in get(query="end")["text"]
    for bad in ({}, {"lines": "1-2", "find": "x"}, {"lines": "x"}, {"lines": "3-1"}):
        with pytest.raises(ValueError):
            get(**bad)
    assert tools.call(spark, "verify", {"path": path, "id": put["id"], "value": "beat 7"})["line"] == 9


def test_text_tools(spark):
    assert tools.call(spark, "distill", {"text": "a b\n" * 9})["collapsed_runs"] == 1
    assert tools.call(spark, "compress", {"text": "a  \n\n\n\nb"})["compressed"] == "a\n\nb"
    assert "refused" in tools.call(spark, "render", {"text": "AKIA" + "A1" * 8})
    drawn = tools.call(spark, "render", {"text": "hello sha deadbeefcafe99"})
    assert drawn["n_pages"] == 1 and drawn["pages"][0][:4] == b"\x89PNG" and "deadbeefcafe99" in drawn["sidecar"]


def test_json_fields(spark):
    d = spark.createDataFrame([('{"b": 1.0, "a": "x", "c": true}',), ("nope",), ('{"b": -1, "a": 2, "c": "true"}',)], "t string")
    t = F.col("t")
    got = d.select(J.canonical(t), J.string_field(t, "a"), J.count_field(t, "b"), J.bool_field(t, "c")).collect()
    assert [tuple(r) for r in got] == [('{"a":"x","b":1,"c":true}', "x", None, True), (None, None, None, None), ('{"a":2,"b":-1,"c":"true"}', None, None, None)]
