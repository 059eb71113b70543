import json
from math import inf

from textloom import tools
from textloom.operators import pricing
from textloom.plans import requests, runs
from textloom.plans.requests import Settings

BULK = "\n".join(f"beat {i % 7} of the long log that goes on and on" for i in range(400))
LOW = Settings(min_chars=1000, min_save=10)


def bodies(spark, *given):
    return spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b, ensure_ascii=False)) for i, b in enumerate(given)], "req_id long, body string")


def user(content):
    return {"role": "user", "content": content}


def test_strict_numbers():
    assert [requests.strict_number(x, 7) for x in ("3", "+.5e1", " 3 ", "0x1F", "1_000", "", None, "1e999", "nan", "-2.")] == [3, 5, 7, 7, 7, 7, 7, 7, 7, -2]
    assert [requests.strict_count(x, 100) for x in ("+7", "100", "101", "-1", "", "٣")] == [7, 100, None, None, None, None]
    own = Settings.of({"recent": " 3 ", "min_chars": "50", "ratio": "0.5", "cache": "off", "verbatim": "lazy", "font": ""})
    assert own == Settings(min_chars=50, ratio=0.5, cache=False, verbatim="lazy") and inf not in vars(own).values()


def test_rewritten(spark):
    pair = [{"type": "text", "text": BULK}, {"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": BULK}, {"type": "image", "source": 1}]}, {"type": "tool_result", "content": "short"}]
    own = [
        {"model": "m", "messages": [user(BULK), {"role": "assistant", "content": BULK}, user("now")]},
        {"messages": [user(pair), user("now")]},
        {"messages": [user([{"type": "text", "text": BULK, "cache_control": {"type": "ephemeral"}}]), user("now")]},
        {"messages": [user(BULK + "\napi_key=abcdefgh1234"), user("now")]},
        {"messages": [user("now"), user(BULK)]},
        {"system": [{"type": "text", "text": "s", "cache_control": {}}] * 4, "messages": [user(BULK), user("now")]},
        "no json", "[1]", '{"messages": [ ]}', '{"messages": [null, 3, {"role": "user"}, {"role": "user", "content": []}]}',
    ]
    got = {r.req_id: r for r in requests.rewritten(bodies(spark, *own), LOW).collect()}
    assert len(got) == len(own) and [i for i in got if got[i].changed] == [i for i in got if i in (0, 1, 5)]
    assert all(got[i].body == (b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(own) if i not in (0, 1, 5))
    first = json.loads(got[0].body)
    blocks = first["messages"][0]["content"]
    assert first["messages"][1:] == own[0]["messages"][1:] and blocks[0]["text"].startswith(f"[{len(BULK)} chars imaged in place as ")
    assert blocks[-1]["type"] == "image" and blocks[-1]["cache_control"] == {"type": "ephemeral"}
    second = json.loads(got[1].body)["messages"][0]["content"]
    inner = second[-2]["content"]
    assert second[0]["text"].startswith("[") and "byte-identical" in inner[0]["text"] and inner[1] == {"type": "image", "source": 1}
    assert second[-1] == {"type": "tool_result", "content": "short", "cache_control": {"type": "ephemeral"}}
    assert "cache_control" not in got[5].body.split('"messages"')[1]


def test_sessions(spark):
    own = bodies(spark, {"messages": [user(BULK), user("a")]}, {"messages": [user(BULK), user("b"), user("c")]}, {"messages": [user(BULK), user(BULK), user("c")]})
    replaced = requests.transformed(requests.blocks(own), LOW)
    rows = sorted(replaced.collect(), key=lambda r: (r.req_id, r.msg))
    sessions = spark.createDataFrame([(0, 1, 0, "opus", False), (1, 1, 1, "opus", True), (2, 2, 0, "opus", False)], "req_id long, conv_id long, req long, model string, saw_cache boolean")
    saved = {r.req_id: r.saved_tokens_cache_aware for r in requests.cache_aware(replaced, sessions).collect()}
    assert saved[0] == rows[0].saved and saved[1] == rows[1].saved and saved[2] == rows[2].saved + rows[3].saved
    seen = sessions.withColumn("saw_cache", sessions.req == 0)
    again = {r.req_id: r.saved_tokens_cache_aware for r in requests.cache_aware(replaced, seen).collect()}
    assert again[1] == round(rows[1].saved / 10) and again[0] == rows[0].saved
    totals = {r.req_id: r for r in requests.totals(replaced).collect()}
    assert totals[2].imaged_blocks == 2 and totals[2].image_count == rows[2].pages and totals[2].cached


def test_empty(spark):
    none = bodies(spark, "x").where("false")
    assert requests.rewritten(none).count() == 0 and requests.totals(requests.transformed(requests.blocks(none))).count() == 0


def test_runs(spark, tmp_path):
    noise = "\n".join(f"line {i} {'abcdefghij'[i % 10] * (i % 90)} {i * i}" for i in range(900))
    rows = [(1, ["pytest"], 0, "....x..\nsome output\n== 7 passed in 0.1s =="), (2, ["make"], None, "a b\n" * 5000), (3, ["make"], 2, noise), (4, ["x"], 0, "")]
    caps = spark.createDataFrame(rows, "doc_id long, cmd array<string>, exit int, text string")
    got = {r.doc_id: r for r in runs.ran(caps).collect()}
    assert got[1].text.startswith("[run] exit 0 · 3 -> 1 lines · ") and got[1].text.endswith(" · rule pytest\n== 7 passed in 0.1s ==") and got[1].id is None
    assert got[2].text.startswith("[run] exit 0 · 5001 -> ") and got[2].text.endswith(f"full output stashed: fetch {got[2].id} [--query re] [--lines a-b]")
    assert got[4].text.startswith("[run] exit 0 · 1 -> ") and got[4].id is None
    path = f"file://{tmp_path}/s"
    runs.keep(caps, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == sorted([got[2].id, got[3].id])


def test_rates(spark):
    own = pricing.rates('{"opus": {"input": 2, "family": "openai"}, "mine": {"cacheReadMult": 0.5}}')
    assert own["opus"] == ("2", "75", "0.1", "1.25", "tile512") and own["mine"] == ("3", "15", "0.5", "1.25", "patch") and own["gpt"] == pricing.RATES["gpt"]
    assert pricing.rates("{") == pricing.rates(None) == pricing.rates("[1]") == pricing.RATES
    rows = spark.createDataFrame([("opus", False, 1_000_000, 10)], "model string, cached boolean, text_tokens long, image_tokens long")
    assert float(pricing.cost_verdict(rows, own).first().text_usd) == 2 and float(pricing.cost_verdict(rows).first().text_usd) == 15


def test_tools(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    put = tools.call(spark, "stash", {"text": BULK + "\nid deadbeefcafe99", "path": path})
    get = lambda **k: tools.call(spark, "fetch", {"path": path, "id": put["id"]} | k)
    drawn = get(lines="1-401")
    assert drawn["pages"][0][:4] == b"\x89PNG" and "deadbeefcafe99" in drawn["sidecar"] and drawn["text"].startswith("[slice imaged as ")
    assert get(query="cafe[0-9]+")["text"].startswith("[query matched 1 of 401 lines]\n") and get(query="(")["text"].startswith("[query matched 0 of ")
    rows = json.dumps([{"name": f"n{i}", "kind": "same", "ok": True} for i in range(60)])
    thin = tools.call(spark, "distill", {"text": rows, "crush": True, "table": True})
    assert thin["crush"]["rows"] == 60 and "·crushed· kept " in thin["distilled"]
    told = tools.call(spark, "estimate", {"text": BULK, "cached": True, "model": "claude-opus-4"})
    assert told["cheaper"] in ("TEXT", "PIPELINE") and told["text_usd"] > 0 and "recommend" in told
