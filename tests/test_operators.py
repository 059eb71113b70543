import struct
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.operators import codebook, commands, dialog, geometry, jsonrows, ledger, pages, pricing, store
from textloom.plans import pipeline
from textloom.sources import tables
from textloom.streaming import sessions


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def by_doc(df, *names):
    return {r.doc_id: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def test_rows_of_arrays_and_lines(spark):
    d = docs(spark, '[{"b":1,"a":2.0},{"c":null}]', '{"a":1}\n\n{"b":"x"}\n', '[1,2]', '{"a":1}', '{"a":1}\n5', "text", '[{"a":1}]')
    assert by_doc(jsonrows.parsed_rows(d).groupBy("doc_id").agg(F.array_sort(F.collect_list("row")).alias("rows")), "rows") == {0: ['{"a":2,"b":1}', '{"c":null}'], 1: ['{"a":1}', '{"b":"x"}']}


def test_crush_keeps_ends_and_errors(spark):
    rows = [f'{{"id":{i},"status":"{"error" if i == 20 else "failed" if i == 45 else "ok"}"}}' for i in range(60)]
    got = jsonrows.crushed(docs(spark, "\n".join(rows), "\n".join(rows[:29]), "\n".join([rows[0]] * 40))).collect()
    kept = {r.doc_id: r for r in got}
    assert kept[0].kept == 17 and kept[0].rows == 60 and kept[0].text.split("\n") == [*rows[:10], rows[20], rows[45], *rows[55:]]
    assert 1 not in kept and kept[2].kept == 1


def test_table_round_trip(spark):
    text = '\n'.join(f'{{"name":"n{i}\\t","value":{i}.0,"long_key_name":[1,{{"z":1,"a":null}}]{"" if i % 2 else ",$extra$:true".replace("$", chr(34))}}}' for i in range(6))
    table = jsonrows.table_encoded(docs(spark, text, '{"a":1}\n{"b":2}'))
    assert by_doc(table, "rows", "cols") == {0: (6, 4)}
    assert table.first().text.startswith('·cols·\t"extra"\t"long_key_name"\t"name"\t"value"\ntrue\t[1,{"a":null,"z":1}]\t"n0\\t"\t0')
    back = by_doc(jsonrows.table_decoded(table), "text")[0].split("\n")
    assert back[1] == '{"long_key_name":[1,{"a":null,"z":1}],"name":"n1\\t","value":1}'
    assert by_doc(jsonrows.table_decoded(docs(spark, "no table", '·cols·\tbad\nx')), "text") == {0: None, 1: None}


@pytest.mark.parametrize("decoded", [False, True])
def test_rows_do_not_carry_their_text(spark, decoded):
    table = jsonrows.table_encoded(docs(spark, '{"a":1}\n{"a":2}'))
    plan = [(jsonrows.table_decoded(table) if decoded else table)._jdf.queryExecution().optimizedPlan()]
    carried = []
    while plan:
        node = plan.pop()
        plan += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Generate" and "row_no" in node.generatorOutput().mkString(","):
            carried.append(node.requiredChildOutput().mkString(","))
    assert len(carried) == 1 and "before#" in carried[0] and "text#" not in carried[0]


def test_rows_are_parsed_once(spark):
    mixed = '{"a":1.0,"b":"x y"}\n{"a":[{"z":null,"c":"\u2028"}],"bb":12345678901234567890123}'
    table = jsonrows.table_encoded(docs(spark, mixed, '["{a", {"a":1}]', '{"a":1}\n"{"', '{"a":1}\nnull'))
    back = jsonrows.table_decoded(table)
    # Encoding: the whole text, or its lines; decoding: names and cells.
    assert back._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 4
    assert by_doc(jsonrows.parsed_rows(docs(spark, mixed, '["{a", {"a":1}]', '{"a":1}\n"{"')), "row_no") == {0: 1}
    long = "\n".join(mixed.split("\n") * 9)
    assert by_doc(jsonrows.table_decoded(jsonrows.table_encoded(docs(spark, long))), "text")[0].split("\n")[:2] == ['{"a":1,"b":"x y"}', '{"a":[{"c":"\u2028","z":null}],"bb":12345678901234567890123}']
    cells = {"0": True, "-12": True, '"a b"': True, "01": False, "-": False, "1x": False, "true": True}
    told = by_doc(jsonrows.table_decoded(docs(spark, *[f'{jsonrows.COLUMNS}\t"a"\n{c}' for c in cells])), "text")
    assert [told[i] is not None for i in range(len(cells))] == list(cells.values())


def test_codebook_round_trip(spark):
    text = " ".join(["/usr/lib/python3/site", "/usr/lib/python3/dist", "averylongidentifier"] * 6) + " § x"
    r = codebook.applied(docs(spark, text, "short text")).orderBy("doc_id").collect()
    assert r[0].entries >= 2 and len(r[0].encoded) < len(text) and "§=" not in r[0].encoded
    assert codebook.decode(r[0].encoded, [(b.sigil, b.value) for b in r[0].book]) == text
    assert r[1].encoded == "short text" and r[1].entries == 0


@pytest.mark.parametrize("font", ["normal", "tiny"])
def test_closed_geometry_is_the_walk(spark, font):
    g = geometry.grid(font)
    sizes = [0, 1, g.cols, g.cols + 1, g.cols * g.full, g.cols * g.full + 1, g.cols * g.full + 223, g.cols * g.full + 224, g.cols * g.full + 272, g.cols * (g.full + 1), g.cols * g.full * 2 + 5]
    d = docs(spark, *["x" * n for n in sizes], "a\n   b\n\tc\n\n\n\n\nd  \n" + " " * 61 + "e\n" + " " * 62 + "f")
    cols = ("pages", "pixels", "tokens")
    assert by_doc(geometry.estimate(d, font), *cols) == by_doc(geometry.walked(d, font), *cols)


def test_pack_is_undone():
    lines = ["\ta", "  two", "   three", " " * 20 + "x", " " * 61 + "y", "plain ↵ → ⇥"]
    g = geometry.grid("normal")
    packed = "".join(x for page in geometry.laid_out("\n".join(lines), g) for x in page)
    assert geometry.unpacked(packed) == "\n".join(lines)


def test_pages_only_grow_at_the_end():
    g = geometry.grid("normal")
    text = "\n".join(f"line {i} " + "x" * 90 for i in range(900))
    a, b = geometry.laid_out(text, g), geometry.laid_out(text + "\nmore" * 400, g)
    assert len(a) > 2 and a[:-1] == b[: len(a) - 1]
    assert geometry.page_sizes([["宽" * 3]], g) == [(8 + 6 * 5, 16)]


def test_png(spark):
    r = pages.rendered(docs(spark, "hello\nworld")).first()
    assert r.png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", r.png[16:24]) == (r.width, r.height)
    at = r.png.index(b"IDAT")
    raw = zlib.decompress(r.png[at + 4 : at + 4 + struct.unpack(">I", r.png[at - 4 : at])[0]])
    assert len(raw) == r.height * (r.width + 1)


def test_costs_and_routes(spark):
    rows = [("claude-opus-4", False, 1000, 400, "PIPELINE", 60, 1000), ("claude-opus-4", True, 1000, 400, "TEXT", -400, 80), ("opus", True, 1000, 50, "PIPELINE", 38, 80), (None, False, 0, 10, "TEXT", 0, 0)]
    d = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, model string, cached boolean, text_tokens long, image_tokens long")
    got = pricing.cost_verdict(d).orderBy("i").collect()
    assert [(r.cheaper, r.cost_saved_pct, r.breakeven) for r in got] == [r[4:] for r in rows]
    assert float(got[0].text_usd) == pytest.approx(0.015)
    levels = spark.createDataFrame([(3733, 896), (4000, 280), (30000, 1000), (800, 100), (0, 0), (16000, 1000), (20100, 1000)], "a long, b long")
    level = pricing.fidelity_level(F.col("a"), F.col("b"), F.lit(False), F.lit(False))
    assert [r[0] for r in levels.select(level).collect()] == ["high", "degraded", "unreliable", "high", "high", "degraded", "unreliable"]
    cols = "raw_tokens long, image_tokens long, side_tokens long, space_tokens long, n_credentials int, dense boolean, model string, cheaper string"
    cases = [(1000, 200, 10, 1000, 0, False, "opus", None), (1000, 200, 10, 900, 1, False, "opus", None), (1000, 200, 10, 1000, 0, True, None, None), (1000, 200, 0, 1000, 0, False, "x/CLAUDE-haiku-4-5", None), (1000, 200, 0, 1000, 0, False, None, "TEXT"), (1000, 20, 0, 1000, 0, False, None, None), (1000, 990, 50, 1000, 0, False, None, None)]
    got = pricing.route(spark.createDataFrame(cases, cols).coalesce(1)).collect()
    assert [(r.pick, r.tokens, r.reason) for r in got] == [("image", 210, "image"), ("text", 900, "credentials"), ("raw", 1000, "dense"), ("raw", 1000, "weak reader"), ("raw", 1000, "cost"), ("raw", 1000, "past the cliff"), ("raw", 1000, "text is cheaper")]


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/stash"
    d = docs(spark, "one\ntwo\nthree", "other", "other")
    store.write(d, path)
    store.write(d, path)
    assert spark.read.parquet(path).count() == 2
    id = store.stashed(docs(spark, "other")).first().id
    assert store.read(spark, path, id).first().text == "other"
    with pytest.raises(ValueError):
        store.read(spark, path, "../etc/passwd")
    one = docs(spark, "one\ntwo\nthree")
    assert [store.fetch_lines(one, a, b).first().text for a, b in ((2, 3), (0, 0), (3, 99), (9, 9))] == ["two\nthree", "one", "three", "three"]
    with pytest.raises(ValueError):
        store.fetch_lines(one, 3, 2)


def test_find_windows_merge(spark):
    text = "\n".join(["disk full", "diskette", "x", "y", "the disk", "z", "w", "v", "disk full now"])
    r = store.fetch_find(docs(spark, text, "nothing"), "Disk full disk").orderBy("doc_id").collect()
    assert r[0].text.startswith("·find· L1-9 score 6\n") and r[0].text.endswith("·find· 2 words · 4 lines matched · 1 windows")
    assert r[1].text == "·find· 2 words · 0 lines matched"


def test_verify(spark):
    d = docs(spark, "a\nid 7f3a9c21 x", "7f3a9c12", "7f3a9c20 7f3a9c2f", "none", "7f3a9c")
    got = {r.doc_id: (r.status, r.line, r.found, r.candidates) for r in store.verified(d, "7f3a9c21").collect()}
    assert got == {0: ("exact", 2, "7f3a9c21", []), 1: ("corrected", 1, "7f3a9c12", []), 2: ("ambiguous", None, None, ["7f3a9c20", "7f3a9c2f"]), 3: ("absent", None, None, []), 4: ("absent", None, None, [])}
    assert store.verified(d, "7f3").where("status = 'corrected'").count() == 0


def test_commands_carriage_returns(spark):
    rows = [(1, ["make"], 0, "a\r\nb\r"), (2, ["x"], 0, ""), (3, [], 0, "text"), (4, ["cargo.exe", "test"], 0, "   Compiling x\nplain")]
    got = by_doc(commands.crushed(spark.createDataFrame(rows, "doc_id long, cmd array<string>, exit int, text string")), "text", "rule")
    assert got == {1: ("ok", "generic"), 2: ("", None), 3: ("text", None), 4: ("plain", "cargo")}
    both = commands.captured(spark.createDataFrame([("o", "e"), ("o", "")], "stdout string, stderr string"))
    assert sorted(r.text for r in both.collect()) == ["o", "o\n--- stderr ---\ne"]


BREAKS = [("ab", "ab", None), ("ab", "abc", None), ("abc", "axc", (1, "modified")), ("abc", "axbc", (1, "added")), ("abc", "ac", (1, "evicted")), ("abc", "acb", (1, "reordered")), ("abc", "ab", (2, "evicted"))]


def test_breaks(spark):
    rows = [(i, list(p), list(c)) for i, (p, c, _) in enumerate(BREAKS)]
    got = spark.createDataFrame(rows, "i int, p array<string>, c array<string>").select("i", dialog.break_of(F.col("p"), F.col("c")).alias("b")).orderBy("i").collect()
    assert [tuple(r.b) if r.b else None for r in got] == [w for _, _, w in BREAKS]
    assert [sessions.attribute_break(list(p), list(c)) for p, c, _ in BREAKS] == [w for _, _, w in BREAKS]


def test_stream_equals_batch(spark, tmp_path):
    turns = spark.createDataFrame([(c, t, "user", f"text {c} {t if t % 3 else 0}") for c in range(3) for t in range(5)], "conv_id long, turn long, role string, text string")
    reqs = dialog.requests(turns).withColumn("saw_cache", F.col("req") == 1)
    reqs = reqs.withColumn("blocks", F.when(F.col("req") == 3, F.slice("blocks", 2, 9)).otherwise(F.col("blocks")))
    reqs.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(reqs.schema).parquet(f"{tmp_path}/in")
    q = sessions.sessions(stream).writeStream.format("memory").queryName("sessions_out").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.conv_id, r.req): (r.break_index, r.break_kind) for r in spark.table("sessions_out").collect() if r.break_kind}
    assert got == {(r.conv_id, r.req): (r["index"], r.kind) for r in dialog.cache_breaks(reqs).collect()} and got
    caching = {(r.conv_id, r.req): r.caching for r in spark.table("sessions_out").collect()}
    assert all(v == (req > 1) for (_, req), v in caching.items())


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "an error"), ("2024-01-01 00:20:00", "fine"), ("2024-01-01 01:05:00", "fine")], "ts string, line string").select(F.to_timestamp("ts").alias("ts"), "line").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, line string").parquet(f"{tmp_path}/in")
    q = sessions.line_counts(stream, "error").writeStream.format("memory").queryName("counts_out").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.n_important) for r in spark.table("counts_out").collect()) == [(1, 0), (2, 1)]


def test_event_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"compressed":true,"orig_chars":100,"image_count":2,"baseline_tokens":1000,"input_tokens":400,"saved_tokens_cache_aware":-50,"output_tokens":100}\n\nnot json\n{"cacheBreak":{"index":1,"kind":"added","rebilled":7},"toolTax":{"unused":["a"],"tokens":9},"volatileSystem":true,"input_tokens":-4}\n')
    r = ledger.totals(tables.read_events(spark, f"{tmp_path}/log.jsonl")).first()
    assert (r.requests, r.compressed, r.imaged_chars, r.images, r.baseline, r.actual, r.output) == (2, 1, 100, 2, 1000, 400, 100)
    assert (r.breaks, r.rebilled, r.last_break, r.taxed, r.tax_tokens, r.volatile) == (1, 7, "added", 1, 9, 1)
    assert (r.saved_tenths, r.saved_aware_tenths, r.output_tenths) == (600, -143, 200)


def test_texts_behind_the_gate(spark, tmp_path):
    for name in ("a.log", ".env", "b.log"):
        (tmp_path / name).write_text(f"text of {name}")
    assert tables.read_texts(spark, f"{tmp_path}/a.log", f"{tmp_path}/.env", f"{tmp_path}/b.log").count() == 2


def test_stages_and_estimate(spark):
    rows = "\n".join(f'{{"id":{i},"status":"{"error" if i == 20 else "ok"}","path":"/var/lib/service/data"}}' for i in range(60))
    d = docs(spark, rows, "plain  words   here  \n\n\n\nend")
    r = pipeline.staged(d, 1, crush=True, table=True, codebook=True).orderBy("doc_id").collect()
    assert (r[0].kept, r[0].rows, r[0].cols) == (16, 60, 3) and "·cols·" in r[0].compressed and "·crushed· kept 16 of 60 rows" in r[0].compressed
    assert r[1].compressed == "plain  words   here\n\nend" and r[1].rows == 0
    e = by_doc(pipeline.estimated(d, model="gpt-5"), "verdict", "pick", "n_credentials")
    assert e[1][2] == 0 and e[1][1] in ("raw", "text", "image")
    rec = {x.doc_id: x for x in pipeline.recommended(d).collect()}
    assert rec[0].crush_rows == 60 and rec[0].crush_kept == 16 and rec[1].crush_rows is None and rec[1].transform == "whitespace"


def test_advice_makes_its_texts_once(spark):
    d = docs(spark, "advice on one text", "and another")
    pipeline.recommended(d)
    assert d.select("doc_id", "text").storageLevel.useMemory
    spark.catalog.clearCache()


def test_advice_holds_no_parsed_rows_or_coded_texts(spark):
    plan = pipeline.recommended(docs(spark, "advice on long texts", "one more"))._jdf.queryExecution().toString()
    spark.catalog.clearCache()
    assert "InMemoryRelation" in plan and "row_no" in plan
    # Cells aren't gathered, and no text comes back from Python.
    assert "cells" not in plan and "encoded" not in plan


def test_tables_where_rows_are_parsed(spark):
    mixed = '{"bb":1.0,"a":"x\\ty"}\n{"a":[{"z":null,"c":"\u2028"}],"bb":12345678901234567890123}'
    d = docs(spark, "\n".join(mixed.split("\n") * 20), " \n".join(mixed.split("\n") * 3), "[" + ",".join(mixed.split("\n") * 5) + "]", '{"a":1}\n{"b":2}', '{"a":1}\n"{"', '{"a":1}\nnull', "{}\n{}", "[]", "no rows", "", None)
    got, want = ({r.doc_id: tuple(r) for r in f(d).collect()} for f in (jsonrows.tables_of, jsonrows.table_encoded))
    assert got == want and sorted(got) == [0, 1, 2]


def test_sizes_without_rows():
    both = [geometry.grid("normal"), geometry.grid("tiny")]
    for text in ("", " ", "\n", "a" * 312, "a" * 313, "    b\n\tc \n\n\n\n\n↵→⇥", "x y\n" * 9000, "宽" * 400, "é" * 28100, *("a" * n for n in range(27980, 28100))):
        a, b = ([(w, h) for w, h in geometry.page_sizes(geometry.laid_out(text, g), g)] for g in both)
        tokens = lambda dims: sum(-(-w // geometry.PATCH) * -(-h // geometry.PATCH) for w, h in dims)
        assert geometry.font_sizes(text) == (len(a), tokens(a), tokens(b)), text[:20]


def test_risk_counts_utf16_units(spark):
    from textloom.operators import needles

    tokens = ["x1y2z3😀w4", "x1y2z3éw4", "a😀b1c", "deadbeef", "12345678", "123456789"]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", needles.at_risk(F.col("t")).alias("risk")).collect()
    assert {r.t: r.risk for r in got} == {t: needles.token_at_risk(t) for t in tokens}
    assert needles.token_at_risk("x1y2z3😀w4")
