"""Bursts of changes, the last good state of each key, and a server that follows versions."""

import io
import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_contract import sample

from tokenloom import cli, server
from tokenloom.plans import contract as contracts
from tokenloom.streaming.reload import bursts, reloads
from tokenloom.streaming.snapshot import Snapshot
from tokenloom.streaming.watch import Watcher, publish, versions_of

START = datetime(2024, 5, 2)
SCHEMA = "project string, version long, body string"


def plain_bursts(rows, gap):
    out = []
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key and t is not None)
        for t in times:
            if out and out[-1][0] == key and t - out[-1][2] <= gap:
                out[-1][2:4] = [t, out[-1][3] + 1]
            else:
                out.append([key, t, t, 1])
    return sorted((str(k), a, b, n, b + gap) for k, a, b, n in out)


def test_bursts(spark):
    rng = random.Random(1)
    ms = lambda n: timedelta(milliseconds=n)
    rows = [(rng.choice(["a", "b", None]), START + ms(rng.randrange(3000))) for _ in range(150)] + [("c", START), ("c", START + ms(51)), ("d", START), ("d", START + ms(50)), ("d", START), ("e", None)]
    got = bursts(spark.createDataFrame(rows, "k string, t timestamp"), "k", "t", "50 milliseconds").collect()
    want = plain_bursts(rows, ms(50))
    assert sorted((str(r.k), r.first_change, r.last_change, r.n_changes, r.reload_at) for r in got) == want
    assert sum(k == "c" for k, *_ in want) == 2 and sum(k == "d" for k, *_ in want) == 1
    assert bursts(spark.createDataFrame([], "k string, t timestamp"), "k", "t", "1 second").count() == 0


def test_three_writes_within_the_gap_are_one_reload_of_a_stream(spark, tmp_path):
    schema = "file string, at timestamp"

    def write(name, *seconds):
        spark.createDataFrame([("c.json", START + timedelta(seconds=s)) for s in seconds], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        reloads(stream, "file", "at", "1 second").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted((r.first_change, r.n_changes) for r in spark.read.schema("file string, first_change timestamp, last_change timestamp, n_changes long, reload_at timestamp").parquet(str(tmp_path / "out")).collect())

    write("1", 0.0)
    write("2", 0.4, 0.9)
    assert run() == []  # the burst may go on
    write("3", 60)
    run()
    assert run() == [(START, 3)]
    write("4", 120)
    run()
    assert run() == [(START, 3), (START + timedelta(seconds=60), 1)]


def plain_latest(rows):
    out = {}
    for k, v, body in rows:
        if k is not None and body != "{" and v > out.get(k, (-1, ""))[0]:
            out[k] = (v, body)
    return sorted((k, *x) for k, x in out.items())


def read(table):
    return sorted(tuple(r) for r in table.read().collect())


@pytest.mark.parametrize("batches", [1, 4])
def test_any_split_into_batches_gives_the_same_table(spark, tmp_path, batches):
    rng = random.Random(batches)
    rows = [(rng.choice(["a", "b", "c", None, *"defgh"]), v, rng.choice(["{", f'{{"v":{v}}}'])) for v in range(80)]
    rng.shuffle(rows)
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("parsed", F.try_parse_json("body"))
    table = Snapshot(spark, f"file://{tmp_path}/table", SCHEMA, 3)
    assert read(table) == []
    table.follow(stream, "parsed", str(tmp_path / "cp"), once=True).awaitTermination()
    assert read(table) == plain_latest(rows) and len(table.heads.numbers()) == min(3, batches)
    # a restart goes on where the checkpoint says
    more = [("a", 100, '{"v":100}'), ("new", 1, "{}"), ("b", 101, "{")]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = Snapshot(spark, f"file://{tmp_path}/table", SCHEMA, 3)
    again.follow(stream, "parsed", str(tmp_path / "cp"), once=True).awaitTermination()
    assert read(again) == plain_latest(rows + more)


def test_a_batch_that_comes_again(spark, tmp_path):
    table = Snapshot(spark, f"file://{tmp_path}/t", SCHEMA, 2)
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA).withColumn("ok", F.when(F.col("body") != "{", F.lit(True)))
    one, two = batch(("a", 1, "x"), ("b", 5, "y")), batch(("a", 2, "z"), ("c", 1, "{"))
    table.upsert(one, 0)
    table.heads.publish, keep = lambda *_: (_ for _ in ()).throw(OSError("crash")), table.heads.publish
    with pytest.raises(OSError, match="crash"):
        table.upsert(two, 1)
    assert read(table) == [("a", 1, "x"), ("b", 5, "y")]  # half a batch shows nothing
    table.heads.publish = keep
    for _ in range(2):
        table.upsert(two, 1)
        assert read(table) == [("a", 2, "z"), ("b", 5, "y")]
    for n in range(2, 7):
        table.upsert(batch(("a", n + 1, f"n{n}")), n)
        table.upsert(one, 0)
    assert read(table) == [("a", 7, "n6"), ("b", 5, "y")]
    assert table.heads.numbers() == [4, 5, 6] and len(table.heads.names("states")) <= 4
    table.upsert(batch(), 7)
    assert read(table) == [("a", 7, "n6"), ("b", 5, "y")]


def until(true, seconds=40):
    end = time.time() + seconds
    while not true() and time.time() < end:
        time.sleep(0.1)
    return true()


def test_server_follows_versions(spark, tmp_path):
    path = str(tmp_path / "c.json")
    told, swaps = io.StringIO(), []
    (tmp_path / "c.json").write_text("{ broken")
    s = server.Server(path, told, watched=True)
    assert "is not JSON" in told.getvalue()
    root = lambda: json.loads(s.answer(json.dumps({"id": 1, "method": "tools/call", "params": {"name": "get_design_context", "arguments": {}}}))["result"]["content"][0]["text"])["sourceRoot"]
    folder = versions_of(path)
    publish(sample(root="/v1"), folder)
    watcher = Watcher(spark, folder, f"{folder}/.followed", lambda c: (swaps.append(c["sourceRoot"]), s.take(c)), "100 milliseconds", quiet=1.0).start()
    try:
        assert root() == "/v1" and "Mismatch" in told.getvalue()
        for k in (2, 3, 4):  # in quick succession: one change
            publish(sample(root=f"/v{k}"), folder)
        assert until(lambda: root() == "/v4") and swaps == ["/v1", "/v4"]
        contracts.save(sample(root="/unseen"), path)  # the file itself is not looked at any more
        (tmp_path / "c.json.versions" / "v000000000005.json").write_text("{ broken")
        (tmp_path / "c.json.versions" / "v000000000006.json").write_text("[1]")
        time.sleep(3)
        assert root() == "/v4"
        publish(sample(root=str(tmp_path)), folder)
        assert until(lambda: root() == str(tmp_path)) and swaps == ["/v1", "/v4", str(tmp_path)]
        assert watcher.version == "v000000000007.json" and told.getvalue().count("Mismatch") == 2
    finally:
        watcher.stop()
    # a server that starts again has the newest good version at once, whatever the checkpoint has seen
    (tmp_path / "c.json.versions" / "v000000000008.json").write_text("{ broken")
    again = Watcher(spark, folder, f"{folder}/.followed", swaps.append).start(once=True)
    again.finish()
    assert again.contract["sourceRoot"] == str(tmp_path) and again.version == "v000000000007.json"


def test_serve(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "a.css").write_text(":root { --bg: #fff; }")
    (tmp_path / "c.json").write_text(json.dumps({"sources": {"codebase": {"root": str(tmp_path), "patterns": ["*.css"]}}, "output": {"path": str(tmp_path / "out.json")}}))
    monkeypatch.setattr(cli, "get_spark", lambda *_: spark)
    assert cli.main(["build", str(tmp_path / "c.json")]) == 0
    capsys.readouterr()
    monkeypatch.setattr("sys.stdin", io.StringIO('{"id":1,"method":"tools/call","params":{"name":"get_token","arguments":{"name":"bg"}}}\n'))
    assert cli.main(["serve", str(tmp_path / "c.json")]) == 0
    assert json.loads(json.loads(capsys.readouterr().out)["result"]["content"][0]["text"])["value"] == "#fff"


def test_old_versions_go(tmp_path):
    for k in range(23):
        publish({"k": k}, str(tmp_path / "v"))
    names = sorted(p.name for p in (tmp_path / "v").iterdir())
    assert len(names) == 20 and names[-1] == "v000000000023.json"
