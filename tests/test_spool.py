"""The spool's drain: files go once they are read, stale and torn ones give nothing, a restart gives none twice."""

import json

from pyspark.sql import functions as F

from chronolens.streaming import spool

NOW = 1_705_309_200_000


def put(folder, name, command, ts=NOW - 1_000, version=1):
    (folder / f"{name}.cmd").write_text(f"v={version}\nts={ts}\nexit=0\nms=5\nshell=zsh\ncwd=/w/token=abcdefgh\ncmd={command}\n")


def test_drain(spark, tmp_path):
    folder = tmp_path / "spool"
    folder.mkdir()

    def run(recording=True):
        stream = spool.commands(spool.files(spark, str(folder), a_batch=2), F.lit(NOW), F.lit(recording))
        q = stream.writeStream.format("json").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        return q

    got = lambda: sorted(r["command"] for f in (tmp_path / "out").glob("part-*.json") for r in map(json.loads, f.read_text().splitlines()))
    put(folder, "a", "make")
    put(folder, "b", "export API_TOKEN=hunter2222")
    put(folder, "old", "ls", ts=NOW - 7 * 3_600_000)
    put(folder, "other", "ls", version=2)
    (folder / "torn.cmd").write_text("v=1\nts=")
    (folder / "note.txt").write_text("not a command")
    q = run()
    assert got() == ["export API_TOKEN=[REDACTED:env_assignment]", "make"] and spool.beat(q)[1] >= 1
    put(folder, "c", "git status")
    run()
    assert got() == ["export API_TOKEN=[REDACTED:env_assignment]", "git status", "make"]
    put(folder, "d", "while paused")
    run(recording=False)
    run()
    assert got() == ["export API_TOKEN=[REDACTED:env_assignment]", "git status", "make"]
    put(folder, "e", "last")
    run()
    left = {p.name for p in folder.iterdir()}
    assert left <= {"note.txt", "e.cmd"} and "note.txt" in left
    rows = [json.loads(x) for f in (tmp_path / "out").glob("part-*.json") for x in f.read_text().splitlines()]
    assert all("abcdefgh" not in r["cwd"] and r["redaction_ok"] for r in rows)
