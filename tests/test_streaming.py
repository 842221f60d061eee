"""A change in a watched folder makes a new graph."""

import json
import os

from codeloom.streaming import watch


def run_once(spark, root, store, base):
    q = watch.watch(spark, root, store, f"{base}/checkpoint", once=True)
    q.awaitTermination(120)
    assert q.exception() is None


def test_new_file_makes_new_edge(spark, tmp_path):
    root, base = tmp_path / "src", str(tmp_path / "state")
    root.mkdir()
    (root / "a.ts").write_text("import './b';\n")
    (root / "note.txt").write_text("no")
    store, seen = watch.Snapshots(f"{base}/store"), []
    store.listeners.append(seen.append)
    assert store.current(spark) is None
    run_once(spark, str(root), store, base)
    assert store.current(spark).edges.first()["resolved"] is False
    (root / "b.ts").write_text("export const b = 1;\n")
    run_once(spark, str(root), store, base)
    graph = store.current(spark)
    assert graph.edges.first()["resolved"] is True and graph.header["cache_hits"] == 1 and seen == [1, 2]
    # after a restart the newest version is in force, and the next one follows it
    again = watch.Snapshots(f"{base}/store")
    assert again.current(spark).edges.first()["resolved"] is True and again.version == 2
    (root / "a.ts").write_text("import './b';\nimport './c';\n")
    run_once(spark, str(root), again, base)
    assert again.version == 3 and again.current(spark).edges.count() == 2
    (root / "b.ts").unlink()
    run_once(spark, str(root), again, base)
    assert [r["path"] for r in again.current(spark).nodes.collect()] == ["a.ts"] and again.current(spark).edges.filter("resolved").isEmpty()
    assert not os.path.exists(f"{base}/store/v2") and os.path.exists(f"{base}/store/v3")
    offset = max(int(n) for n in os.listdir(f"{base}/checkpoint/offsets") if n.isdigit())
    with open(f"{base}/checkpoint/offsets/{offset}") as f:
        assert json.loads(f.read().splitlines()[-1]) == {"seq": 4}  # whatever the number of files


def test_log_survives_restarts_and_stays_small(tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "COMPACT", 5)
    root = tmp_path / "src"
    root.mkdir()
    (root / ".gitignore").write_text("skip*.ts\n")
    (root / "skip1.ts").write_text("")
    seen, offset = {}, {"seq": 0}
    for i in range(30):
        (root / f"f{i % 7}.ts").write_text("x" * i)
        os.utime(root / f"f{i % 7}.ts", ns=(i * 10**9, i * 10**9))
        if i % 4 == 3:
            (root / f"f{(i - 2) % 7}.ts").unlink(missing_ok=True)
        reader = watch._ChangeReader({"path": str(root)})  # as after a restart
        rows, end = reader.read(offset)
        rows = list(rows)
        assert list(reader.readBetweenOffsets(offset, end)) == rows and set(end) == {"seq"}
        for path, mtime, op, *_ in rows:
            if op == "remove":
                del seen[path]
            else:
                seen[path] = mtime
        offset = end
        reader.commit(end)
        assert seen == {p.name: p.stat().st_mtime_ns for p in root.iterdir() if p.name.startswith("f")}
    assert len(os.listdir(root / ".codeloom/changes")) <= 7
