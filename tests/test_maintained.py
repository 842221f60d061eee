"""Graphs kept up to date by changes equal full builds, and read what the changes touch."""

import os
import random

from codeloom.operators.build import build
from codeloom.operators.resolve import resolve_asts
from codeloom.sources import files
from codeloom.streaming import maintained
from codeloom.streaming.maintained import Maintained


def text_of(rng, name, names):
    other = rng.choice(names)
    if name.endswith(".ts"):
        return f"import a from './{os.path.basename(other).split('.')[0]}';\nimport '../{other.split('.')[0]}';\nimport x from 'lib';\nexport function f{rng.randrange(5)}() {{}}\n"
    if name.endswith(".py"):
        return f"from .{os.path.basename(other).split('.')[0]} import x\nfrom . import y\nclass C{rng.randrange(5)}:\n    pass\n"
    return f"use crate::{rng.choice('abc')}::m{rng.randrange(4)}::T;\nmod m{rng.randrange(4)};\npub fn g() {{}}\n"


def same(spark, store, root):
    want, got = build(resolve_asts(files.scan(spark, root).drop("content_hash", "hit")), "function"), store.current(spark)
    for a, b in ((want.nodes, got.nodes), (want.edges, got.edges)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_random_changes(spark, tmp_path):
    rng = random.Random(1)
    root, names = str(tmp_path / "src"), []
    for d in ("a", "b", "c", "a/d"):
        os.makedirs(f"{root}/{d}")
        names += [f"{d}/m{i}.{e}" for i in range(4) for e in ("ts", "py", "rs")] + [f"{d}/lib.rs", f"{d}/__init__.py", f"{d}/index.ts"]

    def write(name):
        with open(f"{root}/{name}", "w") as f:
            f.write(text_of(rng, name, names))

    for name in rng.sample(names, 30):
        write(name)
    store = Maintained(str(tmp_path / "store"), bucket=6)
    assert store.current(spark) is None and store.refresh(spark, root)
    same(spark, store, root)
    for _ in range(3):
        for name in rng.sample(names, 6):
            if os.path.exists(f"{root}/{name}") and rng.random() < 0.5:
                os.remove(f"{root}/{name}")
            else:
                write(name)
        assert store.refresh(spark, root)
        same(spark, store, root)
    assert not store.refresh(spark, root)
    for name in names:
        if os.path.exists(f"{root}/{name}"):
            os.remove(f"{root}/{name}")
    assert store.refresh(spark, root) and store.current(spark).nodes.isEmpty()
    write("a/m0.ts")
    assert store.refresh(spark, root)
    same(spark, store, root)


def test_a_change_touches_its_buckets_alone(spark, tmp_path, monkeypatch):
    root = tmp_path / "src"
    for d in range(40):
        (root / f"d{d:02}").mkdir(parents=True)
        for i in range(5):
            (root / f"d{d:02}/m{i}.ts").write_text(f"import './m{(i + 1) % 5}';\nimport '../d{d:02}/m{(i + 2) % 5}';\n")
    store = Maintained(str(tmp_path / "store"), bucket=10)
    store.refresh(spark, str(root))
    before = store._state(spark)
    assert len(before["buckets"]) >= 15
    (root / "d07/m1.ts").write_text("import './m2';\nexport const changed = 1;\n")
    (root / "d30/m4.ts").unlink()
    parsed = []
    plain = files.scan_files
    monkeypatch.setattr(files, "scan_files", lambda listed, *a: parsed.extend(r["path"] for r in listed.collect()) or plain(listed, *a))
    store.refresh(spark, str(root))
    after = store._state(spark)
    assert parsed == ["d07/m1.ts"] and store.parsed == 1 and store.resolved == 3  # the importers of d30/m4.ts, and the changed file
    moved = [i for i, (a, b) in enumerate(zip(before["buckets"], after["buckets"], strict=True)) if a != b]
    assert 1 <= len(moved) <= 4
    for table in ("files", "nodes", "edges"):
        assert len({b for t, b in store.read if t == table}) <= 6
    assert len({s for t, s in store.read if t == "index"}) == 1 and len({s for t, s in store.read if t == "cache"}) <= 2
    assert sorted(v for v in after["cache"].values())[-2:] == [1, 2]  # one slot of the cache is written anew
    same(spark, store, str(root))
    # contents that were parsed before are taken from the cache, wherever they turn up
    (root / "d12/new.ts").write_text("import './m2';\nexport const changed = 1;\n")
    store.refresh(spark, str(root))
    assert store.parsed == 0 and store.current(spark).header["cache_hits"] == 200
    assert [r["path"] for r in store.functions(spark, "d12/new.ts").collect()] == ["d12/new.ts"]
    same(spark, store, str(root))


def test_versions_survive_restarts_and_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maintained, "MERGE", 2)
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.ts").write_text("import './b';\n")
    seen = []
    for i in range(4):
        (root / f"n{i}.ts").write_text(f"import './n{i + 1}';\nimport './a';\n")
        store = Maintained(str(tmp_path / "store"), bucket=1)
        store.listeners.append(seen.append)
        store.refresh(spark, str(root))
        same(spark, store, str(root))
    assert seen[-1] == store.version and len(store._state(spark)["index"]) <= 3
    kept = sorted(p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("v"))
    assert len(kept) == 2
