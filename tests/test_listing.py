"""Listings made by executors equal a walk in one process; ignore rules of all kinds."""

import os
import random
import subprocess

import pytest
from codeloom.sources import listing
from codeloom.sources.listing import ScanOptions


def tree(root, rng, folders=40, files=200):
    dirs = [""]
    for i in range(folders):
        dirs.append(f"{rng.choice(dirs)}/d{i}".strip("/"))
        os.makedirs(f"{root}/{dirs[-1]}")
    for i in range(files):
        with open(f"{root}/{rng.choice(dirs)}/{rng.choice(['f', 'gen', '.h'])}{i}.{rng.choice(['ts', 'py', 'rs', 'txt'])}", "w") as f:
            f.write("x" * i)
    for d in rng.sample(dirs, 8):
        with open(f"{root}/{d}/{rng.choice(['.gitignore', '.ignore'])}", "w") as f:
            f.write(rng.choice(["gen*\n", "*.py\n!f1*.py\n", "d1*/\n", "/f*.ts\n", "# no\n\nf?.rs\n"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_listing_equals_walk(spark, tmp_path, seed):
    root = str(tmp_path / "src")
    os.makedirs(root)
    tree(root, random.Random(seed))
    for options, budget in ((ScanOptions(), 10), (ScanOptions(hidden=True, depth=3), 1), (ScanOptions(include=("python",), exclude=("d2*",)), 10_000), (ScanOptions(ignore_files=False), 50)):
        want = sorted(listing.walk(root, options))
        got = sorted(tuple(r) for r in listing.listing(spark, root, options, budget).collect())
        assert got == want and (want or options.include)


def found(root, **options):
    return sorted(p for p, *_ in listing.walk(str(root), ScanOptions(**options)))


def test_depth(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for p in ("x.ts", "a/y.ts", "a/b/z.ts"):
        (tmp_path / p).write_text("")
    assert [found(tmp_path, depth=d) for d in (0, 1, 2, 3)] == [[], ["x.ts"], ["a/y.ts", "x.ts"], ["a/b/z.ts", "a/y.ts", "x.ts"]]


def test_rules_above_the_root(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    (tmp_path / "home/.config/git").mkdir(parents=True)
    (tmp_path / "home/.config/git/ignore").write_text("everywhere.ts\n")
    repo = tmp_path / "out/repo"
    root = repo / "pkg/src"
    (root / "in").mkdir(parents=True)
    (repo / ".git/info").mkdir(parents=True)
    (repo / ".git/info/exclude").write_text("/pkg/src/excluded.ts\n")
    (tmp_path / "out/.gitignore").write_text("beyond.ts\n")
    (tmp_path / "out/.ignore").write_text("far.ts\n")
    (repo / ".gitignore").write_text("top*.ts\n/pkg/src/in/deep.ts\n")
    (repo / "pkg/.gitignore").write_text("!top1.ts\n/src/near.ts\n/other.ts\n")
    for name in ("everywhere", "excluded", "beyond", "far", "top1", "top2", "near", "other", "keep", "in/deep", "in/excluded"):
        (root / f"{name}.ts").write_text("")
    kept = ["beyond", "in/excluded", "keep", "other", "top1"]
    assert found(root) == [f"{k}.ts" for k in kept]
    assert len(found(root, above=False)) == 11
    (tmp_path / "home/.gitconfig").write_text("[core]\n\texcludesFile = ~/mine\n")
    (tmp_path / "home/mine").write_text("keep.ts\n")
    assert "keep.ts" not in found(root) and "everywhere.ts" in found(root)


def test_git_agrees(tmp_path, monkeypatch):
    """What git itself leaves out of a made repository."""
    monkeypatch.setenv("HOME", str(tmp_path))
    repo = tmp_path / "repo"
    repo.mkdir()
    if subprocess.run(["git", "init", "-q", str(repo)]).returncode:
        pytest.skip("no git")
    tree(str(repo), random.Random(5))
    for d, _, names in os.walk(repo):
        for name in names:
            if name == ".ignore":
                os.remove(f"{d}/{name}")
    tracked = subprocess.run(["git", "-C", str(repo), "ls-files", "-co", "--exclude-standard"], capture_output=True, text=True).stdout.split()
    assert found(repo, hidden=True) == sorted(p for p in tracked if listing.language_of(os.path.basename(p)))
