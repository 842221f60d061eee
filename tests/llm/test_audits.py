"""Divergence of sources, the Merkle manifest and shared lines, on small cases against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from codeloom.llm import common, divergence, lines, merkle
from pyspark.sql import functions as F

#: Extra columns have names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, idx string, high int, term array<int>"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, 1, "x", 2, [3]) for r in rows], SCHEMA).repartition(parts)


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


# ---- 11


def brute_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", (text or "").translate(UPPER)) for _, text, lang, source in rows]
    by_lang = defaultdict(list)
    for d in docs:
        by_lang[d[0]].append(d)
    out = set()
    for lang, own in by_lang.items():
        found = [(s, Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t))) for _, s, t in own]
        held = Counter(t for _, c in found for t in c)
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = {s: Counter() for s, _ in found}
        for s, c in found:
            counts[s].update({t: c[t] for t in kept if t in c})
        total = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            n = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // n for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)
        for s in counts:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])
            for part, items in (("pair", pairs), ("term", terms[:top])):
                out |= {(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(items, 1)}
    return out


def test_audit(spark, monkeypatch):
    rng = random.Random(11)
    common_words, own = [f"w{c}" for c in "abcdefghijklmnopqrst"], {s: [f"é{chr(97 + s)}{x}日" for x in "uvwxyz"] for s in range(9)}
    rows = [(i, prose(rng, [*common_words, *own[i % 9]], 40) + " One-Two3three's", "en" if i % 3 else "fr", f"s{i % 9}") for i in range(120)]
    rows += [(200, None, "en", "empty"), (201, "", None, None), (202, "123 --", "xx", "a"), (203, " \x00", "xx", "b"), (204, "Zz " * 50_000, "en", None), (5, rows[5][1], "en", "s5"), (None, "wa wb", "en", "s1")]
    got = [tuple(r) for r in divergence.audit(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows)
    for name, value in (("HEAVY", 1), ("HEAVY", 1000), ("TERMS", 1)):
        monkeypatch.setattr(divergence, name, value)
        assert {tuple(r) for r in divergence.audit(frame(spark, rows), top=3).collect()} == brute_audit(rows, top=3)
    assert divergence.audit(frame(spark, rows).limit(0)).count() == 0


def test_tiles_sum_blocks_of_groups_and_terms(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(3)
    p = rng.integers(1, 10**9, (70, 7))
    shares = pd.DataFrame([(f"t{t}", g, p[t, g]) for t in range(70) for g in range(6)], columns=["term", "g", "p"])
    zero = pd.DataFrame({"g": range(7), "p0": 5})
    p[:, 6] = 5
    monkeypatch.setattr(divergence, "ROWS", 4)
    out = pd.concat([divergence._tile(("en", 0, r), shares, zero) for r in (0, 1)])
    want = {(a, b): sum((int(x[a]) - int(x[b])) ** 2 // int(x[b]) for x in p) for a in range(7) for b in range(7) if a != b}
    assert {(a, b): v for a, b, v in out[["a", "b", "value"]].itertuples(index=False)} == want and len(out) == 42


# ---- 12


def brute_manifest(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()

    def leaf(i, text, lang, source):
        fields = (i, source, lang, len(text) if text is not None else None, text)
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))

    def tree(nodes):
        """The last node, and the sides of each first node by level."""
        paths, level, spans = [[] for _ in nodes], nodes, [[i] for i in range(len(nodes))]
        while len(level) > 1:
            up, up_spans = [], []
            for a in range(0, len(level), 16):
                run = level[a : a + 16]
                for k, members in enumerate(spans[a : a + 16]):
                    for m in members:
                        paths[m].append((run[:k], run[k + 1 :]))
                up.append(h(*run))
                up_spans.append(sum(spans[a : a + 16], []))
            level, spans = up, up_spans
        return level[0], paths

    by_source = defaultdict(list)
    for i, text, lang, source in rows:
        low = text.translate(UPPER) if text is not None else None
        own = leaf(i, text, lang, source)
        by_source[b"" if source is None else b"." + source.encode()].append(((i is not None, i or 0, own), i, own, leaf(i, low, lang, source) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else own))
    trees = []
    for key in sorted(by_source):
        leaves = sorted(by_source[key])
        trees.append((leaves, *tree([x[2] for x in leaves])))
    root, tops = tree([t[1] for t in trees])
    out = []
    for (leaves, subroot, paths), top in zip(trees, tops, strict=True):
        for (_, i, own, altered), path in zip(leaves, paths, strict=True):
            x = altered
            for left, right in path + top:
                x = h(*left, x, *right)
            out.append((str(i), own, subroot, root, h(*(d for left, right in path + top for d in left + right)), x, x == root))
    return sorted(out)


@pytest.mark.parametrize("step", [1, 3])
def test_manifest(spark, monkeypatch, tmp_path, step):
    monkeypatch.setattr(merkle, "STEP", step)
    monkeypatch.setattr(merkle, "CHUNK", step * merkle.FAN)
    rng = random.Random(12)
    sizes = {None: 1, "": 16, "A": 17, "b": 257, "é": 2, "hot": 700, **{f"s{i}": 1 for i in range(20)}}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += rng.randrange(1, 4)
            rows.append((i, rng.choice(["Some Text É", "", None, "low", "X" * 50]), rng.choice(["en", None]), source))
    rows += [(None, "A", "en", "hot"), (None, None, None, None), rows[40], rows[40], (10**6, "Long É " * 100_000, "en", "b")]
    docs = frame(spark, rows)
    lowered = merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], merkle.tampered(F.col("text")))
    got, root = merkle.manifest(docs, f"{tmp_path}/store", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered))
    got = sorted((str(r.doc_id), r.leaf, r.subroot, root, r.proof_sha256, r.folded_root, r.folded_root == root) for r in got.collect())
    assert got == brute_manifest(rows)
    levels = {r.level: r["count"] for r in spark.read.parquet(f"{tmp_path}/store/sources").groupBy("level").count().collect()}
    assert levels[0] == len(rows) and levels[1] == sum(-(-n // 16) for n in (2, 16, 17, 260, 2, 701) if n > 1)
    empty, none = merkle.manifest(docs.limit(0))
    assert empty.count() == 0 and none is None


def test_nothing_tampered_verifies(spark):
    rows, root = merkle.manifest(frame(spark, [(i, f"Text {i}", "en", f"s{i % 3}") for i in range(60)]))
    assert [r.folded_root for r in rows.collect()] == [root] * 60
    proof = [merkle.digest(str(i)) for i in range(6)]
    assert merkle.fold("x", proof) == merkle.digest(proof[4], merkle.digest(proof[2], merkle.digest(proof[0], "x", proof[1]), proof[3]), proof[5])


# ---- 13


def brute_lines(rows, least_chars=20, least_docs=3):
    space = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(space).translate(UPPER)
    held = defaultdict(list)
    for i, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].append(-(10**9) if i is None else i)
    out = []
    for i, text, *_ in rows:
        own = (text or "").split("\n")
        gone = [len(key(x)) >= least_chars and len(held[key(x)]) >= least_docs and max(held[key(x)]) != (-(10**9) if i is None else i) for x in own]
        out.append((str(i), len(own), sum(gone), "\n".join(x for x, g in zip(own, gone, strict=True) if not g)))
    return sorted(out)


def line_rows():
    rng = random.Random(13)
    pool = [f"This is the shared line number {k} ÉÀ日本" for k in range(40)] + ["x" * 19, "É" * 20, "y" * 20, "short", ""]
    rows = [(i, "\n".join(rng.choice([" ", "\t", ""]) + (x.upper() if rng.random() < 0.3 and x.isascii() else x) + rng.choice(["\r", "", " \x0b"]) for x in rng.choices(pool, k=rng.randrange(0, 9))) + f"\nonly {i} has this very line", "en", "s") for i in range(150)]
    rows += [(200 + i, "Everyone has this line, everyone." + "\n" * (i % 3), "en", "s") for i in range(60)]
    return rows + [(None, rows[0][1], "en", "s"), (None, "null ids only hold this line\n", "en", "s"), (None, "null ids only hold this line", "en", "s"), (None, "NULL ids only hold this line", "en", "s"), (300, None, "en", "s"), (301, "", "en", "s"), rows[7], rows[7], (302, "one and the same line again\n" * 20_000, "en", "s"), (303, "  one and the same line again", "en", "s")]


@pytest.mark.parametrize("sent", [True, False])
def test_lines(spark, monkeypatch, sent):
    rows = line_rows()
    monkeypatch.setattr(lines, "SHARD", 7)
    monkeypatch.setattr(lines, "HELD", 50)
    options = {} if sent else {"most_bytes": 0, "probes": 20}
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in lines.dedup(frame(spark, rows), **options).collect())
    assert got == brute_lines(rows)
    assert lines.dedup(frame(spark, rows).limit(0), **options).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 50_000):
        high, low = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        low[: n // 2] = low[0] if n > 1 else low[: n // 2]
        assert sorted(lines.PerfectHash.of(high, low).slots(high, low)) == list(range(n))
    shard = lines.Shard.unpacked(lines.Shard.of(high, low, np.full(n, 3), np.arange(n)).packed())
    assert not shard.goes(high, low, np.arange(n), 3).any() and shard.goes(high, low, np.arange(n) + 1, 3).all() and not shard.goes(high, low, np.arange(n) + 1, 4).any()
    assert not shard.goes(*rng.integers(0, 2**64, (2, 10_000), dtype=np.uint64), np.full(10_000, -1), 3).any()


def test_perfect_hash_lists_what_levels_leave(monkeypatch):
    monkeypatch.setattr(lines, "LEVELS", 1)
    high, low = np.random.default_rng(5).integers(0, 2**64, (2, 300), dtype=np.uint64)
    index = lines.PerfectHash.of(high, low)
    assert index.rest.shape[1] and sorted(index.slots(high, low)) == list(range(300))
    assert common.SPACE.strip() == ""
