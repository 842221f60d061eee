"""The join against brute force over all pairs."""

import itertools
import random

import pyarrow as pa
import pytest
from codeloom.llm import jaccard


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k=4, percent=85):
    """[(doc_id, n, component)] for rows (doc_id, text)."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(s), least.get(find(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in jaccard.join(docs, **options).collect()), key=str)


def test_need_and_prefix():
    for a, b in itertools.product(range(1, 60), repeat=2):
        least = next(i for i in range(0, a + b + 1) if 100 * i >= 85 * (a + b - i))
        assert jaccard.need(a, b) == least


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(7, None), (8, ""), (9, " \t\n"), (None, "a b c d e f"), (10, "a b c d e f"), (10, "a b c d e f"), (11, "A B C\x0bD e F"), (12, "one"), (13, "ONE"), (14, "É a b c d"), (15, "é a b c d")]
    i = 100
    for length in [*range(3, 24), 40, 60, 120, 300]:
        for _ in range(3):
            base = [rng.choice(words) for _ in range(length)]
            for _ in range(rng.choice([1, 2, 6])):
                text = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                    at = rng.randrange(len(text))
                    if rng.random() < 0.5:
                        text[at] = rng.choice(words)
                    else:
                        text.insert(at, rng.choice(words))
                if rng.random() < 0.3:
                    text = text[: max(1, int(len(text) * rng.uniform(0.85, 1)))]
                rows.append((i, " ".join(text)))
                i += 1
    rng.shuffle(rows)
    got, want = run(spark, rows), brute(rows)
    assert got == want, [p for p in zip(got, want) if p[0] != p[1]][:8]


def test_large_near_group_with_common_passage(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    for i in range(200, 280):
        rows.append((i, " ".join([rng.choice(vocabulary) for _ in range(60)] + passage)))
    monkeypatch.setattr(jaccard, "LOT", 7)
    monkeypatch.setattr(jaccard, "STAR_LEAST", 4)
    got, want = run(spark, rows), brute(rows)
    assert got == want, [p for p in zip(got, want) if p[0] != p[1]][:8]


@pytest.mark.parametrize(("k", "percent", "least", "lot"), [(4, 85, 8, 50), (5, 80, 16, 2000), (4, 85, 4, 3)])
def test_groups_of_near_copies(spark, monkeypatch, k, percent, least, lot):
    """Several generations of copies, members far from every centre, and strangers that share most of a passage."""
    rng = random.Random(k * percent + lot)
    vocabulary = [f"v{i}" for i in range(5000)]

    def edited(words, edits):
        out = list(words)
        for _ in range(edits):
            at = rng.randrange(len(out))
            way = rng.random()
            if way < 0.5:
                out[at] = rng.choice(vocabulary)
            elif way < 0.75:
                out.insert(at, rng.choice(vocabulary))
            else:
                del out[at : at + rng.choice([1, 4])]
        return out

    rows = []
    for length in (60, 150):
        first = [rng.choice(vocabulary) for _ in range(length)]
        texts = [edited(first, rng.randrange(0, 7)) for _ in range(130)]
        texts += [edited(rng.choice(texts[:20]), rng.randrange(0, 4)) for _ in range(90)]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(80):
        rows.append((len(rows), " ".join([rng.choice(vocabulary) for _ in range(rng.randrange(4, 16))] + passage)))
    monkeypatch.setattr(jaccard, "LOT", lot)
    monkeypatch.setattr(jaccard, "STAR_LEAST", least)
    got, want = run(spark, rows, words=k, percent=percent), brute(rows, k, percent)
    assert got == want, [p for p in zip(got, want) if p[0] != p[1]][:8]


def test_difference_prefix_meets_every_link():
    """Two linked sets that aren't both linked with the pivot share a member of their differences' prefixes."""
    rng = random.Random(3)
    for _ in range(4000):
        percent = rng.choice([80, 85])
        pivot = set(range(rng.randrange(5, 40)))
        x, y = (set(pivot) for _ in range(2))
        for s in (x, y):
            for _ in range(rng.randrange(1, 14)):
                e = rng.randrange(60)
                s.symmetric_difference_update({e})
        link = [100 * len(a & b) >= percent * len(a | b) for a, b in ((x, y), (x, pivot), (y, pivot))]
        if x and y and x != y and link[0] and not (link[1] and link[2]):
            firsts = []
            for s in (x, y):
                d = sorted(s - pivot) + sorted(pivot - s)
                firsts.append(set(d[: max(0, jaccard.difference_prefix(len(s), len(d), len(pivot), percent))]))
            assert firsts[0] & firsts[1]


def test_lists_task_over_batches():
    rng = random.Random(1)
    tokens = [rng.randrange(90) for _ in range(200)]
    rows = sorted((t, rng.randrange(3) if t % 5 == 0 else -1, bytes([rng.randrange(6)]) * 16) for t in tokens)
    table = pa.table({"token": pa.array([r[0] for r in rows], pa.int64()), "salt": pa.array([r[1] for r in rows], pa.int32()), "key": pa.array([r[2] for r in rows], pa.binary())}).combine_chunks()
    whole = pa.Table.from_batches(jaccard._lists_task(iter(table.to_batches()))).to_pylist()
    for size in (1, 2, 3, 7, 50):
        assert pa.Table.from_batches(jaccard._lists_task(iter(table.to_batches(size)))).to_pylist() == whole
    distinct = sorted(set(rows))
    tokens = [r[0] for r in distinct]
    assert [(r["token"], r["salt"], r["key"]) for r in whole] == [r for i, r in enumerate(distinct) if r[1] >= 0 or r[0] in tokens[max(0, i - 1) : i] + tokens[i + 1 : i + 2]]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_words_that_cancel_sums_differ(spark):
    """Thue-Morse words and their complements have one value under any polynomial modulo 2**64."""
    signs = [bin(i).count("1") & 1 for i in range(1024)]
    one, other = ("".join(pair[s] for s in signs) for pair in ("ab", "ba"))
    assert jaccard.word_hashes(one.encode())[0] != jaccard.word_hashes(other.encode())[0]
    got = jaccard.join(spark.createDataFrame([(1, one), (2, other), (3, f"{one} x"), (4, f"{one}  x")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_word_hashes_hang_on_the_word_alone():
    words = [b"a", b"a\0", b"abcdefgh", b"abcdefghi", b"i" * 8 + b"j" * 8, b"j" * 8 + b"i" * 8, b"x" * 200_000, b"\xff" * 7, b"z" * 65_530]
    alone = [int(jaccard.word_hashes(w)[0]) for w in words]
    assert len(set(alone)) == len(words)
    assert [int(h) for h in jaccard.word_hashes(b" \t".join(words) + b"\r\n")] == alone
    assert len(jaccard.word_hashes(b" \n")) == 0
