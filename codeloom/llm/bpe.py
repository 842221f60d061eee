"""Operator 2: BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The vocabulary is a tokenizers file (lower-cased words with word ends). A word's
symbols stand in a line; the leaves of a segment tree hold the rank of each
adjacent pair, and the root yields the leftmost pair of least rank. A merge
updates two leaves and their paths, so a word of n symbols takes O(n log n).

Pieces between ASCII white space are independent of each other, so what a piece
gives is kept in a bounded table per task; a full table is emptied.

Defined cases: null texts count as empty; empty texts have no ids and decode to
the empty text; the strings of special tokens in a text become those tokens, as
the library does; repeated rows give repeated results; an empty table no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEPT_PIECES, KEPT_WORDS, LONGEST_KEPT = 250_000, 250_000, 40
NONE = 1 << 60

#: Unicode white space, which the vocabulary's patterns mean by \\s.
_WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next character from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in prints else chr(free))
        free += b not in prints
    return out


class SegmentTree:
    """Minimum over leaves; the leftmost leaf of least value by descent from the root."""

    def __init__(self, values: list[int]):
        size = 1
        while size < len(values):
            size *= 2
        self.size = size
        self.tree = tree = [NONE] * size + values + [NONE] * (size - len(values))
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left <= right else right

    def least(self) -> int:
        return self.tree[1]

    def leftmost(self) -> int:
        tree, i, value = self.tree, 1, self.tree[1]
        while i < self.size:
            i *= 2
            if tree[i] != value:
                i += 1
        return i - self.size

    def put(self, at: int, value: int) -> None:
        tree, i = self.tree, at + self.size
        tree[i] = value
        i >>= 1
        while i:
            left, right = tree[2 * i], tree[2 * i + 1]
            new = left if left <= right else right
            if tree[i] == new:
                break
            tree[i] = new
            i >>= 1


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.bytes = byte_symbols()
        self.plain = [self.ids.get(s) for s in self.bytes]
        self.last = [self.ids.get(s + self.suffix) for s in self.bytes]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace("\\s", _WHITE))
        self.apart = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def word(self, text: str) -> list[int]:
        """Ids of one word that the pattern has cut out."""
        raw = text.encode("utf-8", "surrogatepass")
        line = [self.plain[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        line = [x for x in line if x is not None]
        if len(line) < 2:
            return line
        ranks = self.ranks
        pairs = [ranks.get(p) for p in zip(line, line[1:], strict=False)]
        tree = SegmentTree([NONE if p is None else p[0] for p in pairs])
        after, before = list(range(1, len(line) + 1)), list(range(-1, len(line) - 1))
        end = len(line)
        while tree.tree[1] != NONE:
            at = tree.leftmost()
            nxt = after[at]
            line[at] = pairs[at][1]
            line[nxt] = -1
            after[at] = after[nxt]
            if nxt < end - 1:
                tree.put(nxt, NONE)
            if after[at] < end:
                before[after[at]] = at
                pairs[at] = p = ranks.get((line[at], line[after[at]]))
                tree.put(at, NONE if p is None else p[0])
            else:
                tree.put(at, NONE)
            if before[at] >= 0:
                left = before[at]
                pairs[left] = p = ranks.get((line[left], line[at]))
                tree.put(left, NONE if p is None else p[0])
        return [x for x in line if x >= 0]

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def encode(self, text: str) -> list[int]:
        return [i for part in (self.apart.split(text) if self.apart else [text]) if part for i in ([self.special[part]] if part in self.special else [i for w in self.words(part) for i in self.word(w)])]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: tokens joined by one space."""
        return " ".join([self.tokens[i] for i in ids])


class Batch:
    """Many words at once: one segment tree a row, all of one power-of-two size."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        known = sorted((a * (1 << 32) + b, rank, new) for (a, b), (rank, new) in v.ranks.items())
        self.keys, self.rank, self.new = (np.array(c, np.int64) for c in zip(*known, strict=True))
        self.plain = np.array([-1 if x is None else x for x in v.plain], np.int64)
        self.last = np.array([-1 if x is None else x for x in v.last], np.int64)
        self.whole = bool((self.plain >= 0).all() and (self.last >= 0).all())

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no merge) and merged symbol."""
        key = a * (1 << 32) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.new[at], -1)

    @staticmethod
    def put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        at = leaf + tree.shape[1] // 2
        tree[rows, at] = value
        at = at >> 1
        while at.size and at[0]:
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            at = at >> 1

    def merge(self, raw: list[bytes]) -> list[list[int]]:
        """Ids of words of 2 to 64 bytes."""
        n = np.array([len(x) for x in raw])
        width = 1 << int(n.max() - 1).bit_length()
        count = len(raw)
        grid = np.zeros((count, width), np.uint8)
        grid[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        line = self.plain[grid]
        every = np.arange(count)
        line[every, n - 1] = self.last[grid[every, n - 1]]
        inside = np.arange(width - 1) < (n - 1)[:, None]
        tree = np.full((count, 2 * width), NONE, np.int64)
        made = np.full((count, width), -1, np.int64)
        rank, new = self.pairs(line[:, :-1][inside], line[:, 1:][inside])
        tree[:, width : 2 * width - 1][inside] = rank
        made[:, : width - 1][inside] = new
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        after = np.tile(np.arange(1, width + 1), (count, 1))
        before = np.tile(np.arange(-1, width - 1), (count, 1))
        live = np.flatnonzero(tree[:, 1] != NONE)
        while live.size:
            at = np.ones(live.size, np.int64)
            least = tree[live, 1]
            while at[0] < width:
                at = 2 * at
                at = at + (tree[live, at] != least)
            at -= width
            nxt = after[live, at]
            line[live, at] = made[live, at]
            line[live, nxt] = -1
            follow = after[live, nxt]
            after[live, at] = follow
            self.put(tree, live, nxt, np.full(live.size, NONE))
            has = follow < n[live]
            rank, new = np.full(live.size, NONE), np.full(live.size, -1)
            r, f = live[has], follow[has]
            before[r, f] = at[has]
            rank[has], new[has] = self.pairs(line[r, at[has]], line[r, f])
            made[live, at] = new
            self.put(tree, live, at, rank)
            has = before[live, at] >= 0
            r, a = live[has], at[has]
            left = before[r, a]
            rank, new = self.pairs(line[r, left], line[r, a])
            made[r, left] = new
            self.put(tree, r, left, rank)
            live = live[tree[live, 1] != NONE]
        keep = (line >= 0) & (np.arange(width) < n[:, None])
        flat, ends = line[keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


#: What a piece gives: number of ids, ids as text, tokens as text.
Coded = tuple[int, str, str]


class Pieces:
    """What pieces between white space give; both tables are bounded."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.batch = vocabulary, Batch(vocabulary)
        self.pieces: dict[str, Coded] = {}
        self.words: dict[str, Coded] = {}

    def _code(self, ids: list[int]) -> Coded:
        return len(ids), " ".join(map(str, ids)), self.vocabulary.decode(ids)

    def _learn_words(self, words: set[str], into: dict[str, Coded]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if 2 <= len(raw) <= 64 and self.batch.whole:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append((w, raw))
            else:
                into[w] = self._code(self.vocabulary.word(w))
        for group in by_width.values():
            for i in range(0, len(group), 20_000):
                part = group[i : i + 20_000]
                for (w, _), ids in zip(part, self.batch.merge([raw for _, raw in part]), strict=True):
                    into[w] = self._code(ids)

    def learn(self, unknown: set[str]) -> None:
        v, cut, plain, fresh = self.vocabulary, {}, {}, set()
        known = self.words
        for piece in unknown:
            low = piece.lower()
            if piece.isascii() and low.isalpha():
                plain[piece] = low
                if low not in known:
                    fresh.add(low)
                continue
            parts = v.apart.split(piece) if "<|" in piece and v.apart else [piece]
            cut[piece] = [([part] if part in v.special else None, [] if part in v.special else v.words(part)) for part in parts if part]
            fresh.update(w for _, words in cut[piece] for w in words if w not in known)
        new: dict[str, Coded] = {}
        self._learn_words(fresh, new)
        if len(known) + len(new) > KEPT_WORDS:
            new = {w: known[w] if w in known else new[w] for w in {*plain.values(), *(w for parts in cut.values() for _, words in parts for w in words)}}
            known.clear()
        known.update(new)
        if len(self.pieces) + len(unknown) > KEPT_PIECES:
            self.pieces.clear()
        for piece, word in plain.items():
            self.pieces[piece] = known[word]
        for piece, parts in cut.items():
            got = [c for special, words in parts for c in ([self._code([v.special[special[0]]])] if special else [known[w] for w in words])]
            self.pieces[piece] = got[0] if len(got) == 1 else (sum(g[0] for g in got), " ".join(g[1] for g in got if g[0]), " ".join(g[2] for g in got if g[0]))

    def code(self, texts: list[str]) -> list[Coded]:
        """Coded texts; together they should be a few MB at most."""
        cut = [apart(t) for t in texts]
        unknown = set()
        for pieces in cut:
            unknown.update(pieces)
        unknown = {p for p in unknown if p not in self.pieces}
        kept = self.pieces
        if unknown and len(kept) + len(unknown) > KEPT_PIECES:  # then all of these texts' pieces are learnt anew
            unknown = {p for pieces in cut for p in pieces}
        if unknown:
            self.learn(unknown)
        out = []
        for pieces in cut:
            got = [g for g in map(kept.__getitem__, pieces) if g[0]]
            out.append((sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])))
        return out


_SEPARATORS = regex.compile("[\x1c-\x1f]")
_ASCII_SPACE = regex.compile("[ \t\n\x0b\x0c\r]+")


def apart(text: str) -> list[str]:
    """Pieces between white space. The four separators that Python counts as white space, and the patterns don't, stay."""
    return _ASCII_SPACE.split(text) if _SEPARATORS.search(text) else text.split()


_LOADED: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(Vocabulary(path))
    return _LOADED[path]


def _chunks(column: pa.Array, size: int = 1_000_000) -> Iterator[list[str]]:
    """Texts (null: empty) in lists of about `size` characters."""
    part, n = [], 0
    for value in column:
        part.append(value.as_py() or "")
        n += len(part[-1])
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def _encode_task(path: str, keep_text: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in common.pieces(common.freed(batches), 1, 4_000_000):
            n_tokens, ids_hash, text_hash, ids_text, texts = [], [], [], [], []
            for part in _chunks(batch.column(1)):
                for n, ids, decoded in pieces.code(part):
                    n_tokens.append(n)
                    ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    if keep_text:
                        ids_text.append([int(i) for i in ids.split()])
                        texts.append(decoded)
            columns = [batch.column(0).cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_text:
                columns += [pa.array(ids_text, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)
        pieces.pieces.clear()
        pieces.words.clear()

    return task


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, keep_text: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_text also ids and decoded.

    path: the vocabulary's file, in the same place on all machines.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_text else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode_task(path or default_path(), keep_text), schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
