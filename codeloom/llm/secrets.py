"""Operator 3: secret scan, with a random forest that removes false positives.

Patterns give candidates (known key formats, values assigned to names such as
password or token, and long mixed runs). A forest on the candidate's length,
character transitions, dictionary coverage, path and neighbouring words, trained
from labelled findings, keeps the true ones. Without findings of one's own, findings
made from a seed are used; fit(findings) takes any.

Defined cases: null and empty texts have no candidates; repeated rows give repeated
results; an empty table gives no rows; where candidates overlap, the one of the
better pattern counts.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TREES, DEPTH, FINDINGS, SEED = 30, 9, 2400, 3

#: Patterns of candidates, best first; group "v" is the candidate, or "w" inside quotes. Values are read to their end, however long: quoted ones to the same quote.
PATTERNS = {
    "private_key": re.compile(r"(?P<v>-----BEGIN [A-Z0-9 ]*?PRIVATE KEY-----(?:(?:\s|\\[nr])*+[A-Za-z][A-Za-z0-9-]*+:(?:(?!\\[nr]|-----)[^\r\n])*+)*+[A-Za-z0-9+/=\s\\]{16,}+-----END [A-Z0-9 ]*?PRIVATE KEY-----)"),
    "access_key": re.compile(r"\b(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    "prefixed": re.compile(r"\b(?P<v>(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+))"),
    "signed_token": re.compile(r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=\beyJ[A-Za-z0-9_-]{8}))(?P<v>eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"),
    "assigned": re.compile(r"(?i)(?<![A-Za-z0-9])(?:pass(?:word|wd)?|pwd|secret|(?:access|auth|api|secret)?[_-]?(?:token|key))\b[\"']?\s{0,3}(?:=|:)\s{0,3}(?:(?P<q>[\"'])(?P<w>(?:\\.|(?!(?P=q))[^\\\r\n]){6,}+)(?P=q)|[\"']?(?P<v>[^\s\"'<>;,]{6,}+))"),
    "mixed_run": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])(?P<v>[A-Za-z0-9+/_-]{20,}+={0,2}+)(?![A-Za-z0-9+/_=-])"),
}
#: What a text must hold to be read with a pattern.
_NEEDED = {"private_key": "PRIVATE KEY", "signed_token": "eyJ"}
#: What candidates of each kind can't be without; a text with none of these has no candidates.
HINTS = {"private_key": "PRIVATE KEY", "access_key": "AKIA|ASIA", "prefixed": "gh[pousr]_|xox[abprs]-|[sr]k_(?:live|test)_", "signed_token": "eyJ", "assigned": "[=:]", "mixed_run": "[0-9]"}
_HINT = re.compile("|".join(HINTS[kind] for kind in PATTERNS).encode())

#: Words of everyday identifiers, for coverage; names near real and unreal secrets.
_WORDS = "admin alpha beta build change check class client code config count data debug default demo dummy example field file first from function hash have here host index insert item last list local login main make name none null number option page path placeholder please port project query read result root sample server setting size some start status string system table test text that this time true type update user value version with word world your".split()
_NEAR_REAL = frozenset("password passwd pwd secret token key auth credential bearer aws login private".split())
_NEAR_UNREAL = frozenset("example sample test dummy placeholder fake sha sha1 sha256 md5 checksum commit digest hash uuid guid revision etag version your template documentation fixture".split())

Finding = tuple[str, str, str, str, str]
"""kind, candidate, text before, text after, path"""

FEATURE_NAMES = (
    ["length", "log_length", "upper", "lower", "digit", "sign", "changes", "entropy", "distinct", "coverage", "vowels", "common_pairs", "longest_letters", "longest_run", "hex", "digits_only", "letters_only", "uuid", "near_real", "near_unreal", "assignment", "quoted", "path_unreal", "path_config"]
    + [f"is_{k}" for k in PATTERNS]
)
_PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split())
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_NAMES = re.compile(r"[A-Za-z0-9]+")


def features(kind: str, value: str, before: str, after: str, path: str) -> list[float]:
    n = len(value)
    upper, lower, digit = sum(c.isupper() for c in value), sum(c.islower() for c in value), sum(c.isdigit() for c in value)
    classes = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "s" for c in value]
    counts = Counter(value)
    low = value.lower()
    covered = bytearray(n)
    for w in _WORDS:
        at = low.find(w)
        while at >= 0:
            covered[at : at + len(w)] = b"\x01" * len(w)
            at = low.find(w, at + 1)
    letters = [c for c in low if c.isalpha()]
    runs = [len(m.group()) for m in re.finditer(r"[A-Za-z]+", value)]
    same = max((len(m.group()) for m in re.finditer(r"(.)\1*", value)), default=0)
    near = {w.lower() for w in _NAMES.findall(before[-60:])[-4:]} | {w.lower() for w in _NAMES.findall(after[:30])[:2]}
    return [
        n, math.log(n + 1), upper / n, lower / n, digit / n, 1 - (upper + lower + digit) / n,
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()), len(counts) / n, sum(covered) / n,
        sum(c in "aeiou" for c in letters) / max(1, len(letters)), sum(low[i : i + 2] in _PAIRS for i in range(n - 1)) / max(1, n - 1), max(runs, default=0) / n, same / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), float(value.isdigit()), float(value.isalpha()), float(bool(_UUID.fullmatch(value))),
        float(bool(near & _NEAR_REAL)), float(bool(near & _NEAR_UNREAL)), float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in "\"'" and before != ""),
        float(bool(re.search(r"test|example|sample|doc|fixture|mock", path, re.I))), float(bool(re.search(r"env|config|setting|secret|credential", path, re.I))),
        *(float(kind == k) for k in PATTERNS),
    ]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), not overlapping, by start: where two overlap, that of the better pattern."""
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in PATTERNS.items():
        if _NEEDED.get(kind, "") not in text:
            continue
        found = [m.span("w" if m.lastgroup == "w" else "v") for m in pattern.finditer(text)]
        if taken and found:
            starts = [a for a, _, _ in taken]
            free = []
            for a, b in found:
                i = bisect.bisect_left(starts, b)
                if i == 0 or taken[i - 1][1] <= a:
                    free.append((a, b))
            found = free
        taken = sorted([*taken, *((a, b, kind) for a, b in found)])
    return [(kind, a, b) for a, b, kind in taken]


def made_findings(count: int = FINDINGS, seed: int = SEED) -> list[tuple[Finding, int]]:
    """Labelled findings from a seed: keys and passwords in their usual places, and what looks like them."""
    rng = np.random.default_rng(seed)

    def pick(*x):
        return x[int(rng.integers(len(x)))]

    def some(alphabet, n):
        return "".join(alphabet[int(i)] for i in rng.integers(0, len(alphabet), n))

    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexa, mixed = "0123456789abcdef", upper + lower + digits

    def prose():
        return "".join(pick("the ", "of ", "in ", "and ", "thing ", "on ", "er ", "une ", "la ", "das ", "que ") for _ in range(4))

    def path():
        return pick("src0", "src7", "app/config.py", "deploy/.env", "lib/main.go", "web")

    def unreal_path():
        return pick("src3", "tests/test_login.py", "docs/example.md", "fixtures/sample.json", "web")

    def real() -> Finding:
        kind = pick("access_key", "prefixed", "signed_token", "assigned", "assigned", "assigned", "mixed_run", "private_key")
        if kind == "access_key":
            return kind, pick("AKIA", "ASIA") + some(upper + digits, 16), prose() + pick("", "key ", "aws_access_key_id = "), prose(), path()
        if kind == "prefixed":
            return kind, pick("ghp_" + some(mixed, 36), "xoxb-" + some(digits, 12) + "-" + some(mixed, 24), "sk_live_" + some(mixed, 24)), prose() + pick("", "token: "), prose(), path()
        if kind == "signed_token":
            return kind, "eyJ" + some(mixed, 30) + "." + some(mixed, 60) + "." + some(mixed, 40), prose() + pick("Bearer ", "token = "), prose(), path()
        if kind == "private_key":
            return kind, "-----BEGIN RSA PRIVATE KEY-----\n" + some(mixed + "+/", 200) + "\n-----END RSA PRIVATE KEY-----", prose(), prose(), path()
        if kind == "mixed_run":
            return kind, some(mixed + "+/", int(rng.integers(28, 60))), prose() + pick("secret ", "private ", "credential ", "auth "), prose(), path()
        name = pick("password", "passwd", "pwd", "secret", "token", "api_key", "auth_token", "access-key")
        name = pick("", "", "DB_", "my_", "app.") + name
        chosen = "".join(pick("hunter", "summer", "dragon", "qwert", "tiger", "star", "monkey") for _ in range(int(rng.integers(1, 3)))) + some(digits, int(rng.integers(1, 5))) + some(lower, int(rng.integers(0, 4)))
        value = pick(some(hexa, int(rng.integers(12, 65))), some(mixed, int(rng.integers(10, 44))), some(mixed + "!@#$%^&*", int(rng.integers(8, 24))), chosen + pick("", "", "!"))
        if rng.random() < 0.25:  # quoted, with signs that end bare values
            at = sorted(int(i) for i in rng.integers(1, 9, 2))
            value = some(mixed, 4) + some(mixed + "!@#$", 9)
            value = value[: at[0]] + pick(";", ",", " ", "<", "'") + value[at[0] : at[1]] + pick("", ";", ",") + value[at[1] :]
            return kind, value, prose() + name + pick('": "', ' = "', '="'), '"' + pick("", ",", ";") + prose(), path()
        return kind, value, prose() + name + pick("=", ": ", ' = "', " = '", "="), pick('"', " ", "'") + prose(), path()

    def unreal() -> Finding:
        kind = pick("assigned", "assigned", "mixed_run", "mixed_run", "access_key", "prefixed")
        words = [_WORDS[int(i)] for i in rng.integers(0, len(_WORDS), 3)]
        if kind == "access_key":
            return kind, "AKIA" + pick("IOSFODNN7EXAMPLE", "X" * 16, "0" * 16, "1234567890ABCDEF"), prose() + pick("example ", "sample "), prose(), unreal_path()
        if kind == "prefixed":
            return kind, pick("ghp_" + "x" * 36, "sk_test_" + "0" * 24, "xoxb-your-token-here"), prose() + pick("example ", ""), prose(), unreal_path()
        if kind == "mixed_run":
            uuid = "-".join(some(hexa, n) for n in (8, 4, 4, 4, 12))
            value, before = pick(
                (some(hexa, 40), pick("commit ", "revision ", "sha1 ")), (some(hexa, 64), pick("sha256 ", "digest ", "checksum ")), (uuid, pick("id ", "uuid ", "")), ("_".join(words) + "_" + some(digits, 2), ""),
                ("/".join(words) + "/" + some(lower, 6) + some(digits, 1), pick("file ", "path ")), (some(lower, int(rng.integers(18, 30))) + some(digits, 2), ""), ("-".join(words) + "-2024", ""), ("".join(pick("tion", "er", "the", "on", "an") for _ in range(8)) + "1", ""), ("=" * 12 + some(digits, 9) + "a", ""), ("a" * 22 + "1", ""),
            )
            return kind, value, prose() + before, prose(), unreal_path()
        name = pick("password", "token", "secret", "api_key", "key", "DB_PASSWORD")
        if rng.random() < 0.25:  # quoted words
            return kind, pick("", "the ", "a ", "Enter ") + pick(" ", " ", ", ").join(words) + pick("", "", ".", "; ", "!"), prose() + name + pick('": "', ' = "', '="', ": '"), pick('"', "'") + prose(), pick(path(), unreal_path())
        value = pick("changeme", "example", "your_" + words[0], "<" + words[1] + ">", "placeholder", "${" + words[0].upper() + "}", "xxxxxxxx", "********", "process.env." + words[1].upper(), "get_" + words[0] + "()", "string", "required", words[0] + words[1], "os.environ[", "null", "123456", "".join(pick("tion", "er", "the", "on", "an", "ing") for _ in range(3)) + pick(".", ","))
        return kind, value, prose() + name + pick("=", ": ", ' = "'), pick('"', " ") + prose(), unreal_path()

    return [(real(), 1) if i % 2 else (unreal(), 0) for i in range(count)]


class Forest:
    """Classification trees on bootstrap samples, with a random part of the features at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            at = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[at], y[at], depth, rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
        mean = float(y.mean())
        if depth == 0 or len(y) < 6 or mean in (0.0, 1.0):
            return mean
        best = (math.inf, 0, 0.0)
        for f in rng.choice(x.shape[1], max(2, int(math.sqrt(x.shape[1]))), replace=False):
            values = x[:, f]
            for cut in np.unique(np.quantile(values, rng.random(6))):
                left = values <= cut
                k = int(left.sum())
                if 0 < k < len(y):
                    p, q = y[left].mean(), y[~left].mean()
                    impurity = k * p * (1 - p) + (len(y) - k) * q * (1 - q)
                    if impurity < best[0]:
                        best = (impurity, int(f), float(cut))
        if best[0] == math.inf:
            return mean
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], y[left], depth - 1, rng), self._grow(x[~left], y[~left], depth - 1, rng)

    def probability(self, row: list[float]) -> float:
        total = 0.0
        for node in self.trees:
            while not isinstance(node, float):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node
        return total / len(self.trees)


def fit(findings: list[tuple[Finding, int]]) -> Forest:
    """From labelled findings: ((kind, candidate, before, after, path), 1 if it is a secret else 0)."""
    return Forest(np.array([features(*f) for f, _ in findings]), np.array([float(y) for _, y in findings]))


@functools.lru_cache(maxsize=1)
def default_forest() -> Forest:
    return fit(made_findings())


def judged(text: str, path: str, forest: Forest) -> list[tuple[str, int, int, float]]:
    return [(k, a, b, forest.probability(features(k, text[a:b], text[max(0, a - 80) : a], text[b : b + 40], path))) for k, a, b in candidates(text)]


def redacted(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


_FOUND = "struct<candidates: bigint, secrets: bigint, spans: string, clean: string>"


def _search(forest: Forest, threshold: float, mark: str | None):
    """Of text and path: the number of candidates and of secrets, the secrets' spans, and the text without them where there are any."""

    @F.arrow_udf(_FOUND)
    def search(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, paths in columns:
            n, kept, spans, clean = [], [], [], []
            for i, value in enumerate(texts.cast(pa.binary())):
                raw = value.as_py()
                found, text = [], ""
                if raw and _HINT.search(raw):
                    text = raw.decode("utf-8", "surrogatepass")
                    found = judged(text, paths[i].as_py() or "", forest)
                real = [f for f in found if f[3] >= threshold]
                n.append(len(found))
                kept.append(len(real))
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in real))
                clean.append(redacted(text, [(a, b) for _, a, b, _ in real], mark).encode("utf-8", "surrogatepass") if real and mark is not None else None)
            columns_ = [pa.array(n, pa.int64()), pa.array(kept, pa.int64()), pa.array(spans, pa.string()), pa.array(clean, pa.binary()).cast(pa.string())]
            yield pa.StructArray.from_arrays(columns_, ["candidates", "secrets", "spans", "clean"])

    return search


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, mark: str | None = None, path: str = "source") -> DataFrame:
    """docs with _candidates, _secrets and _spans (kind:start:end in code points), which replace columns of these names; with a mark, secrets in text become it.

    Only texts and paths go to Python; a text comes back where it changes.
    """
    found = docs.withColumn("_found", _search(forest or default_forest(), threshold, mark)(F.col("text"), F.col(f"`{path}`").cast("string")))
    if mark is not None:
        found = found.withColumn("text", F.coalesce("_found.clean", "text"))
    return found.withColumns({"_candidates": F.col("_found.candidates"), "_secrets": F.col("_found.secrets"), "_spans": F.col("_found.spans")}).drop("_found")


def redact(docs: DataFrame, mark: str = "<SECRET>", path: str = "source", **options) -> DataFrame:
    """All documents, their secrets replaced by mark, n_chars brought up to date."""
    out = scan(common.sealed(docs, "doc_id", "text", "n_chars", path), mark=mark, path=path, **options)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_secrets") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return common.opened(out.drop("_candidates", "_secrets", "_spans"), docs)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return scan(docs).select("doc_id", F.col("_candidates").alias("n_candidates"), F.col("_secrets").alias("n_secrets"), F.col("_spans").alias("spans"))
