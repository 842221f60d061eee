"""Listing source trees (S1-S6): ignore rules of a folder and of all above it, listings made by executors in rounds."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.plans import loops

#: Entries that a task lists before it hands on the folders it hasn't entered.
BUDGET = 20_000
#: Names of ignore files, in the order in which they count.
IGNORE_FILES = (".gitignore", ".ignore")


@dataclass(frozen=True)
class ScanOptions:
    """include: languages; exclude: globs; depth: levels of files (1: those in the root, 0: none); above: rules of folders above the root and of the user count too."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    depth: int | None = None
    hidden: bool = False
    ignore_files: bool = True
    body_spans: bool = False
    above: bool = True


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over whole relative paths: ** crosses directories, * and ? don't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out


def exclude_regex(pattern: str) -> str:
    """--exclude: a glob without a slash meets any path segment, and all below a directory it meets."""
    body = glob_regex(pattern.strip("/"))
    return f"^(?:{body})(?:/.*)?$" if "/" in pattern.strip("/") else f"^(?:.*/)?(?:{body})(?:/.*)?$"


@dataclass(frozen=True)
class IgnoreRule:
    """base: the rule file's directory below the root; above: the root's path below the rule file's directory, with a slash at its end."""

    base: str
    regex: str
    negated: bool
    above: str = ""


def ignore_rules(text: str, base: str = "", above: str = "") -> list[IgnoreRule]:
    """S3: the rules of one ignore file, in order. A path of a directory ends in a slash."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        line = line[1:] if line.startswith("\\") else line
        only_dir = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = glob_regex(line.lstrip("/"))
        head = re.escape(base + "/") if base else ""
        tail = "/.*" if only_dir else "(?:/.*)?"
        out.append(IgnoreRule(base, f"^{head}{'' if anchored else '(?:.*/)?'}{body}{tail}$", negated, above))
    return out


def ignored(path: str, rules: list[IgnoreRule]) -> bool:
    """Whether the last rule that meets path ignores it. Rules of deeper files come later in the list."""
    out = False
    for rule in rules:
        if re.search(rule.regex, rule.above + path):
            out = not rule.negated
    return out


def _text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def _user_rules() -> str:
    """What the user ignores everywhere: core.excludesFile, else git/ignore among the settings."""
    home = os.path.expanduser("~")
    settings = os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    for config in (os.path.join(home, ".gitconfig"), os.path.join(settings, "git", "config")):
        if found := re.search(r"(?im)^\s*excludesfile\s*=\s*\"?([^\"\r\n]+?)\"?\s*$", _text(config) or ""):
            return _text(os.path.expanduser(found.group(1))) or ""
    return _text(os.path.join(settings, "git", "ignore")) or ""


def rules_above(root: str) -> list[IgnoreRule]:
    """The rules that hold in the root before its own: the user's, the repository's exclude file, those of folders above, the nearest last.

    Above the repository's top folder only .ignore counts. An exclude file's rules are relative to the top folder.
    """
    root = os.path.abspath(root)
    out: list[IgnoreRule] = []
    at, below, in_repository, top = root, "", True, None
    while True:
        if below:
            own: list[IgnoreRule] = []
            for name in IGNORE_FILES:
                if name == ".ignore" or in_repository:
                    own += ignore_rules(_text(os.path.join(at, name)) or "", above=below)
            out = own + out
        if in_repository and os.path.isdir(os.path.join(at, ".git")):
            in_repository, top = False, (at, below)
        parent = os.path.dirname(at)
        if parent == at:
            break
        at, below = parent, os.path.basename(at) + "/" + below
    exclude = ignore_rules(_text(os.path.join(top[0], ".git", "info", "exclude")) or "", above=top[1]) if top else []
    return ignore_rules(_user_rules()) + exclude + out


def language_of(name: str) -> str | None:
    stem, dot, ext = name.rpartition(".")
    return next((lang for lang, names in scalars.EXTENSIONS.items() if dot and stem and ext in names), None)


File = tuple[str, str, int, int]
"""relative path, language, size, time of change in nanoseconds"""


def folder(root: str, base: str, rules: list[IgnoreRule], options: ScanOptions) -> tuple[list[File], list[tuple[str, list[IgnoreRule]]], int]:
    """Files of a folder, its folders that may be entered with the rules that hold there, and the number of its entries."""
    excludes = [re.compile(exclude_regex(p)) for p in options.exclude]
    found: list[File] = []
    inner: list[tuple[str, list[IgnoreRule]]] = []
    try:
        entries = sorted(os.scandir(os.path.join(root, base)), key=lambda e: e.name)
    except OSError:
        return found, inner, 0
    if options.ignore_files:
        for name in IGNORE_FILES:
            if any(e.name == name for e in entries) and (text := _text(os.path.join(root, base, name))) is not None:
                rules = rules + ignore_rules(text, base)
    for e in entries:
        path = f"{base}/{e.name}" if base else e.name
        if e.name == ".git" or (e.name.startswith(".") and not options.hidden) or any(x.search(path) for x in excludes):
            continue
        levels = path.count("/") + 1
        if e.is_dir(follow_symlinks=False):
            if (options.depth is None or levels < options.depth) and not ignored(path + "/", rules):
                inner.append((path, rules))
        elif (language := language_of(e.name)) and (options.depth is None or levels <= options.depth):
            if (not options.include or language in options.include) and e.is_file() and not ignored(path, rules):
                try:
                    stat = e.stat()
                except OSError:
                    continue  # gone since
                found.append((path, language, stat.st_size, stat.st_mtime_ns))
    return found, inner, len(entries)


def _start(root: str, options: ScanOptions) -> list[IgnoreRule]:
    return rules_above(root) if options.ignore_files and options.above else []


def walk(root: str, options: ScanOptions = ScanOptions()) -> Iterator[File]:
    """All files below root in this process, by folders; folders that the options rule out aren't entered."""
    work = [("", _start(root, options))]
    while work:
        found, inner, _ = folder(root, *work.pop(), options)
        work += inner
        yield from found


def _packed(rules: list[IgnoreRule]) -> str:
    return json.dumps([[r.base, r.regex, r.negated, r.above] for r in rules])


def _unpacked(text: str) -> list[IgnoreRule]:
    return [IgnoreRule(*r) for r in json.loads(text)]


def _round(root: str, options: ScanOptions, budget: int):
    """Folders -> their files, and of the folders below those that are left when the budget is spent."""

    def task(batches: Iterator) -> Iterator:
        import pandas as pd

        columns = ("path", "language", "size", "mtime", "rules")
        work, seen = [], 0
        for batch in batches:
            work += [(p, _unpacked(r)) for p, r in zip(batch["path"], batch["rules"], strict=True)]
        at = 0
        while at < len(work) and seen < budget:
            rows: list[tuple] = []
            while at < len(work) and seen < budget and len(rows) < 5000:
                found, inner, entries = folder(root, *work[at], options)
                rows += [(*f, None) for f in found]
                work += inner
                seen, at = seen + 1 + entries, at + 1
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame([(p, None, None, None, _packed(r)) for p, r in work[at:]], columns=columns)

    return task


def listing(spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), budget: int = BUDGET) -> DataFrame:
    """Table (path, language, size, mtime) of what walk() gives, listed by executors.

    A round's tasks each take some folders, with the rules that hold in them, enter
    the folders below, and hand on those they don't come to; the next round deals
    these out anew. The root must be a folder that all machines see.
    """
    root = os.path.abspath(root)
    schema = "path string, language string, size long, mtime long, rules string"
    work = spark.createDataFrame([("", _packed(_start(root, options)))], "path string, rules string")
    parts = 1
    out = None
    while True:
        found = loops.saved(work.repartition(parts).mapInPandas(_round(root, options, budget), schema), "listing")
        files = found.filter(F.col("language").isNotNull()).drop("rules")
        out = files if out is None else out.unionByName(files)
        work = found.filter(F.col("language").isNull()).select("path", "rules")
        left = work.count()
        if not left:
            return out
        parts = min(left, 8 * spark.sparkContext.defaultParallelism)
