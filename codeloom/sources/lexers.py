"""Parsers of source text: imports, exports, functions and classes per file.

Each parser works on text whose comments are blanked out and whose string literals
are kept aside, so that patterns only meet code. Lines count from 0; a declaration's
last line is that of its name, as its body isn't measured (body_spans measures it).
Any failure gives an empty result.
"""

from __future__ import annotations

import re

EMPTY = {"imports": [], "exports": [], "functions": [], "classes": []}

_C_LIKE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_RUST = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S)
_PYTHON = re.compile(r"#[^\n]*|[rbuRBU]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')", re.S)


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def code_of(text: str, pattern: re.Pattern, keep_strings: bool) -> str:
    """The text with comments, and strings unless kept, as blanks of equal length."""

    def swap(m: re.Match) -> str:
        s = m.group()
        comment = s.startswith(("//", "/*")) or s.startswith("#") and pattern is _PYTHON
        if comment or not keep_strings:
            return _blank(s) if comment else s[0] + _blank(s[1:-1]) + s[-1:]
        return s

    return pattern.sub(swap, text)


class _Source:
    def __init__(self, text: str, pattern: re.Pattern, body_spans: bool):
        self.plain = code_of(text, pattern, False)
        self.full = code_of(text, pattern, True)
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self.body_spans = body_spans

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, at) - 1

    def end_line(self, at: int) -> int:
        """Line where the braces that open next close; the line of `at` unless bodies are measured."""
        if not self.body_spans:
            return self.line(at)
        opened = self.plain.find("{", at)
        depth = 0
        for m in re.compile(r"[{}]").finditer(self.plain, opened if opened >= 0 else len(self.plain)):
            depth += 1 if m.group() == "{" else -1
            if depth == 0:
                return self.line(m.start())
        return self.line(at)

    def function(self, name: str, at: int, exported: bool = False, is_async: bool = False) -> dict:
        return {"name": name, "line_start": self.line(at), "line_end": self.end_line(at), "calls": [], "is_exported": exported, "is_async": is_async}

    def declared(self, name: str, at: int) -> dict:
        return {"name": name, "line_start": self.line(at), "line_end": self.end_line(at)}


def _import(specifier: str, line: int, kind: str = "static", symbols: list[str] | None = None) -> dict:
    return {"specifier": specifier, "resolved_path": None, "kind": kind, "symbols": symbols or [], "line": line}


def _unlike(items: list[dict], *keys: str) -> list[dict]:
    seen, out = set(), []
    for item in items:
        key = tuple(item[k] for k in keys)
        if key not in seen:
            seen.add(key)
            out.append(item)
    return out


_NAME = r"[A-Za-z_$\u0080-\uffff][\w$]*"
_TS_FROM = re.compile(r"(?<![\w$.])(import|export)\b([^;'\"`()]*?)\bfrom\s*(['\"])(.*?)\3", re.S)
_TS_BARE = re.compile(r"(?<![\w$.])import\s*(['\"])(.*?)\1")
_TS_DYNAMIC = re.compile(r"(?<![\w$.])import\s*\(\s*(['\"`])([^'\"`$]*?)\1")
_TS_EXPORT = re.compile(rf"(?<![\w$.])export\s+(?:declare\s+|abstract\s+)*(?:(async\s+)?function\s*\*?\s*|class\s+|(?:const|let)\s+)({_NAME})")
_TS_FUNCTION = re.compile(rf"(?<![\w$.])(export\s+(?:default\s+)?)?(async\s+)?function\s*\*?\s*({_NAME})\s*[<(]")
_TS_ARROW = re.compile(rf"(?<![\w$.])(export\s+)?(?:const|let|var)\s+({_NAME})\s*(?::[^=;\n]+)?=\s*(async\s*)?(?:function\b|(?:<[^>\n]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{{]+)?=>|{_NAME}\s*=>)")
_TS_CLASS = re.compile(rf"(?<![\w$.])class\s+({_NAME})")


def typescript(text: str, body_spans: bool = False) -> dict:
    s = _Source(text, _C_LIKE, body_spans)
    imports, exports = [], []
    for m in _TS_FROM.finditer(s.full):
        if not s.plain[m.start() : m.start() + 6].strip():
            continue
        if m.group(1) == "import":
            imports.append((m.start(), _import(m.group(4), s.line(m.start()))))
        else:
            exports.append((m.start(), {"symbol": m.group(4), "kind": "star", "line": s.line(m.start())}))
    for m in _TS_BARE.finditer(s.full):
        if s.plain[m.start() : m.start() + 6] == "import":
            imports.append((m.start(), _import(m.group(2), s.line(m.start()))))
    for m in _TS_DYNAMIC.finditer(s.full):
        if s.plain[m.start() : m.start() + 6] == "import":
            imports.append((m.start(), _import(m.group(2), s.line(m.start()), "dynamic")))
    for m in _TS_EXPORT.finditer(s.plain):
        exports.append((m.start(), {"symbol": m.group(2), "kind": "named", "line": s.line(m.start(2))}))
    functions = [(m.start(3), s.function(m.group(3), m.start(3), bool(m.group(1)), bool(m.group(2)))) for m in _TS_FUNCTION.finditer(s.plain)]
    functions += [(m.start(2), s.function(m.group(2), m.start(2), bool(m.group(1)), bool(m.group(3)))) for m in _TS_ARROW.finditer(s.plain)]
    order = lambda pairs: [x for _, x in sorted(pairs, key=lambda p: p[0])]
    return {"imports": order(imports), "exports": order(exports), "functions": _unlike(order(functions), "name", "line_start"), "classes": [s.declared(m.group(1), m.start(1)) for m in _TS_CLASS.finditer(s.plain)]}


_PY_IMPORT = re.compile(r"^[ \t]*(?:.*?[;:][ \t]*)?import[ \t]+([^\n;]+)", re.M)
_PY_FROM = re.compile(r"^[ \t]*(?:.*?[;:][ \t]*)?from[ \t]+(\.*)[ \t]*([\w.]*)[ \t]+import\b", re.M)
_PY_DEF = re.compile(r"^[ \t]*(async[ \t]+)?def[ \t]+(\w+)", re.M)
_PY_CLASS = re.compile(r"^[ \t]*class[ \t]+(\w+)", re.M)


def python(text: str, body_spans: bool = False) -> dict:
    """Dotted names become paths; relative ones stay as written; `import a as b` isn't captured."""
    s = _Source(text, _PYTHON, False)
    joined = re.sub(r"\\\n", "  ", s.plain)
    imports = []
    for m in _PY_IMPORT.finditer(joined):
        if re.search(r"\bfrom\b", joined[joined.rfind("\n", 0, m.start(1)) + 1 : m.start(1)]):
            continue
        at = m.start(1)
        for part in m.group(1).split(","):
            if re.fullmatch(r"\s*[\w.]+\s*", part) and part.strip():
                imports.append((at, _import(part.strip().replace(".", "/"), s.line(at))))
            at += len(part) + 1
    for m in _PY_FROM.finditer(joined):
        if m.group(1) or m.group(2):
            spec = m.group(1) + m.group(2) if m.group(1) else m.group(2).replace(".", "/")
            imports.append((m.start(1), _import(spec, s.line(m.start(1)))))

    def end(at: int) -> int:
        if not body_spans:
            return s.line(at)
        lines = text.split("\n")
        first = s.line(at)
        indent = len(lines[first]) - len(lines[first].lstrip())
        last = first
        for i in range(first + 1, len(lines)):
            if lines[i].strip():
                if len(lines[i]) - len(lines[i].lstrip()) <= indent and not lines[i].lstrip().startswith((")", "]")):
                    break
                last = i
        return last

    functions = [{"name": m.group(2), "line_start": s.line(m.start(2)), "line_end": end(m.start(2)), "calls": [], "is_exported": False, "is_async": bool(m.group(1))} for m in _PY_DEF.finditer(s.plain)]
    classes = [{"name": m.group(1), "line_start": s.line(m.start(1)), "line_end": end(m.start(1))} for m in _PY_CLASS.finditer(s.plain)]
    return {"imports": [x for _, x in sorted(imports, key=lambda p: p[0])], "exports": [], "functions": functions, "classes": classes}


_RS_USE = re.compile(r"(?<![\w$.])use\s+([^;]+);")
_RS_MOD = re.compile(r"(?<![\w$.])mod\s+(\w+)\s*[;{]")
_RS_EXTERN = re.compile(r"(?<![\w$.])extern\s+crate\s+(\w+)")
_RS_FN = re.compile(r"(?<![\w$.])(pub(?:\s*\([^)]*\))?\s+)?(?:(?:const|unsafe|extern(?:\s+\"[^\"]*\")?|async)\s+)*fn\s+(\w+)")
_RS_TYPE = re.compile(r"(?<![\w$.])(?:struct|enum|trait)\s+(\w+)")


def rust(text: str, body_spans: bool = False) -> dict:
    """use trees as written; mod m as ./m."""
    s = _Source(text, _RUST, body_spans)
    found = [(m.start(), _import(m.group(1).strip(), s.line(m.start(1)))) for m in _RS_USE.finditer(s.plain)]
    found += [(m.start(), _import("./" + m.group(1), s.line(m.start(1)))) for m in _RS_MOD.finditer(s.plain)]
    found += [(m.start(), _import(m.group(1), s.line(m.start(1)))) for m in _RS_EXTERN.finditer(s.plain)]
    functions = [s.function(m.group(2), m.start(2), bool(m.group(1)), "async" in m.group()) for m in _RS_FN.finditer(s.plain)]
    return {"imports": [x for _, x in sorted(found, key=lambda p: p[0])], "exports": [], "functions": _unlike(functions, "name", "line_start"), "classes": [s.declared(m.group(1), m.start(1)) for m in _RS_TYPE.finditer(s.plain)]}


_GO_IMPORT = re.compile(r"^[ \t]*import\s*(?:\((.*?)\)|([^\n]*))", re.S | re.M)
_GO_STRING = re.compile(r"\"([^\"\n]*)\"")
_GO_FUNC = re.compile(r"^[ \t]*func\s*(?:\([^)]*\)\s*)?(\w+)\s*[\[(]", re.M)
_GO_TYPE = re.compile(r"^[ \t]*type\s+(?:\((.*?)^[ \t]*\)|(\w+))", re.S | re.M)


def go(text: str, body_spans: bool = False) -> dict:
    """Import paths once each; only quoted ones; exported by a capital."""
    s = _Source(text, _C_LIKE, body_spans)
    imports = []
    for m in _GO_IMPORT.finditer(s.full):
        if s.plain[m.start() : m.end()].lstrip()[:6] == "import":
            group = 1 if m.group(1) is not None else 2
            for q in _GO_STRING.finditer(s.full, m.start(group), m.end(group)):
                imports.append(_import(q.group(1), s.line(q.start())))
    functions = [s.function(m.group(1), m.start(1), m.group(1)[0].isupper()) for m in _GO_FUNC.finditer(s.plain)]
    classes = []
    for m in _GO_TYPE.finditer(s.plain):
        if m.group(2):
            classes.append(s.declared(m.group(2), m.start(2)))
        else:
            depth = 0
            for line in re.finditer(r"[^\n]*\n?", m.group(1)):
                name = re.match(r"\s*(\w+)\s+\S", line.group())
                if name and depth == 0:
                    classes.append(s.declared(name.group(1), m.start(1) + line.start() + name.start(1)))
                depth += line.group().count("{") - line.group().count("}")
    return {"imports": _unlike(imports, "specifier"), "exports": [], "functions": functions, "classes": classes}


_JAVA_IMPORT = re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.]+?)(?:\s*\.\s*\*)?\s*;", re.M)
_JAVA_TYPE = re.compile(r"(?<![\w$.@])(?:class|interface)\s+(\w+)")
_JAVA_METHOD = re.compile(r"(?:^|[;{}\n]|\*/)[ \t]*((?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+|@\w+(?:\([^)]*\))?\s+)*)(?:<[^>{};]+>\s*)?([\w.$]+(?:<[^;{}()]*>)?(?:\s*\[\s*\])*)\s+(\w+)\s*\([^(){};]*(?:\([^()]*\)[^(){};]*)*\)\s*(?:throws\s+[\w.,\s]+)?\s*[{;]")
_JAVA_NOT_TYPES = frozenset("public protected private static final abstract synchronized native default strictfp return new throw else case package import class interface assert do goto yield".split())


def java(text: str, body_spans: bool = False) -> dict:
    """Imports once each, wildcards as the package; classes, interfaces and methods, no constructors."""
    s = _Source(text, _C_LIKE, body_spans)
    imports = _unlike([_import(m.group(1), s.line(m.start(1))) for m in _JAVA_IMPORT.finditer(s.plain) if "." in m.group(1)], "specifier")
    functions, at = [], 0
    while m := _JAVA_METHOD.search(s.plain, at):
        if m.group(2) not in _JAVA_NOT_TYPES:
            functions.append(s.function(m.group(3), m.start(3), "public" in (m.group(1) or "")))
        at = m.end() - 1 if m.end() - 1 > at else m.end()
    return {"imports": imports, "exports": [], "functions": functions, "classes": [s.declared(m.group(1), m.start(1)) for m in _JAVA_TYPE.finditer(s.plain)]}


_PARSERS = {"typescript": typescript, "python": python, "rust": rust, "go": go, "java": java}


def parse(language: str | None, text: str | None, body_spans: bool = False) -> dict:
    """By language; unknown languages and failures give the empty result."""
    try:
        return _PARSERS[language](text.lstrip("\ufeff") if text else "", body_spans)
    except Exception:
        return {k: [] for k in EMPTY}
