"""Code elements of source files: declarations, imports, calls, markup, one row each.

Python uses its own syntax tree where the file parses; the other languages use a scanner
that blanks out comments and strings, finds declarations by pattern and scopes by braces.
Markup and style sheets are read by patterns. Coverage per language: classes and types with
their bases, functions and methods, imports, calls; components and hooks for JavaScript.

Defined results: null or empty contents and unknown languages give no rows; ids are
assigned from the file and the order in it.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.sources.scan import LANGUAGES

SCHEMA = pa.schema(
    [("file_id", pa.int64()), ("file_path", pa.string()), ("language", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
     ("parent_context", pa.string()), ("detail", pa.string()), ("signature", pa.string()), ("documentation", pa.string())]
)
DDL = "file_id bigint, file_path string, language string, ordinal int, kind string, name string, start_line int, end_line int, parent_context string, detail string, signature string, documentation string"

_BLANK = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*(?:\.|::|->))*[A-Za-z_]\w*!?)\s*\(")
# Words before a round bracket that are no calls.
NO_CALLS = frozenset("if for while switch catch return function sizeof match elif except and or not in fn func def new await typeof synchronized super throw assert with print else do case".split())

_NAME = r"([A-Za-z_]\w*)"
# Per language (kind, pattern with the name first, group of the bases or None).
DECLARATIONS: dict[str, list[tuple[str, re.Pattern, int | None]]] = {
    "C": [("Struct", re.compile(rf"^[ \t]*(?:typedef\s+)?struct\s+{_NAME}\s*\{{", re.M), None), ("Function", re.compile(rf"^[ \t]*(?:[A-Za-z_][\w \t]*[\s*]+)\**{_NAME}\s*\(([^;{{}}]*)\)\s*\{{", re.M), None)],
    "C++": [
        ("Class", re.compile(rf"^[ \t]*class\s+{_NAME}(?:\s*final)?(?:\s*:\s*([^{{;]*))?\s*\{{", re.M), 2), ("Struct", re.compile(rf"^[ \t]*struct\s+{_NAME}(?:\s*:\s*([^{{;]*))?\s*\{{", re.M), 2),
        ("Function", re.compile(r"^[ \t]*(?:[A-Za-z_][\w \t:<>,&*]*[\s*&]+)((?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*)\s*\(([^;{}]*)\)[^;{}=]*\{", re.M), None),
    ],
    "Java": [
        ("Class", re.compile(rf"\b(?:class|enum|record)\s+{_NAME}[^{{;]*?(?:\bextends\s+([\w.<>, ]+?))?\s*(?:\bimplements\s+([\w.<>, ]+?))?\s*\{{"), 2), ("Interface", re.compile(rf"\binterface\s+{_NAME}(?:\s+extends\s+([\w.<>, ]+))?\s*\{{"), 2),
        ("Method", re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+(?:[\w<>\[\], ?.]+\s+)?{_NAME}\s*\(([^;{{}}]*)\)\s*(?:throws[^{{]*)?\{{", re.M), None),
    ],
    "Go": [
        ("Struct", re.compile(rf"^type\s+{_NAME}(?:\[[^\]]*\])?\s+struct\s*\{{", re.M), None), ("Interface", re.compile(rf"^type\s+{_NAME}(?:\[[^\]]*\])?\s+interface\s*\{{", re.M), None),
        ("Function", re.compile(rf"^func\s+(?:\(([^)]*)\)\s*)?{_NAME}\s*\(", re.M), None),
    ],
    "Rust": [
        ("Struct", re.compile(rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+{_NAME}", re.M), None), ("Interface", re.compile(rf"^[ \t]*(?:pub\s+)?trait\s+{_NAME}", re.M), None),
        ("Function", re.compile(rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+{_NAME}", re.M), None),
    ],
    "JavaScript": [
        ("Class", re.compile(rf"\bclass\s+{_NAME}(?:<[^>{{]*>)?(?:\s+extends\s+([\w.]+))?(?:<[^>{{]*>)?(?:\s+implements\s+([\w.<>, ]+?))?\s*\{{"), 2), ("Interface", re.compile(rf"^[ \t]*(?:export\s+)?(?:interface|type)\s+{_NAME}", re.M), None),
        ("Function", re.compile(rf"\bfunction\s*\*?\s*{_NAME}\s*(?:<[^>]*>)?\("), None), ("Function", re.compile(rf"\b(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::\s*[\w<>\[\], ]+)?=>"), None),
        ("Method", re.compile(rf"^[ \t]+(?:(?:static|async|public|private|protected|get|set)\s+)*{_NAME}\s*\([^;{{}}()]*\)\s*(?::\s*[\w<>\[\], ]+)?\s*\{{", re.M), None),
    ],
}
DECLARATIONS["TypeScript"] = DECLARATIONS["JavaScript"]
_IMPORTS = {
    "C": re.compile(r"^[ \t]*(#\s*include\s*[<\"][^>\"\n]+[>\"])", re.M), "Java": re.compile(r"^[ \t]*(import\s+(?:static\s+)?[\w.*]+)\s*;", re.M), "Rust": re.compile(r"^[ \t]*((?:pub\s+)?(?:use|mod)\s+[^;{]+)", re.M),
    "JavaScript": re.compile(r"^[ \t]*((?:import|export)\b[^;\n]*?['\"][^'\"\n]+['\"])|(require\(\s*['\"][^'\"]+['\"]\s*\))", re.M),
}
_IMPORTS["C++"], _IMPORTS["TypeScript"] = _IMPORTS["C"], _IMPORTS["JavaScript"]


def clean_documentation(text: str, most: int = 300) -> str:
    """Comment without its marks, white space collapsed, at most ``most`` characters."""
    lines = [re.sub(r"^\s*(?:///?!?|/\*\*?|\*/|\*|#+|\"\"\"|''')\s?|\s*(?:\*/|\"\"\"|''')\s*$", "", x) for x in text.splitlines()]
    flat = " ".join(" ".join(lines).split())
    return flat if len(flat) <= most else flat[:most] + "..."


def _blank(text: str) -> str:
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _block_end(text: str, at: int) -> int:
    """Place after the block whose bracket opens at or after ``at``; the end of the line where none does before a semicolon."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(text, at):
        if m.group() == "{":
            depth += 1
        elif m.group() == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif depth == 0:
            return m.end()
    return len(text)


def _comment_above(lines: list[str], line: int) -> str:
    found = []
    while line > 1 and re.match(r"\s*(//|/\*|\*|#(?!\s*include))", lines[line - 2]):
        line -= 1
        found.append(lines[line - 1])
    return clean_documentation("\n".join(reversed(found)))


def _braces(text: str, language: str, markup: bool = False) -> list[tuple]:
    plain, lines = _blank(text), text.splitlines()
    starts = [m.end() for m in re.finditer("\n", text)]
    import bisect

    line_of = lambda p: bisect.bisect_right(starts, p) + 1
    out, scopes, taken = [], [], set()
    for kind, pattern, bases in DECLARATIONS[language]:
        for m in pattern.finditer(plain):
            group = 2 if language == "Go" and kind == "Function" else 1
            name, at = m.group(group), m.start(group)
            if name in NO_CALLS or at in taken:
                continue
            taken.add(at)
            end = _block_end(plain, m.end() - 1 if m.group().endswith("{") else m.end())
            context, detail = "", ""
            if language == "Go" and kind == "Function" and m.group(1):
                context, kind_now = m.group(1).split()[-1].lstrip("*"), "Method"
            else:
                kind_now = "Method" if "::" in name else kind
            if bases and m.group(bases):
                detail = "extends: " + re.sub(r"\s+", " ", re.sub(r"\b(?:public|private|protected|virtual)\b", "", m.group(bases))).strip()
            if bases and pattern.groups > bases and m.group(bases + 1):
                detail += ("; " if detail else "") + "implements: " + re.sub(r"\s+", " ", m.group(bases + 1)).strip()
            if language in ("JavaScript", "TypeScript") and kind == "Function" and name[0].isupper():
                kind_now = "Component"
            scopes.append((at, end, name, kind_now, context, detail, text[m.start() : m.end()].strip().split("\n")[-1].rstrip("{ ")))
    if language == "Rust":
        scopes += [(m.start(), _block_end(plain, m.end()), m.group(1), "", "", "", "") for m in re.finditer(r"^[ \t]*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)", plain, re.M)]
    scopes.sort()
    stack: list[tuple] = []
    for at, end, name, kind, context, detail, signature in scopes:
        while stack and stack[-1][0] <= at:
            stack.pop()
        parent = context or (stack[-1][1] if stack else "")
        if kind:
            inside = bool(stack) and stack[-1][2] in ("Class", "Struct", "Interface", "")
            kind = "Method" if kind == "Function" and inside else kind
            out.append((at, kind, name, line_of(at), line_of(max(at, end - 1)), parent, detail, signature, _comment_above(lines, line_of(at))))
        stack.append((end, name, kind))
    if language in _IMPORTS:
        for m in _IMPORTS[language].finditer(text):
            found = next(g for g in m.groups() if g)
            out.append((m.start(), "Include", found.strip(), line_of(m.start()), line_of(m.end() - 1), "", "", "", ""))
    if language == "Go":
        for m in re.finditer(r"^import\s*(?:\(([^)]*)\)|(\"[^\"]+\"))", text, re.M):
            out += [(m.start() + k, "Include", s, line_of(m.start()), line_of(m.end() - 1), "", "", "", "") for k, s in enumerate(re.findall(r"\"[^\"]+\"", m.group()))]
    ends = [(a, e, n) for a, e, n, k, *_ in scopes if k in ("Function", "Method", "Component")]
    for m in _CALL.finditer(plain):
        name = m.group(1)
        if re.split(r"\.|::|->", name)[-1] in NO_CALLS or m.start(1) in taken or m.end(1) - len(re.split(r"\.|::|->", name)[-1]) in taken:
            continue
        owner = max(((a, n) for a, e, n in ends if a <= m.start() < e), default=(0, ""))[1]
        kind = "Hook" if language in ("JavaScript", "TypeScript") and re.match(r"use[A-Z]", name) else "Call"
        out.append((m.start(), kind, name, line_of(m.start()), line_of(m.start()), owner, "", "", ""))
    if markup:
        for m in _JSX.finditer(plain):
            owner = max(((a, n) for a, e, n in ends if a <= m.start() < e), default=(0, ""))[1]
            line = line_of(m.start())
            out.append((m.start(), "JSXComponent" if m.group(1)[0].isupper() else "JSXElement", m.group(1), line, line, owner, "", "", ""))
            out += [(m.start(), kind, name, line, line, m.group(1), value, "", "") for kind, name, value in _attributes(text[m.start(2) : m.end(2)])]
    return [x[1:] for x in sorted(out, key=lambda x: x[0])]


def _python(text: str) -> list[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
    out: list[tuple] = []

    def walk(node: ast.AST, parent: str, inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                bases = ", ".join(ast.unparse(b) for b in child.bases)
                out.append(("Class", child.name, child.lineno, child.end_lineno, parent, f"extends: {bases}" if bases else "", "", clean_documentation(ast.get_docstring(child) or "")))
                walk(child, child.name, True)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("Method" if inside else "Function", child.name, child.lineno, child.end_lineno, parent, "", f"def {child.name}({ast.unparse(child.args)})", clean_documentation(ast.get_docstring(child) or "")))
                walk(child, child.name, True)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                out.append(("Include", ast.unparse(child), child.lineno, child.end_lineno, parent, "", "", ""))
            else:
                if isinstance(child, ast.Call):
                    out.append(("Call", ast.unparse(child.func), child.lineno, child.end_lineno, parent, "", "", ""))
                walk(child, parent, inside)

    walk(tree, "", False)
    return out


_JSX = re.compile(r"(?<![\w)\]])<([A-Za-z][\w.]*)((?:\s+[\w:-]+(?:\s*=\s*(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|[^\s>{]*\s*))?)*)\s*/?>")


def _attributes(text: str) -> list[tuple[str, str, str]]:
    """Attributes of a tag with their values, and the tokens of its classes: kind, name, value."""
    out = []
    for a in re.finditer(r"([\w:@.-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|\{[^{}]*\}|[^\s>]+))?", text):
        value = (a.group(2) or "").strip("{}").strip().strip("\"'`")
        out.append(("Attribute", a.group(1), value))
        if a.group(1) in ("class", "className"):
            out += [("UtilityClass", c, "") for c in value.split()]
    return out


def _markup(text: str) -> list[tuple]:
    out = []
    for m in re.finditer(r"<([A-Za-z][\w-]*)((?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?)*)\s*/?>", text):
        line = text.count("\n", 0, m.start()) + 1
        out.append(("JSXElement", m.group(1), line, line, "", "", "", ""))
        out += [(kind, name, line, line, m.group(1), value, "", "") for kind, name, value in _attributes(m.group(2))]
    return out


def _styles(text: str) -> list[tuple]:
    out, plain = [], re.sub(r"/\*[\s\S]*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    line = lambda p: plain.count("\n", 0, p) + 1
    out += [("Include", " ".join(m.group().split()), line(m.start()), line(m.start()), "", "", "", "") for m in re.finditer(r"@[a-z-]+[^;{}]*;?", plain)]
    for m in re.finditer(r"([^{}@;]+)\{([^{}]*)\}", plain):
        name = " ".join(m.group(1).split())
        out.append(("Selector", name, line(m.start(1)), line(m.end()), "", "", "", ""))
        out += [("Property", p.group(1), line(m.start(2) + p.start()), line(m.start(2) + p.start()), name, p.group(2).strip(), "", "") for p in re.finditer(r"([\w-]+)\s*:\s*([^;]+)", m.group(2))]
    return out


def route(path: str) -> str | None:
    """Kind of route that a path stands for by the conventions of page folders."""
    m = re.search(r"(?:^|/)app/(?:.*/)?(page|layout|route|loading|error)\.[jt]sx?$", path)
    if m:
        return m.group(1) + (":dynamic" if "[" in path else "")
    m = re.search(r"(?:^|/)pages/(api/)?.+\.[jt]sx?$", path)
    return ("api" if m.group(1) else "page") + (":dynamic" if "[" in path else "") if m else None


def parse_source(text: str | None, language: str | None, path: str = "") -> list[tuple]:
    """Elements of one file: kind, name, lines, context, detail, signature, documentation."""
    if not text or not language:
        return []
    if language == "Python":
        found = _python(text)
    elif language in DECLARATIONS:
        found = _braces(text, language, path.lower().endswith(("x", ".js")) and language in ("JavaScript", "TypeScript"))
    elif language == "HTML":
        found = _markup(text)
    elif language == "CSS":
        found = _styles(text)
    else:
        return []
    kind = route(path)
    return [("Route", path, 1, text.count("\n") + 1, "", kind, "", ""), *found] if kind else found


def parse_language(path: str | None) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), (None, None))[1] if path and "." in path else None


def elements(files: DataFrame) -> DataFrame:
    """All elements of ``file_id, path, content``, with ``element_id`` from the file and the order in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file_id, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                language = parse_language(path)
                out += [(file_id, path, language, k, *e) for k, e in enumerate(parse_source(content, language, path or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)

    found = files.select("file_id", "path", "content").mapInArrow(run, DDL).dropDuplicates(["file_id", "ordinal"])
    return found.withColumn("element_id", F.shiftleft(F.col("file_id"), 20) + F.col("ordinal"))


# Kinds that make a unit.
PRIMARY = ("Class", "Struct", "Interface", "Function", "Method", "Component", "Hook", "Route")


def owned(kinds: list[str], names: list[str], contexts: list[str], starts: list[int], ends: list[int]) -> list[int | None]:
    """For each element of a file the place of its unit: a primary itself, else the innermost primary that names or encloses it, the first on ties."""
    primary = [i for i, k in enumerate(kinds) if k in PRIMARY]
    primary.sort(key=lambda i: (ends[i] - starts[i], i))
    out: list[int | None] = [i if k in PRIMARY else None for i, k in enumerate(kinds)]
    if not primary:
        return out
    order, s, t = np.array(primary), np.array([starts[i] for i in primary]), np.array([ends[i] for i in primary])
    named: dict[str, int] = {}
    for j, i in enumerate(primary):
        named.setdefault(names[i], j)
    for i, k in enumerate(kinds):
        if k not in PRIMARY:
            inside = (s <= starts[i]) & (ends[i] <= t)
            j = int(inside.argmax())
            places = [j] if inside[j] else []
            if contexts[i] and contexts[i] in named:
                places.append(named[contexts[i]])
            if places:
                out[i] = int(order[min(places)])
    return out


def searchable(files: DataFrame) -> DataFrame:
    """All elements of ``file_id, repo_name, path, content`` with the ``repo_name`` and the ``unit_id`` of each, and one of kind ``File`` for each file that holds none, under the id of its module; files are parsed once."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    schema = pa.schema([*SCHEMA, ("element_id", pa.int64()), ("repo_name", pa.string()), ("unit_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file_id, repo, path, content, stem, ending in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                language = parse_language(path)
                found = parse_source(content, language, path or "")
                unit = owned(*([e[i] for e in found] for i in (0, 1, 4, 2, 3)))
                module = None if any(u is not None for u in unit) else -file_id - 1
                ids = [module if u is None else (file_id << 20) + u for u in unit]
                out += [(file_id, path, language, k, *e, (file_id << 20) + k, repo, u) for k, (e, u) in enumerate(zip(found, ids, strict=True))]
                if not found and path is not None:
                    out.append((file_id, path, None, 0, "File", stem, 1, 1, "", ending, "", "", -file_id - 1, repo, -file_id - 1))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    rows = files.select("file_id", "repo_name", "path", "content").dropDuplicates(["file_id"])
    named = rows.select("*", F.regexp_replace(base, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1)).alias("ending"))
    return named.mapInArrow(run, f"{DDL}, element_id bigint, repo_name string, unit_id bigint")


def html_tags(html: Column) -> Column:
    """Names of the tags of a text of markup, as one expression."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"<([A-Za-z][A-Za-z0-9-]*)"), F.lit(1)), F.lower)


def of_kind(found: DataFrame, *kinds: str) -> DataFrame:
    return found.where(F.col("kind").isin(*kinds))
