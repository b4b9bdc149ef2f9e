"""Source files that do not parse: packrat parsing-expression grammars per language.

A file is cut into tokens by its language's lexer, the tokens become symbols, and the
grammar of the language must consume all of them. For a file that does not parse the
furthest place at which the grammar failed is reported with the cause: markers of a merge
conflict, an end inside an open construct (``truncated``), a token that the language does
not have (``lexical``), brackets that do not pair (``bracket``), or else ``syntax``.

The language is that of the ending of the path. Defined results: null contents and
endings of no known language are not judged; empty and blank files are valid; repeated
rows of a file come out once.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import grammars as G
from tesserae.llm.peg import AUTO, BAD, FIRST_LINE, ID, LAST_LINE, NUM, STR, TPL, Grammar

# Endings of paths and their languages.
LANGUAGES = {
    "py": "Python", "js": "JavaScript", "mjs": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript",
    "java": "Java", "go": "Go", "rs": "Rust", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "hpp": "C++",
}
# Directives of the C preprocessor.
DIRECTIVES = re.compile(r"\s*#\s*(?:include|include_next|define|undef|if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|pragma|error|warning|line|import|embed|\d+)?(?![A-Za-z])")

_LINE_COMMENT, _BLOCK_COMMENT = r"//[^\n]*", r"/\*[\s\S]*?\*/"
_OPEN_COMMENT = r"/\*[\s\S]*"
_WORD = r"[^\W\d]\w*"
_NUMBER = r"(?:\d\w*(?:\.(?!\.)\w*)?|\.\d\w*)(?:(?<=[eEpP])[+-]\d\w*)?"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_GOOD_NUMBER = re.compile(r"(?:0[xX][\da-fA-F_']+(?:\.?[\da-fA-F]*[pP][+-]?\d+)?|0[bB][01_']+|0[oO][0-7_]+|[\d][\d_']*\.?[\d_]*(?:[eE][+-]?[\d_]+)?|\.[\d_]+(?:[eE][+-]?\d+)?)(?:[uUlLfFdDnjJzZ]{0,3}|i|[iuf](?:8|16|32|64|128|size))")


def _operators(listed: str) -> str:
    return "|".join(re.escape(o) for o in sorted(listed.split(), key=len, reverse=True))


def _pattern(*parts: str, operators: str = G.OPERATORS) -> re.Pattern:
    return re.compile("|".join([*parts, _operators(operators), r"\S"]))


_RAW = re.compile(r'(?:L|u8|u|U)?R"([^()\\\s]{0,16})\([\s\S]*?\)\1"')


class Language:
    """Lexer and grammar of a language; ``parses`` keeps memos across files."""

    def __init__(self, name: str, grammar: Grammar, pattern: re.Pattern, lines: str = ""):
        self.name, self.grammar, self.pattern, self.lines = name, grammar, pattern, lines
        self.known: dict[str, str] = {}
        symbols = grammar.symbols
        if lines == "auto":
            ends = "".join(re.escape(symbols[w]) for w in "this super null true false return break continue ++ -- of from as get set static async".split()) + ID + NUM + STR + TPL
            begins = set(symbols) - set("in instanceof of as else catch finally from extends implements satisfies is".split())
            begins = "".join(re.escape(symbols[w]) for w in begins if w[0].isalpha() or w in ("@", "#", "!", "~")) + ID + NUM + STR
            self.ends = re.compile(f"(?<=[{ends})\\]}}])n+(?=[{begins}])")
        elif lines == "semicolon":
            ends = "".join(re.escape(symbols[w]) for w in "break continue fallthrough return ++ --".split()) + ID + NUM + STR + TPL
            self.ends = re.compile(f"(?<=[{ends})\\]}}])n+")

    def symbol(self, token: str) -> str:
        """The symbol of a token; nothing for a comment."""
        first, name, known = token[0], self.name, self.grammar.symbols
        if token in known:
            return known[token]
        if first == "\n":
            if self.lines != "indent":
                return "n"
            width = 0
            for c in token[1:]:
                width = (width // 8 + 1) * 8 if c == "\t" else width + 1
            return chr(min(ord(FIRST_LINE) + width, ord(LAST_LINE)))
        if token.startswith(("//", "/*")) and name != "Python":
            return "" if first != "/" or token[1] == "/" or (token.endswith("*/") and len(token) > 3) else BAD
        if first == "#" and name == "Python":
            return ""
        if name in ("C", "C++") and "#" in token[: len(token) - len(token.lstrip()) + 1]:
            return "" if DIRECTIVES.match(token) else BAD
        if first.isdigit() or (first == "." and len(token) > 1 and token[1].isdigit()):
            if not _GOOD_NUMBER.fullmatch(token) or (name == "Python" and re.fullmatch(r"0\d*[1-9]\d*", token)):
                return BAD
            return NUM
        last = token[-1]
        if name == "Rust" and first == "'" and not (last == "'" and len(token) > 2):
            return TPL if len(token) > 1 else BAD
        if last == "`" and first == "`" and len(token) > 1:
            return STR if name == "Go" else TPL
        if name in ("JavaScript", "TypeScript") and "/" in token and len(token) > 2 and first not in "\"'":
            return known.get(first, first) + STR if first != "/" else STR
        if last in "\"'#" and len(token) > 1:
            return STR
        if first.isidentifier() or first == "$":
            return ID
        if token == "\\\n" or token == "\\\r\n":
            return ""
        return first if first in "()[]{}" else BAD

    def symbols(self, text: str) -> str:
        known, out = self.known, []
        for token in self.pattern.findall(text):
            s = known.get(token)
            if s is None:
                s = self.symbol(token)
                if len(token) < 40:
                    if len(known) > 500_000:
                        known.clear()
                    known[token] = s
            out.append(s)
        return self.settle("".join(out))

    def settle(self, s: str) -> str:
        """Turn line ends into the terminators they stand for."""
        if self.lines == "auto":
            return self.ends.sub(AUTO, s).replace("n", "")
        if self.lines == "semicolon":
            return self.ends.sub(self.grammar.symbols[";"], s).replace("n", "")
        return s

    def settled(self, symbols: list[str], places: list[int]) -> tuple[list[str], list[int]]:
        """``settle`` on single symbols that keep their places."""
        if self.lines not in ("auto", "semicolon"):
            return symbols, places
        mark = AUTO if self.lines == "auto" else self.grammar.symbols[";"]
        for m in self.ends.finditer("".join(symbols)):
            symbols[m.start()] = mark
        keep = [i for i, c in enumerate(symbols) if c != "n"]
        return [symbols[i] for i in keep], [places[i] for i in keep]

    def prepared(self, text: str) -> str:
        """The text with raw strings blanked out, of the same length."""
        if self.name == "C++" and 'R"' in text:
            return _RAW.sub(lambda m: '"' + " " * (len(m.group()) - 2) + '"', text)
        return "\n" + text if self.lines == "indent" else text

    def parses(self, text: str) -> bool:
        s = self.symbols(self.prepared(text))
        if BAD in s:
            return False
        s = self.grammar.reduce(s)
        if any(c in s for c in "()[]{}"):
            return False
        return blocks().parses(self.grammar, s) if self.lines == "indent" else self.grammar.sequence("Program", s)


def _is_line(c: str) -> bool:
    """Whether a symbol is a line end with its indentation."""
    return FIRST_LINE <= c <= LAST_LINE


class Blocks:
    """Indented blocks of Python: lines are classified, then indentation becomes brackets of a second grammar."""

    HEADS = {
        "IfHead": "I", "ElifHead": "E", "ElseHead": "L", "WhileHead": "W", "ForHead": "F", "TryHead": "T", "ExceptHead": "X",
        "FinallyHead": "Y", "WithHead": "H", "DefHead": "D", "ClassHead": "D", "MatchHead": "M", "CaseHead": "C",
    }

    def __init__(self):
        self.grammar = Grammar(G.PY_BLOCKS, "x o I E L F W T X Y H D M C @", "")
        self.names = {v: k for k, v in self.grammar.symbols.items()}
        self.kinds: dict[str, str] = {}
        self.kept: dict[str, bool] = {}

    def kind(self, grammar: Grammar, line: str) -> str:
        got = self.kinds.get(line)
        if got is None:
            if len(self.kinds) > 400_000:
                self.kinds.clear()
            got = self.kinds[line] = self._kind(grammar, line)
        return got

    def _kind(self, grammar: Grammar, line: str) -> str:
        known = self.grammar.symbols
        if grammar.full("Simple", line):
            return known["x"]
        if grammar.full("Decorator", line):
            return known["@"]
        colon = grammar.symbols[":"]
        for at, c in enumerate(line):
            if c != colon:
                continue
            rest = line[at + 1 :]
            if rest and not grammar.full("Simple", rest):
                continue
            for head, kind in self.HEADS.items():
                if grammar.full(head, line[:at]):
                    return known[kind] + (known["o"] if rest else "")
        return ""

    def lines(self, s: str) -> list[tuple[int, str]]:
        """Indentation and symbols of each logical line."""
        out, indent, begin = [], 0, 0
        for at, c in enumerate(s):
            if _is_line(c):
                if at > begin:
                    out.append((indent, s[begin:at]))
                indent, begin = ord(c) - ord(FIRST_LINE), at + 1
        if begin < len(s):
            out.append((indent, s[begin:]))
        return out

    def nested(self, grammar: Grammar, s: str) -> str | None:
        levels, out = [0], []
        for indent, line in self.lines(s):
            kind = self.kind(grammar, line)
            if not kind:
                return None
            if indent > levels[-1]:
                levels.append(indent)
                out.append("{")
            while indent < levels[-1]:
                levels.pop()
                out.append("}")
            if indent != levels[-1]:
                return None
            out.append(kind)
        return "".join(out) + "}" * (len(levels) - 1)

    def first_bad(self, grammar: Grammar, lines: list[tuple[int, str]], finished: bool = True) -> int | None:
        """Number of the first line, of indentations and symbols, that no block can take; of the last where ``finished`` lines lack one."""
        follow = {"I": "EL", "E": "EL", "F": "L", "W": "L", "T": "XY", "X": "XLY"}
        # a level: indentation, kinds that may go on the statement before, whether one must, whether only cases may stand here
        levels: list[list] = [[0, "", False, False]]
        before = ""
        for number, (indent, line) in enumerate(lines):
            kind = "".join(self.names[c] for c in self.kind(grammar, line))
            if not kind:
                return number
            deeper = before not in ("", "x", "@") and "o" not in before
            if deeper != (indent > levels[-1][0]):
                return number
            if deeper:
                levels.append([indent, "", False, before == "M"])
            while indent < levels[-1][0]:
                if levels.pop()[2] or before == "@":
                    return number
            level, head = levels[-1], kind[0]
            if indent != level[0]:
                return number
            if head in "ELXY":
                if head not in level[1]:
                    return number
                tried = level[1] in ("XY", "XLY")
                level[1] = ("Y" if head == "L" else "" if head == "Y" else follow[head]) if tried else follow.get(head, "")
            else:
                if level[2] or (head == "C") != level[3] or (before == "@" and head not in "@D"):
                    return number
                level[1] = follow.get(head, "")
            level[2] = head == "T"
            before = kind
        due = before == "@" or (before not in ("", "x") and "o" not in before)
        return len(lines) - 1 if finished and (due or any(x[2] for x in levels)) else None

    def parses(self, grammar: Grammar, s: str) -> bool:
        s = self.nested(grammar, s)
        if s is None:
            return False
        s = self.grammar.reduce(s)
        return not s or (not any(c in s for c in "{}") and self.grammar.full("Block", s))


@functools.lru_cache(1)
def blocks() -> Blocks:
    return Blocks()


@functools.lru_cache(16)
def language(name: str) -> Language:
    """Lexer and grammar by name, built once per worker."""
    comments = (_LINE_COMMENT, _BLOCK_COMMENT, _OPEN_COMMENT)
    starters = "if for while do return break continue switch try throw const let var function class import export case default"
    if name in ("JavaScript", "TypeScript"):
        regex = r"[=(,:\[!&|?;{}]\s*/(?![/*])(?:\[(?:[^\]\\\n]|\\.)*\]|[^/\\\n\[]|\\.)+/[a-z]*"
        template = r"`(?:[^`\\]|\\[\s\S])*`"
        words = G.TS_WORDS if name == "TypeScript" else G.JS_WORDS
        grammar = Grammar(G.TS if name == "TypeScript" else G.JS, words, G.OPERATORS, starters=starters + (" interface type enum" if name == "TypeScript" else "") + " async static")
        pattern = _pattern(*comments, regex, _DOUBLE, _SINGLE, template, r"\n", _NUMBER, r"[^\W\d][\w$]*|\$[\w$]*", operators=G.OPERATORS.replace(" ` ", " ").replace(" .. ", " ").replace("`", ""))
        return Language(name, grammar, pattern, "auto")
    if name == "Java":
        grammar = Grammar(G.JAVA, G.JAVA_WORDS, G.OPERATORS, starters="if for while do return break continue switch try throw public private protected static final class interface enum int char void boolean long double @ case default var new this super synchronized package import")
        return Language(name, grammar, _pattern(*comments, r'"""[\s\S]*?"""', _DOUBLE, r"'(?:[^'\\\n]|\\[^'\n]+|\\')'", _NUMBER, _WORD))
    if name in ("C", "C++"):
        directive = r"(?m:^)[ \t]*#(?:[^\n\\]|\\[\s\S])*"
        char = r"(?:L|u8|u|U)?'(?:[^'\\\n]|\\[^'\n]+|\\')+'"
        text = r'(?:L|u8|u|U)?"(?:[^"\\\n]|\\[\s\S])*"'
        words = G.CPP_WORDS if name == "C++" else G.C_WORDS
        more = " class namespace template using public private protected virtual throw try auto constexpr" if name == "C++" else " auto"
        grammar = Grammar(G.CPP if name == "C++" else G.C, words, G.OPERATORS, starters="if for while do return break continue switch case default goto int char void long double float short unsigned signed const static struct union enum typedef extern inline" + more)
        return Language(name, grammar, _pattern(*comments, directive, text, char, _NUMBER, _WORD))
    if name == "Go":
        grammar = Grammar(G.GO, G.GO_WORDS, G.OPERATORS, starters="if for switch return break continue go defer var const type func case default")
        return Language(name, grammar, _pattern(*comments, _DOUBLE, r"`[^`]*`", r"'(?:[^'\\\n]|\\[^'\n]+|\\')'", r"\n", _NUMBER, _WORD), "semicolon")
    if name == "Rust":
        raw = tuple(f'b?r{h}"[\\s\\S]*?"{h}' for h in ("##", "#", ""))
        grammar = Grammar(G.RUST, G.RUST_WORDS, G.OPERATORS, starters="if for while loop match return break continue let fn pub struct enum impl trait use mod const static type unsafe async #")
        number = r"\d\w*(?:\.\d\w*|\.(?![.\w]))?(?:(?<=[eE])[+-]\d\w*)?"
        return Language(name, grammar, _pattern(*comments, *raw, r'[bc]?"(?:[^"\\]|\\[\s\S])*"', r"b?'(?:[^'\\\n]|\\(?:u\{[\da-fA-F_]+\}|x[\da-fA-F]{2}|.))'", r"'[^\W\d]\w*", number, _WORD))
    if name == "Python":
        prefix = r"(?:[rRbBuUfFtT]{0,2})"
        triple = (prefix + r'"""(?:[^\\]|\\[\s\S])*?"""', prefix + r"'''(?:[^\\]|\\[\s\S])*?'''")
        grammar = Grammar(G.PYTHON, G.PY_WORDS + " match case type", G.PY_OPERATORS, soft="match case type")
        return Language(name, grammar, _pattern(r"#[^\n]*", *triple, prefix + r'"(?!"")(?:[^"\\\n]|\\[\s\S])*"', prefix + r"'(?!'')(?:[^'\\\n]|\\[\s\S])*'", r"\\\r?\n", r"\n[ \t]*", _NUMBER, _WORD, operators=G.PY_OPERATORS), "indent")
    raise KeyError(name)


def language_of(path: str | None) -> str | None:
    """The language of the ending of a path."""
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None


_MARKERS = re.compile(r"(?m)^(?:<{7}|>{7})(?= |\r?$)")


def conflict(own: Language, text: str) -> int | None:
    """Where a merge conflict opens that is closed as well, outside strings and comments; None without one."""
    marks = list(_MARKERS.finditer(text))
    if {m.group()[0] for m in marks} != {"<", ">"}:
        return None
    lead = own.lines == "indent"
    spans = [(m.start() - lead, m.end() - lead) for m in own.pattern.finditer(own.prepared(text)) if "\n" in m.group().strip()]
    inside = lambda at: any(a < at < b for a, b in spans[max(0, bisect.bisect(spans, (at,)) - 1) :][:1])
    free = [m for m in marks if not inside(m.start())]
    opened = next((m.start() for m in free if m.group()[0] == "<"), None)
    return opened if opened is not None and any(m.group()[0] == ">" and m.start() > opened for m in free) else None


def diagnose(name: str, text: str) -> tuple[int, str] | None:
    """Furthest failure of a text, as its offset, and the cause; None for a valid text."""
    own = language(name)
    if own.parses(text):
        return None
    lead = own.lines == "indent"
    symbols, places = [], []
    for m in own.pattern.finditer(own.prepared(text)):
        for c in own.symbol(m.group()):
            symbols.append(c)
            places.append(m.start() - lead)
    symbols, places = own.settled(symbols, places)
    places.append(len(text))
    offset, cause = len(text), ""
    grammar = own.grammar
    frames: list[tuple[str, int, list[str], list[int]]] = [("", 0, [], [])]
    groups: dict[int, tuple[str, list[str], list[int]]] = {}
    for at, c in enumerate(symbols):
        if c == BAD:
            offset, cause = places[at], "lexical"
            break
        if c in "([{":
            frames.append((c, places[at], [], []))
        elif c in ")]}":
            if "([{".find(frames[-1][0] or "x") != ")]}".find(c):
                offset, cause = places[at], "bracket"
                break
            opened, start, inside, spots = frames.pop()
            body = "".join(inside)
            symbol = grammar.group(opened + body + c)
            if not grammar.met[symbol]:
                kept = [p for p, x in zip(spots, inside, strict=True) if not _is_line(x)]
                body = "".join(x for x in inside if not _is_line(x))
                rules = grammar.bit["PSB"["([{".find(opened)]]
                far = max((grammar.furthest(rule, body) for rule in rules), default=0)
                offset = kept[far] if far < len(kept) else places[at]
                cause = "syntax"
                break
            frames[-1][2].append(symbol)
            frames[-1][3].append(start)
            groups[start] = opened, inside, spots
        else:
            frames[-1][2].append(c)
            frames[-1][3].append(places[at])
    else:
        if len(frames) > 1:
            at = _unfinished(own, frames, len(text))
            offset, cause = (len(text), "truncated") if at is None else (at, "syntax")
        else:
            _, _, inside, spots = frames[0]
            if lead:
                offset, cause = _first_bad_line(grammar, inside, spots, len(text)), "syntax"
            else:
                far = grammar.furthest("Program", "".join(inside))
                offset, cause = (spots[far] if far < len(spots) else len(text)), "syntax"
    if cause == "syntax":
        offset = _inside(grammar, groups, offset)
    if cause in ("syntax", "lexical") and not text[offset:].strip():
        cause = "truncated"
    if cause == "lexical" and text[offset] in "\"'`/" and (text[offset] != "/" or text[offset + 1 : offset + 2] == "*"):
        cause = "truncated"
    at = conflict(own, text)
    line = text.rfind("\n", 0, offset) + 1
    if _MARKERS.match(text, line):
        at = line if at is None else min(at, line)
    return (at, "merge_conflict") if at is not None and at <= offset else (offset, cause)


def _inside(grammar: Grammar, groups: dict[int, tuple[str, list[str], list[int]]], at: int) -> int:
    """Where the brackets that open at a place fail inside, from the outside in; the place itself where they are sound or none open."""
    while at in groups:
        opened, inside, spots = groups[at]
        kept = [(x, p) for x, p in zip(inside, spots, strict=True) if not _is_line(x)]
        body = "".join(x for x, _ in kept)
        rules = [r for r in grammar.bit["PSB"["([{".find(opened)]] if r != "Anything"]
        if any(grammar.full(r, body) for r in rules):
            break
        far = max((grammar.furthest(r, body) for r in rules), default=len(body))
        if far >= len(body):
            break
        at = kept[far][1]
    return at


def _unfinished(own: Language, frames: list[tuple[str, int, list[str], list[int]]], end: int) -> int | None:
    """Where what stands before the end fails already, in the outermost open bracket where it does; None where all may go on."""
    for number, (opened, _, inside, spots) in enumerate(frames):
        kept = [(x, p) for x, p in zip(inside, spots, strict=True) if not _is_line(x)] if opened else list(zip(inside, spots, strict=True))
        body, rules = "".join(x for x, _ in kept), own.grammar.bit["PSB"["([{".find(opened)]] if opened else ["Program"]
        if not opened and own.lines == "indent":
            whole = max((i for i, x in enumerate(inside) if _is_line(x)), default=0)
            at = _first_bad_line(own.grammar, inside[:whole], spots[:whole], end, False)
            if at < end:
                return at
            continue
        far = max((own.grammar.furthest(rule, body) for rule in rules), default=len(body))
        if far < len(body):
            return kept[far][1]
    return None


def _first_bad_line(grammar: Grammar, inside: list[str], spots: list[int], end: int, finished: bool = True) -> int:
    """Place of the first line of a Python file that is no line, or that no block can hold; ``end`` where lines that are not all may go on."""
    lines, begin, indent = [], 0, 0
    for at, c in enumerate([*inside, FIRST_LINE]):
        if _is_line(c):
            if at > begin:
                lines.append((spots[begin], indent, "".join(inside[begin:at])))
            begin, indent = at + 1, ord(c) - ord(FIRST_LINE)
    bad = blocks().first_bad(grammar, [(indent, line) for _, indent, line in lines], finished)
    return end if bad is None else lines[bad][0]


def invalid_files(files: DataFrame) -> DataFrame:
    """``file_id``: files whose content is not valid in the language of the ending of their path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = language_of(path)
                if content and name and not language(name).parses(content):
                    out.append(file_id)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["file_id"])

    return files.select("file_id", "path", "content").mapInArrow(run, "file_id bigint").distinct()


def failures(files: DataFrame) -> DataFrame:
    """``file_id, language, line, char_offset, cause`` of each file that does not parse."""
    schema = pa.schema([("file_id", pa.int64()), ("language", pa.string()), ("line", pa.int32()), ("char_offset", pa.int32()), ("cause", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = language_of(path)
                if content and name and (found := diagnose(name, content)):
                    out.append((file_id, name, content.count("\n", 0, found[0]) + 1, *found))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    found = files.select("file_id", "path", "content").mapInArrow(run, "file_id bigint, language string, line int, char_offset int, cause string")
    return found.dropDuplicates(["file_id"])


def _language_column(path: Column) -> Column:
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))]


def rates(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """``repo_name, language, n_files, n_invalid, share, n_recorded_wrong`` over distinct files.

    ``n_recorded_wrong`` counts files whose latest earlier record says otherwise.
    """
    every = files.select("file_id", "repo_name", _language_column(F.col("path")).alias("language")).where("language IS NOT NULL").distinct()
    bad = invalid_files(files).withColumn("bad", F.lit(1))
    latest = parsed.groupBy("file_id").agg(F.max_by("success", F.struct("parsed_at", "success")).alias("success"))
    joined = every.join(bad, "file_id", "left").join(latest, "file_id", "left").fillna(0, ["bad"])
    return joined.groupBy("repo_name", "language").agg(
        F.count("*").alias("n_files"),
        F.sum("bad").alias("n_invalid"),
        F.round(F.avg("bad"), 6).alias("share"),
        F.sum(F.coalesce((F.col("success") == (F.col("bad") == 1)).cast("int"), F.lit(0))).alias("n_recorded_wrong"),
    )
