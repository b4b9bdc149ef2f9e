"""Packrat parsing expressions over token kinds.

A grammar is text: ``Rule <- expression`` per line (continued lines are indented), with
ordered choice ``/``, sequences, ``* + ?``, lookahead ``& !`` and parentheses. Terminals are
quoted tokens, the classes ``ID NUM STR TPL WORD ANY`` and bracket groups ``P.Rule``
(round), ``S.Rule`` (square) and ``B.Rule`` (curly) whose whole inside must match a rule.

Brackets are reduced from the inside out: the inside of an innermost pair is matched in
full against every rule a grammar asks of that kind of bracket, and the pair becomes one
symbol that stands for the set of rules it met. Matches are memoised twice: by rule and
place within one inside (the packrat table), and by rule and symbols across all insides
and files, since equal passages of code have equal symbols. Rules marked ``%seq`` are
sequences of another rule; they are matched piecewise, so that equal statements are
matched once, and as a whole where the pieces do not fit.

Rules are compiled twice: to generated functions that leave out what the next symbol
excludes, for judging, and to closures that try all and keep the furthest failure, for
reports on what does not match.
"""

from __future__ import annotations

import re
import sys

# Rules call each other once per level of nesting; the frames lie on the heap.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))

ID, NUM, STR, TPL, BAD, AUTO = "i", "0", "s", "t", "\x01", "\x02"
# Stands behind the last symbol, where generated matchers look; no terminal takes it.
END = "\x00"
_OPEN, _CLOSE = "([{", ")]}"
_BASE = {"P": 0xE000, "S": 0xE400, "B": 0xE800}
_KIND = dict(zip(_OPEN, "PSB", strict=True))
_INNER = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}")
_CURLY = "\\ue800-\\uebff"
# Line ends with their indentation, in languages where these count; inside brackets they do not.
FIRST_LINE, LAST_LINE = "\U000f0000", "\U0010fffd"
_LINES = re.compile(f"[{FIRST_LINE}-{LAST_LINE}]")
KEPT = 400_000

_TOKEN = re.compile(r"\s*('(?:[^'\\]|\\.)+'|[PSB]\.\w+|\w+|[/*+?&!()])")


class Grammar:
    """A compiled grammar with its symbols and memos."""

    def __init__(self, text: str, keywords: str, operators: str, ends: str = ";", starters: str = "", soft: str = ""):
        self.symbols: dict[str, str] = {}
        for word in (*keywords.split(), *operators.split()):
            if word not in self.symbols and word not in "()[]{}":
                self.symbols[word] = chr(0x100 + len(self.symbols))
        self.names = {ID, *(self.symbols[w] for w in soft.split())}
        self.words = {ID, *(self.symbols[w] for w in keywords.split())}
        self.rules: dict[str, object] = {}
        self.sequences: dict[str, str] = {}
        self.asked: dict[str, list[str]] = {"P": [], "S": [], "B": []}
        sources: dict[str, str] = {}
        for line in re.sub(r"\n[ \t]+", " ", text).splitlines():
            if not line.strip():
                continue
            name, body = (x.strip() for x in line.split("<-", 1))
            if body.startswith("%seq "):
                self.sequences[name] = body[5:].strip()
                body = body[5:].strip() + "*"
            sources[name] = body
        self.numbers = {name: k for k, name in enumerate(sources)}
        self.nodes = [self._compile(name, body) for name, body in sources.items()]
        self.compiled = [self._closure(node) for node in self.nodes]
        self.met: dict[str, int] = {}  # group symbol: bits of the rules it met
        self.groups: dict[tuple[str, int], str] = {}
        self.bit = {kind: {rule: 1 << k for k, rule in enumerate(rules)} for kind, rules in self.asked.items()}
        self.memo: dict[tuple[str, str], bool] = {}
        self.inside: dict[str, str] = {}
        first = "".join(re.escape(self.symbols.get(w, w)) for w in starters.split()) + ID
        stop = "".join(re.escape(self.symbols.get(e, e)) for e in ends.split()) + AUTO
        self.pieces = re.compile(f"(?:[^{stop}{_CURLY}]|[{_CURLY}](?!$|[{first}]))*(?:[{stop}]|[{_CURLY}]|$)")
        self.far = 0
        self.matchers = Matchers(self.nodes)

    # compiling

    def _compile(self, rule: str, body: str):
        tokens, at = [], 0
        while at < len(body.rstrip()):
            m = _TOKEN.match(body, at)
            if not m:
                raise ValueError(f"{rule}: {body[at:]!r}")
            tokens.append(m.group(1))
            at = m.end()
        node, rest = self._choice(tokens, 0, rule)
        if rest != len(tokens):
            raise ValueError(f"{rule}: {tokens[rest:]}")
        return node

    def _choice(self, tokens, i, rule):
        parts = []
        node, i = self._sequence(tokens, i, rule)
        parts.append(node)
        while i < len(tokens) and tokens[i] == "/":
            node, i = self._sequence(tokens, i + 1, rule)
            parts.append(node)
        return (parts[0] if len(parts) == 1 else ("/", *parts)), i

    def _sequence(self, tokens, i, rule):
        parts = []
        while i < len(tokens) and tokens[i] not in ("/", ")"):
            node, i = self._repeated(tokens, i, rule)
            parts.append(node)
        return (parts[0] if len(parts) == 1 else (" ", *parts)), i

    def _repeated(self, tokens, i, rule):
        ahead = tokens[i] if tokens[i] in ("&", "!") else ""
        node, i = self._atom(tokens, i + bool(ahead), rule)
        while i < len(tokens) and tokens[i] in ("*", "+", "?"):
            node, i = (tokens[i], node), i + 1
        return ((ahead, node) if ahead else node), i

    def _atom(self, tokens, i, rule):
        t = tokens[i]
        if t == "(":
            node, i = self._choice(tokens, i + 1, rule)
            return node, i + 1
        i += 1
        if t[0] == "'":
            word = t[1:-1].replace("\\'", "'")
            if word not in self.symbols:
                raise ValueError(f"{rule}: {word} is no token")
            return ("one", frozenset(self.symbols[word]), frozenset()), i
        if t[0] in "PSB" and t[1:2] == ".":
            kind, name = t.split(".")
            if name not in self.asked[kind]:
                self.asked[kind].append(name)
            return ("one", frozenset(), frozenset([(kind, name)])), i
        classes = {"ID": self.names, "WORD": self.words, "NUM": NUM, "STR": STR, "TPL": TPL, "AUTO": AUTO}
        if t in classes:
            return ("one", frozenset(classes[t]), frozenset()), i
        if t in ("ANY", "NEVER"):
            return (t,), i
        number = self.numbers.get(t)
        if number is None:
            raise ValueError(f"{rule}: no rule {t}")
        return ("rule", number), i

    # closures, which keep the furthest place of a failure

    def _closure(self, node):
        kind = node[0]
        if kind in ("/", " "):
            return (self._first_of if kind == "/" else self._all_of)(tuple(map(self._closure, node[1:])))
        if kind in ("?", "*", "+"):
            return self._wrap(self._closure(node[1]), kind)
        if kind in ("&", "!"):
            inner = self._closure(node[1])
            if kind == "&":
                return lambda s, p, table: p if inner(s, p, table) >= 0 else -1
            return lambda s, p, table: -1 if inner(s, p, table) >= 0 else p
        if kind == "one":
            _, chars, groups = node
            if not groups:
                return self._terminal(chars.__contains__)
            ((bracket, name),) = groups
            base = _BASE[bracket]
            return self._terminal(lambda c: base <= ord(c) < base + 0x400 and bool(self.met[c] & self.bit[bracket][name]))
        if kind == "ANY":
            return self._terminal(lambda c: c != BAD)
        if kind == "NEVER":
            return lambda s, p, table: -1
        number = node[1]

        def call(s, p, table):
            key = number, p
            q = table.get(key)
            if q is None:
                table[key] = -1  # a left-recursive call fails
                q = table[key] = self.compiled[number](s, p, table)
            return q

        return call

    @staticmethod
    def _first_of(parts):
        def choice(s, p, table):
            for part in parts:
                q = part(s, p, table)
                if q >= 0:
                    return q
            return -1

        return choice

    @staticmethod
    def _all_of(parts):
        def sequence(s, p, table):
            for part in parts:
                p = part(s, p, table)
                if p < 0:
                    return -1
            return p

        return sequence

    @staticmethod
    def _wrap(inner, kind):
        if kind == "?":

            def maybe(s, p, table):
                q = inner(s, p, table)
                return q if q >= 0 else p

            return maybe

        def many(s, p, table, least=kind == "+"):
            if least:
                p = inner(s, p, table)
                if p < 0:
                    return -1
            while True:
                q = inner(s, p, table)
                if q < 0 or q == p:
                    return p
                p = q

        return many

    def _terminal(self, fits):
        def terminal(s, p, table):
            if p < len(s) and fits(s[p]):
                return p + 1
            if p > self.far:
                self.far = p
            return -1

        return terminal

    # matching

    def full(self, rule: str, s: str, table: dict[int, int] | None = None) -> bool:
        """Whether all of ``s`` matches the rule; ``table`` is one of the same ``s``."""
        key = rule, s
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > KEPT:
                self.memo.clear()
            got = self.memo[key] = self.matchers.rules[self.numbers[rule]](s + END, 0, {} if table is None else table) == len(s)
        return got

    def sequence(self, rule: str, s: str, table: dict[int, int] | None = None) -> bool:
        """``full`` for any rule, piecewise where it is a sequence."""
        one = self.sequences.get(rule)
        if one is None or not s:
            return self.full(rule, s, table)
        key = rule, s
        got = self.memo.get(key)
        if got is None:
            many = "+" + one
            got = all(self._run(many, one, piece) for piece in self.pieces.findall(s) if piece) or self.full(rule, s, table)
            self.memo[key] = got
        return got

    def _run(self, name: str, one: str, s: str) -> bool:
        key = name, s
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > KEPT:
                self.memo.clear()
            p, table, match, whole = 0, {}, self.matchers.rules[self.numbers[one]], s + END
            while 0 <= p < len(s):
                q = match(whole, p, table)
                p = q if q > p else -1
            got = self.memo[key] = p == len(s)
        return got

    def group(self, whole: str) -> str:
        """The symbol of an innermost bracket pair."""
        got = self.inside.get(whole)
        if got is None:
            if len(self.inside) > KEPT:
                self.inside.clear()
            kind, body = _KIND[whole[0]], _LINES.sub("", whole[1:-1])
            table: dict[int, int] = {}
            bits = sum(bit for rule, bit in self.bit[kind].items() if self.sequence(rule, body, table))
            got = self.groups.get((kind, bits))
            if got is None:
                got = chr(_BASE[kind] + sum(k == kind for k, _ in self.groups))
                self.groups[kind, bits] = got
                self.met[got] = bits
                self.matchers.add(got, {(kind, rule) for rule, bit in self.bit[kind].items() if bits & bit})
            self.inside[whole] = got
        return got

    def reduce(self, s: str) -> str:
        """Replace all balanced brackets by group symbols."""
        replace = lambda m: self.group(m.group())
        while True:
            t = _INNER.sub(replace, s)
            if t == s:
                return s
            s = t

    def furthest(self, rule: str, s: str) -> int:
        """The furthest place in ``s`` at which the rule still failed."""
        self.far = 0
        end = self.compiled[self.numbers[rule]](s, 0, {})
        return max(self.far, end, 0)


class _Ways(dict):
    """By symbol, the matchers of those parts of a choice that may begin with it; filled as symbols occur."""

    def __init__(self, parts: list[tuple[set[str] | None, object]]):
        self.parts = parts

    def __missing__(self, c: str) -> tuple:
        got = self[c] = tuple(match for first, match in self.parts if first is None or c in first)
        return got


class Matchers:
    """Rules as generated functions of ``(s, p, table)``; they give the end of the match or -1.

    A part that must begin with a symbol is tried only where one of its first symbols
    stands, which changes no match. ``s`` ends in ``END``; a table holds places by rule and place.
    """

    WAYS = 4  # parts from which a choice goes by its next symbol

    def __init__(self, nodes: list[tuple]):
        self.sets: dict[tuple[frozenset, frozenset], str] = {}  # names of sets, by symbols and groups
        self.env: dict[str, object] = {}
        self.lines: list[str] = []
        self.choices: list[tuple[str, list[tuple[str | None, str]]]] = []
        self.count = 0
        self.nodes = nodes
        self.first = [(False, frozenset(), frozenset(), False)] * len(nodes)
        while (now := [self._first(node) for node in nodes]) != self.first:
            self.first = now
        for _ in range(2):  # again for rules that call rules of one symbol
            self.nodes = [self._plain(node) for node in self.nodes]
        for number, node in enumerate(self.nodes):
            self._function(f"r{number}", node, number if self._calls(node) else None)
        exec("\n".join(self.lines), self.env)  # noqa: S102  (the source is made here, from the grammar alone)
        for name, parts in self.choices:
            self.env[name] = _Ways([(first and self.env[first], self.env[match]) for first, match in parts])
        self.rules = [self.env[f"r{number}"] for number in range(len(nodes))]

    def add(self, symbol: str, met: set[tuple[str, str]]) -> None:
        """Take in a new group symbol with the rules that it met, before it occurs."""
        for (_, groups), name in self.sets.items():
            if not met.isdisjoint(groups):
                self.env[name].add(symbol)

    # what the rules begin with

    def _first(self, node) -> tuple[bool, frozenset, frozenset, bool]:
        """Whether a node may match nothing, else its first symbols, groups, and whether any symbol may be first."""
        kind = node[0]
        if kind == "one":
            return False, node[1], node[2], False
        if kind in ("ANY", "NEVER"):
            return False, frozenset(), frozenset(), kind == "ANY"
        if kind in ("&", "!"):
            return True, frozenset(), frozenset(), False
        if kind == "rule":
            return self.first[node[1]]
        nothing, chars, groups, free = kind != "/", frozenset(), frozenset(), False
        for part in node[1:]:
            n, c, g, f = self._first(part)
            chars, groups, free = chars | c, groups | g, free or f
            if kind == "/":
                nothing = nothing or n
            elif not n:
                nothing = False
                break
        return nothing or kind in ("?", "*"), chars, groups, free

    def _plain(self, node):
        """The node with parts of one symbol each taken together."""
        kind = node[0]
        if kind == "rule":
            return self.nodes[node[1]] if self.nodes[node[1]][0] == "one" else node
        if kind in ("one", "ANY", "NEVER"):
            return node
        parts = [self._plain(part) for part in node[1:]]
        if kind == "/":
            together = []
            for part in parts:
                if together and part[0] == "one" == together[-1][0]:
                    _, chars, groups = together.pop()
                    part = "one", chars | part[1], groups | part[2]
                together.append(part)
            if len(together) == 1:
                return together[0]
            parts = together
        return kind, *parts

    # generating

    def _name(self, letter: str) -> str:
        self.count += 1
        return f"{letter}{self.count}"

    def _set(self, chars: frozenset, groups: frozenset) -> str:
        name = self.sets.get((chars, groups))
        if name is None:
            name = self.sets[chars, groups] = self._name("K")
            self.env[name] = set(chars)
        return name

    def _begins(self, node) -> str | None:
        """The name of the set of first symbols; None where these exclude nothing."""
        nothing, chars, groups, free = self._first(node)
        return None if nothing or free else self._set(chars, groups)

    def _test(self, node, at: str, no: str = "") -> str | None:
        """The test of a node of one symbol, and so of a look ahead at one."""
        if node[0] == "ANY":
            return f"s[{at}] {'' if no else 'not '}in {BAD + END!r}"
        if node[0] != "one":
            return None
        if len(node[1]) == 1 and not node[2]:
            return f"s[{at}] {'!=' if no else '=='} {min(node[1])!r}"
        return f"s[{at}] {no}in {self._set(node[1], node[2])}"

    def _calls(self, node) -> bool:
        return node[0] == "rule" or any(self._calls(part) for part in node[1:] if isinstance(part, tuple))

    def _function(self, name: str, node, number: int | None = None) -> None:
        """A function that matches a node; that of a rule of a number keeps its places in the table."""
        out = [f"def {name}(s, p, t):"]
        if number is not None:  # a left-recursive call fails
            out += [f" k = p * {len(self.nodes)} + {number}", " q = t.get(k)", " if q is not None: return q", " t[k] = -1"]
        self._node(node, "p", "q", " ", out)
        self.lines += [*out, *[" t[k] = q"] * (number is not None), " return q"]

    def _node(self, node, at: str, to: str, pad: str, out: list[str]) -> None:
        """Lines that match a node from the place ``at`` and leave the end, or -1, in ``to``."""
        kind = node[0]
        if kind == "NEVER":
            out.append(f"{pad}{to} = -1")
        elif test := self._test(node, at):
            out.append(f"{pad}{to} = {at} + 1 if {test} else -1")
        elif kind == "rule":
            begins = self._begins(node)
            out.append(f"{pad}{to} = r{node[1]}(s, {at}, t)" + (f" if s[{at}] in {begins} else -1" if begins else ""))
        elif kind in ("&", "!"):
            end = self._name("v")
            self._node(node[1], at, end, pad, out)
            out.append(f"{pad}{to} = {at} if {end} {'>=' if kind == '&' else '<'} 0 else -1")
        elif kind == "/":
            self._alternatives(node[1:], at, to, pad, out)
        elif kind == " ":
            self._parts(node[1:], at, to, pad, out)
        elif kind == "?" and (test := self._test(node[1], at)):
            out.append(f"{pad}{to} = {at} + 1 if {test} else {at}")
        else:
            begins, end = self._begins(node[1]), self._name("v")
            if kind == "+":
                self._node(node[1], at, to, pad, out)
                out.append(f"{pad}if {to} >= 0:")
                pad += " "
            else:
                out.append(f"{pad}{to} = {at}")
            loop = "if" if kind == "?" else "while"
            out.append(f"{pad}{loop} " + (f"s[{to}] in {begins}:" if begins else "True:"))
            self._node(node[1], to, end, pad + " ", out)
            if kind == "?":
                out.append(f"{pad} if {end} >= 0: {to} = {end}")
            else:
                out += [f"{pad} if {end} <= {to}: break", f"{pad} {to} = {end}"]

    def _alternatives(self, parts, at: str, to: str, pad: str, out: list[str]) -> None:
        if len(parts) >= self.WAYS:
            ways, name = [], self._name("W")
            for part in parts:
                match = f"r{part[1]}" if part[0] == "rule" else self._name("f")
                if part[0] != "rule":
                    self._function(match, part)
                ways.append((self._begins(part), match))
            self.choices.append((name, ways))
            out += [f"{pad}{to} = -1", f"{pad}for f in {name}[s[{at}]]:", f"{pad} {to} = f(s, {at}, t)", f"{pad} if {to} >= 0: break"]
            return
        out.append(f"{pad}{to} = -1")
        for number, part in enumerate(parts):
            begins = self._begins(part)
            tests = [f"{to} < 0"] * (number > 0) + [f"s[{at}] in {begins}"] * (begins is not None)
            if tests:
                out.append(f"{pad}if {' and '.join(tests)}:")
            self._node(part, at, to, pad + " " * bool(tests), out)

    def _parts(self, parts, at: str, to: str, pad: str, out: list[str]) -> None:
        out.append(f"{pad}{to} = -1")
        tests, ahead = [], 0
        for part in (*parts, None):
            place = f"{at} + {ahead}" if ahead else at
            if part and (test := self._test(part, place)):
                tests.append(test)
                ahead += 1
                continue
            if part and part[0] in ("&", "!") and (test := self._test(part[1], place, "not " if part[0] == "!" else "")):
                tests.append(test)
                continue
            if tests:
                out.append(f"{pad}if {' and '.join(tests)}:")
                pad, tests = pad + " ", []
            if part is None:
                out.append(f"{pad}{to} = {place}")
            else:
                if ahead:
                    at, ahead = self._name("v"), 0
                    out.append(f"{pad}{at} = {place}")
                end = self._name("v")
                self._node(part, at, end, pad, out)
                at = end
                if part[0] not in ("?", "*"):
                    out.append(f"{pad}if {at} >= 0:")
                    pad += " "
