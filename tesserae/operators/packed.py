"""Several values packed in one field: dictionary-guided segmentation.

A field holds values joined by inconsistent separators, sometimes quoted. The
operator explodes it into one row per value with its position.

1. *Dictionary.* Values known as wholes are mined from unambiguous places of the
   same column: entries of JSON lists and quoted values. Only values that contain a
   separator matter, since any other value is cut right without help; a value is
   known once it was met in ``min_support`` places.
2. *Automaton.* An Aho-Corasick automaton over the dictionary finds the known values
   in a field. The dictionary is put into an automaton and broadcast only when its
   rows and characters are within bounds; a larger one is joined with the fields by the
   first piece of its values and then by the whole values, whatever their length, so
   that no task or driver holds it whole and the rows are the same.
3. *Cover.* Dynamic programming picks the cheapest cover of the field by values and
   separators. Arcs are quoted values, plain values that run to the next separator
   outside a balanced pair of brackets, and known values; a quoted arc costs least,
   then a known one, and each extra value costs, so delimiters inside legitimate
   values stay protected.

Defined results: null, empty and blank fields give no rows; pieces that are empty
after trimming are dropped and do not count for the position; repeated values keep
their own positions; a field that as a whole is a JSON list of strings gives the
strings of that list; an unclosed quote is an ordinary character.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import cut

# Quotes with the character that closes each.
QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "‘": "’", "«": "»"}
# Brackets with the character that closes each.
BRACKETS = {"(": ")", "[": "]", "<": ">"}
# Characters that separate values outside quotes and brackets.
SEPARATORS = ",;|\t\n\r，；¦、•｜·"
_CLASS = SEPARATORS.replace("|", r"\|")


def _separators(text: str) -> list[bool]:
    """For each character whether it separates when nothing protects it."""
    return [c in SEPARATORS for c in text]


def _brackets(text: str, start: int, stop: int) -> dict[int, int]:
    """Balanced pairs of brackets in text[start:stop]: place of the opening one to that of the closing one."""
    stack: list[int] = []
    pairs: dict[int, int] = {}
    for i in range(start, stop):
        c = text[i]
        if c in BRACKETS:
            stack.append(i)
        elif c in ")]>":
            for k in range(len(stack) - 1, -1, -1):
                if BRACKETS[text[stack[k]]] == c:
                    pairs[stack[k]] = i
                    del stack[k:]
                    break
    return pairs


def _quoted_end(text: str, at: int, marks: list[bool]) -> tuple[int, str] | None:
    """End and content of the quoted value that opens at ``at``; None where the quote never closes a value."""
    close, n, i, out = QUOTES[text[at]], len(text), at + 1, []
    while i < n:
        if text[i] == close:
            if i + 1 < n and text[i + 1] == close:
                out.append(close)
                i += 2
                continue
            k = i + 1
            while k < n and text[k].isspace() and not marks[k]:
                k += 1
            if k == n or marks[k]:
                return i + 1, "".join(out)
            out.append(close)
            i += 1
            continue
        out.append(text[i])
        i += 1
    return None


def json_values(text: str) -> list[str] | None:
    """The strings of a field that as a whole is a JSON list of strings."""
    body = text.strip()
    if not (body.startswith("[") and body.endswith("]")):
        return None
    try:
        got = json.loads(body)
    except ValueError:
        return None
    return got if isinstance(got, list) and all(isinstance(x, str) for x in got) else None


class Segmenter:
    """Finds the cheapest cover of a field by values; ``known`` is an automaton or a set of spans per call."""

    QUOTED, KNOWN, PLAIN = 1.0, 1.5, 2.0

    def __init__(self, words: list[str] | None = None):
        self.automaton = None
        if words:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for word in words:
                self.automaton.add_word(word, len(word))
            self.automaton.make_automaton()

    def known_spans(self, text: str) -> dict[int, list[int]]:
        spans: dict[int, list[int]] = {}
        if self.automaton is not None:
            for end, length in self.automaton.iter(text):
                spans.setdefault(end + 1 - length, []).append(end + 1)
        return spans

    def split(self, text: str, known: dict[int, list[int]] | None = None) -> list[tuple[str, bool]]:
        """Values of the field in order, each with whether it was quoted."""
        listed = json_values(text)
        if listed is not None:
            return [(v, True) for v in (x.strip() for x in listed) if v]
        marks, n = _separators(text), len(text)
        pairs = _brackets(text, 0, n)
        known = self.known_spans(text) if known is None else known
        # best[i]: cheapest cost of text[i:], with the arc that gives it, for i where a value may start
        best: dict[int, tuple[float, tuple | None]] = {n: (0.0, None)}
        order, seen, todo = [], set(), [0]
        arcs: dict[int, list[tuple]] = {}
        while todo:
            i = todo.pop()
            if i in seen or i >= n:
                continue
            seen.add(i)
            order.append(i)
            k = i
            while k < n and (text[k].isspace() or marks[k]):
                k += 1
            if k == n:
                arcs[i] = [(0.0, n, None)]
                continue
            if k > i:
                arcs[i] = [(0.0, k, None)]
                todo.append(k)
                continue
            here: list[tuple] = []
            if text[i] in QUOTES and (got := _quoted_end(text, i, marks)):
                here.append((self.QUOTED, got[0], (got[1], True)))
            else:
                for end in known.get(i, ()):
                    k = end
                    while k < n and text[k] == " ":
                        k += 1
                    if k == n or marks[k]:
                        here.append((self.KNOWN, end, (text[i:end], False)))
                k = i
                while k < n and not marks[k]:
                    k = pairs[k] + 1 if k in pairs else k + 1
                here.append((self.PLAIN, k, (text[i:k], False)))
            arcs[i] = here
            todo.extend(a[1] for a in here)
        for i in sorted(order, reverse=True):
            cost, arc = min(((c + best[e][0], (e, v)) for c, e, v in arcs[i]), key=lambda x: x[0])
            best[i] = (cost, arc)
        values, i = [], 0
        while i < n:
            end, value = best[i][1]
            if value is not None and (v := value[0].strip()):
                values.append((v, value[1]))
            i = end
        return values


def _mine():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Segmenter()
        for batch in batches:
            words: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for value, sure in plain.split(text) if text else ():
                    if sure and any(c in SEPARATORS for c in value):
                        words[value] = words.get(value, 0) + 1
            yield pa.RecordBatch.from_pydict({"word": list(words), "met": list(words.values())}, schema=pa.schema([("word", pa.string()), ("met", pa.int64())]))

    return run


def known_values(df: DataFrame, columns: list[str], min_support: int = 2) -> DataFrame:
    """Dictionary of known whole values that hold a separator: ``word, met``."""
    parts = [df.select(F.col(c).alias("text")).where(F.col(c).isNotNull()).mapInArrow(_mine(), "word string, met bigint") for c in columns]
    mined = parts[0]
    for part in parts[1:]:
        mined = mined.unionByName(part)
    return mined.groupBy("word").agg(F.sum("met").alias("met")).where(F.col("met") >= min_support)


#: Automata of this worker by the name of their dictionary, so that each is compiled once.
_AUTOMATA: dict[str, Segmenter] = {}


def _explode(words, name: str, keys: list[str], columns: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[name] = Segmenter(words.value)
        cutter = _AUTOMATA[name]
        for batch in batches:
            table = batch.to_pydict()
            out: dict[str, list] = {name: [] for name in schema.names}
            for column in columns:
                for row, text in enumerate(table[column]):
                    if not text:
                        continue
                    for pos, (value, _) in enumerate(cutter.split(text)):
                        for key in keys:
                            out[key].append(table[key][row])
                        out["field_name"].append(column)
                        out["item_pos"].append(pos)
                        out["item_value"].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _explode_with_spans(keys: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Segmenter()
        for batch in batches:
            table = batch.to_pydict()
            out: dict[str, list] = {name: [] for name in schema.names}
            for row, text in enumerate(table["text"]):
                spans: dict[int, list[int]] = {}
                for word in table["words"][row] or ():
                    at = text.find(word)
                    while at >= 0:
                        spans.setdefault(at, []).append(at + len(word))
                        at = text.find(word, at + 1)
                for pos, (value, _) in enumerate(cutter.split(text, spans)):
                    for key in keys:
                        out[key].append(table[key][row])
                    out["field_name"].append(table["field_name"][row])
                    out["item_pos"].append(pos)
                    out["item_value"].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _heads(text: str) -> Iterator[tuple[int, list[int]]]:
    """Places where a value may start, each with the places of the separators from there on and the end of the text."""
    cuts = [i for i, m in enumerate(_separators(text)) if m]
    ends = [*cuts, len(text)]
    for k, begin in enumerate([0, *(i + 1 for i in cuts)]):
        while begin < ends[k] and text[begin].isspace():
            begin += 1
        if begin < ends[k] and k < len(cuts):
            yield begin, ends[k:]


def _first_pieces(keys: list[str], schema: pa.Schema):
    """The texts before a separator that begin a possible value, each once a field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}
            table = batch.to_pydict()
            for row, text in enumerate(table["text"]):
                for piece in {text[begin : ends[0]] for begin, ends in _heads(text)}:
                    for key in keys:
                        out[key].append(table[key][row])
                    out["piece"].append(piece)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _spans(keys: list[str], schema: pa.Schema):
    """Candidate whole values: from each start the spans with as many separators as known values of that first piece have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}
            table = batch.to_pydict()
            for row, text in enumerate(table["text"]):
                numbers = {p["piece"]: p["numbers"] for p in table["pieces"][row]}
                found = set()
                for begin, ends in _heads(text):
                    for n in numbers.get(text[begin : ends[0]], ()):
                        if n < len(ends):
                            last = ends[n - 1] + 1
                            found.add(text[begin:last] + text[last : ends[n]].rstrip(" "))
                for word in found:
                    for key in keys:
                        out[key].append(table[key][row])
                    out["word"].append(word)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _matched(fields: DataFrame, key: str, kind: str, words: DataFrame, salts: int) -> DataFrame:
    """``key, field_name, words``: the known values each field may hold, found by joins alone.

    A known value begins with its first piece, and that piece knows how many separators such
    values have; so a field proposes one span a start and number, and spans meet the
    dictionary by equality. Both joins are salted by the field, since one piece or value may
    stand in a third of the rows, and no dictionary side has a key twice.
    """
    salt = F.pmod(F.xxhash64(key, "field_name"), F.lit(salts)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    known = words.select("word", F.regexp_extract("word", f"^[^{_CLASS}]*", 0).alias("piece"), (F.size(F.split("word", f"[{_CLASS}]")) - 1).alias("n")).where("piece <> ''")
    numbers = known.groupBy("piece").agg(F.collect_set("n").alias("numbers")).select("*", spread)
    names, types = [key, "field_name"], [pa.field(key, _arrow(kind)), pa.field("field_name", pa.string())]
    starts = fields.mapInArrow(_first_pieces(names, pa.schema([*types, pa.field("piece", pa.string())])), f"{key} {kind}, field_name string, piece string")
    met = starts.withColumn("salt", salt).join(numbers, ["piece", "salt"]).groupBy(*names).agg(F.collect_list(F.struct("piece", "numbers")).alias("pieces"))
    spans = fields.join(met, names).mapInArrow(_spans(names, pa.schema([*types, pa.field("word", pa.string())])), f"{key} {kind}, field_name string, word string")
    return spans.withColumn("salt", salt).join(known.select("word", spread), ["word", "salt"]).groupBy(*names).agg(F.collect_list("word").alias("words"))


def split_packed(df: DataFrame, key: str, columns: list[str], min_support: int = 2, dictionary_rows: int = 100_000, dictionary_chars: int = 50_000_000, salts: int = 16) -> DataFrame:
    """One row per value: ``key, field_name, item_pos, item_value``.

    Each key comes out once even when its row is repeated. ``dictionary_rows`` and
    ``dictionary_chars`` bound what is broadcast; beyond either the dictionary stays
    distributed and is joined with the fields, which gives the same rows.
    """
    rows = df.select(key, *columns).dropDuplicates([key])
    found = cut(known_values(df, columns, min_support).select("word"))
    size = found.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    kind = df.schema[key].dataType.simpleString()
    ddl = f"{key} {kind}, field_name string, item_pos int, item_value string"
    schema = pa.schema([(key, _arrow(kind)), ("field_name", pa.string()), ("item_pos", pa.int32()), ("item_value", pa.string())])
    if size[0] <= dictionary_rows and size[1] <= dictionary_chars:
        words = df.sparkSession.sparkContext.broadcast(sorted(r[0] for r in found.collect()))
        return rows.mapInArrow(_explode(words, uuid.uuid4().hex, [key], columns, schema), ddl)
    texts: Column = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in columns]))
    fields = rows.select(key, texts.alias("f")).select(key, "f.field_name", "f.text").where(F.col("text").isNotNull())
    return fields.join(_matched(fields, key, kind, found, salts), [key, "field_name"], "left").mapInArrow(_explode_with_spans([key], schema), ddl)


def _arrow(simple: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[simple]
