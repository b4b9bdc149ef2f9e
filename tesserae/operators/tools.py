"""Read-only tools over the tables, their access policy, and grounded answers."""

from __future__ import annotations

import http.client
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import graph, lexical
from tesserae.operators.evidence import read_range

# Names, endings and folders that tools never read.
SENSITIVE_NAMES = (".env", ".netrc", ".npmrc", ".pypirc", "id_rsa", "id_ed25519", "credentials", "credentials.json", "secrets.json", "secrets.yaml")
SENSITIVE_ENDINGS = ("pem", "key", "p12", "pfx", "jks", "keystore", "crt", "der")
SENSITIVE_FOLDERS = (".git", ".ssh", ".aws", ".gnupg", ".kube", "secrets")


def access(path: Column) -> Column:
    """``allowed`` or why a path may not be read."""
    p = F.regexp_replace(path, r"\\", "/")
    parts = F.split(F.lower(p), "/")
    name = F.element_at(parts, -1)
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "denied_empty").when(p.rlike("^(/|[A-Za-z]:)"), "denied_absolute").when(F.array_contains(F.split(p, "/"), ".."), "denied_traversal")
        .when(name.isin(*SENSITIVE_NAMES) | name.startswith(".env."), "denied_name").when(F.regexp_extract(name, r"\.([^.]*)$", 1).isin(*SENSITIVE_ENDINGS), "denied_extension")
        .when(F.arrays_overlap(parts, F.array(*map(F.lit, SENSITIVE_FOLDERS))), "denied_folder").otherwise("allowed")
    )


def find_symbol(elements: DataFrame, name: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    """Elements of that name, in any case, or that hold it: exact ones first, then by name, path and id. ``limit`` is 1 to 30."""
    low = F.lower("name")
    rows = elements.where(low.contains(name.lower()))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    return rows.withColumn("exact", low == name.lower()).orderBy(F.desc("exact"), "name", "file_path", "element_id").limit(max(1, min(30, limit)))


def read_file(files: DataFrame, path: str, start: int = 1, end: int | None = None, most_lines: int = 150, most_chars: int = 8000) -> DataFrame:
    """``path, decision, text`` of one file: at most 150 lines and 8,000 characters, policy checked."""
    last = min(end if end is not None else start + most_lines - 1, start + most_lines - 1)
    rows = files.where(F.col("path") == path).select("path", access(F.col("path")).alias("decision"), "content").dropDuplicates(["path"])
    text = F.substring(read_range(F.col("content"), F.lit(start), F.lit(last)), 1, most_chars)
    return rows.select("path", "decision", F.when(F.col("decision") == "allowed", text).alias("text"))


def search_code(elements: DataFrame, query: str, kinds: tuple[str, ...] | None = None, limit: int = 10) -> DataFrame:
    """The first elements for one query: ``rank, element_id, name, file_path, score``. ``limit`` is 1 to 20; a blank query is refused."""
    if not query.strip():
        raise ValueError("nothing to search for")
    asked = elements.sparkSession.createDataFrame([(0, query)], "query_id bigint, query_text string")
    found = lexical.search(asked, elements, k=max(1, min(20, limit)), kinds=kinds)
    return found.join(elements.select("element_id", "name", "file_path"), "element_id").select("rank", "element_id", "name", "file_path", "score").orderBy("rank")


def get_relationships(edges: DataFrame, elements: DataFrame, symbol: str, direction: str = "both", kinds: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Relationships of the first element of that exact name, else of that name in any case: ``direction, kind, neighbor, name, file_path, phrase``.

    ``limit`` is 1 to 25; outgoing ones come first.
    """
    if direction not in ("in", "out", "both"):
        raise ValueError(f"no direction {direction}")
    same = F.col("name") == symbol
    node = elements.where(F.lower("name") == symbol.lower()).orderBy(F.desc(same), "file_path", "element_id").limit(1).select(F.col("element_id").alias("node"))
    chosen = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    near = graph.top_relationships(chosen, node, elements, max(1, min(25, limit))).where(F.lit(True) if direction == "both" else F.col("direction") == direction)
    named = near.join(elements.select(F.col("element_id").alias("neighbor"), "name", "file_path"), "neighbor", "left")
    order = [F.desc("direction"), F.asc("kind"), F.asc("pos"), F.asc("neighbor")]
    return named.orderBy(*order).limit(max(1, min(25, limit))).select("direction", "kind", "neighbor", "name", "file_path", graph.phrase(F.col("kind"), F.col("direction")).alias("phrase"))


def to_evidence(pool: DataFrame, result: DataFrame, tool: str, query_id: int) -> DataFrame:
    """A pool ``query_id, item_id, stage, pos`` with what a tool found after it: its elements or neighbours, each once, as stage 4 with the ``tool``."""
    known = {"search_code": "element_id", "find_symbol": "element_id", "get_relationships": "neighbor"}
    if tool not in known:
        raise ValueError(f"{tool} finds no elements")
    own = pool.where(F.col("query_id") == query_id)
    fresh = result.select(F.col(known[tool]).alias("item_id")).where("item_id IS NOT NULL").distinct().join(own.select("item_id"), "item_id", "left_anti")
    last = own.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("last"))
    placed = fresh.crossJoin(F.broadcast(last)).select(F.lit(query_id).cast("bigint").alias("query_id"), "item_id", F.lit(4).alias("stage"), (F.col("last") + F.row_number().over(Window.orderBy("item_id"))).alias("pos"), F.lit(tool).alias("tool"))
    return pool.select("query_id", "item_id", "stage", "pos", F.lit(None).cast("string").alias("tool")).unionByName(placed)


@dataclass
class ToolResult:
    status: str
    rows: DataFrame | None = None
    message: str = ""


@dataclass
class ToolRegistry:
    """Tools by unique name; an unknown one gives ``not_found``, a failing one ``error``."""

    tools: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def add(self, name: str, tool: Callable[..., DataFrame]) -> None:
        if name in self.tools:
            raise ValueError(f"{name} is registered already")
        self.tools[name] = tool

    def names(self) -> list[str]:
        return sorted(self.tools)

    def execute(self, name: str, **arguments) -> ToolResult:
        if name not in self.tools:
            return ToolResult("not_found", message=f"no tool {name}")
        try:
            return ToolResult("success", self.tools[name](**arguments))
        except (TypeError, ValueError) as e:
            return ToolResult("invalid_arguments", message=str(e))


def prompt(question: Column, context: Column) -> Column:
    """Prompt of one question over its rendered context."""
    return F.concat(F.lit("Answer from the evidence alone and name the files you used.\n\nEvidence:\n"), context, F.lit("\n\nQuestion: "), question)


def grounded_answers(gated: DataFrame, runtime: Callable[[str], Iterator[str]] | None = None) -> DataFrame:
    """``query_id, status, answer`` from ``query_id, question, sufficient, refusal, context``.

    Insufficient evidence gives the refusal; a runtime that raises gives ``ERROR``. The
    runtime is called on the workers, once per sufficient question.
    """
    run = runtime or FakeRuntime()

    def answer(batches):
        for pdf in batches:
            status, text = [], []
            for ok, refusal, p in zip(pdf["sufficient"], pdf["refusal"], pdf["prompt"], strict=True):
                if not ok:
                    status.append("INSUFFICIENT_EVIDENCE")
                    text.append(refusal)
                    continue
                try:
                    text.append("".join(run(p)))
                    status.append("GROUNDED")
                except Exception as e:  # noqa: BLE001
                    text.append(str(e))
                    status.append("ERROR")
            yield pdf[["query_id"]].assign(status=status, answer=text)

    rows = gated.select("query_id", "sufficient", "refusal", prompt(F.col("question"), F.coalesce("context", F.lit(""))).alias("prompt"))
    return rows.mapInPandas(answer, f"query_id {gated.schema['query_id'].dataType.simpleString()}, status string, answer string")


class HttpRuntime:
    """Answers of a model behind an http endpoint that streams one JSON object a line: ``response`` pieces until ``done``, or an ``error``.

    Raises ``ConnectionError`` where it cannot be reached, ``TimeoutError`` where it is
    silent, ``ValueError`` for lines that are too long or no JSON, ``RuntimeError`` for
    errors it reports and for a stream that ends before it is done.
    """

    def __init__(self, url: str = "http://localhost:11434/api/generate", model: str = "default", timeout: float = 60.0, most_bytes: int = 1_000_000):
        self.host, self.port, self.path = parse_endpoint(url)
        self.model, self.timeout, self.most_bytes = model, timeout, most_bytes

    def __call__(self, prompt_text: str) -> Iterator[str]:
        connection = http.client.HTTPConnection(self.host, self.port, timeout=self.timeout)
        try:
            connection.request("POST", self.path, json.dumps({"model": self.model, "prompt": prompt_text, "stream": True}), {"Content-Type": "application/json"})
            reply = connection.getresponse()
            if reply.status != 200:
                raise RuntimeError(f"status {reply.status}")
            yield from stream_pieces(iter(lambda: reply.readline(self.most_bytes + 1), b""), self.most_bytes)
        except TimeoutError:
            raise
        except OSError as e:
            raise ConnectionError(str(e)) from e
        finally:
            connection.close()


def stream_pieces(lines: Iterator[bytes], most_bytes: int = 1_000_000) -> Iterator[str]:
    """The pieces of a streamed answer from its lines."""
    for line in lines:
        if len(line) > most_bytes:
            raise ValueError("a line of the stream is too long")
        if not line.strip():
            continue
        record = json.loads(line)
        if record.get("error"):
            error = record["error"]
            raise RuntimeError(error.get("message", "error") if isinstance(error, dict) else str(error))
        if record.get("response"):
            yield record["response"]
        if record.get("done"):
            return
    raise RuntimeError("the stream ended before it was done")


class FakeRuntime:
    """Canned answers in chunks, or an error; for tests and dry runs."""

    def __init__(self, text: str = "See the evidence.", chunk: int = 8, error: str | None = None):
        self.text, self.chunk, self.error = text, chunk, error

    def __call__(self, prompt_text: str) -> Iterator[str]:
        if self.error:
            raise RuntimeError(self.error)
        for i in range(0, len(self.text), self.chunk):
            yield self.text[i : i + self.chunk]


class BufferingSink:
    """Collects the events of a stream: chunks, then ``done`` or ``error``."""

    def __init__(self) -> None:
        self.events: list[tuple[str, str]] = []

    def consume(self, chunks: Iterator[str]) -> str:
        try:
            for c in chunks:
                self.events.append(("chunk", c))
            self.events.append(("done", ""))
        except RuntimeError as e:
            self.events.append(("error", str(e)))
        return "".join(t for k, t in self.events if k == "chunk")


def parse_endpoint(url: str) -> tuple[str, int, str]:
    """Host, port and path of an http address; IPv6 in brackets; port 11434 by default."""
    from urllib.parse import urlsplit

    parts = urlsplit(url)
    if parts.scheme != "http" or not parts.hostname:
        raise ValueError(f"no http address: {url}")
    port = parts.port if parts.port is not None else 11434
    if not 1 <= port <= 65535:
        raise ValueError(f"no port: {port}")
    return parts.hostname, port, parts.path or "/"
