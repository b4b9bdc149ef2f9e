"""Broken prompt and response pairs: which answers are no usable answers, and why.

A pair gets at most one defect, by the first rule that holds:

* ``empty``: nothing is left of the answer without blanks, punctuation, markup and
  placeholder words.
* ``copy``: a suffix automaton over the words of the question reads the answer; the
  answer is a copy when almost all its words lie in passages of the question and it holds
  most of the question. Words that only frame a quotation are not counted.
* ``refusal``: an automaton over the parts of refusing sentences in seven languages reads
  the answer outside quotations and code (see ``refusal``): a sentence refuses, nothing of
  substance stands before it and no contrast after it answers after all.
* ``truncated``: a stack of delimiters (fences, code marks, brackets, quotes) is not empty
  at the end, or the last line of prose has no end.
* ``language``: stopwords, and scripts that only one language uses, vote for another
  natural language than that of the question.

``status`` is a weak hint only: it never decides. Defined results: a null answer is
``empty``; a null question is no ground for ``copy`` or ``language``; repeated rows of an
id come out once; very long answers are read whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.refusal import refuses

# Answers that stand for no answer.
PLACEHOLDERS = ("null", "none", "nil", "nan", "n a", "na", "todo", "tbd", "fixme", "empty", "answer", "response", "undefined", "placeholder", "no answer", "unknown", "xxx", "lorem ipsum", "br", "p")
# Words that frame a quoted question.
FRAMING = ("q", "a", "question", "answer", "the", "is", "you", "ask", "asked", "was", "your", "frage", "pregunta", "pregunta", "réponse", "respuesta", "antwort")
# Frequent words of languages written in Latin script.
STOPWORDS = {
    "en": "the a an is are was were be been does do did has have had will would may must can should this that these those it its of to in on at by for from with as and or but if unless when while which what where who why how not no every each one never seldom usually only still now once so until after before both them than then there without yes line at describe explain list show summarise write which note part files use steps lazily twice called calls function takes returns nothing special early owns defined",
    "de": "der die das den dem des ein eine einen einem einer eines ist sind war wird werden und oder aber wenn weil nach vor bei mit für von zu zur zum im in am auf aus nicht kein keine sich es sie er ich wir das dass wie was wo wer warum welche welcher wird obwohl sobald ohne höchstens jede jeder jedes unser alte zweite liste liest geschieht gleich zuständig steht beim",
    "fr": "le la les un une des du de et ou mais si quand que qui est sont était dans sur pour par avec sans ne pas plus au aux ce cette ces se sa son ses il elle on nous vous où comment pourquoi quelle quel même dès lorsque après avant c'est s'en cela l'ancien notre chaque",
    "es": "el la los las un una unos unas de del y o pero si cuando que qué es son fue en por para con sin no más al se su sus lo le él ella cómo dónde qué quién cuál cada aunque hasta después antes está están esa ese esta este nuestro como mientras cuando",
}


def normal(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower().replace("’", "'")


_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`]*`?", re.S)
_PATH = re.compile(r"\S*[/_\\]\S*|\b\w+\.\w+\b|\b\w*[a-z][A-Z]\w*")
_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|«[^»\n]*»')
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|_+", re.U)
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿]")
_TAG = re.compile(r"<[^<>]*>")


def words(text: str) -> list[str]:
    """Words in lower case; each character of an unspaced script is one."""
    low = normal(text)
    found = _WORD.findall(low)
    if not _UNSPACED.search(low):
        return found
    return [c for w in found for c in (w if _UNSPACED.search(w) else (w,))]


class SuffixAutomaton:
    """All passages of a list of words."""

    def __init__(self, symbols: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for c in symbols:
            cur = self._state(self.size[last] + 1, {}, 0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.size[q] != self.size[p] + 1:
                    copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = copy
                    q = copy
                self.link[cur] = q
            last = cur

    def _state(self, size: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def matches(self, symbols: list[str]) -> list[int]:
        """For each end in ``symbols``, the length of the longest passage that ends there."""
        state = size = 0
        out = []
        for c in symbols:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            else:
                size = 0
            out.append(size)
        return out


#: Shares of the answer's words in passages of the question, and of the question given back, from which an answer is a copy.
COPIED, GIVEN_BACK = 0.8, 0.5


def copied(question: str, answer: str, least: int = 2) -> tuple[float, float]:
    """Share of the answer's words in passages of the question of ``least`` words or more, and of the question given back; both 0 where the first is no copy's."""
    asked, said = words(question), words(answer)
    while said and said[0] in FRAMING and said[: len(FRAMING)] != asked[: len(FRAMING)] and said[0] != (asked[0] if asked else ""):
        said = said[1:]
    if not asked or not said:
        return 0.0, 0.0
    known = set(asked)
    inside = sum(w in known for w in said)
    if inside < COPIED * (len(said) - sum(w in FRAMING and w not in known for w in said)):
        return 0.0, 0.0  # no cover can reach the share of a copy
    lengths = SuffixAutomaton(asked).matches(said)
    covered = [False] * len(said)
    for end, size in enumerate(lengths):
        if size >= least and (end + 1 == len(lengths) or lengths[end + 1] <= size):
            covered[end + 1 - size : end + 1] = [True] * size
    neutral = [not c and w in FRAMING for c, w in zip(covered, said, strict=True)]
    given = {w for c, w in zip(covered, said, strict=True) if c}
    return sum(covered) / max(1, len(said) - sum(neutral)), sum(w in given for w in asked) / len(asked)


_ITEM = re.compile(r"\s*(?:\d+[.)]|[-*+•])\s+\S")
_CLOSERS = "\"'”’»)]`*_」』）"
_ENDS = ".!?…。！？:;"
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "」": "「", "）": "（"}


def open_delimiters(text: str) -> list[str]:
    """The stack of delimiters left open outside code: fences, code marks, brackets and double quotes."""
    stack: list[str] = []
    pieces = text.split("```")
    if len(pieces) % 2 == 0:
        return ["```"]
    for prose in pieces[::2]:
        stack = []
        spans = prose.split("`")
        if len(spans) % 2 == 0:
            stack.append("`")
            continue
        for span in spans[::2]:
            for c in span:
                if c in "([{“«「（":
                    stack.append(c)
                elif c in _PAIRS:
                    if stack and stack[-1] == _PAIRS[c]:
                        stack.pop()
                elif c == '"':
                    if stack and stack[-1] == '"':
                        stack.pop()
                    else:
                        stack.append('"')
    return stack


def stops_early(answer: str) -> bool:
    text = answer.rstrip()
    if text.endswith("...") and len(text) > 3:
        return True
    if open_delimiters(text):
        return True
    if text.endswith("```"):
        return False
    line = text.rsplit("\n", 1)[-1].strip()
    bare = line.rstrip(_CLOSERS)
    if not bare or bare[-1] in _ENDS[:-2]:
        return False
    if bare[-1] in ":;,，、":
        return True
    if len(text.split()) == 1 and (text.isalnum() or "`" not in text):
        return False
    ends_code = line.endswith("`") or bool(_PATH.fullmatch(line.split()[-1])) or bool(re.search(r":\d+$", line))
    if _ITEM.match(line) and (ends_code or line[-1] in _CLOSERS):
        return False
    return not (ends_code and len(words(_CODE.sub(" ", line))) <= 1)


def language(text: str) -> str | None:
    """The language that most stopwords, or an own script, vote for; None where too little is said."""
    plain = _PATH.sub(" ", _QUOTED.sub(" ", _CODE.sub(" ", text)))
    kana = len(re.findall(r"[ぁ-ヿ]", plain))
    han = len(re.findall(r"[㐀-鿿]", plain))
    cyrillic = len(re.findall(r"[Ѐ-ӿ]", plain))
    latin = len(re.findall(r"[A-Za-zÀ-ÿ]", plain))
    if (kana + han) * 2 > latin + cyrillic and kana + han >= 3:
        return "ja" if kana * 5 > han else "zh"
    if cyrillic > latin and cyrillic >= 6:
        return "ru"
    own = _WORD.findall(normal(plain))
    voters = _stopwords()
    votes = dict.fromkeys(STOPWORDS, 0)
    for w in own:
        for k in voters.get(w, ()):
            votes[k] += 1
    best = max(votes, key=lambda k: votes[k])
    rest = max(v for k, v in votes.items() if k != best)
    return best if votes[best] >= 2 and votes[best] > 1.3 * rest else None


@functools.lru_cache(1)
def _stopwords() -> dict[str, list[str]]:
    """The languages a word votes for."""
    found: dict[str, list[str]] = {}
    for k, v in STOPWORDS.items():
        for w in set(v.split()):
            found.setdefault(w, []).append(k)
    return found


def defect(question: str | None, answer: str | None) -> str | None:
    """The defect of a pair, or None."""
    if answer is None:
        return "empty"
    said = [w for w in words(_TAG.sub(" ", answer)) if w.strip("_")]
    if not said or (len(said) <= 3 and " ".join(said) in PLACEHOLDERS):
        return "empty"
    if question:
        given, back = copied(question, answer)
        if given >= COPIED and back >= GIVEN_BACK:
            return "copy"
    if refuses(answer):
        return "refusal"
    if stops_early(answer):
        return "truncated"
    if question and (a := language(answer)) and (q := language(question)) and a != q:
        return "language"
    return None


def defects(answers: DataFrame) -> DataFrame:
    """``answer_id, defect``: one row per defective answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds = [], []
            for answer_id, question, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind := defect(question, answer):
                    ids.append(answer_id)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], ["answer_id", "defect"])

    return answers.select("answer_id", "user_question", "answer_text").mapInArrow(run, "answer_id bigint, defect string").distinct()
