import pytest

from tesserae.llm import pairs

Q = "Where is `LineIndex` defined?"


@pytest.mark.parametrize(
    ("question", "answer", "kind"),
    [
        (Q, None, "empty"), (Q, " \n", "empty"), (Q, "```", "empty"), (Q, "N/A", "empty"), (Q, "<br/>", "empty"), (Q, "**Answer:** \n", "empty"),
        (Q, "> " + Q, "copy"), (Q, "Q: " + Q + "\nA: " + Q, "copy"), (Q, "The question is: where is `LineIndex` defined?", "copy"),
        (Q, 'You ask: "' + Q + '" It is in `core/x.py` and nowhere else.', None), (Q, "`LineIndex`", None),
        (Q, "I'm sorry, but I can't help with that.", "refusal"), ("Wo ist das?", "Das kann ich leider nicht beantworten.", "refusal"),
        (Q, "The limit is 3. It answers \"sorry, no such line\" when it is missing.", None),
        (Q, "The limit is checked by `x`. You can't call it twice; the second call is unable to load.", None),
        (Q, "It starts in `a/b.c` and then the who", "truncated"), (Q, "See this:\n```\ndef f():\n    retu", "truncated"), (Q, "The limit is 4 (see", "truncated"),
        (Q, "It is:\n1. `a` in `b/c.py`\n2. `d` in `e/f.py`", None), (Q, "760", None), (Q, "Yes.", None), (Q, "`a/b.py:12`", None),
        (Q, "Das geschieht in der Datei, gleich nach dem Einlesen der Liste.", "language"), (Q, "Это происходит сразу после чтения файла.", "language"),
        (Q, 'It is there. (in German comments: "Das Modul liest die Datei und der Parser wartet.")', None),
        (None, "It is defined in the first file.", None), ("", "", "empty"),
    ],
)
def test_defect(question, answer, kind):
    assert pairs.defect(question, answer) == kind


def test_automaton_agrees_with_brute_force():
    import random

    random.seed(8)
    for _ in range(200):
        a = [random.choice("abc") for _ in range(random.randint(0, 12))]
        b = [random.choice("abcd") for _ in range(random.randint(0, 12))]
        passages = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        expected = [max((k for k in range(1, e + 2) if tuple(b[e + 1 - k : e + 1]) in passages), default=0) for e in range(len(b))]
        assert pairs.SuffixAutomaton(a).matches(b) == expected


def test_rows(spark):
    rows = [(1, Q, None, "x"), (1, Q, None, "x"), (2, Q, "It is in the file `a.py`.", "x"), (3, None, "word " * 50_000 + "end.", "x")]
    df = spark.createDataFrame(rows, "answer_id bigint, user_question string, answer_text string, defect string")
    assert [tuple(r) for r in pairs.defects(df).collect()] == [(1, "empty")]
    assert pairs.defects(df.limit(0)).count() == 0
