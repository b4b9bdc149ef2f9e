import pytest

from tesserae.operators.packed import Segmenter, split_packed


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("a.py|b.py", ["a.py", "b.py"]),
        (" ; ", []),
        ("", []),
        ('["x, y", "z"]', ["x, y", "z"]),
        ("Map<A, B>|C", ["Map<A, B>", "C"]),
        ("'a|b'|c", ["a|b", "c"]),
        ("docs/o'x notes.md;d", ["docs/o'x notes.md", "d"]),
        ('"say ""hi"", x";y', ['say "hi", x', "y"]),
        ("operator()||`a;b`||", ["operator()", "a;b"]),
        ("x < y, z", ["x < y", "z"]),
        ("a\r\nb\tc，d；e、f¦g", list("abcdefg")),
        ("'unclosed|b", ["'unclosed", "b"]),
        ("[ReaderMetric; 30]::iter, f(a, b)", ["[ReaderMetric; 30]::iter", "f(a, b)"]),
        ("a,a", ["a", "a"]),
    ],
)
def test_split(text, values):
    assert [v for v, _ in Segmenter().split(text)] == values


def test_known_value_protects_its_separator():
    assert [v for v, _ in Segmenter(["operator,"]).split("operator,|x")] == ["operator,", "x"]


def test_operator_and_large_dictionary_agree(spark):
    rows = [
        (1, "'operator,'|a", "zz"), (2, "'operator,';b", "zz"), (3, "operator,|c", "zz"), (3, "operator,|c", "zz"),
        (4, None, "zz"), (5, "", "zz"), (6, "  ", "zz"), (7, "x" * 100_000 + ",y", "zz"),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, c6 string, item_pos string")
    small = {tuple(r) for r in split_packed(df, "row_id", ["c6"]).collect()}
    large = {tuple(r) for r in split_packed(df, "row_id", ["c6"], dictionary_rows=0).collect()}
    assert small == large
    assert (3, "c6", 0, "operator,") in small and (3, "c6", 1, "c") in small
    assert {r[0] for r in small} == {1, 2, 3, 7}


@pytest.mark.parametrize("pieces", [2, 8, 40])
def test_long_known_values_are_the_same_beyond_the_bound(spark, pieces):
    value = ",".join(f"v{i} " if i % 3 == 1 else f"v{i}" for i in range(pieces)).strip()
    rows = [(1, f'"{value}"|a'), (2, f"'{value}';b"), (3, f"{value}  ;c"), (4, f"x, {value},y"), (5, f"{value[:-1]}z|d"), (6, f" {value}"), (7, f"{value},{value}"), (8, '"tail,"|x'), (9, "'tail,'"), (10, "tail, ;z"), (11, "tail, z")]
    df = spark.createDataFrame(rows, "row_id bigint, c6 string")
    small = sorted(map(tuple, split_packed(df, "row_id", ["c6"]).collect()))
    assert small == sorted(map(tuple, split_packed(df, "row_id", ["c6"], dictionary_rows=0, salts=3).collect()))
    assert small == sorted(map(tuple, split_packed(df, "row_id", ["c6"], dictionary_chars=1).collect()))
    assert (3, "c6", 0, value) in small and (4, "c6", 1, value) in small and sum(r[0] == 7 for r in small) == 2


def test_empty_table(spark):
    assert split_packed(spark.createDataFrame([], "row_id bigint, c6 string"), "row_id", ["c6"]).count() == 0
