from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwright.operators.packed import explode_packed, split_array

CASES = [
    (None, []), ("", []), (" ", []), (",", []), ('""', []), ("a,,b;；c", ["a", "b", "c"]), ('"layout; two, three",author\'s copy', ["layout; two, three", "author's copy"]),
    ('["retry", "the \\"gold\\" set"]', ["retry", 'the "gold" set']), (" top-k / to read ", ["top-k", "to read"]), ("i/o, 'old / new'", ["i/o", "old / new"]),
    ('"to read"\r\n\'xml\'\r\n', ["to read", "xml"]), ("“组会，周三”、x_y", ["组会，周三", "x_y"]), ('"a ""b"" c";d', ['a "b" c', "d"]), ('"unclosed, x', ['"unclosed', "x"]),
    ("a/b", ["a/b"]), ("[a] , [b]", ["[a]", "[b]"]), ("[]", []), ("x　| y", ["x", "y"]), ("b, b", ["b", "b"]), ("𝒳|é", ["𝒳", "é"]),
]


def split(texts):
    row, pos, values = split_array(pa.array(texts, pa.string()))
    out = defaultdict(list)
    for r, p, v in zip(row, pos, values.to_pylist()):
        assert p == len(out[r]) + 1
        out[r].append(v)
    return [out[i] for i in range(len(texts))]


@pytest.mark.parametrize("text,want", CASES)
def test_one(text, want):
    assert split([text]) == [want]


def test_all_at_once():
    assert split([t for t, _ in CASES]) == [w for _, w in CASES]


def test_very_long():
    assert split(["a," * 200_000 + '"x,y"'])[0] == ["a"] * 200_000 + ["x,y"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("abc é地/'", min_size=1, max_size=6).map(str.strip).filter(lambda v: v and "'" not in v and not v.startswith("/") and not v.endswith("/") and " /" not in v and "/ " not in v), max_size=5), min_size=1, max_size=6))
def test_round_trip(rows):
    assert split([",".join(f'"{v}"' for v in r) for r in rows]) == rows
    assert split([" ; ".join(r) for r in rows]) == rows


def test_frame(spark):
    df = spark.createDataFrame([(1, "a,b", "z", 9), (2, None, "y", 9), (1, "a,b", "z", 9)], "id int, tags string, tag string, pos int")
    got = explode_packed(df, "tags").collect()
    assert sorted((r.id, r.pos, r.tag) for r in got) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert explode_packed(df.limit(0), "tags").count() == 0
