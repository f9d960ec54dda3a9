import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maillake.functions import packed as P
from maillake.operators.packed import PLAIN, unpack


def frame(spark, values):
    # Enough plain structure for the code table, as a corpus has it.
    filler = ["Ann Lee <ann@x.example>", '"Lee, Ann" <ann@x.example>', "legal dept", '"Desk A, Desk B"', "'bo@x.example'", "<cy@x.example>"] * 20
    return spark.createDataFrame([(k, v) for k, v in enumerate([*values, *filler, *["a@x.example"] * 100])], "id int, packed string")


@pytest.mark.parametrize(
    "text, items",
    [
        ("a@x.example; b@x.example;", ["a@x.example", "b@x.example"]),
        ("a@x.example, ;B@X.EXAMPLE, ;c@x.example ;", ["a@x.example", "b@x.example", "c@x.example"]),
        ('"Lee, Ann" <ann@x.example>, "Desk A, Desk B"', ["ann@x.example", "desk a, desk b"]),
        ("'a@x.example' 'b@x.example'", ["a@x.example", "b@x.example"]),
        ("a@x.example and b@x.example", ["a@x.example", "b@x.example"]),
        ("| a@x.example | legal dept |", ["a@x.example", "legal dept"]),
        ("Board: 'a@x.example', \"Lee, Ann\" <ann@x.example>;", ["a@x.example", "ann@x.example"]),
        ("a@x.example\n<b@x.example>\n\"Desk A, Desk B\"", ["a@x.example", "b@x.example", "desk a, desk b"]),
        ('"Desk A, Desk B" / "Desk A, Desk B"', ["desk a, desk b", "desk a, desk b"]),
        ("a@x.example & b@x.example", ["a@x.example", "b@x.example"]),
    ],
)
def test_dialects(spark, text, items):
    got = unpack(frame(spark, [text])).where("id = 0").orderBy("pos").collect()
    assert [r["item"] for r in got] == items and [r["pos"] for r in got] == list(range(1, len(items) + 1))


@pytest.mark.parametrize(
    "text, items",
    [
        # an escaped delimiter or quote belongs to its item
        ('"Lee \\"Al, Bo\\" Ann" <ann@x.example>, "Roe, \\"R\\" Bo" <bo@x.example>', ["ann@x.example", "bo@x.example"]),
        ('"Lee, ""Al, Bo"" Ann" <ann@x.example>; "Desk A, Desk B"', ["ann@x.example", "desk a, desk b"]),
        ("'Lee, Ann' <ann@x.example>, 'Roe, Bo' <bo@x.example>", ["ann@x.example", "bo@x.example"]),
    ],
)
def test_quotes_and_escapes(text, items):
    codes = P.CodeTable({"A": 1000, "Q <A>": 100, "Q": 60, "W W <A>": 50, "'W, W' <A>": 5})
    assert [P.bare(i) for i in P.cheapest(text, codes)[1]] == items


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.\\;,'\" |/&-x", max_size=25))
def test_bare_addresses_are_whole_in_any_case(text):
    codes = P.CodeTable({"A": 100, "Q <A>": 10})
    if re.search(PLAIN, text.strip(" ")):
        assert P.cheapest(text, codes) == (0, [text.strip()])
    else:
        assert len(P.cheapest(text, codes)[1]) <= len(text)


def test_long_codes_stand_by_their_digest():
    sign = "W," * 100
    codes = P.CodeTable({P.code_of(sign): 50, "W": 10})
    assert len(P.code_of(sign)) < 40 and P.code_of("W W") == "W W"
    assert codes.cost(sign, 200) < 8 * len(sign) / 50 + 4 < codes.cost("W;" * 100, 200)


@pytest.mark.parametrize("text", [None, "", "   ", "a@x.example", "a@x.example ;", '"Lee, Ann" <ann@x.example>', "legal dept", ",", '"'])
def test_one_or_none(spark, text):
    assert unpack(frame(spark, [text])).where("id = 0").count() == 0


def test_singles_repeats_long_and_clashes(spark):
    long = "; ".join(f"p{k}@x.example" for k in range(3000))
    df = frame(spark, [long, "a@x.example, b@x.example", "a@x.example, b@x.example"]).selectExpr("id", "packed", "'mine' AS item", "1 AS other")
    out = unpack(df)
    assert out.columns == ["id", "packed", "other", "dialect", "pos", "item"]
    assert out.where("id = 0").count() == 3000
    assert out.where("id IN (1, 2)").count() == 4
    assert unpack(df, singles=True).where("item = 'a@x.example'").count() >= 100


def test_empty_table(spark):
    assert unpack(spark.createDataFrame([], "id int, packed string")).count() == 0


def test_unclosed_quote_protects_nothing():
    codes = P.CodeTable({"A": 100, "Q <A>": 10, '"W <A>': 1})
    assert [P.bare(i) for i in P.cheapest('"Lee <a@x.example>, b@x.example', codes)[1]] == ["a@x.example", "b@x.example"]


# A blank also stands between name and address, so there only lists of bare names are clear.
@pytest.mark.parametrize(
    "delimiter, item",
    [(d, '"Lee, Ann" <p{}@x.example>') for d in (", ", "; ", " | ", " / ", " & ", " and ", "\t", "\n", ", ;", "; , | ")]
    + [(d, '"Desk A, Desk {}"') for d in (", ", "; ", " | ", " / ", " & ", " and ", "\t", "\n", " ", ", ;", "; , | ")],
)
def test_long_lists_of_names_are_split(delimiter, item):
    # As many items as at scale 0.1: a rare code is dear, and the list still isn't one value.
    codes = P.CodeTable({"A": 80_000, "<A>": 1000, "W W <A>": 500, "Q <A>": 200, "Q": 200, "W W": 100})
    text = delimiter.join(item.format(k) for k in range(1000))
    assert len(P.cheapest(text, codes)[1]) == 1000
