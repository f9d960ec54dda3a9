import csv
import io
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from maillake.operators.rejects import LineIndex, check_lines, check_messages, existing_times, line_reasons, load_lines, message_reasons, records_of, split_rejects

GOOD = "Message-ID: <1.mx@x.example>\nDate: Thu, 25 Jun 1998 21:28:11 -0700\nFrom: a@x.example\nTo: b@x.example,\n c@x.example\n\nbody: \"text\n"
LINE = 'm/sent/1.,1.ix@x.example,1999-02-13 17:16:14,a@x.example,11,76464,"one, ""two"""'


def reasons(spark, message):
    df = spark.createDataFrame([(1, message)], "id int, message string")
    return check_messages(df, ["id"]).first()["reasons"]


@pytest.mark.parametrize(
    "change, want",
    [
        (lambda m: m, []),
        (lambda m: m.replace("\n", "\r\n"), []),
        (lambda m: m.replace("Message-ID: <1.mx@x.example>\n", ""), ["missing_message_id"]),
        (lambda m: m.replace("From: a@x.example", "from:  "), ["missing_sender"]),
        (lambda m: m.replace("25 Jun", "31 Jun"), ["unparseable_date"]),
        (lambda m: m.replace("1998", "2044"), ["date_out_of_range"]),
        (lambda m: m.replace("To: b", 'To: "B <b'), ["broken_quoting"]),
        (lambda m: m.replace("\n c@x", '\n "c@x'), ["broken_quoting"]),
        (lambda m: m.replace("\n\nbody", "\nbody"), ["no_body_break"]),
        (lambda m: m.replace("From:", "noise here\nFrom:"), ["bad_header_line"]),
        (lambda m: m.replace("From:", "From here: x\nFrom:"), ["bad_header_line"]),
        (lambda m: "", ["missing_message_id", "missing_sender", "unparseable_date", "no_body_break"]),
        (lambda m: None, ["missing_message_id", "missing_sender", "unparseable_date", "no_body_break"]),
        (lambda m: "\n" + m, ["missing_message_id", "missing_sender", "unparseable_date"]),
    ],
)
def test_messages(spark, change, want):
    assert reasons(spark, change(GOOD)) == want


@pytest.mark.parametrize(
    "line, want",
    [
        (LINE, []),
        (LINE.replace('"one, ""two"""', ""), []),
        (LINE[:-1], ["broken_quoting"]),
        (LINE.replace('"one, ""two"""', 'the "big" one'), ["broken_quoting"]),
        (LINE.replace('"one, ""two"""', '"one" two'), ["broken_quoting"]),
        (LINE.replace('"one, ""two"""', 'one"'), ["broken_quoting"]),
        (LINE.replace('"one, ""two"""', "one, two"), ["wrong_column_count"]),
        (LINE.replace(",", ";"), ["broken_quoting"]),
        (LINE.replace("1999-02-13", "1999-02-30"), ["invalid_value"]),
        (LINE.replace("a@x.example", "@x.example"), ["invalid_value"]),
        (LINE.replace(",11,", ",-3,"), ["invalid_value"]),
        (LINE.replace("76464", "12kB"), ["invalid_value"]),
        ("", ["wrong_column_count"]),
        (None, ["wrong_column_count"]),
    ],
)
def test_lines(spark, line, want):
    df = spark.createDataFrame([(1, line)], "line_id bigint, line string")
    assert check_lines(df, ["line_id"]).first()["reasons"] == want


def slow_line(line, columns):
    """Field by field, character by character."""
    fields, k = 0, 0
    while True:
        fields += 1
        if line[k : k + 1] == '"':
            k += 1
            while True:
                end = line.find('"', k)
                if end < 0:
                    return ["broken_quoting"]
                if line[end + 1 : end + 2] == '"':
                    k = end + 2
                    continue
                k = end + 1
                break
            if k < len(line) and line[k] != ",":
                return ["broken_quoting"]
        else:
            end = line.find(",", k)
            end = len(line) if end < 0 else end
            if '"' in line[k:end]:
                return ["broken_quoting"]
            k = end
        if k >= len(line):
            return [] if fields == columns else ["wrong_column_count"]
        k += 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='",a\né', max_size=14), max_size=8))
def test_lines_like_a_slow_parser(lines):
    assert line_reasons(pa.array(lines, pa.string()), 3) == [slow_line(x, 3) for x in lines]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='",a é', max_size=6), min_size=3, max_size=3), min_size=1, max_size=5))
def test_written_lines_load(rows):
    lines = []
    for row in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(row)
        lines.append(out.getvalue())
    assert all(r == [] for r in line_reasons(pa.array(lines), 3))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab:\n \t"-é', max_size=20), max_size=6))
def test_bad_header_lines_like_a_slow_parser(blocks):
    blocks = [re.sub("\n+", "\n", b).strip("\n") for b in blocks]
    got = message_reasons(pa.array(blocks, pa.string()), np.ones(len(blocks), bool))
    for b, r in zip(blocks, got):
        bad = any(not re.match(r"[ \t]|[A-Za-z0-9-]+:", x) for x in b.split("\n") if x)
        assert ("bad_header_line" in r) == bad


def test_split_and_clashing_names(spark):
    df = spark.createDataFrame([(1, GOOD, "x"), (2, "broken", "y"), (3, None, None)], "id int, message string, reason string")
    good, bad = split_rejects(df, "message")
    assert [r["id"] for r in good.collect()] == [1] and good.columns == df.columns
    assert sorted(r["id"] for r in bad.collect()) == [2, 3]
    assert bad.where("id = 2").first()["reason"].startswith("missing_message_id; missing_sender")


def test_empty_tables_and_long_messages(spark):
    assert check_messages(spark.createDataFrame([], "id int, message string"), ["id"]).count() == 0
    assert check_lines(spark.createDataFrame([], "line_id bigint, line string"), ["line_id"]).count() == 0
    assert reasons(spark, GOOD.replace("From:", "X: " + "y" * 300_000 + "\nFrom:")) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='",a é', max_size=6), min_size=3, max_size=3), min_size=1, max_size=5))
def test_fields_come_back(rows):
    lines = []
    for row in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(row)
        lines.append(out.getvalue())
    index = LineIndex(pa.array(lines))
    assert [list(r) for r in zip(*(index.field(k, np.arange(len(rows))).to_pylist() for k in range(3)))] == rows


@pytest.mark.parametrize("text, there", [("2000-02-29 23:59:59", True), ("1900-02-29 00:00:00", False), ("2001-04-31 00:00:00", False), ("2001-13-01 00:00:00", False), ("2001-01-01 24:00:00", False), ("2001-01-01  0:00:00", False), ("", False), ("2001-01-01 00:00:00\n", False)])
def test_existing_times(text, there):
    assert existing_times(pa.array([text, "x"], pa.large_string())).tolist() == [there, False]


def test_loaded_lines_have_fields(spark):
    df = spark.createDataFrame([(1, LINE), (2, LINE[:-1]), (3, None)], "line_id bigint, line string")
    assert [(r["line_id"], r["fields"][3], r["fields"][6]) for r in load_lines(df).collect()] == [(1, "a@x.example", 'one, "two"')]
    assert load_lines(df.limit(0)).count() == 0


def test_records_over_several_lines(spark, monkeypatch):
    monkeypatch.setattr("maillake.operators.rejects.BLOCK_LINES", 4)
    wanted = [["a", f"one\ntwo, {k}\n\nthree" if k % 3 else "plain", 'say "x"\n' if k % 5 == 0 else ""] for k in range(30)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(wanted)
    text = out.getvalue().removesuffix("\n").split("\n")
    df = spark.createDataFrame([(s, k, x) for s in ("f", None) for k, x in enumerate(text)], "source string, n bigint, line string")
    got = records_of(df, "source", "n", "line").where("source = 'f'").orderBy("n").collect()
    assert [next(csv.reader([r["line"]], strict=True)) if "\n" not in r["line"] else next(csv.reader(io.StringIO(r["line"], newline=""))) for r in got] == wanted
    assert sum(r["lines"] for r in got) == len(text) and records_of(df, "source", "n", "line").count() == 60
    assert check_lines(records_of(df, "source", "n", "line"), ["n"], "line", 3, None).where("size(reasons) > 0").count() == 0


def test_a_quote_that_is_never_closed_joins_no_file(spark):
    df = spark.createDataFrame([("f", k, '"open' if k == 5 else "a,b,c") for k in range(50)], "source string, n bigint, line string")
    got = records_of(df, "source", "n", "line", most_lines=10)
    assert got.count() == 50 and check_lines(got, ["n"], "line", 3, None).where("size(reasons) > 0").count() == 1


def test_archive_with_structure_checks(spark):
    from maillake.operators import mail

    raw = spark.createDataFrame([("m/1.", GOOD), ("m/2.", GOOD.replace("1.mx", "2.mx").replace("To: b", 'To: "B <b')), ("m/3.", None)], "file string, message string")
    mails, _, quarantine, counts = mail.load_archive(raw, max_share=1.0, structure=True)
    assert [r["file"] for r in mails.collect()] == ["m/1."] and counts["quarantined_rows"] == 2
    assert {r["file"]: r["reason"].split("; ")[-1] for r in quarantine.collect()} == {"m/2.": "broken_quoting", "m/3.": "no_body_break"}
