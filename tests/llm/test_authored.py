import pytest

from maillake.llm import authored as A
from maillake.llm import mailtext as M
from maillake.llm.entities import NameModel

NAMES = NameModel(["Onnis", "Ilvette"], ["Sarvobury", "Sarvafell", "Haskimont", "Haskefell"])
OWN = "We can move it on Friday.\n"


def marked(body, encoded=False):
    lines, spans = M.logical_lines(body, encoded)
    return [n for (a, z), f in zip(spans, M.Structure(lines, NAMES).flags) if f for n in range(a, z + 1)]


@pytest.mark.parametrize(
    "tail, lines",
    [
        ("\nOn Tue, 12 Dec 2000, Haskimont, Ilvette wrote:\n> old\n> \nno\n> older", [3, 4, 5, 7]),
        ("Le 14/9/2000, Ilvette Haskimont a écrit :\n| old\n| older", [2, 3, 4]),
        ("At 03:03 10/08/2001, you (a@x.example) said:\n  : old\n  : \n  : older", [2, 3, 4, 5]),
        ("IH> old\nThanks\nIH> older", [2, 4]),
        ("-----Original Message-----\nFrom: x\nSent: y\nTo: z\n\nold", [2, 3, 4, 5, 7]),
        ("------ Forwarded by O S/NM/OFF on 02/12/2000 12:11 PM ------\n\nX on 02/12/2000 12:11 PM\nTo: y\n\nold", [2, 4, 5, 7]),
        ("<<< begin forwarded message >>>\nVon: x\nold\n<<< end >>>\nand mine", [2, 3, 4, 5]),
        ("________________________________\nFrom: a@x.example\nSent: Tuesday 0:54\nTo: b@x.example\n\nold", [2, 3, 4, 5, 7]),
        ("Onnis Sarvobury@OFFICE\n03/29/2001 03:25 PM\nTo:\tx@OFFICE\ncc:\t \nold", [2, 3, 4, 5, 6]),
        ("\nOnnis\n--\nOnnis Sarvobury\nAnalyst\nTel. 555-0124", [4, 5, 6, 7]),
        ("\n*****\nONNIS SARVOBURY\nFirm, Head\nE-mail: o@x.example\n*****", [3, 4, 5, 6, 7]),
        ("Onnis Sarvobury | Analyst | Firm | 555-0124", [2]),
        ("\n======================\nIF YOU ARE NOT AN INTENDED READER, ERASE ALL COPIES.", [3, 4]),
        ("Sent from my two-way pager", [2]),
        # these only look like it
        ("From: the desk we heard nothing so far.", []),
        ("Sent: 24 boxes. Received: 4.", []),
        ("On Sunday the group wrote: pass it, so we did.", []),
        ("____ yes   ____ no   (tick one and send it back)", []),
        ("-- trader first, then the levee.", []),
        ("Forwarded by courier, not by mail: one folder.", []),
        ("Is the soft raffle confidential? Legal says no.", []),
        ("Thanks,\nOnnis", []),
        ("Onnis Sarvobury needs the invoice today.", []),
    ],
)
def test_marks(tail, lines):
    assert [n for n in marked(OWN + tail) if (OWN + tail).split("\n")[n - 1].strip()] == lines


def test_soft_breaks_keep_physical_lines():
    assert marked("mine =\ngoes on\n> old =\nold goes on\nmine", True) == [3, 4]
    assert marked("Le 9/12/1998, Ilvette a =C3=A9crit :\n| x", True) == [1, 2]


def mails(spark, rows):
    return spark.createDataFrame(rows, "tbl string, row_key string, text string, is_message boolean, subject string, sender string, dated string")


PARENT = "The quarterly reserve has to be counted twice before Friday.\nPlease send all of the numbers to the other desk."


def test_ancestors_prove_unmarked_history(spark):
    answer = "I did that already, see what you asked for:\n\n" + PARENT
    rows = [
        ("emails", "1", PARENT, False, "Reserve", "a@x", "1 Jan 2001 10:00:00 +0000"),
        ("emails", "2", answer, False, "RE: reserve", "b@x", "2 Jan 2001 10:00:00 +0000"),
        ("emails", "3", PARENT, False, "FW: Reserve", "c@x", "3 Jan 2001 10:00:00 +0000"),  # that mail sent again
        ("emails", "4", answer, False, "Other thread", "b@x", "2 Jan 2001 10:00:00 +0000"),
        ("emails", "5", None, False, "Reserve", "b@x", None), ("emails", "6", "", False, None, None, None),
    ]
    got = sorted(tuple(r) for r in A.not_own_lines(mails(spark, rows), NAMES).collect())
    assert got == [("emails", "2", 3), ("emails", "2", 4)]


def test_short_answer_above_history_and_repeated_rows(spark):
    rows = [
        ("emails", "1", PARENT, False, "Reserve", "a@x", "1 Jan 2001 10:00:00 +0000"),
        ("emails", "2", "OK, done.\n\n" + PARENT, False, "RE: reserve", "b@x", "2 Jan 2001 10:00:00 +0000"),
        *[("emails", "3", "I did that already, see what you asked for:\n\n" + PARENT, False, "RE: reserve", "c@x", "3 Jan 2001 10:00:00 +0000")] * 2,
        *[("emails", "4", PARENT, False, "FW: Reserve", "d@x", "4 Jan 2001 10:00:00 +0000")] * 2,  # that mail sent again
        ("emails", "5", "Second version\n" + PARENT, False, "Reserve", "Ann Lee <A@X>", "5 Jan 2001 10:00:00 +0000"),  # by the same sender
    ]
    got = sorted(tuple(r) for r in A.not_own_lines(mails(spark, rows), NAMES).collect())
    assert got == [("emails", k, n) for k in "23" for n in (3, 4)]


def test_history_behind_closing_words(spark):
    parent = PARENT + "\nOK?\nAnn"
    rows = [
        ("emails", "1", parent, False, "Reserve", "a@x", "1 Jan 2001 10:00:00 +0000"),
        ("emails", "2", "Done.\nThanks,\nBo\n\n" + parent, False, "RE: reserve", "b@x", "2 Jan 2001 10:00:00 +0000"),
        ("emails", "3", "Thanks.\n\n" + parent, False, "RE: reserve", "c@x", "3 Jan 2001 10:00:00 +0000"),
    ]
    got = sorted(tuple(r) for r in A.not_own_lines(mails(spark, rows), NAMES).collect())
    assert got == [("emails", "2", n) for n in (5, 6, 7, 8)] + [("emails", "3", n) for n in (3, 4, 5, 6)]


def test_wrapped_and_prefixed_history(spark):
    # Overlaps are found and followed wherever lines break; what only touches an overlap is new.
    wrapped = "Done, more below.\n\nThe quarterly reserve has to be\ncounted twice before Friday. Please send all\nof the numbers to the other desk."
    prefixed = "Not yet.\n\n[a] The quarterly reserve has to be counted twice before Friday.\n[a] Please send all of the numbers to the other desk."
    cited = "You ask me to send all of the numbers to the other desk, but I gave every one of them to the auditors a week ago."
    rows = [
        ("emails", "1", PARENT, False, "Reserve", "a@x", "1 Jan 2001 10:00:00 +0000"),
        *[("emails", k, t, False, "RE: reserve", f"{k}@x", "2 Jan 2001 10:00:00 +0000") for k, t in (("2", wrapped), ("3", prefixed), ("4", cited))],
    ]
    got = sorted(tuple(r) for r in A.not_own_lines(mails(spark, rows), NAMES).collect())
    assert got == [("emails", "2", 3), ("emails", "2", 4), ("emails", "2", 5), ("emails", "3", 3), ("emails", "3", 4)]


def test_long_history_is_compared_as_a_whole():
    theirs = [" ".join(f"w{k * 7919 % 6007}x{j}" for j in range(12)) for k in range(3000)]
    words, starts = A._words(theirs)
    chunks = {c["print"]: (c["offset"], c["words"]) for c in A._chunks(theirs, {p: 1 for p, _, _ in A._prints(words, starts)})}
    opened = [{"text": t, "first": k, "last": k, "paragraph": 0} for k, t in enumerate(["Yes, mine.", *theirs])]
    assert [x["first"] for x in A._overlapping(opened, chunks)] == list(range(1, 3001))


def test_repeated_closings(spark):
    closing = "Ask me anything about gas any time"
    rows = [("emails", str(k), f"Number {k} is here.\nBest\n{closing}", False, f"s{k}", "a@x", None) for k in range(4)]
    rows += [("emails", "9", f"Number nine.\nBest\n{closing}", False, "s9", "b@x", None)]
    got = {(r["row_key"], r["line_no"]) for r in A.not_own_lines(mails(spark, rows), NAMES).collect()}
    assert got == {(str(k), 3) for k in range(4)}


def test_messages_and_empty_tables(spark):
    message = "Subject: x\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nmine =\r\nmore\r\n> old\r\n"
    rows = [("raw_emails", "f", message, True, None, None, None), ("raw_emails", "f", message, True, None, None, None), ("raw_emails", "g", "no body", True, None, None, None), ("raw_emails", "h", None, True, None, None, None)]
    assert [tuple(r) for r in A.not_own_lines(mails(spark, rows), NAMES).collect()] == [("raw_emails", "f", 3)]
    assert A.not_own_lines(mails(spark, []), NAMES).count() == 0


def test_new_text(spark):
    df = spark.createDataFrame([(1, "mine\n> old\nmine too", "x"), (2, None, ""), (3, "", "")], "id int, t string, new_text string")
    assert {r["id"]: r["new_text"] for r in A.new_text(df, "t", NAMES).collect()} == {1: "mine\nmine too", 2: None, 3: ""}


def test_very_long_body():
    assert marked("word " * 100_000 + "\n> old") == [2]
    assert len(marked("\n".join(["> old"] * 20_000))) == 20_000


def test_own_texts_of_messages_and_history(spark):
    message = "Subject: x\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nmine =\r\nmore\r\nLe 9/12/1998, Ilvette a =C3=A9crit :\r\n| old =\r\nold goes on\r\n"
    rows = [
        *[("raw_emails", "f", message, True, None, None, None)] * 2,
        ("raw_emails", "g", "no body", True, None, None, None), ("raw_emails", "h", None, True, None, None, None),
        ("emails", "1", PARENT, False, "Reserve", "a@x", "1 Jan 2001 10:00:00 +0000"),
        ("emails", "2", "OK, done.\n\n" + PARENT, False, "RE: reserve", "b@x", "2 Jan 2001 10:00:00 +0000"),
        ("emails", "3", "", False, None, None, None), ("emails", None, "mine\n> old", False, None, None, None),
    ]
    got = [tuple(r) for r in A.own_texts(mails(spark, rows), NAMES).collect()]
    own = ("raw_emails", "f", "mine =\r\nmore\r\n")
    want = [own, own, ("raw_emails", "g", None), ("raw_emails", "h", None), ("emails", "1", PARENT), ("emails", "2", "OK, done.\n"), ("emails", "3", ""), ("emails", None, "mine")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_footers_that_many_senders_share(spark):
    # Worded like no phrase of the list: only that many senders end their mails with it tells.
    footer = "Whoever prints this page waters one tree in the yard behind the house."
    own = "The same long sentence stands in the middle of all of these mails."
    rows = [("emails", f"m{k}", f"Note {k} on the weekly count.\n\n{own}\n\nSee you at {k}.\n\n{footer}", False, f"Matter {k}", f"p{k % 12}@x.example", None) for k in range(24)]
    got = {tuple(r) for r in A.not_own_lines(mails(spark, rows), NAMES).collect()}
    assert got == {("emails", f"m{k}", 7) for k in range(24)}
    few = [(*r[:5], f"p{int(r[1][1:]) % 9}@x.example", r[6]) for r in rows]
    assert A.not_own_lines(mails(spark, few), NAMES).count() == 0


@pytest.mark.parametrize(
    "tail, lines",
    [
        ("\nThis mail is for the exclusive use of the addressee.", [3]),
        ("\nIt holds proprietary information and must not be disclosed to third parties.", [3]),
        ("\nOp dinsdag 3 april 2001 schreef Onnis Sarvobury:\n> oud", [3, 4]),
        ("\nOn Tue, 12 Dec 2000, " + "Haskimont, Ilvette and " * 20 + "others wrote:\n> old", [3, 4]),
        ("\nFrom: x\nX-To: y\nCc: z\n\nBcc: a\nCc: b\nCc: c\nCc: d\nCc: e\nSent: f\nTo: g\nold", []),
        ("\nFrom: x\n" + "Cc: b\n" * 9 + "Sent: f\nTo: g\nold", list(range(3, 16))),
        ("\nPlease unsubscribe me from the list.", []),
        ("\nWe make no binding offer today.", []),
    ],
)
def test_ordinary_wording(tail, lines):
    text = OWN + tail
    got = [n for n in marked(text) if text.split("\n")[n - 1].strip()]
    assert got == [n for n in lines if n <= text.count("\n") + 1]
