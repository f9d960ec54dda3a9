import re

import pytest

from maillake.llm import entities as E
from maillake.llm import pii
from maillake.llm import surrogates as S

GIVEN = ["Onnis", "Ilvette", "Jorusel", "Ketine", "Abor"]
FAMILY = ["Sarvobury", "Sarvafell", "Sarvogaard", "Haskimont", "Haskefell", "Haskozon", "Zwosk", "Zwesk", "Undibe", "Undilf", "Ilvim"]
NAMES = E.NameModel(GIVEN, FAMILY)
KEY = b"test key"


def found(text):
    return [(f.kind, text[f.start : f.end]) for f in E.find(text, NAMES)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mail a.b+c@x-y.example. Or D@E.TEST;", [("email", "a.b+c@x-y.example"), ("email", "D@E.TEST")]),
        ("a_b (at) x.example, c[at]mail[dot]x[dot]example", [("email", "a_b (at) x.example"), ("email", "c[at]mail[dot]x[dot]example")]),
        ("Write to a.b at mail dot x dot example, please", [("email", "a.b at mail dot x dot example")]),
        ("look at the dot on line 3 @ noon", []),
        ("+1 898 555 0115, 1-795-555-0126, (315)5550141 or 466-555-0119 ext. 790", [("phone", x) for x in ("+1 898 555 0115", "1-795-555-0126", "(315)5550141", "466-555-0119 ext. 790")]),
        ("+44 20 7946 0604 / 0044 (0)20 7946 0906 / +49 30 23125 987 / +33 1 99 00 61 54 / 020 7946 0506", [("phone", x) for x in ("+44 20 7946 0604", "0044 (0)20 7946 0906", "+49 30 23125 987", "+33 1 99 00 61 54", "020 7946 0506")]),
        ("(+1 695 555 0129) 443/555-0113 555-0151 917 555 0186 x54 +16805550104", [("phone", x) for x in ("+1 695 555 0129", "443/555-0113", "555-0151", "917 555 0186 x54", "+16805550104")]),
        ("Invoice 9185-9235-57 is for 242 4779 units. Valve 53-6410 and pump 913-77. Deal 446616 at 4.65 on 11/20/2001.", []),
        ("SSN 942-02-6402, SSN: 911389316, soc. sec. 930 16 1132", [("id_number", x) for x in ("942-02-6402", "911389316", "930 16 1132")]),
        ("passport no.: X47232978; passport ZQ 7290051; Personalausweis LH3025210; NI number QQ 18 14 81 D", [("id_number", x) for x in ("X47232978", "ZQ 7290051", "LH3025210", "QQ 18 14 81 D")]),
        ("driver's license: X394-8576-9924, license number 85565135, our file 10000805", [("id_number", "X394-8576-9924"), ("id_number", "85565135")]),
        ("at 4908 Dunmarrow Rd., Lantern Row", [("street_address", "4908 Dunmarrow Rd.")]),
        ("3095 Old Mill Street, Suite 45A, Greyfen", [("street_address", "3095 Old Mill Street, Suite 45A")]),
        ("Vive en Calle Cinder Hill 59. 24, rue de Hollin instead", [("street_address", "Calle Cinder Hill 59"), ("street_address", "24, rue de Hollin")]),
        ("Harlowweg 98, Old Miller Allee 74a, 8153 N. Saltrake Way, # 24A", [("street_address", "Harlowweg 98"), ("street_address", "Old Miller Allee 74a"), ("street_address", "8153 N. Saltrake Way, # 24A")]),
        ("Take exit 19 and follow the road to Greyfen.", []),
        ("Onnis Sarvobury and SARVOBURY, ONNIS met ilvette k. haskimont", [("person_name", x) for x in ("Onnis Sarvobury", "SARVOBURY, ONNIS", "ilvette k. haskimont")]),
        ("Ketine-Abor Zwosk, Dr. Zwesk, Frau Undibe and Mr Onnis Undilf", [("person_name", x) for x in ("Ketine-Abor Zwosk", "Zwesk", "Undibe", "Onnis Undilf")]),
        ("Jorusel Haskafell and Undim, Abor are not listed", [("person_name", "Jorusel Haskafell"), ("person_name", "Undim, Abor")]),
        ("Dear Onnis,\nThanks, Jorusel will call. Onnis", []),
        ("Sarvobury, Onnis@OFFICE", [("person_name", "Sarvobury, Onnis")]),
        ("onnis.sarvobury@x.example", [("email", "onnis.sarvobury@x.example")]),
        ("tax id 944-66-=\n9001 of Onnis Sarvo=\nbury", [("id_number", "944-66-=\n9001"), ("person_name", "Onnis Sarvo=\nbury")]),
        ("", []),
    ],
)
def test_mentions(text, want):
    assert found(text) == want


def test_found_text_stands_in_the_text():
    text = "İ Onnis Sarvobury   a@x.example =\n555-0151"
    assert [x for _, x in found(text)] == ["Onnis Sarvobury", "a@x.example", "555-0151"]


def test_long_text_and_null():
    assert E.find(None, NAMES) == []
    long = "word " * 200_000 + "a@x.example"
    assert found(long) == [("email", "a@x.example")]
    assert found("a" * 300_000 + "@") == [] and found("1" * 20_000) == []


@pytest.mark.parametrize("n", [2, 3, 4])
def test_digits_are_permuted(n):
    assert len({S.permute_digits(str(i).zfill(n), KEY, "t") for i in range(10**n)}) == 10**n


def test_surrogates_keep_type_and_writing():
    for text, kind in (("+1 898 555 0115", "phone"), ("QQ 18 14 81 D", "id_number"), ("942-02-6402", "id_number")):
        f = E.find(f"SSN {text}", NAMES)[0]
        new = S.write_like(f.kind, text, f.canon, S.surrogate(f.kind, f.canon, KEY))
        assert f.kind == kind and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", text) and new != text
    one, other, short = (S.write_like("person_name", w, c, S.surrogate("person_name", c, KEY)) for w, c in (("Onnis Sarvobury", "onnis sarvobury"), ("SARVOBURY, ONNIS", "onnis sarvobury"), ("Sarvobury", "? sarvobury")))
    assert other == f"{one.split()[1].upper()}, {one.split()[0].upper()}" and short == one.split()[1]
    assert S.surrogate("email", "a@x.example", KEY) == S.surrogate("email", "a@x.example", KEY) != S.surrogate("email", "a@x.example", b"another")


def test_addresses_keep_their_writing():
    for text in ("61, rue de Yarrow", "3095 Old Mill Street, Suite 45A", "8153 N. Saltrake Way, # 24A", "HARLOWWEG 98"):
        f = E.find(text, NAMES)[0]
        new = S.write_like(f.kind, text, f.canon, S.surrogate(f.kind, f.canon, KEY))
        shape = lambda x: re.sub(r"[a-zß-ÿ]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d", "9", x)))
        assert shape(new) == shape(text) and new != text


def archive(spark):
    raw = spark.createDataFrame([("m/1.", "From: Onnis Sarvobury <o@x.example>\n\nAsk Onnis Sarvobury.\nAsk Onnis Sarvobury."), ("m/2.", "no body"), ("m/3.", None), ("m/4.", "A: b\r\n\r\nMail o@x.example\r\n")], "file string, message string")
    emails = spark.createDataFrame([("i1", "Call SARVOBURY, ONNIS at 555-0151"), ("i2", None), ("i3", "")], "message_id string, body_clean string")
    return pii.archive_texts(raw, emails)


def test_found_rows(spark):
    got = {tuple(r)[:4] for r in pii.find_entities(archive(spark), NAMES).collect()}
    assert got == {
        ("raw_emails", "m/1.", "person_name", "Onnis Sarvobury"), ("raw_emails", "m/4.", "email", "o@x.example"),
        ("emails", "i1", "person_name", "SARVOBURY, ONNIS"), ("emails", "i1", "phone", "555-0151"),
    }


def test_surrogates_are_distinct_and_shared(spark):
    out = pii.with_surrogates(pii.find_entities(archive(spark), NAMES), KEY)
    names = {r["found_text"]: r["surrogate"] for r in out.where("kind = 'person_name'").collect()}
    given, family = names["Onnis Sarvobury"].split()
    assert names["SARVOBURY, ONNIS"] == f"{family.upper()}, {given.upper()}"


def drawn_alike(monkeypatch, words):
    """The first draw gives all of ``words`` one surrogate, and others a real word."""
    drawn = S.draw
    monkeypatch.setattr(pii.S, "draw", lambda cls, part, key, attempt=0: drawn(cls, part, key, attempt) if attempt or cls != "word" else "same" if part in words else words[0])


def test_collisions_are_drawn_again(spark, monkeypatch):
    drawn_alike(monkeypatch, ["ab", "bc"])
    found = spark.createDataFrame([("t", "1", "person_name", c, c, 1) for c in ("ab bc", "bc cd", "cd ab", "? ab")], pii.ENTITY_SCHEMA)
    chosen = {r["canon"]: r["chosen"] for r in pii.surrogate_table(found, KEY).collect()}
    assert len(set(chosen.values())) == 4 and not {w for c in chosen.values() for w in c.split()} & {"ab", "bc", "cd"}
    # "Mr Ab" keeps the family name of "Cd Ab", drawn again or not.
    assert chosen["? ab"].split()[1] == chosen["cd ab"].split()[1] and chosen["ab bc"].split()[0] == chosen["cd ab"].split()[1]


def test_mailbox_and_name_are_one_person(spark):
    found = spark.createDataFrame([("t", "1", k, c, c, 1) for k, c in (("person_name", "jane doe"), ("email", "jane.doe7@x.example"), ("email", "d@x.example"))], pii.ENTITY_SCHEMA)
    chosen = {r["canon"]: r["chosen"] for r in pii.surrogate_table(found, KEY).collect()}
    local, _, domain = chosen["jane.doe7@x.example"].partition("@")
    assert re.sub(r"\d", "", local) == chosen["jane doe"].replace(" ", ".") and chosen["d@x.example"] == f"d@{domain}" and domain != "x.example"


@pytest.mark.parametrize("name, script", [("иван петров", "CYRILLIC"), ("ελένη παππά", "GREEK"), ("jane doe", "LATIN"), ("محمد علي", "ARABIC"), ("山田 太郎", "CJK")])
def test_script_is_kept(name, script):
    new = S.surrogate("person_name", name, KEY)
    assert new != name and all(S.script_of(w) == script for w in new.split()) and len(new.split()) == 2
    assert new == S.surrogate("person_name", name, KEY) != S.surrogate("person_name", name, b"other")


@pytest.mark.parametrize(
    "text, want",
    [
        ("Talk to Priya Raman today, or ask Miguel Keller.", ["Priya Raman", "Miguel Keller"]),
        ("MARIA LOPEZ signed; James said so; Martin May come", ["MARIA LOPEZ"]),
        ("record 123-45-6789", ["123-45-6789"]),
        ("to " + "m" * 200 + ".x@y.example now", ["m" * 200 + ".x@y.example"]),
        ("Sarvobury," + " " * 90 + "Onnis", ["Sarvobury," + " " * 90 + "Onnis"]),
    ],
)
def test_beyond_the_directory_and_of_any_length(text, want):
    assert [x for _, x in found(text)] == want


def test_placeholders_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "Ask Onnis Sarvobury at a@x.example!", "x"), (2, None, "y"), (3, "", "z")], "id int, t string, redacted string")
    out = pii.redact(df, "t", NAMES)
    assert {r["id"]: r["redacted"] for r in out.collect()} == {1: "Ask <PERSON_NAME> at <EMAIL>!", 2: None, 3: ""}
    kept = pii.redact(df, "t", NAMES, key=KEY).where("id = 1").first()["redacted"]
    assert kept.startswith("Ask ") and kept.endswith(".example!") and "Sarvobury" not in kept


def test_empty_tables_and_size_check(spark):
    empty = spark.createDataFrame([], "tbl string, row_key string, text string, is_message boolean")
    assert pii.with_surrogates(pii.find_entities(empty, NAMES), KEY).count() == 0
    people = spark.createDataFrame([("A", "B"), ("C", None), (None, None)], "given_name string, family_name string")
    assert pii.name_model(people).given == {"a", "c"}
    with pytest.raises(ValueError):
        pii.name_model(people, limit=1)


def test_redact_writes_checked_surrogates_over_both_tables(spark, monkeypatch):
    # The first draw gives both people one surrogate, so only a check over all texts keeps them apart.
    from maillake.llm import queries

    rows = {
        "people": spark.createDataFrame([(g, f) for g in GIVEN for f in FAMILY], "given_name string, family_name string"),
        "raw_emails": spark.createDataFrame([("m/1.", "From: Onnis Sarvobury\n\nAsk Onnis Sarvobury.")] * 2, "file string, message string"),
        "emails": spark.createDataFrame([("i1", "Ask Ilvette Haskimont, not Onnis Sarvobury."), ("i2", None), ("i3", "")], "message_id string, body_clean string"),
    }
    monkeypatch.setattr(queries, "table", lambda spark, d, name: rows[name])
    drawn_alike(monkeypatch, ["onnis", "ilvette", "sarvobury", "haskimont"])
    out = queries.p1_surrogates(spark, "").collect()
    got = {r["row_key"]: r["redacted"] for r in out}
    assert len(out) == 5 and got["i2"] is None and got["i3"] == ""
    one = got["m/1."].removeprefix("From: Onnis Sarvobury\n\nAsk ").rstrip(".")
    other = got["i1"].split(",")[0].removeprefix("Ask ")
    assert got["i1"] == f"Ask {other}, not {one}." and one != other and not {one, other} & {"Onnis Sarvobury", "Ilvette Haskimont"}
    assert {r["row_key"]: r["redacted"] for r in queries.p1_placeholders(spark, "").collect()} == {
        "m/1.": "From: Onnis Sarvobury\n\nAsk <PERSON_NAME>.", "i1": "Ask <PERSON_NAME>, not <PERSON_NAME>.", "i2": None, "i3": "",
    }
