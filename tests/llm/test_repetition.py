import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from maillake.llm import repetition as R


def slow(words, n):
    seen, mask = set(), [False] * len(words)
    for i in range(len(words) - n + 1):
        run = tuple(words[i : i + n])
        if run in seen:
            mask[i : i + n] = [True] * n
        seen.add(run)
    return mask


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.sampled_from([1, 2, 3, 5, 10]))
def test_like_a_set_of_runs(ids, n):
    assert R.repeated_words(np.array(ids, np.int64), n).tolist() == slow(ids, n)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aA b.\n", max_size=60)), max_size=12))
def test_together_like_one_by_one(texts):
    assert R.measure_all(texts) == [R.measure(t) for t in texts]
    for t, m in zip(texts, R.measure_all(texts)):
        words = [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t or "")]
        assert (m is None) == (t is None) and (t is None or m["n_repeated"] == sum(slow(words, 5)))


def test_collisions_do_not_count(monkeypatch):
    monkeypatch.setattr(R, "_BASE", np.uint64(1))  # now every order of the same words collides
    ids = [0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 0, 1, 2, 3, 4]
    assert R.repeated_words(np.array(ids), 5).tolist() == slow(ids, 5)


@pytest.mark.parametrize("text", ["a b c d e f a b c d e", "Ä ä-Ä, 1_2 x", "", "   ", "...", "x " * 5000, "東京 " * 12, "one two\none two\nthree"])
def test_measure(text):
    words = [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", text)]
    m = R.measure(text)
    assert m["n_words"] == len(words) and m["n_repeated"] == sum(slow(words, 5))


def test_rows(spark):
    ten = "a b c d e f g h i j "
    rows = [(1, None), (2, ""), (3, "a b c d e " * 2), (4, ten + ten[:9] + "q r s"), (5, ten), (6, "\n".join(["same line here"] * 3)), (3, "a b c d e " * 2)]
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id bigint, text string, n_words int")
    assert sorted(r[0] for r in R.repetitive(df, "doc_id", "text").collect()) == [3, 3, 6]
    out = {r["doc_id"]: r for r in R.repetition(df, "doc_id", "text").collect()}
    assert out[1]["n_words"] is None and out[1]["repeated_share"] is None and out[2]["repeated_share"] == 0.0
    assert out[3]["repeated_share"] == 0.5 and out[3]["chars_5"] == 0.5 and out[6]["line_chars"] == pytest.approx(2 / 3)
    assert R.repetition(df.limit(0), "doc_id", "text").count() == 0


def test_exactly_thirty_percent_is_a_case(spark):
    # Ten words, of which the last three close a run: five repeated of 16 and 17 words.
    words = "a b c d e " + " ".join(f"w{k}" for k in range(6)) + " a b c d e"
    df = spark.createDataFrame([(1, words), (2, words + " tail")], "doc_id bigint, text string")
    assert [r[0] for r in R.repetitive(df, "doc_id", "text", 5 / 16).collect()] == [1] or R.measure(words)["n_repeated"] == 5
    assert [r[0] for r in R.repetitive(df, "doc_id", "text").collect()] == [1]
