import csv

import pytest

from maillake.sources import files
from maillake.streaming import bronze


def test_csv_with_quotes_and_line_ends(spark, tmp_path):
    path = tmp_path / "mail.csv"
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["file", "message"])
        w.writerow(["a/1.", 'From: "A, B" <a@b.c>\n\nline one\n\nline, two'])
        w.writerow(["a/2.", ""])
    df = files.read_mail_csv(spark, str(path), now="2002-01-01")
    assert df.columns == ["file", "message", "source_path", "ingested_at"] and files.require_rows(df, 2) == 2
    assert df.where("file = 'a/1.'").first()["message"].endswith("line, two") and "mail.csv" in df.first()["source_path"]
    assert {r["column_name"]: r["nulls"] for r in files.null_audit(df).collect()}["message"] == 1
    with pytest.raises(ValueError):
        files.require_rows(df, 3)


def test_sampler(spark, tmp_path):
    of = lambda n, k, seed=42: sorted(r[0] for r in files.sample_rows(spark.range(n), k, seed).collect())
    assert of(5, 10) == [0, 1, 2, 3, 4] and len(set(of(1000, 50))) == 50 and of(1000, 50) == of(1000, 50) != of(1000, 50, 7)
    src = tmp_path / "a.csv"
    src.write_text("file,message\n" + "".join(f'{k},"x\ny{"z" * 200_000}"\n' for k in range(5)))
    assert files.sample_csv(spark, str(src), str(tmp_path / "b.csv"), 3) == 3


def test_append_and_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda k: spark.createDataFrame([(f"a/{k}.", "From: a@b.c\n\nx", None, None)], bronze.RAW_SCHEMA)
    for k in (1, 2):
        row(k).write.mode("append").parquet(src)
        bronze.write_checked(bronze.read_stream(spark, src), out, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 2 and got.first()["reason"] == "missing_message_id; unparseable_date"


def test_entry_lists_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"p2_found", "p4_found", "p5_found", "weekly_volume", "reply_pairs"} <= names and set(e.oracle_sql()) <= names
