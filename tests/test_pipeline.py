import csv
import json
import uuid
from pathlib import Path

import pytest

from maillake import cli, session
from maillake.operators import catalog, priority, reports
from maillake.session import clear_scratch, scratch_path


def test_whole_run(spark, tmp_path):
    path = tmp_path / "mail.csv"
    with open(path, "w", newline="") as f:
        w = csv.writer(f, quoting=csv.QUOTE_ALL)
        w.writerow(["file", "message"])
        for k in range(60):
            a, b = ("ann", "bob") if k % 2 == 0 else ("bob", "ann")
            subject = f"Deal {k // 2}" if k % 2 == 0 else f"RE: Deal {k // 2}"
            w.writerow([f"{a}/sent/{k}.", f"Message-ID: <{k}@x>\nDate: Mon, {1 + k // 4:02d} May 2001 {8 + k % 12:02d}:00:00 -0700 (PDT)\nFrom: {a}@northmere.example\nTo: {b}@northmere.example\nSubject: {subject}\nX-FileName: x.pst\n\nPlease reply, number {k}?\n> old"])
    labels = tmp_path / "labels.csv"
    labels.write_text('file,is_meeting,message\na/1.,true,"Subject: x\n\nhello"\n')
    report = cli.run(spark, str(path), str(tmp_path), settings=priority.Settings(text_features=32, min_doc_freq=1, max_iter=5), labelled=str(labels))
    assert report["counts"]["after_content_dedup"] == 60 and report["counts"]["quarantined_rows"] == 0
    assert report["reply_speed"][0]["matched_replies"] > 0 and report["totals"][0]["total_emails"] == 60
    assert json.loads((tmp_path / "findings.json").read_text())["top_senders"][0]["sent_count"] == 30
    assert spark.catalog.listColumns("gold.person_activity")[0].description == "Address"
    assert spark.table("gold.message_features").count() == 60
    assert reports.profile(spark.table("gold.message_features"), ["body_length"]).count() == 3
    assert reports.peek(spark.table("silver.emails"), 5).count() == 5 and reports.label_distribution(spark.table("gold.message_features"), "label_replied_2h").count() >= 1
    assert reports.chart_weeks(spark.table("gold.weekly_volume")).count() > 0 and reports.chart_months(spark.table("gold.email_categories"), 1).count() == 1
    shown = reports.charts(*(spark.table(f"gold.{t}") for t in ("weekly_volume", "email_categories", "person_activity", "reply_pairs")), exclude=("bob@northmere.example",), floor=1)
    assert len(shown) == 5 and shown["top_senders.png"].x == ["ann"] and sum(shown["response_times.png"].series["replies"]) > 0
    assert shown["meeting_share.png"].average == shown["meeting_share.png"].series["meeting_share"][0]
    assert reports.export_frames({"w": spark.table("gold.weekly_volume")})["w"]["total_emails"].sum() == 60
    audit = catalog.audit_personal(spark)
    assert audit.count() == 19 and audit.where("NOT applied").count() == 0
    assert report["meeting_rule"]["fn"] == 1
    assert "model" in report["counts"] or spark.table("gold.model_weights").count() == 22
    assert (tmp_path / "files" / "gold").is_dir()
    for schema in ("bronze", "silver", "gold"):
        spark.sql(f"DROP SCHEMA {schema} CASCADE")


def test_scratch_of_this_application_is_cleared(spark):
    own = scratch_path(spark, "x")
    other = f"{session.shared_dir(spark)}/maillake/another-application/{uuid.uuid4().hex}"
    for path in (own, other):
        spark.range(3).write.parquet(path)
    clear_scratch(spark)
    there = []
    for path in (own, other):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.append(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    assert there == [False, True]


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())


def test_dictionary_is_current():
    from maillake.operators import catalog

    assert (Path(__file__).resolve().parents[1] / "docs" / "data_dictionary.md").read_text() == catalog.render_dictionary()
