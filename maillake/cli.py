"""The pipeline in stages: python -m maillake.cli CSV OUT."""

from __future__ import annotations

import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maillake.operators import analytics, catalog, features, mail, priority, reports
from maillake.session import clear_scratch, get_session
from maillake.sources.files import read_mail_csv, save_table

#: Senders of machine-made mail, left out of the busiest ones; each archive has its own.
AUTOMATED: tuple[str, ...] = ()


def run(
    spark: SparkSession, source: str, out: str, max_share: float = mail.MAX_QUARANTINE_SHARE, settings: priority.Settings = priority.Settings(),
    automated: tuple[str, ...] = AUTOMATED, labelled: str | None = None,
) -> dict:
    """Bronze to report; tables go to the session catalog, files to ``out``.

    ``automated``: senders left out of the busiest ones. ``labelled``: a CSV of
    labelled messages that the meeting rule is measured on. The intermediate
    tables of this application are deleted at the end.
    """
    try:
        return _run(spark, source, out, max_share, settings, automated, labelled)
    finally:
        clear_scratch(spark)


def _run(spark: SparkSession, source: str, out: str, max_share: float, settings: priority.Settings, automated: tuple[str, ...], labelled: str | None) -> dict:
    reports.setup_schemas(spark, f"{out}/files")
    save_table(read_mail_csv(spark, source), "bronze.raw_emails")
    mails, recipients, quarantine, counts = mail.load_archive(spark.table("bronze.raw_emails"), max_share)
    save_table(quarantine, "silver.dq_quarantine")
    save_table(mails, "silver.emails")
    save_table(recipients, "silver.recipients")
    metrics = spark.createDataFrame([(k, int(v)) for k, v in counts.items()], "metric string, value bigint").withColumn("run_at", F.current_timestamp())
    save_table(metrics, "silver.run_metrics", append=True)
    emails, recipients = spark.table("silver.emails"), spark.table("silver.recipients")
    flagged = analytics.with_flags(emails)
    save_table(analytics.weekly_volume(flagged), "gold.weekly_volume")
    save_table(analytics.monthly_categories(flagged), "gold.email_categories")
    save_table(analytics.match_replies(emails), "gold.reply_pairs")
    pairs = spark.table("gold.reply_pairs")
    save_table(analytics.person_activity(flagged, recipients, pairs), "gold.person_activity")
    save_table(features.message_features(emails, recipients, pairs), "gold.message_features")
    try:
        model, results = priority.train(spark.table("gold.message_features"), settings)
        run_id = F.lit(spark.sparkContext.applicationId)
        settings_text = F.lit(json.dumps(asdict(settings), sort_keys=True))
        save_table(results.withColumns({"run_id": run_id, "settings": settings_text, "trained_at": F.current_timestamp()}), "gold.model_metrics", append=True)
        weights = spark.createDataFrame(priority.numeric_weights(model), "feature string, weight double")
        save_table(weights.withColumn("run_id", run_id), "gold.model_weights", append=True)
        reports.save_model(model, f"{out}/model")
    except ValueError as e:  # too little mail to train on
        counts["model"] = str(e)
    for statement in catalog.statements("data-team"):
        if spark.catalog.tableExists(statement.split(" TABLE ")[1].split()[0]):
            spark.sql(statement)
    people = spark.table("gold.person_activity")
    report = reports.findings(flagged, people, pairs, counts, automated)
    if labelled is not None:
        report["meeting_rule"] = analytics.labelled_rule_quality(read_mail_csv(spark, labelled)).first().asDict()
    shown = reports.charts(spark.table("gold.weekly_volume"), spark.table("gold.email_categories"), people, pairs, automated)
    report["charts"] = [name for name, chart in shown.items() if reports.draw(chart, f"{out}/{name}")]
    reports.write_json(report, f"{out}/findings.json")
    return report


if __name__ == "__main__":
    run(get_session(), sys.argv[1], sys.argv[2])
