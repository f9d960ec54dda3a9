"""Reports: findings as JSON, small tables for pandas, profile, peek and charts (drawn where matplotlib is there)."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maillake.operators import analytics

# Months that charts show and the mails that such a month must have.
CHART_FROM, CHART_TO, CHART_FLOOR = "1999-07-01", "2002-03-01", 1000


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """summary, and mean, min and max of ``columns``."""
    return df.select(*columns).summary("mean", "min", "max")


def peek(df: DataFrame, rows: int = 5, seed: int = 42) -> DataFrame:
    """Some rows for the eye: random, but the same for the same plan."""
    return df.orderBy(F.rand(seed)).limit(rows)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("rows")).orderBy(label)
    return n


def chart_weeks(weekly: DataFrame) -> DataFrame:
    return weekly.where(F.col("week_start").between(CHART_FROM, CHART_TO)).orderBy("week_start")


def chart_months(monthly: DataFrame, floor: int = CHART_FLOOR) -> DataFrame:
    return monthly.where(F.col("month").between(CHART_FROM, CHART_TO) & (F.col("total_emails") >= floor)).orderBy("month")


def findings(flagged: DataFrame, people: DataFrame, pairs: DataFrame, counts: dict[str, int] | None = None, exclude: tuple[str, ...] = ()) -> dict:
    """Headline numbers; every part is a few rows."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    return {
        "counts": counts or {},
        "totals": rows(analytics.headline_totals(flagged)),
        "busiest_week": rows(analytics.busiest_week(analytics.weekly_volume(flagged))),
        "reply_speed": rows(analytics.reply_speed(pairs)),
        "response_buckets": rows(analytics.response_buckets(pairs).orderBy("position")),
        "top_senders": rows(analytics.top_senders(people, exclude)),
    }


def export_frames(tables: dict[str, DataFrame], most: int = 100_000) -> dict:
    """The small gold tables as pandas frames; one of more than ``most`` rows raises, as it belongs into a file."""
    out = {}
    for name, df in tables.items():
        frame = df.limit(most + 1).toPandas()
        if len(frame) > most:
            raise ValueError(f"{name} has more than {most} rows")
        out[name] = frame
    return out


def write_json(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=2, default=str))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def setup_schemas(spark: SparkSession, root: str | None = None) -> list[str]:
    """Schemas of the layers with comments; their names. With ``root`` each layer
    also gets a folder for files below it, as open-source Spark has no volumes."""
    layers = {"bronze": "Mail as it came", "silver": "Typed, checked and de-duplicated", "gold": "Analytics and features"}
    for name, text in layers.items():
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name} COMMENT '{text}'")
        if root is not None:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return sorted(r[0] for r in spark.sql("SHOW SCHEMAS").collect())


@dataclass(frozen=True)
class Chart:
    """What a chart shows: its rows (few), how they are drawn and what it says."""

    kind: str  # stacked, bars, lying bars or line
    title: str
    below: str
    x: list
    series: dict[str, list]
    average: float | None = None


def charts(weekly: DataFrame, monthly: DataFrame, people: DataFrame, pairs: DataFrame, exclude: tuple[str, ...] = (), floor: int = CHART_FLOOR) -> dict[str, Chart]:
    """The five charts by file name. Rows are weeks, months, buckets or ten
    senders; months with less mail than ``floor`` are left out of shares."""
    of = lambda df, *cs: [list(c) for c in zip(*df.select(*cs).collect())] or [[] for _ in cs]
    weeks, inside, outside = of(chart_weeks(weekly), "week_start", "internal_emails", "external_emails")
    senders, sent = of(analytics.top_senders(people, exclude), F.regexp_replace("person", "@.*", "").alias("person"), "sent_count")
    buckets, replies = of(analytics.response_buckets(pairs).orderBy("position"), "bucket", "replies")
    half = analytics.reply_speed(pairs).first()["median_minutes"]
    out = {
        "weekly_volume.png": Chart("stacked", "Mail per week", "After removing copies, office time", weeks, {"internal": inside, "external": outside}),
        "top_senders.png": Chart("lying bars", "Busiest senders", "Mail sent; automated senders left out", senders, {"mails": sent}),
        "response_times.png": Chart("bars", "Time to reply", "No matched replies" if half is None else f"Matched replies; median {half:.0f} minutes", buckets, {"replies": replies}),
    }
    shown = chart_months(monthly, floor)
    for share, title in (("meeting_share", "Mail about meetings"), ("after_hours_share", "Mail outside working hours")):
        months, shares = of(shown, "month", share)
        average = analytics.weighted_share(shown, share).first()[0]
        out[f"{share}.png"] = Chart("line", title, "Share of each month's mail; dashed: average over the months shown", months, {share: shares}, average)
    return out


def draw(chart: Chart, path: str) -> bool:
    """The chart as an image; False where matplotlib isn't installed."""
    try:
        import matplotlib
    except ImportError:
        return False
    matplotlib.use("Agg")
    from matplotlib import pyplot
    from matplotlib.ticker import PercentFormatter, StrMethodFormatter

    figure, axes = pyplot.subplots(figsize=(9, 4.5))
    values = list(chart.series.values())
    if chart.kind == "stacked":
        axes.stackplot(chart.x, *values, labels=list(chart.series))
        axes.legend(loc="upper left", frameon=False)
    elif chart.kind == "line":
        axes.plot(chart.x, values[0])
        axes.set_ylim(bottom=0)
    elif chart.kind == "bars":
        total = sum(values[0]) or 1
        axes.bar_label(axes.bar(chart.x, values[0]), [f"{v / total:.0%}" for v in values[0]])
    else:
        axes.bar_label(axes.barh(chart.x[::-1], values[0][::-1]), [f"{v:,}" for v in values[0][::-1]])
    if chart.average is not None:
        axes.axhline(chart.average, linestyle="--")
    scale = axes.xaxis if chart.kind == "lying bars" else axes.yaxis
    scale.set_major_formatter(PercentFormatter(1.0, decimals=0) if chart.kind == "line" else StrMethodFormatter("{x:,.0f}"))
    axes.set_title(f"{chart.title}\n{chart.below}", loc="left", fontsize=10)
    figure.tight_layout()
    figure.savefig(path)
    pyplot.close(figure)
    return True
