"""Streaming operators as registered queries.

Each starts a real streaming query over the event files, lets it run until all input is read,
and returns what it wrote. Windows still open at the end are not written in append mode; the
SQL leaves them out by the same watermark rule.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import clean
from ..operators.enrich import enrich
from ..session import durable, shared_path
from ..sources.adapters import TABLES, event_mapping, garbled_events
from ..sources.transactions import from_text
from ..streaming import baselines, ingest, sinks, windows
from .common import CLEAN, EV, TIME, m, over, plain, q, rounded, sales


#: Scored from this day on; the days before it are the baseline.
SCORED_FROM = "2024-01-16"


def event_stream(spark, folder):
    """Enriched events as a stream."""
    files = f"{folder}/events*.parquet"
    return enrich(ingest.marked(ingest.stream_parquet(spark, files, TABLES["events"], event_mapping())))


def appended(spark, stream, purpose):
    path = shared_path(spark, purpose)
    sinks.append_files(stream, path).awaitTermination()
    return plain(sinks.read_appended(spark, path, stream))


def _past(raw):
    """The price median of the rows received before the stream starts."""
    return clean.price_median(clean.drop_missing_time(clean.drop_duplicate_rows(from_text(raw))))


def st1(spark, folder):
    """Text rows with defects arrive as files, are cleaned on the way and appended."""
    path = shared_path(spark, "incoming")
    raw = garbled_events(spark, folder)
    raw.write.option("header", True).csv(path)
    text = ingest.stream_csv(spark, f"{path}/*.csv", raw.columns)
    return appended(spark, ingest.stream_clean(text, _past(raw)), "st1")


#: Parts of the days that arrive one after the other, and files each of them is written in, side by side.
PARTS, PART_FILES = 4, 4


def arriving(spark, rows, day, write):
    """Rows in the order of their days, a part of the days after the other; how many files a part has.

    ``write`` stores one part; a stream that takes as many files at a time sees a part per batch."""
    part = F.ntile(PARTS).over(W.orderBy("day"))  # one row per day
    days = rows.select(day.alias("day")).where("day is not null").distinct().withColumn("part", part)
    dealt = durable(rows.withColumn("day", day).join(F.broadcast(days), "day").drop("day"))
    least = dealt.groupBy("part").count().agg(F.min("count")).first()[0] or 1
    files = min(PART_FILES, least)
    for number in range(1, PARTS + 1):
        write(dealt.where(F.col("part") == number).drop("part").repartition(files), number)
    return files


def cleaned_stream(spark, folder):
    """Text rows with defects that arrive in the order of their times, a part of the days per batch, and are
    cleaned on the way."""
    path = shared_path(spark, "incoming")
    raw = garbled_events(spark, folder)
    files = arriving(
        spark, raw, F.substring("transaction_time", 1, 10),
        lambda rows, number: rows.write.option("header", True).csv(f"{path}/part-{number}"),
    )
    text = ingest.stream_csv(spark, f"{path}/*/*.csv", raw.columns, maxFilesPerTrigger=files)
    return ingest.stream_clean(text, _past(raw))


def moving(spark, folder, purpose, score):
    """Score a stream of events by a baseline that moves with it. The stream is stopped and started anew after every part of the
    days, on the same state."""
    path, incoming = shared_path(spark, purpose), shared_path(spark, "incoming")
    rows = sales(spark, folder).select("transaction_time", "transaction_qty", "revenue", "store_location", "date")
    schema = rows.drop("date").schema

    def run(part, number):
        part.drop("date").write.parquet(f"{incoming}/part-{number}")
        stream = spark.readStream.schema(schema).parquet(f"{incoming}/*/*.parquet")
        score(ingest.marked(stream), path).awaitTermination()

    arriving(spark, rows, F.col("date"), run)
    return plain(baselines.read_scored(spark, path))


def st4_moving(spark, folder):
    found = moving(spark, folder, "st4", baselines.score_rolling)
    return rounded(found, "baseline_revenue", "vs_baseline", digits=7)


def st5_moving(spark, folder):
    found = moving(spark, folder, "st5", lambda stream, path: baselines.score_anomalies(stream, path, 1.5))
    return rounded(found, "z_score")


def st3(spark, folder):
    return appended(spark, windows.rolling_windows(event_stream(spark, folder)), "st3")


def _baseline(spark, history):
    return windows.store_baseline(history, shared_path(spark, "baseline"), SCORED_FROM)


def _scored(stream):
    return stream.where(F.col("date") >= F.lit(SCORED_FROM).cast("date"))


def st4(spark, folder):
    baseline = _baseline(spark, sales(spark, folder))
    stream = windows.rolling_vs_baseline(_scored(event_stream(spark, folder)), baseline)
    return rounded(appended(spark, stream, "st4"), "baseline_revenue", "vs_baseline", digits=4)


def st5(spark, folder):
    baseline = _baseline(spark, sales(spark, folder))
    stream = windows.window_anomalies(_scored(event_stream(spark, folder)), baseline, 1.5)
    return rounded(appended(spark, stream, "st5"), "z_score")


def st5_cleaned(spark, folder):
    baseline = _baseline(spark, enrich(clean.clean(from_text(garbled_events(spark, folder)))))
    stream = windows.window_anomalies(_scored(cleaned_stream(spark, folder)), baseline, 1.5)
    return rounded(appended(spark, stream, "st5"), "z_score")


def st6(spark, folder):
    path = shared_path(spark, "st6")
    feed = event_stream(spark, folder).select("transaction_id", "transaction_time", "store_location", "revenue")
    sinks.keep_latest(feed, path, 20).awaitTermination()
    return plain(sinks.read_snapshot(spark, path))


def st7(spark, folder):
    path = shared_path(spark, "st7")
    sinks.keep_snapshots(windows.live_store_revenue(event_stream(spark, folder)), path).awaitTermination()
    return sinks.read_snapshot(spark, path)


QUERIES = {
    "st1_stream_ingest": st1,
    "st2_hourly_by_store": lambda s, f: appended(s, windows.hourly_by_store(event_stream(s, f)), "st2"),
    "st2_cleaned": lambda s, f: appended(s, windows.hourly_by_store(cleaned_stream(s, f)), "st2"),
    "st3_rolling_windows": st3,
    "st3_cleaned": lambda s, f: appended(s, windows.rolling_windows(cleaned_stream(s, f)), "st3"),
    "st4_rolling_vs_baseline": st4,
    "st3_long_windows": lambda s, f: appended(s, windows.rolling_windows(event_stream(s, f), 240, 10), "st3"),
    "st4_moving_baseline": st4_moving,
    "st5_moving_baseline": st5_moving,
    "st5_window_anomalies": st5,
    "st5_cleaned": st5_cleaned,
    "st6_latest_feed": st6,
    "st7_live_store_revenue": st7,
}


def _sliding(t: str, since: str = "2000-01-01", minutes: int = 60, slide: int = 15) -> str:
    return f"""--with mark AS (SELECT max(transaction_time) - INTERVAL 10 MINUTE AS t FROM {t}),
starts AS (SELECT time_bucket(INTERVAL {slide} MINUTE, transaction_time) - to_minutes(CAST({slide} * k AS INTEGER)) AS ws, {t}.*
  FROM {t}, range(0, {minutes // slide}) AS r(k) WHERE date >= DATE '{since}'),
w AS (SELECT ws, ws + INTERVAL {minutes} MINUTE AS we, {m()} AS revenue, {q()} AS units, count(*) AS transactions
  FROM starts GROUP BY ws),
closed AS (SELECT w.* FROM w, mark WHERE we <= t)
"""


def _hours(t: str, key: str = "", since: str = "2000-01-01") -> str:
    return f"""--with mark AS (SELECT max(transaction_time) - INTERVAL 10 MINUTE AS t FROM {t}),
w AS (SELECT time_bucket(INTERVAL 1 HOUR, transaction_time) AS ws, {key} {m()} AS revenue, {q()} AS units,
  count(*) AS transactions FROM {t} WHERE date >= DATE '{since}' {"AND store_location IS NOT NULL" if key else ""} GROUP BY ALL),
closed AS (SELECT w.* FROM w, mark WHERE ws + INTERVAL 1 HOUR <= t),
days AS (SELECT date, hour, {m()} AS r, {q()} AS u FROM {t} WHERE date < DATE '{SCORED_FROM}' GROUP BY ALL),
base AS (SELECT hour, avg(r) AS base_revenue, avg(u) AS mean_units, stddev_samp(u) AS std_units FROM days GROUP BY hour)
"""


_S = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_TXN = f"transaction_id, {TIME}, transaction_qty, unit_price, store_location, product_category, product_type"


def _by_store(t: str) -> str:
    return _hours(t, "store_location,") + f"""SELECT {_S.format("ws")} AS window_start,
      {_S.format("ws + INTERVAL 1 HOUR")} AS window_end, store_location, units, revenue, transactions FROM closed"""


def _rolling(t: str, minutes: int = 60, slide: int = 15) -> str:
    return _sliding(t, minutes=minutes, slide=slide) + f"""SELECT {_S.format("ws")} AS window_start, {_S.format("we")} AS window_end, units, revenue,
      transactions, revenue / transactions AS avg_order FROM closed"""


def _anomalies(t: str) -> str:
    return _hours(t, "", SCORED_FROM) + f"""SELECT {_S.format("ws")} AS window_start,
      CAST(hour(ws) AS INTEGER) AS hour, units, round((units - mean_units) / (std_units + 1e-9), 6) AS z_score,
      coalesce(abs((units - mean_units) / (std_units + 1e-9)) > 1.5, false) AS is_anomaly
    FROM closed LEFT JOIN base ON hour(ws) = base.hour"""


ORACLE = {
    "st1_stream_ingest": over(
        CLEAN,
        f"""SELECT {_TXN}, revenue, CAST(date AS VARCHAR) AS date, hour, month, quarter, weekday, weekday_num,
          is_weekend FROM tidy""",
    ),
    "st2_hourly_by_store": over(EV, _by_store("ev")),
    "st2_cleaned": over(CLEAN, _by_store("tidy")),
    "st3_rolling_windows": over(EV, _rolling("ev")),
    "st3_cleaned": over(CLEAN, _rolling("tidy")),
    "st3_long_windows": over(EV, _rolling("ev", 240, 10)),
    "st4_moving_baseline": over(
        EV,
        _sliding("ev") + f""", days AS (SELECT date, hour, {m()} AS r FROM ev GROUP BY ALL),
        s AS (SELECT ws, any_value(we) AS we, any_value(revenue) AS revenue, count(days.r) AS days, avg(days.r) AS b
          FROM closed LEFT JOIN days ON days.hour = hour(ws) AND days.date < CAST(ws AS DATE) GROUP BY ws)
        SELECT {_S.format("ws")} AS window_start, {_S.format("we")} AS window_end, CAST(hour(ws) AS INTEGER) AS hour,
          revenue, days, round(b, 7) AS baseline_revenue, round(revenue / b, 7) AS vs_baseline FROM s""",
    ),
    "st5_moving_baseline": over(
        EV,
        _hours("ev") + f""", every AS (SELECT date, hour, {q()} AS u FROM ev GROUP BY ALL),
        s AS (SELECT ws, any_value(closed.units) AS units, count(u) AS days, avg(u) AS mean, stddev_samp(u) AS std
          FROM closed LEFT JOIN every ON every.hour = hour(ws) AND every.date < CAST(ws AS DATE) GROUP BY ws)
        SELECT {_S.format("ws")} AS window_start, CAST(hour(ws) AS INTEGER) AS hour, units,
          days, round((units - mean) / (std + 1e-9), 6) AS z_score,
          coalesce(abs((units - mean) / (std + 1e-9)) > 1.5, false) AS is_anomaly FROM s""",
    ),
    "st4_rolling_vs_baseline": over(
        EV,
        _sliding("ev", SCORED_FROM)
        + f""", days AS (SELECT date, hour, {m()} AS r FROM ev WHERE date < DATE '{SCORED_FROM}' GROUP BY ALL),
        base AS (SELECT hour, avg(r) AS b FROM days GROUP BY hour)
        SELECT {_S.format("ws")} AS window_start, {_S.format("we")} AS window_end, CAST(hour(ws) AS INTEGER) AS hour,
          revenue, round(b, 4) AS baseline_revenue, round(revenue / b, 4) AS vs_baseline
        FROM closed LEFT JOIN base ON hour(ws) = base.hour""",
    ),
    "st5_window_anomalies": over(EV, _anomalies("ev")),
    "st5_cleaned": over(CLEAN, _anomalies("tidy")),
    "st6_latest_feed": over(
        EV,
        f"""SELECT transaction_id, {TIME}, store_location, revenue FROM
        (SELECT * FROM ev ORDER BY transaction_time DESC, transaction_id DESC LIMIT 20)""",
    ),
    "st7_live_store_revenue": over(EV, f"SELECT store_location, {m()} AS revenue FROM ev GROUP BY 1"),
}
