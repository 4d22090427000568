"""Freely written times against a parser of the standard kind, over forms that a fixed list and a generator give."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resona.functions.times import free_time
from resona.operators import ingest

FORMS = [
    "2026-07-02 10:30:00", "2026-7-2", "2026/7/2 9:05", "2026.07.02", "20260702", "20260702T103015", "20260702103015", "202607021030",
    "20260702T103015Z", "2026-07-02T10:30:00Z", "2026-07-02T10:30:00.123Z", "2026-07-02T10:30:00,5", "2026-07-02T10:30:00+08:00",
    "2026-07-02 10:30 +0800", "2026-07-02 10:30:15 -05", "2 July 2026", "July 2, 2026", "Jul 2 2026 3:04 PM", "2nd of July 2026",
    "Thursday, July 2, 2026 at 10:30 am", "Thu, 02 Jul 2026 10:30:15 GMT", "Thu, 2 Jul 2026 10:30:15 -0300 (BRST)", "Thu Jul  2 10:30:15 2026",
    "Thu Jul 2 10:30:15 BRST 2026", "02-Jul-2026", "02-Jul-26 10:30", "2026 Jul 2", "2026-Jul-02", "7/2/2026", "07/02/2026 11:59:59 PM",
    "13/7/2026", "13.07.2026 08:00", "7-2-2026", "10:30 2 July 2026", "10pm July 2 2026", "12am 2026-07-02", "12:15 pm 2026-07-02",
    "Sept 3 2026", "4 SEPTEMBER 2026 10:30 UTC", "10:30 JUL 2 2026", "7/2/26", "1999-12-31 23:59:59.999999", "45/07/02", "2024-02-29",
    "February 29, 2024 12:00"]
NO_TIMES = ["不是时间", "2026-13-02", "2026-02-30", "2025-02-29", "2026-07-02 25:00", "2026-07-02 10:61", "13:30 pm 2026-07-02", "Julember 2 2026",
            "2026-07-02 10:30:61", "32 July 2026", "hello 2026-07-02", "2026-07-02 10:30 11:40", "1751431200", "", "-", "13/13/2026"]


def parsed(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", free_time(F.col("t")).alias("f")).select("i", F.unix_micros("f.time").alias("us"), F.col("f.day").cast("string").alias("day"))
    return {texts[r.i]: (r.us, r.day) for r in rows.collect()}


def expected(text):
    parser = pytest.importorskip("dateutil.parser")
    t = parser.parse(text)
    day = t.date().isoformat()
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    delta = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return delta.days * 86_400_000_000 + delta.seconds * 1_000_000 + delta.microseconds, day


@pytest.mark.filterwarnings("ignore")
def test_forms_give_the_same_instant_and_day(spark):
    got = parsed(spark, FORMS)
    assert {t: got[t] for t in FORMS} == {t: expected(t) for t in FORMS}


@pytest.mark.filterwarnings("ignore")
def test_generated_times(spark):
    rng = random.Random(4)
    dates = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%m/%d/%Y", "%d %b %Y", "%d %B, %Y", "%b %d, %Y", "%B %d %Y", "%a, %d %b %Y", "%A %B %d %Y", "%d-%b-%Y"]
    clocks = ["", " %H:%M", " %H:%M:%S", " %H:%M:%S.%f", " %I:%M %p", " %I:%M:%S%p", " at %H:%M"]
    zones = ["", "Z", " UTC", " +0530", "-07:00", " GMT", " EST"]
    texts = set()
    for _ in range(300):
        t = datetime.fromtimestamp(rng.randrange(0, 4_000_000_000), timezone.utc).replace(microsecond=rng.randrange(10 ** 6))
        clock = rng.choice(clocks)
        # A Z behind AM would read as one zone name, AMZ.
        zone = rng.choice(zones[2:] if clock.endswith("p") else zones) if clock else ""
        texts.add(t.strftime(rng.choice(dates) + clock) + zone)
    texts = sorted(texts)
    got = parsed(spark, texts)
    assert {t: got[t] for t in texts} == {t: expected(t) for t in texts}


def test_what_is_no_time(spark):
    got = parsed(spark, [*NO_TIMES, "10:30", "July 2026"])
    assert set(got.values()) == {(None, None)}
    assert parsed(spark, ["10:30AMZ 2 July 2026"]) == {"10:30AMZ 2 July 2026": (None, None)}


def test_import_takes_free_times_and_keeps_the_written_day(spark):
    rows = [("Thu, 02 Jul 2026 23:30:00 -0500",), ("2026年7月2日 10:30",), ("never",), (None,), (" 7/2/2026 1:05 AM ",)]
    df = spark.createDataFrame(rows, "t string").select(
        ingest.parse_time(F.col("t"), T.StringType()).alias("time"), ingest.literal_date(F.col("t"), T.StringType()).cast("string").alias("day"))
    got = [(r.time and r.time.isoformat(sep=" "), r.day) for r in df.select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("s"), "day", "time").collect()]
    shown = [r.s for r in df.select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("s")).collect()]
    assert shown == ["2026-07-03 04:30:00", "2026-07-02 10:30:00", None, None, "2026-07-02 01:05:00"]
    assert [d for _, d in got] == ["2026-07-02", "2026-07-02", None, None, "2026-07-02"]
