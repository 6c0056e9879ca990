import pytest
from pyspark.sql import functions as F

from lodestrata.functions.dates import parse_date

NEW_YEARS_EVE = """2024-12-31|2024/12/31|2024.12.31|20241231|12/31/2024|31/12/2024|31.12.2024|31-12-2024|12-31-2024|12/31/24|31/12/24|December 31, 2024|December 31 2024|december 31st, 2024|Dec 31, 2024|Dec. 31, 2024|DEC 31 2024
31 December 2024|31 Dec 2024|31-Dec-2024|31-dec-24|31st of December 2024|the 31st of December, 2024|31st day of December, 2024|Tuesday, December 31, 2024|Tue, 31 Dec 2024|Tues. Dec 31 2024|2024 December 31|2024-Dec-31|December 31, '24
2024-12-31T00:00:00Z|2024-12-31 23:59|2024-12-31T10:11:12.5+01:00|December 31, 2024 5:30 PM|  2024-12-31  |on December 31, 2024|2024/31/12|Dec/31/2024""".replace("\n", "|").split("|")
OTHERS = {
    "1/2/2024": "2024-01-02", "13/2/2024": "2024-02-13", "2/13/2024": "2024-02-13", "Sept 9, 2023": "2023-09-09", "Sep 9 2023": "2023-09-09", "9 May 99": "1999-05-09", "May 9, 68": "2068-05-09",
    "February 29, 2024": "2024-02-29", "2024-1-5": "2024-01-05", "5 6 2024": "2024-05-06", "Aug 3, 1987": "1987-08-03", "3 August 0987": "0987-08-03",
}
NONE = [None, "", "no date", "2024", "December 2024", "December 31", "31", "12/31", "February 30, 2024", "February 29, 2023", "13/13/2024", "2024-13-13", "Smarch 3, 2024", "Dec Jan 3 2024", "1 2 3 4", "2024-12-31-5", "12.5", "December 31, 2024 or so", "fy 2024 12 31", "$12/31/2024", "32/40/2024", "December 0, 2024", "0/1/2024", "De 31, 2024"]


@pytest.fixture(scope="module")
def parsed(spark):
    texts = [*NEW_YEARS_EVE, *OTHERS, *NONE]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", parse_date(F.col("t")).cast("string").alias("d")).collect()
    return {texts[r["i"]]: r["d"] for r in rows}


def test_written_forms(parsed):
    assert len(NEW_YEARS_EVE) + len(OTHERS) + len(NONE) >= 60
    assert {t: parsed[t] for t in NEW_YEARS_EVE} == dict.fromkeys(NEW_YEARS_EVE, "2024-12-31")
    assert {t: parsed[t] for t in OTHERS} == OTHERS


def test_what_is_no_date(parsed):
    assert {t: parsed[t] for t in NONE} == dict.fromkeys(NONE)
