"""The capture times of a whole test table against an independent row-by-row reading with Python's tz database."""

import datetime as dt
import re
import zoneinfo
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.01")
OFFSETS = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "PST": -480, "PDT": -420, "CET": 60, "CEST": 120}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def instant(value, source, camera, sites):
    if value is None:
        return None
    v = value.strip()
    if re.fullmatch(r"\d{10}|\d{13}|\d{16}", v):
        return int(v) * 10 ** {10: 6, 13: 3, 16: 0}[len(v)]
    zone = None
    if v.startswith("UTC "):
        zone, v = 0, v[4:]
    if m := re.search(r"\[(.+)\]$", v) or re.search(r" ([A-Z]\w+/\w+)$", v):
        zone, v = m[1], v[: m.start()]
    if m := re.search(r"(?<=\d)\s?(Z|UTC|GMT|EST|EDT|PST|PDT|CET|CEST)$", v):
        zone, v = OFFSETS[m[1]], v[: m.start()]
    if ":" in v or "T" in v:
        if m := re.search(r"(?<=[\dT:.]\d\d)\s?([+-])(\d\d):?(\d\d)$", v):
            zone, v = (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3])), v[: m.start()]
    v = re.sub(r"^[A-Z][a-z][a-z], ", "", v)
    half = re.search(r" ?([ap])m$", v, re.IGNORECASE)
    if half:
        v = v[: half.start()]
    if m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)[T_]?(\d\d)(\d\d)(\d\d)(?:_(\d+))?", v) or re.fullmatch(r"(\d{4})[-:/年](\d{1,2})[-:/月](\d{1,2})日?[T ](\d{1,2})[:时](\d\d)(?:[:分](\d\d)秒?(?:[.,](\d+))?)?", v):
        y, mo, d, h, mi, s, f = m.groups()
    elif m := re.fullmatch(r"(\d{1,2})[. ](\d\d|[A-Z][a-z]+)[. ](\d{4}),? (\d{1,2}):(\d\d)(?::(\d\d))?()", v):
        d, mo, y, h, mi, s, f = m.groups()
        mo = MONTHS[mo[:3].lower()] if mo.isalpha() else mo
    else:
        return None
    h = int(h)
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (half[1].lower() == "p")
    try:
        t = dt.datetime(int(y), int(mo), int(d), h, int(mi), int(s or 0), int(((f or "") + "000000")[:6]))
    except ValueError:
        return None
    if zone is None:
        zone = 0 if (source or "").strip().lower() == "embedded" or camera not in sites else sites[camera]
    offset = t.replace(tzinfo=zoneinfo.ZoneInfo(zone), fold=0).utcoffset() if isinstance(zone, str) else dt.timedelta(minutes=zone)
    return (t - offset - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
def test_capture_times_of_a_table(spark):
    sites = {r[0]: r[1].strip() for r in spark.read.parquet(f"{FOLDER}/camera_sites.parquet").select("source_identifier", "site_zone").collect()}
    rows = spark.read.parquet(f"{FOLDER}/source_assets.parquet").select("id", "capture_time", "capture_time_source", "source_identifier").collect()
    want = {(r[0], us) for r in rows if (us := instant(r[1], r[2], r[3], sites)) is not None}
    assert {tuple(r) for r in entry.queries()["p3_found"](spark, str(FOLDER)).collect()} == want
