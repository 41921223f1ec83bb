"""Mixed timestamp spellings to one UTC form, in built-in expressions only.

All formats are one regex alternation with named groups. One regexp_replace writes every component into one delimited
string, so each value is matched once; the parts are then range-checked and the instant is put together by integer day arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and senses of zones.
_OFFSET_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180,
    "msk": 180, "gst": 240, "pkt": 300, "ist": 330, "ict": 420, "hkt": 480, "sgt": 480, "pht": 480, "awst": 480, "jst": 540, "kst": 540,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "北京时间": 480, "北京時間": 480,
    "香港时间": 480, "香港時間": 480, "中国标准时间": 480, "台北时间": 480, "东京时间": 540,
}
# The same abbreviation in the sense usual at sites of that region.
_REGION_MINUTES = {
    "Australia": {"est": 600, "edt": 660, "cst": 570, "cdt": 630, "wst": 480},
    "Asia": {"cst": 480, "ist": 330, "bst": 360},
    "Asia/Jerusalem": {"ist": 120, "idt": 180},
    "Europe/Dublin": {"ist": 60},
}
# Month names by their first three letters.
_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "mär": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12}
# Words for the half of the day, as hours to add to hours below 12 (None: twelve is midnight).
_MORNING = "上午|早上|清晨|凌晨|早晨"
_AFTERNOON = "下午|晚上|傍晚|午后|夜间"
_NOON = "中午"

_MONTH = "jan|feb|m[aä]r|apr|ma[iy]|jun|jul|aug|sep|o[ck]t|nov|de[cz]"
_CLOCK = (
    rf"(?:[t\s,]*(?:\bat\b|\bum\b)?\s*(?<half%d>{_MORNING}|{_AFTERNOON}|{_NOON})?\s*(?<h%d>\d{{1,2}})(?::|时|點|点)(?<mi%d>\d{{1,2}})(?:[:分](?<s%d>\d{{1,2}}))?秒?"
    r"(?:[.,]\d{1,9})?\s*(?<ap%d>[ap]\.?m\b\.?)?\s*(?:uhr\b)?)?"
)
_ZONES = "|".join(sorted(_OFFSET_MINUTES.keys() | {k for v in _REGION_MINUTES.values() for k in v}, key=lambda k: (-len(k), k)))
_ZONE = rf"\s*[(\[]?\s*(?:(?:utc|gmt)(?=[+-]))?(?<z>(?<![a-z])(?:{_ZONES})(?![a-z])|[+-]\d{{2}}(?::?\d{{2}})?|[a-z]+/[a-z_]+(?:/[a-z_]+)?)?"


def _clock(k: int) -> str:
    return _CLOCK % ((k,) * 5)


_DATES = (
    rf"(?<y1>\d{{4}})\s*[-./年]\s*(?<m1>\d{{1,2}})\s*[-./月]\s*(?<d1>\d{{1,2}})日?{_clock(1)}",
    rf"(?<a2>\d{{1,2}})\s*[-./]\s*(?<b2>\d{{1,2}})\s*[-./]\s*(?<y2>\d{{4}}){_clock(2)}",
    rf"(?<d3>\d{{1,2}})(?:st|nd|rd|th)?[-.\s]*(?<n3>{_MONTH})[a-zä]*\.?[-,\s]*(?<y3>\d{{4}}){_clock(3)}",
    rf"(?<![a-z])(?<n4>{_MONTH})[a-zä]*\.?\s*(?<d4>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<y4>\d{{4}}){_clock(4)}",
    r"(?<y5>\d{4})(?<m5>\d{2})(?<d5>\d{2})(?:[t\s]+(?<h5>\d{2}):?(?<mi5>\d{2})(?::?(?<s5>\d{2}))?(?:[.,]\d{1,9})?)?",
    r"(?<![-+.,:/\d])(?<e>\d{9,17})(?:[.,]\d+)?",
)
_PATTERN = rf"(?s)^[^0-9]*?(?:{'|'.join(_DATES)})(?![0-9]){_ZONE}[^0-9]*$"
_FIELDS = ("y", "m", "d", "n", "a", "b", "h", "mi", "s", "half", "ap", "z", "e")
_GROUPS = {
    "y": "y1 y2 y3 y4 y5", "m": "m1 m5", "d": "d1 d3 d4 d5", "n": "n3 n4", "a": "a2", "b": "b2", "h": "h1 h2 h3 h4 h5", "mi": "mi1 mi2 mi3 mi4 mi5",
    "s": "s1 s2 s3 s4 s5", "half": "half1 half2 half3 half4", "ap": "ap1 ap2 ap3 ap4", "z": "z", "e": "e",
}
_REPLACEMENT = "\x01" + "\x01".join("".join(f"${{{g}}}" for g in _GROUPS[k].split()) for k in _FIELDS)

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　     \t\r\n" + "－–—−"
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " " * 9 + "----"
_INVISIBLE = "​‌‍‎‏⁠﻿­"


def _number(text: Column) -> Column:
    return F.when(text != "", text).cast("long")


def _last_day(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(m.isin(4, 6, 9, 11), 30).when((m == 2) & leap, 29).when(m == 2, 28).otherwise(31)


def _offset_seconds(zone: Column, site_tz: Column) -> Column:
    """Seconds east of UTC of a written offset or a zone's name; null for an IANA name and for none."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    written = F.when((hours <= 18) & (minutes <= 59), (hours * 3600 + minutes * 60) * F.when(zone.startswith("-"), -1).otherwise(1))
    named = F.element_at(_table(_OFFSET_MINUTES), zone) * 60
    by_region = F.lit(None).cast("int")
    for region, names in sorted(_REGION_MINUTES.items(), key=lambda kv: len(kv[0])):
        by_region = F.when(F.coalesce(site_tz, F.lit("")).startswith(region) & zone.isin(*names), F.element_at(_table(names), zone) * 60).otherwise(by_region)
    return F.when(zone.rlike("^[+-]"), written).otherwise(F.coalesce(by_region, named))


def _table(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def with_utc_seconds(df: DataFrame, out: str, value: Column, locale: Column, site_tz: Column) -> DataFrame:
    """Adds column `out`: the instant a value names, as whole seconds since 1970 UTC (fractions cut off), null where it names none.

    value: any spelling; labels around it are ignored. locale: decides between day-month and month-day order (en-US: month first).
    site_tz: IANA zone for values without one. A local time that occurs twice is the earlier instant, a skipped one is read with the
    offset valid before the change. Nulls, blanks, impossible dates and free text give null; a null or unknown locale means day
    first, a null site_tz means UTC. Each step is a projection of its own, so no part of the arithmetic is computed twice.
    """
    t = lambda k: f"__t_{k}"
    c = lambda k: F.col(t(k))
    clean = F.lower(F.translate(value, _WIDE + _INVISIBLE, _PLAIN))
    kept = df.columns
    df = df.withColumns({t("parts"): F.split(F.regexp_replace(clean, _PATTERN, _REPLACEMENT), "\x01"), t("us"): F.coalesce(locale, F.lit("")) == "en-US", t("tz"): F.coalesce(site_tz, F.lit("UTC"))})
    df = df.withColumns({t(k): F.get(c("parts"), F.lit(i + 1)) for i, k in enumerate(_FIELDS)})
    named = F.element_at(_table(_MONTHS), F.substring(c("n"), 1, 3)).cast("long")
    late = c("half").rlike(_AFTERNOON) | c("ap").startswith("p")
    early = c("half").rlike(_MORNING) | c("ap").startswith("a")
    h = F.coalesce(_number(c("h")), F.lit(0))
    noon = c("half").rlike(_NOON) & (h < 11)
    digits = F.length(c("e"))
    epoch = _number(c("e"))
    df = df.withColumns({
        t("yy"): _number(c("y")),
        t("mm"): F.coalesce(_number(c("m")), named, _number(F.when(c("us"), c("a")).otherwise(c("b")))),
        t("dd"): F.coalesce(_number(c("d")), _number(F.when(c("us"), c("b")).otherwise(c("a")))),
        t("hh"): F.when((late | noon) & (h < 12), h + 12).when(early & (h == 12), F.lit(0)).otherwise(h),
        t("mn"): F.coalesce(_number(c("mi")), F.lit(0)),
        t("ss"): F.coalesce(_number(c("s")), F.lit(0)),
        t("offset"): F.when(c("z") != "", _offset_seconds(c("z"), site_tz)),
        t("unix"): F.when((c("e") != "") & (c("z") == ""), F.when(digits <= 11, epoch).when(digits <= 14, F.floor(epoch / 1000)).otherwise(F.floor(epoch / 1000000))),
    })
    ok = (c("yy") >= 1) & c("mm").between(1, 12) & (c("dd") >= 1) & (c("dd") <= _last_day(c("yy"), c("mm"))) & (c("hh") <= 23) & (c("mn") <= 59) & (c("ss") <= 59)
    iana = F.array_join(F.transform(F.split(c("z"), "/"), lambda x: F.regexp_replace(F.initcap(F.regexp_replace(x, "_", " ")), " ", "_")), "/")
    # A year that begins in March makes leap days the last ones.
    df = df.withColumns({t("ok"): ok, t("place"): F.when(c("z").contains("/"), iana).otherwise(c("tz")), t("ys"): F.when(c("mm") <= 2, c("yy") - 1).otherwise(c("yy")), t("ms"): F.when(c("mm") > 2, c("mm") - 3).otherwise(c("mm") + 9)})
    day = c("ys") * 365 + F.floor(c("ys") / 4) - F.floor(c("ys") / 100) + F.floor(c("ys") / 400) + F.floor((c("ms") * 153 + 2) / 5) + c("dd") - 719469
    df = df.withColumn(t("local"), F.when(c("ok"), day * 86400 + c("hh") * 3600 + c("mn") * 60 + c("ss")))
    at_place = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(c("local")), c("place")))
    civil = F.when((c("z") != "") & ~c("z").contains("/"), c("local") - c("offset")).otherwise(at_place)
    return df.select(*[F.col(f"`{k}`") for k in kept], F.when(c("e") != "", c("unix")).otherwise(civil).alias(out))


def utc_text(seconds: Column) -> Column:
    """Whole seconds since 1970 as YYYY-MM-DDTHH:MM:SSZ, whatever the session's zone."""
    day = F.floor(seconds / 86400).cast("int")
    rest = seconds - day.cast("long") * 86400
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))


#: The one written form the results have.
UTC_FORM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
