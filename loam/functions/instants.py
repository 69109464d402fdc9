"""Timestamps of many forms, precisions and zones to microseconds since 1970-01-01 UTC.

A value is reduced to a *shape mask* (digits ``9``, ASCII letters ``a``, every other character itself).  Each
distinct mask is compiled to a parser once per Python worker: the mask fixes where each field lies, so all values
of a mask are parsed together as one character matrix.  Wall-clock values are converted through zone transition
tables (sorted local break points and offsets), built once per zone and tied to one tz database version.

Defined results: null, blank, sentinels (``n/a``, ``now``, ``0000-00-00``) and impossible dates or times give null;
digits beyond microseconds are cut off; missing finer fields are zero; a time without zone is wall-clock time of
the given zone (null or unknown zone: UTC); a repeated wall-clock time is its first occurrence, a skipped one moves
forward by the length of the skip; slashed dates that do not start with the year follow ``date_order`` (null: DMY).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANONICAL = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\+00:00\z"

#: Standard offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "gst": 240, "pkt": 300, "ist": 330, "ict": 420, "hkt": 480, "sgt": 480,
    "awst": 480, "kst": 540, "jst": 540, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720,
    "nzdt": 780, "brt": -180, "brst": -120, "art": -180, "nst": -210, "ndt": -150, "ast": -240, "adt": -180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600,
}

MONTHS = "january february march april may june july august september october november december".split()
MONTH_NUMBER = {w: i + 1 for i, m in enumerate(MONTHS) for w in (m, m[:3])} | {"sept": 9}

_MASK = {ord(c): "9" for c in "0123456789"} | {ord(c): "a" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}

_CLOCK = r"(?P<H>9{1,2}):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?"
_OFFSET = r"(?P<sg>[+-])(?P<oh>99)(?::?(?P<om>99))?"
_ZONE = rf"(?: ?(?P<z>a)| ?{_OFFSET}| (?P<gmt>aaa){_OFFSET.replace('<sg>', '<sg2>').replace('<oh>', '<oh2>').replace('<om>', '<om2>')}| (?P<abbr>a{{2,5}})| ?(?P<name>\[?a+(?:[/_+-][a9]+)*\]?))?"
_YEAR, _MON, _DAY = r"(?P<y>9999)", r"(?P<m>9{1,2})", r"(?P<d>9{1,2})"

#: Shapes of masks, tried in order.
SHAPES = [
    ("stamp", rf"{_YEAR}-(?P<m>99)-(?P<d>99)(?:(?P<t>a)|[ ]+){_CLOCK}{_ZONE}"),
    ("stamp", rf"{_YEAR}-(?P<m>99)-(?P<d>99)"),
    ("stamp", rf"{_YEAR}(?P<m>99)(?P<d>99)(?P<t>a)(?P<H>99)(?P<M>99)(?P<S>99)?{_ZONE}"),
    ("stamp", rf"{_YEAR}/{_MON}/{_DAY}(?: {_CLOCK}{_ZONE})?"),
    ("slashed", rf"(?P<p>9{{1,2}})/(?P<q>9{{1,2}})/{_YEAR}(?: {_CLOCK}(?: ?(?P<half>aa))?)?"),
    ("stamp", rf"{_DAY}\.{_MON}\.{_YEAR}(?: {_CLOCK}{_ZONE})?"),
    ("stamp", rf"(?:(?P<wd>a+), )?{_DAY} (?P<mon>a+) {_YEAR}(?: {_CLOCK}(?: (?P<half>aa))?)?"),
    ("stamp", rf"(?:(?P<wd>a+), )?{_DAY} (?P<mon>a+) {_YEAR} {_CLOCK}{_ZONE}"),
    ("stamp", rf"(?P<mon>a+) {_DAY}, {_YEAR}(?: {_CLOCK}(?: ?(?P<half>aa))?)?"),
    ("stamp", rf"{_YEAR}년 {_MON}월 {_DAY}일(?: (?P<half>오전|오후) {_CLOCK})?"),
    ("seconds", r"(?P<n>9{10})(?:\.(?P<f>9+))?"),
    ("millis", r"(?P<n>9{13})"),
    ("stamp", rf"{_YEAR}(?P<m>99)(?P<d>99)"),
]
_SHAPES = [(kind, re.compile(p)) for kind, p in SHAPES]
#: Seconds between which zone tables hold every transition (about 1900 to 2100); other times follow the zone's rules.
FIRST, LAST = -70 * 31_557_600, 130 * 31_557_600
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def tz_version() -> str:
    """Version of the tz database of this Python, so that driver and workers can be held to one."""
    from importlib import metadata, resources

    try:
        return resources.files("tzdata").joinpath("zones").exists() and metadata.version("tzdata") or "system"
    except (ModuleNotFoundError, metadata.PackageNotFoundError):
        return "system"


def _offset_outside(name: str, local: int) -> int:
    """Offset of a wall-clock second before or after what the tables cover, by the zone's own rules: the first of a repeated
    time, and that before the skip of a skipped one, as in the tables."""
    from zoneinfo import ZoneInfo

    at = datetime(1970, 1, 1) + timedelta(seconds=local)
    return int(at.replace(tzinfo=ZoneInfo(name)).utcoffset().total_seconds())


@lru_cache(maxsize=1024)
def zone_table(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Local break points (seconds) and the offsets (seconds) between them; None for an unknown zone.

    Break ``i`` is the first local second that has offset ``i + 1``: the larger of the two local readings of the
    transition.  That sends a repeated time to its first occurrence and a skipped one forward.
    """
    from zoneinfo import ZoneInfo

    try:
        zone = ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None

    def offset(second: int) -> int:
        return int((_EPOCH + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

    day = 86_400
    breaks, offsets = [], [offset(FIRST)]
    for at in range(FIRST, LAST, 7 * day):
        lo, hi = at, at + 7 * day
        while offset(hi) != offsets[-1]:
            a, b = lo, hi
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if offset(mid) == offsets[-1] else (a, mid)
            breaks.append(b + max(offsets[-1], offset(b)))
            offsets.append(offset(b))
            lo = b
    return np.array(breaks, np.int64), np.array(offsets, np.int64)


@lru_cache(maxsize=4096)
def parser_for(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """Kind and field positions of a mask; None if no shape fits."""
    for kind, pattern in _SHAPES:
        if m := pattern.fullmatch(mask):
            return kind, {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 and whether the date exists."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    m1 = np.clip(m, 1, 12)
    months = ((y.clip(1) - 1970) * 12 + m1 - 1).astype("datetime64[M]")
    start = months.astype("datetime64[D]").astype(np.int64)
    length = (months + 1).astype("datetime64[D]").astype(np.int64) - start
    return start + d - 1, ok & (d <= length)


class _Fields:
    """Fields of all values of one mask, read out of their character matrix."""

    def __init__(self, values: list[str], spans: dict[str, tuple[int, int]]):
        width = len(values[0])
        self.n, self.spans = len(values), spans
        self.chars = np.array(values, dtype=f"U{width}").view(np.uint32).reshape(self.n, width)

    def number(self, key: str, default: int = 0) -> np.ndarray:
        if key not in self.spans:
            return np.full(self.n, default, np.int64)
        a, b = self.spans[key]
        out = np.zeros(self.n, np.int64)
        for i in range(a, b):
            out = out * 10 + (self.chars[:, i].astype(np.int64) - 48)
        return out

    def micros(self) -> np.ndarray:
        if "f" not in self.spans:
            return np.zeros(self.n, np.int64)
        a, b = self.spans["f"]
        out = np.zeros(self.n, np.int64)
        for i in range(a, a + 6):
            out = out * 10 + ((self.chars[:, i].astype(np.int64) - 48) if i < b else 0)
        return out

    def words(self, key: str) -> tuple[list[str], np.ndarray]:
        """Distinct words of a field, in lower case, and each row's word."""
        a, b = self.spans[key]
        block = np.ascontiguousarray(self.chars[:, a:b]).view(f"U{b - a}").ravel()
        distinct, which = np.unique(block, return_inverse=True)
        return [str(w) for w in distinct], which

    def lookup(self, key: str, known: dict[str, int], missing: int = -1) -> np.ndarray:
        distinct, which = self.words(key)
        return np.array([known.get(w.lower(), missing) for w in distinct], np.int64)[which]


def _local_to_utc(local: np.ndarray, ok: np.ndarray, zones: Sequence[str | None], rows: np.ndarray) -> np.ndarray:
    """Seconds of wall-clock time to UTC seconds; ``zones`` are distinct names, ``rows`` each value's name."""
    out = local.copy()
    for k, name in enumerate(zones):
        at = rows == k
        table = zone_table(name) if name else None
        if table is not None:
            breaks, offsets = table
            out[at] = local[at] - offsets[np.searchsorted(breaks, local[at], side="right")]
            for i in np.flatnonzero(at & ok & ((local < FIRST + 172_800) | (local > LAST - 172_800))):
                out[i] = local[i] - _offset_outside(name, int(local[i]))
    return out


def _parse_group(values: list[str], kind: str, spans: dict, zones: list, orders: list) -> tuple[np.ndarray, np.ndarray]:
    f = _Fields(values, spans)
    if kind == "seconds":
        return f.number("n") * 1_000_000 + f.micros(), np.ones(f.n, bool)
    if kind == "millis":
        return f.number("n") * 1000, np.ones(f.n, bool)
    ok = np.ones(f.n, bool)
    if kind == "slashed":
        mdy = np.array([o == "MDY" for o in orders])
        p, q = f.number("p"), f.number("q")
        month, day = np.where(mdy, p, q), np.where(mdy, q, p)
    else:
        month = f.lookup("mon", MONTH_NUMBER) if "mon" in spans else f.number("m")
        day = f.number("d")
    days, real = _days(f.number("y"), month, day)
    hour, minute, second = f.number("H"), f.number("M"), f.number("S")
    ok &= real & (minute < 60) & (second < 60)
    if "half" in spans:
        half = f.lookup("half", {"am": 0, "pm": 12, "오전": 0, "오후": 12})
        ok &= (half >= 0) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + half
    ok &= hour < 24
    if "t" in spans:
        ok &= f.lookup("t", {"t": 1}) == 1
    local = days * 86_400 + hour * 3600 + minute * 60 + second
    fixed = None
    if "z" in spans or "abbr" in spans:
        minutes = f.lookup("z" if "z" in spans else "abbr", {"z": 0} if "z" in spans else ABBREVIATIONS, 99_999)
        ok &= minutes != 99_999
        fixed = minutes * 60
    elif "sg" in spans or "sg2" in spans:
        s = "2" if "sg2" in spans else ""
        oh, om = f.number("oh" + s), f.number("om" + s)
        ok &= (oh <= 18) & (om < 60)
        if "gmt" in spans:
            ok &= f.lookup("gmt", {"gmt": 1, "utc": 1}) == 1
        fixed = (oh * 3600 + om * 60) * np.where(f.chars[:, spans["sg" + s][0]] == 45, -1, 1)
    if fixed is not None:
        utc = local - fixed
    elif "name" in spans:
        distinct, which = f.words("name")
        names = [w.strip("[]") for w in distinct]
        known = np.array([zone_table(n) is not None for n in names])
        ok &= known[which]
        utc = _local_to_utc(local, ok, names, which)
    else:
        distinct = list(dict.fromkeys(zones))
        place = {z: i for i, z in enumerate(distinct)}
        utc = _local_to_utc(local, ok, distinct, np.array([place[z] for z in zones]))
    return utc * 1_000_000 + f.micros(), ok


def parse_instants(values: list[str | None], zones: list[str | None], orders: list[str | None]) -> pa.Array:
    """Microseconds since 1970 UTC of each value, null where it names no instant."""
    out, valid = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    groups: dict[str, list[int]] = {}
    stripped = [None if v is None else v.strip() for v in values]
    for i, v in enumerate(stripped):
        if v:
            groups.setdefault(v.translate(_MASK), []).append(i)
    for mask, rows in groups.items():
        if parser := parser_for(mask):
            got, ok = _parse_group([stripped[i] for i in rows], *parser, [zones[i] for i in rows], [orders[i] for i in rows])
            out[rows], valid[rows] = got, ok
    return pa.array(out, pa.int64(), mask=~valid)


def _instant_udf(version: str):
    @F.arrow_udf("long")
    def udf(value: pa.Array, zone: pa.Array, order: pa.Array) -> pa.Array:
        if tz_version() != version:
            raise RuntimeError(f"tz database {tz_version()} on this executor, {version} on the driver")
        return parse_instants(value.to_pylist(), zone.to_pylist(), order.to_pylist())

    return udf


def is_canonical(value: Column) -> Column:
    """Exactly ``YYYY-MM-DDTHH:MM:SS.ffffff+00:00``."""
    return value.rlike(CANONICAL)


def canonical_us(value: Column) -> Column:
    """Microseconds of a value in canonical form, null for any other; stays in the JVM."""
    return F.when(is_canonical(value), F.unix_micros(value.try_cast("timestamp")))


def noncanonical_us(value: Column, zone: Column, order: Column) -> Column:
    """Microseconds of any value through shape masks (Arrow-vectorised)."""
    return _instant_udf(tz_version())(value, zone, order)


def instant_us(value: Column, zone: Column, order: Column) -> Column:
    """Microseconds of any value; canonical ones never leave the JVM, only the rest is sent to Python."""
    rest = noncanonical_us(F.when(~is_canonical(value), value), zone, order)
    return F.coalesce(canonical_us(value), rest)


def with_agent(df: DataFrame, agents: DataFrame) -> DataFrame:
    """Add ``_zone`` and ``_order`` of each row's ``agent``; null for an agent that is null or not listed.

    ``agents`` has one row per writer; repeated rows of an agent are resolved to the smallest pair.  The join is
    left to the optimizer, which broadcasts the side only if its file size is below the session's threshold.
    """
    known = agents.where(F.col("agent").isNotNull()).groupBy(F.col("agent").alias("_agent")).agg(
        F.min(F.struct("time_zone", "date_order")).alias("_a")
    )
    return df.join(known, df["agent"] == known["_agent"], "left").select(
        *[df[c] for c in df.columns], F.col("_a.time_zone").alias("_zone"), F.col("_a.date_order").alias("_order")
    )
