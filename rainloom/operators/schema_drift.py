"""Files whose fields drift: one consistent table and a list of every change (problem 6).

Each file is compared with the one before it in its series.  The edit script between the two schemas is a
tree edit distance whose rename costs come from the data: a file repeats the last records of the one before,
so two fields are the same quantity if they hold the same values in the repeated records, whatever their
names.  The scripts of a series say which names are one quantity; with that each file's script is compiled into
a projection, which column and which conversion gives which field, and applied to its records in SQL.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions.tree_edit import Node, edit_script, schema_tree
from rainloom.session import small_or_shuffled

#: Signs of a missing value, and names known for a quantity.
MISSING = {"", "mq", "-", "na", "nan", "null"}
NAMES = {
    "poste": {"POSTE", "NUM_POSTE", "STATION_ID", "ID_STN", "CODE", "CODE_STATION", "STATION"},
    "time": {"DATE", "DATE_OBS", "HORODATE", "AAAAMMJJHH", "DATETIME", "TIME"},
    "rr1": {"RR1", "RR_1H", "PRECIP_1H", "PLUIE_HORAIRE", "HAUTEUR_RR"},
    "drr1": {"DRR1", "DUR_PRECIP", "DUREE_RR1", "EPISODE_MIN"},
    "rr": {"RR", "RR_JOUR", "CUMUL_24H", "PRECIP_D"},
    "temperature": {"T", "TEMP", "TEMPERATURE_AIR"},
    "humidity": {"U", "HUM_REL", "HUMIDITE"},
    "quality": {"QRR1", "CQ", "QUALITE", "FLAG1"},
}
FAMILY = {n: q for q, names in NAMES.items() for n in names}
#: Factors between two notations of one quantity.
RATIOS = [1.0, 10.0, 0.1, 100.0, 0.01, 60.0, 1 / 60, 25.4, 1 / 25.4]

_DATES = [
    (re.compile(r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)?$"), "ymdhi"),
    (re.compile(r"^(\d{4})-(\d\d)-(\d\d)[T ](\d\d)(?::?(\d\d))?(?::\d\d)?Z?$"), "ymdhi"),
    (re.compile(r"^(\d\d)/(\d\d)/(\d{4}) (\d\d)(?:h|:)?(\d\d)?h?$"), "dmyhi"),
]
_STATION = re.compile(r"^[A-Za-z]{0,2}(\d{7,9})(?:-[A-Za-z0-9])?$")
_NUMBER = re.compile(r"^([-+]?\d+(?:[.,]\d+)?) ?(?:mm|°c|%|min)?$", re.I)
_CLOCK = re.compile(r"^(\d+):(\d\d)$")


def parse_file(content: str | None) -> tuple[list[str], list[list[str]]]:
    """Field names (upper case, without quotes and blanks) and records as texts.

    The separator is the one of ; tab | , that cuts the header into most parts.  Comment lines, blank lines, a
    byte order mark and line ends don't matter; short records are filled up.  A second column of one name gets its
    place added (``RR1#4``); a column without a name, as records longer than the header have, is named by its
    place (``#5``) if it holds a value anywhere, else "".
    """
    lines = [x for x in re.split(r"\r\n|\r|\n", (content or "").lstrip("\ufeff")) if x.strip() and not x.lstrip().startswith("#")]
    if not lines:
        return [], []
    sep = max(";\t|,", key=lines[0].count)
    names = [n.strip().strip('"').strip().upper() for n in lines[0].split(sep)]
    rows = [[v.strip().strip('"').strip() for v in x.split(sep)] for x in lines[1:]]
    width = max(map(len, rows), default=0)
    names += [""] * (width - len(names))
    rows = [r + [""] * (len(names) - len(r)) for r in rows]
    seen: set[str] = set()
    for i, n in enumerate(names):
        if not n or n in seen:
            names[i] = f"{n}#{i + 1}" if n or any(r[i].lower() not in MISSING for r in rows) else ""
        seen.add(names[i])
    return names, rows


_KINDS = [("whole", re.compile(r"[-+]?\d+")), ("comma", re.compile(r"[-+]?\d+(?:,\d+)?")), ("point", re.compile(r"[-+]?\d+(?:\.\d+)?"))]


def value_type(values: list[str]) -> str | None:
    """whole, comma, point or text: what all values that aren't missing are; None if all are missing."""
    there = {v for v in values if v.lower() not in MISSING}
    if not there:
        return None
    return next((name for name, pattern in _KINDS if all(map(pattern.fullmatch, there))), "text")


@lru_cache(1 << 16)
def to_station(v: str) -> str | None:
    """Digits of a station number."""
    m = _STATION.match(v)
    return m[1] if m else None


@lru_cache(1 << 16)
def to_time(v: str) -> dt.datetime | None:
    for pattern, order in _DATES:
        if m := pattern.match(v):
            g = dict(zip(order, (int(x or 0) for x in m.groups())))
            try:
                return dt.datetime(g["y"], g["m"], g["d"], 0, 0) + dt.timedelta(hours=g["h"], minutes=g["i"])
            except ValueError:
                return None
    return None


@lru_cache(1 << 16)
def to_number(v: str) -> float | None:
    """A value as a number: units are cut off, clock times are minutes, a word for nothing is zero."""
    if v.lower() in ("néant", "neant", "nil", "nulle", "nul"):
        return 0.0
    if m := _CLOCK.match(v):
        return int(m[1]) * 60.0 + int(m[2])
    if m := _NUMBER.match(v):
        return float(m[1].replace(",", "."))
    return None


class Parsed:
    """A file with its station and time columns found by content, and its records by station and time."""

    def __init__(self, content: str | None):
        self.content = content
        self.names, self.rows = parse_file(content)
        self.columns = {n: [r[i] for r in self.rows] for i, n in enumerate(self.names) if n}
        self.types = {n: value_type(c) for n, c in self.columns.items()}
        share = lambda c, test: sum(test(v) is not None for v in there) / len(there) if (there := [v for v in c if v.lower() not in MISSING]) else 0.0
        times = {n: share(c, to_time) for n, c in self.columns.items()}
        stations = {n: share(c, to_station) for n, c in self.columns.items()}
        best = lambda d, q: max(d, key=lambda n: (d[n], FAMILY.get(n) == q, n)) if d and max(d.values()) >= 0.9 else None
        self.time = best(times, "time")
        self.station = best({n: s for n, s in stations.items() if n != self.time}, "poste")
        self.at: dict[tuple[str, dt.datetime], int] = {}
        if self.time and self.station:
            for i, (s, t) in enumerate(zip(self.columns[self.station], self.columns[self.time])):
                station, when = to_station(s), to_time(t)
                if station and when:
                    self.at.setdefault((station, when), i)
        self._numbers: dict[str, np.ndarray] = {}

    def numbers(self, name: str) -> np.ndarray:
        """A column's values as numbers, NaN where they are none."""
        if name not in self._numbers:
            self._numbers[name] = np.array([np.nan if (x := to_number(v)) is None else x for v in self.columns[name]], float)
        return self._numbers[name]

    def there(self, name: str) -> np.ndarray:
        return np.array([v.lower() not in MISSING for v in self.columns[name]], bool)

    def schema(self) -> Node:
        """Tree of the fields; dotted names are nested."""
        return schema_tree(self.types)


class Likeness:
    """How surely a field of one file and one of the next are the same quantity, from 0 to 1."""

    def __init__(self, old: Parsed, new: Parsed):
        self.old, self.new = old, new
        both = [(i, new.at[k]) for k, i in old.at.items() if k in new.at]
        self.i, self.j = (np.array(x, int) for x in zip(*both)) if both else (np.zeros(0, int), np.zeros(0, int))

    def __call__(self, a: str, b: str) -> float:
        old, new = self.old, self.new
        if a not in old.columns or b not in new.columns:  # structs
            return 0.0
        if (old.time and (a, b) == (old.time, new.time)) or (old.station and (a, b) == (old.station, new.station)):
            return 0.98
        if a in (old.time, old.station) or b in (new.time, new.station):
            return 0.0
        known = FAMILY.get(a), FAMILY.get(b)
        guess = 0.8 if known[0] and known[0] == known[1] else 0.1 if all(known) else None
        use = old.there(a)[self.i] & new.there(b)[self.j] if len(self.i) else np.zeros(0, bool)
        p, q = old.numbers(a)[self.i][use], new.numbers(b)[self.j][use]
        if use.any() and not (np.isnan(p).any() or np.isnan(q).any()):
            telling = (p != 0) | (q != 0)
            if (n := int(telling.sum())) >= 2:
                agree = max(float((np.abs(q - r * p) <= 0.006 * max(r, 1) + 0.03 * np.abs(r * p))[telling].mean()) for r in RATIOS)
                varied = len(set(zip(p[telling].round(6), q[telling].round(6))))
                if agree >= 0.85 and (varied >= 2 or guess is None or guess > 0.5):
                    return 0.97
                if agree < 0.6:
                    return 0.03 if n >= 3 or guess is None else guess * 0.6
        elif use.any():
            x, y = old.columns[a], new.columns[b]
            shared = [(x[i], y[j]) for i, j in zip(self.i[use], self.j[use])]
            pairs = set(shared)
            if len(shared) >= 3 and len(pairs) >= 2:
                one_to_one = len({p for p, _ in pairs}) == len(pairs) == len({q for _, q in pairs})
                return 0.9 if one_to_one else 0.05
        if guess is not None:
            return guess
        # too few repeated records to tell: the looks of the values decide
        u, v = (z[~np.isnan(z)] for z in (old.numbers(a), new.numbers(b)))
        if not len(u) or not len(v):
            return 0.2
        span = lambda z: ((z == 0).mean(), np.log1p(np.percentile(np.abs(z), 90)))
        (z1, s1), (z2, s2) = span(u), span(v)
        return 0.6 if old.types[a] == new.types[b] and abs(z1 - z2) < 0.25 and abs(s1 - s2) < 0.5 else 0.1


def file_changes(before: Parsed, now: Parsed) -> list[tuple[str, str | None, str | None, str]]:
    """(kind, old name, new name, detail) of every change from one file to the next."""
    _, edits = edit_script(before.schema(), now.schema(), Likeness(before, now))
    return [(e.kind, e.old, e.new, e.detail) for e in edits]


_CHANGE = "file_id long, series string, published_at timestamp_ntz, change_kind string, field_name string, old_name string, detail string"


def _changes(batches):
    """Changes of files that come in order by series and bucket; each file is read once."""
    at, before = None, None
    for b in batches:
        rows = []
        for file_id, series, published, bucket, content in b[["file_id", "series", "published_at", "bucket", "content"]].itertuples(index=False, name=None):
            if (series, bucket) != at:
                at, before = (series, bucket), None
            if before is not None and before.content == content:
                continue
            now = Parsed(content)
            if before is not None:
                rows += [(file_id, series, published, kind, old if kind == "removed" else new, old, detail) for kind, old, new, detail in file_changes(before, now)]
            before = now
        yield pd.DataFrame(rows, columns=["file_id", "series", "published_at", "change_kind", "field_name", "old_name", "detail"])


def schema_changes(files: DataFrame, bucket_days: int = 30) -> DataFrame:
    """Every change of a file against the one before it in its series, by published_at then file_id.

    files: (file_id, series, published_at, content).  Result: (file_id, series, published_at, change_kind,
    field_name, old_name, detail); change_kind is added, removed, renamed, retyped or moved (to another parent, in
    dotted names).  The first file of a series and repeated deliveries have no changes.  Files without content,
    series, id or time are no files; a field that is missing throughout a file has no type there, so it isn't
    retyped.

    Contents are shuffled once, by series and bucket of days, so a series that holds a third of all files is no
    single task; the last file of each bucket goes along to the next one.
    """
    x = files.where("file_id is not null and series is not null and published_at is not null and trim(content) != ''").select("file_id", "series", "published_at", "content")
    x = x.withColumn("bucket", F.floor(F.unix_date(F.to_date("published_at")) / bucket_days))
    last = x.groupBy("series", "bucket").agg(F.max_by(F.struct("file_id", "published_at", "content"), F.struct("published_at", "file_id")).alias("l"))
    last = last.select("series", F.lead("bucket").over(Window.partitionBy("series").orderBy("bucket")).alias("bucket"), "l.*").where("bucket is not null")
    both = x.unionByName(last).repartition("series", "bucket").sortWithinPartitions("series", "bucket", "published_at", "file_id")
    return both.mapInPandas(_changes, _CHANGE)


def field_classes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(series, names map): the quantity of each field name that a series' renames connect.

    Only distinct pairs of names reach a task, so its size follows the names of a series, not its files.
    """
    pairs = changes.where("change_kind = 'renamed'").select("series", "old_name", "field_name").distinct()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        group: dict[str, set[str]] = {}
        for a, b in zip(g["old_name"], g["field_name"]):
            merged = group.get(a, {a}) | group.get(b, {b})
            for n in merged:
                group[n] = merged
        out = {}
        for n, names in group.items():
            known = sorted({FAMILY[m] for m in names if m in FAMILY})
            out[n] = known[0] if len(known) == 1 else FAMILY.get(n) or min(names).lower()
        return pd.DataFrame({"series": [g["series"].iloc[0]], "names": [list(out)], "quantities": [list(out.values())]})

    return pairs.groupBy("series").applyInPandas(run, "series string, names array<string>, quantities array<string>")


def _factor(quantity: str, kind: str | None) -> float:
    """Factor of a column's numbers to the quantity's unit."""
    if quantity in ("rr1", "rr") and kind == "whole":
        return 0.1  # whole numbers are tenths of a millimetre
    if quantity == "drr1" and kind in ("comma", "point"):
        return 60.0  # hours
    if quantity == "humidity" and kind in ("comma", "point"):
        return -100.0  # shares up to one, else percent
    return 1.0


NUMBERS = ["rr1", "drr1", "rr", "temperature", "humidity"]
_PROJECTION = "file_id long, series string, published_at timestamp_ntz, content string, station int, clock int, fields array<struct<quantity:string,name:string,place:int,factor:double>>"


def _compile(batches):
    """Each file with its projection: which column, and which factor, gives which field."""
    for b in batches:
        rows = []
        for file_id, series, published, content, names, quantities in b[["file_id", "series", "published_at", "content", "names", "quantities"]].itertuples(index=False, name=None):
            p = Parsed(content)
            known = {} if names is None else dict(zip(names, quantities))
            place = {n: i for i, n in enumerate(p.names) if n}
            fields = []
            for n, i in place.items():
                q = known.get(n) or FAMILY.get(n) or n.lower()
                if n not in (p.station, p.time):
                    fields.append({"quantity": q if q in NUMBERS or q == "quality" else "other", "name": n.lower(), "place": i, "factor": _factor(q, p.types[n])})
            rows.append((file_id, series, published, content, place.get(p.station), place.get(p.time), fields))
        out = pd.DataFrame(rows, columns=["file_id", "series", "published_at", "content", "station", "clock", "fields"])
        out["station"], out["clock"] = out["station"].astype("Int32"), out["clock"].astype("Int32")
        yield out


def with_records(files: DataFrame) -> DataFrame:
    """``files`` with ``header``, the names of the fields, and ``lines``, an array of records, each an array of texts."""
    tidy = lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, "^[\\s\"]+", ""), "[\\s\"]+$", ""))
    lines = F.filter(F.split(F.regexp_replace("content", "^\ufeff+", ""), "\r\n|\r|\n"), lambda x: ~x.rlike("^\\s*(#|$)"))
    x = files.withColumn("__l", lines).where("size(__l) > 0")
    count = F.transform(F.array(*[F.lit(c) for c in ";\t|,"]), lambda c, i: F.struct(F.size(F.split(F.col("__l")[0], F.concat(F.lit("\\Q"), c, F.lit("\\E")))).alias("n"), (-i).alias("i"), c.alias("c")))
    x = x.withColumn("__s", F.concat(F.lit("\\Q"), F.array_max(count)["c"], F.lit("\\E")))
    cut = lambda line: F.transform(F.split(line, F.col("__s"), -1), tidy)
    return x.withColumn("header", F.transform(cut(F.col("__l")[0]), lambda n: F.upper(n))).withColumn("lines", F.transform(F.slice("__l", 2, F.greatest(F.size("__l") - 1, F.lit(0))), cut)).drop("__l", "__s")


def _number(v) -> "F.Column":
    clock = F.regexp_extract(v, r"^(\d+):(\d\d)$", 1).try_cast("double") * 60 + F.regexp_extract(v, r"^(\d+):(\d\d)$", 2).try_cast("double")
    plain = F.regexp_replace(F.regexp_extract(v, r"^(?i)([-+]?\d+(?:[.,]\d+)?) ?(?:mm|°c|%|min)?$", 1), ",", ".").try_cast("double")
    return F.when(F.lower(v).isin("néant", "neant", "nil", "nulle", "nul"), 0.0).otherwise(F.coalesce(clock, plain))


def _moment(v) -> "F.Column":
    out = []
    for pattern, order in _DATES:
        at = {c: i + 1 for i, c in enumerate(order)}
        part = lambda c: F.regexp_extract(v, pattern.pattern, at[c]).try_cast("int")  # noqa: E731,B023
        day = F.try_make_timestamp_ntz(part("y"), part("m"), part("d"), F.lit(0), F.lit(0), F.lit(0))
        out.append(day + F.make_dt_interval(F.lit(0), part("h"), F.coalesce(part("i"), F.lit(0)), F.lit(0)))
    return F.coalesce(*out)


def file_records(files: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """All records of all files as they stand there, one row each, by the compiled projection of each file.

    Columns: those of ``unified_records`` and line, the record's number in its file.
    """
    names = field_classes(files, schema_changes(files) if changes is None else changes)
    x = files.where("file_id is not null and series is not null and trim(content) != ''").select("file_id", "series", "published_at", "content")
    x = x.join(small_or_shuffled(names), "series", "left").mapInPandas(_compile, _PROJECTION)
    x = with_records(x).select("file_id", "series", "published_at", "station", "clock", "fields", F.posexplode("lines").alias("line", "r"))
    # each value is cleaned and read as a number once per record, then picked by place
    x = x.withColumn("r", F.transform("r", lambda v: F.when(~F.lower(v).isin(*MISSING), v))).withColumn("__n", F.transform("r", _number))
    value, number = (lambda i: F.get("r", i)), (lambda i: F.get("__n", i))
    of = lambda q: F.filter("fields", lambda f: f["quantity"] == q)
    first = lambda a: F.get(F.filter(a, lambda v: v.isNotNull()), F.lit(0))
    factor = lambda f: F.when(f["factor"] >= 0, f["factor"]).when(number(f["place"]) <= 1, -f["factor"]).otherwise(1.0)
    scaled = lambda f: number(f["place"]) * factor(f)
    rest = F.filter(F.transform(of("other"), lambda f: F.struct(f["name"].alias("k"), value(f["place"]).alias("v"))), lambda e: e["v"].isNotNull())
    return x.select(
        "series",
        F.regexp_extract(value(F.col("station")), _STATION.pattern, 1).try_cast("long").alias("poste"),
        _moment(value(F.col("clock"))).alias("time"),
        *[F.round(first(F.transform(of(q), scaled)), 9).alias(q) for q in NUMBERS],
        first(F.transform(of("quality"), lambda f: value(f["place"]))).alias("quality"),
        F.map_from_entries(rest).alias("other"),
        "file_id", "published_at", "line",
    )


def unified_records(files: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """All records of all files in one table, one row per series, station and time, of the latest file.

    Columns: series, poste, time (as written, local), rr1 and rr in mm, drr1 in minutes, temperature, humidity in
    percent, quality, other (map of fields that are no known quantity), file_id, published_at.  A missing field or
    value is NULL.  Records without a readable station or time are kept with NULL there, one row each.
    """
    rows = file_records(files, changes)
    keyless = F.when(F.col("poste").isNull() | F.col("time").isNull(), F.concat_ws(":", "file_id", "line"))
    rest = [*NUMBERS, "quality", "other", "file_id", "published_at"]
    latest = rows.groupBy("series", "poste", "time", keyless.alias("__k")).agg(F.max_by(F.struct(*rest), F.struct("published_at", "file_id", "line")).alias("r"))
    return latest.select("series", "poste", "time", *[f"r.{c}" for c in rest])
