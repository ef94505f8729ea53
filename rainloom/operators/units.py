"""Values recorded in many units, brought to common ones (problem 5).

Conversions are edges of a graph, each an affine function ``y = scale * x + offset``.  Shortest
compositions between all pairs of units are worked out once from the edge table, cycles are checked for
agreement, and readings get their factor by an equi-join on (source unit, target unit).
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainloom.functions.unit_text import unit_of, unit_said
from rainloom.session import BROADCAST_ROWS, fits

#: Conversions known beside those of a unit table: (from, to, scale, offset).  They also close cycles.
KNOWN_EDGES = [
    ("cm", "mm", 10.0, 0.0),
    ("inch", "cm", 2.54, 0.0),
    ("hundredth_inch", "inch", 0.01, 0.0),
    ("um", "tenth_mm", 0.01, 0.0),
    ("mm_min", "mm_h", 60.0, 0.0),
    ("mm_s", "mm_min", 60.0, 0.0),
    ("m_s", "mm_s", 1000.0, 0.0),
]
#: Most units a graph may have; it is a dimension that is held by the driver.
MAX_UNITS = 2_000


@dataclass(frozen=True)
class Affine:
    scale: float
    offset: float = 0.0

    def then(self, other: "Affine") -> "Affine":
        return Affine(self.scale * other.scale, self.offset * other.scale + other.offset)

    def inverse(self) -> "Affine":
        return Affine(1.0 / self.scale, -self.offset / self.scale)


class UnitGraph:
    """Compositions of affine conversions between units.

    Edges with a NULL end, or a NULL or zero scale, are left out.  Repeated edges must agree.
    """

    def __init__(self, edges: list[tuple[str, str, float, float]]):
        self.edges: dict[str, dict[str, Affine]] = {}
        self.given: list[tuple[str, str, Affine]] = []
        for a, b, scale, offset in edges:
            if a is None or b is None or not scale:
                continue
            f = Affine(float(scale), float(offset or 0.0))
            self.given.append((a, b, f))
            self.edges.setdefault(a, {}).setdefault(b, f)
            self.edges.setdefault(b, {}).setdefault(a, f.inverse())

    def from_unit(self, start: str) -> dict[str, tuple[int, Affine]]:
        """Units that can be reached, with the number of steps and the composed function."""
        seen = {start: (0, Affine(1.0))}
        queue = deque([start])
        while queue:
            unit = queue.popleft()
            steps, f = seen[unit]
            for other, g in sorted(self.edges.get(unit, {}).items()):
                if other not in seen:
                    seen[other] = (steps + 1, f.then(g))
                    queue.append(other)
        return seen

    def disagreements(self, tolerance: float = 1e-5) -> list[tuple[str, str, float, float]]:
        """Given edges whose function differs from the composition along the shortest paths."""
        out = []
        for root in sorted(self.edges):
            reach = self.from_unit(root)
            for a, b, f in self.given:
                if a in reach and b in reach:
                    want, got = reach[b][1], reach[a][1].then(f)
                    if abs(got.scale - want.scale) > tolerance * max(1e-300, abs(want.scale)) or abs(got.offset - want.offset) > tolerance * max(1.0, abs(want.offset)):
                        out.append((a, b, f.scale, f.offset))
        return sorted(set(out))

    def table(self, spark: SparkSession, targets: list[str]) -> DataFrame:
        """(source_unit, target_unit, scale, offset, steps) for each unit that reaches a target."""
        if bad := self.disagreements():
            raise ValueError(f"conversions disagree along a cycle: {bad[:5]}")
        rows = []
        for t in targets:
            for unit, (steps, f) in self.from_unit(t).items():
                back = f.inverse()
                rows.append((unit, t, back.scale, back.offset, steps))
        return spark.createDataFrame(rows, "source_unit string, target_unit string, scale double, offset double, steps int")

    @staticmethod
    def from_codes(codes: DataFrame, more: list[tuple[str, str, float, float]] = KNOWN_EDGES) -> "UnitGraph":
        """A graph of a table (unit_code, quantity, to_common); its size is checked."""
        rows = codes.select("unit_code", "quantity", "to_common").limit(MAX_UNITS + 1).collect()
        if len(rows) > MAX_UNITS:
            raise ValueError(f"more than {MAX_UNITS} units")
        edges = [(r.unit_code, "mm_h" if r.quantity == "rate" else "mm", r.to_common, 0.0) for r in rows]
        have = {r.unit_code for r in rows}
        return UnitGraph(edges + [e for e in more if e[0] in have and e[1] in have])


def deployment_units(deployments: DataFrame) -> DataFrame:
    """Spans in which a deployment's remarks set a unit: (u_poste, u_field, u_from, u_to, u_code).

    A time belongs to the deployment that holds it, else to the last one begun before it.  Of two begun
    at once the one with the larger id counts.  Spans whose remarks name no unit are left out, as are
    deployments with a NULL station, field or begin.
    """
    said = F.when(F.col("field") == "rain_rate", unit_said(F.col("remarks"), "rate")).otherwise(unit_said(F.col("remarks"), "depth"))
    base = (
        deployments.where("poste is not null and field is not null and active_from is not null")
        .select("poste", "field", "active_from", F.coalesce("active_to", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")).alias("active_to"), "deployment_id", said.alias("code"))
        .groupBy("poste", "field", "active_from")
        .agg(F.max(F.struct("deployment_id", "active_to", "code")).alias("d"))
        .select("poste", "field", "active_from", "d.active_to", "d.code")
    )
    w = Window.partitionBy("poste", "field").orderBy("active_from")
    before = F.max(F.struct("active_to", "code")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    end = F.coalesce(F.lead("active_from").over(w), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))
    x = base.select("*", end.alias("end"), before.alias("prev"))
    # own span; the rest of an earlier one that goes on; what remains is again its own
    own_end = F.least("active_to", "end")
    held_end = F.when(F.col("prev.active_to") > F.col("active_to"), F.least(F.col("prev.active_to"), F.col("end"))).otherwise(own_end)
    spans = F.array(
        F.struct(F.col("active_from").alias("a"), own_end.alias("b"), F.col("code").alias("c")),
        F.struct(own_end.alias("a"), held_end.alias("b"), F.col("prev.code").alias("c")),
        F.struct(F.greatest(own_end, held_end).alias("a"), F.col("end").alias("b"), F.col("code").alias("c")),
    )
    return (
        x.select("poste", "field", F.explode(spans).alias("s"))
        .where("s.c is not null and s.a < s.b")
        .select(F.col("poste").alias("u_poste"), F.col("field").alias("u_field"), F.col("s.a").alias("u_from"), F.col("s.b").alias("u_to"), F.col("s.c").alias("u_code"))
    )


def with_recorded_unit(readings: DataFrame, deployments: DataFrame, quantity: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Readings (poste, field, time, unit, remark and others) with the code they are recorded in, ``unit_code``.

    The row's unit counts, then its remark, then the remarks of its deployment, else the common unit.
    Blank and unreadable units count as not given; a row without time or station has no deployment.
    Rows are neither lost nor multiplied.  Deployment spans are broadcast only if they were counted to be
    few and small; otherwise both sides are shuffled on station, field and day, so a hot station is spread over its
    days and a reading meets the spans of its day only.
    """
    common = "mm_h" if quantity == "rate" else "mm"
    unit, remark = F.col("unit"), F.col("remark")
    # the commonest spelling first: no pattern is tried for it
    own = F.when(unit.isNull(), None).when(unit == ("mm/h" if quantity == "rate" else "mm"), common).otherwise(unit_of(unit, quantity))
    said = F.when(F.col("__own").isNull() & remark.isNotNull(), unit_said(remark, quantity))
    x = readings.withColumn("__own", own).withColumn("__own", F.coalesce("__own", said))
    spans = deployment_units(deployments)
    on = (F.col("poste") == F.col("u_poste")) & (F.col("field") == F.col("u_field")) & (F.col("time") >= F.col("u_from")) & (F.col("time") < F.col("u_to")) & F.col("__own").isNull()
    if fits(spans, broadcast_rows):
        x = x.join(F.broadcast(spans), on, "left")
    else:
        ends = readings.agg(F.to_date(F.min("time")).alias("a"), F.to_date(F.max("time")).alias("b")).first()
        if ends.a is None:
            return x.select(*readings.columns, F.coalesce("__own", F.lit(common)).alias("unit_code"))
        low, high = F.greatest(F.to_date("u_from"), F.lit(ends.a)), F.least(F.to_date("u_to"), F.lit(ends.b))
        spans = spans.where(low <= high).withColumn("u_day", F.explode(F.sequence(low, high)))
        x = x.withColumn("__day", F.to_date("time")).join(spans, on & (F.col("__day") == F.col("u_day")), "left")
    keep = [F.col(c) for c in readings.columns]
    return x.select(*keep, F.coalesce("__own", "u_code", F.lit(common)).alias("unit_code"))


def to_common_units(readings: DataFrame, conversions: DataFrame, target: str, value: str = "value", out: str = "value_common") -> DataFrame:
    """Readings with ``value`` converted from ``unit_code`` to ``target``; NULL where no conversion is known.

    ``conversions`` is the table of a UnitGraph: at most the square of its checked number of units.
    """
    c = conversions.where(F.col("target_unit") == target).select(F.col("source_unit").alias("__src"), F.col("scale").alias("__scale"), F.col("offset").alias("__offset"))
    x = readings.join(F.broadcast(c), F.col("unit_code") == F.col("__src"), "left")
    return x.select(*[F.col(k) for k in readings.columns], (F.col(value) * F.col("__scale") + F.col("__offset")).alias(out))


def usable(value: F.Column) -> F.Column:
    """Not NULL, not NaN, not negative."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0)


def mf_readings(mf: DataFrame, fields: list[str]) -> DataFrame:
    """Long form of the record table: (table_name, row_id, poste, field, time, value, unit, remark)."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return (
        mf.select("obs_id", "poste", "time", "unit", "remark", F.explode(F.filter(parts, lambda p: p["value"].isNotNull())).alias("p"))
        .select(F.lit("mf_data").alias("table_name"), F.col("obs_id").alias("row_id"), "poste", "p.field", "time", "p.value", "unit", "remark")
    )


def radar_readings(radar: DataFrame) -> DataFrame:
    return radar.where("rain_rate is not null").select(
        F.lit("radar_rain").alias("table_name"), F.col("rate_id").alias("row_id"), "poste", F.lit("rain_rate").alias("field"), "time", F.col("rain_rate").alias("value"), "unit", "remark"
    )


def harmonised(mf: DataFrame, radar: DataFrame, deployments: DataFrame, codes: DataFrame, mf_fields: list[str] = ["rr6", "rr"]) -> DataFrame:
    """All usable readings in mm or mm/h with the unit each was recorded in.

    Columns: table_name, row_id, poste, field, time, value, unit_code, value_common.  Values that are NULL,
    NaN or negative are no readings.  Repeated rows stay: each has its own id.  Empty tables give no rows.
    """
    graph = UnitGraph.from_codes(codes)
    conversions = graph.table(codes.sparkSession, ["mm", "mm_h"])
    out = []
    for rows, quantity, target in ((mf_readings(mf, mf_fields), "depth", "mm"), (radar_readings(radar), "rate", "mm_h")):
        x = with_recorded_unit(rows.where(usable(F.col("value"))), deployments, quantity)
        out.append(to_common_units(x, conversions, target).drop("unit", "remark"))
    return out[0].unionByName(out[1])
