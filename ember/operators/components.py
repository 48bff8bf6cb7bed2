"""4-connected components of class pixels and their outlines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ember.session import cut_lineage


def row_runs(px: DataFrame, keys: Sequence[str] = ("chip_id",), cls: str = "cls") -> DataFrame:
    """Tag each class pixel with its horizontal run (the run's first ``pos``).

    One exchange on the chip serves this window and the vertical one.
    """
    keys = list(keys)
    rows = Window.partitionBy(*keys, "rw").orderBy("cl")
    fires = px.where(F.col(cls) > 0).select(*keys, "rw", "cl", "pos", F.col(cls).cast("int").alias("cls"))
    start = (F.lag("cl").over(rows) == F.col("cl") - 1) & (F.lag("cls").over(rows) == F.col("cls"))
    fires = fires.repartition(*keys).withColumn("_head", ~F.coalesce(start, F.lit(False)))
    return fires.withColumn("run", F.max(F.when(F.col("_head"), F.col("pos"))).over(rows.rowsBetween(Window.unboundedPreceding, 0))).drop("_head")


def run_edges(tagged: DataFrame, keys: Sequence[str] = ("chip_id",)) -> DataFrame:
    """Distinct pairs of vertically touching runs of one class."""
    down = Window.partitionBy(*keys, "cl").orderBy("rw")
    above = tagged.select(
        *keys,
        "run",
        F.when((F.lag("rw").over(down) == F.col("rw") - 1) & (F.lag("cls").over(down) == F.col("cls")), F.lag("run").over(down)).alias("up"),
    )
    return above.where(F.col("up").isNotNull()).select(*keys, F.col("run").alias("u"), F.col("up").alias("v")).distinct()


def _contract(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One large-star and one small-star step; reads its input once."""
    keys = list(keys)
    around = Window.partitionBy(*keys, "u")
    pair = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
    u, v = F.col("u"), F.col("v")
    both = edges.select(*keys, F.inline(F.array(pair(u, v), pair(v, u))))
    low = both.withColumn("_m", F.least(u, F.min("v").over(around)))
    large = low.where("v > u").select(*keys, v.alias("u"), F.col("_m").alias("v")).where("u <> v").distinct()
    downward = large.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    ranked = downward.withColumn("_m", F.min("v").over(around))
    small = ranked.select(*keys, F.inline(F.array(pair(v, F.col("_m")), pair(u, F.col("_m")))))
    return small.where("u <> v").distinct()


def connect(edges: DataFrame, keys: Sequence[str] = ("chip_id",), max_rounds: int = 60) -> DataFrame:
    """Smallest reachable vertex per vertex of an undirected edge table.

    Alternates large-star and small-star contraction, which needs a logarithmic
    number of rounds however long a component winds.  Every second round is
    written to the checkpoint folder, so lost executors repeat at most two.
    Only a count and a digest of the edges reach the driver.
    """
    keys = list(keys)

    def mark(e: DataFrame):
        row = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*keys, "u", "v")).alias("h")).first()
        return row["n"], row["h"]

    current = cut_lineage(_contract(edges.where("u <> v"), keys))
    state = mark(current)
    for _ in range(max_rounds):
        current = cut_lineage(_contract(_contract(current, keys), keys))
        now = mark(current)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("component search did not settle")
    return current.select(*keys, F.col("u").alias("run"), F.col("v").alias("root"))


def components(px: DataFrame, keys: Sequence[str] = ("chip_id",), cls: str = "cls") -> DataFrame:
    """Class pixels with ``comp`` = smallest ``pos`` of their component."""
    keys = list(keys)
    tagged = row_runs(px, keys, cls)
    roots = connect(run_edges(tagged, keys), keys)
    return tagged.join(roots, [*keys, "run"], "left").withColumn("comp", F.coalesce("root", "run")).drop("root", "run")


def component_report(comps: DataFrame, keys: Sequence[str] = ("chip_id",)) -> DataFrame:
    return comps.groupBy(*keys, "cls", "comp").agg(
        F.count(F.lit(1)).alias("pixels"), F.min("rw").alias("top"), F.min("cl").alias("left"), F.max("rw").alias("bottom"), F.max("cl").alias("right")
    )


def outline_edges(comps: DataFrame, keys: Sequence[str] = ("chip_id",)) -> DataFrame:
    """Directed pixel sides on a component's border, region on the right hand.

    A side is on the border when the neighbour there is not of the same
    component - found with two windows, without pairing pixels.
    """
    keys = list(keys)
    rows = Window.partitionBy(*keys, "rw").orderBy("cl")
    cols = Window.partitionBy(*keys, "cl").orderBy("rw")

    def same(fn, w, axis: str, step: int):
        return F.coalesce((fn(axis).over(w) == F.col(axis) + step) & (fn("comp").over(w) == F.col("comp")), F.lit(False))

    flagged = comps.repartition(*keys).select(
        *keys,
        "cls",
        "comp",
        "rw",
        "cl",
        same(F.lag, rows, "cl", -1).alias("_l"),
        same(F.lead, rows, "cl", 1).alias("_r"),
        same(F.lag, cols, "rw", -1).alias("_u"),
        same(F.lead, cols, "rw", 1).alias("_d"),
    )
    r, c = F.col("rw"), F.col("cl")

    def side(flag: str, r1, c1, r2, c2):
        return F.when(~F.col(flag), F.struct(r1.alias("r1"), c1.alias("c1"), r2.alias("r2"), c2.alias("c2")))

    sides = F.array_compact(
        F.array(side("_u", r, c, r, c + 1), side("_r", r, c + 1, r + 1, c + 1), side("_d", r + 1, c + 1, r + 1, c), side("_l", r + 1, c, r, c))
    )
    return flagged.select(*keys, "cls", "comp", F.inline(sides))


def _rings(sides: pd.DataFrame) -> Iterator[tuple[bool, list[tuple[int, int]]]]:
    """Chain directed sides into rings; at a pinch point turn right first."""
    nexts: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r1, c1, r2, c2 in sides[["r1", "c1", "r2", "c2"]].itertuples(index=False):
        nexts.setdefault((r1, c1), []).append((r2, c2))
    for start in sorted(nexts):
        while start in nexts:
            ring, at, heading = [start], start, None
            while True:
                options = nexts[at]
                if len(options) == 1 or heading is None:
                    to = options[0]
                else:
                    right = (heading[1], -heading[0])
                    to = next((o for o in options if (o[0] - at[0], o[1] - at[1]) == right), options[0])
                options.remove(to)
                if not options:
                    del nexts[at]
                step = (to[0] - at[0], to[1] - at[1])
                if heading == step:
                    ring[-1] = to
                else:
                    ring.append(to)
                at, heading = to, step
                if at == start:
                    break
            twice = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:]))
            yield twice < 0, ring


def contours(comps: DataFrame, keys: Sequence[str] = ("chip_id",)) -> DataFrame:
    """Rings of every component: ``keys, cls, comp, ring, hole, line``.

    ``line`` lists pixel-corner ``(r, c)`` vertices, closed.  Only border sides
    reach Python, grouped by chip: a chip is bounded by contract, and one group
    per chip costs far less than one per component.
    """
    keys = list(keys)
    edges = outline_edges(comps, keys)
    types = {f.name: f.dataType.simpleString() for f in edges.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "cls", "comp"]) + ", ring int, hole boolean, line array<struct<r:bigint,c:bigint>>"

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        head = [pdf[k].iloc[0] for k in keys]
        rows = []
        for (cls, comp), sides in pdf.groupby(["cls", "comp"], sort=False):
            found = sorted(_rings(sides), key=lambda x: (x[0], x[1][0]))
            rows += [(*head, cls, comp, i, bool(hole), [{"r": int(r), "c": int(c)} for r, c in ring]) for i, (hole, ring) in enumerate(found)]
        return pd.DataFrame(rows, columns=[*keys, "cls", "comp", "ring", "hole", "line"])

    return edges.groupBy(*keys).applyInPandas(stitch, schema)


def planar_ring_area(line) -> "F.Column":
    """Area in pixels of a closed corner ring (shoelace on integers)."""
    n = F.size(line)
    term = lambda i: F.get(line, i)["c"] * F.get(line, i + 1)["r"] - F.get(line, i + 1)["c"] * F.get(line, i)["r"]
    terms = F.transform(F.sequence(F.lit(0), n - 2), term)
    return F.abs(F.aggregate(terms, F.lit(0).cast("bigint"), lambda acc, t: acc + t)) / 2
