"""Complete radius joins of points on the sphere: Voronoi cells, then a vantage-point tree in each.

Points at one spot are folded into a place first. Every place belongs to the cell of its nearest
pivot (its home) and is copied to each further cell that can hold a neighbour, by the triangle
inequality. A cell that is still too large gets pivots of its own, level by level, until all are
small or can't be split because their places lie within a few radii of each other; those are cut
into blocks of queries. Pivots are chosen inside each cell and travel as rows, so the driver sees
none of them, and no number of points changes the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions.sphere import VantageTree, distance, nearest_and_reach
from rookery.session import materialise

#: Places that one task joins at a time, and pivots of one cell on one level (a fan-out, not a limit of the result).
CELL_POINTS, FAN_OUT = 20_000, 256
#: Members of one place that are dealt together.
MEMBERS = 5_000
#: Pairs that leave a task at a time.
SLICE = 200_000


def positions(rows: DataFrame, point: str, lat: str, lon: str) -> DataFrame:
    """``point, lat, lon``: one row for each id with a usable position.

    Left out: null ids, a missing or NaN coordinate, latitude outside -90..90, longitude outside
    -180..180, and exactly (0, 0). Repeated rows of an id count once (the smallest position).
    """
    ok = (
        F.col(point).isNotNull()
        & F.col(lat).between(-90.0, 90.0)
        & F.col(lon).between(-180.0, 180.0)
        & ~((F.col(lat) == 0) & (F.col(lon) == 0))
    )
    best = F.min(F.struct(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))).alias("_p")
    return rows.where(ok).groupBy(F.col(point).alias("point")).agg(best).select("point", "_p.lat", "_p.lon")


def places_of(points: DataFrame) -> DataFrame:
    """``place, lat, lon, n``: each spot once, named by its smallest point, with its number of points."""
    # adding 0.0 makes one zero of the two
    spot = points.select("point", (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"))
    return spot.groupBy("lat", "lon").agg(F.min("point").alias("place"), F.count(F.lit(1)).alias("n")).select("place", "lat", "lon", "n")


def choose_pivots(lat: np.ndarray, lon: np.ndarray, count: int, apart_m: float) -> list[int]:
    """Indices of up to ``count`` points, none closer than ``apart_m`` to another."""
    kept: list[int] = []
    for i in range(len(lat)):
        if len(kept) == count:
            break
        if not kept or distance(lat[i], lon[i], lat[kept], lon[kept]).min() >= apart_m:
            kept.append(i)
    return kept


def _pivots(large: DataFrame, cell_points: int, fan_out: int, radius_m: float, level: int) -> DataFrame:
    """``cell, lat, lon, j``: pivots of each cell, from about eight candidates for each wanted one.

    ``large`` has ``_size``, the number of places of the cell. A cell whose candidates all lie
    close together has one pivot only.
    """
    wanted = F.least(F.ceil(2 * F.col("_size") / cell_points), F.lit(fan_out)).cast("int")
    draw = F.pmod(F.xxhash64("place", F.lit(level)), F.lit(1 << 40)) / float(1 << 40)
    some = large.where(draw < 8 * wanted / F.col("_size")).select("cell", "lat", "lon", wanted.alias("k"), draw.alias("d"))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["d", "lat", "lon"], kind="stable")
        lat, lon = own["lat"].to_numpy(), own["lon"].to_numpy()
        kept = choose_pivots(lat, lon, int(own["k"].iloc[0]), 8 * radius_m)
        return pd.DataFrame({"cell": own["cell"].iloc[0], "lat": lat[kept], "lon": lon[kept], "j": np.arange(len(kept), dtype=np.int32)})

    return some.groupBy("cell").applyInPandas(run, "cell string, lat double, lon double, j int")


def _assign(large: DataFrame, sizes: DataFrame, pivots: DataFrame, block_points: int, radius_m: float) -> DataFrame:
    """Places of the large cells in their new cells; blocks of places meet the pivots of their cell."""
    blocks = F.ceil(F.col("_size") / block_points).cast("int")
    columns = ["place", "lat", "lon", "n", "home", "cell"]
    marked = large.select(*columns, F.pmod(F.xxhash64("place", F.lit("block")), blocks).cast("int").alias("_b"), F.lit(-1).alias("j"))
    zero = F.lit(0).cast("long")
    again = pivots.join(sizes, "cell").select(zero.alias("place"), "lat", "lon", zero.alias("n"), F.lit(False).alias("home"), "cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_b"), "j")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        of = rows["j"].to_numpy()
        p, own = rows[of >= 0].sort_values("j"), rows[of < 0]
        home, i, j = nearest_and_reach(own["lat"], own["lon"], p["lat"].to_numpy(), p["lon"].to_numpy(), 2 * radius_m)
        names = np.array([f"{key[0]}.{x}" for x in range(len(p))], object)
        return pd.concat([own.assign(cell=names[home]), own.iloc[i].assign(cell=names[j], home=False)])[columns]

    return marked.unionByName(again).groupBy("cell", "_b").applyInPandas(run, "place long, lat double, lon double, n long, home boolean, cell string")


def place_pairs(places: DataFrame, radius_m: float, cell_points: int = CELL_POINTS, fan_out: int = FAN_OUT) -> DataFrame:
    """``place_a, place_b, n_a, n_b, metres``: all pairs ``place_a < place_b`` at most ``radius_m`` apart.

    ``places`` has ``place, lat, lon, n``. The choice of pivots changes the cost, never the result.
    A level ends with each of its cells small, or split again if that took a tenth off it, so the
    number of levels grows with the logarithm of the number of places.
    """
    current = materialise(places.select("place", "lat", "lon", "n", F.lit(True).alias("home"), F.lit("0").alias("cell")), "places")
    parents = None
    done: list[DataFrame] = []
    level = 0
    while True:
        sizes = current.groupBy("cell").agg(F.count(F.lit(1)).alias("_size"))
        if parents is None:
            split = sizes.where(F.col("_size") > cell_points)
        else:
            above = parents.select(F.col("cell").alias("_up"), F.col("_size").alias("_was"))
            split = sizes.where(F.col("_size") > cell_points).withColumn("_up", F.regexp_replace("cell", r"\.\d+$", "")).join(above, "_up").where(F.col("_size") <= 0.9 * F.col("_was")).select("cell", "_size")
        split = materialise(split, "large-cells")
        if split.isEmpty():
            break
        large = current.join(split, "cell")
        pivots = materialise(_pivots(large, cell_points, fan_out, radius_m, level), "pivots")
        several = materialise(split.join(pivots.where("j = 1").select("cell"), "cell", "left_semi"), "split-cells")
        done.append(current.join(several, "cell", "left_anti"))
        if several.isEmpty():
            current = None
            break
        current = materialise(_assign(current.join(several, "cell"), several, pivots.join(several.select("cell"), "cell", "left_semi"), 5 * cell_points, radius_m), f"cells-{level}")
        parents, level = several, level + 1
    cells = current
    for more in done:
        cells = more.select("place", "lat", "lon", "n", "home", "cell") if cells is None else cells.unionByName(more.select(*cells.columns))
    return _join_cells(cells, radius_m, cell_points)


def _join_cells(cells: DataFrame, radius_m: float, cell_points: int) -> DataFrame:
    """Join the home places of each cell with all its places, ``cell_points`` a side at a time."""
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_points).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("place"), F.col("_blocks")).cast("int")
    each = F.sequence(F.lit(0), F.col("_blocks") - 1)
    cut = cells.join(sizes, "cell").withColumn("_own", own)
    # block pair (i, j): queries of block i against places of block j
    as_query = cut.where("home").select("place", "lat", "lon", "n", F.lit(True).alias("asks"), "cell", F.col("_own").alias("qb"), F.explode(each).alias("pb"))
    as_place = cut.select("place", "lat", "lon", "n", F.lit(False).alias("asks"), "cell", F.explode(each).alias("qb"), F.col("_own").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches([*batches])
        column = {c: whole.column(c).to_numpy() for c in ("place", "lat", "lon", "n", "asks")}
        ask = column["asks"]
        q, p = ({c: x[side] for c, x in column.items()} for side in (ask, ~ask))
        for i, j in VantageTree(p["lat"], p["lon"]).within(q["lat"], q["lon"], radius_m, SLICE):
            keep = q["place"][i] < p["place"][j]
            i, j = i[keep], j[keep]
            m = distance(q["lat"][i], q["lon"][i], p["lat"][j], p["lon"][j])
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (q["place"][i], p["place"][j], q["n"][i], p["n"][j], m)], ["place_a", "place_b", "n_a", "n_b", "metres"]
                )

    both = as_query.unionByName(as_place)
    return both.groupBy("cell", "qb", "pb").applyInArrow(run, "place_a long, place_b long, n_a long, n_b long, metres double")


def _dealt(members: DataFrame, n: str = "n") -> DataFrame:
    """Members of each place with their part ``_own`` of ``_parts``, so that no part holds many."""
    parts = F.ceil(F.col(n) / MEMBERS).cast("int")
    return members.withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64("point"), F.col("_parts")).cast("int"))


def _with_place(points: DataFrame, places: DataFrame) -> DataFrame:
    """Points with the row of their spot in ``places``; points of other spots are left out.

    A spot of a thousandth of all points or more is one of a thousand at most; these are broadcast,
    so that no task gets all points of a crowded spot.
    """
    at = points.select("point", (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"))
    total = places.agg(F.sum("n").alias("n"))  # one row
    hot = materialise(places.where(F.col("n") * 1_000 >= total.scalar()), "hot-places")
    rest = places.where(F.col("n") * 1_000 < total.scalar())
    others = at.join(F.broadcast(hot.select("lat", "lon")), ["lat", "lon"], "left_anti")
    return at.join(F.broadcast(hot), ["lat", "lon"]).unionByName(others.join(rest, ["lat", "lon"]))


def expand(points: DataFrame, places: DataFrame, pairs: DataFrame) -> DataFrame:
    """``point_a, point_b``: pairs of points, ``point_a < point_b``, from pairs of places and the points of each.

    The pairs are the result, so there are as many as there are. Places of one point are left as
    they are; members of others are dealt into parts, and parts meet parts.
    """
    several = places.where("n > 1")
    crowd = materialise(_dealt(_with_place(points, several).select("point", "place", "n")), "members")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / MEMBERS).cast("int") - 1))
    own = crowd.select("place", "point", "_own")
    # within a place: part i meets every part j
    a = crowd.select("place", F.col("point").alias("a"), F.col("_own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("j"))
    b = crowd.select("place", F.col("point").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("i"), F.col("_own").alias("j"))
    inside = a.join(b, ["place", "i", "j"]).where("a < b").select("a", "b")
    single = pairs.where("n_a = 1 AND n_b = 1").select(F.col("place_a").alias("a"), F.col("place_b").alias("b"))
    rest = pairs.where("n_a > 1 OR n_b > 1").select("place_a", "place_b", every("n_a").alias("i"), "n_b").select("place_a", "place_b", "i", every("n_b").alias("j"))
    left = rest.join(own.select(F.col("place").alias("place_a"), F.col("point").alias("x"), F.col("_own").alias("i")), ["place_a", "i"], "left")
    right = left.join(own.select(F.col("place").alias("place_b"), F.col("point").alias("y"), F.col("_own").alias("j")), ["place_b", "j"], "left")
    across = right.select(F.coalesce("x", "place_a").alias("a"), F.coalesce("y", "place_b").alias("b"))
    both = single.unionByName(across).unionByName(inside)
    return both.select(F.least("a", "b").alias("point_a"), F.greatest("a", "b").alias("point_b"))


def near_points(rows: DataFrame, point: str, lat: str, lon: str, radius_m: float = 150.0, cell_points: int = CELL_POINTS, fan_out: int = FAN_OUT) -> DataFrame:
    """``point_a, point_b``: all pairs of different ids whose usable positions are at most ``radius_m`` apart.

    Points at one spot pair with each other. An empty input has no pairs.
    """
    points = materialise(positions(rows, point, lat, lon), "positions")
    places = materialise(places_of(points), "spots")
    return expand(points, places, place_pairs(places, radius_m, cell_points, fan_out))


def near_counts(rows: DataFrame, point: str, lat: str, lon: str, radius_m: float = 150.0, cell_points: int = CELL_POINTS, fan_out: int = FAN_OUT) -> DataFrame:
    """``point, place, n_near``: every usable position with its place (the smallest id at the spot) and its number of neighbours.

    Pairs of points are never made: a point's neighbours are the others at its place and all points
    of the places around it.
    """
    points = materialise(positions(rows, point, lat, lon), "positions")
    places = materialise(places_of(points), "spots")
    ends = place_pairs(places, radius_m, cell_points, fan_out).select(F.explode(F.array(F.struct(F.col("place_a").alias("place"), F.col("n_b").alias("m")), F.struct(F.col("place_b").alias("place"), F.col("n_a").alias("m")))).alias("e")).select("e.*")
    around = ends.groupBy("place").agg(F.sum("m").alias("_m"))
    spots = materialise(places.join(around, "place", "left").select("lat", "lon", "place", "n", (F.col("n") - 1 + F.coalesce("_m", F.lit(0))).alias("n_near")), "counted")
    return _with_place(points, spots).select("point", "place", "n_near")
