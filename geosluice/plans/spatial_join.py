"""Spatial joins planned as grid-cell equi-joins.

Grids have cells of a base size, twice that, and so on.  A row's own level is the first
whose cells are as wide as its envelope, so it meets at most four cells there.  Rows of
two levels meet in the grid of the coarser one: a row is sent to its own level and to
those coarser levels that rows of the other side have, at most four cells in each, so
boxes of any size cost the same.  The cheap envelope test and then the exact relation
filter, and a pair is kept only in the cell that holds the lower left corner of the
envelopes' common part, so each pair comes once without a distinct.  Cells are half
open, so a point on a cell's edge has one owner.

Rows with one and the same geometry are joined as one row, which carries the others'
columns as an array of at most COPIES, exploded after the relation: it is computed once for
different geometries, and copies cost no more than their pairs in the result.  Cells with
very many rows are cut into blocks, each a key of its own, and tasks are as many as the
pairs to compare ask for, so no task has more than a bounded share.

Exact relations of shapes are interpreted, some tenths of a millisecond a pair.  Points, lines of
two points and convex polygons of up to four corners are compared first by compiled
arithmetic on columns: a line along an edge that has all of the other shape on its outer
side tells them apart, and none does so where they meet.  Cases within rounding of a
border, and all other shapes, are left to the exact relation.

Rows without an envelope, or with a coordinate that is null, NaN or infinite, match
nothing; there is no other limit of coordinates, so the result is that of the plain
predicate."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import shapes as sh

SIDES = ("minx", "miny", "maxx", "maxy")


def _sound(b: Column) -> Column:
    finite = lambda c: F.coalesce(F.abs(b[c]) < float("inf"), F.lit(False))
    return finite("minx") & finite("miny") & finite("maxx") & finite("maxy") & (b["minx"] <= b["maxx"]) & (b["miny"] <= b["maxy"])


def choose_cell(left: DataFrame, right: DataFrame, left_box: str, right_box: str, least: float = 0.0) -> float:
    """A cell about as wide as the smaller side's usual envelope, and not finer than rows are dense: an aggregate of each side.

    Percentiles, so that a few huge or far envelopes do not matter."""
    wide, dense = [], []
    for df, box in ((left, left_box), (right, right_box)):
        b = F.col(box)
        ends = [F.percentile_approx(b[c], F.array(F.lit(0.02), F.lit(0.98))) for c in ("minx", "miny")]
        side, xs, ys, n = df.where(_sound(b)).agg(F.percentile_approx(F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"]), 0.5), *ends, F.count("*")).first()
        if not n:
            return 1.0
        wide.append(side)
        dense.append(max(xs[1] - xs[0], ys[1] - ys[0]) / n**0.5)
    cell = max(least, min(wide), min(dense))
    return cell if 0 < cell < float("inf") else 1.0


def _level(b: Column, cell: float) -> Column:
    side = F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"]) / F.lit(cell)
    return F.when(side <= 1, 0).when(side < float("inf"), F.ceil(F.log2(side)).cast("int")).otherwise(1 << 10)


def _cells(df: DataFrame, side: str, cell: float, levels: list[int]) -> DataFrame:
    """A row for each cell in which it can meet rows of the other side, which has these levels."""
    b, own = F.col("__box_" + side), F.col("__level_" + side)
    tell = F.signum(F.col("__box_" + side)["minx"] * 0 + 1)  # 1.0, of the row
    turn = 1 if side == "l" else -1
    goals = F.array_distinct(F.transform(F.array(*map(F.lit, levels)), lambda v: F.struct(F.greatest(v, own).alias("level"), F.signum((v - own) * turn).cast("int").alias("turn"))))

    def tiles(goal: Column) -> Column:
        size = F.pow(F.lit(2.0), goal["level"]) * cell * tell
        span = lambda low, high: F.sequence(F.floor(b[low] / size), F.floor(b[high] / size))
        ys = span("miny", "maxy")
        return F.flatten(F.transform(span("minx", "maxx"), lambda x: F.transform(ys, lambda y: F.struct(goal["level"].alias("level"), goal["turn"].alias("turn"), x.alias("x"), y.alias("y")))))

    return df.withColumn("__cell", F.explode(F.flatten(F.transform(goals, tiles))))


#: Rows of one geometry that a row of the join stands for, and rows of a cell in one block, at most; pairs that a task compares.
COPIES, BLOCK, TASK_PAIRS = 1024, 2048, 4_000_000


def _hashed(df: DataFrame, names: list[str]) -> Column:
    """A hash of these columns; maps cannot be hashed."""
    return F.xxhash64(*[F.col(c) for c in names if "map<" not in df.schema[c].dataType.simpleString() and "variant" not in df.schema[c].dataType.simpleString()])


def _together(df: DataFrame, on: list[str], rows: str) -> DataFrame:
    """Rows that agree in `on` as one, the other columns in the array `rows`; as they are if few agree."""
    rest = [c for c in df.columns if c not in on]
    counts = df.groupBy(*on).agg(F.count("*").alias("__copies"))
    total, kinds, most = counts.agg(F.coalesce(F.sum("__copies"), F.lit(0)), F.count("*"), F.max("__copies")).first()
    if total < 2 * kinds or not rest or not total:
        return df
    keys = list(on)
    if most > COPIES:
        hot = counts.where(F.col("__copies") > COPIES)
        df = df.join(hot, on, "left").withColumn("__part", F.pmod(_hashed(df, rest), F.coalesce(F.ceil(F.col("__copies") / COPIES), F.lit(1))))
        keys.append("__part")
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias(rows)).drop("__part")


def _blocks(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with `__key`, the cell and a block of each side's rows, and the number of tasks for the pairs that meet in cells."""

    def held(df: DataFrame, s: str) -> DataFrame:
        weight = F.size("__rows_" + s) if "__rows_" + s in df.columns else F.lit(1)
        return df.groupBy("__cell").agg(F.count("*").alias("n_" + s), F.sum(weight).alias("w_" + s))

    part = lambda s: F.ceil((F.col("n_" + s) + F.col("w_" + s) / 16) / BLOCK).cast("int").alias("__parts_" + s)
    met = held(a, "l").join(held(b, "r"), "__cell")
    work = F.col("n_l").cast("double") * F.col("n_r") + F.col("w_l").cast("double") * F.col("w_r") / 8
    cut_up = met.where(work > BLOCK * BLOCK).select("__cell", part("l"), part("r"))
    total, large = met.agg(F.coalesce(F.sum(work), F.lit(0.0)), F.count_if(work > BLOCK * BLOCK)).first()
    tasks = max(1, math.ceil(total / TASK_PAIRS))
    if not large:
        return a.withColumn("__key", F.struct("__cell")), b.withColumn("__key", F.struct("__cell")), tasks
    out = []
    for df, s, own, other in ((a, "l", "i", "j"), (b, "r", "j", "i")):
        near = "r" if s == "l" else "l"
        mine = F.pmod(F.col("__hash_" + s), F.coalesce(F.col("__parts_" + s), F.lit(1))).cast("int")
        df = df.join(F.broadcast(cut_up), "__cell", "left").withColumn("__other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts_" + near), F.lit(1)) - 1)))
        place = {own: mine, other: F.col("__other")}
        out.append(df.withColumn("__key", F.struct("__cell", place["i"].alias("i"), place["j"].alias("j"))).drop("__other", "__parts_l", "__parts_r"))
    return out[0], out[1], tasks


def spatial_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, relation: Callable[[], Column] | None = None, distance: float = 0.0, cell: float | None = None, on: tuple[list[str], list[str]] | None = None, prepare: Callable[[DataFrame, str], DataFrame] | None = None, quick: Column | None = None, load: float = 1.0) -> DataFrame:
    """Pairs whose envelopes, the left expanded by `distance`, meet and for which `relation` holds.

    Column names of the sides must differ; the result has all of both.  `on`: the columns of each side that the
    relation reads beside the envelopes; given, rows that agree in them are joined as one.  `quick`: what the relation is,
    where columns that `prepare` adds to a side tell it cheaply, else null.  `load`: the work for a pair, 1 for a comparison."""
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    names = [*left.columns, *right.columns]
    sides = []
    for df, box, s, i in ((left, left_box, "l", 0), (right, right_box, "r", 1)):
        df = df.where(_sound(F.col(box)))
        df = df if on is None else _together(df, [box, *on[i]], "__rows_" + s)
        sides.append(prepare(df, s) if prepare else df)
    cell = cell or choose_cell(*sides, left_box, right_box, distance)
    if not 0 < cell < math.inf:
        raise ValueError(f"cell size: {cell}")
    wide = g.expand(F.col(left_box), distance) if distance else F.col(left_box)
    for i, (box, s) in enumerate(((wide, "l"), (F.col(right_box), "r"))):
        df = sides[i].withColumn("__box_" + s, box).where(_sound(F.col("__box_" + s)))
        sides[i] = df.withColumn("__level_" + s, _level(F.col("__box_" + s), cell)).withColumn("__hash_" + s, _hashed(df, df.columns))
    # levels are logarithms of sizes: a few dozen numbers at most
    known = [sorted(r[0] for r in df.select("__level_" + s).distinct().collect()) for df, s in zip(sides, "lr")]
    a, b, tasks = _blocks(_cells(sides[0], "l", cell, known[1] or [0]), _cells(sides[1], "r", cell, known[0] or [0]))
    tasks = math.ceil(tasks * load)
    size = F.pow(F.lit(2.0), F.col("__cell")["level"]) * cell
    corner = lambda c: F.floor(F.greatest(F.col("__box_l")[c], F.col("__box_r")[c]) / size)
    owner = (corner("minx") == F.col("__cell")["x"]) & (corner("miny") == F.col("__cell")["y"])
    a, b = a.repartition(tasks, "__key"), b.drop("__cell").repartition(tasks, "__key")
    out = a.join(b.hint("merge"), "__key").where(g.meets(F.col("__box_l"), F.col("__box_r")) & owner)
    if quick is not None:
        # as a generated column, so that the exact relation stays behind the compiled join and sees only what it must
        out = out.where(F.coalesce(quick, F.lit(True))).withColumn("__sure", F.explode(F.array(F.coalesce(quick, F.lit(False)))))
        out = out.where(F.col("__sure") | relation())
    elif relation:
        out = out.where(relation())
    for s in "lr":
        rows = "__rows_" + s
        if rows in out.columns:
            out = out.withColumn(rows, F.explode(rows)).select("*", rows + ".*").drop(rows)
    return out.select(*names)


def intersects_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, cell: float | None = None) -> DataFrame:
    """Envelopes with a point in common."""
    return spatial_join(left, right, left_box, right_box, cell=cell, on=([], []))


def distance_join(left: DataFrame, right: DataFrame, left_point: str, right_point: str, d: float, cell: float | None = None) -> DataFrame:
    """Pairs of points at most d apart, d included."""
    box = lambda p: g.envelope(F.col(p)["x"], F.col(p)["y"], F.col(p)["x"], F.col(p)["y"])
    left, right = left.withColumn("__lb", box(left_point)), right.withColumn("__rb", box(right_point))
    out = spatial_join(left, right, "__lb", "__rb", lambda: g.within_distance(F.col(left_point), F.col(right_point), d), d, cell, ([left_point], [right_point]))
    return out.drop("__lb", "__rb")


def parse_relation(text: str | None) -> tuple[Callable[[Column, Column], Column], float]:
    """A relation of shapes and how far apart its envelopes may be, from `intersects` (the default) or `within_distance(d)`."""
    text = (text or "intersects").strip().lower()
    if text == "intersects":
        return sh.intersects, 0.0
    found = re.fullmatch(r"within_distance\s*\(\s*([0-9.]+(?:e[-+]?[0-9]+)?)\s*\)", text)
    if not found:
        raise ValueError(f"unknown relation: {text}")
    d = float(found[1])
    return lambda a, b: sh.within_distance(a, b, d), d


def _with_edges(df: DataFrame, side: str, shape: str, most: int) -> DataFrame:
    """df with numbers for `_meet`: corners, and edges as (nx, ny, c, room), nx * x + ny * y + c being negative outside."""
    v, n = F.col("__corners"), F.size("__corners")
    at = lambda i: F.get(v, F.pmod(F.lit(i), n))
    known, zero = v.isNotNull(), F.lit(0.0)
    cols = {f"__known_{side}": F.coalesce(known, F.lit(False)), f"__fills_{side}": sh.fills_envelope(v), f"__reach_{side}": F.coalesce(F.array_max(F.transform(v, lambda p: F.abs(p["x"]) + F.abs(p["y"]))) + 1.0, zero)}
    for i in range(most):
        p, q = at(i), at(i + 1)
        nx, ny = p["y"] - q["y"], q["x"] - p["x"]
        edge = {"nx": nx, "ny": ny, "c": -(nx * p["x"] + ny * p["y"]), "room": (F.abs(nx) + F.abs(ny)) * sh.ROOM}
        cols |= {f"__x{i}_{side}": F.coalesce(p["x"], zero), f"__y{i}_{side}": F.coalesce(p["y"], zero)}
        cols |= {f"__{k}{i}_{side}": F.coalesce(F.when(F.lit(i) < n, e), zero) for k, e in edge.items()}
    return df.withColumn("__corners", sh.corners(F.col(shape))).withColumns(cols).drop("__corners")


def _meet(most: tuple[int, int]) -> Column:
    """Whether shapes of these numbers of corners meet, their envelopes doing so; null where that is not sure."""
    apart, close = F.lit(False), F.lit(False)
    for s, o, n, m in (("l", "r", *most), ("r", "l", *most[::-1])):
        for i in range(n if n > 1 else 0):
            nx, ny, c, room = (F.col(f"__{k}{i}_{s}") for k in ("nx", "ny", "c", "room"))
            slack = room * (F.col("__reach_l") + F.col("__reach_r"))
            out = [nx * F.col(f"__x{j}_{o}") + ny * F.col(f"__y{j}_{o}") + c for j in range(m)]
            every = lambda test: functools.reduce(lambda x, y: x & y, map(test, out))
            apart |= every(lambda v: v < -slack)
            close |= (room > 0) & every(lambda v: v <= slack)
    sides = F.col("__known_l") & F.col("__known_r")
    return F.when(sides, F.when(F.col("__fills_l") & F.col("__fills_r"), True).when(apart, False).when(~close, True))


def _gap_within(d: float) -> Column:
    """Whether shapes are within d, where they fill their envelopes or those are too far apart; else null."""
    a, b = F.col("__ls"), F.col("__rs")
    gap = lambda low, high: F.greatest(F.lit(0.0), b[low] - a[high], a[low] - b[high])
    dx, dy = gap("minx", "maxx"), gap("miny", "maxy")
    far = F.sqrt(dx * dx + dy * dy)
    return F.when(F.col("__fills_l") & F.col("__fills_r"), far <= d).when(far > d * (1 + 1e-9) + 1e-9, False)


def shape_join(left: DataFrame, right: DataFrame, left_shape: str, right_shape: str, relation: str | None = None, cell: float | None = None) -> DataFrame:
    """Pairs of shapes for which the relation holds exactly; null and empty shapes match nothing."""
    test, d = parse_relation(relation)
    shapes = {"l": left_shape, "r": right_shape}
    most = {s: df.agg(F.max(F.size(sh.corners(F.col(shapes[s]))))).first()[0] or 1 if test is sh.intersects else 1 for df, s in ((left, "l"), (right, "r"))}
    quick = _meet((max(1, most["l"]), max(1, most["r"]))) if test is sh.intersects else _gap_within(d)
    left, right = left.withColumn("__ls", sh.envelope(F.col(left_shape))), right.withColumn("__rs", sh.envelope(F.col(right_shape)))
    prepare = lambda df, s: _with_edges(df, s, shapes[s], max(1, most[s]))
    return spatial_join(left, right, "__ls", "__rs", lambda: test(F.col(left_shape), F.col(right_shape)), d, cell, ([left_shape], [right_shape]), prepare, quick).drop("__ls", "__rs")


def count_intersecting(left: DataFrame, right: DataFrame, left_box: str, right_box: str, by: str, name: str) -> DataFrame:
    """For each value of the right column `by`, the number of pairs of rows whose envelopes meet; left rows of one envelope are counted before."""
    kinds = left.groupBy(left_box).agg(F.count("*").alias("__n"))
    return spatial_join(kinds, right, left_box, right_box).groupBy(by).agg(F.sum("__n").alias(name))


def count_later_within(df: DataFrame, ident: str, point: str, d: float, name: str) -> DataFrame:
    """For each ident, a whole number, of how many rows of greater ident the point is at most d apart; only those that have some.

    Rows of one point are kept as sorted arrays of at most COPIES idents or so, and two arrays whose points are near
    are compared as a whole, so the work is that of the different points that are near, times idents."""
    box = g.envelope(F.col(point)["x"], F.col(point)["y"], F.col(point)["x"], F.col(point)["y"])
    rows = df.select(F.col(ident).cast("long").alias("l_id"), F.col(point).alias("l_pt"), box.alias("l_box")).where(F.col("l_id").isNotNull())
    as_right = lambda t: t.toDF(*[c.replace("l_", "r_", 1) for c in t.columns])
    kept = _together(rows.where(_sound(F.col("l_box"))), ["l_pt", "l_box"], "l_rows")
    near = lambda: g.within_distance(F.col("l_pt"), F.col("r_pt"), d)
    if "l_rows" not in kept.columns:
        pairs = spatial_join(rows, as_right(rows), "l_box", "r_box", near, d).where("l_id < r_id")
        return pairs.groupBy(F.col("l_id").alias(ident)).agg(F.count("*").alias(name))
    kept = kept.select("l_pt", "l_box", F.array_sort(F.transform("l_rows", lambda r: r["l_id"])).alias("l_ids"))
    pairs = spatial_join(kept, as_right(kept), "l_box", "r_box", near, d, load=64).select("l_ids", "r_ids")

    def later(batches):
        held, counts = None, None
        for batch in batches:
            sides = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in batch.columns]
            out = []
            for i in range(batch.num_rows):
                ids, others = (values[at[i] : at[i + 1]] for at, values in sides)
                if held is None or not np.array_equal(held, ids):
                    if held is not None:
                        out.append((held, counts))
                    held, counts = ids.copy(), np.zeros(len(ids), np.int64)
                counts += len(others) - np.searchsorted(others, ids, side="right")
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], ["id", "n"])
        if held is not None:
            yield pa.record_batch([pa.array(held), pa.array(counts)], ["id", "n"])

    counted = pairs.mapInArrow(later, "id long, n long").where("n > 0")
    return counted.groupBy(F.col("id").alias(ident)).agg(F.sum("n").alias(name))


def intersecting_lists(left: DataFrame, right: DataFrame, left_box: str, right_box: str, by: str, inner: str, name: str) -> DataFrame:
    """For each value of the left column `by`, of which all rows have one envelope, the sorted `inner` values of the right rows that it meets, joined by commas.

    Lists are made once for each envelope."""
    kinds = left.select(left_box).distinct()
    found = matched(spatial_join(kinds, right, left_box, right_box), [left_box], [inner])
    found = found.select(left_box, F.array_join(F.transform("inners", lambda v: v[inner].cast("string")), ",").alias(name))
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = left.groupBy(by, left_box).agg(F.count("*").cast("int").alias("__n")).repartition(tasks, left_box)
    again = F.array_join(F.flatten(F.transform(F.split(name, ","), lambda v: F.array_repeat(v, F.col("__n")))), ",")
    return rows.join(found.repartition(tasks, left_box).hint("merge"), left_box).select(by, F.when(F.col("__n") == 1, F.col(name)).otherwise(again).alias(name))


def matched(pairs: DataFrame, outer: list[str], inner: list[str], name: str = "inners") -> DataFrame:
    """One row for each outer row with its inner rows as an array: for results with few inner rows each."""
    return pairs.groupBy(*outer).agg(F.array_sort(F.collect_list(F.struct(*inner))).alias(name))


#: Relations of envelopes by name.
ENVELOPE_RELATIONS = {"intersects": g.meets, "contains": g.covers, "contained_by": lambda a, b: g.covers(b, a)}


def envelope_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, relation: str, cell: float | None = None) -> DataFrame:
    """Theta join of envelopes; each pair once."""
    if relation not in ENVELOPE_RELATIONS:
        raise ValueError(f"unknown relation: {relation}")
    return spatial_join(left, right, left_box, right_box, lambda: ENVELOPE_RELATIONS[relation](F.col(left_box), F.col(right_box)), cell=cell, on=([], []))


def key_matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Pairs of quadkeys that are equal or nested, by equi-join: each key against the other's prefixes."""
    prefixes = lambda k: F.transform(F.sequence(F.lit(0), F.length(k)), lambda i: F.substring(k, F.lit(1), i))
    down = left.join(right.withColumn("__p", F.explode(prefixes(F.col(right_key)))), F.col(left_key) == F.col("__p")).drop("__p")
    up = left.withColumn("__p", F.explode(prefixes(F.col(left_key)))).where(F.col("__p") != F.col(left_key))
    return down.unionByName(up.join(right, F.col("__p") == F.col(right_key)).drop("__p"))
