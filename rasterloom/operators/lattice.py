"""Components, sieves, fills and overlays on class grids."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ship import shared_folder, ship
from ..ship import stored as _shared
from .joins import FOUR, neighbours


def majority_vote(grid: DataFrame, comp: str, cls: str) -> DataFrame:
    """(comp, vote, n): the class that most edges of a component border on; ties: the larger class code."""
    n = neighbours(grid.withColumn("_s", F.struct(comp, cls)), "_s", FOUR).where(F.col(f"_s.{comp}") != F.col(f"near.{comp}"))
    n = n.groupBy(F.col(f"_s.{comp}").alias(comp), F.col(f"near.{cls}").alias("vote")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(comp).agg(F.max(F.struct("n", "vote")).alias("b")).select(comp, "b.vote", "b.n")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, comp): comp is the smallest id that edges(a, b) reach. Each round takes the smallest label nearby and then the label's own label, so rounds grow as the logarithm of a component's reach."""
    both = _shared(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = _shared(nodes.select("id", F.col("id").alias("comp")), "labels")
    while True:
        near = both.join(now, both["b"] == now["id"]).groupBy("a").agg(F.min("comp").alias("m"))
        least = now.join(near, now["id"] == near["a"], "left").select("id", F.col("comp").alias("was"), F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        # Hooking the label itself lets whole trees move at once.
        hook = least.where("comp < was").groupBy(F.col("was").alias("h")).agg(F.min("comp").alias("to"))
        hooked = least.join(hook, least["comp"] == hook["h"], "left").select("id", "was", F.least("comp", F.coalesce("to", "comp")).alias("comp"))
        own = hooked.select(F.col("id").alias("i"), F.col("comp").alias("c"))
        new = _shared(hooked.join(own, hooked["comp"] == own["i"], "left").select("id", "was", F.least("comp", F.coalesce("c", "comp")).alias("comp")), "labels")
        if new.where("comp <> was").isEmpty():
            return new.select("id", "comp")
        now = new.select("id", "comp")


TILE = 512


def label_tile(row: np.ndarray, col: np.ndarray, cls: np.ndarray, steps) -> np.ndarray:
    """For each cell, the place of the first cell of its component; cells come ordered by row and column."""
    n = len(row)
    r, c = row - row.min(), col - col.min()
    at = np.full((r.max() + 1, c.max() + 1), -1, np.int64)
    at[r, c] = np.arange(n)
    h, w = at.shape
    edges = []
    for dr, dc in steps:
        if dr < 0 or dr == 0 and dc < 0:
            continue  # the opposite step finds the same edges
        u = at[: h - dr, max(0, -dc) : w - max(0, dc)]
        v = at[dr:, max(0, dc) : w + min(0, dc)]
        both = (u >= 0) & (v >= 0)
        u, v = u[both], v[both]
        same = cls[u] == cls[v]
        edges.append((u[same], v[same]))
    u, v = (np.concatenate(x) for x in zip(*edges))
    return label_edges(n, u, v)


def label_edges(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n places, the smallest that the edges (u, v) reach."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        new = label.copy()
        np.minimum.at(new, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def cell_components(grid: DataFrame, cls: str, steps=FOUR, width: int = 1 << 31, tile: int = TILE) -> DataFrame:
    """Adds comp: connected cells of equal class share the id (row * width + col) of their first cell.

    Cells are labelled tile by tile in NumPy (a group is one tile); labels that touch across tile borders are joined by
    components(), which sees border labels only. Nulls of the class are a class of their own.
    """
    cells = grid.select("row", "col", F.col(cls).alias("_cls"), F.floor(F.col("row") / tile).alias("_tr"), F.floor(F.col("col") / tile).alias("_tc"))
    kind = cells.schema["_cls"].dataType.simpleString()

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        ids = pdf["row"].to_numpy(np.int64) * width + pdf["col"].to_numpy(np.int64)
        codes = pd.factorize(pdf["_cls"], use_na_sentinel=False)[0]
        first = label_tile(pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64), codes, steps)
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "_cls": pdf["_cls"], "_run": ids[first]})

    ship(cells.sparkSession)
    marked = _shared(cells.groupBy("_tr", "_tc").applyInPandas(label, f"row int, col int, _cls {kind}, _run long"), "labels")
    last = lambda c: F.pmod(F.col(c), F.lit(tile)) == tile - 1
    rim = marked.where(last("row") | last("col") | (F.pmod(F.col("row"), F.lit(tile)) == 0) | (F.pmod(F.col("col"), F.lit(tile)) == 0))
    forward = tuple(s for s in steps if s > (0, 0))
    info = F.struct(F.col("_run").alias("run"), F.col("_cls").alias("cls"))
    met = neighbours(rim.withColumn("_s", info), "_s", forward).where(F.col("_s.cls").eqNullSafe(F.col("near.cls")) & (F.col("_s.run") != F.col("near.run")))
    edges = _shared(met.select(F.col("_s.run").alias("a"), F.col("near.run").alias("b")).distinct(), "borders")
    if edges.isEmpty():
        return grid.join(marked.select("row", "col", F.col("_run").alias("comp")), ["row", "col"])
    nodes = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    roots = components(edges, nodes)
    comp = marked.join(roots, marked["_run"] == roots["id"], "left").select("row", "col", F.coalesce("comp", "_run").alias("comp"))
    return grid.join(comp, ["row", "col"])


def chained(sides: DataFrame, tile: int = TILE) -> DataFrame:
    """Adds chain and node to sides(id, left, right, x1, y1, x2, y2) of cells: sides of the same left and right share the smallest id where no other meets them; node: other than two meet in (x1, y1).

    Sides are joined tile by tile in NumPy (a group is one tile); components() sees only what touches a tile's rim.
    Rims are half a tile off the origin, so that a grid's first row and column aren't one.
    """
    half = tile // 2
    at = lambda c: F.floor((F.least(f"{c}1", f"{c}2") + half) / tile)
    named = sides.select("id", "left", "right", "x1", "y1", "x2", "y2", at("y").alias("_tr"), at("x").alias("_tc"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x, y = (pdf[[f"{c}1", f"{c}2"]].to_numpy(np.int64).ravel() + half - pdf[t].iloc[0] * tile for c, t in (("x", "_tc"), ("y", "_tr")))
        key = y * (tile + 1) + x
        inner = (x > 0) & (x < tile) & (y > 0) & (y < tile)
        met = np.bincount(key)[key]
        two = np.flatnonzero(inner & (met == 2))
        u, v = np.sort(two[np.argsort(key[two], kind="stable")].reshape(-1, 2) // 2, axis=1).T
        sort = pd.factorize(pdf.left)[0] * (len(pdf) + 1) + pd.factorize(pdf.right)[0]
        same = sort[u] == sort[v]
        label = label_edges(len(pdf), u[same], v[same])
        node = pd.array(met[::2] != 2, "boolean")
        node[~inner[::2]] = pd.NA
        return pdf.drop(columns=["_tr", "_tc"]).assign(_part=pdf.id.to_numpy()[label], node=node)

    ship(sides.sparkSession)
    kinds = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in ("id", "left", "right", "x1", "y1", "x2", "y2"))
    parts = _shared(named.groupBy("_tr", "_tc").applyInPandas(join, f"{kinds}, _part long, node boolean"), "parts")
    on = lambda c: F.pmod(F.col(c) + half, F.lit(tile)) == 0
    ends = parts.select("_part", "left", "right", F.inline(F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2)]))).where(on("x") | on("y"))
    ends = ends.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("_part").alias("a"), F.max("_part").alias("b"), *[f(c).alias(f"{n}{c}") for c in ("left", "right") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    ends = _shared(ends, "rims")
    edges = ends.where("n = 2 AND a <> b AND loleft = hileft AND loright = hiright").select("a", "b")
    roots = components(edges, edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct())
    nodes = ends.where("n <> 2").select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.lit(True).alias("_node"))
    rim = parts.where("node IS NULL").join(nodes, ["x1", "y1"], "left").withColumn("node", F.col("_node").isNotNull()).drop("_node")
    both = parts.where("node IS NOT NULL").unionByName(rim)
    return both.join(roots.select(F.col("id").alias("_part"), "comp"), "_part", "left").withColumn("chain", F.coalesce("comp", "_part")).drop("_part", "comp")


def patches(grid: DataFrame, cls: str, steps=FOUR, cell_area: float = 1.0) -> DataFrame:
    """(comp, cls, cells, area): a class map's polygons, as sets of cells."""
    return cell_components(grid, cls, steps).groupBy("comp", cls).agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * cell_area).alias("area"))


def sieve(grid: DataFrame, cls: str, min_cells: int, steps=FOUR, rounds: int | None = None, forced: tuple[int, ...] = (), group: str | None = None, tile: int = TILE) -> DataFrame:
    """(row, col, cls): components of fewer than min_cells cells take the class most of their border edges touch.

    First only neighbours that are large enough vote. Where no small component has such a neighbour, a small one joins
    the senior of its small neighbours (more cells; then the smaller label). forced: classes that are always small.
    group: only cells of the same group vote. Ties: the larger class code. Stops when nothing changes: each round
    joins components, so there are fewer than at first; rounds: stop after so many. Cells without a class stay as they
    are and don't vote.

    What a round makes of a cell depends on cells less than 2 * min_cells away, so tiles with a margin are taken through
    several rounds in one task each. Where that doesn't hold (forced classes, min_cells beyond a third of a tile), rounds
    are jobs over the whole grid.
    """
    kept = grid.select("row", "col", cls, *([group] if group else []))
    now = _shared(kept.where(F.col(cls).isNotNull()), "sieve")
    void = kept.where(F.col(cls).isNull()).select("row", "col", cls)
    done = sieve_jobs(now, cls, min_cells, steps, rounds, forced, group) if forced or 3 * min_cells > tile else sieve_tiles(now, cls, min_cells, steps, rounds, group, tile)
    return done.select("row", "col", cls).unionByName(void)


def sieve_tiles(now: DataFrame, cls: str, min_cells: int, steps, rounds: int | None, group: str | None, tile: int) -> DataFrame:
    """sieve() in passes of several rounds; a group is one tile and its margin.

    A vote always changes a class, so the last round in which an inner cell of any tile changed tells when the votes of
    large neighbours ended. Rounds behind it change nothing, and the next pass begins with a round of seniors.
    """
    reach = 2 * min_cells - 1
    most = max(1, min(6, tile // 4 // reach))
    names = ["row", "col", cls, *([group] if group else [])]
    kinds = ", ".join(f"`{c}` {now.schema[c].dataType.simpleString()}" for c in names)
    ship(now.sparkSession)
    senior = False
    while rounds is None or rounds > 0:
        turns = most if rounds is None else min(most, rounds)
        margin = turns * reach + min_cells
        lo, hi = (lambda c: F.floor((F.col(c) - margin) / tile)), (lambda c: F.floor((F.col(c) + margin) / tile))
        spread = now.select(*names, F.explode(F.sequence(lo("row"), hi("row"))).alias("_tr"), lo("col").alias("_a"), hi("col").alias("_b")).select(*names, "_tr", F.explode(F.sequence("_a", "_b")).alias("_tc"))

        def clean(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["row", "col"], ignore_index=True)
            row, col = pdf.row.to_numpy(np.int64), pdf.col.to_numpy(np.int64)
            inner = (row // tile == pdf._tr.iloc[0]) & (col // tile == pdf._tc.iloc[0])
            if not inner.any():
                return pdf[names].iloc[:0].assign(_n=np.int32(0), _small=False)
            codes, values = pd.factorize(pdf[cls], sort=True)
            at, last, left = codes, 0, False
            u, v = block_pairs(row, col)
            of = pd.factorize(pdf[group])[0] if group else None
            if group:
                same = (of[u] == of[v]) & (of[u] >= 0)
                u, v = u[same], v[same]
            for turn in range(turns + 1):
                comp = label_tile(row, col, at, steps)
                size = np.bincount(comp, minlength=len(row))[comp]
                left = bool((size[inner] < min_cells).any())
                if turn == turns or not (size < min_cells).any():
                    break
                new = sieve_round(comp, size, at, u, v, min_cells, senior and turn == 0)
                if (new[inner] != at[inner]).any():
                    last = turn + 1
                elif np.array_equal(new, at):
                    break
                at = new
            out = pdf[names].assign(**{cls: values[at]})[inner]
            return out.assign(_n=np.int32(last), _small=left)

        made = _shared(spread.groupBy("_tr", "_tc").applyInPandas(clean, f"{kinds}, _n int, _small boolean"), "sieve")
        last, small = made.agg(F.max("_n"), F.bool_or("_small")).first()
        now = made.select(*names)
        if not small or senior and not last:
            break
        if rounds is not None:
            rounds -= last
        senior = last < turns
    return now


def sieve_jobs(now: DataFrame, cls: str, min_cells: int, steps, rounds: int | None, forced: tuple[int, ...], group: str | None) -> DataFrame:
    """sieve() in jobs over the whole grid, for reaches that no margin bounds."""
    for _ in count() if rounds is None else range(rounds):
        comps = cell_components(now, cls, steps)
        sizes = comps.groupBy("comp", cls).agg(F.count(F.lit(1)).alias("_n"))
        sizes = sizes.withColumn("_small", (F.col("_n") < min_cells) | F.col(cls).isin(list(forced)) if forced else F.col("_n") < min_cells)
        if sizes.where("_small").isEmpty():
            break
        c = _shared(comps.join(sizes, ["comp", cls]), "sized")
        info = F.struct("comp", cls, "_n", "_small", *([F.col(group).alias("_g")] if group else []))
        n = neighbours(c.withColumn("_s", info), "_s", FOUR).where((F.col("_s.comp") != F.col("near.comp")) & F.col("_s._small"))
        if group:
            n = n.where(F.col("_s._g") == F.col("near._g"))
        n = _shared(n.groupBy(F.col("_s.comp").alias("comp"), F.col("_s._n").alias("n"), F.col("near.comp").alias("to"), F.col(f"near.{cls}").alias("vote"), F.col("near._n").alias("m"), F.col("near._small").alias("small")).agg(F.count(F.lit(1)).alias("edges")), "votes")
        vote = n.where("NOT small").groupBy("comp", "vote").agg(F.sum("edges").alias("e")).groupBy("comp").agg(F.max(F.struct("e", "vote")).alias("b")).select("comp", F.col("b.vote").alias("new"))
        if vote.isEmpty():
            senior = n.where((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("to") < F.col("comp"))))
            vote = senior.groupBy("comp", "vote").agg(F.sum("edges").alias("e")).groupBy("comp").agg(F.max(F.struct("e", "vote")).alias("b")).select("comp", F.col("b.vote").alias("new"))
            if vote.isEmpty():
                break
        now = _shared(c.join(vote, "comp", "left").select("row", "col", F.coalesce("new", cls).alias(cls), *([group] if group else [])), "sieve")
    return now


def nearest_fill(grid: DataFrame, holes: DataFrame, value: str, reach: float | None = None) -> DataFrame:
    """(row, col, value): grid, and holes(row, col) filled from the nearest valued cell by Euclidean distance; ties: the smaller value. reach: the greatest distance.

    Two separable passes, whatever the holes' size. Along columns a window gives each row that has holes the nearest
    value above or below. Along rows each hole looks at columns ever farther off, until they are farther than what it
    has. A group of the second pass is a band of rows, 256 at most and fewer where rows are long. Both windows run from
    their partition's start, so their work grows with the rows.
    """
    valued = _shared(grid.where(F.col(value).isNotNull()).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), value), "valued")
    holes = _shared(holes.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct().join(valued, ["row", "col"], "left_anti"), "holes")
    first, last, left, right = holes.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if first is None:
        return valued
    ends = valued.agg(F.min("col"), F.max("col")).first()
    if ends[0] is None:
        return valued
    band = max(1, min(256, (1 << 18) // (max(right, ends[1]) - min(left, ends[0]) + 1)))
    kind = valued.schema[value].dataType.simpleString()
    wanted = valued.select("col").distinct().withColumn("row", F.explode(F.sequence(F.lit(first), F.lit(last))))
    wanted = wanted.join(holes.select("row").distinct(), "row", "left_semi").select("row", "col", F.lit(None).cast(kind).alias(value), F.lit(True).alias("_ask"))
    both = valued.withColumn("_ask", F.lit(False)).unionByName(wanted)
    at = F.when(~F.col("_ask"), F.struct("row", value))
    above = F.last(at, True).over(W.partitionBy("col").orderBy("row", "_ask").rowsBetween(W.unboundedPreceding, 0))
    below = F.last(at, True).over(W.partitionBy("col").orderBy(F.desc("row"), "_ask").rowsBetween(W.unboundedPreceding, 0))
    off = lambda x: F.struct(F.abs(F.col("row") - x["row"]).alias("d"), x[value].alias("v"))
    near = both.select("row", "col", "_ask", above.alias("a"), below.alias("b")).where("_ask").withColumn("n", F.least(F.when(F.col("a").isNotNull(), off(F.col("a"))), F.when(F.col("b").isNotNull(), off(F.col("b")))))
    lines = near.select("row", "col", F.col("n.d").alias("d"), F.col("n.v").alias(value), F.lit(False).alias("_hole"))
    lines = lines.unionByName(holes.select("row", "col", F.lit(None).cast("int").alias("d"), F.lit(None).cast(kind).alias(value), F.lit(True).alias("_hole")))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        hole, have = pdf[pdf._hole], pdf[~pdf._hole]
        if not len(hole) or not len(have):
            return hole[["row", "col", value]].iloc[:0]
        r, c, r1, c1 = (x.to_numpy(np.int64) for x in (hole.row, hole.col, have.row, have.col))
        codes, values = pd.factorize(have[value], sort=True)  # the smaller value has the smaller code
        top, low = r.min(), min(c.min(), c1.min())
        n = max(c.max(), c1.max()) - low + 1
        d, code = (np.full((r.max() - top + 1, n), x, np.int64) for x in (np.iinfo(np.int64).max // 4, len(values)))
        d[r1 - top, c1 - low], code[r1 - top, c1 - low] = have.d.to_numpy(np.int64) ** 2, codes
        row, best, what = r - top, d[r - top, c - low], code[r - top, c - low]
        left, k = np.arange(len(c)), 0
        while len(left):
            k += 1
            left = left[(best[left] >= k * k) & (k < n)]
            for side in (c[left] - low - k, c[left] - low + k):
                inside = (side >= 0) & (side < n)
                i, j = left[inside], side[inside]
                new, v = d[row[i], j] + k * k, code[row[i], j]
                nearer = (new < best[i]) | ((new == best[i]) & (v < what[i]))
                best[i[nearer]], what[i[nearer]] = new[nearer], v[nearer]
        out = pd.DataFrame({"row": hole.row, "col": hole.col, value: np.asarray(values)[np.minimum(what, len(values) - 1)]})
        return out if reach is None else out[best <= reach * reach]

    ship(lines.sparkSession)
    return valued.unionByName(_shared(lines.groupBy(F.floor(F.col("row") / band).alias("_band")).applyInPandas(fill, f"row int, col int, {value} {kind}"), "filled"))


def dissolve(grid: DataFrame, cls: str, mapping: dict[int, int], steps=FOUR) -> DataFrame:
    """Patches after all codes are replaced at once."""
    from ..functions.codes import replace_codes

    return patches(grid.withColumn(cls, replace_codes(F.col(cls), mapping)), cls, steps)


def overlay(targets: list[DataFrame], base: DataFrame, cls: str) -> DataFrame:
    """(row, col, cls, src): the first target that covers a cell wins; base where none does; src says which (0: base)."""
    from functools import reduce

    layers = [t.select("row", "col", cls, F.lit(i + 1).alias("src"), F.lit(i).alias("_p")) for i, t in enumerate(targets)]
    layers.append(base.select("row", "col", cls, F.lit(0).alias("src"), F.lit(len(targets)).alias("_p")))
    u = reduce(DataFrame.unionByName, layers)
    # One column for each layer, as a struct of place and class can't be hashed together and would be sorted. A null class comes first in its layer.
    own = lambda i, x: F.when(F.col("_p") == i, x)
    each = [f(own(i, x)).alias(f"{n}{i}") for i in range(len(layers)) for n, f, x in (("_c", F.min, F.col(cls)), ("_v", F.bool_or, F.col(cls).isNull()))]
    won = u.groupBy("row", "col").agg(F.min("_p").alias("_p"), *each)
    value = F.coalesce(*[F.when((F.col("_p") == i) & ~F.col(f"_v{i}"), F.col(f"_c{i}")) for i in range(len(layers))])
    return won.select("row", "col", value.alias(cls), F.when(F.col("_p") < len(targets), F.col("_p") + 1).otherwise(0).alias("src"))


def no_overlap(cells: DataFrame, key: str, is_target: str, area: str) -> DataFrame:
    """Of the objects that claim a cell, a target wins, then the larger, then the smaller key."""
    return cells.groupBy("row", "col").agg(F.min_by(key, F.struct(~F.col(is_target), -F.col(area), F.col(key))).alias(key))


def dilate(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Cells within radius (a square window) of a cell of the set."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    r = cells.select("row", "col", F.explode(span).alias("_d")).select((F.col("row") + F.col("_d")).alias("row"), "col").distinct()
    return r.select("row", "col", F.explode(span).alias("_d")).select("row", (F.col("col") + F.col("_d")).alias("col")).distinct()


def erode(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Cells whose whole square window is in the set."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    n = 2 * radius + 1
    r = cells.select("row", "col", F.explode(span).alias("_d")).select((F.col("row") + F.col("_d")).alias("row"), "col").groupBy("row", "col").count().where(F.col("count") == n).drop("count")
    return r.select("row", "col", F.explode(span).alias("_d")).select("row", (F.col("col") + F.col("_d")).alias("col")).groupBy("row", "col").count().where(F.col("count") == n).drop("count")


def close_gaps(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Morphological closing: gaps narrower than the window are filled."""
    return erode(dilate(cells, radius), radius).unionByName(cells.select("row", "col")).distinct()


def slivers(grid: DataFrame, comp: str, radius: int = 1) -> DataFrame:
    """Components that vanish when eroded."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    k = (2 * radius + 1) ** 2
    spread = grid.select(comp, "row", "col", F.explode(span).alias("_a")).select(comp, (F.col("row") + F.col("_a")).alias("row"), "col", F.explode(span).alias("_b")).select(comp, "row", (F.col("col") + F.col("_b")).alias("col"))
    core = spread.groupBy(comp, "row", "col").count().where(F.col("count") == k).select(comp).distinct()
    return grid.select(comp).distinct().join(core, comp, "left_anti")


def merge_slivers(grid: DataFrame, cls: str, radius: int = 1, steps=FOUR) -> DataFrame:
    """(row, col, cls): components that vanish when eroded take the class that most of their border edges touch, all at once; ties: the larger class code."""
    c = _shared(cell_components(grid.select("row", "col", cls), cls, steps), "parts")
    vote = majority_vote(c, "comp", cls).join(slivers(c, "comp", radius), "comp", "left_semi")
    return c.join(vote.select("comp", "vote"), "comp", "left").select("row", "col", F.coalesce("vote", cls).alias(cls))


def fill_holes(mask: DataFrame, max_cells: int) -> DataFrame:
    """A mask (row, col, m) of 0 and 1: components of fewer than max_cells cells take the other value, holes first. Components at the frame's edge count like others."""
    def flip(g: DataFrame, value: int) -> DataFrame:
        c = cell_components(g, "m")
        small = c.where(F.col("m") == value).groupBy("comp").count().where(F.col("count") < max_cells).select("comp", F.lit(True).alias("_f"))
        return _shared(c.join(small, "comp", "left").select("row", "col", F.when(F.col("_f"), 1 - F.col("m")).otherwise(F.col("m")).alias("m")), "mask")

    return flip(flip(mask, 0), 1)


def segments(grid: DataFrame, cls: str) -> DataFrame:
    """(row, col, cls, case, x1, y1, x2, y2): marching squares at one half for each class, over the 2 by 2 quads that hold it.

    A quad's four corners make a case of 1 to 14; each case has one or two segments between edge midpoints.
    """
    # Edges 0 top, 1 right, 2 bottom, 3 left of a quad whose corners are bits 8 4 2 1 clockwise from top left.
    cases = {1: ((3, 2),), 2: ((2, 1),), 3: ((3, 1),), 4: ((1, 0),), 5: ((3, 0), (1, 2)), 6: ((2, 0),), 7: ((3, 0),), 8: ((0, 3),), 9: ((0, 2),), 10: ((0, 1), (2, 3)), 11: ((0, 1),), 12: ((1, 3),), 13: ((1, 2),), 14: ((2, 3),)}
    mid = {0: (0.5, 0.0), 1: (1.0, 0.5), 2: (0.5, 1.0), 3: (0.0, 0.5)}
    corners = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(w).alias("w")) for a, b, w in ((0, 0, 8), (0, -1, 4), (-1, -1, 2), (-1, 0, 1))])
    q = grid.select("row", "col", cls, F.explode(corners).alias("k")).select((F.col("row") + F.col("k.dr")).alias("row"), (F.col("col") + F.col("k.dc")).alias("col"), cls, "k.w")
    q = q.groupBy("row", "col", cls).agg(F.sum("w").alias("case")).where("case < 15")
    rows = F.array(*[F.struct(F.lit(c).alias("c"), *[F.lit(v).alias(n) for n, v in zip(("ax", "ay", "bx", "by"), (*mid[a], *mid[b]))]) for c, s in cases.items() for a, b in s])
    out = q.withColumn("s", F.explode(F.filter(rows, lambda x: x["c"] == F.col("case"))))
    return out.select("row", "col", cls, "case", (F.col("col") + F.col("s.ax")).alias("x1"), (F.col("row") + F.col("s.ay")).alias("y1"), (F.col("col") + F.col("s.bx")).alias("x2"), (F.col("row") + F.col("s.by")).alias("y2"))


def structural_sieve(grid: DataFrame, cls: str, structure: dict[int, int], min_cells: int) -> DataFrame:
    """Sieves structural classes, then gives each cell whose structure changed the nearest type of its new structure."""
    table = F.create_map(*[F.lit(x) for kv in structure.items() for x in kv])
    g = _shared(grid.select("row", "col", cls, F.element_at(table, F.col(cls)).alias("_st")), "structure")
    new = sieve(g.select("row", "col", F.col("_st")), "_st", min_cells).withColumnRenamed("_st", "_new")
    both = _shared(g.join(new, ["row", "col"]), "structure")
    kept = both.where("_st = _new").select("row", "col", cls)
    out = kept
    for s in sorted(set(structure.values())):  # a handful of structures
        holes = both.where((F.col("_new") == s) & (F.col("_st") != s)).select("row", "col")
        inside = both.where(F.col("_new") == s).select("row", "col")
        near = nearest_fill(kept.join(inside, ["row", "col"], "left_semi"), holes, cls)
        out = out.unionByName(near.join(holes, ["row", "col"], "left_semi"))
    return out


def correct(targets: list[DataFrame], base: DataFrame, extent: DataFrame, cls: str) -> DataFrame:
    """Targets by priority over base, then what of the extent is still void from the nearest cell."""
    laid = overlay(targets, base, cls).select("row", "col", cls)
    return nearest_fill(laid, extent, cls)


def report(cells: DataFrame, extent: DataFrame) -> DataFrame:
    """(what, n): cells that several objects claim, and cells of the extent that none does."""
    over = cells.groupBy("row", "col").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    gap = extent.join(cells, ["row", "col"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return over.select(F.lit("overlap").alias("what"), "n").unionByName(gap.select(F.lit("gap").alias("what"), "n"))


def far_nearest(cells: DataFrame, points: DataFrame, size: int, extent: float) -> DataFrame:
    """(row, col, id): each cell's nearest point, ties by the smaller id, by descent over boxes of cells and boxes of points.

    Boxes of both sides are cut in four along each axis from level to level, down to `size`. A box of cells goes on with the
    boxes of points that may hold the nearest one: those no farther than the least greatest distance to any of them.
    Cells bound their boxes once more on their own and then look at points.
    """

    def boxes(df: DataFrame, level: int, side: str) -> DataFrame:
        ends = [f(f"{c}{i}").alias(f"{side}{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))]
        return df.groupBy(*[F.floor(F.col(f"b{c}") / 4**level).alias(f"{side}{c}") for c in "xy"]).agg(*ends)

    def leaves(df: DataFrame, x: Column, y: Column) -> DataFrame:
        at = df.select(x.alias("x"), y.alias("y")).select("x", "y", F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"))
        return _shared(at.groupBy("bx", "by").agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))]), "boxes")

    def near(pairs: DataFrame, *by: str) -> DataFrame:
        apart = lambda c: F.greatest(F.col(f"t{c}0") - F.col(f"n{c}1"), F.col(f"n{c}0") - F.col(f"t{c}1"), F.lit(0.0))
        over = lambda c: F.greatest(F.col(f"t{c}1") - F.col(f"n{c}0"), F.col(f"n{c}1") - F.col(f"t{c}0"))
        pairs = pairs.withColumn("_least", apart("x") ** 2 + apart("y") ** 2).withColumn("_bound", F.min(over("x") ** 2 + over("y") ** 2).over(W.partitionBy(*by)))
        return pairs.where(F.col("_least") <= F.col("_bound") * (1 + 1e-9) + 1e-5)  # distances count to six digits

    cells = cells.select("row", "col", (F.col("col") + 0.5).alias("_x"), (F.col("row") + 0.5).alias("_y"))
    tiles, nodes = leaves(cells, F.col("_x"), F.col("_y")), leaves(points, F.col("x"), F.col("y"))
    level, pairs = 0, None
    while size * 4**level < extent:
        level += 1
    while level >= 0:
        t, n = boxes(tiles, level, "t"), boxes(nodes, level, "n")
        if pairs is None:  # the whole extent: two boxes along each axis at most
            met = t.crossJoin(n)
        else:
            up = lambda df, s: df.withColumns({f"_{s}{c}": F.floor(F.col(f"{s}{c}") / 4) for c in "xy"})
            met = pairs.join(up(t, "t"), ["_tx", "_ty"]).join(up(n, "n"), ["_nx", "_ny"])
        pairs = _shared(near(met, "tx", "ty").select(*[F.col(c).alias(f"_{c}") for c in ("tx", "ty", "nx", "ny")]), "pairs")
        level -= 1
    c = cells.select("row", "col", F.floor(F.col("_x") / size).alias("_tx"), F.floor(F.col("_y") / size).alias("_ty"), *[F.col(f"_{c}").alias(f"t{c}{i}") for c in "xy" for i in (0, 1)])
    asked = c.join(pairs, ["_tx", "_ty"]).join(boxes(nodes, 0, "n").withColumnsRenamed({"nx": "_nx", "ny": "_ny"}), ["_nx", "_ny"])
    asked = near(asked, "row", "col").select("row", "col", "_nx", "_ny")
    p = points.select("id", "x", "y", F.floor(F.col("x") / size).alias("_nx"), F.floor(F.col("y") / size).alias("_ny"))
    d = F.round((F.col("col") + 0.5 - F.col("x")) ** 2 + (F.col("row") + 0.5 - F.col("y")) ** 2, 6)
    return asked.join(p, ["_nx", "_ny"]).groupBy("row", "col").agg(F.min(F.struct(d.alias("d"), "id")).alias("b")).select("row", "col", F.col("b.id").alias("id"))


def split_by_points(cells: DataFrame, points: DataFrame, reach: int = 6) -> DataFrame:
    """(row, col, id): each cell's nearest point, ties by the smaller id; none if there are no points. A cell looks in blocks of `reach` cells around its own; cells that find none within reach descend over boxes of points."""
    ends = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).unionByName(cells.agg(F.min("col"), F.max("col"), F.min("row"), F.max("row")).toDF("min(x)", "max(x)", "min(y)", "max(y)")).collect()
    if any(r[0] is None for r in ends):
        return cells.select("row", "col", F.lit(None).cast(points.schema["id"].dataType).alias("id")).limit(0)
    extent = max(max(r[1] for r in ends) - min(r[0] for r in ends), max(r[3] for r in ends) - min(r[2] for r in ends)) + 1
    d = F.round((F.col("col") + 0.5 - F.col("x")) ** 2 + (F.col("row") + 0.5 - F.col("y")) ** 2, 6)
    span = F.sequence(F.lit(-1), F.lit(1))
    # Of points in one place the smallest id is enough.
    points = _shared(points.groupBy("x", "y").agg(F.min("id").alias("id")), "points")
    p = points.select("id", "x", "y", F.floor(F.col("x") / reach).alias("_bx"), F.floor(F.col("y") / reach).alias("_by"))
    spread = p.select("id", "x", "y", "_bx", "_by", F.explode(span).alias("_i")).select("id", "x", "y", (F.col("_bx") + F.col("_i")).alias("_bx"), "_by", F.explode(span).alias("_j")).select("id", "x", "y", "_bx", (F.col("_by") + F.col("_j")).alias("_by"))
    cells = _shared(cells.select("row", "col"), "cells")
    c = cells.select("row", "col", F.floor(F.col("col") / reach).cast("long").alias("_bx"), F.floor(F.col("row") / reach).cast("long").alias("_by"))
    near = c.join(spread, ["_bx", "_by"]).withColumn("_d", d).groupBy("row", "col").agg(F.min(F.struct("_d", "id")).alias("b"))
    # Beyond the reach less a cell's half, a point of a block farther off may be nearer.
    near = _shared(near.where(F.col("b._d") <= float((reach - 0.5) ** 2) if reach < extent else F.lit(True)).select("row", "col", F.col("b.id").alias("id")), "near")
    rest = _shared(cells.join(near, ["row", "col"], "left_anti"), "far")
    return near if rest.isEmpty() else near.unionByName(far_nearest(rest, points, reach, extent))


def tiled(grid: DataFrame, cls: str, tile: int, margin: int, min_cells: int = 4) -> DataFrame:
    """(tile_r, tile_c, row, col, cls): each tile with its margin is cleaned on its own by Arrow-fed NumPy code, and its inner cells are kept.

    A cell is repeated for the tiles whose margin it is in; a group is one tile and its margin.
    """
    def lo(c: str):
        return F.floor((F.col(c) - margin) / tile)

    def hi(c: str):
        return F.floor((F.col(c) + margin) / tile)

    spread = grid.select("row", "col", cls, F.explode(F.sequence(lo("row"), hi("row"))).alias("tile_r"), lo("col").alias("_a"), hi("col").alias("_b")).select("row", "col", cls, "tile_r", F.explode(F.sequence("_a", "_b")).alias("tile_c"))

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        """Cells that fewer than min_cells of their 3 by 3 window agree with take the window's commonest class, the larger on ties."""
        r0, c0 = pdf.row.min(), pdf.col.min()
        a = np.full((pdf.row.max() - r0 + 3, pdf.col.max() - c0 + 3), -1, np.int64)
        a[pdf.row - r0 + 1, pdf.col - c0 + 1] = pdf[cls]
        near = np.stack([np.roll(np.roll(a, i, 0), j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        codes = np.unique(pdf[cls])
        votes = np.stack([(near == c).sum(0) for c in codes])
        own = (near == a).sum(0)
        best = codes[len(codes) - 1 - votes[::-1].argmax(0)]
        out = np.where(own < min_cells, best, a)
        pdf = pdf.assign(**{cls: out[pdf.row - r0 + 1, pdf.col - c0 + 1]})
        tr, tc = pdf.tile_r.iloc[0], pdf.tile_c.iloc[0]
        return pdf[(pdf.row // tile == tr) & (pdf.col // tile == tc)][["tile_r", "tile_c", "row", "col", cls]]

    ship(spread.sparkSession)
    return spread.groupBy("tile_r", "tile_c").applyInPandas(clean, f"tile_r long, tile_c long, row int, col int, {cls} int")


def block_pairs(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): the places of each cell and each of its four neighbours that exist."""
    r, c = row - row.min(), col - col.min()
    at = np.full((r.max() + 1, c.max() + 1), -1, np.int64)
    at[r, c] = np.arange(len(row))
    down, right = ((x.ravel(), y.ravel()) for x, y in ((at[:-1], at[1:]), (at[:, :-1], at[:, 1:])))
    u, v = (np.concatenate(x) for x in zip(down, right))
    both = (u >= 0) & (v >= 0)
    u, v = u[both], v[both]
    return np.concatenate([u, v]), np.concatenate([v, u])


def sieve_round(comp: np.ndarray, size: np.ndarray, codes: np.ndarray, u: np.ndarray, v: np.ndarray, min_cells: int, senior: bool) -> np.ndarray:
    """The codes after one round: of small components, those with voters take the code with most edges, then the larger. Voters are large neighbours, or with senior small ones of more cells, then of the smaller label."""
    asks = (comp[u] != comp[v]) & (size[u] < min_cells)
    u, v = u[asks], v[asks]
    votes = (size[v] > size[u]) | (size[v] == size[u]) & (comp[v] < comp[u]) if senior else size[v] >= min_cells
    if not votes.any():
        return codes
    n = int(codes.max()) + 1
    key, edges = np.unique(comp[u[votes]] * n + codes[v[votes]], return_counts=True)
    best = np.full(len(comp), -1, np.int64)
    np.maximum.at(best, key // n, edges * n + key % n)
    won = best[comp]
    return np.where(won >= 0, won % n, codes)


def sieve_block(row: np.ndarray, col: np.ndarray, cls: np.ndarray, min_cells: int) -> np.ndarray:
    """sieve() of a block of cells, ordered by row and column, in one task."""
    codes, values = pd.factorize(cls, sort=True)
    u, v = block_pairs(row, col)
    while True:
        comp = label_tile(row, col, codes, FOUR)
        size = np.bincount(comp, minlength=len(row))[comp]
        new = sieve_round(comp, size, codes, u, v, min_cells, False)
        if np.array_equal(new, codes):
            new = sieve_round(comp, size, codes, u, v, min_cells, True)
        if np.array_equal(new, codes):
            return values[codes].astype(cls.dtype)
        codes = new


def tiled_sieve(grid: DataFrame, cls: str, min_cells: int, tile: int = TILE, margin: int = 16) -> DataFrame:
    """(tile_r, tile_c, row, col, cls): each tile with its margin is sieved on its own, and its inner cells are kept. As sieve() where no component of a tile and its margin reaches beyond; a group is one tile and its margin."""
    def lo(c: str):
        return F.floor((F.col(c) - margin) / tile)

    def hi(c: str):
        return F.floor((F.col(c) + margin) / tile)

    spread = grid.select("row", "col", cls, F.explode(F.sequence(lo("row"), hi("row"))).alias("tile_r"), lo("col").alias("_a"), hi("col").alias("_b")).select("row", "col", cls, "tile_r", F.explode(F.sequence("_a", "_b")).alias("tile_c"))

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        pdf = pdf.assign(**{cls: sieve_block(pdf.row.to_numpy(np.int64), pdf.col.to_numpy(np.int64), pdf[cls].to_numpy(), min_cells)})
        return pdf[(pdf.row // tile == pdf.tile_r) & (pdf.col // tile == pdf.tile_c)][["tile_r", "tile_c", "row", "col", cls]]

    ship(spread.sparkSession)
    return spread.groupBy("tile_r", "tile_c").applyInPandas(clean, f"tile_r long, tile_c long, row int, col int, {cls} int")


def stored_parts(grid: DataFrame, part: str, name: str | None = None) -> DataFrame:
    """Writes the parts to the shared folder and reads them all; a part's rows are together and files hold whole parts, unless one is so large that several tasks write it, so files grow with the rows and not with parts times tasks. With a name, parts that an earlier run under that name has finished stay as they are, and only the others are computed and added."""
    import uuid

    from pyspark.errors import AnalysisException

    spark = grid.sparkSession
    path = f"{shared_folder(spark)}/parts/{name or uuid.uuid4().hex}"
    try:
        done = spark.read.parquet(path).select(part).distinct()
        grid = grid.join(done, grid[part].cast("string") == done[part].cast("string"), "left_anti")
    except AnalysisException:  # nothing is there yet
        pass
    grid.hint("rebalance", F.col(part)).sortWithinPartitions(part).write.mode("append").parquet(path)
    return spark.read.parquet(path)
