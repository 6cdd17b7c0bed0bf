"""Haplotype paths on a reference: placed steps, pieces of tiles, departures."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pangrove.functions.names import sample
from pangrove.graph import Graph
from pangrove.operators.intervals import MOST_BP, cover, holes, tile_of
from pangrove.operators import place as placing
from pangrove.operators.place import check_steps, offset_steps
from pangrove.plans.storage import written

TILE, STAY = 65_536, 311


def reference_visits(offset: DataFrame, ref: str) -> DataFrame:
    """``(node, seq, ref_offset, ref_rev, passes)``: each visit of the reference sample's own lines.

    Segments of no length are not steps of a walk.
    """
    own = offset.where((sample(F.col("name")) == ref) & (F.col("length") > 0))
    passes = own.groupBy("node").agg(F.count("*").alias("passes"))
    return own.select("node", F.col("name").alias("seq"), F.col("offset").alias("ref_offset"), F.col("rev").alias("ref_rev")).join(passes, "node")


def reference_ends(offset: DataFrame, ref: str) -> DataFrame:
    own = offset.where(sample(F.col("name")) == ref)
    return own.groupBy(F.col("name").alias("seq")).agg(F.max(F.col("offset") + F.col("length")).cast("bigint").alias("end_pos"))


def reference_holes(offset: DataFrame, ref: str) -> DataFrame:
    own = offset.where(sample(F.col("name")) == ref)
    spans = own.groupBy("line", F.col("name").alias("seq"), F.col("start").alias("start_pos")).agg(F.max(F.col("offset") + F.col("length")).alias("end_pos"))
    return holes(spans.select("seq", "start_pos", "end_pos"))


def stable_placement(offset: DataFrame, ref: str) -> DataFrame:
    """Nodes off the reference at the least (name, offset) of the paths that visit them."""
    visits = reference_visits(offset, ref).select("node").distinct()
    off = offset.where(F.col("length") > 0).join(visits, "node", "left_anti")
    return off.groupBy("node").agg(F.min(F.struct("name", "offset")).alias("at")).select("node", F.col("at.name").alias("seq"), F.col("at.offset").alias("start_pos"))


_NO_VISITS = "cast(array() as array<struct<seq: string, ref_offset: bigint, ref_rev: boolean>>)"


def _with_visits(steps: DataFrame, visits: DataFrame) -> DataFrame:
    """Steps with all passes of the reference over their node, by sequence and offset."""
    ordered = visits.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("seq", "ref_offset", "ref_rev"))).alias("visits"))
    return steps.join(ordered, "node", "left").withColumn("visits", F.coalesce("visits", F.expr(_NO_VISITS)))


def _stretches(steps: DataFrame) -> DataFrame:
    """Steps with ``stretch``: from one step on a node passed once to before the next, and whether it needs choices.

    A node passed once fixes the place, so stretches are placed each by itself;
    what is before a line's first such node goes with its first stretch.
    """
    along = Window.partitionBy("line").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    once = (F.size("visits") == 1).cast("int")
    steps = steps.withColumn("stretch", F.greatest(F.sum(once).over(along), F.lit(1)))
    return steps.withColumn("choice", F.max(F.size("visits") > 1).over(Window.partitionBy("line", "stretch")))


def _records(rows: pd.DataFrame) -> list[dict]:
    """Steps in order; their passes as plain (sequence, offset, strand)."""
    steps = rows.sort_values("i").to_dict("records")
    for s in steps:
        s["visits"] = [(v["seq"], v["ref_offset"], v["ref_rev"]) for v in s["visits"]]
    return steps


def _expected(place: tuple, step: dict) -> int:
    """The offset at which a step lies that is as far along the reference as along the path."""
    at, turned, was = place
    gone = step["offset"] - was["offset"]
    return at + gone if was["rev"] == turned else at + was["length"] - gone - step["length"]


def _nearest_passes(rows: pd.DataFrame) -> pd.DataFrame:
    """One stretch's places: outward both ways from its node passed once.

    Each step takes, on the sequence that the last placed step is on, the pass
    nearest to where that predicts it (the lower offset on a tie), else its
    node's first pass.
    """
    steps = _records(rows)
    on = [k for k, s in enumerate(steps) if len(s["visits"])]
    anchor = next((k for k in on if len(steps[k]["visits"]) == 1), on[0])
    chosen = {}
    for order in ([k for k in on if k >= anchor], [k for k in reversed(on) if k <= anchor]):
        last = None
        for k in order:
            passes = [v for v in steps[k]["visits"] if last and v[0] == last[0]]
            if k not in chosen:
                if passes:
                    x = bisect.bisect_left([v[1] for v in passes], goal := _expected(last[1:], steps[k]))
                    chosen[k] = min(passes[max(0, x - 1) : x + 1], key=lambda v: (abs(v[1] - goal), v[1]))
                else:
                    chosen[k] = steps[k]["visits"][0]
            seq, at, turned = chosen[k]
            last = seq, at, turned, steps[k]
    return pd.DataFrame([(steps[k]["line"], steps[k]["i"], *chosen[k]) for k in sorted(chosen)], columns=["line", "i", "seq", "ref_offset", "ref_rev"])


_CHOSEN = "line string, i bigint, seq string, ref_offset bigint, ref_rev boolean"


def place_steps(offset: DataFrame, ref: str, revisited: bool | None = None) -> DataFrame:
    """Steps with their place on the reference: ``seq, ref_offset, ref_rev, passes``, null off it.

    A reference's own steps lie at their own offsets.  Where no reference node
    is passed twice this is one equality join; else stretches that meet such
    nodes go through a grouped map, a stretch at a time.
    """
    steps = offset.where(F.col("length") > 0)
    visits = reference_visits(offset, ref)
    if revisited is None:
        revisited = visits.where("passes > 1").limit(1).count() > 0
    own = sample(F.col("name")) == ref
    passes = visits.select("node", "passes").distinct()
    placed_own = steps.where(own).join(passes, "node").select(
        *steps.columns, F.col("name").alias("seq"), F.col("offset").alias("ref_offset"), F.col("rev").alias("ref_rev"), "passes"
    )
    others = steps.where(~own)
    if not revisited:
        return placed_own.unionByName(others.join(visits, "node", "left").select(placed_own.columns))
    rows = _stretches(_with_visits(others, visits))
    only = F.get("visits", F.lit(0))
    settled = rows.where(~F.col("choice")).select(*steps.columns, *(only[c].alias(c) for c in ("seq", "ref_offset", "ref_rev")))
    open_rows = rows.where("choice")
    chosen = open_rows.select("line", "stretch", "i", "offset", "length", "rev", "visits").groupBy("line", "stretch").applyInPandas(_nearest_passes, _CHOSEN)
    placed = settled.unionByName(open_rows.select(steps.columns).join(chosen, ["line", "i"], "left").select(settled.columns))
    return placed_own.unionByName(placed.join(passes, "node", "left").select(placed_own.columns))


_MOVED = "line string, i bigint, t_seq string, t_tile bigint, seq string, ref_offset bigint, ref_rev boolean"


def _stays(rows: pd.DataFrame, tile: int, stay: int) -> pd.DataFrame:
    """One stretch's steps kept in the tile they come back to.

    A run of steps away from the current tile stays in it where the path comes
    back, the run spends ``stay`` bp at most on reference nodes, none of them
    passed once, and each that the tile has passes of finds one within ``stay``
    bp of where the last placed step predicts it.  Steps on other nodes of the
    reference lose their place there.
    """
    steps = _records(rows)
    where = [(s["t_seq"], s["t_tile"]) for s in steps]
    after = (steps[-1]["next_seq"], steps[-1]["next_tile"])  # of the node passed once behind the stretch
    place = [(s["seq"], int(s["ref_offset"]), bool(s["ref_rev"])) if isinstance(s["seq"], str) else None for s in steps]

    def resettled(home: tuple, run: range) -> dict | None:
        known = next(((place[k], k) for k in range(run.start - 1, -1, -1) if place[k]), None)
        out = {}
        for k in run:
            if place[k] is None:
                continue
            here = [v for v in steps[k]["visits"] if v[0] == home[0] and home[1] <= v[1] < home[1] + tile]
            if not here:
                out[k] = None
                continue
            if known is None:
                return None
            goal = _expected((known[0][1], known[0][2], steps[known[1]]), steps[k])
            best = min(here, key=lambda v: abs(v[1] - goal))
            if abs(best[1] - goal) > stay:
                return None
            out[k] = (best[0], int(best[1]), bool(best[2]))
            known = out[k], k
        return out

    home, k, n = where[0], 1, len(steps)
    while k < n:
        end, bp, once = k, 0, False
        while end < n and where[end] != home and bp <= stay:
            if len(steps[end]["visits"]):
                bp += steps[end]["length"]
                once |= len(steps[end]["visits"]) == 1
            end += 1
        back = end > k and bp <= stay and not once and (where[end] if end < n else after) == home
        moved = resettled(home, range(k, end)) if back else None
        if moved is None:
            home, k = where[k], k + 1
            continue
        for x, new in moved.items():
            place[x] = new
        where[k:end] = [home] * (end - k)
        k = end
    none = (None, None, None)
    return pd.DataFrame(
        [(s["line"], s["i"], *w, *(p or none)) for s, w, p in zip(steps, where, place)], columns=[c.split()[0] for c in _MOVED.split(", ")]
    ).astype({"ref_offset": "Int64", "ref_rev": "boolean"})


def _kept_home(steps: DataFrame, visits: DataFrame, tile: int, stay: int) -> DataFrame:
    """The other lines' steps, with those moved that ``_stays`` keeps in their tile."""
    rows = _stretches(_with_visits(steps, visits))
    ahead = Window.partitionBy("line").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    once = F.size("visits") == 1
    rows = rows.withColumns({f"next_{c}": F.last(F.when(once, F.col(f"t_{c}")), ignorenulls=True).over(ahead) for c in ("seq", "tile")})
    open_rows = rows.where("choice")
    moved = open_rows.select(
        "line", "stretch", "i", "offset", "length", "rev", "visits", "seq", "ref_offset", "ref_rev", "t_seq", "t_tile", "next_seq", "next_tile"
    ).groupBy("line", "stretch").applyInPandas(lambda df: _stays(df, tile, stay), _MOVED)
    kept = [c for c in steps.columns if c not in ("t_seq", "t_tile", "seq", "ref_offset", "ref_rev")]
    return rows.where(~F.col("choice")).select(steps.columns).unionByName(open_rows.select(kept).join(moved, ["line", "i"]).select(steps.columns))


def tiled_steps(placed: DataFrame, ref: str, tile: int = TILE, stay: int = 0, block: int | None = None) -> DataFrame:
    """Steps with the tile they are cut into (``t_seq, t_tile``) and the number of their piece.

    A step off the reference stays in the tile of the last placed step, at the
    line's start in that of the first.  Lines with no placed step are left out.
    Lines are cut in blocks of ``block`` steps; what a block takes over from
    those before it is a row for each block.  Where no line is longer than a
    block, nothing is taken over.
    """
    block = block or placing.BLOCK
    longest = placed.agg(F.max("i")).first()[0]
    several = longest is not None and longest >= block
    here = F.when(F.col("seq").isNotNull(), F.struct(F.col("seq").alias("s"), tile_of(F.col("ref_offset"), tile).alias("t")))
    steps = placed.withColumns({"b": F.floor(F.col("i") / block), "here": here})
    inside = Window.partitionBy("line", "b").orderBy("i")
    # Only steps with no place before them look ahead, so the first place of their whole block is the one ahead:
    # a frame that ends with the block but moves with the row would be summed anew for each step.
    back, whole = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if several:
        steps = steps.join(_carried(steps), ["line", "b"])
    else:
        none = F.lit(None).cast(steps.schema["here"].dataType)
        steps = steps.withColumns({"before": none, "behind": none})
    home = F.coalesce(F.last("here", ignorenulls=True).over(back), F.col("before"), F.first("here", ignorenulls=True).over(whole), F.col("behind"))
    steps = steps.withColumn("home", home).where(F.col("home").isNotNull())
    steps = steps.withColumns({"t_seq": F.col("home.s"), "t_tile": F.col("home.t")}).drop("home", "here", "before", "behind", "b")
    if stay > 0:  # only nodes that the reference passes more than once let a step stay
        own = steps.where(sample(F.col("name")) == ref)
        visits = own.select("node", "seq", "ref_offset", "ref_rev")
        steps = own.unionByName(_kept_home(steps.where(sample(F.col("name")) != ref), visits, tile, stay))
    return _numbered(steps, block, several)


def _carried(steps: DataFrame) -> DataFrame:
    """``(line, b, before, behind)``: the last place in the blocks before each, and the first in those behind."""
    at = F.when(F.col("here").isNotNull(), F.struct("i", "here"))
    ends = steps.groupBy("line", "b").agg(F.min(at)["here"].alias("first"), F.max(at)["here"].alias("last"))
    earlier = lambda order: Window.partitionBy("line").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        "line", "b", F.last("last", ignorenulls=True).over(earlier("b")).alias("before"),
        F.last("first", ignorenulls=True).over(earlier(F.desc("b"))).alias("behind"),
    )


def _numbered(steps: DataFrame, block: int, several: bool) -> DataFrame:
    """Steps with the number of their piece: how often the tile has changed since the line's start."""
    if not several:
        along = Window.partitionBy("line").orderBy("i")
        now = F.struct("t_seq", "t_tile")
        steps = steps.withColumn("new", (~now.eqNullSafe(F.lag(now).over(along))).cast("bigint"))
        return steps.withColumn("piece", (F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("bigint")).drop("new")
    steps = steps.withColumns({"b": F.floor(F.col("i") / block), "now": F.struct("t_seq", "t_tile")})
    blocks = Window.partitionBy("line").orderBy("b")
    last = steps.groupBy("line", "b").agg(F.max(F.struct("i", "now"))["now"].alias("end"))
    steps = steps.join(last.select("line", "b", F.lag("end").over(blocks).alias("before")), ["line", "b"])
    inside = Window.partitionBy("line", "b").orderBy("i")
    earlier = F.coalesce(F.lag("now").over(inside), F.col("before"))
    steps = steps.withColumn("new", (~F.col("now").eqNullSafe(earlier)).cast("bigint")).drop("before", "now")
    sums = steps.groupBy("line", "b").agg(F.sum("new").alias("n"))
    sums = sums.select("line", "b", F.coalesce(F.sum("n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("so_far"))
    count = F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("so_far") - 1
    return steps.join(sums, ["line", "b"]).withColumn("piece", count.cast("bigint")).drop("new", "so_far", "b")


def pieces(tiled: DataFrame) -> DataFrame:
    """``(name, frag_start, hap_offset, piece, seq, tile, n_steps, bp)``: maximal runs of steps in one tile."""
    return tiled.groupBy("line", "name", F.col("start").alias("frag_start"), "piece", F.col("t_seq").alias("seq"), F.col("t_tile").alias("tile")).agg(
        F.min("offset").alias("hap_offset"), F.count("*").alias("n_steps"), F.sum("length").cast("bigint").alias("bp")
    ).select("name", "frag_start", "hap_offset", "piece", "seq", "tile", "n_steps", "bp")


def line_spans(offset: DataFrame) -> DataFrame:
    """``(line, name, start, bp)`` of each line, and ``covered``: the bp of its path's lines before it."""
    spans = offset.groupBy("line", "name", "start").agg(F.sum("length").cast("bigint").alias("bp"))
    before = Window.partitionBy("name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("covered", F.coalesce(F.sum("bp").over(before), F.lit(0)))


def departures(tiled: DataFrame, ref: str, gaps: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """Where a path leaves a reference sequence and comes back, in different pieces and not adjacent there.

    A path's lines count as one, in the order of their starts.  One row for
    each pair of its consecutive steps on one sequence.  ``gaps`` are the
    reference's holes, which count as nothing between two breakpoints.
    ``spans`` are ``line_spans`` of all lines, also of those with no step on the
    reference; with them ``missing_bp`` is the part of ``own_bp`` in no line.
    ``own_tiles`` are the tiles of the sequence that hold own steps: the
    leave's, where its piece goes on behind it, and the rejoin's, where its
    piece begins before it.
    """
    steps = tiled.where(sample(F.col("name")) != ref)
    if spans is None:
        spans = line_spans(steps)
    # Only the first and the last step of a piece on a sequence can end a departure: a row for each piece, not each step.
    against = F.col("rev") != F.col("ref_rev")
    end = F.struct("i", "offset", "length", "ref_offset", against.alias("against"), "passes", "t_tile")
    whole = steps.groupBy("line", "piece").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    each = steps.where(F.col("seq").isNotNull()).groupBy("line", "name", "start", "piece", "seq").agg(F.min(end).alias("first"), F.max(end).alias("final"))
    each = each.join(whole, ["line", "piece"]).join(spans.select("line", "bp", "covered"), "line")
    of = lambda e: F.struct(
        F.col("line"), F.col("start"), F.col("bp"), F.col("covered"), *(F.col(f"{e}.{c}").alias(c) for c in ("i", "offset", "length", "ref_offset", "against", "passes", "t_tile")),
        (F.col("hi") > F.col(f"{e}.i")).alias("goes_on"), (F.col("lo") < F.col(f"{e}.i")).alias("began"),
    )
    chain = Window.partitionBy("name", "seq").orderBy("start", "first.i")
    pairs = each.select("name", "seq", of("first").alias("to"), F.lag(of("final")).over(chain).alias("from")).where("from is not null")
    stop = lambda e, leave: F.when(F.col(f"{e}.against") == leave, F.col(f"{e}.ref_offset")).otherwise(F.col(f"{e}.ref_offset") + F.col(f"{e}.length"))
    # Between two lines: what lies between their ends, less the lines there.
    missing = F.when(
        F.col("from.line") != F.col("to.line"),
        F.col("to.start") - F.col("from.start") - F.col("from.bp") - (F.col("to.covered") - F.col("from.covered") - F.col("from.bp")),
    ).otherwise(0)
    tiles = F.array_distinct(F.concat(*[F.when(F.col(c), F.array(f"{e}.t_tile")).otherwise(F.expr("cast(array() as array<bigint>)")) for e, c in (("from", "from.goes_on"), ("to", "to.began"))]))
    rows = pairs.select(
        F.col("from.line").alias("line"), "name", "seq", (F.col("from.offset") + F.col("from.length")).alias("hap_start"),
        (F.col("to.offset") - F.col("from.offset") - F.col("from.length")).alias("own_bp"), missing.cast("bigint").alias("missing_bp"),
        stop("from", True).alias("leave_pos"), F.col("from.against").alias("leave_rev"), F.col("from.passes").alias("leave_passes"),
        stop("to", False).alias("rejoin_pos"), F.col("to.against").alias("rejoin_rev"), F.col("to.passes").alias("rejoin_passes"),
        F.least("from.ref_offset", "to.ref_offset").alias("start_pos"),
        F.greatest(F.col("from.ref_offset") + F.col("from.length"), F.col("to.ref_offset") + F.col("to.length")).alias("end_pos"),
        F.col("from.i").alias("leave_i"), F.col("to.i").alias("rejoin_i"), tiles.alias("own_tiles"),
    )
    return _unlike(rows, gaps)


def _unlike(rows: DataFrame, gaps: DataFrame | None) -> DataFrame:
    """Those whose ends are not adjacent, with their kind."""
    leave, rejoin = F.col("leave_pos"), F.col("rejoin_pos")
    if gaps is not None:
        # A position with the holes before it removed: the last hole that ends at or before it.
        ordered = gaps.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("end_pos", (F.col("before") + F.col("end_pos") - F.col("start_pos")).alias("upto")))).alias("gaps"))
        rows = rows.join(ordered, "seq", "left")
        passed = lambda p: F.coalesce(F.array_max(F.transform(F.filter("gaps", lambda g: g["end_pos"] <= p), lambda g: g["upto"])), F.lit(0))
        leave, rejoin = leave - passed(leave), rejoin - passed(rejoin)
    adjacent = (F.col("own_bp") == 0) & (F.col("leave_rev") == F.col("rejoin_rev")) & (leave == rejoin)
    kind = (
        F.when(F.col("leave_rev") != F.col("rejoin_rev"), "switch")
        .when(F.when(F.col("leave_rev"), rejoin > leave).otherwise(rejoin < leave), "back")
        .when(rejoin == leave, "own")
        .otherwise("forward")
    )
    return rows.where(~adjacent).withColumn("kind", kind).drop("gaps")


def filed_departures(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Departures under each block of their cover, so that a window reads a few equal keys, not a range."""
    block = F.explode(cover(F.col("start_pos"), F.col("end_pos"), tile)).alias("block")
    return rows.select("*", block).select("*", F.col("block.start").alias("block_start"), F.col("block.size").alias("block_size")).drop("block")


def departures_in(filed: DataFrame, seq: str, start: int, end: int, tile: int = TILE) -> DataFrame:
    """Departures that overlap a window: the blocks that can touch it, overlap, distinct."""
    from pangrove.operators.intervals import BLOCK_TILES

    touched = F.lit(False)
    for n in BLOCK_TILES:
        size = n * tile
        touched = touched | ((F.col("block_size") == size) & F.col("block_start").between(start // size * size, (end - 1) // size * size))
    hits = filed.where((F.col("seq") == seq) & touched & (F.col("start_pos") < end) & (F.col("end_pos") > start))
    return hits.drop("block_start", "block_size").distinct()


def binned_departures(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Departures each filed once: in the smallest size of bin that is no shorter, under the bin where it starts.

    Sizes grow by eights from a tile.  Where a cover files a departure under
    every block of it, which long ones have many of, this keeps one row.
    """
    long = F.col("end_pos") - F.col("start_pos")
    size = F.coalesce(*[F.when(long <= n, F.lit(n)) for n in _bins(tile)]).cast("bigint")
    return rows.withColumn("bin_size", size).withColumn("bin_start", F.col("start_pos") - F.col("start_pos") % F.col("bin_size"))


def _bins(tile: int) -> list[int]:
    sizes = [tile]
    while sizes[-1] <= MOST_BP:
        sizes.append(sizes[-1] * 8)
    return sizes


def binned_departures_in(binned: DataFrame, seq: str, start: int, end: int, tile: int = TILE) -> DataFrame:
    """Departures that overlap a window: of each size the bins that touch it, and the one before, whose departures can reach in."""
    touched = F.lit(False)
    for size in _bins(tile):
        touched = touched | ((F.col("bin_size") == size) & F.col("bin_start").between(start // size * size - size, (end - 1) // size * size))
    hits = binned.where((F.col("seq") == seq) & touched & (F.col("start_pos") < end) & (F.col("end_pos") > start))
    return hits.drop("bin_start", "bin_size").distinct()


def left_out(placed: DataFrame, ref: str) -> DataFrame:
    """Lines with no step on the reference."""
    return placed.groupBy("line", "name").agg(F.max(F.col("seq").isNotNull()).alias("on")).where("not on").select("name")


def walk_steps(graph: Graph, ref: str, tile: int = TILE, stay: int = 0, revisited: bool | None = None, check: bool = True) -> DataFrame:
    """The whole pipeline from a graph to tiled steps; refuses steps on unknown nodes and lines that collide."""
    offset = written(offset_steps(graph), "walk-offsets")  # what follows reads each of these several times
    if check:
        check_steps(offset)
    placed = written(place_steps(offset, ref, revisited), "walk-places")
    return tiled_steps(placed, ref, tile, stay)
