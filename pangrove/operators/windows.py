"""Reading a window of a reference: what paths do over it, where they leave it, and what to draw.

A window ``[start, end)`` with ``context`` on either side is the stretch that
every function here takes as ``(seq, lo, hi)``.  The tiles it reads are those
whose extent overlaps it, so a node longer than a tile is found from any tile
that it covers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pangrove.functions.names import sample
from pangrove.operators.encode import WHOLE, decode, decode_references, extents, expanded, rail, read_blocks
from pangrove.operators.walks import TILE, _unlike, departures_in


def stretch(start: int, end: int, context: int = 0) -> tuple[int, int]:
    return max(0, start - context), end + context


def tiles_over(tiled: DataFrame, ref: str, seq: str, lo: int, hi: int) -> DataFrame:
    """``(t_seq, t_tile)`` of the tiles whose extent overlaps the stretch."""
    hull = extents(rail(tiled.where(F.col("t_seq") == seq), ref))
    return hull.where((F.col("unit_start") < hi) & (F.col("unit_end") > lo)).select(F.col("seq").alias("t_seq"), F.col("tile").alias("t_tile"))


def steps_over(tiled: DataFrame, ref: str, seq: str, lo: int, hi: int) -> DataFrame:
    """All steps of the pieces in those tiles, with ``inside`` where they lie over the stretch."""
    near = tiled.where(F.col("t_seq") == seq).join(tiles_over(tiled, ref, seq, lo, hi), ["t_seq", "t_tile"], "left_semi")
    inside = (F.col("seq") == seq) & (F.col("ref_offset") < hi) & (F.col("ref_offset") + F.col("length") > lo)
    return near.withColumn("inside", F.coalesce(inside, F.lit(False)))


def _in_fragments(near: DataFrame) -> DataFrame:
    """Steps with their run of consecutive pieces, and the first and last of it that lie inside; others left out."""
    by_line = Window.partitionBy("line").orderBy("i")
    jump = F.coalesce(F.col("piece") - F.lag("piece").over(by_line) > 1, F.lit(True))
    near = near.withColumn("fragment", F.sum(jump.cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("line", "fragment")
    at = F.when(F.col("inside"), F.col("i"))
    return near.withColumns({"first": F.min(at).over(whole), "last": F.max(at).over(whole)}).where(F.col("first").isNotNull())


def _text(node: Column, rev: Column) -> Column:
    return F.concat(F.when(rev, "<").otherwise(">"), node.cast("string"))


def fragments(near: DataFrame) -> DataFrame:
    """What each line does over the stretch: ``(name, frag_start, hap_start, hap_end, bp_before, bp_after, steps)``.

    Consecutive pieces are one run, trimmed to its first and last step inside;
    the bp that it has before and after are told.
    """
    runs = _in_fragments(near)
    kept = F.col("i").between(F.col("first"), F.col("last"))
    bp = lambda c: F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0)).cast("bigint")
    step = F.concat(F.when(F.col("seq").eqNullSafe(F.col("t_seq")), F.concat(F.col("ref_offset").cast("string"), F.when(F.col("rev") != F.col("ref_rev"), "-").otherwise("+"))).otherwise(""), _text(F.col("node"), F.col("rev")))
    return runs.groupBy("line", "name", F.col("start").alias("frag_start"), "fragment").agg(
        F.min(F.when(kept, F.col("offset"))).alias("hap_start"), F.max(F.when(kept, F.col("offset") + F.col("length"))).alias("hap_end"),
        bp(F.col("i") < F.col("first")).alias("bp_before"), bp(F.col("i") > F.col("last")).alias("bp_after"),
        F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("i", step.alias("t"))))), lambda x: x["t"]).alias("steps"),
    ).select("name", "frag_start", "hap_start", "hap_end", "bp_before", "bp_after", F.array_join("steps", " ").alias("steps"))


def computed_departures(near: DataFrame, seq: str, lo: int, hi: int, gaps: DataFrame | None = None) -> DataFrame:
    """Departures inside a piece, which no record tells: between consecutive steps on the sequence that are not adjacent."""
    by_piece = Window.partitionBy("line", "piece").orderBy("i")
    against = F.col("rev") != F.col("ref_rev")
    end = F.struct("i", "offset", "length", "ref_offset", against.alias("against"), "passes")
    pairs = near.where(F.col("seq") == seq).select("line", "name", "seq", "piece", "i", end.alias("to")).withColumn("from", F.lag("to").over(by_piece)).where("from is not null")
    side = lambda e, leave: F.when(F.col(f"{e}.against") == leave, F.col(f"{e}.ref_offset")).otherwise(F.col(f"{e}.ref_offset") + F.col(f"{e}.length"))
    rows = pairs.select(
        "line", "name", "seq", "piece", (F.col("from.offset") + F.col("from.length")).alias("hap_start"), (F.col("to.offset") - F.col("from.offset") - F.col("from.length")).alias("own_bp"),
        side("from", True).alias("leave_pos"), F.col("from.against").alias("leave_rev"), F.col("from.passes").alias("leave_passes"),
        side("to", False).alias("rejoin_pos"), F.col("to.against").alias("rejoin_rev"), F.col("to.passes").alias("rejoin_passes"),
        F.least("from.ref_offset", "to.ref_offset").alias("start_pos"),
        F.greatest(F.col("from.ref_offset") + F.col("from.length"), F.col("to.ref_offset") + F.col("to.length")).alias("end_pos"),
        F.col("from.i").alias("leave_i"), F.col("to.i").alias("rejoin_i"),
    )
    return _unlike(rows.where((F.col("start_pos") < hi) & (F.col("end_pos") > lo)), gaps)


def _attached(rows: DataFrame, lo: int, hi: int, most: int) -> DataFrame:
    """Departures that leave or rejoin on the stretch with ``most`` bp of their own, at most."""
    leave = F.when(F.col("leave_rev"), F.col("leave_pos")).otherwise(F.col("leave_pos") - 1)
    rejoin = F.when(F.col("rejoin_rev"), F.col("rejoin_pos") - 1).otherwise(F.col("rejoin_pos"))
    over = lambda p: (p >= lo) & (p < hi)
    return rows.where((F.col("own_bp") <= most) & (over(leave) | over(rejoin)))


_OWN = ["name", "seq", "hap_start", "own_bp", "offset", "node", "rev", "length"]


def own_steps_of_records(tiled: DataFrame, records: DataFrame, lo: int, hi: int, most: int = TILE) -> DataFrame:
    """The own steps of departure records: the path's steps within its own stretch, in the tiles the record names."""
    asked = _attached(records, lo, hi, most).select("name", F.col("seq").alias("t_seq"), "hap_start", "own_bp", F.explode("own_tiles").alias("t_tile"))
    steps = tiled.drop("seq").join(asked, ["name", "t_seq", "t_tile"])
    within = (F.col("offset") >= F.col("hap_start")) & (F.col("offset") + F.col("length") <= F.col("hap_start") + F.col("own_bp"))
    return steps.where(within).withColumnRenamed("t_seq", "seq").select(_OWN)


def own_steps_computed(near: DataFrame, rows: DataFrame, lo: int, hi: int, most: int = TILE) -> DataFrame:
    """The own steps of computed departures: those of the piece between the two ends."""
    asked = _attached(rows, lo, hi, most).select("line", "piece", F.col("seq").alias("on"), "hap_start", "own_bp", "leave_i", "rejoin_i")
    steps = near.join(asked, ["line", "piece"]).where((F.col("i") > F.col("leave_i")) & (F.col("i") < F.col("rejoin_i")))
    return steps.drop("seq").withColumnRenamed("on", "seq").select(_OWN)


def own_runs(own: DataFrame) -> DataFrame:
    """Each departure's own steps as text: ``(name, seq, hap_start, own_bp, steps)``."""
    one = F.struct("offset", _text(F.col("node"), F.col("rev")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"])
    return own.distinct().groupBy("name", "seq", "hap_start", "own_bp").agg(F.array_join(ordered, "").alias("steps"))


def drawn_stretch(near: DataFrame, ref: str, seq: str, lo: int, hi: int) -> DataFrame:
    """One row ``(seq, start_pos, end_pos)``: the stretch widened to whole steps of the reference."""
    own = near.where((sample(F.col("name")) == ref) & F.col("inside"))
    return own.agg(F.least(F.lit(lo), F.min("ref_offset")).alias("start_pos"), F.greatest(F.lit(hi), F.max(F.col("ref_offset") + F.col("length"))).alias("end_pos")).select(
        F.lit(seq).alias("seq"), F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos")
    )


def _kept_steps(near: DataFrame) -> DataFrame:
    return _in_fragments(near).where(F.col("i").between(F.col("first"), F.col("last")))


def drawn_nodes(near: DataFrame, own: list[DataFrame], tiled: DataFrame, ref: str, seq: str, lo: int, hi: int) -> DataFrame:
    """Where to draw each node: ``(node, seq, start_pos, end_pos, rank, passes, rev)``.

    A node of the reference takes its pass over the stretch, the earliest of
    several, else its earliest in the tiles read (own steps' tiles are read
    too); any other node the first place that a fragment or own steps hold it,
    by name, then offset.
    """
    steps = _kept_steps(near).select("name", "offset", "node", "length")
    for more in own:
        steps = steps.unionByName(more.select("name", "offset", "node", "length"))
    first = steps.groupBy("node").agg(F.min(F.struct("name", "offset", "length")).alias("v"))
    more = [o.select("node").distinct() for o in own]
    reads = near.select("t_seq", "t_tile").distinct()
    passes = tiled.where((F.col("t_seq") == seq) & (sample(F.col("name")) == ref)).select("t_seq", "t_tile", "node", "ref_offset", "length", "passes", "rev")
    if more:
        wanted = reduce(DataFrame.union, more).distinct()
        holding = tiled.where(F.col("t_seq") == seq).join(wanted, "node", "left_semi").select("t_seq", "t_tile").distinct()
        reads = reads.union(holding).distinct()
    passes = passes.join(reads, ["t_seq", "t_tile"], "left_semi")
    end = F.col("ref_offset") + F.col("length")
    over = (F.col("ref_offset") < hi) & (end > lo)
    best = passes.groupBy("node").agg(
        F.min(F.struct((~over).alias("away"), F.col("ref_offset").alias("a"), end.alias("b"), F.col("passes").alias("n"), F.col("rev").alias("r"))).alias("p")
    )
    both = first.join(best, "node", "full_outer").where(F.col("v").isNotNull() | ~F.col("p.away"))
    at = lambda there, here: F.when(F.col("p").isNotNull(), there).otherwise(here)
    return both.select(
        "node", at(F.lit(seq), F.col("v.name")).alias("seq"), at(F.col("p.a"), F.col("v.offset")).cast("bigint").alias("start_pos"),
        at(F.col("p.b"), F.col("v.offset") + F.col("v.length")).cast("bigint").alias("end_pos"), F.col("p").isNull().cast("bigint").alias("rank"),
        F.coalesce("p.n", F.lit(0)).cast("bigint").alias("passes"), F.coalesce("p.r", F.lit(False)).alias("rev"),
    )


def taken_links(near: DataFrame) -> DataFrame:
    """Links between consecutive steps of the fragments, each once, the way round with more forward ends.

    On a tie the one whose first handle is less.
    """
    steps = _kept_steps(near)
    along = Window.partitionBy("line", "fragment").orderBy("i")
    id_ = F.col("node").cast("bigint")  # of two ways the lesser number comes first
    pairs = steps.select(id_.alias("a"), F.col("rev").alias("ar"), F.lead(id_).over(along).alias("b"), F.lead("rev").over(along).alias("br")).where("b is not null")
    way = lambda a, ar, b, br: F.struct((ar.cast("int") + br.cast("int")).alias("back"), a.alias("src"), ar.alias("src_rev"), b.alias("tgt"), br.alias("tgt_rev"))
    a, ar, b, br = (F.col(c) for c in ("a", "ar", "b", "br"))
    return pairs.select(F.least(way(a, ar, b, br), way(b, ~br, a, ~ar)).alias("l")).select("l.src", "l.src_rev", "l.tgt", "l.tgt_rev").distinct()


def node_sets(near: DataFrame, index_nodes: DataFrame) -> DataFrame:
    """Nodes that only the walks, or only the index, have over a window: ``(node, in_walks, in_index)``."""
    w = _kept_steps(near).select("node").distinct().withColumn("w", F.lit(True))
    i = index_nodes.select("node").distinct().withColumn("x", F.lit(True))
    both = w.join(i, "node", "full_outer")
    return both.select("node", F.col("w").isNotNull().alias("in_walks"), F.col("x").isNotNull().alias("in_index")).where("in_walks <> in_index")


def read_rows(rows: DataFrame, seq: str, lo: int, hi: int, expand: DataFrame | None = None) -> DataFrame:
    """Pieces of a window out of printed rows, as items in path order.

    ``(path, frag_start, piece, hap_offset, k, node, rev, length, ref_offset, until)``: a
    step has a node; of a piece that its tile abridged and whose path is not in
    ``expand(path)``, an item is a stretch of the reference (``ref_offset`` to
    ``until``) or a run of bp whose nodes are not read.  Only tiles whose
    reference overlaps the stretch are decoded, and only those records of them
    that are asked for.
    """
    c = lambda k: F.col("c")[k].cast("bigint")
    rows = rows.where(F.col("seq") == seq)
    tiles = rows.where("kind = 'ref'").withColumn("c", F.split("line", "\t")).where((c(1) < hi) & (c(2) > lo)).select("seq", "tile").distinct()
    rows = rows.join(tiles, ["seq", "tile"], "left_semi")
    wide = expanded(rows)
    if expand is None:
        units = rows.where(F.col("unit") == WHOLE)
        closed = wide
    else:
        asked = wide.join(expand, "path", "left_semi").select("seq", "tile", F.col("detail").alias("unit")).distinct()
        units = rows.where(F.col("unit") == WHOLE).unionByName(rows.join(asked, ["seq", "tile", "unit"], "left_semi"))
        closed = wide.join(expand, "path", "left_anti")
    steps = decode(units).unionByName(decode_references(units))
    steps = steps.select("path", "frag_start", "piece", "hap_offset", "k", "node", "rev", "length", "ref_offset", F.when(F.col("ref_offset").isNotNull(), F.col("ref_offset") + F.col("length")).alias("until"))
    key = ["seq", "tile", "path", "frag_start", "piece"]
    starts = rows.where("kind = 'abridged'").withColumn("c", F.split("line", "\t")).select("seq", "tile", F.col("c")[4].alias("path"), c(5).alias("frag_start"), c(7).alias("piece"), c(6).alias("hap_offset"))
    runs = read_blocks(rows).join(closed.select(key), key, "left_semi").join(starts, key)
    runs = runs.select(
        "path", "frag_start", "piece", "hap_offset", F.col("item").alias("k"), F.lit(None).cast("bigint").alias("node"), F.col("against").alias("rev"),
        F.col("bp").alias("length"), F.col("lo").alias("ref_offset"), F.col("hi").alias("until"),
    )
    return steps.unionByName(runs)


def window(tiled: DataFrame, filed: DataFrame, ref: str, seq: str, start: int, end: int, context: int = 0, attach: int = TILE, tile: int = TILE, gaps: DataFrame | None = None) -> dict[str, DataFrame]:
    """All that a cut over a window returns: fragments, records, computed departures, own steps, nodes, links, the drawn stretch.

    ``filed`` are departures under their blocks, from ``filed_departures``.
    """
    lo, hi = stretch(start, end, context)
    near = steps_over(tiled, ref, seq, lo, hi)
    records = departures_in(filed, seq, lo, hi, tile)
    computed = computed_departures(near, seq, lo, hi, gaps)
    own = [own_steps_of_records(tiled, records, lo, hi, attach), own_steps_computed(near, computed, lo, hi, attach)]
    return {
        "fragments": fragments(near), "records": records, "computed": computed, "own": own_runs(own[0].unionByName(own[1])),
        "nodes": drawn_nodes(near, own, tiled, ref, seq, lo, hi), "links": taken_links(near), "drawn": drawn_stretch(near, ref, seq, lo, hi),
    }
