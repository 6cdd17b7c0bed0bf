"""The bundle: fine index, contig layout and coarse tier of one graph, with a manifest."""

from __future__ import annotations

import json

from pangrove.graph import Graph
from pangrove.operators import fold, index, place
from pangrove.plans.storage import checkpointed

TIER_BELOW = {True: 10_000, False: 50}  # tagged graphs, plain graphs


def default_prefix(path: str) -> str:
    """A file's name less its folders and its ``.gfa`` or ``.gfa.gz``."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    for ending in (".gz", ".gfa"):
        name = name.removesuffix(ending)
    return name


def build(graph: Graph, out: str, reference: str | None = None, below: int | None = None, max_component: int | None = index.MAX_COMPONENT) -> dict:
    """Write the tables of one graph below ``out`` as sorted Parquet; returns the manifest.

    Placed nodes and turned links are made once and feed all writers; the tier
    is the folded graph, placed from its own tags and filed in the same way.
    """
    graph, placed = place.place(graph, reference)
    placed.nodes = checkpointed(placed.nodes)
    graph.links = checkpointed(graph.links)
    below = TIER_BELOW[placed.from_tags] if below is None else below
    tables = {}

    def write(name: str, g: Graph, p: place.Placed, layout: str) -> None:
        spans = index.by_contig(p) if layout == "contig" else index.anchored(g, p, max_component)
        for kind, rows in (("nodes", index.node_rows(p, spans)), ("links", index.link_rows(g, p, spans, layout))):
            tables[f"{name}_{kind}"] = f"{out}/{name}_{kind}"
            index.save(rows, tables[f"{name}_{kind}"])

    write("fine", graph, placed, "anchored")
    write("contig", graph, placed, "contig")
    coarse = fold.fold(graph, placed, below)
    coarse.segments, coarse.links = checkpointed(coarse.segments), checkpointed(coarse.links)
    write("tier", coarse, place.from_tags(coarse), "anchored")
    return {"coordinates": "tags" if placed.from_tags else "paths", "references": placed.references, "notes": placed.notes, "tierBelow": below, "maxComponent": max_component, "tables": tables}


def manifest_text(manifest: dict) -> str:
    return json.dumps(manifest, indent=2, ensure_ascii=True) + "\n"


def tier_for(bp_per_pixel: float, below: int) -> bool:
    """Whether the coarse tier serves a view: variants under ``below`` bp are under ten pixels."""
    return bp_per_pixel >= below / 10
