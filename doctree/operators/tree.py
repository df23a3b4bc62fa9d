"""Items to trees: prefaces, page ranges, parents, paths, ids; trees as JSON and back."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .folds import folded



def add_preface(items: DataFrame) -> DataFrame:
    """An item "Preface" (structure 0, page 1) before the items of documents whose first one starts after page 1."""
    first = items.groupBy("doc_id").agg(F.min_by("physical_index", "pos").alias("_f")).filter("_f > 1")
    extra = first.select("doc_id", F.lit(-1).alias("pos"), F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).alias("physical_index"))
    both = items.unionByName(extra, allowMissingColumns=True)
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return both.withColumn("pos", pos)


def assign_ranges(items: DataFrame, ends: DataFrame) -> DataFrame:
    """Items with start_index and end_index; ends has (doc_id, end_page).

    A section ends where the next one starts, or a page before if that opens its page; the last one at
    end_page. An end before the start stays: the section has no page of its own.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    index, opens = F.lead("physical_index").over(w), F.coalesce(F.lead("appear_start").over(w), F.lit(False))
    last = F.lead("pos").over(w).isNull()
    out = items.withColumns({"start_index": F.col("physical_index"), "_end": F.when(opens, index - 1).otherwise(index), "_last": last})
    out = out.join(ends.select("doc_id", "end_page"), "doc_id")
    return out.withColumn("end_index", F.when(F.col("_last"), F.col("end_page")).otherwise(F.col("_end")).cast("int")).drop("_end", "_last", "end_page")


def _by_codes(repair_gaps: bool):
    """Parents, paths and depths from codes, in list order: each code's latest item is what an item below it hangs on."""

    def fold(batches):
        doc, latest = object(), {}
        for ids, places, codes in batches:
            parents, paths = [], []
            for i, pos, code in zip(ids, places, codes):
                if i != doc:
                    doc, latest = i, {}
                up, found = (code or "").rpartition(".")[0], None
                while up and (found := latest.get(up)) is None and repair_gaps:
                    up = up.rpartition(".")[0]
                path = [*found, pos] if found else [pos]
                parents.append(found[-1] if found else None)
                paths.append(path)
                if code is not None:
                    latest[code] = path
            yield parents, paths, [len(p) - 1 for p in paths]

    fold.reads = ["doc_id", "pos", "structure"]
    return fold


def _by_links(batches):
    """Paths and depths from parent_pos, in list order."""
    doc, known = object(), {}
    for ids, places, parents in batches:
        paths = []
        for i, pos, up in zip(ids, places, parents):
            if i != doc:
                doc, known = i, {}
            known[pos] = path = [*known[up], pos] if up is not None else [pos]
            paths.append(path)
        yield paths, [len(p) - 1 for p in paths]


_by_links.reads = ["doc_id", "pos", "parent_pos"]


def _pos_kind(items: DataFrame) -> str:
    return items.schema["pos"].dataType.simpleString()


def resolve_parents(items: DataFrame, repair_gaps: bool = False) -> DataFrame:
    """Items with parent_pos: the latest earlier item whose code is the parent code; null for roots.

    With repair_gaps, a missing parent is replaced by the nearest ancestor that exists.
    """
    return build_tree(items, repair_gaps).drop("path", "depth")


def node_paths(items: DataFrame) -> DataFrame:
    """Items with path (positions from the root to the item) and depth (0 for roots), from parent_pos; parents stand before their children."""
    return folded(items, ["pos"], _by_links, [("path", f"array<{_pos_kind(items)}>"), ("depth", "int")])


def build_tree(items: DataFrame, repair_gaps: bool = False) -> DataFrame:
    """K1: J4 and W10 on a flat list, for trees of any depth: items with parent_pos, path and depth.

    One pass over each document's items in list order; what it keeps is the path of the latest item of each code.
    """
    kind = _pos_kind(items)
    return folded(items, ["pos"], _by_codes(repair_gaps), [("parent_pos", kind), ("path", f"array<{kind}>"), ("depth", "int")])


def _in_preorder(batches):
    """node_seq, node_id, parent_seq and is_leaf of nodes in the order of their paths; it keeps the way from the root and looks one batch ahead."""
    doc, seq, way = object(), 0, []
    batches = iter(batches)
    batch = next(batches, None)
    while batch is not None:
        ahead = next(batches, None)
        ids, paths = batch
        numbers, parents, leaves = [], [], []
        for k, (i, path) in enumerate(zip(ids, paths)):
            if i != doc:
                doc, seq, way = i, 0, []
            while way and way[-1][0] != path[: len(way[-1][0])]:
                way.pop()
            parents.append(way[-1][1] if way and len(way[-1][0]) == len(path) - 1 else None)
            way.append((path, seq))
            numbers.append(seq)
            seq += 1
            # In depth-first order a node is a leaf unless the next one is deeper.
            after = (ids[k + 1], paths[k + 1]) if k + 1 < len(ids) else (ahead[0][0], ahead[1][0]) if ahead and ahead[0] else None
            leaves.append(not (after is not None and after[0] == i and len(after[1]) > len(path)))
        yield numbers, [f"{n:04d}" for n in numbers], parents, leaves
        batch = ahead


_in_preorder.reads = ["doc_id", "path"]


def write_node_ids(nodes: DataFrame) -> DataFrame:
    """node_seq from 0 in depth-first order of path, and node_id with four digits at least; is_leaf and parent_seq too.

    One pass over each document's nodes in the order of their paths, with the way from the root in memory.
    """
    return folded(nodes, ["path"], _in_preorder, [("node_seq", "int"), ("node_id", "string"), ("parent_seq", "int"), ("is_leaf", "boolean")])


def max_end_index(nodes: DataFrame) -> DataFrame:
    """A5: (doc_id, page_count): the largest end_index of a document's tree, 0 if it has none."""
    return nodes.groupBy("doc_id").agg(F.coalesce(F.max("end_index"), F.lit(0)).alias("page_count"))


def child_summaries(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_seq, children): title and summary of each node's children, in order."""
    kids = F.sort_array(F.collect_list(F.struct(F.col("node_seq").alias("seq"), "title", F.coalesce("summary", F.lit("")).alias("summary"))))
    return nodes.filter("parent_seq is not null").groupBy("doc_id", F.col("parent_seq").alias("node_seq")).agg(kids.alias("children"))


def nodes_by_depth(nodes: DataFrame) -> DataFrame:
    """(doc_id, depth, n_nodes)."""
    return nodes.groupBy("doc_id", "depth").agg(F.count("*").alias("n_nodes"))


def strip_text(nodes: DataFrame) -> DataFrame:
    """Nodes without text."""
    return nodes.drop("text")


def description_fields(nodes: DataFrame) -> DataFrame:
    """What a description is made of."""
    return nodes.select("doc_id", "node_seq", "parent_seq", "title", "node_id", "summary")


_KEYS = ("title", "node_id", "start_index", "end_index", "summary", "text")


def _nested(rows: list[dict]) -> list[dict]:
    """Nested nodes from rows in depth-first order."""
    made: dict[int, dict] = {}
    roots: list[dict] = []
    for row in rows:
        node = {k: row[k] for k in _KEYS if row.get(k) is not None}
        made[row["node_seq"]] = node
        parent = row["parent_seq"]
        (roots if parent is None else made[parent].setdefault("nodes", [])).append(node)
    return roots


def export_tree(nodes: DataFrame) -> DataFrame:
    """K4: (doc_id, structure_json): each document's tree as nested JSON.

    Keys stand as title, node_id, start_index, end_index, summary, text, nodes; absent values and empty lists
    are left out. A document's nodes are one row, as its tree is one value; leave page text out with `strip_text`.
    """
    columns = ["node_seq", "parent_seq", *[c for c in _KEYS if c in nodes.columns]]

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                rows = batch.slice(low, 64)
                trees = [json.dumps(_nested(x), ensure_ascii=False) for x in rows.column("rows").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(trees, pa.string())], names=["doc_id", "structure_json"])

    rows = nodes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    return rows.mapInArrow(run, "doc_id string, structure_json string")


_FLAT = "doc_id string, node_seq int, parent_seq int, depth int, path array<int>, title string, node_id string, start_index int, end_index int, is_leaf boolean, summary string, text string"


def flatten_tree(index_docs: DataFrame) -> DataFrame:
    """K2: nodes from (doc_id, structure_json), in depth-first order; JSON that does not parse has none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["structure_json"]):
                try:
                    roots = json.loads(text)
                except (TypeError, ValueError):
                    continue
                seq = 0
                stack = [(n, None, (i,)) for i, n in reversed(list(enumerate(roots if isinstance(roots, list) else [roots])))]
                while stack:
                    node, parent, path = stack.pop()
                    kids = node.get("nodes") or []
                    rows.append((doc, seq, parent, len(path) - 1, list(path), node.get("title"), node.get("node_id"), node.get("start_index"), node.get("end_index"), not kids, node.get("summary"), node.get("text")))
                    stack += [(k, seq, (*path, i)) for i, k in reversed(list(enumerate(kids)))]
                    seq += 1
            names = [f.split(" ")[0] for f in _FLAT.split(", ")]
            out = pd.DataFrame(rows, columns=names)
            for c in ("node_seq", "parent_seq", "depth", "start_index", "end_index"):
                out[c] = out[c].astype("Int32")
            yield out

    return index_docs.select("doc_id", "structure_json").mapInPandas(run, _FLAT)
