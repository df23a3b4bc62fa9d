"""Leaf text, summaries and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rules import clip, clipped
from ..sources.scratch import cut
from . import mapping, tree
from .folds import folded
from .requests import Answers


def add_node_text(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """K3: nodes with text: the pages of a leaf in order, empty if its end is before its start; null for inner nodes and null ranges.

    Nodes go to the pages' text with all their columns, so the text moves once.
    """
    nodes = nodes.drop("text")
    has_text = F.col("is_leaf") & F.col("start_index").isNotNull() & F.col("end_index").isNotNull()
    leaves = mapping.with_range_text(nodes.filter(has_text), pages, ["doc_id", "node_seq"])
    return leaves.unionByName(nodes.filter(~F.coalesce(has_text, F.lit(False))).withColumn("text", F.lit(None).cast("string")))


def _summed(child_chars: int):
    """Summaries from each document's last node to its first: children come before their parent, which takes theirs."""

    def fold(batches):
        doc, open_nodes = object(), {}
        for ids, seqs, parents, titles, given in batches:
            out = []
            for i, seq, parent, title, summary in zip(ids, seqs, parents, titles, given):
                if i != doc:
                    doc, open_nodes = i, {}
                kids = open_nodes.pop(seq, ())
                if summary is None:
                    summary = "; ".join(reversed(kids)) if kids else ""
                out.append(summary)
                if parent is not None and title is not None:
                    open_nodes.setdefault(parent, []).append(f"{title}: {clipped(summary, child_chars)}" if summary else title)
            yield (out,)

    fold.reads = ["doc_id", "node_seq", "parent_seq", "title", "_given"]
    return fold


def _asked_level_by_level(nodes: DataFrame, leaf_chars: int, child_chars: int, answers: Answers) -> DataFrame:
    """(doc_id, node_seq, summary): what `summarize` finds where a model may answer for each node; as many rounds as there are levels."""
    depth = nodes.agg(F.max("depth")).first()[0]
    columns = ["doc_id", "node_seq", "parent_seq", "depth", "title", "summary"]
    whole = nodes.withColumn("summary", F.when(F.col("is_leaf"), clip("text", leaf_chars)))
    leaves = answers.apply("summary", whole.filter("is_leaf and text <> ''"), ["node_seq"], summary="text")
    narrow = cut(leaves.unionByName(whole.filter("not coalesce(is_leaf and text <> '', false)")).select(*columns))
    done = narrow.filter("summary is not null")
    for level in range((depth or 0) - 1, -1, -1):
        kids = tree.child_summaries(done.filter(F.col("depth") == level + 1))
        line = lambda k: F.when(k["summary"] == "", k["title"]).otherwise(F.concat(k["title"], F.lit(": "), clip(k["summary"], child_chars)))
        own = narrow.filter((F.col("depth") == level) & F.col("summary").isNull()).drop("summary").join(kids, ["doc_id", "node_seq"])
        made = own.select(*columns[:-1], F.array_join(F.transform("children", line), "; ").alias("summary"))
        made = answers.apply("summary", made.withColumn("text", F.col("summary")), ["node_seq"], summary="text").select(*columns)
        done = done.unionByName(cut(made))
    return done.select("doc_id", "node_seq", "summary")


def summarize(nodes: DataFrame, leaf_chars: int = 200, child_chars: int = 80, answers: Answers | None = None, keep_text: bool = True) -> DataFrame:
    """K5: nodes with summary; text is needed, and stays if keep_text.

    R7: a leaf's is its first leaf_chars characters to a word's end; a parent's is its children's titles, each
    with its clipped summary. Without text and children it is empty. Rules take one pass over each document's
    nodes, from the last to the first, whatever their depth; texts are clipped before that and do not move. Only
    where a model may answer there is a round for each level, as its questions depend on its answers.
    """
    nodes = nodes.drop("summary")
    if answers is not None:
        done = _asked_level_by_level(nodes, leaf_chars, child_chars, answers)
    else:
        given = nodes.withColumn("_given", F.when(F.col("is_leaf"), clip("text", leaf_chars)))
        narrow = given.select("doc_id", "node_seq", "parent_seq", "title", "_given") if keep_text else given.drop("text")
        done = folded(narrow, [F.col("node_seq").desc()], _summed(child_chars), [("summary", "string")]).drop("_given")
        if not keep_text:
            return done
    out = nodes.join(done.select("doc_id", "node_seq", "summary"), ["doc_id", "node_seq"], "left").withColumn("summary", F.coalesce("summary", F.lit("")))
    return out if keep_text else out.drop("text")


def describe_documents(nodes: DataFrame, chars: int = 300, answers: Answers | None = None) -> DataFrame:
    """K6: (doc_id, doc_description): the titles of a document's roots in order, clipped; for nodes with summaries."""
    roots = nodes.filter("depth = 0 and summary is not null")
    titles = F.sort_array(F.collect_list(F.struct("node_seq", "title")))
    made = roots.groupBy("doc_id").agg(F.array_join(titles["title"], "; ").alias("text"))
    made = made.withColumn("doc_description", clip("text", chars))
    if answers is not None:
        made = answers.apply("description", made, doc_description="text")
    return made.select("doc_id", "doc_description")
