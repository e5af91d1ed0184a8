"""Metadata, objects and reachability of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quirecheck.sources.checkpoints import checkpointed
from quirecheck.operators.unions import union_all

# Actions worth reporting, file infrastructure, and marks of a resource kind.
SUSPICIOUS = ["JavaScript", "Launch", "URI", "SubmitForm", "ImportData", "GoToR"]
INFRASTRUCTURE = ["ObjStm", "XRef"]
RESOURCE_MARKS = ["Font", "/Image", "XObject", "/Form"]
#: Levels that are searched one by one before chains are contracted.
SHALLOW = 4


def metadata(meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One column per wanted key, '' where a document does not have it."""
    wanted = [F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit("")).alias(k.lower()) for k in keys]
    return meta.groupBy("doc_id").agg(*wanted)


def metadata_entries(meta: DataFrame) -> DataFrame:
    """Non-empty entries as ``key: value``, in order."""
    entry = F.struct("pos", F.concat_ws(": ", "key", "value").alias("entry"))
    ordered = F.sort_array(F.collect_list(F.when(F.col("value") != "", entry)))
    return meta.groupBy("doc_id").agg(F.transform(ordered, lambda e: e["entry"]).alias("entries"))


def is_bloated(size: Column, pages: Column, limit_kb: int = 1024) -> Column:
    """Whole kilobytes per page above the limit; a document counts as one page at least."""
    kilobytes = F.floor(size / 1024)
    return F.floor(kilobytes / F.greatest(pages, F.lit(1))) > limit_kb


def labelled(objects: DataFrame) -> DataFrame:
    return objects.withColumn("label", F.concat_ws(": ", F.col("obj_id").cast("string"), F.col("kind")))


def object_sizes(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Size of each wanted object (doc_id, obj_id), or a message where the document has no such object."""
    found = wanted.join(objects.select("doc_id", "obj_id", "size"), ["doc_id", "obj_id"], "left")
    missing = F.concat(F.lit("object "), F.col("obj_id").cast("string"), F.lit(" does not exist"))
    return found.withColumn("error", F.when(F.col("size").isNull(), missing))


def _followed(pointers: DataFrame) -> DataFrame:
    """(doc_id, node, anchor): pointers followed to the first node that has none itself.

    Every round doubles the length of the steps. Nodes whose pointers lead into a cycle have no end: they
    come back with a null anchor.
    """
    pointers = checkpointed(pointers)
    count, steps = pointers.count(), 1
    while steps <= count:
        onward = pointers.select("doc_id", F.col("node").alias("anchor"), F.col("anchor").alias("_next"))
        pointers = checkpointed(
            pointers.join(onward, ["doc_id", "anchor"], "left").select(
                "doc_id", "node", F.coalesce("_next", "anchor").alias("anchor"), F.col("_next").isNotNull().alias("moved")
            )
        )
        steps *= 2
        ended = pointers.filter("moved").isEmpty()
        pointers = pointers.drop("moved")
        if ended:
            return pointers
    inside = pointers.select("doc_id", F.col("node").alias("anchor"), F.lit(True).alias("_inside"))
    outside = F.when(F.col("_inside").isNull(), F.col("anchor"))
    return checkpointed(pointers.join(inside, ["doc_id", "anchor"], "left").select("doc_id", "node", outside.alias("anchor")))


def _contracted(edges: DataFrame, pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (doc_id, node, anchor) of the nodes with one way in, and the edges among the other nodes."""
    links = _followed(pointers)
    inner = links.select("doc_id", F.col("node").alias("src"), "anchor", F.lit(True).alias("_linked"))
    rest = (
        edges.join(links.select("doc_id", F.col("node").alias("dst")), ["doc_id", "dst"], "left_anti")
        .join(inner, ["doc_id", "src"], "left")
        .filter("_linked is null or anchor is not null")
        .select("doc_id", F.coalesce("anchor", "src").alias("src"), "dst")
        .filter("src <> dst")
        .distinct()
    )
    return links, checkpointed(rest)


def _frontiers(edges: DataFrame, roots: DataFrame, compact_every: int, most: float = float("inf")) -> tuple[DataFrame, bool]:
    """Breadth first: each round joins the newest nodes to the edges and keeps what was not seen.

    What was found within ``most`` rounds, and whether that is all.
    """
    seen = frontier = roots
    rounds = 0
    while not frontier.isEmpty():
        if rounds >= most:
            return seen, False
        step = edges.join(frontier.withColumnRenamed("node", "src"), ["doc_id", "src"], "left_semi")
        found = step.select("doc_id", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(found.join(seen, ["doc_id", "node"], "left_anti"))
        seen = union_all(seen, frontier)
        rounds += 1
        if rounds % compact_every == 0:
            seen = checkpointed(seen)
    return seen, True


def reachable(edges: DataFrame, roots: DataFrame, compact_every: int = 8) -> DataFrame:
    """Nodes (doc_id, node) reachable from ``roots`` over ``edges`` (doc_id, src, dst); roots are reachable.

    The first SHALLOW levels are searched breadth first, which ends most graphs. In deeper ones a node with one way in is reachable where the node before it is. Such nodes point there, pointers are
    followed in steps that double, and the nodes leave the graph, so a chain of any length costs rounds by
    the logarithm of its length. Nodes that then have one way in left, such as the ends of diamonds, go the
    same way, as long as that takes a tenth of the edges. What remains is searched breadth first. Every round is
    checkpointed. Cycles and edges that occur twice are allowed; edges with a null end lead nowhere.
    """
    roots = checkpointed(roots.select("doc_id", "node").filter("node is not null").distinct())
    edges = edges.select("doc_id", "src", "dst").filter("src <> dst")
    seen, all_found = _frontiers(edges, roots, compact_every, SHALLOW)
    if all_found:
        return seen
    roots = checkpointed(seen)
    edges = checkpointed(edges.join(roots.withColumnRenamed("node", "dst"), ["doc_id", "dst"], "left_anti"))
    links, left = [], edges.count()
    while left:
        ways = edges.groupBy("doc_id", "dst").agg(F.min("src").alias("anchor"), F.max("src").alias("_last"))
        pointers = ways.filter("anchor = _last").select("doc_id", F.col("dst").alias("node"), "anchor")
        found, edges = _contracted(edges, pointers)
        links.append(found)
        before, left = left, edges.count()
        if left * 10 > before * 9:
            break
    reached = _frontiers(edges, roots, compact_every)[0] if left else roots
    for found in reversed(links):
        within = found.join(reached.withColumnRenamed("node", "anchor"), ["doc_id", "anchor"], "left_semi")
        reached = union_all(reached, within.select("doc_id", "node"))
    return reached


def unreferenced(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Objects no root reaches, file infrastructure aside."""
    rest = objects.join(reachable(edges, roots), ["doc_id", "node"], "left_anti")
    return labelled(rest.filter(~F.col("kind").isin(INFRASTRUCTURE)))


def orphaned(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Unreferenced objects that are fonts, images or forms."""
    resource = F.lit(False)
    for mark in RESOURCE_MARKS:
        resource = resource | F.contains("kind", F.lit(mark))
    return unreferenced(objects, edges, roots).filter(resource)


def active_content(objects: DataFrame) -> DataFrame:
    """Per document: is there JavaScript, and which suspicious kinds of action occur."""
    return objects.groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("action") == "JavaScript"), F.lit(False)).alias("has_javascript"),
        F.sort_array(F.collect_set(F.when(F.col("action").isin(SUSPICIOUS), F.col("action")))).alias("actions"),
    )


def suspicious_actions(objects: DataFrame) -> DataFrame:
    """Distinct ``action (object n)`` entries, one row each."""
    hits = objects.filter(F.col("action").isin(SUSPICIOUS)).select("doc_id", "action", "obj_id").distinct()
    entry = F.concat("action", F.lit(" (object "), F.col("obj_id").cast("string"), F.lit(")"))
    return hits.select("doc_id", entry.alias("entry"))


def security_flags(objects: DataFrame) -> DataFrame:
    """Encryption, free permissions (its negation), and presence of signature fields."""
    encrypted = F.coalesce(F.bool_or("encrypted"), F.lit(False))
    return objects.groupBy("doc_id").agg(
        encrypted.alias("encrypted"),
        (~encrypted).alias("unrestricted"),
        F.coalesce(F.bool_or(F.col("ft") == "Sig"), F.lit(False)).alias("has_signature_fields"),
    )
