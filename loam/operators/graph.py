"""Property graph and wiki links: traversal, statistics, similarity, orphans and link suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import bigrams_of, links
from loam.session import cut


def edges_view(edges: DataFrame) -> DataFrame:
    """Edges with trimmed lower-case ends and relation, and ``entity`` for a null type; blank ends are skipped."""
    clean = lambda c: F.lower(F.trim(F.col(c)))
    rows = edges.select("id", clean("from_id").alias("from_id"), clean("relation").alias("relation"), clean("to_id").alias("to_id"), F.coalesce("graph_type", F.lit("entity")).alias("graph_type"))
    return rows.where("from_id != '' and to_id != ''")


def walk(edges: DataFrame, seed: str, hops: int) -> DataFrame:
    """``from_id, relation, to_id, depth``: every edge that leaves a node when it is first reached, breadth first.

    Each hop joins the frontier (one row per node) with the edges, so adaptive execution can split a hub.
    """
    out, spark = None, edges.sparkSession
    frontier = spark.createDataFrame([(seed,)], "from_id string")
    seen = frontier
    for depth in range(1, hops + 1):
        step = edges.join(frontier, "from_id").select("from_id", "relation", "to_id", F.lit(depth).alias("depth")).distinct()
        out = step if out is None else out.unionByName(step)
        if depth < hops:
            frontier = cut(step.select(F.col("to_id").alias("from_id")).distinct().join(seen, "from_id", "left_anti"))
            seen = seen.unionByName(frontier)
    return out


def reachable(edges: DataFrame, seed: str, hops: int) -> DataFrame:
    """``node, depth`` of the nodes reached from ``seed`` within ``hops``, with their least depth."""
    return walk(edges, seed, hops).groupBy(F.col("to_id").alias("node")).agg(F.min("depth").alias("depth")).where(F.col("node") != seed)


def causal_edges(edges: DataFrame, direction: str = "backward") -> DataFrame:
    """Causal edges to follow: backward along ``caused_by``; forward along ``resulted_in`` and reversed ``caused_by``."""
    causal = edges.where("graph_type = 'causal'")
    back = causal.where("relation = 'caused_by'").select("from_id", "relation", "to_id")
    if direction == "backward":
        return back
    turned = back.select(F.col("to_id").alias("from_id"), F.lit("resulted_in").alias("relation"), F.col("from_id").alias("to_id"))
    return causal.where("relation = 'resulted_in'").select("from_id", "relation", "to_id").unionByName(turned)


def stats(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """``kind, name, n``: nodes by type and the most frequent relations."""
    kinds = nodes.groupBy(F.coalesce("node_type", F.lit("unknown")).alias("name")).agg(F.countDistinct("id").alias("n"))
    relations = edges.groupBy(F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(top)
    return kinds.select(F.lit("node_type").alias("kind"), "name", "n").unionByName(relations.select(F.lit("relation").alias("kind"), "name", "n"))


def hub_edges(edges: DataFrame, hubs: int = 20) -> DataFrame:
    """Relations of the ``hubs`` nodes with most distinct outgoing edges, with their counts."""
    plain = edges.select("from_id", "relation", "to_id").distinct()
    best = plain.groupBy("from_id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "from_id").limit(hubs)
    return plain.groupBy("from_id", "relation").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(best), "from_id")  # hubs rows


def newest_nodes(nodes: DataFrame) -> DataFrame:
    """``id, node_type, label, n_rows``: the last row of each id counts (upsert)."""
    rows = nodes.where("id is not null").groupBy("id").agg(F.max(F.struct("created_at", "node_no", "node_type", "label")).alias("b"), F.count(F.lit(1)).alias("n_rows"))
    return rows.select("id", "b.node_type", "b.label", "n_rows")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per edge: the first id and the number of times it was written."""
    return edges.groupBy("from_id", "relation", "to_id", "graph_type").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_rows"))


def similar(nodes: DataFrame, query: str, top: int = 10) -> DataFrame:
    """``id, score``: cosine of character-bigram tf-idf between labels and a query; the query's own node is left out.

    There are at most as many bigrams as pairs of characters in use; their document frequencies are joined, not
    collected.
    """
    labels = nodes.where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    n = labels.count()
    grams = labels.select("id", F.explode(bigrams_of(F.col("label"))).alias("g")).groupBy("id", "g").agg(F.count(F.lit(1)).alias("tf"))
    idf = grams.groupBy("g").agg((F.log((F.lit(n) + 2) / (F.count(F.lit(1)) + 1)) + 1).alias("idf"))
    low = query.lower()
    mine: dict[str, int] = {}
    for a, b in zip(low, low[1:], strict=False):
        mine[a + b] = mine.get(a + b, 0) + 1
    asked = nodes.sparkSession.createDataFrame(list(mine.items()), "g string, q int")
    weighted = asked.join(idf, "g", "left").select("g", (F.col("q") * F.coalesce("idf", F.lit(1.0))).alias("w"))
    length = weighted.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l")).first()["l"]
    scored = grams.join(idf, "g").join(F.broadcast(weighted), "g", "left")  # one row per bigram of the query
    x = F.col("tf") * F.col("idf")
    sums = scored.groupBy("id").agg(F.sum(x * F.coalesce("w", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(x * x)).alias("norm"))
    cosine = F.floor(F.col("dot") / (F.col("norm") * F.lit(length)) * 10_000 + F.lit(0.5)) / F.lit(10_000.0)
    return sums.where((F.col("dot") > 0) & (F.col("id") != query)).select("id", cosine.alias("score")).orderBy(F.desc("score"), "id").limit(top)


def orphan_nodes(nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Ids that no edge and no document names."""
    ids = nodes.where("id is not null").select(F.lower(F.trim("id")).alias("id")).distinct()
    used = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    named = documents.where("entity is not null").select(F.lower(F.trim("entity")).alias("id")).distinct()
    return ids.join(used, "id", "left_anti").join(named, "id", "left_anti")


def link_table(docs: DataFrame) -> DataFrame:
    """``doc_id, target`` of every distinct wiki link of a document."""
    return docs.select("doc_id", F.explode(links(F.col("content"))).alias("target"))


def backlinks(docs: DataFrame) -> DataFrame:
    """Per target: documents that link to it, and the first of them."""
    return link_table(docs).groupBy("target").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def link_neighbours(docs: DataFrame, target: str, hops: int = 2) -> DataFrame:
    """``target, hop``: targets that share a document with ``target``, directly or over others."""
    table = link_table(docs)
    frontier = table.where(F.col("target") == target).select("target").distinct()
    seen = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        files = table.join(frontier, "target", "left_semi").select("doc_id").distinct()
        near = table.join(files, "doc_id", "left_semi").select("target").distinct()
        frontier = cut(near.join(seen, "target", "left_anti"))
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return seen.where("hop > 0")


def broken_links(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets without a page of their own (``pages``: slug), with the number of documents that link to them."""
    known = pages.select(F.lower("slug").alias("target")).distinct()
    return link_table(docs).groupBy(F.lower("target").alias("target")).agg(F.count(F.lit(1)).alias("n_docs")).join(known, "target", "left_anti")


NAME = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,2}"
SLUG = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)+"


def mentions(docs: DataFrame) -> DataFrame:
    """``doc_id, slug`` of hyphenated words and of names in capitals, outside wiki links."""
    bare = F.regexp_replace("content", r"\[\[[^\[\]\n]*\]\]", " ")
    slugs = F.regexp_extract_all(F.lower(bare), F.lit(SLUG), F.lit(0))
    names = F.transform(F.regexp_extract_all(bare, F.lit(NAME), F.lit(0)), lambda x: F.lower(F.translate(x, " ", "-")))
    return docs.select("doc_id", F.explode(F.array_distinct(F.concat(slugs, names))).alias("slug"))


def suggested_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, slug``: nodes that a document names without linking to them."""
    known = nodes.where("id is not null").select(F.col("id").alias("slug")).distinct()
    linked = link_table(docs).select("doc_id", F.col("target").alias("slug"))
    return mentions(docs).join(known, "slug", "left_semi").join(linked, ["doc_id", "slug"], "left_anti").select("doc_id", "slug")


def unreferenced(docs: DataFrame, entity: Column) -> DataFrame:
    """Entities of live notes that nothing links to or mentions."""
    notes = docs.where("dir = 'live-notes'").select(entity.alias("slug")).where("slug is not null").distinct()
    used = link_table(docs).select(F.col("target").alias("slug")).unionByName(mentions(docs).select("slug")).distinct()
    return notes.join(used, "slug", "left_anti")


def resolve_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``name, canonical``: smallest canonical of a name's alias; the name itself if it has none."""
    known = aliases.where("canonical is not null").groupBy(F.lower(F.trim("alias")).alias("name")).agg(F.min(F.lower(F.trim("canonical"))).alias("c"))
    return names.join(known, "name", "left").select("name", F.coalesce("c", "name").alias("canonical"))
