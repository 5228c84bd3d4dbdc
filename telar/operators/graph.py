"""Dependency graphs of tender clauses: triples from texts and replies, nodes, edges, cycles, exports."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.sources.files import settled

# Node and relation types, and the sentence patterns with the types they give.
NODE_TYPES = ["requirement", "stakeholder", "milestone", "resource", "risk", "document", "clause"]
RELATIONS = ["depends_on", "blocks", "requires", "related_to", "triggered_by", "conflicts_with", "mentions"]
SENTENCES = [
    (r"(?:el\s+)?(\w+(?:\s+\w+)?)\s+(?:se\s+)?(?:libera|realiza|ejecuta|completa)\s+(?:tras|después de|luego de)\s+(?:la\s+)?(\w+(?:\s+\w+)?)", "milestone", "triggered_by", "milestone", 0.7),
    (r"(?:el\s+|la\s+)?(\w+(?:\s+\w+)?)\s+(?:requiere|necesita|depende de)\s+(?:el\s+|la\s+)?(\w+(?:\s+\w+)?)", "requirement", "requires", "resource", 0.7),
    (r"si\s+(?:el\s+|la\s+)?(\w+(?:\s+\w+)?)\s+(?:falla|no se cumple|no ocurre)[,\s]+(?:se aplicará\s+)?(?:el\s+|la\s+)?(\w+(?:\s+\w+)?)", "resource", "blocks", "risk", 0.6),
]
LARGE, TOO_LARGE = 30, 50
NO_NODES = "graph TD\n    empty[No nodes]"
REPLY = "array<struct<subject:struct<id:string,label:string,type:string>,predicate:string,object:struct<id:string,label:string,type:string>,confidence:double>>"
SHAPES = {"milestone": ('(("', '"))'), "risk": ('[/"', '"\\]'), "stakeholder": ('[["', '"]]')}


def node_id(label: Column) -> Column:
    """Lower-case words joined by underscores, 50 characters at most."""
    plain = F.trim(F.regexp_replace(F.lower(label), r"(?U)[^\w\s]", ""))
    return F.substring(F.regexp_replace(plain, r"(?U)\s+", "_"), 1, 50)


def coerce_node(kind: Column) -> Column:
    return F.when(F.coalesce(F.lower(kind).isin(*NODE_TYPES), F.lit(False)), F.lower(kind)).otherwise("requirement")


def coerce_relation(kind: Column) -> Column:
    return F.when(F.coalesce(F.lower(kind).isin(*RELATIONS), F.lit(False)), F.lower(kind)).otherwise("related_to")


def pattern_triples(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, subject and object (label, type), relation, confidence of the sentence patterns in a text."""
    low = F.lower("text")

    def family(p: str, s: str, rel: str, o: str, conf: float) -> Column:
        pairs = F.arrays_zip(*[F.regexp_extract_all(low, F.lit("(?U)" + p), F.lit(g)).alias(f"g{g}") for g in (1, 2)])
        return F.transform(pairs, lambda x: F.struct(
            F.initcap(F.trim(x["g1"])).alias("subject"), F.lit(s).alias("subject_type"), F.lit(rel).alias("relation"),
            F.initcap(F.trim(x["g2"])).alias("object"), F.lit(o).alias("object_type"), F.lit(conf).alias("confidence")))

    return texts.select(*keys, F.posexplode(F.concat(*[family(*s) for s in SENTENCES])).alias("seq", "t")).select(*keys, "seq", "t.*")


def json_triples(replies: DataFrame, keys: list[str]) -> DataFrame:
    """The same from JSON replies: from the first [ to the last ]; missing ids are `unknown`, confidence 0.8."""
    found = F.regexp_extract("reply", r"(?s)\[.*\]", 0)
    t = replies.select(*keys, F.posexplode(F.from_json(F.when(found != "", found), REPLY)).alias("seq", "t"))
    side = lambda s: [F.coalesce(f"t.{s}.label", F.lit("Unknown")).alias(s), coerce_node(F.coalesce(f"t.{s}.type", F.lit("requirement"))).alias(f"{s}_type"), node_id(F.coalesce(f"t.{s}.id", F.lit("unknown"))).alias(f"{s}_id")]
    return t.filter("t IS NOT NULL").select(*keys, "seq", *side("subject"), coerce_relation(F.coalesce("t.predicate", F.lit("related_to"))).alias("relation"), *side("object"), F.coalesce("t.confidence", F.lit(0.8)).alias("confidence"))


def node_winners(triples: DataFrame, generation: int = 0, key: str = "graph_id") -> DataFrame:
    """(node_id, won) of a section's triples: won has the place, label and type of the first mention, a triple's subject before its object."""
    place = lambda side: (F.lit(generation).alias("generation"), "seq", F.lit(side).alias("side"))
    both = F.array(*[F.struct(F.struct(*place(i), F.col(c).alias("label"), F.col(f"{c}_type").alias("type")).alias("m"), node_id(F.col(c)).alias("node_id")) for i, c in enumerate(("subject", "object"))])
    return triples.select(key, F.inline(both)).groupBy(key, "node_id").agg(F.min("m").alias("won"))


def edge_winners(triples: DataFrame, generation: int = 0, key: str = "graph_id") -> DataFrame:
    """(source, target, won) of a section's triples: won has the place, relation and weight of the last one each way."""
    last = F.max(F.struct(F.lit(generation).alias("generation"), "seq", "relation", F.col("confidence").alias("weight")))
    return triples.groupBy(key, node_id(F.col("subject")).alias("source"), node_id(F.col("object")).alias("target")).agg(last.alias("won"))


def merged_nodes(*winners: DataFrame, key: str = "graph_id") -> DataFrame:
    return reduce(DataFrame.unionByName, winners).groupBy(key, "node_id").agg(F.min("won").alias("won"))


def merged_edges(*winners: DataFrame, key: str = "graph_id") -> DataFrame:
    return reduce(DataFrame.unionByName, winners).groupBy(key, "source", "target").agg(F.max("won").alias("won"))


def shown_nodes(winners: DataFrame, key: str = "graph_id") -> DataFrame:
    return winners.select(key, "node_id", "won.label", "won.type")


def shown_edges(winners: DataFrame, key: str = "graph_id") -> DataFrame:
    return winners.select(key, "source", "target", "won.relation", "won.weight")


def nodes(triples: DataFrame, key: str = "graph_id") -> DataFrame:
    """First mention wins label and type; a triple's subject comes before its object."""
    return shown_nodes(node_winners(triples, 0, key), key)


def edges(triples: DataFrame, key: str = "graph_id") -> DataFrame:
    """One edge per direction; the last relation and weight win."""
    return shown_edges(edge_winners(triples, 0, key), key)


def reachable(graph: DataFrame, key: str = "graph_id") -> DataFrame:
    """(source, target) of every two nodes joined by a walk, by squaring: after i rounds, walks of 2 ** i edges."""
    found, n = settled(graph.select(key, "source", "target").distinct(), "reach"), -1
    while n != (n := found.count()):
        further = found.withColumnRenamed("target", "via").join(found.withColumnRenamed("source", "via"), [key, "via"]).select(key, "source", "target")
        found = settled(found.unionByName(further).distinct(), "reach")
    return found


def strong_components(graph: DataFrame, key: str = "graph_id") -> DataFrame:
    """(node, component) of nodes on a cycle: those that reach one another; the least of them names the component."""
    there = reachable(graph, key)
    back = there.select(key, F.col("target").alias("source"), F.col("source").alias("target"))
    return there.join(back, [key, "source", "target"]).groupBy(key, F.col("source").alias("node")).agg(F.min("target").alias("component"))


def closable(ring: DataFrame, key: str) -> DataFrame:
    """(first, node): nodes from which `first`, their least, is reached by edges between nodes that aren't less."""
    back = ring.select(key, F.col("target").alias("node"), F.col("source").alias("before"))
    new = settled(ring.filter("source > target").select(key, F.col("target").alias("first"), F.col("source").alias("node")).distinct(), "closable")
    found = new
    while not new.isEmpty():
        further = new.join(back, [key, "node"]).filter("before > first").select(key, "first", F.col("before").alias("node")).distinct()
        new = settled(further.join(found, [key, "first", "node"], "left_anti"), "closable")
        found = found.unionByName(new)
    return found


def grown_cycles(ring: DataFrame, longest: int | None, key: str) -> DataFrame:
    """(path) of cycles by paths that grow from their least node, along nodes from which it can be reached again."""
    end = closable(ring, key)
    paths, n = ring.filter("target >= source").select(key, F.col("source").alias("first"), F.col("target").alias("last"), F.array("source").alias("path")), 1
    open_ = paths.join(end.withColumnRenamed("node", "last"), [key, "first", "last"])
    found, open_ = paths.filter("last = first").select(key, "path"), settled(open_, "paths")
    while n != longest and not open_.isEmpty():
        steps = open_.join(ring.withColumnRenamed("source", "last"), [key, "last"]).filter("target = first OR target > first AND target <> last AND NOT array_contains(path, target)")
        steps = settled(steps.select(key, "first", F.col("target").alias("last"), F.concat("path", F.array("last")).alias("path")), "paths")
        found = found.unionByName(steps.filter("last = first").select(key, "path"))
        open_, n = steps.filter("last <> first").join(end.withColumnRenamed("node", "last"), [key, "first", "last"]), n + 1
    return found


def small_cycles(edges: list[tuple], longest: int | None) -> Iterator[list]:
    """The simple cycles of a small graph, each from its least node."""
    after, before = defaultdict(set), defaultdict(set)
    for a, z in edges:
        after[a].add(z)
        before[z].add(a)
    for first in sorted(after):
        ends, todo = {first}, [first]  # nodes, none less than the first, from which it is reached
        while todo:
            new = {x for x in before[todo.pop()] if x > first} - ends
            ends |= new
            todo += new
        path, branches = [first], [iter(sorted(after[first] & ends))]
        while branches:
            node = next(branches[-1], None)
            if node is None:
                branches.pop()
                path.pop()
            elif node == first:
                yield list(path)
            elif node not in path and len(path) != longest:
                path.append(node)
                branches.append(iter(sorted(after[node] & ends)))


def cycles(graph: DataFrame, longest: int | None = None, key: str = "graph_id", small: int = TOO_LARGE) -> DataFrame:
    """Simple directed cycles (of `longest` nodes at most, if given), from their least node; self-loops count. graph: edges.

    Only edges within a strong component can be part of a cycle, so graphs without cycles end there. A component of at
    most `small` nodes is followed in one task; in larger ones paths grow by equi-joins, each step's written to the shared
    folder, and only along nodes from which the first can still be reached. The number of cycles itself can be exponential.
    """
    e = settled(graph.select(key, "source", "target").distinct(), "edges")
    parts = settled(strong_components(e, key), "components")
    sizes = parts.groupBy(key, "component").agg((F.count(F.lit(1)) <= small).alias("small"))
    side = lambda c: parts.select(key, F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    ring = e.join(side("source"), [key, "source"]).join(side("target"), [key, "target"]).filter("source_component = target_component")
    ring = settled(ring.withColumnRenamed("source_component", "component").join(sizes, [key, "component"]).select(key, "component", "source", "target", "small"), "ring")
    kind = graph.schema[key].dataType.simpleString()

    def follow(table: pd.DataFrame) -> pd.DataFrame:
        found = list(small_cycles(list(zip(table["source"], table["target"])), longest))
        return pd.DataFrame({key: pd.Series([table[key].iloc[0]] * len(found), dtype=table[key].dtype), "path": pd.Series(found, dtype=object)})

    node = graph.schema["source"].dataType.simpleString()
    found = ring.filter("small").groupBy(key, "component").applyInPandas(follow, f"`{key}` {kind}, path array<{node}>")
    large = ring.filter("NOT small").select(key, "source", "target")
    if not large.isEmpty():
        found = found.unionByName(grown_cycles(large, longest, key))
    return found.withColumn("severity", F.when(F.size("path") <= 3, "high").otherwise("medium"))


def describe_cycles(found: DataFrame, named: DataFrame, key: str = "graph_id") -> DataFrame:
    """Adds the sentence that names the nodes; labels come from the graph's own table of labels."""
    labels = named.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("node_id", "label"))).alias("labels"))
    text = F.array_join(F.transform(F.concat("path", F.slice("path", 1, 1)), lambda n: F.coalesce(F.try_element_at("labels", n), n)), " → ")
    return found.join(labels, key).select(key, "path", "severity", F.concat(F.lit("Dependencia circular: "), text).alias("description"))


def limits(named: DataFrame, key: str = "graph_id") -> DataFrame:
    n = F.col("n_nodes")
    out = named.groupBy(key).agg(F.count(F.lit(1)).alias("n_nodes"))
    return out.withColumns({"accepted": n <= TOO_LARGE, "warning": F.when(n > LARGE, F.format_string("Grafo grande: %d nodos", n))})


def degrees(graph: DataFrame, key: str = "graph_id") -> DataFrame:
    """Edges from and to each node."""
    both = graph.select(key, F.inline(F.array(F.struct(F.col("source").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return both.groupBy(key, "node_id").agg(F.sum("o").alias("edges_from"), F.sum("i").alias("edges_to"))


def summary(named: DataFrame, graph: DataFrame, found: DataFrame, key: str = "graph_id") -> DataFrame:
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    out = count(named, "nodes").join(count(graph, "edges"), key, "left").join(count(found, "deadlocks"), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(key, "nodes", zero("edges"), zero("deadlocks"), (F.coalesce("deadlocks", F.lit(0)) > 0).alias("has_deadlocks"))


def mermaid_edge(label: Column | None = None) -> Column:
    """One edge as Mermaid text: its own label, else its relation in capitals."""
    named = F.upper("relation") if label is None else F.coalesce(label, F.upper("relation"))
    return F.concat("source", F.lit(" -->|"), named, F.lit("| "), "target")


def mermaid(named: DataFrame, graph: DataFrame, key: str = "graph_id", graphs: DataFrame | None = None) -> DataFrame:
    """Mermaid text per graph: nodes by id, shaped by type, then edges. graphs: the keys of all graphs; one without nodes says so."""
    opened, closed = F.lit('["'), F.lit('"]')
    for kind, (a, z) in SHAPES.items():
        opened, closed = F.when(F.col("type") == kind, a).otherwise(opened), F.when(F.col("type") == kind, z).otherwise(closed)
    a = named.select(key, F.struct(F.lit(0).alias("o"), F.col("node_id").alias("x"), F.lit("").alias("y"), F.concat(F.lit("    "), "node_id", opened, "label", closed).alias("line")).alias("r"))
    b = graph.select(key, F.struct(F.lit(1).alias("o"), F.col("source").alias("x"), F.col("target").alias("y"), F.concat(F.lit("    "), "source", F.lit(" -->|"), "relation", F.lit("| "), "target").alias("line")).alias("r"))
    per = a.unionByName(b).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("r"))
    out = per.select(key, F.array_join(F.concat(F.array(F.lit("graph TD")), F.transform("r", lambda x: x["line"])), "\n").alias("mermaid"))
    if graphs is None:
        return out
    return graphs.select(key).distinct().join(out, key, "left").select(key, F.coalesce("mermaid", F.lit(NO_NODES)).alias("mermaid"))


def escape_xml(c: Column) -> Column:
    for a, z in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(z))
    return c


def graphml(named: DataFrame, graph: DataFrame, key: str = "graph_id") -> DataFrame:
    """(key, part, x, y, line): one line of GraphML per node and edge, to be written in this order between head and foot."""
    a = named.select(key, F.lit(0).alias("part"), F.col("node_id").alias("x"), F.lit("").alias("y"), F.concat(F.lit('<node id="'), escape_xml(F.col("node_id")), F.lit('"><data key="label">'), escape_xml(F.col("label")), F.lit('</data><data key="type">'), "type", F.lit("</data></node>")).alias("line"))
    b = graph.select(key, F.lit(1).alias("part"), F.col("source").alias("x"), F.col("target").alias("y"), F.concat(F.lit('<edge source="'), escape_xml(F.col("source")), F.lit('" target="'), escape_xml(F.col("target")), F.lit('"><data key="relation">'), "relation", F.lit("</data></edge>")).alias("line"))
    return a.unionByName(b)
