"""The graph of notes: parents, links, components and an audit of both."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions import text
from mnemoframe.operators.tables import cut_lineage

ROOT = "BRAIN"
#: What may hang directly below the root, and a link that may lead nowhere while there is no private layer.
ROOT_CHILDREN = ("notes/profile", "notes/projects", "notes/knowledge", "private/INDEX")
MISSING_ALLOWED = ("private/INDEX",)


def read_nodes(spark: SparkSession, root: str) -> DataFrame:
    """(node_id, text) of BRAIN.md, notes/ and private/ without memory folders."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    rel = F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), root.rstrip("/").split("://")[-1] + "/", -1), r"\.md$", "")
    rows = rows.select(rel.alias("node_id"), F.col("value").alias("text"))
    return rows.where((F.col("node_id") == ROOT) | F.startswith("node_id", F.lit("notes/")) | (F.startswith("node_id", F.lit("private/")) & ~F.array_contains(F.split("node_id", "/"), "memory")))


def _resolved(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``refs`` (node_id, raw) with target and error. A reference with a slash is an id, one without a file name; case doesn't matter."""
    rows = refs.withColumn("ref", text.normalize_reference(F.col("raw"))).withColumn("_k", F.lower("ref"))
    by_id = nodes.groupBy(F.lower("node_id").alias("_k")).agg(F.first("node_id").alias("_id"))
    by_stem = nodes.groupBy(F.lower(F.element_at(F.split("node_id", "/"), -1)).alias("_k")).agg(F.array_sort(F.collect_set("node_id")).alias("_stem"))
    rows = rows.join(by_id, "_k", "left").join(by_stem, "_k", "left")
    path = F.contains("ref", F.lit("/"))
    target = F.when(path, F.col("_id")).when(F.size("_stem") == 1, F.try_element_at("_stem", F.lit(1)))
    error = (
        F.when(F.col("ref").isNull(), F.concat(F.lit("invalid reference "), F.col("raw"))).when(~path & (F.size("_stem") > 1), F.concat(F.lit("ambiguous target "), F.col("ref"), F.lit(": "), F.array_join("_stem", ", ")))
        .when(target.isNull(), F.concat(F.lit("missing target "), F.col("ref")))
    )
    return rows.withColumns({"target": target, "error": error}).drop("_k", "_id", "_stem")


def parents(nodes: DataFrame) -> DataFrame:
    """(node_id, raw): each parent line of the front matter."""
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    return nodes.select("node_id", F.explode(F.regexp_extract_all(front, F.lit(r"(?m)^parent:[ \t]*(.*?)[ \t]*$"), 1)).alias("raw"))


def links(nodes: DataFrame) -> DataFrame:
    """(node_id, raw): each wikilink in the visible text."""
    return nodes.select("node_id", F.explode(text.wikilinks(F.col("text"))).alias("raw"))


def components(nodes: DataFrame, edges: DataFrame, key: str = "node_id", max_rounds: int = 60) -> DataFrame:
    """(key, component): the least node of each node's undirected component. edges: (src, dst).

    Each round takes the least label among the neighbours and then that label's own label, so paths halve; rounds are cut by a written table.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both = cut_lineage(both)
    now = cut_lineage(nodes.select(F.col(key).alias("node"), F.col(key).alias("label")))
    for _ in range(max_rounds):
        near = both.join(now.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("low"))
        step = now.join(near, "node", "left").select("node", "label", F.least("label", "low").alias("low"))
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = cut_lineage(step.join(jump, "low", "left").select("node", F.coalesce("lower", "low").alias("label"), (F.coalesce("lower", "low") != F.col("label")).alias("moved")))
        if not new.where("moved").take(1):
            return new.select(F.col("node").alias(key), F.col("label").alias("component"))
        now = new.select("node", "label")
    raise RuntimeError(f"no end after {max_rounds} rounds")


def parent_chains(parent_of: DataFrame, root: str = ROOT, max_rounds: int = 60) -> DataFrame:
    """(child, reaches, cyclic): whether each chain of (child, parent) ends at the root, by pointer doubling.

    A chain that neither ends nor reaches the root after doubling past the number of nodes goes round.
    """
    hops = cut_lineage(parent_of.select("child", F.col("parent").alias("at")))
    n = hops.count()
    for r in range(max_rounds):
        following = hops.select(F.col("child").alias("at"), F.col("at").alias("then"))
        new = cut_lineage(hops.join(following, "at", "left").select("child", F.coalesce("then", "at").alias("at"), (F.col("then").isNotNull() & (F.col("then") != F.col("at"))).alias("moved")))
        still = new.where("moved").join(new.select(F.col("child").alias("at")), "at", "left_semi")
        open_chains = still.count()
        hops = new.select("child", "at")
        if not open_chains or 2**r > n:
            break
    inner = parent_of.select(F.col("child").alias("at")).distinct().withColumn("inner", F.lit(True))
    return hops.join(inner, "at", "left").select("child", (F.col("at") == root).alias("reaches"), F.coalesce("inner", F.lit(False)).alias("cyclic"))


def audit(nodes: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(report, errors): one row (nodes, parent_edges, links, components, ok), and (node_id, error)."""
    nodes = cut_lineage(nodes)
    wrong = []
    same_id = nodes.groupBy(F.lower("node_id").alias("k")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("node_id")), ", ").alias("node_id")).where("n > 1")
    wrong.append(same_id.select("node_id", F.lit("duplicate node id").alias("error")))
    same_stem = nodes.groupBy(F.lower(F.element_at(F.split("node_id", "/"), -1)).alias("k")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("node_id")), ", ").alias("node_id")).where("n > 1")
    wrong.append(same_stem.select("node_id", F.lit("duplicate node name").alias("error")))
    wrong.append(nodes.select("node_id", F.explode(text.malformed_links(F.col("text"))).alias("line")).select("node_id", F.concat(F.lit("incomplete or multi-line wikilink in body line "), F.col("line")).alias("error")))
    raw = cut_lineage(parents(nodes))
    count = nodes.join(raw.groupBy("node_id").agg(F.count("*").alias("n")), "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"))
    wrong.append(count.where((F.col("node_id") == ROOT) & (F.col("n") > 0)).select("node_id", F.lit("the root has a parent").alias("error")))
    wrong.append(count.where((F.col("node_id") != ROOT) & (F.col("n") != 1)).select("node_id", F.concat(F.lit("exactly one parent is needed, found "), F.col("n")).alias("error")))
    wrong.append(nodes.agg(F.count_if(F.col("node_id") == ROOT).alias("n")).where("n = 0").select(F.lit(ROOT).alias("node_id"), F.lit("the root is missing").alias("error")))
    single = raw.join(count.where((F.col("n") == 1) & (F.col("node_id") != ROOT)).select("node_id"), "node_id", "left_semi")
    found = cut_lineage(_resolved(single, nodes))
    n, p = F.col("node_id"), F.col("target")
    rule = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("parent "), F.col("error"))).when(p == n, F.lit("parent is the node itself"))
        .when((p == ROOT) & ~n.isin(*ROOT_CHILDREN), F.lit("may not hang below the root")).when(F.startswith(n, F.lit("notes/")) & F.startswith(p, F.lit("private/")), F.lit("clean node with a private parent"))
        .when(F.startswith(n, F.lit("private/")) & (p != ROOT) & ~F.startswith(p, F.lit("private/")), F.lit("private node with a clean parent"))
    )
    found = found.withColumn("rule", rule)
    wrong.append(found.where("rule is not null").select("node_id", F.col("rule").alias("error")))
    parent_of = cut_lineage(found.where("rule is null").select(F.col("node_id").alias("child"), F.col("target").alias("parent")))
    chains = parent_chains(parent_of, max_rounds=max_rounds)
    wrong.append(chains.where("not reaches").select(F.col("child").alias("node_id"), F.when(F.col("cyclic"), F.lit("parent cycle")).otherwise(F.lit("parent chain doesn't reach the root")).alias("error")))
    linked = cut_lineage(_resolved(links(nodes), nodes))
    private = nodes.agg((F.count_if(F.startswith("node_id", F.lit("private/"))) > 0).alias("private"))
    stub = F.coalesce(F.col("ref").isin(*MISSING_ALLOWED), F.lit(False)) & ~F.col("private")
    wrong.append(linked.where("error is not null").crossJoin(F.broadcast(private)).where(~stub).select("node_id", "error"))  # one row
    edges = parent_of.select(F.col("child").alias("src"), F.col("parent").alias("dst")).unionByName(linked.where("target is not null and target <> node_id").select(F.col("node_id").alias("src"), F.col("target").alias("dst"))).distinct()
    edges = cut_lineage(edges)
    errors = wrong[0]
    for w in wrong[1:]:
        errors = errors.unionByName(w)
    errors = cut_lineage(errors.distinct())
    n_components = components(nodes, edges, max_rounds=max_rounds).agg(F.count_distinct("component").alias("components"))
    report = (
        nodes.agg(F.count("*").alias("nodes")).crossJoin(parent_of.agg(F.count("*").alias("parent_edges"))).crossJoin(edges.agg(F.count("*").alias("links"))).crossJoin(n_components)
        .crossJoin(errors.agg(F.count("*").alias("n_errors")))
    )  # single rows
    return report.withColumn("ok", (F.col("n_errors") == 0) & ((F.col("components") == 1) | (F.col("nodes") == 0))), errors


#: Folders that an editor of the vault must not show: they hold raw files, not notes of the graph.
HIDDEN_FOLDERS = ("memory/", "private/memory/")


def ignore_filters(config: str | None) -> tuple[frozenset[str], list[str]]:
    """(folders that the editor's configuration hides, what is wrong with it). config: its JSON text, None if there is none."""
    if config is None:
        return frozenset(), ["the editor's configuration is missing"]
    try:
        found = json.loads(config)
    except ValueError:
        return frozenset(), ["the editor's configuration isn't JSON"]
    hidden = found.get("userIgnoreFilters") if isinstance(found, dict) else None
    if not isinstance(hidden, list) or not all(isinstance(x, str) for x in hidden):
        return frozenset(), ["userIgnoreFilters must be a list of texts"]
    return frozenset(hidden), [f"userIgnoreFilters must hold {x}" for x in HIDDEN_FOLDERS if x not in hidden]


def unmanaged(files: DataFrame, hidden: Iterable[str] = ()) -> DataFrame:
    """(rel, error) of Markdown files (rel, size) that the editor shows outside the curated folders."""
    top = F.split("rel", "/")[0]
    seen = ~F.startswith("rel", F.lit(".")) & ~top.isin("notes", "private") & ~F.concat(top, F.lit("/")).isin(*hidden, "")
    error = (
        F.when(~F.contains("rel", F.lit("/")), F.when(F.col("rel") == f"{ROOT}.md", None).when(F.col("size") == 0, F.lit("empty placeholder at the root")).otherwise(F.lit("note at the root outside the graph")))
        .when(seen, F.lit("visible note outside the graph"))
    )
    return files.where(F.col("rel").rlike(r"\.md$")).select("rel", error.alias("error")).where("error is not null")


def layout_errors(spark: SparkSession, vault: str) -> DataFrame:
    """(rel, error): what is wrong with a vault's folders and the editor's configuration."""
    base = vault.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001  the public Hadoop file system is behind it
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    there = fs.exists(path(f"{base}/.obsidian/app.json"))
    # Readers leave empty files out; at the root they are listed one by one.
    empty = [(s.getPath().getName(), 0) for s in fs.listStatus(path(base)) if s.isFile() and not s.getLen() and s.getPath().getName().endswith(".md")]
    hidden, wrong = ignore_filters(spark.read.text(f"{base}/.obsidian/app.json", wholetext=True).first().value if there else None)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(base)
    rel = F.substring(F.regexp_replace("path", "^[A-Za-z0-9]+:(//[^/]*)?", ""), len(re.sub("^[A-Za-z0-9]+:(//[^/]*)?", "", base)) + 2, 10_000)
    files = rows.select(rel.alias("rel"), F.col("length").alias("size")).where("size > 0").unionByName(spark.createDataFrame(empty, "rel string, size bigint"))
    found = unmanaged(files, hidden)
    return found.unionByName(spark.createDataFrame([(".obsidian/app.json", w) for w in wrong], "rel string, error string"))
