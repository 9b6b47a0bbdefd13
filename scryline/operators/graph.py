"""Connected parts and relations (IDs J21, J22, J23, J24, O16, O18, X60, X61)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scryline.functions.scalars import version_satisfies
from scryline.operators.terms import held_terms
from scryline.sources.versions import shared_dir


def _checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def shared_components(members: DataFrame, node: str, via: str) -> DataFrame:
    """Node, component (the least node it is connected with): nodes that share a `via` value belong together.

    Labels travel through the shared values, one row for each member, so a value with many nodes makes no pairs. Each round
    takes the least label of a node's values, and of that node's own label; rounds end when none changes.
    """
    members = _checkpointed(members.select(node, via).distinct())
    labels = members.select(node).distinct().withColumn("component", F.col(node))
    while True:
        by_value = members.join(labels, node).groupBy(via).agg(F.min("component").alias("_l"))
        spread = members.join(by_value, via).groupBy(node).agg(F.min("_l").alias("_l"))
        step = spread.join(labels, node)
        hop = labels.select(F.col(node).alias("_l"), F.col("component").alias("_far"))
        new = _checkpointed(step.join(hop, "_l", "left").select(node, F.least("component", "_l", "_far").alias("_new"), "component"))
        changed = new.where("_new <> component").limit(1).count()
        labels = new.select(node, F.col("_new").alias("component"))
        if not changed:
            return labels


def related_paths(files: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """Files (path, content) by how many of the terms (term) they hold, two more for tests."""
    hits = held_terms(files, "content", terms.select("term")).withColumn("hits", F.size("terms")).where("hits > 0")
    score = F.col("hits") + F.when(F.col("path").rlike(r"(^|/)tests?/|(^|/)test_|[._]test\."), 2).otherwise(0)
    return hits.drop("terms").withColumn("score", score).orderBy(F.desc("score"), "path").limit(most)


def matching_rule(rule_ids: DataFrame, rules: DataFrame, candidate: str) -> DataFrame:
    """Of each candidate's rules (array, in order) the first whose package or one of its first three terms is in the text, else the first."""
    each = rule_ids.select(candidate, "text", F.posexplode("rule_ids").alias("pos", "rule_id")).join(rules, "rule_id", "left")
    t = F.lower("text")
    hit = F.coalesce(F.contains(t, F.lower("package")), F.lit(False)) | F.coalesce(F.exists(F.slice("terms", 1, 3), lambda x: F.contains(t, F.lower(x))), F.lit(False))
    return each.groupBy(candidate).agg(F.min_by("rule_id", F.struct(~hit, F.col("pos"))).alias("rule_id"))


def manifest_contradicts(manifest: Column, package: Column, version: Column) -> Column:
    """Does the manifest list the package with the wanted major version? Later sections win: optional, peer, dev, plain."""
    sections = "struct<dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>,optionalDependencies:map<string,string>>"
    m = F.from_json(manifest, sections)
    get = lambda s: F.element_at(F.map_from_entries(F.transform(F.map_entries(m[s]), lambda e: F.struct(F.lower(e["key"]), e["value"]))), F.lower(package))
    found = F.coalesce(get("optionalDependencies"), get("peerDependencies"), get("devDependencies"), get("dependencies"))
    return found.isNotNull() & version_satisfies(found, version)


def project_of(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Path, project: the nearest folder above a file that holds a marker; null if none does."""
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("dir"))
    held = above.join(markers.select("dir").distinct(), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("project"))
    return files.select("path").join(held, "path", "left")


def context_paths(first: Column, second: Column, third: Column, most: int) -> Column:
    """Distinct paths of three lists in order, cut at most."""
    return F.slice(F.array_distinct(F.concat(first, second, third)), 1, most)
