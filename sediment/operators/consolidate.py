"""From facts to nodes: grouping by consolidation key, pair relations, lifecycle links and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import cut

#: Tokens whose loss alone doesn't narrow a fact.
DETAIL_WORDS = ["anchor", "raw", "source"]


def consolidate(facts: DataFrame) -> DataFrame:
    """One node per consolidation key of facts (id, text, project): support, projects, layer, topic, scope, confidence.

    first_id is the fact that gives the node its text. Keys are grouped by their SHA-256 and no text is carried: rows
    are small, partial sums come first, and copies of one fact don't gather.
    """
    low = facts.select("id", "project", "text", F.lower("text").alias("_low"))  # step by step: nothing is worked out twice
    read = low.select("*", T.plain_words(F.col("_low")).alias("_words"))
    meant = read.select("*", T.semantic_tokens(F.col("text"), F.col("_words")).alias("_tokens"), T.semantic_polarity(F.col("text"), F.col("_words")).alias("_polarity"))
    key = F.sha2(T.consolidation_key(F.col("text"), F.col("_tokens"), F.col("_polarity")), 256)
    keyed = meant.select("id", key.alias("node_sha256"), F.col("project").alias("_project"), F.struct("project", T.memory_topic(F.col("_low")).alias("topic"), T.is_global_fact(F.col("_low")).alias("everywhere")).alias("_told"))
    per_project = keyed.groupBy("node_sha256", "_project").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("id", "_told")).alias("_first"), F.max("id").alias("_last"))
    nodes = per_project.groupBy("node_sha256").agg(F.sum("_n").alias("support_count"), F.count("_project").alias("project_count"), F.min("_first").alias("_first"), F.max("_last").alias("last_id"))
    told = nodes.select("node_sha256", "support_count", "project_count", F.col("_first.id").alias("first_id"), "last_id", "_first._told.*")
    layer = F.when(F.col("everywhere"), "global").when(F.col("project_count") >= 2, "domain").otherwise("project")
    scope = F.when(layer == "global", "global").when(layer == "domain", F.concat(F.lit("domain:"), "topic")).otherwise(F.concat(F.lit("project:"), F.coalesce("project", F.lit(""))))
    sure = F.when((F.col("support_count") >= 2) | F.col("everywhere"), "high").otherwise("medium")
    return told.select("*", layer.alias("layer"), scope.alias("scope"), sure.alias("confidence")).drop("everywhere")


def relation(current: Column, old: Column, current_polarity: Column, old_polarity: Column) -> Column:
    """What a newer fact's tokens say about an older one's; '' where nothing."""
    both = F.size(F.array_intersect(current, old))
    ratio = both / F.greatest(F.size(F.array_union(current, old)), F.lit(1))
    opposed = (current_polarity != 0) & (old_polarity != 0) & (current_polarity != old_polarity)
    narrower = (both == F.size(current)) & (F.size(current) < F.size(old))
    lost = F.array_except(old, current)
    return (
        F.when((F.size(current) < 4) | (F.size(old) < 4) | (both < 4), "")
        .when(opposed & (ratio >= 0.6), "contradiction")
        .when(opposed & (ratio >= 0.45), "contradiction_review")
        .when(narrower & (F.size(F.array_except(lost, T.words(DETAIL_WORDS))) == 0), "partial_supersession")
        .when(narrower, "scope_review")
        .when(ratio >= 0.45, "overlap_review")
        .otherwise("")
    )


def _told(nodes: DataFrame) -> DataFrame:
    """id, tokens, polarity of facts that say enough to be related."""
    read = nodes.select("id", "text", F.lower("text").alias("_low")).select("id", "text", T.plain_words(F.col("_low")).alias("_words"))
    told = F.struct(F.sort_array(T.semantic_tokens(F.col("text"), F.col("_words"))).alias("tokens"), T.semantic_polarity(F.col("text"), F.col("_words")).alias("polarity"))
    # a generator of one row: the filter isn't pushed down into the tokens, where they would be worked out again
    return read.select("id", F.inline(F.array(told))).filter(F.size("tokens") >= 4)


def fact_classes(nodes: DataFrame) -> DataFrame:
    """id, class_id, n_facts: facts (id, text) of equal tokens and polarity are one class, known by its smallest id.

    With `related_classes` this gives every link: a fact relates to the older facts of each class that its own relates to.
    """
    told = cut(_told(nodes).select("id", F.xxhash64("tokens", "polarity").alias("key")))  # texts are read once
    sizes = told.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_facts"))
    return told.join(sizes, "key").select("id", "class_id", "n_facts")


def related_pairs(nodes: DataFrame) -> DataFrame:
    """current_id, old_id, relation of nodes (id, text): of two related classes the newest and the oldest node."""
    return related_classes(nodes).select("current_id", "old_id", "relation")


def related_classes(nodes: DataFrame) -> DataFrame:
    """current_class, old_class, relation, current_id, old_id of classes of nodes (id, text), some of the first newer than some
    of the second by id; current_id is the newest and old_id the oldest of them.

    A related pair shares at least 45 % of its tokens or has one inside the other. By rarity of tokens, one of the newer
    node's first n - ceil(0.45 n) + 1 tokens is then in the older one, so only these rare tokens are joined on: no pairs
    of a frequent word, and no pair is lost.
    """
    known = _told(nodes).groupBy("tokens", "polarity").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    each = known.select("tokens", "polarity", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    ranked = each.join(seen, "token").groupBy("tokens", "polarity").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("by_rarity"))
    probe = F.size("tokens") - F.ceil(F.size("tokens") * F.lit(0.45) - F.lit(1e-9)) + 1
    probes = ranked.select("tokens", "polarity", F.explode(F.slice("by_rarity", F.lit(1), probe.cast("int"))).alias("x")).select("tokens", "polarity", F.col("x.token").alias("token"))
    old = each.select("token", F.col("tokens").alias("old_tokens"), F.col("polarity").alias("old_polarity"))
    pairs = probes.join(old, "token").select("tokens", "polarity", "old_tokens", "old_polarity").distinct()
    kind = relation(F.col("tokens"), F.col("old_tokens"), F.col("polarity"), F.col("old_polarity"))
    rated = pairs.withColumn("relation", kind).filter("relation <> ''")
    newer = known.select("tokens", "polarity", F.col("first_id").alias("current_class"), F.col("last_id").alias("current_id"))
    older = known.select(F.col("tokens").alias("old_tokens"), F.col("polarity").alias("old_polarity"), F.col("first_id").alias("old_class"), F.col("first_id").alias("old_id"))
    both = rated.join(newer, ["tokens", "polarity"]).join(older, ["old_tokens", "old_polarity"]).filter("old_id < current_id")
    return both.select("current_class", "old_class", "relation", "current_id", "old_id")


def edges(nodes: DataFrame, field: str) -> DataFrame:
    """src, dst of a list column, without self edges, from nodes whose lifecycle is valid."""
    return nodes.filter(lifecycle_valid("search")).select(F.col("id").alias("src"), F.explode(field).alias("dst")).filter("src <> dst").distinct()


def lifecycle_valid(mode: str) -> Column:
    """first_seen is not after last_seen; searches also accept nodes without either, audits don't."""
    first, last = F.coalesce(F.col("first_seen"), F.lit("")), F.coalesce(F.col("last_seen"), F.lit(""))
    ordered = F.coalesce(T.parse_timestamp(first) <= T.parse_timestamp(last), F.lit(False))
    return ordered | ((first == "") & (last == "")) if mode == "search" else ordered


LINKS = {"supersedes": "superseded_by", "contradicts": "contradicted_by", "deprecates": "deprecated_by"}


def inactive_ids(nodes: DataFrame) -> DataFrame:
    """Ids of nodes with an invalid lifecycle, nodes that another one replaces, and markers of deprecation.

    A backward link counts only if the forward one exists, and then the forward one already tells.
    """
    gone = nodes.filter(~lifecycle_valid("search")).select("id")
    for field in LINKS:
        gone = gone.unionByName(edges(nodes, field).select(F.col("dst").alias("id")))
    return gone.unionByName(nodes.filter(F.size("deprecates") > 0).select("id")).distinct().join(nodes.select("id"), "id", "left_semi")


def one_sided_links(nodes: DataFrame) -> DataFrame:
    """relation, src, dst of forward links without their backward link, and the reverse."""
    out = None
    for forward, backward in LINKS.items():
        there = nodes.select(F.col("id").alias("src"), F.explode(forward).alias("dst")).distinct()
        back = nodes.select(F.explode(backward).alias("src"), F.col("id").alias("dst")).distinct()
        for name, a, b in ((forward, there, back), (backward, back, there)):
            one = a.join(b, ["src", "dst"], "left_anti").select(F.lit(name).alias("relation"), "src", "dst")
            out = one if out is None else out.unionByName(one)
    return out


def reached(links: DataFrame, depth: int) -> DataFrame:
    """src, dst, steps: the nodes within `depth` links (src, dst), each at its fewest steps; joins are unrolled."""
    now = links.select("src", "dst").distinct()
    out, front = now.withColumn("steps", F.lit(1)), now
    for k in range(2, depth + 1):
        front = front.join(now.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct()
        out = out.unionByName(front.withColumn("steps", F.lit(k)))
    return out.groupBy("src", "dst").agg(F.min("steps").alias("steps"))


def apply_links(nodes: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The nodes with their forward links written back: a replaced node names the last (by id) of those that replace it, has
    low confidence, and each that replaces it derives from it. Contradictions name all. Links to unknown ids and to oneself
    change nothing. `more` (current, old) are further supersessions, as those found by text.

    Edges are a table: they join nodes by id and are summed up per node, so neither a hub nor the nodes' order matters.
    """
    ids = nodes.select(F.col("id").alias("dst"))
    given = {}
    for field in LINKS:
        one = nodes.select(F.col("id").alias("src"), F.explode(field).alias("dst"))
        if field == "supersedes" and more is not None:
            one = one.unionByName(more.select(F.col("current").alias("src"), F.col("old").alias("dst")))
        given[field] = one.filter("src <> dst").distinct().join(ids, "dst", "left_semi")
    out = nodes
    every = None
    for field, back in LINKS.items():
        named = F.array_sort(F.collect_set("src")) if field == "contradicts" else F.array(F.max("src"))
        out = out.join(given[field].groupBy(F.col("dst").alias("id")).agg(named.alias(f"_{back}")), "id", "left")
        out = out.join(given[field].groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias(f"_{field}")), "id", "left")
        every = given[field] if every is None else every.unionByName(given[field])
    none = F.array().cast("array<string>")
    out = out.join(every.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("_from")), "id", "left")
    low = F.lit(False)
    changed = {}
    for field, back in LINKS.items():
        low = low | F.col(f"_{back}").isNotNull()
        changed[field] = F.array_union(field, F.coalesce(f"_{field}", none))
        changed[back] = F.array_union(back, F.coalesce(f"_{back}", none)) if field == "contradicts" else F.coalesce(f"_{back}", back)
    changed["confidence"] = F.when(low, "low").otherwise(F.col("confidence"))
    changed["derived_from"] = F.array_union("derived_from", F.coalesce("_from", none))
    return out.withColumns(changed).select(*nodes.columns)


def text_links(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """current, old: pairs of nodes where a fact (text, target) of the first's text aims at the second's, by their text keys."""
    key = lambda c: T.text_key(F.col(c))
    aims = targets.filter("target is not null").select(key("text").alias("k"), key("target").alias("t")).filter("k <> t and k <> '' and t <> ''").distinct()
    current = nodes.select(key("text").alias("k"), F.col("id").alias("current"))
    old = nodes.select(key("text").alias("t"), F.col("id").alias("old"))
    return current.join(aims, "k").join(old, "t").filter("current <> old").select("current", "old").distinct()


def link_integrity(nodes: DataFrame) -> DataFrame:
    """One row: links by relation, how many have their counterpart (reciprocity, 1 without links), how many lead nowhere, and
    the shares of nodes with sources and with evidence."""
    ids = nodes.select(F.col("id").alias("dst"), F.lit(True).alias("_there"))
    parts = []
    for field, back in LINKS.items():
        forward = nodes.select(F.col("id").alias("src"), F.explode(field).alias("dst"), F.lit(field).alias("relation"))
        backward = nodes.select(F.explode(back).alias("src"), F.col("id").alias("dst"), F.lit(field).alias("relation"))
        parts.append(forward.withColumn("way", F.lit(1)).unionByName(backward.withColumn("way", F.lit(2))))
    links = parts[0].unionByName(parts[1]).unionByName(parts[2])
    pairs = links.groupBy("relation", "src", "dst").agg(F.bit_or("way").alias("ways"), F.count(F.lit(1)).alias("n"))
    known = pairs.join(ids, "dst", "left").join(ids.select(F.col("dst").alias("src"), F.col("_there").alias("_from")), "src", "left")
    sums = known.agg(*(F.coalesce(F.sum(F.when((F.col("relation") == f), F.col("n"))), F.lit(0)).alias(f"n_{f}") for f in LINKS), F.coalesce(F.sum(F.when(F.col("ways") == 3, F.col("n")).otherwise(0)) / F.sum("n"), F.lit(1.0)).alias("reciprocity"), F.coalesce(F.sum(F.when(F.col("_there").isNull() | F.col("_from").isNull(), F.col("n"))), F.lit(0)).alias("n_broken"))
    share = lambda c: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    cover = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), share(F.size("derived_from") > 0).alias("derived_share"), share(F.size("drill_paths") > 0).alias("evidence_share"))
    return sums.crossJoin(cover)  # one row each
