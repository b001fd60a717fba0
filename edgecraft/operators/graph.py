"""Graph construction and adjacency.

Graphs are plain node / edge DataFrames.  Undirected graphs are stored with
both directions so that a neighbour lookup is a single equi-join on ``src``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgecraft.operators.features import id_map
from edgecraft.sources.jsonl import once

SIMILAR_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("titleSlug", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("difficulty", T.StringType()),
]))


def catalog_from_tag_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Problem nodes with a slug; tags = titles of tag neighbours (either
    edge direction); problems without tags are kept with an empty list;
    distinct on frontend_id."""
    prob = nodes.where((F.col("type") == "problem") & F.col("title_slug").isNotNull()
                       & (F.col("title_slug") != ""))
    tags = nodes.where(F.col("type") == "tag").select(F.col("id").alias("tag_id"),
                                                      F.coalesce("title", "id").alias("tag"))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"),
                                                               F.col("src").alias("dst")))
    pt = both.join(tags, both.dst == tags.tag_id).groupBy("src").agg(
        F.sort_array(F.collect_set("tag")).alias("tags"))
    cat = prob.join(pt, prob.id == pt.src, "left").select(
        F.col("id").cast("string").alias("frontend_id"),
        F.col("title_slug").alias("problem_id"),
        F.coalesce("title", "title_slug").alias("title"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    return cat.dropDuplicates(["frontend_id"])


def similar_problem_graph(questions: DataFrame, lists: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the undirected similar-problem graph.

    With ``lists`` (``list_id, similarQuestions``) the questions name their list by
    ``list_id``; a list that many questions share is then read once, see
    :func:`_list_graph`.

    ``similarQuestions`` is a JSON string list.  A similar slug not in the
    question list becomes a stub node whose id is the slug.  Edges are stored
    once, canonical (least, greatest), distinct.
    """
    if lists is not None:
        return _list_graph(questions, lists)
    q = questions.select(F.col("frontendQuestionId").cast("string").alias("id"),
                         "title", "titleSlug", "similarQuestions")
    ids = q.select(F.col("titleSlug").alias("s_slug"), F.col("id").alias("s_id"))
    sim = q.select(F.col("id").alias("src"),
                   F.explode(F.from_json("similarQuestions", SIMILAR_SCHEMA)).alias("s")) \
        .select("src", F.col("s.titleSlug").alias("slug"), F.col("s.title").alias("stitle"))
    j = sim.join(ids, sim.slug == ids.s_slug, "left")
    dst = F.coalesce(F.col("s_id"), F.col("slug"))
    edges = j.select(F.least(F.col("src"), dst).alias("src"),
                     F.greatest(F.col("src"), dst).alias("dst")).distinct()
    stubs = j.where(F.col("s_id").isNull()).groupBy("slug").agg(F.min("stitle").alias("title")) \
        .select(F.col("slug").alias("id"), F.coalesce("title", "slug").alias("title"),
                F.col("slug").alias("titleSlug"))
    nodes = q.select("id", "title", "titleSlug").unionByName(stubs)
    return nodes, edges


def _list_graph(questions: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C1 on shared lists.  Nodes that have the same lists and stand in the same
    lists are one class; edges are told apart between classes and then expanded, so
    no edge is shuffled to find its copies."""
    q = questions.select(F.col("frontendQuestionId").cast("string").alias("id"), "title", "titleSlug", "list_id")
    ids = q.select(F.col("titleSlug").alias("s_slug"), F.col("id").alias("s_id"))
    own = q.where("list_id is not null").select("id", "list_id").distinct()
    sim = lists.join(own.select("list_id").distinct(), "list_id", "left_semi") \
        .select("list_id", F.explode(F.from_json("similarQuestions", SIMILAR_SCHEMA)).alias("s")) \
        .select("list_id", F.col("s.titleSlug").alias("slug"), F.col("s.title").alias("stitle"))
    j = sim.join(ids, sim.slug == ids.s_slug, "left")
    listed = j.select(F.coalesce("s_id", "slug").alias("id"), "list_id").distinct()
    # an end without an id leaves the other end alone, as least / greatest do
    mine, its = own.withColumnRenamed("id", "a"), listed.withColumnRenamed("id", "b")
    alone = mine.join(its.where("b is null"), "list_id").select(F.col("a").alias("id")) \
        .unionByName(mine.where("a is null").join(its, "list_id").select(F.col("b").alias("id"))) \
        .unionByName(mine.join(its, (mine.list_id == its.list_id) & (mine.a == its.b)).select(F.col("a").alias("id"))).distinct()
    sets = own.where("id is not null").withColumn("side", F.lit("own")) \
        .unionByName(listed.where("id is not null").withColumn("side", F.lit("in"))).groupBy("id").agg(
            *[F.sort_array(F.collect_set(F.when(F.col("side") == k, F.col("list_id")))).alias(n)
              for k, n in (("own", "own"), ("in", "in_"))])
    member = sets.select(F.col("id").alias("problem_id"), F.md5(F.to_json(F.struct("own", "in_")).cast("binary")).alias("class_id"),
                         "own", "in_")
    classes = member.groupBy("class_id").agg(F.any_value("own").alias("own"), F.any_value("in_").alias("in_"))
    pairs = classes.select(F.col("class_id").alias("a"), F.explode("own").alias("list_id")) \
        .join(classes.select(F.col("class_id").alias("b"), F.explode("in_").alias("list_id")), "list_id") \
        .select(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).distinct()
    edges = expand_classes(pairs, member.select("problem_id", "class_id")) \
        .select(F.col("p1").alias("src"), F.col("p2").alias("dst")) \
        .unionByName(alone.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    stubs = j.where(F.col("s_id").isNull()).groupBy("slug").agg(F.min("stitle").alias("title")) \
        .select(F.col("slug").alias("id"), F.coalesce("title", "slug").alias("title"),
                F.col("slug").alias("titleSlug"))
    return q.select("id", "title", "titleSlug").unionByName(stubs), edges


@dataclass
class SimilarLists:
    """C4 without its pairs: ``own`` (slug, list) and ``listed`` (list, slug); a slug's
    neighbours are the slugs of its own lists (and, on the undirected graph, those
    whose lists it stands in).  Lists are numbered."""
    own: DataFrame
    listed: DataFrame

    def by_slug(self) -> DataFrame:
        """slug, own lists, lists it stands in."""
        side = self.own.select("slug", "list", F.lit(True).alias("mine")) \
            .unionByName(self.listed.select("slug", "list", F.lit(False).alias("mine")))
        return side.groupBy("slug").agg(F.collect_set(F.when(F.col("mine"), F.col("list"))).alias("own"),
                                        F.collect_set(F.when(~F.col("mine"), F.col("list"))).alias("listed"))


def similar_slug_lists(questions: DataFrame, lists: DataFrame, undirected: bool = False) -> SimilarLists:
    """C4 from questions that name their list.  On the undirected graph of C1 an
    entry without a slug leaves an edge of the listing problem to itself."""
    own = questions.where("list_id is not null and titleSlug is not null").select(F.col("titleSlug").alias("slug"), "list_id").distinct()
    listed = lists.select("list_id", F.explode(F.from_json("similarQuestions", SIMILAR_SCHEMA)).alias("s")) \
        .select("list_id", F.col("s.titleSlug").alias("slug")).distinct()
    if undirected:
        alone = own.join(listed.where("slug is null"), "list_id", "left_semi") \
            .select("slug", F.concat(F.lit("alone "), F.col("slug")).alias("list_id"))
        own, listed = own.unionByName(alone), listed.unionByName(alone.select("list_id", "slug"))
    number = id_map(own, "list_id", "list")
    return SimilarLists(own.join(number, "list_id").select("slug", "list"),
                        listed.where("slug is not null").join(number, "list_id").select("list", "slug"))


def similar_slug_relation(questions: DataFrame, symmetric_: bool = True) -> DataFrame:
    """C4 straight from the question list: (src_slug, dst_slug) for every
    listed similar question; ``symmetric_`` adds the reverse direction."""
    rel = questions.select(F.col("titleSlug").alias("src_slug"),
                           F.explode(F.from_json("similarQuestions", SIMILAR_SCHEMA)).alias("s")) \
        .select("src_slug", F.col("s.titleSlug").alias("dst_slug"))
    if symmetric_:
        rel = rel.unionByName(rel.select(F.col("dst_slug").alias("src_slug"),
                                         F.col("src_slug").alias("dst_slug")))
    return rel.distinct()


def bipartite_tag_graph(problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Problem nodes, ``tag_<slug>`` nodes and problem->tag edges."""
    pt = problems.select(F.col("frontend_id").alias("pid"), "title", "problem_id",
                         F.explode(F.array_distinct("tags")).alias("tag"))
    tid = F.concat(F.lit("tag_"), F.regexp_replace("tag", "[^A-Za-z0-9]+", "-"))
    pnodes = problems.select(F.col("frontend_id").alias("id"), F.lit("problem").alias("type"),
                             "title", F.col("problem_id").alias("title_slug"))
    tnodes = pt.select(tid.alias("id"), F.lit("tag").alias("type"), F.col("tag").alias("title"),
                       F.lit(None).cast("string").alias("title_slug")).dropDuplicates(["id"])
    edges = pt.select(F.col("pid").alias("src"), tid.alias("dst")).distinct()
    return pnodes.unionByName(tnodes), edges


def _pairs_within(members: DataFrame, key: str, block_size: int) -> DataFrame:
    """(key, p1, p2, ...) for p1 < p2 sharing ``key``; each key's member list
    is cut into blocks of ``block_size`` so one task forms at most
    block_size^2 pairs even for a hot key."""
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    nb = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(block_size))).cast("int")
    m = members.join(sizes, key) \
        .withColumn("_nb", nb).withColumn("_b", (F.abs(F.xxhash64("problem_id")) % F.col("_nb")).cast("int"))
    rest = [c for c in members.columns if c not in (key, "problem_id")]
    every = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    left = m.select(key, F.col("problem_id").alias("p1"), *[F.col(c).alias(c + "1") for c in rest],
                    F.col("_b").alias("_bi"), every.alias("_bj"))
    right = m.select(key, F.col("problem_id").alias("p2"), *[F.col(c).alias(c + "2") for c in rest],
                     every.alias("_bi"), F.col("_b").alias("_bj"))
    return left.join(right, [key, "_bi", "_bj"]).where(F.col("p1") < F.col("p2")).drop("_bi", "_bj")


def tag_classes(problem_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Problems of equal tag sets as one class: (membership ``problem_id, class_id``,
    classes ``class_id, tags, members``).  The class id is the MD5 of the sorted
    tags, so membership needs no join."""
    ts = problem_tags.groupBy("problem_id").agg(F.sort_array(F.collect_set("tag")).alias("tags")) \
        .select("problem_id", F.md5(F.array_join("tags", "\x01").cast("binary")).alias("class_id"), "tags")
    classes = ts.groupBy("class_id").agg(F.any_value("tags").alias("tags"), F.count(F.lit(1)).alias("members"))
    return ts.select("problem_id", "class_id"), classes


def class_graph(classes: DataFrame, min_shared_tags: int = 1, block_size: int = 4096) -> DataFrame:
    """C3 / D7 between classes: (c1, c2, weight, similarity) with c1 <= c2, for
    classes that share at least ``min_shared_tags`` tags (a class with itself if it
    has two problems or more)."""
    own = classes.select(F.col("class_id").alias("problem_id"), "tags")
    if min_shared_tags <= 1:
        pairs = _pairs_within(own.select("problem_id", F.explode("tags").alias("tag")), "tag", block_size) \
            .groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("weight"))
    else:
        # a pair is made once, in the group of the first two tags that it shares
        n = F.size("tags")
        two = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.transform(
            F.slice("tags", i + 2, F.greatest(n - i - 1, F.lit(0))), lambda t: F.array(F.col("tags")[i], t))))
        members = own.where(n >= 2).select("problem_id", F.col("tags").alias("ts"), F.explode(two).alias("tp"))
        inter = F.array_intersect("ts1", "ts2")
        pairs = _pairs_within(members, "tp", block_size).where(F.col("tp") == F.slice(inter, 1, 2)) \
            .select("p1", "p2", F.size(inter).cast("long").alias("weight"))
    size = classes.select("class_id", F.size("tags").cast("long").alias("n"))
    across = pairs.where(F.col("weight") >= min_shared_tags) \
        .join(size.select(F.col("class_id").alias("p1"), F.col("n").alias("n1")), "p1") \
        .join(size.select(F.col("class_id").alias("p2"), F.col("n").alias("n2")), "p2") \
        .select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), "weight",
                (F.col("weight") / F.sqrt(F.col("n1") * F.col("n2"))).alias("similarity"))
    alike = classes.where((F.col("members") > 1) & (F.size("tags") >= min_shared_tags)).select(
        F.col("class_id").alias("c1"), F.col("class_id").alias("c2"), F.size("tags").cast("long").alias("weight"),
        F.lit(1.0).alias("similarity"))
    return across.unionByName(alike)


def expand_classes(pairs: DataFrame, membership: DataFrame, block_size: int = 4096) -> DataFrame:
    """Problem pairs ``p1 < p2`` of class pairs, other columns kept."""
    rest = [c for c in pairs.columns if c not in ("c1", "c2")]
    side = lambda c, p: membership.select(F.col("class_id").alias(c), F.col("problem_id").alias(p))
    across = pairs.where("c1 < c2").join(side("c1", "a"), "c1").join(side("c2", "b"), "c2") \
        .select(F.least("a", "b").alias("p1"), F.greatest("a", "b").alias("p2"), *rest)
    inside = _pairs_within(membership, "class_id", block_size).select("class_id", "p1", "p2") \
        .join(pairs.where("c1 = c2").select(F.col("c1").alias("class_id"), *rest), "class_id").select("p1", "p2", *rest)
    return across.unionByName(inside)


def shared_tag_graph(problem_tags: DataFrame, min_shared_tags: int = 1,
                     block_size: int = 4096) -> DataFrame:
    """(p1, p2, weight) with p1 < p2 and weight = number of shared tags,
    kept when weight >= min_shared_tags: :func:`class_graph` expanded to
    problems (output-bound; take the classes where they are enough)."""
    membership, classes = tag_classes(problem_tags)
    return expand_classes(class_graph(classes, min_shared_tags, block_size).drop("similarity"), membership, block_size)


def tag_cosine(problem_tags: DataFrame, block_size: int = 4096) -> DataFrame:
    """D7 (non-zero part): binary cosine = shared / sqrt(n1 * n2) for every
    pair that shares a tag, worked out once a class pair; pairs sharing nothing
    have cosine 0 and are not materialised (that part is a cross product)."""
    membership, classes = tag_classes(problem_tags)
    return expand_classes(class_graph(classes, 1, block_size).drop("weight"), membership, block_size)


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def slug_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """C4: neighbour relation in slug space (both directions), ignoring nodes
    without a slug."""
    slugs = nodes.where(F.col("titleSlug").isNotNull() & (F.col("titleSlug") != "")) \
        .select(F.col("id"), F.col("titleSlug").alias("slug"))
    s = symmetric(edges)
    a = slugs.select(F.col("id").alias("src"), F.col("slug").alias("src_slug"))
    b = slugs.select(F.col("id").alias("dst"), F.col("slug").alias("dst_slug"))
    return s.join(a, "src").join(b, "dst").select("src_slug", "dst_slug").distinct()


def slug_adjacency(slug_rel: DataFrame | SimilarLists) -> DataFrame:
    """C4 as sets: slug -> sorted neighbour slugs.  Of lists (both directions count)
    the slugs that have the same lists and stand in the same lists are one class,
    whose neighbours are gathered once."""
    if isinstance(slug_rel, SimilarLists):
        sides = slug_rel.by_slug().select("slug", F.sort_array("own").alias("own"), F.sort_array("listed").alias("listed"))
        name = F.md5(F.to_json(F.struct("own", "listed")).cast("binary")).alias("class_id")
        classes = sides.select(name, "own", "listed").groupBy("class_id").agg(
            F.any_value("own").alias("own"), F.any_value("listed").alias("listed"))
        met = classes.select("class_id", F.explode("own").alias("list")).join(slug_rel.listed, "list").select("class_id", "slug") \
            .unionByName(classes.select("class_id", F.explode("listed").alias("list")).join(slug_rel.own, "list").select("class_id", "slug"))
        return sides.select(name, F.col("slug").alias("src_slug")) \
            .join(met.groupBy("class_id").agg(F.sort_array(F.collect_set("slug")).alias("neighbors")), "class_id") \
            .select("src_slug", "neighbors")
    return slug_rel.groupBy("src_slug").agg(F.sort_array(F.collect_set("dst_slug")).alias("neighbors"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts (one row)."""
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(
        edges.agg(F.count(F.lit(1)).alias("n_edges")))


# ----------------------------------------------------------------- rerank G1-G3


def struggle_set(history: DataFrame, min_penalty: int = 1) -> DataFrame:
    """G1: (user_id, problem_id) with penalties >= min_penalty or unsolved."""
    return history.where((F.col("penalty_count") >= min_penalty) | ~F.col("solved")) \
        .select("user_id", "problem_id").distinct()


def graph_boost(candidates: DataFrame, struggles: DataFrame, slug_rel: DataFrame | SimilarLists,
                alpha: float = 0.05, symmetric_rel: bool = False) -> DataFrame:
    """Per (user_id, problem_id) candidate: alpha if the candidate is a
    neighbour of a struggle problem; else alpha/2 if one of the candidate's
    neighbours is a struggle problem; else 0.

    ``slug_rel`` is the directed neighbour relation (src_slug -> dst_slug); on
    a symmetric one (``symmetric_rel``) the half boost never applies.  As
    :class:`SimilarLists` no neighbours are listed: a candidate and a struggle
    problem meet in a list of one in which the other stands.
    """
    if isinstance(slug_rel, SimilarLists):
        return _graph_boost_lists(candidates, struggles, slug_rel, alpha, symmetric_rel)
    near = struggles.join(slug_rel, struggles.problem_id == slug_rel.src_slug) \
        .select("user_id", F.col("dst_slug").alias("problem_id")).distinct() \
        .withColumn("_full", F.lit(True))
    if symmetric_rel:
        return candidates.join(near, ["user_id", "problem_id"], "left") \
            .withColumn("boost", F.when(F.col("_full"), F.lit(alpha)).otherwise(F.lit(0.0))).drop("_full")
    back = candidates.select("user_id", "problem_id") \
        .join(slug_rel, F.col("problem_id") == F.col("src_slug")) \
        .join(struggles.select("user_id", F.col("problem_id").alias("dst_slug")),
              ["user_id", "dst_slug"], "left_semi") \
        .select("user_id", "problem_id").distinct().withColumn("_half", F.lit(True))
    j = candidates.join(near, ["user_id", "problem_id"], "left") \
        .join(back, ["user_id", "problem_id"], "left")
    boost = F.when(F.col("_full"), F.lit(alpha)).when(F.col("_half"), F.lit(alpha * 0.5)) \
        .otherwise(F.lit(0.0))
    return j.withColumn("boost", boost.cast("double")).drop("_full", "_half")


def _graph_boost_lists(candidates: DataFrame, struggles: DataFrame, lists: SimilarLists, alpha: float,
                       symmetric_rel: bool) -> DataFrame:
    # a user's problems are one row of arrays: nothing is exploded or ordered by list
    by = lists.by_slug().withColumnRenamed("slug", "problem_id")
    key = ["user_id", "problem_id"]
    rows = candidates.select(*key).distinct().withColumn("cand", F.lit(True)) \
        .join(struggles.select(*key).distinct().withColumn("hard", F.lit(True)), key, "full").join(by, "problem_id")
    of_hard = lambda c: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("hard"), F.col(c)))))
    mine = rows.repartition("user_id").groupBy("user_id").agg(
        F.collect_list(F.when(F.col("cand"), F.struct("problem_id", "own", "listed"))).alias("c"),
        of_hard("own").alias("hard_own"), of_hard("listed").alias("hard_listed"))
    mine = mine.where((F.size("hard_own") > 0) | (F.size("hard_listed") > 0)) \
        .select("user_id", once(F.struct("c", "hard_own", "hard_listed")).alias("m"))
    met = F.filter(F.transform("m.c", lambda x: F.struct(
        x["problem_id"].alias("problem_id"), F.arrays_overlap(x["listed"], F.col("m.hard_own")).alias("_full"),
        F.arrays_overlap(x["own"], F.col("m.hard_listed")).alias("_half"))), lambda x: x["_full"] | x["_half"])
    met = mine.select("user_id", F.explode(met).alias("x")).select("user_id", "x.problem_id", "x._full")
    full = F.col("_full").isNotNull() if symmetric_rel else F.col("_full")
    boost = F.when(full, F.lit(alpha)).when(F.col("_full").isNotNull(), F.lit(alpha * 0.5)).otherwise(F.lit(0.0))
    return candidates.join(met, ["user_id", "problem_id"], "left").withColumn("boost", boost.cast("double")).drop("_full")


def _clique_penalty_lists(selected: DataFrame, lists: SimilarLists, penalty: float, g: list[str]) -> DataFrame:
    # keys of a pick as an earlier and as a later one: itself, its own lists (even), lists it stands in (odd)
    by = lists.by_slug().withColumnRenamed("slug", "problem_id")
    name = lambda c, p: F.transform(F.coalesce(c, F.array().cast("array<bigint>")),
                                    lambda x: F.concat(F.lit(p), x.cast("string")))
    own, listed = F.col("own"), F.col("listed")
    me = F.array(F.concat(F.lit("="), F.col("problem_id")))
    keys = F.concat(F.transform(F.concat(me, name(own, "o"), name(listed, "i")), lambda k: F.struct(k.alias("key"), F.lit(True).alias("first"))),
                    F.transform(F.concat(me, name(listed, "o"), name(own, "i")), lambda k: F.struct(k.alias("key"), F.lit(False).alias("first"))))
    rows = selected.where(F.col("problem_id").isNotNull()).select(*g, "problem_id", "pos").distinct() \
        .join(by, "problem_id", "left").repartition(*g) \
        .select(*g, "problem_id", "pos", F.explode(keys).alias("k")).select(*g, "problem_id", "pos", "k.key", "k.first")
    earliest = F.min(F.when(F.col("first"), F.col("pos"))).over(Window.partitionBy(*g, "key"))
    hits = rows.withColumn("ppos", earliest).where(~F.col("first") & (F.col("ppos") < F.col("pos"))) \
        .select(*g, "problem_id", "pos").distinct().withColumn("_hit", F.lit(True))
    return selected.join(hits, [*g, "problem_id", "pos"], "left") \
        .withColumn("clique_penalty", F.when(F.col("_hit"), F.lit(penalty)).otherwise(0.0)).drop("_hit")


def clique_penalty(selected: DataFrame, slug_rel: DataFrame | SimilarLists, penalty: float = 0.02,
                   group: tuple[str, ...] = ("user_id", "tier")) -> DataFrame:
    """For each selected item (ordered by ``pos`` in its group), 0.02 if it
    equals or neighbours an item selected earlier in the same group."""
    g = list(group)
    if isinstance(slug_rel, SimilarLists):
        return _clique_penalty_lists(selected, slug_rel, penalty, g)
    a = selected.select(*g, F.col("problem_id").alias("cand"), F.col("pos").alias("cpos"))
    b = selected.select(*g, F.col("problem_id").alias("prev"), F.col("pos").alias("ppos"))
    # a pick's own slug and its neighbours, met with the earlier picks by key: no pairs within a group
    near = a.withColumn("prev", F.col("cand")).unionByName(
        a.join(slug_rel, F.col("cand") == F.col("src_slug")).select(*g, "cand", "cpos", F.col("dst_slug").alias("prev")))
    first = b.groupBy(*g, "prev").agg(F.min("ppos").alias("ppos"))
    hits = near.join(first, [*g, "prev"]).where(F.col("ppos") < F.col("cpos")) \
        .select(*g, "cand", "cpos").distinct().withColumn("_hit", F.lit(True))
    out = selected.join(hits.withColumnRenamed("cand", "problem_id").withColumnRenamed("cpos", "pos"),
                        g + ["problem_id", "pos"], "left")
    return out.withColumn("clique_penalty", F.when(F.col("_hit"), F.lit(penalty)).otherwise(0.0)) \
        .drop("_hit")
