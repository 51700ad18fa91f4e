"""Connected components, and components of a similarity join given its inverted lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlake.operators.prefilter import likely_among
from bidlake.session import cut, let_go, only_hinted_broadcasts

#: Links that are so few that rounds over them are a task's work, without exchanges: each exchange starts a thread of the driver's.
FEW_LINKS = 10_000


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node of (u, v) is a centre or has one centre: no u has two v's or is itself a v."""
    up, down = (F.struct(F.col(end).alias("node"), F.lit(a).alias("up"), F.lit(b).alias("down")) for end, a, b in (("u", 1, 0), ("v", 0, 1)))
    held = edges.select(F.explode(F.array(up, down)).alias("e")).select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not held.filter((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).head(1)


def _with_least(edges: DataFrame, few: bool) -> DataFrame:
    """(u, v, m) of (u, v): m is the least v of each u. Few edges are one partition, of which a window needs no exchange."""
    if few:
        return edges.withColumn("m", F.min("v").over(W.partitionBy("u")))
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u")


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node that it is connected with.

    Large and small stars alternate until only stars are left: a logarithmic number of rounds, each of which
    takes minima with map-side combining, so a hub with many neighbours is no group in one task. Each round is
    checkpointed, and what the round before left on disk is let go. Its joins are never broadcast, as many rounds' broadcasts, each
    with a thread, would pile up in the driver; up to FEW_LINKS edges are one partition, so that their rounds have no exchanges either.
    Loops and repeated edges don't matter; edges with a null end are left out; without edges there are no rows.
    """
    u, v = F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    stars = cut(edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).select(u, v).distinct())
    few = len(stars.select(F.lit(1)).take(FEW_LINKS + 1)) <= FEW_LINKS

    def kept(frame: DataFrame) -> DataFrame:
        return cut(frame).coalesce(1) if few else cut(frame)

    stars = stars.coalesce(1) if few else stars
    while not _only_stars(stars):
        both = stars.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = _with_least(both, few).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = kept(large.distinct())
        small = _with_least(large, few).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = kept(small.select("e.*").filter("u != v").distinct())
        del both, large, small
        let_go(edges.sparkSession)
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _joined(known: DataFrame, more: DataFrame) -> DataFrame:
    """The components ``known`` after further links: the old ones come as the stars that they are, not as their links."""
    return connected_components(known.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _open_members(shared: DataFrame, known: DataFrame) -> DataFrame:
    """(key, id, size, root, most): members of lists with several components; most is the largest one's root."""
    several = shared.filter("n > 2").select("key", "id", "size").join(known.withColumnRenamed("node", "id"), "id", "left")
    placed = cut(several.withColumn("root", F.coalesce("root", "id")))
    counts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    open_lists = counts.groupBy("key").agg(F.count(F.lit(1)).alias("_roots"), F.max(F.struct("n", "root")).alias("_most")).filter("_roots > 1")
    return cut(placed.join(open_lists.select("key", F.col("_most.root").alias("most")), "key"))


def list_components(
    postings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    plausible: Callable[[str, str], Column] | None = None,
    details: DataFrame | None = None,
    percent: int = 0,
    rounds: int = 2,
    prepare: Callable[[DataFrame], None] | None = None,
    bounds: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components of the links that ``verify`` finds among pairs that share a key: (node, root) of linked nodes.

    ``postings`` has (key, id), also rank if the leaders aren't to be the smallest ids, and size if linked ids are to have sizes of
    which the smaller is at least ``percent`` % of the larger; without ranks, repeated rows count as one. ``details`` has what ``plausible`` needs of each id; ``verify`` takes
    distinct pairs (a, b), a < b, and returns those that are links. First each list's leader, of the smallest (rank, id), is held
    against its other members: as many pairs as postings. Where a list's members are then in one component, no further link
    could join anything. In the other lists, each member outside of the list's largest component is held against all members of other
    components that ``plausible`` (of the two sides' aliases) allows. So every pair of a list is verified, ruled out, or known
    to be in one component already. Before that, ``rounds`` times a member drawn from each list's largest component is held against those
    outside of it: where many are alike, each has links with many, and most are found without holding all against all.

    ``prepare`` gets (id) of all ids that share a key before any pair is verified. ``bounds`` is for links that are those of a distance of
    at most 100 - ``percent`` % of the larger size: of pairs (a, b) it gives (a, b, lo, hi), between which the distance lies. With it, pairs of
    a list that has many are ruled out by their distances from one member, so that what is verified grows with members, not with pairs.
    """
    with only_hinted_broadcasts(postings.sparkSession):
        return _list_components(postings, verify, plausible, details, percent, rounds, prepare, bounds)


def _not_ruled_out(pairs: DataFrame, members: DataFrame, bounds: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Those of the pairs (key, a, b, most) that the triangle inequality leaves; most is the largest size of a pair.

    Where a list has more than twice as many pairs as members, both ends are measured against one member of its largest component: two
    ends whose distances from it are further apart than a link allows are no link.
    """
    drawn = F.min(F.when(F.col("root") == F.col("most"), F.struct(F.xxhash64("id").alias("draw"), "id")))
    lists = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), drawn.alias("_drawn")).select("key", "_n", F.col("_drawn.id").alias("hub"))
    held = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("_pairs")).join(lists, "key")
    hubs = cut(held.filter("_pairs > 2 * _n").select("key", "hub"))
    if not hubs.head(1):
        return pairs
    pairs = cut(pairs.join(hubs, "key", "left"))
    ends = pairs.filter("hub is not null").select("hub", F.explode(F.array("a", "b")).alias("id")).distinct()
    asked = ends.filter("id != hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    found = cut(bounds(asked))
    turned = F.explode(F.array(F.struct(F.col("a").alias("hub"), F.col("b").alias("id")), F.struct(F.col("b").alias("hub"), F.col("a").alias("id")), F.struct(F.col("a").alias("hub"), F.col("a").alias("id"))))
    apart = found.select(turned.alias("e"), "lo", "hi").select("e.*", F.when(F.col("e.hub") == F.col("e.id"), 0).otherwise(F.col("lo")).alias("lo"), F.when(F.col("e.hub") == F.col("e.id"), 0).otherwise(F.col("hi")).alias("hi")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(apart.select("hub", F.col("id").alias(end), F.col("lo").alias(f"lo_{end}"), F.col("hi").alias(f"hi_{end}")), ["hub", end], "left")
    further = F.greatest(F.col("lo_a") - F.col("hi_b"), F.col("lo_b") - F.col("hi_a"))
    return pairs.filter(F.coalesce(100 * further <= (100 - percent) * F.col("most"), F.lit(True)))


def _list_components(
    postings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    plausible: Callable[[str, str], Column] | None,
    details: DataFrame | None,
    percent: int,
    rounds: int,
    prepare: Callable[[DataFrame], None] | None,
    bounds: Callable[[DataFrame], DataFrame] | None,
) -> DataFrame:
    if "size" not in postings.columns:
        postings = postings.withColumn("size", F.lit(1))
    ranked = "rank" in postings.columns

    def fits(x: str, y: str) -> Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    if not ranked:  # few of many keys have a second member; two numbers a key find them
        several = postings.groupBy("key").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).filter("_low < _high").select("key")
        several = cut(several)
        let_go(postings.sparkSession)
        postings = cut(likely_among(postings, F.col("key"), several, "key").join(several, "key").select("key", "id", "size").distinct())
        del several
    else:  # lists and members are both made of them
        postings = cut(postings)
        let_go(postings.sparkSession)
    lead = F.min(F.struct("rank", "id", "size")) if ranked else F.min(F.struct("id", "size"))
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), lead.alias("lead")).filter("n > 1")
    lists = lists.select("key", "n", F.col("lead.id").alias("leader"), F.col("lead.size").alias("leader_size"))
    shared = cut(postings.select("key", "id", "size").join(lists, "key").filter("id != leader"))
    let_go(postings.sparkSession)
    if prepare is not None:
        prepare(cut(postings.select("id").distinct()))
    ends = F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")
    links = cut(verify(shared.filter(fits("size", "leader_size")).select(*ends).distinct()).select("a", "b"))
    known = connected_components(links)
    del links
    let_go(postings.sparkSession)
    for turn in range(rounds):
        members = _open_members(shared, known)
        drawn = F.min(F.when(F.col("root") == F.col("most"), F.struct(F.xxhash64(F.lit(turn), "key", "id").alias("draw"), "id", "size")))
        rest = members.filter("root != most").join(members.groupBy("key").agg(drawn.alias("other")), "key")
        rest = rest.filter(fits("size", "other.size")).select(F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b")).distinct()
        more = cut(verify(rest).select("a", "b"))
        if not more.head(1):
            break
        known = _joined(known, more)
        del members, rest, more
        let_go(postings.sparkSession)
    members = _open_members(shared, known)
    marks = members.groupBy("id").agg(F.sort_array(F.collect_set(F.hash("key"))).alias("_marks"))  # as many as an id has keys
    members = cut(members.join(marks if details is None else details.join(marks, "id"), "id"))
    x, y = members.filter("root != most").alias("x"), members.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.most")) | (F.col("x.id") < F.col("y.id")))
    apart &= fits("x.size", "y.size")
    if plausible is not None:
        apart &= plausible("x", "y")
    # A pair comes by the first two keys that both have, not by all: two, as the marks of different keys may be equal, once in 10^7 pairs.
    apart &= F.array_contains(F.slice(F.array_intersect("x._marks", "y._marks"), 1, 2), F.hash("x.key"))
    rest = x.join(y, apart).select(F.col("x.key").alias("key"), F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.greatest("x.size", "y.size").alias("most"))
    if bounds is not None:
        rest = _not_ruled_out(cut(rest), members, bounds, percent)
    more = cut(verify(rest.select("a", "b").distinct()).select("a", "b"))
    return _joined(known, more) if more.head(1) else known
