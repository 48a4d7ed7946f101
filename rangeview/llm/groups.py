"""Connected components, and links inside buckets without all pairs of a bucket."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeview.llm.common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b); component is the smallest node of each.

    In each round a node points to the smallest of itself and its neighbours, pointers are followed to their end, and
    the ends become the nodes of the next round, with the edges between different ends only. A star is one node after
    one round; a round at least halves the nodes that still have edges. Each step is a written table; no link or label
    comes to the driver. Empty edges give an empty table; loops and repeated edges change nothing.
    """
    left = written(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    labels = None
    while True:
        ends = _followed(written(left.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("end"))))
        one = left.join(ends.select(F.col("node").alias("a"), F.col("end").alias("ea")), "a")
        two = one.join(ends.select(F.col("node").alias("b"), F.col("end").alias("eb")), "b")
        less = written(two.where("ea != eb").select(F.col("ea").alias("a"), F.col("eb").alias("b")).distinct())
        forget(left)
        if labels is None:
            new = written(ends.select("node", F.col("end").alias("component")))
        else:
            step = ends.select(F.col("node").alias("component"), "end")
            new = written(labels.join(step, "component", "left").select("node", F.coalesce("end", "component").alias("component")))
            forget(labels)
        forget(ends)
        left, labels = less, new
        if not left.limit(1).collect():
            forget(left)
            return labels


def _followed(points: DataFrame) -> DataFrame:
    """``points`` (node, end) with every end followed to a node that points to itself, as a written table."""
    while True:
        far = points.select(F.col("node").alias("end"), F.col("end").alias("far"))
        new = written(points.join(far, "end").select("node", F.col("far").alias("end"), (F.col("far") != F.col("end")).alias("moved")))
        forget(points)
        points = new
        if not points.where("moved").limit(1).collect():
            return points


def meeting(members: DataFrame) -> DataFrame:
    """``members`` (bucket, id, weight, sig) of buckets with more than one of them, and the bucket's size ``n``, as a written table."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return written(members.join(sizes, "bucket"))


def _mixed(rows: DataFrame, order) -> DataFrame:
    """The buckets of ``rows`` that hold several components, each with its head: the member that is first in ``order``."""
    head = F.min(F.struct(order.alias("order"), "id", "sig", "comp")).alias("head")
    return rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), head).where("lo < hi")


def _open_pairs(rows: DataFrame) -> float:
    """Pairs of different components that share a bucket, counted once for each bucket."""
    parts = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    return parts.agg(F.sum(((F.col("n") * F.col("n") - F.col("own")) / 2).cast("double")).alias("p")).first().p or 0


#: Rounds of heads at most; pairs of different components, for each row of a bucket, that the last step may look at without another round;
#: the share of these pairs that a round has to close for another one to follow.
ROUNDS, FEW, WORTH = 8, 1, 0.2


class _Found:
    """What the rounds have found: the pairs that were held against each other, and the components that the links make."""

    def __init__(self, verify: Callable[[DataFrame], DataFrame]):
        self.verify, self.pairs, self.components = verify, [], None

    def hold(self, pairs: DataFrame) -> None:
        """Verify those of ``pairs`` (a, b) that no round before has held against each other."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for tried in self.pairs:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs)
        self.pairs.append(pairs)
        if self.components is None or pairs.limit(1).collect():
            links = written(self.verify(pairs).select("a", "b"))
            if self.components is None:
                self.components = components(links)
            elif links.limit(1).collect():
                self._join(links)
            forget(links)

    def _join(self, links: DataFrame) -> None:
        """Take in more links: only what they connect of the components so far is worked out anew."""
        one = self.label(links.select(F.col("a").alias("id"), "b")).select(F.col("comp").alias("a"), F.col("b").alias("id"), "b")
        between = components(self.label(one).select("a", F.col("comp").alias("b")))
        step = between.select(F.col("node").alias("component"), F.col("component").alias("end"))
        moved = self.components.join(step, "component", "left").select("node", F.coalesce("end", "component").alias("component"))
        # a node whose first link this is stands for itself so far
        fresh = between.join(self.components.select("node"), "node", "left_anti").select("node", "component")
        new = written(moved.union(fresh))
        for t in (self.components, between):
            forget(t)
        self.components = new

    def label(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component of each id, its own id where it has no link."""
        rows = rows.drop("comp")
        if self.components is None:
            return rows.withColumn("comp", F.col("id"))
        own = self.components.select(F.col("node").alias("id"), "component")
        return rows.join(own, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")

    def close(self) -> DataFrame:
        for t in self.pairs:
            forget(t)
        return self.components


def _by_heads(found: _Found, rows: DataFrame, order, near, one: bool = False) -> None:
    """Hold each bucket's head against its members of other components; ``one``: each member only against the first of its heads."""
    current = found.label(rows)
    head = _mixed(current, order).select("bucket", F.col("head.order").alias("horder"), F.col("head.id").alias("hid"), F.col("head.sig").alias("hsig"), F.col("head.comp").alias("hcomp"))
    left = current.join(head, "bucket").where("comp != hcomp")
    if near is not None:
        left = left.where(near(F.col("sig"), F.col("hsig")))
    if one:
        left = left.groupBy("id").agg(F.min(F.struct("horder", "hid")).alias("h")).select("id", F.col("h.hid").alias("hid"))
    found.hold(left.select(F.col("id").alias("a"), F.col("hid").alias("b")))


def _by_pairs(found: _Found, rows: DataFrame, near, once=None) -> None:
    """Hold all members of different components of a bucket against each other, as far as ``near`` lets them; a pair that
    shares several buckets meets in the one that ``once`` tells."""
    current = found.label(rows)
    rest = current.join(_mixed(current, F.col("id")).select("bucket"), "bucket").select("bucket", "id", "sig", "comp")
    other = rest.select(F.col("bucket").alias("obucket"), F.col("id").alias("oid"), F.col("sig").alias("osig"), F.col("comp").alias("ocomp"))
    close = (F.col("id") < F.col("oid")) & (F.col("comp") != F.col("ocomp"))
    if near is not None:
        close = close & near(F.col("sig"), F.col("osig"))
    if once is not None:
        close = close & once(F.col("bucket"), F.col("sig"), F.col("osig"))
    found.hold(rest.join(other, (F.col("bucket") == F.col("obucket")) & close).select(F.col("id").alias("a"), F.col("oid").alias("b")))


def linked(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], near=None, narrow=None, once=None) -> DataFrame:
    """(node, component): the connected components that all verified pairs within buckets would make, as components() gives them.

    ``shared``: what meeting() gives of (bucket, id, weight, and what ``near`` looks at as struct ``sig``). ``verify`` takes distinct pairs
    (a, b), a < b, and returns those that are links. ``near``, if given, is a necessary condition on two sigs. ``narrow``,
    if given, takes the ids (id) that still share a bucket with another component and returns (members, near): buckets as
    for meeting() in which every two of these ids that are linked meet, and the condition that both then fulfil. ``once``, if
    given, tells of a bucket and two sigs whether it is the one of their shared buckets in which the pair is looked at.

    All pairs of a bucket are never formed. In each round one member of a bucket, its head, is held against those of
    other components (in the first round only once for each member): first the heaviest (copies, then the sum of the sizes of the buckets it is in: the middle of a
    cloud of near copies is in most), then one drawn by hash, another in each bucket and round, so that the parts of a
    cloud without a middle meet by many different pairs. Members that a round has linked belong to one component.
    With ``narrow`` the buckets serve one round of heads; what stays open goes on in the narrow buckets, where members
    without links mostly meet nobody. Rounds end when the pairs of different components that still share a bucket are few
    against the rows of the buckets, when a round has closed less than ``WORTH`` of them, or after ``ROUNDS``; those pairs that ``near`` lets through are all held against each
    other, so no link is lost.
    """
    found = _Found(verify)
    rank = shared.groupBy("id").agg(F.sum("n").alias("reach"))
    rows = written(shared.join(rank, "id").select("bucket", "id", "sig", F.struct(-F.col("weight"), -F.col("reach"), F.col("id")).alias("order")))
    # in a dense group nearly every pair is a link, so one head for each member spares most pairs
    _by_heads(found, rows, F.col("order"), near, one=True)
    _by_heads(found, rows, F.col("order"), near)
    tables = [rows]
    if narrow is not None:
        current = found.label(rows)
        left = written(current.join(_mixed(current, F.col("id")).select("bucket"), "bucket").select("id").distinct())
        members, near = narrow(left)
        rows = meeting(members)
        tables += [left, rows]
    n = rows.count()
    before = math.inf
    for k in range(1, ROUNDS):
        still = _open_pairs(found.label(rows))
        if still <= FEW * n or still > before * (1 - WORTH):
            break
        before = still
        _by_heads(found, rows, F.xxhash64("bucket", "id", F.lit(k)), near)
    _by_pairs(found, rows, near, once)
    for t in tables:
        forget(t)
    return found.close()
