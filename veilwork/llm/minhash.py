"""Near-duplicates by bottom-k sketches from one hash function.

A document is the set of hashes of its word shingles; its sketch is the
smallest of them.  Documents that share one of their first sketch values meet
in that value's inverted list.  Of such pairs the sketch of the union (the
smallest values of both sketches) gives an estimate, which drops pairs far
below the limit; what is left is verified on the full sets.

Texts with equal sets are one class from the start.  Sketch values that many
classes share are warm, the others cold.  Each class is listed under its first
cold values; these lists are short, and all pairs in them are candidates.  That
covers every class at least half of whose sketch is cold: what it shares with a
near copy cannot be warm alone.  The other classes, made of content that many
share, are also listed under each three sketch values in a row (small sets,
under their warm values), if they can have a link at all: what a class shares
with any other is at most what it has of the values that others have too, and that
has to be enough for the sizes of the two.  A near copy with more edits than the
limit allows is told by its own words so, and is compared with nothing.  In a list
each class first meets one pivot, that of the list with the least share of values of
its own, as one order of all classes has it; where the links found so join all classes of the list, nothing more is to
be found there.  In the other lists the classes meet pivots that stand for the
largest components there, in turns, each after the links of the turn before.  Of
what is still apart then, the classes outside the largest component meet all others
of the list, once for each pair (in the smallest of the lists that both are in), and only
pairs that the estimate passes leave the join.  So no pair is left out by a
limit, and copies by the thousand cost a few comparisons each.

A pair at 0.85 shares each of the listed values with probability 0.65 or more
(both halves of a set count), so it meets in none of 16 lists with probability
under 0.35**16; a pair of warm content has no three shared values in a row among
48 with probability under 1e-7; sets of up to 48 are covered for certain.  The
estimate is passed over at five standard deviations.  Hashes have 64 bits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilwork.llm.common import cut, join_small, words
from veilwork.llm.components import components

LISTED = 16
SKETCH = 48
#: Classes that share a cold value at most.
FEW = 32
#: Pivots of a list that one of them has not joined, and how often others are tried.
PIVOTS = 8
TURNS = 1
#: Sketch values in a row that classes of warm content are listed under, from this many shingles on.
RUN = 3
SMALL = 24
#: Smallest hashes (whole sets, mostly) by which classes are compared that pivots have not joined.
WIDE = 256


def shingles(text: Column, n: int) -> Column:
    """Hashes of the distinct shingles, smallest first; A-Z count as a-z."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.get(F.transform(F.array(words(low)), lambda w: (
        F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) < n, F.array(F.xxhash64(w)))
        .otherwise(F.array_sort(F.array_distinct(F.transform(
            F.sequence(F.lit(0), F.size(w) - n),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]),
        ))))
    )), F.lit(0))


def _class(h: Column) -> Column:
    """128 bits of the whole set."""
    return F.concat(F.hex(F.xxhash64(h)), F.lit("-"), F.hex(F.xxhash64(F.lit(7), h)))


def _sized(percent: int) -> Column:
    return 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")


def _ordered() -> list[Column]:
    return [F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")]


def _whole() -> Column:
    """Both sketches are whole sets, so the estimate is the similarity itself."""
    return (F.col("n1") <= SKETCH) & (F.col("n2") <= SKETCH)


def _near(percent: int) -> Column:
    """Whether the sketch of the union of ``s1`` and ``s2`` allows a link."""
    t = percent / 100
    slack = 5 * (t * (1 - t) / SKETCH) ** 0.5

    def judge(union: Column) -> Column:
        seen = F.when(_whole(), F.size(union)).otherwise(F.least(F.size(union), F.lit(SKETCH)))
        shared = F.size(F.array_intersect(F.slice(union, F.lit(1), seen), F.array_intersect("s1", "s2")))
        return F.when(_whole(), 100 * shared >= percent * seen).otherwise(shared >= (t - slack) * seen)

    return F.get(F.transform(F.array(F.array_sort(F.array_union("s1", "s2"))), judge), F.lit(0))


def _least_wide(percent: int) -> float:
    """The share of a wide sketch that a link leaves in both, less five standard deviations."""
    t = percent / 100
    return t - 5 * (t * (1 - t) / WIDE) ** 0.5


def _near_wide(percent: int) -> Column:
    """The same of the upper halves of up to ``WIDE`` hashes, in the same order.

    Halves that fall together make sets look more alike, or some values smaller:
    ``x`` values of whole sets, as counted; one more is allowed of others.
    """
    both = F.size(F.array_intersect("s1", "s2")) + F.least("x1", "x2")
    whole = (F.col("n1") <= WIDE) & (F.col("n2") <= WIDE)

    def judge(union: Column) -> Column:
        seen = F.least(F.size(union), F.lit(WIDE))
        shared = F.size(F.array_intersect(F.slice(union, F.lit(1), seen), F.array_intersect("s1", "s2")))
        return shared + 1 >= _least_wide(percent) * seen

    sketched = F.get(F.transform(F.array(F.array_sort(F.array_union("s1", "s2"))), judge), F.lit(0))
    return F.when(whole, 100 * both >= percent * (F.col("n1") + F.col("n2") - both)).otherwise(sketched)


def _may(percent: int, n1: Column, n2: Column, w: Column) -> Column:
    """Whether ``_near_wide`` may pass sets of these sizes that share ``w`` values at most."""
    whole = F.greatest(n1, n2) <= WIDE
    return F.when(whole, (100 + percent) * w >= percent * (n1 + n2)).otherwise(w + 1 >= _least_wide(percent) * (WIDE - 1))


def _may_any(percent: int, n: Column, w: Column, low: Column) -> Column:
    """The same beside any set of ``low`` values or more that is not too small for a link."""
    small = (100 + percent) * w >= percent * (n + F.greatest(low, F.ceil(percent * n / 100)))
    large = (100 * n > percent * WIDE) & (w + 1 >= _least_wide(percent) * (WIDE - 1))
    return ((n <= WIDE) & small) | large


def _high(x: Column) -> Column:
    """The upper halves of hashes."""
    return F.transform(x, lambda v: F.shiftright(v, 32).cast("int"))


def _numbered(df: DataFrame, x: int, **more: str) -> DataFrame:
    names = {"c": "c", "n": "n", **more}
    return df.select("g", *[F.col(c).alias(f"{short}{x}") for c, short in names.items()])


class _Search:
    def __init__(self, docs: DataFrame, classes: DataFrame, n: int, percent: int):
        self.docs, self.classes, self.n, self.percent = docs, classes, n, percent

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(c, h) with the whole sets of the wanted classes (c, id), from the texts of their ids."""
        ids = cut(wanted.select(F.col("id").alias("wanted_id")).distinct(), "near-ids")
        again = self.docs.join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
        sets = again.select(shingles(F.col("t"), self.n).alias("h")).select(_class(F.col("h")).alias("c"), "h")
        return sets.join(wanted.select("c"), "c", "left_semi").groupBy("c").agg(F.first("h").alias("h"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The candidate pairs that are links."""
        side = lambda name, x: self.classes.select(
            F.col("c").alias(name), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("id").alias(f"id{x}")
        )
        met = pairs.join(side("a", 1), "a").join(side("b", 2), "b")
        met = cut(met.where(_near(self.percent)).select("a", "b", "id1", "id2", _whole().alias("whole")), "near-met")
        open_ = met.where("NOT whole")
        sure = met.where("whole").select("a", "b")
        wanted = cut(
            open_.select(F.col("a").alias("c"), F.col("id1").alias("id"))
            .unionByName(open_.select(F.col("b").alias("c"), F.col("id2").alias("id"))).distinct(),
            "near-wanted",
        )
        sets = cut(self.sets(wanted), "near-sets")
        full = open_.select("a", "b").join(sets.select(F.col("c").alias("a"), F.col("h").alias("h1")), "a")
        full = full.join(sets.select(F.col("c").alias("b"), F.col("h").alias("h2")), "b")
        both = F.size(F.array_intersect("h1", "h2"))
        full = full.select("a", "b", both.alias("i"), (F.size("h1") + F.size("h2")).alias("s"))
        linked = full.where(100 * F.col("i") >= self.percent * (F.col("s") - F.col("i"))).select("a", "b")
        return cut(sure.unionByName(linked), "near-links")

    def tagged(self) -> DataFrame:
        """Classes with their cold and warm sketch values, smallest first."""
        values = self.classes.select(F.explode("sketch").alias("v"))
        warm = cut(
            values.groupBy("v").agg(F.count("*").alias("k")).where(F.col("k") > FEW)
            .select("v", F.lit(True).alias("warm")),
            "near-warm",
        )
        # dealt by class first, so that the values of a class come together again where they are
        each = self.classes.repartition("c").select("c", "n", F.explode("sketch").alias("v"))
        each = join_small(each, warm, ["v"], "left")
        sorted_ = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("v"))))
        return cut(
            each.groupBy("c").agg(
                F.first("n").alias("n"), sorted_(F.col("warm").isNull()).alias("cold"),
                sorted_(F.col("warm").isNotNull()).alias("warm"),
            ),
            "near-tagged",
        )

    def listed(self) -> Column:
        """What a class of warm content is listed under: each three sketch values in a row;
        of a small set, its warm values.  In between, where the two kinds must meet, both."""
        runs = F.transform(
            F.sequence(F.lit(0), F.size("s") - RUN),
            lambda i: F.xxhash64(*[F.get("s", i + j) for j in range(RUN)]),
        )
        empty = F.array().cast("array<bigint>")
        large = F.when(F.col("n") >= SMALL, runs).otherwise(empty)
        small = F.when(F.col("n") <= SMALL * 100 // self.percent + 1, F.slice("warm", 1, LISTED)).otherwise(empty)
        return F.array_distinct(F.concat(large, small))

    def wide(self, warm: DataFrame) -> DataFrame:
        """(c, n, s, same, w, listed): upper halves of the smallest hashes, how many of them come again, how
        many others have too, so that no link shares more, and what the class is listed under."""
        wanted = cut(warm.select("c").join(self.classes.select("c", "id"), "c"), "near-warm-ids")
        wide = self.sets(wanted).select("c", _high(F.slice("h", 1, WIDE)).alias("s"), F.xxhash64("c").alias("o"))
        wide = cut(wide, "near-halves")
        values = wide.select("o", F.explode("s").alias("v")).groupBy("v").agg(F.min("o").alias("o"), F.count("*").alias("k"))
        own = cut(values.where("k = 1").groupBy("o").agg(F.count("*").alias("own")), "near-own")
        wide = wide.join(own, "o", "left").join(warm, "c")
        again = F.size("s") - F.size(F.array_distinct("s"))
        shared = F.size("s") - F.coalesce("own", F.lit(0))
        return cut(wide.select("c", "n", "s", again.alias("same"), shared.alias("w"), "listed"), "near-wide")

    def lists(self, wide: DataFrame) -> DataFrame:
        """(g, c, n, w, pivot): the entries of lists, of the classes that may have a link there.

        ``pivot`` is the class of the list with the least share of values of its own;
        the order is one for all lists, so that lists agree on it.
        """
        n, w = F.col("n"), F.col("w")
        placed = wide.where(_may_any(self.percent, n, w, F.lit(0))).select("c", "n", "w", F.explode("listed").alias("g"))
        placed = cut(placed, "near-listed")
        order = F.struct((-w / F.least(n, F.lit(WIDE))).alias("o"), F.xxhash64("c").alias("h"), "c", "n", "w")
        lists = placed.groupBy("g").agg(F.count("*").alias("k"), F.min("n").alias("low"), F.min(order).alias("pivot"))
        met = placed.join(lists.where("k > 1").drop("k"), "g").where(_may_any(self.percent, n, w, F.col("low")))
        return cut(met.select("g", "c", "n", "w", "pivot"), "near-warm-lists")

    def unsettled(self, lists: DataFrame, roots: DataFrame) -> DataFrame:
        """The entries, with root, of the lists that hold several roots, and each list's top root."""
        placed = lists.join(roots, lists["c"] == roots["node"], "left").withColumn("root", F.coalesce("root", "c"))
        placed = cut(placed.select("g", "c", "n", "w", "root"), "near-placed")
        parts = placed.groupBy("g", "root").agg(F.count("*").alias("k"))
        parts = parts.groupBy("g").agg(F.max(F.struct("k", "root"))["root"].alias("top"), F.count("*").alias("k"))
        return cut(placed.join(parts.where("k > 1").select("g", "top"), "g"), "near-unsettled")

    def renamed(self, entries: DataFrame, roots: DataFrame) -> DataFrame:
        """The same entries, with what their roots and the lists' top roots have become."""
        for at in ("root", "top"):
            now = roots.select(F.col("node").alias(at), F.col("root").alias("now"))
            entries = entries.join(now, at, "left").withColumn(at, F.coalesce("now", at)).drop("now")
        return cut(entries, "near-unsettled")

    def pivoted(self, entries: DataFrame, pivots: int, turn: int) -> DataFrame:
        """(a, b): each class outside a list's top root beside the list's pivots of other roots.

        Pivots stand for the ``pivots`` roots that most classes of the list have.
        They come as one array for each list, so a list entry is one row, and a
        class that meets a pivot in many lists takes it once.  A class of the top
        root need not look for the others: they look for it.
        """
        stands = F.min(F.struct(F.xxhash64("c", F.lit(turn)).alias("h"), "c", "n", "root", "w")).alias("p")
        first = entries.groupBy("g", "root").agg(F.count("*").alias("k"), stands)
        order = Window.partitionBy("g").orderBy(F.desc("k"), F.col("p.h"), F.col("p.c"))
        first = first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= pivots)
        arrays = first.groupBy("g").agg(F.collect_list(F.struct("p.c", "p.n", "p.root", "p.w")).alias("ps"))
        fits = lambda p: (p["root"] != F.col("root")) & (
            100 * F.least("n", p["n"]) >= self.percent * F.greatest("n", p["n"])
        ) & _may(self.percent, F.col("n"), p["n"], F.least("w", p["w"]))
        met = entries.where("root != top").join(arrays, "g").select("c", F.filter("ps", fits)["c"].alias("ps"))
        met = met.groupBy("c").agg(F.array_distinct(F.flatten(F.collect_list("ps"))).alias("ps"))
        return met.select(F.col("c").alias("c1"), F.explode("ps").alias("c2")).select(*_ordered())

    def run(self) -> DataFrame:
        """(node, root) of the classes with links."""
        tagged = self.tagged()
        cold = tagged.select("c", "n", F.explode(F.slice("cold", 1, LISTED)).alias("g"))
        found = _numbered(cold, 1).join(_numbered(cold, 2), "g").where((F.col("c1") < F.col("c2")) & _sized(self.percent))
        found = found.select(*_ordered())
        warm = cut(
            tagged.where(F.size("warm") > F.size("cold")).select(
                "c", "n", F.array_sort(F.concat("cold", "warm")).alias("s"), "warm"
            ).select("c", "n", self.listed().alias("listed")),
            "near-warm-classes",
        )
        if warm.isEmpty():
            return components(self.links(cut(found.distinct(), "near-pairs")))
        wide = self.wide(warm)
        lists = self.lists(wide)
        may = _may(self.percent, F.col("n1"), F.col("n2"), F.least("w1", "w2"))
        # first one pivot a list
        starred = lists.select(*[F.col(c).alias(f"{c}1") for c in "cnw"], *[F.col(f"pivot.{c}").alias(f"{c}2") for c in "cnw"])
        starred = starred.where((F.col("c1") != F.col("c2")) & _sized(self.percent) & may)
        pairs = found.unionByName(starred.select(*_ordered())).distinct()
        links = self.links(cut(pairs, "near-pairs"))
        roots = components(links)
        if lists.isEmpty():
            return roots
        open_ = self.unsettled(lists, roots)
        for turn in range(1, TURNS + 1):
            new = self.links(cut(self.pivoted(open_, PIVOTS, turn).distinct(), "near-pairs"))
            if new.isEmpty():
                break
            links = links.unionByName(new)
            roots = components(links)
            open_ = self.renamed(open_, roots)
        if open_.isEmpty():
            return roots
        open_ = open_.join(wide.select("c", "s", "same", _high(F.col("listed")).alias("listed")), "c")
        more = {"s": "s", "listed": "l", "root": "r", "w": "w", "same": "x"}
        outside = _numbered(open_.where("root != top"), 1, **more)
        # both may be outside; then the pair is met from either side, and one is enough
        inside = _numbered(open_.withColumn("top", F.col("root") == F.col("top")), 2, **more, top="top")
        rest = outside.join(inside, "g").where(
            (F.col("r1") != F.col("r2")) & (F.col("top2") | (F.col("c1") < F.col("c2"))) & _sized(self.percent) & may
            & (F.array_min(F.array_intersect("l1", "l2")) == F.shiftright("g", 32)) & _near_wide(self.percent)
        )
        rest = cut(rest.select(*_ordered()).distinct(), "near-rest")
        if rest.isEmpty():
            return roots
        return components(links.unionByName(self.links(rest)))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``key``, n_shingles, component_id (smallest key of the component) and kept, per document.

    Documents are linked if their sets of ``n``-word shingles share at least
    ``percent`` % of their union.  With fewer words the whole sequence is the
    one shingle.  Null and empty texts and texts without a word have an empty
    set and are linked with nothing: each is its own component.  Rows with a
    null key take part; a component of such rows alone has a null id, and a
    null key is kept only there.  Repeated rows are one class.  An empty table
    gives an empty one; other columns are not read.
    """
    base = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t"))
    light = base.select("id", F.explode(F.array(shingles(F.col("t"), n))).alias("h")).select(
        "id", F.size("h").cast("long").alias("n"), _class(F.col("h")).alias("c"),
        F.slice("h", 1, SKETCH).alias("sketch"),
    )
    light = cut(light, "near-sketches")
    classes = cut(
        light.where("n > 0").groupBy("c").agg(
            F.first("n").alias("n"), F.min("id").alias("id"), F.first("sketch").alias("sketch")
        ),
        "near-classes",
    )
    roots = _Search(base, classes, n, percent).run()
    named = classes.select("c", "id").join(roots, F.col("c") == F.col("node"), "left")
    named = cut(named.select("c", "id", F.coalesce("root", "c").alias("root")), "near-named")
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = cut(named.join(smallest, "root").select("c", "component_id"), "near-components")
    full = light.where("n > 0").select("id", "n", "c").join(named, "c").select("id", "n", "component_id")
    empty = light.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.unionByName(empty).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
