"""MinHash near-dedup by an inverted join over signature coordinates.

Documents with equal shingle sets form one class; only classes are compared. A class is posted under (coordinate, value) of its
K-coordinate MinHash signature. A pair whose Jaccard similarity reaches the threshold matches in at least needed(percent) coordinates
but for a chance of at most MISS, so it shares one of the K - needed + 1 rarest coordinate values of both: only that prefix is posted,
and values that one class alone holds are never shuffled again. Merging skips: in each posting list the class whose own lists are
longest, the hub, is compared with the rest, and pairs already in one component are never formed.

A large group of near copies may still hold many components. Its members are then described by their edits, the shingles in which they
differ from the group's consensus (`gathered`). Sizes and shared edits decide a link exactly, so texts are not read again: one star
comparison finds all pairs that are linked whatever they share, and the others come from an inverted join over the rarest edits
(`posted_edits`). Who is outside the star's component is first gathered again with those of the same commonest edit (`parted`), around a
consensus of their own, so a variant that many members share costs no pairs either. The work follows the number of edits and not the square of the group. Pairs of a list that have no hub in common are met in the list itself, each pair once, if
they collide in enough coordinates and their sizes allow it. What passes is confirmed on full shingle sets.
Links, components and signatures stay in DataFrames; nothing of the size of the corpus reaches the driver.

Ids are integers. Defined results: words are runs of other than [\\x20\\x09-\\x0D] after A-Z are lower-cased; fewer words than a
shingle make one shingle of all. Null, empty or blank texts have an empty set, link with nothing and are kept. A null doc_id orders
last. Rows that share a doc_id are one document. Repeated rows are exact copies. Empty tables and very long texts work. Ties do not
occur: a component is named by its smallest doc_id. Other columns are not returned, whatever their names. Node keys are 64-bit hashes of
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm import common
from seekspark.llm.hashing import BASE, mix, shingle_sets

WORDS, COORDINATES = 5, 32
MISS = 1e-7  # the greatest chance that a pair just at the threshold is not compared
NEAR_HUB = 5  # matches with a hub from which a class is compared with it
NEAR = 30  # percent of similarity to a hub from which a class is described by its edits of it
LEVELS = 2  # how often a group is parted by its commonest edits
LAST = 2**63 - 1
_SEEDS = np.random.default_rng(11).integers(1, 2**63, (2, COORDINATES), dtype=np.uint64) | np.uint64(1)


def missed(percent: int, need: int) -> float:
    """The chance that a pair of that similarity matches in fewer than `need` coordinates."""
    p = percent / 100
    return sum(comb(COORDINATES, i) * p**i * (1 - p) ** (COORDINATES - i) for i in range(need))


def needed(percent: int) -> int:
    """The most matching coordinates that can be asked of pairs at the threshold within MISS."""
    need = max((n for n in range(1, COORDINATES + 1) if missed(percent, n) <= MISS), default=0)
    if not need:
        raise ValueError(f"{COORDINATES} coordinates miss pairs of {percent} percent with a chance over {MISS}")
    return need


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a sorted set."""
    n = np.array([len(hashes)], np.uint64)
    a = mix(np.add.reduce(mix(hashes), keepdims=True) + n * BASE)
    b = mix(np.bitwise_xor.reduce(mix(hashes * BASE), keepdims=True) + n)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def signature(hashes: np.ndarray) -> np.ndarray:
    """The 32-bit minimum of each coordinate, in blocks so that very long texts need little memory."""
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1 << 14):
        h = hashes[i : i + (1 << 14)]
        for k in range(COORDINATES):
            low[k] = min(low[k], ((h ^ _SEEDS[0, k]) * _SEEDS[1, k]).min())
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for s in shingle_sets(b["_text"].tolist(), n):
            rows.append((len(s), *set_key(s), signature(s)) if len(s) else (0, 0, 0, None))
        yield pd.DataFrame({"did": b["did"].to_numpy(np.int64), **dict(zip(("n", "s1", "s2", "sig"), zip(*rows), strict=False)), "ord": b["ord"].astype("Int64")}) if rows else pd.DataFrame({"did": [], "n": [], "s1": [], "s2": [], "sig": [], "ord": []})


def _compared(batches: Iterator[pd.DataFrame], n: int, percent: int) -> Iterator[pd.DataFrame]:
    """Exact comparison of a (a hub, or any text) with b: linked or not, near or not, sizes, and in what shingles they differ."""
    held: tuple = (None, None)
    for batch in batches:
        rows = []
        for a, b, ta, s in zip(batch["a"], batch["b"], batch["ta"], shingle_sets(batch["tb"].tolist(), n)):
            if held[0] != a:
                held = (a, next(shingle_sets([ta], n)))
            edits = np.setxor1d(s, held[1], assume_unique=True)
            either = (len(s) + len(held[1]) + len(edits)) // 2
            both = either - len(edits)
            near = 100 * both >= NEAR * either
            rows.append((a, b, 100 * both >= percent * either, near, len(held[1]), len(s), edits.view(np.int64) if near else None))
        yield pd.DataFrame(rows, columns=["a", "b", "linked", "near", "na", "nb", "edits"])


def _own(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Of the texts under a doc_id, those of the class itself."""
    for b in batches:
        yield b[[bool(len(s)) and set_key(s)[0] == x for s, x in zip(shingle_sets(b["t"].tolist(), n), b["node"])]]


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): the least label of each node's component, by least-label propagation with pointer jumping.

    nodes: (node, label) with labels distinct or shared by nodes that belong together. links: (a, b). Each step runs in as many tasks as
    the links need, since few links over many tasks would leave mostly empty shuffle files.
    """
    spark = nodes.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = common.saved(both, "links")
    tasks = max(6, both.count() // 20_000)
    small = lambda df: df.coalesce(tasks)
    state = common.saved(small(nodes.select("node", "label", F.col("label").alias("comp"))), "components")
    held = [state]
    while True:
        near = small(both.join(state.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b")).groupBy("a").agg(F.min("c").alias("least"))
        step = state.join(small(near).withColumnRenamed("a", "node"), "node", "left").withColumn("next", F.least("comp", F.coalesce("least", "comp")))
        step = common.saved(small(step), "hop")
        roots = small(step.groupBy(F.col("label").alias("next")).agg(F.min("next").alias("up")))
        jump = step.join(roots, "next", "left").select("node", "label", F.coalesce("up", "next").alias("comp"), (F.coalesce("up", "next") != F.col("comp")).alias("moved"))
        jump = common.saved(small(jump), "components")
        common.discard(step, *held)
        held = [jump]
        state = jump.select("node", "label", "comp")
        done = jump.where("moved").isEmpty()
        common.tidy(spark)
        if done:
            common.discard(both)
            return state


def mixed(rows: DataFrame, *key: str) -> DataFrame:
    """The rows of those keys that still hold more than one component."""
    return rows.join(rows.groupBy(*key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(*key), [*key])


class Links:
    """The component of each class so far. New links are joined on components, so only components that grow are worked on."""

    def __init__(self, classes: DataFrame):
        self.state = classes.select("node", F.col("label").alias("comp"))

    def add(self, sure: DataFrame) -> None:
        """sure: (a, b), written already."""
        at = lambda x: self.state.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
        common.tidy(self.state.sparkSession)
        links = common.saved(sure.join(at("a"), "a").join(at("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "new_links")
        if links.isEmpty():
            return
        nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
        grown = components(nodes.select("node", F.col("node").alias("label")), links)
        grown = grown.where("node <> comp").select(F.col("node").alias("comp"), F.col("comp").alias("into"))
        self.state = common.saved(self.state.join(grown, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")), "state")
        common.tidy(self.state.sparkSession)

    def of(self, rows: DataFrame) -> DataFrame:
        """rows with the component of their node as it is now."""
        return rows.drop("comp").join(self.state.select("node", "comp"), "node")


def gathered(group: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups (node, hub, n, edits, label) with edits of the group's consensus in place of its hub, and g; and (hub, star, star_g).

    The consensus holds what more than half of the members hold, so what all of them share against their hub is no edit any more, and
    edits are rare. With g = (100 + percent) |edits| - (100 - percent) n, two members are linked exactly if the sum of their g is at most
    2 (100 + percent) times the number of edits they share. Where that sum is not positive they are linked whatever they share, and then
    both are linked so with the member of the least g, the star: comparing it with all others finds every such component.
    """
    sizes = group.groupBy("hub").agg(F.count("*").alias("m"))
    held = group.join(sizes, "hub").select("hub", "m", F.explode("edits").alias("item")).groupBy("hub", "item").agg(F.count("*").alias("c"), F.max("m").alias("m"))
    usual = held.where("2 * c > m").groupBy("hub").agg(F.collect_list("item").alias("usual"))
    usual = F.coalesce("usual", F.array().cast("array<long>")), group.join(usual, "hub", "left")
    new = F.concat(F.array_except("edits", usual[0]), F.array_except(usual[0], F.col("edits")))
    out = usual[1].withColumn("edits", new).withColumn("g", (100 + percent) * F.size("edits").cast("long") - (100 - percent) * F.col("n"))
    out = common.saved(out.drop("usual"), "gathered")
    common.tidy(group.sparkSession)
    return out, out.groupBy("hub").agg(F.min(F.struct("g", "label", "node")).alias("s")).select("hub", F.col("s.g").alias("star_g"), F.col("s.node").alias("star"))


def posted_edits(rows: DataFrame, percent: int) -> DataFrame:
    """Of each member of an open group the rarest edits, as many as a link to a member of another component demands.

    Every open pair has a probe, a member outside the star's component. A probe must share at least as many edits with any member as
    with the star's g, any member as with the least g of the probes; the rest of its edits, the commonest, need not be posted. Edits that
    one member alone has are never posted. `left` is how many edits a member can share from this one on, in the common order.
    """
    probe = F.col("comp") != F.col("star_comp")
    least = rows.where(probe).groupBy("hub").agg(F.min("g").alias("probe_g"))
    rows = rows.join(least, "hub").withColumn("probe", probe)
    asked = F.greatest(F.lit(1), F.ceil((F.col("g") + F.when(F.col("probe"), F.col("star_g")).otherwise(F.col("probe_g"))) / (2 * (100 + percent))))
    each = rows.select("hub", "node", F.explode("edits").alias("item"))
    often = each.groupBy("hub", "item").agg(F.count("*").alias("df")).where("df > 1")
    rare = each.join(often, ["hub", "item"]).groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("p"))
    rows = rows.select("hub", "node", "comp", "g", "probe", asked.cast("int").alias("asked")).join(rare, ["hub", "node"])
    rows = rows.select("hub", "node", "comp", "g", "probe", F.size("p").alias("shared"), F.posexplode(F.slice("p", 1, F.greatest(F.lit(0), F.size("p") - F.col("asked") + 1))).alias("at", "x"))
    return rows.select("hub", "node", "comp", "g", "probe", F.col("x.item").alias("item"), (F.col("shared") - F.col("at")).alias("left"))


def parted(rows: DataFrame) -> DataFrame:
    """(hub, node, part): members of a group parted by the commonest edit of each, those parts that hold more than one component."""
    each = rows.select("hub", "node", F.explode("edits").alias("item"))
    often = each.groupBy("hub", "item").agg(F.count("*").alias("df")).where("df > 1")
    most = each.join(often, ["hub", "item"]).groupBy("hub", "node").agg(F.max(F.struct("df", "item")).alias("x"))
    parts = most.select("hub", "node", F.xxhash64("hub", F.col("x.item")).alias("part")).join(rows.select("hub", "node", "comp"), ["hub", "node"])
    return mixed(parts, "part").select("hub", "node", "part")


def linked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 85, words: int = WORDS, order: str | None = None) -> DataFrame:
    """docs' (id, text hash), and `ord`, the column `order`, with n_shingles, component_id and kept; see near_duplicates."""
    spark, need = docs.sparkSession, needed(percent)
    src = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).alias("did"), F.col(text).alias("_text"), (F.col(order) if order else F.lit(None)).cast("long").alias("ord"))
    rows = common.saved(src.mapInPandas(lambda it: _signed(it, words), "did long, n long, s1 long, s2 long, sig array<int>, ord long"), "signatures")
    full = rows.where("n > 0")
    classes = full.groupBy("s1", "s2").agg(F.min("did").alias("label"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = common.saved(classes.select(F.col("s1").alias("node"), "label", "n", "sig"), "classes")
    # postings: only values that two classes hold, and of each class only the rarest
    posted = classes.select("node", F.posexplode("sig").alias("k", "v")).withColumn("list", F.col("k") * F.lit(1 << 32) + F.col("v").cast("long").bitwiseAND(F.lit(2**32 - 1))).select("node", "list")
    often = posted.groupBy("list").agg(F.count("*").alias("df")).where("df > 1")
    rare = posted.join(often, "list").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "list"))).alias("p"))
    room = F.greatest(F.lit(0), F.size("p") - (need - 1))  # K - need + 1 less the K - size(p) values that it alone holds
    rare = rare.select("node", F.slice("p", 1, room).alias("p")).withColumn("weight", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["df"]))
    common.tidy(spark)
    lists = common.saved(rare.select("node", "weight", F.explode("p").alias("x")).select("node", "weight", F.col("x.list").alias("list")), "postings")
    texts = src.select("did", F.col("_text").alias("t"))
    links = Links(classes)
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda m: m))

    def compared(pairs: DataFrame, least: int) -> DataFrame:
        """Count collisions of the pairs, compare what passes on full sets, and join components."""
        pairs = common.saved(pairs.distinct(), "pairs")
        sig = classes.select("node", "label", "sig")
        one = pairs.join(sig.select(F.col("node").alias("a"), F.col("label").alias("la"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("label").alias("lb"), F.col("sig").alias("sb")), "b")
        near = common.saved(one.where(same >= least).select("a", "b", "la", "lb"), "near")
        common.tidy(spark)
        wanted = near.select(F.col("la").alias("did"), F.col("a").alias("node")).unionByName(near.select(F.col("lb").alias("did"), F.col("b").alias("node"))).distinct()
        wanted = common.saved(wanted, "wanted")
        shown = common.maybe_in(texts, "did", wanted).join(wanted, "did").mapInPandas(lambda it: _own(it, words), "did long, t string, node long").select("node", "t")
        shown = common.saved(shown.groupBy("node").agg(F.min("t").alias("t")), "near_texts")
        full = near.select("a", "b").join(shown.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").join(shown.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
        done = common.saved(full.select("a", "b", "ta", "tb").mapInPandas(lambda it: _compared(it, words, percent), "a long, b long, linked boolean, near boolean, na long, nb long, edits array<long>"), "compared")
        common.discard(pairs, near, wanted, shown)
        common.tidy(spark)
        links.add(done.where("linked").select("a", "b"))
        return done

    # 1. the hub of each posting list, the class with the longest lists (in a group of near copies one near its middle), against the rest of the list
    hubs = common.saved(lists.groupBy("list").agg(F.max(F.struct("weight", "node")).alias("h")).select("list", F.col("h.node").alias("hub")), "hubs")
    first = compared(lists.join(hubs, "list").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")), min(NEAR_HUB, need))
    # each class belongs to the hub that most classes are near to, of those it is near to itself
    near = first.where("near")
    member = near.select(F.col("b").alias("node"), F.col("a").alias("hub"), F.col("nb").alias("n"), "edits")
    own = near.select(F.col("a").alias("node"), F.col("a").alias("hub"), F.col("na").alias("n")).distinct().withColumn("edits", F.array().cast("array<long>"))
    member = member.unionByName(own)
    fame = member.groupBy("hub").agg(F.count("*").alias("fame"))
    best = F.max_by(F.struct("hub", "n", "edits"), F.struct("fame", "hub")).alias("x")
    group = common.saved(member.join(fame, "hub").groupBy("node").agg(best).select("node", "x.*"), "groups")
    common.tidy(spark)

    # 2. groups around a hub that still hold several components, by their edits alone
    now = mixed(links.of(group.select("node", "hub")), "hub").select("hub").distinct()
    now = group.join(now, "hub").join(classes.select("node", "label"), "node")
    levels: list[tuple[DataFrame, DataFrame, DataFrame | None]] = []
    star_links = []
    for level in range(LEVELS):
        held, stars = gathered(now, percent)
        if held.isEmpty():
            break
        # whom the star links whatever they share counts as of its component from here on
        sure = (F.col("node") != F.col("star")) & (F.col("g") + F.col("star_g") <= 0)
        star_links.append(held.join(stars, "hub").where(sure).select(F.col("star").alias("a"), F.col("node").alias("b")))
        left = links.of(held).join(stars, "hub").join(links.state.select(F.col("node").alias("star"), F.col("comp").alias("star_comp")), "star")
        left = common.saved(mixed(left.withColumn("comp", F.when(sure, F.col("star_comp")).otherwise(F.col("comp"))), "hub"), "left")
        common.tidy(spark)
        items = common.saved(posted_edits(left, percent), "posted_edits")
        part = None
        if level < LEVELS - 1:  # who is outside the star's component goes on with those of the same commonest edit
            part = common.saved(parted(left.where("comp <> star_comp")), "parts")
            now = held.join(part, ["hub", "node"]).select("node", F.col("part").alias("hub"), "n", "edits", "label")
        levels.append((held, items, part))
        common.discard(left)
        common.tidy(spark)
    if star_links:
        links.add(common.saved(reduce(DataFrame.unionByName, star_links), "star_links"))
        # a linked pair passes at the first edit that both have: it shares that one and at most what is left of either
        possible = F.col("ga") + F.col("gb") <= 2 * (100 + percent) * F.least("lefta", "leftb")
        found = []
        for held, items, part in levels:  # each level without the pairs of one part, which are met below
            items = items.join(part, ["hub", "node"], "left") if part is not None else items.withColumn("part", F.lit(None).cast("long"))
            rest = common.saved(mixed(links.of(items), "hub", "item"), "open_items")
            one, two = (rest.select("hub", "item", *[F.col(c).alias(f"{c}{x}") for c in ("node", "comp", "g", "left", "probe", "part")]) for x in "ab")
            once = ~F.col("probeb") | (F.col("nodea") < F.col("nodeb"))
            elsewhere = ~F.coalesce(F.col("parta") == F.col("partb"), F.lit(False))
            met = (one["hub"] == two["hub"]) & (one["item"] == two["item"]) & (F.col("nodea") != F.col("nodeb")) & (F.col("compa") != F.col("compb")) & once & elsewhere & possible
            pairs = one.where("probea").join(two, met).select(one["hub"], F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct()
            at = lambda x: held.select("hub", F.col("node").alias(x), F.col("edits").alias(f"e{x}"), F.col("g").alias(f"g{x}"))  # noqa: B023, E731
            shared = F.size(F.array_intersect("ea", "eb")).cast("long")
            found.append(common.saved(pairs.join(at("a"), ["hub", "a"]).join(at("b"), ["hub", "b"]).where(F.col("ga") + F.col("gb") <= 2 * (100 + percent) * shared).select("a", "b"), "edit_links"))
            common.discard(rest)
            common.tidy(spark)
        links.add(reduce(DataFrame.unionByName, found))
        common.discard(*[t for level in levels for t in level if t is not None])

    # 3. pairs of one list that no hub brings together, each in the first list that both are in
    rest = links.of(lists).join(group.select("node", "hub"), "node", "left")
    several = rest.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("hub").alias("h0"), F.max("hub").alias("h1"), F.count("hub").alias("hn"), F.count("*").alias("n")).where("lo < hi AND (h0 < h1 OR hn < n)")
    rest = common.saved(rest.join(several.select("list"), "list"), "open_lists")
    if not rest.isEmpty():
        prefixes = rest.groupBy("node").agg(F.array_sort(F.collect_list("list")).alias("in"))
        rest = rest.join(prefixes, "node").join(classes.select("node", "n", "sig"), "node")
        one, two = (rest.select(F.col("list").alias(f"l{x}"), F.col("node").alias(x), *[F.col(c).alias(f"{k}{x}") for c, k in (("comp", "c"), ("hub", "h"), ("in", "i"), ("sig", "s"), ("n", "n"))]) for x in "ab")
        alike = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        other = ~F.col("ha").eqNullSafe(F.col("hb")) | F.col("ha").isNull()
        met = (F.col("la") == F.col("lb")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & other & alike & (same >= need) & (F.array_min(F.array_intersect("ia", "ib")) == F.col("la"))
        compared(one.join(two, met).select("a", "b"), need)
    # texts without words keep out of the join, since they would share one key
    found = full.join(links.state.select(F.col("node").alias("s1"), "comp"), "s1").select("did", "s1", "n", "comp", "ord")
    out = found.unionByName(rows.where("n = 0").select("did", "s1", "n", F.col("did").alias("comp"), "ord"))
    return out.select("did", "s1", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), "ord")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 85, words: int = WORDS) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (smallest id reachable by links of `percent` similarity), kept."""
    found = linked(docs, id_col, text, percent, words)
    name = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return found.select(name("did").alias(id_col), "n_shingles", name("component_id").alias("component_id"), (F.col("did") == F.col("component_id")).alias("kept"))


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents", "doc_id", "text"), percent=85)
