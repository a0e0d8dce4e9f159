"""Graph analytics over (src, dst, weight) edges: ranks, roll-ups, neighbours, call and import resolution, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seekspark.plans.scratch import saved

DAMPING, EPSILON, ITERATIONS, NEIGHBOURS = 0.85, 1e-6, 100, 5
TIERS = ((0.1, "full"), (0.3, "signatures"), (0.7, "names"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, tolerance: float | None = EPSILON, focus=None, damping: float = DAMPING, cut: int = 4) -> DataFrame:
    """(node, rank). Weighted out-edges; the mass of nodes without any, and the jumps, follow the bias: uniform, or 0.3 uniform and 0.7 on
    the focus nodes (a condition on node). With tolerance None the iterations are fixed; the written state is read back every `cut` rounds."""
    base = nodes.select("node").distinct()
    n = base.count()
    if not n:
        return base.withColumn("rank", F.lit(0.0))
    hot = base.where(focus).count() if focus is not None else 0
    bias = F.lit(1.0 / n) if not hot else 0.3 / n + F.when(focus, 0.7 / hot).otherwise(0.0)
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = saved(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    state = saved(base.join(out, base.node == out.src, "left").select("node", bias.alias("bias"), F.col("total").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")), "ranks")
    for i in range(iterations):
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))  # one row
        flow = share.join(state.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        new = (1 - damping) * F.col("bias") + damping * (F.coalesce(F.col("in"), F.lit(0.0)) + F.col("lost") * F.col("bias"))
        step = state.join(flow, "node", "left").crossJoin(F.broadcast(lost)).select("node", "bias", "dangling", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved"))
        last = i == iterations - 1
        if tolerance is not None or last or i % cut == cut - 1:
            step = saved(step, "ranks")
        state = step.drop("moved")
        if tolerance is not None and step.agg(F.sum("moved")).first()[0] < tolerance:
            break
    return state.select("node", "rank")


def counted_edges(calls: DataFrame) -> DataFrame:
    return calls.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def rolled_up(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between parents (node, parent), without loops."""
    p = parents.select("node", "parent")
    up = edges.join(p.select(F.col("node").alias("src"), F.col("parent").alias("s")), "src").join(p.select(F.col("node").alias("dst"), F.col("parent").alias("d")), "dst")
    return up.where("s <> d").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("weight").alias("weight"))


def rank_of_parents(ranks: DataFrame, parents: DataFrame) -> DataFrame:
    return ranks.join(parents, "node").groupBy("parent").agg(F.sum("rank").alias("rank"))


def neighbours(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(node, direction, other, weight, place): the k heaviest on either side."""
    ins = edges.select(F.col("dst").alias("node"), F.lit("in").alias("direction"), F.col("src").alias("other"), "weight")
    outs = edges.select(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "weight")
    w = W.partitionBy("node", "direction").orderBy(F.desc("weight"), "other")
    return ins.unionByName(outs).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def density_alpha(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: 0.5 + 0.3 min(edges / n(n-1), 1); 0.5 for up to one node."""
    n, e = nodes.agg(F.countDistinct("node").alias("n")), edges.agg(F.count("*").alias("e"))
    return n.crossJoin(e).select(F.when(F.col("n") <= 1, 0.5).otherwise(0.5 + 0.3 * F.least(F.col("e") / F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1)), F.lit(1.0))).alias("alpha"))


def offsets(defs: DataFrame, group: str) -> DataFrame:
    """Exclusive prefix sums of group sizes, in group order."""
    sizes = defs.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.withColumn("first", F.coalesce(F.sum("n").over(W.orderBy(group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def resolved_calls(calls: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """calls (call_id, file_id, callee) with the definition meant: the first of the same file, else the first of an imported file, else null."""
    cand = calls.join(defs.select(F.col("file_id").alias("def_file"), "def_idx", F.col("name").alias("callee")), "callee", "left")
    imp = imports.where(F.col("resolved").isNotNull()).select("file_id", F.col("resolved").alias("def_file"), F.lit(True).alias("imported")).distinct()
    cand = cand.join(imp, ["file_id", "def_file"], "left")
    prio = F.when(F.col("def_file") == F.col("file_id"), 0).when(F.col("imported"), 1)
    best = cand.groupBy("call_id").agg(F.min(F.when(prio.isNotNull(), F.struct(prio.alias("p"), "def_file", "def_idx"))).alias("b"))
    return calls.join(best, "call_id", "left").select(*calls.columns, F.col("b.def_file").alias("def_file"), F.col("b.def_idx").alias("def_idx"))


def enclosing(points: DataFrame, defs: DataFrame, innermost: bool = False) -> DataFrame:
    """points (file_id, call_id, offset) with the definition [start, end) around each: the first in order, or the narrowest."""
    hit = points.join(defs, "file_id").where((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end")))
    order = F.struct((F.col("end") - F.col("start")).alias("span"), "def_idx") if innermost else F.struct("def_idx")
    return hit.groupBy("file_id", "call_id").agg(F.min_by("def_idx", order).alias("def_idx"))


def import_candidates(imports: DataFrame) -> DataFrame:
    """imports (import_id, file_path, raw, ext) with the paths that could be meant, by priority."""
    folder = F.regexp_replace("file_path", "[^/]*$", "")
    dotted = F.translate(F.regexp_replace("raw", r"^\.+", ""), ".", "/")
    # leading dots climb from the importing file's folder; the same name from the root comes after that
    climbs = F.length(F.regexp_extract("raw", r"^\.*", 0))
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    near = F.array_join(F.concat(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - climbs + 1, F.lit(0))), F.filter(F.array(dotted), lambda x: x != "")), "/")
    bases = F.when(climbs > 0, F.array(near, dotted)).otherwise(F.array(dotted))
    python = F.flatten(F.transform(bases, lambda base: F.array(*[F.concat(base, F.lit(x)) for x in (".py", ".pyi", "/__init__.py", "/__init__.pyi")])))
    up = F.regexp_replace(F.concat(folder, F.col("raw")), r"(^|/)\./", "$1")
    for _ in range(4):
        up = F.regexp_replace(F.regexp_replace(up, r"(^|/)\./", "$1"), r"[^/]+/\.\./", "")
    script = F.array(*[F.concat(up, F.lit(x)) for x in (".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.jsx", "/index.ts", "/index.tsx")])
    path = F.regexp_replace(F.regexp_replace("raw", "^(crate|self|super)::", ""), "::", "/")
    root = F.when(F.col("raw").startswith("crate::"), F.concat(F.regexp_extract("file_path", r"^(.*?src/|)", 1), path)).when(F.col("raw").startswith("super::"), F.concat(F.regexp_replace(folder, "[^/]+/$", ""), path)).when(F.col("raw").startswith("self::"), F.concat(folder, path))
    # the longest prefix first: the last segments may name items of the module
    cuts = [F.regexp_replace(root, "/[^/]*" * i + "$", "") if i else root for i in range(3)]
    rust = F.array(*[F.concat(c, F.lit(x)) for c in cuts for x in (".rs", "/mod.rs")])
    cand = F.when(F.col("ext").isin("py", "pyi"), python).when(F.col("ext").isin("js", "jsx", "ts", "tsx") & F.col("raw").startswith("."), script).when((F.col("ext") == "rs") & root.isNotNull(), rust)
    return imports.select("import_id", F.posexplode(cand).alias("priority", "path"))


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, path): the first candidate that is a file."""
    hit = import_candidates(imports).join(files.select("path"), "path")
    return hit.groupBy("import_id").agg(F.min_by("path", "priority").alias("path"))


def tiers(ranks: DataFrame, id_col: str = "node") -> DataFrame:
    """Each node's place by rank and how much of it an overview shows."""
    w = W.orderBy(F.desc("rank"), id_col)
    place = ranks.withColumn("place", F.row_number().over(w) - 1).crossJoin(F.broadcast(ranks.agg(F.count("*").alias("n"))))
    at = F.col("place") / F.col("n")
    tier = F.when(at < TIERS[0][0], TIERS[0][1]).when(at < TIERS[1][0], TIERS[1][1]).when(at < TIERS[2][0], TIERS[2][1]).otherwise("path")
    return place.select(id_col, "rank", "place", tier.alias("tier"))


def rendered(sections: DataFrame, budget: int) -> str:
    """The text of sections (place, full, path) in order while 4 bytes a token fit; the first always; then one path line if it fits."""
    w = W.orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    used = sections.withColumns({"bytes": F.sum(F.octet_length("full")).over(w), "row": F.row_number().over(W.orderBy("place"))})
    kept = used.where((F.col("bytes") / 4 <= budget) | (F.col("row") == 1)).orderBy("place").select("full").collect()  # as many as the budget holds
    out = "".join(r.full for r in kept)
    nxt = used.where(F.col("row") == len(kept) + 1).select("path").first()
    return out + (nxt.path if nxt and (len(out.encode()) + len(nxt.path.encode())) // 4 <= budget else "")


def rank_lookup(def_ranks: DataFrame, file_ranks: DataFrame) -> DataFrame:
    """(key, rank) for `path::name` and `path`, both divided by the greatest definition rank; of a repeated key the last definition counts."""
    most = def_ranks.agg(F.max("rank").alias("m"))
    defs = def_ranks.groupBy(F.concat_ws("::", "path", "name").alias("key")).agg(F.max_by("rank", "def_idx").alias("rank"))
    return defs.unionByName(file_ranks.select(F.col("path").alias("key"), "rank")).crossJoin(F.broadcast(most)).select("key", (F.col("rank") / F.col("m")).alias("rank"))


def first_definitions(defs: DataFrame) -> DataFrame:
    """(path, name, def_idx) of each name's first definition in its file."""
    return defs.groupBy("path", "name").agg(F.min("def_idx").alias("def_idx"))


def focused(files: DataFrame, focus: str) -> DataFrame:
    """The first path that is `focus` or ends with it; no row without one."""
    return files.where(F.col("path").endswith(focus)).select("path").orderBy("path").limit(1)


def calls_of(edges: DataFrame, names: DataFrame, node: int, incoming: bool) -> DataFrame:
    """(place, name, weight): who calls a definition, or whom it calls, from its bounded neighbour list."""
    mine = edges.where(F.col("dst" if incoming else "src") == node)
    rows = neighbours(mine).where((F.col("node") == node) & (F.col("direction") == ("in" if incoming else "out")))
    return rows.join(names.select(F.col("node").alias("other"), "name"), "other").select("place", "name", "weight")
