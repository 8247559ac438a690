"""Yearly dispute networks: densities, signs, triangles, centralities and communities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEGATIVE = ("C-R", "TP-R")


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges of each relation by year."""
    n = lambda r: F.count_if(F.col("relation") == r).alias("n_" + r.lower().replace("-", "_"))
    return edges.groupBy("year").agg(n("C-R"), n("TP-R"), n("C-TP"), F.count(F.lit(1)).alias("n_edges"))


def undirected_multiplicity(edges: DataFrame) -> DataFrame:
    """Unordered pairs with the larger of the two directions' edge counts."""
    ways = edges.groupBy("year", "a", "b").count()
    return ways.groupBy("year", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("count").alias("m"))


def density(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density and mean degree of the undirected collapse; a loop counts twice in degrees."""
    pairs = undirected_multiplicity(edges)
    nodes = edges.select("year", F.explode(F.array("a", "b")).alias("v")).groupBy("year").agg(F.count_distinct("v").alias("n_nodes"))
    m = pairs.groupBy("year").agg(F.sum("m").alias("n_edges"))
    n = F.col("n_nodes").cast("double")
    return nodes.join(m, "year").select(
        "year",
        "n_nodes",
        "n_edges",
        F.when(n > 1, F.round(2 * F.col("n_edges") / (n * (n - 1)), 6)).otherwise(0.0).alias("density"),
        F.round(2 * F.col("n_edges") / n, 6).alias("avg_degree"),
    )


def conflict_density(edges: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("relation").isin(*NEGATIVE))
    total = F.count(F.lit(1))
    return edges.groupBy("year").agg(F.round(bad / total, 6).alias("conflict_density"), F.round(F.count_if(F.col("relation") == "C-TP") / total, 6).alias("support_ratio"))


def signed_edges(edges: DataFrame) -> DataFrame:
    """One sign for each unordered pair and year; a single negative edge makes it negative."""
    sign = F.when(F.col("relation") == "C-TP", 1).otherwise(-1)
    return edges.filter("a <> b").groupBy("year", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(sign).alias("sign"))


def degree_centrality(signed: DataFrame) -> DataFrame:
    """Degrees over unordered pairs, all, positive and negative, divided by the number of other nodes."""
    ends = signed.select("year", F.explode(F.array("x", "y")).alias("v"), "sign")
    n = ends.groupBy("year").agg((F.count_distinct("v") - 1).alias("others"))
    part = lambda c: F.round(F.sum(c) / F.first("others"), 6)
    return (
        ends.join(F.broadcast(n), "year")
        .groupBy("year", "v")
        .agg(part(F.lit(1)).alias("degree"), part((F.col("sign") > 0).cast("int")).alias("positive_degree"), part((F.col("sign") < 0).cast("int")).alias("negative_degree"))
    )


def triangles(signed: DataFrame) -> DataFrame:
    """Triangles of signed pairs by year: balanced if the number of negative sides is even."""
    e = lambda x, y, s: signed.select("year", F.col("x").alias(x), F.col("y").alias(y), F.col("sign").alias(s))
    t = e("p", "q", "s1").join(e("q", "r", "s2"), ["year", "q"]).join(e("p", "r", "s3"), ["year", "p", "r"])
    balanced = F.col("s1") * F.col("s2") * F.col("s3") > 0
    return t.groupBy("year").agg(F.count_if(balanced).alias("balanced"), F.count_if(~balanced).alias("unbalanced"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """Share of distinct arcs whose opposite exists."""
    arcs = edges.filter("a <> b").select("year", "a", "b").distinct()
    back = arcs.select("year", F.col("a").alias("b"), F.col("b").alias("a"), F.lit(1).alias("back"))
    return arcs.join(back, ["year", "a", "b"], "left").groupBy("year").agg(F.round(F.sum(F.coalesce("back", F.lit(0))) / F.count(F.lit(1)), 6).alias("reciprocity"))


def node_covariates(dyads: DataFrame, value: str) -> DataFrame:
    """Both directions of a pair take the larger value."""
    return dyads.groupBy("year", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y")).agg(F.max(value).alias(value))


def _adjacency(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    nodes = np.unique(pdf[["x", "y"]].to_numpy())
    a = np.zeros((len(nodes), len(nodes)))
    x, y = (np.searchsorted(nodes, pdf[c]) for c in ("x", "y"))
    np.add.at(a, (x, y), pdf["w"])
    np.add.at(a, (y, x), pdf["w"])
    return nodes, a


def betweenness(pairs: DataFrame) -> DataFrame:
    """Normalised shortest-path betweenness of each node, a year's graph (some hundred nodes) at a time.

    Path counts and distances of all sources grow together, one level of breadth-first search a step.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, w = _adjacency(pdf)
        a, n = (w > 0).astype(float), len(nodes)
        np.fill_diagonal(a, 0)
        level, paths, dist, d = np.eye(n), np.eye(n), np.where(np.eye(n) > 0, 0, -1), 0
        levels = []
        while level.any():
            levels.append(level)
            d += 1
            level = np.where(dist < 0, level @ a, 0)
            dist[level > 0] = d
            paths += level
        credit = np.zeros((n, n))
        for k in range(len(levels) - 1, 0, -1):
            share = np.where(dist == k, (1 + credit) / np.where(paths > 0, paths, 1), 0) @ a
            credit += np.where(dist == k - 1, share * paths, 0)
        np.fill_diagonal(credit, 0)
        score = credit.sum(axis=0) / max((n - 1) * (n - 2), 1)
        return pd.DataFrame({"year": pdf["year"].iloc[0], "v": nodes, "betweenness": np.round(score, 6)})

    return pairs.groupBy("year").applyInPandas(one, "year int, v int, betweenness double")


def modularity(a: np.ndarray, label: np.ndarray) -> float:
    total = a.sum()
    if not total:
        return 0.0
    k = a.sum(axis=1)
    same = label[:, None] == label[None, :]
    return float(((a - np.outer(k, k) / total) * same).sum() / total)


def _moved(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Labels after moving nodes one by one to the neighbouring community of largest gain, until none gains."""
    n, total, k = len(a), a.sum(), a.sum(axis=1)
    label, strength = np.arange(n), k.copy()
    changed = True
    while changed:
        changed = False
        for v in rng.permutation(n):
            own = label[v]
            strength[own] -= k[v]
            links = np.bincount(label, weights=np.where(np.arange(n) == v, 0, a[v]), minlength=n)
            gain = links - strength * k[v] / total
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-12:
                best = own
            changed |= best != own
            label[v] = best
            strength[best] += k[v]
    return np.unique(label, return_inverse=True)[1]


def louvain(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """year, v, community and the year's modularity: levels of greedy moves on ever coarser graphs."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, full = _adjacency(pdf)
        rng, label, a = np.random.default_rng(seed), np.arange(len(nodes)), full
        while a.sum():
            found = _moved(a, rng)
            if found.max() + 1 == len(a):
                break
            label = found[label]
            groups = np.eye(found.max() + 1)[found]
            a = groups.T @ a @ groups
        return pd.DataFrame({"year": pdf["year"].iloc[0], "v": nodes, "community": label, "modularity": round(modularity(full, label), 4)})

    return pairs.groupBy("year").applyInPandas(one, "year int, v int, community int, modularity double")


def eigenvector(pairs: DataFrame) -> DataFrame:
    """Entries of the unit eigenvector of the largest eigenvalue, links unweighted, a year's graph at a time.

    Where several parts of a graph share the largest eigenvalue, the vector is the one nearest to equal entries.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, w = _adjacency(pdf)
        values, vectors = np.linalg.eigh((w > 0).astype(float))
        top = vectors[:, values > values[-1] - 1e-9]
        v = top @ top.sum(axis=0)
        return pd.DataFrame({"year": pdf["year"].iloc[0], "v": nodes, "eigenvector": np.round(v / np.linalg.norm(v), 6)})

    return pairs.groupBy("year").applyInPandas(one, "year int, v int, eigenvector double")


#: Triads by mutual, one-way and null pairs, and a letter where these do not tell them apart.
TRIADS = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")


def triad_type(code: int) -> str:
    """The type of a triad p, q, r; bits of code are p to q, q to p, p to r, r to p, q to r and r to q, from the lowest."""
    states = [code & 3, code >> 2 & 3, code >> 4 & 3]
    m, n = states.count(3), states.count(0)
    sent, got = [0] * 3, [0] * 3
    for bit, (a, b) in enumerate(((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1))):
        sent[a] += code >> bit & 1
        got[b] += code >> bit & 1
    name = f"{m}{3 - m - n}{n}"
    letter = {
        "021": "D" if 2 in sent else "U" if 2 in got else "C",
        "111": "D" if 2 in got else "U",
        "030": "C" if sent == [1, 1, 1] else "T",
        "120": "D" if 0 in got else "U" if 0 in sent else "C",
    }
    return name + letter.get(name, "")


def triad_census(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """year, triad and n for all 16 types over the nodes (year, v).

    Only triads with two linked pairs or more are built, from pairs that share a node; how many have one linked pair or
    none follows from the numbers of pairs and nodes.
    """
    way = F.when(F.col("a") < F.col("b"), 1).otherwise(2)
    pairs = arcs.filter("a <> b").groupBy("year", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.bit_or(way).alias("s"))
    ends = pairs.select("year", "x", "y", "s", F.explode(F.array("x", "y")).alias("c"))
    other = ends.select("year", "c", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("s").alias("s2"))
    wedges = ends.join(other, ["year", "c"]).filter("x < x2 OR (x = x2 AND y < y2)")
    t = F.array_sort(F.array_distinct(F.array("x", "y", "x2", "y2")))
    wedges = wedges.select("year", "x", "y", "s", "x2", "y2", "s2", t[0].alias("p"), t[1].alias("q"), t[2].alias("r"))
    place = lambda x, y, s: F.col(s) * F.when(F.col(y) == F.col("q"), 1).when(F.col(x) == F.col("p"), 4).otherwise(16)
    code = F.bit_or(place("x", "y", "s").bitwiseOR(place("x2", "y2", "s2")))
    codes = wedges.groupBy("year", "p", "q", "r").agg(code.alias("code")).groupBy("year", "code").agg(F.count(F.lit(1)).alias("n"))

    types = F.create_map(*(F.lit(x) for c in range(64) for x in (c, triad_type(c))))
    linked = codes.select("year", types[F.col("code").cast("int")].alias("triad"), "n").groupBy("year", "triad").agg(F.sum("n").alias("n"))
    kinds = F.substring("triad", 1, 1).cast("int"), F.substring("triad", 2, 1).cast("int")
    used = linked.groupBy("year").agg(F.sum(kinds[0] * F.col("n")).alias("used_m"), F.sum(kinds[1] * F.col("n")).alias("used_a"), F.sum("n").alias("used"))
    total = pairs.groupBy("year").agg(F.count_if(F.col("s") == 3).alias("m"), F.count_if(F.col("s") < 3).alias("a"))
    size = nodes.select("year", "v").distinct().groupBy("year").agg(F.count(F.lit(1)).alias("size"))
    year = size.join(total, "year", "left").join(used, "year", "left").fillna(0)
    one_m, one_a = F.col("m") * (F.col("size") - 2) - F.col("used_m"), F.col("a") * (F.col("size") - 2) - F.col("used_a")
    every = F.expr("size * (size - 1) * (size - 2) div 6")
    row = lambda name, n: F.struct(F.lit(name).alias("triad"), n.cast("long").alias("n"))
    rest = [row(name, F.lit(0)) for name in TRIADS[3:]]
    few = year.select("year", F.inline(F.array(row("003", every - one_m - one_a - F.col("used")), row("012", one_a), row("102", one_m), *rest)))
    return few.unionByName(linked).groupBy("year", "triad").agg(F.sum("n").alias("n"))


def change_statistics(arcs: DataFrame, nodes: DataFrame, decay: float = 0.5, edge_covariates: DataFrame | None = None, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Features of every ordered pair of a year's nodes for a pseudo-likelihood: the tie, its opposite, the tie and its
    opposite a year before, whether a tie would keep the pair as it was (1) or change it (-1), and the change in
    geometrically weighted out- and in-degree if the tie is added.

    Columns of edge_covariates (year, a, b, ...) are taken as they are, 0 where a pair has none. Each attribute of
    nodes (year, v, ...) gives that of the sender, of the receiver and their absolute difference. Arcs between others
    than a year's nodes are passed over. Degrees and opposites are windows over the pairs, so arcs are read once.
    """
    present = arcs.filter("a <> b").select("year", "a", "b").distinct().withColumn("tie", F.lit(1))
    end = lambda side: nodes.select("year", F.col("v").alias(side), *(F.col(x).alias(f"{side}_{x}") for x in attributes))
    out = end("a").join(end("b"), "year").filter("a <> b").join(present, ["year", "a", "b"], "left").fillna(0, ["tie"])
    both = Window.partitionBy("year", F.least("a", "b"), F.greatest("a", "b"))
    out = out.withColumn("mutual", (F.sum("tie").over(both) - F.col("tie")).cast("int"))
    earlier = Window.partitionBy("a", "b").orderBy("year").rangeBetween(-1, -1)
    out = out.withColumns({name: F.coalesce(F.max(x).over(earlier), F.lit(0)) for name, x in (("before", "tie"), ("delrecip", "mutual"))})
    for side, name in (("a", "out"), ("b", "in")):
        degree = F.sum("tie").over(Window.partitionBy("year", side))
        out = out.withColumn(f"gw{name}", F.round(F.pow(F.lit(1 - float(np.exp(-decay))), degree - F.col("tie")), 6))
    extra = []
    for x in attributes:
        extra += [F.col(f"a_{x}").alias(f"sender_{x}"), F.col(f"b_{x}").alias(f"receiver_{x}"), F.abs(F.col(f"a_{x}") - F.col(f"b_{x}")).alias(f"absdiff_{x}")]
    if edge_covariates is not None:
        names = [c for c in edge_covariates.columns if c not in ("year", "a", "b")]
        out = out.join(edge_covariates, ["year", "a", "b"], "left")
        extra += [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]
    return out.select("year", "a", "b", "tie", "mutual", "before", "delrecip", (2 * F.col("before") - 1).alias("stability"), "gwout", "gwin", *extra)


def signed_changes(signed: DataFrame, nodes: DataFrame, decay: float = 0.5) -> DataFrame:
    """Features of every unordered pair of a year's nodes for a signed pseudo-likelihood: its sign (-1, 0 or 1) and, for
    a positive and for a negative tie in its place, how much each statistic of the network would change.

    signed has one row (year, x, y, sign) for each tied pair, x < y. pos_degree and neg_degree are geometrically
    weighted degrees of either sign; pos_friends and pos_enemies are those of the friends and of the enemies that the
    ends of positive ties share, so that neg_enemies is what a negative tie does to the positive ties around it. A
    pair's own tie never counts in its features. Wedges are joined at the node that they share, with a sum before the
    shuffle; what is left grows with pairs of nodes, as the model does.
    """
    shrink = 1 - float(np.exp(-decay))
    power = lambda n: F.pow(F.lit(shrink), n)
    ways = signed.select("year", "x", "y", "sign").unionByName(signed.select("year", F.col("y").alias("x"), F.col("x").alias("y"), "sign"))
    half = lambda side: ways.select("year", F.col("y").alias("k"), F.col("x").alias(side), F.col("sign").alias(f"sign_{side}"))
    same = half("x").join(half("y"), ["year", "k"]).filter("x <> y and sign_x = sign_y")
    shared = same.groupBy("year", "x", "y").agg(F.count_if(F.col("sign_x") == 1).alias("friends"), F.count_if(F.col("sign_x") == -1).alias("enemies"))
    held = ways.join(shared, ["year", "x", "y"], "left").fillna(0, ["friends", "enemies"])
    # what a tie of x and y does to the positive ties of x: by shared friends where y is a friend of the third, by enemies where it is one
    third = held.filter("sign = 1").select("year", "x", F.col("y").alias("k"), "friends", "enemies")
    around = third.join(half("y"), ["year", "k"]).filter("x <> y").groupBy("year", "x", "y").agg(
        F.sum(F.when(F.col("sign_y") == 1, power(F.col("friends")))).alias("by_friends"), F.sum(F.when(F.col("sign_y") == -1, power(F.col("enemies")))).alias("by_enemies")
    )
    both = around.groupBy("year", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("by_friends").alias("by_friends"), F.sum("by_enemies").alias("by_enemies"))
    degrees = ways.groupBy("year", F.col("x").alias("v")).agg(F.count_if(F.col("sign") == 1).alias("pos"), F.count_if(F.col("sign") == -1).alias("neg"))
    end = lambda side: nodes.select("year", F.col("v").alias(side)).join(degrees.select("year", F.col("v").alias(side), F.col("pos").alias(f"pos_{side}"), F.col("neg").alias(f"neg_{side}")), ["year", side], "left").fillna(0)
    pairs = end("x").join(end("y"), "year").filter("x < y").join(signed.select("year", "x", "y", "sign"), ["year", "x", "y"], "left")
    pairs = pairs.join(shared, ["year", "x", "y"], "left").join(both, ["year", "x", "y"], "left").fillna(0, ["sign", "friends", "enemies", "by_friends", "by_enemies"])
    own = lambda s: (F.col("sign") == s).cast("int")
    scale = float(np.exp(decay))
    without = lambda sums, s: F.col(sums) / F.when(F.col("sign") == s, shrink).otherwise(1.0)
    return pairs.select(
        "year",
        "x",
        "y",
        "sign",
        (power(F.col("pos_x") - own(1)) + power(F.col("pos_y") - own(1))).alias("pos_degree"),
        (power(F.col("neg_x") - own(-1)) + power(F.col("neg_y") - own(-1))).alias("neg_degree"),
        (scale * (1 - power(F.col("friends"))) + without("by_friends", 1)).alias("pos_friends"),
        (scale * (1 - power(F.col("enemies")))).alias("pos_enemies"),
        without("by_enemies", -1).alias("neg_enemies"),
    )
