"""Dyad-year trade: aggregation, dependence, reverse flows, blocs, membership and agreements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.operators.frames import guarded_ratio


def money(x: Column) -> Column:
    return x.cast("double")


def dyad_year(flow: DataFrame, *more: str) -> DataFrame:
    """Exports of i to j by year (and more keys); own trade left out. Sums are exact decimals, then doubles."""
    return (
        flow.filter("i <> j")
        .groupBy(*more, "year", "i", "j")
        .agg(money(F.sum("v")).alias("exports"), F.count_distinct("k").alias("n_products"), F.count_distinct("section").alias("n_sections"))
    )


def section_year(flow: DataFrame) -> DataFrame:
    return flow.filter("i <> j").groupBy("year", "i", "j", "section").agg(money(F.sum("v")).alias("exports"))


def dependence(flow: DataFrame) -> DataFrame:
    """Section flows with shares in i's exports of the section, in i's exports, and in exports to the partner."""
    f = flow.filter("i <> j").groupBy("year", "i", "j", "section").agg(F.sum("v").alias("v"))
    of = lambda *keys: F.sum("v").over(Window.partitionBy("year", *keys))
    return f.select(
        "year",
        "i",
        "j",
        "section",
        guarded_ratio("v", of("i", "section")).alias("partner_share"),
        guarded_ratio("v", of("i")).alias("sector_dependence"),
        guarded_ratio("v", of("i", "j")).alias("bilateral_concentration"),
    )


def hhi(flow: DataFrame) -> DataFrame:
    """Sum of squared section shares of each dyad-year; NULL where nothing is traded."""
    share = F.col("exports") / F.sum("exports").over(Window.partitionBy("year", "i", "j"))
    return section_year(flow).withColumn("share", share).groupBy("year", "i", "j").agg(F.round(F.sum(F.col("share") * F.col("share")), 6).alias("hhi"))


def with_reverse(df: DataFrame, column: str, name: str) -> DataFrame:
    """The same column of the opposite direction, 0 where it has no row."""
    back = df.select("year", F.col("j").alias("i"), F.col("i").alias("j"), F.col(column).alias(name))
    return df.join(back, ["year", "i", "j"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def import_dependence(dyads: DataFrame) -> DataFrame:
    """Exports, imports and the partner's shares in all of i's exports and imports."""
    both = with_reverse(dyads.select("year", "i", "j", "exports"), "exports", "imports")
    w = Window.partitionBy("year", "i")
    return both.select(
        "year",
        "i",
        "j",
        "exports",
        "imports",
        guarded_ratio("exports", F.sum("exports").over(w), 4).alias("export_dependence"),
        guarded_ratio("imports", F.sum("imports").over(w), 4).alias("import_dependence"),
    )


def members_by_year(members: DataFrame, years: DataFrame, exit_inclusive: bool = True) -> DataFrame:
    """code, year of bloc membership; the member table is small by nature (one row a country), so a range join."""
    last = F.coalesce("exit_year", F.lit(9999))
    inside = (F.col("year") >= F.col("acc_year")) & (F.col("year") <= last if exit_inclusive else F.col("year") < last)
    return years.join(F.broadcast(members), inside).select("code", "year")


def dual_representation(flow: DataFrame, member_years: DataFrame, bloc: int = 999) -> DataFrame:
    """Dyad-year trade of countries and of the bloc as one party, in one aggregation.

    Each flow counts once as it is (rep 0) and once with members replaced by the bloc (rep 1). Totals are over all
    partners of a representation; only then are rows of rep 1 that do not touch the bloc dropped.
    """
    m = member_years.withColumn("m", F.lit(True))
    side = lambda name: F.broadcast(m.select(F.col("code").alias(name), "year", F.col("m").alias(f"{name}_in")))
    f = flow.join(side("i"), ["i", "year"], "left").join(side("j"), ["j", "year"], "left")
    as_bloc = lambda name: F.when(F.col(f"{name}_in"), F.lit(bloc)).otherwise(F.col(name))
    pairs = F.array(
        F.struct(F.lit(0).alias("rep"), F.col("i"), F.col("j")),
        F.struct(F.lit(1).alias("rep"), as_bloc("i").alias("i"), as_bloc("j").alias("j")),
    )
    both = f.select("year", "k", "section", "v", F.explode(pairs).alias("p")).select("year", "k", "section", "v", "p.rep", "p.i", "p.j")
    dyads = dyad_year(both, "rep")
    total = F.sum("exports").over(Window.partitionBy("rep", "year", "i"))
    out = dyads.withColumn("export_dependence", guarded_ratio("exports", total, 4))
    return out.filter((F.col("rep") == 0) | (F.col("i") == bloc) | (F.col("j") == bloc))


def both_members(dyads: DataFrame, members: DataFrame) -> DataFrame:
    """Dyad-years in which both ends have joined; who is not listed never has."""
    for end in ("i", "j"):
        dim = F.broadcast(members.select(F.col("code").alias(end), F.col("join_year").alias("_join")))
        dyads = dyads.join(dim, end, "left").filter(F.col("year") >= F.coalesce("_join", F.lit(9999))).drop("_join")
    return dyads


def forward_filled(df: DataFrame, year: str, last: int, until: int) -> DataFrame:
    """df and its rows of the last year again for each later year."""
    later = df.filter(F.col(year) == last).withColumn(year, F.explode(F.sequence(F.lit(last + 1), F.lit(until))))
    return df.unionByName(later.withColumn(year, F.col(year).cast(df.schema[year].dataType)))


def undirected(dyads: DataFrame, agreements: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Attributes of unordered pairs on directed dyads, by one join on (least, greatest, year).

    agreements has one row an unordered pair and year; columns maps its columns to SQL defaults of unmatched rows.
    """
    right = agreements.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y"), "year", *columns)
    left = dyads.withColumn("_x", F.least("i", "j")).withColumn("_y", F.greatest("i", "j"))
    out = left.join(right, ["_x", "_y", "year"], "left").drop("_x", "_y")
    return out.withColumns({c: F.coalesce(c, F.expr(default)) for c, default in columns.items()})


def dual_role(dyads: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Node-year attributes of both ends, with suffixes _1 and _2."""
    for end, suffix in (("i", "_1"), ("j", "_2")):
        dim = nodes.select(F.col("code").alias(end), "year", *(F.col(c).alias(c + suffix) for c in columns))
        dyads = dyads.join(dim, [end, "year"], "left")
    return dyads


def inherited_agreements(agreements: DataFrame, member_years: DataFrame, bloc: int = 999) -> DataFrame:
    """For each partner and year the deepest agreement of any member with it, as the bloc's."""
    ways = agreements.select("year", "a", "b", "label", "depth_index").unionByName(agreements.select("year", F.col("b").alias("a"), F.col("a").alias("b"), "label", "depth_index"))
    ever = member_years.select("code").distinct()
    from_members = ways.filter("label = 1").join(F.broadcast(ever.withColumnRenamed("code", "a")), "a")
    w = Window.partitionBy("b", "year").orderBy(F.col("depth_index").desc_nulls_last(), F.col("label").desc(), F.col("a"))
    best = from_members.withColumn("n", F.row_number().over(w)).filter("n = 1")
    return best.select(F.lit(bloc).alias("bloc"), F.col("b").alias("partner"), "year", "label", "depth_index", F.col("a").alias("from_member"))
