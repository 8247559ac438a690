"""Cases, roles and the dyads and histories made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Role pairs of a case: relation, first role, second role.
RELATIONS = (("C-R", "complainant", "respondent"), ("TP-R", "third_party", "respondent"), ("C-TP", "complainant", "third_party"))


def role_dyads(parties: DataFrame, relations=RELATIONS) -> DataFrame:
    """case_id, a, b, relation: the products of each case's role lists. Roles are gathered once a case (lists are
    as long as a case has parties); their products are one array, so parties are read and exploded once, without a join."""
    lists = parties.groupBy("case_id").agg(*(F.collect_list(F.when(F.col("role") == r, F.col("party"))).alias(r) for r in ("complainant", "respondent", "third_party")))
    product = lambda name, a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("a"), y.alias("b"), F.lit(name).alias("relation")))))
    return lists.select("case_id", F.inline(F.concat(*(product(*r) for r in relations))))


def role_severity(relation: str = "relation", severity: str = "severity") -> Column:
    return F.when(F.col(relation) == "C-R", F.col(severity).cast("double")).when(F.col(relation) == "TP-R", F.lit(0.5)).when(F.col(relation) == "C-TP", F.lit(0.0))


def with_cases(dyads: DataFrame, cases: DataFrame) -> DataFrame:
    return dyads.join(cases.select("case_id", "year", "severity"), "case_id").withColumn("score", role_severity())


def disputed_trade(dyads: DataFrame, sections: DataFrame, flows: DataFrame, lags: int = 3) -> DataFrame:
    """Sum and mean of trade in a case's sections, in both directions and for years 0 to lags back.

    Each dyad is exploded over sections and lags and met with the section flows by equality; NULL where none match. The
    flows are broadcast, as there is one at most for two nations, a section and a year; so all rows of a case stay where
    its dyads and sections have met, and the sums need no shuffle of the exploded rows.
    """
    wanted = (
        dyads.select("case_id", "a", "b", "year")
        .distinct()
        .join(sections, "case_id")
        .select("case_id", "a", "b", "year", "section", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"))
        .select("*", F.explode(F.array(F.struct(F.lit("out").alias("way"), F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.lit("back").alias("way"), F.col("b").alias("i"), F.col("a").alias("j")))).alias("d"))
        .select("case_id", "a", "b", "year", "section", "lag", "d.way", "d.i", "d.j", (F.col("year") - F.col("lag")).alias("at"))
    )
    met = wanted.join(F.broadcast(flows.withColumnRenamed("year", "at")), ["i", "j", "at", "section"], "left")
    return met.groupBy("case_id", "a", "b", "year", "way", "lag").agg(F.round(F.sum("exports"), 2).alias("total"), F.round(F.avg("exports"), 6).alias("mean"))


def append_missing(dyads: DataFrame, disputes: DataFrame) -> DataFrame:
    """dyads with a flag, and the disputes of dyad-years that dyads lack, other columns NULL."""
    keys = ["year", "i", "j"]
    d = disputes.select(*keys).distinct()
    known = dyads.join(d.withColumn("has_dispute", F.lit(1)), keys, "left").withColumn("has_dispute", F.coalesce("has_dispute", F.lit(0)))
    return known.unionByName(d.join(dyads, keys, "left_anti").withColumn("has_dispute", F.lit(1)), allowMissingColumns=True)


def annual_roles(parties: DataFrame, cases: DataFrame) -> DataFrame:
    """Distinct cases by party, year and role; 0 where a party has other roles only."""
    p = parties.join(cases.select("case_id", "year"), "case_id")
    counts = [F.count_distinct(F.when(F.col("role") == r, F.col("case_id"))).alias(f"n_{r}") for r in ("complainant", "respondent", "third_party")]
    return p.groupBy("party", "year").agg(*counts)


def third_party_history(dyads: DataFrame) -> DataFrame:
    """Running number of distinct earlier cases of (third party, respondent), in the year after each event."""
    yearly = dyads.filter("relation = 'TP-R'").groupBy("a", "b", "year").agg(F.count_distinct("case_id").alias("n"))
    w = Window.partitionBy("a", "b").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return yearly.select("a", "b", (F.col("year") + 1).alias("year"), F.sum("n").over(w).alias("cum_tp"), F.lit(1).alias("tp_before"))


def cumulative_roles(annual: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Running counts and an ever flag on a balanced party-year skeleton."""
    filled = skeleton.join(annual, ["party", "year"], "left").fillna(0)
    w = Window.partitionBy("party").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    roles = ("complainant", "respondent", "third_party")
    any_role = F.greatest(*(F.col(f"n_{r}") for r in roles)) > 0
    return filled.select("party", "year", *(F.sum(f"n_{r}").over(w).alias(f"cum_{r}") for r in roles), F.max(any_role.cast("int")).over(w).alias("ever_participant"))


def bloc_classes(parties: DataFrame, members: DataFrame) -> DataFrame:
    """Whether the complainants of a case are members only, others only, or both."""
    inside = F.col("code").isNotNull()
    met = parties.filter("role = 'complainant' or role = 'respondent'").join(F.broadcast(members.select("code").distinct()), F.col("party") == F.col("code"), "left")
    found = met.groupBy("case_id").agg(F.bool_or(inside).alias("has_member"), F.bool_or(~inside).alias("has_other"))
    kind = F.when(F.col("has_member") & F.col("has_other"), "mixed").when(F.col("has_member"), "member_only").otherwise("other_only")
    return found.select("case_id", kind.alias("kind"))


def disaggregated(dyads: DataFrame, member_years: DataFrame, bloc: int, end: str = "a") -> DataFrame:
    """Rows with the bloc at one end, as one row a member of that year; all others as they are."""
    members = F.broadcast(member_years.groupBy("year").agg(F.collect_list("code").alias("_members")))
    of_bloc = F.col(end) == bloc
    rows = dyads.join(members, "year", "left")
    codes = F.when(of_bloc, F.coalesce("_members", F.array().cast("array<int>"))).otherwise(F.array(end))
    others = [F.col(c) for c in dyads.columns if c != end]
    return rows.select(*others, of_bloc.cast("int").alias(f"{end}_from_bloc"), F.explode(codes).alias(end))


def two_digit_date(text: str, pivot: int = 2068) -> Column:
    """A date like 07-Nov-96; years after the pivot are of the century before."""
    d = F.try_to_timestamp(F.col(text), F.lit("dd-MMM-yy")).cast("date")
    return F.when(F.year(d) > pivot, F.add_months(d, -1200)).otherwise(d)
