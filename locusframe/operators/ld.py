"""Greedy linkage operators: pruning and clumping, as rounds in which the first of each neighbourhood decides.

The sequential loops take variants in an order, and a variant's fate hangs on earlier ones within the window alone. Links
of r2 come from tiles of bit planes; a round then decides, in stretches of a chromosome, every variant whose earlier
neighbours are decided, with the neighbours beyond a stretch's ends as they stand. Stretches move by half their length
from round to round. What is left undecided gets fewer each round, the result is the loop's, and no group is longer than
STRETCH windows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.guards import cut, require
from locusframe.operators.numbering import numbered
from locusframe.operators.packed import links, packed
from locusframe.operators.ranking import top_k

#: Windows of a stretch.
STRETCH = 16
OPEN, KEPT, GONE = 0, 1, 2


def first_come(nodes: DataFrame, pairs: DataFrame, window_bp: int) -> DataFrame:
    """(id, kept): a node is kept if none of the earlier ones that it's linked to is kept.

    ``nodes``: (id, CHR, pos), ids in the order of the decisions; ``pairs``: (a, b), a before b, where a can take b.
    """
    before = pairs.groupBy(F.col("b").alias("id")).agg(F.collect_list("a").alias("before"))
    state = cut(nodes.select("id", "CHR", "pos").join(before, "id", "left").withColumn("before", F.coalesce("before", F.array())).withColumn("state", F.lit(OPEN)))
    length, turn = STRETCH * max(window_bp, 1), 0

    def decide(table: pa.Table) -> pa.Table:
        rows = table.sort_by("id").to_pylist()
        known = {r["id"]: r["state"] for r in rows}
        for r in rows:
            if r["own"] and r["state"] == OPEN:
                found = {known[a] for a in r["before"]}
                known[r["id"]] = GONE if KEPT in found else OPEN if OPEN in found else KEPT
        own = [r for r in rows if r["own"]]
        return pa.table([pa.array([r["id"] for r in own], pa.int64()), pa.array([known[r["id"]] for r in own], pa.int32())], ["id", "now"])

    while True:
        stretch = lambda by: F.floor((F.col("pos") + by + (turn % 2) * (length // 2)) / length)  # noqa: B023, E731
        of = state.withColumn("_at", stretch(0)).withColumn("_in", F.explode(F.array_distinct(F.array(stretch(-window_bp), stretch(0), stretch(window_bp)))))
        own = F.col("_in") == F.col("_at")
        dealt = of.select("CHR", "_in", "id", "state", own.alias("own"), F.when(own, F.col("before")).alias("before"))
        now = dealt.groupBy("CHR", "_in").applyInArrow(decide, "id long, now int")
        state = cut(state.join(now, "id").withColumn("state", F.col("now")).drop("now"))
        turn += 1
        if state.filter(F.col("state") == OPEN).isEmpty():
            return state.select("id", (F.col("state") == KEPT).alias("kept"))


def prune(candidates: DataFrame, window_bp: int, r2: float, at_least: int = 1) -> DataFrame:
    """Markers in order of position, without those that some kept one within the window has r2 or more with.

    Missing dosages are the row's mean; constant rows go.
    """
    d = packed(candidates.select("variant_index", "CHR", "pos", "dosages")).filter(F.col("ss") > 1e-12)
    d = numbered(d, [F.col("CHR"), F.col("pos"), F.col("variant_index")], "id")
    kept = first_come(d, cut(links(d, window_bp, r2)), window_bp).filter("kept").select("id")
    left = d.join(kept, "id").select("variant_index", "CHR", "pos")
    out = numbered(left, [F.col("CHR"), F.col("pos"), F.col("variant_index")], "_number")
    if at_least > 1:
        n = out.count()
        require(n >= at_least, f"{n} markers left of {at_least} needed")
    return out.select("variant_index", "CHR", "pos", (F.col("_number") + 1).alias("structure_marker_rank"))


def clump(table: DataFrame, p: str, index_p: float, secondary_p: float | None, window_bp: int, r2: float, fallback: int, missing: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Leads and members. Candidates in order of p take the unassigned rows of the window that have r2 or more with them.

    ``missing``: ``raw`` takes -1 as a dosage, ``impute`` the row's mean. A constant lead has r2 0 with itself, so it has
    no member. Needs variant_index, snp, CHR, pos, p and dosages.
    """
    impute = missing == "impute"
    index = table.filter(F.col(p) <= index_p)
    if index.isEmpty():
        index = top_k(table, p, fallback)
    second = index if secondary_p is None else table.filter(F.col(p) <= secondary_p)
    if secondary_p is not None and second.isEmpty():
        second = index
    cols = ["variant_index", "snp", "CHR", "pos", F.col(p).alias("p")]
    roles = lambda d, lead, member: d.select(*cols, "dosages", F.lit(lead).alias("lead"), F.lit(member).alias("member"))
    pool = roles(index, 1, 0).unionByName(roles(second, 0, 1))
    d = numbered(packed(pool, impute), [F.col("p"), F.col("CHR"), F.col("pos"), F.col("variant_index"), F.col("lead")], "_row")
    # A variant with both roles stands twice; its first number is its place in the order.
    role = d.groupBy("variant_index").agg(F.min("_row").alias("id"), F.max("lead").alias("lead"), F.max("member").alias("member"))
    d = cut(d.drop("lead", "member").join(role, "variant_index").filter(F.col("_row") == F.col("id")).drop("_row"))
    pairs = links(d, window_bp, r2, impute)
    about = d.select("id", "lead", "member")
    side = lambda c: about.select(F.col("id").alias(c), F.col("lead").alias(f"{c}_lead"), F.col("member").alias(f"{c}_member"))
    pairs = cut(pairs.join(side("a"), "a").join(side("b"), "b").filter((F.col("a_lead") == 1) | (F.col("b_lead") == 1)))
    takes = pairs.filter((F.col("a_lead") == 1) & (F.col("b_lead") == 1) & (F.col("b_member") == 1))
    leads = cut(d.filter("lead = 1").join(first_come(d.filter("lead = 1"), takes, window_bp).filter("kept").select("id"), "id").drop("bits"))
    one = leads.select("id")
    found = pairs.filter("b_member = 1 AND a_lead = 1").select(F.col("a").alias("id"), F.col("b").alias("of"), "r2").unionByName(pairs.filter("a_member = 1 AND b_lead = 1").select(F.col("b").alias("id"), F.col("a").alias("of"), "r2"))
    found = found.join(one, "id", "left_semi").join(one.select(F.col("id").alias("of")), "of", "left_anti")
    # A member goes to the first lead that is linked to it; a lead that varies is its own member.
    first = found.groupBy("of").agg(F.min_by(F.struct("id", "r2"), "id").alias("x")).select("of", "x.*")
    first = first.unionByName(leads.filter(F.col("ss") * F.col("ss") > 1e-12).select(F.col("id").alias("of"), "id", F.lit(1.0).alias("r2")))
    sizes = first.groupBy("id").agg(F.count("*").alias("n_local_members"))
    ranked = numbered(leads, [F.col("id")], "_number").withColumn("lead_rank", (F.col("_number") + 1).cast("int"))
    ranked = ranked.join(sizes, "id", "left").select("id", F.col("variant_index").alias("lead_variant_index"), F.coalesce("n_local_members", F.lit(0)).cast("long").alias("n_local_members"), F.col("snp").alias("lead_snp"), "CHR", "pos", "p", "lead_rank")
    members = first.join(ranked.select("id", "lead_variant_index", "lead_rank"), "id").join(d.select(F.col("id").alias("of"), "variant_index"), "of")
    return ranked.drop("id"), members.select("lead_variant_index", "variant_index", F.col("r2").alias("r2_to_lead"), "lead_rank")
