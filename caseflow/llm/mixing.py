"""Mixing sources to target weights by hierarchical budgeting.

The token budget runs down a domain-language-source tree. At each level a parent's budget is split by the children's weights, no child
getting more than all leaves below it can give (their tokens times ``max_epochs``); what a child can't take goes to its siblings by
weight, and only what no sibling can take stays with the parent, so that it goes to the parent's siblings. A leaf takes a
prefix of its documents in seeded order, epoch after epoch, until its tokens are used up. The epoch is part of the seed, so that an epoch that is cut does not
begin with the same documents as another.

Prefixes need no global sort: the documents of a leaf's cut epoch fall into ranges of the seeded hash, the running totals of the ranges say which one holds the
end of the prefix, and only that range is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.shared import fresh_name, materialize, release_shuffles

LEVELS = ("domain", "lang", "source")
#: Hash ranges of a leaf: three hex digits of the seeded hash.
RANGE_DIGITS = 3
#: What stands for a null name in the tree.
NULL_NAME = "\x01null"
#: Leaves that are broadcast to the documents; more of them are joined by a shuffle.
BROADCAST_LEAVES = 100_000


def split_budget(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``{name}_budget``: the parent's ``budget`` split over its children by ``weight`` within ``capacity``.

    Children fill up in order of capacity per weight; the level at which the rest share is found from running sums.
    """
    order = Window.partitionBy(*parents).orderBy("fill", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = nodes.withColumn("fill", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(0.0)))
    filled = filled.withColumn("level", (F.col("budget") - F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).over(before), F.lit(0))) / F.nullif(F.sum("weight").over(later), F.lit(0)))
    full = F.coalesce(F.col("level") >= F.col("fill"), F.lit(True))
    cut = filled.withColumn("open_level", F.when(~full, F.col("level")))
    shared = F.max("open_level").over(Window.partitionBy(*parents))
    shares = shared.isNotNull() & ~full & (F.col("weight") > 0)
    exact = shared * F.col("weight")
    share = F.when(F.col("weight") <= 0, F.lit(0)).when(shares, F.floor(exact)).otherwise(F.col("capacity"))
    cut = cut.withColumns({"shares": shares, "part": exact - F.floor(exact), "share": F.least(share, F.col("capacity")).cast("long")})
    # tokens lost to rounding go to the largest remainders, one each
    rest = F.col("budget") - F.sum("share").over(Window.partitionBy(*parents))
    place = F.row_number().over(Window.partitionBy(*parents, "shares").orderBy(F.desc("part"), name))
    more = F.when(F.col("shares") & (place <= rest), 1).otherwise(0)
    return cut.withColumn(f"{name}_budget", F.col("share") + more).drop("fill", "level", "open_level", "shares", "part", "share")


def mix(
    docs: DataFrame,
    *,
    budget_share: float,
    domain: Column,
    weights: dict[str, dict[str, int]],
    tokens: Column,
    max_epochs: int = 2,
    floor_epochs: int = 0,
    seed: str = "0",
    id_col: str = "doc_id",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Rows (all columns of ``docs``, then __domain, __tokens, __epoch): the mixture, a document once for each epoch that takes it.

    The budget is ``budget_share`` of all tokens. With ``floor_epochs`` every leaf first gets that many whole epochs, and the tree shares out the rest. ``weights[level][value]`` is a child's whole-number weight among its siblings, 1 where not named. Null
    domains, languages and sources are values of their own. Whole epochs take every document of a leaf; of the epoch that is cut, a document is taken while the tokens before it in the epoch's order are below what
    is left of the leaf's budget, so the last one may overshoot. Documents of no tokens are taken with the prefix they stand in. Rows repeated with the same id stand
    together in the order; rows without an id are ordered by a null's hash. An empty table gives an empty mixture. Columns named like the three new ones are replaced.
    """
    docs = docs.drop("__domain", "__tokens", "__epoch")
    fresh = {c: fresh_name(docs, f"mix_{c}") for c in ("domain", "lang", "source", "tokens", "id", "key", "range", "whole", "room", "cut", "before")}
    d, lng, src, tok, ident, key, rng, whole, room, cut, before = fresh.values()
    names = {d: domain.cast("string"), lng: F.col(lang_col).cast("string"), src: F.col(source_col).cast("string")}
    rows = docs.withColumns({c: F.coalesce(x, F.lit(NULL_NAME)) for c, x in names.items()} | {tok: tokens.cast("long"), ident: F.coalesce(F.col(id_col).cast("string"), F.lit("null"))})
    slim = materialize(rows.select(d, lng, src, tok, ident), "mix-rows")

    leaves = slim.groupBy(F.col(d).alias("domain"), F.col(lng).alias("lang"), F.col(src).alias("source")).agg(F.coalesce(F.sum(tok), F.lit(0)).alias("tokens"))
    leaves = materialize(leaves.withColumn("leaf_capacity", F.col("tokens") * (max_epochs - floor_epochs)), "mix-leaves")
    few = leaves.count() <= BROADCAST_LEAVES
    by_leaf = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    # few leaves are one partition and joins are merges, so that the tree needs no shuffle and no broadcast: each takes some MB of the driver and plans all levels again
    tree = leaves.coalesce(1) if few else leaves
    parents: list[str] = []
    for level in LEVELS:
        here = [*parents, level]
        named = F.coalesce(*[F.when(F.col(level) == k, F.lit(int(w))) for k, w in weights.get(level, {}).items()], F.lit(1))
        nodes = tree.groupBy(*here).agg(F.sum("leaf_capacity").alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("weight", named).withColumn("root", F.lit(0))
        if parents:
            nodes = nodes.join(budgets.select(*parents, "budget").hint("merge"), parents)
        else:
            nodes = nodes.withColumn("budget", F.floor(F.sum("tokens").over(Window.partitionBy("root")) * F.lit(float(budget_share - floor_epochs))).cast("long"))
        budgets = split_budget(nodes, parents or ["root"], level).withColumn("budget", F.col(f"{level}_budget"))
        parents = here
    # of each leaf: whole epochs, and the tokens left for the one after them
    spent = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs - floor_epochs))).otherwise(F.lit(max_epochs - floor_epochs)).cast("long")
    plan = budgets.withColumn("spent", spent)
    plan = plan.select(*[F.col(p).alias(c) for p, c in zip(LEVELS, (d, lng, src), strict=True)], (F.col("spent") + floor_epochs).alias(whole), (F.col("budget") - F.col("spent") * F.col("tokens")).alias("left"))
    leaf = [d, lng, src]
    plan = materialize(plan, "mix-plan")
    seeded = F.md5(F.concat_ws(":", F.lit(seed), F.col(whole).cast("string"), F.col(ident)))
    # the range of the cut epoch that holds the end of its prefix, and the tokens left for it
    within = F.when(F.col("left") > 0, F.substring(seeded, 1, RANGE_DIGITS)).alias(rng)
    ranges = slim.join(by_leaf(plan), leaf).groupBy(*leaf, whole, "left", within).agg(F.sum(tok).alias("in_range"))
    order = Window.partitionBy(*leaf).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn(room, F.col("left") - F.coalesce(F.sum("in_range").over(order), F.lit(0)))
    holds = (F.col(room) > 0) & (F.col(room) <= F.col("in_range"))
    ends = materialize(ranges.groupBy(*leaf, whole).agg(F.max(F.when(holds, F.col(rng))).alias(cut), F.max(F.when(holds, F.col(room))).alias(room)), "mix-ends")
    release_shuffles(docs.sparkSession)

    placed = rows.join(by_leaf(ends), leaf).withColumn(key, seeded).withColumn(rng, F.substring(key, 1, RANGE_DIGITS))
    takes = F.col(whole) + F.when(F.col(rng) <= F.col(cut), 1).otherwise(0)
    taken = placed.where(takes > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(0), (takes - 1).cast("int"))))
    at_end = F.coalesce((F.col("__epoch") == F.col(whole)) & (F.col(rng) == F.col(cut)), F.lit(False))
    inside = Window.partitionBy(*leaf).orderBy(key, F.col(id_col)).rowsBetween(Window.unboundedPreceding, -1)
    last_ones = taken.where(at_end).withColumn(before, F.coalesce(F.sum(tok).over(inside), F.lit(0))).where(F.col(before) < F.col(room))
    both = taken.where(~at_end).unionByName(last_ones.drop(before))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.nullif(F.col(d), F.lit(NULL_NAME)).alias("__domain"), F.col(tok).alias("__tokens"), "__epoch")


def words(text_col: str = "text") -> Column:
    """Words of a text (runs of anything but ASCII white space) as a token measure; null and empty texts have none."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
