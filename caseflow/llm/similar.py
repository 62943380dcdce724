"""Groups of similar texts: the Jaccard of their word shingles reaches a share.

SimHash within three bits finds few pairs below 0.95, so candidates also come from MinHash bands: texts meet where the least values of five hash
functions agree, in one of 25 bands. A pair of Jaccard 0.8 misses all bands with a chance of 5 in 100,000. Every link is verified on the
shingles themselves, by joins; what very many rows ask for is copied, so that they meet it in many tasks. A bucket first compares its members with one hub for each round, so that a group of near copies that are linked costs its size.

What is still apart after some rounds is joined by how it differs from a hub. Texts that share buckets, directly or over others, make a group with one hub ``h``. With ``D(x)`` the shingles
that x adds to the hub's and those it lacks, two texts differ by ``|D(x)| + |D(y)| - 2 |D(x) & D(y)|`` shingles, and reach the share ``t`` if that is at most ``c (|x| + |y|)``,
``c = (1 - t) / (1 + t)``. Then either both reach it with the hub, or D(x) and D(y) share a difference, ``(|D(x)| - c |x| + |D(y)| - c |y|) / 2`` of them at least, so that one stands near the
beginning of both when differences are ordered by how many texts of the group have them. That is exact, and a crowd of texts that are nearly but not quite alike
costs little, because what sets each apart comes first in its order and meets nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.components import connected_components
from caseflow.llm.shared import HOT_ROWS, materialize, release_shuffles, spread_join
from caseflow.llm.simhash import fingerprint_links, print_of, shingle_hasher

BANDS, BAND_ROWS = 25, 5
#: Hub rounds before what is still apart is joined by its differences from a hub, and the pairs a node for which this is done earlier.
HUB_ROUNDS, FEW_PAIRS = 2, 2
_FACTORS, _SHIFTS = np.random.default_rng(11).integers(1, 2**63, size=(2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(shingles: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band; none without shingles."""
    import xxhash

    if not len(shingles):
        return []
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * _FACTORS + _SHIFTS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), seed=i + 1) for i, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _node(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes())], np.uint64).view(np.int64)[0])


def _sketched(rows: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, node, fp, bands); texts of the same shingles are one node."""

    @F.pandas_udf("node long, fp long, bands array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = shingle_hasher(shingle_words)
        for texts in batches:
            found = []
            for text in texts:
                every = hashes(text)
                once = np.unique(every)
                found.append((_node(once), print_of(every), bands(once)))
            yield pd.DataFrame(found, columns=["node", "fp", "bands"]).astype({"node": "int64", "fp": "int64"})

    return rows.withColumn("s", sketch("text")).select("doc_id", "s.node", "s.fp", "s.bands")


def _sets(rows: DataFrame, firsts: DataFrame, nodes: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles: sorted distinct hashes) of ``nodes``, made anew from their first texts. The ids are the hashed side of the join, so texts are not sorted."""

    @F.pandas_udf("node long, shingles array<long>")
    def shingled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = shingle_hasher(shingle_words)
        for texts in batches:
            sets = [np.unique(hashes(t)) for t in texts]
            yield pd.DataFrame({"node": pd.Series([_node(x) for x in sets], dtype="int64"), "shingles": pd.Series([x.view(np.int64) for x in sets], dtype="object")})

    wanted = firsts.join(nodes.hint("merge"), "node", "left_semi").select(F.col("first_id").alias("doc_id"), F.col("node").alias("want"))
    found = rows.join(wanted.hint("shuffle_hash"), "doc_id").withColumn("s", shingled("text")).where("s.node = want")
    return found.select("s.node", "s.shingles").dropDuplicates(["node"])


def _most(counts: DataFrame, column: str) -> int:
    return counts.agg(F.coalesce(F.max(column), F.lit(0)).alias("most")).first()["most"]


def _verified(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose Jaccard is ``share`` or more. ``pairs`` is a written table; a hub stands in very many of them."""
    most = _most(pairs.groupBy(F.col("a").alias("k")).count().union(pairs.groupBy("b").count()), "count")
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    sided = spread_join(spread_join(pairs, x, ["a"], "b", most), y, ["b"], "a", most, counted=pairs)
    enough = F.least(F.size("x"), F.size("y")) >= share * F.greatest(F.size("x"), F.size("y"))
    both = F.size(F.array_intersect("x", "y"))
    return sided.where(enough & (both >= share * (F.size("x") + F.size("y") - both))).select("a", "b")


def _difference_pairs(live: DataFrame, sets: DataFrame, share: float, most: int = 0) -> DataFrame:
    """Pairs (a, b) of nodes of different classes, among them all whose Jaccard is ``share`` or more and whose link can join two classes. ``live`` has bucket, node and comp, and ``most`` rows in its largest bucket (0: not known, so buckets are not split)."""
    slack, c = 1e-9, (1 - share) / (1 + share)
    firsts = live.groupBy("bucket").agg(F.min("node").alias("first"))
    met = spread_join(live, firsts, ["bucket"], "node", most).select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    grouped = connected_components(met, name="similar-groups")
    nodes = materialize(live.groupBy("node").agg(F.min("comp").alias("comp"), F.count("*").alias("buckets")).join(grouped.hint("merge"), "node"), "similar-nodes")
    hubs = materialize(nodes.groupBy("component").agg(F.max_by("node", F.struct("buckets", F.xxhash64("node"))).alias("hub"), F.count("*").alias("members")), "similar-hubs")
    largest = _most(hubs, "members")
    placed = materialize(spread_join(nodes, hubs, ["component"], "node", largest).select("node", "comp", "hub"), "similar-placed")
    base = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("base"))
    own = spread_join(placed, base, ["hub"], "node", largest).join(sets.hint("merge"), "node")
    both = own.select("node", "comp", "hub", F.size("shingles").alias("n"), F.array_except("shingles", "base").alias("more"), F.array_except("base", "shingles").alias("less"))
    sides = both.withColumn("d", F.size("more") + F.size("less")).withColumn("spare", F.col("d") - c * F.col("n"))
    marks = F.concat(F.transform("more", lambda t: F.struct(F.lit(1).alias("sign"), t.alias("token"))), F.transform("less", lambda t: F.struct(F.lit(0).alias("sign"), t.alias("token"))))
    every = materialize(sides.select("node", "comp", "hub", "n", "d", "spare", F.explode(marks).alias("m")).select("node", "comp", "hub", "n", "d", "spare", "m.sign", "m.token"), "similar-differences")
    often = materialize(every.groupBy("hub", "sign", "token").agg(F.count("*").alias("df")).where("df > 1"), "similar-often")
    # differences of one text alone come first and never meet
    held = spread_join(every, often, ["hub", "sign", "token"], "node", _most(often, "df")).groupBy("node", "comp", "hub", "n", "d", "spare").agg(F.array_sort(F.collect_list(F.struct("df", "sign", "token"))).alias("t"))
    spots = held.select("node", "comp", "hub", "n", "d", "spare", (F.col("d") - F.size("t")).alias("alone"), F.posexplode("t").alias("pos", "t"))
    spots = spots.withColumn("at", F.col("alone") + F.col("pos")).select("node", "comp", "hub", "n", "d", "spare", "at", "t.sign", "t.token")
    # how many must be shared at least: by the text with less to spare, and by the other whatever it meets
    enough = lambda k: F.col("at") <= F.col("d") - F.greatest(F.lit(1), F.ceil(k - slack))
    probe = materialize(spots.where(enough(F.col("spare") - c * F.col("n") / share)), "similar-prefixes")
    index = probe.where(enough(F.col("spare")))
    other = probe.select("hub", "sign", "token", *[F.col(x).alias(f"o_{x}") for x in ("node", "comp", "n", "d", "spare", "at")])
    shared = F.least(F.col("d") - F.col("at"), F.col("o_d") - F.col("o_at")) >= (F.col("spare") + F.col("o_spare")) / 2 - slack
    sized = (F.col("n") >= share * F.col("o_n") - slack) & (F.col("o_n") >= share * F.col("n") - slack)
    apart = (F.col("comp") != F.col("o_comp")) & (F.col("spare") <= F.col("o_spare"))
    # rows of one text compress to almost nothing, so Spark would take the table for a small one and broadcast it
    near = index.join(other.hint("merge"), ["hub", "sign", "token"]).where(apart & sized & shared)
    pairs = near.select("node", F.col("o_node").alias("other")).union(placed.where("node != hub").select("node", "hub"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, share: float = 0.8) -> DataFrame:
    """One row (doc_id, component_id) per row of ``docs`` with an id; component_id is the smallest id reachable over links of Jaccard ``share`` or more.

    Words and shingles are those of the fingerprints. Texts without words are alike. Rows without an id take no part; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    marked = materialize(_sketched(rows, shingle_words), "similar")
    firsts = materialize(marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "similar-firsts")
    # the smallest SimHash class stands for its fingerprints: what is within three bits shares a bucket
    prints = connected_components(materialize(fingerprint_links(marked.select("fp").distinct()), "similar-prints"), name="similar-prints")
    simhash = marked.select("node", "fp").distinct().join(prints.withColumnRenamed("node", "fp"), "fp", "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("bucket"), "node")
    placed = materialize(marked.select(F.explode("bands").alias("bucket"), "node").union(simhash).distinct(), "similar-placed")
    shared = materialize(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "similar-buckets")
    live = materialize(spread_join(placed, shared, ["bucket"], "node", _most(shared, "n")).select("bucket", "node", F.col("node").alias("comp")), "similar-live")
    sets = materialize(_sets(rows, firsts, live.select("node").distinct(), shingle_words), "similar-sets")
    release_shuffles(docs.sparkSession)
    count = firsts.agg(F.count("*").alias("size"), F.coalesce(F.max("copies"), F.lit(0)).alias("copies")).first()
    size, links, tested, at = count["size"], None, None, 0
    while True:
        sizes = live.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        total = sizes.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n") - F.col("same")), F.lit(0.0)).alias("p"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
        apart, most = total["p"] / 2, total["most"]
        if not apart:
            break
        last = apart <= FEW_PAIRS * size and at or at >= HUB_ROUNDS
        if last:
            pairs = _difference_pairs(live, sets, share, most)
        else:
            hubs = live.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(at)), "node", "comp")).alias("h")).select("bucket", F.col("h.node").alias("hub"), F.col("h.comp").alias("hub_comp"))
            pairs = spread_join(live, hubs, ["bucket"], "node", most).where("comp != hub_comp").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        pairs = materialize(pairs if tested is None else pairs.join(tested.hint("merge"), ["a", "b"], "left_anti"), "similar-pairs")
        met = _verified(pairs, sets, share)
        links = materialize(met if links is None else links.union(met), "similar-links")
        release_shuffles(docs.sparkSession)
        if last:
            break
        tested = pairs if tested is None else tested.union(pairs)
        classes = connected_components(links, name="similar")
        live = live.select("bucket", "node").join(classes.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
        mixed = live.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        live, at = materialize(spread_join(materialize(live, "similar-classes") if most > HOT_ROWS else live, mixed, ["bucket"], "node", most).select("bucket", "node", "comp"), "similar-live"), at + 1
    if links is None:
        return spread_join(marked, firsts, ["node"], "doc_id", count["copies"]).select("doc_id", F.col("first_id").alias("component_id"))
    members = materialize(connected_components(links, name="similar").join(firsts.hint("merge"), "node"), "similar-members")
    smallest = materialize(members.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "similar-smallest")
    linked = spread_join(members, smallest, ["component"], "node", _most(smallest, "members")).select("node", "component_id")
    final = firsts.join(linked.hint("merge"), "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    return spread_join(marked.select("doc_id", "node"), final, ["node"], "doc_id", count["copies"]).select("doc_id", "component_id")
