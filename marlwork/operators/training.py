"""Training sets: sampling, splits, near-duplicates, preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlwork.sources.durable import few, kept


def drawn(key: Column, seed: int = 42) -> Column:
    """A stable stand-in for a random order: the md5 of key and seed, alike in every engine."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def prefix(key: Column, seed: int) -> Column:
    """The first 16 bits of drawn(), by which rows fall into bins that are in its order."""
    return F.conv(F.substring(drawn(key, seed), 1, 4), 16, 10).cast("int")


def binned(rows: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """by, bin, bin_rows and upto: how many rows of each `by` fall into each bin of the stable random order, and into it and those before."""
    counts = rows.groupBy(by, prefix(F.col(key), seed).alias("bin")).agg(F.count("*").alias("bin_rows"))
    return counts.withColumn("upto", F.sum("bin_rows").over(Window.partitionBy(by).orderBy("bin")))  # 65,536 rows of one `by` at most


def at_places(rows: DataFrame, by: str, key: str, wanted: DataFrame, seed: int = 42) -> DataFrame:
    """wanted (by, place, ...) with the key of the row of its `by` that stands at `place` (from 0) in the stable random order.

    The bin that a place falls into is told by counts; the rows of that bin alone are put in order, so that no task
    holds a whole group. Rows and wishes without a `by` don't take part.
    """
    before = F.col("upto") - F.col("bin_rows")
    found = wanted.join(binned(rows, by, key, seed), by).where((F.col("place") < F.col("upto")) & (F.col("place") >= before))
    found = few(found.withColumn("inner", F.col("place") - before).drop("bin_rows", "upto"))
    inside = rows.select(by, key, prefix(F.col(key), seed).alias("bin")).join(found.select(by, "bin").distinct(), [by, "bin"], "left_semi")
    order = Window.partitionBy(by, "bin").orderBy(drawn(F.col(key), seed), key)
    return found.join(inside.withColumn("inner", F.row_number().over(order) - 1), [by, "bin", "inner"]).select(*wanted.columns, key)


def stratified(rows: DataFrame, by: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """`target` rows, as many of each stratum as of any other; the larger strata share the rest.

    Strata with fewer rows than their quota give whole copies of all they have, and a sample for what remains. Rows
    without a stratum are a stratum of their own. The rows of a sample are those before a place in the stable random
    order: bins of that order are taken whole up to the one that the place falls into, of which alone rows are ordered.
    """
    sizes = rows.groupBy(by).agg(F.count("*").alias("size"))
    # One row per stratum from here on; the ordering of strata is over this small table.
    order = Window.orderBy(F.desc("size"), by)
    totals = sizes.agg(F.count("*").alias("strata"))
    base = F.greatest(F.lit(1), F.floor(F.lit(target) / F.col("strata")))
    quotas = sizes.withColumn("stratum_place", F.row_number().over(order)).crossJoin(F.broadcast(totals))
    quota = base + F.when(F.col("stratum_place") <= target - base * F.col("strata"), 1).otherwise(0)
    quotas = quotas.where(F.col("stratum_place") <= target).select(F.col(by).alias("marlwork_by"), quota.alias("quota"), "size")
    quotas = few(quotas.select("marlwork_by", F.floor(F.col("quota") / F.col("size")).alias("whole"), (F.col("quota") % F.col("size")).alias("rest")))
    bins = binned(rows, by, key, seed).withColumnRenamed(by, "marlwork_own")
    edge = bins.join(quotas, bins["marlwork_own"].eqNullSafe(quotas["marlwork_by"])).where((F.col("rest") <= F.col("upto")) & (F.col("rest") > F.col("upto") - F.col("bin_rows")))
    edge = edge.select(F.col("marlwork_own").alias("marlwork_edge"), F.col("bin").alias("edge"), (F.col("rest") - F.col("upto") + F.col("bin_rows")).alias("take"))
    limits = few(quotas.join(edge, quotas["marlwork_by"].eqNullSafe(edge["marlwork_edge"]), "left").select("marlwork_by", "whole", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("take", F.lit(0)).alias("take")))
    placed = rows.withColumn("bin", prefix(F.col(key), seed))
    placed = placed.join(limits, placed[by].eqNullSafe(limits["marlwork_by"]))
    sure = placed.where("bin <> edge").withColumn("copies", F.col("whole") + (F.col("bin") < F.col("edge")).cast("int"))
    inner = F.row_number().over(Window.partitionBy(by, "bin").orderBy(drawn(F.col(key), seed), key))
    split = placed.where("bin = edge").withColumn("copies", F.col("whole") + (inner <= F.col("take")).cast("int"))
    some = sure.unionByName(split).where("copies > 0")
    return some.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(by, *(x for x in rows.columns if x != by))


def isolated_split(rows: DataFrame, by: str, share: float = 0.15, seed: int = 42, least: int = 30) -> DataFrame:
    """rows with `split`: whole groups of `by` go to eval, `share` of them and one at least; then the largest others until eval has `least` rows.

    Rows without a group are a group of their own.
    """
    groups = rows.groupBy(F.col(by).alias("marlwork_by")).agg(F.count("*").alias("size"))
    order = Window.orderBy(drawn(F.col("marlwork_by"), seed), "marlwork_by")
    ranked = groups.withColumn("place", F.row_number().over(order)).crossJoin(F.broadcast(groups.agg(F.count("*").alias("n"))))
    ranked = ranked.withColumn("drawn", F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") * share)))
    # Rows that eval has before a group moves: those of the drawn groups, and of the larger others.
    earlier = Window.orderBy(F.desc("drawn"), F.desc("size"), "place").rowsBetween(Window.unboundedPreceding, -1)
    moves = F.coalesce(F.sum("size").over(earlier), F.lit(0)) < least
    side = few(ranked.select("marlwork_by", F.when(F.col("drawn") | moves, F.lit("eval")).otherwise(F.lit("train")).alias("split")))
    return rows.join(side, rows[by].eqNullSafe(side["marlwork_by"])).select(*rows.columns, "split")


def stable_id(instruction: Column, citation: Column, chunk_id: Column) -> Column:
    return F.concat(F.lit("eval_"), F.substring(F.sha2(F.concat_ws("|", instruction, citation, chunk_id), 256), 1, 12))


def first_of_text(rows: DataFrame, by: str, key: str, text: str) -> DataFrame:
    """by, id and t: the smallest key of each distinct text (in lower case) of a group. Rows without a text go."""
    return rows.where(F.col(text).isNotNull()).groupBy(by, F.lower(text).alias("t")).agg(F.min(key).alias("id"))


def similar_pairs(rows: DataFrame, by: str, key: str, text: str, least: float = 0.8) -> DataFrame:
    """by, a, b, similarity of texts of one group whose edit distance leaves more than `least` of the longer text.

    Equal texts, in any case, count as one with their smallest key, as first_of_text() has them. An edit changes two pairs
    of neighbouring letters at most, so similar texts share many of them, and a rare one: each text is found under the
    rarest pairs of which one must be shared, and only texts that meet there are compared. `least` is above 0.5.
    """
    if least <= 0.5:
        raise ValueError("least must be above 0.5")
    low = kept(first_of_text(rows, by, key, text))
    n = F.length("t")
    # The k-th occurrence of a pair of letters is a token of its own; texts of one letter have their text as token.
    couples = F.when(n < 2, F.array("t")).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(F.col("t"), i, F.lit(2))))
    numbered = F.transform(F.array_sort(couples), lambda c, i: F.struct(c.alias("c"), (i - F.array_position(F.array_sort(couples), c)).alias("k")))
    tokens = low.where(n > 0).select(by, "id", n.alias("n"), F.explode(numbered).alias("x"))
    common = few(tokens.groupBy("x").agg(F.count("*").alias("df")))
    need = F.greatest(F.lit(1), F.floor((2 * least - 1) * F.col("n") - 1 - 1e-9) + 1)
    taken = F.greatest(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1)) - need + 1).cast("int")
    rare = tokens.join(common, "x").groupBy(by, "id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("xs"))
    rare = rare.select(by, "id", "n", F.explode(F.slice("xs", F.lit(1), taken)).alias("x")).select(by, "id", "n", "x.x")
    left, right = (rare.select(by, "x", F.col("id").alias(a), F.col("n").alias(f"n_{a}")) for a in "ab")
    met = left.join(right, [by, "x"]).where("a < b").where(F.least("n_a", "n_b") > least * F.greatest("n_a", "n_b") - 1e-9).select(by, "a", "b").distinct()
    texts = lambda a: low.select(by, F.col("id").alias(a), F.col("t").alias(f"t_{a}"))
    pairs = met.join(texts("a"), [by, "a"]).join(texts("b"), [by, "b"])
    alike = F.round(1 - F.levenshtein("t_a", "t_b") / F.greatest(F.length("t_a"), F.length("t_b")), 6)
    return pairs.withColumn("similarity", alike).where(F.col("similarity") > least).select(by, "a", "b", "similarity")


def keep_first_similar(rows: DataFrame, by: str, key: str, text: str, least: float = 0.8) -> DataFrame:
    """rows without those that are similar to an earlier row (in the order of `key`) of their group that stays.

    Of equal texts, in any case, the first alone can stay; rows without a text or with an empty one stay. In rounds over
    all groups at once: a row without an earlier neighbour stays, and its later neighbours go. Each round settles one
    row of every chain at least and is kept durably; no group is collected.
    """
    left = kept(similar_pairs(rows, by, key, text, least).select("a", "b").distinct())
    gone = left.select(F.col("b").alias("gone")).limit(0)
    while not left.isEmpty():
        stays = left.select(F.col("a").alias("stays")).distinct().join(left.select("b"), F.col("stays") == F.col("b"), "left_anti")
        goes = kept(left.join(stays, left["a"] == stays["stays"], "left_semi").select(F.col("b").alias("gone")).distinct())
        gone = gone.union(goes)
        # Pairs of rows that are settled say nothing more: every neighbour of a row that stays goes.
        left = left.join(goes, left["a"] == goes["gone"], "left_anti")
        left = kept(left.join(goes, left["b"] == goes["gone"], "left_anti"))
    first = first_of_text(rows, by, key, text).where(F.length("t") > 0).select(F.col(by).alias("marlwork_by"), F.col("t").alias("marlwork_t"), F.col("id").alias("marlwork_first"))
    own = rows.join(first, (rows[by] == F.col("marlwork_by")) & (F.lower(rows[text]) == F.col("marlwork_t")), "left")
    own = own.where(F.col("marlwork_first").isNull() | (F.col("marlwork_first") == F.col(key))).select(*rows.columns)
    return own.join(gone, own[key] == gone["gone"], "left_anti")


def told_apart(rows: DataFrame, key: str, instruction: str, section: str) -> DataFrame:
    """rows with instructions that repeat, in any case, marked by their section; the row of the smallest key stays as it is.

    Rows without an instruction repeat none and stay as they are.
    """
    same = F.lower(F.trim(instruction))
    first = few(rows.where(same.isNotNull()).groupBy(same.alias("marlwork_same")).agg(F.min(key).alias("marlwork_first")))
    repeats = F.col("marlwork_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("marlwork_first"))
    marked = F.when(repeats, F.concat_ws("", instruction, F.lit(" ["), section, F.lit("]"))).otherwise(F.col(instruction))
    return rows.join(first, same == F.col("marlwork_same"), "left").withColumn(instruction, marked).select(*rows.columns)
