"""SpotSigs fingerprints in DataFrame expressions: chains of content words that follow common words.

A text is lower-cased and cut into runs of letters and digits. Each anchor (a common word) makes one spot signature: its
name and the CHAIN content words that follow it, other anchors in between being skipped. The fingerprint of a text is
the set of its spot signatures' hashes. A text with words but without a spot has one signature, of all its words; a null
text or one without words has none. Likeness is the Jaccard index; two empty sets are alike by 1, one by 0.

Rows that repeat an id are texts each, in order of text; null ids come first; all rows of one id are ordered by one task.
The only row of a table is its own next. An empty table gives an empty result. Columns of the table other than id and text
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import cut

#: Common words of the languages that the texts are in.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für ist mit nicht und von zu "
    "dans de des du en est et la le les pour que qui sur un une "
    "con del el es las los por se su una y"
).split()
CHAIN = 2
MARK = "\u0001"


def marked_words(text: Column) -> Column:
    """Content words in order, each with the anchors that follow it; before the first one stands `^`."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    anchors = "|".join(sorted(set(ANCHORS)))
    return F.split(F.regexp_replace(F.concat(F.lit("^ "), plain), f" (?=(?:{anchors})(?: |$))", MARK), " ")


def signatures(marked: Column) -> Column:
    """Sorted distinct 64-bit hashes of the spot signatures of marked_words()."""
    content = lambda k: F.substring_index(F.get(marked, k), MARK, 1)
    spots = F.filter(F.sequence(F.lit(0), F.greatest(F.size(marked) - 1, F.lit(0))), lambda k: (k < F.size(marked) - CHAIN) & F.get(marked, k).contains(MARK))
    each = lambda k: F.transform(F.slice(F.split(F.get(marked, k), MARK), 2, 1 << 30), lambda a: F.xxhash64(a, *(content(k + i) for i in range(1, CHAIN + 1))))
    found = F.flatten(F.transform(spots, each))
    whole = F.when(F.array_join(marked, " ").isin("^", "^ "), F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(marked, " "))))
    return F.array_sort(F.array_distinct(F.when(F.size(found) > 0, found).otherwise(whole)))


def with_signatures(df: DataFrame, text: Column, name: str) -> DataFrame:
    return df.withColumn("_marked", marked_words(text)).withColumn(name, signatures(F.col("_marked"))).drop("_marked")


def fingerprint(sigs: Column) -> Column:
    """A string that is equal for equal sets: their size and a digest."""
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), F.md5(F.array_join(sigs.cast("array<string>"), ",").cast("binary")))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """The Jaccard index; 0 without a comparison where the sizes alone keep it below at_least."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (low + high - shared)
    return F.when(high == 0, 1.0).when((low == 0) | (low < at_least * high), 0.0).when(a == b, 1.0).otherwise(exact)


def edited(text: Column, other: Column) -> Column:
    """text, the last half of its code points replaced by as many (or all) of the first ones of other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text, sigs, next_text, next_sigs): each row with the next one by id and text; the last one with the first.

    Null ids come first and null texts are empty. Ids are dealt to ranges by their quantiles, so no task orders all
    rows; the first row of each range is sent to the range before as well. The driver gets two numbers a range.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = sorted(set(cuts))
    step = max(1, int(len(bounds) ** 0.5))
    number = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda b: b <= F.col("key")))
    coarse = below(number(bounds[::step]))  # of each step-th bound; then those after the last of these
    start = F.greatest(coarse - 1, F.lit(0)) * step
    rows = rows.withColumn("part", F.when(coarse == 0, 0).otherwise(start + below(F.slice(number(bounds), start + 1, step))) if bounds else F.lit(0))
    firsts = [(r.part, r.first) for r in rows.groupBy("part").agg(F.min("key").alias("first")).orderBy("part").collect()]
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    rows = rows.join(F.broadcast(spark.createDataFrame(before, "key long, before int")), "key", "left")
    copies = F.array(F.struct("part", F.lit(False).alias("copy")), F.struct(F.col("before").alias("part"), F.lit(True).alias("copy")))
    rows = rows.select("id", "key", "text", F.inline(F.filter(copies, lambda c: c.part.isNotNull())))
    # one range a task: `deal` has the number that Spark's hash sends to the range's own task
    spare = spark.range(32 * n).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("task")).groupBy("task").agg(F.min("id").alias("id"))
    sends = {r.task: r.id for r in spare.collect()}
    deal = F.get(F.array(*(F.lit(int(sends.get(i, i))) for i in range(n))), F.col("part") % n).cast("int")
    rows = with_signatures(rows.withColumn("deal", deal).repartition(n, "deal"), F.col("text"), "sigs")
    order = Window.partitionBy("deal", "part").orderBy("copy", "key", "text")
    nexts = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sigs", F.lead("sigs").over(order))
    return nexts.where(~F.col("copy")).select(F.col("id").alias(id_col), "text", "sigs", "next_text", "next_sigs")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) of all rows, and pairs (a, b, likeness) of classes that are alike by at_least or more.

    Rows of equal sets form a class, named by its smallest id; texts without words are in none (class_id null). Set
    lengths are dealt to partitions so that alike sets are in the same or the next one; in these, sets meet by the rarest
    of their signatures, as many as an alike set can't all lack, and are compared where their sizes permit.
    """
    rows = with_signatures(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.col("text"), "sigs").drop("text")
    rows = cut(rows.withColumn("digest", F.when(F.size("sigs") > 0, fingerprint(F.col("sigs")))))
    classes = rows.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("class_id"), F.first("sigs").alias("sigs"))
    members = rows.join(classes.drop("sigs"), "digest", "left").select(F.col("id").alias(id_col), "class_id")
    sets = cut(classes.select(F.col("class_id").alias("id"), "sigs", F.size("sigs").alias("n")))
    each = sets.select("id", "n", F.explode("sigs").alias("sig"))
    ranked = each.join(each.groupBy("sig").agg(F.count("*").alias("known")).where("known > 1"), "sig")
    rare = ranked.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("known", "sig"))).alias("common"))
    # signatures that no other set has come first; those are met by none
    length = F.col("n") - F.ceil(F.col("n") * at_least - 1e-9) + 1
    held = F.slice("common", 1, F.greatest(length - (F.col("n") - F.size("common")), F.lit(0)).cast("int"))
    part = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / at_least)) + 1e-9) if at_least < 1 else F.col("n")
    prefix = rare.select("id", "n", part.alias("part"), F.explode(held).alias("c")).select("id", "n", "part", F.col("c.sig").alias("sig"))
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    fits = (F.col("na") <= F.col("nb")) & (F.col("na") >= at_least * F.col("nb") - 1e-9) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    pairs = left.join(prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sig", "part"), ["sig", "part"]).where(fits).select("a", "b").distinct()
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("of_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("of_b")), "b")
    alike = joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("of_a"), F.col("of_b"), at_least).alias("likeness"))
    return members, alike.where(F.col("likeness") >= at_least)
