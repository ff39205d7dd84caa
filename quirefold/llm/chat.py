"""Chat formatting in DataFrame expressions: a dialogue from the view of each of its speakers.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as
named users; masks are the spans of characters that the assistant says, its end mark included. Speakers named in `system`
give context and aren't participants. `<|` in texts and names becomes `< |`, so that only the format makes marks.

A rendering comes in parts that make the whole one after another: a part has the turns of one range of TURNS turn
numbers. Where repeated turn numbers make a range larger than LARGE turns, it is cut at turns, then by the hash of the
turns' contents, then by count, so no task holds an unbounded dialogue.

Turns are in order of turn number (null last), then of the hash of speaker and text. Rows that repeat a turn are rendered
as often. A null speaker is `unknown`, a null text empty; rows without conversation are a conversation of their own
(null). Conversations without participants have no rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS, LARGE = 64, 512
#: Ranges above LARGE that are broadcast at most; beyond, Spark joins as it sees fit.
BROADCAST = 100_000
END = "<|end|>\n"


def plain(text: Column, otherwise: str) -> Column:
    return F.replace(F.coalesce(text, F.lit(otherwise)), F.lit("<|"), F.lit("< |"))


def _cut_large(turns: DataFrame) -> DataFrame:
    """turns with `at` (what orders the parts) and, where one row is very often repeated, cut into several rows."""
    keys = ["conv", "range"]
    large = turns.groupBy(*keys).agg(F.sum("copies").alias("rows")).where(F.col("rows") > LARGE)
    few = large.count()
    whole = F.struct(F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("hash"), F.lit(0).alias("copy"))
    if not few:
        return turns.withColumn("at", whole)
    same = lambda x, y: (x["conv"].eqNullSafe(y["conv"])) & (x["range"].eqNullSafe(y["range"]))
    flag = large.select("conv", "range", F.lit(True).alias("large")).alias("l")
    flag = F.broadcast(flag) if few <= BROADCAST else flag
    t = turns.alias("t")
    marked = t.join(flag, same({c: F.col(f"t.{c}") for c in keys}, {c: F.col(f"l.{c}") for c in keys}), "left").select("t.*", "large")
    small = marked.where("large is null").drop("large").withColumn("at", whole)
    big = marked.where("large").drop("large")
    known = big.groupBy("conv", "turn").agg(F.count("*").alias("distinct"))
    b, k = big.alias("b"), known.alias("k")
    big = b.join(k, F.col("b.conv").eqNullSafe(F.col("k.conv")) & F.col("b.turn").eqNullSafe(F.col("k.turn"))).select("b.*", "distinct")
    # hashes are even over all longs: their upper bits deal the contents of one turn to parts in order
    bits = F.ceil(F.log2(F.greatest(F.col("distinct") / TURNS, F.lit(1)))).cast("int")
    upper = F.when(bits > 0, F.expr("shiftright(hash, 64 - greatest(1, cast(ceil(log2(greatest(distinct / %d, 1))) as int)))" % TURNS)).otherwise(0)
    big = big.withColumn("part_hash", upper).withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / LARGE).cast("int"))))
    held = F.least(F.col("copies") - F.col("copy") * LARGE, F.lit(LARGE))
    whole = F.col("copies") <= LARGE
    at = F.struct("turn", F.col("part_hash").cast("long").alias("hash"), F.when(whole, 0).otherwise(F.col("copy") + 1).cast("int").alias("copy"))
    return small.unionByName(big.withColumn("at", at).withColumn("copies", held).select(small.columns))


def perspectives(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_col, speaker, part, n_turns, text, masks (array of start and end in the part), char_offset (of the part)."""
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), plain(F.col(speaker_col), "unknown").alias("speaker"), plain(F.col(text_col), "").alias("text"))
    turns = rows.groupBy("conv", "turn", "speaker", "text").agg(F.count("*").alias("copies"))
    turns = turns.withColumns({"range": F.floor(F.col("turn") / TURNS), "hash": F.xxhash64("speaker", "text")})
    turns = _cut_large(turns)
    said = F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), "hash", "speaker", "text", "copies")
    parts = turns.groupBy("conv", "range", "at").agg(F.array_sort(F.collect_list(said)).alias("turns"))
    order = Window.partitionBy("conv").orderBy(F.col("range").asc_nulls_last(), F.col("at.turn").asc_nulls_last(), "at.hash", "at.copy")
    parts = parts.withColumn("part", F.row_number().over(order) - 1)
    parts = parts.withColumn("turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(F.struct(t.speaker.alias("speaker"), t.text.alias("text")), t.copies.cast("int")))))
    people = rows.where(~F.col("speaker").isin(*system)).select(F.col("conv").alias("of"), F.col("speaker").alias("self")).distinct()
    views = parts.join(people, F.col("conv").eqNullSafe(F.col("of")))

    def head(t: Column) -> Column:
        own = F.when(t.speaker == F.col("self"), "<|assistant|>\n").when(t.speaker.isin(*system), F.concat(F.lit("<|"), t.speaker, F.lit("|>\n")))
        return own.otherwise(F.concat(F.lit("<|user:"), t.speaker, F.lit("|>\n")))

    views = views.withColumn("said", F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t.text, F.lit(END)).alias("body"), (t.speaker == F.col("self")).alias("own"))))
    views = views.withColumn("text", F.array_join(F.transform("said", lambda s: F.concat(s.head, s.body)), ""))
    sizes = F.transform("said", lambda s: F.length(s.head) + F.length(s.body))
    views = views.withColumn("starts", F.transform(F.sequence(F.lit(0), F.size("said") - 1), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x)))
    spans = F.transform(F.arrays_zip("said", "starts"), lambda z: F.struct(z.said.own.alias("own"), (z.starts + F.length(z.said.head)).alias("start"), (z.starts + F.length(z.said.head) + F.length(z.said.body)).alias("end")))
    views = views.withColumn("masks", F.transform(F.filter(spans, lambda s: s.own), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))))
    before = Window.partitionBy("conv", "self").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0)).alias("char_offset")
    return views.select(F.col("conv").alias(conv_col), F.col("self").alias("speaker"), "part", F.size("turns").alias("n_turns"), "text", "masks", offset)
