"""Quotation linking for chat formatting, in DataFrame operations only.

Lines that begin with ``>`` are quotes; the number of marks is their level. Consecutive quoted lines
of one level are a passage. A passage, and each of its lines of at least ``LEAST_WORDS`` words, is normalised
(lower case, runs of anything but letters and digits become one space) and hashed. Each message likewise
offers its own words: the whole of them, every paragraph and every line. A quoted hash links to the
newest earlier message of its conversation that offers it; "newest earlier" is one sort of
offers and quotes together for each hash, never a join of all pairs.

A message replies to the message that most of its first-level quoted characters link to (else the
next deeper level's), else to the one before it. Replies that do not follow their parent directly begin a branch;
``reply_order`` is the turns at which branches begin, from the root, and the own turn: sorted by it, a
conversation has every message after its parent and branches together. The text loses its quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

LEAST_WORDS = 3
#: Turns of one conversation that are sorted together.
BUCKET = 1 << 14
_QUOTE = r"^[ \t]*>[ \t>]*"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 0), r"[^>]", ""))


def _content(line: Column) -> Column:
    return F.regexp_replace(line, _QUOTE, "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, passages: what each message says itself, and its quoted passages in order.

    ``passages`` is an array of (level, text); lines of one level in a row are one passage.
    """
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n")
    parsed = F.transform(lines, lambda x: F.struct(_level(x).cast("int").alias("level"), F.when(_level(x) > 0, _content(x)).otherwise(x).alias("line")))
    # a line opens a run where its level is not that of the line before
    marked = F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), F.when(i == 0, True).otherwise(F.col("lines")[i - 1]["level"] != x["level"]).alias("opens")))
    opens = F.filter(F.transform("marked", lambda x, i: F.when(x["opens"], i)), lambda i: i.isNotNull())
    run = F.transform(
        "opens",
        lambda a, k: F.struct(
            F.col("marked")[a]["level"].alias("level"),
            F.array_join(F.transform(F.slice("marked", a + 1, F.coalesce(F.get("opens", k + 1), F.size("marked")) - a), lambda x: x["line"]), "\n").alias("text"),
        ),
    )
    rows = messages.select("conv_id", "turn", "role", parsed.alias("lines"))
    rows = rows.withColumn("marked", marked).withColumn("opens", opens).withColumn("runs", run)
    own = F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["text"]), "\n")
    body = F.trim(F.regexp_replace(F.regexp_replace(own, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t"))
    return rows.select("conv_id", "turn", "role", body.alias("body"), F.filter("runs", lambda r: (r["level"] > 0) & (normalised(r["text"]) != "")).alias("passages"))


def _keys(text: Column, whole: bool = True) -> Column:
    """Hashes of a text: of the whole, its paragraphs, and its lines with enough words."""
    parts = F.concat(F.split(text, r"\n\s*\n"), F.filter(F.split(text, "\n"), lambda x: F.size(F.split(normalised(x), " ")) >= LEAST_WORDS))
    parts = F.concat(F.array(text), parts) if whole else parts
    clean = F.array_distinct(F.filter(F.transform(parts, normalised), lambda x: x != ""))
    return F.transform(clean, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.hash(F.reverse(x)).alias("h2"), F.length(x).alias("size")))


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, parent_turn, chars: what quoted hashes link to, counted by target."""
    offers = parsed.where("body <> ''").select("conv_id", "turn", F.explode(_keys(F.col("body"))).alias("k"))
    offers = offers.select("conv_id", "k.h1", "k.h2", "k.size", "turn", F.lit(None).cast("int").alias("level"))
    asks = parsed.where(F.size("passages") > 0).select("conv_id", "turn", F.explode("passages").alias("p"))
    asks = asks.select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(_keys(F.col("p.text"))).alias("k"))
    # only hashes that someone quotes need a sort; of others no row is moved again
    wanted = asks.select("conv_id", "k.h1", "k.h2").distinct()
    offers = offers.join(wanted, ["conv_id", "h1", "h2"], "left_semi")
    both = offers.unionByName(asks.select("conv_id", "k.h1", "k.h2", "k.size", "turn", "level")).distinct()
    earlier = Window.partitionBy("conv_id", "h1", "h2").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("parent_turn", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(earlier))
    return found.where("level IS NOT NULL AND parent_turn IS NOT NULL").groupBy("conv_id", "turn", "level", "parent_turn").agg(F.sum("size").alias("chars"))


def reply_order(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_passages, n_linked_levels, parent_turn, quoted, branch_depth, reply_order.

    One row for each row of ``messages(conv_id, turn, role, text)``. ``text`` is without quotes;
    ``quoted`` tells that a quote, not the order, named the parent. Null text is empty. Rows with null conv_id
    or turn are returned with no parent and linked with nothing. Rows that repeat conv_id and turn are all
    returned; they share the parent that most of their quotes name. Empty table: no rows. Extra columns
    are not read.
    """
    scratch = Scratch(spark, "quotes")
    parsed = scratch.write(parse(messages), "parsed")
    placed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    linked = scratch.write(links(placed), "links")
    best = linked.groupBy("conv_id", "turn").agg(
        F.min_by("parent_turn", F.struct("level", -F.col("chars"), -F.col("parent_turn"))).alias("quoted_turn"), F.countDistinct("level").alias("n_linked_levels")
    )
    # turns are taken in buckets, so a conversation of any length is dealt out; what a bucket needs of earlier ones is one row each
    turns = placed.select("conv_id", "turn", F.floor(F.col("turn") / BUCKET).alias("bucket")).distinct()
    bucket, earlier = Window.partitionBy("conv_id", "bucket").orderBy("turn"), Window.partitionBy("conv_id").orderBy("bucket")
    last = turns.groupBy("conv_id", "bucket").agg(F.max("turn").alias("last"))
    last = last.select("conv_id", "bucket", F.lag("last").over(earlier).alias("last_before"))
    tree = turns.withColumn("previous", F.lag("turn").over(bucket)).join(last, ["conv_id", "bucket"])
    tree = tree.withColumn("previous", F.coalesce("previous", "last_before")).join(best, ["conv_id", "turn"], "left")
    tree = tree.withColumn("parent_turn", F.coalesce("quoted_turn", "previous")).withColumn("branches", F.coalesce(F.col("parent_turn") != F.col("previous"), F.lit(False)))
    tree = scratch.write(tree.drop("last_before"), "turns")
    # every turn belongs to the newest branch begun at or before it, until quotes take it elsewhere
    begun = F.max(F.when(F.col("branches"), F.col("turn")))
    open_before = tree.groupBy("conv_id", "bucket").agg(begun.alias("begun"))
    open_before = open_before.select("conv_id", "bucket", F.max("begun").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("begun_before"))
    tree = tree.withColumn("branch", begun.over(bucket.rowsBetween(Window.unboundedPreceding, 0))).join(open_before, ["conv_id", "bucket"])
    tree = scratch.write(tree.withColumn("branch", F.coalesce("branch", "begun_before")).drop("bucket", "begun_before"), "tree")
    digits = lambda c: F.lpad((F.col(c) if isinstance(c, str) else c).cast("string"), 20, "0")
    # a branch hangs on the branch of its parent. Paths grow by doubling: each round puts the path of the branch that a path
    # hangs on before it, so there are as many rounds as the depth of nesting has binary digits
    starts = tree.where("branches").select("conv_id", F.col("turn").alias("branch"), "parent_turn")
    above = tree.select("conv_id", F.col("turn").alias("parent_turn"), F.col("branch").alias("up"))
    paths = starts.join(above.hint("merge"), ["conv_id", "parent_turn"]).select("conv_id", "branch", F.concat_ws("/", digits("parent_turn"), digits("branch")).alias("path"), F.lit(1).alias("depth"), "up")
    paths, k = scratch.write(paths, "paths-0"), 0
    while not paths.where("up IS NOT NULL").isEmpty():
        k += 1
        hung = paths.select("conv_id", F.col("branch").alias("up"), F.col("path").alias("p"), F.col("depth").alias("d"), F.col("up").alias("next"))
        more = paths.where("up IS NOT NULL").join(hung.hint("merge"), ["conv_id", "up"]).select("conv_id", "branch", F.concat_ws("/", "p", "path").alias("path"), (F.col("depth") + F.col("d")).alias("depth"), F.col("next").alias("up"))
        paths = scratch.write(paths.where("up IS NULL").unionByName(more), f"paths-{k}")
    shape = tree.join(paths.hint("merge"), ["conv_id", "branch"], "left").select(
        "conv_id", "turn", "parent_turn", F.col("quoted_turn").isNotNull().alias("quoted"), F.coalesce("n_linked_levels", F.lit(0)).alias("n_linked_levels"),
        F.coalesce("depth", F.lit(0)).alias("branch_depth"), F.concat_ws("/", "path", digits("turn")).alias("reply_order"),
    )
    # the written tables are small files of many rows: their size says little about that in memory
    out = parsed.join(shape.hint("merge"), ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.col("body").alias("text"), F.size("passages").alias("n_passages"), F.coalesce("n_linked_levels", F.lit(0)).alias("n_linked_levels"),
        "parent_turn", F.coalesce("quoted", F.lit(False)).alias("quoted"), F.coalesce("branch_depth", F.lit(0)).alias("branch_depth"), F.coalesce("reply_order", F.lit("")).alias("reply_order"),
    )
