"""Chat formatting: quoted passages are linked to the messages they come from, and conversations ordered by reply."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, discard, table, written

#: A line's quote marks, and a line that announces a quotation.
MARKS = r"^(?:[ \\t]?>)+"
ANNOUNCED = r"^(?i)(?:on|am|le|el) .{1,200}(?:wrote|schrieb|écrit|escribió) ?: *$"


def carried(df: DataFrame, key: list[str], order: list[str], **columns: tuple[str, str]) -> DataFrame:
    """df with columns that run along the rows of a key in order, name=(aggregate, column): the aggregate, sum or max,
    over the rows up to each one, itself included, as a written table.

    A key may hold any share of the rows: rows are dealt out by ranges of key and order, the aggregates run inside
    each range, and what the ranges before it add up to is joined to them.
    """
    dealt = written(df.repartitionByRange(*key, *order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy(*key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    run = {"sum": F.sum, "max": F.max}
    parts = dealt.groupBy(*key, "part").agg(*(run[how](c).alias(f"{n}_of") for n, (how, c) in columns.items()))
    parts = parts.select(*(F.col(k).alias(f"{k}_k") for k in key), F.col("part").alias("part_k"), *(run[how](f"{n}_of").over(ahead).alias(f"{n}_ahead") for n, (how, _) in columns.items()))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_k")) for k in [*key, "part"]))
    out = dealt.withColumns({n: run[how](c).over(inside) for n, (how, c) in columns.items()}).join(checkpoint(parts), same)
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest}
    out = out.withColumns({n: both[how](F.col(n), F.col(f"{n}_ahead")) for n, (how, _) in columns.items()})
    made = written(out.select(*df.columns, *columns))
    discard(dealt)
    return made


def ranked(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with each row's place (0, 1, ...) among the rows of its key, as a written table; equal rows in any order."""
    rows = carried(df.withColumn("one", F.lit(1).cast("long")), [key], order, **{name: ("sum", "one")})
    return rows.withColumn(name, F.col(name) - 1).drop("one")


def parsed(messages: DataFrame) -> DataFrame:
    """messages with own (the text without quotations and their announcements), own_lines (its lines with words,
    normalised) and quotes: the quoted passages, runs of lines of one level, as structs of level and normalised lines.

    Lines become "level tab text", and a regular expression cuts them at changes of the level, so a long text is
    passed over once. Quoted lines without words belong to no passage and end none.
    """
    line = f"struct(length(translate(regexp_extract(x, '{MARKS}', 0), ' \t', '')) as level, regexp_replace(x, '{MARKS}', '') as text)"
    df = messages.selectExpr("*", f"transform(split(coalesce(text, ''), '\n'), x -> {line}) as parts")
    announces = f"p.text rlike '{ANNOUNCED}' and coalesce(get(parts, i + 1).level, 0) > 0"
    normal = lambda x: f"trim(lower(regexp_replace({x}, '\\\\s+', ' ')))"
    marked = f"array_join(transform(filter(parts, p -> p.level = 0 or p.text rlike '\\\\S'), p -> concat(p.level, '\t', if(p.level = 0, '', {normal('p.text')}))), '\n')"
    runs = f"regexp_extract_all({marked}, '(?m)^([1-9][0-9]*)\\t[^\\n]*+(?:\\n\\\\1\\t[^\\n]*+)*+', 0)"
    df = df.selectExpr("*", f"array_join(filter(parts, (p, i) -> p.level = 0 and not ({announces})).text, '\n') as own", f"{runs} as runs")
    lines = "split(regexp_replace(r, '(?m)^[0-9]+\\t', ''), '\n')"
    return df.selectExpr(
        "* except (parts, runs)",
        f"filter(transform(split(own, '\n'), x -> {normal('x')}), x -> x <> '') as own_lines",
        f"transform(runs, r -> struct(cast(substring_index(r, '\t', 1) as int) as level, {lines} as lines)) as quotes",
    )


def sources(rows: DataFrame) -> DataFrame:
    """(conv, place, source): for each message that quotes earlier ones of its conversation, the place of the one that
    it answers. Of the lowest quote level found: a message that holds a whole passage before one that holds single
    lines, the one with most of the lines, the latest of equal ones.

    What is looked for, whole passages and their single lines, is hashed. A passage is joined to messages by the hash of
    the line of it that fewest messages of the conversation have, then checked in full. A quotation's source is the latest
    holder before it: a running maximum over holders and quotations in the order of the conversation, so that neither
    a common line nor a long conversation makes pairs of quotations and holders.
    """
    asked = rows.where("size(quotes) > 0").select("conv", "place", F.inline("quotes"))
    whole = "struct(1 as whole, array_join(lines, '\n') as unit, lines)"
    asked = asked.selectExpr("conv", "place", "level", f"inline(array_union(array({whole}), transform(lines, x -> struct(0 as whole, x as unit, array(x) as lines))))")
    asked = checkpoint(asked.selectExpr("conv", "place", "level", "whole", "unit", "xxhash64(unit) as hash", "lines"))
    units = checkpoint(asked.groupBy("conv", "hash", "unit").agg(F.first("lines").alias("lines")))  # a unit is its lines
    held = rows.select("conv", "place", F.explode(F.array_distinct("own_lines")).alias("text"))
    looked = units.select("conv", F.explode(F.array_distinct("lines")).alias("text")).distinct()
    same = lambda a, b, *more: reduce(and_, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("conv", *more)))
    held = checkpoint(held.alias("a").join(looked.alias("b"), same("a", "b", "text"), "left_semi"))
    counts = held.groupBy("conv", "text").agg(F.count(F.lit(1)).alias("n"))
    parts = units.select("conv", "hash", "unit", F.size("lines").alias("size"), F.explode(F.array_distinct("lines")).alias("text")).alias("a")
    parts = parts.join(counts.alias("b"), same("a", "b", "text")).select("a.*", "n")
    keys = checkpoint(parts.groupBy("conv", "hash", "unit", "size").agg(F.min(F.struct("n", "text"))["text"].alias("text")))
    hits = keys.alias("a").join(held.alias("b"), same("a", "b", "text")).select("a.conv", "hash", "unit", "size", "place")
    single = hits.where("size = 1").drop("size")
    full = hits.where("size > 1").alias("a").join(rows.alias("b"), same("a", "b", "place"))
    full = full.where("contains(concat('\n', array_join(own_lines, '\n'), '\n'), concat('\n', unit, '\n'))").select("a.conv", "hash", "unit", "a.place")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    holders = single.unionByName(full).select("conv", "hash", "unit", (2 * F.col("place") + 1).alias("at"), F.col("place").alias("holder"), none("asker", "long"), none("level", "int"), none("whole", "int"), none("n", "long"))
    askers = asked.groupBy("conv", "hash", "unit", "place", "level", "whole").agg(F.max(F.size("lines")).cast("long").alias("n"))
    askers = askers.select("conv", "hash", "unit", (2 * F.col("place")).alias("at"), none("holder", "long"), F.col("place").alias("asker"), "level", "whole", "n")
    found = carried(holders.unionByName(askers), ["conv", "hash", "unit"], ["at"], source=("max", "holder")).where("asker is not null and source is not null")
    votes = found.groupBy("conv", "asker", "level", "whole", "source").agg(F.sum("n").alias("n"))
    best = F.min_by("source", F.struct("level", -F.col("whole"), -F.col("n"), -F.col("source")))
    return votes.groupBy("conv", F.col("asker").alias("place")).agg(best.alias("source"))


def paths(branches: DataFrame) -> DataFrame:
    """(conv, branch, thread) for branches(conv, branch, up), up the branch that it leaves, null for a first one: the
    branches from the first to its own. Pointers double, so a chain of n takes log n rounds."""
    now = checkpoint(branches.select("conv", "branch", "up", F.array("branch").alias("thread")))
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("conv").alias("c"), F.col("branch").alias("b"), F.col("up").alias("next"), F.col("thread").alias("head"))
        joined = now.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("up") == F.col("b")), "left")
        now = checkpoint(joined.select("conv", "branch", F.col("next").alias("up"), F.when(F.col("head").isNull(), F.col("thread")).otherwise(F.concat("head", "thread")).alias("thread")))
    return now.drop("up")


def reply_order(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) with place, parent_place, n_quotes (quoted lines with words), thread (places
    where branches begin, from the first to the message's own), position and own, the text without quotations; row
    holds the columns given.

    A message answers the message that it quotes, else the one before it. Answering an earlier one begins a branch;
    position orders a conversation so that a branch follows the branch it leaves, and replies follow what they
    answer. place is the message's number by turn (ties by role, then text; equal rows in any order). A null
    conv_id is a conversation too, a null text an empty message, a null turn the first. An empty table gives no rows.
    A conversation may hold any share of the rows; a text may be very long, and is one row in one task.
    """
    df = messages.select(F.struct(*messages.columns).alias("row"), F.col("conv_id").alias("conv"), "turn", "role", "text")
    rows = parsed(ranked(df, "conv", ["turn", "role", "text"], "place"))
    rows = written(rows.select("row", "conv", "place", "own", "own_lines", "quotes", F.expr("aggregate(quotes, 0L, (s, q) -> s + size(q.lines))").alias("n_quotes")))
    answers = checkpoint(sources(rows.select("conv", "place", "own_lines", "quotes"))).select(F.col("conv").alias("c"), F.col("place").alias("p"), "source")
    rows = rows.join(answers, F.col("conv").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left")
    rows = rows.withColumn("parent", F.coalesce("source", F.when(F.col("place") > 0, F.col("place") - 1)))
    # a branch is a run of messages that each answer the one before
    begins = F.when(F.col("parent").isNull() | (F.col("parent") < F.col("place") - 1), F.col("place"))
    rows = carried(rows.select("row", "conv", "place", "parent", "own", "n_quotes", begins.alias("begins")), ["conv"], ["place"], branch=("max", "begins"))
    at = rows.select(F.col("conv").alias("c"), F.col("place").alias("p"), F.col("branch").alias("up"))
    first = rows.where("begins is not null").select("conv", "branch", "parent")
    branches = first.join(at, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("p")), "left").select("conv", "branch", "up")
    threads = paths(branches).select(F.col("conv").alias("c"), F.col("branch").alias("b"), "thread")
    out = rows.join(threads, F.col("conv").eqNullSafe(F.col("c")) & (F.col("branch") == F.col("b")))
    out = out.select("row", F.col("conv").alias("conv_id"), "place", F.col("parent").alias("parent_place"), "n_quotes", "thread", "own")
    return ranked(out, "conv_id", ["thread", "place"], "position")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with the one it answers, its position in reply order, and its text without quotations."""
    out = reply_order(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "row.turn", "row.role", "parent_place", "n_quotes", F.array_join("thread", ",").alias("thread"), "position", F.col("own").alias("text"))


OP3_SQL = """
with m as (select conv_id, turn, role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn, role, text) - 1 as place from conversations),
x as (select *, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from m),
y as (select *, length(replace(regexp_extract(line, '^(?:[ \\t]?>)+'), ' ', '')) as level, regexp_replace(line, '^(?:[ \\t]?>)+', '') as rest from x),
own as (select conv_id, place, string_agg(case when level = 0 then rest end, chr(10) order by i) as own, count(*) filter (where level > 0 and regexp_matches(rest, '\\S')) as n_quotes from y group by conv_id, place)
select m.conv_id, turn, role, (case when m.place > 0 then m.place - 1 end)::bigint as parent_place, n_quotes::bigint as n_quotes, '0' as thread, m.place::bigint as position, coalesce(own, '') as text
from m join own on m.conv_id = own.conv_id and m.place = own.place
"""
