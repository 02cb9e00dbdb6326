"""Chat formatting by quotation linking. DataFrame functions only.

Quoted lines are parsed with their nesting level. Normalised passages of them, whole runs of lines
and single lines, are hashed and matched with the earlier message of the conversation that wrote them.
A message whose quotation leads to another message than the one before it opens a branch there.
Conversations are given branch by branch in order of reply, without the quotations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.llm.common import checkpointed

#: Turns that one block or one piece of a written conversation covers; none holds more, however long it gets.
BLOCK = 512
#: Letters and digits from which any passage of a message can be quoted; shorter quotations only lead to messages that say no more than that.
LEAST_CHARS = 8

QUOTE = r"^(([ \t]*>)+)"
#: Lines that announce a quotation, when a quoted line follows.
ANNOUNCES = r"^(On .+ wrote|Am .+ schrieb .+|Le .+ a écrit|El .+ escribió)[ ]?:[ ]*$"


def _lines(messages: DataFrame) -> DataFrame:
    """A row for each line: (conv_id, turn, message, pos, level, normal); announcements of quotations have level -1.

    message is a hash of the role and the text, so that no line carries its whole message along.
    """
    message = F.xxhash64("role", "text")
    each = messages.select("conv_id", "turn", message.alias("message"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    marks = F.expr(f"transform(lines, x -> regexp_extract(x, r'{QUOTE}', 1))")
    each = each.withColumn("marks", marks)
    parsed = F.transform(
        "lines",
        lambda x, k: F.struct(
            k.alias("pos"),
            F.when((F.get("marks", k) == "") & (F.coalesce(F.get("marks", k + 1), F.lit("")) != "") & x.rlike(ANNOUNCES), -1).otherwise(F.length(F.regexp_replace(F.get("marks", k), "[^>]", ""))).alias("level"),
            F.substring(x, F.length(F.get("marks", k)) + 1, F.length(x)).alias("body"),
        ),
    )
    lines = each.select("conv_id", "turn", "message", F.explode(parsed).alias("line")).select("conv_id", "turn", "message", "line.*")
    return lines.withColumn("normal", F.expr(_normal("body"))).drop("body")


def _normal(body: str) -> str:
    """An expression for the letters and digits of a passage, in lower case."""
    return f"regexp_replace(lower({body}), r'[^\\p{{L}}\\p{{N}}]+', '')"


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, chars) of each passage: a run of lines of one level up to an empty line, or one line.

    Of the unquoted passages with fewer than LEAST_CHARS letters and digits, only those that are the whole message count.
    """
    lines = _lines(messages).where("level >= 0")
    message = Window.partitionBy("conv_id", "turn", "message").orderBy("pos")
    starts = (F.col("level") != F.coalesce(F.lag("level").over(message), F.lit(-9))) | (F.col("normal") == "") | (F.coalesce(F.lag("normal").over(message), F.lit("")) == "")
    runs = lines.withColumn("run", F.sum(starts.cast("int")).over(message.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = runs.groupBy("conv_id", "turn", "message", "run", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "normal"))), lambda x: x.normal), "").alias("normal"))
    both = lines.select("conv_id", "turn", "level", "normal").unionByName(grouped.select("conv_id", "turn", "level", "normal"))
    both = both.where((F.length("normal") >= LEAST_CHARS) | ((F.col("level") > 0) & (F.col("normal") != "")))
    wholes = unquoted(messages).select("conv_id", "turn", F.lit(0).alias("level"), F.expr(_normal("text")).alias("normal"))
    both = both.unionByName(wholes.where(F.length("normal").between(1, LEAST_CHARS - 1)))
    return both.distinct().select("conv_id", "turn", "level", F.md5("normal").alias("hash"), F.length("normal").alias("chars"))


def replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) of the turns whose quotations lead to an earlier turn.

    Each quoted passage leads to the latest earlier turn that wrote it unquoted. The innermost unresolved
    levels are passed over: the outermost level that leads anywhere counts, on it the turn with the
    most quoted characters, and of such the latest.
    """
    quoting = messages.where(F.col("text").rlike(r"(?m)" + QUOTE)).select("conv_id").distinct()
    found = checkpointed(passages(messages.join(quoting, "conv_id", "left_semi")))
    wrote = F.max(F.when(F.col("level") == 0, F.col("turn")))
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = found.withColumn("target", wrote.over(earlier)).where("level > 0 and target is not null")
    scored = linked.groupBy("conv_id", "turn", "level", "target").agg(F.sum("chars").alias("chars"))
    best = F.max_by("target", F.struct(-F.col("level"), F.col("chars"), F.col("target")))
    return scored.groupBy("conv_id", "turn").agg(best.alias("reply_to"))


def branches(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, reply_to, branch): the turn that each turn answers, and the first turn of its branch.

    A turn without a resolved quotation answers the turn before it. Running values are taken within
    blocks of turns and over one row a block, so no task gets a whole conversation.
    """
    turns = messages.select("conv_id", "turn").distinct().join(replies(messages), ["conv_id", "turn"], "left").withColumn("block", F.floor(F.col("turn") / block))
    turns = checkpointed(turns)
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    over = Window.partitionBy("conv_id").orderBy("block")
    last = turns.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    last = last.withColumn("last_before", F.lag("last").over(over)).select("conv_id", "block", "last_before")
    turns = turns.withColumn("before", F.lag("turn").over(inside)).join(last, ["conv_id", "block"]).withColumn("before", F.coalesce("before", "last_before"))
    opens = F.col("before").isNull() | (F.coalesce("reply_to", "before") != F.col("before"))
    turns = turns.withColumn("start", F.when(opens, F.col("turn"))).withColumn("reply_to", F.coalesce("reply_to", "before"))
    turns = checkpointed(turns.select("conv_id", "turn", "block", "reply_to", "start"))
    starts = turns.groupBy("conv_id", "block").agg(F.max("start").alias("start"))
    starts = starts.withColumn("start_before", F.max("start").over(over.rowsBetween(Window.unboundedPreceding, -1))).select("conv_id", "block", "start_before")
    running = F.max("start").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("running", running).join(starts, ["conv_id", "block"]).select("conv_id", "turn", "reply_to", F.coalesce("running", "start_before").alias("branch"))


def unquoted(messages: DataFrame) -> DataFrame:
    """The messages with quoted lines and the lines that announce them taken out of the text, and the space around it."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    keep = F.filter(
        F.transform(F.col("lines"), lambda x, k: F.struct(x.alias("x"), (x.rlike(QUOTE) | (x.rlike(ANNOUNCES) & F.coalesce(F.get("lines", k + 1).rlike(QUOTE), F.lit(False)))).alias("quoted"))),
        lambda s: ~s.quoted,
    )
    text = F.regexp_replace(F.array_join(F.transform(keep, lambda s: s.x), "\n"), r"^\s+|\s+$", "")
    return messages.withColumn("lines", lines).withColumn("text", text).drop("lines")


def conversations(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, branch, piece, reply_to, n_messages, text): branches in order of reply, without quotations.

    branch is the first turn of the branch, reply_to the turn that this first turn answers (null for the first of the
    conversation). text has "role: words" for each message in order of turn, then of role and text, with
    an empty line between two. Branches of more than a block of turns come in several pieces. A null
    text counts as empty and a null role as "user"; quotations without letters or digits lead nowhere; repeated rows count once; rows without a
    conversation or a turn have no place in one and are left out. Other columns are not read.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = checkpointed(rows.where("conv_id is not null and turn is not null").distinct())
    places = checkpointed(branches(rows, block))
    pieces = unquoted(rows).join(places, ["conv_id", "turn"]).withColumn("piece", F.floor(F.col("turn") / block))
    message = F.struct("turn", "role", "text")
    grouped = pieces.groupBy("conv_id", "branch", "piece").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(message)).alias("messages"))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(": "), m.text)), "\n\n")
    first = places.where("turn = branch").select("conv_id", "branch", "reply_to")
    return grouped.join(first, ["conv_id", "branch"]).select("conv_id", "branch", "piece", "reply_to", "n_messages", text.alias("text"))


def oracle_sql(block: int = BLOCK) -> str:
    """The same over DuckDB's table conversations."""
    return rf"""
with m as (select distinct conv_id::bigint as conv_id, turn::bigint as turn, coalesce(role, 'user') as role, coalesce(text, '') as text
    from conversations where conv_id is not null and turn is not null)
, numbered as (select *, row_number() over () as id from m)
, raw as (select id, conv_id, turn, role, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as pos from numbered)
, marked as (select *, regexp_extract(x, '{QUOTE}', 1) as mark from raw)
, follow as (select *, coalesce(lead(mark) over (partition by id order by pos), '') as mark_after from marked)
, lines as (select *, case when mark = '' and mark_after <> '' and regexp_matches(x, '{ANNOUNCES}') then -1 else length(regexp_replace(mark, '[^>]', '', 'g')) end as level,
    regexp_replace(lower(substr(x, length(mark) + 1)), '[^\p{{L}}\p{{N}}]+', '', 'g') as normal from follow)
, flagged as (select *, case when level <> coalesce(lag(level) over w, -9) or normal = '' or coalesce(lag(normal) over w, '') = '' then 1 else 0 end as start
    from lines where level >= 0 window w as (partition by id order by pos))
, runs as (select *, sum(start) over (partition by id order by pos) as run from flagged)
, grouped as (select conv_id, turn, level, string_agg(normal, '' order by pos) as normal from runs group by id, conv_id, turn, run, level)
, wholes as (select conv_id, turn, 0 as level, coalesce(string_agg(normal, '' order by pos) filter (where level = 0), '') as normal from lines group by id, conv_id, turn)
, passages as (select distinct conv_id, turn, level, normal from (select conv_id, turn, level, normal from runs union all select * from grouped) where length(normal) >= {LEAST_CHARS} or level > 0 and normal <> ''
    union select * from wholes where length(normal) between 1 and {LEAST_CHARS} - 1)
, linked as (select q.conv_id, q.turn, q.level, q.normal, max(o.turn) as target from passages q join passages o
    on q.conv_id = o.conv_id and q.normal = o.normal and o.level = 0 and o.turn < q.turn where q.level > 0 group by 1, 2, 3, 4)
, scored as (select conv_id, turn, level, target, sum(length(normal)) as chars from linked group by 1, 2, 3, 4)
, best as (select conv_id, turn, target from scored qualify row_number() over (partition by conv_id, turn order by level, chars desc, target desc) = 1)
, turns as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as before from (select distinct conv_id, turn from m))
, opened as (select turns.*, coalesce(target, before) as reply_to, case when before is null or coalesce(target, before) <> before then turns.turn end as start
    from turns left join best on best.conv_id = turns.conv_id and best.turn = turns.turn)
, places as (select *, max(start) over (partition by conv_id order by turn) as branch from opened)
, bodies as (select id, conv_id, turn, role, regexp_replace(coalesce(string_agg(x, chr(10) order by pos) filter (where level = 0), ''), '^\s+|\s+$', '', 'g') as text from lines group by 1, 2, 3, 4)
select b.conv_id as conv_id, p.branch as branch, floor(b.turn / {block})::bigint as piece, f.reply_to as reply_to, count(*) as n_messages,
    string_agg(b.role || ': ' || b.text, chr(10) || chr(10) order by b.turn, b.role, b.text) as text
from bodies b join places p on p.conv_id = b.conv_id and p.turn = b.turn join places f on f.conv_id = p.conv_id and f.turn = p.branch
group by 1, 2, 3, 4
"""
