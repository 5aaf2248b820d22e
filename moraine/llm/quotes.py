r"""Chat formatting by linking quotations.

A line that starts with `>` signs is quoted, as deep as it has signs; a line such
as "X wrote:" right before quoted lines announces them.  Lines of one level that
stand side by side are a passage, and a quoted line without words ends one.  A
passage is normalised (lower case, all white space single spaces, so line breaks
don't count) and hashed.  What a message says itself offers its passages to be
quoted: the whole of it, its paragraphs, and every run of lines within a paragraph.
Runs of up to `RUN` lines are all hashed; of the longer ones, which grow with the
square of a paragraph's lines, those whose beginning some quoted passage of the
conversation shares and that end at a line where that passage does.  A quoted
passage is joined to the first message of the same conversation that offers it, its
original, and a message replies to the original that most of its shallowest linked
passages come from, the latest among equals.

The SQL stops at runs of four lines; beyond those the operator links what it leaves out.

A thread is named by its first message.  `format_chats` keeps every message, without
quoted lines, announcements and white space around, and `conversations` orders each thread's messages so
that replies follow what they answer.

Defined results: a null text gives an empty one and neither quotes nor is quoted; a
null turn neither links nor is linked to and keeps itself as thread; a null
conversation is one of its own, apart from that named ""; quotes of nothing earlier
are removed and link to nothing; rows of equal conversation and turn are told apart
by their texts, of which the first in the order of a hash stands for the turn as an
answer; rows equal in all three are told by nothing and all stay; columns other than
the four are not read, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, scratch, settled

QUOTED = r"^[ \t]*>"
_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
ANNOUNCED = r"(?i)(?:\b(?:wrote|writes|said|schrieb|escribió|a écrit)[ \t]*:[ \t]*)$"
#: Runs of up to so many lines of a paragraph are hashed without looking at what is quoted.
RUN = 4
#: Of a quoted passage so many characters are looked up at most; what begins alike is then held against all of it.
HEAD = 1024


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\x{a0}]+", " ")))


def _blank(line: Column) -> Column:
    return ~line.rlike(r"[^\s\x{a0}]")


def _unquoted(text: Column) -> Column:
    """The lines a message says itself."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    quoted = lambda x: x.rlike(QUOTED)
    # A line's neighbour comes from the array moved up by one, so each line is looked at once.
    pairs = F.arrays_zip(lines.alias("a"), F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit(""))).alias("b"))
    return F.transform(F.filter(pairs, lambda x: ~quoted(x["a"]) & ~(x["a"].rlike(ANNOUNCED) & quoted(x["b"]))), lambda x: x["a"])


def _grouped(lines: Column, level: Column) -> Column:
    """Runs of (level, line) whose neighbours have equal levels, as (level, lines); a level of 0 ends a run and has none."""
    kind = "array<struct<level: int, lines: array<string>>>"
    tagged = F.transform(lines, lambda x: F.struct(level(x).cast("int").alias("level"), x.alias("line")))
    held = F.aggregate(
        tagged,
        F.struct(F.array().cast(kind).alias("done"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("open")),
        lambda a, x: F.when((x["level"] > 0) & (x["level"] == a["level"]), F.struct(a["done"].alias("done"), a["level"].alias("level"), F.concat(a["open"], F.array(x["line"])).alias("open"))).otherwise(
            F.struct(
                F.when(a["level"] > 0, F.concat(a["done"], F.array(F.struct(a["level"].alias("level"), a["open"].alias("lines"))))).otherwise(a["done"]).alias("done"),
                x["level"].alias("level"),
                F.when(x["level"] > 0, F.array(x["line"])).otherwise(F.array().cast("array<string>")).alias("open"),
            )
        ),
        lambda a: F.when(a["level"] > 0, F.concat(a["done"], F.array(F.struct(a["level"].alias("level"), a["open"].alias("lines"))))).otherwise(a["done"]),
    )
    return held


def _depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, _MARKS, "")


def _hashed(rows: DataFrame, *columns: str, head: bool = False) -> DataFrame:
    """The `columns`, and two hashes of the column `passage`, normalised, where it has any word.

    `head` adds its length, the largest power of two in that up to `HEAD`, and a hash of so many characters at its beginning.
    """
    plain = rows.select(*columns, _plain(F.col("passage")).alias("plain")).where("plain <> ''")
    held = plain.select(*columns, F.xxhash64("plain").alias("h1"), F.sha2("plain", 256).alias("h"), *([F.length("plain").alias("length"), F.col("plain")] if head else []))
    if not head:
        return held
    held = held.withColumn("power", F.least(F.expr("shiftleft(1, length(bin(length)) - 1)"), F.lit(HEAD)))
    return held.withColumn("head", F.xxhash64(F.substring("plain", F.lit(1), F.col("power")))).drop("plain")


def _long_runs(paragraphs: DataFrame, quoting: DataFrame, folder: str) -> DataFrame:
    """(c, t, passage) of the runs of more than `RUN` lines that a passage of `quoting` may be; `paragraphs` has (c, t, lines)."""
    # Each paragraph by the first message that has it, its normalised lines, and where they begin in its text of them, the end plus one last.
    lengths = F.transform("lines", lambda x: F.length(_plain(x)))
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n + 1))
    by = paragraphs.where(F.size("lines") > RUN).groupBy("c", "lines").agg(F.min("t").alias("t"))
    held = settled(by.select("c", "t", "lines", starts.alias("starts"), F.transform("lines", _plain).alias("plain"), F.monotonically_increasing_id().alias("p")), f"{folder}/paragraphs")
    # `RUN` + 1 lines have so many characters at least, with the spaces between them.
    wanted = quoting.where(F.col("length") > 2 * RUN).select("c", "power", "head", "length").distinct()
    powers = wanted.groupBy("c").agg(F.collect_set("power").alias("powers"))
    # All beginnings of a paragraph come from one row, as rows of one start each would repeat its lines; k characters are k / 2 + 1 lines at most.
    fitting = lambda i: F.filter("powers", lambda k: i + k < F.element_at("starts", -1))
    begin = lambda j, k: F.substring(F.array_join(F.slice("plain", j + 1, F.shiftright(k, 1) + 1), " "), F.lit(1), k)
    begun = F.transform(F.slice("starts", F.lit(1), F.size("lines") - RUN), lambda i, j: F.transform(fitting(i), lambda k: F.struct(i.alias("start"), k.alias("power"), F.xxhash64(begin(j, k)).alias("head"))))
    heads = held.join(powers, "c").select("c", "p", F.explode(F.flatten(begun)).alias("x"))
    hits = heads.select("c", "p", "x.*").join(wanted, ["c", "power", "head"]).groupBy("p").agg(F.collect_set(F.struct("start", "length")).alias("hits"))
    first = lambda x: F.array_position("starts", x["start"]).cast("int")
    after = lambda x: F.array_position("starts", x["start"] + x["length"] + 1).cast("int")
    ended = F.filter("hits", lambda x: after(x) > first(x) + RUN)
    return held.join(hits, "p").select("c", "t", F.explode(F.transform(ended, lambda x: F.array_join(F.slice("lines", first(x), after(x) - first(x)), "\n"))).alias("passage"))


def _offered(said: DataFrame, quoting: DataFrame, folder: str) -> DataFrame:
    """(c, t, passage) of all that the lines `said` (c, t, lines) may be quoted by, of longer runs what `quoting` may hold."""
    whole = said.select("c", "t", F.array_join("lines", "\n").alias("passage"))
    paragraphs = said.select("c", "t", F.explode(_grouped(F.col("lines"), lambda x: F.when(_blank(x), 0).otherwise(1))).alias("block")).select("c", "t", F.col("block.lines").alias("lines"))
    n = F.size("lines")
    starts = F.sequence(F.lit(1), n)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), n - i + 1)), lambda k: F.array_join(F.slice("lines", i, k), "\n"))))
    cut = paragraphs.select("c", "t", F.explode(F.array_append(runs, F.array_join("lines", "\n"))).alias("passage"))
    return whole.union(cut).union(_long_runs(paragraphs, quoting, folder))


def _linked(messages: DataFrame, conv: str, turn: str, role: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    folder = scratch(messages.sparkSession)
    # A null conversation has a key that no other has; only the four columns go on, under names of our own.
    rows = messages.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("c"), F.col(turn).cast("long").alias("t"), F.xxhash64(text).alias("digest"),
        F.col(conv).alias("m_conv"), F.col(turn).alias("m_turn"), F.col(role).alias("m_role"), F.col(text).alias("text"),
    )
    lines = rows.where("t is not null and text is not null")
    quoting = lines.where(F.col("text").rlike(r"(?m)" + QUOTED)).select("c", "t", "digest", F.explode(_grouped(F.split("text", "\n"), lambda x: F.when(_blank(_bare(x)), 0).otherwise(_depth(x)))).alias("block"))
    quoting = quoting.select("c", "t", "digest", F.col("block.level").alias("depth"), F.array_join(F.transform("block.lines", _bare), "\n").alias("passage"))
    quoting = settled(_hashed(quoting, "c", "t", "digest", "depth", head=True), f"{folder}/quoted")
    # Only conversations with quotes offer anything, only passages that somebody quotes are looked up, each by the first message that has it.
    said = lines.join(quoting.select("c").distinct(), "c", "left_semi").select("c", "t", _unquoted(F.col("text")).alias("lines"))
    offered = _hashed(_offered(said, quoting, folder), "c", "t")
    first = offered.join(quoting.select("c", "h1", "h").distinct(), ["c", "h1", "h"], "left_semi").groupBy("c", "h1", "h").agg(F.min("t").alias("original"))
    linked = quoting.join(first, ["c", "h1", "h"]).where("original < t")
    votes = linked.groupBy("c", "t", "digest", "original").agg(F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n"))
    replies = votes.groupBy("c", "t", "digest").agg(F.sum("n").alias("n_linked"), F.max_by("original", F.struct(-F.col("depth"), F.col("n"), F.col("original"))).alias("reply_to"))
    replies = settled(replies, f"{folder}/replies")
    drop_folder(messages.sparkSession, f"{folder}/quoted", f"{folder}/paragraphs")
    paths = _paths(replies, folder)
    quoted = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(QUOTED)))
    joined = rows.join(replies, ["c", "t", "digest"], "left").join(paths.select("c", F.col("t").alias("reply_to"), F.col("path").alias("above")), ["c", "reply_to"], "left")
    above = F.coalesce("above", F.when(F.col("reply_to").isNotNull(), F.array("reply_to")), F.array().cast("array<long>"))
    return joined.select("*", F.btrim(F.array_join(_unquoted(F.col("text")), "\n"), F.lit(" \n")).alias("own"), quoted.cast("long").alias("n_quoted"), F.concat(above, F.when(F.col("t").isNull(), F.array().cast("array<long>")).otherwise(F.array("t"))).alias("path"))


def _paths(replies: DataFrame, folder: str) -> DataFrame:
    """(c, t, path): the turns from a reply's thread down to the reply, itself last, by doubling pointers."""
    now = replies.groupBy("c", "t").agg(F.min_by("reply_to", "digest").alias("top")).select("c", "t", "top", F.array("top", "t").alias("path"))
    now = settled(now, f"{folder}/paths-0")
    for step in range(1, 64):
        up = now.select("c", F.col("t").alias("top"), F.col("top").alias("further"), F.col("path").alias("upper"))
        if now.join(up, ["c", "top"], "left_semi").isEmpty():
            break
        nearer = now.join(up, ["c", "top"], "left")
        path = F.when(F.col("upper").isNull(), F.col("path")).otherwise(F.concat("upper", F.slice("path", F.lit(2), F.size("path"))))
        now = settled(nearer.select("c", "t", F.coalesce("further", "top").alias("top"), path.alias("path")), f"{folder}/paths-{step}")
        drop_folder(replies.sparkSession, f"{folder}/paths-{step - 1}")
    return now


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: (conv, turn, role, text, n_quoted, n_linked, reply_to, thread, depth)."""
    out = _linked(messages, conv, turn, role, text)
    return out.select(
        F.col("m_conv").alias(conv), F.col("m_turn").alias(turn), F.col("m_role").alias(role), F.col("own").alias(text), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to", F.get("path", F.lit(0)).alias("thread"), F.greatest(F.size("path") - 1, F.lit(0)).cast("long").alias("depth"),
    )


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per thread: (conv, thread, messages), its messages (turn, role, text, reply_to, depth) in the order of replies.

    An answer follows what it answers and all earlier answers to it; messages of no turn stand alone in a thread of null.
    """
    out = _linked(messages, conv, turn, role, text)
    entry = F.struct(F.col("path"), F.col("m_turn").alias(turn), F.col("m_role").alias(role), F.col("own").alias(text), F.col("reply_to"), F.greatest(F.size("path") - 1, F.lit(0)).alias("depth"))
    held = out.groupBy("c", F.get("path", F.lit(0)).alias("thread")).agg(F.first("m_conv").alias(conv), F.sort_array(F.collect_list(entry)).alias("messages"))
    return held.select(conv, "thread", F.transform("messages", lambda x: x.dropFields("path")).alias("messages"))


def query(messages: DataFrame) -> DataFrame:
    return format_chats(messages)


ORACLE = r"""
WITH RECURSIVE m AS (SELECT conv_id AS c, turn AS t, role, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT c, t, ls, unnest(range(1, len(ls) + 1)) AS i FROM m),
k AS (
  SELECT c, t, i, ls[i] AS line, regexp_matches(ls[i], '^[ \t]*>') AS q, coalesce(regexp_matches(ls[i + 1], '^[ \t]*>'), false) AS nq,
         regexp_replace(ls[i], '^[ \t]*((?:>[ \t]?)+)', '') AS bare,
         length(regexp_replace(regexp_extract(ls[i], '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS d FROM l),
own AS (
  SELECT c, t, i, line, row_number() OVER (PARTITION BY c, t ORDER BY i) AS j FROM k
  WHERE NOT q AND NOT (nq AND regexp_matches(line, '(?i)\b(wrote|writes|said|schrieb|escribió|a écrit)[ \t]*:[ \t]*$'))),
full_ AS (SELECT c, t, j, line, j - row_number() OVER (PARTITION BY c, t ORDER BY j) AS b FROM own WHERE regexp_matches(line, '[^\s\x{a0}]')),
offers AS (
  SELECT c, t, string_agg(line, chr(10) ORDER BY j) AS p FROM own GROUP BY c, t
  UNION ALL SELECT c, t, string_agg(line, chr(10) ORDER BY j) FROM full_ GROUP BY c, t, b
  UNION ALL
  SELECT a.c, a.t, string_agg(z.line, chr(10) ORDER BY z.j) FROM full_ a CROSS JOIN range(1, 5) r(n) JOIN full_ z ON z.c = a.c AND z.t = a.t AND z.b = a.b AND z.j BETWEEN a.j AND a.j + r.n - 1
  GROUP BY a.c, a.t, a.j, r.n),
said AS (SELECT c, min(t) AS o, lower(trim(regexp_replace(p, '[\s\x{a0}]+', ' ', 'g'))) AS p FROM offers GROUP BY c, 3),
deep AS (SELECT c, t, i, bare, d, i - row_number() OVER (PARTITION BY c, t, d ORDER BY i) AS b FROM k WHERE q AND regexp_matches(bare, '[^\s\x{a0}]')),
quoted AS (SELECT c, t, d, lower(trim(regexp_replace(string_agg(bare, chr(10) ORDER BY i), '[\s\x{a0}]+', ' ', 'g'))) AS p FROM deep GROUP BY c, t, d, b),
votes AS (SELECT c, t, o, min(d) AS d, count(*) AS n FROM quoted JOIN said USING (c, p) WHERE o < t GROUP BY c, t, o),
replies AS (SELECT c, t, sum(n)::BIGINT AS n_linked, arg_max(o, (-d, n, o)) AS reply_to FROM votes GROUP BY c, t),
up AS (
  SELECT m.c, m.t, m.t AS thread, 0::BIGINT AS depth FROM m LEFT JOIN replies r USING (c, t) WHERE r.reply_to IS NULL
  UNION ALL SELECT r.c, r.t, up.thread, up.depth + 1 FROM replies r JOIN up ON up.c = r.c AND up.t = r.reply_to)
SELECT m.c AS conv_id, m.t AS turn, m.role,
       coalesce((SELECT trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10)) FROM own WHERE own.c = m.c AND own.t = m.t), '') AS text,
       len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*>')))::BIGINT AS n_quoted,
       coalesce(n_linked, 0)::BIGINT AS n_linked, reply_to, up.thread, up.depth
FROM m LEFT JOIN replies USING (c, t) JOIN up USING (c, t)
"""
