"""Chat formatting with quotation linking, in DataFrame functions alone.

Lines are parsed for nested quote levels (leading ``>`` marks). A passage is a run of lines of one level without a blank
one; its lines are normalised (case, white space) and joined, so a re-wrapped quote is the same passage. Passages, and
the lines of longer ones, are hashed and joined to the latest earlier message of the conversation that holds them one level
less deep: what a reply quotes with one mark its parent wrote, what it quotes with two its parent quoted with one. A quote
of two or more marks may also be found where it was written. The message with the most characters at the right levels
is replied to (ties: most of its own words, most found where written, latest). A message without a linked quote replies
to the one before it. A reply to any other message opens a branch; messages are ordered branch by branch, a branch behind
the one it replies to, and their texts lose the quotes.

Each quoted piece has one vote, so nothing is paired within a group, however often a line or a first turn is repeated.
Only conversations with a quote take part in linking.

Defined results: a null text has no lines and gives an empty text; a quote with no original links nothing; messages
of equal conversation and turn are ordered by role and text, and stand for the turn together; a message with null
conv_id is a conversation of its own; a null turn comes first in its conversation and links nothing; an empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, stage, unstage

MARKS = r"^((?:[ \t]*>)+)"
_MARKS_SQL = MARKS.replace("\\", "\\\\")


def _level(x: str) -> str:
    marks = f"regexp_extract({x}, '{_MARKS_SQL}', 1)"
    return f"length({marks}) - length(translate({marks}, '>', ''))"


def quote_pieces(messages: DataFrame) -> DataFrame:
    """Distinct conv_id, turn, level, hash and length of the passages of each message, and of the lines of those with several."""
    norm = f"trim(regexp_replace(lower(regexp_replace(x, '{_MARKS_SQL}', '')), '[ \\\\t\\\\r\\\\x0b\\\\x0c]+', ' '))"
    parsed = f"transform(split(text, '\\n'), x -> named_struct('level', {_level('x')}, 'norm', {norm}))"
    opens = "filter(sequence(0, size(p) - 1), i -> p[i].norm <> '' AND (i = 0 OR p[i - 1].norm = '' OR p[i - 1].level <> p[i].level))"
    run = "filter(slice(p, s[k] + 1, coalesce(get(s, k + 1), size(p)) - s[k]), y -> y.norm <> '').norm"
    passages = f"transform(s, (b, k) -> named_struct('level', p[b].level, 'lines', {run}))"
    rows = messages.where("text IS NOT NULL").select("conv_id", "turn", F.expr(parsed).alias("p"))
    rows = rows.select("conv_id", "turn", "p", F.expr(opens).alias("s")).select("conv_id", "turn", F.explode(F.expr(passages)).alias("q"))
    pieces = F.when(F.size("q.lines") > 1, F.concat(F.array(F.array_join("q.lines", " ")), "q.lines")).otherwise(F.col("q.lines"))
    rows = rows.select("conv_id", "turn", F.col("q.level").alias("level"), F.explode(pieces).alias("norm"))
    return rows.select("conv_id", "turn", "level", F.xxhash64("norm").alias("h"), F.length("norm").alias("n")).distinct()


def quote_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to and n_linked of each message with a linked quote."""
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = known.where("text RLIKE '(?m)^[ \\\\t]*>'").select("conv_id").distinct()
    pieces = quote_pieces(known.join(quoting, "conv_id", "left_semi"))
    held = pieces.select("conv_id", "turn", "h", "n", "level", F.lit(None).cast("string").alias("tier"))
    # a piece looks for itself one level less deep, and, from two on, where it was written
    tiers = F.expr("CASE WHEN level = 1 THEN array(named_struct('level', level - 1, 'tier', 'own')) ELSE array(named_struct('level', level - 1, 'tier', 'deep'), named_struct('level', level * 0, 'tier', 'loose')) END")
    wanted = pieces.where("level > 0").select("conv_id", "turn", "h", "n", F.explode(tiers).alias("t")).select("conv_id", "turn", "h", "n", "t.level", "t.tier")
    earlier = Window.partitionBy("conv_id", "h", "level").orderBy("turn", F.col("tier").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("tier").isNull(), F.col("turn")), ignorenulls=True).over(earlier)
    found = held.unionByName(wanted).withColumn("reply_to", latest).where("tier IS NOT NULL AND reply_to IS NOT NULL")
    chars = lambda tier: F.sum(F.when(F.col("tier").isin(*tier), F.col("n")).otherwise(0))
    votes = found.groupBy("conv_id", "turn", "reply_to").agg(chars(["own", "deep"]).alias("level_chars"), chars(["own"]).alias("own_chars"), chars(["loose"]).alias("loose_chars"), F.count("*").alias("n_linked"))
    best = F.max_by(F.struct("reply_to", "n_linked"), F.struct("level_chars", "own_chars", "loose_chars", "reply_to"))
    return votes.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", "b.reply_to", "b.n_linked")


def branch_paths(branches: DataFrame) -> DataFrame:
    """conv_id, start and path (starts from the root down) of each branch; ``branches``: conv_id, start, parent. Paths grow by
    the path of the branch they reach so far, so the deepest takes as many rounds as its depth has binary digits."""
    paths = stage(branches.select("conv_id", "start", F.col("parent").alias("above"), F.array("start").alias("path")), "paths")
    while not paths.where("above IS NOT NULL").isEmpty():
        up = paths.select("conv_id", F.col("start").alias("above"), F.col("above").alias("next"), F.col("path").alias("upper"))
        more = paths.where("above IS NOT NULL").join(up, ["conv_id", "above"]).select("conv_id", "start", F.col("next").alias("above"), F.concat("upper", "path").alias("path"))
        before, paths = paths, stage(paths.where("above IS NULL").unionByName(more), "paths")
        unstage(before)
    return paths.select("conv_id", "start", "path")


def link_quotations(conversations: DataFrame) -> DataFrame:
    """Every message with its quotes, its reply link, its place in reply order and its text without quotes."""
    messages = conversations.select("conv_id", "turn", "role", "text")
    known = messages.where("conv_id IS NOT NULL")
    links = quote_links(messages)
    turns = known.groupBy("conv_id", "turn").agg(F.count("*").alias("rows"))
    seen = Window.partitionBy("conv_id").orderBy("turn")
    linked = (
        turns.join(links, ["conv_id", "turn"], "left")
        .withColumn("previous", F.lag("turn").over(seen))
        .withColumn("opens", F.col("previous").isNull() | (F.col("reply_to").isNotNull() & (F.col("reply_to") != F.col("previous"))))
        .withColumn("branch", F.max(F.when(F.col("opens"), F.col("turn"))).over(seen.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("reply", F.coalesce("reply_to", "previous"))
    )
    linked = stage(linked, "links")
    opened = linked.where("opens").select("conv_id", F.col("turn").alias("start"), "reply_to")
    parents = linked.select("conv_id", F.col("turn").alias("reply_to"), F.col("branch").alias("parent"))
    branches = stage(opened.where("start IS NOT NULL").join(parents, ["conv_id", "reply_to"], "left").select("conv_id", "start", "parent"), "branches")
    paths = branch_paths(branches).withColumnRenamed("start", "branch")
    placed = linked.join(paths, ["conv_id", "branch"], "left").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "reply", "n_linked", "path")
    rows = known.join(placed, (known["conv_id"] == placed["c"]) & known["turn"].eqNullSafe(placed["t"]), "left")
    order = Window.partitionBy("conv_id").orderBy("path", "turn", "role", "text")
    rows = rows.withColumn("position", F.row_number().over(order) - 1).select("conv_id", "turn", "role", "text", "reply", "n_linked", "path", "position")
    alone = messages.where("conv_id IS NULL").selectExpr("conv_id", "turn", "role", "text", "turn AS reply", "CAST(NULL AS LONG) AS n_linked", "array(turn) AS path", "0 AS position").withColumn("reply", F.when(F.lit(False), F.col("reply"))).withColumn("path", F.when(F.lit(False), F.col("path")))
    quoted = "filter(split(text, '\\n'), x -> x RLIKE '^[ \\\\t]*>')"
    plain = "filter(split(text, '\\n'), x -> NOT (x RLIKE '^[ \\\\t]*>'))"
    depth = f"aggregate(transform({quoted}, x -> {_level('x')}), 0, (a, b) -> greatest(a, b))"
    clean = F.expr(f"trim(BOTH ' \\n\\t\\r' FROM coalesce(array_join({plain}, '\\n'), ''))")
    return rows.unionByName(alone).select(
        "conv_id",
        "turn",
        "role",
        F.coalesce(F.expr(f"size({quoted})"), F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce(F.expr(depth), F.lit(0)).cast("long").alias("quote_levels"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("reply").cast("long").alias("reply_to"),
        F.greatest(F.coalesce(F.size("path"), F.lit(1)), F.lit(1)).cast("long").alias("depth"),
        F.col("position").cast("long").alias("position"),
        clean.alias("clean_text"),
    )


def chat_documents(linked: DataFrame) -> DataFrame:
    """One row for each conversation: its messages in reply order, rendered with role headings."""
    turns = F.sort_array(F.collect_list(F.struct("position", "role", "clean_text")))
    rendered = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "clean_text")
    return linked.withColumn("clean_text", rendered).groupBy("conv_id").agg(F.array_join(turns["clean_text"], "\n").alias("chat"))


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(read_table(spark, sf_dir, "conversations"))


#: The same in DuckDB.
OP4_SQL = r"""
WITH RECURSIVE msg AS (SELECT conv_id, turn, role, text, row_number() OVER () AS rid FROM conversations),
lines AS (SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM msg WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
parsed AS (
  SELECT rid, conv_id, turn, i,
    length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)+)', '')), '[ \t\r\x0b\x0c]+', ' ', 'g')) AS norm
  FROM lines),
opened AS (SELECT *, norm <> '' AND (i = 1 OR lag(norm) OVER w = '' OR lag(level) OVER w <> level) AS opens FROM parsed WINDOW w AS (PARTITION BY rid ORDER BY i)),
numbered AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY rid ORDER BY i) AS run FROM opened),
passages AS (SELECT rid, run, conv_id, turn, any_value(level) AS level, string_agg(norm, ' ' ORDER BY i) AS norm, count(*) AS c FROM numbered WHERE norm <> '' GROUP BY rid, run, conv_id, turn),
pieces AS (
  SELECT conv_id, turn, level, norm FROM passages
  UNION SELECT n.conv_id, n.turn, n.level, n.norm FROM numbered n JOIN passages p ON n.rid = p.rid AND n.run = p.run WHERE n.norm <> '' AND p.c > 1),
seen AS (
  SELECT conv_id, turn, norm, level, NULL AS tier FROM pieces
  UNION ALL SELECT conv_id, turn, norm, level - 1, CASE WHEN level = 1 THEN 'own' ELSE 'deep' END FROM pieces WHERE level > 0
  UNION ALL SELECT conv_id, turn, norm, 0, 'loose' FROM pieces WHERE level > 1),
latest AS (
  SELECT *, last_value(CASE WHEN tier IS NULL THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id, norm, level ORDER BY turn, tier IS NULL ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reply_to FROM seen),
votes AS (
  SELECT conv_id, turn, reply_to, count(*) AS n_linked, sum(CASE WHEN tier <> 'loose' THEN length(norm) ELSE 0 END) AS a, sum(CASE WHEN tier = 'own' THEN length(norm) ELSE 0 END) AS b,
    sum(CASE WHEN tier = 'loose' THEN length(norm) ELSE 0 END) AS c
  FROM latest WHERE tier IS NOT NULL AND reply_to IS NOT NULL GROUP BY ALL),
best AS (SELECT conv_id, turn, reply_to, n_linked FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY a DESC, b DESC, c DESC, reply_to DESC) = 1),
turns AS (
  SELECT t.conv_id, t.turn, b.reply_to, b.n_linked, lag(t.turn) OVER (PARTITION BY t.conv_id ORDER BY t.turn NULLS FIRST) AS previous
  FROM (SELECT DISTINCT conv_id, turn FROM msg WHERE conv_id IS NOT NULL) t LEFT JOIN best b ON t.conv_id = b.conv_id AND t.turn = b.turn),
starts AS (
  SELECT *, previous IS NULL OR coalesce(reply_to <> previous, false) AS opens FROM turns),
branched AS (
  SELECT *, max(CASE WHEN opens THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST ROWS UNBOUNDED PRECEDING) AS branch,
    coalesce(reply_to, previous) AS reply FROM starts),
branches AS (
  SELECT o.conv_id, o.turn AS start, p.branch AS parent
  FROM branched o LEFT JOIN branched p ON o.conv_id = p.conv_id AND o.reply_to = p.turn WHERE o.opens),
paths AS (
  SELECT conv_id, start, [start] AS path FROM branches WHERE parent IS NULL
  UNION ALL
  SELECT b.conv_id, b.start, list_append(p.path, b.start) FROM branches b JOIN paths p ON b.conv_id = p.conv_id AND b.parent = p.start)
SELECT m.conv_id, m.turn, m.role,
  coalesce(len(list_filter(string_split(m.text, chr(10)), lambda x: regexp_matches(x, '^[ \t]*>'))), 0) AS n_quoted,
  coalesce(list_max(list_transform(string_split(m.text, chr(10)), lambda x: length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')))), 0) AS quote_levels,
  coalesce(b.n_linked, 0) AS n_linked, b.reply AS reply_to, coalesce(len(p.path), 1) AS depth,
  CASE WHEN m.conv_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY m.conv_id ORDER BY p.path NULLS FIRST, m.turn NULLS FIRST, m.role NULLS FIRST, m.text NULLS FIRST) - 1 END AS position,
  trim(coalesce(array_to_string(list_filter(string_split(m.text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)), ''), chr(32) || chr(10) || chr(9) || chr(13)) AS clean_text
FROM msg m
LEFT JOIN branched b ON m.conv_id = b.conv_id AND m.turn IS NOT DISTINCT FROM b.turn
LEFT JOIN paths p ON p.conv_id = b.conv_id AND p.start = b.branch
"""
