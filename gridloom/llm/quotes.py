"""Chat formatting by quotation linking, in DataFrame functions only.

A line that starts with quote marks (``>``, nested ``>>`` or ``> >``) quotes at as many levels.  Runs
of lines of one level are passages.  Passages are normalised (lower case, letters and digits only)
and hashed.  Originals are the unquoted passages of a conversation's messages, whole messages and
single lines.  A quoted passage, or failing that its lines, is joined to the latest earlier message
of the conversation that wrote it.  The message answers the original of its shallowest linked quote.

Messages are then ordered by thread: a message without a link starts one, replies follow the start of
the thread they belong to, in order of turn.  Threads are found by pointer doubling, so their depth
costs a logarithmic number of joins, each written to the shared folder.  Texts lose the lines that were
linked and keep quotes without an original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, ranked, table

MARKS = r"^(?:[ \t]*>)+"
#: turns of one block of a passage's history
TURNS = 1024


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return (F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).cast("int")


def plain(line: Column) -> Column:
    return F.regexp_replace(line, MARKS, "")


def text_key(text_col: str) -> Column:
    """Tells the texts of one conversation and turn apart; null is a text too."""
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def passages(lines: DataFrame) -> DataFrame:
    """``lines`` that are not blank, with ``run``, which numbers the passages of a message."""
    w = Window.partitionBy("conv_id", "turn", "k").orderBy("line_no")
    new = (F.col("level") != F.coalesce(F.lag("level").over(w), F.lit(-1))) | F.col("blank") | F.coalesce(F.lag("blank").over(w), F.lit(False))
    return lines.withColumn("run", F.sum(new.cast("int")).over(w)).where(~F.col("blank"))


def latest_before(asked: DataFrame, original: DataFrame, block: int = TURNS) -> DataFrame:
    """``asked`` (conv_id, hash, t and more) plus ``orig``: the latest turn before t with the same hash in ``original`` (conv_id, hash, t).

    One sorted history of a passage in a conversation, not its quotes paired with its originals.  The
    history is cut into blocks of turns, so a long one is many windows; what lies in earlier blocks comes
    from a table of the blocks' last originals.
    """
    names = [c for c in asked.columns if c not in ("conv_id", "hash", "t")]
    blk = F.floor(F.col("t") / block)
    old = original.where("t is not null").select("conv_id", "hash", "t").distinct().withColumn("blk", blk)
    last = old.groupBy("conv_id", "hash", "blk").agg(F.max("t").alias("last"))
    both = last.unionByName(asked.select("conv_id", "hash", blk.alias("blk")).distinct().withColumn("last", F.lit(None).cast("long")))
    both = both.groupBy("conv_id", "hash", "blk").agg(F.max("last").alias("last"))
    w = Window.partitionBy("conv_id", "hash").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    before = both.select(F.col("conv_id").alias("b_conv"), F.col("hash").alias("b_hash"), F.col("blk").alias("b_blk"), F.max("last").over(w).alias("before"))
    # at equal turns the quote (-1) comes before the original (0): a message is never its own original
    events = asked.withColumn("blk", blk).withColumn("q", F.lit(-1)).unionByName(old.withColumn("q", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("conv_id", "hash", "blk").orderBy("t", "q").rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("near", F.last(F.when(F.col("q") == 0, F.col("t")), ignorenulls=True).over(w)).where("q = -1 and t is not null")
    found = seen.join(before, seen["conv_id"].eqNullSafe(before["b_conv"]) & (seen["hash"] == before["b_hash"]) & (seen["blk"] == before["b_blk"]))
    found = found.select("conv_id", "hash", "t", *names, F.coalesce("near", "before").alias("orig"))
    return found.unionByName(asked.where("t is null").withColumn("orig", F.lit(None).cast("long")))


def link(talk: DataFrame, conv: str = "conv_id", turn: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, k, reply_to, n_quotes, n_linked, linked) of every message that quotes.

    ``k`` is the hash of the text, which tells messages of one conversation and turn apart; rows that
    repeat a message are one.  ``linked`` has the numbers of the lines whose original was found.
    """
    lines = talk.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), text_key(text_col).alias("k"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line")
    ).select("conv_id", "turn", "k", "line_no", level(F.col("line")).alias("level"), F.trim(normal(plain(F.col("line")))).alias("norm"))
    lines = lines.withColumn("blank", F.col("norm") == "")
    quoting = lines.where("level > 0 and not blank").select("conv_id").distinct()
    # conversations without a quote need no originals
    convs = quoting.select(F.col("conv_id").alias("q_conv"))
    some = lines.join(convs, lines["conv_id"].eqNullSafe(convs["q_conv"]), "left_semi").dropDuplicates(["conv_id", "turn", "k", "line_no"])
    rows = cut(passages(some))
    text_of = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "norm"))), lambda x: x["norm"]), " ")
    run = rows.groupBy("conv_id", "turn", "k", "run", "level").agg(F.xxhash64(text_of()).alias("hash"))
    whole = rows.where("level = 0").groupBy("conv_id", "turn", "k").agg(F.xxhash64(text_of()).alias("hash"))
    line = rows.select("conv_id", "turn", "k", "run", "level", "line_no", F.xxhash64("norm").alias("hash"))
    original = run.where("level = 0").select("conv_id", "turn", "hash").unionByName(whole.select("conv_id", "turn", "hash")).unionByName(line.where("level = 0").select("conv_id", "turn", "hash"))
    asked = run.where("level > 0").withColumn("line_no", F.lit(None).cast("int")).unionByName(line.where("level > 0"))
    seen = latest_before(asked.withColumnRenamed("turn", "t"), original.withColumnRenamed("turn", "t"))
    of_run, of_lines = F.col("line_no").isNull() & F.col("orig").isNotNull(), F.col("line_no").isNotNull()
    best = seen.groupBy("conv_id", "t", "k", "run", "level").agg(
        F.max(F.when(of_run, F.col("orig"))).alias("whole"), F.max(F.when(of_lines, F.col("orig"))).alias("part"),
        F.collect_list(F.when(of_lines, F.col("line_no"))).alias("all"), F.collect_list(F.when(of_lines & F.col("orig").isNotNull(), F.col("line_no"))).alias("some"),
    )
    best = best.select("conv_id", "t", "k", "level", F.coalesce("whole", "part").alias("orig"), F.when(F.col("whole").isNotNull(), F.col("all")).otherwise(F.col("some")).alias("lines"))
    return best.groupBy("conv_id", F.col("t").alias("turn"), "k").agg(
        F.min_by("orig", F.when(F.col("orig").isNotNull(), F.struct("level", -F.col("orig")))).alias("reply_to"),
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("orig").alias("n_linked"),
        F.flatten(F.collect_list("lines")).alias("linked"),
    )


def thread_roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of the messages that reply, from (conv_id, turn, reply_to): pointer doubling."""
    now = cut(replies.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("root")).withColumn("depth", F.lit(1).cast("long")))
    while True:
        up = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        nxt = cut(
            now.join(up, now["conv_id"].eqNullSafe(up["c"]) & (now["root"] == up["t"]), "left").select(
                "conv_id", "turn", F.coalesce("r2", "root").alias("root"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("r2").isNotNull().alias("moved")
            )
        )
        drop_cut(now)
        more = not nxt.where("moved").isEmpty()
        now = nxt.drop("moved")
        if not more:
            return now


def conversations(talk: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, position, reply_to, depth, n_quotes, n_linked, text) for each message, without the quotes that were linked.

    position orders a conversation from 0: by the first turn of the thread, then by turn, then by the
    text's hash.  A message that quotes nothing it can be linked to has reply_to null and depth 0.
    Quoted lines without an original stay in the text, as nothing else holds them; blank quoted lines go
    with the linked ones.  Null texts stay null and quote nothing; empty texts stay empty; a null
    conversation is one conversation, a null turn comes first and is never an original; repeated
    messages are all kept and linked alike; very long texts are parsed whole.  Other columns are not read.
    """
    links = cut(link(talk, conv, turn, text_col))
    roots = thread_roots(links.where("reply_to is not null").select("conv_id", "turn", "reply_to"))
    names = talk.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text_col).alias("text"), text_key(text_col).alias("k"))
    a = links.select(*[F.col(c).alias(f"l_{c}") for c in links.columns])
    b = roots.select(F.col("conv_id").alias("r_c"), F.col("turn").alias("r_t"), "root", "depth")
    out = names.join(a, names["conv_id"].eqNullSafe(a["l_conv_id"]) & names["turn"].eqNullSafe(a["l_turn"]) & (names["k"] == a["l_k"]), "left")
    out = out.join(b, out["conv_id"].eqNullSafe(b["r_c"]) & (out["turn"] == b["r_t"]) & F.col("l_reply_to").isNotNull(), "left")
    void = lambda x: (level(x) > 0) & (F.trim(normal(plain(x))) == "")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("l_linked", i) & ~void(x))
    text = F.when(F.col("l_n_linked") > 0, F.btrim(F.array_join(kept, "\n"), F.lit("\n "))).otherwise(F.col("text"))
    out = out.select(
        "conv_id", "turn", "role", F.col("l_reply_to").alias("reply_to"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("l_n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("l_n_linked", F.lit(0)).cast("long").alias("n_linked"),
        text.alias("text"), F.coalesce("root", "turn").alias("__gl_root"), "k",
    )
    out = ranked(out, ["conv_id"], ["__gl_root", "turn", "k"], "position")
    return out.select("conv_id", "turn", "role", "position", "reply_to", "depth", "n_quotes", "n_linked", "text")


def op10_quotation_links(spark, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


_MARKS = r"^(?:[ \t]*>)+"
_LEVEL = "len(regexp_extract({0}, '" + _MARKS + "')) - len(replace(regexp_extract({0}, '" + _MARKS + "'), '>', ''))"
_NORM = "trim(regexp_replace(lower(regexp_replace({0}, '" + _MARKS + r"', '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
SQL = {
    "op10_quotation_links": f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, md5(coalesce(text, '')) AS k FROM conversations),
d AS (SELECT DISTINCT conv_id, turn, k, string_split(text, chr(10)) AS ls FROM m WHERE text IS NOT NULL),
l AS (SELECT conv_id, turn, k, unnest(ls) AS ln, unnest(range(0, len(ls))) AS line_no FROM d),
b AS (SELECT conv_id, turn, k, line_no, {_LEVEL.format("ln")} AS level, {_NORM.format("ln")} AS norm FROM l),
q AS (SELECT DISTINCT conv_id AS c FROM b WHERE level > 0 AND norm <> ''),
s AS (SELECT b.*, norm = '' AS blank FROM b JOIN q ON b.conv_id IS NOT DISTINCT FROM c),
e AS (SELECT *, CASE WHEN level <> coalesce(lag(level) OVER w, -1) OR blank OR coalesce(lag(blank) OVER w, false) THEN 1 ELSE 0 END AS new
      FROM s WINDOW w AS (PARTITION BY conv_id, turn, k ORDER BY line_no)),
r AS (SELECT * FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, k ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM e) WHERE NOT blank),
rn AS (SELECT conv_id, turn, k, run, level, string_agg(norm, ' ' ORDER BY line_no) AS p FROM r GROUP BY ALL),
wh AS (SELECT conv_id, turn, k, string_agg(norm, ' ' ORDER BY line_no) AS p FROM r WHERE level = 0 GROUP BY ALL),
o AS (SELECT DISTINCT conv_id, turn, p FROM (SELECT conv_id, turn, p FROM rn WHERE level = 0 UNION ALL SELECT conv_id, turn, p FROM wh
      UNION ALL SELECT conv_id, turn, norm FROM r WHERE level = 0) WHERE turn IS NOT NULL),
a AS (SELECT conv_id, turn, k, run, level, NULL::BIGINT AS line_no, p FROM rn WHERE level > 0
      UNION ALL SELECT conv_id, turn, k, run, level, line_no, norm FROM r WHERE level > 0),
f AS (SELECT a.conv_id, a.turn, a.k, a.run, a.level, a.line_no, a.p, max(o.turn) AS orig FROM a
      LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM a.conv_id AND o.p = a.p AND o.turn < a.turn GROUP BY ALL),
g AS (SELECT conv_id, turn, k, run, level, max(CASE WHEN line_no IS NULL THEN orig END) AS whole, max(CASE WHEN line_no IS NOT NULL THEN orig END) AS part,
      list(line_no) FILTER (WHERE line_no IS NOT NULL) AS every, list(line_no) FILTER (WHERE line_no IS NOT NULL AND orig IS NOT NULL) AS found FROM f GROUP BY ALL),
h AS (SELECT conv_id, turn, k, level, coalesce(whole, part) AS orig, CASE WHEN whole IS NOT NULL THEN every ELSE found END AS ls FROM g),
x AS (SELECT conv_id, turn, k, arg_min(orig, level * 1000000000000 - orig) FILTER (WHERE orig IS NOT NULL) AS reply_to, count(*) AS n_quotes, count(orig) AS n_linked,
      flatten(list(ls) FILTER (WHERE ls IS NOT NULL)) AS linked FROM h GROUP BY ALL),
p AS (SELECT conv_id, turn, min(reply_to) AS up FROM x WHERE reply_to IS NOT NULL GROUP BY ALL),
t AS (SELECT conv_id, turn, up AS root, 1 AS depth FROM p
      UNION ALL SELECT t.conv_id, t.turn, p.up, depth + 1 FROM t JOIN p ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.turn = t.root),
z AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM t GROUP BY ALL),
y AS (SELECT m.conv_id, m.turn, m.role, m.k, m.text, string_split(m.text, chr(10)) AS ls, x.reply_to, x.n_quotes, x.n_linked, x.linked, z.root, z.depth
      FROM m LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM m.conv_id AND x.turn IS NOT DISTINCT FROM m.turn AND x.k = m.k
      LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM m.conv_id AND z.turn = m.turn AND x.reply_to IS NOT NULL)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(root, turn) NULLS FIRST, turn NULLS FIRST, k) - 1 AS position,
       reply_to, CAST(coalesce(depth, 0) AS BIGINT) AS depth, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
       CASE WHEN n_linked > 0 THEN trim(array_to_string([v FOR v, i IN ls IF NOT list_contains(linked, i - 1)
            AND NOT ({_LEVEL.format("v")} > 0 AND {_NORM.format("v")} = '')], chr(10)), chr(10) || ' ') ELSE text END AS text
FROM y
"""
}
