"""Quotation linking: reply-ordered conversations without quotes.

Quote levels are the leading ``>`` marks of a line (``> >`` or ``>>``).  Consecutive lines of one level are a passage.  Passages are
normalised (lower case, white space collapsed, punctuation at the ends dropped) and hashed; every message offers the hashes of its own
unquoted text as a whole, by passage between quotes, by paragraph and by line, and a quoted passage is joined to the earliest message that offers it: an
earlier turn of its own conversation if there is one, else the first conversation and turn that has it.  A passage that nobody offers as a whole is
broken into the same pieces, and goes to the message that offers most of their characters, of its own conversation if one offers any.  The deepest evidence for a reply is the outermost level:
a message answers the latest earlier turn that it quotes at its lowest level; without a quote it goes on after the turn before it.

``order_key`` sorts a conversation in reply order (a reply stands right after what it answers, ahead of the turns that merely follow), and
``position`` counts it from 0.  Offers are aggregated to one row per hash before they are joined, only offers that are quoted
at all are joined, and quotes of one popular passage are salted.

Defined results: very long messages are parsed in one pass over their lines; other columns, whatever their names, are not read; a null text is the empty text (no own text, no quotes); a null turn sorts first; repeated rows share their key and are ordered
arbitrarily among themselves; a quote that nobody offers links to nothing and is still removed; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed, let, whole_text

SALTS = 32
TURNS_PER_RANGE = 4096
LEVEL = "^((?:> ?)+)"


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, no punctuation or quote marks at the ends."""
    flat = F.regexp_replace(F.lower(text), "[\\s>]+", " ")
    return F.regexp_replace(flat, "^[\\p{Punct}\\s]+|[\\p{Punct}\\s]+$", "")


def lines_of(text: Column) -> Column:
    """Array of struct(level, line): the number of leading ``>`` marks, and the line without them."""
    mark = lambda x: F.regexp_extract(x, LEVEL, 1)
    return F.transform(
        F.split(text, "\r?\n"),
        lambda x: F.struct((F.length(mark(x)) - F.length(F.replace(mark(x), F.lit(">"), F.lit("")))).cast("int").alias("level"), F.regexp_replace(x, LEVEL, "").alias("line")),
    )


def passages_of(lines: Column) -> Column:
    """Array of struct(level, text): consecutive lines of one level, joined."""
    level = lambda i: F.get(lines, i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))

    def passage(s: Column, i: Column, k: Column) -> Column:
        inside = F.slice(lines, i + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - i)
        return F.struct(level(i).alias("level"), F.array_join(F.transform(inside, lambda x: x["line"]), "\n").alias("text"))

    return let(starts, lambda s: F.transform(s, lambda i, k: passage(s, i, k)))


def pieces_of(text: Column) -> Column:
    """The text as a whole, its paragraphs and its lines, each normalised form once, without empty ones."""
    parts = F.concat(F.array(text), F.split(text, "\n\\s*\n"), F.split(text, "\n"))
    return F.filter(F.array_distinct(F.transform(parts, normalised)), lambda x: F.length(x) > 0)


def parsed(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, own_text, own_parts (what stands between quotes), quotes (array of struct(level, text))."""
    raw = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), whole_text(text).alias("text"))
    quoted = F.col("text").rlike("(^|\n)>")
    passages = F.when(quoted, let(lines_of(F.col("text")), passages_of))
    split = raw.withColumn("p", passages)
    parts = F.transform(F.filter("p", lambda x: x["level"] == 0), lambda x: x["text"])
    kept = F.array_join(parts, "\n")
    own = F.when(F.col("p").isNull(), F.col("text")).otherwise(F.regexp_replace(kept, "^\\s+|\\s+$", ""))
    quotes = F.coalesce(F.filter("p", lambda x: (x["level"] > 0) & (F.length(normalised(x["text"])) > 0)), F.array().cast("array<struct<level: int, text: string>>"))
    return split.select("conv_id", "turn", "role", own.alias("own_text"), F.coalesce(parts, F.array().cast("array<string>")).alias("own_parts"), quotes.alias("quotes"))


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, from_conv, from_turn of every quoted passage (nulls where nothing offers it)."""
    passages = messages.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", F.col("q.level").alias("level"), pieces_of(F.col("q.text")).alias("pieces"))
    passages = checkpointed(passages.withColumn("passage", F.monotonically_increasing_id()))
    # the first piece is the whole
    pieces = passages.select("passage", "conv_id", "turn", F.posexplode("pieces").alias("at", "piece"))
    quotes = checkpointed(pieces.select("passage", "conv_id", "turn", (F.col("at") == 0).alias("whole"), F.length("piece").alias("size"), F.sha2("piece", 256).alias("hash")))
    wanted = quotes.select("hash").distinct()
    offered = F.array_distinct(F.concat(pieces_of(F.col("own_text")), F.flatten(F.transform("own_parts", pieces_of))))
    offers = messages.select("conv_id", "turn", F.explode(F.transform(offered, lambda x: F.sha2(x, 256))).alias("hash")).join(wanted, "hash", "left_semi")
    offers = checkpointed(offers.groupBy("hash", "conv_id").agg(F.min("turn").alias("from_turn")))
    # the two first conversations of each hash: the second is for quotes in the first one
    two = offers.withColumn("k", F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))).where("k <= 2")
    offer = F.struct("conv_id", "from_turn")
    anywhere = two.groupBy("hash").agg(F.min(F.when(F.col("k") == 1, offer)).alias("first"), F.min(F.when(F.col("k") == 2, offer)).alias("second")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inside = quotes.alias("q").join(offers.alias("o"), (F.col("q.hash") == F.col("o.hash")) & (F.col("q.conv_id") == F.col("o.conv_id")) & (F.col("o.from_turn") < F.col("q.turn")), "left").select("q.*", F.col("o.from_turn").alias("own_turn"))
    salted = inside.withColumn("salt", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(SALTS)).cast("int"))
    both = salted.join(anywhere, ["hash", "salt"], "left")
    own = F.col("own_turn").isNotNull()
    other = F.when(F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first"))
    found = both.select("passage", "conv_id", "whole", "size", F.when(own, F.col("conv_id")).otherwise(other["conv_id"]).alias("from_conv"), F.when(own, F.col("own_turn")).otherwise(other["from_turn"]).alias("from_turn"))
    votes = found.where("from_turn is not null").groupBy("passage", "conv_id", "from_conv", "from_turn").agg(F.max("whole").alias("whole"), F.sum("size").alias("size"))
    order = F.struct((~F.col("whole")).alias("broken"), (~F.col("from_conv").eqNullSafe(F.col("conv_id"))).alias("outside"), (-F.col("size")).alias("less"), "from_conv", "from_turn")
    best = votes.groupBy("passage").agg(F.min(order).alias("best"))
    return passages.join(best, "passage", "left").select("conv_id", "turn", "level", F.col("best.from_conv").alias("from_conv"), F.col("best.from_turn").alias("from_turn"))


def reply_ordered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, own_text, n_quotes, n_linked, reply_to_conv, reply_to_turn, order_key, position."""
    messages = checkpointed(parsed(df, conv, turn, role, text))
    links = checkpointed(linked(messages))
    lowest = F.struct(F.col("level"), -F.col("from_turn"), "from_turn")
    inner = links.where("from_turn is not null and from_conv = conv_id").groupBy("conv_id", "turn").agg(F.min(lowest)["from_turn"].alias("p"))
    outer = links.where("from_turn is not null and from_conv <> conv_id").groupBy("conv_id", "turn").agg(F.min(F.struct("level", "from_conv", "from_turn")).alias("o"))
    counts = links.groupBy("conv_id", "turn").agg(F.count("from_turn").alias("n_linked"))
    heads = checkpointed(inner.select("conv_id", F.col("turn").alias("head"), "p"))
    paths = checkpointed(_paths(heads))
    # the branch of a message is that of the last linked turn up to it
    branch = with_latest(messages, "turn", heads.select("conv_id", F.col("head").alias("value")), "head")
    keyed = branch.join(paths, ["conv_id", "head"], "left").withColumn("order_key", F.concat(F.coalesce("path", F.array().cast("array<bigint>")), F.array(F.coalesce("turn", F.lit(-1).cast("long")))))
    # position: ranges of the first element of the key, and rows within a range
    spot = F.floor(F.get("order_key", F.lit(0)) / TURNS_PER_RANGE).cast("long")
    keyed = keyed.withColumn("spot", spot)
    before = keyed.groupBy("conv_id", "spot").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("conv_id", "spot", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = keyed.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "spot").orderBy("order_key", "role", "own_text")))
    placed = numbered.alias("k").join(before.alias("b"), F.col("k.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("k.spot") == F.col("b.spot"))).select("k.*", (F.col("b.before") + F.col("k.n") - 1).alias("position"))
    out = placed.join(inner, ["conv_id", "turn"], "left").join(outer, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "own_text", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.when(F.col("p").isNotNull(), F.col("conv_id")).otherwise(F.col("o.from_conv")).alias("reply_to_conv"), F.coalesce("p", "o.from_turn").alias("reply_to_turn"), "order_key", "position",
    )


def with_latest(rows: DataFrame, at: str, values: DataFrame, name: str) -> DataFrame:
    """``rows`` with the greatest value of their conversation up to their ``at`` (null sorts first): an as-of over ranges of turns.

    ``values`` (conv_id, value) and the rows of a range are sorted together; what holds at the start of a range is carried
    from the ranges before it, so a conversation of any length is many tasks and no pairs are made.
    """
    names = rows.columns
    slot = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0)) / TURNS_PER_RANGE).cast("long")
    values = values.distinct().withColumn("__slot", slot("value"))
    left = rows.select("conv_id", slot(at).alias("__slot"), F.col(at).cast("long").alias("__at"), F.lit(1).alias("__side"), F.struct(*(F.col(f"`{n}`") for n in names)).alias("__row"), F.lit(None).cast("long").alias("__value"))
    right = values.select("conv_id", "__slot", F.col("value").alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col("value").alias("__value"))
    together = Window.partitionBy("conv_id", "__slot").orderBy(F.col("__at").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("__local", F.max("__value").over(together)).where("__side = 1")
    slots = left.select("conv_id", "__slot").distinct().join(values.groupBy("conv_id", "__slot").agg(F.max("value").alias("__last")), ["conv_id", "__slot"], "full")
    before = F.max("__last").over(Window.partitionBy("conv_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
    carry = slots.select("conv_id", "__slot", before.alias("__carry")).where("__carry IS NOT NULL")
    joined = found.join(carry, ["conv_id", "__slot"], "left")
    return joined.select(*(F.col("__row")[n].alias(n) for n in names), F.when(F.col("__at").isNotNull(), F.coalesce("__local", "__carry")).alias(name))


def _paths(heads: DataFrame) -> DataFrame:
    """conv_id, head, path: the turns that the branch of a linked turn hangs on, outermost first.

    A branch starts at a linked turn; the turn it answers belongs to the branch of the last linked turn up
    to that one.  Pointers are doubled until every path reaches the trunk: log of the nesting depth rounds.
    """
    if heads.isEmpty():
        return heads.select("conv_id", "head", F.array("p").alias("path")).where("false")
    up = with_latest(heads, "p", heads.select("conv_id", F.col("head").alias("value")), "up")
    state = checkpointed(up.select("conv_id", "head", "up", F.array("p").alias("path")))
    while not state.where("up is not null").isEmpty():
        a, b = state.alias("a"), state.alias("b")
        state = checkpointed(
            a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.up") == F.col("b.head")), "left").select(
                "a.conv_id", "a.head", F.col("b.up").alias("up"), F.concat(F.coalesce("b.path", F.array().cast("array<bigint>")), F.col("a.path")).alias("path")
            )
        )
    return state.select("conv_id", "head", F.col("path").cast("array<bigint>").alias("path"))
