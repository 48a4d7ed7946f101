"""Quotation linking: messages without their quotes, in the order of replies. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeview.llm.common import forget, text_of, written

_QUOTED = r"(?m)^[ \t]*>[^\n]*(?:\n|\z)"
_MARK, _GAP = "\x01", "\x02"


def normalised(text: Column) -> Column:
    """Lower case, every run of what is neither letter nor digit as one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _passages(text: Column) -> Column:
    """array<struct<level, body>>: each run of lines of one quote level; level 0 is the message's own text."""
    lines = F.split(F.translate(F.regexp_replace(text, r"\r\n?", "\n"), _MARK + _GAP, ""), "\n")
    marks = lambda line: F.regexp_extract(line, r"^[ \t]*((?:>[ \t]?)*)", 1)
    level = lambda line: F.length(F.regexp_replace(marks(line), "[^>]", ""))
    body = lambda line: F.regexp_replace(line, r"^[ \t]*(?:>[ \t]?)+", "")
    parsed = F.transform(lines, lambda x: F.struct(level(x).alias("level"), body(x).alias("body")))
    joined = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.size(F.col("_lines")) - 1),
            lambda i: F.concat(
                F.when((i > 0) & (F.get("_lines", i).level == F.get("_lines", i - 1).level), F.lit("\n")).otherwise(F.concat(F.lit(_MARK), F.get("_lines", i).level.cast("string"), F.lit(_GAP))),
                F.get("_lines", i).body,
            ),
        ),
        "",
    )
    return parsed, F.transform(F.filter(F.split(joined, _MARK), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, _GAP, 1).cast("int").alias("level"), F.substring_index(p, _GAP, -1).alias("body")))


def _pieces(text: Column) -> Column:
    """array<string>: the normalised sentences of each line in their order; a line without an end of sentence is one piece."""
    cut = F.split(text, r"\n|(?<=[.!?\x{2026}\x{3002}])[ \t]+")
    return F.filter(F.transform(cut, normalised), lambda p: p != "")


def _in_order(pieces: Column, held: Column) -> Column:
    """Whether ``held`` has all of ``pieces`` in their order, with others between them or not."""

    def step(at: Column, piece: Column) -> Column:
        found = F.array_position(F.slice(held, at + 1, F.size(held)), piece).cast("int")
        return F.when((at >= 0) & (found > 0), at + found).otherwise(F.lit(-1))

    return F.aggregate(pieces, F.lit(0), step) >= 0


def _holders(quotes: DataFrame, own: DataFrame) -> DataFrame:
    """(conv_id, pkey, holder): the earliest message of ``own`` (conv_id, turn, text) that holds a passage's pieces in order.

    A passage of one piece needs the piece's first message only. Of several pieces the one that the fewest messages
    hold picks the messages to look at, each distinct passage once, however often it is quoted.
    """
    asked = quotes.select("conv_id", "pkey", "pieces").distinct()
    want = asked.select("conv_id", "pkey", F.size("pieces").alias("k"), F.explode(F.array_distinct("pieces")).alias("piece"))
    texts = own.select("conv_id", "turn", _pieces(F.col("text")).alias("held"))
    places = texts.select("conv_id", "turn", F.explode(F.array_distinct("held")).alias("piece")).join(want.select("conv_id", "piece").distinct(), ["conv_id", "piece"], "left_semi")
    known = places.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("holder"))
    found = want.join(known, ["conv_id", "piece"], "left")
    single = found.where("k = 1 and n is not null").select("conv_id", "pkey", "holder")
    rarest = found.where("k > 1").groupBy("conv_id", "pkey").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r")).where("r.n > 0")
    near = rarest.select("conv_id", "pkey", F.col("r.piece").alias("piece")).join(places, ["conv_id", "piece"]).select("conv_id", "pkey", "turn")
    several = near.join(asked, ["conv_id", "pkey"]).join(texts, ["conv_id", "turn"]).where(_in_order(F.col("pieces"), F.col("held")))
    return single.union(several.groupBy("conv_id", "pkey").agg(F.min("turn").alias("holder")))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Link quoted passages to the messages they come from and drop the quotes.

    ``messages``: (conv_id, turn, role, text). A line's quote level is its number of leading ``>`` (spaces between
    them allowed). Each run of lines of one level is a passage. A passage's hash is taken of its normalised text; the
    units a quote can come from are a message's own text as a whole, its runs of unquoted lines, its paragraphs and its lines.
    A quote can also be a part: its pieces, the sentences of its lines, are looked for in the message's own pieces, all of
    them in their order, with others between them or not. A passage is linked to the earliest message of the same
    conversation that has a unit of the same hash or holds its pieces so, and stands before the quoting message. ``reply_to`` is the latest turn linked at the lowest linked level; a thread is a message
    that replies to none, with everything that replies to it, directly or not.

    Returns (conv_id, turn, role, text, n_quotes, n_linked, reply_to, thread, depth), a row for each message, sorted by
    (conv_id, thread, turn): every message stands after the one it replies to. text is without quoted lines and
    without blank space at its ends. Null texts are empty; messages with a null conv_id or turn are kept, link to
    nothing and have themselves as thread; several rows with one (conv_id, turn) are one message for links, and all
    stay; an empty table gives an empty result; other columns are not looked at. A conversation may hold any share
    of the rows: nothing is gathered by conversation, only by passage.
    """
    base = messages.select("conv_id", "turn", "role", text_of().alias("text"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), _QUOTED, ""), F.lit(" \t\n"))
    quoted = F.col("text").rlike(r"(?m)^[ \t]*>")
    keyed = base.where("conv_id is not null and turn is not null")
    parsed, passages = _passages(F.col("text"))
    quotes = (
        keyed.where(quoted)
        .withColumn("_lines", parsed)
        .select("conv_id", "turn", F.posexplode(passages).alias("place", "p"))
        .where("p.level > 0")
        .select("conv_id", "turn", "place", F.col("p.level").alias("level"), normalised(F.col("p.body")).alias("body"), _pieces(F.col("p.body")).alias("pieces"))
        .where("body != ''")
        .select("conv_id", "turn", "place", "level", F.xxhash64("body").alias("hash"), F.sha2("body", 256).alias("sha"), "pieces", F.sha2(F.array_join("pieces", "\n"), 256).alias("pkey"))
    )
    quotes = written(quotes)
    wanted = quotes.select("conv_id", "hash").distinct()
    own = keyed.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    blocks = F.split(F.regexp_replace("text", _QUOTED, _MARK), _MARK)
    lines = F.split(F.regexp_replace("text", _QUOTED, ""), "\n")
    paragraphs = F.split(F.regexp_replace("text", _QUOTED, ""), r"\n[ \t]*\n")
    whole = F.array(F.regexp_replace("text", _QUOTED, ""))
    units = own.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(whole, blocks, paragraphs, lines))).alias("unit")).select("conv_id", "turn", normalised(F.col("unit")).alias("body")).where("body != ''")
    units = units.select("conv_id", "turn", F.xxhash64("body").alias("hash"), F.sha2("body", 256).alias("sha"))
    first = units.join(wanted, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash", "sha").agg(F.min("turn").alias("origin"))
    holders = _holders(quotes, own.withColumn("text", F.regexp_replace("text", _QUOTED, "")))
    links = quotes.join(first, ["conv_id", "hash", "sha"], "left").join(holders, ["conv_id", "pkey"], "left").withColumn("origin", F.least("origin", "holder")).select("conv_id", "turn", "place", "level", F.when(F.col("origin") < F.col("turn"), F.col("origin")).alias("origin"))
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct(-F.col("level"), F.col("origin"))))
    parents = links.groupBy("conv_id", "turn").agg(F.countDistinct("place").alias("n_quotes"), F.countDistinct(F.when(F.col("origin").isNotNull(), F.col("place"))).alias("n_linked"), best.alias("b"))
    # (turn, place) repeats only where rows repeat; a link goes up by doubling until every message knows its root
    up = written(parents.select("conv_id", "turn", "n_quotes", "n_linked", F.col("b.origin").alias("reply_to"), F.col("b.origin").alias("top"), F.when(F.col("b").isNotNull(), 1).otherwise(0).cast("long").alias("depth")))
    forget(quotes)
    while True:
        over = up.where("top is not null").select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        new = written(up.join(over, ["conv_id", "top"], "left").select("conv_id", "turn", "n_quotes", "n_linked", "reply_to", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        again = bool(new.where("moved").limit(1).collect())
        forget(up)
        up = new.drop("moved")
        if not again:
            break
    out = base.select("conv_id", "turn", "role", clean.alias("text")).join(up, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "text", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("reply_to"), F.coalesce("top", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    ).orderBy("conv_id", "thread", "turn")
