"""Conversations as training windows of a token budget, with the characters that bear loss.

Turns are numbered over ranges of (conversation, turn), and prefix sums of their tokens (in each range, then over
ranges) give every turn its place. From places alone follow the spans of whole turns, so a conversation of any
length is cut without being gathered: groups are ranges, spans, or token stretches of a conversation.

All work is done by DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlens.session import written

#: Tokens of a window: system turn, repeated history and new turns.
BUDGET = 2048
#: Tokens of earlier turns that a window repeats at most.
HISTORY = 512

#: Tokens counted for the marks of a turn.
MARKS = 8
#: What counts as one token: up to six letters or three digits, or any other visible character.
TOKEN = r"[A-Za-z]{1,6}|[0-9]{1,3}|[^\x00-\x20\x7FA-Za-z0-9]"

OPEN, END = "### ", "</turn>\n"
#: A control string in a text gets a backslash after its first character; one that has backslashes there gets one more.
_CONTROL = (r"(#\\*)(## )", r"(<\\*)(/turn>)")
_CONTROL_ESCAPED = (r"(#\\*)\\(## )", r"(<\\*)\\(/turn>)")
#: Characters that a role may not show in its mark (the first one first when writing, last when reading).
_ROLE = (("%", "%25"), (":", "%3A"), ("<", "%3C"), ("#", "%23"), ("\n", "%0A"))

_SYSTEM, _REPEATED, _NEW = 0, 1, 2


def escape(text: Column) -> Column:
    for pattern in _CONTROL:
        text = F.regexp_replace(text, pattern, r"$1\\$2")
    return text


def unescape(text: Column) -> Column:
    for pattern in _CONTROL_ESCAPED:
        text = F.regexp_replace(text, pattern, "$1$2")
    return text


def _role_mark(role: Column) -> Column:
    for plain, coded in _ROLE:
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return F.concat(F.lit(OPEN), role, F.lit(": "))


def _role_read(mark: Column) -> Column:
    for plain, coded in reversed(_ROLE):
        mark = F.replace(mark, F.lit(coded), F.lit(plain))
    return mark


def _turns(conversations: DataFrame, target: str) -> DataFrame:
    """Formatted turns, numbered in order of conversation and turn: ``row`` has the range in its upper bits."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = [F.col("conv_id"), F.asc_nulls_last("turn"), F.col("role"), F.xxhash64("text")]
    ranged = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("row", F.monotonically_increasing_id())
    marked = numbered.withColumn("mark", _role_mark(F.col("role"))).withColumn("said", escape(F.col("text")))
    return marked.select(
        "conv_id",
        "row",
        F.concat("mark", "said", F.lit(END)).alias("body"),
        (F.regexp_count("said", F.lit(TOKEN)) + MARKS).cast("bigint").alias("tokens"),
        F.char_length("mark").alias("lead"),
        F.when(F.col("role") == target, F.char_length("said")).otherwise(0).alias("bears"),
        (F.col("role") == "system").alias("system"),
    )


def _places(turns: DataFrame, budget: int, history: int, longest: int) -> DataFrame:
    """Each turn with the number of its conversation, its first token there, and the span it belongs to."""
    narrow = turns.select("conv_id", "row", "tokens", "system", F.shiftright("row", 33).alias("piece"))
    narrow = narrow.withColumn("long", (F.col("tokens") > longest).cast("bigint"))
    # Sums of each range are added up first; a conversation has as many of them as ranges.
    pieces = narrow.groupBy("conv_id", "piece").agg(
        F.sum("tokens").alias("all"), F.sum("long").alias("longs"), F.min(F.struct("row", "system", "tokens", "long")).alias("head")
    )
    conversation = Window.partitionBy("conv_id")
    earlier = conversation.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        F.col("conv_id").alias("of"),
        F.col("piece").alias("at"),
        F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("longs").over(earlier), F.lit(0)).alias("longs_before"),
        F.sum("all").over(conversation).alias("whole"),
        F.min("head").over(conversation).alias("head"),
    )
    upto = Window.partitionBy("conv_id", "piece").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = narrow.withColumn("upto", F.sum("tokens").over(upto)).withColumn("n_long", F.sum("long").over(upto))
    placed = summed.join(offsets, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("at")))
    system = F.when(F.col("head.system"), F.col("head.tokens")).otherwise(0)
    system_long = F.when(F.col("head.system"), F.col("head.long")).otherwise(0)
    placed = placed.withColumn("system_tokens", system).withColumn("is_system", F.expr("head.system AND row = head.row"))
    placed = placed.withColumn("start", F.when(F.col("is_system"), 0).otherwise(F.expr("tokens_before + upto - tokens - system_tokens")))
    # Turns up to ``longest`` tokens go by their last token to a stride; with the start of the first one, a span
    # has less than stride + longest tokens. A longer turn is a span of its own.
    width = F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(2 * longest)) - longest
    placed = placed.withColumn("width", width)
    nth = F.col("longs_before") + F.col("n_long") - system_long
    return placed.select(
        F.col("head.row").alias("conversation"),
        "row",
        "start",
        "tokens",
        "is_system",
        F.expr("whole = system_tokens").alias("alone"),
        F.when(F.col("head.system"), F.col("head.row")).alias("system_row"),
        F.when(F.col("is_system"), 0).otherwise(nth).alias("nth"),
        F.expr("CASE WHEN is_system THEN 0 WHEN long = 1 THEN -1 ELSE (start + tokens - 1) div width END").alias("stride"),
    )


def _members(places: DataFrame, history: int) -> DataFrame:
    """(conversation, position, row, kind): which turns each window holds, and as what."""
    span = Window.partitionBy("conversation", "nth", "stride")
    new = places.where("NOT is_system OR alone").withColumn("position", F.min("start").over(span))
    spans = new.groupBy("conversation", "position").agg(F.min("system_row").alias("system_row"), F.bool_or("alone").alias("alone"))
    system = spans.where("system_row IS NOT NULL AND NOT alone")
    members = new.select("conversation", "position", "row", F.lit(_NEW).alias("kind")).unionByName(
        system.select("conversation", "position", F.col("system_row").alias("row"), F.lit(_SYSTEM).alias("kind"))
    )
    if history <= 0:
        return members
    # Turns and span starts meet in stretches of ``history`` tokens; each turn takes some, so a stretch holds few.
    stretch = F.floor(F.col("start") / history)
    turns = places.where("NOT is_system").select("conversation", "row", "start", "tokens", stretch.alias("stretch"))
    here = F.floor(F.col("position") / history)
    starts = spans.where("position > 0").select("conversation", "position", F.explode(F.array(here - 1, here)).alias("stretch"))
    near = turns.join(starts, ["conversation", "stretch"])
    near = near.where(F.col("start") >= F.col("position") - history).where(F.col("start") + F.col("tokens") <= F.col("position"))
    return members.unionByName(near.select("conversation", "position", "row", F.lit(_REPEATED).alias("kind")))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, target: str = "assistant") -> DataFrame:
    """conv_id, position, n_tokens, carried, text and loss of each training window.

    ``conversations`` has conv_id, turn, role, text. Turns go by ``turn`` (null last), equal ones by role and a hash
    of the text; repeated rows are turns of their own; rows without conv_id are one conversation; a null role or
    text is empty. Other columns are ignored. An empty table gives no window.

    Each turn is new in exactly one window, whole. A first turn of role ``system`` leads every window of its
    conversation; before the new turns come earlier ones of at most ``history`` tokens. A window keeps to ``budget``
    unless one turn, or the system turn, is longer than a quarter of it and does not fit. ``position`` is the place
    of the first new token, so it orders the windows of a conversation; ``carried`` turns at the start of the text
    were in an earlier window. ``loss`` lists (start, length) in code points of the new texts of role ``target``:
    repeated turns, other roles and all marks bear none.

    The formatted turns are written once when this is called.
    """
    turns = written(_turns(conversations, target), "chat-turns")
    members = _members(_places(turns, budget, history, budget // 4), history)
    held = members.join(turns, "row")
    before = Window.partitionBy("conversation", "position").orderBy("kind", "row").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("at", F.coalesce(F.sum(F.char_length("body")).over(before), F.lit(0)) + F.col("lead"))
    bears = F.when(F.col("kind") == _NEW, F.col("bears")).otherwise(0)
    turn = F.struct("kind", "row", "body", F.struct(F.col("at").alias("start"), bears.cast("bigint").alias("length")).alias("loss"))
    gathered = held.groupBy("conversation", "position").agg(
        F.first("conv_id").alias("conv_id"),
        F.sum("tokens").alias("n_tokens"),
        F.count_if((F.col("kind") == _REPEATED) | (F.col("kind") == _SYSTEM) & (F.col("position") > 0)).alias("carried"),
        F.sort_array(F.collect_list(turn)).alias("turns"),
    )
    return gathered.select(
        "conv_id",
        "position",
        "n_tokens",
        "carried",
        F.array_join(F.transform("turns", lambda t: t["body"]), "").alias("text"),
        F.filter(F.transform("turns", lambda t: t["loss"]), lambda x: x["length"] > 0).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """position, formatted_chars, turns (role, text) and the unescaped text under the loss of each window, from its text."""
    said = F.split("text", END)
    new = F.slice(said, F.col("carried").cast("int") + 1, F.size(said))
    new = F.filter(new, lambda s: s != "")

    def turn(s: Column) -> Column:
        colon = F.instr(s, ": ")
        role = _role_read(F.substr(s, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1))
        return F.struct(role.alias("role"), unescape(F.substr(s, colon + 2, F.char_length(s))).alias("text"))

    lost = F.transform("loss", lambda x: unescape(F.substr("text", (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return formatted.select(
        "conv_id",
        "position",
        F.char_length("text").cast("bigint").alias("formatted_chars"),
        F.transform(new, turn).alias("turns"),
        F.array_join(lost, "").alias("loss_text"),
    )


def digests(formatted: DataFrame, stretch: int = 64 * BUDGET) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, as read back.

    A digest needs the whole text of a conversation in one row; stretches of it are joined first.
    """
    spelled = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = read_back(formatted).select(
        "conv_id",
        F.floor(F.col("position") / stretch).alias("stretch"),
        "formatted_chars",
        F.size("turns").alias("n_turns"),
        F.struct("position", F.array_join(spelled, "").alias("said"), "loss_text").alias("part"),
    )

    def joined(name: str) -> Column:
        return F.array_join(F.transform("parts", lambda p: p[name]), "")

    def together(df: DataFrame, *keys: str) -> DataFrame:
        grouped = df.groupBy(*keys).agg(
            F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts")
        )
        part = F.struct(F.col("parts")[0]["position"].alias("position"), joined("said").alias("said"), joined("loss_text").alias("loss_text"))
        return grouped.withColumn("part", part).drop("parts")

    whole = together(together(read, "conv_id", "stretch"), "conv_id")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2("part.said", 256).alias("turns_sha256"),
        F.char_length("part.loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("part.loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
