"""Chat formatting in budgeted windows; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

#: Marks of a turn: before and behind its role, and at its end. "|" and "\" inside roles and texts are escaped by "\", so no text can hold a mark.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: A turn's role and text, escaped, in what precedes its END.
_TURN = r"(?s)^<\|((?:[^|\\]|\\.)*+)\|>\n(.*)$"
#: Tokens a turn has besides its text, and code points of a token, about.
TURN_TOKENS, TOKEN_CHARS = 4, 4
#: Turn numbers of a chunk: what one task orders and adds up of a conversation. Windows never reach over a chunk's end.
CHUNK_TURNS = 4096
#: Rooms of a block: what is held as one row while its windows are cut.
BLOCK_ROOMS = 8

_LOSS = "array<struct<start:bigint,length:bigint>>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE), escape(text), F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.split(formatted, r"<\|end\|>\n", -1)
    turn = lambda x: F.struct(
        unescape(F.regexp_extract(x, _TURN, 1)).alias("role"), unescape(F.regexp_extract(x, _TURN, 2)).alias("text")
    )
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def _total(costs: Column) -> Column:
    return F.aggregate(costs, F.lit(0).cast("long"), lambda a, x: a + x)


def _turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, tokens_col: str | None) -> DataFrame:
    """Rows (id, id0 and none: the id as a key that is never null, chunk, turn, role, text, cost)."""
    turn, key = F.col(turn_col), F.col(id_col)
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    tokens = (F.length(text) / TOKEN_CHARS).cast("long") + 1
    if tokens_col is not None:
        tokens = F.coalesce(F.col(tokens_col).cast("long"), tokens)
    chunk = F.floor(turn / CHUNK_TURNS).cast("long") if isinstance(rows.schema[turn_col].dataType, NumericType) else F.lit(0).cast("long")
    return rows.select(
        key.alias("id"), F.coalesce(key.cast("string"), F.lit("")).alias("id0"), key.isNull().alias("none"),
        F.coalesce(chunk, F.lit(-(1 << 62))).alias("chunk"), turn.alias("turn"), role.alias("role"), text.alias("text"), (tokens + TURN_TOKENS).alias("cost"),
    )


def _blocks(t: DataFrame, room: int, history_turns: int) -> DataFrame:
    """Rows (id, lead, head, room, body, before): turns of a conversation that follow one another, of a bounded number of tokens (but for the last
    turn). lead: turns of the conversation's head (its system turn); before: up to history_turns turns before them."""
    keys = ["id0", "none", "chunk"]
    first = F.struct("turn", "role", F.when(F.col("role") == "system", F.col("text")).alias("text"), "cost")
    conversation = Window.partitionBy("id0", "none")
    by_chunk = conversation.orderBy("chunk")
    # one row a chunk; of the texts only those of system turns are in it
    c = t.groupBy(*keys).agg(F.count("*").alias("in_chunk"), F.min(first).alias("first"))
    c = c.select(
        *keys, "in_chunk", F.lead("chunk").over(by_chunk).alias("next_chunk"), F.first("first").over(by_chunk).alias("first"), F.sum("in_chunk").over(conversation).alias("n"),
        F.coalesce(F.sum("in_chunk").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
    )
    # a system turn alone is a turn like any other
    c = c.withColumn("lead", F.when((F.col("first.role") == "system") & (F.col("n") > 1), 1).otherwise(0))
    head = F.when(F.col("lead") == 1, F.array(F.struct("first.role", "first.text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    left = F.lit(room) - F.when(F.col("lead") == 1, F.col("first.cost")).otherwise(0)
    c = c.select(*keys, "in_chunk", "next_chunk", "earlier", "lead", head.alias("head"), F.greatest(left, F.lit(1)).alias("room"))

    order = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    x = t.join(c, keys).withColumn("place", F.row_number().over(order)).withColumn("at", F.col("earlier") + F.col("place") - 1)
    x = x.where((F.col("lead") == 0) | (F.col("at") > 0))
    sums = F.coalesce(F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("block", F.floor(sums / (F.col("room") * BLOCK_ROOMS)))
    turn = F.struct("role", "text", "cost")
    opens = ~F.col("block").eqNullSafe(F.lag("block").over(order))
    back = [F.lag(turn, h).over(order) for h in range(history_turns, 0, -1)]
    near = F.when(opens, F.array_compact(F.array(*back))) if back else F.when(opens, F.array().cast("array<struct<role:string,text:string,cost:bigint>>"))
    x = x.withColumn("near", near)
    g = x.groupBy(*keys, "block").agg(
        *[F.first(k).alias(k) for k in ("id", "lead", "head", "room")], F.first("near", ignorenulls=True).alias("near"), F.array_sort(F.collect_list(F.struct("at", "role", "text", "cost"))).alias("body")
    )
    # the last turns of a chunk are the history of the next one
    last = x.where(F.col("next_chunk").isNotNull() & (F.col("in_chunk") - F.col("place") < history_turns))
    last = last.groupBy("id0", "none", F.col("next_chunk").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "cost"))).alias("far"))
    far = F.transform("far", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["cost"].alias("cost")))
    before = F.when((F.col("block") == 0) & F.col("far").isNotNull(), far).otherwise(F.col("near"))
    return g.join(last, keys, "left").select("id", "lead", "head", "room", "body", before.alias("before"))


def format_conversations(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 1024, history: int = 128, history_turns: int = 2, tokens_col: str | None = None
) -> DataFrame:
    """Windows of conversations: (id, window, formatted, loss, n_repeated, n_turns).

    A turn's tokens are those in tokens_col, or are estimated from its code points. The running sum of them cuts a conversation into spans of whole
    turns, as long as the budget allows beside the system turn (the first, if its role is system) and the history; a longer turn has a span of its own
    and is never cut. Spans also end at every CHUNK_TURNS turn numbers and where BLOCK_ROOMS rooms are full, so no task holds more of a conversation
    than a chunk, and no row more than a block. Every window has the system turn, then of the turns before its span up to history_turns whose sum is
    within history (at a chunk's start: of those of the chunk before), then its span; n_repeated turns at its head were in an earlier window. window
    is the place in the conversation of the span's first turn. loss has (start, length) in code points of the assistant texts of the span in
    formatted, escaped as they stand there: each assistant text once over all windows.

    Turns are ordered by turn, then role, then text (nulls first); repeated rows are turns of their own. A null text is empty, a null role is an empty
    role; null ids are one conversation. Extra columns are left out, whatever their names; an empty table gives no rows."""
    b = _blocks(_turns(rows, id_col, turn_col, role_col, text_col, tokens_col), budget - history, history_turns)
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, t: Column) -> Column:
        opens = (a["i"] == 0) | (a["sum"] + t["cost"] > F.col("room"))
        starts = F.when(opens, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"])
        return F.struct(F.when(opens, t["cost"]).otherwise(a["sum"] + t["cost"]).alias("sum"), (a["i"] + 1).alias("i"), starts.alias("starts"))

    plain = F.transform("body", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["cost"].alias("cost")))
    b = b.withColumn("starts", F.aggregate("body", start, step)["starts"]).withColumn("all", F.concat("before", plain))
    known = F.size("before")

    def span(s: Column, k: Column) -> Column:
        """Of the span from s on: its first turn's place, how many turns before it are repeated, all turns of the window."""
        stop = F.coalesce(F.get("starts", k + 1), F.size("body"))
        recent = lambda h: F.transform(F.slice("all", known + s - h + 1, h), lambda t: t["cost"])
        fits = [F.when(F.lit(h) <= known + s, F.when(_total(recent(F.lit(h))) <= history, F.lit(h))) for h in range(1, history_turns + 1)]
        back = F.coalesce(F.greatest(*fits, F.lit(0), F.lit(0)), F.lit(0))
        turns = F.transform(F.slice("all", known + s - back + 1, stop - s + back), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return F.struct(F.get("body", s)["at"].alias("window"), back.alias("back"), F.concat("head", turns).alias("turns"))

    w = b.select("id", "lead", F.explode(F.transform("starts", span)).alias("w")).select("id", "lead", "w.*")
    w = w.withColumn("n_repeated", F.when(F.col("window") == F.col("lead"), 0).otherwise(F.col("lead") + F.col("back")))
    shown = F.transform("turns", lambda t: render(t["role"], t["text"]))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("i"), F.array().cast(_LOSS).alias("loss"))

    def mark(a: Column, t: Column) -> Column:
        text = F.length(escape(t["text"])).cast("long")
        start = a["at"] + F.length(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE)))
        target = (a["i"] >= F.col("n_repeated")) & (t["role"] == "assistant")
        loss = F.when(target, F.concat(a["loss"], F.array(F.struct(start.alias("start"), text.alias("length"))))).otherwise(a["loss"])
        return F.struct((start + text + len(END)).alias("at"), (a["i"] + 1).alias("i"), loss.alias("loss"))

    return w.select(
        F.col("id").alias(id_col), F.col("window").cast("long").alias("window"), F.array_join(shown, "").alias("formatted"), F.aggregate("turns", begin, mark)["loss"].alias("loss"), "n_repeated", F.size("turns").alias("n_turns")
    )


def read_windows(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Of each formatted window: (id, window, turns array of its own (role, text), targets array of the texts under the loss mask, chars)."""
    own = parse(F.col("formatted"))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    turns = F.slice(own, F.col("n_repeated") + 1, F.greatest(F.size(own) - F.col("n_repeated"), F.lit(0)))
    return windows.select(F.col(f"`{id_col}`"), "window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").cast("long").alias("chars"))


def read_back(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Conversations from formatted windows: (id, turns array of (role, text), targets array of the texts under the loss mask, formatted_chars). A
    conversation is one row here."""
    g = read_windows(windows, id_col).groupBy(F.col(f"`{id_col}`")).agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return g.select(F.col(f"`{id_col}`"), F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("w", lambda x: x["targets"])).alias("targets"), "formatted_chars")
