"""Chat formatting by relational operations: collected turns, merged blocks, concatenation.

Template of a block: ``<|im_start|>role newline text [<|im_sep|> text ...] <|im_end|> newline``; adjacent
turns of one role share a block. In roles and texts the first character of every control string,
and the escape character itself, become two characters; the escape is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, SEPARATOR, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
ESCAPE = "␛"
# Control strings of common chat templates.
CONTROLS = [
    "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|start_header_id|>",
    "<|end_header_id|>", "<|eot_id|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>",
    "[INST]", "[/INST]",
]


def _opening(character: str) -> str:
    """A pattern for ``character`` where a control string begins."""
    return rf"\Q{character}\E(?=" + "|".join(rf"\Q{c[1:]}\E" for c in CONTROLS if c[0] == character) + ")"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    text = F.regexp_replace(text, _opening("<"), ESCAPE + "1")
    return F.regexp_replace(text, _opening("["), ESCAPE + "2")


def unescape(text: Column) -> Column:
    for code, plain in (("1", "<"), ("2", "["), ("3", "\n"), ("0", ESCAPE)):
        text = F.replace(text, F.lit(ESCAPE + code), F.lit(plain))
    return text


def format_chats(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant"
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    ``loss_spans`` are (start, length) in code points of ``formatted``: the escaped texts of the
    role ``trained``, each once and in order, without any marker. Turns are ordered by turn (nulls
    first), then role, then text, so repeated or tied rows have a fixed order; all of them stay. A
    null role or text is empty; a null conversation id is one conversation. Texts are kept whole.
    A conversation is one output row and is gathered in one task. An empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    # One shuffle by conversation serves the window and the collection.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    opens = ~F.col("role").eqNullSafe(F.lag("role").over(order))
    closes = ~F.col("role").eqNullSafe(F.lead("role").over(order))
    name = F.replace(escape(F.col("role")), F.lit("\n"), F.lit(ESCAPE + "3"))
    rows = rows.withColumns(
        {
            "place": F.row_number().over(order),
            "head": F.when(opens, F.concat(F.lit(START), name, F.lit("\n"))).otherwise(F.lit(SEPARATOR)),
            "tail": F.when(closes, F.lit(STOP)).otherwise(F.lit("")),
        }
    )
    rows = rows.withColumn("text", escape(F.col("text")))  # ties were put in order by the texts themselves
    rows = rows.withColumn("piece", F.concat("head", "text", "tail"))
    placed = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum(F.length("piece")).over(placed), F.lit(0))
    rows = rows.withColumn("start", begins + F.length("head"))
    entry = F.struct("place", "role", "piece", "start", F.length("text").cast("long").alias("length"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == F.lit(trained)), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs of a formatted conversation, as they were before formatting."""
    blocks = F.filter(F.split(formatted, r"\Q" + STOP + r"\E"), lambda b: b != "")

    def turns(block):
        body = F.substring(block, len(START) + 1, F.length(block))
        line = F.instr(body, "\n")
        name = unescape(F.substring(body, F.lit(1), line - 1))
        texts = F.split(F.substring(body, line + 1, F.length(body)), r"\Q" + SEPARATOR + r"\E")
        return F.transform(texts, lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int"))), ""))


def with_turns(turns: DataFrame, extra: DataFrame) -> DataFrame:
    """The turns columns of both tables."""
    names = ["conv_id", "turn", "role", "text"]
    return turns.select(*names).unionByName(extra.select(*names))
