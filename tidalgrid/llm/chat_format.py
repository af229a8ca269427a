"""Chat formatting: turns to one marked text a conversation and back, by column expressions only.

    <|start|>user<|says|>text<|also|>text of the next user turn<|end|><|start|>assistant<|says|>...<|end|>

Adjacent turns of one role share a block.  Inside roles and texts ``<|`` is written ``<||``, so no
text can hold a marker, and reading back gives exactly the turns that went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .columns import bind

START, SAYS, ALSO, END = "<|start|>", "<|says|>", "<|also|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit("<||"), F.lit("<|"))


def _quoted(marker: str) -> str:
    return r"\Q" + marker + r"\E"


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn, role, text) to (conv_id, formatted, loss_spans).

    Turns are sorted by (turn, role, text), so ties and repeated rows have a fixed order and all are
    kept; a NULL turn comes first, a NULL role or text is empty, rows whose conv_id is NULL form one
    conversation.  ``loss_spans`` lists (start, length) in code points of each text of
    ``trained_role`` inside ``formatted``, as escaped.  Other columns are ignored.  The one shuffle is
    by conversation; its windows and the second grouping reuse it.
    """
    t = turns.select("conv_id", F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    role = lambda i: F.get("ts", i)["role"]
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    g = bind(g, begins=F.concat(begins, F.array(n)))
    blocks = F.transform(
        F.sequence(F.lit(0), F.size("begins") - 2),
        lambda k: F.slice("ts", F.get("begins", k) + 1, F.get("begins", k + 1) - F.get("begins", k)))
    g = bind(g, blocks=blocks)
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.flatten(F.transform(b, lambda x, j: F.array(
            piece(F.when(j == 0, F.concat(F.lit(START), escape(x["role"]), F.lit(SAYS))).otherwise(F.lit(ALSO)), no),
            piece(escape(x["text"]), x["role"] == trained_role)))),
        F.array(piece(F.lit(END), no)))))
    p = g.select("conv_id", F.posexplode(pieces).alias("at", "p")).select("conv_id", "at", "p.s", "p.loss")
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("start", F.coalesce(F.sum(F.char_length("s")).over(before), F.lit(0)).cast("bigint"))
    span = F.when(F.col("loss"), F.struct(F.col("start"), F.char_length("s").cast("bigint").alias("length")))
    return p.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, _quoted(END)), lambda b: b != "")

    def turns(b: Column) -> Column:
        halves = F.split(b, _quoted(SAYS))
        role = unescape(F.substring(F.get(halves, F.lit(0)), len(START) + 1, 1 << 30))
        return F.transform(F.split(F.get(halves, F.lit(1)), _quoted(ALSO)), lambda s: F.struct(role.alias("role"), unescape(s).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined without anything between."""
    return F.array_join(F.transform(spans, lambda x: unescape(F.substr(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")
