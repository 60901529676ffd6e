"""Chat formatting with Spark expressions only.

A conversation becomes one string of blocks::

    <|im_start|>role\\ntext<|im_end|>\\n

Neighbouring turns of one role share a block; ``<|im_sep|>`` stands between their texts, so that nothing of the turns
is lost.  Escaping keeps texts and roles from looking like marks and can be undone: a backslash is doubled, ``<|``
becomes ``<\\|``, and a line break in a role becomes ``<\\n>``.  ``loss`` lists the code points ``[start, stop)`` of the
formatted string that a model is trained on: the texts of the given roles, without marks.

Turns are numbered into chunks of ``CHUNK`` turn numbers.  A task sorts and folds one chunk at a time, and a conversation
only joins the strings of its chunks, so the turns of one long conversation are worked on by many tasks.  What meets in
one row is the formatted string itself, which Spark bounds at 2 GB.

Defined results.  Null texts and roles count as empty.  Turns go by (turn, role, text), nulls first, so equal turn
numbers have one order and repeated rows are repeated turns.  All rows whose conversation is null are one conversation.
Other columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the template's control strings
OPEN, CLOSE, SEPARATOR = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
#: Turn numbers of one chunk.
CHUNK = 256
#: Characters of the pieces in which a formatted string is read back.
PIECE = 4096


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` and its lambdas name it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _block_start(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def _fold(turns: Column, loss_roles: tuple[str, ...]) -> Column:
    """Sorted turns to (first, last role, body pieces, loss spans): same-role neighbours go to one block.

    The body begins with the first turn's text; the mark before it depends on the chunk before.
    """
    ready = F.transform(
        turns,
        lambda t: F.struct(
            _escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), t["role"].isin(*loss_roles).alias("loss")
        ),
    )

    def step(state: Column, turn: Column) -> Column:
        mark = (
            F.when(state["last"].isNull(), F.lit(""))
            .when(state["last"] == turn["role"], F.lit(SEPARATOR))
            .otherwise(F.concat(F.lit(CLOSE), _block_start(turn["role"])))
        )

        def put(mark: Column) -> Column:
            start = state["size"] + F.length(mark)
            stop = start + F.length(turn["text"])
            return F.struct(
                F.coalesce(state["first"], turn["role"]).alias("first"),
                turn["role"].alias("last"),
                stop.alias("size"),
                F.concat(state["body"], F.array(mark, turn["text"])).alias("body"),
                F.when(turn["loss"], F.concat(state["loss"], F.array(F.struct(start.alias("start"), stop.alias("stop")))))
                .otherwise(state["loss"])
                .alias("loss"),
            )

        return _with(mark, put)

    empty = F.struct(
        F.lit(None).cast("string").alias("first"),
        F.lit(None).cast("string").alias("last"),
        _long(0).alias("size"),
        F.array().cast("array<string>").alias("body"),
        F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("loss"),
    )
    return F.aggregate(ready, empty, step)


def _join(chunks: Column) -> Column:
    """Folded chunks in order to the formatted string and its loss spans."""

    def mark(chunk: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(chunks, i - 1))
        return (
            F.when(i == 0, _block_start(chunk["first"]))
            .when(before["last"] == chunk["first"], F.lit(SEPARATOR))
            .otherwise(F.concat(F.lit(CLOSE), _block_start(chunk["first"])))
        )

    marked = F.transform(chunks, lambda c, i: F.struct(mark(c, i).alias("mark"), c.alias("chunk")))

    def assemble(marked: Column) -> Column:
        def step(state: Column, m: Column) -> Column:
            start = state["size"] + F.length(m["mark"])
            return F.struct(
                (start + m["chunk"]["size"]).alias("size"), F.concat(state["starts"], F.array(start)).alias("starts")
            )

        zero = F.struct(_long(0).alias("size"), F.array().cast("array<bigint>").alias("starts"))
        at = F.aggregate(marked, zero, step)
        text = F.concat(
            F.array_join(F.transform(marked, lambda m: F.concat(m["mark"], F.array_join(m["chunk"]["body"], ""))), ""),
            F.lit(CLOSE),
        )
        spans = _with(
            at["starts"],
            lambda starts: F.flatten(
                F.transform(
                    marked,
                    lambda m, i: F.transform(
                        m["chunk"]["loss"],
                        lambda s: F.struct(
                            (s["start"] + F.get(starts, i)).alias("start"), (s["stop"] + F.get(starts, i)).alias("stop")
                        ),
                    ),
                )
            ),
        )
        return F.struct(text.alias("formatted"), spans.alias("loss"))

    return _with(marked, assemble)


def format_chats(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` and ``loss``, its spans in code points."""
    turns = rows.select(
        F.col(conv).alias("conv"),
        F.floor(F.col(turn) / chunk).alias("chunk"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chunks = turns.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    folded = chunks.select("conv", F.struct("chunk", _with(F.col("turns"), lambda t: _fold(t, loss_roles)).alias("c")).alias("c"))
    whole = folded.groupBy("conv").agg(F.sort_array(F.collect_list("c")).alias("chunks"))
    done = whole.select("conv", _with(F.col("chunks")["c"], _join).alias("out"))
    return done.select(F.col("conv").alias(conv), "out.formatted", "out.loss")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as ``array<struct<role, text>>``."""
    # a block is role, line break, texts; the string begins with a mark, so the first part is empty
    blocks = F.transform(
        F.filter(F.split(formatted, _literal(OPEN)), lambda b: b != ""),
        lambda b: F.substring(b, F.lit(1), F.length(b) - len(CLOSE)),
    )

    def turns(block: Column) -> Column:
        cut = F.instr(block, F.lit("\n"))
        role = _unescape_role(F.substring(block, F.lit(1), cut - 1))
        body = F.substring(block, cut + 1, F.length(block))
        return _with(
            role,
            lambda r: F.transform(
                F.split(body, _literal(SEPARATOR)), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))
            ),
        )

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts of the loss spans; a span looks at the pieces that it touches only."""

    def cut(pieces: Column) -> Column:
        def text(span: Column) -> Column:
            first = F.floor(span["start"] / PIECE)
            count = F.floor((span["stop"] - 1) / PIECE) - first + 1
            part = F.array_join(F.slice(pieces, (first + 1).cast("int"), F.greatest(count, _long(0)).cast("int")), "")
            return unescape(
                F.substring(part, (span["start"] - first * PIECE + 1).cast("int"), (span["stop"] - span["start"]).cast("int"))
            )

        return F.transform(loss, text)

    return _with(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), cut)


def _literal(text: str) -> str:
    """A regular expression for ``text`` itself."""
    return "".join(f"\\{c}" if c in "<>|\\" else c for c in text)
