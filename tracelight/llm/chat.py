"""Chat formatting by schema fingerprints, in DataFrame operations only.

A record is a variant. Which of the known nested field paths it has is hashed to a fingerprint, and the
fingerprint selects a declarative mapping from that layout to canonical turns. Turns are written in
a template whose marks cannot occur in texts, since control strings are broken up by a backslash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of common chat templates, split after their first character.
CONTROL = r"([<\[])(\|[A-Za-z_]+\|>|/?s>|</?SYS>>|/?INST\])"


@dataclass(frozen=True)
class Layout:
    """Where a record layout keeps its turns.

    With ``items``, every element of that array is a turn with the fields ``role`` and ``text``; with
    ``row``, the record itself is one turn, whose role is taken as it is; else ``parts`` lists roles and the fields joined for them.
    """

    name: str
    paths: tuple[str, ...]
    items: str | None = None
    role: str | None = None
    text: str | None = None
    row: bool = False
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()


def _parts(name: str, *parts: tuple[str, tuple[str, ...]]) -> Layout:
    return Layout(name, tuple(f for _, fields in parts for f in fields), parts=parts)


LAYOUTS = (
    Layout("messages", ("messages[0].role", "messages[0].content"), "messages", "role", "content"),
    Layout("conversations", ("conversations[0].from", "conversations[0].value"), "conversations", "from", "value"),
    Layout("turn", ("role", "text"), role="role", text="text", row=True),
    _parts("prompt_response", ("user", ("prompt",)), ("assistant", ("response",))),
    _parts("prompt_completion", ("user", ("prompt",)), ("assistant", ("completion",))),
    _parts("system_prompt_response", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    _parts("question_answer", ("user", ("question",)), ("assistant", ("answer",))),
    _parts("instruction_output", ("user", ("instruction",)), ("assistant", ("output",))),
    _parts("instruction_input_output", ("user", ("instruction", "input")), ("assistant", ("output",))),
)
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def known_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for layout in layouts for p in layout.paths})


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the known nested field paths that a record has, null values included."""
    has = [F.when(F.try_variant_get(record, f"$.{p}", "variant").isNotNull(), p) for p in known_paths(layouts)]
    return F.xxhash64(F.concat_ws("|", *has))


def selected(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Name of the layout whose paths have the record's fingerprint, else null."""
    own = fingerprint(record, layouts)
    picks = [F.when(own == F.xxhash64(F.lit("|".join(sorted(x.paths)))), x.name) for x in layouts]
    return F.coalesce(*picks)


def _field(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{path}", "string"), F.lit(""))


def _role(role: Column) -> Column:
    out = role
    for other, name in ROLES.items():
        out = F.when(role == other, name).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def turns_of(record: Column, layout: Layout) -> Column:
    """Array of (role, text) of a record in the given layout."""
    if layout.items:
        every = F.try_variant_get(record, f"$.{layout.items}", "array<variant>")
        return F.transform(every, lambda x: _turn(_role(_field(x, layout.role)), _field(x, layout.text)))
    if layout.row:
        return F.array(_turn(_field(record, layout.role), _field(record, layout.text)))
    turns = []
    for role, fields in layout.parts:
        texts = F.filter(F.array(*[_field(record, f) for f in fields]), lambda t: t != "")
        turns.append(_turn(F.lit(role), F.array_join(texts, "\n\n")))
    return F.array(*turns)


def canonical(records: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with ``layout`` (null if unknown) and ``turns`` (empty then)."""
    name = selected(F.col(record_col), layouts)
    told = records.withColumn("layout", name)
    nothing = F.lit(None).cast("array<struct<role:string,text:string>>")
    turns = nothing
    for layout in layouts:
        turns = F.when(F.col("layout") == layout.name, turns_of(F.col(record_col), layout)).otherwise(turns)
    return told.withColumn("turns", F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>")))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, id_col: str, order: list[str], trained: str = "assistant") -> DataFrame:
    """One row per conversation: id, ``formatted`` and ``mask``, the spans that count for the loss.

    ``turns`` has ``role`` and ``text``; rows stand in the order of ``order`` (nulls first), then role,
    then text. A span is (start, length) in code points of the formatted text and covers one text of
    the role ``trained``. A conversation is one sample, so its turns meet in one row.
    """
    own = turns.select(
        F.col(id_col).alias("id"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    own = own.withColumn("head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)))
    own = own.withColumn("body", escaped(F.col("text")))
    place = Window.partitionBy("id").orderBy(*[f"o{i}" for i in range(len(order))], "role", "text")
    size = F.char_length("head") + F.char_length("body") + len(END)
    before = F.coalesce(F.sum(size).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.struct((before + F.char_length("head")).alias("start"), F.char_length("body").alias("length"))
    lined = own.select(
        "id", F.row_number().over(place).alias("n"), F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(F.col("role") == trained, span).alias("span"),
    )
    rows = F.array_sort(F.collect_list(F.struct("n", "piece", "span")))
    made = lined.groupBy("id").agg(rows.alias("rows"))
    return made.select(
        F.col("id").alias(id_col),
        F.array_join(F.col("rows.piece"), "").alias("formatted"),
        F.filter(F.col("rows.span"), lambda s: s.isNotNull()).alias("mask"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    pieces = F.split(formatted, r"<\|turn\|>")
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        body = F.substring_index(F.substring_index(piece, TEXT, -1), END, 1)
        return _turn(unescaped(F.substring_index(piece, TEXT, 1)), unescaped(body))

    return F.transform(pieces, turn)


def masked(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    texts = F.transform(mask, lambda s: unescaped(F.substring(formatted, s["start"].cast("int") + 1, s["length"])))
    return F.array_join(texts, "")


def digest(samples: DataFrame, id_col: str) -> DataFrame:
    """What reading the samples back gives: turns, digests and sizes."""
    told = samples.withColumn("turns", read_back(F.col("formatted")))
    told = told.withColumn("loss", masked(F.col("formatted"), F.col("mask")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return told.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def format_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted samples of a table with one row per turn, through the ``turn`` layout.

    Null texts and roles are empty; a null id is a conversation of its own; null turns come first,
    ties stand by role and text and repeated rows stay; an empty table gives no sample; other columns
    are not read.
    """
    record = F.to_variant_object(
        F.struct(F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    )
    records = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), record.alias("record"))
    turns = canonical(records, "record").select("id", "turn", F.explode("turns").alias("t"))
    turns = turns.select("id", "turn", "t.role", "t.text")
    return format_turns(turns, "id", ["turn"]).withColumnRenamed("id", id_col)
