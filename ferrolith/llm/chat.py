"""Chat formatting by schema fingerprints. DataFrame functions only.

A record's nested field paths, those that a layout asks for, are sorted and hashed; where the hash is
the layout's, its declarative mapping turns the record into canonical turns (conv_id, turn, role,
text); of several the one of most paths counts, so that other fields don't matter. Tables are told by
their schema, JSON records row by row. Turns are then formatted as

    <|im_start|>role\\ntext<|im_end|>\\n

with control strings inside roles and texts escaped reversibly ('&' as '&amp;', '<|' as '&lt;|', a
role's line end as '&#10;'), and a loss mask that covers the assistant's texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TURN = "array<struct<role:string,text:string>>"
#: Fixed values. Layout: its field paths, and the turns as an expression over them; a table of one row per turn has none.
LAYOUTS = {
    "turn rows": (("role", "text", "turn"), None),
    "messages": (("messages", "messages.content", "messages.role"), "transform(messages, m -> struct(m.role as role, m.content as text))"),
    "from and value": (("conversations", "conversations.from", "conversations.value"), "transform(conversations, m -> struct(case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end as role, m.value as text))"),
    "instruction and input": (("input", "instruction", "output"), "array(struct('user' as role, concat_ws('\\n\\n', instruction, nullif(input, '')) as text), struct('assistant' as role, output as text))"),
    "instruction": (("instruction", "output"), "array(struct('user' as role, instruction as text), struct('assistant' as role, output as text))"),
    "prompt and completion": (("completion", "prompt"), "array(struct('user' as role, prompt as text), struct('assistant' as role, completion as text))"),
    "prompt and response": (("prompt", "response"), "array(struct('user' as role, prompt as text), struct('assistant' as role, response as text))"),
    "question and answer": (("answer", "question"), "array(struct('user' as role, question as text), struct('assistant' as role, answer as text))"),
}
_PATHS = sorted({p for paths, _ in LAYOUTS.values() for p in paths})
_RECORD = "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, instruction string, input string, output string, prompt string, completion string, response string, question string, answer string"


def fingerprint(paths) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("|".join(sorted(set(paths))).encode()).hexdigest()


#: Fingerprint, paths and name of each layout, those of more paths first.
_PRINTS = sorted(((fingerprint(paths), paths, name) for name, (paths, _) in LAYOUTS.items()), key=lambda x: -len(x[1]))


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The dotted paths of all fields, through arrays and structs."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at)
    if not isinstance(kind, T.StructType):
        return []
    return [p for f in kind.fields for here in [f"{at}.{f.name}" if at else f.name] for p in (here, *schema_paths(f.dataType, here))]


def layout_of(df: DataFrame) -> str:
    """The layout of a table: the one of most paths whose fingerprint is that of the schema's part it asks for."""
    have = set(schema_paths(df.schema))
    for mark, paths, name in _PRINTS:
        if fingerprint(have & set(paths)) == mark:
            return name
    raise ValueError(f"no layout has the fields {sorted(have)}")


def _rows(df: DataFrame, turns: Column) -> DataFrame:
    return df.select(F.col("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def canonical(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows of a table of any known layout with a ``conv_id``; other columns don't matter."""
    turns = LAYOUTS[layout_of(df)][1]
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text") if turns is None else _rows(df, F.expr(turns).cast(TURN))


def told_json(df: DataFrame, column: str) -> DataFrame:
    """(conv_id, record, layout, turns) of every JSON record, each of a layout of its own.

    The layout is the one of most paths whose fingerprint is that of the record's part it asks for, all
    elements of its arrays counted; an empty array has whatever its elements should have. Records that are
    no object, or that no layout fits, are kept with a null layout and null turns.
    """
    none = F.array().cast("array<string>")
    top = F.coalesce(F.json_object_keys(column), none)

    def under(p: str) -> Column:
        asked = F.array(*(F.lit(x) for x in _PATHS if x.startswith(f"{p}.")))
        inside = F.get_json_object(F.col(column), f"$.{p}")
        keys = F.flatten(F.transform(F.from_json(inside, "array<map<string,string>>"), lambda m: F.coalesce(F.map_keys(m), none)))
        return F.when(F.json_array_length(inside) == 0, asked).otherwise(F.coalesce(F.transform(keys, lambda x: F.concat(F.lit(f"{p}."), x)), none))

    have = F.concat(top, under("messages"), under("conversations"))
    told = df.select("conv_id", F.col(column).alias("record"), F.from_json(column, _RECORD).alias("r"), F.array_distinct(have).alias("have"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for mark, paths, layout in reversed(_PRINTS):
        if (mapping := LAYOUTS[layout][1]) is not None:
            fits = F.sha2(F.array_join(F.array_sort(F.array_intersect("have", F.array(*map(F.lit, paths)))), "|"), 256) == mark
            name, turns = F.when(fits, layout).otherwise(name), F.when(fits, F.expr(mapping).cast(TURN)).otherwise(turns)
    found = told.select("conv_id", "record", name.alias("layout"), "have", "r.*")
    return found.select("conv_id", "record", "layout", turns.alias("turns"))


def canonical_json(df: DataFrame, column: str) -> DataFrame:
    """(conv_id, turn, role, text) rows of the JSON records that some layout fits; ``unread`` has the others."""
    return _rows(told_json(df, column), F.col("turns"))


def unread(df: DataFrame, column: str) -> DataFrame:
    """(conv_id, record) of the JSON records that no layout fits, whole, to be counted and kept."""
    return told_json(df, column).where("layout is null").select("conv_id", "record")


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))
    return F.replace(out, F.lit("\n"), F.lit("&#10;")) if role else out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) from canonical rows; ``loss`` has the spans (start, length, turn, inside).

    Spans count code points: ``start`` within ``formatted``, ``inside`` within the turn's own segment.
    Turns are ordered by number, role and text; repeated rows stay; a null role or text is an empty one;
    rows of a null conv_id are one conversation.
    """
    role, text = escape(F.col("role"), role=True), escape(F.col("text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END)).alias("segment"), (F.length(role) + len(START) + 1).alias("inside"), F.length(text).alias("length"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "segment")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.row_number().over(order) - 1).withColumn("start", F.sum(F.length("segment")).over(before) - F.length("segment") + F.col("inside"))
    span = F.when(F.col("role") == "assistant", F.struct("start", F.col("length").cast("long").alias("length"), "at", "inside"))
    both = F.array_sort(F.collect_list(F.struct("at", "segment", span.alias("span"))))
    out = rows.groupBy("conv_id").agg(both.alias("b"))
    return out.select("conv_id", F.array_join(F.transform("b", lambda x: x["segment"]), "").alias("formatted"), F.filter(F.transform("b", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars): what the formatted text and its mask hold, unescaped."""
    parts = formatted.withColumn("parts", F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2**31 - 1))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END))).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.substr(F.get("parts", s["at"]), (s["inside"] - len(START) + 1).cast("int"), s["length"].cast("int"))))
    return parts.select("conv_id", F.transform("parts", turn).alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
