"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

The nested field paths of a layout, in code-point order, are hashed; the hash
picks a mapping from layouts() that turns prompt/response, instruction, message
array or turn-row layouts into canonical rows (conv_id, turn, role, text). For
JSON records the fingerprint is taken per record, from the record's own paths.
Fields that no layout has are left out of the fingerprint; an unknown
fingerprint is an error that names the paths.

The template marks turns as <|turn|>role<|text|>text<|end|>. Inside texts and
roles the characters \\ < [ become \\s \\l \\b, so neither this template's
marks nor those of other templates (</s>, [INST], <|im_start|>) survive in a
text, and unescape() restores every text exactly.

Edge cases: null text and null role are empty; null turns sort first; turns
that repeat a number are ordered by role and text; a null conv_id is a
conversation of its own; rows that repeat are turns each; an empty message
array gives no turns; extra columns are ignored, and where the fields of several
layouts stand side by side the first in the table counts; an empty table gives
no rows. A conversation is one string, so its formatted text has to stay below
2 GB, the limit of a string in Spark.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Fixed escapes, applied in this order and undone in the opposite one.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"))


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Leaf paths of a nested schema; [] stands for array elements."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def path_hash(paths: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _said(role: Column, text: Column, turn: Column | None = None) -> Column:
    """One turn; `own` says whether the layout numbers it."""
    number = F.lit(None) if turn is None else turn
    return F.struct(number.cast("long").alias("turn"), F.lit(turn is not None).alias("own"), role.cast("string").alias("role"), text.cast("string").alias("text"))


def _turn(role: str, text: str) -> Column:
    return _said(F.lit(role), F.col(text))


def _messages(array: str, role: str, text: str, names: dict[str, str] | None = None) -> Column:
    def one(m: Column) -> Column:
        said = m[role]
        for theirs, ours in (names or {}).items():
            said = F.when(said == theirs, ours).otherwise(said)
        return _said(said, m[text])

    return F.transform(F.col(array), one)


def _instruction(extra: str | None) -> Column:
    asked = F.col("instruction") if extra is None else F.concat_ws("\n", F.col("instruction"), F.nullif(F.col(extra), F.lit("")))
    return F.array(_said(F.lit("user"), asked), _turn("assistant", "output"))


#: Type of a mapping's result.
TURNS = "array<struct<turn:bigint,own:boolean,role:string,text:string>>"


def _no_turns() -> Column:
    return F.array().cast(TURNS)


#: Roles of the other message layout.
FOREIGN_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def layouts() -> dict[tuple[str, ...], callable]:
    """Mappings by their sorted paths (without the id); called late, since columns need a session."""
    return {
        ("role", "text", "turn"): lambda: F.array(_said(F.col("role"), F.col("text"), F.col("turn"))),
        ("prompt", "response"): lambda: F.array(_turn("user", "prompt"), _turn("assistant", "response")),
        ("completion", "prompt"): lambda: F.array(_turn("user", "prompt"), _turn("assistant", "completion")),
        ("instruction", "output"): lambda: _instruction(None),
        ("input", "instruction", "output"): lambda: _instruction("input"),
        ("messages[].content", "messages[].role"): lambda: _messages("messages", "role", "content"),
        ("conversations[].from", "conversations[].value"): lambda: _messages("conversations", "from", "value", FOREIGN_ROLES),
        # Arrays without elements have no fields inside.
        ("messages[]",): _no_turns,
        ("conversations[]",): _no_turns,
    }


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) rows of any known layout, chosen by the fingerprint of the schema."""
    paths = known_paths(p for p in field_paths(df.schema) if p != conv_id)
    mapping = choose(paths)
    if mapping is None:
        raise ValueError(f"no mapping for the layout {paths}")
    turns = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.explode(numbered(mapping())).alias("m"))
    return turns.select("conv_id", "m.turn", "m.role", "m.text")


def known_paths(paths) -> list[str]:
    """The paths that some layout has; other fields say nothing of the layout."""
    known = {p for layout in layouts() for p in layout}
    return sorted(known.intersection(paths))


def choose(paths: list[str]):
    """The mapping of the layout whose fingerprint the paths have. Where fields of several layouts stand side by side, the
    first layout in the table that they hold whole."""
    prints = {fingerprint(layout): mapping for layout, mapping in layouts().items()}
    if (chosen := prints.get(fingerprint(paths))) is not None:
        return chosen
    return next((mapping for layout, mapping in layouts().items() if fingerprint(set(layout).intersection(paths)) == fingerprint(layout)), None)


def numbered(turns: Column) -> Column:
    """Turns with their numbers: their own where the layout has them, else their places."""
    return F.transform(turns, lambda m, i: F.struct(F.coalesce(m["turn"], F.when(~m["own"], i)).cast("long").alias("turn"), m["role"].alias("role"), m["text"].alias("text")))


def fingerprint(paths) -> str:
    """The hash path_hash() gives, on the driver."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: JSON fields that some layout has, and one schema that reads them all.
RECORD_SCHEMA = (
    "prompt string, response string, completion string, instruction string, input string, output string, role string, text string, turn bigint, "
    "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>"
)


def _inside(name: str, field: Column) -> Column:
    return F.concat(F.lit(name + "[]."), field)


def canonical_json(df: DataFrame, json: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """As canonical_turns(), for JSON records of mixed layouts: each record's own field paths are hashed, those of all
    elements of its arrays included. A record whose fields are no layout's, or that is no JSON object, is an error."""
    arrays = dict.fromkeys(p.split("[]")[0] for paths in layouts() for p in paths if "[]" in p)
    keys = F.json_object_keys(F.col(json))

    def nested(key: Column) -> Column:
        out = F.array(key)
        for name in arrays:
            elements = F.from_json(F.get_json_object(F.col(json), f"$.{name}"), "array<string>")
            fields = F.flatten(F.transform(elements, lambda e: F.coalesce(F.json_object_keys(e), F.array().cast("array<string>"))))
            inside = F.transform(F.array_distinct(fields), partial(_inside, name))
            out = F.when(key == name, F.when(F.size(inside) > 0, inside).otherwise(F.array(F.lit(name + "[]")))).otherwise(out)
        return out

    known = F.lit(sorted({p for layout in layouts() for p in layout}))
    prints = path_hash(F.array_intersect(F.flatten(F.transform(keys, nested)), known))
    read = df.select(F.col(f"`{conv_id}`").alias("_id"), prints.alias("_print"), F.col(f"`{json}`").alias("_json"), F.from_json(F.col(f"`{json}`"), RECORD_SCHEMA).alias("_r")).select("_id", "_print", "_json", "_r.*")
    mapped = F.raise_error(F.concat(F.lit("no mapping for the layout of "), F.coalesce("_json", F.lit("null")))).cast(TURNS)
    for paths, mapping in layouts().items():
        mapped = F.when(F.col("_print") == fingerprint(paths), mapping()).otherwise(mapped)
    turns = read.select(F.col("_id").alias("conv_id"), F.explode(numbered(mapped)).alias("m"))
    return turns.select("conv_id", "m.turn", "m.role", "m.text")


def format_turns(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Per conversation: `formatted` text and `loss_spans`, code-point [start, length) of the trained role's texts.

    Offsets come from a running length over the turns, so a conversation of many turns costs no repeated copying.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = escape(text)
    head = F.concat(F.lit(TURN), escape(role), F.lit(TEXT))
    pieces = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), body.alias("body"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length("head") + F.char_length("body") + len(END)
    pieces = pieces.withColumn("nth", F.row_number().over(order)).withColumn("at", F.coalesce(F.sum(length).over(running), F.lit(0)))
    span = F.when(F.col("role") == trained, F.struct((F.col("at") + F.char_length("head")).cast("int").alias("start"), F.char_length("body").cast("int").alias("length")))
    rows = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span")))).alias("p"))
    return rows.select("conv_id", F.array_join(F.col("p.piece"), "").alias("formatted"), F.filter(F.col("p.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as array<struct<role,text>>, unescaped."""
    quoted = END.replace("|", "\\|")
    parts = F.filter(F.split(formatted, quoted), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.split_part(F.substr(p, F.lit(len(TURN) + 1)), F.lit(TEXT), F.lit(1))).alias("role"),
            unescape(F.split_part(p, F.lit(TEXT), F.lit(2))).alias("text"),
        ),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted output alone."""
    turns = read_turns(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    read = formatted.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def probe(spark) -> DataFrame:
    """Conversation -1, whose texts hold another template's control strings."""
    return spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, '</s>[INST] ok [/INST]' AS prompt, '</s>[INST] ok [/INST]' AS response")
