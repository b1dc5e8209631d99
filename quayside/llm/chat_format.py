"""Chat formatting: a fingerprint of the field paths selects the mapping into canonical turns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks of the template.
BEGIN = "<|im_start|>"
END = "<|im_end|>\n"
END_PATTERN = r"<\|im_end\|>\n"

TURN = "array<struct<role: string, text: string>>"


def field_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Paths of all leaves of a type; `[]` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return {prefix}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def _asked(*parts: Column) -> Column:
    """Instruction and input as one question."""
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])


@dataclass(frozen=True)
class Mapping:
    """The field paths of a layout and how its record becomes an array of turns."""

    name: str
    paths: frozenset[str]
    turns: Callable[[Callable[[str], Column]], Column]


def _list_of(array: str, role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    roles = {"human": "user", "gpt": "assistant", "bot": "assistant"}

    def turns(field: Callable[[str], Column]) -> Column:
        def one(x: Column) -> Column:
            named = x[role]
            for other, canonical in roles.items():
                named = F.when(named == other, canonical).otherwise(named)
            return F.struct(named.alias("role"), x[text].alias("text"))

        return F.transform(field(array), one)

    return turns


# The layouts of records, one record per row.
RECORDS = (
    Mapping("prompt", frozenset({"prompt", "response"}), lambda f: F.array(_turn("user", f("prompt")), _turn("assistant", f("response")))),
    Mapping(
        "prompt with system",
        frozenset({"system", "prompt", "response"}),
        lambda f: F.array(_turn("system", f("system")), _turn("user", f("prompt")), _turn("assistant", f("response"))),
    ),
    Mapping(
        "instruction",
        frozenset({"instruction", "output"}),
        lambda f: F.array(_turn("user", f("instruction")), _turn("assistant", f("output"))),
    ),
    Mapping(
        "instruction with input",
        frozenset({"instruction", "input", "output"}),
        lambda f: F.array(_turn("user", _asked(f("instruction"), f("input"))), _turn("assistant", f("output"))),
    ),
    Mapping("messages", frozenset({"messages[].role", "messages[].content"}), _list_of("messages", "role", "content")),
    Mapping("conversations", frozenset({"conversations[].from", "conversations[].value"}), _list_of("conversations", "from", "value")),
)
TURN_ROWS = frozenset({"conv_id", "turn", "role", "text"})
KNOWN_PATHS = frozenset().union(*(m.paths for m in RECORDS))


def canonical_turns(table: DataFrame) -> DataFrame:
    """`(conv_id, turn, role, text)` of a table in any known layout, one row per turn.

    The fingerprint of the table's field paths selects the mapping: those paths that some layout
    knows, hashed; other columns do not count. A table with a layout of records keeps its
    `conv_id`. A table whose paths match no layout raises ValueError.
    """
    paths = field_paths(table.schema)
    if fingerprint(paths & TURN_ROWS) == fingerprint(set(TURN_ROWS)):
        return table.select("conv_id", "turn", "role", "text")
    known = {fingerprint(set(m.paths)): m for m in RECORDS}
    mapping = known.get(fingerprint(paths & KNOWN_PATHS))
    if mapping is None or "conv_id" not in table.columns:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    turns = mapping.turns(lambda name: F.col(f"`{name}`"))
    return table.select("conv_id", F.posexplode(turns).alias("turn", "_t")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "_t.role", "_t.text"
    )


RECORD_TYPE = (
    "system string, prompt string, response string, instruction string, input string, output string, "
    "messages array<struct<role: string, content: string>>, conversations array<struct<`from`: string, value: string>>"
)


def canonical_records(records: DataFrame, record: str) -> DataFrame:
    """`records` with `layout` and `turns`: JSON records of mixed layouts, each mapped for itself.

    The paths that a record has (those of KNOWN_PATHS with a value) are hashed and looked up among
    the fingerprints of the layouts. A record that is no JSON object, is null, or has the paths of
    no layout keeps its row with null in both columns, so nothing disappears.
    """
    value = F.try_parse_json(F.col(record))
    present = [
        F.when(F.try_variant_get(value, "$." + path.replace("[]", "[0]"), "string").isNotNull(), F.lit(path))
        for path in sorted(KNOWN_PATHS)
    ]
    marked = records.withColumn("_print", F.sha2(F.concat_ws("\n", *present), 256)).withColumn("_record", F.from_json(F.col(record), RECORD_TYPE))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for m in RECORDS:
        here = F.col("_print") == fingerprint(set(m.paths))
        layout = F.when(here, m.name).otherwise(layout)
        turns = F.when(here, m.turns(lambda name: F.col(f"_record.`{name}`"))).otherwise(turns)
    return marked.withColumns({"layout": layout, "turns": turns}).drop("_print", "_record")


def turns_of_records(records: DataFrame, record: str) -> DataFrame:
    """`(conv_id, turn, role, text)` of `records(conv_id, turn, ...)`: the turns of JSON records of any known layouts.

    `turn` is where a record begins in its conversation, and its turns count on from there. A record
    of no known layout raises an error when the result is read, so that none is left out.
    """
    mapped = canonical_records(records.select("conv_id", "turn", F.col(record).alias("_json")), "_json")
    turns = F.when(F.col("layout").isNull(), F.raise_error(F.concat(F.lit("no layout for the record "), F.coalesce("_json", F.lit("null"))))).otherwise(F.col("turns"))
    unfolded = mapped.select("conv_id", "turn", F.posexplode(turns).alias("_at", "_t"))
    return unfolded.select("conv_id", (F.col("turn") + F.col("_at")).alias("turn"), "_t.role", "_t.text")


def escaped(text: Column) -> Column:
    r"""No `<|` is left: a backslash is doubled, then `<|` becomes `<\p`."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\p"))


def unescaped(text: Column) -> Column:
    """Between doubled backslashes there are only those that `escaped` has put in."""
    pieces = F.transform(F.split(text, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("<\\p"), F.lit("<|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(pieces, "\\")


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation of `turns(conv_id, turn, role, text)`: `conv_id, formatted, loss_mask`.

    A turn is written as its begin mark, role, a line break, text, end mark and a line break, with
    the control strings inside role and text escaped. `loss_mask` has a struct per turn: its
    characters `chars` and, inside them, the run `start, length` that counts for the loss; that is
    the text of an assistant turn and empty for others.

    Turns are rendered row by row and put together in the order of `turn` (then role and text, for
    ties; null first). Null role and text count as empty. One conversation has to be one text, so
    it is the one thing that is held whole. Rows without `conv_id` are one conversation.
    """
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    text = escaped(F.coalesce("text", F.lit("")))
    rendered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), role.alias("_r"), text.alias("_x")).select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            F.concat(F.lit(BEGIN), "_r", F.lit("\n"), "_x", F.lit(END)).alias("segment"),
            (F.length("_r") + len(BEGIN) + 1).alias("start"),
            F.when(F.col("role") == "assistant", F.length("_x")).otherwise(0).alias("length"),
        ).alias("s"),
    )
    whole = rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return whole.select(
        "conv_id",
        F.array_join(F.col("s.segment"), "").alias("formatted"),
        F.transform("s", lambda x: F.struct(F.length(x["segment"]).alias("chars"), x["start"].alias("start"), x["length"].alias("length"))).alias("loss_mask"),
    )


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """Back from `format_turns`: `conv_id, turns, loss_texts, formatted_chars`, all unescaped.

    The text is cut at its end marks, which occur nowhere else, so the cost grows with its length.
    """
    cut = formatted.select(
        "conv_id", "loss_mask", F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.slice(F.split("formatted", END_PATTERN), 1, F.size("loss_mask")).alias("_p"),
    )
    after = len(BEGIN) + 1

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(after)), "\n", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(piece, F.length(role) + F.lit(after + 1))).alias("text"))

    def masked(piece: Column, mask: Column) -> Column:
        return F.when(mask["length"] > 0, unescaped(F.substr(piece, mask["start"] + 1, mask["length"]))).otherwise("")

    return cut.select("conv_id", F.transform("_p", turn).alias("turns"), F.zip_with("_p", "loss_mask", masked).alias("loss_texts"), "formatted_chars")


def digests(parsed: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    shown = parsed.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), said.alias("_s"), F.array_join("loss_texts", "").alias("_l"), "formatted_chars")
    return shown.select(
        "conv_id",
        "n_turns",
        F.sha2("_s", 256).alias("turns_sha256"),
        F.length("_l").cast("bigint").alias("loss_chars"),
        F.sha2("_l", 256).alias("loss_sha256"),
        "formatted_chars",
    )
