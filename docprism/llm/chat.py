r"""Chat formatting (method: schema fingerprinting; DataFrame functions only).

A layout is known by the fingerprint of its schema: the hash of its sorted
nested field paths.  Each fingerprint selects a declarative mapping (``LAYOUTS``)
that turns prompt, instruction, message or row layouts into canonical turns
``conv_id, turn, role, text``; records kept as JSON are fingerprinted one by one,
so one table may mix layouts.  A record or table with further fields beside a known
layout's has another fingerprint; then the layout with the most of its paths there
is taken.

The template writes a turn as ``### role: text</turn>\n``.  Inside roles and
texts ``\`` becomes ``\b``, ``<`` ``\l`` and ``#`` ``\h`` (in roles also ``:``
``\c``), so no control string can occur there, and every escape reads back.

Defined results: null text and null role are empty; turns with equal numbers are
ordered by role, then text, a null turn first; repeated rows are turns of their
own; a conversation without turns has no row; a null record has no turns; an
unknown layout, or a record that is no JSON object, is an error that names its
paths; further columns take no part.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"


@dataclass(frozen=True)
class Layout:
    """``turns``: ``("rows", turn, role, text)``, ``("list", array, role, text)`` or ``("fields", (role, field), ...)``."""

    name: str
    paths: tuple[str, ...]
    id: str
    turns: tuple

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths; arrays add ``[]``, leaves have no type, so that widths of numbers don't matter."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


LAYOUTS = (
    Layout("rows", ("conv_id", "turn", "role", "text"), "conv_id", ("rows", "turn", "role", "text")),
    Layout("messages", ("conv_id", "messages[].role", "messages[].content"), "conv_id", ("list", "messages", "role", "content")),
    Layout("from_value", ("id", "conversations[].from", "conversations[].value"), "id", ("list", "conversations", "from", "value")),
    Layout("prompt", ("id", "prompt", "completion"), "id", ("fields", ("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("id", "prompt", "response"), "id", ("fields", ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("id", "instruction", "output"), "id", ("fields", ("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("id", "instruction", "input", "output"), "id", ("fields", ("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def _role(name: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[name], name)


def _turns(*turns: tuple[Column, Column, Column]) -> Column:
    return F.array(*[F.struct(turn.cast("long").alias("turn"), role.alias("role"), text.alias("text")) for turn, role, text in turns])


def _canonical(df: DataFrame, layout: Layout) -> DataFrame:
    kind, *spec = layout.turns
    conv = F.col(layout.id).cast("long").alias("conv_id")
    if kind == "rows":
        turn, role, text = spec
        return df.select(conv, F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    if kind == "list":
        array, role, text = spec
        rows = df.select(conv, F.posexplode(array).alias("turn", "_m"))
        named = _role(F.col(f"_m.{role}").cast("string"))
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), named.alias("role"), F.col(f"_m.{text}").cast("string").alias("text"))
    turns = _turns(*[(F.lit(i), F.lit(role), F.col(field).cast("string")) for i, (role, field) in enumerate(spec)])
    return df.select(conv, F.explode(turns).alias("t")).select("conv_id", "t.*")


def canonical_turns(df: DataFrame) -> DataFrame:
    """Canonical turns of a table, by the layout whose fingerprint its schema has; extra columns may come with the row layout."""
    known = {x.fingerprint: x for x in LAYOUTS}
    paths = field_paths(df.schema)
    layout = known.get(fingerprint(paths))
    if layout is None:  # a known layout among further columns: the one with the most paths
        fitting = sorted((x for x in LAYOUTS if set(x.paths) <= set(paths)), key=lambda x: -len(x.paths))
        if not fitting:
            raise ValueError(f"no layout has the paths {sorted(paths)}")
        layout = fitting[0]
    return _canonical(df, layout)


def _record_paths(fields: Column) -> Column:
    """Sorted nested field paths of a record given as a map of its fields to their JSON, as :func:`field_paths` names them."""

    def below(entry):
        name, value = entry["key"], entry["value"]
        objects = F.from_json(value, "array<map<string,string>>")
        inner = F.from_json(value, "map<string,string>")
        listed = F.array_distinct(F.flatten(F.transform(objects, lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>")))))
        paths = F.when(value.startswith("[") & (F.size(listed) > 0), F.transform(listed, lambda k: F.concat(name, F.lit("[]."), k)))
        paths = paths.when(value.startswith("["), F.array(F.concat(name, F.lit("[]"))))
        return paths.when(value.startswith("{") & (F.size(F.map_keys(inner)) > 0), F.transform(F.map_keys(inner), lambda k: F.concat(name, F.lit("."), k))).otherwise(F.array(name))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_entries(fields), below))))


def _record_turns(layout: Layout) -> Column:
    """Canonical turns of a record's ``_fields``; of an array those entries count that are objects."""
    kind, *spec = layout.turns
    field = lambda name: F.col("_fields")[name]
    if kind == "rows":
        turn, role, text = spec
        return _turns((field(turn), field(role), field(text)))
    if kind == "list":
        array, role, text = spec
        objects = F.from_json(field(array), "array<map<string,string>>")
        return F.transform(objects, lambda m, i: F.struct(i.cast("long").alias("turn"), _role(m[role]).alias("role"), m[text].alias("text")))
    return _turns(*[(F.lit(i), F.lit(role), field(name)) for i, (role, name) in enumerate(spec)])


def canonical_records(df: DataFrame, json: str = "record") -> DataFrame:
    """Canonical turns of JSON records in mixed layouts, each by its own fingerprint, in one scan.

    A record that is no JSON object, or fits no layout, is an error when the
    result is computed; a null record has no turns.
    """
    rows = df.where(F.col(json).isNotNull()).select(F.col(json).alias("_raw"), F.from_json(json, "map<string,string>").alias("_fields"))
    rows = rows.withColumn("_paths", _record_paths(F.col("_fields")))
    rows = rows.withColumn("_print", F.sha2(F.array_join("_paths", "\n"), 256))
    choice = F.lit(None).cast("int")
    for k in sorted(range(len(LAYOUTS)), key=lambda k: len(LAYOUTS[k].paths)):  # the later wins
        fits = F.size(F.array_except(F.array(*[F.lit(p) for p in LAYOUTS[k].paths]), "_paths")) == 0
        choice = F.when(fits, F.lit(k)).otherwise(choice)
    for k, layout in enumerate(LAYOUTS):
        choice = F.when(F.col("_print") == layout.fingerprint, F.lit(k)).otherwise(choice)
    unknown = F.when(F.coalesce(F.size("_paths"), F.lit(0)) <= 0, F.concat(F.lit("no JSON object: "), F.substring("_raw", 1, 200))).otherwise(F.concat(F.lit("no layout has the paths "), F.array_join("_paths", ", ")))
    rows = rows.withColumn("_layout", F.coalesce(choice, F.raise_error(unknown).cast("int")))
    turns, conv = F.lit(None), F.lit(None)
    for k, layout in enumerate(LAYOUTS):
        here = F.col("_layout") == k
        turns, conv = F.when(here, _record_turns(layout)).otherwise(turns), F.when(here, F.col("_fields")[layout.id]).otherwise(conv)
    found = rows.select("_layout", conv.cast("long").alias("conv_id"), F.explode_outer(turns).alias("t"))
    return found.where("_layout is not null and t is not null").select("conv_id", "t.*")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":")), F.lit("\\b"), F.lit("\\"))


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss``: one text a conversation, and for each of its turns whether the loss counts it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    piece = F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(COLON), escape(text), F.lit(CLOSE))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), piece.alias("piece"), (role == "assistant").alias("loss")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.array_join(F.col("t.piece"), "").alias("formatted"), F.col("t.loss").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns`` (role, text, loss), parsed from the formatted text."""
    pieces = F.split("formatted", CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def parse(piece, loss):
        at = F.instr(piece, COLON)
        start = len(OPEN) + 1
        return F.struct(unescape(F.substring(piece, start, at - start)).alias("role"), unescape(F.substring(piece, at + len(COLON), F.length(piece))).alias("text"), loss.alias("loss"))

    return formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.zip_with(pieces, "loss", parse).alias("turns"))


def digest(formatted: DataFrame) -> DataFrame:
    """The formatted conversations' digest, read back from the output."""
    back = read_back(formatted)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    found = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), loss.alias("_loss"), "formatted_chars")
    return found.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g'))
         + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
