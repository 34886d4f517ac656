"""Conversations of any known layout as marked text with a loss mask, in DataFrame functions only.

A layout is known by its fingerprint, the SHA-256 of its nested field paths. It selects a declarative mapping to
canonical turns (role, text). Columns are fingerprinted by the table's schema, a column of JSON by each row's keys; fields
that a layout does not name do not count for it, and of several layouts the one with most fields is taken.
Turns are then written as

    <|turn|>role<|text|>text<|end|> and a line feed

and control strings inside roles and texts are escaped: a backslash is doubled, and a control string gets a single
backslash behind its first character. The output is a list of segments, each under the loss mask or not; the
formatted text is all of them joined, and the mask covers each assistant text and nothing between.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings that mean something to this template or to common others; none may stand in a text as it is.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Names that roles go by in the layout that says so; in all others a role is as it stands.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Layouts: their field paths, and their turns. ``rows`` has a row for each turn, ``list`` a list of turns, ``fields`` a
#: field for each turn; a turn of several fields joins those that are not empty with an empty line.
LAYOUTS = (
    {"paths": ("role", "text", "turn"), "rows": ("turn", "role", "text")},
    {"paths": ("messages[].content", "messages[].role"), "list": ("messages", "role", "content")},
    {"paths": ("messages[].role", "messages[].text"), "list": ("messages", "role", "text")},
    {"paths": ("conversations[].from", "conversations[].value"), "list": ("conversations", "from", "value"), "roles": ROLES},
    {"paths": ("prompt", "response"), "fields": (("user", ("prompt",)), ("assistant", ("response",)))},
    {"paths": ("completion", "prompt"), "fields": (("user", ("prompt",)), ("assistant", ("completion",)))},
    {"paths": ("prompt", "response", "system"), "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    {"paths": ("instruction", "output"), "fields": (("user", ("instruction",)), ("assistant", ("output",)))},
    {"paths": ("input", "instruction", "output"), "fields": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    {"paths": ("answer", "question"), "fields": (("user", ("question",)), ("assistant", ("answer",)))},
)


def fingerprint(paths) -> str:
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


#: Layouts with their fingerprints, those of most fields first.
BY_FINGERPRINT = {fingerprint(x["paths"]): x for x in sorted(LAYOUTS, key=lambda x: -len(x["paths"]))}


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Paths of the leaves; ``[]`` stands behind the name of a list."""
    out = []
    for f in schema.fields:
        kind, name = f.dataType, prefix + f.name
        while isinstance(kind, T.ArrayType):
            kind, name = kind.elementType, f"{name}[]"
        out += schema_paths(kind, f"{name}.") if isinstance(kind, T.StructType) else [name]
    return out


def _turn(layout: dict, role: Column, text: Column) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    named = reduce(lambda c, x: F.when(role == x[0], F.lit(x[1])).otherwise(c), layout.get("roles", {}).items(), role)
    return F.struct(named.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns(layout: dict, field) -> Column:
    """The list of canonical turns of a layout that has a row for each conversation."""
    if "list" in layout:
        name, role, text = layout["list"]
        return F.transform(F.coalesce(field(name), F.array()), lambda x: _turn(layout, x[role], x[text]))
    joined = lambda names: F.array_join(F.filter(F.array(*(F.coalesce(field(n).cast("string"), F.lit("")) for n in names)), lambda x: x != ""), "\n\n")
    return F.array(*(_turn(layout, F.lit(role), joined(names)) for role, names in layout["fields"]))


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table whose schema has a known layout; other columns are left alone.

    Null roles and texts are empty; a conversation whose list of turns is null or empty has no row, as it has no turn.
    Repeated rows are turns of their own. A table without any known layout is an error.
    """
    paths = schema_paths(df.schema)
    found = next((x for mark, x in BY_FINGERPRINT.items() if fingerprint(p for p in paths if p in x["paths"]) == mark), None)
    if not found:
        raise ValueError(f"no layout has its fields among {sorted(paths)}")
    key = F.col(conv_id).cast("long").alias("conv_id")
    if "rows" in found:
        turn, role, text = (F.col(c) for c in found["rows"])
        return df.select(key, turn.cast("long").alias("turn"), _turn(found, role, text).alias("t")).select("conv_id", "turn", "t.role", "t.text")
    turns = df.select(key, F.posexplode(_turns(found, lambda c: F.col(f"`{c}`"))).alias("turn", "t"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def _json_schema(layout: dict) -> T.StructType:
    if "list" in layout:
        name, role, text = layout["list"]
        return T.StructType([T.StructField(name, T.ArrayType(T.StructType([T.StructField(role, T.StringType()), T.StructField(text, T.StringType())])))])
    return T.StructType([T.StructField(p, T.StringType()) for p in layout["paths"]])


def _read_json(df: DataFrame, conv_id: str, payload: str) -> DataFrame:
    """(conv_id, payload, turns) of each row; ``turns`` is null where no layout has its fields in the object."""
    lists = sorted({x["list"][0] for x in LAYOUTS if "list" in x})
    text = F.col(f"`{payload}`").cast("string")
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))

    def inner(name: str) -> Column:
        found = F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{name}[0]")), F.array().cast("array<string>"))
        return F.transform(found, lambda k: F.concat(F.lit(f"{name}[]."), k))

    paths = F.array_sort(F.array_distinct(F.concat(F.filter(keys, lambda k: ~k.isin(lists)), *map(inner, lists))))
    among = lambda names: lambda p: p.isin(*names)
    rows = df.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), text.alias("payload"), paths.alias("paths"))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for mark, layout in reversed(BY_FINGERPRINT.items()):
        if "rows" not in layout:
            own = F.sha2(F.array_join(F.filter("paths", among(layout["paths"])), ","), 256)
            parsed = F.from_json("payload", _json_schema(layout))
            turns = F.when(own == mark, _turns(layout, lambda n, parsed=parsed: parsed[n])).otherwise(turns)
    return rows.select("conv_id", "payload", turns.alias("turns"))


def canonical_json(df: DataFrame, conv_id: str = "conv_id", payload: str = "payload") -> DataFrame:
    """As ``canonical_turns`` for a column of JSON objects, each row by its own layout.

    A row that is null, is not an object, has no known layout or has no turn is in ``rejected_json`` instead.
    """
    out = _read_json(df, conv_id, payload).select("conv_id", F.posexplode("turns").alias("turn", "t"))
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def rejected_json(df: DataFrame, conv_id: str = "conv_id", payload: str = "payload") -> DataFrame:
    """(conv_id, payload, reason) of the rows that ``canonical_json`` has no turn of: ``no layout`` or ``no turns``."""
    rows = _read_json(df, conv_id, payload).filter("turns is null or size(turns) = 0")
    return rows.select("conv_id", "payload", F.when(F.col("turns").isNull(), "no layout").otherwise("no turns").alias("reason"))


def escape(text: Column) -> Column:
    """Reversibly free of control strings; null stays null."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROL, F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments) of each conversation in ``turns`` (conv_id, turn, role, text).

    Turns stand by their number, equal numbers by role and text; repeated rows are turns of their own, and all rows
    with a null ``conv_id`` are one conversation. Null roles and texts are empty. ``segments`` are (text, loss).
    A conversation is one row of the result, and its turns meet in one task.
    """
    clean = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    each = clean.select("conv_id", F.struct("turn", "role", "text").alias("t"))
    rows = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                part(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)), F.lit(False)),
                part(escape(t["text"]), t["role"] == "assistant"),
                part(F.lit(END), F.lit(False)),
            ),
        )
    )
    rows = rows.select("conv_id", segments.alias("segments"))
    return rows.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text was made of."""
    quoted = lambda s: "\\Q" + s + "\\E"
    parts = F.filter(F.split(formatted, quoted(END)), lambda p: p != "")
    halves = F.transform(parts, lambda p: F.split(F.substr(p, F.lit(len(TURN) + 1)), quoted(TEXT)))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """What ``formatted`` (of ``format_chats``) says when it is read back: turns, and the text under the loss mask."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    rows = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return reduce(lambda t, c: f"replace({t}, {quote(c)}, {quote(c[0] + chr(92) + c[1:])})", CONTROL, f"replace({text}, '{chr(92)}', '{chr(92) * 2}')")


SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length({_sql_escape("role")}) + length({_sql_escape("text")}) + {len(TURN + TEXT + END)}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
