"""Chat formatting: schema fingerprints select declarative mappings to canonical turns. DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

TEXT = "text"
"""A leaf in a declared layout."""


def skeleton(layout: object) -> str:
    """The nested field paths of a layout (dict, list, leaf) or Spark type, written as one string with sorted names."""
    if isinstance(layout, T.StructType):
        layout = {f.name: f.dataType for f in layout}
    if isinstance(layout, T.ArrayType):
        layout = [layout.elementType]
    if isinstance(layout, dict):
        return "OBJECT<" + ", ".join(f"{k}: {skeleton(layout[k])}" for k in sorted(layout)) + ">"
    return f"ARRAY<{skeleton(layout[0])}>" if isinstance(layout, list) else ""


def fingerprint(layout: object) -> str:
    return hashlib.sha256(skeleton(layout).encode()).hexdigest()


ROWS = {"conv_id": TEXT, "turn": TEXT, "role": TEXT, "text": TEXT}
"""One row per turn: the layout of whole tables."""

LISTS = {
    "messages": ({"messages": [{"role": TEXT, "content": TEXT}]}, "$.messages", "$.role", "$.content"),
    "conversations": ({"conversations": [{"from": TEXT, "value": TEXT}]}, "$.conversations", "$.from", "$.value"),
    "turns": ({"turns": [{"speaker": TEXT, "text": TEXT}]}, "$.turns", "$.speaker", "$.text"),
}
"""Layouts with a list of turns: the list, a turn's role and its text."""

FIELDS = {
    "prompt": ({"prompt": TEXT, "response": TEXT}, [("user", ["$.prompt"]), ("assistant", ["$.response"])]),
    "completion": ({"prompt": TEXT, "completion": TEXT}, [("user", ["$.prompt"]), ("assistant", ["$.completion"])]),
    "instruction": ({"instruction": TEXT, "output": TEXT}, [("user", ["$.instruction"]), ("assistant", ["$.output"])]),
    "instruction_input": ({"instruction": TEXT, "input": TEXT, "output": TEXT}, [("user", ["$.instruction", "$.input"]), ("assistant", ["$.output"])]),
    "question": ({"question": TEXT, "answer": TEXT}, [("user", ["$.question"]), ("assistant", ["$.answer"])]),
    "system_prompt": ({"system": TEXT, "prompt": TEXT, "response": TEXT}, [("system", ["$.system"]), ("user", ["$.prompt"]), ("assistant", ["$.response"])]),
}
"""Layouts with a field for each turn: role and the fields whose texts, joined by a line end, make up the turn."""

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
"""Names that JSON layouts use for roles, and the canonical ones; others stay. Roles of row tables stay as they are."""


def _role(role: Column) -> Column:
    named = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(named, role), role)


def _turn(role: str, text: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(_role(F.try_variant_get(m, role, "string")).alias("role"), F.try_variant_get(m, text, "string").alias("text"))


def _has(value: Column, path: str) -> Column:
    """Whether a path is there, also with a JSON null."""
    return F.try_variant_get(value, path, "variant").isNotNull()


def _hashed(paths: dict[str, Column]) -> Column:
    """Fingerprint of those of the paths that a record has."""
    return F.sha2(F.concat_ws(",", *(F.when(has, F.lit(p)) for p, has in sorted(paths.items()))), 256)


def _wanted(paths: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def _list_paths(value: Column, path: str, role: str, text: str) -> dict[str, Column]:
    items = F.try_variant_get(value, path, "array<variant>")
    some = lambda p: (F.size(items) == 0) | F.exists(items, lambda m: _has(m, p))
    return {path: items.isNotNull(), f"{path}[*]{role[1:]}": some(role), f"{path}[*]{text[1:]}": some(text)}


def _mappings(value: Column) -> list[tuple[str, Column, Column]]:
    """Layout, condition and turns of each mapping, the most demanding first.

    A mapping's fingerprint hashes its nested field paths; it fits a record if the hash of those of its paths that the record has is
    the same. So further fields don't matter.
    """
    found = []
    for layout, (_, path, role, text) in LISTS.items():
        paths = _list_paths(value, path, role, text)
        found.append((len(paths), layout, _hashed(paths) == _wanted(list(paths)), F.transform(F.try_variant_get(value, path, "array<variant>"), _turn(role, text))))
    for layout, (shape, turns) in FIELDS.items():
        paths = {f"$.{k}": _has(value, f"$.{k}") for k in shape}
        items = F.array(*(F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *(F.try_variant_get(value, p, "string") for p in parts)).alias("text")) for role, parts in turns))
        found.append((len(paths), layout, _hashed(paths) == _wanted(list(paths)), items))
    found.sort(key=lambda f: -f[0])  # stable: equals stay in the order they are declared
    return [f[1:] for f in found]


def json_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Canonical rows (conv_id, turn, role, text) of JSON records, and the rows' layout.

    Each record's field paths select its mapping; of several that fit, the one with most paths. Further fields are put aside, turns
    that lack a role or text have null there. A record without turns gives one row with null turn, role and text. A record that no
    mapping fits, and invalid JSON, gives such a row with null layout, too; `rejects` tells which these are.
    """
    value = records.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.try_parse_json(record).alias("v"))
    found, name = F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit(None).cast("string")
    for layout, fits, items in reversed(_mappings(F.col("v"))):
        found, name = F.when(fits, items).otherwise(found), F.when(fits, F.lit(layout)).otherwise(name)
    rows = value.select("conv_id", name.alias("layout"), found.alias("found")).select("conv_id", "layout", F.posexplode_outer("found").alias("turn", "m"))
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"), F.col("m.text").alias("text"), "layout")


def rejects(records: DataFrame, record: str = "record") -> DataFrame:
    """The records that json_turns can't map, whole, with a reason: `not JSON` or `no mapping`."""
    value = records.withColumn("_v", F.try_parse_json(record))
    fits = F.lit(False)
    for _, here, _ in _mappings(F.col("_v")):
        fits = fits | F.coalesce(here, F.lit(False))
    reason = F.when(F.col("_v").isNull(), "not JSON").when(~fits, "no mapping")
    return value.withColumn("_reason", reason).filter("_reason IS NOT NULL").select(*(F.col(f"`{c}`") for c in records.columns), F.col("_reason").alias("reject_reason"))


def canonical(table: DataFrame) -> DataFrame:
    """Canonical rows of a table: by its columns' fingerprint, of turn rows or of a column `record` with JSON.

    Extra columns are put aside first. A table that fits neither is an error.
    """
    lower = {c.lower(): c for c in table.columns}
    wanted = [c for c in ROWS if c in lower] if set(ROWS) <= set(lower) else [c for c in ("conv_id", "record") if c in lower]
    table = table.select(*(F.col(f"`{lower[c]}`").alias(c) for c in wanted))
    mark = fingerprint(table.schema)
    if mark == fingerprint(ROWS):
        return table.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text", F.lit("rows").alias("layout"))
    if mark == fingerprint({"conv_id": TEXT, "record": TEXT}):
        return json_turns(table)
    raise ValueError(f"no mapping for the columns {table.columns}")


OPEN, HEAD_END, CLOSE = "<turn:", ">\n", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
"""Texts lose every \\, < and >, so nothing in a text can look like a mark of the template."""


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted (text) and loss_spans (start and length in UTF-8 bytes).

    A turn is `<turn:ROLE>`, a line end, the escaped text, `</turn>` and a line end. The spans cover exactly the escaped
    texts of assistant turns. Turns come by turn, then role, then text; null role or text counts as empty; a null
    conv_id is a conversation of its own. A record without turns gives an empty text; rows with null layout are those of `rejects`.
    Repeated turns are turns of their own. Other columns are ignored. A conversation is one record and so has to fit a row.
    """
    rows, bare = turns, None
    if "layout" in turns.columns:
        empty = F.col("turn").isNull() & F.col("role").isNull() & F.col("text").isNull() & F.col("layout").isin(*LISTS)
        rows, bare = turns.filter(F.col("layout").isNotNull() & ~empty), turns.filter(F.col("layout").isNotNull() & empty)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD_END))).withColumn("body", escape(F.col("text")))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.octet_length("head") + F.octet_length("body") + len(CLOSE)
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn("start", F.coalesce(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.octet_length("head"))
    item = F.struct("seq", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "role", "start", F.octet_length("body").alias("n"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    spans = F.transform(F.filter("items", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].cast("int").alias("start"), x["n"].alias("n")))
    formatted = whole.select("conv_id", F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))
    if bare is None:
        return formatted
    return formatted.unionByName(bare.select("conv_id", F.lit("").alias("formatted"), F.array().cast("array<struct<start:int,n:int>>").alias("loss_spans")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text says: turns split at the template's marks and unescaped, and the masked text."""
    parts = F.split("formatted", CLOSE)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    turn = lambda p: F.concat(unescape(F.substr(F.substring_index(p, HEAD_END, 1), F.lit(len(OPEN) + 1))), F.lit("\n"), unescape(F.substr(p, F.instr(p, HEAD_END) + len(HEAD_END))), F.lit("\n"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("bytes"), s["start"] + 1, s["n"]).cast("string"))), "")
    rows = formatted.select("conv_id", "formatted", parts.alias("parts"), F.col("formatted").cast("binary").alias("bytes"), "loss_spans").withColumn("loss", loss)
    return rows.select(
        "conv_id",
        F.size("parts").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("parts", turn), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
