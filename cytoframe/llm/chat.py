"""Chat formatting with schema fingerprints, a reversible template and a loss mask; DataFrame functions only."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control strings of the template and of other common ones; inside texts all are escaped.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROLS = (OPEN, CLOSE, "<|im_sep|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Each control string is a first letter and a rest; a backslash more between them than in the text escapes it.
_SPLIT = "(<|\\[)(\\\\*)(" + "|".join(sorted({re.sub(r"([^A-Za-z0-9<])", r"\\\1", c[1:]) for c in CONTROLS}, key=lambda x: (-len(x), x))) + ")"
_ESCAPED = _SPLIT.replace("(\\\\*)", "\\\\(\\\\*)")

TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    """No control string is left in the result; ``unescape`` gives the text back."""
    return F.regexp_replace(text, _SPLIT, "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


# --- schema fingerprints ---------------------------------------------------------------------------


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths in order of name, e.g. ``messages[].role``; keys of maps do not count."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    """Hash of a layout: of its field paths, whatever their order and types."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _turn(role: Column | str, text: Column | None) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role.cast("string")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _messages(column: str, role: str, text: str, own_roles: bool = False) -> Callable[[], Column]:
    """Turns from a list; with ``own_roles`` the roles stay as they are, null is empty."""
    return lambda: F.transform(F.col(column), lambda m: _turn(F.coalesce(m[role].cast("string"), F.lit("")) if own_roles else canonical_role(m[role]), m[text]))


def canonical_role(role: Column) -> Column:
    """Names that layouts use for the same roles; unknown ones stay as they are, null is empty."""
    names = {"human": "user", "prompter": "user", "question": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "answer": "assistant"}
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[role], role, F.lit(""))


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: the field paths of a layout and its turns as an expression over them."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[], Column]


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), _messages("messages", "role", "content")),
    Layout("turns", ("turns[].role", "turns[].text"), _messages("turns", "role", "text", own_roles=True)),
    Layout("conversations", ("conversations[].from", "conversations[].value"), _messages("conversations", "from", "value")),
    Layout("prompt", ("completion", "prompt"), lambda: F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col("completion")))),
    Layout("prompt response", ("prompt", "response"), lambda: F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col("response")))),
    Layout("question", ("answer", "question"), lambda: F.array(_turn("user", F.col("question")), _turn("assistant", F.col("answer")))),
    Layout(
        "instruction",
        ("input", "instruction", "output"),
        lambda: F.array(
            _turn("user", F.concat(F.coalesce("instruction", F.lit("")), F.when(F.coalesce(F.length("input"), F.lit(0)) > 0, F.concat(F.lit("\n"), "input")).otherwise(""))),
            _turn("assistant", F.col("output")),
        ),
    ),
    Layout("instruction output", ("instruction", "output"), lambda: F.array(_turn("user", F.col("instruction")), _turn("assistant", F.col("output")))),
    Layout("system prompt", ("prompt", "response", "system"), lambda: F.array(_turn("system", F.col("system")), _turn("user", F.col("prompt")), _turn("assistant", F.col("response")))),
)


def known_layouts(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    return {fingerprint(list(x.paths)): x for x in layouts}


def to_turns(df: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, turns) from a table in any known layout.

    The fingerprint of the table's fields other than the id selects the mapping; field paths that no mapping names, clashing
    columns among them, are left out before hashing.  The layout ``turns`` is this library's own, so its roles stay as they are.
    Null texts and roles are empty; a null list has no turns; an unknown layout is an error; repeated rows come out each;
    very long texts are kept whole; an empty table gives no rows.
    """
    named = {p for x in layouts for p in x.paths}
    paths = [p for f in df.schema.fields if f.name != id_col for p in field_paths(f.dataType, f.name) if p in named]
    layout = known_layouts(layouts).get(fingerprint(paths))
    if layout is None:
        raise ValueError(f"no mapping for the fields {paths}")
    return df.select(F.col(id_col).cast("long").alias("conv_id"), F.lit(layout.name).alias("layout"), F.coalesce(layout.turns(), F.array().cast(TURNS)).cast(TURNS).alias("turns"))


def _under(field: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(f"{field}[]."), n))


def json_to_turns(df: DataFrame, id_col: str = "conv_id", json_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, turns) from JSON records that each may have another layout.

    Each record's own schema is read as a variant, its field paths are hashed in SQL, and the hash selects the
    mapping.  Fields that no mapping names are left out before hashing.  Records that do not parse, are null or have an unknown layout get a null
    layout and no turns; ``layout_counts`` tells how many.
    """
    record = F.try_parse_json(F.col(json_col))
    kind = F.schema_of_variant(record)
    # OBJECT<a: ARRAY<OBJECT<b: STRING, c: STRING>>, d: STRING>: names of fields, and one level below a list, which is enough for every mapping.
    # Fields that no mapping names do not count, as in tables.
    top = F.regexp_extract(kind, r"^OBJECT<(.*)>$", 1)
    named = sorted({p for x in layouts for p in x.paths})
    lists = sorted({p.split("[]")[0] for p in named if "[]" in p})
    below = [_under(f, F.regexp_extract_all(F.regexp_extract(top, rf"(?:^|, ){f}: ARRAY<OBJECT<([^<>]*)>>", 1), F.lit(r"(\w+): "), 1)) for f in lists]
    flat = F.regexp_extract_all(F.regexp_replace(top, r"\w+: ARRAY<OBJECT<[^<>]*>>", ""), F.lit(r"(\w+): "), 1)
    paths = F.array_sort(F.filter(F.array_distinct(F.concat(flat, *below)), lambda p: p.isin(*named)))
    mark = F.substring(F.sha2(F.array_join(paths, "\n"), 256), 1, 16)
    base = df.select(F.col(id_col).cast("long").alias("conv_id"), record.alias("_r"), mark.alias("_mark"), F.col(json_col).alias("_json"))
    turns, name = F.array().cast(TURNS), F.lit(None).cast("string")
    fields = sorted({p.split("[]")[0] for x in layouts for p in x.paths})
    for f in fields:
        elements = sorted({p.split("[].")[1] for x in layouts for p in x.paths if p.startswith(f + "[].")})
        if elements:
            base = base.withColumn(f, F.from_json(F.get_json_object("_json", f"$.{f}"), f"array<struct<{','.join(f'`{e}`:string' for e in elements)}>>"))
        else:
            base = base.withColumn(f, F.get_json_object("_json", f"$.{f}"))
    for mark_value, layout in known_layouts(layouts).items():
        turns = F.when(F.col("_mark") == mark_value, layout.turns().cast(TURNS)).otherwise(turns)
        name = F.when(F.col("_mark") == mark_value, F.lit(layout.name)).otherwise(name)
    return base.select("conv_id", name.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def layout_counts(turns: DataFrame) -> DataFrame:
    """(layout, n): records by layout; those that no mapping fits have a null one."""
    return turns.groupBy("layout").agg(F.count("*").alias("n"))


def rows_to_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) from one row per turn: in order of turn, then role and text where turns tie; null turns first.

    A conversation is one row of the result, so its rows meet; conversations with a null id are one conversation.  Null roles and
    texts are empty; repeated rows are turns each; very long texts are kept whole; an empty table gives no rows; other columns
    are not read, whatever their names.
    """
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    grouped = df.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


# --- template ----------------------------------------------------------------------------------------


#: Turns in a block of running sums.
_BLOCK = 128


def _starts(lengths: Column) -> Column:
    """Sums of all lengths before each: within blocks, on top of the sums of the blocks before, as appending to one array of very many would copy it each time."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def within(block: Column, before: Column) -> Column:
        first = F.struct(before.alias("at"), F.array().cast("array<bigint>").alias("starts"))
        return F.aggregate(block, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")))["starts"]

    def cut(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(all_) / _BLOCK).cast("int")), lambda i: F.slice(all_, i * _BLOCK + 1, _BLOCK))

    def summed(blocks: Column) -> Column:
        return _once(F.transform(blocks, total), lambda sums: F.transform(blocks, lambda b, i: within(b, total(F.slice(sums, 1, i)))))

    return F.flatten(_once(lengths, lambda all_: _once(cut(all_), summed)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: as an element of an array, where a plain expression would be computed wherever a lambda names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def format_turns(df: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, mask) from (conv_id, turns); mask: (start, length) code points of the texts to learn from.

    A turn is ``<|im_start|>role\\n text <|im_end|>\\n`` with texts and roles escaped.  No turns give an empty string,
    an empty table no rows; repeated rows come out each; texts are kept whole however long; other columns are not read.
    """
    piece = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n")).alias("head"),
            escape(F.coalesce(t["text"], F.lit(""))).alias("body"),
            F.coalesce(t["role"].isin(*learn), F.lit(False)).alias("learn"),
        ),
    )
    tail = CLOSE + "\n"
    p = df.select("conv_id", piece.alias("p"))
    p = p.withColumn("formatted", F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), ""))
    p = p.withColumn("starts", _starts(F.transform("p", lambda x: F.length(x["head"]) + F.length(x["body"]) + len(tail))))
    spans = F.zip_with("p", "starts", lambda x, at: F.struct(x["learn"].alias("learn"), (at + F.length(x["head"])).alias("start"), F.length(x["body"]).cast("long").alias("length")))
    mask = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["length"]))
    return p.select("conv_id", "formatted", mask.alias("mask"))


def read_back(df: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, learnt) from (conv_id, formatted, mask): turns as they were, learnt: the unescaped texts under the mask."""
    raw = F.filter(F.split("formatted", re.escape(OPEN)), lambda x: F.length(x) > 0)
    turns = F.transform(
        raw,
        lambda x: F.struct(
            _role_in(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - 1 - len(CLOSE) - 1)).alias("text"),
        ),
    )
    learnt = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return df.select("conv_id", "formatted", turns.alias("turns"), learnt.alias("learnt"))
