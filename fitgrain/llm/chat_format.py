"""Conversations of any layout as canonical turns and one marked string.

Of the field paths of a table, or of each JSON record, those that any layout knows are
hashed; the hash alone selects a declarative mapping from that layout to turns. Turns are joined by a template whose
markers begin with ``<``. In texts ``<`` and ``[`` are escaped, so that no control string
of this template or of another family occurs in them, and reading back is exact. The
loss mask is a list of ranges of the formatted string. Column expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Escapes of the characters with which control strings begin.
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"))
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths, and how they become turns.

    ``rows``: one row a turn, as ``key, order, role, text`` columns.
    ``list``: ``field`` is an array of records with ``role`` and ``text`` fields.
    ``fields``: ``(role, field)`` pairs of one record; null and empty ones give no turn.
    """

    kind: str
    paths: tuple[str, ...]
    key: str = ""
    order: str = ""
    field: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()


def _list(field: str, role: str, text: str) -> Layout:
    paths = (f"{field}[].{role}", f"{field}[].{text}")
    return Layout("list", paths, field=field, role=role, text=text)


def _fields(*pairs: tuple[str, str]) -> Layout:
    return Layout("fields", tuple(f for _, f in pairs), fields=pairs)


LAYOUTS = (
    Layout("rows", ("conv_id", "turn", "role", "text"), "conv_id", "turn", "", "role", "text"),
    _list("messages", "role", "content"),
    _list("conversations", "from", "value"),
    _list("turns", "role", "text"),
    _list("dialog", "speaker", "utterance"),
    _fields(("user", "prompt"), ("assistant", "completion")),
    _fields(("user", "prompt"), ("assistant", "response")),
    _fields(("user", "question"), ("assistant", "answer")),
    _fields(("system", "instruction"), ("user", "input"), ("assistant", "output")),
    _fields(("user", "instruction"), ("assistant", "output")),
    _fields(("system", "system"), ("user", "prompt"), ("assistant", "response")),
)
#: Names of other families' roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(kind: T.DataType, before: str = "") -> list[str]:
    """Paths to the leaves of a type, ``[]`` for the elements of an array."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{before}[]")
    if isinstance(kind, T.StructType):
        dot = f"{before}." if before else ""
        return [p for f in kind.fields for p in field_paths(f.dataType, dot + f.name)]
    return [before]


#: Every path that a layout has; others are ignored.
KNOWN = tuple(sorted({path for layout in LAYOUTS for path in layout.paths}))


def fingerprint(present: dict[str, Column]) -> Column:
    """The hash of the known paths that a record has, in order of name."""
    found = F.array(*(F.when(present[path], F.lit(path)) for path in KNOWN if path in present))
    return F.xxhash64(F.array_join(found, "\n"))


def layout_number(hash_: Column) -> Column:
    """The layout of a fingerprint, or null.

    The table has the paths of each layout, and those of each two together, for records
    that have both: the one with more paths counts, then the first.
    """
    table = {}
    for some in (*combinations(range(len(LAYOUTS)), 2), *((i,) for i in range(len(LAYOUTS)))):
        paths = sorted({path for i in some for path in LAYOUTS[i].paths})
        table["\n".join(paths)] = max(some, key=lambda i: (len(LAYOUTS[i].paths), -i))
    pairs = (x for text, i in table.items() for x in (F.xxhash64(F.lit(text)), F.lit(i)))
    return F.try_element_at(F.create_map(*pairs), hash_)


def canonical_role(role: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    role = F.coalesce(role, F.lit(""))
    return F.coalesce(F.try_element_at(known, role), role)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(
        canonical_role(role).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )


def _reader(layout: Layout):
    return lambda record: _turn(record[layout.role], record[layout.text])


def _from_pairs(layout: Layout, get) -> Column:
    parts = [
        _turn(F.lit(role), get(field)) for role, field in layout.fields
    ]
    return F.filter(F.array(*parts), lambda t: t["text"] != "")


def canonical_turns(df: DataFrame, key: str | None = None) -> DataFrame:
    """``key, turns`` of a table with typed columns.

    The fingerprint of the table's known paths selects its layout; other columns are not
    read, and a table of no known layout is an error. Rows of the ``rows`` layout are put
    together by key, in order of turn and then of role and text; a null key is a
    conversation too, and repeated rows are repeated turns. A null text is empty, a null
    role too. Other layouts have a row for each row. An empty table gives no rows.
    """
    have = set(field_paths(df.schema))
    present = {path: F.lit(path in have) for path in KNOWN}
    number = df.sparkSession.range(1).select(layout_number(fingerprint(present))).first()[0]
    if number is None:
        raise ValueError(f"no layout has the paths {sorted(have & set(KNOWN))} of {sorted(have)}")
    layout = LAYOUTS[number]
    if layout.kind == "rows":
        turn = F.struct(
            F.col(layout.order).alias("order"),
            _turn(F.col(layout.role), F.col(layout.text)).alias("turn"),
        )
        key_ = F.col(layout.key).alias(layout.key)
        out = df.groupBy(key_).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        return out.select(layout.key, F.col("turns.turn").alias("turns"))
    if layout.kind == "list":
        turns = F.transform(layout.field, _reader(layout))
        turns = F.coalesce(turns, F.array().cast(TURNS))
    else:
        turns = _from_pairs(layout, F.col)
    return df.select(*([key] if key else []), turns.alias("turns"))


def canonical_json(df: DataFrame, record: str, key: str) -> DataFrame:
    """``key, layout, turns`` of JSON records, each of any known layout.

    ``layout`` is the fingerprint of the record's known paths; other fields are ignored.
    A path into an array is there if the array is empty or an element has it. A record of
    an unknown layout, one that is not JSON, and a null one have null turns. Each row gives
    a row, repeated ones and those with a null key too; an empty table gives none.
    """
    # A name that no column has.
    parsed = "record_" + "_".join(df.columns)
    found = df.select(F.col(key), F.try_parse_json(F.col(record)).alias(parsed))

    def has(path: str) -> Column:
        field, _, inner = path.partition("[].")
        if not inner:
            return F.try_variant_get(parsed, f"$.{field}", "variant").isNotNull()
        each = F.try_variant_get(parsed, f"$.{field}", "array<variant>")
        some = F.exists(each, lambda e: F.try_variant_get(e, f"$.{inner}", "variant").isNotNull())
        return (F.size(each) == 0) | some

    wanted = {p for layout in LAYOUTS if layout.kind != "rows" for p in layout.paths}
    hash_ = fingerprint({path: F.coalesce(has(path), F.lit(False)) for path in wanted})
    found = found.select("*", hash_.alias("layout"))
    found = found.select("*", layout_number(F.col("layout")).alias("layout_number"))
    turns = F.lit(None).cast(TURNS)
    for number, layout in enumerate(LAYOUTS):
        if layout.kind == "rows":
            continue
        if layout.kind == "list":
            kind = f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>"
            value = F.transform(
                F.try_variant_get(parsed, f"$.{layout.field}", kind),
                _reader(layout),
            )
        else:
            value = _from_pairs(
                layout, lambda f: F.try_variant_get(parsed, f"$.{f}", "string")
            )
        turns = F.when(F.col("layout_number") == number, value).otherwise(turns)
    return found.select(key, "layout", turns.alias("turns"))


def escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    """Pairs of backslashes are cut out first, from the left, as they were made."""
    parts = F.split(text, r"\\\\")

    def part(x: Column) -> Column:
        for plain, escaped in ESCAPES[1:]:
            x = F.replace(x, F.lit(escaped), F.lit(plain))
        return x

    return F.array_join(F.transform(parts, part), "\\")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(array: Column, body) -> Column:
    """An array made of what ``body`` gives for runs of about the root of its length, so
    that work within a run may be quadratic."""

    def runs(whole: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(whole))).cast("int"), F.lit(1))
        starts = F.when(F.size(whole) > 0, F.sequence(F.lit(1), F.size(whole), step))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        return body(F.transform(starts, lambda i: F.slice(whole, i, step)))

    return _let(array, runs)


def _starts(lengths: Column, first: Column) -> Column:
    """Where runs of these lengths begin, by adding up one after the other."""
    none = F.array().cast("array<int>")
    return F.aggregate(
        lengths,
        F.struct(first.alias("at"), none.alias("out")),
        lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
        ),
        lambda acc: acc["out"],
    )


def running_starts(lengths: Column) -> Column:
    """Where runs of these lengths begin, in two levels."""

    def of_runs(runs: Column) -> Column:
        totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda a, n: a + n))
        return _let(
            _starts(totals, F.lit(0)),
            lambda first: F.flatten(F.transform(runs, lambda run, i: _starts(run, F.get(first, i)))),
        )

    return _blocks(lengths, lambda runs: _let(runs, of_runs))


def format_chats(turned: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` and ``loss``, the ranges of it that the loss counts.

    A range has the start (from 0) and length in code points of the escaped text of a
    turn whose role is in ``trained``. No turns and null turns give an empty string and
    no range. All rows and columns stay; columns called ``formatted`` or ``loss`` are
    replaced.
    """
    # Names that no column has.
    marked, starts = (f"{name}_" + "_".join(turned.columns) for name in ("marked", "starts"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"),
            escape(t["text"]).alias("body"),
            t["role"].isin(list(trained)).alias("loss"),
        ),
    )
    kept = [name for name in turned.columns if name not in ("formatted", "loss")]
    none = F.array().cast("array<struct<head:string,body:string,loss:boolean>>")
    out = turned.select(*kept, F.coalesce(parts, none).alias(marked))
    lengths = F.transform(
        marked, lambda m: F.length(m["head"]) + F.length(m["body"]) + F.lit(len(END))
    )
    out = out.select("*", _let(lengths, running_starts).alias(starts))
    formatted = F.array_join(
        F.transform(marked, lambda m: F.concat(m["head"], m["body"], F.lit(END))), ""
    )
    spans = F.zip_with(
        marked,
        starts,
        lambda m, at: F.when(
            m["loss"],
            F.struct(
                (at + F.length(m["head"])).alias("start"), F.length(m["body"]).alias("length")
            ),
        ),
    )
    return out.select(
        *kept, formatted.alias("formatted"), F.filter(spans, F.isnotnull).alias("loss")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string; none of an empty one, null of null."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")

    def turn(piece: Column) -> Column:
        return _let(
            F.split(piece, r"<\|text\|>"),
            lambda parts: F.struct(
                unescape(F.substring(F.get(parts, F.lit(0)), len(TURN) + 1, 1 << 30)).alias("role"),
                unescape(F.get(parts, F.lit(1))).alias("text"),
            ),
        )

    return F.transform(pieces, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask, whose ranges are in order."""

    def of_run(whole: Column, run: Column) -> Column:
        first, last = F.get(run, F.lit(0))["start"], F.element_at(run, -1)
        piece = F.substring(whole, first + 1, last["start"] + last["length"] - first)
        return _let(
            piece,
            lambda text: F.array_join(
                F.transform(
                    run, lambda s: unescape(F.substring(text, s["start"] - first + 1, s["length"]))
                ),
                "",
            ),
        )

    def of_runs(whole: Column) -> Column:
        return _blocks(
            loss,
            lambda runs: F.array_join(F.transform(runs, lambda run: of_run(whole, run)), ""),
        )

    return _let(formatted, of_runs)


def digests(chats: DataFrame, key: str) -> DataFrame:
    """What is read back from ``key, formatted, loss`` of each row, as counts and digests.

    Repeated rows and null keys are like any others; other columns are not read. An empty
    table gives no rows.
    """
    chats = chats.select(key, "formatted", "loss", read_turns(F.col("formatted")).alias("read_turns"))
    turns = F.col("read_turns")
    lines = F.transform(
        turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    out = chats.select(
        key,
        "formatted",
        F.size(turns).cast("long").alias("n_turns"),
        F.array_join(lines, "").alias("lines"),
        loss_text(F.col("formatted"), F.col("loss")).alias("masked"),
    )
    return out.select(
        key,
        "n_turns",
        F.sha2("lines", 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
