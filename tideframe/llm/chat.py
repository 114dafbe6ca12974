"""Chat formatting: records of many layouts become turns, turns become marked text with a loss mask.

A layout is told by its nested field paths (`messages[].content`): a mapping declares the paths it reads, and a record or a
table follows the first mapping whose fingerprint, a hash of its paths, is that of the record's own paths among the mapping's.
Mappings are data; each is turned into columns once, for tables by their schema and for JSON records behind their fingerprint.

The template writes a turn as `### Mark: text</turn>` and a line end. Inside texts a backslash breaks up whatever could be
read as a mark, so texts come back as they were. All of this is done row by row: a turn is one row, and no conversation is
ever held whole, however long it is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import tidy

TURN = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Said:
    """One turn of a fixed role: the fields' texts that are there and not empty, parted by an empty line."""

    role: str
    fields: tuple[str, ...]
    optional: tuple[str, ...] = ()
    drop_empty: bool = False

    def paths(self) -> set[str]:
        return {*self.fields, *self.optional}


@dataclass(frozen=True)
class Listed:
    """Turns of a list. `text` may be a list of parts inside (`content[].text`), which are joined."""

    path: str
    role: str
    text: str
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        return {f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"}


@dataclass(frozen=True)
class Row:
    """A row is a turn already: its place, role and text."""

    turn: str
    role: str
    text: str
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        return {self.turn, self.role, self.text}


@dataclass(frozen=True)
class Mapping:
    """A layout's name, the parts its turns come from, in order, and roles that have another name here."""

    name: str
    parts: tuple[Said | Listed | Row, ...]
    roles: dict[str, str] = field(default_factory=dict)

    def vocabulary(self) -> frozenset[str]:
        return frozenset().union(*(p.paths() for p in self.parts))

    def prints(self) -> set[int]:
        """The fingerprints of all path sets that follow this mapping: with and without what is optional."""
        free = sorted({x for p in self.parts for x in p.optional})
        kept = self.vocabulary().difference(free)
        return {fingerprint(kept | set(some)) for n in range(len(free) + 1) for some in combinations(free, n)}


def fingerprint(paths: Iterable[str]) -> int:
    """A signed 64-bit hash of a set of field paths."""
    text = "\n".join(sorted(set(paths)))
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_SYSTEM = Said("system", (), ("system",), drop_empty=True)
LAYOUTS = (
    Mapping("turn rows", (Row("turn", "role", "text"),)),
    Mapping("messages", (_SYSTEM, Listed("messages", "role", "content"))),
    Mapping("messages of parts", (_SYSTEM, Listed("messages", "role", "content[].text"))),
    Mapping("conversations", (_SYSTEM, Listed("conversations", "from", "value")), {"human": "user", "gpt": "assistant"}),
    Mapping("instruction", (_SYSTEM, Said("user", ("instruction",), ("input",)), Said("assistant", ("output",)))),
    Mapping("prompt and response", (_SYSTEM, Said("user", ("prompt",)), Said("assistant", ("response",)))),
    Mapping("prompt and completion", (_SYSTEM, Said("user", ("prompt",)), Said("assistant", ("completion",)))),
    Mapping("question and answer", (_SYSTEM, Said("user", ("question",), ("context",)), Said("assistant", ("answer",)))),
)


def record_paths(value, at: str = "") -> Iterator[str]:
    """Field paths of a parsed JSON value down to what is neither object nor list."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from record_paths(inner, f"{at}.{key}" if at else key)
    elif isinstance(value, list):
        for inner in value:
            yield from record_paths(inner, f"{at}[]")
    elif at:
        yield at


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """The same of a table's type."""
    if isinstance(kind, T.StructType):
        for inner in kind.fields:
            yield from schema_paths(inner.dataType, f"{at}.{inner.name}" if at else inner.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    elif at:
        yield at


def layout_of(paths: Iterable[str], layouts: tuple[Mapping, ...] = LAYOUTS) -> int | None:
    """The number of the first mapping that paths follow."""
    return _layout_of(frozenset(paths), tuple((m.vocabulary(), frozenset(m.prints())) for m in layouts))


@lru_cache(maxsize=4096)
def _layout_of(paths: frozenset[str], known: tuple) -> int | None:
    return next((i for i, (words, prints) in enumerate(known) if fingerprint(paths & words) in prints), None)


def _named(role: Column, names: dict[str, str]) -> Column:
    out = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in names.items():
        out = F.when(role == old, new).otherwise(out)
    return out


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _listed(part: Listed, turns: Column, roles: dict[str, str]) -> Column:
    """The turns of a list's elements."""
    text, _, inside = part.text.partition("[].")

    def turn(m: Column) -> Column:
        said = F.array_join(F.transform(m[text], lambda p: _text(p[inside])), "") if inside else m[text]
        return F.struct(_named(m[part.role], roles).alias("role"), _text(said).alias("text"))

    return F.transform(turns, turn)


def _turns(mapping: Mapping, get, has) -> Column:
    """The turns of a record as an array, with get(field) its columns and has(field) whether it is declared there."""
    out = []
    for part in mapping.parts:
        if isinstance(part, Listed):
            out.append(F.coalesce(_listed(part, get(part.path), mapping.roles), F.array().cast(TURN)))
        else:
            texts = [get(x) for x in (*part.fields, *part.optional) if has(x)]
            if texts:
                said = F.concat_ws("\n\n", *[F.when(_text(x) != "", _text(x)) for x in texts])
                one = F.array(F.struct(F.lit(part.role).alias("role"), said.alias("text")))
                out.append(F.when(said != "", one).otherwise(F.array().cast(TURN)) if part.drop_empty else one)
    return F.concat(*out)


def _record_type(mapping: Mapping) -> T.StructType:
    """The type by which a mapping's JSON records are parsed."""
    out = T.StructType()
    for part in mapping.parts:
        if isinstance(part, Listed):
            text, _, inside = part.text.partition("[].")
            said = T.ArrayType(T.StructType([T.StructField(inside, T.StringType())])) if inside else T.StringType()
            out = out.add(part.path, T.ArrayType(T.StructType([T.StructField(part.role, T.StringType()), T.StructField(text, said)])))
        else:
            for x in part.paths():
                out = out.add(x, T.StringType())
    return out


def turns_of_table(table: DataFrame, key: str = "conv_id", layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """The turns of a typed table: key, turn, role, text. The table's schema tells its layout.

    Null roles and texts are empty; a row of a layout of one row a conversation gives its turns numbers from 0. Columns that
    no mapping knows are not read. Raises ValueError where no mapping fits.
    """
    found = layout_of(schema_paths(table.schema), layouts)
    if found is None:
        raise ValueError(f"no mapping for a table of {sorted(schema_paths(table.schema))}")
    mapping = layouts[found]
    head = mapping.parts[0]
    if isinstance(head, Row):
        return table.select(F.col(f"`{key}`").alias(key), F.col(head.turn).cast("long").alias("turn"), _named(F.col(head.role), mapping.roles).alias("role"), _text(F.col(head.text)).alias("text"))
    turns = _turns(mapping, lambda x: F.col(f"`{x}`"), lambda x: x in table.columns)
    return _exploded(table.select(F.col(f"`{key}`").alias(key), turns.alias("_turns")), key)


def _exploded(rows: DataFrame, key: str) -> DataFrame:
    said = rows.select(key, F.posexplode("_turns").alias("turn", "_said"))
    return said.select(key, F.col("turn").cast("long").alias("turn"), "_said.role", "_said.text")


def with_layouts(records: DataFrame, column: str, layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """JSON records with `layout`, the name of the mapping that each follows; null where none fits or JSON cannot be read."""

    @F.pandas_udf("string")
    def told(lines: pd.Series) -> pd.Series:
        def one(line: str | None) -> str | None:
            try:
                found = layout_of(record_paths(json.loads(line)), layouts) if line else None
            except (ValueError, RecursionError):
                return None
            return None if found is None else layouts[found].name

        return lines.map(one)

    return records.withColumn("layout", told(F.col(column)))


def turns_of_json(records: DataFrame, column: str, key: str = "conv_id", layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """The turns of a column of JSON records: key, turn, role, text; each record's own field paths tell its layout.

    Null roles and texts are empty, numbers are written as text. A record that no mapping fits has no turns here:
    with_layouts tells which these are. A layout of one row a turn takes its number from the record.
    """
    rows = with_layouts(records.select(F.col(f"`{key}`").alias(key), F.col(f"`{column}`").alias("_record")), "_record", layouts)
    made, numbered = F.lit(None).cast(TURN), F.lit(None).cast("long")
    for mapping in layouts:
        head, fits = mapping.parts[0], F.col("layout") == mapping.name
        if isinstance(head, Row):
            got = F.from_json("_record", T.StructType([T.StructField(head.turn, T.LongType()), T.StructField(head.role, T.StringType()), T.StructField(head.text, T.StringType())]))
            turns = F.array(F.struct(_named(got[head.role], mapping.roles).alias("role"), _text(got[head.text]).alias("text")))
            numbered = F.when(fits, got[head.turn]).otherwise(numbered)
        else:
            got = F.from_json("_record", _record_type(mapping))
            turns = _turns(mapping, lambda x, got=got: got[x], lambda x: True)
        made = F.when(fits, turns).otherwise(made)
    said = rows.select(key, numbered.alias("_number"), F.posexplode(made).alias("turn", "_said"))
    return said.select(key, F.coalesce("_number", F.col("turn").cast("long")).alias("turn"), "_said.role", "_said.text")


OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
MARKS = {"system": "System", "user": "User", "assistant": "Assistant"}
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """A text in which neither three signs `#` follow each other nor `</` stands."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("##"), F.lit("#\\#")), F.lit("</"), F.lit("<\\/"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """turns (role, text and any others) with formatted, loss_start and loss_end: the span of formatted, in code points from
    0, that is learned from; null where the turn is not the assistant's.

    Null roles and texts count as empty. A role other than system, user and assistant is marked by `=` and its URL form.
    A column of turns with one of the three names gives way. Texts are read whole; order and number of rows do not change.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.concat(F.lit("="), F.url_encode(role))
    for name, written in MARKS.items():
        mark = F.when(role == name, written).otherwise(mark)
    head = F.concat(F.lit(OPEN), mark, F.lit(COLON))
    start = F.when(role == LEARNED, F.length(head))
    out = turns.withColumns({"formatted": F.concat(head, escaped(text), F.lit(CLOSE)), "loss_start": start})
    return out.withColumn("loss_end", F.when(F.col("loss_start").isNotNull(), F.length("formatted") - len(CLOSE)))


def read_back(formatted: Column) -> Column:
    """(role, text) of one formatted turn."""
    colon = F.locate(COLON, formatted)
    mark = F.substring(formatted, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1)
    role = F.url_decode(F.substring(mark, F.lit(2), F.length(mark)))
    for name, written in MARKS.items():
        role = F.when(mark == written, name).otherwise(role)
    text = F.substring(formatted, colon + len(COLON), F.length(formatted) - colon - (len(COLON) - 1) - len(CLOSE))
    return F.struct(role.alias("role"), unescaped(text).alias("text"))


def read_text(text: Column) -> Column:
    """The turns of a text of formatted turns, one after the other."""
    pieces = F.filter(F.split(text, CLOSE), lambda x: x != "")
    return F.transform(pieces, lambda x: read_back(F.concat(x, F.lit(CLOSE))))


def in_order(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """The turns in order of conversations and turns, for writing: ranges of (key, turn), so that a very long conversation is
    spread over files as well."""
    order = [key, "turn", "role", "text"]
    return formatted.repartitionByRange(*order).sortWithinPartitions(*order)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of conversations that follow each other in order; one running hash is held, not a conversation."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    done: list[tuple] = []
    started, current, n, chars, learned = False, None, 0, 0, 0
    said, loss = hashlib.sha256(), hashlib.sha256()

    def batch() -> pa.RecordBatch:
        rows = list(zip(*done, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done.clear()
        return pa.record_batch([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)

    for found in batches:
        columns = (found.column(x).to_pylist() for x in ("conv_id", "role", "text", "loss", "formatted_chars"))
        for conv, role, text, lost, size in zip(*columns, strict=True):
            if started and conv != current:
                done.append((current, n, said.hexdigest(), learned, loss.hexdigest(), chars))
                n, chars, learned, said, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                if len(done) >= 10_000:
                    yield batch()
            started, current, n, chars = True, conv, n + 1, chars + size
            said.update(f"{role}\n{text}\n".encode())
            if lost is not None:
                learned += len(lost)
                loss.update(lost.encode())
    if started:
        done.append((current, n, said.hexdigest(), learned, loss.hexdigest(), chars))
        yield batch()


def digest(formatted: DataFrame) -> DataFrame:
    """What format_turns wrote of each conv_id, read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns go by turn, equal ones by role and text, null first; rows without conv_id are one conversation. SHA-256 is a chain
    over the turns in order, so one task reads a conversation's turns; it streams them and holds one turn at a time.
    """
    back = read_back(F.col("formatted"))
    masked = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    rows = formatted.select("conv_id", "turn", back.alias("_back"), F.when(F.col("loss_start").isNotNull(), unescaped(masked)).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    rows = rows.select("conv_id", "turn", "_back.role", "_back.text", "loss", "formatted_chars")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(tidy(_digests), DIGESTS)


#: A conversation that holds the template's own marks, beside the table's.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"

#: The digests in DuckDB's SQL over `conversations` and that conversation.
ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
marked AS (SELECT *, '### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '=' || url_encode(role) END
  || ': ' || replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</', '<\/') || '</turn>' || chr(10) AS formatted FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
