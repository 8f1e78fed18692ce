"""Chat formatting: heterogeneous layouts to canonical turns, a reversible template, and a loss mask.

Fingerprints. The nested field paths of a record, with types ("messages[].role:string"), are sorted and hashed. The
fingerprint selects a declarative mapping (:data:`MAPPINGS`). A table with typed columns has one fingerprint, that of
its schema. A column of JSON strings has one per record: only this hash runs in Python, the mapping itself is applied
by Spark's JSON reader. Records whose fingerprint no mapping has are returned as rejects with it.

Template. A turn is

    ### ROLE:
    TEXT
    </turn>

with a line break at its end. Backslash, # and < in role and text are written as \\\\, \\h and \\l, a colon in a role as \\c, so
no control string can stand inside a text, and the way back is exact. The loss mask covers the texts of assistants.

Formatted conversations are rows of one turn each, in order: a conversation is the concatenation of its pieces, and
none has to fit into one cell. The digests read the sorted pieces as a stream.

Cases: null text is empty; null role is empty; null conversation ids are one conversation; null turn numbers come
first; turns with equal numbers are ordered by role and text; repeated rows are turns of their own; an empty table gives
an empty result; columns beyond those of a mapping make another fingerprint, so they are chosen with ``columns``.
"""

import hashlib
import json
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSISTANT = "assistant"
#: Names that layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Each:
    """Turns from an array of structs."""

    path: str
    role: str
    text: str


@dataclass(frozen=True)
class One:
    """One turn from text fields; those that are not empty are joined by line breaks, and no turn is made if all are."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Rows:
    """Every row is a turn."""

    record: str
    order: str
    role: str
    text: str


@dataclass(frozen=True)
class Mapping:
    """Columns as Spark DDL, by name; optional ones may be absent."""

    name: str
    columns: dict[str, str] = field(hash=False)
    steps: tuple
    optional: tuple[str, ...] = ()

    def variants(self) -> list[dict[str, str]]:
        out = [{}]
        for name, kind in self.columns.items():
            more = [o | {name: kind} for o in out]
            out = more + out if name in self.optional else more
        return out


MAPPINGS = (
    Mapping("turn rows", {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}, (Rows("conv_id", "turn", "role", "text"),)),
    Mapping("messages", {"messages": "array<struct<role:string,content:string>>"}, (Each("messages", "role", "content"),)),
    Mapping("conversations", {"conversations": "array<struct<from:string,value:string>>"}, (Each("conversations", "from", "value"),)),
    Mapping("system and messages", {"system": "string", "messages": "array<struct<role:string,content:string>>"}, (One("system", ("system",)), Each("messages", "role", "content"))),
    Mapping(
        "instruction", {"system": "string", "instruction": "string", "input": "string", "output": "string"},
        (One("system", ("system",)), One("user", ("instruction", "input")), One("assistant", ("output",))), optional=("system", "input"),
    ),
    Mapping("prompt and completion", {"prompt": "string", "completion": "string"}, (One("user", ("prompt",)), One("assistant", ("completion",)))),
    Mapping("prompt and response", {"prompt": "string", "response": "string"}, (One("user", ("prompt",)), One("assistant", ("response",)))),
    Mapping("question and answer", {"context": "string", "question": "string", "answer": "string"}, (One("user", ("context", "question")), One("assistant", ("answer",))), optional=("context",)),
)


# --- fingerprints ------------------------------------------------------------------------------


def paths_of_type(kind: T.DataType, at: str) -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of_type(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of_type(kind.elementType, f"{at}[]")
    return [f"{at}:{kind.simpleString()}"]


def paths_of_value(value, at: str) -> set[str]:
    """Paths of a JSON value; null has no type of its own and counts as text."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths_of_value(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths_of_value(v, f"{at}[]")}
    kind = "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
    return {f"{at}:{kind}"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "replace")).hexdigest()[:16]


def schema_fingerprint(schema: T.StructType) -> str:
    return fingerprint(paths_of_type(schema, ""))


def known_fingerprints(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, tuple[Mapping, dict[str, str]]]:
    """Fingerprint -> mapping and the columns that are present."""
    out = {}
    for m in mappings:
        for columns in m.variants():
            schema = T._parse_datatype_string(", ".join(f"`{n}` {k}" for n, k in columns.items()))
            out[schema_fingerprint(schema)] = (m, columns)
    return out


def json_fingerprint(payload: Column) -> Column:
    """Fingerprint of each JSON object; null for what is no object."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                value = json.loads(t)
            except (TypeError, ValueError, RecursionError):
                return None
            return fingerprint(paths_of_value(value, "")) if isinstance(value, dict) else None

        return texts.map(one)

    return run(payload)


# --- canonical turns ---------------------------------------------------------------------------


def _role(role: Column) -> Column:
    out = F.coalesce(role.cast("string"), F.lit(""))
    for name, canonical in ROLES.items():
        out = F.when(role == name, canonical).otherwise(out)
    return out


def _turns(mapping: Mapping, present: dict[str, str], column) -> Column:
    """Array of (role, text) by the steps of a mapping; ``column`` gives the column of a name."""
    parts = []
    for s in mapping.steps:
        if isinstance(s, Each):
            parts.append(F.coalesce(_each(column(s.path), s), F.array().cast("array<struct<role:string,text:string>>")))
        else:
            texts = [F.when(column(p) != "", column(p)) for p in s.paths if p in present]
            if texts:
                turn = F.array(F.struct(F.lit(s.role).alias("role"), F.concat_ws("\n", *texts).alias("text")))
                some = F.coalesce(*texts).isNotNull()
                parts.append(F.when(some, turn).otherwise(F.array().cast("array<struct<role:string,text:string>>")))
    return F.concat(*parts)


def _each(turns: Column, step: Each) -> Column:
    return F.transform(turns, lambda x: F.struct(_role(x[step.role]).alias("role"), F.coalesce(x[step.text], F.lit("")).alias("text")))


def canonical_turns(df: DataFrame, id_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """(conv_id, turn_no, role, text) from a table with typed columns, by the fingerprint of its schema.

    ``id_col`` names the record id, which is no part of the layout; a layout of turn rows has its own.
    """
    chosen = df.select(*(columns or [c for c in df.columns if c != id_col]))
    found = known_fingerprints().get(schema_fingerprint(chosen.schema))
    if found is None:
        raise ValueError(f"no mapping for the layout {sorted(paths_of_type(chosen.schema, ''))}")
    mapping, present = found
    if isinstance(mapping.steps[0], Rows):
        r = mapping.steps[0]
        by = Window.partitionBy("conv_id").orderBy(F.col("__turn").asc_nulls_first(), "role", "text")
        plain = chosen.select(
            F.col(r.record).alias("conv_id"), F.col(r.order).alias("__turn"), F.coalesce(r.role, F.lit("")).alias("role"), F.coalesce(r.text, F.lit("")).alias("text")
        )
        return plain.select("conv_id", (F.row_number().over(by) - 1).alias("turn_no"), "role", "text")
    record = df.select(F.col(id_col).alias("conv_id"), _turns(mapping, present, F.col).alias("t"))
    return record.select("conv_id", F.posexplode("t").alias("turn_no", "t")).select("conv_id", "turn_no", "t.role", "t.text")


def canonical_json(df: DataFrame, id_col: str, payload_col: str) -> tuple[DataFrame, DataFrame]:
    """Turns of records in JSON strings of any known layout, and the rejects (conv_id, fingerprint)."""
    marked = df.select(F.col(id_col).alias("conv_id"), F.col(payload_col).alias("payload")).withColumn("mark", json_fingerprint(F.col("payload")))
    turns, known = None, known_fingerprints()
    record_layouts = {k: v for k, v in known.items() if not isinstance(v[0].steps[0], Rows)}
    for mark, (mapping, present) in record_layouts.items():
        read = F.from_json("payload", ", ".join(f"`{n}` {k}" for n, k in present.items()))
        value = _json_turns(mapping, present, read)
        turns = F.when(F.col("mark") == mark, value) if turns is None else turns.when(F.col("mark") == mark, value)
    rejects = marked.filter(F.col("mark").isNull() | ~F.col("mark").isin(*record_layouts)).select("conv_id", F.col("mark").alias("fingerprint"))
    rows = marked.select("conv_id", F.posexplode(turns).alias("turn_no", "t")).select("conv_id", "turn_no", "t.role", "t.text")
    return rows, rejects


def _json_turns(mapping: Mapping, present: dict[str, str], read: Column) -> Column:
    # Bound once: the record is parsed once for all fields.
    return F.get(F.transform(F.array(read), lambda r: _turns(mapping, present, lambda name: r[name])), F.lit(0))


# --- template ----------------------------------------------------------------------------------


def _escape(text: Column, role: bool = False) -> Column:
    out = text
    for raw, code in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"), *([(":", "\\c")] if role else [])):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def _unescape(text: Column) -> Column:
    """Between double backslashes every backslash starts a code."""

    def codes(part: Column) -> Column:
        for raw, code in (("#", "\\h"), ("<", "\\l"), (":", "\\c")):
            part = F.replace(part, F.lit(code), F.lit(raw))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), codes), "\\")


_OPEN, _MIDDLE, _CLOSE = "### ", ":\n", "\n</turn>\n"


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn_no, piece, loss_first, loss_chars): the loss mask covers these code points of the piece."""
    role, text = _escape(F.col("role"), True), _escape(F.col("text"))
    head = F.concat(F.lit(_OPEN), role, F.lit(_MIDDLE))
    made = turns.select("conv_id", "turn_no", head.alias("head"), text.alias("body"), (F.col("role") == ASSISTANT).alias("learn"))
    return made.select(
        "conv_id", "turn_no", F.concat("head", "body", F.lit(_CLOSE)).alias("piece"), F.length("head").alias("loss_first"),
        F.when(F.col("learn"), F.length("body")).otherwise(0).alias("loss_chars"),
    )


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, turn_no, role, text, loss_text, n_chars) from formatted pieces alone; loss_text is null outside the mask."""
    start = F.instr("piece", _MIDDLE)
    role = F.substring("piece", len(_OPEN) + 1, start - len(_OPEN) - 1)
    body = F.substring("piece", start + len(_MIDDLE), F.length("piece") - start - len(_MIDDLE) - len(_CLOSE) + 1)
    under = F.substring("piece", F.col("loss_first") + 1, F.col("loss_chars"))
    return pieces.select(
        "conv_id", "turn_no", _unescape(role).alias("role"), _unescape(body).alias("text"),
        F.when(F.col("loss_chars") > 0, _unescape(under)).alias("loss_text"), F.length("piece").alias("n_chars"),
    )


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64()),
])


def digests(read: DataFrame) -> DataFrame:
    """Counts and hashes per conversation of :func:`read_back`, as a stream over turns in order."""

    def run(batches):
        now = None
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for conv, role, text, loss, chars in zip(*columns, strict=True):
                if now is None or now["conv_id"] != conv:
                    if now is not None:
                        out.append(close(now))
                    now = {"conv_id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                now["n"] += 1
                now["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss is not None:
                    now["loss"].update(loss.encode("utf-8", "surrogatepass"))
                    now["loss_chars"] += len(loss)
                now["chars"] += chars
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
        if now is not None:
            yield pa.RecordBatch.from_pylist([close(now)], schema=_DIGEST)

    def close(x):
        return {
            "conv_id": x["conv_id"], "n_turns": x["n"], "turns_sha256": x["turns"].hexdigest(), "loss_chars": x["loss_chars"],
            "loss_sha256": x["loss"].hexdigest(), "formatted_chars": x["chars"],
        }

    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    columns = ordered.select(F.col("conv_id").cast("bigint"), "role", "text", "loss_text", "n_chars")
    return columns.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
