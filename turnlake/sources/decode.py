"""From transcript records to turns, as column expressions: 0 to 3 turns a record, one for each tier it has text in.

Top-level fields come from ``get_json_object``, which takes the first of duplicate keys; message contents, which may be a
string or a list of blocks, from a VARIANT, whose type can be asked. Both providers give the columns of ``schema.TURN``
with path and off, by which the archive orders records.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..plans.errors import UsageError
from .transcripts import THREAD, plausible

# Identifying arguments of a tool call, most common first, and the longest argument shown otherwise.
IDENTIFYING = ("command", "file_path", "url", "query", "pattern", "path", "notebook_path", "skill", "subagent_type")
LONGEST_ARGUMENT = 256

# Record and payload types of the second provider.
CODEX_TURNS = ("message", "function_call", "function_call_output")
CODEX_SILENT = ("turn_context", "world_state", "security_risk_score", "inter_agent_communication", "inter_agent_communication_metadata")
CODEX_SILENT_PAYLOADS = ("reasoning",)


def field(raw: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(raw, f"$.{path}"), F.lit(""))


def lenient_bool(raw: Column, path: str) -> Column:
    """true, a number other than zero, or one of the words for true."""
    v = F.lower(F.trim(field(raw, path)))
    return v.isin("true", "1", "t") | (F.rlike(v, F.lit(r"^-?[0-9.]+$")) & (F.coalesce(F.try_to_number(v, F.lit("S999999999999D999999")), F.lit(0)) != 0)) | (F.rlike(v, F.lit(r"^-?[0-9]+$")) & ~F.rlike(v, F.lit(r"^-?0+$")))


def text_at(v: Column, path: str) -> Column:
    """A scalar of a variant as text; empty for what isn't there or isn't a scalar."""
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def is_list(v: Column, path: str) -> Column:
    return F.startswith(F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("")), F.lit("ARRAY"))


def is_nested(v: Column) -> Column:
    kind = F.coalesce(F.schema_of_variant(v), F.lit(""))
    return F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT"))


def some(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def short_arguments(given: Column) -> Column:
    """Short scalar arguments as sorted k=v, after a space."""
    entries = F.map_entries(F.coalesce(F.try_variant_get(given, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    shown = F.transform(F.filter(entries, lambda e: ~is_nested(e["value"])), lambda e: F.struct(e["key"].alias("k"), text_at(e["value"], "$").alias("v")))
    kept = F.filter(shown, lambda e: (e["v"] != "") & (F.octet_length(e["v"]) <= LONGEST_ARGUMENT))
    joined = F.array_join(F.array_sort(F.transform(kept, lambda e: F.concat(e["k"], F.lit("="), e["v"]))), " ")
    return F.when(joined != "", F.concat(F.lit(" "), joined)).otherwise("")


def invocation(block: Column) -> Column:
    argument = some(*[text_at(block, f"$.input.{k}") for k in IDENTIFYING])
    return F.concat(text_at(block, "$.name"), F.when(argument != "", F.concat(F.lit(" "), argument)).otherwise(short_arguments(F.try_variant_get(block, "$.input", "variant"))))


def result_texts(block: Column) -> Column:
    """Texts of a tool result: its content, or the text blocks of it."""
    inner = F.coalesce(F.try_variant_get(block, "$.content", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(F.filter(inner, lambda b: text_at(b, "$.type") == "text"), lambda b: text_at(b, "$.text"))
    return F.when(is_list(block, "$.content"), texts).otherwise(F.array(text_at(block, "$.content")))


def parts(message: Column) -> Column:
    """(conversation, invocation, result): the texts of a message's content."""
    listed = is_list(message, "$.content")
    blocks = F.coalesce(F.try_variant_get(message, "$.content", "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda b: text_at(b, "$.type")
    nonempty = lambda a: F.filter(a, lambda x: x != "")
    talk = F.transform(F.filter(blocks, lambda b: kind(b).isin("text", "thinking")), lambda b: F.when(kind(b) == "text", text_at(b, "$.text")).otherwise(text_at(b, "$.thinking")))
    calls = F.transform(F.filter(blocks, lambda b: kind(b) == "tool_use"), invocation)
    results = F.flatten(F.transform(F.filter(blocks, lambda b: kind(b) == "tool_result"), result_texts))
    none = F.array().cast("array<string>")
    return F.struct(
        nonempty(F.when(listed, talk).otherwise(F.array(text_at(message, "$.content")))).alias("conversation"),
        F.when(listed, calls).otherwise(none).alias("invocation"),
        F.when(listed, nonempty(results)).otherwise(none).alias("result"),
    )


def tag_body(text: Column, tag: str) -> Column:
    return F.trim(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def command_line(text: Column) -> Column:
    """The line typed at a slash command; empty for none."""
    name, arguments = tag_body(text, "command-name"), tag_body(text, "command-args")
    return F.when(arguments == "", "").when(name != "", F.concat(name, F.lit(" "), arguments)).otherwise(arguments)


def _exploded(df: DataFrame, texts: list[tuple[str, Column]]) -> DataFrame:
    """A row for each tier that has text, numbered in order."""
    each = F.filter(F.array(*[F.struct(F.lit(t).alias("tier"), c.alias("text")) for t, c in texts]), lambda x: x["text"] != "")
    return df.select("*", F.posexplode(each).alias("seq", "t")).withColumn("tier", F.col("t.tier")).withColumn("text", F.col("t.text")).drop("t")


def claude_turns(read: DataFrame, origin: str = "claude-code") -> DataFrame:
    """Turns of the first provider's lines (path, off, raw)."""
    raw = F.col("raw")
    head = read.where(plausible(raw)).select("path", "off", F.try_parse_json(raw).alias("v"), *[field(raw, p).alias(n) for n, p in (("type", "type"), ("uuid", "uuid"), ("ts", "timestamp"), ("cwd0", "cwd"), ("cwd1", "relocatedCwd"), ("branch", "gitBranch"), ("agent", "agentId"), ("prompt", "promptSource"), ("role0", "message.role"), ("s0", "sessionId"), ("s1", "session_id"))], lenient_bool(raw, "isSidechain").alias("side"))
    role = F.when(F.col("type").isin("user", "assistant"), F.col("type")).when(F.col("type").isin(*S.KNOWN_TYPES), "").when(F.col("role0").isin("user", "assistant"), F.col("role0")).otherwise("")
    rows = head.withColumn("role", role).where("role <> ''").withColumn("p", parts(F.try_variant_get("v", "$.message", "variant")))
    rows = rows.withColumn("talk", F.array_join("p.conversation", "\n\n"))
    author = F.when(F.col("side"), "agent").when(F.col("role") == "assistant", "assistant").when(F.col("prompt") == "typed", "human").otherwise("system")
    rows = rows.withColumn("author", author).withColumn("typed", F.when(F.col("author") == "system", command_line(F.col("talk"))).otherwise(""))
    rows = rows.withColumn("talk", F.when(F.col("typed") != "", F.col("typed")).when((F.col("author") == "system") & F.contains("talk", F.lit("<command-args>")), "").otherwise(F.col("talk")))
    rows = rows.withColumn("author", F.when(F.col("typed") != "", "human").otherwise(F.col("author")))
    out = _exploded(rows, [("conversation", F.col("talk")), ("invocation", F.array_join("p.invocation", "\n")), ("result", F.array_join("p.result", "\n"))])
    return _shaped(out.withColumn("session", some(F.col("s0"), F.col("s1"))).withColumn("cwd", some(F.col("cwd0"), F.col("cwd1"))), origin)


def codex_turns(read: DataFrame, origin: str = "codex") -> DataFrame:
    """Turns of the second provider's lines; identity comes from the latest session_meta before a record in its file."""
    raw = F.col("raw")
    head = read.where(plausible(raw)).select("path", "off", "raw", F.try_parse_json(raw).alias("v"), field(raw, "timestamp").alias("ts"), field(raw, "type").alias("type")).where("type <> ''")
    before = Window.partitionBy("path").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    meta = lambda p: F.last(F.when(F.col("type") == "session_meta", F.nullif(text_at(F.col("v"), p), F.lit(""))), ignorenulls=True).over(before)
    rows = head.withColumn("id", meta("$.payload.id")).withColumn("cwd", F.coalesce(meta("$.payload.cwd"), F.lit(""))).withColumn("branch", F.coalesce(meta("$.payload.git.branch"), F.lit(""))).withColumn("agent", F.coalesce(meta("$.payload.agent_nickname"), F.lit("")))
    v, kind = F.col("v"), F.col("kind")
    rows = rows.withColumn("kind", F.when(F.col("type") == "response_item", text_at(v, "$.payload.type")).when(F.col("type") == "compacted", "compacted").otherwise("")).where(kind.isin("message", "function_call", "function_call_output", "compacted"))
    blocks = F.coalesce(F.try_variant_get(v, "$.payload.content", "array<variant>"), F.array().cast("array<variant>"))
    message = F.array_join(F.filter(F.transform(blocks, lambda b: text_at(b, "$.text")), lambda x: x != ""), "\n\n")
    call = F.trim(F.concat_ws(" ", text_at(v, "$.payload.name"), text_at(v, "$.payload.call_id")))
    role = text_at(v, "$.payload.role")
    author = F.when(F.col("agent") != "", "agent").when((kind == "message") & (role == "user"), "human").when(((kind == "message") & (role == "assistant")) | (kind == "function_call"), "assistant").otherwise("system")
    text = lambda k, c: F.when(kind == k, c).otherwise("")
    talk = F.when(kind == "message", message).when(kind == "compacted", text_at(v, "$.payload.message")).otherwise("")
    out = rows.withColumn("author", author).withColumn("uuid", F.concat(F.col("off").cast("string"), F.lit("-"), F.lower(F.hex(F.xxhash64("raw"))))).withColumn("session", F.coalesce("id", F.regexp_extract("path", THREAD, 1)))
    return _shaped(_exploded(out, [("conversation", talk), ("invocation", text("function_call", call)), ("result", text("function_call_output", text_at(v, "$.payload.output")))]), origin)


def _shaped(rows: DataFrame, origin: str) -> DataFrame:
    return rows.withColumn("origin", F.lit(origin)).withColumn("repo", F.lit("")).select(*S.TURN_COLUMNS, "path", "off")


def observed(read: DataFrame) -> DataFrame:
    """One row: lines, malformed lines, records without a type, records of people outside of agents' branches, those of
    them that were typed, and records that carry command arguments."""
    raw = F.col("raw")
    ok = plausible(raw)
    main = ok & (field(raw, "type") == "user") & ~lenient_bool(raw, "isSidechain")
    talk = F.get_json_object(raw, "$.message.content")
    shaped = main & F.coalesce(talk != "", F.lit(False)) & ~F.contains(talk, F.lit('"tool_result"')) & ~F.startswith(F.ltrim(talk), F.lit("<"))
    count = lambda c, n: F.count_if(c).alias(n)
    return read.agg(F.count("*").alias("lines"), count(~ok, "malformed"), count(ok & (field(raw, "type") == ""), "untyped"), count(shaped, "human_shaped"), count(main & (field(raw, "promptSource") == "typed"), "typed"), count(F.contains(raw, F.lit("<command-args>")), "command_args"))


def unknown_types(read: DataFrame) -> DataFrame:
    """(type, n) of record types that aren't known; none is dropped silently."""
    kind = field(F.col("raw"), "type")
    return read.where(plausible(F.col("raw"))).select(kind.alias("type")).where((F.col("type") != "") & ~F.col("type").isin(*S.KNOWN_TYPES)).groupBy("type").agg(F.count("*").alias("n"))


def codex_kinds(read: DataFrame) -> DataFrame:
    """(type, payload, n, fate) of the second provider's records by envelope and payload: identity, turn, telemetry (the
    event stream, which says again what records say), silent (nothing to read) or unknown."""
    raw = F.col("raw")
    kinds = read.where(plausible(raw)).select(field(raw, "type").alias("type"), F.when(field(raw, "type") == "response_item", field(raw, "payload.type")).otherwise("").alias("payload"))
    t, p = F.col("type"), F.col("payload")
    fate = F.when(t == "session_meta", "identity").when((t == "compacted") | ((t == "response_item") & p.isin(*CODEX_TURNS)), "turn").when(t == "event_msg", "telemetry").when(t.isin(*CODEX_SILENT) | ((t == "response_item") & p.isin(*CODEX_SILENT_PAYLOADS)), "silent").otherwise("unknown")
    return kinds.groupBy("type", "payload").agg(F.count("*").alias("n")).withColumn("fate", fate)


def codex_observed(read: DataFrame) -> DataFrame:
    """One row: lines, malformed and untyped ones, telemetry dropped, turns that a summary replaced."""
    raw = F.col("raw")
    ok = plausible(raw)
    replaced = F.when(field(raw, "type") == "compacted", F.coalesce(F.json_array_length(F.get_json_object(raw, "$.payload.replacement_history")), F.lit(0))).otherwise(0)
    return read.agg(F.count("*").alias("lines"), F.count_if(~ok).alias("malformed"), F.count_if(ok & (field(raw, "type") == "")).alias("untyped"), F.count_if(field(raw, "type") == "event_msg").alias("telemetry"), F.coalesce(F.sum(replaced), F.lit(0)).cast("long").alias("replaced"))


def codex_unknown(read: DataFrame) -> DataFrame:
    """(type, n) of envelopes and payloads that aren't known."""
    name = F.when(F.col("payload") != "", F.concat_ws("/", "type", "payload")).otherwise(F.col("type"))
    return codex_kinds(read).where("fate = 'unknown' AND type <> ''").select(name.alias("type"), "n")


#: Decoders by the name of their store, and what each counts of records it read.
PROVIDERS = {"claude-code": claude_turns, "codex": codex_turns}
OBSERVERS = {"claude-code": lambda read: {"counts": observed(read), "unknown": unknown_types(read)}, "codex": lambda read: {"counts": codex_observed(read), "unknown": codex_unknown(read)}}

# Environment variables by which an agent is detected.
AGENT_MARKS = (("CODEX_THREAD_ID", "codex"), ("CODEX_SESSION_ID", "codex"), ("GEMINI_CLI", "gemini"), ("CURSOR_AGENT", "cursor"))


@dataclass(frozen=True)
class Selection:
    """Which stores a question reads, and why."""

    agents: tuple[str, ...]
    reason: str
    fell_back: bool = False


def select_agents(wanted: str = "", environ: Mapping[str, str] | None = None, readable: Callable[[str], bool] = lambda _: True) -> Selection:
    """The agents named, else those of the environment (TURNLAKE_AGENT), else the one that is asking, else the default.

    ``all`` is every store that can be read. An agent that was asked for by name must be known; one that was only
    detected gives way to the default where it isn't known or can't be read.
    """
    environ = os.environ if environ is None else environ
    name = wanted or environ.get("TURNLAKE_AGENT", "")
    default = next(iter(PROVIDERS))
    if name == "all":
        return Selection(tuple(a for a in PROVIDERS if readable(a)), "all were asked for")
    if name and name != "auto":
        if name not in PROVIDERS:
            raise UsageError(f"unknown agent {name!r}; known are {', '.join(PROVIDERS)}")
        return Selection((name,), f"{name} was asked for")
    found = next((agent for mark, agent in AGENT_MARKS if environ.get(mark)), "")
    if not found:
        return Selection((default,), "no other agent was detected")
    if found not in PROVIDERS:
        return Selection((default,), f"{found} was detected but isn't known; {default} instead", True)
    if not readable(found):
        return Selection((default,), f"{found} was detected but can't be read; {default} instead", True)
    return Selection((found,), f"{found} was detected")
