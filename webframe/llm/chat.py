"""Tool-call linking for chats, in built-in functions alone.

Messages are calls, results and others. A call has an identifier, a tool's name and arguments in JSON; a result names the
identifier of its call. Identifiers are the strings in ``call_key``, or where messages have no such column the numbers in
``call_turn``. Each side is counted by its different texts, and reduced to one row per (conversation, identifier) for the
other side to meet in a hash join: so every call and result stays, and no join multiplies rows even if a key is repeated
by a third of all of them.

The linked rows are put in topological order by their depth in the graph of dependencies. A result depends on its call,
with which it is one row. A call depends on the call that ``after_key`` names, where messages have that column and it
isn't null; all else depends on the message of the turn before it. Without ``after_key`` depths follow from global row
numbers in the order of (conversation, turn), as a run of turns is an island of equal differences; with it they are found
by pointer doubling in about log2(depth) joins on unique keys. Arguments are validated against the tool's schema, which
may nest objects, arrays and enumerations, and every row is serialised as canonical JSON: no spaces, keys in order at
every level. A conversation is never gathered into one task: rows are its links, ordered by (conv_id, depth, turn).

Defined results: results without a call are rows of status ``orphan_result``, calls without a result ``unanswered``;
of several different calls or results for one identifier each is a row, first the calls with the least result, then the
other results with the least call; n_calls and n_results tell how many messages had the row's call and its result;
calls and results whose identifier is null link to nothing;
messages of other roles, and those with a null conversation or turn, are rows of status ``message``, repeated rows each;
a row without a turn has depth 0, and one whose dependencies run in a circle, or lead to one, has a null depth;
an ``after_key`` without such a call is as if it were null;
arguments that are no JSON, lack a required field, have one of the wrong type or one that the schema doesn't know are
invalid, and so are those of tools without a schema; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.llm.sharding import number_rows
from webframe.session import cut

#: tool -> schema of its arguments, see :func:`fits`
SCHEMAS = {
    "reply": {
        "type": "object",
        "properties": {
            "about": {"type": "object", "properties": {"conv": {"type": "integer"}, "turn": {"type": "integer", "minimum": 0}}, "required": ["conv", "turn"]},
            "lines": {"type": "array", "items": {"type": "string"}, "minItems": 1, "maxItems": 3},
            "n_chars": {"type": "integer"},
            "size": {"enum": ["short", "long"]},
        },
        "required": ["about", "lines", "n_chars", "size"],
    }
}
_KINDS = {"string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": r"BIGINT|DOUBLE|FLOAT|DECIMAL\(.*", "boolean": "BOOLEAN", "null": "VOID", "object": "OBJECT<.*", "array": "ARRAY<.*"}


def canonical(text: Column) -> Column:
    """Compact JSON with sorted keys; null if the text is no JSON."""
    return F.to_json(F.try_parse_json(text))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fits(value: Column, schema: dict) -> Column:
    """Whether a variant is there and fits a schema of ``type`` (or several), ``enum``, ``minLength``, ``maxLength``,
    ``minimum``, ``maximum``, ``items``, ``minItems``, ``maxItems``, ``properties``, ``required`` and
    ``additionalProperties`` (false unless given)."""
    return F.coalesce(value.isNotNull() & _let(value, lambda v: _fits(v, schema)), F.lit(False))


def _fits(v: Column, schema: dict) -> Column:
    tests = []
    if "enum" in schema:
        tests.append(F.to_json(v).isin([json.dumps(x, separators=(",", ":"), ensure_ascii=False, sort_keys=True) for x in schema["enum"]]))
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
    if types:
        tests.append(F.schema_of_variant(v).rlike("(?s)^(" + "|".join(_KINDS[t] for t in types) + ")$"))
    for name, of, size in (("Length", "string", F.length(F.try_variant_get(v, "$", "string"))), ("Items", "array<variant>", F.size(F.try_variant_get(v, "$", "array<variant>"))), ("imum", "double", F.try_variant_get(v, "$", "double"))):
        # a bound says nothing of values of another type, which have no size
        own = F.schema_of_variant(v).rlike("^" + {"string": "STRING$", "array<variant>": "ARRAY<", "double": "BIGINT|DOUBLE|FLOAT|DECIMAL"}[of])
        if f"min{name}" in schema:
            tests.append(~own | (size >= schema[f"min{name}"]))
        if f"max{name}" in schema:
            tests.append(~own | (size <= schema[f"max{name}"]))
    if "items" in schema:
        items = F.try_variant_get(v, "$", "array<variant>")
        tests.append(items.isNull() | F.forall(items, lambda x: fits(x, schema["items"])))
    if "properties" in schema or "required" in schema:
        tests.append(_let(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: m.isNull() | _fields(m, schema)))
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def _fields(m: Column, schema: dict) -> Column:
    known = schema.get("properties", {})
    names = F.map_keys(m)
    out = F.lit(True)
    if not schema.get("additionalProperties"):
        out = F.forall(names, lambda k: k.isin(*known)) if known else F.size(names) == 0
    for name in schema.get("required", ()):
        out = out & F.array_contains(names, name)
    for name, one in known.items():
        out = out & (~F.array_contains(names, name) | fits(F.try_element_at(m, F.lit(name)), one))
    return out


def valid_arguments(name: Column, arguments: Column, schemas=SCHEMAS) -> Column:
    verdict = F.lit(False)
    for tool, schema in schemas.items():
        verdict = F.when(name == tool, fits(F.try_parse_json(arguments), schema)).otherwise(verdict)
    return verdict


def turns_as_messages(turns: DataFrame) -> DataFrame:
    """The turns of plain chats as messages: a user's turn calls ``reply``, and the assistant's turn after it is the
    result, which names that turn. Columns: conv_id, turn, kind, call_turn, name, arguments, content."""
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    kind = F.when(known & (F.col("role") == "user"), "call").when(known & (F.col("role") == "assistant"), "result").otherwise("message")
    n = F.coalesce(F.length("text"), F.lit(0))
    about = F.struct(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"))
    arguments = F.to_json(F.struct(about.alias("about"), F.split("text", "\n").alias("lines"), n.alias("n_chars"), F.when(n < 200, "short").otherwise("long").alias("size")))
    return turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        kind.alias("kind"),
        F.when(kind == "call", F.col("turn")).when(kind == "result", F.col("turn") - 1).alias("call_turn"),
        F.when(kind == "call", "reply").alias("name"),
        F.when(kind == "call", arguments).alias("arguments"),
        F.col("role"),
        F.col("text").alias("content"),
    )


def depths_of_turns(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, depth) of distinct (conv_id, turn): the number of messages that directly precede one another."""
    numbered = number_rows(nodes, ["conv_id", "turn"]).withColumn("island", F.col("turn") - F.col("row_number"))
    first = numbered.groupBy("conv_id", "island").agg(F.min("turn").alias("first"))
    return numbered.join(first.hint("shuffle_hash"), ["conv_id", "island"]).select("conv_id", "turn", (F.col("turn") - F.col("first")).alias("depth"))


def depths_of_calls(nodes: DataFrame, after: DataFrame) -> DataFrame:
    """The same, where the messages in ``after`` (conv_id, turn, up) depend on the turn ``up``.

    Each round doubles the stretch that a pointer covers; what is open after as many rounds as the longest possible
    chain takes runs in a circle.
    """
    before = nodes.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(1).alias("has"))
    by = ["conv_id", "turn"]
    told = after.groupBy(*by).agg(F.min("up").alias("told"))
    up = F.coalesce("told", F.when(F.col("has") == 1, F.col("turn") - 1))
    state = nodes.join(before.hint("shuffle_hash"), by, "left").join(told.hint("shuffle_hash"), by, "left").select(*by, up.isNotNull().cast("long").alias("depth"), up.alias("up"))
    state = cut(state)
    for _ in range(max(1, state.count()).bit_length() + 1):
        if not state.filter(F.col("up").isNotNull()).limit(1).count():
            break
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("depth").alias("more"), F.col("up").alias("next"))
        state = cut(state.join(above.hint("shuffle_hash"), ["conv_id", "up"], "left").select(*by, (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").alias("up")))
    return state.select(*by, F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link(messages: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """conv_id, turn, call_id, status, depth, valid, n_calls, n_results, json."""
    key = F.col("call_key") if "call_key" in messages.columns else F.col("call_turn").cast("string")
    after = F.col("after_key") if "after_key" in messages.columns else F.lit(None).cast("string")
    messages = messages.select("conv_id", "turn", "kind", key.alias("call_key"), after.alias("after_key"), "name", "arguments", "role", "content")
    by = ["conv_id", "call_key"]
    calls = messages.filter(F.col("kind") == "call").groupBy(*by, "name", "arguments").agg(F.min("turn").alias("turn"), F.count("*").alias("n_calls"))
    results = messages.filter(F.col("kind") == "result").groupBy(*by, "content").agg(F.min("turn").alias("r_turn"), F.count("*").alias("n_results"))
    one_call = calls.groupBy(*by).agg(F.min(F.struct("name", "arguments", "turn", "n_calls")).alias("c")).hint("shuffle_hash")
    one_result = results.groupBy(*by).agg(F.min_by(F.struct("content", "n_results"), F.struct(F.col("content").isNull(), F.col("content"))).alias("r")).hint("shuffle_hash")
    called = calls.join(one_result, by, "left").select(*by, "turn", "name", "arguments", "n_calls", F.col("r.content").alias("content"), F.col("r.n_results").alias("n_results"))
    more = results.join(one_result, by, "left").join(one_call, by, "left").filter(F.col("c").isNull() | ~F.col("content").eqNullSafe(F.col("r.content")))
    more = more.select(*by, F.coalesce("c.turn", "r_turn").alias("turn"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.n_calls").alias("n_calls"), "content", "n_results")
    met = called.unionByName(more)
    linked = met.select(
        "conv_id",
        "turn",
        F.when(F.col("call_key").isNotNull(), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("call_key"))).alias("call_id"),
        F.when(F.col("n_calls").isNull(), "orphan_result").when(F.col("n_results").isNull(), "unanswered").otherwise("linked").alias("status"),
        "name",
        "arguments",
        "content",
        F.lit(None).cast("string").alias("role"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
    )
    others = messages.filter(F.col("kind") == "message").select("conv_id", "turn", F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("status"), "name", "arguments", "content", "role", F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    nodes = messages.filter(known).groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).drop("one")
    named = messages.filter(known & F.col("after_key").isNotNull()).select("conv_id", "turn", F.col("after_key").alias("call_key"))
    if "after_key" in messages.columns and named.limit(1).count():
        up = named.join(one_call, by).select("conv_id", "turn", F.col("c.turn").alias("up")).filter(F.col("up").isNotNull())
        depth = depths_of_calls(nodes, up)
    else:
        depth = depths_of_turns(nodes)
    depth = depth.withColumn("found", F.lit(True)).hint("shuffle_hash")
    rows = linked.unionByName(others).join(depth, ["conv_id", "turn"], "left")
    record = F.to_json(
        F.struct(
            F.try_parse_json("arguments").alias("arguments"),
            F.col("call_id").alias("id"),
            F.col("name"),
            F.when(F.col("status") != "message", F.col("content")).alias("result"),
            F.col("role"),
            F.when(F.col("status") == "message", F.col("content")).alias("text"),
        )
    )
    valid = (F.col("status") == "message") | valid_arguments(F.col("name"), F.col("arguments"), schemas)
    return rows.select("conv_id", "turn", "call_id", "status", F.when(F.col("found").isNull(), 0).otherwise(F.col("depth")).alias("depth"), F.coalesce(valid, F.lit(False)).alias("valid"), "n_calls", "n_results", record.alias("json"))


ORACLE_SQL = """
WITH m AS (SELECT *, coalesce(role, '') AS r, conv_id IS NOT NULL AND turn IS NOT NULL AS known FROM conversations),
calls AS (SELECT conv_id, turn, min(text) AS text, count(*) AS n FROM m WHERE known AND r = 'user' GROUP BY 1, 2),
results AS (SELECT conv_id, turn - 1 AS turn, min(text) AS text, count(*) AS n FROM m WHERE known AND r = 'assistant' GROUP BY 1, 2),
nodes AS (SELECT DISTINCT conv_id, turn FROM m WHERE known),
runs AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM nodes),
depths AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS depth FROM runs),
linked AS (
  SELECT coalesce(c.conv_id, s.conv_id) AS conv_id, CASE WHEN c.n IS NULL THEN s.turn + 1 ELSE c.turn END AS turn,
    coalesce(c.conv_id, s.conv_id) || ':' || coalesce(c.turn, s.turn) AS call_id,
    CASE WHEN c.n IS NULL THEN 'orphan_result' WHEN s.n IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    c.n IS NOT NULL AND c.text IS NOT NULL AND c.turn >= 0 AND len(string_split(c.text, chr(10))) <= 3 AS valid, coalesce(c.n, 0) AS n_calls, coalesce(s.n, 0) AS n_results,
    '{' || CASE WHEN c.n IS NULL THEN '' ELSE '"arguments":{"about":{"conv":' || c.conv_id || ',"turn":' || c.turn || '},"lines":' || CAST(to_json(string_split(c.text, chr(10))) AS VARCHAR)
        || ',"n_chars":' || length(c.text) || ',"size":"' || CASE WHEN length(c.text) < 200 THEN 'short' ELSE 'long' END || '"},' END
      || '"id":' || CAST(to_json(coalesce(c.conv_id, s.conv_id) || ':' || coalesce(c.turn, s.turn)) AS VARCHAR)
      || CASE WHEN c.n IS NULL THEN '' ELSE ',"name":"reply"' END
      || CASE WHEN s.text IS NULL THEN '' ELSE ',"result":' || CAST(to_json(s.text) AS VARCHAR) END || '}' AS json
  FROM calls c FULL JOIN results s ON c.conv_id = s.conv_id AND c.turn = s.turn
),
others AS (
  SELECT conv_id, turn, CAST(NULL AS VARCHAR) AS call_id, 'message' AS status, true AS valid, 0 AS n_calls, 0 AS n_results,
    '{' || CASE WHEN role IS NULL THEN '' ELSE '"role":' || CAST(to_json(role) AS VARCHAR) || ',' END || '"text":' || CAST(to_json(text) AS VARCHAR) || '}' AS json
  FROM m WHERE NOT (known AND r IN ('user', 'assistant'))
)
SELECT x.conv_id, x.turn, x.call_id, x.status, CAST(coalesce(d.depth, 0) AS BIGINT) AS depth, x.valid, CAST(x.n_calls AS BIGINT) AS n_calls, CAST(x.n_results AS BIGINT) AS n_results, x.json
FROM (SELECT * FROM linked UNION ALL SELECT * FROM others) x LEFT JOIN depths d ON x.conv_id = d.conv_id AND x.turn = d.turn
"""
