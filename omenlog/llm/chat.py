"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omenlog.session import checkpointed

#: Argument -> (JSON type, required), by tool.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "summarise": {"text": ("string", True), "max_words": ("integer", True), "strict": ("boolean", False)},
    "translate": {"text": ("string", True), "to": ("string", True)},
}

_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$",
          "array": "^ARRAY<", "object": "^OBJECT<"}


def errors(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments (JSON text), as a sorted array of short texts."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    found = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        wrong = []
        for arg, (kind, required) in sorted(schema.items()):
            of = F.schema_of_variant(F.try_variant_get(parsed, f"$['{arg}']", "variant"))
            missing = of.isNull() if required else F.lit(False)
            wrong.append(F.when(missing, F.lit(f"{arg} is missing")).when(~of.rlike(_TYPES[kind]), F.lit(f"{arg} is no {kind}")))
        extra = F.transform(
            F.array_except(keys, F.array(*[F.lit(a) for a in sorted(schema)])), lambda k: F.concat(k, F.lit(" is unknown")))
        here = F.when(parsed.isNull() | keys.isNull(), F.array(F.lit("no JSON object"))).otherwise(
            F.concat(F.array_compact(F.array(*wrong)), F.array_sort(extra)))
        found = F.when(name == tool, here).otherwise(found)
    return found


def stages(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, stage, cyclic`` for the calls of conversations that are not in order.

    ``calls`` has conv_id, call_id, turn, needs (identifiers of calls whose results it uses).
    Where every need stands in an earlier turn, the turn is a topological order already and
    nothing is to do.  Other conversations are peeled: in each round the calls without open needs
    get the next stage; calls that are never free stand on a cycle or behind one.
    """
    ids = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    edges = calls.select("conv_id", "call_id", "turn", F.explode("needs").alias("need"))
    at = ids.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("need"), F.col("turn").alias("need_turn"))
    edges = checkpointed(edges.join(at, (edges["conv_id"] == at["_c"]) & (edges["need"] == at["need"])).select(
        edges["conv_id"], "call_id", edges["need"], "turn", "need_turn"))
    late = checkpointed(edges.filter("need_turn >= turn").select("conv_id").distinct())
    left = checkpointed(ids.join(late, "conv_id", "left_semi").select("conv_id", "call_id"))
    edges = checkpointed(edges.join(late, "conv_id", "left_semi").select("conv_id", "call_id", "need").distinct())
    done, stage = [], 0
    while left.count():
        still = left.select("conv_id", F.col("call_id").alias("need"))
        waiting = checkpointed(edges.join(still, ["conv_id", "need"], "left_semi").select("conv_id", "call_id").distinct())
        free = checkpointed(left.join(waiting, ["conv_id", "call_id"], "left_anti"))
        if not free.count():
            break
        done.append(free.select("*", F.lit(stage).cast("long").alias("stage"), F.lit(False).alias("cyclic")))
        left = checkpointed(left.join(waiting, ["conv_id", "call_id"], "left_semi"))
        stage += 1
    rest = left.select("*", F.lit(stage).cast("long").alias("stage"), F.lit(True).alias("cyclic"))
    return reduce(DataFrame.unionByName, done, rest)


def link(messages: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """One row for each row of ``messages``: how it is linked, its place, and its canonical JSON.

    ``messages`` has conv_id, turn, kind (call, result or anything else), role, call_id, name,
    arguments (JSON text), needs (array of call ids) and content.  Calls and results of a
    conversation are joined by identifier; both sides meet a table with one row per identifier
    (counts summed before the shuffle), so repeated identifiers never multiply.  Given are

    * ``status``: ok, or the first that holds of invalid, cyclic, needs unknown call, no result
      (calls), no call (results); ok for other messages,
    * ``linked_turn``: the first turn of the result of a call, of the call of a result,
    * ``stage``: rows sorted by (conv_id, stage, turn, kind) are in topological order,
    * ``errors``, and ``json``: keys in order, no blanks, nulls written, arguments as parsed.

    Null conversations and identifiers are never linked; null text stays null; repeated rows stay;
    a call that needs itself is cyclic; an empty table gives an empty result; other columns are
    not read.
    """
    rows = messages.select("conv_id", "turn", "kind", "role", "call_id", "name", "arguments", "needs", "content")
    rows = rows.withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))
    known = rows.filter("conv_id IS NOT NULL AND call_id IS NOT NULL")
    calls = known.filter("kind = 'call'").select("conv_id", "call_id", "turn", "name", "needs")
    by_call = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"), F.min("name").alias("of_name"))
    by_result = known.filter("kind = 'result'").groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    staged = checkpointed(stages(calls))
    needs = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    there = by_call.select("conv_id", F.col("call_id").alias("need"))
    lacking = needs.join(there, ["conv_id", "need"], "left_anti").select("conv_id", "call_id").distinct()

    ids = (
        by_call.select("conv_id", "call_id", F.lit("call").alias("other"), F.col("turn").alias("linked_turn"), "of_name")
        .unionByName(by_result.select(
            "conv_id", "call_id", F.lit("result").alias("other"), F.col("turn").alias("linked_turn"),
            F.lit(None).cast("string").alias("of_name")))
    )
    extra = (
        by_call.select("conv_id", "call_id")
        .join(staged, ["conv_id", "call_id"], "left")
        .join(lacking.withColumn("lacks", F.lit(True)), ["conv_id", "call_id"], "left")
    )
    other = F.when(F.col("kind") == "call", "result").when(F.col("kind") == "result", "call")
    linked = rows.withColumn("other", other).join(ids, ["conv_id", "call_id", "other"], "left").join(
        extra, ["conv_id", "call_id"], "left")
    call = F.col("kind") == "call"
    wrong = F.when(call, errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    linked = linked.withColumn("errors", wrong).withColumn("name", F.coalesce("name", "of_name"))
    status = (
        F.when(call & (F.size("errors") > 0), "invalid")
        .when(call & F.coalesce("cyclic", F.lit(False)), "cyclic")
        .when(call & F.coalesce("lacks", F.lit(False)), "needs unknown call")
        .when(call & F.col("linked_turn").isNull(), "no result")
        .when((F.col("kind") == "result") & F.col("linked_turn").isNull(), "no call")
        .otherwise("ok")
    )
    stage = F.coalesce("stage", F.when(F.col("kind") == "result", F.coalesce("linked_turn", "turn")).otherwise(F.col("turn")))
    given = {"ignoreNullFields": "false"}
    body = F.when(call, F.to_json(F.struct(
        F.try_parse_json("arguments").alias("arguments"), "call_id", "name", "needs", "role"), given)
    ).when(F.col("kind") == "result", F.to_json(F.struct("call_id", "content", "name", "role"), given)
    ).otherwise(F.to_json(F.struct("content", "role"), given))
    return linked.select(
        "conv_id", "turn", "kind", "call_id", "name", status.alias("status"), "linked_turn", stage.alias("stage"),
        F.array_join("errors", "; ").alias("errors"), body.alias("json"),
    )


def as_tool_calls(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as the messages that ``link`` takes.

    A user's turn calls a tool that depends on its number of words; the assistant's turn after it
    is the result.  A summary needs the call of two turns before.  Some calls lack an argument or
    have one of the wrong type, as the words have it.
    """
    words = F.size(F.split("text", " "))
    user, helper = F.col("role") == "user", F.col("role") == "assistant"
    name = F.element_at(F.array(F.lit("search"), F.lit("summarise"), F.lit("translate")), (words % 3 + 1).cast("int"))
    ident = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    arguments = (
        F.when(F.col("name") == "search", F.when(words % 7 == 0, F.to_json(F.struct(F.col("text").alias("query"))))
               .otherwise(F.to_json(F.struct(F.col("text").alias("query"), (words % 10).alias("limit")))))
        .when(F.col("name") == "summarise", F.when(words % 5 == 0, F.to_json(F.struct(
            F.col("text"), words.cast("string").alias("max_words"))))
            .otherwise(F.to_json(F.struct(F.col("text"), words.alias("max_words"), (words > 20).alias("strict")))))
        .otherwise(F.to_json(F.struct(F.lit("en").alias("to"), F.col("text"))))
    )
    named = conversations.select("conv_id", "turn", "role", "text").withColumn("name", F.when(user, name))
    return named.select(
        "conv_id", "turn", F.when(user, "call").when(helper, "result").otherwise("message").alias("kind"),
        F.when(user, F.lit("assistant")).when(helper, F.lit("tool")).otherwise(F.col("role")).alias("role"),
        F.when(user, ident(F.col("turn"))).when(helper, ident(F.col("turn") - 1)).alias("call_id"), "name",
        F.when(user, arguments).alias("arguments"),
        F.when(user & (F.col("name") == "summarise") & (F.col("turn") >= 2), F.array(ident(F.col("turn") - 2)))
        .otherwise(F.array().cast("array<string>")).alias("needs"),
        F.when(~user, F.col("text")).alias("content"),
    )


def link_sql() -> str:
    """``link(as_tool_calls(conversations))`` for DuckDB (linked_turn -1: none); all needs there stand in earlier turns."""
    return """
    WITH w AS (SELECT conv_id, turn, role, text, len(string_split(text, ' ')) AS n FROM conversations),
    named AS (
      SELECT *, CASE WHEN role = 'user' THEN ['search', 'summarise', 'translate'][n % 3 + 1] END AS nm FROM w),
    m AS (
      SELECT conv_id, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
        CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'tool' ELSE role END AS role,
        CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id,
        nm, text, n,
        CASE WHEN nm = 'summarise' AND turn >= 2 THEN [conv_id || ':' || (turn - 2)] ELSE []::VARCHAR[] END AS needs
      FROM named),
    calls AS (SELECT conv_id, call_id, min(turn) AS turn, min(nm) AS of_name FROM m WHERE kind = 'call' GROUP BY ALL),
    results AS (SELECT conv_id, call_id, min(turn) AS turn FROM m WHERE kind = 'result' GROUP BY ALL),
    lacking AS (
      SELECT DISTINCT e.conv_id, e.call_id FROM (SELECT conv_id, call_id, unnest(needs) AS need FROM m WHERE kind = 'call') e
      WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = e.conv_id AND c.call_id = e.need)),
    l AS (
      SELECT m.*, coalesce(m.nm, c.of_name) AS name, CASE m.kind WHEN 'call' THEN r.turn WHEN 'result' THEN c.turn END AS linked_turn,
        k.call_id IS NOT NULL AS lacks,
        CASE WHEN nm = 'search' AND n % 7 = 0 THEN 'limit is missing'
             WHEN nm = 'summarise' AND n % 5 = 0 THEN 'max_words is no integer' ELSE '' END AS errors
      FROM m
      LEFT JOIN results r ON m.kind = 'call' AND m.conv_id = r.conv_id AND m.call_id = r.call_id
      LEFT JOIN calls c ON m.kind = 'result' AND m.conv_id = c.conv_id AND m.call_id = c.call_id
      LEFT JOIN lacking k ON m.kind = 'call' AND m.conv_id = k.conv_id AND m.call_id = k.call_id)
    SELECT conv_id, turn, kind, call_id, name,
      CASE WHEN errors <> '' THEN 'invalid' WHEN lacks THEN 'needs unknown call'
           WHEN kind = 'call' AND linked_turn IS NULL THEN 'no result'
           WHEN kind = 'result' AND linked_turn IS NULL THEN 'no call' ELSE 'ok' END AS status,
      coalesce(linked_turn, -1) AS linked_turn, CASE WHEN kind = 'result' THEN coalesce(linked_turn, turn) ELSE turn END AS stage, errors,
      CAST(CASE kind
        WHEN 'call' THEN json_object('arguments', CASE
            WHEN nm = 'search' AND n % 7 = 0 THEN json_object('query', text)
            WHEN nm = 'search' THEN json_object('limit', n % 10, 'query', text)
            WHEN nm = 'summarise' AND n % 5 = 0 THEN json_object('max_words', CAST(n AS VARCHAR), 'text', text)
            WHEN nm = 'summarise' THEN json_object('max_words', n, 'strict', n > 20, 'text', text)
            ELSE json_object('text', text, 'to', 'en') END,
          'call_id', call_id, 'name', name, 'needs', needs, 'role', role)
        WHEN 'result' THEN json_object('call_id', call_id, 'content', text, 'name', name, 'role', role)
        ELSE json_object('content', text, 'role', role) END AS VARCHAR) AS json
    FROM l
    """
