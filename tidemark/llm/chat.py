"""Chat formatting in DataFrame functions only: tool calls linked to their results, in order, as canonical JSON.

An assistant's text may be a JSON object with ``tool_calls`` (``id, name, arguments``) and ``content``; a
``tool`` message's text is one with ``tool_call_id`` and ``content``. Calls and results are joined by
conversation and identifier (``linked``). A call whose arguments mention ``$id`` of another call of its message
depends on it; a message's calls are in topological order, of several the one that stands first, and those on a
cycle, or behind one, come last. Turns are in order already, so what needs a call of an earlier message stands
after it. Arguments are validated against the tools' schemas: each parameter has a type and may be required.

A conversation is one row, however many messages it has: its chat is one value, which Spark bounds by 2 GB; a larger
one fails rather than being cut. A row without a conversation is a chat of its own, so these are never gathered.
Canonical JSON has the keys of every object in order, at every depth, and no spaces; arguments and results that are
JSON objects or arrays stand in it as such, others as strings. Repeated rows are written as often as they occur;
their calls and results link once. A result is linked to one call, a call has one result, and results that are
left over stay messages. Rows without a turn come first; rows of one turn are in order of role and text. Null texts
have empty content, null roles none. An empty table gives no rows, other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of parameters, by the type of a value as Spark names it.
TYPES = {"integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY", "string": "^STRING"}
_CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"
_RESULT = "struct<content:string,tool_call_id:string>"
_OF_MESSAGE = "array<struct<place:int,id:string,needs:array<string>,json:string,linked:boolean,invalid:boolean>>"
SCHEMA_COLUMNS = "tool string, parameter string, type string, required boolean"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value computed once however often it is used in lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def messages(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``, a parsed ``call`` or ``result``, and ``message``, the key of one with either or without a conversation."""
    rows = df.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    is_object = F.col("text").rlike(r"^\s*\{")
    call = F.when((F.col("role") == "assistant") & is_object & F.col("text").contains('"tool_calls"'), F.from_json("text", _CALLS))
    result = F.when((F.col("role") == "tool") & is_object, F.from_json("text", _RESULT))
    rows = rows.withColumn("call", call).withColumn("result", result)
    keyed = F.col("call.tool_calls").isNotNull() | F.col("result.tool_call_id").isNotNull() | F.col("conv_id").isNull()
    return rows.withColumn("message", F.when(keyed, F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text")), 256)))


def calls(msgs: DataFrame) -> DataFrame:
    """``conv_id, id, name, arguments, message, turn, place``, those of equal messages once."""
    rows = msgs.where(F.col("call.tool_calls").isNotNull()).select("conv_id", "message", "turn", F.posexplode("call.tool_calls").alias("place", "c"))
    return rows.select("conv_id", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), "message", "turn", "place").distinct()


def linked(made: DataFrame, msgs: DataFrame) -> DataFrame:
    """The calls with ``result_turn, result_content`` of their result, and ``answer``, its key; each result has one call at most.

    Calls and results of an identifier are taken in order of turn, calls before results of the same turn. Results
    that follow a row of calls belong to the last of these calls, one each, in order.
    """
    results = msgs.where(F.col("result.tool_call_id").isNotNull()).select("conv_id", F.col("result.tool_call_id").alias("id"), "turn", F.col("result.content").alias("content"), "message").distinct()
    asked = made.select("conv_id", "id", "turn", F.lit(0).alias("kind"), "place", F.lit(None).cast("string").alias("content"), "message")
    given = results.select("conv_id", "id", "turn", F.lit(1).alias("kind"), F.lit(0).alias("place"), "content", "message")
    of_id = Window.partitionBy("conv_id", "id").orderBy("turn", "kind", "place", "content", "message")
    rows = asked.unionByName(given).where(F.col("conv_id").isNotNull() & F.col("id").isNotNull())
    again = (F.col("kind") == 0) & (F.lag("kind").over(of_id) == 1)
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False)).cast("int")).withColumn("row", F.sum("again").over(of_id))
    of_row = Window.partitionBy("conv_id", "id", "row")
    n_calls, n_results = F.count_if(F.col("kind") == 0).over(of_row), F.count_if(F.col("kind") == 1).over(of_row)
    rows = rows.withColumn("skip", F.when(F.col("kind") == 0, F.greatest(n_calls - n_results, F.lit(0))).otherwise(0))
    place_in_row = F.row_number().over(Window.partitionBy("conv_id", "id", "row", "kind").orderBy("turn", "place", "content", "message"))
    rows = rows.withColumn("slot", place_in_row - F.col("skip"))
    ours = rows.where((F.col("kind") == 0) & (F.col("slot") > 0)).select("conv_id", "id", "row", "slot", "message", "place")
    theirs = rows.where("kind = 1").select("conv_id", "id", "row", "slot", F.col("turn").alias("result_turn"), F.col("content").alias("result_content"), F.col("message").alias("answer"))
    pairs = ours.join(theirs, ["conv_id", "id", "row", "slot"]).select("message", "place", "result_turn", "result_content", "answer")
    return made.hint("shuffle_hash").join(pairs, ["message", "place"], "left").select(*made.columns, "result_turn", "result_content", "answer")


def validated(made: DataFrame, schemas: DataFrame) -> DataFrame:
    """The calls with ``problems``: a sorted array, empty for valid ones. A parameter that is ``null`` is absent."""
    by_tool = schemas.groupBy("tool").agg(F.collect_list(F.struct("parameter", "type", "required")).alias("parameters"))
    given = F.transform_values(F.from_json("arguments", "map<string,variant>"), lambda _, v: F.schema_of_variant(v))
    rows = made.join(by_tool, F.col("name") == F.col("tool"), "left").withColumn("given", given)
    patterns = F.create_map(*(x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v))))

    def kind(p: Column) -> Column:
        return F.nullif(F.col("given")[p["parameter"]], F.lit("VOID"))

    absent = F.transform(F.filter("parameters", lambda p: p["required"] & kind(p).isNull()), lambda p: F.concat(F.lit("missing:"), p["parameter"]))
    wrong = F.transform(F.filter("parameters", lambda p: kind(p).isNotNull() & ~F.regexp(kind(p), F.coalesce(patterns[p["type"]], F.lit("^")))), lambda p: F.concat(F.lit("type:"), p["parameter"]))
    extra = F.transform(F.array_except(F.map_keys("given"), F.transform("parameters", lambda p: p["parameter"])), lambda k: F.concat(F.lit("unknown:"), k))
    problems = F.when(F.col("tool").isNull(), F.array(F.lit("tool"))).when(F.col("given").isNull(), F.array(F.lit("json"))).otherwise(F.array_sort(F.concat(absent, wrong, extra)))
    return rows.withColumn("problems", problems).drop("tool", "parameters", "given")


def mentioned(arguments: Column) -> Column:
    """The identifiers that follow a ``$`` in a call's arguments."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(arguments, F.lit("")), F.lit(r"\$([A-Za-z0-9_.:-]+)"), F.lit(1)))


def depths(nodes: Column) -> Column:
    """For an array of structs with ``id`` and ``needs``: each one's depth among what needs what, the array's size on a cycle or behind one.

    Depths rise until none changes, so the work is the deepest chain times the array, without a job or a join.
    """
    ids = F.transform(nodes, lambda x: x["id"])
    needs = F.transform(nodes, lambda x: F.filter(F.transform(x["needs"], lambda q: F.coalesce(F.array_position(ids, q), F.lit(0)).cast("int")), lambda p: p > 0))

    def rise(of: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            def next_(d: Column) -> Column:
                return F.struct(d.alias("d"), (d == acc["d"]).alias("done"))

            deeper = F.transform(of, lambda ps: F.coalesce(F.array_max(F.transform(ps, lambda p: F.element_at(acc["d"], p))) + 1, F.lit(0)))
            return F.when(acc["done"], acc).otherwise(_with(deeper, next_))

        start = F.struct(F.transform(of, lambda _: F.lit(0)).alias("d"), (F.size(F.flatten(of)) == 0).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(of), F.lit(1))), start, step, lambda acc: acc["d"])

    return _with(needs, rise)


def topological(nodes: Column) -> Column:
    """The array in topological order; of several that may come next, by depth, the one that stands first."""
    keyed = F.zip_with(nodes, depths(nodes), lambda x, d: F.struct(d.alias("depth"), x["place"].alias("place"), x.alias("node")))
    return F.transform(F.array_sort(keyed), lambda x: x["node"])


def _value(text: Column) -> Column:
    """The variant of a JSON object or array, else of the string."""
    return F.coalesce(F.when(text.rlike(r"^\s*[\[{]"), F.try_parse_json(text)), text.cast("variant"))


def formatted(df: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """``conv_id, n_messages, n_calls, n_linked, n_invalid, n_orphans, chat`` from ``conv_id, turn, role, text``.

    ``chat`` is a JSON array of messages in order of turns; a message's calls are in topological order, each
    with its result and, if there are schemas, its problems; without schemas no call is judged and ``n_invalid`` is
    0. Results that are linked to a call appear with it only, all others where they are.
    """
    msgs = messages(df)
    made = calls(msgs)
    with_results = linked(made, msgs)
    full = with_results.withColumn("problems", F.lit(None).cast("array<string>")) if schemas is None else validated(with_results, schemas)
    entry = F.struct(_value(F.col("arguments")).alias("arguments"), F.col("id").alias("id"), F.col("name").alias("name"), F.col("problems").alias("problems"), _value(F.col("result_content")).alias("result"))
    node = F.struct("place", "id", mentioned(F.col("arguments")).alias("needs"), F.to_json(entry).alias("json"), F.col("answer").isNotNull().alias("linked"), F.coalesce(F.size("problems") > 0, F.lit(False)).alias("invalid"))
    per_message = full.groupBy("message").agg(F.array_sort(F.collect_list(node)).cast(_OF_MESSAGE).alias("nodes")).select("message", topological(F.col("nodes")).alias("of_message"))
    # Only calls and results meet a join; the rest goes straight to its conversation.
    has_calls, is_result = F.col("call.tool_calls").isNotNull(), F.col("result.tool_call_id").isNotNull()
    none, unclaimed = F.lit(None).cast(_OF_MESSAGE), F.lit(None).cast("boolean")
    wanted = full.where(F.col("answer").isNotNull()).select(F.col("answer").alias("message"), F.lit(True).alias("claimed"))
    with_calls = msgs.where(has_calls).join(per_message, "message", "left").withColumn("claimed", unclaimed)
    results = msgs.where(is_result).join(wanted, "message", "left").withColumn("of_message", none)
    plain = msgs.where(~has_calls & ~is_result).withColumn("of_message", none).withColumn("claimed", unclaimed)
    all_ = with_calls.unionByName(results).unionByName(plain)

    content = F.when(has_calls, F.coalesce("call.content", F.lit(""))).when(is_result, F.coalesce("result.content", F.lit(""))).otherwise(F.col("text"))
    said = F.to_json(F.struct(content.alias("content"), F.col("role").alias("role")))
    entries = F.array_join(F.transform("of_message", lambda x: x["json"]), ",")
    json = F.when(has_calls, F.concat(F.expr("substr(said, 1, length(said) - 1)"), F.lit(',"tool_calls":['), F.coalesce(entries, F.lit("")), F.lit("]}"))).otherwise(F.col("said"))
    count = lambda f: F.coalesce(F.size(F.filter("of_message", f)), F.lit(0)).cast("long")
    line = F.struct(
        F.col("turn").alias("turn"),
        F.col("role").alias("role"),
        F.col("text").alias("text"),
        F.when(F.col("claimed").isNull(), json).alias("json"),
        count(lambda x: F.lit(True)).alias("n_calls"),
        count(lambda x: x["linked"]).alias("n_linked"),
        count(lambda x: x["invalid"]).alias("n_invalid"),
        (F.coalesce(F.col("role") == "tool", F.lit(False)) & F.col("claimed").isNull()).cast("long").alias("n_orphans"),
    )
    alone = F.when(F.col("conv_id").isNull(), F.col("message")).alias("alone")
    grouped = all_.withColumn("said", said).groupBy("conv_id", alone).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    body = F.array_join(F.filter(F.transform("lines", lambda x: x["json"]), lambda x: x.isNotNull()), ",")
    total = lambda name: F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + x[name]).alias(name)
    counts = [total(name) for name in ("n_calls", "n_linked", "n_invalid", "n_orphans")]
    return grouped.select("conv_id", F.size("lines").cast("long").alias("n_messages"), *counts, F.concat(F.lit("["), body, F.lit("]")).alias("chat"))
