"""Tool-call linking for chat formatting, in DataFrame operations only.

The first call and the first result of each identifier are hash-joined by conversation and
identifier; all others are rows of their own.  Every call may name a parent (the call whose result it builds on); its level, the
number of calls before it on that path, orders calls topologically.  Levels come from pointer
doubling: each round joins a call with its farthest known ancestor, so a chain of k calls takes
about log2(k) rounds and a conversation is never one task's.  Arguments are parsed as variants,
checked against the tool's schema by compiled expressions, and serialised as canonical JSON:
keys in order, no white space, absent values as null.

There is one output row per call and per result that is not linked to a call.  Defined
results, by ``status``: ``no_id`` (a call or result without an identifier, linked to nothing),
``orphan_result`` (no such call), ``duplicate_id`` (a call or result whose identifier an earlier
one has), ``cycle`` (the parents never end; the level is null), ``invalid`` (``errors`` tell
why), ``no_result``, ``ok``; the first that applies.  A parent that is no call of the
conversation counts as none, and one that is several calls is the first of them.  Calls without
an identifier and later ones have the level that their own parent gives them.  Of several calls
or results with one identifier the first by turn (then by content) is linked.  ``n_calls`` and
``n_results`` count those with the row's identifier, or those without any, in its conversation.
Rows with a null conversation are one conversation.  Null and empty arguments are not JSON; null
content is a null result.  Other columns of the inputs are not looked at.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appcensus.llm.tables import written


@dataclass(frozen=True)
class Field:
    """One argument: ``kind`` is string, integer, number, boolean, array or object."""

    name: str
    kind: str
    required: bool = True
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


Schema = tuple[Field, ...]

# What a variant of each kind calls its type.
_TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)",
    "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _path(name: str) -> str:
    return _quoted("$['" + name + "']")


def _field_errors(field: Field) -> list[str]:
    value = f"try_variant_get(_args, {_path(field.name)}, 'variant')"
    there = f"({value} is not null)"
    fits = f"(schema_of_variant({value}) rlike {_quoted('^' + _TYPES[field.kind] + '$')})"
    out = [f"when {there} and not {fits} then {_quoted('type:' + field.name)}"]
    if field.required:
        out.append(f"when not {there} then {_quoted('missing:' + field.name)}")
    number = f"try_variant_get(_args, {_path(field.name)}, 'double')"
    bounds = [f"{number} < {field.low}"] * (field.low is not None)
    bounds += [f"{number} > {field.high}"] * (field.high is not None)
    if bounds:
        out.append(f"when {there} and ({' or '.join(bounds)}) then {_quoted('range:' + field.name)}")
    if field.choices:
        text = f"try_variant_get(_args, {_path(field.name)}, 'string')"
        choices = ", ".join(map(_quoted, field.choices))
        out.append(f"when {there} and {text} not in ({choices}) then {_quoted('choice:' + field.name)}")
    return out


def validation(schemas: dict[str, Schema], name: str, arguments: str) -> Column:
    """Errors of ``_args`` (the parsed ``arguments``) as a sorted array."""
    per_tool = []
    for tool, fields in sorted(schemas.items()):
        checks = ", ".join(f"case {' '.join(_field_errors(f))} end" for f in fields)
        known = ", ".join(_quoted(f.name) for f in fields)
        unknown = (
            f"transform(array_except(coalesce(json_object_keys({arguments}), array()),"
            f" array({known})), k -> concat('unknown:', k))"
        )
        per_tool.append(
            f"when {name} = {_quoted(tool)} then"
            f" array_sort(concat(array_compact(array({checks})), {unknown}))"
        )
    return F.expr(
        "case when _args is null then array('not_json')"
        " when schema_of_variant(_args) not like 'OBJECT%' then array('not_object') "
        + " ".join(per_tool)
        + " else array('unknown_tool') end"
    )


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of calls (``conv_id, call_id, parent_id``; ids unique).

    The level of a call whose parents form a cycle is null.
    """
    known = calls.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"))
    is_call = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("parent_id") == F.col("_p"))
    state = calls.join(known, is_call, "left").select(
        "conv_id", "call_id", F.col("_p").alias("up"), F.col("_p").isNotNull().cast("bigint").alias("level")
    )
    state = written(state, "levels")
    reach, total = 1, state.count()
    while reach <= total and not state.filter("up is not null").isEmpty():
        above = state.select(
            F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"),
            F.col("up").alias("_up"), F.col("level").alias("_level"),
        )
        at = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("up") == F.col("_i"))
        going = state.filter("up is not null").join(above, at).select(
            "conv_id", "call_id", F.col("_up").alias("up"), (F.col("level") + F.col("_level")).alias("level")
        )
        state = written(state.filter("up is null").union(going), "levels")
        reach *= 2
    return state.select(
        "conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level")
    )


def _several(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``_sc, _si, n_calls, n_results`` of each identifier that is not one call or one result's,
    and of the rows without one."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    keys = calls.select("conv_id", "call_id", one.alias("c"), none.alias("r")).union(
        results.select("conv_id", "call_id", none.alias("c"), one.alias("r"))
    )
    counts = keys.groupBy(F.col("conv_id").alias("_sc"), F.col("call_id").alias("_si")).agg(
        F.sum("c").alias("n_calls"), F.sum("r").alias("n_results")
    )
    return written(counts.filter("_si is null or n_calls > 1 or n_results > 1"), "several")


def _first_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``_row`` of the first row of each identifier, in ``order``."""
    first = F.min(F.struct(*order, "_row"))["_row"]
    named = rows.filter("call_id is not null").groupBy("conv_id", "call_id").agg(first.alias("_row"))
    return named.select("_row")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """Calls (``conv_id, turn, call_id, parent_id, name, arguments``) with their results
    (``conv_id, turn, call_id, content``)."""
    calls = written(
        calls.select("conv_id", "turn", "call_id", "parent_id", "name", "arguments",
                     F.monotonically_increasing_id().alias("_row")),
        "calls",
    )
    results = written(
        results.select("conv_id", "turn", "call_id", "content", F.monotonically_increasing_id().alias("_row")),
        "results",
    )
    several = _several(calls, results)
    same_id = F.col("call_id") == F.col("_si")
    same_conv = F.col("conv_id").eqNullSafe(F.col("_sc"))
    any_id = F.col("call_id").eqNullSafe(F.col("_si"))

    # What is not linked.  Few rows are, as a rule; they are told apart by their numbers.
    many = calls.join(several, same_conv & any_id).drop("_sc", "_si")
    later = many.join(_first_rows(many, ["turn", "name", "arguments", "parent_id"]), "_row", "left_anti")
    later = written(later, "later-calls")
    repeated = written(
        results.join(several, same_conv & any_id).drop("_sc", "_si"), "repeated-results",
    )
    first_rows = written(_first_rows(repeated, ["turn", "content"]), "first-results")

    heads = calls.filter("call_id is not null").join(later.select("_row"), "_row", "left_anti")
    depth = levels(heads.select("conv_id", "call_id", "parent_id"))
    depth = depth.select(F.col("conv_id").alias("_lc"), F.col("call_id").alias("_li"), "level")
    in_conv = F.col("conv_id").eqNullSafe(F.col("_lc"))
    leveled = heads.join(depth, in_conv & (F.col("call_id") == F.col("_li")), "left")
    leveled = leveled.join(several.drop("n_results"), same_conv & same_id, "left").withColumn(
        "n_calls", F.coalesce("n_calls", F.lit(1).cast("bigint"))
    )
    answers = (
        results.filter("call_id is not null").join(several, same_conv & any_id, "left_anti")
        .select("conv_id", "call_id", "_row", F.lit(1).cast("bigint").alias("n_results"))
        .union(
            repeated.join(first_rows, "_row", "left_semi")
            .select("conv_id", "call_id", "_row", "n_results")
        )
        .toDF("_rc", "_ri", "_rr", "n_results")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_rc")) & (F.col("call_id") == F.col("_ri"))
    # The hash join holds identifiers and numbers only; contents follow by number.
    contents = results.select(F.col("_row").alias("_of"), "content")
    linked = leveled.drop("_row").join(answers.hint("shuffle_hash"), same, "full_outer")
    linked = linked.join(contents, F.col("_rr") == F.col("_of"), "left").select(
        F.when(F.col("n_calls").isNull(), F.col("_rc")).otherwise(F.col("conv_id")).alias("conv_id"),
        F.when(F.col("n_calls").isNull(), F.col("_ri")).otherwise(F.col("call_id")).alias("call_id"),
        "level", "name", "arguments", "parent_id", "content",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.col("n_calls").isNotNull().alias("_call"), F.lit(False).alias("_later"),
    )
    at_parent = in_conv & (F.col("parent_id") == F.col("_li"))
    later = later.join(depth, at_parent, "left").select(
        "conv_id", "call_id", F.when(F.col("_li").isNull(), 0).otherwise(F.col("level") + 1).alias("level"),
        "name", "arguments", "parent_id", F.lit(None).cast("string").alias("content"),
        "n_calls", "n_results", F.lit(True).alias("_call"), F.lit(True).alias("_later"),
    )
    null, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    spare = repeated.join(first_rows, "_row", "left_anti").select(
        "conv_id", "call_id", number.alias("level"), null.alias("name"), null.alias("arguments"),
        null.alias("parent_id"), "content", "n_calls", "n_results",
        F.lit(False).alias("_call"), F.lit(True).alias("_later"),
    )
    rows = later.union(spare).union(linked)
    rows = rows.withColumn("_args", F.try_parse_json("arguments"))
    no_errors = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn(
        "_errors", F.when(F.col("_call"), validation(schemas, "name", "arguments")).otherwise(no_errors)
    )
    status = (
        F.when(F.col("call_id").isNull(), "no_id")
        .when(F.col("n_calls") == 0, "orphan_result")
        .when(F.col("_later"), "duplicate_id")
        .when(F.col("level").isNull(), "cycle")
        .when(F.size("_errors") > 0, "invalid")
        .when(F.col("n_results") == 0, "no_result")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    record = F.to_json(
        F.struct(
            F.col("_args").alias("arguments"), "call_id", F.col("_errors").alias("errors"), "level",
            "name", F.col("parent_id").alias("parent"), F.col("content").alias("result"), "status",
        ),
        {"ignoreNullFields": "false"},
    )
    return rows.select(
        "conv_id", "call_id", "level", "status", F.array_join("_errors", ",").alias("errors"),
        "n_calls", "n_results", record.alias("record"),
    )


TOOLS: dict[str, Schema] = {
    "answer": (Field("n_words", "integer", low=1, high=150), Field("text", "string")),
    "lookup": (Field("limit", "integer", low=1, high=1000), Field("query", "string"),
               Field("lang", "string", required=False)),
    "measure": (Field("size", "integer"), Field("unit", "string", choices=("char", "line", "word"))),
}


def traffic(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a conversation stands for.

    Every assistant turn is a call with its whole text, and builds on the assistant turn before
    the last user turn; every other turn, whatever its role, is the result of the turn before it.
    """
    call = conversations.filter("role = 'assistant'")
    arguments = F.expr(
        "case pmod(conv_id + turn, 3)"
        " when 0 then to_json(named_struct('text', text, 'n_words', size(split(text, ' '))))"
        " when 1 then to_json(named_struct('query', text, 'limit', length(text)))"
        " else case pmod(conv_id, 5)"
        "  when 0 then to_json(named_struct('unit', 'char', 'size', cast(length(text) as string)))"
        "  when 1 then to_json(named_struct('unit', 'byte', 'size', length(text)))"
        "  when 2 then to_json(named_struct('size', length(text), 'text', text))"
        "  else to_json(named_struct('unit', 'char', 'size', length(text))) end end"
    )
    calls = call.select(
        "conv_id", "turn", F.expr("concat('c', conv_id, '-', turn)").alias("call_id"),
        F.expr("case when turn >= 2 then concat('c', conv_id, '-', turn - 2) end").alias("parent_id"),
        F.expr("element_at(array('answer', 'lookup', 'measure'), cast(pmod(conv_id + turn, 3) + 1 as int))").alias("name"),
        arguments.alias("arguments"),
    )
    results = conversations.filter("not (role <=> 'assistant')").select(
        "conv_id", "turn", F.expr("concat('c', conv_id, '-', turn - 1)").alias("call_id"),
        F.col("text").alias("content"),
    )
    return calls, results


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = traffic(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link(calls, results, TOOLS)


OP1_SQL = """
with recursive calls as (
  select conv_id, turn, 'c' || conv_id || '-' || turn as call_id, text, length(text) as n,
         len(string_split(text, ' ')) as w, (conv_id + turn) % 3 as tool, conv_id % 5 as how,
         case when turn >= 2 then 'c' || conv_id || '-' || (turn - 2) end as parent_id
  from conversations where role = 'assistant'
), results as (
  select conv_id, turn, 'c' || conv_id || '-' || (turn - 1) as call_id, text as content
  from conversations where role is distinct from 'assistant'
), depth as (
  select conv_id, call_id, cast(0 as bigint) as level from calls
  where parent_id is null or parent_id not in (select call_id from calls)
  union all
  select c.conv_id, c.call_id, d.level + 1 from calls c join depth d on c.parent_id = d.call_id
), checked as (
  select *, ['answer', 'lookup', 'measure'][tool + 1] as name,
         case tool
           when 0 then '{"n_words":' || w || ',"text":' || to_json(text) || '}'
           when 1 then '{"limit":' || n || ',"query":' || to_json(text) || '}'
           else case how
             when 0 then '{"size":"' || n || '","unit":"char"}'
             when 1 then '{"size":' || n || ',"unit":"byte"}'
             when 2 then '{"size":' || n || ',"text":' || to_json(text) || '}'
             else '{"size":' || n || ',"unit":"char"}' end end as args,
         case tool
           when 0 then case when w > 150 then 'range:n_words' else '' end
           when 1 then case when n > 1000 or n < 1 then 'range:limit' else '' end
           else case how when 0 then 'type:size' when 1 then 'choice:unit'
             when 2 then 'missing:unit,unknown:text' else '' end end as errors
  from calls
), linked as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id,
         d.level, c.name, c.args, c.parent_id, coalesce(c.errors, '') as errors, r.content,
         cast(c.call_id is not null as bigint) as n_calls,
         cast(r.call_id is not null as bigint) as n_results,
         case when c.call_id is null then 'orphan_result' when c.errors <> '' then 'invalid'
              when r.call_id is null then 'no_result' else 'ok' end as status
  from checked c full join results r on c.conv_id = r.conv_id and c.call_id = r.call_id
  left join depth d on d.call_id = c.call_id
)
select conv_id, call_id, level, status, errors, n_calls, n_results,
       '{"arguments":' || coalesce(args, 'null') || ',"call_id":"' || call_id || '","errors":['
       || case when errors = '' then '' else '"' || replace(errors, ',', '","') || '"' end
       || '],"level":' || coalesce(cast(level as varchar), 'null')
       || ',"name":' || coalesce('"' || name || '"', 'null')
       || ',"parent":' || coalesce('"' || parent_id || '"', 'null')
       || ',"result":' || coalesce(cast(to_json(content) as varchar), 'null')
       || ',"status":"' || status || '"}' as record
from linked
"""

QUERIES = {"op1_tool_calls": op1_tool_calls}
ORACLE = {"op1_tool_calls": OP1_SQL}
