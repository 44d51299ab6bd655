"""Trace documents: tool calls, activation, features, counters (RSH-5, AGG-15, AGG-24..25, AGG-30, AGG-37, WIN-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscape import fixed
from trialscape.functions.scalar import pct, strip_prefix, variant_array, variant_kind, variant_number
from trialscape.sources.traces import payload

_CALL = "struct<tool_name:string,tool_source:string,arguments:string>"


def _name(call: Column, *paths: str) -> Column:
    found = F.coalesce(*[F.nullif(F.try_variant_get(call, p, "string"), F.lit("")) for p in paths])
    return strip_prefix(found, fixed.TOOL_NAME_PREFIX)


def _call(name: Column, source: str, args: Column) -> Column:
    """Arguments as JSON with sorted keys, at most 500 characters."""
    text = F.when(~F.is_variant_null(args), F.substring(F.to_json(args), 1, 500))
    return F.struct(name.alias("tool_name"), F.lit(source).alias("tool_source"), text.alias("arguments")).cast(_CALL)


def _list(v: Column, path: str) -> Column:
    return F.coalesce(variant_array(v, path), F.array().cast("array<variant>"))


def _args(call: Column) -> Column:
    return F.try_variant_get(call, "$.arguments", "variant")


def calls_of(trace: Column) -> Column:
    """RSH-5: the calls of a trace from five places, named ones only, in order."""
    def plain(path: str, source: str, *names: str) -> Column:
        return F.transform(_list(trace, path), lambda c: _call(_name(c, *names), source, _args(c)))

    def of_event(e: Column) -> Column:
        kind = F.coalesce(
            F.nullif(F.try_variant_get(e, "$.name", "string"), F.lit("")), F.try_variant_get(e, "$.type", "string")
        )
        meta = F.try_variant_get(e, "$.metadata", "variant")
        own = _call(_name(meta, "$.toolName", "$.name", "$.server_event.toolName"), "aiTrace.events:mcp.tool_call", _args(meta))
        called = F.when(kind == "mcp.tool_call", F.array(own)).otherwise(F.array().cast(f"array<{_CALL}>"))
        native = F.transform(
            _list(meta, "$.native_mcp.visibleToolCalls"),
            lambda c: _call(_name(c, "$.name", "$.toolName"), "aiTrace.events:native_mcp", _args(c)),
        )
        return F.concat(called, native)

    parts = F.concat(
        plain("$.toolCalls", "trace.toolCalls", "$.name", "$.toolName"),
        plain("$.nativeMcp.visibleToolCalls", "trace.nativeMcp.visibleToolCalls", "$.name", "$.toolName"),
        plain("$.serverMcp", "trace.serverMcp", "$.toolName", "$.name"),
        F.flatten(F.transform(_list(trace, "$.aiTrace.events"), of_event)),
    )
    return F.filter(parts, lambda c: F.coalesce(F.length(c["tool_name"]), F.lit(0)) > 0)


def _distinct_calls(traces: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with ``__c``, the distinct calls of a trace as text: the name behind its length, then the rest as
    JSON. Spark makes texts distinct by hash and not by pairs; the name is cut off without parsing."""
    rest = lambda c: F.to_json(F.struct(c["tool_source"], c["arguments"]))
    text = lambda c: F.concat(F.length(c["tool_name"]).cast("string"), F.lit(":"), c["tool_name"], rest(c))
    return (
        traces.where(F.col("body").isNotNull())
        .select(*columns, payload(F.col("body")).alias("__t"))
        .select(*columns, F.array_distinct(F.transform(calls_of(F.col("__t")), text)).alias("__c"))
    )


def _cut_name() -> tuple[Column, Column]:
    """The name of a call's text and what follows it."""
    c, length = F.col("__c"), F.substring_index("__c", ":", 1)
    first = F.length(length) + 2
    return F.substring(c, first, length.cast("int")), F.substring(c, first + length.cast("int"), F.length(c))


def tool_events(traces: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """RSH-5, SET-5, WIN-6: one row per distinct call of a trace with its 1-based position."""
    columns = keep or ["trialId"]
    name, rest = _cut_name()
    return (
        _distinct_calls(traces, columns)
        .select(*columns, F.posexplode("__c").alias("call_index", "__c"))
        .select(
            *columns, (F.col("call_index") + 1).cast("long").alias("call_index"), name.alias("tool_name"),
            F.from_json(rest, "tool_source string, arguments string").alias("__c"),
        )
        .select(*columns, "call_index", "tool_name", "__c.*")
    )


def tool_names(traces: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The names of :func:`tool_events` alone, for counting: arguments only tell calls apart."""
    columns = keep or ["trialId"]
    return _distinct_calls(traces, columns).select(*columns, F.explode("__c").alias("__c")).select(
        *columns, _cut_name()[0].alias("tool_name")
    )


def without_inline(runs: DataFrame) -> DataFrame:
    return runs.where(~F.col("strategy").eqNullSafe("inline"))


def events_by_entity(events: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """JON-6: calls with each entity (task or tag) of their trial."""
    pairs = entities.select("trialId", entity, "modelId", "configurationId").distinct()
    return events.join(pairs, "trialId", "inner").where(F.col(entity).isNotNull())


def tool_activation(events: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """AGG-30, JON-7: per entity, model, configuration and tool the trials that used it, the calls and
    the share of all trials of the cell."""
    cell = [entity, "modelId", "configurationId"]
    runs = entities.groupBy(*cell).agg(F.count_distinct("trialId").alias("total_runs"))
    # a trial's calls are counted before they meet its entities, so a trial is once in a cell
    counted = events.groupBy("trialId", "tool_name").agg(F.count("tool_name").alias("calls"))
    used = events_by_entity(counted, entities, entity).groupBy(*cell, "tool_name").agg(
        F.count(F.lit(1)).alias("runs_with_tool"), F.sum("calls").alias("tool_calls")
    )
    return used.join(runs, cell, "left").withColumns(
        {
            "activation_rate_pct": pct(F.col("runs_with_tool"), F.col("total_runs")),
            "tool_label": F.concat_ws(" / ", "configurationId", "tool_name"),
        }
    )


def _present(t: Column, path: str) -> Column:
    value = F.try_variant_get(t, path, "variant")
    return value.isNotNull() & ~F.is_variant_null(value)


def trace_features(traces: DataFrame) -> DataFrame:
    """AGG-37 for execution traces (payload below ``trace``)."""
    t = F.try_variant_get(F.col("body"), "$.trace", "variant")
    size = lambda p: F.size(_list(t, p)).cast("long")
    native = F.coalesce(variant_number(t, "$.nativeMcp.visibleToolCallCount").cast("long"), size("$.nativeMcp.visibleToolCalls"))
    return traces.select(
        "trialId",
        F.col("body").isNotNull().alias("trace_query_exists"),
        F.coalesce(_present(t, "$.error"), F.lit(False)).alias("trace_query_error_present"),
        native.alias("trace_native_mcp_visible_count"),
        (native > 0).alias("trace_native_mcp_has_visible_calls"),
        size("$.serverMcp").alias("trace_server_mcp_count"),
        size("$.toolCalls").alias("trace_tool_call_count"),
    )


def eval_trace_features(traces: DataFrame) -> DataFrame:
    """AGG-37 for evaluation traces."""
    t = F.try_variant_get(F.col("body"), "$.trace", "variant")
    raw = _list(t, "$.rawResponse")
    bad = ("failed", "errored", "incomplete")
    count = lambda items, test: F.size(F.filter(items, test)).cast("long")
    return traces.select(
        "trialId",
        F.col("body").isNotNull().alias("trace_eval_exists"),
        F.coalesce(_present(t, "$.error"), F.lit(False)).alias("trace_eval_top_error_present"),
        F.size(raw).cast("long").alias("trace_eval_raw_response_count"),
        count(raw, lambda r: _present(r, "$.error")).alias("trace_eval_raw_error_count"),
        count(raw, lambda r: F.try_variant_get(r, "$.status", "string").isin(*bad)).alias("trace_eval_status_error_count"),
        count(_list(t, "$.aiTrace.judges"), lambda j: _present(j, "$.error")).alias("trace_eval_judge_error_count"),
    )


def instrumentation_gap(responses: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """AGG-24: reported tool calls next to those visible in traces, per configuration. Without
    features the trace columns are null."""
    zero = F.lit(0.0)
    reported = [
        F.count("trialId").alias("runs"),
        F.coalesce(F.sum("toolCalls"), zero).alias("reported_toolCalls_sum"),
        F.coalesce(F.sum("mcpToolCalls"), zero).alias("reported_mcpToolCalls_sum"),
    ]
    if features is None:
        table = responses.groupBy("configurationId").agg(*reported)
        nothing = F.lit(None).cast("long")
        return table.withColumns(
            {
                "trace_native_mcp_visible_sum": nothing, "trace_native_mcp_visible_runs": nothing,
                "trace_tool_call_sum": nothing, "query_trace_error_runs": nothing,
                "native_mcp_visible_runs_pct": F.lit(None).cast("double"), "trace_scan_enabled": F.lit(False),
            }
        )
    table = responses.join(features, "trialId", "left").groupBy("configurationId").agg(
        *reported,
        F.coalesce(F.sum("trace_native_mcp_visible_count"), F.lit(0)).alias("trace_native_mcp_visible_sum"),
        F.count_if("trace_native_mcp_has_visible_calls").alias("trace_native_mcp_visible_runs"),
        F.coalesce(F.sum("trace_tool_call_count"), F.lit(0)).alias("trace_tool_call_sum"),
        F.count_if("trace_query_error_present").alias("query_trace_error_runs"),
    )
    return table.withColumns(
        {
            "native_mcp_visible_runs_pct": pct(F.col("trace_native_mcp_visible_runs"), F.col("runs")),
            "trace_scan_enabled": F.lit(True),
        }
    )


def eval_trace_summary(evals: DataFrame, features: DataFrame) -> DataFrame:
    """AGG-25."""
    joined = evals.select("trialId", "judgeErrorCount").join(features, "trialId", "left")
    positive = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(0)) > 0)
    return joined.agg(
        F.lit(True).alias("trace_scan_enabled"),
        F.count(F.lit(1)).alias("eval_rows_scanned"),
        positive("judgeErrorCount").alias("reported_judge_error_rows"),
        F.count_if("trace_eval_top_error_present").alias("trace_top_error_rows"),
        positive("trace_eval_raw_error_count").alias("trace_raw_error_rows"),
        positive("trace_eval_status_error_count").alias("trace_status_error_rows"),
        positive("trace_eval_judge_error_count").alias("trace_judge_error_rows"),
    )


EVENT_NUMBERS = {
    "input_tokens": "$.input_tokens", "output_tokens": "$.output_tokens", "total_tokens": "$.total_tokens",
    "cached_input_tokens": "$.cached_input_tokens", "cache_read_input_tokens": "$.cache_read_input_tokens",
    "cache_creation_input_tokens": "$.cache_creation_input_tokens", "reasoning_tokens": "$.reasoning_tokens",
    "steps": "$.steps", "estimated_input_tokens": "$.estimated_input_tokens",
    "estimated_output_tokens": "$.estimated_output_tokens", "reserved_tokens": "$.reserved_tokens",
}


def explode_events(traces: DataFrame) -> DataFrame:
    """Ordered events of ``aiTrace`` with the numbers of their metadata."""
    t = payload(F.col("body"))
    rows = traces.select("trialId", F.posexplode(_list(t, "$.aiTrace.events")).alias("pos", "e"))
    e = F.col("e")
    return rows.select(
        "trialId", "pos",
        F.try_variant_get(e, "$.type", "string").alias("type"),
        F.try_variant_get(e, "$.name", "string").alias("name"),
        variant_number(e, "$.duration_ms").alias("duration_ms"),
        *[variant_number(e, p.replace("$.", "$.metadata.")).alias(n) for n, p in EVENT_NUMBERS.items()],
    )


def metrics_from_events(events: DataFrame, strategies: DataFrame | None = None) -> DataFrame:
    """AGG-15: counters of a trial from its events. Sums without a value stay null, counts start at 0,
    the last span or reservation wins. ``strategies`` (trialId, strategy) zeroes tool counters of
    inline trials."""
    kind = F.col("type")
    model, wait, sleep = kind == "model.generate", kind == "rate_limit.wait", kind == "retry.sleep"
    when = lambda cond, c: F.when(cond, F.col(c))
    total = lambda cond, c: F.sum(when(cond, c))
    last = lambda cond, c: F.max_by(when(cond, c), when(cond, "pos"))
    estimated = F.when(model & F.col("total_tokens").isNull(), F.col("input_tokens") + F.col("output_tokens"))
    whole = F.col("name").isin("engine.execute", "engine.execute_model_input")
    strategy = F.col("name").isin(*[f"strategy.{s}.execute" for s in ("inline", "local_function", "local_mcp", "remote_mcp")])
    reserve = kind == "rate_limit.reserve"
    calls = F.count_if(kind == "mcp.tool_call")
    table = events.groupBy("trialId").agg(
        last(whole, "duration_ms").alias("totalDurationMs"),
        last(strategy, "duration_ms").alias("strategyDurationMs"),
        total(model, "duration_ms").alias("modelDurationMs"),
        total(kind == "mcp.tool_result", "duration_ms").alias("toolDurationMs"),
        F.count_if(model).alias("modelCalls"),
        calls.alias("toolCalls"), calls.alias("mcpToolCalls"), calls.alias("functionCalls"),
        F.greatest(F.lit(0.0), F.max("steps")).alias("steps"),
        F.count_if(kind == "retry.attempt").alias("retryCount"),
        total(model, "input_tokens").alias("inputTokens"),
        total(model, "output_tokens").alias("outputTokens"),
        total(model, "total_tokens").alias("totalTokens"),
        F.sum(estimated).alias("totalTokensEstimated"),
        total(model, "cached_input_tokens").alias("cachedInputTokens"),
        total(model, "cache_read_input_tokens").alias("cacheReadInputTokens"),
        total(model, "cache_creation_input_tokens").alias("cacheCreationInputTokens"),
        total(model, "reasoning_tokens").alias("reasoningTokens"),
        last(reserve, "estimated_input_tokens").alias("estimatedInputTokens"),
        last(reserve, "estimated_output_tokens").alias("estimatedOutputTokens"),
        last(reserve, "reserved_tokens").alias("reservedTokens"),
        total(wait, "duration_ms").alias("rateLimitWaitMs"),
        total(sleep, "duration_ms").alias("retrySleepMs"),
    )
    left = F.col("strategyDurationMs") - F.coalesce("modelDurationMs", F.lit(0.0))
    rest = left - F.coalesce("toolDurationMs", F.lit(0.0))
    floor0 = lambda c: F.when(F.col("strategyDurationMs").isNotNull(), F.greatest(F.lit(0.0), c))
    table = table.withColumns(
        {"benchmarkDurationMsEstimated": floor0(left), "loopControlDurationMsEstimated": floor0(rest)}
    )
    if strategies is None:
        return table
    inline = F.col("strategy").eqNullSafe("inline")
    joined = table.join(strategies.select("trialId", "strategy"), "trialId", "left")
    zeroed = {c: F.when(inline, F.lit(0)).otherwise(F.col(c)) for c in ("toolCalls", "functionCalls", "mcpToolCalls")}
    zeroed["toolDurationMs"] = F.when(inline, F.lit(0.0)).otherwise(F.col("toolDurationMs"))
    return joined.withColumns(zeroed).drop("strategy")


def trace_kind(body: Column) -> Column:
    return variant_kind(body, "$")
