"""SQL of the derived run logs, shared by the statements of the other areas."""

from __future__ import annotations

from trialscape.mart.registry import cte

cte("x_trials", """
SELECT CAST(o_orderkey AS VARCHAR) AS trialId, o_orderkey AS k,
  'exp-' || (o_orderkey % 4) AS experimentId, lower(r_name) AS dataset_id, 'v1' AS dataset_version,
  'i' || c_nationkey AS instanceId, o_orderpriority AS taskId,
  'State of order ' || o_orderkey || '?' AS taskStatement,
  'State of order {order} of {segment} in {year}?' AS taskTemplate,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN ['urgent','service']
       WHEN o_orderpriority = '3-MEDIUM' THEN ['standard']
       WHEN o_orderpriority = '5-LOW' THEN ['backlog','service'] ELSE []::VARCHAR[] END AS tags,
  CASE WHEN o_orderpriority = '5-LOW' THEN ['b1'] ELSE ['b1','b2'] END AS contextBlocks,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'north' ELSE 'south' END AS provider,
  c_mktsegment AS modelId, lower(c_mktsegment) || '-v1' AS modelName,
  CASE o_orderstatus WHEN 'F' THEN 'inline' WHEN 'O' THEN 'local_function' ELSE 'remote_mcp' END AS strategy,
  CASE o_orderstatus WHEN 'F' THEN 'html' ELSE 'json' END AS representation,
  CASE o_orderstatus WHEN 'F' THEN 'page' ELSE 'ops' END AS surface,
  'cfg-' || o_orderstatus AS configurationId, CAST(o_orderkey % 3 + 1 AS INTEGER) AS repeatIndex,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'repoqa-scorer' ELSE 'judge' END AS validationType
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")

cte("x_log", """
SELECT CAST(l_orderkey AS VARCHAR) AS trialId,
  CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN l_returnflag <> 'R' THEN repeat('part ' || l_partkey || ' from supplier ' || l_suppkey || ' costs '
     || CAST(floor(l_extendedprice) AS BIGINT) || '. ', l_linenumber * 2) END AS response,
  CASE WHEN l_returnflag = 'R' THEN 'returned' END AS errorMessage,
  CASE WHEN l_linestatus = 'F' THEN 'traces/executions/' || l_orderkey || '.json' END AS traceRef,
  floor(l_extendedprice) AS price, l_linenumber AS line, l_quantity AS qty,
  CASE WHEN l_linenumber <> 7 THEN floor(l_extendedprice) END AS totalDurationMs,
  floor(floor(l_extendedprice) / 2) AS modelDurationMs,
  CAST(CASE WHEN l_linenumber > 2 THEN l_linenumber * 10 END AS DOUBLE) AS toolDurationMs,
  CAST(l_linenumber AS DOUBLE) AS modelCalls,
  CAST(CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END AS DOUBLE) AS toolCalls,
  CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS DOUBLE) AS functionCalls,
  CAST(CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS DOUBLE) AS mcpToolCalls,
  CAST(l_linenumber + 1 AS DOUBLE) AS steps,
  CASE WHEN l_linenumber <> 6 THEN floor(l_quantity * 3 / 4) END AS inputTokens,
  l_quantity - floor(l_quantity * 3 / 4) AS outputTokens,
  CASE WHEN l_linenumber <> 6 THEN l_quantity END AS totalTokens,
  floor(l_quantity / 4) AS cachedInputTokens, l_quantity + 10 AS reservedTokens,
  floor(l_quantity * 3 / 4) AS u_input, CASE WHEN l_linenumber <> 5 THEN l_quantity END AS u_total,
  CAST(l_partkey % 7 AS DOUBLE) AS reasoningTokens,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS startedAt,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC,
     l_suppkey DESC, l_extendedprice DESC) AS back
FROM lineitem""")

cte("x_last", "SELECT * FROM x_log WHERE back = 1")

cte("x_votes", """
SELECT CAST(l_orderkey AS VARCHAR) AS trialId, 'judge' || (l_suppkey % 3) AS judgeId,
  'jp' || (l_suppkey % 2) AS provider, 'jm' || (l_suppkey % 3) AS model,
  CASE WHEN l_linenumber = 6 THEN 'error' END AS status, CASE WHEN l_linenumber = 6 THEN 'timeout' END AS error,
  CASE WHEN l_discount < 0.035 THEN 'meets' WHEN l_discount < 0.065 THEN 'partial' ELSE 'misses' END AS correctness,
  CASE WHEN l_tax < 0.025 THEN 'meets' WHEN l_tax < 0.055 THEN 'partial' ELSE 'misses' END AS completeness,
  'line ' || l_linenumber AS justification, CAST(l_partkey % 100 AS DOUBLE) AS inputTokens,
  CAST(CASE WHEN l_linenumber <> 5 THEN l_suppkey % 10 END AS DOUBLE) AS outputTokens,
  CAST(CASE WHEN l_linenumber <> 5 THEN l_partkey % 100 + l_suppkey % 10 END AS DOUBLE) AS totalTokens,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS DOUBLE) AS durationMs,
  row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_shipdate DESC, l_linenumber DESC,
     l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS back,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber = 6, l_shipdate, l_linenumber,
     l_partkey, l_suppkey, l_extendedprice) AS firstValid
FROM lineitem""")

cte("x_lastvotes", "SELECT * FROM x_votes WHERE back = 1")

cte("x_long", """
SELECT trialId, judgeId, error, back, inputTokens, totalTokens, durationMs, justification, 'correctness' AS criterion, correctness AS rating FROM x_votes
UNION ALL
SELECT trialId, judgeId, error, back, inputTokens, totalTokens, durationMs, justification, 'completeness', completeness FROM x_votes""")

cte("x_plural", """
SELECT trialId, criterion, arg_min(rating, (-n, CASE rating WHEN 'meets' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END)) AS rating,
  max(n) * 2 > sum(n) AS agreement
FROM (SELECT trialId, criterion, rating, count(*) AS n FROM x_long WHERE back = 1 AND error IS NULL GROUP BY ALL)
GROUP BY trialId, criterion""")

cte("x_outcome", """
SELECT trialId,
  max(rating) FILTER (criterion = 'correctness') AS correctness, bool_or(agreement) FILTER (criterion = 'correctness') AS c_agree,
  max(rating) FILTER (criterion = 'completeness') AS completeness, bool_or(agreement) FILTER (criterion = 'completeness') AS k_agree
FROM x_plural GROUP BY trialId""")

cte("x_counts", """
SELECT trialId, count(*) FILTER (error IS NULL) AS judge_count, count(*) FILTER (error IS NOT NULL) AS judge_error_count,
  sum(inputTokens) AS ev_in, sum(outputTokens) AS ev_out, sum(durationMs) AS ev_ms
FROM x_lastvotes GROUP BY trialId""")

cte("x_evals", """
SELECT t.*, l.qty,
  CASE WHEN k % 50 = 0 THEN 'skipped' WHEN validationType = 'repoqa-scorer' THEN 'evaluated'
       WHEN coalesce(judge_count, 0) = 0 THEN 'error' WHEN judge_error_count > 0 THEN 'partial' ELSE 'evaluated' END AS ev_status,
  validationType = 'judge' AS judged,
  CASE WHEN validationType = 'judge' THEN CAST(coalesce(judge_count, 0) AS DOUBLE) END AS judgeCount,
  CASE WHEN validationType = 'judge' THEN CAST(coalesce(judge_error_count, 0) AS DOUBLE) END AS judgeErrorCount,
  CASE WHEN validationType = 'judge' THEN correctness END AS correctness, CASE WHEN validationType = 'judge' THEN c_agree END AS c_agree,
  CASE WHEN validationType = 'judge' THEN completeness END AS completeness, CASE WHEN validationType = 'judge' THEN k_agree END AS k_agree,
  CASE WHEN validationType = 'judge' THEN ev_in END AS evaluationInputTokens,
  CASE WHEN validationType = 'judge' THEN ev_out END AS evaluationOutputTokens,
  CASE WHEN validationType = 'judge' AND (ev_in IS NOT NULL OR ev_out IS NOT NULL)
       THEN coalesce(ev_in, 0) + coalesce(ev_out, 0) END AS evaluationTotalTokens,
  CASE WHEN validationType = 'judge' THEN ev_ms END AS evaluationDurationMs,
  CASE WHEN k % 4 = 0 THEN 'traces/evals/' || trialId || '.json' END AS ev_trace,
  CASE WHEN validationType <> 'judge' THEN l.qty >= 25 END AS passed,
  CASE WHEN validationType <> 'judge' THEN l.qty / 64.0 END AS similarity
FROM x_trials t JOIN (SELECT trialId, qty FROM x_last WHERE status = 'success') l USING (trialId)
LEFT JOIN x_outcome USING (trialId) LEFT JOIN x_counts USING (trialId)""")

cte("x_spread", """
SELECT trialId, count(*) AS n_votes, count(*) FILTER (error IS NULL) AS n_valid,
  count(DISTINCT correctness || '/' || completeness) FILTER (error IS NULL) = 1 AS one
FROM x_votes GROUP BY trialId""")

_SCORE = "CASE {} WHEN 'meets' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'misses' THEN 0.0 END"

cte("x_facts", f"""
SELECT t.experimentId, t.dataset_id, t.dataset_version, t.trialId, t.instanceId, t.taskId,
  array_to_string(t.tags, '|') AS taskTags, t.provider, t.modelId, t.modelName, t.strategy, t.representation,
  t.surface, t.configurationId, t.repeatIndex,
  r.trialId IS NOT NULL AS response_present, r.status AS execution_status,
  e.trialId IS NOT NULL AS evaluation_present, e.ev_status AS evaluation_status,
  CASE WHEN e.trialId IS NOT NULL THEN e.validationType END AS evaluation_method, true AS evaluation_method_consistent,
  r.inputTokens AS input_tokens, r.outputTokens AS output_tokens, r.totalTokens AS total_tokens,
  r.cachedInputTokens AS cached_input_tokens, CAST(NULL AS DOUBLE) AS cached_read_tokens, r.reservedTokens AS reserved_tokens,
  r.reasoningTokens AS reasoning_tokens, r.totalDurationMs AS duration_ms, r.totalDurationMs / 1000.0 AS duration_sec,
  r.modelDurationMs AS model_duration_ms, r.toolDurationMs AS tool_duration_ms, r.modelCalls AS model_calls,
  r.toolCalls AS tool_calls, r.functionCalls AS function_calls, r.mcpToolCalls AS mcp_tool_calls, r.steps AS steps,
  CASE WHEN e.judged THEN 'judge_meets' WHEN e.trialId IS NOT NULL THEN 'pass' END AS primary_metric_name,
  CASE WHEN e.judged THEN e.correctness = 'meets' AND e.completeness = 'meets' ELSE e.passed END AS primary_success,
  CASE WHEN e.judged THEN CAST(({_SCORE.format('e.correctness')} + {_SCORE.format('e.completeness')}) AS DOUBLE) / 2 ELSE e.similarity END AS primary_score,
  e.evaluationInputTokens AS evaluation_input_tokens, e.evaluationOutputTokens AS evaluation_output_tokens,
  e.evaluationDurationMs AS evaluation_duration_ms, e.judgeCount AS judge_count, e.judgeErrorCount AS judge_error_count,
  CASE WHEN e.judged THEN (CAST(e.c_agree AS DOUBLE) + CAST(e.k_agree AS DOUBLE)) / 2 END AS judge_agreement_mean,
  CASE WHEN e.judged AND s.n_valid >= 2 THEN s.one END AS judge_unanimous,
  (t.k % 5 <> 0 OR r.traceRef IS NOT NULL OR e.ev_trace IS NOT NULL) AS trace_available,
  (t.k % 5 <> 0 OR r.traceRef IS NOT NULL) AS execution_trace_available, e.ev_trace IS NOT NULL AS eval_trace_available,
  r.response IS NOT NULL AS raw_response_available,
  (coalesce(r.toolCalls, r.functionCalls, r.mcpToolCalls) IS NOT NULL OR (t.k % 5 <> 0 AND (t.k % 2 = 0 OR t.k % 4 = 1))) AS tool_calls_observable,
  (coalesce(t.strategy = 'remote_mcp' AND r.mcpToolCalls > 0, false) OR (t.k % 5 <> 0 AND t.k % 3 = 0)) AS native_mcp_observable,
  CASE WHEN t.k % 5 <> 0 THEN t.k % 7 < 3 END AS server_mcp_observable,
  coalesce(r.inputTokens, r.outputTokens, r.totalTokens) IS NOT NULL AS usage_observable,
  (r.errorMessage IS NOT NULL OR (t.k % 5 <> 0 AND t.k % 11 = 0)) AS error_observable,
  r.errorMessage AS error_message,
  CASE WHEN length(r.response) > 280 THEN substr(r.response, 1, 280) || '…' ELSE r.response END AS response_excerpt
FROM x_trials t LEFT JOIN x_last r USING (trialId) LEFT JOIN x_evals e USING (trialId) LEFT JOIN x_spread s USING (trialId)""")
