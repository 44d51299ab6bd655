"""Declared schemas of the logs. Nothing is inferred in jobs.

Counters are DOUBLE: a log may hold whole or fractional numbers, and a string or a
boolean in their place must read as null.
"""

from __future__ import annotations

DATASET = (
    "STRUCT<id: STRING, version: STRING, origin: STRING, resolvedRevision: STRING, "
    "contentHash: STRING, materializedPath: STRING>"
)
TREATMENT = (
    "STRUCT<canonicalId: STRING, configurationId: STRING, strategy: STRING, "
    "representation: STRING, surface: STRING>"
)
COUNTERS = (
    "totalDurationMs", "strategyDurationMs", "modelDurationMs", "toolDurationMs",
    "benchmarkDurationMsEstimated", "loopControlDurationMsEstimated", "modelCalls", "mcpToolCalls",
    "toolCalls", "functionCalls", "steps", "retryCount", "inputTokens", "outputTokens", "totalTokens",
    "totalTokensEstimated", "cachedInputTokens", "cacheReadInputTokens", "cacheCreationInputTokens",
    "taskStatementTokensEstimated", "estimatedInputTokens", "estimatedOutputTokens", "reservedTokens",
    "contextChars", "contextBytes", "taskStatementChars", "promptChars", "rateLimitWaitMs", "retrySleepMs",
)
SUMMARY = "STRUCT<" + ", ".join(f"{c}: DOUBLE" for c in COUNTERS) + ">"
USAGE = "STRUCT<" + ", ".join(
    f"{c}: DOUBLE"
    for c in (
        "inputTokens", "outputTokens", "totalTokens", "cachedInputTokens",
        "cacheReadInputTokens", "reasoningTokens",
    )
) + ">"

DIMENSIONS = (
    f"trialId STRING, experimentId STRING, dataset {DATASET}, instanceId STRING, taskId STRING, "
    "taskStatement STRING, taskTemplate STRING, taskTags ARRAY<STRING>, contextBlocks ARRAY<STRING>, "
    "provider STRING, modelId STRING, modelName STRING, model STRING, strategy STRING, "
    "representation STRING, surface STRING, configurationId STRING, repeatIndex INT, "
    "validationType STRING, validationConfig MAP<STRING, STRING>, parameters MAP<STRING, STRING>, "
    f"metadata {TREATMENT}"
)
LEGACY = "runId STRING, questionId STRING, answer STRING, question STRING, format STRING"

TRIALS = DIMENSIONS
RESPONSES = (
    f"{DIMENSIONS}, status STRING, response STRING, errorMessage STRING, traceRef STRING, "
    "timing STRUCT<startedAt: STRING, finishedAt: STRING, durationMs: DOUBLE>, "
    f"usage {USAGE}, metricsSummary {SUMMARY}"
)
EVALS = (
    f"trialId STRING, experimentId STRING, dataset {DATASET}, instanceId STRING, taskId STRING, "
    "repeatIndex INT, strategy STRING, representation STRING, surface STRING, configurationId STRING, "
    f"metadata {TREATMENT}, status STRING, evaluationMethod STRING, judgeCount DOUBLE, "
    "judgeErrorCount DOUBLE, outcome STRUCT<correctness: STRUCT<rating: STRING, agreement: VARIANT>, "
    "completeness: STRUCT<rating: STRING, agreement: VARIANT>>, evaluationInputTokens DOUBLE, "
    "evaluationOutputTokens DOUBLE, evaluationTotalTokens DOUBLE, evaluationDurationMs DOUBLE, "
    "contextBlocks ARRAY<STRING>, traceRef STRING, details STRUCT<outcome: STRUCT<passed: BOOLEAN, "
    "reason: STRING>, repoqa: STRUCT<threshold: DOUBLE, bestTarget: STRING, bestSimilarScore: DOUBLE, "
    "passed: BOOLEAN>>"
)
CRITERION = "STRUCT<rating: STRING, justification: STRING>"
JUDGE_VOTES = (
    "trialId STRING, experimentId STRING, instanceId STRING, taskId STRING, surface STRING, "
    "strategy STRING, judgeId STRING, provider STRING, model STRING, status STRING, error STRING, "
    f"criterias STRUCT<correctness: {CRITERION}, completeness: {CRITERION}>, inputTokens DOUBLE, "
    "outputTokens DOUBLE, totalTokens DOUBLE, durationMs DOUBLE, traceRef STRING"
)

ARTIFACTS = {
    "trials": TRIALS,
    "responses": RESPONSES,
    "evals": EVALS,
    "judge_votes": JUDGE_VOTES,
}

MANIFEST = (
    "provisioningArtifactVersion VARIANT, experimentId STRING, "
    "configurations MAP<STRING, STRUCT<strategy: STRING, representation: STRING, surface: STRING>>, "
    "surfaces MAP<STRING, STRUCT<type: STRING, operations: ARRAY<STRING>>>, "
    f"dataset {DATASET}, evaluation STRUCT<enabled: BOOLEAN, judges: ARRAY<STRUCT<provider: STRING, "
    "model: STRING, params: MAP<STRING, STRING>>>>"
)

TASK_CATALOG = (
    "datasetId STRING, version STRING, tasks ARRAY<STRUCT<id: STRING, statement: STRING, "
    "tags: ARRAY<STRING>, validation: STRUCT<type: STRING, threshold: DOUBLE, ignoreComments: BOOLEAN>, "
    "contextBlocks: ARRAY<STRING>, contextBlock: ARRAY<STRING>, question: STRING>>"
)
INSTANCE_CATALOG = (
    "datasetId STRING, version STRING, referenceDate STRING, instances ARRAY<STRUCT<instanceId: STRING, "
    "contextBlocks: STRING, tasks: ARRAY<STRUCT<id: STRING, parameters: MAP<STRING, STRING>>>>>"
)
NEEDLE = (
    "STRUCT<name: STRING, path: STRING, description: STRING, start_line: INT, end_line: INT, "
    "start_byte: INT, end_byte: INT>"
)
REPOSITORY = (
    f"STRUCT<repo: STRING, content: MAP<STRING, STRING>, dependency: MAP<STRING, ARRAY<STRING>>, "
    f"needles: ARRAY<{NEEDLE}>>"
)
CORPUS = f"MAP<STRING, ARRAY<{REPOSITORY}>>"
CORPUS_LINE = (
    "language STRING, repo_ord INT, repo STRING, content MAP<STRING, STRING>, "
    f"dependency MAP<STRING, ARRAY<STRING>>, needles ARRAY<{NEEDLE}>"
)
