"""Fixed values. They must equal the contract of the logs, so they stand here as plain text."""

# Ratings a judge may give, best first, and the score each one counts for.
RATINGS = ("meets", "partial", "misses")
RATING_SCORES = {"meets": 1.0, "partial": 0.5, "misses": 0.0}

# Spellings that judges use for the ratings.
RATING_ALIASES = {
    "meets": "meets",
    "partial": "partial",
    "partially meets": "partial",
    "misses": "misses",
    "does not meet": "misses",
}

# Evaluation methods and statuses of the contract.
JUDGE_METHOD = "judge"
SCORER_METHOD = "repoqa-scorer"
METHODS = (JUDGE_METHOD, SCORER_METHOD)
EVALUATION_STATUSES = ("evaluated", "partial", "error", "skipped")
CONTRACT_VERSION = 2

# Behaviour terms, searched in lower-cased text with single spaces.
BEHAVIOUR_TERMS = {
    "no_information": [
        "não há informação", "não existem informações", "não existe informação",
        "não consta", "não aparece", "sem informação suficiente", "sem informações suficientes",
        "sem dados suficientes", "sem evidência suficiente", "o contexto não informa",
        "o contexto não indica", "o contexto não traz", "o contexto não fornece",
        "the context does not provide", "the context does not state", "the context does not indicate",
        "no information available", "no information provided", "no evidence available",
        "no evidence provided", "insufficient information", "insufficient evidence", "insufficient data",
    ],
    "not_found": [
        "não encontrei", "não foi possível encontrar", "não localizei", "não foi encontrada",
        "não foi encontrado", "not found", "could not find", "i could not find", "was not found",
    ],
    "tool_limitation": [
        "ferramenta", "tool", "function", "mcp", "não consegui acessar",
        "não tenho acesso", "access to", "returned no", "failed to",
    ],
    "uncertainty_marker": [
        "talvez", "parece", "aparentemente", "possivelmente", "provavelmente",
        "não é possível afirmar", "may", "might", "appears", "seems", "probably",
        "possibly", "it is not possible to state",
    ],
}
CONTEXT_TERMS = ["contexto", "context", "lattes", "currículo", "curriculo", "curriculum"]

# File names that hold the representations of a context.
CONTEXT_FILES = {
    "html": "clean.html",
    "raw_html": "raw.html",
    "cleaned_html": "clean.html",
    "clean_html": "clean.html",
    "json": "parsed.json",
    "parsed_json": "parsed.json",
    "blocks": "blocks.json",
}
CODE_CONTEXT_FILES = {
    "code": "code_context.txt",
    "code_context": "code_context.txt",
    "text": "code_context.txt",
    "json": "parsed.json",
    "parsed": "parsed.json",
    "parsed_json": "parsed.json",
    "blocks": "blocks.json",
    "oracle": "oracle.json",
}

# Prefix that some servers put before a tool name.
TOOL_NAME_PREFIX = "copa_lattes_"

# Names of the nested parts of a curriculum.
SUPERVISION_LEVELS = ("masters", "doctoral", "undergraduate", "specialization", "others")
ACTIVITY_LISTS = (
    "reviewerRoles", "editorialBoards", "eventParticipations",
    "eventOrganizations", "defenseBoards", "otherBoards",
)

# Column names of old logs, refused on sight.
LEGACY_COLUMNS = ("runId", "questionId", "answer", "question")

# Programming languages of a corpus: accepted spellings and short names.
LANGUAGE_ALIASES = {
    "py": "python",
    "python": "python",
    "java": "java",
    "js": "javascript",
    "javascript": "javascript",
    "ts": "typescript",
    "typescript": "typescript",
    "go": "go",
    "golang": "go",
    "rs": "rust",
    "rust": "rust",
}
LANGUAGE_SHORT_NAMES = {
    "python": "py",
    "java": "java",
    "javascript": "js",
    "typescript": "ts",
    "go": "go",
    "rust": "rs",
}
HASH_COMMENT_LANGUAGES = ("python", "ruby", "shell", "bash")

# Fields of the detail of one trial, in the order of the contract.
DETAIL_FIELDS = (
    "trialId", "experimentId", "taskId", "instanceId", "strategy", "configurationId", "representation", "surface",
    "repeatIndex", "taskTags", "status", "errorMessage", "response", "timing", "usage", "metricsSummary", "parameters", "metadata",
)

# Dimensions and files that the manifest of a metrics run names.
CORE_DIMENSIONS = ("effectiveness", "efficiency", "robustness", "evaluation_reliability", "observability")
METRIC_OUTPUTS = (
    "trial_metrics.csv", "aggregate_metrics.csv", "dimension_summary.csv", "failure_cases.csv", "dimensions/effectiveness.csv",
    "dimensions/efficiency.csv", "dimensions/robustness.csv", "dimensions/evaluation_reliability.csv",
    "dimensions/observability.csv", "summary.json", "metrics-manifest.json",
)
