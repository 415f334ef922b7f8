"""Results depend on every one of them."""

# Words that carry no meaning of their own, a closed list.
STOPWORDS = tuple(
    """about above after against all also an and any are as at be been before being below between both
    but by can do does each either for from further had has have if in into is it its may more most must
    no nor not of off on once only or other our out over own per same should so some such than that the
    their them then there these they this those through to too under until up use used using very was we
    were what when where which while who will with would you your""".split()
)

# Phrases that say when to reach for a tool.
WHEN_TO_USE = (
    "use this when", "use when", "use this tool when", "use this for", "use it when", "useful when", "useful for",
    "call this when", "call this tool", "when you need", "when the user", "if you need", "only use", "do not use",
    "don't use", "avoid using", "instead of", "prefer this", "rather than", "unlike", "for cases where",
    "in cases where", "should be used", "this tool is for",
)

# Phrases by which a final message declines.
REFUSALS = (
    "can't", "cannot", "can not", "unable to", "not able to", "don't have access", "do not have access",
    "no access to", "not permitted", "not allowed", "don't have permission", "do not have permission",
    "i'm sorry", "i am sorry", "i apologize", "isn't available", "is not available", "unavailable", "no tools",
    "no such tool", "tool is not",
)

# Parts of error texts, in the order in which classes are tried.
UNREACHABLE = (
    "executable file not found", "no such file or directory", "connection refused", "no such host",
    "closed stdout before responding", "broken pipe", "file already closed", "network is unreachable", "launch ",
)
TIMEOUT = ("timeout", "deadline exceeded")
AUTH = ("unauthorized", "unauthenticated", "forbidden", "invalid api key", "invalid token", "authentication")

# BM25.
K1, B = 1.2, 0.75
TOP_K = 3
MOST_QUERY_WORDS, LEADING_WORDS = 12, 3

# Hygiene.
SIMILAR = 0.60
GRADES = ((90.0, "A"), (75.0, "B"), (60.0, "C"), (40.0, "D"))
LAST_GRADE = "F"
DESCRIPTION_LENGTH = (20, 1000)
SENTENCE_WORDS = 4
SCHEMA_DEPTH = 12

# Client modes.
STUB_TOKENS, CODE_TOKENS = 500, 1000
K_RANGE = (3, 5)
MIDDLE_K = 4
WINDOW_TOKENS = 200_000

# Canonical form.
TOOL_FIELDS = ("name", "title", "description", "inputSchema", "outputSchema", "annotations", "icons", "_meta")
REF_DEPTH, REF_NODES, REF_SECONDS = 32, 20_000, 5.0

# Flags of references that stay, in the order in which they are listed.
EXTERNAL_REF = "external_ref_unresolvable"
RECURSIVE_REF = "recursive_ref_unresolved"
REF_BOUND = "ref_resolution_bound_exceeded"
BAD_POINTER = "internal_ref_unresolvable"
REF_FLAGS = (EXTERNAL_REF, RECURSIVE_REF, REF_BOUND, BAD_POINTER)

# Analysis of frame logs.
MOST_WARNINGS = 50
UNMATCHED = "(unmatched)"

# Texts of the warnings about a frame log, in printf form.
BAD_LINE = "line %d: not valid JSON, skipped"
ODD_LINE = "line %d: neither a header nor a frame, skipped"
ODD_DIRECTION = "line %d: unknown direction \"%s\""
ODD_MESSAGE = "line %d: message carries neither a method nor a response payload"
REUSED_ID = "line %d: request id %s reused before the earlier one was answered"
LOST_RESPONSE = "line %d: response id %s has no logged request"
NO_RESULT_TOKENS = (
    "result tokens unavailable: %d of %d tool-call responses carry result_full; rerun the interposer with --full-results to measure them"
)
MIXED_VERSIONS = "log carries %d interposer versions ([%s]); frames from different versions are not comparable and this report is not publishable"
NO_HEADER = "log has no header line, so interposer_version is unknown; section 5 withholds a result missing a version stamp"
MANY_SESSIONS = "log contains %d sessions; one log per trial is the section 6 convention"
MORE_WARNINGS = "%d further warnings suppressed"

# Texts of launch, credential and listing outcomes.
ONLY_SSE = "only the deprecated HTTP+SSE transport is declared, which the harness does not support"
NO_LAUNCH = "acquisition spec unresolved in the corpus"
NO_VARIABLE = "credential required but the corpus declares no env var convention"
UNSET_VARIABLE = "credential required but %s is not set"
NO_LISTING = "no dependency listing found in %d lines of output"
BAD_LISTING = "dependency listing carried a malformed entry: [%s]"

# Environment that a launch inherits.
INHERITED = (
    "PATH", "HOME", "USER", "LANG", "LC_ALL", "TMPDIR", "SHELL", "XDG_CACHE_HOME", "XDG_DATA_HOME", "NODE_PATH",
    "NPM_CONFIG_CACHE", "UV_CACHE_DIR",
)

# An input schema that stands for none.
EMPTY_SCHEMA = '{"type":"object","properties":{}}'

# Sources.
MOST_PAGES = 200
MOST_LINE_BYTES = 64 << 20
NEGOTIATE = -32022

# Tasks whose success is read from the transcript, and the servers of tasks by the letters they begin with.
TRANSCRIPT_TASKS = ("FS-01", "FS-02", "PW-01", "PW-02", "PW-03", "PW-04", "GH-01", "GH-02", "GH-05")
TASK_SERVERS = {"FS": "filesystem", "PW": "playwright", "GH": "github"}

# Why a server is left out of a total, in printf form.
NO_DATA = "no data (%s %s)"
NO_MEASUREMENT = "no %s measurement (pending)"
NO_SEARCH_MODEL = "no tool-search model (pending)"
NO_CODE_MODEL = "no code-mode model (pending)"

# How what a launch resolves is listed, what it looks for, and why nothing is listed.
BY_UVX, BY_NPX, BY_IMAGE, NOT_LISTED = "uvx_importlib_metadata", "npx_node_modules_walk", "container_image", "not_applicable"
NPM_SDK, PYPI_SDK = "@modelcontextprotocol/sdk", "mcp"
DEPS_NOTES = {
    "container_image": "the image is the dependency pin: its layers ship the resolved dependencies, so nothing is resolved at acquisition time. acquisition.pinned reports whether the image reference is a digest rather than a mutable tag",
    "not_applicable/remote": "remote transport: nothing is resolved locally, and the protocol exposes no dependency set for the server behind the endpoint",
    "not_applicable/binary": "binary launch: the command is already on the machine and no resolver runs at acquisition time",
}
