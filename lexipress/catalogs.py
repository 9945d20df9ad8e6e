"""Rule catalogs (fixed values) as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Compression symbols, in the order in which they are preferred.
GREEK = [chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2] + [chr(c) for c in range(0x391, 0x3AA) if c != 0x3A2]
MATH = list("∂∇∆∑∏∫√∞≈≠≤≥∀∃∅∈∉∋∧∨∩∪⊂⊃⊆⊇⊕⊗⊥∥∝∴∵∶∷∸")
SUBSCRIPT = [chr(c) for c in range(0x2080, 0x208A)] + list("₊₋₌₍₎ₐ₄₥₦₧")
SUPERSCRIPT = list("⁰¹²³") + [chr(c) for c in range(0x2074, 0x207A)] + list("⁺⁻⁼⁽⁾ⁿⁱ") + [chr(c) for c in range(0x2061, 0x2064)]
BOXES = list("┌┐└┘├┤┬┴┼─│┏┓┗┛┣┫┳┻╋━┃")
ARROWS = list("←→↑↓↔↕⇐⇒⇑⇓⇔⇕↖↗↘↙↩↪↺↻⟲⟳")
SHAPES = list("○●□■△▲▽▼◇◆◊☆★☉☐☑☒◯◉◎⊙◀▶")
CURRENCY = list("€£¥¢₹₽₿©®™°±¬¦§¨¯¶·¸¿×÷")
OPERATORS = list("∘∙∛∜∝∞∟∠∡∢∣∤∥∦∧∨∩∪∫∬∭∮∯∰")
TECHNICAL = list("⌈⌉⌊⌋〈〉⟨⟩⟪⟫⟬⟭") + [chr(c) for c in range(0x2310, 0x231C)]
ASCII_FALLBACK = (
    [f"|{c}" for c in "ABCDEFGHIJKLMNOPQRST"] + [f"||{c}" for c in "ABCDEFGH"] + [f"~{c}~" for c in "ABCDEFGH"]
    + ["^^^", "|||", "~~~", "===", "+++", "---", "***", ">>>", "<<<"] + [f"[|{c}|]" for c in "ABCDEF"] + [f"?{c}?" for c in "ABCDEFGH"]
)

# Role aliases.
ROLE_ALIASES = {"sys": "system", "usr": "user", "user_message": "user", "assistant_message": "assistant", "ai": "assistant", "human": "user"}
ROLES = ("system", "user", "assistant", "function")

# Model families in order, each with the substrings that name it.
FAMILIES = {
    "gpt-4": ["gpt-4", "gpt4"], "gpt-3.5": ["gpt-3.5", "gpt-35", "turbo"], "gpt-3": ["davinci", "curie", "babbage", "ada"],
    "claude": ["claude", "anthropic"], "llama": ["llama", "llama2", "llama-2", "llama3", "llama-3"], "codellama": ["codellama", "code-llama"],
    "mistral": ["mistral", "mixtral"], "gemini": ["gemini", "bard"], "palm": ["palm", "palm2"], "qwen": ["qwen", "qwen1.5", "qwen2", "qwen3", "qwen-"],
    "yi": ["yi-", "01-ai"], "deepseek": ["deepseek"], "phi": ["phi-", "microsoft/phi"], "falcon": ["falcon"], "starcoder": ["starcoder", "starcode"],
    "vicuna": ["vicuna"], "alpaca": ["alpaca"], "chatglm": ["chatglm", "glm-"],
}
SPECIAL_FAMILIES = (("qwen3", "qwen3"), ("qwen2", "qwen2"), ("qwen", "qwen"), ("llama3", "llama3"), ("llama-3", "llama3"))

# Log tags in order of precedence, and the category of each.
LOG_TAGS = (
    (("[FIX]",), "system_fixes"), (("[TIMEOUT FILTER]",), "request_filtering"), (("[CLEANUP]",), "cleanup_operations"), (("[ERROR]",), "error_handling"),
    (("[ALL REQUESTS]", "[DEBUG]"), "request_processing"), (("[CLINE]",), "cline_integration"), (("[SESSION]",), "session_management"),
    (("[STREAMING DEBUG]", "[PROXY STREAMING DEBUG]"), "streaming_responses"), (("[NON-STREAMING DEBUG]", "[PROXY DECOMPRESSION DEBUG]"), "response_decompression"),
    (("TOKEN CALCULATION",), "token_calculations"), (("[CONVERSATION DETECTION]",), "conversation_detection"), (("[KV DEBUG]", "[KV CACHE]"), "kv_cache_optimization"),
    (("[CONVERSATION COMPRESS]",), "conversation_compression"), (("[PROXY]",), "compression_proxy"), (("SET MODEL CONTEXT",), "model_context"),
    (("SERVER", "FORWARDED", "TARGET", "API"), "server_communication"), (("[PAYLOAD DEBUG]",), "payload_debugging"), (("TEST", "DEMO", "EXPERIMENT"), "test_utilities"),
    (("OVERRIDE", "TIMEOUT"), "system_fixes"), (("COMPRESSION", "DYNAMIC DICTIONARY", "ANALYSIS"), "compression_core"), (("SYMBOL", "MODEL CONTEXT"), "symbol_management"),
)
DEFAULT_CATEGORY = "request_processing"

# Source languages, in order: file endings, words that show them, block comments, line comments.
LANGUAGES = (
    ("python", (".py", ".pyw"), ("def ", "import ", "from ", "__init__", "self.", "print("), ('"""[\\s\\S]*?"""', "'''[\\s\\S]*?'''"), "#"),
    ("javascript", (".js", ".jsx", ".ts", ".tsx", ".mjs"), ("function ", "var ", "let ", "const ", "console."), ("/\\*[\\s\\S]*?\\*/",), "//"),
    ("c_cpp", (".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx"), ("#include", "int main", "std::", "printf("), ("/\\*[\\s\\S]*?\\*/",), "//"),
    ("html", (".html", ".htm", ".xhtml"), ("<html", "<body", "<div", "<script"), ("<!--[\\s\\S]*?-->",), None),
    ("css", (".css", ".scss", ".sass", ".less"), (), ("/\\*[\\s\\S]*?\\*/",), None),
    ("sql", (".sql",), ("SELECT", "FROM", "WHERE", "INSERT"), ("/\\*[\\s\\S]*?\\*/",), None),
    ("shell", (".sh", ".bash", ".zsh", ".fish"), (), (), "#"),
)

# Code constructs: kind, pattern, shortest and longest match.
RECEIVERS = (
    "self", "logger", "config", "analyzer", "data", "result", "item", "obj", "ctx", "req", "res", "app", "client",
    "server", "db", "model", "parser", "handler", "manager", "service", "utils", "helpers", "tools", "api", "cache",
)
_CODE_GROUPS = (
    ("logging", 0, 119, (r"logger\.info\([^)]*\)", r"logger\.debug\([^)]*\)", r"logger\.warning\([^)]*\)", r"logger\.error\([^)]*\)", r"logging\.getLogger\([^)]*\)", r"log\.info\([^)]*\)", r"log\.debug\([^)]*\)", r"log\.error\([^)]*\)")),
    ("method_call", 0, 99, tuple(name + r"\.\w+\([^)]*\)" for name in RECEIVERS)),
    ("attribute", 0, 49, tuple(name + r"\.\w+" for name in RECEIVERS)),
    ("function", 0, 119, (r"def \w+\(self[^)]*\):", r"def \w+\([^)]*\):", r"async def \w+\([^)]*\):", r"lambda [^:]+:", r"\w+\([^)]{1,80}\)")),
    ("import", 0, 99, (r"from [\w.]+ import [\w., ]+", r"import [\w., ]+", r"from \. import \w+", r"from \.[\w.]+ import \w+")),
    ("assignment", 11, 79, (r"\w+ = [^=\n]{1,60}", r"\w+: [\w\[\]]+", r"\w+: [\w\[\]]+ = [^=\n]{1,40}")),
    ("control", 0, 999, (r"if [^:]{1,50}:", r"elif [^:]{1,50}:", r"for \w+ in [^:]{1,50}:", r"while [^:]{1,50}:", r"try:", r"except \w+ as \w+:", r"except \w+:", r"finally:", r"with [^:]{1,50}:")),
    ("string", 0, 99, (r'f"[^"]*\{[^}]+\}[^"]*"', r"f'[^']*\{[^}]+\}[^']*'", r'"[^"]*"\.format\([^)]*\)', r"'[^']*'\.format\([^)]*\)", r"\.join\([^)]+\)", r"\.split\([^)]*\)", r"\.strip\(\)", r"\.replace\([^)]+\)")),
    ("collection", 0, 9999, (r"\.get\([^)]+\)", r"\.items\(\)", r"\.keys\(\)", r"\.values\(\)", r"\.append\([^)]+\)", r"\.extend\([^)]+\)", r"\.update\([^)]+\)", r"len\([^)]+\)", r"enumerate\([^)]+\)", r"zip\([^)]+\)", r"range\([^)]+\)")),
    ("class", 0, 99, (r"class \w+\([^)]*\):", r"@\w+", r"@\w+\([^)]*\)", r"super\(\)\.\w+\([^)]*\)", r"self\.\w+ = [^=\n]{1,40}")),
    ("operator", 0, 99, (r"is not None", r"is None", r"not in ", r" in ", r" and ", r" or ", r" == ", r" != ", r" >= ", r" <= ", r" > ", r" < ")),
    ("config", 0, 79, (r"config\['[^']+'\]", r'config\["[^"]+"\]', r"\.get\('[^']+', [^)]+\)", r'\.get\("[^"]+", [^)]+\)', r"json\.loads\([^)]+\)", r"json\.dumps\([^)]+\)")),
    ("file", 0, 99, (r"open\([^)]+\)", r"with open\([^)]+\) as \w+:", r"\.read\(\)", r"\.write\([^)]+\)", r"\.close\(\)", r"Path\([^)]+\)", r"os\.path\.\w+\([^)]+\)", r"\.exists\(\)", r"\.mkdir\([^)]*\)")),
    ("param_call", 0, 9999, (r"\w+\.get\([^,]+,\s*[^)]+\)", r'\w+\.get\("[^"]+",\s*[^)]+\)', r"\w+\s*=\s*\w+\.get\([^)]+\)", r'log_message\(f"[^"]*\{[^}]+\}[^"]*"\)', r"timing_breakdown\.get\([^)]+\)")),
    ("param_assignment", 0, 99, (r"\w+_chars_saved = [^=\n]+", r"\w+_tokens_saved = [^=\n]+", r"\w+_stats\.get\([^)]+\)", r"comment_\w+ = [^=\n]+", r"config_data\.get\([^)]+\)", r'logger\.\w+\(f"[^"]*"\)')),
    ("param_fstring", 0, 119, (r'f"[^"]*→[^"]*: \{[^}]+\}s \(\{[^}]+\}%\)"', r'f"[^"]*: \{[^}]+\}s"', r'f"[^"]*\{[^}]+\}[^"]*characters"', r'f"[^"]*\{[^}]+\}[^"]*patterns"')),
    ("block", 0, 99, (r"(?:if|for|while|with|elif) [^:\n]{1,80}:", r"return [^\n]{1,60}")),
)


def _unicode_words(pattern: str) -> str:
    """Word characters of any script, in both engines' terms."""
    return pattern.replace(r"[\w", r"[\p{L}\p{N}_").replace(r"\w", r"[\p{L}\p{N}_]")


CODE_PATTERNS = tuple((kind, _unicode_words(p), least, most) for kind, least, most, some in _CODE_GROUPS for p in some)
SIMPLE_CODE_PATTERNS = (
    ("call", r"[A-Za-z0-9_]+\([^)]*\)", 5, 100),
    ("attribute", r"[A-Za-z0-9_]+\.[A-Za-z0-9_]+", 5, 100),
    ("definition", r"(?:def|class) [A-Za-z0-9_]+", 5, 100),
)
CODE_INDICATORS = ("def ", "class ", "import ", "function", "{", "}", "()", ";")
ALL_CODE_INDICATORS = ("def ", "class ", "import ", "from ", "if ", "for ", "while ", "()", "{}", "[]", "=>", "===", "!==", "&&", "||", "function", "var ", "let ", "const ", "return")
CODE_TERMS = ("log", "msg", "data", "config", "file", "json", "def", "class")

# Providers and the prompt format of each; others take chatml.
PROVIDER_FORMATS = {"anthropic": "claude", "google": "gemini", "gemini": "gemini", "qwen": "qwen", "gemma": "gemma", "openai": "chatml", "mistral": "chatml", "x-ai": "chatml", "xai": "chatml", "ollama": "chatml"}
# Request settings that are timeouts, and the fields that a message may have.
TIMEOUT_PARAMS = (
    "timeout", "request_timeout", "response_timeout", "connection_timeout", "read_timeout", "write_timeout",
    "stream_timeout", "api_timeout", "client_timeout", "server_timeout", "connect_timeout", "total_timeout",
)
MESSAGE_FIELDS = ("role", "content", "name")
# Signs of clients: a web client's browsers, origins and parameters, and headers and names of others.
BROWSERS = ("mozilla", "chrome", "safari", "firefox", "edge")
LOCAL_ORIGINS = ("localhost", "127.0.0.1", "192.168.")
WEB_PARAMS = ("cache_prompt", "samplers", "dynatemp_range", "timings_per_token")
ANTHROPIC_HEADERS = ("x-api-key", "anthropic-version", "anthropic-beta")
CLINE_AGENTS = ("cline", "so/js")
CLINE_HEADERS = ("x-task-id", "x-cline-session", "x-cline-version", "x-anthropic-version")
CLIENTS = ("cline", "webui", "sillytavern", "anthropic", "roo", "aider", "standard")
# Names of a tool call's fields.
TOOL_KEYS = ("tool", "function", "action", "command", "operation", "method")
PATH_KEYS = ("path", "file", "filename", "filepath", "directory", "location")
STRUCTURE_KEYS = ("operationIsLocatedInWorkspace", "content", "arguments", "params", "parameters", "options", "config")
REASONING_TAGS = ("think", "thinking", "thought", "analysis", "reasoning")


def symbols(private_use: bool = False) -> list[tuple[str, str]]:
    """(symbol, kind) in order, without repeats; optionally private-use code points behind, which no text holds."""
    groups = [("unicode", GREEK + MATH + SUBSCRIPT + SUPERSCRIPT + BOXES + ARROWS + SHAPES + CURRENCY + OPERATORS + TECHNICAL), ("ascii", ASCII_FALLBACK)]
    if private_use:
        groups.append(("private", [chr(c) for c in range(0xE000, 0xF900)]))
    kind = {}
    for name, some in groups:
        for s in some:
            kind.setdefault(s, name)
    return list(kind.items())


def symbol_pool(spark: SparkSession, private_use: bool = False) -> DataFrame:
    """(symbol, rank, kind, cost): the pool in order; cost in tokens: 1 Unicode, 2 ASCII, 3 private use."""
    cost = {"unicode": 1, "ascii": 2, "private": 3}
    return spark.createDataFrame([(s, i + 1, k, cost[k]) for i, (s, k) in enumerate(symbols(private_use))], "symbol string, rank int, kind string, cost int")


def family_patterns(spark: SparkSession, custom: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(p, i, f) for i, (p, f) in enumerate(SPECIAL_FAMILIES)]
    for name, some in [*FAMILIES.items(), *(custom or {}).items()]:
        rows += [(p, len(rows) + k, name) for k, p in enumerate(some)]
    return spark.createDataFrame(rows, "pattern string, priority int, family string")


def code_patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODE_PATTERNS), "kind string, pattern string, min_len int, max_len int")


def log_tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i, c) for i, (tags, c) in enumerate(LOG_TAGS) for t in tags], "tag string, priority int, category string")


def comment_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, list(e), list(w), list(b), line) for n, e, w, b, line in LANGUAGES], "language string, endings array<string>, words array<string>, blocks array<string>, line string")
