"""Word lists, patterns, weights and lookup tables the results depend on."""

# ---- severities -------------------------------------------------------------------------

# Stored severity of a chunk, tested over the whole entry (first hit wins).
INGEST_SEVERITY = [
    ("error", r"(?i)\b(ERROR|Exception|Traceback|Failed|Critical|Fatal)\b"),
    ("warning", r"(?i)\bWARN(ING)?\b"),
]

# Analysis severity, tested over the first line (first hit wins).
ANALYSIS_SEVERITY = [
    ("fatal", r"(?i)\bFATAL\b"),
    ("critical", r"(?i)\bCRITICAL\b"),
    ("error", r"(?i)\bERROR\b|Exception|Traceback"),
    ("warning", r"(?i)\bWARN(ING)?\b"),
    ("info", r"(?i)\bINFO\b"),
    ("debug", r"(?i)\bDEBUG\b"),
]
CLUSTERED_SEVERITIES = ["fatal", "critical", "error", "warning"]
ERROR_SEVERITIES = ["error", "critical", "fatal"]
SEVERITY_WEIGHT = {"fatal": 1.0, "critical": 0.95, "error": 0.85, "warning": 0.55,
                   "info": 0.2, "debug": 0.1, "unknown": 0.15}
SEVERITY_ORDER = {"fatal": 5, "critical": 4, "error": 3, "warning": 2, "info": 1}
SEVERITY_RANK_SCORE = {"fatal": 10, "critical": 8, "error": 6, "warning": 3,
                       "info": 1, "debug": 0, "unknown": 1}
TREND_RANK_SCORE = {"spike": 5, "new": 4, "regression": 4, "stable": 1, "declining": 0, "unknown": 1}
TREND_CAUSAL_SCORE = {"spike": 1.0, "new": 0.9, "regression": 0.8, "stable": 0.5,
                      "declining": 0.3, "unknown": 0.3}
LEVEL_WORDS = ["error", "warning", "warn", "info", "debug", "fatal", "critical"]

# ---- log text ---------------------------------------------------------------------------

# A line matching this opens a new log entry.
ENTRY_START = (r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
               r"|\[?\d{4}-\d{2}-\d{2}[\s_]\d{2}:\d{2}"
               r"|\d{13,}\s"
               r"|(?i:(ERROR|WARN(ING)?|INFO|DEBUG|FATAL|CRITICAL)\b))")
TIMESTAMP = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})"
EXCEPTION = r"(?i)([\w.]*(?:Error|Exception|Fault|Failure|Panic)(?::\s*.{0,120})?)"
EXCEPTION_NO_PANIC = r"(?i)([\w.]*(?:Error|Exception|Fault|Failure)(?::\s*.{0,120})?)"
EXCEPTION_WORDS = ["error", "exception", "fault", "failure", "panic"]
HTTP_STATUS = r"(?i)(?:status|code|HTTP)\s*[:=]?\s*(4\d{2}|5\d{2})"
TIMED_OUT = r"(?i)(?:timed?\s*out|timeout|connection\s+refused)"
STACK_FRAME = (r'(?i)(?:at\s+[\w$.]+\(|File\s+"[^"]+",\s+line\s+\d+|in\s+[\w.]+'
               r"|[\w.]+\.(?:py|java|js|ts|rb|go):\d+)")
FILE_LINE = r"(?i)([\w./\\-]+\.(?:py|js|ts|tsx|jsx|java|go|rs|rb|php))\s*[:\s]+(?:line\s+)?(\d+)"
FUNCTION_WORD = r"""(?i)(?:in|function|method|def)\s+['"]?(\w{2,})['"]?"""
CLASS_METHOD = r"\b([A-Z][a-zA-Z0-9]+)\.(\w+)\b"
STOP_CLASSES = ["System", "Console", "Object", "Array", "String", "Integer", "Boolean", "Math", "Date"]
PY_FRAME = r'File\s+"([^"]+\.py)",\s+line\s+(\d+),\s+in\s+(\w+)'
JAVA_FRAME = r"at\s+([\w.]+)\.(\w+)\(([\w.]+):(\d+)\)"
JS_FRAME = r"at\s+(\w+)\s+\(([^)]+\.(?:js|ts|tsx|jsx)):(\d+):\d+\)"
# Variable parts of a message, replaced in this order.
NORMALISE = [
    (r"0x[0-9a-fA-F]+", "<addr>"),
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.\dZ]*", "<ts>"),
    (r"\b\d{4,}\b", "<num>"),
]
LEVEL_PREFIX = r"^(error|warn(ing)?|fatal|critical)\s*[:\s]*"
TS_PREFIX = r"^\[?\s*<ts>\s*\]?\s*"
KEYWORD_TOKEN = r"[A-Za-z_][\p{L}\p{N}_.]{2,}"
KEYWORD_STOPWORDS = (
    "the a an is are was were in on at to for of and or but not with from by as it that this be has "
    "have had do does did log info debug error warn warning fatal critical null none true false"
).split()

# ---- files ------------------------------------------------------------------------------

LOG_EXTENSIONS = [".log", ".out"]
LOG_DIR_EXTENSIONS = [".log", ".out", ".txt", ".err"]
# Folders never indexed (besides any folder whose name starts with a dot).
SKIP_DIRS = (
    ".git .hg .svn node_modules .venv venv env .env __pycache__ .mypy_cache .pytest_cache .ruff_cache "
    "dist build .next .nuxt target .idea .vscode model-weights vectordb coverage .coverage .tox .nox "
    ".cache __pypackages__ .eggs out .output .gradle .maven .cargo vendor bower_components .terraform "
    ".serverless .webpack .parcel-cache site-packages .sass-cache tmp .tmp"
).split()
SKIP_EXTENSIONS = (
    ".bin .model .vocab .onnx .pt .pth .safetensors .gguf .ggml .h5 .hdf5 .tflite .pb .pkl .pickle .npy "
    ".npz .parquet .feather .exe .dll .so .dylib .o .obj .a .lib .zip .tar .gz .bz2 .7z .xz .rar .png "
    ".jpg .jpeg .gif .ico .svg .webp .bmp .tiff .psd .mp3 .mp4 .wav .avi .mov .flv .mkv .woff .woff2 "
    ".ttf .eot .otf .map .lock .db .sqlite .sqlite3 .coverage .prof .trace .pyc .pyo .class .jar .war "
    ".ear .nupkg"
).split()
SKIP_FILENAMES = (
    "package-lock.json yarn.lock pnpm-lock.yaml Pipfile.lock poetry.lock Gemfile.lock composer.lock "
    "Cargo.lock go.sum .DS_Store Thumbs.db desktop.ini"
).split()
SKIP_SUFFIXES = [".min.js", ".min.css", ".bundle.js", ".chunk.js", ".min.map", ".bundle.map"]
TEXT_EXTENSIONS = (
    ".py .js .ts .jsx .tsx .java .go .rs .c .cpp .h .hpp .cs .rb .php .swift .kt .scala .ex .exs .clj "
    ".hs .lua .sh .bash .zsh .fish .ps1 .json .yaml .yml .toml .ini .cfg .conf .xml .md .rst .txt .sql "
    ".graphql .proto .html .css .scss .log .out"
).split()
TEXT_SUFFIXES = [".env.example"]
MAX_FILE_BYTES = 512 * 1024

# Parser language by extension; anything else is "text".
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx",
    ".go": "go", ".java": "java", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
    ".ini": "config", ".cfg": "config", ".conf": "config", ".env": "config", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".cs": "csharp", ".rs": "rust",
    ".kt": "kotlin", ".swift": "swift", ".scala": "scala", ".rb": "ruby", ".php": "php",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".fish": "shell", ".ps1": "shell",
}
# Display language of the architecture report.
DISPLAY_LANGUAGE = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "JSX", ".tsx": "TSX",
    ".go": "Go", ".java": "Java", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".c": "C",
    ".cpp": "C++", ".h": "C/C++ Header", ".cs": "C#", ".swift": "Swift", ".kt": "Kotlin",
    ".scala": "Scala", ".sh": "Shell", ".sql": "SQL", ".json": "JSON", ".yaml": "YAML",
    ".yml": "YAML", ".toml": "TOML", ".xml": "XML", ".html": "HTML", ".css": "CSS",
    ".scss": "SCSS", ".md": "Markdown",
}
ENTRY_POINT_NAMES = (r"(?i)^(main\.(py|js|ts|go|java)|app\.(py|js|ts)|server\.(py|js|ts|go)"
                     r"|index\.(js|ts|tsx)|manage\.py|wsgi\.py|asgi\.py)$")
ENTRY_POINT_PATHS = r"(?i)^cmd[/\\]"
CONFIG_NAMES = (r"(?i)^(docker-compose|Dockerfile|\.dockerignore)"
                r"|^(Makefile|CMakeLists\.txt|build\.gradle)$"
                r"|^(package\.json|requirements\.txt|go\.mod|pom\.xml|Cargo\.toml)$"
                r"|\.(yaml|yml|toml|ini|cfg|conf|env)$")
# What a top folder's name says about it.
MODULE_PURPOSE = [
    ("API / route handlers", ["api", "routes", "handlers", "controllers"]),
    ("Data models / schemas", ["models", "schemas", "entities"]),
    ("Core business logic", ["services", "core", "lib"]),
    ("Test suite", ["tests", "test", "spec", "__tests__"]),
    ("Shared utilities", ["utils", "helpers", "common"]),
    ("Data storage layer", ["db", "database", "storage"]),
    ("Authentication / authorization", ["auth", "authentication"]),
    ("Configuration", ["config", "settings"]),
    ("Request middleware", ["middleware"]),
    ("UI components / views", ["components", "pages", "views"]),
]

# ---- chunk sizes ------------------------------------------------------------------------

WINDOW_LINES, WINDOW_STEP = 40, 32
UNIT_LINES, UNIT_STEP = 80, 72
MIN_CHUNK_CHARS = 60
MIN_MODULE_CHARS = 30
MAX_ENTRY_LINES = 80
HEADER_IMPORTS = 3

# ---- code -------------------------------------------------------------------------------

JS_LANGS = ["javascript", "typescript", "jsx", "tsx"]
C_LANGS = ["c", "cpp", "csharp", "rust", "kotlin", "swift", "scala"]
# Line patterns that open a unit: (languages, kind, pattern, group of the name).
UNIT_PATTERNS = [
    (["python"], "class", r"^[ \t]*class\s+(\w+)\s*[\(:]", 1),
    (["python"], "function", r"^[ \t]*(async\s+)?def\s+(\w+)\s*\(", 2),
    (JS_LANGS, "class", r"^[ \t]*(?:export\s+)?(?:default\s+)?class\s+(\w+)", 1),
    (JS_LANGS, "function",
     r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*[\(<]", 1),
    (JS_LANGS, "arrow",
     r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[a-zA-Z_]\w*)\s*=>", 1),
    (["go"], "class", r"^type\s+(\w+)\s+struct\s*\{", 1),
    (["go"], "function", r"^func\s+(?:\(\s*\w+\s+\*?\w+\)\s+)?(\w+)\s*\(", 1),
    (["java"], "class",
     r"^[ \t]*(?:public|private|protected)?\s*(?:abstract\s+)?(?:static\s+)?class\s+(\w+)", 1),
    (["java"], "method",
     r"^[ \t]+(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?(?:synchronized\s+)?"
     r"\w[\w<>\[\], ]*\s+(\w+)\s*\(", 1),
    (C_LANGS, "class",
     r"^(?:(?:public|private|protected|abstract|sealed|partial|static|final)\s+)*"
     r"(?:class|struct|interface|enum|trait|object)\s+(\w+)", 1),
    (["c", "cpp", "csharp", "kotlin", "swift", "scala"], "function",
     r"^[\w\s\*:&<>,\[\]~]+?\b(\w+)\s*\([^)]*\)\s*(?:const\s*)?(?:override\s*)?(?:noexcept\s*)?\{", 1),
    (["rust"], "function", r"^(?:pub(?:\([\w:]+\))?\s+)?(?:async\s+)?fn\s+(\w+)", 1),
    (["rust"], "struct", r"^(?:pub(?:\([\w:]+\))?\s+)?(?:struct|enum|trait|impl)\s+(\w+)", 1),
    (["ruby"], "class", r"^[ \t]*(?:class|module)\s+(\w+)", 1),
    (["ruby"], "function", r"^[ \t]*def\s+(\w+[\?\!]?)", 1),
    (["php"], "class", r"^(?:(?:abstract|final)\s+)?class\s+(\w+)", 1),
    (["php"], "function", r"^(?:[ \t]*(?:public|private|protected|static)\s+)*function\s+(\w+)\s*\(", 1),
    (["shell"], "function", r"^(?:function\s+)?(\w+)\s*\(\s*\)\s*\{", 1),
]
# Import lines per language.
IMPORT_PATTERNS = [
    (["python"], r"^(?:from\s+\S+\s+)?import\s+.+"),
    (JS_LANGS, r"^(?:import\s+.+|const\s+\w+\s*=\s*require\(.+\))"),
    (["go"], r'^import\s+".+"'),
    (["java"], r"^import\s+[\w.*]+;"),
    (C_LANGS, r'^(?:#include\s+[<"].+?[>"]|using\s+.+;|import\s+.+)'),
    (["ruby"], r"^(?:require|require_relative|include|extend)\s+.+"),
    (["php"], r"^(?:use\s+.+;|require(?:_once)?\s+.+;|include(?:_once)?\s+.+;)"),
]
# Section openers of configuration files.
SECTION_PATTERNS = {
    "yaml": r"^(\S[\w\-. ]*)\s*:",
    "toml": r"^\[([^\]]+)\]",
    "config": r"^\[([^\]]+)\]",
}
# A trimmed Ruby line starting like this opens a nested block.
RUBY_OPEN = r"^(def |class |module |do|if |unless |begin|case )"
INDENT_LANGS = ["python"]
END_LANGS = ["ruby"]
WHOLE_FILE_MODULE_LANGS = C_LANGS + ["ruby", "php", "shell"]
CALL = r"\b([a-zA-Z_]\w*)\s*\("
CALL_IGNORE = (
    "if for while return print len range str int float list dict set tuple type isinstance super hasattr "
    "getattr setattr delattr open close True False None self cls import from def class async await yield "
    "function const let var new this constructor require export module console fmt log err nil make append "
    "System String Integer Boolean Object void"
).split()
# Structural questions and the graph lookup each one asks for.
STRUCTURAL_LOOKUPS = [
    ("importers", r"which\s+files?\s+(?:use|import|depend on|reference)\s+(?:the\s+)?(\w+)"),
    ("dependents", r"what\s+depends?\s+on\s+(?:the\s+)?(\w+)"),
    ("methods", r"(?:what|which)\s+methods?\s+(?:does|has)\s+(\w+)"),
    ("symbols", r"(?:what|which)\s+(?:functions?|classes?|symbols?)\s+(?:are\s+)?in\s+(.+?)(?:\?|$)"),
]

# ---- ranking ----------------------------------------------------------------------------

RRF_K = 60
KEYWORD_DISTANCE, SEVERITY_DISTANCE = 0.30, 0.20
RELEVANT = 0.35
LABEL_HIGH, LABEL_MEDIUM = 0.70, 0.45
BOOST_STRUCTURE, BOOST_DOC, BOOST_ERROR, BOOST_TRACE = 0.05, 0.02, 0.08, 0.06
BOOST_DAY, BOOST_WEEK = 0.03, 0.01
ERROR_SIGNAL = (r"(?i)\b(ERROR|Exception|Traceback|FATAL|CRITICAL|FAILED|FAILURE|panic|segfault"
                r"|OutOfMemoryError|NullPointerException|StackOverflowError|RuntimeError|ValueError|TypeError"
                r"|KeyError|AttributeError|IOError|OSError|ConnectionError|TimeoutError)\b")
TRACE_SIGNAL = (r"(?im)(Traceback \(most recent call last\)|^\s+at\s+\S+\(.*:\d+\)"
                r'|^\s+File\s+".*",\s+line\s+\d+|goroutine\s+\d+|^\s+\d+:\s+0x[0-9a-f]+\s+)')
CONFIDENCE_WEIGHTS = {
    "broad": {"similarity": 0.15, "volume": 0.20, "severity": 0.20, "recency": 0.10, "pattern": 0.15,
              "cross_file": 0.20},
    "specific": {"similarity": 0.35, "volume": 0.12, "severity": 0.18, "recency": 0.10, "pattern": 0.12,
                 "cross_file": 0.13},
}
CAUSAL_WEIGHTS = {"frequency": 0.25, "stack_trace": 0.20, "code_match": 0.25, "dependency": 0.10, "trend": 0.20}
CAUSAL_LABELS = {"frequency": "Error concentration", "stack_trace": "Stack trace consistency",
                 "code_match": "Code reference match", "dependency": "Dependency proximity",
                 "trend": "Recency/spike correlation"}

# ---- questions --------------------------------------------------------------------------

# Question word -> words to look for in stored text, in this order.
SEARCH_TERMS = {
    "error": ["ERROR", "Error", "error"],
    "exception": ["Exception", "exception", "Traceback"],
    "traceback": ["Traceback", "traceback"],
    "failed": ["Failed", "failed", "FAILED"],
    "failure": ["Failure", "failure", "FAILURE"],
    "crash": ["crash", "Crash", "CRASH"],
    "warning": ["WARN", "WARNING", "Warning"],
    "warn": ["WARN", "WARNING", "Warning"],
    "fatal": ["FATAL", "Fatal"],
    "critical": ["CRITICAL", "Critical"],
    "timeout": ["timeout", "Timeout", "TIMEOUT", "timed out"],
    "null": ["NullPointerException", "NoneType", "null"],
    "none": ["NoneType"],
    "panic": ["panic", "PANIC"],
    "oom": ["OutOfMemoryError", "OOM", "out of memory"],
}
DEFAULT_SEARCH_TERMS = ["ERROR", "Exception", "WARN", "Traceback", "FATAL"]
LOG_WORD = r"\blog(s|file)?\b"
# Question words dropped from the keyword variant.
QUESTION_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might can "
    "could must i me my we our you your he she it they them their this that these those what which who whom "
    "where when why how in on at to for of with by from and or but not no if so then than about any all each "
    "every some show tell find get give explain"
).split()
# Substitutes tried in this order.
SYNONYMS = {
    "error": ["exception", "failure", "fault"],
    "exception": ["error", "traceback"],
    "crash": ["failure", "fatal", "abort"],
    "timeout": ["timed out", "deadline exceeded"],
    "bug": ["defect", "issue", "problem"],
    "performance": ["slow", "latency", "bottleneck"],
    "memory": ["OOM", "out of memory", "heap"],
    "null": ["NoneType", "NullPointerException", "undefined"],
    "import": ["dependency", "require", "module"],
    "function": ["method", "def", "handler"],
    "class": ["type", "object", "struct"],
    "database": ["db", "SQL", "query"],
    "api": ["endpoint", "route", "handler"],
    "config": ["configuration", "settings", "environment"],
    "deploy": ["deployment", "release", "build"],
    "test": ["spec", "assert", "unittest"],
}
# Identifier shapes kept by the technical variant, in this order.
TECHNICAL_SHAPES = [
    r"[a-zA-Z_]\w+(?:\.\w+){1,}",
    r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b",
    r"\b[a-z]+(?:_[a-z]+){1,}\b",
    r"[\w./\\-]+\.\w{1,5}",
    r"\b[A-Z][A-Z_]{2,}\b",
]
GREETINGS = [
    r"^(hi|hello|hey|howdy|hola|yo)[\s!.,?]*$",
    r"^(good\s*(morning|afternoon|evening|day|night))[\s!.,?]*$",
    r"^how\s+are\s+you",
    r"^what'?s?\s+up[\s!?]*$",
    r"^(thanks?|thank\s+you|thx|ty)[\s!.,?]*$",
    r"^(bye|goodbye|see\s+you|take\s+care)[\s!.,?]*$",
    r"^(who|what)\s+are\s+you[\s?]*$",
    r"^your\s+name[\s?]*$",
    r"^(please\s+)?help[\s!?]*$",
]
STRONG_PROJECT = [
    r"error|exception|traceback|stack\s*trace|crash|fail|bug|issue",
    r"timeout|latency|slow|OOM|out\s+of\s+memory|memory\s+leak",
    r"null\s*pointer|NoneType|undefined|segfault|panic|deadlock",
    r"5[0-9]{2}\b|4[0-9]{2}\b",
    r"log(s|file|ged)?|incident|alert|warning|critical|fatal",
    r"\.(py|js|ts|java|go|rs|rb|cpp|c|h|yaml|yml|json|toml|xml|sql)\b",
    r"function|class|method|module|package|import|endpoint|route|\bapi\b",
    r"\bfile\b|directory|folder|config|setting|\benv\b|variable|parameter",
    r"database|\bdb\b|table|schema|migration|\bquery\b|\bindex\b",
    r"deploy|docker|container|pod|k8s|kubernetes|service|server",
    r"git|commit|branch|merge|pull\s+request|PR\b",
    r"\btest\b|\bspec\b|assert|coverage|\bci\b|\bcd\b|pipeline",
    r"depend|requirement|version|upgrade|install",
    r"(src|lib|app|core|api|routes?|models?|services?|utils?|helpers?)/",
    r"line\s+\d+",
    r"which\s+(file|class|function|module|service|endpoint)",
    r"list\s+(all|the|files|classes|functions|errors|logs)",
    r"optimiz|refactor|improve|code\s*(quality|review|smell)",
    r"(is|are)\s+(the|this|it)\s+(code|codebase|project|app)\s+(good|bad|clean|messy|optimized|well)",
    r"review\s+(the|this|my)\s+(code|codebase|project)",
    r"(best\s+practice|anti.?pattern|technical\s+debt|code\s+coverage)",
    r"(performance|security|scalab|maintainab|readab)\w*\s+(issue|problem|concern|improve)",
]
OFF_TOPIC = [
    r"quantum\s+(physics|mechanics|computing|entanglement)",
    r"recipe|cooking|bake\b|ingredients",
    r"(stock|crypto)\s*(market|price|trading)|bitcoin|ethereum",
    r"weather\s+(forecast|today|tomorrow)",
    r"(write|compose|create)\s+(a\s+)?(poem|song|story|essay|novel)",
    r"(who\s+is|tell\s+me\s+about)\s+(elon|trump|biden|obama|modi|taylor)",
    r"(capital|president|prime\s+minister)\s+of\s+\w+",
    r"translate\s+.+\s+(to|into)\s+\w+",
    r"(play|recommend)\s+.{0,20}(movie|song|game|book)",
    r"(explain|what\s+is)\s+(relativity|evolution|gravity|photosynthesis)",
    r"(solve|calculate)\s+\d+\s*[\+\-\*/]",
    r"(history|geography|philosophy)\s+of\s+",
    r"(meaning|origin)\s+of\s+life",
    r"(sport|football|basketball|cricket|tennis)\s+(score|match|result)",
]
CONVERSATIONAL = [
    r"^are\s+you\s+(?:a\s+)?\w+",
    r"^do\s+you\s+(like|love|hate|feel|think|believe|dream|eat|sleep|remember)",
    r"^can\s+you\s+(feel|think|dream|love|sing|dance|laugh|cry|joke|play|flirt)",
    r"^(who|what)\s+(made|created|built|trained|programmed|designed)\s+you",
    r"^how\s+old\s+are\s+you",
    r"^what('?s|\s+is)\s+your\s+(name|age|gender|sex|fav|favorite|opinion|problem|purpose|job)",
    r"^(tell|say)\s+(me\s+)?(a\s+)?(joke|story|fun\s*fact|something\s+(funny|interesting|cool))",
    r"^i\s+(love|hate|like|miss|need|want)\s+you",
    r"^you('re|\s+are)\s+\w+",
    r"^do\s+you\s+have\s+(?:a\s+)?(?:boyfriend|girlfriend|wife|husband|body|soul|mind|brain|feelings?"
    r"|emotions?|consciousness|name|age|life|family|friends?)",
    r"^(lol|haha|rofl|lmao|omg|bruh|bro|dude|wow|nice|hmm+|meh|ugh|yikes|oops|ha+)[\s!?.]*$",
    r"^(ok|okay|sure|yes|no|nah|nope|yep|yeah|yea|k|kk|alright|cool|fine|whatever|great)[\s!?.]*$",
    r"^(sing|dance|rap|beatbox|flirt|marry)",
    r"^(write|compose|make)\s+(me\s+)?(a\s+)?(poem|song|haiku|limerick|rap|joke|riddle)",
    r"^what\s+can\s+you\s+do",
    r"^(f+u+c+k+|sh+i+t+|damn|wtf|stfu|shut\s+up)",
]
ROUTE_KEYWORDS = (
    "error exception stack log trace function module file service crash dependency architecture bug issue "
    "timeout latency slow oom memory leak null undefined segfault panic deadlock deploy docker container "
    "kubernetes database migration config endpoint route api test coverage git commit branch import class "
    "method variable server warning critical fatal optimize refactor review code codebase performance "
    "security scalab incident"
).split()
ROUTE_PATTERNS = [
    r"\.(py|js|ts|java|go|rs|rb|cpp|c|h|yaml|yml|json|toml|sql)\b",
    r"line\s+\d+",
    r"5[0-9]{2}\b|4[0-9]{2}\b",
    r"(src|lib|app|core|api|routes?|models?)/",
    r"which\s+(file|class|function|module|service|endpoint)",
    r"list\s+(all|the|files|classes|functions|errors|logs)",
    r"(what|why|how)\s+.{0,40}(error|bug|crash|fail|timeout)",
]
BROAD = [
    r"any\s+error",
    r"summarize|summarise|summary",
    r"what\s+(went\s+wrong|happened|errors?\s+are)",
    r"overview|report",
    r"list\s+(all|the)\s+(error|issue|problem)",
    r"are\s+there\s+(error|issue|problem|warning)",
]
LOG_QUESTION_WORDS = [
    "error", "exception", "traceback", "failed", "failure", "crash", "warning", "warn", "fatal", "critical",
    "timeout", "panic", "null", "none", "undefined", "oom", "stacktrace", "stack trace", "segfault",
    "deadlock", "bug", "issue",
]
ROOT_CAUSE = [
    r"\bwhy\b.*\b(?:fail|error|crash|broken|wrong|exception)",
    r"\broot\s*cause\b",
    r"\bwhat\s+(?:caused|causes)\b",
    r"\bwhy\s+(?:is|are|did|does|was)\b.*\b(?:failing|crashing|broken|erroring)",
    r"\bdiagnos[ei]\b",
    r"\binvestigat[ei]\b",
    r"\bcorrelat[ei]\b.*\b(?:log|error|code)",
    r"\btrace\b.*\b(?:back|through|issue|error)",
    r"\bfix\b.*\b(?:error|bug|issue|crash|failure)",
]
ARCHITECTURE = [
    r"\barchitecture\b", r"\bproject\s+structure\b", r"\boverview\b", r"\bhow\s+is.*\borganized\b",
    r"\bexplain\s+the\s+project\b", r"\bdirectory\s+structure\b", r"\bmodules?\b.*\bproject\b",
    r"\bproject\s+layout\b", r"\bentry\s+points?\b",
    r"\btell\s+me\s+about\s+(?:the\s+)?(?:project|codebase)\b",
    r"\bwhat\s+does\s+(?:the\s+)?(?:project|codebase)\s+do\b",
]
STRUCTURAL = [
    r"which\s+files?\s+(?:use|import|depend on|reference)",
    r"what\s+depends?\s+on",
    r"(?:what|which)\s+methods?\s+(?:does|has)",
    r"(?:what|which)\s+(?:functions?|classes?|symbols?)\s+(?:are\s+)?in",
]
CODE_REVIEW = [
    r"\boptimiz", r"\brefactor", r"\b(code|codebase)\s*(quality|review|smell|health)",
    r"\breview\s+(the|this|my)\s+(code|codebase|project)",
    r"\b(is|are)\s+(the|this|it)\s+(code|codebase|project)\s+(good|bad|clean|messy|optimized|well)",
    r"\b(best\s+practice|anti.?pattern|technical\s+debt)",
    r"\b(performance|security|scalab|maintainab|readab)\w*\s+(issue|problem|concern|improve)",
    r"\bimprov\w*\s+(the|this|my|any)\s+(code|codebase|project)",
    r"\b(any|suggest|give)\s+improve",
    r"\bcode\s+(is|looks?)\s+(good|bad|ok|fine|terrible)",
    r"\bhow\s+can\s+i\s+(improve|optimize|make.*better)",
    r"\bwhat.*wrong\s+with\s+(the|this|my)\s+(code|codebase)",
]
CODE_QUESTION = [
    r"\bhow\s+does\b",
    r"\bexplain\b.*\b(?:code|function|class|method|implementation)\b",
    r"\bwhat\s+does\s+\w+\s+do\b",
    r"\bshow\s+(?:me\s+)?(?:the\s+)?(?:code|implementation|function|class)\b",
    r"\bwhere\s+is\s+\w+\s+(?:defined|implemented|declared)\b",
    r"\bhow\s+is\s+\w+\s+(?:implemented|defined|used)\b",
]
FOLLOW_UP_MARKERS = [
    "it", "that", "those", "them", "this", "these", "the same", "the other", "which one", "which file", "also",
    "and what about", "more details", "more about", "tell me more", "elaborate", "explain further", "what else",
    "anything else", "any other", "the error", "the issue", "the bug",
]
TRUNCATION_SIGNALS = ["...", "[truncated", "I'll continue", "Let me continue", "Due to length",
                      "I would need more space"]
TERMINAL_CHARS = ".!?:>\n`|"
# Steps per question type, each with the step it needs; fast types need one lookup.
PLANS = {
    "architecture": [("get_arch", None)],
    "structural": [("query_graph", None)],
    "log_analysis": [("search_logs", None), ("extract_refs", "search_logs"), ("cross_analysis", "extract_refs")],
    "root_cause": [("search_logs", None), ("extract_refs", "search_logs"), ("retrieve_code", "extract_refs"),
                   ("get_deps", "retrieve_code"), ("get_arch", None), ("cross_analysis", "retrieve_code")],
    "code_analysis": [("search_code", None), ("bundle_context", "search_code"), ("get_deps", "search_code")],
    "code_review": [("search_code", None), ("bundle_context", "search_code"), ("get_arch", None),
                    ("get_deps", "search_code")],
    "general": [("search_logs", None), ("search_code", None), ("bundle_context", "search_code")],
}
FAST_TYPES = ["architecture", "structural"]
