"""Names, extensions and word lists that decide results, as plain data."""

from __future__ import annotations

# --- fixed values: languages by file extension (case-sensitive)
LANGUAGE_OF_EXTENSION = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "tsx": "tsx",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "jsx",
    "py": "python", "pyw": "python", "pyi": "python",
    "java": "java",
    "cs": "csharp",
    "go": "go",
    "rs": "rust",
    "php": "php",
    "rb": "ruby",
    "kt": "kotlin", "kts": "kotlin",
    "swift": "swift",
    "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
    "scala": "scala", "sc": "scala",
}
# --- fixed values: families of languages that share one rule set
LANGUAGE_FAMILY = {
    "typescript": "js", "tsx": "js", "javascript": "js", "jsx": "js",
    "python": "python",
    "java": "jvm", "kotlin": "jvm", "scala": "jvm",
    "csharp": "dotnet",
    "go": "go",
    "php": "php",
    "ruby": "ruby",
    "rust": "rust",
    "swift": "swift",
    "c": "c", "cpp": "c",
}
# --- fixed values: directories that a scan never enters
IGNORED_DIRECTORIES = ("node_modules", ".git", "dist", "build", "target", ".next", "coverage", ".turbo", "__pycache__")

# --- fixed values: words of personal data, of authentication, of logging
PII_WORDS = (
    "email", "password", "passwd", "secret", "ssn", "social_security", "credit_card", "creditcard", "card_number", "cardnumber",
    "phone", "address", "date_of_birth", "dateofbirth", "dob", "token", "api_key", "apikey",
)
AUTH_WORDS = ("auth", "jwt", "protect", "verify", "guard", "login")
LOG_OBJECTS = ("console", "logger", "log", "winston", "pino", "logging", "slog", "Logger", "Log")
LOG_METHODS = (
    "log", "info", "warn", "error", "debug", "trace", "fatal", "warning", "critical", "exception",
    "Println", "Printf", "Print", "Fatalf", "Panicf", "Info", "Warn", "Error", "Debug", "Fatal", "severe", "puts",
    "LogInformation", "LogWarning", "LogError", "LogDebug", "LogTrace", "LogCritical",
)
HTTP_VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "ALL")
ENTRY_WORDS = ("main", "handler", "controller", "endpoint", "route", "dispatch", "serve", "run", "start", "execute", "process", "handle")

# --- fixed values: roles of files, in the order in which they are tried
GENERATED_DIRECTORIES = ("vendor", "node_modules", "generated")
GENERATED_PARTS, GENERATED_ENDINGS = (".generated.",), (".pb.go", ".g.dart", ".g.cs")
TEST_DIRECTORIES = ("tests", "__tests__", "spec", "test")
TEST_ENDINGS = (
    "_test.go", "_test.rs", "_spec.rs", "_spec.rb", "_test.py", "test.java", "test.cs", "test.kt",
    ".test.js", ".test.ts", ".test.tsx", ".test.jsx", ".spec.js", ".spec.ts", ".spec.tsx", ".spec.jsx",
)
DOC_DIRECTORIES, DOC_EXTENSIONS = ("docs",), ("md", "mdx", "rst", "adoc")
BUILD_NAMES = (
    "Makefile", "makefile", "GNUmakefile", "Cargo.toml", "package.json", "build.rs", "build.gradle", "build.gradle.kts", "pom.xml",
    "CMakeLists.txt", "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "Rakefile", "Gemfile", "Justfile", "justfile",
    "go.mod", "go.sum", "setup.py", "setup.cfg", "pyproject.toml", "Pipfile", "Cargo.lock", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "flake.nix", "composer.json",
)
CONFIG_EXTENSIONS = ("yaml", "yml", "ini", "cfg", "env")
CONFIG_NAMES = (
    ".gitignore", ".gitattributes", ".editorconfig", ".prettierrc", ".eslintrc", ".babelrc", "tsconfig.json", "rustfmt.toml",
    "clippy.toml", ".rustfmt.toml", ".clippy.toml", "deny.toml",
)
CODE_EXTENSIONS = (
    "rs", "go", "py", "pyi", "js", "mjs", "cjs", "ts", "tsx", "mts", "cts", "jsx", "java", "kt", "kts", "rb", "c", "h", "cpp", "cc",
    "cxx", "hpp", "cs", "swift", "scala", "sc", "php", "sh", "bash", "zsh", "lua", "ex", "exs", "hs", "r", "html", "htm", "css",
    "scss", "sass", "less",
)
#: the two spellings of a file role: the label in histograms and the name in records
ROLE_NAME = {"impl": "implementation", "test": "test", "config": "config", "docs": "documentation", "generated": "generated", "build": "build", "other": "other"}

# --- fixed values: import probing
PROBE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".cs", ".rb", ".php")
PROBE_INDEXES = ("/index.ts", "/index.js")
ROOT_MODULE = "__root__"

# --- fixed values: confidence of resolved references
CONFIDENCE = {"import_based": 0.95, "same_file": 0.90, "global_unique": 0.80, "global_same_dir": 0.60, "global_ambiguous": 0.40, "unresolved": 0.0, "external": 0.60}
IMPORT_FILE_ONLY = 0.50
IMPACT_FLOOR = 0.1
FAN_OUT_LEAST, FAN_OUT_RATIO = 2, 3.0
FLOW_DEPTH, HIERARCHY_DEPTH = 15, 10

# --- fixed values: Python web frameworks
ROUTE_OBJECTS = ("app", "router", "api", "blueprint", "bp", "api_router", "web", "route")
FILE_ENDINGS = (
    ".py", ".sh", ".js", ".ts", ".jsx", ".tsx", ".rb", ".go", ".rs", ".java", ".cs", ".php", ".c", ".cpp", ".h", ".hpp", ".swift",
    ".kt", ".scala", ".sql", ".html", ".css", ".json", ".yaml", ".yml", ".toml", ".xml", ".txt", ".md", ".cfg", ".ini", ".conf",
    ".log", ".csv",
)

# --- fixed values: behaviour by language
BEHAVIOUR = {
    # language: (separator, source roots, where a signature is cut, call node kinds)
    "typescript": (".", ("src", "lib", "app"), "{", ("call_expression",)),
    "python": (".", ("src", "app"), ":", ("call",)),
    "java": (".", ("src/main/java", "src"), "{", ("method_invocation",)),
    "csharp": (".", ("src", "Controllers", "Services"), "{", ("invocation_expression",)),
    "go": (".", ("cmd", "internal", "pkg"), "{", ("call_expression",)),
    "php": ("\\", ("src", "app"), "{", ("member_call_expression", "function_call_expression", "scoped_call_expression")),
    "ruby": ("::", ("app", "lib"), "\n", ("call", "method_call")),
    "rust": ("::", ("src",), "{", ("call_expression",)),
    "generic": (".", ("src",), "{", ("call_expression",)),
}


def behaviour(language: str) -> tuple:
    """Separator, source roots, signature cut and call node kinds of a language."""
    alias = {"tsx": "typescript", "javascript": "typescript", "jsx": "typescript", "kotlin": "java", "scala": "java"}
    return BEHAVIOUR.get(alias.get(language, language), BEHAVIOUR["generic"])
