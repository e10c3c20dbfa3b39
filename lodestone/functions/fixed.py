"""Word lists, tables and limits that results must equal."""

# Fixed values.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "or", "not",
    "with", "this", "that", "from", "by", "it", "what", "how", "does", "do", "can", "where", "which", "who", "when",
]

INTENTS = {
    "lookup": ["section", "specification", "feature", "story", "stories", "endpoint", "finding", "security", "persona", "overview", "requirement", "integration", "ui spec", "api spec"],
    "code_exploration": ["function", "class", "method", "call graph", "caller", "callee", "symbol", "data model", "entity", "schema", "module", "file", "import"],
    "search": ["find", "search", "locate", "where", "which files", "look for", "show me all"],
}
SEARCH_WEIGHT = 1.5

EXTENSIONS = {
    "py": "python", "pyi": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "java": "java", "go": "go", "rs": "rust",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "cs": "c_sharp",
    "rb": "ruby", "rake": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "lua": "lua",
    "sh": "bash", "bash": "bash", "zsh": "bash", "html": "html", "htm": "html", "css": "css", "json": "json", "yml": "yaml", "yaml": "yaml",
    "toml": "toml", "md": "markdown", "mdx": "markdown", "sql": "sql", "ex": "elixir", "exs": "elixir", "hs": "haskell", "ml": "ocaml",
    "mli": "ocaml", "r": "r", "dart": "dart", "zig": "zig",
}
GRAMMAR_LANGUAGES = ["python", "javascript", "typescript", "java", "go", "rust", "c", "cpp"]
SKIP_DIRS = ["node_modules", "vendor", ".venv", "__pycache__", "build", "dist", "target", ".git", ".svn", ".hg", ".next"]
MAX_REPO_BYTES = 2_147_483_648
SNIFF_BYTES = 8192

SECTION_TITLES = {
    "executive_overview": "Executive Overview", "features": "Main Application Features", "personas": "User Personas", "user_stories": "User Stories",
    "security_requirements": "Security Requirements", "system_overview": "System Overview", "data_models": "Data Models",
    "interfaces": "Interface Specifications", "ui_specs": "UI Specifications", "api_specs": "API Specifications",
    "integrations": "Integration Points", "tech_stories": "Technical User Stories", "security_considerations": "Security Considerations",
}

#: (least length, required headings) of the gate of each section.
GATES = {
    "executive_overview": (300, []), "features": (200, ["Feature Areas"]), "system_overview": (200, ["Architecture Diagram"]), "data_models": (100, []),
    "api_specs": (100, []), "user_stories": (200, []), "tech_stories": (200, []), "security_requirements": (100, []),
    "security_considerations": (200, ["Coverage Summary"]), "integrations": (100, []), "interfaces": (100, []), "personas": (100, []), "ui_specs": (50, []),
}
PLACEHOLDERS = [
    "PROJECT NAME", "PROJECT_NAME", "TODO", "TBD", "PLACEHOLDER", "INSERT", "YOUR", "EXAMPLE", "MODULE NAME", "MODULE_NAME", "FUNCTION NAME",
    "FUNCTION_NAME", "CLASS NAME", "CLASS_NAME", "FILE PATH", "FILE_PATH", "DESCRIPTION", "DETAILS",
]
PLACEHOLDER_WORDS = ["TODO", "TBD", "INSERT", "YOUR", "EXAMPLE", "PLACEHOLDER"]

AUTH_WORDS = ["auth", "login", "logout", "token", "jwt", "oauth", "session", "password", "credential"]
AUTHZ_WORDS = ["permission", "role", "rbac", "scope", "access", "policy", "guard", "middleware"]
VULNERABLE_WORDS = ["eval", "exec", "system", "popen", "subprocess", "shell", "pickle", "deserialize", "unsafe", "raw_sql", "sql", "inject"]
SENSITIVE_WORDS = ["password", "secret", "key", "token", "credential", "private"]
UI_WORDS = ["component", "page", "view", "screen", "form", "modal", "dialog", "button", "input", "layout", "template", "widget"]
UI_SUFFIXES = [".tsx", ".jsx", ".vue", ".svelte"]
ROUTE_WORDS = ["route", "handler", "endpoint", "view"]
SERVICE_WORDS = ["service", "repository", "handler", "controller"]
PERSONAS = {
    "Administrator": ["admin", "manage", "dashboard", "config", "setting"],
    "Developer": ["api", "sdk", "webhook", "endpoint", "token"],
    "End User": ["login", "register", "profile", "account", "submit"],
}
OUTCOMES = {
    "validation": "data is validated correctly",
    "pricing": "pricing is calculated accurately",
    "workflow": "the workflow completes successfully",
    "access_control": "access is properly controlled",
    "data_constraint": "data integrity is maintained",
}
OTHER_OUTCOME = "the system behaves correctly"

STAGE_LABELS = {
    "ingestion_resolve": "Scanning codebase", "ingestion_detect": "Detecting languages", "ingestion_chunk": "Splitting source files",
    "static_analysis": "Parsing code structure", "llm_analysis": "AI analysis", "dual_analysis": "Cross-validating findings", "quality": "Scoring confidence",
    "intelligence_model": "Building Intelligence Model", "section_generation": "Generating documentation",
    "citation_verification": "Verifying citations", "persistence": "Saving results",
}

CHARS_PER_TOKEN = 4
MIN_EMBED_TOKENS, MAX_CHUNK_TOKENS, MAX_BATCH_TOKENS = 10, 8000, 250_000
CHUNK_TOKENS, MIN_CHUNK_LINES, OVERLAP_LINES = 6000, 10, 50
CONTEXT_CHARS, SNIPPET_CHARS, RRF_K, MAX_DISTANCE, TOP_K = 12_000, 400, 60, 1.5, 10
LOW_CONFIDENCE, FLOOR, CEILING = 0.60, 0.10, 0.95
REPLAY, STUCK_SECONDS = 500, 900
SECTION_CONCURRENCY = 5
DIAGRAM_EDGES, DIAGRAM_ENTITIES, DIAGRAM_CALLS, STORY_CALLS, PERSONA_NAMES = 50, 20, 30, 15, 10
CONTEXT_CAPS = {"entities": 30, "rules": 20, "risks": 10, "purposes": 15, "relationships": 20, "workflows": 5, "samples": 5}

#: Words that begin a table's constraint; bases and calls of mapped classes; verbs of routes; lines in which a handler follows its decorator.
TABLE_CONSTRAINTS = ["PRIMARY", "UNIQUE", "CHECK", "CONSTRAINT", "INDEX"]
ORM_BASES = ["Base", "Model", "DeclarativeBase"]
ORM_COLUMNS = ["Column", "mapped_column"]
HTTP_VERBS = ["get", "post", "put", "delete", "patch"]
HANDLER_LINES = 5

#: Patterns of identifier words and of placeholder marks.
IDENTIFIER_WORD = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[a-z]+|\d+"
PLACEHOLDER_MARK = r"\[([A-Z][A-Z0-9_\s]{2,30})\]"
