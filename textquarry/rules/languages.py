"""Languages by file name, comment marks and categories."""

from __future__ import annotations

# Language of each file extension.
LANGUAGE_OF: dict[str, str] = {
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mts": "typescript",
    ".py": "python",
    ".pyi": "python",
    ".pyw": "python",
    ".java": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".scala": "scala",
    ".sbt": "scala",
    ".groovy": "groovy",
    ".clj": "clojure",
    ".cljs": "clojure",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".hxx": "cpp",
    ".vcxproj": "cpp",
    ".cs": "csharp",
    ".csproj": "csharp",
    ".sln": "csharp",
    ".m": "objectivec",
    ".mm": "objectivec",
    ".xcodeproj": "objectivec",
    ".pbxproj": "objectivec",
    ".go": "go",
    ".rs": "rust",
    ".zig": "zig",
    ".nim": "nim",
    ".swift": "swift",
    ".d": "dlang",
    ".cr": "crystal",
    ".v": "v",
    ".pas": "pascal",
    ".pp": "pascal",
    ".bas": "basic",
    ".vb": "vbnet",
    ".vbs": "vbscript",
    ".asm": "assembly",
    ".s": "assembly",
    ".asmx": "assembly",
    ".wat": "webassembly",
    ".wasm": "webassembly",
    ".rb": "ruby",
    ".rake": "ruby",
    ".php": "php",
    ".pl": "perl",
    ".pm": "perl",
    ".lua": "lua",
    ".r": "r",
    ".jl": "julia",
    ".ex": "elixir",
    ".exs": "elixir",
    ".heex": "elixir",
    ".eex": "elixir",
    ".leex": "elixir",
    ".erl": "erlang",
    ".hrl": "erlang",
    ".html": "html",
    ".htm": "html",
    ".css": "css",
    ".scss": "scss",
    ".sass": "sass",
    ".less": "less",
    ".vue": "vue",
    ".svelte": "svelte",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".xml": "xml",
    ".ini": "ini",
    ".env": "env",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".fish": "fish",
    ".ps1": "powershell",
    ".psm1": "powershell",
    ".bat": "batch",
    ".cmd": "batch",
    ".dart": "dart",
    ".hs": "haskell",
    ".lhs": "haskell",
    ".ml": "ocaml",
    ".mli": "ocaml",
    ".fs": "fsharp",
    ".fsi": "fsharp",
    ".fsx": "fsharp",
    ".sql": "sql",
    ".graphql": "graphql",
    ".gql": "graphql",
    ".proto": "protobuf",
    ".thrift": "thrift",
    ".tf": "terraform",
    ".hcl": "hcl",
    ".sol": "solidity",
    ".vy": "vyper",
    ".md": "markdown",
    ".mdx": "markdown",
    ".rst": "rst",
    ".txt": "text",
    ".dockerfile": "dockerfile",
    ".prisma": "prisma",
    ".dbml": "dbml",
    ".mdb": "access",
    ".accdb": "access",
    ".cmake": "cmake",
    ".makefile": "makefile",
    ".gradle": "gradle",
    ".maven": "maven",
    ".pom": "maven",
    ".adoc": "asciidoc",
    ".asciidoc": "asciidoc",
    ".tex": "latex",
    ".ltx": "latex",
    ".coffee": "coffeescript",
    ".litcoffee": "coffeescript",
    ".iced": "coffeescript",
    ".elm": "elm",
    ".re": "reason",
    ".rei": "reason",
    ".res": "rescript",
    ".resi": "rescript",
    ".purs": "purescript",
    ".gleam": "gleam",
    ".nix": "nix",
    ".dhall": "dhall",
    ".cue": "cue",
    ".bicep": "bicep",
    ".pkl": "pkl",
}

# File names (lower case, at the end of the path) that decide before the extension does, in order.
SPECIAL_NAMES: list[tuple[str, str]] = [
    ("dockerfile", "dockerfile"),
    ("makefile", "makefile"),
    ("gnumakefile", "makefile"),
    ("cmakelists.txt", "cmake"),
    (".cmake", "cmake"),
    ("rakefile", "ruby"),
    ("gemfile", "ruby"),
    ("cargo.toml", "toml"),
    ("cargo.lock", "toml"),
    ("requirements.txt", "python"),
    ("setup.py", "python"),
    ("pipfile", "python"),
    ("go.mod", "go"),
    ("go.sum", "go"),
    ("composer.json", "php"),
    ("composer.lock", "php"),
    ("package.json", "json"),
    ("package-lock.json", "json"),
    ("yarn.lock", "json"),
    ("pnpm-lock.yaml", "json"),
    ("mix.exs", "elixir"),
    ("project.clj", "clojure"),
    ("deps.edn", "clojure"),
    ("stack.yaml", "haskell"),
    ("cabal", "haskell"),
    ("dune", "ocaml"),
    ("opam", "ocaml"),
    ("build.sbt", "scala"),
    ("build.gradle", "gradle"),
    ("build.gradle.kts", "gradle"),
    ("pom.xml", "maven"),
    ("pubspec.yaml", "dart"),
    ("podfile", "ruby"),
]

# Known languages that aren't code.
NOT_CODE = ["text", "markdown", "rst", "json", "yaml", "toml", "xml", "ini", "env"]

# Single-line mark, start and end of block comments.
COMMENTS: dict[str, tuple[str | None, str | None, str | None]] = {
    "javascript": ("//", "/*", "*/"),
    "typescript": ("//", "/*", "*/"),
    "python": ("#", '"""', '"""'),
    "java": ("//", "/*", "*/"),
    "go": ("//", "/*", "*/"),
    "rust": ("//", "/*", "*/"),
    "cpp": ("//", "/*", "*/"),
    "c": ("//", "/*", "*/"),
    "csharp": ("//", "/*", "*/"),
    "ruby": ("#", "=begin", "=end"),
    "php": ("//", "/*", "*/"),
    "swift": ("//", "/*", "*/"),
    "kotlin": ("//", "/*", "*/"),
    "shell": ("#", None, None),
    "sql": ("--", "/*", "*/"),
    "lua": ("--", "--[[", "]]"),
    "haskell": ("--", "{-", "-}"),
    "elixir": ("#", None, None),
    "html": (None, "<!--", "-->"),
    "css": (None, "/*", "*/"),
}

# Categories of languages.
CATEGORIES: dict[str, list[str]] = {
    "Web Frontend": ["javascript", "typescript", "html", "css", "scss", "less", "vue", "svelte"],
    "Web Backend": ["python", "java", "csharp", "go", "rust", "ruby", "php", "elixir", "scala", "kotlin"],
    "Systems": ["c", "cpp", "rust", "zig", "nim", "dlang"],
    "Mobile": ["swift", "kotlin", "dart", "objectivec"],
    "Data/ML": ["python", "r", "julia", "sql"],
    "DevOps": ["shell", "dockerfile", "terraform", "hcl", "yaml"],
    "Functional": ["haskell", "ocaml", "fsharp", "clojure", "elixir", "erlang"],
    "Blockchain": ["solidity", "vyper", "rust"],
}
