"""Patterns of symbols and imports by language, for whole texts."""

from __future__ import annotations

GENERIC = "*"

# Language, kind, pattern whose first group is the name; tried in this order.
RULES: list[tuple[str, str, str]] = [
    ("javascript", "function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
    ("javascript", "function", r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\("),
    ("javascript", "function", r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\w*\s*=>"),
    ("javascript", "function", r"(\w+)\s*\(.*?\)\s*\{"),
    ("javascript", "class", r"(?:export\s+)?class\s+(\w+)"),
    ("javascript", "constant", r"(?:export\s+)?const\s+([A-Z_][A-Z0-9_]+)\s*="),
    ("javascript", "export", r"export\s+(?:default\s+)?(?:class|function|const|let|var)\s+(\w+)"),
    ("javascript", "export", r"module\.exports\s*=\s*(\w+)"),
    ("typescript", "function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
    ("typescript", "function", r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\("),
    ("typescript", "function", r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\w*\s*=>"),
    ("typescript", "class", r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("typescript", "interface", r"(?:export\s+)?interface\s+(\w+)"),
    ("typescript", "type", r"(?:export\s+)?type\s+(\w+)"),
    ("typescript", "constant", r"(?:export\s+)?const\s+([A-Z_][A-Z0-9_]+)\s*[:=]"),
    ("typescript", "export", r"export\s+(?:default\s+)?(?:class|function|const|let|var|type|interface|enum)\s+(\w+)"),
    ("python", "function", r"^(?:async\s+)?def\s+(\w+)"),
    ("python", "class", r"^class\s+(\w+)"),
    ("python", "type", r"^(\w+)\s*=\s*(?:TypeVar|NewType|Union|Optional|Literal)"),
    ("python", "constant", r"^([A-Z_][A-Z0-9_]+)\s*[:=]"),
    ("python", "export", r"^__all__\s*=\s*\[(.*?)\]"),
    ("java", "function", r"(?:public|private|protected|static|\s)+[\w<>\[\]]+\s+(\w+)\s*\("),
    ("java", "class", r"(?:public\s+)?(?:abstract\s+)?(?:final\s+)?class\s+(\w+)"),
    ("java", "interface", r"(?:public\s+)?interface\s+(\w+)"),
    ("java", "type", r"(?:public\s+)?enum\s+(\w+)"),
    ("java", "constant", r"(?:public|private|protected)?\s*static\s+final\s+\w+\s+([A-Z_][A-Z0-9_]+)"),
    ("go", "function", r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\("),
    ("go", "interface", r"type\s+(\w+)\s+interface\s*\{"),
    ("go", "type", r"type\s+(\w+)\s+(?:struct|int|string|float|bool|map|chan|\[)"),
    ("go", "constant", r"(?:const|var)\s+(\w+)"),
    ("rust", "function", r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"),
    ("rust", "interface", r"(?:pub\s+)?trait\s+(\w+)"),
    ("rust", "type", r"(?:pub\s+)?(?:struct|enum|type)\s+(\w+)"),
    ("rust", "constant", r"(?:pub\s+)?(?:const|static)\s+(\w+)"),
    ("rust", "export", r"pub\s+(?:use|mod)\s+(\w+)"),
    ("cpp", "function", r"(?:\w+[\s*&]+)?(\w+)\s*\([^)]*\)\s*(?:const\s*)?(?:override\s*)?(?:noexcept\s*)?[\{;]"),
    ("cpp", "class", r"(?:class|struct)\s+(\w+)"),
    ("cpp", "type", r"(?:typedef|using)\s+(\w+)"),
    ("cpp", "type", r"enum\s+(?:class\s+)?(\w+)"),
    ("cpp", "constant", r"(?:constexpr|const)\s+\w+\s+([A-Z_][A-Z0-9_]+)"),
    ("cpp", "constant", r"#define\s+([A-Z_][A-Z0-9_]+)"),
    ("c", "function", r"(?:\w+[\s*]+)?(\w+)\s*\([^)]*\)\s*[\{;]"),
    ("c", "type", r"typedef\s+(?:struct|enum|union)\s+\w*\s*\{[^}]*\}\s*(\w+)"),
    ("c", "type", r"typedef\s+\w+\s+(\w+)"),
    ("c", "constant", r"#define\s+([A-Z_][A-Z0-9_]+)"),
    ("csharp", "function", r"(?:public|private|protected|internal|static|async|virtual|override|\s)+[\w<>\[\]?]+\s+(\w+)\s*[(<]"),
    ("csharp", "class", r"(?:public\s+)?(?:abstract\s+)?(?:partial\s+)?(?:static\s+)?class\s+(\w+)"),
    ("csharp", "interface", r"(?:public\s+)?interface\s+(\w+)"),
    ("csharp", "type", r"(?:public\s+)?(?:enum|struct|record)\s+(\w+)"),
    ("csharp", "constant", r"(?:public|private|protected|internal)\s+(?:static\s+)?(?:readonly\s+)?const\s+\w+\s+(\w+)"),
    ("ruby", "function", r"def\s+(?:self\.)?(\w+[?!=]?)"),
    ("ruby", "class", r"class\s+(\w+)"),
    ("ruby", "type", r"module\s+(\w+)"),
    ("ruby", "constant", r"([A-Z_][A-Z0-9_]+)\s*="),
    ("php", "function", r"(?:public|private|protected|static|\s)*function\s+(\w+)"),
    ("php", "class", r"(?:abstract\s+)?class\s+(\w+)"),
    ("php", "interface", r"interface\s+(\w+)"),
    ("php", "type", r"(?:trait|enum)\s+(\w+)"),
    ("php", "constant", r"(?:const|define\(')(\w+)"),
    ("swift", "function", r"(?:public\s+)?(?:static\s+)?func\s+(\w+)"),
    ("swift", "class", r"(?:public\s+)?(?:final\s+)?class\s+(\w+)"),
    ("swift", "interface", r"(?:public\s+)?protocol\s+(\w+)"),
    ("swift", "type", r"(?:public\s+)?(?:struct|enum)\s+(\w+)"),
    ("swift", "constant", r"(?:let|static\s+let)\s+(\w+)"),
    ("kotlin", "function", r"(?:fun|suspend\s+fun)\s+(?:<.*?>\s+)?(\w+)"),
    ("kotlin", "class", r"(?:data\s+)?(?:abstract\s+)?(?:open\s+)?class\s+(\w+)"),
    ("kotlin", "interface", r"interface\s+(\w+)"),
    ("kotlin", "type", r"(?:enum\s+class|typealias|object)\s+(\w+)"),
    ("kotlin", "constant", r"(?:const\s+val|val)\s+([A-Z_][A-Z0-9_]+)"),
    ("dart", "function", r"(?:\w+[\s<>]*\s+)?(\w+)\s*\([^)]*\)\s*(?:async\s*)?[\{=>]"),
    ("dart", "class", r"(?:abstract\s+)?class\s+(\w+)"),
    ("dart", "type", r"(?:enum|mixin|extension)\s+(\w+)"),
    ("dart", "constant", r"(?:const|final)\s+\w+\s+([A-Z_]\w+)"),
    ("scala", "function", r"def\s+(\w+)"),
    ("scala", "class", r"(?:case\s+)?class\s+(\w+)"),
    ("scala", "interface", r"trait\s+(\w+)"),
    ("scala", "type", r"(?:type|object)\s+(\w+)"),
    ("scala", "constant", r"val\s+([A-Z_]\w+)"),
    ("elixir", "function", r"def[p]?\s+(\w+)"),
    ("elixir", "interface", r"defprotocol\s+(\w+)"),
    ("elixir", "type", r"defmodule\s+([\w.]+)"),
    ("haskell", "function", r"^(\w+)\s+::"),
    ("haskell", "class", r"^class\s+(\w+)"),
    ("haskell", "type", r"^(?:data|type|newtype)\s+(\w+)"),
    ("haskell", "export", r"module\s+(\w+(?:\.\w+)*)"),
    ("lua", "function", r"(?:local\s+)?function\s+(?:[\w.:]+\.)?(\w+)"),
    ("lua", "function", r"(\w+)\s*=\s*function"),
    ("sql", "function", r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE)\s+(\w+)"),
    ("sql", "type", r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW|TYPE|INDEX)\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)"),
    ("solidity", "function", r"function\s+(\w+)"),
    ("solidity", "class", r"contract\s+(\w+)"),
    ("solidity", "interface", r"interface\s+(\w+)"),
    ("solidity", "type", r"(?:struct|enum|event)\s+(\w+)"),
    ("terraform", "type", r"(?:resource|data|module|variable|output)\s+\"(\w+)\""),
    ("terraform", "constant", r"variable\s+\"(\w+)\""),
    ("terraform", "export", r"output\s+\"(\w+)\""),
    ("crystal", "function", r"def\s+(\w+[?!=]?)"),
    ("crystal", "class", r"class\s+(\w+)"),
    ("crystal", "interface", r"module\s+(\w+)"),
    ("crystal", "type", r"struct\s+(\w+)"),
    ("crystal", "constant", r"([A-Z_][A-Z0-9_]+)\s*="),
    ("coffeescript", "function", r"(?:(\w+)\s*[:=]\s*)?(?:\([^)]*\)\s*)?[-=]>"),
    ("coffeescript", "function", r"(\w+)\s*:\s*[-=]>"),
    ("coffeescript", "class", r"class\s+(\w+)"),
    ("coffeescript", "constant", r"([A-Z_][A-Z0-9_]+)\s*="),
    ("coffeescript", "export", r"module\.exports\s*=\s*(\w+)"),
    ("elm", "function", r"^(\w+)\s*:"),
    ("elm", "class", r"^type\s+(?:alias\s+)?(\w+)"),
    ("elm", "type", r"^type\s+(?:alias\s+)?(\w+)"),
    ("elm", "export", r"^(\w+)\s*exposing"),
    ("pascal", "function", r"procedure\s+(\w+)"),
    ("pascal", "function", r"function\s+(\w+)"),
    ("pascal", "type", r"type\s+(\w+)"),
    ("pascal", "constant", r"const\s+(\w+)"),
    ("vbnet", "function", r"(?:Public|Private|Protected|Friend)\s+(?:Shared\s+)?(?:Function|Sub)\s+(\w+)"),
    ("vbnet", "class", r"Public\s+(?:Class|Module)\s+(\w+)"),
    ("vbnet", "interface", r"Public\s+Interface\s+(\w+)"),
    ("vbnet", "type", r"Public\s+(?:Structure|Enum)\s+(\w+)"),
    ("vbnet", "constant", r"Public\s+Const\s+(\w+)"),
    (GENERIC, "function", r"(?:function|func|fn|def|sub|proc|method)\s+(\w+)"),
    (GENERIC, "function", r"(?:public|private|protected|static|\s)+[\w<>\[\]*&]+\s+(\w+)\s*\("),
    (GENERIC, "class", r"(?:class|struct|record)\s+(\w+)"),
    (GENERIC, "interface", r"(?:interface|trait|protocol)\s+(\w+)"),
    (GENERIC, "type", r"(?:type|typedef|enum|union)\s+(\w+)"),
    (GENERIC, "constant", r"(?:const|final|static)\s+[\w<>\[\]]+\s+([A-Z_][A-Z0-9_]+)"),
    (GENERIC, "export", r"(?:export|pub|public)\s+(?:\w+\s+)*(\w+)"),
]

LANGUAGES = {rule[0] for rule in RULES} - {GENERIC}

# Language, pattern whose first group is what a file imports.
IMPORTS: list[tuple[str, str]] = [
    ("javascript", r"import\s+.*?\s+from\s+['\"](.+?)['\"]"),
    ("javascript", r"import\s*\(\s*['\"](.+?)['\"]\s*\)"),
    ("javascript", r"require\s*\(\s*['\"](.+?)['\"]\s*\)"),
    ("typescript", r"import\s+.*?\s+from\s+['\"](.+?)['\"]"),
    ("typescript", r"import\s+type\s+.*?\s+from\s+['\"](.+?)['\"]"),
    ("typescript", r"import\s*\(\s*['\"](.+?)['\"]\s*\)"),
    ("typescript", r"require\s*\(\s*['\"](.+?)['\"]\s*\)"),
    ("python", r"^import\s+([\w.]+)"),
    ("python", r"^from\s+([\w.]+)\s+import"),
    ("java", r"^import\s+(?:static\s+)?([\w.]+)"),
    ("go", r"[\"']([\w./]+)[\"']"),
    ("rust", r"use\s+([\w:]+)"),
    ("cpp", r"#include\s*[<\"]([\w./]+)[>\"]"),
    ("c", r"#include\s*[<\"]([\w./]+)[>\"]"),
    ("csharp", r"using\s+([\w.]+)"),
    ("ruby", r"require(?:_relative)?\s+['\"](.+?)['\"]"),
    ("php", r"(?:use|require|include)(?:_once)?\s+['\"]?(.+?)['\"]?\s*;"),
    ("swift", r"import\s+(\w+)"),
    ("kotlin", r"import\s+([\w.]+)"),
    ("dart", r"import\s+['\"](.+?)['\"]"),
    ("scala", r"import\s+([\w.\{\}]+)"),
    ("elixir", r"(?:import|alias|use|require)\s+([\w.]+)"),
    ("haskell", r"import\s+(?:qualified\s+)?([\w.]+)"),
    ("lua", r"require\s*\(?['\"](.+?)['\"]\)?"),
]

# Words before a bracket that aren't calls.
NOT_CALLS = ["if", "for", "while", "switch", "catch", "return", "new", "typeof", "console"]

# Exported names and paths that something outside uses.
ENTRY_NAMES = ["main", "default", "index", "app", "handler", "setup", "init"]
ENTRY_PATHS = r"(^|/)(index|main|app|server|cli|config)\.[^/]+$"
