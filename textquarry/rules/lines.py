"""Rules on single lines: security, quality and complexity patterns.

Patterns are written for Java's and RE2's dialects alike; word boundaries are those of ASCII words.
"""

from __future__ import annotations

#: Stands before or after an ASCII word where a pattern needs its boundary.
AHEAD, BEHIND = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def word(pattern: str) -> str:
    """pattern as a whole ASCII word."""
    return f"{AHEAD}(?:{pattern}){BEHIND}"


# Name, category, severity, pattern, ignores case.
SECURITY: list[tuple[str, str, str, str, bool]] = [
    ("SQL injection risk", "injection", "critical", r"(?:query|execute|exec|raw)\s*\(\s*[`'\"]\s*(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER).*?\$\{|%s|%d|\+\s*\w", True),
    ("Command injection risk", "injection", "critical", r"(?:exec|spawn|system|popen|subprocess\.(?:call|run|Popen))\s*\([^)]*(?:\$\{|\+\s*\w|%s|f['\"]\s*\{)", False),
    ("Potential XSS via innerHTML", "xss", "high", r"\.innerHTML\s*=|dangerouslySetInnerHTML|v-html\s*=", False),
    ("Hardcoded secret/credential", "secrets", "critical", r"(?:password|secret|api_key|apikey|token|private_key|access_key|auth_token|client_secret)\s*[:=]\s*['\"]\S{8,}['\"]", True),
    ("Credential in URL", "secrets", "high", r"(?:https?|ftp)://\w+:\w+@", False),
    ("Insecure randomness", "crypto", "medium", r"Math\.random\(\)|random\.random\(\)|rand\(\)", False),
    ("Weak hash algorithm (MD5/SHA1)", "crypto", "medium", r"(?:createHash|hashlib\.md5|hashlib\.sha1|MD5|SHA1)\s*\(", False),
    ("Dangerous eval() usage", "injection", "high", r"(?<![A-Za-z0-9_])eval\s*\((?!['\"][^'\"]+['\"])|new\s+Function\s*\(", False),
    ("CORS wildcard origin", "config", "medium", r"(?:Access-Control-Allow-Origin|cors)\s*[:(\{]\s*['\"]\*['\"]", False),
    ("Open redirect risk", "redirect", "medium", r"(?:redirect|location\.href|window\.location)\s*=\s*(?:req\.|request\.|params\.|query\.)", False),
    ("TLS/SSL verification disabled", "config", "high", r"verify\s*=\s*False|rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0", False),
    ("Debug mode enabled", "config", "medium", r"DEBUG\s*=\s*True|debug\s*:\s*true|app\.debug\s*=\s*True", False),
    ("Swallowed security exception", "error-handling", "low", r"catch\s*\([^)]*\)\s*\{\s*\}|except:\s*pass", False),
    ("Path traversal risk", "injection", "high", r"path\.join\s*\([^)]*req\.|path\.resolve\s*\([^)]*req\.|os\.path\.join\s*\([^)]*request\.", False),
    ("JWT without verification", "auth", "high", r"jwt\.decode\s*\([^)]*verify\s*=\s*False|algorithms\s*=\s*\[\s*['\"]none['\"]", False),
]

#: Of each security rule literals of which a line that breaks it holds one; in lower case if the rule ignores case.
LITERALS: dict[str, list[str]] = {
    "SQL injection risk": ["${", "%s", "%d", "+"],
    "Command injection risk": ["exec", "spawn", "system", "popen", "subprocess."],
    "Potential XSS via innerHTML": [".innerHTML", "dangerouslySetInnerHTML", "v-html"],
    "Hardcoded secret/credential": ["password", "secret", "api_key", "apikey", "token", "private_key", "access_key"],
    "Credential in URL": ["://"],
    "Insecure randomness": ["Math.random()", "random.random()", "rand()"],
    "Weak hash algorithm (MD5/SHA1)": ["createHash", "hashlib.", "MD5", "SHA1"],
    "Dangerous eval() usage": ["eval", "Function"],
    "CORS wildcard origin": ["Access-Control-Allow-Origin", "cors"],
    "Open redirect risk": ["redirect", "location"],
    "TLS/SSL verification disabled": ["verify", "rejectUnauthorized", "NODE_TLS_REJECT_UNAUTHORIZED"],
    "Debug mode enabled": ["DEBUG", "debug"],
    "Swallowed security exception": ["catch", "except:"],
    "Path traversal risk": ["path.join", "path.resolve"],
    "JWT without verification": ["jwt.decode", "algorithms"],
}

# Files that should not be in a tree; all high, secrets.
INSECURE_FILES = [".env", "id_rsa", "id_ed25519", ".npmrc", ".pypirc"]

# Severities from worst to least.
SEVERITIES = ["critical", "high", "medium", "low", "info"]

# Quality rules on lines, all without regard to case.
TODOS = r"(//|/\*|#|<!--).*?(TODO|FIXME|HACK|XXX|BUG|OPTIMIZE)(?![A-Za-z0-9_])"
DEBUG_LOGS = r"console\.(log|debug|info|warn|error)|print\(|println!|fmt\.Print|System\.out|Debug\.Log"
SECRETS = r"(password|secret|api_key|apikey|token|credential)\s*[:=]\s*[\"'][^\"']+[\"']"

# Words that count as decisions in a file's complexity, and marks that do.
DECISION_WORDS = ["if", r"else\s+if", "elif", "for", "while", "do", "switch", "case", "match", "catch", "except", "rescue", "when", "guard"]
DECISION_MARKS = [r"\?\?", r"\?\.", "&&", r"\|\|"]

# The same for cyclomatic complexity in heat maps.
CYCLOMATIC_WORDS = ["if", r"else\s+if", "while", "for", "case", "catch"]
CYCLOMATIC_MARKS = ["&&", r"\|\|", r"\?[^.?:]"]
NESTING_WORDS = "if|elif|while|for|switch|match"

# Layer rules: files whose path has the first must not import paths that have one of the others.
LAYER_RULES = [
    ("no-controller-in-model", "controllers", ["models", "database", "db", "repositories"], "error"),
    ("no-upward-dependency", "utils", ["services", "controllers", "routes", "handlers"], "warning"),
]
