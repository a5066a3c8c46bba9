"""Words of the concept search."""

from __future__ import annotations

# Synonyms of each concept.
CONCEPTS: dict[str, list[str]] = {
    "auth": ["auth", "login", "logout", "session", "token", "jwt", "oauth", "password", "credential", "authenticate", "authorize", "permission", "role", "rbac"],
    "database": ["database", "db", "sql", "query", "table", "schema", "migration", "model", "orm", "repository", "entity", "record", "row", "column", "index"],
    "api": ["api", "endpoint", "route", "handler", "controller", "middleware", "request", "response", "rest", "graphql", "grpc", "webhook"],
    "error": ["error", "exception", "catch", "throw", "try", "finally", "fault", "failure", "retry", "fallback", "recovery", "panic"],
    "test": ["test", "spec", "describe", "it", "expect", "assert", "mock", "stub", "fixture", "beforeEach", "afterEach", "jest", "mocha", "pytest"],
    "config": ["config", "configuration", "settings", "env", "environment", "option", "preference", "parameter", "setup", "initialize"],
    "cache": ["cache", "memoize", "redis", "memcache", "ttl", "invalidate", "expire", "store", "lru"],
    "log": ["log", "logger", "logging", "debug", "trace", "info", "warn", "console", "print", "output", "telemetry", "metric"],
    "security": ["security", "encrypt", "decrypt", "hash", "salt", "csrf", "xss", "sanitize", "validate", "escape", "cors", "helmet"],
    "ui": ["ui", "component", "render", "template", "view", "layout", "style", "css", "html", "dom", "element", "widget", "page"],
    "network": ["network", "http", "https", "fetch", "axios", "socket", "websocket", "tcp", "udp", "connection", "client", "server"],
    "file": ["file", "filesystem", "fs", "read", "write", "stream", "buffer", "path", "directory", "upload", "download"],
    "async": ["async", "await", "promise", "callback", "event", "emitter", "observable", "future", "channel", "concurrent", "parallel", "thread", "worker"],
    "validation": ["validate", "validation", "schema", "check", "verify", "constraint", "rule", "sanitize", "parse", "zod", "joi", "yup"],
    "payment": ["payment", "stripe", "billing", "invoice", "subscription", "charge", "refund", "checkout", "cart", "order", "price"],
}

# Words that are no terms.
STOP_WORDS: list[str] = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has", "its", "let", "var", "const",
    "new", "this", "that", "with", "from", "will", "have", "been", "more", "when", "who", "than", "them", "some", "what", "then", "each", "make",
    "like", "just", "use", "null", "void", "true", "false", "else", "case", "return", "import", "export", "default", "require", "module", "string",
    "number", "boolean", "object", "array", "type", "interface", "class", "function", "extends", "implements", "public", "private", "protected",
    "static", "abstract", "override", "readonly", "any", "undefined",
]
