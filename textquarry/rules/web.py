"""Routes of web frameworks, and other fixed tables of the ecosystem extractors."""

from __future__ import annotations

# Source, ending of the file, gate on the content, prefix pattern (or none), route pattern with method and path.
ROUTES: list[tuple[str, str, str, str | None, str]] = [
    ("express", r"\.(js|ts|mjs|cjs)$", r"express|(app|router)\.(get|post|put|delete|patch|use)\s*\(", None, r"(?:app|router|\w+Router)\.(get|post|put|delete|patch|all)\s*\(\s*['\"`]([^'\"`]+)['\"`]"),
    ("koa", r"\.(js|ts|mjs|cjs)$", r"from\s+['\"]koa['\"]|require\s*\(['\"]koa['\"]|router\.(get|post|put|delete)", None, r"(?:router|app)\.(get|post|put|delete|patch|all)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("fastify", r"\.(js|ts|mjs|cjs)$", r"from\s+['\"]fastify['\"]|require\s*\(['\"]fastify['\"]|fastify\.(get|post|put|delete)", None, r"(?:fastify|app)\.(get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("nestjs", r"\.ts$", r"@Controller|@nestjs", r"@Controller\s*\(\s*['\"]([^'\"]*)['\"]\s*\)", r"@(Get|Post|Put|Delete|Patch)\s*\(\s*(?:['\"]([^'\"]*)['\"]\s*)?\)"),
    ("fastapi", r"\.py$", r"@(?:app|router)\.(get|post|put|delete)|from\s+fastapi", None, r"@(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("flask", r"\.py$", r"@(?:app|blueprint|router)\.(route|get|post|put|delete|patch)|from\s+flask", None, r"@(?:app|blueprint|router)\.(route|get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("rails", r"routes\.rb$", r"(get|post|put|patch|delete|resources?)\s+['\"]", None, r"(get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"]"),
    ("sinatra", r"\.rb$", r"sinatra", None, r"(get|post|put|delete|patch)\s+['\"]([^'\"]+)['\"]"),
    ("laravel", r"\.php$", r"Route::", None, r"Route::(get|post|put|delete|patch|any|match)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("spring", r"\.(java|kt)$", r"@(Rest)?Controller|@RequestMapping", r"@RequestMapping\s*\(\s*['\"]([^'\"]+)['\"]", r"@(Get|Post|Put|Delete|Patch)Mapping\s*\(\s*(?:value\s*=\s*)?['\"]([^'\"]*)['\"]"),
    ("gin", r"\.go$", r"gin-gonic|gin\.", None, r"(?:router|r|engine)\.(GET|POST|PUT|DELETE|PATCH|Any)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("echo", r"\.go$", r"labstack/echo", None, r"(?:e|app|router)\.(GET|POST|PUT|DELETE|PATCH|Any)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("fiber", r"\.go$", r"gofiber", None, r"(?:app|router)\.(Get|Post|Put|Delete|Patch|All)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("chi", r"\.go$", r"go-chi", None, r"(?:r|router|mux)\.(Get|Post|Put|Delete|Patch|Method)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("actix", r"\.rs$", r"actix", None, r"\.(route|get|post|put|delete)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("rocket", r"\.rs$", r"rocket", None, r"#\[(get|post|put|delete|patch|head|options)\s*\(['\"]([^'\"]+)['\"]"),
    ("axum", r"\.rs$", r"axum", None, r"\.(route|get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("aspnet", r"\.cs$", r"\[Http|\[ApiController", r"\[Route\s*\(\s*['\"]([^'\"]+)['\"]", r"\[Http(Get|Post|Put|Delete|Patch)\s*(?:\(\s*['\"]([^'\"]*)['\"]\s*)?\)\]"),
    ("jaxrs", r"\.(java|kt)$", r"javax\.ws\.rs|jakarta\.ws\.rs", r"@Path\s*\(\s*['\"]([^'\"]+)['\"]", r"@(GET|POST|PUT|DELETE|PATCH)\s+@Path\s*\(\s*['\"]([^'\"]*)['\"]"),
]

# Package, ecosystem, first version that is safe, severity.
ADVISORIES: list[tuple[str, str, str, str]] = [
    ("lodash", "npm", "4.17.21", "high"),
    ("minimist", "npm", "1.2.6", "high"),
    ("node-fetch", "npm", "2.6.7", "high"),
    ("axios", "npm", "1.6.0", "medium"),
    ("jsonwebtoken", "npm", "9.0.0", "high"),
    ("express", "npm", "4.19.2", "medium"),
    ("tar", "npm", "6.1.12", "high"),
    ("semver", "npm", "7.5.2", "medium"),
    ("xml2js", "npm", "0.5.0", "high"),
    ("got", "npm", "11.8.5", "medium"),
    ("moment", "npm", "999.0.0", "low"),
    ("request", "npm", "999.0.0", "low"),
    ("event-stream", "npm", "999.0.0", "critical"),
    ("ua-parser-js", "npm", "0.7.33", "critical"),
    ("colors", "npm", "1.4.0", "high"),
    ("faker", "npm", "5.5.3", "high"),
    ("pyyaml", "pip", "6.0", "high"),
    ("django", "pip", "4.2.0", "medium"),
    ("flask", "pip", "2.3.0", "low"),
    ("pillow", "pip", "10.0.0", "high"),
    ("cryptography", "pip", "41.0.0", "high"),
    ("urllib3", "pip", "2.0.0", "medium"),
    ("hyper", "cargo", "0.14.23", "high"),
    ("regex", "cargo", "1.8.0", "medium"),
]

# Package, estimated KB in a bundle.
HEAVY: list[tuple[str, int]] = [("moment", 290), ("lodash", 530), ("aws-sdk", 7500), ("firebase", 600), ("antd", 1200), ("@mui/material", 800), ("core-js", 500)]

# Top-level keys of a GitLab pipeline that aren't jobs.
GITLAB_KEYS = ["image", "services", "stages", "variables", "before_script", "after_script", "cache", "include", "workflow", "default", "pages"]

# Issue, severity, type of resource, key, value that is wrong (none: the key must be there).
MISCONFIGURED: list[tuple[str, str, str, str, str | None]] = [
    ("open-ingress", "warning", r"^(?!data\.).*security_group", r"ingress", r"0\.0\.0\.0/0"),
    ("no-versioning", "info", r"^(?!data\.).*s3_bucket", r"versioning", None),
    ("no-encryption", "warning", r"^(?!data\.).*(rds|db_instance)", r"encrypted", None),
    ("unpinned-image", "warning", r"^(docker-service|k8s/)", r"(^|/)image$", r":latest|^[^:]+$"),
    ("privileged", "error", r"^(docker-service|k8s/)", r"(^|/)(privileged|runAsRoot)$", r"^true$"),
    ("no-limits", "info", r"^k8s/Deployment$", r"(^|/)resources(/|$)", None),
]

# Issue, severity, ending of the file, top key, key, value that is wrong, whether the line is named.
MISCONFIGURED_ROWS: list[tuple[str, str, str, str | None, str, str, bool]] = [
    ("hardcoded-secret", "error", r"\.tf$", None, r"(?i)(password|secret|api_key|token)$", r'^"[^$"][^"]*"$', True),
    ("docker-socket", "warning", r"\.ya?ml$", "services", r"", r"^/var/run/docker\.sock:", False),
]
