"""Expected rows of the queries over the sample trees: name -> (columns with types, rows)."""

from __future__ import annotations

ROWS: dict[str, tuple[list[tuple[str, str]], list[tuple]]] = {
    "detect_language": (
        [("path", "string"), ("language", "string"), ("code", "boolean"), ("category", "string")],
        [
            ('.env', 'env', False, 'General'),
            ('.github/workflows/ci.yml', 'yaml', False, 'DevOps'),
            ('App.csproj', 'csharp', True, 'Web Backend'),
            ('Cargo.toml', 'toml', False, 'General'),
            ('Dockerfile', 'dockerfile', True, 'DevOps'),
            ('a/b/Script.PY', 'python', True, 'Web Backend, Data/ML'),
            ('build.gradle.kts', 'gradle', True, 'General'),
            ('docs/readme.md', 'markdown', False, 'General'),
            ('go.mod', 'go', True, 'Web Backend'),
            ('infra/main.tf', 'terraform', True, 'DevOps'),
            ('keys/id_rsa', 'unknown', False, 'General'),
            ('next.config.js', 'javascript', True, 'Web Frontend'),
            ('noext', 'unknown', False, 'General'),
            ('package.json', 'json', False, 'General'),
            ('packages/a/package.json', 'json', False, 'General'),
            ('packages/b/package.json', 'json', False, 'General'),
            ('pom.xml', 'maven', True, 'General'),
            ('requirements.txt', 'python', True, 'Web Backend, Data/ML'),
            ('tests/test_x.py', 'python', True, 'Web Backend, Data/ML'),
            ('weird.unknownext', 'unknown', False, 'General'),
        ],
    ),
    "codebase_map": (
        [("total_files", "bigint"), ("code_files", "bigint"), ("directories", "bigint"), ("has_tests", "boolean"), ("has_ci", "boolean"), ("has_docs", "boolean"), ("has_docker", "boolean"), ("size_class", "string"), ("main_language", "string")],
        [
            (20, 10, 8, True, True, True, True, 'small', 'python'),
        ],
    ),
    "detect_frameworks": (
        [("framework", "string"), ("evidence", "string"), ("files", "bigint")],
        [
            ('.NET', 'App.csproj', 1),
            ('Next.js', 'next.config.js', 1),
            ('React', 'package.json', 1),
            ('Spring Boot', 'pom.xml', 1),
            ('Terraform', 'infra/main.tf', 1),
        ],
    ),
    "detect_package_managers": (
        [("manager", "string"), ("files", "bigint")],
        [
            ('cargo', 1),
            ('go modules', 1),
            ('gradle', 1),
            ('maven', 1),
            ('npm', 3),
            ('pip', 1),
        ],
    ),
    "insecure_files": (
        [("path", "string"), ("severity", "string"), ("category", "string")],
        [
            ('.env', 'high', 'secrets'),
            ('keys/id_rsa', 'high', 'secrets'),
        ],
    ),
    "symbols": (
        [("path", "string"), ("name", "string"), ("kind", "string"), ("line_no", "bigint"), ("language", "string"), ("signature", "string")],
        [
            ('app/copy.py', 'one', 'function', 1, 'python', 'def one(values):'),
            ('app/copy2.py', 'one', 'function', 1, 'python', 'def one(values):'),
            ('app/tools.py', 'LIMIT', 'constant', 4, 'python', 'LIMIT = 5'),
            ('app/tools.py', 'Store', 'class', 18, 'python', 'class Store:'),
            ('app/tools.py', 'read', 'function', 7, 'python', 'def read(path):'),
            ('cmd/main.go', 'Serve', 'function', 8, 'go', 'func Serve(port int) error {'),
            ('cmd/main.go', 'Server', 'type', 13, 'go', 'type Server struct {'),
            ('lib/core.rs', 'Door', 'type', 10, 'rust', 'pub struct Door {'),
            ('lib/core.rs', 'open', 'function', 4, 'rust', 'pub fn open(path: &str) -> bool {'),
            ('src/controllers/user.ts', 'show', 'export', 3, 'typescript', 'export function show(id: number): User {'),
            ('src/controllers/user.ts', 'show', 'function', 3, 'typescript', 'export function show(id: number): User {'),
            ('src/index.ts', 'main', 'export', 4, 'typescript', 'export function main(): void {'),
            ('src/index.ts', 'main', 'function', 4, 'typescript', 'export function main(): void {'),
            ('src/models/user.ts', 'User', 'class', 3, 'typescript', 'export class User {'),
            ('src/models/user.ts', 'User', 'export', 3, 'typescript', 'export class User {'),
            ('src/orphan.ts', 'lonely', 'export', 1, 'typescript', 'export const lonely = true;'),
            ('src/runner.ts', 'helper', 'function', 17, 'typescript', 'function helper(n: number): number {'),
            ('src/runner.ts', 'run', 'export', 9, 'typescript', 'export function run(job: Job): number {'),
            ('src/runner.ts', 'run', 'function', 9, 'typescript', 'export function run(job: Job): number {'),
            ('src/runner.ts', 'unusedExport', 'export', 21, 'typescript', 'export function unusedExport(): void {'),
            ('src/runner.ts', 'unusedExport', 'function', 21, 'typescript', 'export function unusedExport(): void {'),
            ('src/services/audit.ts', 'audit', 'export', 3, 'typescript', 'export function audit(text: string): void {'),
            ('src/services/audit.ts', 'audit', 'function', 3, 'typescript', 'export function audit(text: string): void {'),
            ('src/types.ts', 'Job', 'export', 1, 'typescript', 'export interface Job {'),
            ('src/types.ts', 'Job', 'interface', 1, 'typescript', 'export interface Job {'),
            ('src/types.ts', 'Jobs', 'export', 6, 'typescript', 'export type Jobs = Array<Job>;'),
            ('src/types.ts', 'Jobs', 'type', 6, 'typescript', 'export type Jobs = Array<Job>;'),
            ('src/types.ts', 'Task', 'class', 8, 'typescript', 'export class Task implements Job {'),
            ('src/types.ts', 'Task', 'export', 8, 'typescript', 'export class Task implements Job {'),
            ('src/utils/log.ts', 'MAX_LINES', 'constant', 3, 'typescript', 'export const MAX_LINES = 10;'),
            ('src/utils/log.ts', 'MAX_LINES', 'export', 3, 'typescript', 'export const MAX_LINES = 10;'),
            ('src/utils/log.ts', 'log', 'export', 4, 'typescript', 'export const log = (text: string) => {'),
            ('src/utils/log.ts', 'log', 'function', 4, 'typescript', 'export const log = (text: string) => {'),
            ('web/Main.java', 'Main', 'class', 3, 'java', 'public class Main {'),
            ('web/Main.java', 'start', 'function', 5, 'java', 'public static void start(String[] args) {'),
            ('web/école.js', 'while', 'function', 3, 'javascript', 'while (true) { eval(x); }'),
        ],
    ),
    "symbol_search": (
        [("path", "string"), ("name", "string"), ("kind", "string"), ("line_no", "bigint")],
        [
            ('src/runner.ts', 'run', 'export', 9),
            ('src/runner.ts', 'run', 'function', 9),
        ],
    ),
    "symbols_of_language": (
        [("path", "string"), ("name", "string"), ("kind", "string"), ("line_no", "bigint")],
        [
            ('app/copy.py', 'one', 'function', 1),
            ('app/copy2.py', 'one', 'function', 1),
            ('app/tools.py', 'read', 'function', 7),
        ],
    ),
    "imports": (
        [("path", "string"), ("import_path", "string")],
        [
            ('app/tools.py', 'json'),
            ('app/tools.py', 'os'),
            ('cmd/main.go', 'fmt'),
            ('lib/core.rs', 'std::fs'),
            ('src/controllers/user.ts', '../models/user'),
            ('src/index.ts', './runner'),
            ('src/index.ts', './types'),
            ('src/models/a.ts', './b'),
            ('src/models/b.ts', './c'),
            ('src/models/c.ts', './a'),
            ('src/models/c.ts', './c'),
            ('src/models/user.ts', './a'),
            ('src/runner.ts', './types'),
            ('src/runner.ts', './utils/log'),
            ('src/services/audit.ts', '../utils/log'),
            ('src/utils/log.ts', '../services/audit'),
            ('tests/runner.test.ts', '../src/runner'),
            ('web/Main.java', 'java.util.List'),
            ('web/école.js', 'fs'),
        ],
    ),
    "dependency_graph": (
        [("path", "string"), ("n", "bigint"), ("imports", "string")],
        [
            ('app/tools.py', 2, 'json os'),
            ('cmd/main.go', 1, 'fmt'),
            ('lib/core.rs', 1, 'std::fs'),
            ('src/controllers/user.ts', 1, '../models/user'),
            ('src/index.ts', 2, './runner ./types'),
            ('src/models/a.ts', 1, './b'),
            ('src/models/b.ts', 1, './c'),
            ('src/models/c.ts', 2, './a ./c'),
            ('src/models/user.ts', 1, './a'),
            ('src/runner.ts', 2, './types ./utils/log'),
            ('src/services/audit.ts', 1, '../utils/log'),
            ('src/utils/log.ts', 1, '../services/audit'),
            ('tests/runner.test.ts', 1, '../src/runner'),
            ('web/Main.java', 1, 'java.util.List'),
            ('web/école.js', 1, 'fs'),
        ],
    ),
    "importers": (
        [("path", "string")],
        [
            ('src/index.ts',),
            ('src/runner.ts',),
        ],
    ),
    "call_graph": (
        [("path", "string"), ("caller", "string"), ("callee", "string"), ("line_no", "bigint")],
        [
            ('app/tools.py', 'put', 'range', 20),
            ('app/tools.py', 'put', 'read', 22),
            ('app/tools.py', 'read', 'open', 14),
            ('app/tools.py', 'read', 'parse', 14),
            ('app/tools.py', 'read', 'read', 14),
            ('cmd/main.go', '<module>', 'import', 3),
            ('cmd/main.go', 'Serve', 'Println', 9),
            ('config/app.js', '<module>', 'fetch', 3),
            ('config/app.js', '<module>', 'query', 4),
            ('config/app.js', '<module>', 'random', 5),
            ('src/controllers/user.ts', 'show', 'find', 4),
            ('src/index.ts', 'main', 'run', 5),
            ('src/models/user.ts', '<module>', 'User', 5),
            ('src/models/user.ts', '<module>', 'find', 4),
            ('src/runner.ts', 'run', 'helper', 12),
            ('src/runner.ts', 'run', 'log', 11),
            ('src/runner.ts', 'unusedExport', 'log', 22),
            ('src/services/audit.ts', 'audit', 'log', 5),
            ('src/utils/log.ts', '<module>', 'log', 6),
            ('tests/runner.test.ts', '<module>', 'run', 3),
            ('web/Main.java', '<module>', 'println', 6),
            ('web/Main.java', '<module>', 'start', 5),
            ('web/école.js', '<module>', 'eval', 3),
            ('web/école.js', '<module>', 'require', 2),
        ],
    ),
    "import_edges": (
        [("src", "string"), ("dst", "string")],
        [
            ('src/controllers/user', 'src/models/user'),
            ('src/index', 'src/runner'),
            ('src/index', 'src/types'),
            ('src/models/a', 'src/models/b'),
            ('src/models/b', 'src/models/c'),
            ('src/models/c', 'src/models/a'),
            ('src/models/c', 'src/models/c'),
            ('src/models/user', 'src/models/a'),
            ('src/runner', 'src/types'),
            ('src/runner', 'src/utils/log'),
            ('src/services/audit', 'src/utils/log'),
            ('src/utils/log', 'src/services/audit'),
            ('tests/runner.test', 'src/runner'),
        ],
    ),
    "circular_imports": (
        [("node", "string"), ("cycle", "string")],
        [
            ('src/models/a', 'src/models/a'),
            ('src/models/b', 'src/models/a'),
            ('src/models/c', 'src/models/a'),
            ('src/services/audit', 'src/services/audit'),
            ('src/utils/log', 'src/services/audit'),
        ],
    ),
    "self_imports": (
        [("node", "string")],
        [
            ('src/models/c',),
        ],
    ),
    "layer_violations": (
        [("path", "string"), ("import_path", "string"), ("rule", "string"), ("severity", "string")],
        [
            ('src/controllers/user.ts', '../models/user', 'no-controller-in-model', 'error'),
            ('src/utils/log.ts', '../services/audit', 'no-upward-dependency', 'warning'),
        ],
    ),
    "type_flow": (
        [("path", "string"), ("line_no", "int"), ("kind", "string")],
        [
            ('src/index.ts', 2, 'import'),
            ('src/runner.ts', 1, 'import'),
            ('src/runner.ts', 9, 'parameter'),
            ('src/types.ts', 1, 'definition'),
            ('src/types.ts', 6, 'generic'),
            ('src/types.ts', 8, 'extends'),
        ],
    ),
    "dead_exports": (
        [("path", "string"), ("name", "string"), ("line_no", "bigint"), ("kind", "string")],
        [
            ('src/controllers/user.ts', 'show', 3, 'export'),
            ('src/orphan.ts', 'lonely', 1, 'export'),
            ('src/runner.ts', 'unusedExport', 21, 'export'),
            ('src/types.ts', 'Jobs', 6, 'export'),
            ('src/types.ts', 'Task', 8, 'class'),
            ('src/utils/log.ts', 'MAX_LINES', 3, 'constant'),
        ],
    ),
    "orphan_files": (
        [("path", "string")],
        [
            ('app/copy.py',),
            ('app/copy2.py',),
            ('app/tools.py',),
            ('lib/core.rs',),
            ('src/orphan.ts',),
            ('web/Main.java',),
            ('web/école.js',),
        ],
    ),
    "find_dead_code": (
        [("path", "string"), ("name", "string"), ("kind", "string"), ("line_no", "bigint")],
        [
            ('lib/core.rs', 'Door', 'type', 10),
            ('src/controllers/user.ts', 'show', 'export', 3),
            ('src/controllers/user.ts', 'show', 'function', 3),
            ('src/orphan.ts', 'lonely', 'export', 1),
            ('src/runner.ts', 'unusedExport', 'export', 21),
            ('src/runner.ts', 'unusedExport', 'function', 21),
            ('src/types.ts', 'Jobs', 'export', 6),
            ('src/types.ts', 'Jobs', 'type', 6),
            ('src/types.ts', 'Task', 'class', 8),
            ('src/types.ts', 'Task', 'export', 8),
            ('src/utils/log.ts', 'MAX_LINES', 'constant', 3),
            ('src/utils/log.ts', 'MAX_LINES', 'export', 3),
            ('web/Main.java', 'Main', 'class', 3),
        ],
    ),
    "index_stale": (
        [("path", "string")],
        [
            ('b.ts',),
            ('d.ts',),
        ],
    ),
    "index_update": (
        [("path", "string"), ("mtime", "bigint")],
        [
            ('a.ts', 1),
            ('b.ts', 5),
            ('c.ts', 3),
            ('d.ts', 4),
        ],
    ),
    "index_remove": (
        [("path", "string"), ("mtime", "bigint")],
        [
            ('c.ts', 3),
        ],
    ),
    "index_stats": (
        [("symbols", "bigint"), ("files", "bigint")],
        [
            (36, 15),
        ],
    ),
    "line_types": (
        [("path", "string"), ("language", "string"), ("lines", "bigint"), ("code", "bigint"), ("comment", "bigint"), ("blank", "bigint")],
        [
            ('app/copy.py', 'python', 7, 6, 0, 1),
            ('app/copy2.py', 'python', 7, 6, 0, 1),
            ('app/tools.py', 'python', 24, 13, 4, 7),
            ('cmd/main.go', 'go', 16, 11, 1, 4),
            ('config/app.js', 'javascript', 6, 5, 0, 1),
            ('lib/core.rs', 'rust', 13, 9, 1, 3),
            ('src/controllers/user.ts', 'typescript', 6, 4, 0, 2),
            ('src/index.ts', 'typescript', 7, 5, 0, 2),
            ('src/models/a.ts', 'typescript', 3, 2, 0, 1),
            ('src/models/b.ts', 'typescript', 3, 2, 0, 1),
            ('src/models/c.ts', 'typescript', 4, 3, 0, 1),
            ('src/models/user.ts', 'typescript', 8, 6, 0, 2),
            ('src/orphan.ts', 'typescript', 2, 1, 0, 1),
            ('src/runner.ts', 'typescript', 24, 15, 5, 4),
            ('src/services/audit.ts', 'typescript', 10, 7, 1, 2),
            ('src/types.ts', 'typescript', 11, 8, 0, 3),
            ('src/utils/log.ts', 'typescript', 8, 5, 1, 2),
            ('tests/runner.test.ts', 'typescript', 4, 2, 0, 2),
            ('web/Main.java', 'java', 9, 6, 1, 2),
            ('web/école.js', 'javascript', 5, 3, 1, 1),
        ],
    ),
    "code_metrics": (
        [("path", "string"), ("language", "string"), ("lines", "bigint"), ("code", "bigint"), ("comment", "bigint"), ("blank", "bigint"), ("complexity", "bigint"), ("comment_ratio", "double")],
        [
            ('app/copy.py', 'python', 7, 6, 0, 1, 2, 0.0),
            ('app/copy2.py', 'python', 7, 6, 0, 1, 2, 0.0),
            ('app/tools.py', 'python', 24, 13, 4, 7, 4, 0.235294),
            ('cmd/main.go', 'go', 16, 11, 1, 4, 1, 0.083333),
            ('config/app.js', 'javascript', 6, 5, 0, 1, 1, 0.0),
            ('lib/core.rs', 'rust', 13, 9, 1, 3, 2, 0.1),
            ('src/controllers/user.ts', 'typescript', 6, 4, 0, 2, 1, 0.0),
            ('src/index.ts', 'typescript', 7, 5, 0, 2, 1, 0.0),
            ('src/models/a.ts', 'typescript', 3, 2, 0, 1, 1, 0.0),
            ('src/models/b.ts', 'typescript', 3, 2, 0, 1, 1, 0.0),
            ('src/models/c.ts', 'typescript', 4, 3, 0, 1, 1, 0.0),
            ('src/models/user.ts', 'typescript', 8, 6, 0, 2, 1, 0.0),
            ('src/orphan.ts', 'typescript', 2, 1, 0, 1, 1, 0.0),
            ('src/runner.ts', 'typescript', 24, 15, 5, 4, 3, 0.25),
            ('src/services/audit.ts', 'typescript', 10, 7, 1, 2, 2, 0.125),
            ('src/types.ts', 'typescript', 11, 8, 0, 3, 1, 0.0),
            ('src/utils/log.ts', 'typescript', 8, 5, 1, 2, 1, 0.166667),
            ('tests/runner.test.ts', 'typescript', 4, 2, 0, 2, 1, 0.0),
            ('web/Main.java', 'java', 9, 6, 1, 2, 1, 0.142857),
            ('web/école.js', 'javascript', 5, 3, 1, 1, 4, 0.25),
        ],
    ),
    "empty_catches": (
        [("path", "string"), ("line_no", "bigint"), ("style", "string")],
        [
            ('app/tools.py', 15, 'python'),
            ('src/services/audit.ts', 6, 'braces'),
        ],
    ),
    "long_functions": (
        [("path", "string"), ("name", "string"), ("start_line", "bigint"), ("end_line", "bigint"), ("lines", "bigint")],
        [
            ('app/copy.py', 'one', 1, 6, 6),
            ('app/copy2.py', 'one', 1, 6, 6),
            ('app/tools.py', 'read', 7, 15, 9),
            ('src/runner.ts', 'run', 9, 15, 7),
            ('src/services/audit.ts', 'audit', 3, 9, 7),
        ],
    ),
    "duplicate_functions": (
        [("n", "bigint"), ("n_paths", "bigint"), ("first_path", "string")],
        [
            (2, 2, 'app/copy.py'),
        ],
    ),
    "security_scan_code": (
        [("path", "string"), ("line_no", "int"), ("rule", "string"), ("category", "string"), ("severity", "string"), ("snippet", "string")],
        [
            ('app/tools.py', 15, 'Swallowed security exception', 'error-handling', 'low', 'except: pass'),
            ('config/app.js', 1, 'Hardcoded secret/credential', 'secrets', 'critical', 'const password = "hunter22hunter";'),
            ('config/app.js', 2, 'Credential in URL', 'secrets', 'high', "const url = 'http://bob:pw@host/';"),
            ('config/app.js', 3, 'TLS/SSL verification disabled', 'config', 'high', 'fetch(url, { rejectUnauthorized: false });'),
            ('config/app.js', 4, 'SQL injection risk', 'injection', 'critical', 'query(`SELECT * FROM t WHERE id = ${id}`);'),
            ('config/app.js', 5, 'Insecure randomness', 'crypto', 'medium', 'Math.random();'),
            ('src/runner.ts', 18, 'SQL injection risk', 'injection', 'critical', 'return n + 1;'),
            ('web/école.js', 3, 'Dangerous eval() usage', 'injection', 'high', 'while (true) { eval(x); }'),
            ('web/école.js', 4, 'Potential XSS via innerHTML', 'xss', 'high', 'el.innerHTML = y;'),
        ],
    ),
    "plugin_rules": (
        [("path", "string"), ("line_no", "int"), ("rule", "string"), ("category", "string"), ("severity", "string"), ("snippet", "string")],
        [
            ('web/école.js', 3, 'Loose comparison', 'style', 'low', 'while (true) { eval(x); }'),
        ],
    ),
    "diff_symbols": (
        [("diff_id", "int"), ("file", "string"), ("name", "string"), ("change", "string"), ("old_name", "string")],
        [
            (1, 'src/a.ts', 'Fresh', 'added', None),
            (1, 'src/a.ts', 'newName', 'renamed', 'oldName'),
            (2, 'lib/b.py', 'gone', 'removed', None),
            (2, 'lib/b.py', 'same', 'modified', None),
            (3, 'new.go', 'Add', 'added', None),
        ],
    ),
    "categorize_diff": (
        [("diff_id", "int"), ("category", "string"), ("confidence", "bigint")],
        [
            (1, 'feature', 100),
            (2, 'refactor', 0),
            (3, 'feature', 100),
        ],
    ),
    "change_impact": (
        [("path", "string"), ("reason", "string"), ("what", "string")],
        [
            ('src/index.ts', 'imports', 'src/types.ts'),
            ('src/index.ts', 'uses', 'Job'),
            ('src/runner.ts', 'imports', 'src/types.ts'),
            ('src/runner.ts', 'uses', 'Job'),
        ],
    ),
    "affected_tests": (
        [("path", "string")],
        [
            ('tests/runner.test.ts',),
        ],
    ),
    "change_risk": (
        [("affected", "bigint"), ("symbols", "bigint"), ("breaking", "bigint"), ("risk", "string")],
        [
            (2, 1, 0, 'low'),
        ],
    ),
    "lcov": (
        [("path", "string"), ("file", "string"), ("lines_total", "bigint"), ("lines_hit", "bigint"), ("functions_total", "bigint"), ("functions_hit", "bigint"), ("branches_total", "bigint"), ("branches_hit", "bigint"), ("percent", "bigint")],
        [
            ('lcov.info', 'src/a.ts', 3, 2, 2, 1, 4, 3, 67),
            ('lcov.info', 'src/b.ts', 2, 0, 0, 0, 0, 0, 0),
        ],
    ),
    "coverage_summary": (
        [("files", "bigint"), ("lines_total", "bigint"), ("lines_hit", "bigint"), ("untested", "bigint"), ("percent", "bigint")],
        [
            (2, 5, 2, 1, 40),
        ],
    ),
    "untested_files": (
        [("file", "string")],
        [
            ('src/b.ts',),
        ],
    ),
    "istanbul": (
        [("path", "string"), ("file", "string"), ("statements", "bigint"), ("hit", "bigint"), ("functions", "bigint"), ("percent", "bigint")],
        [
            ('coverage-final.json', 'src/a.ts', 3, 2, 1, 67),
            ('coverage-final.json', 'src/b.ts', 1, 0, 0, 0),
        ],
    ),
    "istanbul_summary": (
        [("path", "string"), ("file", "string"), ("lines", "bigint"), ("hit", "bigint"), ("percent", "bigint")],
        [
            ('coverage-summary.json', 'src/a.ts', 8, 6, 75),
            ('coverage-summary.json', 'src/b.ts', 1, 0, 0),
        ],
    ),
    "cobertura": (
        [("path", "string"), ("file", "string"), ("percent", "bigint")],
        [
            ('cobertura.xml', 'src/a.py', 88),
            ('cobertura.xml', 'src/b.py', 0),
        ],
    ),
    "notebooks": (
        [("path", "string"), ("language", "string"), ("cells", "bigint"), ("code_cells", "bigint"), ("markdown_cells", "bigint"), ("in_order", "boolean"), ("unexecuted", "boolean"), ("errors", "boolean"), ("imports", "bigint")],
        [
            ('bad.ipynb', 'unknown', 4, 4, 0, False, True, True, 0),
            ('good.ipynb', 'python', 3, 2, 1, True, False, False, 1),
        ],
    ),
    "notebook_health": (
        [("path", "string"), ("score", "bigint")],
        [
            ('bad.ipynb', 40),
            ('good.ipynb', 100),
        ],
    ),
    "lockfile_dependencies": (
        [("path", "string"), ("ecosystem", "string"), ("name", "string"), ("version", "string")],
        [
            ('Cargo.lock', 'cargo', 'hyper', '0.14.23'),
            ('Cargo.lock', 'cargo', 'regex', '1.7.3'),
            ('Pipfile.lock', 'pip', 'urllib3', '1.26.5'),
            ('go.sum', 'go', 'github.com/x/y', '1.2.3'),
            ('package-lock.json', 'npm', 'axios', '1.6.0'),
            ('package-lock.json', 'npm', 'lodash', '4.17.20'),
            ('package-lock.json', 'npm', 'minimist', '1.2.5'),
            ('package-lock.json', 'npm', 'tar', '6.1.11'),
            ('requirements.txt', 'pip', 'django', '4.1.0'),
            ('requirements.txt', 'pip', 'flask', '2.3.0'),
            ('requirements.txt', 'pip', 'pyyaml', '5.4'),
        ],
    ),
    "dependency_vulnerabilities": (
        [("path", "string"), ("ecosystem", "string"), ("name", "string"), ("version", "string"), ("safe_from", "string"), ("severity", "string")],
        [
            ('Cargo.lock', 'cargo', 'regex', '1.7.3', '1.8.0', 'medium'),
            ('Pipfile.lock', 'pip', 'urllib3', '1.26.5', '2.0.0', 'medium'),
            ('package-lock.json', 'npm', 'lodash', '4.17.20', '4.17.21', 'high'),
            ('package-lock.json', 'npm', 'minimist', '1.2.5', '1.2.6', 'high'),
            ('package-lock.json', 'npm', 'tar', '6.1.11', '6.1.12', 'high'),
            ('requirements.txt', 'pip', 'django', '4.1.0', '4.2.0', 'medium'),
            ('requirements.txt', 'pip', 'pyyaml', '5.4', '6.0', 'high'),
        ],
    ),
    "package_dependencies": (
        [("path", "string"), ("package", "string"), ("name", "string"), ("version", "string")],
        [
            ('package.json', 'root', 'left-pad', '1.0.0'),
            ('package.json', 'root', 'lodash', '4.17.20'),
            ('package.json', 'root', 'moment', '2.29.0'),
            ('package.json', 'root', 'react', '18.0.0'),
            ('packages/a/package.json', 'pkg-a', 'lodash', '4.17.21'),
            ('packages/a/package.json', 'pkg-a', 'pkg-b', '1.0.0'),
            ('packages/b/package.json', 'pkg-b', 'pkg-a', '1.0.0'),
        ],
    ),
    "heavy_dependencies": (
        [("path", "string"), ("name", "string"), ("size_kb", "bigint"), ("severity", "string")],
        [
            ('package.json', 'lodash', 530, 'warning'),
            ('package.json', 'moment', 290, 'info'),
            ('packages/a/package.json', 'lodash', 530, 'warning'),
        ],
    ),
    "monorepo_edges": (
        [("package", "string"), ("name", "string")],
        [
            ('pkg-a', 'pkg-b'),
            ('pkg-b', 'pkg-a'),
        ],
    ),
    "version_mismatches": (
        [("name", "string"), ("versions", "bigint"), ("seen", "string")],
        [
            ('lodash', 2, '4.17.20, 4.17.21'),
        ],
    ),
    "cpu_profile": (
        [("path", "string"), ("name", "string"), ("hits", "bigint"), ("percent", "double"), ("severity", "string")],
        [
            ('run.cpuprofile', '(anonymous)', 38, 38.0, 'critical'),
            ('run.cpuprofile', 'cold', 2, 2.0, 'info'),
            ('run.cpuprofile', 'hot', 60, 60.0, 'critical'),
        ],
    ),
    "bundle_stats": (
        [("path", "string"), ("name", "string"), ("size", "bigint"), ("severity", "string")],
        [
            ('stats.json', 'big.js', 600000, 'critical'),
            ('stats.json', 'mid.js', 250000, 'warning'),
            ('stats.json', 'small.js', 10, 'info'),
        ],
    ),
    "db_columns": (
        [("path", "string"), ("orm", "string"), ("table", "string"), ("column", "string"), ("type", "string"), ("nullable", "boolean"), ("primary", "boolean"), ("unique", "boolean"), ("default", "string"), ("references", "string")],
        [
            ('app/models.py', 'django', 'Book', 'title', 'CharField', None, None, None, None, None),
            ('app/models.py', 'django', 'Book', 'year', 'IntegerField', None, None, None, None, None),
            ('app/tables.py', 'sqlalchemy', 'Car', 'id', 'Integer', None, None, None, None, None),
            ('app/tables.py', 'sqlalchemy', 'Car', 'name', 'String', None, None, None, None, None),
            ('db/001.sql', 'sql', 'roles', 'id', 'INT', False, True, False, None, None),
            ('db/001.sql', 'sql', 'user_roles', 'role_id', 'INT', False, True, False, None, 'roles'),
            ('db/001.sql', 'sql', 'user_roles', 'user_id', 'INT', False, True, False, None, 'users'),
            ('db/001.sql', 'sql', 'users', 'email', 'VARCHAR(80)', False, False, True, None, None),
            ('db/001.sql', 'sql', 'users', 'id', 'INT', False, True, False, None, None),
            ('db/001.sql', 'sql', 'users', 'note', 'TEXT', True, False, False, None, None),
            ('ent/cat.ts', 'typeorm', 'Cat', 'id', 'number', None, None, None, None, None),
            ('ent/cat.ts', 'typeorm', 'Cat', 'name', 'string', None, None, None, None, None),
            ('m/user.rb', 'activerecord', 'Account', None, None, None, None, None, None, None),
            ('prisma/schema.prisma', 'prisma', 'Post', 'author', 'User', False, False, False, None, 'User'),
            ('prisma/schema.prisma', 'prisma', 'Post', 'authorId', 'Int', False, False, False, None, None),
            ('prisma/schema.prisma', 'prisma', 'Post', 'id', 'Int', False, True, False, None, None),
            ('prisma/schema.prisma', 'prisma', 'Post', 'title', 'String?', True, False, False, None, None),
            ('src/schema.ts', 'drizzle', 'pets', 'id', 'serial', False, True, False, None, None),
            ('src/schema.ts', 'drizzle', 'pets', 'name', 'text', False, False, False, None, None),
            ('src/schema.ts', 'drizzle', 'pets', 'owner', 'integer', True, False, False, None, 'people'),
        ],
    ),
    "db_tables": (
        [("path", "string"), ("orm", "string"), ("table", "string"), ("columns", "bigint"), ("keys", "bigint"), ("foreign_keys", "bigint")],
        [
            ('app/models.py', 'django', 'Book', 2, 0, 0),
            ('app/tables.py', 'sqlalchemy', 'Car', 2, 0, 0),
            ('db/001.sql', 'sql', 'roles', 1, 1, 0),
            ('db/001.sql', 'sql', 'user_roles', 2, 2, 2),
            ('db/001.sql', 'sql', 'users', 3, 1, 0),
            ('ent/cat.ts', 'typeorm', 'Cat', 2, 0, 0),
            ('m/user.rb', 'activerecord', 'Account', 0, 0, 0),
            ('prisma/schema.prisma', 'prisma', 'Post', 4, 1, 1),
            ('src/schema.ts', 'drizzle', 'pets', 3, 1, 1),
        ],
    ),
    "db_relationships": (
        [("source", "string"), ("target", "string"), ("kind", "string"), ("through", "string")],
        [
            ('Post', 'User', 'one-to-many', None),
            ('pets', 'people', 'one-to-many', None),
            ('roles', 'users', 'many-to-many', 'user_roles'),
            ('user_roles', 'roles', 'one-to-many', None),
            ('user_roles', 'users', 'one-to-many', None),
        ],
    ),
    "api_endpoints": (
        [("path", "string"), ("source", "string"), ("method", "string"), ("route", "string")],
        [
            ('Api.java', 'spring', 'GET', '/api/v'),
            ('Ctl.cs', 'aspnet', 'GET', '/api/c/q'),
            ('cats.controller.ts', 'nestjs', 'GET', '/cats/:id'),
            ('cats.controller.ts', 'nestjs', 'POST', '/cats'),
            ('config/routes.rb', 'rails', 'DELETE', '/posts/:id'),
            ('config/routes.rb', 'rails', 'GET', '/home'),
            ('config/routes.rb', 'rails', 'GET', '/posts'),
            ('config/routes.rb', 'rails', 'GET', '/posts/:id'),
            ('config/routes.rb', 'rails', 'POST', '/posts'),
            ('config/routes.rb', 'rails', 'PUT', '/posts/:id'),
            ('main.py', 'fastapi', 'GET', '/x'),
            ('main.py', 'flask', 'GET', '/x'),
            ('s.graphql', 'graphql', 'QUERY', 'pet'),
            ('s.graphql', 'graphql', 'QUERY', 'pets'),
            ('srv.go', 'gin', 'GET', '/g'),
            ('srv.js', 'express', 'GET', '/a'),
            ('srv.js', 'express', 'POST', '/u'),
            ('srv.rs', 'rocket', 'GET', '/r'),
            ('web.php', 'laravel', 'GET', '/p'),
        ],
    ),
    "openapi_endpoints": (
        [("path", "string"), ("source", "string"), ("method", "string"), ("route", "string")],
        [
            ('api.json', 'openapi', 'DELETE', '/pets/{id}'),
            ('api.json', 'openapi', 'GET', '/pets'),
            ('api.json', 'openapi', 'POST', '/pets'),
        ],
    ),
    "api_method_histogram": (
        [("method", "string"), ("endpoints", "bigint"), ("sources", "bigint")],
        [
            ('DELETE', 1, 1),
            ('GET', 12, 10),
            ('POST', 3, 3),
            ('PUT', 1, 1),
            ('QUERY', 2, 1),
        ],
    ),
    "iac_resources": (
        [("path", "string"), ("type", "string"), ("name", "string"), ("detail", "string")],
        [
            ('docker-compose.yml', 'docker-service', 'db', None),
            ('docker-compose.yml', 'docker-service', 'web', None),
            ('k8s/deploy.yaml', 'k8s/Deployment', 'api', 'api'),
            ('main.tf', 'aws_rds_cluster', 'db', 'aws'),
            ('main.tf', 'aws_security_group', 'web', 'aws'),
            ('main.tf', 'data.aws_ami', 'img', 'aws'),
            ('main.tf', 'module', 'vpc', './vpc'),
        ],
    ),
    "iac_issues": (
        [("path", "string"), ("type", "string"), ("name", "string"), ("severity", "string")],
        [
            ('docker-compose.yml', 'docker-socket', None, 'warning'),
            ('docker-compose.yml', 'privileged', 'web', 'error'),
            ('docker-compose.yml', 'unpinned-image', 'web', 'warning'),
            ('k8s/deploy.yaml', 'no-limits', 'api', 'info'),
            ('k8s/deploy.yaml', 'unpinned-image', 'api', 'warning'),
            ('main.tf', 'hardcoded-secret', '7', 'error'),
            ('main.tf', 'no-encryption', 'db', 'warning'),
            ('main.tf', 'open-ingress', 'web', 'warning'),
        ],
    ),
    "cicd_jobs": (
        [("path", "string"), ("platform", "string"), ("job", "string"), ("runs_on", "string")],
        [
            ('.circleci/config.yml', 'circleci', 'unit', None),
            ('.github/workflows/ci.yml', 'github-actions', 'build', 'ubuntu'),
            ('.github/workflows/ci.yml', 'github-actions', 'deploy', None),
            ('.gitlab-ci.yml', 'gitlab-ci', 'build', None),
            ('.gitlab-ci.yml', 'gitlab-ci', 'ship', None),
            ('Jenkinsfile', 'jenkins', 'Build', None),
            ('Jenkinsfile', 'jenkins', 'Test', None),
        ],
    ),
    "cicd_needs": (
        [("path", "string"), ("job", "string"), ("needs", "string")],
        [
            ('.github/workflows/ci.yml', 'deploy', 'build'),
            ('.gitlab-ci.yml', 'ship', 'build'),
        ],
    ),
    "cicd_facts": (
        [("path", "string"), ("platform", "string"), ("what", "string"), ("job", "string"), ("value", "string")],
        [
            ('.circleci/config.yml', 'circleci', 'job', 'unit', None),
            ('.github/workflows/ci.yml', 'github-actions', 'issue', 'build', 'unpinned action'),
            ('.github/workflows/ci.yml', 'github-actions', 'issue', 'deploy', 'no runs-on'),
            ('.github/workflows/ci.yml', 'github-actions', 'job', 'build', 'ubuntu'),
            ('.github/workflows/ci.yml', 'github-actions', 'job', 'deploy', None),
            ('.github/workflows/ci.yml', 'github-actions', 'needs', 'deploy', 'build'),
            ('.github/workflows/ci.yml', 'github-actions', 'secret', 'build', 'KEY'),
            ('.github/workflows/ci.yml', 'github-actions', 'step', 'build', 'actions/checkout@main'),
            ('.github/workflows/ci.yml', 'github-actions', 'step', 'build', 'make'),
            ('.github/workflows/ci.yml', 'github-actions', 'step', 'deploy', 'ship'),
            ('.github/workflows/ci.yml', 'github-actions', 'trigger', None, 'pull_request'),
            ('.github/workflows/ci.yml', 'github-actions', 'trigger', None, 'push'),
            ('.gitlab-ci.yml', 'gitlab-ci', 'job', 'build', None),
            ('.gitlab-ci.yml', 'gitlab-ci', 'job', 'ship', None),
            ('.gitlab-ci.yml', 'gitlab-ci', 'needs', 'ship', 'build'),
            ('.gitlab-ci.yml', 'gitlab-ci', 'stage', 'build', 'one'),
            ('.gitlab-ci.yml', 'gitlab-ci', 'step', 'build', 'make'),
            ('.gitlab-ci.yml', 'gitlab-ci', 'step', 'ship', 'send'),
            ('Jenkinsfile', 'jenkins', 'job', 'Build', None),
            ('Jenkinsfile', 'jenkins', 'job', 'Test', None),
        ],
    ),
    "code_docs": (
        [("path", "string"), ("name", "string"), ("kind", "string"), ("line_no", "bigint"), ("summary", "string"), ("params", "bigint"), ("deprecated", "boolean")],
        [
            ('app/tools.py', 'read', 'docstring', 7, 'Reads a file.', 1, False),
            ('cmd/main.go', 'Serve', 'comment', 8, 'Serve starts it.', 0, False),
            ('lib/core.rs', 'open', 'comment', 4, 'Opens a door.', 0, False),
            ('src/runner.ts', 'run', 'block', 8, 'Runs a job.', 1, True),
            ('web/Main.java', 'start', 'block', 4, 'Starts.', 0, False),
        ],
    ),
    "undocumented": (
        [("path", "string"), ("name", "string"), ("kind", "string"), ("line_no", "bigint")],
        [
            ('app/copy.py', 'one', 'function', 1),
            ('app/copy2.py', 'one', 'function', 1),
            ('app/tools.py', 'Store', 'class', 18),
            ('cmd/main.go', 'Server', 'type', 13),
            ('lib/core.rs', 'Door', 'type', 10),
            ('src/controllers/user.ts', 'show', 'function', 3),
            ('src/index.ts', 'main', 'function', 4),
            ('src/models/user.ts', 'User', 'class', 3),
            ('src/runner.ts', 'helper', 'function', 17),
            ('src/runner.ts', 'unusedExport', 'function', 21),
            ('src/services/audit.ts', 'audit', 'function', 3),
            ('src/types.ts', 'Job', 'interface', 1),
            ('src/types.ts', 'Jobs', 'type', 6),
            ('src/types.ts', 'Task', 'class', 8),
            ('src/utils/log.ts', 'log', 'function', 4),
            ('web/Main.java', 'Main', 'class', 3),
            ('web/école.js', 'while', 'function', 3),
        ],
    ),
    "symbol_docs": (
        [("path", "string"), ("name", "string"), ("summary", "string"), ("deprecated", "boolean")],
        [
            ('src/runner.ts', 'run', 'Runs a job.', True),
        ],
    ),
    "dependency_counts": (
        [("direct", "bigint"), ("total", "bigint"), ("lockfile_found", "boolean")],
        [
            (4, 4, False),
        ],
    ),
    "coverage_location": (
        [("path", "string"), ("format", "string")],
        [
            ('coverage/coverage-final.json', 'istanbul'),
        ],
    ),
    "coverage_of_file": (
        [("file", "string"), ("percent", "bigint")],
        [
            ('src/a.ts', 67),
        ],
    ),
    "test_files": (
        [("path", "string")],
        [
            ('lib/spec_a.rb',),
            ('tests/runner.test.ts',),
            ('tests/test_x.py',),
        ],
    ),
    "workspaces": (
        [("path", "string"), ("tool", "string"), ("globs", "string")],
        [
            ('package.json', 'npm-workspaces', 'apps/web packages/*'),
            ('old/package.json', 'npm-workspaces', 'libs/*'),
            ('pnpm-workspace.yaml', 'pnpm-workspaces', 'packages/* tools'),
            ('Cargo.toml', 'cargo-workspaces', 'crates/a crates/b'),
            ('turbo.json', 'turborepo', ''),
            ('nx.json', 'nx', ''),
        ],
    ),
    "workspace_cycles": (
        [("node", "string"), ("cycle", "string")],
        [
            ('pkg-a', 'pkg-a'),
            ('pkg-b', 'pkg-a'),
        ],
    ),
    "iac_summary": (
        [("platform", "string"), ("resources", "bigint"), ("types", "bigint"), ("issues", "bigint")],
        [
            ('docker', 2, 1, 3),
            ('kubernetes', 1, 1, 2),
            ('terraform', 4, 4, 3),
        ],
    ),
    "heatmap_functions": (
        [("path", "string"), ("name", "string"), ("line_no", "bigint"), ("params", "bigint"), ("cyclomatic", "bigint"), ("cognitive", "bigint"), ("nesting", "bigint"), ("loc", "bigint"), ("score", "bigint"), ("grade", "string")],
        [
            ('src/runner.ts', 'run', 9, 1, 3, 3, 2, 7, 10, 'A'),
        ],
    ),
    "blame": (
        [("path", "string"), ("line_no", "bigint"), ("hash", "string"), ("author", "string"), ("date", "string")],
        [
            ('f', 1, '01234567', 'Ann', '2024-01-01'),
            ('f', 2, '01234567', 'Ann', '2024-01-01'),
            ('f', 3, '89abcdef', 'Bob', '2025-01-01'),
        ],
    ),
}
