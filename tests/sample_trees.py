"""Small source trees for the extractors, which the shared tables have no code for."""

from __future__ import annotations

CODE: list[tuple[str, str, str]] = [
    ("src/index.ts", "typescript", "import { run } from './runner';\nimport type { Job } from './types';\n\nexport function main(): void {\n  run({ id: 1 });\n}\n"),
    ("src/runner.ts", "typescript", "import { Job } from './types';\nimport { log } from './utils/log';\n\n/**\n * Runs a job.\n * @param job what to run\n * @deprecated use start\n */\nexport function run(job: Job): number {\n  if (job.id > 0 && job.ok) {\n    log('run');\n    return helper(job.id);\n  }\n  return 0;\n}\n\nfunction helper(n: number): number {\n  return n + 1;\n}\n\nexport function unusedExport(): void {\n  log('never');\n}\n"),
    ("src/types.ts", "typescript", "export interface Job {\n  id: number;\n  ok?: boolean;\n}\n\nexport type Jobs = Array<Job>;\n\nexport class Task implements Job {\n  id = 0;\n}\n"),
    ("src/utils/log.ts", "typescript", "import { audit } from '../services/audit';\n\nexport const MAX_LINES = 10;\nexport const log = (text: string) => {\n  // TODO: levels\n  console.log(text);\n};\n"),
    ("src/services/audit.ts", "typescript", "import { log } from '../utils/log';\n\nexport function audit(text: string): void {\n  try {\n    log(text);\n  } catch (e) {\n    // nothing\n  }\n}\n"),
    ("src/controllers/user.ts", "typescript", "import { User } from '../models/user';\n\nexport function show(id: number): User {\n  return User.find(id);\n}\n"),
    ("src/models/user.ts", "typescript", "import { a } from './a';\n\nexport class User {\n  static find(id: number): User {\n    return new User();\n  }\n}\n"),
    ("src/models/a.ts", "typescript", "import { b } from './b';\nexport const a = 1;\n"),
    ("src/models/b.ts", "typescript", "import { c } from './c';\nexport const b = 2;\n"),
    ("src/models/c.ts", "typescript", "import { a } from './a';\nimport { c } from './c';\nexport const c = 3;\n"),
    ("src/orphan.ts", "typescript", "export const lonely = true;\n"),
    ("tests/runner.test.ts", "typescript", "import { run } from '../src/runner';\n\nrun({ id: 2 });\n"),
    ("app/tools.py", "python", "import os\nfrom json import loads as parse\n\nLIMIT = 5\n\n\ndef read(path):\n    \"\"\"Reads a file.\n\n    Args:\n        path: where it is\n    \"\"\"\n    try:\n        return parse(open(path).read())\n    except: pass\n\n\nclass Store:\n    def put(self, key):\n        for k in range(3):\n            if k:\n                read(key)\n        return None\n"),
    ("app/copy.py", "python", "def one(values):\n    total = 0\n    for value in values:\n        total += value\n        total *= 2\n    return total\n"),
    ("app/copy2.py", "python", "def one(values):\n    total = 0\n    for value in values:\n        total += value\n        total *= 2\n    return total\n"),
    ("cmd/main.go", "go", "package main\n\nimport (\n\t\"fmt\"\n)\n\n// Serve starts it.\nfunc Serve(port int) error {\n\tfmt.Println(port)\n\treturn nil\n}\n\ntype Server struct {\n\tport int\n}\n"),
    ("lib/core.rs", "rust", "use std::fs;\n\n/// Opens a door.\npub fn open(path: &str) -> bool {\n    match path {\n        _ => true,\n    }\n}\n\npub struct Door {\n    wide: u32,\n}\n"),
    ("web/Main.java", "java", "import java.util.List;\n\npublic class Main {\n    /** Starts. */\n    public static void start(String[] args) {\n        System.out.println(args);\n    }\n}\n"),
    ("web/\u00e9cole.js", "javascript", "// \u00e9do and do\nconst \u00e9cole = require('fs');\nwhile (true) { eval(x); }\nel.innerHTML = y;\n"),
    ("config/app.js", "javascript", "const password = \"hunter22hunter\";\nconst url = 'http://bob:pw@host/';\nfetch(url, { rejectUnauthorized: false });\nquery(`SELECT * FROM t WHERE id = ${id}`);\nMath.random();\n"),
]

PATHS: list[tuple[str, str]] = [
    ("Dockerfile", "FROM x"),
    ("package.json", '{"name": "root", "dependencies": {"react": "18.0.0", "lodash": "4.17.20", "moment": "2.29.0"}, "devDependencies": {"left-pad": "1.0.0"}}'),
    ("packages/a/package.json", '{"name": "pkg-a", "dependencies": {"pkg-b": "1.0.0", "lodash": "4.17.21"}}'),
    ("packages/b/package.json", '{"name": "pkg-b", "dependencies": {"pkg-a": "1.0.0"}}'),
    ("next.config.js", ""),
    ("requirements.txt", "Django==4.1.0\nflask==2.3.0\n"),
    ("Cargo.toml", ""),
    ("pom.xml", ""),
    ("go.mod", ""),
    ("docs/readme.md", ""),
    (".env", "A=1"),
    ("keys/id_rsa", "x"),
    (".github/workflows/ci.yml", ""),
    ("build.gradle.kts", ""),
    ("weird.unknownext", ""),
    ("noext", ""),
    ("a/b/Script.PY", ""),
    ("infra/main.tf", ""),
    ("App.csproj", ""),
    ("tests/test_x.py", ""),
]

DIFFS: list[tuple[int, str]] = [
    (1, "--- a/src/a.ts\n+++ b/src/a.ts\n-export function oldName(x) {\n+export function newName(x) {\n+export class Fresh {\n"),
    (2, "--- a/lib/b.py\n+++ b/lib/b.py\n-def gone(a):\n-    return a\n def kept(b):\n-def same(c):\n+def same(c, d):\n"),
    (3, "--- a/new.go\n+++ b/new.go\n+func Add(a int) int {\n+\treturn a\n+}\n+// implement feature\n"),
]

LCOV = "TN:\nSF:src/a.ts\nFNF:2\nFNH:1\nDA:1,5\nDA:2,0\nDA:3,1\nBRF:4\nBRH:3\nend_of_record\nSF:src/b.ts\nFNF:0\nFNH:0\nDA:1,0\nDA:2,0\nend_of_record\n"
REPORTS: dict[str, str] = {
    "lcov.info": LCOV,
    "coverage-final.json": '{"src/a.ts": {"s": {"0": 3, "1": 0, "2": 1}, "f": {"0": 1}}, "src/b.ts": {"s": {"0": 0}, "f": {}}}',
    "coverage-summary.json": '{"total": {"lines": {"total": 9, "covered": 6}}, "src/a.ts": {"lines": {"total": 8, "covered": 6}}, "src/b.ts": {"lines": {"total": 1, "covered": 0}}}',
    "cobertura.xml": '<coverage><packages><package><classes><class name="a" filename="src/a.py" line-rate="0.875"></class><class name="b" filename="src/b.py" line-rate="0"></class></classes></package></packages></coverage>',
}

NOTEBOOKS: list[tuple[str, str]] = [
    ("good.ipynb", '{"metadata": {"kernelspec": {"language": "python"}}, "cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": ["import os\\n", "x = 1"], "execution_count": 1, "outputs": []}, {"cell_type": "code", "source": "y = 2", "execution_count": 2, "outputs": []}]}'),
    ("bad.ipynb", '{"metadata": {}, "cells": [{"cell_type": "code", "source": "a", "execution_count": 3, "outputs": [{"output_type": "error", "ename": "E", "evalue": "v"}]}, {"cell_type": "code", "source": "b", "execution_count": 2, "outputs": []}, {"cell_type": "code", "source": "c", "execution_count": null, "outputs": []}, {"cell_type": "code", "source": "d", "execution_count": 4, "outputs": []}]}'),
]

LOCKS: list[tuple[str, str]] = [
    ("package-lock.json", '{"packages": {"": {"version": "1.0.0"}, "node_modules/lodash": {"version": "4.17.20"}, "node_modules/axios": {"version": "1.6.0"}, "node_modules/a/node_modules/minimist": {"version": "1.2.5"}}, "dependencies": {"tar": {"version": "6.1.11"}}}'),
    ("Cargo.lock", '[[package]]\nname = "regex"\nversion = "1.7.3"\n\n[[package]]\nname = "hyper"\nversion = "0.14.23"\n'),
    ("requirements.txt", "Django==4.1.0\nflask==2.3.0\nrequests>=2\npyyaml==5.4 # old\n"),
    ("Pipfile.lock", '{"default": {"urllib3": {"version": "==1.26.5"}}}'),
    ("go.sum", "github.com/x/y v1.2.3 h1:abc=\ngithub.com/x/y v1.2.3/go.mod h1:def=\n"),
]

PROFILES: list[tuple[str, str]] = [
    ("run.cpuprofile", '{"nodes": [{"hitCount": 60, "callFrame": {"functionName": "hot", "url": "a.js"}}, {"hitCount": 38, "callFrame": {"functionName": "", "url": "b.js"}}, {"hitCount": 2, "callFrame": {"functionName": "cold", "url": "c.js"}}, {"hitCount": 0, "callFrame": {"functionName": "none", "url": ""}}]}'),
]
BUNDLES: list[tuple[str, str]] = [("stats.json", '{"assets": [{"name": "big.js", "size": 600000}, {"name": "mid.js", "size": 250000}, {"name": "small.js", "size": 10}]}')]

SCHEMAS: list[tuple[str, str]] = [
    ("db/001.sql", "CREATE TABLE IF NOT EXISTS users (\n  id INT PRIMARY KEY,\n  email VARCHAR(80) NOT NULL UNIQUE,\n  note TEXT\n);\nCREATE TABLE roles (\n  id INT PRIMARY KEY\n);\nCREATE TABLE user_roles (\n  user_id INT NOT NULL REFERENCES users(id),\n  role_id INT NOT NULL REFERENCES roles(id),\n  PRIMARY KEY (user_id, role_id)\n);\n"),
    ("prisma/schema.prisma", "model Post {\n  id Int @id\n  title String?\n  author User @relation(fields: [authorId], references: [id])\n  authorId Int\n}\n"),
    ("src/schema.ts", "export const pets = pgTable('pets', {\n  id: serial('id').primaryKey(),\n  owner: integer('owner').references(() => people.id),\n  name: text('name').notNull(),\n});\n"),
    ("app/models.py", "from django.db import models\n\n\nclass Book(models.Model):\n    title = models.CharField(max_length=9)\n    year = models.IntegerField()\n"),
    ("app/tables.py", "class Car(Base):\n    id = Column(Integer, primary_key=True)\n    name = Column(String)\n"),
    ("m/user.rb", "class Account < ApplicationRecord\n  has_many :orders\nend\n"),
    ("ent/cat.ts", "@Entity()\nexport class Cat {\n  @PrimaryColumn()\n  id: number;\n\n  @Column()\n  name: string;\n}\n"),
]

APIS: list[tuple[str, str]] = [
    ("api.json", '{"openapi": "3.0.0", "paths": {"/pets": {"get": {}, "post": {}}, "/pets/{id}": {"delete": {}, "parameters": []}}}'),
    ("s.graphql", "type Query {\n  pet(id: ID!): Pet\n  pets: [Pet]\n}\n"),
    ("srv.js", "const express = require('express');\nconst app = express();\napp.get('/a', f);\nuserRouter.post('/u', g);\n"),
    ("main.py", "from fastapi import FastAPI\napp = FastAPI()\n\n@app.get('/x')\ndef x(): pass\n"),
    ("cats.controller.ts", "@Controller('cats')\nexport class Cats {\n  @Get(':id')\n  one() {}\n  @Post()\n  add() {}\n}\n"),
    ("Api.java", "@RestController\n@RequestMapping(\"/api\")\nclass Api {\n  @GetMapping(\"/v\")\n  int v() { return 1; }\n}\n"),
    ("config/routes.rb", "get '/home', to: 'x#y'\nresources :posts\n"),
    ("srv.go", "import \"github.com/gin-gonic/gin\"\nr.GET(\"/g\", f)\n"),
    ("srv.rs", "use rocket;\n#[get(\"/r\")]\nfn r() {}\n"),
    ("web.php", "Route::get('/p', f);\n"),
    ("Ctl.cs", "[ApiController]\n[Route(\"api/c\")]\nclass C {\n  [HttpGet(\"q\")]\n  int Q() => 1;\n}\n"),
]

IAC: list[tuple[str, str]] = [
    ("main.tf", 'resource "aws_security_group" "web" {\n  ingress {\n    cidr_blocks = ["0.0.0.0/0"]\n  }\n}\nresource "aws_rds_cluster" "db" {\n  password = "hunter22"\n}\nmodule "vpc" {\n  source = "./vpc"\n}\ndata "aws_ami" "img" {\n}\n'),
    ("docker-compose.yml", "services:\n  web:\n    image: nginx:latest\n    privileged: true\n  db:\n    image: postgres:16\n    volumes:\n      - /var/run/docker.sock:/s\n"),
    ("k8s/deploy.yaml", "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: api\nspec:\n  template:\n    image: api\n"),
]

PIPELINES: list[tuple[str, str]] = [
    (".github/workflows/ci.yml", "name: ci\non:\n  push:\n  pull_request:\njobs:\n  build:\n    runs-on: ubuntu\n    steps:\n      - uses: actions/checkout@main\n      - run: make\n        env:\n          KEY: ${{ secrets.KEY }}\n  deploy:\n    needs: [build]\n    steps:\n      - name: ship\n"),
    (".gitlab-ci.yml", "stages:\n  - one\nbuild:\n  stage: one\n  script:\n    - make\nship:\n  needs: [\"build\"]\n  script:\n    - send\n"),
    ("Jenkinsfile", "pipeline { stages { stage('Build') { } stage('Test') { } } }"),
    (".circleci/config.yml", "version: 2\njobs:\n  unit:\n    docker: x\nworkflows:\n  all:\n    jobs: [unit]\n"),
]

WORKSPACES: list[tuple[str, str]] = [
    ("package.json", '{"name": "root", "workspaces": ["packages/*", "apps/web"], "devDependencies": {"x": "1"}}'),
    ("old/package.json", '{"workspaces": {"packages": ["libs/*"]}}'),
    ("other/package.json", '{"name": "plain"}'),
    ("pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  - tools\n"),
    ("Cargo.toml", '[workspace]\nmembers = ["crates/a", "crates/b"]\n'),
    ("one/Cargo.toml", '[package]\nname = "one"\n'),
    ("turbo.json", "{}"),
    ("nx.json", "{}"),
]

BLAME = (
    "0123456789abcdef0123456789abcdef01234567 1 1 2\nauthor Ann\nauthor-time 1704067200\nsummary first\n\tline one\n"
    "0123456789abcdef0123456789abcdef01234567 2 2\n\tline two\n"
    "89abcdef0123456789abcdef0123456789abcdef 1 3 1\nauthor Bob\nauthor-time 1735689600\nsummary second\n\tline three\n"
)
