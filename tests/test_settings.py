"""Settings, pipelines, infrastructure and schemas against hand-written expectations."""

from __future__ import annotations

from textquarry.operators import schemas, settings

WORKFLOW = """# ci
name: "ci: all"
on: [push, pull_request]
jobs:
  build:
    runs-on: [self-hosted, linux]   # where
    steps:
    - uses: actions/checkout@v4
      with:
        token: ${{ secrets.GH }}
    - name: run it
      run: |
        make all
        # no comment
        make test: now
  ship:
    needs:
      - build
    runs-on: ubuntu
    env:
      API_KEY: abc#1
    steps:
      - run: echo "a: b"
      - uses: x/y@main
"""

TERRAFORM = """
/* all */
resource "aws_s3_bucket" "logs" {
  bucket = "b-${var.name}"  # "quoted"
  tags = {
    a = "x"
    b = ["y", "z"]
  }
  rule { days = 3 }
}
resource "aws_db_instance" "db" {
  storage_encrypted = true
  user_data = <<EOF
password = "nothing here"
EOF
  password = "hunter22"
  token = "${var.token}"
}
data "aws_db_instance" "seen" {}
module "net" { source = "./net" }
"""


def test_rows_of_yaml():
    rows = [(r[1], "/".join(r[2]), r[3], r[4]) for r in settings.yaml_rows(WORKFLOW)]
    assert (2, "name", "ci: all", False) in rows
    assert [r[2] for r in rows if r[1].startswith("on/")] == ["push", "pull_request"]
    assert (6, "jobs/build/runs-on", "[self-hosted, linux]", False) in rows
    assert (8, "jobs/build/steps/[0]/uses", "actions/checkout@v4", True) in rows
    assert (12, "jobs/build/steps/[1]/run", "make all\n# no comment\nmake test: now", False) in rows
    assert (18, "jobs/ship/needs/[0]", "build", True) in rows
    assert (21, "jobs/ship/env/API_KEY", "abc#1", False) in rows
    assert [r[1] for r in rows if r[3] and "ship/steps" in r[1]] == ["jobs/ship/steps/[0]/run", "jobs/ship/steps/[1]/uses"]
    assert list(settings.yaml_rows("")) == [] and [r[0] for r in settings.yaml_rows("a: 1\n---\nb: 2")] == [0, 1]


def test_rows_of_hcl():
    rows = [(r[1], "/".join(r[2]), r[3]) for r in settings.hcl_rows(TERRAFORM)]
    assert (4, "resource/aws_s3_bucket/logs/bucket", '"b-${var.name}"') in rows
    assert any(k.endswith("logs/tags") and '"y", "z"' in v for _, k, v in rows if v)
    assert (9, "resource/aws_s3_bucket/logs/rule/days", "3") in rows
    assert (16, "resource/aws_db_instance/db/password", '"hunter22"') in rows
    assert ("data/aws_db_instance/seen", None) in [r[1:] for r in rows] and (20, "module/net/source", '"./net"') in rows
    assert list(settings.hcl_rows("")) == [] and list(settings.hcl_rows("} = {")) != None  # noqa: E711


def test_infrastructure_and_pipelines(spark):
    files = spark.createDataFrame([("a/main.tf", TERRAFORM), (".github/workflows/ci.yml", WORKFLOW), ("empty.tf", ""), ("null.yml", None), ("k.yaml", "kind: Deployment\nmetadata:\n  name: x\nspec:\n  containers:\n    - image: a:1\n      resources: {}\n---\nkind: Pod\nspec:\n  containers:\n    - image: b\n      securityContext:\n        privileged: true\n")], "path string, content string")
    found = {(r["what"], r["type"], r["name"], r["detail"]) for r in settings.iac(files).collect()}
    assert found == {
        ("resource", "aws_s3_bucket", "logs", "aws"),
        ("resource", "aws_db_instance", "db", "aws"),
        ("resource", "data.aws_db_instance", "seen", "aws"),
        ("resource", "module", "net", "./net"),
        ("issue", "no-versioning", "logs", None),
        ("issue", "hardcoded-secret", "16", None),
        ("resource", "k8s/Deployment", "x", "a:1"),
        ("resource", "k8s/Pod", "unnamed", "b"),
        ("issue", "unpinned-image", "unnamed", "b"),
        ("issue", "privileged", "unnamed", "true"),
    }
    assert {(r["platform"], r["resources"], r["issues"]) for r in settings.iac_summary(settings.iac(files)).collect()} == {("terraform", 4, 2), ("kubernetes", 2, 2)}
    facts = {(r["what"], r["job"], r["value"]) for r in settings.cicd(files).collect()}
    assert facts == {
        ("trigger", None, "push"),
        ("trigger", None, "pull_request"),
        ("job", "build", "[self-hosted, linux]"),
        ("job", "ship", "ubuntu"),
        ("needs", "ship", "build"),
        ("secret", "build", "GH"),
        ("step", "build", "actions/checkout@v4"),
        ("step", "build", "run it"),
        ("step", "ship", 'echo "a: b"'),
        ("step", "ship", "x/y@main"),
        ("issue", "ship", "unpinned action"),
        ("issue", None, "possible secret in line 21"),
    }
    assert settings.iac(files.limit(0)).count() == settings.cicd(files.limit(0)).count() == 0


def test_columns_of_sql():
    text = """
    -- CREATE TABLE no (id INT);
    CREATE TABLE IF NOT EXISTS "shop"."orders" (
      id BIGINT GENERATED ALWAYS AS IDENTITY, total NUMERIC(10, 2) NOT NULL DEFAULT (1 + 2),
      state VARCHAR(9) DEFAULT 'a,b;c' UNIQUE, at TIMESTAMP WITH TIME ZONE, buyer INT REFERENCES users(id),
      PRIMARY KEY (id), CONSTRAINT one FOREIGN KEY (seller, x) REFERENCES people (id, y), seller INT
    ) ENGINE=x;
    create temporary table t2(a int)
    """
    assert list(schemas.sql_columns(text)) == [
        ("orders", "id", "BIGINT", False, True, False, None, None),
        ("orders", "total", "NUMERIC(10, 2)", False, False, False, "(1 + 2)", None),
        ("orders", "state", "VARCHAR(9)", True, False, True, "'a,b;c'", None),
        ("orders", "at", "TIMESTAMP WITH TIME ZONE", True, False, False, None, None),
        ("orders", "buyer", "INT", True, False, False, None, "users"),
        ("orders", "seller", "INT", True, False, False, None, "people"),
        ("t2", "a", "int", True, False, False, None, None),
    ]
    assert list(schemas.sql_columns("")) == list(schemas.sql_columns("CREATE TABLE x (")) == list(schemas.sql_columns("CREATE")) == []


def test_columns_of_prisma():
    text = "model A {\n  id Int @id @default(autoincrement())\n  // note Int\n  name String? @unique\n  bs B[]\n  b B @relation(\"x\", fields: [bId], references: [id])\n  @@map(\"as\")\n}\nenum E {\n  X\n}\n"
    assert list(schemas.prisma_columns(text)) == [
        ("A", "id", "Int", False, True, False, "autoincrement()", None),
        ("A", "name", "String?", True, False, True, None, None),
        ("A", "bs", "B[]", False, False, False, None, None),
        ("A", "b", "B", False, False, False, None, "B"),
    ]
