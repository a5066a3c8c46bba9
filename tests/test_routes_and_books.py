from __future__ import annotations

from textquarry.operators import books, routers

FILES = "path string, content string"


def test_routers_through_mounts_chains_names_and_cycles(spark):
    rows = [
        ("app.js", "const app = express();\nconst users = require('./lib/users');\napp.use('/api', users);\napp.use('/old/', users);\nconst adminRouter = express.Router();\nadminRouter.all('/stats', f);\napp.use('/admin', adminRouter);\napp.get('/', home);"),
        ("lib/users.js", "import posts from './posts';\nconst router = express.Router();\nconst onePath = '/one/:id';\nrouter.get(onePath, f);\nrouter.route('/many').get(a).post(b);\nrouter.use('/posts', posts);\nrouter.get(`/v/${x}/y`, f);\nexport default router;"),
        ("lib/posts.ts", "const router = Router();\nimport users from './users';\nrouter.use('/back', users);\nrouter.delete('/:id', f);\nexport default router;"),
        ("other.js", "thing.get('/no', f)"),
        ("null.js", None),
    ]
    got = {tuple(r) for r in routers.mounted_routes(spark.createDataFrame(rows, FILES)).collect()}
    users = [("GET", "/one/:id"), ("GET", "/many"), ("POST", "/many"), ("GET", "/v/*/y")]
    want = {("lib/users.js", m, f"{base}{route}") for base in ("/api", "/old") for m, route in users}
    want |= {("lib/posts.ts", "DELETE", f"{base}/posts/:id") for base in ("/api", "/old")}
    assert got == want | {("app.js", "ANY", "/admin/stats"), ("app.js", "GET", "/")}
    assert routers.mounted_routes(spark.createDataFrame([], FILES)).count() == 0


def test_notebooks_of_any_shape(spark):
    book = '{"cells": [{"cell_type": "code", "source": ["def f():\\n", "  pass"], "execution_count": 2, "outputs": [{"output_type": "stream", "text": "x"}, {"odd": 1}, {"output_type": "error", "ename": "E", "evalue": "v", "traceback": []}]}, {"cell_type": "code", "source": "class A: pass", "execution_count": 1}, {"source": 5}, {"cell_type": "markdown", "source": []}, {"cell_type": "raw", "source": "r", "execution_count": "no"}]}'
    files = spark.createDataFrame([("a", book), ("b", "no json"), ("c", '{"cells": 3}'), ("d", None), ("e", "{}")], FILES)
    found = books.cells(files)
    got = [tuple(r)[2:] for r in found.orderBy("cell").collect()]
    assert got == [("code", "def f():\n  pass", 2, "stream unknown error", "E: v"), ("code", "class A: pass", 1, "", ""), ("unknown", "5", None, "", ""), ("markdown", "", None, "", ""), ("raw", "r", None, "", "")]
    assert {tuple(r) for r in books.functions(found).collect()} == {("a", 1, "f"), ("a", 2, "A")}
    assert books.extracted_code(found).first()["code"] == "# cell 1\ndef f():\n  pass\n\n# cell 2\nclass A: pass"
    assert [tuple(r) for r in books.execution_order(found).collect()] == [("a", 2, 1, 2)]
