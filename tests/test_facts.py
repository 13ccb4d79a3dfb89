from __future__ import annotations

from codequarry.operators import facts


def test_functions(source_files):
    files = source_files(
        ("a.js", "async function a() {}\nconst b = async (x) =>\n 1; let c = y => 2;\nfunction a() {}"),
        ("b.jsx", "function J() {}"),
        ("c.java", "class C {\n\n  int f(int x) {\n return foo(x); } Foo g = new Foo(1); }"),
        ("d.rb", "def ok?\nend\ndef set=(x)"),
        ("e.ex", "defp hid(x)\ndef pub do"),
        ("f.dart", "Future<int> go(x) async {\n}"),
        ("g.md", "function no() {}"),
    )
    rows = [(r.file, r.name, r.line) for r in facts.functions(files).collect()]
    assert sorted(rows) == [
        ("a.js", "a", 1),
        ("a.js", "a", 4),
        ("a.js", "b", 2),
        ("a.js", "c", 3),
        ("b.jsx", "J", 1),
        ("c.java", "Foo", 4),
        ("c.java", "f", 1),
        ("c.java", "foo", 3),
        ("d.rb", "ok?", 1),
        ("d.rb", "set=", 3),
        ("e.ex", "hid", 1),
        ("e.ex", "pub", 2),
        ("f.dart", "go", 1),
    ]


def test_imports_and_kinds(source_files):
    text = (
        "import x from './OrderService'\nimport './repo:x'\nconst m = require( \"../models/M\" )\n"
        "import { a,\n b } from 'late'\nimport y from './userEntity'\nrequire('controllers/c')\n"
        "require('middleware')\nrequire('helpers')\nrequire('fs'); require('fs')\nrequire('')"
    )
    rows = [(r.source, r.kind, r.line) for r in facts.imports(source_files(("a.py", text))).collect()]
    assert rows == [
        ("./OrderService", "service", 1),
        ("./userEntity", "model", 6),
        ("./repo:x", "repository", 2),
        ("../models/M", "model", 3),
        ("controllers/c", "controller", 7),
        ("middleware", "middleware", 8),
        ("helpers", "utility", 9),
        ("fs", "module", 10),
        ("", "module", 11),
    ]


def test_db_operations(source_files):
    text = "User.find (1); db.query('x')\n$a.create(); Database.Prepare('y'); x.findAll(1)"
    rows = facts.db_operations(source_files(("a.js", text))).collect()
    assert [(r.kind, r.target, r.operation, r.line) for r in rows] == [
        ("orm", "User", "find", 1),
        ("orm", "a", "create", 2),
        ("database", "db", "query", 1),
        ("database", "database", "query", 1),
        ("database", "database", "Prepare", 2),
    ]


def test_external_apis(source_files):
    text = "fetch('http://a:1/b'); prefetch('no')\naxios.GET(`u`); requests.post(\"v\") ; https.get('w'); http.get(x)"
    rows = facts.external_apis(source_files(("a.js", text))).collect()
    assert [(r.client, r.method, r.target, r.line) for r in rows] == [
        ("fetch", "fetch", "http://a:1/b", 1),
        ("axios", "GET", "u", 2),
        ("requests", "post", "v", 2),
        ("http", "get", "w", 2),
    ]


def test_file_analysis(source_files):
    text = "import m from './models/A.js'\nfunction f() { A.find(); fetch('x') }"
    (row,) = facts.analyze_files(source_files(("a.ts", text), ("b.txt", text))).collect()
    assert (row.file, row.language) == ("a.ts", "typescript")
    assert [tuple(x) for x in row.functions] == [("f", 2)]
    assert [tuple(x) for x in row.dependencies.models] == [("./models/A.js", 1)]
    assert row.dependencies.services == []
    assert [tuple(x) for x in row.databaseOperations] == [("orm", "A", "find", 2)]
    assert [tuple(x) for x in row.externalApis] == [("fetch", "fetch", "x", 2)]
