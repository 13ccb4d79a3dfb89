from __future__ import annotations

import json

from codequarry.operators import project


def package(path, scripts=None, **maps):
    return (path, json.dumps({"name": path, "scripts": scripts or {}, **maps}))


def test_unreadable_packages_are_skipped(source_files):
    texts = {
        "{bad": False, "null": False, '{"a":1} x': False, "{}": True, "[1]": True, "0": False,
        "7": True, '""': False, '"s"': True, "false": False, '{"a":1}}': False, "": False,
        ' {"a": {"b": [1, null]}}\n': True, "{'a': 1}": False, '{"dependencies": ["x"]}': True,
        '{"a": 1,}': False, '{"a": NaN}': False, "[1": False, "true": True, "1 2": False,
    }
    files = source_files(*[(f"{i}/package.json", t) for i, t in enumerate(texts)])
    kept = {int(r.path.split("/")[0]) for r in project.packages(files).collect()}
    assert kept == {i for i, ok in enumerate(texts.values()) if ok}


def test_dependencies_keep_order_and_repeats(source_files):
    text = '{"peerDependencies": {"c": "1"}, "dependencies": {"b": "1", "a": {"x": 1}, "b": "2"}, "devDependencies": {"a": null}}'
    rows = project.package_dependencies(source_files(("package.json", text))).collect()
    assert [(r.ord, r.dependency) for r in rows] == [(0, "b"), (1, "a"), (2, "a"), (3, "c")]


def test_roles(source_files):
    both = {"dependencies": {"react": "1", "express": "1"}}
    cases = {
        "client/package.json": ({}, "unknown"),
        "x/Client/package.json": ({}, "frontend"),
        "x/frontend/y/package.json": ({"dependencies": {"express": "1"}}, "frontend"),
        "x/server/package.json": ({}, "backend"),
        "x/backend/client/package.json": ({}, "frontend"),
        "f/package.json": ({"dependencies": {"Vue": "1"}}, "frontend"),
        "b/package.json": ({"devDependencies": {"koa": "1"}}, "backend"),
        "s/package.json": ({**both, "scripts": {"start": "x"}}, "backend"),
        "e/package.json": ({**both, "scripts": {"start": ""}}, "unknown"),
        "n/package.json": (both, "unknown"),
    }
    files = source_files(*[package(p, **c) for p, (c, _) in cases.items()])
    roles = {r.path: r.role for r in project.package_profiles(files).collect()}
    assert roles == {p: role for p, (_, role) in cases.items()}


def test_the_last_start_script_counts(source_files):
    text = '{"scripts": {"start": "x", "start": ""}, "dependencies": {"next": "1", "koa": "1"}}'
    (row,) = project.package_profiles(source_files(("package.json", text))).collect()
    assert row.role == "unknown"


def test_project_sections(source_files):
    files = source_files(
        package("x/client/package.json", dependencies={"spring-web": "1", "pg": "1"}),
        package("y/package.json", dependencies={"next": "1", "koa": "1", "mongoose": "1"}),
        ("main.py", ""),
        ("a/b.sc", ""),
        ("lib/main.dart", ""),
        ("go.mod", ""),
        ("dist/a.rb", ""),
    )
    rows = project.project_profiles(files).collect()
    found = {}
    for r in rows:
        found.setdefault(r.section, set()).add((r.value, r.detail) if r.detail else r.value)
    assert found == {
        "languages": {"Python", "Scala", "Dart"},
        "runtimes": {"Python", "Dart"},
        "packageManagers": {"Go Modules"},
        "entryPoints": {"main.py", "lib/main.dart"},
        "manifests": {
            ("x/client/package.json", "package.json"),
            ("y/package.json", "package.json"),
            ("go.mod", "go.mod"),
        },
        "frameworks": {("Spring", "frontend"), ("NextJS", "frontend"), ("Koa", "backend")},
        "databases": {"PostgreSQL", "MongoDB"},
        "orms": {"Mongoose"},
        "dependencies": {"spring-web", "pg", "next", "koa", "mongoose"},
    }
    (summary,) = project.project_summary(files).collect()
    assert summary.frameworks == ["Koa", "NextJS", "Spring"]
    assert (summary.dependencies, summary.entryPoints, summary.manifests) == (5, 2, 3)


def test_spring_in_the_backend_is_a_runtime(source_files):
    files = source_files(package("package.json", dependencies={"spring-boot": "1"}))
    assert [r.runtime for r in project.runtimes(files).collect()] == ["JVM"]
    rows = project.project_profiles(files).where("section = 'runtimes'").collect()
    assert [r.value for r in rows] == ["JVM"]


def test_pages_hold_the_whole_profile(spark, source_files):
    """One project with most of the entries: full pages, every row once, the rest on page 0."""
    import json

    names = {f"dep{k:03}": "1" for k in range(137)} | {"react": "1", "express": "2", "pg": "3"}
    files = [("big", f"a{k}/index.js", "x") for k in range(45)]
    files += [("big", f"m{k}/go.mod", "x") for k in range(20)] + [("big", f"p{k}/package.json", json.dumps({"dependencies": names})) for k in range(3)]
    files += [("small", "package.json", '{"dependencies": {"vue": "1"}}'), ("bare", "x.py", "y")]
    table = source_files(*files)
    wanted = sorted(tuple(r) for r in project.project_profiles(table).collect())
    wanted = sorted(wanted, key=repr)
    for entries in (1, 7, 10, 1000):
        pages = project.project_pages(table, entries)
        rows = pages.collect()
        assert sorted((tuple(r) for r in project.profile_rows(pages).collect()), key=repr) == wanted
        for name in ("dependencies", "entryPoints", "manifests"):
            sizes = {r.page: len(r[name]) for r in rows if r.project == "big"}
            filled = [sizes[k] for k in sorted(sizes) if sizes[k]]
            assert all(n == entries for n in filled[:-1]) and filled[-1] <= entries
        assert all(not r.languages and not r.frameworks for r in rows if r.page)
        assert {r.project for r in rows} == {"big", "small", "bare"}
    assert project.project_pages(source_files(*files).limit(0)).collect() == []
