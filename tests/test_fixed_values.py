"""Each fixed value against an expectation written by hand, apart from the tables."""

from __future__ import annotations

import json

from codequarry.functions.languages import display_language, flow_language, interface_language
from codequarry.operators import facts, project
from codequarry.sources.corpus import scan
from pyspark.sql import functions as F

PACKAGES = """
frontend: react=React react-dom=React vite=Vite next=NextJS vue=Vue nuxt=Nuxt @angular/core=Angular
  svelte=Svelte @sveltejs/kit=SvelteKit astro=Astro
backend: express=Express fastify=Fastify @nestjs/core=NestJS koa=Koa @hapi/hapi=Hapi flask=Flask
  fastapi=FastAPI django=Django spring-boot=Spring spring-web=Spring spring-webmvc=Spring
  Microsoft.AspNetCore=ASP.NET github.com/gin-gonic/gin=Gin github.com/labstack/echo=Echo
  github.com/gofiber/fiber=Fiber rails=Rails laravel/framework=Laravel symfony/framework-bundle=Symfony
  phoenix=Phoenix actix-web=Actix axum=Axum rocket=Rocket io.ktor=Ktor vapor=Vapor
database: mongodb=MongoDB mongoose=MongoDB pymongo=MongoDB motor=MongoDB pg=PostgreSQL
  psycopg2=PostgreSQL psycopg=PostgreSQL postgres=PostgreSQL mysql=MySQL mysql2=MySQL mysqlclient=MySQL
  redis=Redis ioredis=Redis sqlite3=SQLite better-sqlite3=SQLite sqlite=SQLite
  cassandra-driver=Cassandra @aws-sdk/client-dynamodb=DynamoDB firebase=Firebase firebase-admin=Firebase
orm: mongoose=Mongoose prisma=Prisma @prisma/client=Prisma sequelize=Sequelize typeorm=TypeORM
  sqlalchemy=SQLAlchemy hibernate-core=Hibernate Microsoft.EntityFrameworkCore=EntityFramework
  activerecord=ActiveRecord ecto=Ecto
realtime: socket.io=Socket.IO socket.io-client=Socket.IO ws=WebSocket websocket=WebSocket
  @microsoft/signalr=SignalR flask-socketio=Flask-SocketIO
ai: openai=OpenAI @anthropic-ai/sdk=Anthropic langchain=LangChain @langchain/core=LangChain
  transformers=Transformers @huggingface/transformers=Transformers tensorflow=TensorFlow
  @tensorflow/tfjs=TensorFlow torch=PyTorch scikit-learn=ScikitLearn pandas=Pandas numpy=NumPy
testing: jest=Jest vitest=Vitest mocha=Mocha cypress=Cypress playwright=Playwright
  @playwright/test=Playwright pytest=Pytest junit=JUnit
"""
LANGUAGES = """
js=JavaScript mjs=JavaScript cjs=JavaScript jsx=JavaScript ts=TypeScript tsx=TypeScript py=Python
java=Java cs=CSharp go=Go php=PHP rb=Ruby rs=Rust kt=Kotlin kts=Kotlin swift=Swift dart=Dart
scala=Scala sc=Scala ex=Elixir exs=Elixir
"""
MANAGERS = {
    "package-lock.json": "npm", "yarn.lock": "Yarn", "pnpm-lock.yaml": "pnpm", "bun.lock": "Bun",
    "bun.lockb": "Bun", "requirements.txt": "pip", "pyproject.toml": "pip", "Pipfile": "pip",
    "pom.xml": "Maven", "build.gradle": "Gradle", "build.gradle.kts": "Gradle", "go.mod": "Go Modules",
    "Cargo.toml": "Cargo", "Gemfile": "Bundler", "composer.json": "Composer", "pubspec.yaml": "Pub",
    "Package.swift": "Swift Package Manager", "mix.exs": "Mix",
}
RUNTIMES = {
    "JavaScript": "Node.js", "TypeScript": "Node.js", "Python": "Python", "Java": "JVM", "Kotlin": "JVM",
    "CSharp": ".NET", "Go": "Go", "Rust": "Rust", "Ruby": "Ruby", "PHP": "PHP", "Swift": "Swift",
    "Dart": "Dart", "Elixir": "BEAM", "Scala": None,
}
MANIFESTS = """package.json requirements.txt pyproject.toml Pipfile pom.xml build.gradle build.gradle.kts
settings.gradle settings.gradle.kts go.mod Cargo.toml Gemfile composer.json pubspec.yaml Package.swift
mix.exs""".split()
ENTRIES = """index.js server.js app.js main.js index.ts server.ts app.ts main.ts main.py app.py manage.py
Main.java Application.java Program.cs main.go main.rs main.rb config.ru index.php main.kt Application.kt
main.swift main.dart main.ex""".split()


def languages() -> dict[str, str]:
    return dict(x.split("=") for x in LANGUAGES.split())


def test_technologies(source_files):
    expected = set()
    for line in PACKAGES.replace("\n  ", " ").strip().splitlines():
        category, pairs = line.split(": ")
        expected |= {(category, *pair.split("=")) for pair in pairs.split()}
    names = sorted({name for _, name, _ in expected})
    files = [(f"{k}/package.json", json.dumps({"dependencies": {n: "1"}})) for k, n in enumerate(names)]
    files += [(f"no{k}/package.json", json.dumps({"dependencies": {n + "-x": "1"}})) for k, n in enumerate(names)]
    rows = project.package_technologies(source_files(*files)).collect()
    found = {(r.category, names[int(r.path.split("/")[0])], r.technology) for r in rows}
    assert found == expected and len({t for _, _, t in expected}) == 67 + 1


def test_languages(source_files):
    known = languages()
    files = [(f"f.{e}", "") for e in known] + [(f"G.{e.upper()}", "") for e in known]
    files += [("f.jsp", ""), ("js", ""), (".js", ""), ("f.js.txt", "")]
    path = F.col("path")
    rows = scan(source_files(*files)).select(
        "path", display_language(path).alias("d"), flow_language(path).alias("f"), interface_language(path).alias("i")
    )
    for r in rows.collect():
        name = known.get(r.path.rpartition(".")[2].lower()) if r.path[:2] in ("f.", "G.") else None
        assert r.d == name and r.f == (name and name.lower())
        assert r.i == (None if r.path.lower().endswith(".jsx") else r.f)


def test_managers_manifests_and_entry_points(source_files):
    names = sorted({*MANAGERS, *MANIFESTS, *ENTRIES})
    files = [(f"p{k}", f"sub/{n}", "{}") for k, n in enumerate(names)]
    files += [(f"n{k}", f"sub/x{n}", "{}") for k, n in enumerate(names)]
    table = source_files(*files)
    managers = {r.project: r.manager for r in project.package_managers(table).collect()}
    assert managers == {f"p{k}": MANAGERS[n] for k, n in enumerate(names) if n in MANAGERS}
    manifests = {r.project: r.type for r in project.manifests(table).collect()}
    assert manifests == {f"p{k}": n for k, n in enumerate(names) if n in MANIFESTS}
    entries = {r.project for r in project.entry_points(table).collect()}
    assert entries == {f"p{k}" for k, n in enumerate(names) if n in ENTRIES}


def test_runtimes(source_files):
    known = languages()
    table = source_files(*[(e, f"f.{e}", "") for e in known])
    found = {r.project: r.runtime for r in project.runtimes(table).collect()}
    assert found == {e: RUNTIMES[n] for e, n in known.items() if RUNTIMES[n]}


def test_import_kinds(source_files):
    cases = {
        "./orderService": "service", "./userRepository": "repository", "./repo": "repository", "./UserModel": "model",
        "./schema": "model", "./entity/a": "model", "./aController": "controller", "./Middleware": "middleware",
        "./utils": "utility", "./helper": "utility", "react": "module", "./serviceModel": "service",
    }
    text = "\n".join(f"import x from '{s}'" for s in cases)
    rows = facts.imports(source_files(("a.js", text))).collect()
    assert {r.source: r.kind for r in rows} == cases


def test_ignored_directories(source_files):
    names = ("node_modules", ".git", "dist", "build", "coverage")
    files = [(f"{n}/a.js", "") for n in names] + [(f"x/{n}/y/a.js", "") for n in names]
    files += [(f"{n}s/a.js", "") for n in names] + [(n, "") for n in names]
    left = {r.path for r in scan(source_files(*files)).collect()}
    assert left == {f"{n}s/a.js" for n in names} | set(names)
