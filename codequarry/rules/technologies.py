"""Fixed tables about packages, manifests and runtimes."""

from __future__ import annotations

# --- fixed values: category -> technology -> package names --------------------
TECHNOLOGIES = {
    "frontend": {
        "React": ["react", "react-dom"],
        "Vite": ["vite"],
        "NextJS": ["next"],
        "Vue": ["vue"],
        "Nuxt": ["nuxt"],
        "Angular": ["@angular/core"],
        "Svelte": ["svelte"],
        "SvelteKit": ["@sveltejs/kit"],
        "Astro": ["astro"],
    },
    "backend": {
        "Express": ["express"],
        "Fastify": ["fastify"],
        "NestJS": ["@nestjs/core"],
        "Koa": ["koa"],
        "Hapi": ["@hapi/hapi"],
        "Flask": ["flask"],
        "FastAPI": ["fastapi"],
        "Django": ["django"],
        "Spring": ["spring-boot", "spring-web", "spring-webmvc"],
        "ASP.NET": ["Microsoft.AspNetCore"],
        "Gin": ["github.com/gin-gonic/gin"],
        "Echo": ["github.com/labstack/echo"],
        "Fiber": ["github.com/gofiber/fiber"],
        "Rails": ["rails"],
        "Laravel": ["laravel/framework"],
        "Symfony": ["symfony/framework-bundle"],
        "Phoenix": ["phoenix"],
        "Actix": ["actix-web"],
        "Axum": ["axum"],
        "Rocket": ["rocket"],
        "Ktor": ["io.ktor"],
        "Vapor": ["vapor"],
    },
    "database": {
        "MongoDB": ["mongodb", "mongoose", "pymongo", "motor"],
        "PostgreSQL": ["pg", "psycopg2", "psycopg", "postgres"],
        "MySQL": ["mysql", "mysql2", "mysqlclient"],
        "Redis": ["redis", "ioredis"],
        "SQLite": ["sqlite3", "better-sqlite3", "sqlite"],
        "Cassandra": ["cassandra-driver"],
        "DynamoDB": ["@aws-sdk/client-dynamodb"],
        "Firebase": ["firebase", "firebase-admin"],
    },
    "orm": {
        "Mongoose": ["mongoose"],
        "Prisma": ["prisma", "@prisma/client"],
        "Sequelize": ["sequelize"],
        "TypeORM": ["typeorm"],
        "SQLAlchemy": ["sqlalchemy"],
        "Hibernate": ["hibernate-core"],
        "EntityFramework": ["Microsoft.EntityFrameworkCore"],
        "ActiveRecord": ["activerecord"],
        "Ecto": ["ecto"],
    },
    "realtime": {
        "Socket.IO": ["socket.io", "socket.io-client"],
        "WebSocket": ["ws", "websocket"],
        "SignalR": ["@microsoft/signalr"],
        "Flask-SocketIO": ["flask-socketio"],
    },
    "ai": {
        "OpenAI": ["openai"],
        "Anthropic": ["@anthropic-ai/sdk"],
        "LangChain": ["langchain", "@langchain/core"],
        "Transformers": ["transformers", "@huggingface/transformers"],
        "TensorFlow": ["tensorflow", "@tensorflow/tfjs"],
        "PyTorch": ["torch"],
        "ScikitLearn": ["scikit-learn"],
        "Pandas": ["pandas"],
        "NumPy": ["numpy"],
    },
    "testing": {
        "Jest": ["jest"],
        "Vitest": ["vitest"],
        "Mocha": ["mocha"],
        "Cypress": ["cypress"],
        "Playwright": ["playwright", "@playwright/test"],
        "Pytest": ["pytest"],
        "JUnit": ["junit"],
    },
}

MANAGERS = {
    "npm": ["package-lock.json"],
    "Yarn": ["yarn.lock"],
    "pnpm": ["pnpm-lock.yaml"],
    "Bun": ["bun.lock", "bun.lockb"],
    "pip": ["requirements.txt", "pyproject.toml", "Pipfile"],
    "Maven": ["pom.xml"],
    "Gradle": ["build.gradle", "build.gradle.kts"],
    "Go Modules": ["go.mod"],
    "Cargo": ["Cargo.toml"],
    "Bundler": ["Gemfile"],
    "Composer": ["composer.json"],
    "Pub": ["pubspec.yaml"],
    "Swift Package Manager": ["Package.swift"],
    "Mix": ["mix.exs"],
}

# Languages, by display name, that show a runtime. Scala alone shows none.
RUNTIMES = {
    "Node.js": ["JavaScript", "TypeScript"],
    "Python": ["Python"],
    "JVM": ["Java", "Kotlin"],
    ".NET": ["CSharp"],
    "Go": ["Go"],
    "Rust": ["Rust"],
    "Ruby": ["Ruby"],
    "PHP": ["PHP"],
    "Swift": ["Swift"],
    "Dart": ["Dart"],
    "BEAM": ["Elixir"],
}
# This backend technology shows a runtime by itself.
BACKEND_RUNTIME = ("Spring", "JVM")

ENTRY_POINTS = [
    "index.js",
    "server.js",
    "app.js",
    "main.js",
    "index.ts",
    "server.ts",
    "app.ts",
    "main.ts",
    "main.py",
    "app.py",
    "manage.py",
    "Main.java",
    "Application.java",
    "Program.cs",
    "main.go",
    "main.rs",
    "main.rb",
    "config.ru",
    "index.php",
    "main.kt",
    "Application.kt",
    "main.swift",
    "main.dart",
    "lib/main.dart",
    "main.ex",
]

MANIFESTS = [
    "package.json",
    "requirements.txt",
    "pyproject.toml",
    "Pipfile",
    "pom.xml",
    "build.gradle",
    "build.gradle.kts",
    "settings.gradle",
    "settings.gradle.kts",
    "go.mod",
    "Cargo.toml",
    "Gemfile",
    "composer.json",
    "pubspec.yaml",
    "Package.swift",
    "mix.exs",
]

# Directories that settle the role of the packages below them, in this order.
ROLE_DIRECTORIES = (
    ("client", "frontend"),
    ("frontend", "frontend"),
    ("server", "backend"),
    ("backend", "backend"),
)
# -----------------------------------------------------------------------------
