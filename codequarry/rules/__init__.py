"""All interface rules, in the order their rows are listed for a file."""

from __future__ import annotations

from codequarry.rules import (
    csharp,
    dart,
    elixir,
    go,
    java,
    javascript,
    kotlin,
    php,
    python,
    ruby,
    rust,
    scala,
    swift,
)
from codequarry.rules.base import Detector

_JS = ("javascript", "typescript")
_JVM = ("java", "kotlin")

DETECTORS = (
    Detector("express", _JS, javascript.express),
    Detector("socketio-js", _JS, javascript.socketio, directed=True),
    Detector("fastify", _JS, javascript.fastify),
    Detector("nestjs", _JS, javascript.nestjs),
    Detector("websocket-js", _JS, javascript.websocket),
    Detector("graphql-js", _JS, javascript.graphql),
    Detector("flask", ("python",), python.flask),
    Detector("fastapi", ("python",), python.fastapi),
    Detector("django", ("python",), python.django),
    Detector("flask-socketio", ("python",), python.flask_socketio),
    Detector("django-channels", ("python",), python.django_channels),
    Detector("grpc-python", ("python",), python.grpc),
    Detector("spring", _JVM, java.spring),
    Detector("jax-rs", ("java",), java.jax_rs),
    Detector("spring-websocket", _JVM, java.spring_websocket),
    Detector("grpc-java", ("java",), java.grpc),
    Detector("aspnet-core", ("csharp",), csharp.aspnet_core),
    Detector("signalr", ("csharp",), csharp.signalr),
    Detector("grpc-csharp", ("csharp",), csharp.grpc),
    Detector("go-net-http", ("go",), go.net_http),
    Detector("gin", ("go",), go.gin),
    Detector("echo", ("go",), go.echo),
    Detector("fiber", ("go",), go.fiber),
    Detector("chi", ("go",), go.chi),
    Detector("grpc-go", ("go",), go.grpc),
    Detector("websocket-go", ("go",), go.websocket),
    Detector("laravel", ("php",), php.laravel),
    Detector("symfony", ("php",), php.symfony),
    Detector("slim", ("php",), php.slim),
    Detector("rails", ("ruby",), ruby.rails),
    Detector("sinatra", ("ruby",), ruby.sinatra),
    Detector("actix-web", ("rust",), rust.actix_web),
    Detector("axum", ("rust",), rust.axum),
    Detector("rocket", ("rust",), rust.rocket),
    Detector("warp", ("rust",), rust.warp),
    Detector("grpc-rust", ("rust",), rust.grpc),
    Detector("ktor", ("kotlin",), kotlin.ktor),
    Detector("vapor", ("swift",), swift.vapor),
    Detector("shelf", ("dart",), dart.shelf),
    Detector("dart-frog", ("dart",), dart.dart_frog),
    Detector("play-framework", ("scala",), scala.play),
    Detector("akka-http", ("scala",), scala.akka_http),
    Detector("phoenix", ("elixir",), elixir.phoenix),
)
