"""Words without which a rule finds nothing, as bits of a number by file.

The numbers are stored with the corpus as a level of directories, so a rule opens only files
that hold one of its words. A bit is set more often than a rule finds rows, never less.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.languages import interface_language
from codequarry.functions.text import mentions
from codequarry.rules import DETECTORS
from codequarry.rules.base import Detector
from codequarry.rules.dart import DART_FROG_PACKAGE
from codequarry.rules.go import (
    CHI_IMPORT,
    ECHO_IMPORT,
    FIBER_IMPORT,
    GIN_IMPORT,
    GRPC_IMPORT,
    WEBSOCKET_IMPORTS,
)
from codequarry.rules.php import LARAVEL_FACADE
from codequarry.rules.rust import WARP_EVIDENCE
from codequarry.rules.scala import AKKA_EVIDENCE, PLAY_EVIDENCE

# Words to find in the text as it is.
WORDS = {
    "nestjs": ("@nestjs/common", "@Controller"),
    "graphql-js": ("express-graphql", "graphqlHTTP", "ApolloServer", "GraphQLSchema", "createYoga"),
    "flask": ("flask", "Flask", "Blueprint", ".route"),
    "fastapi": ("FastAPI", "APIRouter", "fastapi"),
    "django": ("django", "urlpatterns"),
    "flask-socketio": ("flask_socketio", "SocketIO"),
    "django-channels": (
        "channels", "WebsocketConsumer", "websocket_urlpatterns", "TypeRouter", "URLRouter",
    ),
    "grpc-python": ("grpc", "Servicer_to_server"),
    "spring": ("org.springframework.", "Controller", "Mapping"),
    "jax-rs": ("@Path",),
    "spring-websocket": ("org.springframework.", "MessageMapping", "SubscribeMapping", "SendTo"),
    "grpc-java": ("io.grpc", "GrpcService", "ImplBase", "bindService"),
    "aspnet-core": (
        "AspNetCore", "WebApplication", "ControllerBase", "ApiController", ".Map", "[Http",
    ),
    "signalr": ("SignalR", "Hub", "Clients.", "SendAsync"),
    "grpc-csharp": ("Grpc", "Base"),
    "go-net-http": ("net/http", "http."),
    "gin": (GIN_IMPORT, "gin."),
    "echo": (ECHO_IMPORT, "echo.New"),
    "fiber": (FIBER_IMPORT, "fiber.New"),
    "chi": (CHI_IMPORT, "chi.NewRouter"),
    "grpc-go": (GRPC_IMPORT, "Register", "grpc.NewServer"),
    "websocket-go": (*WEBSOCKET_IMPORTS, "Upgrade"),
    "symfony": ("Symfony", "Route"),
    "slim": ("Slim", "AppFactory"),
    "rails": ("Rails.", "ApplicationController", "ActionController::"),
    "sinatra": ("sinatra", "Sinatra::Base"),
    "actix-web": ("actix_web", "HttpServer::new", "App::new"),
    "axum": ("axum::", "Router::new"),
    "rocket": ("rocket", "#[launch]"),
    "warp": (WARP_EVIDENCE,),
    "grpc-rust": ("tonic", "add_service"),
    "ktor": ("io.ktor", "embeddedServer", "routing"),
    "vapor": ("Vapor",),
    "shelf": ("shelf", "Router"),
    "dart-frog": (DART_FROG_PACKAGE, "onRequest"),
    "play-framework": PLAY_EVIDENCE,
    "akka-http": (AKKA_EVIDENCE,),
    "phoenix": ("Phoenix.", "scope"),
}
# Words to find in the lower-cased text.
LOWER_WORDS = {
    "express": ("express", "router"),
    "socketio-js": ("io.on", "socket.io"),
    "fastify": ("fastify",),
    "websocket-js": ("websocket", "wss.on"),
    "laravel": (LARAVEL_FACADE.lower(), "route::"),
}


def _bits() -> dict[str, dict[str, int]]:
    """By language, the bit of each of its rules, in their order."""
    found: dict[str, dict[str, int]] = defaultdict(dict)
    for d in DETECTORS:
        for language in d.languages:
            found[language][d.name] = 1 << len(found[language])
    return dict(found)


BITS = _bits()
# Numbers mean nothing under other words, so a column of them is named after the words.
EVIDENCE = "evidence_%08x" % zlib.crc32(repr((BITS, WORDS, LOWER_WORDS)).encode())


def evidence(path: Column, text: Column) -> Column:
    """The rules of a file's language whose words it holds, as a number; 0 without any."""
    language, lower = interface_language(path), F.lower(text)

    def held(name: str) -> Column:
        if name in LOWER_WORDS:
            return mentions(lower, *LOWER_WORDS[name])
        return mentions(text, *WORDS[name])

    number = F
    for known, rules in BITS.items():
        bits = [F.when(held(name), bit).otherwise(0) for name, bit in rules.items()]
        number = number.when(language == known, reduce(lambda a, b: a + b, bits))
    return F.coalesce(number.otherwise(0), F.lit(0)).cast("int")


def evident(detectors: Iterable[Detector]) -> Column:
    """Files, by kind and number, that hold evidence of one of the rules."""
    names = {d.name for d in detectors}
    tests = []
    for language, rules in BITS.items():
        mask = sum(bit for name, bit in rules.items() if name in names)
        if mask:
            tests.append((F.col("kind") == language) & (F.col(EVIDENCE).bitwiseAND(mask) != 0))
    return reduce(lambda a, b: a | b, tests, F.lit(False))
