"""Expected interfaces of small files, one group of cases per rule."""

from __future__ import annotations

import pytest

from codequarry.operators.interfaces import detect_routes, discover_interfaces, interfaces_full
from codequarry.rules import DETECTORS

# path -> (content, expected rows in order). HTTP rows are (framework, method, path),
# events (protocol, framework, role, event) with the direction where there is one.
CASES = {
    "express/a.js": (
        "import x from 'express'\napp.get('/a', f); xRouter.post('/no'); router . get('/no');\n"
        "router.DELETE(`/b`, f); app.get('/a', g)",
        [("Express", "GET", "/a"), ("Express", "DELETE", "/b")],
    ),
    "express/unicode.js": ("express()\néapp.get('/x', f)", [("Express", "GET", "/x")]),
    "express/none.js": ("app.get('/a', f)", []),
    "express/wide_space.js": (
        "express()\napp.get( '/nbsp', f)",
        [("Express", "GET", "/nbsp")],
    ),
    "express/both.ts": (
        "require('express'); require('fastify')\napp.put('/p', f)",
        [("Express", "PUT", "/p"), ("Fastify", "PUT", "/p")],
    ),
    "socketio/server.js": (
        "io.on('connection', s => {});\nsocket.on('e', f); socket.on('e', g); io.emit('e');"
        "io.to(x).emit('no'); io.of.x.emit('news'); socket.emit('client only')",
        [
            ("socketio", "Socket.IO", "server", "e", "incoming"),
            ("socketio", "Socket.IO", "server", "news", "outgoing"),
        ],
    ),
    "socketio/client.js": (
        "import { io } from 'socket.io-client'; const s = io('x')\n"
        "socket.emit('a'); socket.on('a', f); socket.on('b', f)",
        [
            ("socketio", "Socket.IO", "client", "a", "outgoing"),
            ("socketio", "Socket.IO", "client", "b", "incoming"),
        ],
    ),
    "socketio/import_only.js": ("require('socket.io')\nsocket.on('a', f)", []),
    "fastify/a.mjs": (
        "fastify ()\nfastify.head('/h'); server.patch(\n '/p'); app.route('/no')",
        [("Fastify", "HEAD", "/h"), ("Fastify", "PATCH", "/p")],
    ),
    "nest/a.ts": (
        "@Controller('cats/') export class A { @Get() a() {} @Post('/x/') b() {} }\n"
        "@Controller() class B { @Head('//y') c() {} }",
        [("NestJS", "GET", "/cats"), ("NestJS", "POST", "/cats/x"), ("NestJS", "HEAD", "/y")],
    ),
    "nest/loose.ts": (
        "import '@nestjs/common'; @Get('a') f() {} @GetX('no')",
        [("NestJS", "GET", "/a"), ("NestJS", "GET", "/")],
    ),
    "nest/none.ts": ("@Get('a') f() {}", []),
    "ws/server.js": (
        "new WebSocketServer({}); wss.on('Connection', f); ws.on('ping', f); x.onmessage = f",
        [
            ("websocket", "WebSocket", "server", "Connection"),
            ("websocket", "WebSocket", "server", "message"),
        ],
    ),
    "ws/silent.js": ("new WebSocket.Server({})", [("websocket", "WebSocket", "server", "connection")]),
    "ws/client.js": (
        "new WebSocket('ws://x'); client.addEventListener('open', f)",
        [("websocket", "WebSocket", "client", "open")],
    ),
    "ws/both.js": (
        "new WebSocket('wss://x'); new WebSocketServer(); onclose = f",
        [("websocket", "WebSocket", "unknown", "close")],
    ),
    "graphql/a.js": (
        "new ApolloServer({ path: '/p' }); app.use('/g', 1, createHandler()); endpoint: `/p`",
        [("Apollo Server", "POST", "/g"), ("Apollo Server", "POST", "/p")],
    ),
    "graphql/default.ts": ("import 'express-graphql'", [("GraphQL", "POST", "/graphql")]),
    "graphql/none.ts": ("const resolvers = { }; type Query", []),
    "flask/a.py": (
        "import flask\n@app.route('/x', methods=['get', \"POST\"])\n@router.put( '/y' )\n"
        "@app.route(rule='/z')\n@app.route(name)\n@bp.route('/missed')",
        [
            ("Flask", "GET", "/x"),
            ("Flask", "POST", "/x"),
            ("Flask", "PUT", "/y"),
            ("Flask", "GET", "/z"),
        ],
    ),
    "flask/tuple.py": (
        "@app.route('/x', methods=('GET', 'POST'))",
        [("Flask", "GET", "/x")],
    ),
    "flask/none.py": ("@app.get('/x')", []),
    "fastapi/a.py": (
        "r = APIRouter(prefix='/one')\nr = APIRouter(prefix='/a')\nx = FastAPI ()\n"
        "@r.get('/')\n@r.post('b')\n@x.put('//c//')\n@other.get('/no')\n@router.head('/d')",
        [
            ("FastAPI", "GET", "/a/"),
            ("FastAPI", "POST", "/a/b"),
            ("FastAPI", "PUT", "/c/"),
            ("FastAPI", "HEAD", "/d"),
        ],
    ),
    "django/urls.py": (
        "urlpatterns = [path('a/', v), re_path(\"b/\", v), path(r'raw/', v), path('a/', w)]",
        [("Django", "ANY", "a/"), ("Django", "ANY", "b/")],
    ),
    "flask_socketio/a.py": (
        "s = SocketIO(app)\n@s.on('a')\ns.emit('b'); t.emit('a')",
        [
            ("socketio", "Flask-SocketIO", "server", "a"),
            ("socketio", "Flask-SocketIO", "server", "b"),
        ],
    ),
    "channels/a.py": (
        "import channels\n",
        [("websocket", "Django Channels", "server", "websocket")],
    ),
    "channels/none.py": ("import channels2\nclass XWebsocketConsumers: ...", []),
    "grpc/a.py": (
        "import grpc\nadd_GreeterServicer_to_server(x)\nclass G(pb.GreeterServicer, B):\n  ...",
        [("grpc", "gRPC", "server", "Greeter"), ("grpc", "gRPC", "server", "G")],
    ),
    "grpc/bare.py": ("from grpc import x\ngrpc.server()", [("grpc", "gRPC", "server", "grpc")]),
    "grpc/client.py": ("import grpc\n", []),
    "spring/A.java": (
        "@RequestMapping(value = {\"/a\"}) @X class A {\n @GetMapping List f() {}\n"
        " @PostMapping(path=\"/p/\") void g() {}\n @RequestMapping(\"/r\") void h() {}\n"
        " @RequestMapping(method = {RequestMethod.PUT, RequestMethod.HEAD}) void i() {} }",
        [
            # The brace of the value ends the look for a type, so this counts as a route.
            ("Spring", "ANY", "/a/a"),
            ("Spring", "GET", "/a/"),
            ("Spring", "POST", "/a/p/"),
            ("Spring", "ANY", "/a/r"),
            ("Spring", "PUT", "/a/"),
            ("Spring", "HEAD", "/a/"),
        ],
    ),
    "spring/prefix.java": (
        "@RequestMapping(\"/a\") @X record A { @PutMapping(\"/b\") f(); }",
        [("Spring", "PUT", "/a/b")],
    ),
    "spring/root.kt": ("@DeleteMapping fun f() {}", [("Spring", "DELETE", "/")]),
    "jaxrs/A.java": (
        "import jakarta.ws.rs.*; @Path(\"/a\") public class A {\n"
        " @GET @Path(\"x\") @Path(\"{id}/\") public String f() {}\n @POST @HEAD void g() {} }",
        [
            ("Jakarta REST", "GET", "/a/{id}"),
            ("Jakarta REST", "POST", "/a"),
            ("Jakarta REST", "HEAD", "/a"),
        ],
    ),
    "jaxrs/method.java": ("@Path(\"x\") @PUT void f() {}", [("JAX-RS", "PUT", "/x")]),
    "jaxrs/no_path.java": ("import javax.ws.rs.GET; @GET String f() {}", []),
    "springws/A.java": (
        "@MessageMapping(\"/m\") f() @SendTo g() @SubscribeMapping h()",
        [
            ("websocket", "Spring WebSocket", "server", "/m"),
            ("websocket", "Spring WebSocket", "server", "send"),
            ("websocket", "Spring WebSocket", "server", "message"),
        ],
    ),
    "grpcjava/A.java": (
        "class A extends x.GreeterGrpc implements GreeterGrpc.GreeterImplBase {\n"
        "@Override public void hello(X x) {} }",
        [("grpc", "gRPC", "server", "Greeter"), ("grpc", "gRPC", "server", "hello")],
    ),
    "grpcjava/bare.java": ("import io.grpc.X;", [("grpc", "gRPC", "server", "grpc")]),
    "aspnet/a.cs": (
        "[Route(\"api\")] public class A {\n [HttpGet(\"{id}/\")] a; [HttpPost] b; [HttpPut(@\"/c\")] }\n"
        "app.MapDelete($\"raw/\", f); app.MapAny(\"/no\")",
        [
            ("ASP.NET Core", "DELETE", "raw/"),
            ("ASP.NET Core", "GET", "/api/{id}"),
            ("ASP.NET Core", "POST", "/api"),
            ("ASP.NET Core", "PUT", "/api/c"),
        ],
    ),
    "signalr/a.cs": (
        "class A : Hub { public async Task Go(int x) {} public Task OnConnectedAsync() {}\n"
        "x.SendAsync(\"s\"); c.On<int, string>(\"Go\", f); }",
        [
            ("signalr", "SignalR", "server", "s"),
            ("signalr", "SignalR", "server", "Go"),
            ("signalr", "SignalR", "client", "Go"),
        ],
    ),
    "grpccs/a.cs": (
        "class A : Greeter.GreeterBase { public override Task<X> Hello(Y y) {} }",
        [("grpc", "gRPC", "server", "Greeter"), ("grpc", "gRPC", "server", "Hello")],
    ),
    "grpccs/bare.cs": ("using Grpc.Core;", [("grpc", "gRPC", "server", "grpc")]),
    "nethttp/a.go": (
        "import \"net/http\"\nhttp.Handle(\"/b\", x); mux.HandleFunc(`/a`, f); x.Handle(\"/no\")",
        [("net/http", "ANY", "/a"), ("net/http", "ANY", "/b")],
    ),
    "gin/a.go": ("gin.New()\nr.GET(\"/a\", f); r.Get(\"/no\")", [("Gin", "GET", "/a")]),
    "echo/a.go": ("\"github.com/labstack/echo/v4\"\ne.PUT('/a')", [("Echo", "PUT", "/a")]),
    "fiber/a.go": ("fiber.New()\na.Patch(\"/a\"); a.PATCH(\"/no\")", [("Fiber", "PATCH", "/a")]),
    "chi/a.go": ("chi.NewRouter()\nr.Head(\"/a\")", [("Chi", "HEAD", "/a")]),
    "grpcgo/a.go": ("pb.RegisterGreeterServer(s)", [("grpc", "gRPC", "server", "Greeter")]),
    "grpcgo/bare.go": ("grpc.NewServer()", [("grpc", "gRPC", "server", "grpc")]),
    "wsgo/a.go": (
        "websocket.Upgrader{}; c.ReadJSON(x)",
        [("websocket", "WebSocket", "server", "message")],
    ),
    "wsgo/b.go": ("u.Upgrade (w)", [("websocket", "WebSocket", "server", "websocket")]),
    "laravel/a.php": (
        "ROUTE::Get('/a', f); Route::match('/b'); Route::any(\"/c\"); Route::head('/no')",
        [("Laravel", "GET", "/a"), ("Laravel", "ANY", "/b"), ("Laravel", "ANY", "/c")],
    ),
    "symfony/a.php": (
        "/** @Route(\"/old\", methods={\"put\"}) */\n#[Route('/a', methods: ['GET', 'post'])]\n"
        "#[ Route(path: '/b') ]\n#[Route(X)]",
        [
            ("Symfony", "GET", "/a"),
            ("Symfony", "POST", "/a"),
            ("Symfony", "ANY", "/b"),
            ("Symfony", "PUT", "/old"),
        ],
    ),
    "slim/a.php": (
        "AppFactory::create();\n$app->get('/a'); $g->MAP('/b'); $app->head('/no')",
        [("Slim", "GET", "/a"), ("Slim", "ANY", "/b")],
    ),
    "rails/routes.rb": (
        "Rails.application.routes.draw do\n  get '/a'\n\n  PUT \"/b\", x\n  x get '/no'",
        [("Rails", "GET", "/a"), ("Rails", "PUT", "/b")],
    ),
    "sinatra/a.rb": (
        "require 'sinatra'\nget '/a' do\nend\npost '/no'\n",
        [("Sinatra", "GET", "/a")],
    ),
    "actix/a.rs": ("App::new()\n#[get(\"/a\")] #[Post('/b')]", [("Actix Web", "GET", "/a"), ("Actix Web", "POST", "/b")]),
    "axum/a.rs": (
        "axum::Router\n.route(\"/a\", get(f).post(g).get(h)); .route(\"/b\", any(f))",
        [("Axum", "GET", "/a"), ("Axum", "POST", "/a")],
    ),
    "rocket/a.rs": ("#[launch]\n#[options(\"/a\")]", [("Rocket", "OPTIONS", "/a")]),
    "warp/a.rs": (
        "warp::path!(\"a\").and(warp::get())" + " " * 300 + "warp::path('/far')",
        [("Warp", "GET", "/a"), ("Warp", "ANY", "/far")],
    ),
    "grpcrust/a.rs": (
        "s.add_service(GreeterServer::new(x))",
        [("grpc", "gRPC", "server", "Greeter")],
    ),
    "grpcrust/bare.rs": ("tonic::transport", [("grpc", "gRPC", "server", "grpc")]),
    "ktor/a.kt": ("routing { get(\"/a\") { } post(\"/no\", x) }", [("Ktor", "GET", "/a")]),
    "vapor/a.swift": (
        "import Vapor\napp.get(\"a\", \":id\") {}\napp.on(.put, \"b\") {}\napp.on(\"c\") {}\napp.post() {}",
        [
            ("Vapor", "GET", "/a/:id"),
            ("Vapor", "PUT", "/b"),
            ("Vapor", "ANY", "/c"),
            ("Vapor", "POST", "/"),
        ],
    ),
    "shelf/a.dart": ("Router()\nr.get('/a'); r.mount('/no')", [("Shelf", "GET", "/a")]),
    "dart_frog/routes/a/[id]/index.dart": (
        "import 'package:dart_frog/x'; HttpMethod.get HttpMethod.GET HttpMethod.put",
        [("Dart Frog", "GET", "/a/:id"), ("Dart Frog", "PUT", "/a/:id")],
    ),
    "routes/index.dart": ("onRequest(RequestContext context)", [("Dart Frog", "ANY", "/")]),
    "dart_frog/lib/a.dart": ("import 'package:dart_frog/x'", []),
    "play/a.scala": (
        "import play.api.mvc._\n@GET @Path(\"/a\") @POST def f\n@PUT def g\n@Path('/h') def h",
        [("Play Framework", "GET", "/a"), ("Play Framework", "POST", "/a")],
    ),
    "akka/a.sc": (
        "akka.http.scaladsl\npath(\"a\") { put { x } }" + " " * 300 + "pathPrefix(\"/b\")",
        [("Akka HTTP", "PUT", "/a"), ("Akka HTTP", "ANY", "/b")],
    ),
    "phoenix/a.ex": (
        "scope \"/\" do\n  get \"/a\", C, :x\n  post \"/no\"\n",
        [("Phoenix", "GET", "/a")],
    ),
    "other/a.jsx": ("express()\napp.get('/a')", []),
    "other/A.JS": ("express()\napp.get('/a')", [("Express", "GET", "/a")]),
    "node_modules/x/a.js": ("express()\napp.get('/a')", []),
}


@pytest.fixture(scope="module")
def discovered(source_files):
    rows = discover_interfaces(source_files(*[(p, c) for p, (c, _) in CASES.items()])).collect()
    found = {path: [] for path in CASES}
    for r in sorted(rows, key=lambda r: r.ord):
        if r.type == "http":
            assert r.role == "server" and r.event is None
            found[r.file].append((r.framework, r.method, r.path))
        else:
            assert r.method is None and r.path is None
            row = (r.protocol, r.framework, r.role, r.event)
            found[r.file].append(row if r.direction is None else (*row, r.direction))
    return found


@pytest.mark.parametrize("path", CASES)
def test_interfaces_of_file(discovered, path):
    assert discovered[path] == CASES[path][1]


def test_every_rule_has_a_case(spark, source_files):
    files = source_files(*[(p, c) for p, (c, _) in CASES.items()])
    empty = [
        d.name for d in DETECTORS if discover_interfaces(files, detectors=[d]).isEmpty()
    ]
    assert empty == []


def test_directions_are_kept_where_asked(source_files):
    text = "io.on('connection', s => {});\nsocket.on('e', f); io.emit('e')"
    files = source_files(("a.js", text))
    assert [r.direction for r in discover_interfaces(files).collect()] == ["incoming"]
    assert [r.direction for r in interfaces_full(files).collect()] == ["incoming", "outgoing"]


def test_projects_do_not_mix(source_files):
    text = "express()\napp.get('/a')"
    rows = discover_interfaces(source_files(("p", "a.js", text), ("q", "a.js", text))).collect()
    assert sorted(r.project for r in rows) == ["p", "q"]


def test_routes_without_evidence(source_files):
    text = "app.get('/a', f); app.get('/a', g); xapp.get('/no')"
    rows = detect_routes(source_files(("a.js", text), ("a.ts", text), ("a.JS", text))).collect()
    assert [(r.file, r.method, r.route, r.ord) for r in rows] == [
        ("a.js", "GET", "/a", 0),
        ("a.js", "GET", "/a", 1),
    ]
