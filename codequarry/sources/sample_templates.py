"""Text of the sample source files: (path, evidence, body).

``<<k>>`` stands for the number of the file and ``<<noise>>`` for a document.
Every fifth file of a template goes without its evidence lines.
"""

TEMPLATES = [
    (
        "api/src/routes/r<<k>>.js",
        "import express from 'express';\n",
        """import { saveOrder } from "../services/orderService.js";
import Order from '../models/Order.js';
/* <<noise>> */
const cache = require("./utils/cache");
app.get("/orders/<<k>>", async (req, res) => {
  const found = await Order.find({ id: <<k>> });
  res.json(found);
});
router.POST( `/orders/<<k>>/items`, createItem);
app.get("/orders/<<k>>", again);
myapp.get("/not/<<k>>", nothing);
async function createItem(req, res) {
  await Order.create(req.body); await Order.updateOne({});
  return fetch("https://pay.example/<<k>>");
}
const list = (req, res) => Order.findById(req.id);
""",
    ),
    (
        "api/src/sockets/s<<k>>.js",
        "const { Server } = require('socket.io');\nconst io = new Server(http);\n",
        """// <<noise>>
io.on("connection", (socket) => {
  console.log('hi');
});
socket.on("join", async (room) => {
  await Room.findOne({ id: room });
  io.to(room).emit("joined-<<k>>", room);
  socket.emit("ack", 1);
});
socket.on("message", function named(text) { return text; });
socket.on("message", (text) => {
  Message.create({ text, from: "}" }); // }
  io.emit("message", text);
  db.query("insert into t values (<<k>>)");
});
io.sockets.emit("news", <<k>>);
""",
    ),
    (
        "web/src/live/l<<k>>.ts",
        'import { io } from "socket.io-client";\n',
        """const socket = io("https://live.example");
/* <<noise>> */
socket.on("message", (m: string) => { show(m); });
socket.emit("message", "hello <<k>>");
socket.emit('typing', true);
mysocket.emit("other");
export const show = (m: string) => { document.title = m; };
""",
    ),
    (
        "api/src/nested/n<<k>>.ts",
        'import { Server } from "socket.io";\n',
        """const io = new Server(3000);
io.on("connection", socket => {
  /* <<noise>> */
});
socket.on("outer", (a) => {
  socket.on("inner", (b) => { Inner.deleteOne({ b }); });
  if (a) { for (;;) { try { io.emit("outer-done", `${a} }`); } catch (e) { /* } */ } } }
});
socket.on("after", onAfter);
const late = (x) => { After.find({ x }); wss.send("late", x); };
socket.on("unclosed", (z) => { never(
""",
    ),
    (
        "api/src/fast/f<<k>>.mjs",
        "import Fastify from 'fastify'\n",
        """const fastify = Fastify({ logger: true })
/* <<noise>> */
fastify.get('/health/<<k>>', async () => 'ok')
server.delete("/items/<<k>>", remove)
fastify.route({ method: 'GET', url: '/no' })
""",
    ),
    (
        "api/src/nest/c<<k>>.controller.ts",
        "import { Controller, Get, Post } from '@nestjs/common';\n",
        """import { CatsService } from './cats.service';
@Controller('cats/<<k>>')
export class CatsController {
  /* <<noise>> */
  @Get()
  all() { return this.service.find(); }
  @Get(':id/')
  one() {}
  @Post("new")
  add() {}
}
@Controller()
export class RootController {
  @Delete('/all')
  drop() {}
}
""",
    ),
    (
        "api/src/nest/loose<<k>>.ts",
        "import { Get } from '@nestjs/common';\n",
        """/* <<noise>> */
export function build() {
  return [@Get('loose/<<k>>'), @Put()];
}
""",
    ),
    (
        "api/src/ws/w<<k>>.js",
        "const wss = new WebSocketServer({ port: 8080 });\n",
        """/* <<noise>> */
wss.on('connection', function connection(ws) {
  ws.on('message', (data) => ws.send("pong", <<k>>));
  ws.on('ping', nothing);
});
""",
    ),
    (
        "web/src/ws/c<<k>>.tsx",
        'const ws = new WebSocket("wss://feed.example/<<k>>");\n',
        """/* <<noise>> */
ws.onmessage = (e) => update(e.data);
ws.onClose = () => {};
client.addEventListener("Open", ready);
""",
    ),
    (
        "api/src/ws/both<<k>>.cjs",
        "const a = new WebSocket('ws://peer');\n",
        "/* <<noise>> */\nconst b = new WebSocket.Server({ noServer: true });\n",
    ),
    (
        "api/src/gql/g<<k>>.js",
        "const { ApolloServer } = require('apollo-server');\n",
        """const typeDefs = `type Query { order: String }`;
/* <<noise>> */
app.use("/graphql/<<k>>", createHandler(new ApolloServer({ typeDefs })));
const options = { path: '/playground', endpoint: "/graphql/<<k>>" };
""",
    ),
    (
        "api/src/gql/y<<k>>.ts",
        "import { createYoga } from 'graphql-yoga';\n",
        "/* <<noise>> */\nexport const yoga = createYoga({ schema });\n",
    ),
    (
        "svc/app/v<<k>>.py",
        "from flask import Flask\n",
        '''"""<<noise>>"""
import requests
app = make(__name__)

@app.route("/users/<<k>>", methods=["GET", "POST"])
def users():
    return requests.get("https://users.example/<<k>>")

@app.route(rule="/tuple", methods=("PUT", "PATCH"))
async def pair():
    cursor.execute("select 1")

@router.get('/plain')
def plain(): pass

@app.route(PATH)
def skipped(): pass

@bp.route("/missed")
def missed(): pass
''',
    ),
    (
        "svc/fast/a<<k>>.py",
        "from fastapi import APIRouter, FastAPI\n",
        '''"""<<noise>>"""
api = APIRouter(prefix="/first")
api = APIRouter(tags=["x"], prefix="/v<<k>>")
items = APIRouter()
web = FastAPI()

@api.get("/")
async def root(): ...

@api.post("//items//")
async def add(): ...

@items.delete('item')
def drop(): ...

@web.put("/web")
def put(): ...

@unknown.get("/never")
def never(): ...
''',
    ),
    (
        "svc/dj/urls<<k>>.py",
        "from django.urls import path, re_path\n",
        '''# <<noise>>
patterns = [
    path("orders/<<k>>/", views.order),
    re_path("archive/", views.archive),
    path(r"raw/", views.raw),
    path('orders/<<k>>/', views.order),
]
''',
    ),
    (
        "svc/live/sio<<k>>.py",
        "from flask_socketio import SocketIO\n",
        '''"""<<noise>>"""
socketio = connect(app)

@socketio.on("chat-<<k>>")
def chat(m):
    socketio.emit("chat-<<k>>", m)
    socketio.emit('pong')
    socket.emit("side", m)
''',
    ),
    (
        "svc/live/consumer<<k>>.py",
        "from channels.generic.websocket import AsyncWebsocketConsumer\n",
        '"""<<noise>>"""\nclass Chat(Base):\n    async def connect(self): ...\n',
    ),
    (
        "svc/rpc/server<<k>>.py",
        "import grpc\n",
        '''"""<<noise>>"""
class Greeter<<k>>(pb2_grpc.GreeterServicer):
    def SayHello(self, request, context): ...

def serve():
    pb2_grpc.add_GreeterServicer_to_server(Greeter<<k>>(), server)
''',
    ),
    (
        "svc/rpc/bare<<k>>.py",
        "import grpc\n",
        "server = grpc.server(pool)\n# <<noise>>\n",
    ),
    (
        "core/src/main/java/C<<k>>.java",
        "import org.springframework.web.bind.annotation.*;\n",
        """/* <<noise>> */
@RestController
@RequestMapping("/api/<<k>>")
public class C<<k>> {
  @GetMapping
  public List<String> all() { return repo.findAll(); }
  @PostMapping(path = "/add")
  public void add(Order o) { return save(o); }
  @RequestMapping(value = {"/many"}, method = {RequestMethod.GET, RequestMethod.PUT})
  public String many() { return "x"; }
  @RequestMapping("/any")
  String any() { return new Foo(1); }
}
""",
    ),
    (
        "core/src/main/java/J<<k>>.java",
        "import jakarta.ws.rs.*;\n",
        """/* <<noise>> */
@Path("/jobs")
public class J<<k>> {
  @GET
  @Path("/{id}/")
  public Response one(@PathParam("id") String id) { return ok(); }
  @POST
  @Produces("application/json")
  public Response add() { return ok(); }
  @GET @HEAD @Path("a") @Path("b")
  protected Map<String, List<String>> last() { return null; }
}
""",
    ),
    (
        "core/src/main/java/X<<k>>.java",
        "import javax.ws.rs.GET;\n",
        """/* <<noise>> */
public class X<<k>> {
  @Path("x<<k>>") @DELETE
  public void drop() { }
}
""",
    ),
    (
        "core/src/main/java/W<<k>>.java",
        "import org.springframework.messaging.handler.annotation.*;\n",
        """/* <<noise>> */
public class W<<k>> {
  @MessageMapping("/chat/<<k>>")
  @SendTo("/topic/all")
  public String chat(String m) { return m; }
  @SubscribeMapping
  public String hello() { return "hi"; }
  @SendTo
  public void none() { }
}
""",
    ),
    (
        "core/src/main/java/G<<k>>.java",
        "import io.grpc.stub.StreamObserver;\n",
        """/* <<noise>> */
public class G<<k>> extends GreeterGrpc.GreeterImplBase {
  @Override
  public void sayHello(Req r, StreamObserver<Res> o) { }
}
""",
    ),
    (
        "core/src/main/java/H<<k>>.java",
        "import io.grpc.Server;\n",
        "/* <<noise>> */\npublic class H<<k>> { int n; }\n",
    ),
    (
        "net/Api/P<<k>>.cs",
        "var builder = WebApplication.CreateBuilder(args);\n",
        """/* <<noise>> */
app.MapGet("/orders/<<k>>/", () => Results.Ok());
app.MapPost(@"/orders", Create);
app.MapFallback("/no", x);
""",
    ),
    (
        "net/Api/Controllers/O<<k>>Controller.cs",
        "using Microsoft.AspNetCore.Mvc;\n",
        """/* <<noise>> */
[ApiController]
[Route("api/[controller]")]
public class O<<k>>Controller : ControllerBase {
  [HttpGet]
  public IActionResult All() => Ok();
  [HttpGet("{id}/")]
  public IActionResult One(int id) { return Ok(id); }
  [HttpDelete($"{id}/x<<k>>")]
  private static Task<int> Drop(int id) { return db.Execute(id); }
}
""",
    ),
    (
        "net/Api/Hubs/H<<k>>.cs",
        "using Microsoft.AspNetCore.SignalR;\n",
        """/* <<noise>> */
public class H<<k>> : Hub {
  public async Task Send(string m) { await Clients.All.SendAsync("receive-<<k>>", m); }
  public override Task OnConnectedAsync() { return base.OnConnectedAsync(); }
  public async Task OnDisconnectedAsync(Exception e) { }
}
connection.On<string>("receive", m => { });
connection.On("Send", m => { });
""",
    ),
    (
        "net/Rpc/G<<k>>.cs",
        "using Grpc.Core;\n",
        """/* <<noise>> */
public class Impl<<k>> : Greeter.GreeterBase {
  public override Task<Reply> SayHello(Request r, ServerCallContext c) { return null; }
}
""",
    ),
    (
        "net/Rpc/N<<k>>.cs",
        "using Grpc.AspNetCore;\n",
        "/* <<noise>> */\nclass N<<k>> { }\n",
    ),
    (
        "edge/cmd/h<<k>>.go",
        'package main\nimport "net/http"\n',
        """// <<noise>>
func main() {
	http.HandleFunc("/h/<<k>>", handler)
	mux.Handle("/static/", files)
	other.HandleFunc("/no", x)
}
func (s *Server) handler(w Writer, r *Request) { db.query("x") }
""",
    ),
    (
        "edge/cmd/gin<<k>>.go",
        'import "github.com/gin-gonic/gin"\n',
        """/* <<noise>> */
func routes() {
	r.GET("/gin/<<k>>", list)
	r.POST("/gin", add)
	r.Get("/no", x)
}
""",
    ),
    (
        "edge/cmd/echo<<k>>.go",
        "e := echo.New()\n",
        '/* <<noise>> */\nfunc routes() {\n\te.PUT("/echo/<<k>>", put)\n\te.HEAD(`/echo`, head)\n\te.Any("/no", x)\n}\n',
    ),
    (
        "edge/cmd/fiber<<k>>.go",
        "app := fiber.New()\n",
        '/* <<noise>> */\nfunc routes() {\n\tapp.Get("/fiber/<<k>>", get)\n\tapp.Delete("/fiber", del)\n\tapp.GET("/no", x)\n}\n',
    ),
    (
        "edge/cmd/chi<<k>>.go",
        'import "github.com/go-chi/chi/v5"\n',
        '/* <<noise>> */\nfunc routes() {\n\tr.Patch("/chi/<<k>>", patch)\n\tr.Options("/chi", opt)\n\tr.Mount("/no", x)\n}\n',
    ),
    (
        "edge/rpc/g<<k>>.go",
        'import "google.golang.org/grpc"\n',
        "// <<noise>>\nfunc serve() {\n\tpb.RegisterGreeterServer(s, &server{})\n\tpb.RegisterOrder<<k>>Server(s, &o{})\n}\n",
    ),
    (
        "edge/rpc/n<<k>>.go",
        "s := grpc.NewServer()\n",
        "/* <<noise>> */\nfunc nothing() {}\n",
    ),
    (
        "edge/ws/w<<k>>.go",
        'import "github.com/gorilla/websocket"\n',
        "/* <<noise>> */\nfunc read(c *Conn) {\n\tc.ReadMessage()\n}\n",
    ),
    (
        "edge/ws/u<<k>>.go",
        "var up = websocket.Upgrader{}\n",
        "/* <<noise>> */\nfunc up(c *Conn) {\n\treturn\n}\n",
    ),
    (
        "php/routes/web<<k>>.php",
        "<?php\nuse Illuminate\\Support\\Facades\\Route;\n",
        """/* <<noise>> */
Route::get('/l/<<k>>', 'C@m');
Route::match("/both", fn() => 1);
route::Any('/any', x);
Route::resource('no', x);
function helper($x) { return $db->query('x'); }
""",
    ),
    (
        "php/src/S<<k>>.php",
        "<?php\nuse Symfony\\Component\\Routing\\Annotation\\Route;\n",
        """/* <<noise>> */
#[Route('/s/<<k>>', name: 'x', methods: ['GET', 'post'])]
function one() {}
/** @Route("/old", methods={"PUT"}) */
function two() {}
#[ Route(path: "/bare") ]
function three() {}
#[Route(self::PATH)]
function four() {}
""",
    ),
    (
        "php/slim/a<<k>>.php",
        "<?php\n$app = AppFactory::create();\n",
        """/* <<noise>> */
$app->get('/slim/<<k>>', fn() => 1);
$group->map("/map", x);
$app->add('/no');
""",
    ),
    (
        "rb/config/routes<<k>>.rb",
        "Rails.application.routes.draw do\n",
        """  get '/rails/<<k>>', to: 'a#b'
  POST "/up"
  resources :orders
# <<noise>>
end
def index?
  Order.find (1)
end
""",
    ),
    (
        "rb/app<<k>>.rb",
        "require 'sinatra'\n",
        "# <<noise>>\nget '/sin/<<k>>' do\n  'x'\nend\nput \"/no\", x\n\n  delete '/gone'   do |x|\nend\n",
    ),
    (
        "rs/actix/a<<k>>.rs",
        "use actix_web::{get, App};\n",
        '/* <<noise>> */\n#[get("/actix/<<k>>")]\npub async fn one() {}\n#[post( \'/p\' )]\nfn two() {}\n#[route("/no")]\nfn three() {}\n',
    ),
    (
        "rs/axum/x<<k>>.rs",
        "use axum::routing::{get, post};\n",
        """/* <<noise>> */
pub fn routes() -> R {
    r.route("/axum/<<k>>", get(list).post(add).get(again))
        .route("/axum", delete(drop));
    r.route("/none", handler)
}
""",
    ),
    (
        "rs/rocket/r<<k>>.rs",
        "#[launch]\n",
        '/* <<noise>> */\n#[patch("/rocket/<<k>>")]\nfn patch() {}\n#[head("/r")]\npub fn head() {}\n',
    ),
    (
        "rs/warp/w<<k>>.rs",
        "use warp::Filter;\n",
        """/* <<noise>> */
pub fn a() { warp::path!("warp/<<k>>").and(warp::get()).or(warp::post()) }
/* 1234567890123456789012345678901234567890123456789012345678901234567890123456789012345678901234567890
1234567890123456789012345678901234567890123456789012345678901234567890123456789012345678901234567890
1234567890123456789012345678901234567890123456789012345678901234567890123456789012345678901234567890
1234567890123456789012345678901234567890123456789012345678901234567890123456789012345678901234567890 */
fn b() { warp::path("/far") }
""",
    ),
    (
        "rs/rpc/t<<k>>.rs",
        "use tonic::transport::Server;\n",
        "/* <<noise>> */\nfn serve() { s.add_service(GreeterServer::new(g)).add_service(Order<<k>>Server::new(o)); }\n",
    ),
    (
        "rs/rpc/b<<k>>.rs",
        "tonic_build::compile_protos();\n",
        "/* <<noise>> */\nfn main() {}\n",
    ),
    (
        "kt/src/K<<k>>.kt",
        "import io.ktor.server.routing.*\n",
        """/* <<noise>> */
fun Application.module() {
  get("/ktor/<<k>>") { call.respond("x") }
  post('/p') { }
  get("/no", x)
}
fun plain(x: Int) = x
""",
    ),
    (
        "kt/src/S<<k>>.kts",
        "import org.springframework.web.bind.annotation.*\n",
        """/* <<noise>> */
@RequestMapping("/kt")
interface S<<k>> {
  @DeleteMapping("/d/<<k>>")
  fun drop()
  @PutMapping(value = "/u")
  fun put()
}
""",
    ),
    (
        "ios/Sources/App/r<<k>>.swift",
        "import Vapor\n",
        """/* <<noise>> */
func routes(_ app: Application) throws {
  app.get("v", ":id", "<<k>>") { req in req }
  app.on(.PATCH, "big") { req in req }
  app.on("plain") { req in req }
  app.post { req in req }
  app.delete() { req in req }
}
""",
    ),
    (
        "dart/bin/s<<k>>.dart",
        "import 'package:shelf/shelf.dart';\n",
        """/* <<noise>> */
Future<void> main() async {
  router.get('/shelf/<<k>>', handler);
  router.put("/p", handler);
  router.mount('/no', x);
}
int twice(int x) { return x * 2; }
""",
    ),
    (
        "dart/routes/items/[id]/f<<k>>.dart",
        "import 'package:dart_frog/dart_frog.dart';\n",
        """/* <<noise>> */
Response handle(RequestContext context) {
  if (m == HttpMethod.get) return a;
  if (m == HttpMethod.post || m == HttpMethod.get) return b;
  return c;
}
""",
    ),
    (
        "dart/routes/v<<k>>/index.dart",
        "Response onRequest(RequestContext context) { return r; }\n",
        "/* <<noise>> */\nint n = 1;\n",
    ),
    (
        "sc/app/P<<k>>.scala",
        "import play.api.mvc._\n",
        """/* <<noise>> */
class P {
  @GET @Path("/play/<<k>>")
  def list(x: Int) = x
  @POST
  def nopath = 1
  @Path("/noverb") def noverb() = 2
  @PUT
  @HEAD
  @Path("/two")
  def two() = 3
}
""",
    ),
    (
        "sc/app/A<<k>>.sc",
        "import akka.http.scaladsl.server._\n",
        """/* <<noise>> */
val r = path("akka<<k>>") { get { complete(1) } ~ post { complete(2) } }
/* 1234567890123456789012345678901234567890123456789012345678901234567890123456789012345678901234567890
1234567890123456789012345678901234567890123456789012345678901234567890123456789012345678901234567890
1234567890123456789012345678901234567890123456789012345678901234567890123456789012345678901234567890 */
def s(x: Int) = pathPrefix("/api") { reject }
""",
    ),
    (
        "ex/lib/router<<k>>.ex",
        "use Phoenix.Router\n",
        """  get "/ph/<<k>>", C, :index
  Delete '/d', C, :drop
  post "/no"
  # <<noise>>
  def show(conn), do: conn
  defp hidden do
  end
""",
    ),
    (
        "web/src/views/V<<k>>.jsx",
        "import express from 'express';\n",
        """import helper from "../helpers/format";
import "./style.css";
/* <<noise>> */
app.get("/never", x);
export const View = async name => axios.post("/api/<<k>>", name);
function Inner() { return http.get('http://local/<<k>>'); }
""",
    ),
    (
        "api/src/services/order<<k>>.ts",
        "import { UserRepo } from '../repositories/user';\n",
        """import User from "../models/user.ts";
import { check } from '../middleware/auth';
import { C } from '../controllers/c';
import * as e from "./entity/Order";
/* <<noise>> */
export class OrderService {
  run() {
    return pool.query('select') + connection.run("x") + database.Prepare('y') + User.findOne();
  }
}
export const go = async (a, b) => axios.GET('https://a.example/<<k>>') || request.get("no");
let one = x => https.request("https://b.example");
""",
    ),
    (
        "api/src/models/m<<k>>.js",
        "const express = require('express');\n",
        """const User = require("./models/User.js");
const userSchema = require('./schema/order');
/* <<noise>> */
app.get("/users/<<k>>", () => User.find());
router.delete('/users', () => order.deleteMany({}));
""",
    ),
    ("web/src/i<<k>>/index.js", "", ""),
    (
        "apps/client/p<<k>>/package.json",
        "",
        '{"name": "web-<<k>>", "scripts": {"start": "vite"}, "dependencies": {"react": "18", "react-dom": "18", "pg": "8", "lib-<<k>>": "1"}, "devDependencies": {"vite": "5", "jest": "29"}}',
    ),
    (
        "apps/server/p<<k>>/package.json",
        "",
        '{"name": "api-<<k>>", "dependencies": {"express": "4", "mongoose": "8", "socket.io": "4"}, "devDependencies": {"Jest": "29", "mongoose": "8"}, "peerDependencies": {"ws": "8"}}\n',
    ),
    (
        "client/p<<k>>/package.json",
        "",
        '{"name": "plain-<<k>>", "dependencies": {}}',
    ),
    (
        "apps/full<<k>>/package.json",
        "",
        '{"name": "full", "scripts": {"start": "node ."}, "dependencies": {"next": "14", "@nestjs/core": "10", "openai": "4", "@prisma/client": "5"}}',
    ),
    (
        "apps/mix<<k>>/package.json",
        "",
        '{"scripts": {"test": "x", "start": ""}, "dependencies": {"vue": "3", "koa": "2", "ioredis": "5"}, "devDependencies": {"@playwright/test": "1", "spring-boot": "3"}}',
    ),
    ("apps/bad<<k>>/package.json", "", '{"name": "bad", "dependencies": {"react": "18"'),
    ("apps/null<<k>>/package.json", "", "null"),
    (
        "apps/only<<k>>/package.json",
        "",
        '{"name": "only", "dependencies": {"svelte": "4", "sqlite3": "5", "spring-web": "x"}, "extra": [1, {"a": null}]}',
    ),
    ("apps/list<<k>>/package.json", "", "[1, 2]"),
    ("apps/tail<<k>>/package.json", "", '{"name": "tail", "dependencies": {"react": "18"}} x'),
    (
        "node_modules/x/i<<k>>.js",
        "import express from 'express';\n",
        'app.get("/ignored/<<k>>", x); /* <<noise>> */\n',
    ),
    ("docs/dist/d<<k>>.js", "const express = require('express');\n", 'app.get("/dist", x);\n'),
    ("docs/d<<k>>.md", "", "# Notes <<k>>\n\n<<noise>>\n"),
    ("docs/distribution/<<k>>/Read.Me.TXT", "", "<<noise>>"),
    ("svc/r<<k>>/requirements.txt", "", "flask\nrequests\n"),
    ("svc/a<<k>>/main.py", "", "def main():\n    connection.execute('x')\n"),
    ("edge/m<<k>>/go.mod", "", "module m<<k>>\n"),
    ("java/a<<k>>/pom.xml", "", "<project/>\n"),
    ("kt/a<<k>>/build.gradle.kts", "", "plugins { }\n"),
    ("web/l<<k>>/yarn.lock", "", "# yarn\n"),
    ("a<<k>>.", "", "dot"),
    ("g<<k>>/.gitignore", "", "node_modules\n"),
    ("x/.env<<k>>", "", "A=1\n"),
    ("archive/x<<k>>.tar.gz", "", "<<noise>>"),
    ("web/src/BIG<<k>>.JS", "var app = Express();\n", 'app.get("/upper/<<k>>", x);\n'),
    ("py/__init__<<k>>.py", "", "# <<noise>>\n"),
]
