"""A workspace with several spellings of what rules and extractors look for, from ``part``.

Each part gives one of the files below in a folder of its own; the statement runs on
Spark and on DuckDB, and SQL of the queries reads the files' text, not this list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scan import with_parts
from .bindings import view

#: (name below the part's folder, lines)
FILES = (
    # imports and re-exports of scripts
    ("a.ts", ["import './side'", 'import "side2";', "import { a, b as c, type D } from './named'", "import type { E } from './types'", "import type F from './deftype'", "import G from './def';"]),
    ("b.js", ["import H, { i, j as k } from './both'", "import L, * as M from './defspace'", "import * as N from './space'", "import{o}from'./tight'", "export { p, q as r } from './again'", "export * from './all'", "export * as s from './named-all'"]),
    ("c.jsx", ["const t = require('./one')", "const { u, v } = require('./two');", "var w = require ( './three' )", "let x=require('./four')", "  const y = await import('./five')", "import ( './six' ).then(z)"]),
    ("d.mjs", ["import {", "  multi", "} from './lines'", "// import A from './comment'", "import B from './end' // tail", "require('./bare')", "const q = other.require('./no')", "export const e = 1"]),
    ("e.tsx", ["import React, { useState } from 'react'", "import Default from", "import x from './a', y", "export {f} from \"./quoted\"", "exports.a = require('./prop')", "const {a, b: c} = require('./alias')"]),
    # integrations
    ("f.py", ["pool = CREATEPOOL(1)", "from sqlalchemy import create_engine", "import psycopg2", "requests.patch(u)", "async with aiohttp.ClientSession() as s: pass"]),
    ("g.ts", ["fetch ('/a')", "axios.request(x)", "new HTTPClient()", "redis.createclient()", "new  WebSocket (url)", "import S from '@aws-sdk/x'"]),
    ("h.ts", ['fetch("/b")', "axios.del(x)", "fetch(url)", "const s = IO ('x')", "gql`query`", "import {g} from '@grpc/grpc-js'", "new queue('x')", "new Queue('x')"]),
    ("i.py", ["import celery", "amqp.connect()", "from kafka import KAFKAconsumer", "bull.add(1)", "import firebase_admin", "from google.cloud import storage", "import boto3"]),
    ("j.py", ["Celerys = 1", "x.httpx.get()", "rabbitmq = 1", "Mongoose.Connect()", "prisma.$connect()", "ioredis", "graphql (q)", "graphql(q)", "socket.IO", "import '@azure/x'"]),
    ("k.ts", ["const a = 1", "prefetch( 'x')", "refetch('x')", "studio('x')", "newWebSocket(x)", "grpc_x = 1", "mysql.Created()"]),
    # shared state
    ("l.ts", ["let a = new Map()", "export const S = createContext (null)", "Foo.getInstance ( )", "container.resolve(X)", "export const useStore = create((set) => ({}))"]),
    ("m.js", ["  let a = {}", "let b = foo({})", "var c = [", "@Singleton", "INJECTOR.GET(X)", "createContext", "const store = configureStore({})"]),
    ("n.py", ["_CACHE = {}", "Cache = {}", "ITEMS: list = []", "x = servicelocator.get()", "@singleton", "getInstance(1)"]),
    ("o.py", ["  CACHE = dict()", "ALL = set()", "Container.get(x)", "import zustand"]),
    ("p.tsx", ["var d: {a: 1}", "let e : Map = new Map()", "let f = new Array(3)", "const g = new Map()", "createSlice({})", "create ( (set)"]),
    # entry points of Python
    ("main.py", ["from fastapi import APIRouter", "router = APIRouter()", "@router.get('/a')", "@ROUTER.post ('/b')", "@other.get('/c')"]),
    ("web.py", ["from flask import Flask", "@app.route('/')", "@bp.post('/x')"]),
    ("urls.py", ["urlpatterns = [path('a', v), re_path('b', v), url ('c', v)]"]),
    ("other.py", ["urlpatterns = [path('a', v)]"]),
    ("views.py", ["class V:", "    def post(self, r): pass"]),
    ("wsgi.py", ["application = get()"]),
    ("asgi.py", ["app = get()"]),
    ("__main__.py", ["print(1)"]),
    ("cmd.py", ["import typer", "@app.command()", "def go(): pass"]),
    ("run.py", ["if __name__ == '__main__':", "    uvicorn.run(app)"]),
    ("script.py", ["if __name__ == \"__main__\":", "    go()"]),
    ("server.py", ["x = 1"]),
    ("__init__.py", ["from .a import b", "from .c import d", "from .e import f", "", "x = 1"]),
    ("src/config/app.py", ["app = FastAPI()", "@app.get('/')"]),
    # entry points of scripts
    ("index.ts", ["export * from './a'", "export { b } from './b'", "", "const c = 1"]),
    ("pages/api/x.ts", ["export default function handler() {}"]),
    ("middleware.ts", ["import { NextResponse } from 'next/server'"]),
    ("web.ts", ["const app = express()", "app.get('/a', f)", "app.use (\"/b\", g)"]),
    ("routes.js", ["r.get('/a')", "r.post('/b')", "r.use('/c')", "r.all('/d')"]),
    ("koa.js", ["const app = new Koa()"]),
    ("cats.controller.ts", ["@Controller('cats')", "class C { @Get() a() {} @Post ('x') b() {} }"]),
    ("hono.ts", ["const app = new Hono()", "app.get(path, f)"]),
    ("tool.js", ["if (require.main === module) run()"]),
    ("src/bin/x.js", ["#!/usr/bin/env node"]),
    ("src/cli/y.ts", ["const a = 1"]),
    ("app.ts", ["http.createServer(f).listen(3)"]),
    ("main.ts", ["boot()"]),
    ("vite.config.ts", ["export default defineConfig({})"]),
    ("jest.setup.js", ["const a = 1"]),
    # entry points of C# and Java
    ("Program.cs", ["var b = WebApplication.CreateBuilder(args);", "app.MapGet (\"/\", f); app.MapPost(\"/a\", g);"]),
    ("src/Program.cs", ["class P { static void Main() {} }"]),
    ("UserController.cs", ["[ApiController]", "[HttpGet]", "[HttpPost(\"x\")]", "[Route]"]),
    ("Startup.cs", ["void ConfigureServices() {}"]),
    ("App.java", ["@SpringBootApplication", "class App { public static void main(String[] a) {} }"]),
    ("Users.java", ["@RestController", "@GetMapping(\"/a\")", "@RequestMapping"]),
    ("Res.java", ["@Path(\"/a\")", "@GET", "@DELETE"]),
    ("Tool.java", ["public static void main(String[] a) {}"]),
    # names of files and functions, classes of files
    ("get-user.ts", ["const getX = async (a) => a", "function setY(a) {}", "const has = (a) => a", "function isOk (x) {}"]),
    ("user_model.py", ["def get_user(a): pass", "def getter(a): pass", "def validate_it (a): pass"]),
    ("UserList.tsx", ["export const handleClick = (e) => e", "const updateIt = async(x) => x"]),
    ("userList.java", ["public static int getAll(int n) {}", "private void createOne() {}", "protected List<X> deleteAll() {}"]),
    ("Names.cs", ["internal async Task processAll(int n) {}", "public int hasAny() {}"]),
    ("src/migrations/m1.py", ["def is_up(): pass"]),
    ("migrations/m2.py", ["x = 1"]),
    ("src/hooks/useX.ts", ["export const useX = 1"]),
    ("sdk.gen.ts", ["export const a = 1"]),
    ("tests/test_a.py", ["def test_get(): pass"]),
    ("src/a.spec.ts", ["it('x')"]),
    ("node_modules/x/index.js", ["module.exports = 1"]),
    ("models/user.py", ["import redis", "redis.publish(1)"]),
    ("docs/x.py", ["x = 1"]),
)


def _sql() -> str:
    text = lambda s: "concat(" + ", chr(10), ".join("'" + x.replace("'", "''") + "'" for x in s) + ")"
    names = " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(FILES))
    bodies = " ".join(f"WHEN {i} THEN {text(body)}" for i, (_, body) in enumerate(FILES))
    return f"SELECT concat('/w/d', p_partkey, '/', CASE p_partkey % {len(FILES)} {names} END) AS path, CASE p_partkey % {len(FILES)} {bodies} END AS content FROM part"


SPELLINGS = _sql()
#: Links from each file to one of forty, which have many importers then.
EDGES = f"""SELECT a.path AS source, b.path AS target, 'import' AS type, CAST(0.75 AS DOUBLE) AS strength
  FROM (SELECT path, CAST(regexp_extract(path, 'd([0-9]+)/', 1) AS INT) AS k FROM ({SPELLINGS}) x) a
  JOIN (SELECT path, CAST(regexp_extract(path, 'd([0-9]+)/', 1) AS INT) AS k FROM ({SPELLINGS}) x) b ON b.k = a.k % 40 + 1 WHERE a.k <> b.k"""


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parts(view(spark, sf_dir, SPELLINGS, "part"), "/w")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EDGES, "part")
