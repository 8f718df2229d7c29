"""Fact extraction from small sources of each language."""

import pytest
from pyspark.sql import functions as F

from quarrylens.operators.extract import extract, extract_text, fact_tables
from quarrylens.operators.search import SearchPattern, StructuralSearch, search_single
from quarrylens.sources.code import Code

TS = r'''import { A, B as C } from './svc';
import * as fs from "fs";
import D from 'lib';
/** Users. */
export class UserService extends Base implements IThing<Foo> {
  private name: string;
  constructor(private x: number) { super(); }
  async getUser(id: string): Promise<User> { return this.repo.find(id).then(u => u.toJson()); }
}
export interface Shape extends Other { id: number; label?: string }
export function main(app) {
  // app.get('/no')
  app.get('/users/:id', requireAuth, getUser);
  router.post("/x", (req, res) => { logger.info("email " + req.body.email); fetch('http://a/b'); });
  console.log('hi'); const k = process.env.API_KEY; process.env[foo];
}
'''
PY = r'''import os, sys as s
from .models import User, models
from fastapi import FastAPI
app = FastAPI()
class Item(Base, mod.Mixin):
    """Doc of item."""
    name: str
    size: int = 3
    def __init__(self, a):
        self.a = a
        self._b: int = 2
@app.get("/items/{item_id}")
@require_login
async def read_item(item_id: int):
    logger.warning("password %s", os.getenv("SECRET_KEY"))
    requests.get("http://x")
    return helper.load(item_id)
urlpatterns = [path("users/<int:id>/", views.user_list), path("a.py", x)]
def test_it(): pass
'''
GO = r'''package main
type User struct {
	Base
	Name string `json:"name"`
	age int
}
func (u *User) Save(x int) error { return u.db.Exec("q") }
func main() {
	r := gin.Default()
	r.GET("/u/:id", authMiddleware(), handlers.GetUser)
	http.HandleFunc("/x", handleX)
	log.Printf("email %s", e)
	http.Get("http://x")
	_ = os.Getenv("PORT")
}
'''
JAVA = r'''@RestController
public class UserController extends Base implements A, B<C> {
  private final UserService service;
  @Value("${app.key}") String k;
  /** Lists. */
  @GetMapping("/users/{id}")
  @PreAuthorize("hasRole('X')")
  public List<User> list(@PathVariable Long id) { log.info("ssn " + id); return restTemplate.getForObject("u", X.class); }
  @RequestMapping(value = "/p", method = RequestMethod.POST)
  ResponseEntity<?> p() { return System.getenv("A"); }
}
interface Repo extends Crud<User> { User find(String a); }
'''
CS = r'''[ApiController]
[Route("api/[controller]")]
[Authorize]
public class OrdersController : ControllerBase, IThing {
  public int Id { get; set; }
  [HttpGet("{id}")]
  [AllowAnonymous]
  public async Task<Order> Get(int id) { _logger.LogInformation("a"); return await _httpClient.GetAsync("x"); }
  [HttpPost]
  public IActionResult Post(Order o) => Ok();
}
app.MapGet("/min/{id}", Handler).RequireAuthorization();
'''
RB = r'''class UsersController < ApplicationController
  # Shows it
  def show
    Rails.logger.info("email")
    logger.info("x #{email}")
    ENV["A"]; ENV.fetch("B")
    HTTParty.get("http://x")
  end
end
get '/users/:id', to: 'users#show'
resources :posts
before_action :authenticate_user
'''
PHP = r'''<?php
class U extends M { public function show($id) { Log::info("password"); return Http::get("x"); } }
Route::get('/users/{id}', [UserController::class, 'show'])->middleware('auth');
Route::apiResource('photos', P::class);
$x = env('A'); $_ENV["B"];
'''
RS = r'''/// Doc
pub struct P { pub a: i32, b: String }
impl Display for P { fn fmt(&self) -> R { log::info!("x"); helper(self.a) } }
#[test]
fn t() { std::env::var("A"); env!("B"); logger.info("token"); }
'''


def routes(r):
    return [(x["method"], x["path"], (x["auth"] or {}).get("name"), x["handler_name"]) for x in r["interfaces"]]


def symbols(r):
    return [(x["name"], x["kind"], x["visibility"], x["parent"], x["is_test"]) for x in r["symbols"]]


def calls(r):
    return [(x["source_symbol"], x["target_symbol"]) for x in r["references"] if x["reference_kind"] == "call"]


def supers(r):
    return [(x["source_symbol"], x["reference_kind"], x["target_symbol"]) for x in r["references"] if x["reference_kind"] != "call"]


def fields(r):
    return {m["name"]: [(f["name"], f["field_type"], f["visibility"]) for f in m["fields"]] for m in r["data_models"]}


def test_typescript():
    r = extract_text("a.ts", TS, "typescript")
    assert routes(r) == [("GET", "/users/:id", "requireAuth", "getUser"), ("POST", "/x", None, None)]
    assert [x["target"] for x in r["dependencies"]] == ["fetch('http://a/b')"]
    assert [(x["contains_pii"], x["line"]) for x in r["sinks"]] == [(True, 14), (False, 15)]
    assert symbols(r) == [("UserService", "class", "public", None, False), ("constructor", "method", "public", "UserService", False), ("getUser", "method", "public", "UserService", False), ("Shape", "interface", "public", None, False), ("main", "function", "public", None, False)]
    assert [(x["source"], x["specifiers"]) for x in r["imports"]] == [("./svc", ["A", "B"]), ("fs", ["fs"]), ("lib", ["D"])]
    assert ("u", "u.toJson") in calls(r) and ("", "logger.info") in calls(r) and ("main", "console.log") in calls(r)
    assert supers(r) == [("UserService", "extends", "Base"), ("UserService", "implements", "IThing"), ("UserService", "implements", "Foo"), ("Shape", "extends", "Other")]
    assert fields(r) == {"UserService": [("name", "string", "private")], "Shape": [("id", "number", None), ("label", "string", None)]}
    assert [x["var_name"] for x in r["env_dependencies"]] == ["API_KEY", "<dynamic>"]


def test_nest_controllers():
    text = """@Controller('api/articles')
@UseGuards(AuthGuard)
export class A {
  @Get(':slug')
  one() { return 1; }
  @Post()
  @UseGuards(AdminGuard)
  make() {}
}
"""
    assert routes(extract_text("a.ts", text, "typescript")) == [("GET", "/api/articles/:slug", "AuthGuard", "one"), ("POST", "/api/articles", "AdminGuard", "make")]


def test_python():
    r = extract_text("a.py", PY, "python")
    assert routes(r) == [("GET", "/items/{item_id}", "require_login", "read_item"), ("ALL", "/users/<int:id>/", None, "user_list")]
    assert [x["contains_pii"] for x in r["sinks"]] == [True]
    assert symbols(r) == [("Item", "class", "public", None, False), ("__init__", "function", "private", "Item", False), ("read_item", "function", "public", None, False), ("test_it", "function", "public", None, True)]
    assert r["symbols"][0]["doc"] == "Doc of item." and r["symbols"][2]["signature"] == "async def read_item(item_id"
    assert [(x["source"], x["specifiers"]) for x in r["imports"]] == [("os", ["os"]), ("sys", ["sys"]), (".models", ["User"]), ("fastapi", ["FastAPI"])]
    assert supers(r) == [("Item", "extends", "Base"), ("Item", "extends", "Mixin")]
    assert fields(r)["Item"] == [("name", "str", "public"), ("size", "int", "public"), ("a", None, "public"), ("_b", "int", "private")]
    assert [x["var_name"] for x in r["env_dependencies"]] == ["SECRET_KEY"] and len(r["dependencies"]) == 1


def test_go():
    r = extract_text("a.go", GO, "go")
    assert routes(r) == [("GET", "/u/:id", "authMiddleware()", "GetUser"), ("ALL", "/x", None, "handleX")]
    assert symbols(r) == [("User", "struct", "public", None, False), ("Save", "method", "public", "User", False), ("main", "function", "private", None, False)]
    assert supers(r) == [("User", "extends", "Base")] and fields(r)["User"] == [("Name", "string", "public"), ("age", "int", "private")]
    assert [x["target"] for x in r["dependencies"]] == ['http.Get("http://x")'] and [x["var_name"] for x in r["env_dependencies"]] == ["PORT"]


def test_java():
    r = extract_text("A.java", JAVA, "java")
    assert routes(r) == [("GET", "/users/{id}", "PreAuthorize", "list"), ("POST", "/p", None, "p")]
    assert supers(r)[:4] == [("UserController", "extends", "Base"), ("UserController", "implements", "A"), ("UserController", "implements", "B"), ("UserController", "implements", "C")]
    assert {x["var_name"] for x in r["env_dependencies"]} == {"A", "app.key"} and [x["contains_pii"] for x in r["sinks"]] == [True]
    assert len(r["dependencies"]) == 1 and fields(r)["UserController"] == [("service", "UserService", "private"), ("k", "String", None)]


def test_csharp():
    r = extract_text("a.cs", CS, "csharp")
    assert routes(r) == [("GET", "/api/orders/{id}", None, "Get"), ("POST", "/api/orders", "Authorize", "Post"), ("GET", "/min/{id}", "RequireAuthorization", "Handler")]
    assert supers(r) == [("OrdersController", "extends", "ControllerBase"), ("OrdersController", "implements", "IThing")]
    assert fields(r)["OrdersController"] == [("Id", "int", "public")] and len(r["dependencies"]) == 1


def test_ruby_php_rust():
    r = extract_text("a.rb", RB, "ruby")
    assert routes(r) == [("GET", "/users/:id", "authenticate_user", "users#show"), ("ALL", "/posts", "authenticate_user", None)]
    assert [x["contains_pii"] for x in r["sinks"]] == [True, True] and {x["var_name"] for x in r["env_dependencies"]} == {"A", "B"}
    r = extract_text("a.php", PHP, "php")
    assert [(x["method"], x["path"]) for x in r["interfaces"]] == [("GET", "/users/{id}"), ("GET", "/photos"), ("POST", "/photos"), ("GET", "/photos/{photo}"), ("PUT", "/photos/{photo}"), ("DELETE", "/photos/{photo}")]
    assert symbols(r) == [("U", "class", None, None, False), ("show", "method", "public", "U", False)]
    r = extract_text("a.rs", RS, "rust")
    assert symbols(r) == [("P", "struct", "public", None, False), ("fmt", "function", "private", "P", False), ("t", "function", "private", None, True)]
    assert supers(r) == [("P", "implements", "Display")] and fields(r)["P"] == [("a", "i32", "public"), ("b", "String", "private")]


@pytest.mark.parametrize("language", ["kotlin", "scala", "swift", "c", "cpp", "jsx", "tsx", "javascript"])
def test_other_languages_give_sinks(language):
    text = "class A {\n  fun f() {\n    logger.info(\"email\");\n  }\n}\n" if language != "c" else 'int f(int x) {\n  Logger::error("token");\n  return g(x);\n}\n'
    r = extract_text("x", text, language)
    assert len(r["sinks"]) == 1 and r["sinks"][0]["contains_pii"]


@pytest.mark.parametrize("text", ["", "((((", "'unterminated", "/* open", "def f(:\n", "}}}}{{{", "\x00\ufffd😀 f(é)", "class", "@", "`" * 9])
def test_broken_text_never_fails(text):
    for language in ("typescript", "python", "java", "csharp", "go", "php", "ruby", "rust", "kotlin", "scala", "swift", "c", "cpp"):
        extract_text("x", text, language)


def test_masking_keeps_offsets_and_bytes():
    code = Code("x = 'é(' // f(\nf(1)", "typescript")
    assert len(code.masked) == len(code.text) and [c.callee for c in code.calls] == ["f"]
    a = code.anchor(code.calls[0].start, code.calls[0].end, "")
    assert (a["line"], a["start_byte"], a["end_byte"]) == (2, 16, 20)


def test_extract_on_spark(spark):
    files = spark.createDataFrame([("a.ts", TS), ("b.py", PY), ("c.txt", "x"), ("d.go", None), ("e.go", GO)], "path string, content string")
    facts = fact_tables(extract(files))
    assert facts["interfaces"].count() == 6 and facts["symbols"].where(F.col("file") == "e.go").count() == 3
    assert {r.file for r in facts["imports"].collect()} == {"a.ts", "b.py"}


def test_structural_search(spark):
    text = "console.log(a, b); console.log( f(x, y) ); foo(bar(1), 2); a.b = c; if (x == x) {}"
    one = lambda p: [(m["text"], dict(m["captured_vars"])) for m in search_single(text, "javascript", p)]
    assert one("console.log($X)") == [("console.log( f(x, y) )", {"X": "f(x, y)"})]
    assert [t for t, _ in one("console.log($$$ARGS)")] == ["console.log(a, b)", "console.log( f(x, y) )"]
    assert one("foo($A, $B)") == [("foo(bar(1), 2)", {"A": "bar(1)", "B": "2"})]
    assert one("$A == $A") and not one("console.error($X)")
    files = spark.createDataFrame([("a.js", text), ("b.py", text)], "path string, content string")
    found = StructuralSearch([SearchPattern("p", "javascript", "foo($A, $$$R)"), SearchPattern("q", "python", "foo($$$R)")]).search(files).collect()
    assert {(r.pattern_id, r.path) for r in found} == {("p", "a.js"), ("q", "b.py")}
