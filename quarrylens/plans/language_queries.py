"""Extraction queries, one for each language family, over source text that is generated from supplier.

A sample is a text in which KEY stands for the supplier's key and MARK for a word that depends on whether the key is
even, and the facts that must be found in it, by hand, as (fact, detail, first line, last line), in which AUTH stands for
the protection that the word means.  A declaration begins with its modifiers and, in Java, Kotlin and C#, its annotations;
its signature ends at the first brace, even one in an annotation.  SQL joins these facts with supplier, so every column of every row is compared."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quarrylens.operators import extract as X
from quarrylens.plans import views as V
from quarrylens.plans.registry import query
from quarrylens.sources.files import describe

KEY, MARK, AUTH = "§", "¤", "¶"


@dataclass(frozen=True)
class Sample:
    ending: str
    text: str
    marks: tuple[str, str]  # MARK for even and odd keys
    auth: tuple[str, str]  # and AUTH
    facts: tuple[tuple[str, str, int, int], ...]


def _detail(name: str) -> Column:
    dash = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("-"))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    some = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).otherwise("-")
    return {
        "interfaces": lambda: F.concat_ws(" ", "method", "path", dash(F.concat_ws(":", "auth.kind", "auth.name")), dash("handler_name"), names("parameters")),
        "dependencies": lambda: F.col("target"),
        "sinks": lambda: F.concat(F.when(F.col("contains_pii"), "pii ").otherwise(""), "text"),
        "symbols": lambda: F.concat_ws(" | ", "kind", "name", dash("parent"), dash("visibility"), dash("doc"), "signature"),
        "imports": lambda: F.concat_ws(" ", "source", F.array_join("specifiers", ",")),
        "references": lambda: F.concat(F.col("source_symbol"), F.lit(">"), "target_symbol", F.lit(" "), "reference_kind"),
        "data_models": lambda: F.concat_ws(" ", "model_kind", "name", dash("parent_type"), some("implemented_interfaces"), F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["field_type"], dash(f["visibility"]))), ",")),
        "env_dependencies": lambda: F.col("var_name"),
    }[name]()


def _facts(spark, sf_dir, sample: Sample) -> DataFrame:
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), (F.col("s_suppkey") % 2 == 0).alias("even"))
    text = F.replace(F.replace(F.lit(sample.text), F.lit(KEY), F.col("k")), F.lit(MARK), F.when(F.col("even"), sample.marks[0]).otherwise(sample.marks[1]))
    files = describe(s.select(F.concat(F.lit("src/f"), "k", F.lit(sample.ending)).alias("path"), text.alias("content")))
    extracted = X.extract(files).where(F.col("error").isNull())
    parts = []
    for name in ("interfaces", "dependencies", "sinks", "symbols", "imports", "references", "data_models", "env_dependencies"):
        rows = extracted.select(F.col("path").alias("file"), F.explode(name).alias("f")).select("file", "f.*")
        if name == "interfaces":
            rows = rows.withColumn("auth", F.when(F.col("auth").isNull(), F.struct(F.lit("-").alias("kind"), F.lit(None).cast("string").alias("name"))).otherwise(F.struct(F.col("auth.kind").alias("kind"), F.col("auth.name").alias("name"))))
        line = F.col("source_line") if name == "references" else F.col("line")
        end = F.col("end_line") if "end_line" in rows.columns else F.lit(0)
        parts.append(rows.select("file", F.lit(name).alias("fact"), _detail(name).alias("detail"), line.cast("long").alias("line"), end.cast("long").alias("end_line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sql(sample: Sample) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({text(f)}, {text(d)}, {a}, {b})" for f, d, a, b in sample.facts)
    return f"""SELECT 'src/f' || s_suppkey || {text(sample.ending)} AS file, fact,
replace(replace(replace(detail, '{KEY}', s_suppkey::VARCHAR), '{MARK}', CASE WHEN s_suppkey % 2 = 0 THEN {text(sample.marks[0])} ELSE {text(sample.marks[1])} END),
  '{AUTH}', CASE WHEN s_suppkey % 2 = 0 THEN {text(sample.auth[0])} ELSE {text(sample.auth[1])} END) AS detail,
line::BIGINT AS line, end_line::BIGINT AS end_line FROM supplier, (VALUES {rows}) t(fact, detail, line, end_line)"""


SAMPLES: dict[str, Sample] = {}

SAMPLES["python"] = Sample(".py", '''import os
from flask import Flask
from .util§ import helper as h, other

class Item§(Base):
    """An item."""
    name: str
    size: int = 3

    def load(self, key):
        return helper(key)

@app.get("/p§/{id}")
@¤
def show§(id):
    key = os.environ["KEY_§"]
    logging.info("user " + email)
    return requests.get("http://x/§")

@bp.route("/r§")
def listed§():
    return os.getenv("ROOT_§")

urlpatterns = [path("d§/<int:pk>/", views.detail§)]
''', ("login_required", "cached"), ("decorator:login_required", "-"), (
    ("interfaces", "GET /p§/{id} ¶ show§ id", 13, 18),
    ("interfaces", "ALL /r§ - listed§ ", 20, 22),
    ("interfaces", "ALL /d§/<int:pk>/ - detail§ pk", 24, 24),
    ("dependencies", 'requests.get("http://x/§")', 18, 18),
    ("sinks", 'pii logging.info("user " + email)', 17, 17),
    ("symbols", "class | Item§ | - | public | An item. | class Item§(Base)", 5, 11),
    ("symbols", "function | load | Item§ | public | - | def load(self, key)", 10, 11),
    ("symbols", "function | show§ | - | public | - | def show§(id)", 15, 18),
    ("symbols", "function | listed§ | - | public | - | def listed§()", 21, 22),
    ("imports", "os os", 1, 0),
    ("imports", "flask Flask", 2, 0),
    ("imports", ".util§ helper,other", 3, 0),
    ("references", "load>helper call", 11, 0),
    ("references", ">app.get call", 13, 0),
    ("references", "show§>logging.info call", 17, 0),
    ("references", "show§>requests.get call", 18, 0),
    ("references", ">bp.route call", 20, 0),
    ("references", "listed§>os.getenv call", 22, 0),
    ("references", ">path call", 24, 0),
    ("references", "Item§>Base extends", 5, 0),
    ("data_models", "class Item§ Base - name:str:public,size:int:public", 5, 11),
    ("env_dependencies", "ROOT_§", 22, 22),
    ("env_dependencies", "KEY_§", 16, 16),
))

SAMPLES["java"] = Sample(".java", '''package x;
import java.util.List;

/** Handles items. */
@RestController
public class Ctl§ extends Base implements Runnable {
    private String name;

    @GetMapping("/j§/{id}")
    @¤("x")
    public String get§(String id) {
        logger.info("user " + email);
        return restTemplate.getForObject("http://x/§", String.class);
    }

    @RequireAuth
    @RequestMapping(value = "/m§", method = RequestMethod.POST)
    public void post§() {
        String k = System.getenv("KEY_§");
        helper(k);
    }

    private static int size() { return 0; }
}
''', ("PreAuthorize", "Cached"), ("annotation:PreAuthorize", "-"), (
    ("interfaces", "GET /j§/{id} ¶ get§ id", 9, 14),
    ("interfaces", "POST /m§ annotation:RequireAuth post§ ", 17, 21),
    ("dependencies", 'restTemplate.getForObject("http://x/§", String.class)', 13, 13),
    ("sinks", 'pii logger.info("user " + email)', 12, 12),
    ("symbols", "class | Ctl§ | - | - | Handles items. | @RestController\npublic class Ctl§ extends Base implements Runnable", 5, 24),
    ("symbols", 'method | get§ | Ctl§ | - | - | @GetMapping("/j§/', 9, 14),
    ("symbols", 'method | post§ | Ctl§ | - | - | @RequireAuth\n    @RequestMapping(value = "/m§", method = RequestMethod.POST)\n    public void post§()', 16, 21),
    ("symbols", "method | size | Ctl§ | private | - | private static int size()", 23, 23),
    ("references", "get§>logger.info call", 12, 0),
    ("references", "get§>restTemplate.getForObject call", 13, 0),
    ("references", "post§>System.getenv call", 19, 0),
    ("references", "post§>helper call", 20, 0),
    ("references", "Ctl§>Base extends", 6, 0),
    ("references", "Ctl§>Runnable implements", 6, 0),
    ("data_models", "class Ctl§ Base Runnable name:String:private", 5, 24),
    ("env_dependencies", "KEY_§", 19, 19),
))

SAMPLES["kotlin"] = Sample(".kt", '''@RestController
class Ctl§(val repo: Repo) : Base() {
    @GetMapping("/k§/{id}")
    @¤
    fun get§(id: String): String {
        return helper(id)
    }

    @DeleteMapping("/k§")
    fun drop§() {
        repo.clear()
    }
}
''', ("RequireAuth", "Cached"), ("annotation:RequireAuth", "-"), (
    ("interfaces", "GET /k§/{id} ¶ get§ id", 3, 7),
    ("interfaces", "DELETE /k§ - drop§ ", 9, 12),
    ("references", "get§>helper call", 6, 0),
    ("references", "drop§>repo.clear call", 11, 0),
    ("references", "Ctl§>Base extends", 2, 0),
    ("data_models", "class Ctl§ Base - repo:Repo:-", 1, 13),
))

SAMPLES["csharp"] = Sample(".cs", '''[Route("api/[controller]")]
[Authorize]
public class Item§Controller : ControllerBase, IDisposable
{
    public string Name { get; set; }

    [HttpGet("{id}")]
    public string Get§(string id) {
        var k = Environment.GetEnvironmentVariable("KEY_§");
        return client.GetAsync("http://x/§");
    }

    [HttpPost]
    [¤]
    public void Post§() { Helper(); }
}
''', ("AllowAnonymous", "Obsolete"), ("-", "attribute:Authorize"), (
    ("interfaces", "GET /api/item§/{id} attribute:Authorize Get§ id", 7, 11),
    ("interfaces", "POST /api/item§ ¶ Post§ ", 13, 15),
    ("dependencies", 'client.GetAsync("http://x/§")', 10, 10),
    ("symbols", 'class | Item§Controller | - | public | - | [Route("api/[controller]")]\n[Authorize]\npublic class Item§Controller : ControllerBase, IDisposable', 1, 16),
    ("symbols", 'method | Get§ | Item§Controller | public | - | [HttpGet("', 7, 11),
    ("symbols", "method | Post§ | Item§Controller | public | - | [HttpPost]\n    [¤]\n    public void Post§()", 13, 15),
    ("references", "Get§>Environment.GetEnvironmentVariable call", 9, 0),
    ("references", "Get§>client.GetAsync call", 10, 0),
    ("references", "Post§>Helper call", 15, 0),
    ("references", "Item§Controller>ControllerBase extends", 3, 0),
    ("references", "Item§Controller>IDisposable implements", 3, 0),
    ("data_models", "class Item§Controller ControllerBase IDisposable Name:string:public", 1, 16),
    ("env_dependencies", "KEY_§", 9, 9),
))

SAMPLES["minimal_api"] = Sample(".cs", '''var app = builder.Build();
app.MapGet("/m§/{id}", GetItem§).¤();
app.MapPost("/m§", (Item item) => Save(item));
app.Run();
''', ("RequireAuthorization", "WithOpenApi"), ("middleware:RequireAuthorization", "-"), (
    ("interfaces", "GET /m§/{id} ¶ GetItem§ id", 2, 2),
    ("interfaces", "POST /m§ - - ", 3, 3),
    ("references", ">builder.Build call", 1, 0),
    ("references", ">app.MapGet call", 2, 0),
    ("references", '>app.MapGet("/m§/{id}", GetItem§).¤ call', 2, 0),
    ("references", ">app.MapPost call", 3, 0),
    ("references", ">Save call", 3, 0),
    ("references", ">app.Run call", 4, 0),
))

SAMPLES["go"] = Sample(".go", '''package main

// Item§ is an item.
type Item§ struct {
	Base
	Name string
	size int
}

func Show§(c *gin.Context) {
	k := os.Getenv("KEY_§")
	log.Printf("user %s", email)
	http.Get("http://x/§")
}

func setup(r *gin.Engine) {
	r.GET("/g§/:id", ¤, Show§)
	http.HandleFunc("/h§", Show§)
}
''', ("authRequired", "logged"), ("middleware:authRequired", "-"), (
    ("interfaces", "GET /g§/:id ¶ Show§ id", 17, 17),
    ("interfaces", "ALL /h§ - Show§ ", 18, 18),
    ("dependencies", 'http.Get("http://x/§")', 13, 13),
    ("sinks", 'pii log.Printf("user %s", email)', 12, 12),
    ("symbols", "struct | Item§ | - | public | Item§ is an item. | type Item§ struct", 4, 8),
    ("symbols", "function | Show§ | - | public | - | func Show§(c *gin.Context)", 10, 14),
    ("symbols", "function | setup | - | private | - | func setup(r *gin.Engine)", 16, 19),
    ("references", "Show§>os.Getenv call", 11, 0),
    ("references", "Show§>log.Printf call", 12, 0),
    ("references", "Show§>http.Get call", 13, 0),
    ("references", "setup>r.GET call", 17, 0),
    ("references", "setup>http.HandleFunc call", 18, 0),
    ("references", "Item§>Base extends", 4, 0),
    ("data_models", "struct Item§ Base - Name:string:public,size:int:private", 4, 8),
    ("env_dependencies", "KEY_§", 11, 11),
))

SAMPLES["php"] = Sample(".php", '''<?php
class Item§ extends Model {
    public function show($id) {
        $k = getenv('KEY_§');
        Log::info('user ' . $email);
        return Http::get('http://x/§');
    }
}
Route::get('/p§/{id}', [Item§Controller::class, 'show'])->middleware('¤');
Route::apiResource('p§things', ThingController::class);
Route::resource('p§boxes', BoxController::class);
''', ("auth", "web"), ("middleware:auth", "-"), (
    ("interfaces", "GET /p§/{id} ¶ show id", 9, 9),
    ("interfaces", "GET /p§things - - ", 10, 10),
    ("interfaces", "POST /p§things - - ", 10, 10),
    ("interfaces", "GET /p§things/{p§thing} - - p§thing", 10, 10),
    ("interfaces", "PUT /p§things/{p§thing} - - p§thing", 10, 10),
    ("interfaces", "DELETE /p§things/{p§thing} - - p§thing", 10, 10),
    ("interfaces", "GET /p§boxes - - ", 11, 11),
    ("interfaces", "GET /p§boxes/create - - ", 11, 11),
    ("interfaces", "POST /p§boxes - - ", 11, 11),
    ("interfaces", "GET /p§boxes/{p§boxe} - - p§boxe", 11, 11),
    ("interfaces", "GET /p§boxes/edit - - ", 11, 11),
    ("interfaces", "PUT /p§boxes/{p§boxe} - - p§boxe", 11, 11),
    ("interfaces", "DELETE /p§boxes/{p§boxe} - - p§boxe", 11, 11),
    ("dependencies", "Http::get('http://x/§')", 6, 6),
    ("sinks", "pii Log::info('user ' . $email)", 5, 5),
    ("symbols", "class | Item§ | - | - | - | class Item§ extends Model", 2, 8),
    ("symbols", "method | show | Item§ | public | - | public function show($id)", 3, 7),
    ("references", "show>getenv call", 4, 0),
    ("references", "show>Log::info call", 5, 0),
    ("references", "show>Http::get call", 6, 0),
    ("references", ">Route::get call", 9, 0),
    ("references", ">Route::get('/p§/{id}', [Item§Controller::class, 'show'])->middleware call", 9, 0),
    ("references", ">Route::apiResource call", 10, 0),
    ("references", ">Route::resource call", 11, 0),
    ("env_dependencies", "KEY_§", 4, 4),
))

SAMPLES["ruby"] = Sample(".rb", '''class Item§ < Base
  def show(id)
    k = ENV["KEY_§"]
    Rails.logger.info("user #{email}")
    HTTParty.get("http://x/§")
  end
end
get "/r§/:id", to: "items#show"
resources :things§
before_action :¤
''', ("authenticate_user", "load_item"), ("before_action:authenticate_user", "-"), (
    ("interfaces", "GET /r§/:id ¶ items#show id", 8, 8),
    ("interfaces", "ALL /things§ ¶ - ", 9, 9),
    ("dependencies", 'HTTParty.get("http://x/§")', 5, 5),
    ("sinks", 'pii Rails.logger.info("user #{email}")', 4, 4),
    ("symbols", "class | Item§ | - | - | - | class Item§ < Base", 1, 7),
    ("symbols", "method | show | Item§ | - | - | def show(id)", 2, 6),
    ("references", "show>Rails.logger.info call", 4, 0),
    ("references", "show>HTTParty.get call", 5, 0),
    ("env_dependencies", "KEY_§", 3, 3),
))

SAMPLES["rust"] = Sample(".rs", '''/// An item.
pub struct Item§ {
    pub name: String,
    size: u32,
}

impl Runner for Item§ {
    fn run(&self, id: u32) -> u32 {
        let k = std::env::var("KEY_§");
        ¤(id)
    }
}
''', ("helper", "other"), ("helper", "other"), (
    ("symbols", "struct | Item§ | - | public | An item. | pub struct Item§", 2, 5),
    ("symbols", "function | run | Item§ | private | - | fn run(&self, id: u32) -> u32", 8, 11),
    ("references", "run>std::env::var call", 9, 0),
    ("references", "run>¤ call", 10, 0),
    ("references", "Item§>Runner implements", 7, 0),
    ("data_models", "struct Item§ - - name:String:public,size:u32:private", 2, 5),
    ("env_dependencies", "KEY_§", 9, 9),
))

SAMPLES["nest"] = Sample(".ts", '''@Controller("cats§")
@UseGuards(AuthGuard)
export class Cats§ {
  @Get(":id")
  find§(id: string) { return axios.get("/x§"); }
  @Post()
  @UseGuards(¤)
  make§() { return 1; }
}
''', ("RoleGuard", "OwnerGuard"), ("RoleGuard", "OwnerGuard"), (
    ("interfaces", "GET /x§ - - ", 5, 5),
    ("interfaces", "GET /cats§/:id decorator:AuthGuard find§ id", 5, 5),
    ("interfaces", "POST /cats§ decorator:¤ make§ ", 8, 8),
    ("dependencies", 'axios.get("/x§")', 5, 5),
    ("symbols", "class | Cats§ | - | public | - | class Cats§", 3, 9),
    ("symbols", "method | find§ | Cats§ | public | - | find§(id: string)", 5, 5),
    ("symbols", "method | make§ | Cats§ | public | - | make§()", 8, 8),
    ("references", ">Controller call", 1, 0),
    ("references", ">UseGuards call", 2, 0),
    ("references", ">Get call", 4, 0),
    ("references", "find§>axios.get call", 5, 0),
    ("references", ">Post call", 6, 0),
    ("references", ">UseGuards call", 7, 0),
    ("data_models", "class Cats§ - - ", 3, 9),
))


def _register(name: str, sample: Sample) -> None:
    def run(spark, sf_dir):
        return _facts(spark, sf_dir, sample)

    run.__name__ = f"extract_{name}"
    query(_sql(sample))(run)


for _name, _sample in SAMPLES.items():
    _register(_name, _sample)
