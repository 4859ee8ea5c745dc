"""Detectors on small sources written for the purpose."""

import zipfile

from factloom.operators import evidence, extract, graph, parsed, rules
from factloom.sources import files as src

PY = '''from fastapi import APIRouter, FastAPI
app = FastAPI()
api = APIRouter()
BASE = "/v1"

@app.post(BASE + "/pay")
def pay(x):
    with transaction.atomic():
        cache.set("k", 1)
        send.delay(x)
    redis_client.get("a")

@app.get(unknown)
def no(): ...
'''
FLASK = '''from flask import Flask
web = Flask(__name__)

@web.route("/a", methods=["GET", "POST"])
def a(): ...

@shared_task
def job(): ...
'''
JAVA = '''package demo;
@RestController
@RequestMapping("/orders")
public class OrderController {
  private KafkaTemplate<String, String> events;
  private OrderRepository orders;
  @Transactional
  @PostMapping(
    "/{id}")
  public void pay(String id) {
    // orders.save(ignored);
    orders.save(new Order());
    events.send("paid", "orders.find(");
  }
  @GetMapping("/a" + SUFFIX)
  public void computed() { }
  @KafkaListener(topics = "paid")
  public void on(String m) { orders.findAll(); }
}
'''
NEST = '''@Controller('users')
export class UsersController {
  @Get(':id')
  @UseGuards(Auth)
  one(@Param('id') id: string) { return prisma.$transaction([]); }
}
@Injectable()
export class Other { @Get('x') no() {} }
'''


def found(path, source):
    return [(r["kind"], r.get("method"), r.get("route"), r.get("op") or r.get("name")) for r in parsed.facts(path, source)]


def test_python():
    got = found("a.py", PY)
    assert got == [("api.route", "POST", "/v1/pay", "pay"), ("db.transaction", None, None, None), ("cache.write", None, None, "set"), ("queue.dispatch", None, None, "delay"), ("cache.read", None, None, "get")]
    assert found("b.py", FLASK) == [("api.route", "GET", "/a", "a"), ("api.route", "POST", "/a", "a"), ("queue.consume", None, None, "job")]
    assert found("c.py", "def (") == [("parse_error", None, None, None)]


def test_java():
    got = set(found("O.java", JAVA))
    assert ("api.route", "POST", "/orders/{id}", "pay") in got
    assert ("db.transaction", None, None, "method") in got
    assert ("db.write", None, None, "save") in got and ("db.read", None, None, "findAll") in got
    assert ("queue.dispatch", None, None, "paid") in got and ("queue.consume", None, None, "paid") in got
    assert len([g for g in got if g[0] == "api.route"]) == 1


def test_nest():
    assert [g for g in found("u.ts", NEST) if g[0] == "api.route"] == [("api.route", "GET", "/users/{id}", "one")]


def test_graph(spark):
    files = spark.createDataFrame([("a.py", PY), ("O.java", JAVA)], "path string, content string")
    rows = graph.placed(evidence.with_ids(rules.detect(files)))
    kinds = {r["type"] for r in graph.edges(rows).collect()}
    assert kinds == {"encloses_tx", "uses_cache", "dispatches_job", "cache_within_tx", "dispatch_within_tx", "observed_in_same_scope", "supported_by"}
    ids = [r["event_id"] for r in graph.nodes(rows).collect()]
    again = graph.placed(evidence.with_ids(rules.detect(files.repartition(3))))
    assert ids == sorted(ids) == [r["event_id"] for r in graph.nodes(again).collect()]
    assert len(set(ids)) == len(ids)


def lines(spark, path, text):
    return extract.lines_of(spark.createDataFrame([(path, text)], "path string, content string"))


def test_sql(spark):
    rows = lines(spark, "a.sql", "begin;\nCREATE TABLE IF NOT EXISTS users (id int);\ncreate unique index ix on users(id);\ncommit;\n")
    assert [(r["concept"], r["name"], r["line_no"]) for r in extract.sql_ddl(rows).orderBy("line_no").collect()] == [("Storage", "users", 2), ("Index", "ix", 3)]
    assert [(r["start_line"], r["end_line"]) for r in extract.sql_tx(rows).collect()] == [(1, 4)]
    assert extract.sql_tx(lines(spark, "b.sql", "commit;\nbegin;")).count() == 0


def test_typescript_lines(spark):
    text = "app.use('/v1', router);\nrouter.get('/users/:id', h);\napp.post('/x', h);\nfetch('/a');\nfetch('/b', { method: 'post' });\naxios.delete(`/c`);\nredisClient.del('k');\nmailQueue.add('x');\nnew Worker('mail', f);"
    rows = lines(spark, "a.ts", text)
    assert [(r["method"], r["route"]) for r in extract.express_routes(rows).orderBy("line_no").collect()] == [("GET", "/v1/users/{id}"), ("POST", "/x")]
    assert [(r["client"], r["method"], r["raw"], r["confidence"]) for r in extract.http_callers(rows).orderBy("line_no").collect()] == [("fetch", "GET", "/a", 0.8), ("fetch", "POST", "/b", 0.86), ("axios", "DELETE", "/c", 0.88)]
    assert [r["kind"] for r in extract.cache_operations(rows).collect()] == ["cache.invalidate"]
    assert [(r["kind"], r["queue"]) for r in extract.queue_operations(rows).orderBy("line_no").collect()] == [("queue.dispatch", "mailQueue"), ("queue.consume", "mail")]


def test_config_files(spark):
    compose = "version: '3'\nservices:\n  web:\n    image: app\n    ports:\n      - '1:1'\n  store:\n    image: redis:7\nvolumes:\n  v:\n"
    assert [(r["service"], r["concept"]) for r in extract.compose_infra(lines(spark, "docker-compose.yml", compose)).orderBy("concept").collect()] == [("store", "Cache"), ("store", "KV/Storage")]
    assert [r["concept"] for r in extract.dockerfile(lines(spark, "Dockerfile", "FROM x\nCOPY . .\nRUN curl http://a\nENV TOKEN=1")).orderBy("line_no").collect()] == ["FileSystem", "External IO", "Secrets/Config"]
    assert [r["dependency"] for r in extract.requirements(lines(spark, "requirements.txt", "a>=1\n# c\nb~=2")).orderBy("line_no").collect()] == ["a", "b"]
    package = spark.createDataFrame([("package.json", '{"dependencies": {"x": "1"}, "scripts": {"test": "t"}}')], "path string, content string")
    assert sorted((r["section"], r["name"]) for r in extract.package_json(package).collect()) == [("dependencies", "x"), ("scripts", "test")]
    spec = spark.createDataFrame([("openapi.json", '{"paths": {"/a": {"get": {}, "post": {}}, "/b": {"x-y": 1}}}')], "path string, content string")
    assert sorted((r["method"], r["route"]) for r in extract.openapi_json(spec).collect()) == [("GET", "/a"), ("POST", "/a")]
    yaml = "openapi: 3\npaths:\n  /a:\n    get:\n      x: 1\n  /b/{id}:\n    delete:\ncomponents:\n  /no:\n    get:\n"
    assert [(r["method"], r["route"]) for r in extract.openapi_yaml(lines(spark, "o.yaml", yaml)).orderBy("line_no").collect()] == [("GET", "/a"), ("DELETE", "/b/{id}")]
    assert {r["concept"] for r in extract.workflow_steps(lines(spark, "w.yml", "on:\n  - cron: '0'\nuses: actions/cache@v3\nrun: curl x")).collect()} == {"Scheduling", "Cache", "External IO"}


def test_sources(spark, tmp_path):
    (tmp_path / "t" / "node_modules").mkdir(parents=True)
    (tmp_path / "t" / "a.py").write_text("x = 1\n")
    (tmp_path / "t" / "node_modules" / "b.js").write_text("y\n")
    (tmp_path / "t" / "c.txt").write_bytes(b"\x00\x01")
    tree = src.read_tree(spark, str(tmp_path / "t"))
    assert sorted(r["path"] for r in tree.collect()) == ["a.py", "c.txt", "node_modules/b.js"]
    assert [r["path"] for r in src.kept(tree).collect()] == ["a.py"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("ok.py", "a")
        z.writestr("../evil", "b")
    assert {r["path"]: r["reason"] for r in src.read_zips(spark, str(tmp_path / "z.zip")).collect()} == {"ok.py": None, "../evil": "traversal"}
