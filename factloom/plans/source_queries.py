"""Queries of the source detectors over small generated files, one for each row of pages.

A file's text is written once, in SQL that both engines run; what is found in it is told
twice: by the detectors here, and in SQL by other means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entrypoints, extract, parsed, surface
from . import bindings as b
from .registry import query


def lines(*parts: str) -> str:
    """SQL for a text of lines, each an SQL expression; a plain text where it holds no SQL."""
    return "concat_ws(chr(10), " + ", ".join(p if p.startswith(("concat(", "CASE ")) else f"'{p}'" for p in parts) + ")"


def source(path: str, content: str) -> tuple[str, str]:
    return path, content


def cte(made: tuple[str, str]) -> str:
    return f"src AS (SELECT page_id, {made[0]} AS path, {made[1]} AS content FROM pages)"


def line_cte(made: tuple[str, str]) -> str:
    return f"{cte(made)}, l AS (SELECT page_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM src)"


def files(spark: SparkSession, sf_dir: str, made: tuple[str, str]) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", F.expr(made[0]).alias("path"), F.expr(made[1]).alias("content"))


def _lines(spark: SparkSession, sf_dir: str, made: tuple[str, str]) -> DataFrame:
    return extract.lines_of(files(spark, sf_dir, made))


TX = source(
    "concat('db/', page_id, '.sql')",
    f"""CASE page_id % 5 WHEN 0 THEN {lines('BEGIN;', "concat('INSERT INTO t VALUES (', page_id, ');')", 'COMMIT;')}
    WHEN 1 THEN {lines('-- moves', '  begin transaction;', 'UPDATE t SET a = 1;', ' commit work;', 'SELECT 1;')} WHEN 2 THEN {lines('COMMIT;', 'BEGIN;')}
    WHEN 3 THEN {lines('SELECT 1;')} ELSE {lines('BEGIN;', 'COMMIT;', 'BEGIN;', 'ROLLBACK;', 'COMMIT;', 'END;')} END""",
)


@query(
    f"""WITH {line_cte(TX)}, m AS (SELECT path, min(n) FILTER (upper(trim(line)) LIKE 'BEGIN%') AS a, max(n) FILTER (upper(trim(line)) LIKE 'COMMIT%') AS z FROM l GROUP BY path)
    SELECT path, a AS start_line, z AS end_line, CAST(0.8 AS DOUBLE) AS confidence FROM m WHERE a <= z"""
)
def source_sql_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of SQL files."""
    return extract.sql_tx(_lines(spark, sf_dir, TX))


DDL = source(
    "concat('db/', page_id, '.sql')",
    lines("concat('CREATE TABLE t', page_id % 9, ' (id int);')", "CASE WHEN page_id % 2 = 0 THEN concat('create unique index if not exists i', page_id, ' on t (a);') ELSE 'drop table x;' END",
          "CASE WHEN page_id % 3 = 0 THEN 'Create  Table If Not Exists \"shop.orders\" (id int); create index `by_day` on x (y);' ELSE 'INSERT INTO created VALUES (1);' END"),
)


@query(
    f"""WITH {cte(DDL)}, f AS (SELECT path, 1 AS line_no, 'Storage' AS concept, concat('t', page_id % 9) AS name FROM src
    UNION ALL SELECT path, 2, 'Index', concat('i', page_id) FROM src WHERE page_id % 2 = 0 UNION ALL SELECT path, 3, 'Storage', 'shop.orders' FROM src WHERE page_id % 3 = 0
    UNION ALL SELECT path, 3, 'Index', 'by_day' FROM src WHERE page_id % 3 = 0)
    SELECT path, CAST(line_no AS BIGINT) AS line_no, concept, name, CAST(CASE concept WHEN 'Index' THEN 0.65 ELSE 0.6 END AS DOUBLE) AS confidence FROM f"""
)
def source_sql_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and indexes that SQL files create."""
    return extract.sql_ddl(_lines(spark, sf_dir, DDL))


API_JSON = source(
    "concat('api/', page_id, '.json')",
    """CASE WHEN page_id % 7 = 0 THEN '{not json' ELSE concat('{"openapi": "3.0.0", "paths": {"/users/{id}": {"get": {"summary": "a"}', CASE WHEN page_id % 2 = 0 THEN ', "delete": {}' ELSE '' END,
    ', "parameters": []}, "/items/', page_id % 11, '": {"post": {}, "HEAD": {}, "x-internal": true}}}') END""",
)


@query(
    f"""WITH {cte(API_JSON)}, ok AS (SELECT * FROM src WHERE json_valid(content)), p AS (SELECT path, content, unnest(json_keys(content, '$.paths')) AS route FROM ok),
    v AS (SELECT path, route, unnest(json_keys(content, concat('$.paths."', route, '"'))) AS verb FROM p)
    SELECT path, route, upper(verb) AS method, CAST(0.85 AS DOUBLE) AS confidence FROM v WHERE lower(verb) IN ('get', 'post', 'put', 'delete', 'patch', 'options', 'head')"""
)
def source_openapi_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods and routes of OpenAPI documents in JSON."""
    return extract.openapi_json(files(spark, sf_dir, API_JSON))


API_YAML = source(
    "concat('api/', page_id, '.yaml')",
    lines("openapi: 3.0.0", "info:", "  get: no route", "paths:", "concat('  /users/', page_id % 5, ':')", "    get:", "      summary: x", "CASE WHEN page_id % 2 = 0 THEN '    Delete:' ELSE '    parameters:' END", "  \"/items/{id}\":", "    post:",
          "CASE WHEN page_id % 3 = 0 THEN '      put: deeper still' ELSE '' END", "components:", "  /not/a/route:", "    get:"),
)


@query(
    f"""WITH {cte(API_YAML)}, f AS (SELECT path, 6 AS line_no, concat('/users/', page_id % 5) AS route, 'GET' AS method FROM src
    UNION ALL SELECT path, 8, concat('/users/', page_id % 5), 'DELETE' FROM src WHERE page_id % 2 = 0 UNION ALL SELECT path, 10, '/items/{{id}}', 'POST' FROM src
    UNION ALL SELECT path, 11, '/items/{{id}}', 'PUT' FROM src WHERE page_id % 3 = 0)
    SELECT path, CAST(line_no AS BIGINT) AS line_no, route, method FROM f"""
)
def source_openapi_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods and routes of OpenAPI documents in YAML, by indent."""
    return extract.openapi_yaml(_lines(spark, sf_dir, API_YAML))


CI = source(
    "concat('.github/workflows/', page_id, '.yml')",
    lines("name: build", "on:", "  schedule:", "CASE WHEN page_id % 2 = 0 THEN '    - cron: 0 4 * * *' ELSE '    - at: night' END", "concurrency:", "jobs:", "CASE WHEN page_id % 3 = 0 THEN '      uses: actions/cache@v4' ELSE '      uses: actions/checkout@v4' END",
          "concat('      run: curl https://example.org/', page_id)", "      token: secrets.KEY", "      run: wget secrets.txt"),
)


@query(
    f"""WITH {line_cte(CI)}, c AS (SELECT path, n, line, unnest(['Scheduling', 'Secrets/Config', 'Cache', 'Concurrency', 'External IO']) AS concept FROM l)
    SELECT path, n AS line_no, concept, CAST(CASE concept WHEN 'External IO' THEN 0.65 ELSE 0.6 END AS DOUBLE) AS confidence FROM c
    WHERE CASE concept WHEN 'Scheduling' THEN starts_with(replace(trim(line), '- ', ''), 'cron:') WHEN 'Secrets/Config' THEN contains(line, 'secrets.') WHEN 'Cache' THEN contains(line, 'actions/cache')
        WHEN 'Concurrency' THEN starts_with(trim(line), 'concurrency:') ELSE contains(line, 'curl ') OR contains(line, 'wget ') OR contains(line, 'http://') OR contains(line, 'https://') END"""
)
def source_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of CI workflow files."""
    return extract.workflow_steps(_lines(spark, sf_dir, CI))


DOCKER = source(
    "concat('img/', page_id, '/Dockerfile')",
    lines("FROM python:3.13", "WORKDIR /app", "COPY . .", "CASE WHEN page_id % 2 = 0 THEN 'RUN curl -O https://example.org/x' ELSE 'RUN make' END", "concat('ENV SECRET_', page_id, '=1')", "arg TOKEN", "EXPOSE 80",
          "CASE WHEN page_id % 3 = 0 THEN '  add http://example.org/y /y' ELSE 'VOLUME /data' END", "# ENV KEY"),
)


@query(
    f"""WITH {line_cte(DOCKER)}, w AS (SELECT path, n, lower(line) AS line, upper(string_split(trim(line), ' ')[1]) AS op FROM l), c AS (SELECT *, unnest(['FileSystem', 'External IO', 'Secrets/Config']) AS concept FROM w)
    SELECT path, n AS line_no, concept FROM c WHERE CASE concept WHEN 'FileSystem' THEN op IN ('COPY', 'ADD', 'VOLUME', 'WORKDIR')
        WHEN 'External IO' THEN op IN ('RUN', 'ADD', 'EXPOSE') AND (contains(line, 'http') OR contains(line, 'curl') OR contains(line, 'wget') OR contains(line, 'expose'))
        ELSE op IN ('ENV', 'ARG') END"""
)
def source_dockerfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dockerfile instructions that touch files, the network, or configuration."""
    return extract.dockerfile(_lines(spark, sf_dir, DOCKER))


COMPOSE = source(
    "concat('stack/', page_id, '/docker-compose.yml')",
    lines("version: 3", "services:", "concat('  web', page_id % 4, ':')", "    image: nginx:1", "    depends_on:", "      - db", "  store:", "CASE page_id % 3 WHEN 0 THEN '    image: \"redis:7\"' WHEN 1 THEN '    image: postgres:16' ELSE '    image: bitnami/kafka' END", "  idle:", "    build: .",
          "CASE WHEN page_id % 2 = 0 THEN '    image: rabbitmq' ELSE '    environment:' END", "volumes:", "  data:", "    image: mysql"),
)


@query(
    f"""WITH {cte(COMPOSE)}, f AS (SELECT path, 8 AS line_no, 'store' AS service, unnest(CASE page_id % 3 WHEN 0 THEN ['Cache', 'KV/Storage'] WHEN 1 THEN ['KV/Storage'] ELSE ['Queue'] END) AS concept,
        CASE page_id % 3 WHEN 0 THEN 'redis' WHEN 1 THEN 'postgres' ELSE 'kafka' END AS infra FROM src
    UNION ALL SELECT path, 11, 'idle', 'Queue', 'rabbitmq' FROM src WHERE page_id % 2 = 0) SELECT path, CAST(line_no AS BIGINT) AS line_no, service, concept, infra FROM f"""
)
def source_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infrastructure that the services of compose files stand for."""
    return extract.compose_infra(_lines(spark, sf_dir, COMPOSE))


DEPS = source(
    "concat('py/', page_id, '/requirements.txt')",
    lines("concat('lib', page_id % 6, '==1.', page_id)", "# a note", "", "  numpy>=2 ; python_version > 3", "flask~=3.0", "CASE WHEN page_id % 2 = 0 THEN 'plain' ELSE '==1' END"),
)


@query(
    f"""WITH {cte(DEPS)}, f AS (SELECT path, 1 AS line_no, concat('lib', page_id % 6) AS dependency FROM src UNION ALL SELECT path, 4, 'numpy' FROM src UNION ALL SELECT path, 5, 'flask' FROM src
    UNION ALL SELECT path, 6, 'plain' FROM src WHERE page_id % 2 = 0) SELECT path, CAST(line_no AS BIGINT) AS line_no, dependency, 'Config' AS concept FROM f"""
)
def source_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of requirements files."""
    return extract.requirements(_lines(spark, sf_dir, DEPS))


GO = source(
    "concat('go/', page_id, '/go.mod')",
    lines("concat('module example.org/m', page_id)", "go 1.22", "require example.org/one v1.0.0", "require (", "concat('\texample.org/lib', page_id % 5, ' v0.', page_id % 3, '.0')", "CASE WHEN page_id % 2 = 0 THEN '\t// none' ELSE '\tgolang.org/x/text v0.3.0 // indirect' END", ")", "replace example.org/one => ../one"),
)


@query(
    f"""WITH {cte(GO)}, f AS (SELECT path, 3 AS line_no, 'example.org/one' AS dependency, 'v1.0.0' AS version FROM src
    UNION ALL SELECT path, 5, concat('example.org/lib', page_id % 5), concat('v0.', page_id % 3, '.0') FROM src UNION ALL SELECT path, 6, 'golang.org/x/text', 'v0.3.0' FROM src WHERE page_id % 2 = 1)
    SELECT path, CAST(line_no AS BIGINT) AS line_no, dependency, version, 'Config' AS concept FROM f"""
)
def source_go_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of go.mod files, single and in blocks."""
    return extract.go_mod(_lines(spark, sf_dir, GO))


PACKAGE = source(
    "concat('js/', page_id, '/package.json')",
    """CASE WHEN page_id % 7 = 0 THEN 'broken {' ELSE concat('{"name": "p', page_id, '", "main": "index.js", "dependencies": {"express": "^4", "lib', page_id % 4, '": "1"}, "scripts": {"Test": "jest"',
    CASE WHEN page_id % 2 = 0 THEN ', "start": "node ."' ELSE '' END, '}', CASE page_id % 3 WHEN 0 THEN ', "bin": "cli.js"' WHEN 1 THEN ', "bin": {"tool": "a.js", "other": "b.js"}' ELSE '' END, '}') END""",
)


@query(
    f"""WITH {cte(PACKAGE)}, ok AS (SELECT * FROM src WHERE page_id % 7 <> 0) SELECT path, 'dependencies' AS section, 'express' AS name, '^4' AS value FROM ok
    UNION ALL SELECT path, 'dependencies', concat('lib', page_id % 4), '1' FROM ok UNION ALL SELECT path, 'scripts', 'Test', 'jest' FROM ok UNION ALL SELECT path, 'scripts', 'start', 'node .' FROM ok WHERE page_id % 2 = 0"""
)
def source_package_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies and scripts of package.json files."""
    return extract.package_json(files(spark, sf_dir, PACKAGE))


@query(
    f"""WITH {cte(PACKAGE)}, ok AS (SELECT * FROM src WHERE page_id % 7 <> 0), e AS (SELECT path, 'tests' AS kind, 'npm run Test' AS command, 0.8 AS confidence FROM ok
    UNION ALL SELECT path, 'cli', 'npm run start', 0.8 FROM ok WHERE page_id % 2 = 0 UNION ALL SELECT path, 'cli', 'node index.js', 0.7 FROM ok
    UNION ALL SELECT path, 'cli', 'npx cli.js', 0.7 FROM ok WHERE page_id % 3 = 0 UNION ALL SELECT path, 'cli', concat('npx ', unnest(['tool', 'other'])), 0.7 FROM ok WHERE page_id % 3 = 1)
    SELECT path, kind, 'node' AS language, command AS title, command, CAST(confidence AS DOUBLE) AS confidence, sha1(concat_ws('|', kind, path, command)) AS id FROM e"""
)
def source_entrypoints_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the packages of package.json files are started."""
    return entrypoints.package_json(files(spark, sf_dir, PACKAGE))


STARTS = source(
    "concat('r', page_id, CASE page_id % 7 WHEN 0 THEN '/manage.py' WHEN 1 THEN '/pyproject.toml' WHEN 2 THEN '/setup.cfg' WHEN 3 THEN '/setup.py' WHEN 4 THEN '/compose.yaml' WHEN 5 THEN '/.github/workflows/ci.yml' ELSE '/README.md' END)",
    f"""CASE page_id % 7 WHEN 0 THEN {lines('import django')} WHEN 1 THEN {lines('[project]', "concat('name = \"p', page_id, '\"')", '[project.scripts]', "concat('run-', page_id, ' = \"p:main\"')", 'other = "p:b"')}
    WHEN 2 THEN {lines('[options.entry_points]', 'console_scripts =', "concat('    job', page_id, ' = p.jobs:main')")} WHEN 3 THEN {lines('setup(', 'entry_points={"console_scripts": ["ignored"]},', 'console_scripts=["one=p:a", "two=p:b"],', ')')}
    WHEN 4 THEN {lines('services:', '  a:', "concat('  b', page_id, ':')", '  c:', '  d:')} WHEN 5 THEN {lines("CASE WHEN page_id % 2 = 0 THEN concat('name: Build ', page_id) ELSE 'on: push' END", 'jobs:')}
    ELSE {lines('# Use', "CASE WHEN page_id % 2 = 0 THEN 'run docker compose up now' ELSE 'npm run start' END", 'python -m app')} END""",
)


@query(
    f"""WITH {cte(STARTS)}, e AS (SELECT path, 'web' AS kind, 'python' AS language, 'Django runserver' AS title, 'python manage.py runserver' AS command, 0.85 AS confidence FROM src WHERE page_id % 7 = 0
    UNION ALL SELECT path, 'migration', 'python', 'Django migrate', 'python manage.py migrate', 0.75 FROM src WHERE page_id % 7 = 0
    UNION ALL SELECT path, 'cli', 'python', concat('console script ', c), c, 0.7 FROM (SELECT path, unnest([concat('run-', page_id), 'other']) AS c FROM src WHERE page_id % 7 = 1)
    UNION ALL SELECT path, 'cli', 'python', concat('console script job', page_id), concat('job', page_id), 0.7 FROM src WHERE page_id % 7 = 2
    UNION ALL SELECT path, 'cli', 'python', concat('console script ', c), c, 0.7 FROM (SELECT path, unnest(['one', 'two']) AS c FROM src WHERE page_id % 7 = 3)
    UNION ALL SELECT path, 'docker', 'shell', concat('Compose up (a, b', page_id, ', c...)'), 'docker compose up', 0.8 FROM src WHERE page_id % 7 = 4
    UNION ALL SELECT path, 'ci', 'unknown', CASE WHEN page_id % 2 = 0 THEN concat('Build ', page_id) ELSE 'ci' END, 'see workflow file', 0.6 FROM src WHERE page_id % 7 = 5
    UNION ALL SELECT path, 'cli', 'python', 'python -m (README)', 'python -m ...', 0.4 FROM src WHERE page_id % 7 = 6
    UNION ALL SELECT path, CASE WHEN page_id % 2 = 0 THEN 'docker' ELSE 'cli' END, CASE WHEN page_id % 2 = 0 THEN 'shell' ELSE 'node' END, CASE WHEN page_id % 2 = 0 THEN 'docker compose up (README)' ELSE 'npm run start (README)' END,
        CASE WHEN page_id % 2 = 0 THEN 'docker compose up' ELSE 'npm run start' END, 0.4 FROM src WHERE page_id % 7 = 6)
    SELECT path, kind, language, title, command, CAST(confidence AS DOUBLE) AS confidence, sha1(concat_ws('|', kind, path, command)) AS id FROM e"""
)
def source_entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How projects are started, by their manage.py, console scripts, compose files, workflows and README."""
    made = files(spark, sf_dir, STARTS)
    out = None
    for find in (entrypoints.manage_py, entrypoints.console_scripts, entrypoints.compose, entrypoints.workflows, entrypoints.readme):
        out = find(made) if out is None else out.unionByName(find(made))
    return out


@query(
    f"""WITH {cte(PACKAGE)}, e AS (SELECT page_id % 7 AS m, page_id FROM pages WHERE page_id % 7 <> 0), c AS (SELECT 'tests' AS kind, 'high' AS band FROM e UNION ALL SELECT 'cli', 'high' FROM e WHERE page_id % 2 = 0
    UNION ALL SELECT 'cli', 'mid' FROM e UNION ALL SELECT 'cli', 'mid' FROM e WHERE page_id % 3 = 0 UNION ALL SELECT 'cli', unnest(['mid', 'mid']) FROM e WHERE page_id % 3 = 1)
    SELECT kind, band, count(*) AS n FROM c GROUP BY GROUPING SETS ((kind), (band), ())"""
)
def source_entrypoint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points by kind, by band of confidence, and in all."""
    return entrypoints.stats(entrypoints.package_json(files(spark, sf_dir, PACKAGE)))


EXPRESS = source(
    "concat('js/', page_id, '.ts')",
    lines("const router = express.Router()", "CASE WHEN page_id % 2 = 0 THEN 'app.use(\"/v1\", router)' ELSE 'app.use(cors())' END", "concat('router.get(\"/items/:id/', page_id % 8, '\", show)')", "app.post(\"//login\", login)", "router.all(\"/x\", no)",
          "CASE WHEN page_id % 3 = 0 THEN '  app.delete(`/old`, drop)' ELSE 'app.get(path, computed)' END"),
)


@query(
    f"""WITH {cte(EXPRESS)}, f AS (SELECT path, 3 AS line_no, 'GET' AS method, concat(CASE WHEN page_id % 2 = 0 THEN '/v1' ELSE '' END, '/items/{{id}}/', page_id % 8) AS route FROM src
    UNION ALL SELECT path, 4, 'POST', '/login' FROM src UNION ALL SELECT path, 6, 'DELETE', '/old' FROM src WHERE page_id % 3 = 0)
    SELECT path, CAST(line_no AS BIGINT) AS line_no, method, route, CAST(0.82 AS DOUBLE) AS confidence FROM f"""
)
def source_express(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of express applications, with the prefix that a router is used under."""
    return extract.express_routes(_lines(spark, sf_dir, EXPRESS))


CALLS = source(
    "concat('web/', page_id, '.ts')",
    lines("const api = axios.create({ baseURL: \"/api\" })", "concat('const a = await fetch(\"/users/', page_id % 9, '\")')", "fetch(\"/items\", { method: \"put\" })", "CASE WHEN page_id % 2 = 0 THEN 'axios.delete(\"/old\")' ELSE 'axios.get(url)' END", "CASE WHEN page_id % 3 = 0 THEN 'api.post(\"/orders\", body)' ELSE '' END", "fetch(target)"),
)


@query(
    f"""WITH {cte(CALLS)}, f AS (SELECT path, 2 AS line_no, 'fetch' AS client, 'GET' AS method, concat('/users/', page_id % 9) AS raw, true AS inferred, 0.8 AS confidence FROM src
    UNION ALL SELECT path, 3, 'fetch', 'PUT', '/items', false, 0.86 FROM src UNION ALL SELECT path, 4, 'axios', 'DELETE', '/old', false, 0.88 FROM src WHERE page_id % 2 = 0
    UNION ALL SELECT path, 5, 'axios', 'POST', '/api/orders', false, 0.88 FROM src WHERE page_id % 3 = 0)
    SELECT path, CAST(line_no AS BIGINT) AS line_no, client, method, raw, inferred, CAST(confidence AS DOUBLE) AS confidence FROM f"""
)
def source_http_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fetch and axios calls with a literal url, those of an axios instance with its base."""
    return extract.http_callers(_lines(spark, sf_dir, CALLS))


@query(
    f"""WITH {cte(CALLS)} SELECT path, CAST(6 AS BIGINT) AS line_no, 'fetch' AS client, 'computed_url' AS reason FROM src
    UNION ALL SELECT path, 4, 'axios', 'computed_url' FROM src WHERE page_id % 2 <> 0"""
)
def source_unsupported_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose url is computed, which no link can be made for."""
    return extract.unsupported_callers(_lines(spark, sf_dir, CALLS))


SIDE = source(
    "concat('svc/', page_id, '.ts')",
    lines("import Redis from \"ioredis\"", "concat('await redis.get(\"k', page_id, '\")')", "CASE WHEN page_id % 2 = 0 THEN 'cacheClient.setex(key, 60, v)' ELSE 'other.set(key, v)' END", "this.redisClient.del(key)", "mailQueue.add(\"send\", x)", "concat('new Worker(\"jobs', page_id % 4, '\", run)')", "CASE WHEN page_id % 3 = 0 THEN 'mailQueue.process(run)' ELSE 'list.add(1)' END"),
)


@query(
    f"""WITH {cte(SIDE)}, f AS (SELECT path, 2 AS line_no, 'redis' AS symbol, 'get' AS op, 'cache.read' AS kind FROM src UNION ALL SELECT path, 3, 'cacheClient', 'setex', 'cache.write' FROM src WHERE page_id % 2 = 0
    UNION ALL SELECT path, 4, 'this.redisClient', 'del', 'cache.invalidate' FROM src) SELECT path, CAST(line_no AS BIGINT) AS line_no, symbol, op, kind, true AS ioredis FROM f"""
)
def source_cache_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache calls of scripts, and whether their file uses ioredis."""
    return extract.cache_operations(_lines(spark, sf_dir, SIDE))


@query(
    f"""WITH {cte(SIDE)}, f AS (SELECT path, 5 AS line_no, 'queue.dispatch' AS kind, 'mailQueue' AS queue FROM src UNION ALL SELECT path, 6, 'queue.consume', concat('jobs', page_id % 4) FROM src
    UNION ALL SELECT path, 7, 'queue.consume', 'mailQueue' FROM src WHERE page_id % 3 = 0) SELECT path, CAST(line_no AS BIGINT) AS line_no, kind, queue FROM f"""
)
def source_queue_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispatches to queues and their consumers in scripts."""
    return extract.queue_operations(_lines(spark, sf_dir, SIDE))


JAVA = source(
    "concat('src/', page_id, '.java')",
    lines("@RestController @RequestMapping(\"/api\")", "concat('class C', page_id, ' {')", "  private final OrderRepository orders;", "  private EntityManager em;", "concat('  @GetMapping(\"/items/', page_id % 6, '\")')", "  @Transactional", "  public void handle() {", "    orders.save(x);",
          "CASE WHEN page_id % 2 = 0 THEN '    em.find(A.class, 1);' ELSE '    orders.findAll();' END", "    kafkaTemplate.send(\"topic\", x);", "  }", "}"),
)


@query(
    f"""WITH {cte(JAVA)}, f AS (SELECT path, 5 AS start_line, 'spring' AS framework, 'api.route' AS kind, 'handle' AS name, 'GET' AS method, concat('/api/items/', page_id % 6) AS route, NULL AS op, 0.85 AS confidence FROM src
    UNION ALL SELECT path, 6, 'spring', 'db.transaction', 'handle', NULL, NULL, 'method', 0.84 FROM src UNION ALL SELECT path, 8, 'jpa', 'db.write', 'orders', NULL, NULL, 'save', 0.82 FROM src
    UNION ALL SELECT path, 9, 'jpa', 'db.read', CASE WHEN page_id % 2 = 0 THEN 'em' ELSE 'orders' END, NULL, NULL, CASE WHEN page_id % 2 = 0 THEN 'find' ELSE 'findAll' END, CASE WHEN page_id % 2 = 0 THEN 0.84 ELSE 0.82 END FROM src
    UNION ALL SELECT path, 10, 'spring_kafka', 'queue.dispatch', 'topic', NULL, NULL, NULL, 0.82 FROM src) SELECT path, start_line, framework, kind, name, method, route, op, CAST(confidence AS DOUBLE) AS confidence FROM f"""
)
def source_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes, transactions, data access and queues of Java sources."""
    return parsed.structure(files(spark, sf_dir, JAVA)).select("path", "start_line", "framework", "kind", "name", "method", "route", "op", "confidence")


PYTHON = source(
    "concat('app/', page_id, '.py')",
    lines("from fastapi import FastAPI, APIRouter", "from django.db import transaction", "app = FastAPI()", "concat('@app.get(\"/items/', page_id % 6, '\")')", "def show(item):", "    with transaction.atomic():", "        return item", "CASE WHEN page_id % 4 = 0 THEN 'def broken(:' ELSE 'x = 1' END"),
)


@query(
    f"""WITH {cte(PYTHON)}, f AS (SELECT path, 4 AS start_line, 'fastapi' AS framework, 'api.route' AS kind, 'GET' AS method, concat('/items/', page_id % 6) AS route, 'show' AS scope FROM src WHERE page_id % 4 <> 0
    UNION ALL SELECT path, 6, 'django', 'db.transaction', NULL, NULL, 'show' FROM src WHERE page_id % 4 <> 0 UNION ALL SELECT path, NULL, NULL, 'parse_error', NULL, NULL, NULL FROM src WHERE page_id % 4 = 0)
    SELECT path, start_line, framework, kind, method, route, scope FROM f"""
)
def source_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and transactions of Python sources with their function; a file that can't be parsed is told."""
    return parsed.structure(files(spark, sf_dir, PYTHON)).select("path", "start_line", "framework", "kind", "method", "route", "scope")


SNIPPETS = source(
    "concat('api/', page_id, '.py')",
    """CASE page_id % 8 WHEN 0 THEN concat('@login', chr(10), '@app.get("/items/', page_id, '")', chr(10), 'def f(): pass') WHEN 1 THEN concat('@router.delete( "/old/', page_id % 5, '" )')
    WHEN 2 THEN concat('@bp.route("/flask/', page_id % 9, '", methods=["POST", "GET"])') WHEN 3 THEN concat('@app.route("/plain/', page_id % 9, '")') WHEN 4 THEN concat('patch /words/', page_id % 6, ' rest')
    WHEN 5 THEN '@app.get(PATH)' WHEN 6 THEN 'alone' ELSE concat('@app.put("/ignored/', page_id, '")') END""",
)


@query(
    """WITH m AS (SELECT page_id, page_id % 8 AS k FROM pages)
    SELECT page_id, CASE k WHEN 0 THEN 'GET' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'POST' WHEN 3 THEN 'GET' WHEN 4 THEN 'PATCH' WHEN 7 THEN 'HEAD' END AS method,
    CASE k WHEN 0 THEN concat('/items/', page_id) WHEN 1 THEN concat('/old/', page_id % 5) WHEN 2 THEN concat('/flask/', page_id % 9) WHEN 3 THEN concat('/plain/', page_id % 9) WHEN 4 THEN concat('/words/', page_id % 6) WHEN 7 THEN '/own' END AS route FROM m"""
)
def source_surface_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method and route of API finds, where missing from their snippets: decorators, then the first two words."""
    own = F.col("page_id") % 8 == 7
    method, route = surface.recovered(F.when(own, "head"), F.when(own, "/own"), F.col("content"))
    return files(spark, sf_dir, SNIPPETS).select("page_id", method.alias("method"), route.alias("route"))
