import json
import threading
import time
import urllib.request
from urllib.error import HTTPError

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from tidewell import cli
from tidewell.functions import dialect
from tidewell.plans import guard, params
from tidewell.plans.pipeline import Engine, Pipeline, PipelineError, RequestError, load_all, rows_to_json
from tidewell.plans.text import in_code, parts, split_arguments, statements
from tidewell.server import Service, server
from tidewell.sources.context import Source

@pytest.fixture
def sales(spark):
    for name in ("orders", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").createOrReplaceTempView(name)


@given(st.text(alphabet="ab'\"`-/*{} \n;\\", max_size=40))
def test_parts_lose_nothing(sql):
    assert "".join(t for _, t in parts(sql)) == sql
    assert in_code(sql, lambda c: c) == sql


def test_parameters_outside_quotes_and_comments():
    sql = "SELECT '{a}' AS x -- {b}\n FROM t WHERE c = {c} /* {d} */ AND c2 > {c} AND \"{e}\" = {f}"
    assert params.names(sql) == ["c", "f"]
    assert params.misplaced(sql) == ["a"]


def test_parameter_columns_and_types(spark, sales):
    sql = """SELECT * FROM orders WHERE o_orderstatus IN ({open}, {done}) AND {least_total} < o_totalprice AND NOT o_orderpriority LIKE {urgency}
             AND o_orderdate BETWEEN {since} AND current_date() AND o_custkey = {customer} LIMIT {page}"""
    found = {p.name: (p.column, p.type.simpleString()) for p in params.infer(spark, sql)}
    assert found == {
        "open": ("o_orderstatus", "string"), "done": ("o_orderstatus", "string"), "least_total": ("o_totalprice", "double"), "urgency": ("o_orderpriority", "string"),
        "since": ("o_orderdate", "timestamp_ntz"), "customer": ("o_custkey", "bigint"), "page": ("limit", "bigint"),
    }


@pytest.mark.parametrize("name,column", [("min_price", "price"), ("price_max", "price"), ("max_price", "price"), ("price_min", "price"), ("brand", "brand")])
def test_names_hint_at_columns(name, column):
    assert params.by_affix(name) == column


def test_validation(spark, sales):
    good = params.validate(spark, "SELECT p_partkey, p_retailprice FROM part WHERE p_brand = {brand}")
    assert good.valid and len(good.parameters) == 1 and good.fields == ["p_partkey", "p_retailprice"]
    assert not params.validate(spark, "SELEC x FRM").valid
    missing = params.validate(spark, "SELECT x FROM nowhere_at_all WHERE y = {y}")
    assert missing.valid and missing.warnings and len(missing.parameters) == 1


ACCESS = {"users": "read_only", "orders": "read_write"}


@pytest.mark.parametrize("sql", [
    "CREATE TABLE t (a int)", "CREATE INDEX i ON t (a)", "create view v as select 1", "DROP TABLE users", "DROP INDEX i", "ALTER TABLE t ADD COLUMN b int", "TRUNCATE TABLE t",
    "INSERT INTO users VALUES (1)", "insert into USERS (id) select 1", "UPDATE users SET a = 1", "DELETE FROM Users WHERE a = {a}", "SELECT 1; DROP TABLE t",
    "MERGE INTO users u USING orders o ON u.id = o.id WHEN MATCHED THEN DELETE", "FROM orders INSERT INTO users SELECT *", "FROM orders INSERT INTO orders SELECT * INSERT INTO users SELECT *",
    "LOAD DATA INPATH 'x' INTO TABLE users", "REPLACE TABLE users AS SELECT 1", "CREATE OR REPLACE TABLE orders AS SELECT 1", "INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT 1",
    "INSERT OVERWRITE users SELECT 1", "WITH a AS (SELECT 1) INSERT INTO users SELECT * FROM a", "ALTER DATABASE d SET LOCATION 'x'", "ADD JAR 'x.jar'", "SET a = b", "RESET", "CACHE TABLE users",
    "UNCACHE TABLE users", "REFRESH TABLE users", "ANALYZE TABLE users COMPUTE STATISTICS", "USE d", "CREATE FUNCTION f AS 'x'", "CREATE TEMPORARY FUNCTION f(x INT) RETURNS INT RETURN x", "CREATE SEQUENCE s", "COPY (SELECT 1) TO 'x'",
    "SELECT FROM WHERE", "SELEC * FROM t", "INSERT INTO", "COPY users TO 'x'",
])
def test_guard_rejects(spark, sql):
    with pytest.raises(guard.GuardError):
        guard.check(spark, sql, ACCESS)


@pytest.mark.parametrize("sql", [
    "", "SELECT * FROM users WHERE id = {id} LIMIT {n}", "INSERT INTO orders (a) VALUES ({a})", "INSERT INTO orders SELECT * FROM users", "UPDATE orders SET a = {a} WHERE b = 1",
    "WITH a AS (SELECT 1) INSERT INTO orders SELECT * FROM a", "INSERT OVERWRITE orders SELECT 1", "FROM users INSERT INTO orders SELECT *", "SHOW TABLES", "DESCRIBE users", "EXPLAIN SELECT 1", "VALUES (1)", "-- nothing",
    "SELECT a FROM users QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) = {n}", "SELECT x FROM knn('v', 'e', (SELECT e FROM v WHERE id = {id}), 3) AS k",
    "DELETE FROM unknown_table", "SELECT 'DROP TABLE x; ' AS t", "SELECT 1; SELECT 2",
])
def test_guard_allows(spark, sql):
    guard.check(spark, sql, ACCESS)


def test_dialect(spark):
    run = lambda s: spark.sql(dialect.translate(s)).collect()
    assert run('SELECT a[1] AS "X y" FROM (SELECT [1, 2, 3] AS a)')[0]["X y"] == 2
    assert run("SELECT array_agg(x ORDER BY t DESC) AS a FROM VALUES (1, 'p'), (2, NULL), (3, 'r') AS v(t, x)")[0]["a"] == ["r", None, "p"]
    assert sorted(r.v for r in run("SELECT DISTINCT ON (k) k, v FROM VALUES (1, 5), (1, 3), (2, 9) AS t(k, v) ORDER BY k, v")) == [3, 9]
    assert dialect.remote_urls("SELECT * FROM 's3://b/x.csv' JOIN 'gs://c/y'") == ["s3://b/x.csv", "gs://c/y"]
    assert dialect.hadoop_path("s3://b/x") == "s3a://b/x"
    assert split_arguments("'a,b', f(1, 2), [3, 4]") == ["'a,b'", "f(1, 2)", "[3, 4]"]
    assert statements("a; b -- ;\n; ';'") == ["a", "b -- ;", "';'"]


def test_operators_and_types(engine):
    one = lambda e: engine.sql(f"SELECT {e} AS x").first().x
    assert (one("7/2"), one("7/2/2"), one("7/2.0"), one("(1 + 6) / (8 / 4)"), one("CAST(7 AS DOUBLE) / 2"), one("7 / CAST(2 AS BIGINT)")) == (3, 1, 3.5, 3, 3.5, 3)
    assert one("'a/b'") == "a/b" and one("6 / (SELECT max(user_id) FROM people)") == 2
    assert one("concat('a', NULL, 1)") == "a1" and one("'5'::varchar || 'x'") == "5x" and one("CAST(5 AS TEXT)") == "5"
    assert (one("'abc' ~ 'b'"), one("'abc' ~* 'B'"), one("'abc' !~ 'b'"), one("'abc' !~* 'X'"), one("'abc' SIMILAR TO 'a%'"), one("'abc' SIMILAR TO 'b_'")) == (True, True, False, True, True, False)
    assert one("~5") == -6
    assert (one("regexp_replace('aXbX', 'X', '-')"), one("regexp_replace('aXbX', 'x', '-', 'gi')"), one("regexp_match('ab12', '[0-9]+')")) == ("a-bX", "a-b-", ["12"])
    assert (one("gcd(84, 36)"), one("lcm(4, 6)"), one("iszero(0)"), one("trunc(-2.7)"), one("trunc(2.567, 2)"), one("to_hex(255)"), one("log(100)")) == (12, 12, True, -2.0, 2.56, "ff", 2.0)
    assert one("trunc(DATE '2024-05-17', 'MM')").isoformat() == "2024-05-01"
    assert one("to_char(TIMESTAMP_NTZ '2024-05-17 03:04:05', '%d.%m.%Y at %H')") == "17.05.2024 at 03"
    assert one("date_bin(INTERVAL '1 hour', TIMESTAMP_NTZ '2024-05-17 03:44:05', TIMESTAMP_NTZ '2024-01-01 00:30:00')").isoformat() == "2024-05-17T03:30:00"
    assert (one("array_position([1, 2], 9)"), one("array_remove([1, 2, 1], 1)"), one("array_slice([1, 2, 3], 2, 3)"), one("string_to_array('a.b', '.')"), one("list_distinct([1, 1])")) == (None, [2, 1], [2, 3], ["a", "b"], [1])
    assert (one("arrow_typeof(1)"), one("arrow_cast('7', 'Int64')"), one("get_field(named_struct('k', 4), 'k')"), one("encode('a', 'hex')")) == ("Int32", 7, 4, "61")


def test_blocks_at_any_depth(engine):
    rows = lambda s: [tuple(r) for r in engine.sql(s).collect()]
    values = "(VALUES (1, 'p', 5), (1, NULL, 3), (2, 'q', 9), (2, 'r', NULL)) AS t(k, s, v)"
    assert rows(f"SELECT k FROM {values} ORDER BY v DESC") == [(2,), (2,), (1,), (1,)]
    assert rows(f"SELECT v FROM {values} ORDER BY v") == [(3,), (5,), (9,), (None,)]
    assert rows(f"WITH a AS (SELECT k, s FROM {values} QUALIFY row_number() OVER (PARTITION BY k ORDER BY v) = 1) SELECT * FROM a UNION ALL SELECT 7, 'z' ORDER BY k") == [(1, None), (2, "q"), (7, "z")]
    assert rows(f"SELECT * FROM (SELECT DISTINCT ON (k) k, v FROM {values} ORDER BY k, v DESC) x ORDER BY k DESC") == [(2, None), (1, 5)]
    assert rows(f"SELECT array_agg(s ORDER BY k DESC, v) AS a, string_agg(s, '+' ORDER BY s DESC) AS b, first_value(s ORDER BY v DESC) AS c FROM (SELECT * FROM {values} WHERE v > 0)") == [(["q", None, "p"], "q+p", "q")]
    assert rows(f"SELECT k, array_agg(s) OVER (PARTITION BY k ORDER BY v) AS a FROM {values} WHERE k = 1 ORDER BY v") == [(1, [None]), (1, [None, "p"])]
    assert rows(f"SELECT k, array_agg(s) FILTER (WHERE v > 3) AS a FROM {values} WHERE k = 1 GROUP BY k") == [(1, ["p"])]
    assert rows(f"SELECT v, count(*) OVER (ORDER BY k GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM {values} WHERE v > 3 ORDER BY v") == [(5, 1), (9, 2)]
    assert rows("SELECT sum(value) AS s FROM generate_series(1, 4)") == [(10,)] and rows("SELECT x FROM unnest([4, 5]) AS u(x) ORDER BY x") == [(4,), (5,)]


@given(st.text(alphabet="aB1'\"`-/*(),.:~ \n", max_size=50))
def test_tokens_lose_nothing(sql):
    assert "".join(t for _, t in dialect.tokens(sql)) == sql


def test_requests_leave_no_view(engine, spark, tmp_path):
    spark.sql("SELECT 1 AS id, array(1.0F, 0.0F) AS v UNION ALL SELECT 2, array(0.0F, 1.0F)").write.parquet(f"{tmp_path}/vecs.parquet")
    found = Engine(spark, [Source("vecs", "vectors", path=f"{tmp_path}/vecs.parquet")])
    before = {t.name for t in spark.catalog.listTables()}
    at = f"{tmp_path}/vecs.parquet"
    assert found.sql(f"SELECT '{at}' AS src, id FROM '{at}' ORDER BY id").first().src == at
    text = "WITH me AS (SELECT v FROM vecs WHERE id = {id}) SELECT k.id FROM knn('vecs', 'v', (SELECT v FROM me), {k}) AS k"
    p = found.prepare(Pipeline.parse(f"metadata: {{name: n, version: 1}}\nquery: \"{text}\""))
    assert [r.id for r in found.execute(p, {"id": 2, "k": 1}).collect()] == [2] and found.execute(p, {"id": 77, "k": 1}).count() == 0
    assert {t.name for t in spark.catalog.listTables()} == before


def test_copy_and_created_tables(engine, tmp_path):
    assert engine.sql(f"COPY people TO '{tmp_path}/out.parquet'").first()["count"] == 3
    assert engine.sql(f"COPY (SELECT user_id, name FROM people WHERE user_id > {{least}}) TO '{tmp_path}/out.csv' STORED AS CSV", {"least": 1}).first()["count"] == 2
    engine.sql(f"CREATE EXTERNAL TABLE again STORED AS CSV LOCATION '{tmp_path}/out.csv' OPTIONS ('format.has_header' 'true')")
    assert engine.sql("CREATE TABLE names AS SELECT name FROM again").first()["count"] == 2
    assert sorted(r.name for r in engine.sql("SELECT * FROM names").collect()) == ["Bob", "Charlie"]


YAML = "metadata: !Metadata\n  name: find\n  version: '1'\n  author: x\nquery: !Query |\n  SELECT user_id, name, category FROM people WHERE user_id = {user_id} AND category = {category}\n"


@pytest.fixture
def engine(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("user_id,name,category\n1,Alice,premium\n2,Bob,basic\n3,Charlie,\n")
    return Engine(spark, [Source("people", "csv", path=str(path))])


def test_pipeline_end_to_end(engine):
    p = engine.prepare(Pipeline.parse(YAML))
    assert [(x.name, x.type.simpleString()) for x in p.request] == [("user_id", "bigint"), ("category", "string")]
    assert p.response.names == ["user_id", "name", "category"]
    assert rows_to_json(engine.execute(p, {"user_id": 1, "category": "premium", "extra": 5})) == [{"user_id": 1, "name": "Alice", "category": "premium"}]
    assert rows_to_json(engine.execute(p, {"user_id": 1, "category": "x' OR '1'='1"})) == []
    with pytest.raises(RequestError):
        engine.execute(p, {"user_id": 1})
    with pytest.raises(RequestError):
        engine.execute(p, {"user_id": [1], "category": "x"})
    assert rows_to_json(engine.sql("SELECT category FROM people WHERE user_id = 3")) == [{"category": None}]
    assert Pipeline.parse(p.to_yaml()).query == p.query


def test_pipeline_folder(tmp_path):
    with pytest.raises(PipelineError):
        load_all(str(tmp_path))
    (tmp_path / "b.yaml").write_text(YAML)
    (tmp_path / "a.yml").write_text(YAML.replace("find", "first"))
    (tmp_path / "c.txt").write_text("no")
    assert [p.metadata.name for p in load_all(str(tmp_path))] == ["first", "find"]
    (tmp_path / "d.yaml").write_text(YAML)
    with pytest.raises(PipelineError):
        load_all(str(tmp_path))


def test_http_service(engine):
    service = Service(engine, [Pipeline.parse(YAML)])
    http = server(service, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, None if body is None else json.dumps(body).encode())) as r:
                return r.status, json.loads(r.read())
        except HTTPError as e:
            return e.code, json.loads(e.read())

    assert call("/health")[1]["status"] == "healthy"
    assert call("/health/find")[1]["data_sources"]["healthy"] == 1
    assert call("/pipelines")[1]["count"] == 1
    assert call("/pipeline/find")[1]["pipeline"]["endpoint"] == "/find/execute"
    assert call("/data_source")[1]["data"][0]["tables"][0]["schema"][0] == {"name": "user_id", "type": "bigint", "nullable": True}
    status, body = call("/find/execute", {"user_id": 2, "category": "basic"})
    assert status == 200 and body["rows"] == 1 and body["data"][0]["name"] == "Bob"
    assert call("/find/execute", {"user_id": 2})[0] == 400
    assert call("/none/execute", {})[0] == 404
    http.shutdown()


def test_cli(spark, tmp_path, capsys):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,x\n2,\n")
    assert cli.main(["query", "--sql", f"SELECT a, b FROM '{path}' ORDER BY a", "--master", "local[2]"]) == 0
    assert "2 row(s) returned" in capsys.readouterr().out
    ctx = tmp_path / "ctx.yaml"
    ctx.write_text(f"data_sources:\n  - name: xs\n    type: csv\n    path: {path}\n")
    cli.main(["query", "--ctx", str(ctx), "--schema", "--all"])
    assert capsys.readouterr().out.startswith("table: xs\n  a: bigint")
    with pytest.raises(SystemExit):
        cli.main(["query", "--ctx", "nowhere.yaml", "--sql", "SELECT 1"])
    assert time.time() > 0
