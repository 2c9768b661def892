import json
import subprocess
import sys

import pytest
from pyspark.sql import types as T

from tidewell.functions import models, onnx_file
from tidewell.operators.knn import KnnError, VectorTables, knn, rewrite
from tidewell.plans.pipeline import Engine
from tidewell.sources import context, docstore, iceberg, iceberg_table, jdbc, kvstore
from tidewell.sources.context import Access, ContextError, Source
from tidewell.streaming.windows import windowed_counts


def test_context_checks(tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("x\n1\n")
    ok = Source("a", "csv", path=str(f))
    context.check([ok])
    for bad in (
        [ok, ok],
        [Source("b", "csv", path="/no/such")],
        [Source("b", "postgres")],
        [Source("b", "csv", path=str(f), access_mode=Access.READ_WRITE)],
        [Source("b", "what", path=str(f))],
    ):
        with pytest.raises(ContextError):
            context.check(bad)
    parsed = context.parse("data_sources:\n - {name: m, type: mongo, connection_string: x, access_mode: read_write, options: {table: t, has_header: true}}")
    assert parsed[0].access_mode is Access.READ_WRITE and parsed[0].options["has_header"] == "true"


def test_s3_settings():
    s = Source("s", "parquet", path="s3://b/x")
    with pytest.raises(ContextError):
        context.check_s3(s, {})
    with pytest.raises(ContextError):
        context.check_s3(s, {"AWS_REGION": "r"})
    assert context.check_s3(s, {"AWS_REGION": "r", "AWS_PROFILE": "p"}) == {"fs.s3a.endpoint.region": "r"}
    with pytest.raises(ContextError):
        context.check_s3(Source("s", "parquet", path="s3://b/x", options={"aws_region": "r"}), {"AWS_REGION": "r", "AWS_PROFILE": "p"})


def test_csv_options(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("1|x\n2|y\n")
    df = context.read_csv(spark, str(f), {"has_header": "false", "delimiter": "|", "schema_infer_max_records": "1"})
    assert [c.dataType.simpleString() for c in df.schema] == ["bigint", "string"] and df.count() == 2
    assert context.read_csv(spark, str(f), {"delimiter": "|", "has_header": "maybe"}).count() == 1
    assert context.read_csv(spark, str(f), {"delimiter": "|", "has_header": "false"}, {"a": "Float64", "b": "Utf8"}).dtypes == [("a", "double"), ("b", "string")]


def test_database_urls():
    env = {"U": "me", "P": "p@ss"}
    assert jdbc.jdbc_url("postgres", "postgresql://h/db?sslmode=require", {"user_env": "U", "pass_env": "P"}, env) == ("jdbc:postgresql://h:5432/db?sslmode=require", {"user": "me", "password": "p@ss"})
    assert jdbc.jdbc_url("mysql", "mysql://a:b%40@h/db/more", {"ssl_mode": "REQUIRED"}, env) == ("jdbc:mysql://h:3306/db", {"user": "a", "password": "b@", "sslMode": "required"})
    with pytest.raises(jdbc.DatabaseError):
        jdbc.jdbc_url("postgres", "postgresql://h/db", {"user_env": "NOPE"}, env)
    assert jdbc.with_credentials("postgresql://x@h:1/db?a=b", "u", "p/w") == "postgresql://u:p%2Fw@h:1/db?a=b"
    assert docstore.uri("mongodb://h/db", "u", "p@") == "mongodb://u:p%40@h:27017/db"
    assert docstore.uri("mongodb+srv://h/db") == "mongodb+srv://h/db"


def test_database_reads_and_writes(spark, tmp_path):
    url = "jdbc:derby:memory:shop;create=true"
    db = jdbc.Database(spark, url)
    db.execute('CREATE TABLE users (id INT GENERATED ALWAYS AS IDENTITY, name VARCHAR(20), score DOUBLE)')
    csv = tmp_path / "n.csv"
    csv.write_text("who,points\nann,1.5\nbob,2.5\nann,3.0\n")
    users = Source("users", "jdbc", connection_string=url, options={"dbtable": "users"}, access_mode=Access.READ_WRITE)
    engine = Engine(spark, [Source("points", "csv", path=str(csv)), users])
    assert [c.lower() for c in db.auto_columns("USERS")] == ["id"]
    insert = engine.sql("INSERT INTO users (name, score) SELECT who, sum(points) FROM points WHERE points > {least} GROUP BY who", {"least": 0.0})
    assert insert.first()["count"] == 2
    assert engine.sql("INSERT INTO users (name, score) VALUES ({n}, {s})", {"n": "o'hara", "s": 9.0}).first()["count"] == 1
    assert engine.sql("UPDATE users SET score = {s} WHERE name = {n}", {"s": 7.0, "n": "bob"}).first()["count"] == 1
    assert engine.sql("DELETE FROM users WHERE name = {n}", {"n": "ann"}).first()["count"] == 1
    rows = engine.sql("SELECT u.name, u.score, p.points FROM users u LEFT JOIN points p ON p.who = u.name ORDER BY u.name").collect()
    assert [tuple(r) for r in rows] == [("bob", 7.0, 2.5), ("o'hara", 9.0, None)]
    with pytest.raises(jdbc.DatabaseError):
        db.update("users", {})
    assert db.insert("users", spark.createDataFrame([(5, "z", 1.0)], "id int, name string, score double"), overwrite=True) == 1
    assert db.delete("users") == 1
    db.execute("INSERT INTO users (name, score) VALUES ('kept', 1.0)")
    with pytest.raises(Exception):  # noqa: B017  a name too long for its column: the old rows are still there
        db.insert("users", spark.createDataFrame([("x" * 50, 1.0)], "name string, score double"), overwrite=True)
    assert engine.sql("SELECT name FROM users").first().name == "kept"
    assert engine.sql("INSERT OVERWRITE users (name, score) SELECT who, points FROM points").first()["count"] == 3 and engine.sql("SELECT * FROM users").count() == 3


_WITH_EXECUTORS = """
import sys
from tidewell.plans.pipeline import Engine
from tidewell.session import session
from tidewell.sources import jdbc
from tidewell.sources.context import Access, Source

spark = session("local-cluster[2,1,1024]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{sys.argv[1]}"})
jdbc.HELD_ROWS = 700
url = "jdbc:derby:memory:apart;create=true"
db = jdbc.Database(spark, url)
db.execute("CREATE TABLE t (id INT GENERATED ALWAYS AS IDENTITY, k BIGINT, name VARCHAR(5), t TIMESTAMP, price DECIMAL(10,2))")
spark.range(2000).repartition(3).createOrReplaceTempView("r")
engine = Engine(spark, [Source("t", "jdbc", connection_string=url, options={"dbtable": "t"}, access_mode=Access.READ_WRITE)])
rows = "SELECT id AS k, CASE WHEN id % 2 = 0 THEN 'even' ELSE '' END AS name, TIMESTAMP'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS t, CASE WHEN id % 3 > 0 THEN CAST(id * 0.25 AS DECIMAL(10,2)) END AS price FROM r"
want = sorted(map(tuple, spark.sql(rows).collect()), key=repr)
got = lambda: sorted(map(tuple, engine.sql("SELECT k, name, t, price FROM t").collect()), key=repr)
assert got() == []
for java8 in ("false", "true"):
    spark.conf.set("spark.sql.datetime.java8API.enabled", java8)
    assert engine.sql(f"INSERT INTO t (k, name, t, price) {rows}").first()["count"] == 2000
    assert got() == want, "rows read differ from those written"
    before = engine.sql("SELECT k FROM t")
    assert engine.sql("UPDATE t SET k = -1 WHERE k < {least}", {"least": 500}).first()["count"] == 500
    assert engine.sql("SELECT k FROM t WHERE k = -1").count() == 500 and before.filter("k = -1").count() == 0
    try:
        engine.sql("INSERT INTO t (k, name) SELECT id, CASE WHEN id = 1999 THEN 'too long' ELSE '' END FROM r")
        raise SystemExit("a name too long was taken")
    except Exception as e:
        assert "too long" in str(e), e
    assert engine.sql("SELECT * FROM t").count() == 2000, "a part of a failed INSERT stayed"
    assert engine.sql("INSERT OVERWRITE t (k, name) SELECT k, name FROM t WHERE k < 0").first()["count"] == 500
    assert engine.sql("SELECT DISTINCT k FROM t").first().k == -1 and db.delete("t") == 500 and got() == []
print("done")
"""


def test_embedded_database_with_executors_apart(tmp_path):
    """Only the driver sees the database: rows that executors read or make go through it, and none is lost."""
    run = subprocess.run([sys.executable, "-c", _WITH_EXECUTORS, f"{tmp_path}/shared"], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert run.stdout.endswith("done\n"), run.stderr[-3000:]


def test_markers_and_casts():
    assert jdbc.positional("UPDATE t SET a = :a::int WHERE b = ':b' AND c = :c", {"a": 1, "c": 2}) == ("UPDATE t SET a = ?::int WHERE b = ':b' AND c = ?", [1, 2])


def test_documents(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    root = str(tmp_path)
    (tmp_path / "products.schema.json").write_text(json.dumps({"$jsonSchema": {"required": ["name"], "properties": {"product_id": {"bsonType": "string"}, "name": {"bsonType": "string"}, "price": {"bsonType": "double"}, "n": {"bsonType": "int"}}}}))
    source = Source("products", "mongo", connection_string=root, options={"table": "products", "primary_key": "product_id"}, access_mode=Access.READ_WRITE)
    engine = Engine(spark, [source])
    assert engine.sql("INSERT INTO products (product_id, name, price) SELECT * FROM (VALUES ('a', 'x', 1.5), ('b', NULL, 2.5)) AS t(i, n, p)").first()["count"] == 2
    engine.sql("INSERT INTO products (product_id, name, price) VALUES ('a', 'y', 3.5)")
    assert [tuple(r) for r in engine.sql("SELECT product_id, name, price, n FROM products ORDER BY product_id").collect()] == [("a", "y", 3.5, None), ("b", None, 2.5, None)]
    assert engine.sql("SELECT price FROM products WHERE product_id = 'b'").collect()[0][0] == 2.5
    with pytest.raises(docstore.DocumentError):
        engine.sql("DELETE FROM products WHERE product_id = 'a'")
    assert docstore.coerced(None, T.StringType()) == "" and docstore.coerced(2**31, T.IntegerType()) == -(2**31)
    assert docstore.coerced(2.9, T.LongType()) == 2 and docstore.coerced("x", T.DoubleType()) is None


def test_documents_in_a_session_that_pushes_no_filters(spark, tmp_path):
    docstore.upsert(spark.sql("SELECT string(id) AS code, id % 2 AS odd FROM range(9)"), str(tmp_path), "t", "code")
    source = Source("t", "mongo", connection_string=str(tmp_path), options={"collection": "t", "primary_key": "code"})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        engine = Engine(spark, [source])
        assert [tuple(r) for r in engine.sql("SELECT code, odd FROM t WHERE code = '3'").collect()] == [("3", 1)]
        assert sorted(r.code for r in engine.sql("SELECT code FROM t WHERE odd = 0").collect()) == ["0", "2", "4", "6", "8"]
        assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_key_lookups_in_a_session_without_the_setting(spark, tmp_path):
    docstore.upsert(spark.sql("SELECT string(id) AS code, id % 2 AS odd FROM range(9)"), str(tmp_path), "t", "code")
    source = Source("t", "mongo", connection_string=str(tmp_path), options={"collection": "t", "primary_key": "code"})
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    try:
        engine = Engine(spark, [source])
        (tmp_path / "t" / "5.json").write_text("whoever reads this fails")
        assert [tuple(r) for r in engine.sql("SELECT code, odd FROM t WHERE code = '3'").collect()] == [("3", 1)]
        with pytest.raises(Exception):  # noqa: B017  without a key all documents are read
            engine.sql("SELECT code FROM t WHERE odd = 0").collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_hashes(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("A1", "Widget", 10, 19.99, None), ("A2", "Gadget", 20, 29.95, b"\xff")], "order_id string, item string, qty int, price double, raw binary")
    assert kvstore.write(df, root, "orders", "order_id", overwrite=True) == 2
    store = kvstore.FolderHashes(root)
    assert store.scan("orders:") == ["orders:A1", "orders:A2"]
    assert store.get("orders:A1") == {"item": "Widget", "qty": "10", "price": "19.99", "raw": ""}
    got = kvstore.read(spark, root, {"table": "orders", "key_column": "order_id"}).orderBy("order_id").collect()
    assert [r.asdict() if hasattr(r, "asdict") else r.asDict() for r in got][1] == {"order_id": "A2", "item": "Gadget", "price": "29.95", "qty": "20", "raw": "ff"}
    assert kvstore.write(df.limit(1), root, "orders", "order_id", overwrite=True) == 1 and len(store.scan("orders:")) == 1
    with pytest.raises(kvstore.KeyValueError):
        kvstore.infer(store, "nothing", "id")


def test_hashes_by_insert(spark, tmp_path):
    df = spark.range(20).repartition(4)
    assert kvstore.write(df, str(tmp_path), "n") == 20 and len(kvstore.FolderHashes(str(tmp_path)).scan("n:")) == 20
    source = Source("n", "redis", connection_string=str(tmp_path), options={"table": "n", "key_column": "k"}, access_mode=Access.READ_WRITE)
    engine = Engine(spark, [source])
    assert engine.sql("INSERT INTO n (k, id) VALUES ('a', '1')").first()["count"] == 1
    assert engine.sql("SELECT id FROM n WHERE k = 'a'").first().id == "1"
    with pytest.raises(docstore.DocumentError):
        engine.sql("DELETE FROM n WHERE k = 'a'")


def test_stores_named_in_sql(spark, tmp_path):
    env = {"AWS_ACCESS_KEY_ID": "k", "AWS_SECRET_ACCESS_KEY": "s", "AWS_REGION": "r", "AZURE_STORAGE_ACCOUNT_NAME": "acc", "AZURE_STORAGE_ACCOUNT_KEY": "z"}
    assert context.url_settings("s3://b/x", env) == {"fs.s3a.access.key": "k", "fs.s3a.secret.key": "s", "fs.s3a.endpoint.region": "r"}
    assert context.url_settings("az://c/x", env) == {"fs.azure.account.key.acc.dfs.core.windows.net": "z"} and context.url_settings("gs://b/x", env) == {}
    context.check_reachable(spark, f"file://{tmp_path}")
    with pytest.raises(ContextError):
        context.check_reachable(spark, f"file://{tmp_path}/none")


def test_json_and_lance_by_path(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    engine = Engine(spark, [Source("told", "ndjson", path=f"{tmp_path}/x.ndjson")])
    assert [tuple(r) for r in engine.sql("SELECT a, b FROM told ORDER BY a").collect()] == [(1, "x"), (2, None)]
    spark.sql("SELECT 1 AS id, array(1.0F, 2.0F) AS v").write.parquet(f"{tmp_path}/near.lance")
    assert engine.sql(f"SELECT id FROM '{tmp_path}/near.lance'").first().id == 1
    assert engine.sql("SELECT id FROM knn('near', 'v', [1.0, 2.0], 1)").first().id == 1


def test_iceberg_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5), (3, "c", None)], "id long, old string, x double")
    iceberg_table.write(df.repartition(2), f"{tmp_path}/ns/t", renamed={"old": "new"}, version=101)
    source = Source("t", "iceberg", path=str(tmp_path), options={"namespace": "ns", "table": "t"})
    got = Engine(spark, [source]).sql("SELECT id, new, x FROM t ORDER BY id").collect()
    assert [tuple(r) for r in got] == [(1, "a", 1.5), (2, None, 2.5), (3, "c", None)]
    assert iceberg.metadata_file(f"{tmp_path}/ns/t").endswith("v101.metadata.json")


def test_iceberg_metadata(tmp_path):
    folder = tmp_path / "metadata"
    folder.mkdir()
    with pytest.raises(iceberg.IcebergError):
        iceberg.metadata_file(str(tmp_path))
    for name in ("00001-" + "a" * 8 + "-aaaa-aaaa-aaaa-" + "a" * 12 + ".metadata.json", "00003-" + "b" * 8 + "-bbbb-bbbb-bbbb-" + "b" * 12 + ".metadata.json", "x.txt"):
        (folder / name).write_text("{}")
    assert "00003-" in iceberg.metadata_file(str(tmp_path))
    for n in (1, 2, 3):
        (folder / f"v{n}.metadata.json").write_text("{}")
    assert iceberg.metadata_file(str(tmp_path)).endswith("v3.metadata.json")
    (folder / "version-hint.text").write_text("2")
    assert iceberg.metadata_file(str(tmp_path)).endswith("v2.metadata.json")


def test_knn(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [3.0, 4.0], "a"), (4, None, "a")], "id int, v array<float>, tag string")
    assert [(r.id, r._distance) for r in knn(df, "v", [0.0, 0.0], 2).collect()] == [(1, 0.0), (2, 1.0)]
    assert [r.id for r in knn(df, "v", [0.0, 0.0], 2, "tag = 'a'").collect()] == [1, 3]
    assert knn(df, "v", [0.0, 0.0], 2).columns == ["id", "tag", "_distance"]
    df.createOrReplaceTempView("vecs")
    tables = VectorTables({"vecs": "l2"})
    sql = rewrite(spark, "SELECT id FROM knn('vecs', 'v', (SELECT v FROM vecs WHERE id = 99), 3) k", tables)
    assert spark.sql(sql).count() == 0
    assert spark.sql(rewrite(spark, "SELECT id FROM lance_knn('vecs', 'v', array(3.0, 4.0), 1, 'id > 0') k", tables)).first().id == 3
    for bad in ("knn('vecs', 'v', array(1.0))", "knn(vecs, 'v', array(1.0, 2.0), 1)", "knn('none', 'v', array(1.0, 2.0), 1)", "knn('vecs', 'v', array(1.0, 2.0), 'k')"):
        with pytest.raises(KnnError):
            rewrite(spark, f"SELECT * FROM {bad}", tables)


def test_models(spark, tmp_path):
    models.register_linear(spark, "twice", 2.0, 1.0)
    assert [r.y for r in spark.sql("SELECT twice(x) AS y FROM VALUES (0.0F), (1.5F), (2.0F) AS t(x)").collect()] == [1.0, 4.0, 5.0]
    (tmp_path / "sum.onnx").write_bytes(onnx_file.sum_of_two())
    (tmp_path / "same.onnx").write_bytes(onnx_file.identity())
    whole, same = f"{tmp_path}/sum.onnx", f"{tmp_path}/same.onnx"
    models.register_onnx(spark)
    got = spark.sql(f"SELECT onnx_predict('{whole}', a, b) AS y FROM VALUES (1, 2), (3, 4), (NULL, 1) AS t(a, b)").collect()
    assert sorted((r.y for r in got), key=str) == [3.0, 7.0, None]
    lists = spark.sql(f"SELECT onnx_predict_list('{same}', array(1.0, 2.0), array(3.0, 4.0)) AS y").first()
    assert lists.y == [1.0, 3.0, 2.0, 4.0]
    # by the type of the argument, whatever its name
    typed = Engine(spark).sql(f"SELECT onnx_predict('{same}', xs, ys) AS y FROM (SELECT array(1.0, 2.0) AS xs, array(3.0, 4.0) AS ys)").first()
    assert typed.y == [1.0, 3.0, 2.0, 4.0]


def test_windows_in_batch_and_stream(spark, tmp_path):
    rows = spark.sql("SELECT TIMESTAMP'2024-01-01 00:10:00' + make_interval(0,0,0,0,id % 3) AS ts, 'a' AS event_type, CAST(id AS DOUBLE) AS value FROM range(9)")
    rows.write.parquet(f"{tmp_path}/events")
    batch = sorted(map(tuple, windowed_counts(rows).collect()))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/events"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("win").collect())) == batch and len(batch) == 3
