"""Statement digests, case by case."""

import pytest

from fleetvitals.functions.statements import digest_text
from fleetvitals.operators import workload
from fleetvitals.sources import parse
from fleetvitals.streaming import digests

CASES = [
    ("SELECT  * FROM t1 WHERE id = 5 AND flag = 'A'", "SELECT * FROM t1 WHERE id = ? AND flag = ?"),
    ("select * from T where a='it''s' and b='a\\'b' and c=\"x\\\"y\"", "SELECT * FROM T WHERE a=? AND b=? AND c=?"),
    ("SELECT 1.5e-10, .5, 2., 0xFF, 0b01, x'4D', _utf8mb4'ä', N'n' FROM t2x", "SELECT ?, ?, ?, ?, ?, ?, ?, ? FROM t2x"),
    ("SELECT a FROM t WHERE id IN (1)", "SELECT a FROM t WHERE id IN (...)"),
    ("SELECT a FROM t WHERE id IN (1, 2,3 , 4)", "SELECT a FROM t WHERE id IN (...)"),
    ("SELECT a FROM t WHERE id IN(  'x' ,\n'y')", "SELECT a FROM t WHERE id IN (...)"),
    ("INSERT INTO t (a, b) VALUES (1, 'x')", "INSERT INTO t (a, b) VALUES (...)"),
    ("INSERT INTO t (a, b) VALUES (1, 'x'), (2, 'y'),(3,NULL)", "INSERT INTO t (a, b) VALUES (...) /* , ... */"),
    ("INSERT INTO t VALUES (1),(2)", "INSERT INTO t VALUES (?) /* , ... */"),
    ("SELECT /* hint */ a -- end\nFROM t # more\nWHERE b = 1;", "SELECT a FROM t WHERE b = ?"),
    ("SELECT /*!50001 SQL_NO_CACHE */ a FROM t", "SELECT SQL_NO_CACHE a FROM t"),
    ("SELECT '-- no comment', '/* none */', '#' FROM t", "SELECT ?, ?, ? FROM t"),
    ("SELECT `order 1`, `it's`, `a``b` FROM `t 2` WHERE `c`=3", "SELECT `order 1`, `it's`, `a``b` FROM `t 2` WHERE `c`=?"),
    ("SELECT a FROM t WHERE b = -5 AND c > - 3.2 AND d - 1 = +2", "SELECT a FROM t WHERE b = ? AND c > ? AND d - ? = ?"),
    ("SELECT a-1 FROM t LIMIT 10, 20", "SELECT a-? FROM t LIMIT ?, ?"),
    ("UPDATE t SET a = NULL, b = 1 WHERE c IS NULL AND d IS NOT NULL", "UPDATE t SET a = ?, b = ? WHERE c IS NULL AND d IS NOT NULL"),
    ("SELECT @v1, t.c1, db2.t3.c4, 5c FROM 2nd_table", "SELECT @v1, t.c1, db2.t3.c4, 5c FROM 2nd_table"),
    ("Select Count(*) From orders Where State = 'a' Or `From` = 2", "SELECT COUNT(*) FROM orders WHERE State = ? OR `From` = ?"),
    ("SELECT f(1, 2), g(3) FROM t", "SELECT f(...), g(?) FROM t"),
    ("SELECT 'never closed FROM t WHERE a = 1", "SELECT 'never closed FROM t WHERE a = ?"),
    ("  ;  ", ""),
    ("", ""),
    (None, None),
]


@pytest.fixture(scope="module")
def normal_forms(spark):
    rows = spark.createDataFrame([(i, sql) for i, (sql, _) in enumerate(CASES)], "i int, sql string")
    return {r.i: r.d for r in rows.select("i", digest_text("sql").alias("d")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_normal_form(normal_forms, i):
    assert normal_forms[i] == CASES[i][1]


def test_a_normal_form_is_its_own(spark):
    rows = spark.createDataFrame([(d,) for _, d in CASES if d and "/*" not in d], "d string")
    assert all(r.again == r.d for r in rows.select("d", digest_text("d").alias("again")).collect())


def entry(day, sql, seconds):
    return f"# Time: 2026-01-{day:02d}\n# User@Host: a[a] @ [x]\n# Query_time: {seconds}  Lock_time: 0.1 Rows_sent: 1  Rows_examined: 9\nuse shop;\n{sql};\n"


def test_days_one_after_the_other_equal_one_batch(spark, tmp_path):
    folder = tmp_path / "logs" / "shop" / "10.0.0.7"
    folder.mkdir(parents=True)
    state, totals = str(tmp_path / "state"), str(tmp_path / "totals")
    assert digests.digest_totals(spark, totals) is None
    days = [
        entry(1, "SELECT 1", 0.5) + entry(1, "SELECT a FROM t WHERE b IN (1, 2)", 2.0),
        entry(2, "SELECT 22", 1.5) + entry(2, "DELETE FROM t", 1.0),
        entry(3, "SELECT a FROM t WHERE b IN (7)", 4.25),
    ]
    seen = []
    for day, text in enumerate(days):
        (folder / f"slow-{day}.log").write_text(text)
        got = digests.roll_up_new_logs(spark, str(tmp_path / "logs"), totals, state, files_per_batch=1)
        seen.append(sorted(map(tuple, got.select("cluster_id", "node_ip", "query", "exec_count", "total_us", "max_us", "rows_examined", "first_seen", "last_seen").collect())))
    assert seen[-1] == [
        ("shop", "10.0.0.7", "DELETE FROM t", 1, 1_000_000, 1_000_000, 9, "2026-01-02", "2026-01-02"),
        ("shop", "10.0.0.7", "SELECT ?", 2, 2_000_000, 1_500_000, 18, "2026-01-01", "2026-01-02"),
        ("shop", "10.0.0.7", "SELECT a FROM t WHERE b IN (...)", 2, 6_250_000, 4_250_000, 18, "2026-01-01", "2026-01-03"),
    ]
    # Nothing new: nothing is read again, and the totals stay.
    again = digests.roll_up_new_logs(spark, str(tmp_path / "logs"), totals, state)
    assert again.agg({"exec_count": "sum"}).first()[0] == 5
    whole = digests.roll_up_new_logs(spark, str(tmp_path / "logs"), str(tmp_path / "whole"), str(tmp_path / "whole-state"))
    columns = whole.columns
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, again.select(columns).collect()))
    assert len(list((tmp_path / "totals").iterdir())) <= 2


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    """The last version is lost with its mark of success: the batch that the stream repeats starts from the one before."""
    statements = spark.createDataFrame([("c", "n", "d", "SELECT 1", 5, "x"), ("c", "n", "d", "SELECT 2", 7, "y")], "cluster_id string, node_ip string, db string, sql string, latency_us long, seen_at string")
    one = workload.digest_statements(statements, digests.NODE_KEYS)
    both = workload.merge_digests(one.unionByName(one), digests.NODE_KEYS).first()
    assert (both["exec_count"], both["total_us"], both["max_us"], both["first_seen"], both["last_seen"], both["avg_us"]) == (4, 24, 7, "x", "y", 6.0)
    one.write.parquet(str(tmp_path / "batch=0"))
    one.write.parquet(str(tmp_path / "batch=1"))
    (tmp_path / "batch=1" / "_SUCCESS").unlink()
    assert digests.digest_totals(spark, str(tmp_path)).first()["exec_count"] == 2
    assert [n for n, _ in digests._folders(spark, str(tmp_path))] == [0]


def test_an_entry_is_parsed_once(spark, tmp_path):
    """The plan holds the pattern of the timing line once: no filter on the entries parses them again."""
    folder = tmp_path / "shop" / "10.0.0.7"
    folder.mkdir(parents=True)
    (folder / "slow.log").write_text(entry(1, "SELECT 1", 0.5) + entry(2, "SELECT 22", 1.5) + "# Time: 2026-01-03\n# User@Host: b[b] @ [y]\n")
    entries = parse.read_slow_logs(spark, str(tmp_path), "2026-01-05")
    assert sorted(map(tuple, entries.select("cluster_id", "node_ip", "time", "sql", "query_s").collect())) == [
        ("shop", "10.0.0.7", "2026-01-01", "SELECT 1;", 0.5), ("shop", "10.0.0.7", "2026-01-02", "SELECT 22;", 1.5)
    ]
    assert entries._jdf.queryExecution().optimizedPlan().toString().count("Query_time:") == 1


def test_a_digest_tries_its_patterns_once(spark):
    """Every step's pattern is written once, though steps are taken only for texts that hold what they change."""
    plan = spark.createDataFrame([("a",)], "d string").select(digest_text("d").alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("LIMIT|OFFSET|BETWEEN|AND|OR|LIKE|SET|BY") == 1
    # Ends of lines that are no white space stay, as a pattern that ends in $ leaves them.
    texts = spark.createDataFrame([("SELECT a; ",), ("SELECT a \t; ;",), ("SELECT\u0085;",)], "d string")
    assert [r.d for r in texts.select(digest_text("d").alias("d")).collect()] == ["SELECT a ", "SELECT a", "SELECT\u0085"]
