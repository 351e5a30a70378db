"""SQL semantics and refusals over small tables held in memory."""

import math
import re

import pyarrow as pa
import pytest

from quern.errors import AmbiguousNameError, ExecutionError, NotFoundError, PlanningError, UnsupportedError


@pytest.fixture
def db(session):
    sales = [(o + k, ("east", "west")[k], (10, 20)[k], (10.0 + o, 20.0 + o)[k]) for o in (0, 2, 4, 6) for k in (0, 1)]
    session.register_memory("sales", sales, "id bigint, region string, customer_id bigint, amount double", 4)
    session.register_memory("keyed", [("a", 1, 1.0), ("a", 1, 2.0), (None, 2, 3.0), ("a", 2, 4.0), ("b", 1, 5.0), (None, 2, 6.0)], "category string, code bigint, amount double", 2)
    session.register_memory("flags", [(True,), (False,), (None,)], "flag boolean")
    session.register_memory("customers", [(10, "gold"), (20, "silver")], "customer_id bigint, tier string")
    session.register_memory("gold", [(10, "gold")], "customer_id bigint, tier string")
    session.register_memory("lookup", [(10, "east", "east-10"), (20, "west", "west-20"), (None, "east", "null-key")], "customer_id bigint, region string, label string")
    session.register_memory("other", [(100, 10), (200, 20)], "id bigint, customer_id bigint")
    session.register_memory("empty", [], "id bigint, region string, amount double")
    session.register_memory("a", [(1, 10), (1, 11), (2, None), (None, 30)], "id bigint, value bigint", 2)
    session.register_memory("b", [(1, 10), (1, 11), (3, 300), (None, 30)], "id bigint, value bigint", 3)
    session.register_memory("narrow", [(1, 2.5)], "i int, f float")
    return session


def run(db, sql):
    return db.execute_sql(sql).rows()


def ordered(db, sql):
    return sorted(run(db, sql), key=lambda row: [(v is not None, v) for v in row])


def test_filter_sort_limit(db):
    assert run(db, "SELECT id FROM sales WHERE amount >= 22 ORDER BY id DESC LIMIT 3") == [(7,), (5,), (3,)]


def test_grouped(db):
    assert run(db, "SELECT region, COUNT(*) AS n, SUM(amount) AS s FROM sales GROUP BY region ORDER BY region") == [("east", 4, 52.0), ("west", 4, 92.0)]


def test_global_aggregates(db):
    assert run(db, "SELECT COUNT(DISTINCT region) AS r, AVG(amount) AS a, MIN(amount) AS lo, MAX(amount) AS hi FROM sales") == [(2, 18.0, 10.0, 26.0)]


def test_null_group_keys(db):
    assert ordered(db, "SELECT category, code, COUNT(*) AS n, SUM(amount) AS s FROM keyed GROUP BY category, code") == [(None, 2, 2, 9.0), ("a", 1, 2, 3.0), ("a", 2, 1, 4.0), ("b", 1, 1, 5.0)]


def test_empty_input(db):
    assert run(db, "SELECT COUNT(*) AS n, SUM(amount) AS s FROM empty") == [(0, None)]
    result = db.execute_sql("SELECT region, COUNT(*) AS n FROM empty GROUP BY region")
    assert result.rows() == [] and result.columns == ["region", "n"]


def test_three_valued_logic(db):
    assert run(db, "SELECT COUNT(*) AS n FROM flags WHERE flag OR NULL") == [(1,)]
    truth = run(db, "SELECT flag, flag AND FALSE AS a, flag OR TRUE AS o, flag AND NULL AS an, flag OR NULL AS orn, flag IS NULL AS n FROM flags ORDER BY flag")
    assert truth == [(False, False, True, False, None, False), (True, False, True, None, True, False), (None, False, True, None, None, True)]


def test_null_order_defaults(db):
    assert run(db, "SELECT value FROM a ORDER BY value")[-1] == (None,)
    assert run(db, "SELECT value FROM a ORDER BY value DESC")[0] == (None,)
    assert run(db, "SELECT value FROM a ORDER BY value NULLS FIRST")[0] == (None,)
    assert run(db, "SELECT value FROM a ORDER BY value DESC NULLS LAST")[-1] == (None,)


def test_order_by_a_number_is_a_constant(db):
    assert len(run(db, "SELECT id FROM sales ORDER BY 1 LIMIT 2")) == 2


def test_joins(db):
    assert run(db, "SELECT COUNT(tier) AS n, COUNT(*) AS rows FROM sales s LEFT JOIN gold g ON s.customer_id = g.customer_id") == [(4, 8)]
    inner = ordered(db, "SELECT s.id, l.label FROM sales s JOIN lookup l ON l.region = s.region AND s.customer_id = l.customer_id")
    assert [label for _, label in inner] == ["east-10", "west-20"] * 4
    assert ordered(db, "SELECT a.id, a.value, b.value AS other FROM a LEFT JOIN b ON a.id = b.id") == [(None, 30, None), (1, 10, 10), (1, 10, 11), (1, 11, 10), (1, 11, 11), (2, None, None)]
    assert ordered(db, "SELECT a.id, b.value FROM a LEFT JOIN b ON a.id = b.id AND a.value = b.value") == [(None, None), (1, 10), (1, 11), (2, None)]
    assert run(db, "SELECT x.id AS key, y.value AS result FROM a AS x JOIN b AS y ON x.id = y.id WHERE x.value > 10 ORDER BY result") == [(1, 10), (1, 11)]
    assert run(db, "SELECT e.id, b.value FROM empty e LEFT JOIN b ON e.id = b.id") == []
    assert run(db, "SELECT a.id, e.amount FROM a LEFT JOIN empty e ON a.id = e.id ORDER BY a.id") == [(1, None), (1, None), (2, None), (None, None)]
    assert run(db, "SELECT COUNT(b.value) AS n FROM a LEFT JOIN b ON a.value = b.id") == [(0,)]


def test_join_star_renames_clashes(db):
    result = db.execute_sql("SELECT * FROM sales s JOIN other o ON s.customer_id = o.customer_id")
    assert result.columns == ["id", "region", "customer_id", "amount", "right.id", "right.customer_id"]
    assert result.row_count == 8


def test_names(db):
    assert db.execute_sql("SELECT Sales.id, amount FROM Sales LIMIT 1").columns == ["id", "amount"]
    with pytest.raises(AmbiguousNameError):
        db.sql("SELECT id FROM sales s JOIN other o ON s.customer_id = o.customer_id")
    with pytest.raises(AmbiguousNameError):
        db.sql("SELECT s.id FROM sales s JOIN other o ON customer_id = o.customer_id")
    with pytest.raises(PlanningError, match="both tables"):
        db.sql("SELECT id FROM sales JOIN sales ON id = id")
    with pytest.raises(PlanningError, match="no column"):
        db.sql("SELECT ID FROM sales")
    with pytest.raises(PlanningError, match="no column"):
        db.sql("SELECT sales.id FROM sales AS s")
    with pytest.raises(PlanningError, match="same table"):
        db.sql("SELECT s.id FROM sales s JOIN other o ON s.id = s.customer_id")
    with pytest.raises(NotFoundError):
        db.sql("SELECT 1 AS x FROM nowhere")


def test_division(db):
    assert run(db, "SELECT 7 / 2 AS i, (0 - 7) / 2 AS n, 7 / 2.0 AS f FROM narrow") == [(3, -3, 3.5)]
    a, b, c, d = run(db, "SELECT 1.0 / 0 AS a, (0 - 1) / 0.0 AS b, 0.0 / 0 AS c, NULL / 0.0 AS d FROM narrow")[0]
    assert (a, b, math.isnan(c), d) == (math.inf, -math.inf, True, None)
    with pytest.raises(ExecutionError):
        run(db, "SELECT id / 0 AS x FROM sales")


def test_overflow_is_an_error(db):
    with pytest.raises(ExecutionError):
        run(db, "SELECT id + 9223372036854775807 AS x FROM sales")
    with pytest.raises(PlanningError):
        db.sql("SELECT 9223372036854775808 AS x FROM sales")


def test_narrow_types_widen(db):
    result = db.execute_sql("SELECT i + i AS s, f + f AS t, i AS i FROM narrow")
    assert [str(f.type) for f in result.table.schema] == ["int64", "double", "int32"]


def test_result_types(db):
    schema = db.execute_sql("SELECT COUNT(*) AS n, SUM(id) AS s, AVG(id) AS a, MIN(id) AS m FROM sales").table.schema
    assert [str(f.type) for f in schema] == ["int64", "double", "double", "int64"]


def test_integer_sums_do_not_overflow(db):
    db.register_memory("big", [(2**62,), (2**62,), (2**62,)], "x bigint")
    assert run(db, "SELECT SUM(x) AS s, SUM(DISTINCT x) AS d FROM big") == [(3 * 2.0**62, 2.0**62)]
    values = [2**63 - 1, -(2**63), -(2**63), 2**53 + 1, -1, 1 << 44, -(1 << 22), 0, None]
    db.register_memory("wide", [(v,) for v in values], "x bigint", 3)
    assert run(db, "SELECT SUM(x) AS s FROM wide") == [(float(sum(v for v in values if v is not None)),)]


def test_casts(db):
    assert run(db, "SELECT CAST('x' AS INT) AS a, '12'::bigint AS b, CAST(12.9 AS INT) AS c, CAST(0 - 12.9 AS BIGINT) AS d, CAST(1e30 AS BIGINT) AS e, CAST(1 AS BOOLEAN) AS f, CAST(TRUE AS INTEGER) AS g, CAST(5 AS DOUBLE PRECISION) AS h, CAST(7 AS VARCHAR(10)) AS i FROM narrow") == [
        (None, 12, 12, -12, None, True, 1, 5.0, "7")
    ]
    unsigned = run(db, "SELECT CAST(0 - 1 AS INT UNSIGNED) AS a, CAST(4294967295 AS UINT32) AS b, CAST(4294967296 AS UINT32) AS c, CAST(2.9 AS BIGINT UNSIGNED) AS d, CAST('18446744073709551615' AS UBIGINT) AS e FROM narrow")
    assert [None if v is None else int(v) for v in unsigned[0]] == [None, 4294967295, None, 2, 2**64 - 1]


def test_unsigned_rules(db):
    db.register_memory("u", pa.table({"x": pa.array([1, 5], pa.uint64()), "y": pa.array([2, 3], pa.uint32()), "s": pa.array([1, 2], pa.int64())}))
    assert [tuple(map(int, row)) for row in run(db, "SELECT x + y AS a, x * y AS b FROM u ORDER BY a")] == [(3, 2), (8, 15)]
    assert [tuple(map(int, row)) for row in run(db, "SELECT x / y AS q FROM u ORDER BY q")] == [(0,), (1,)]
    with pytest.raises(ExecutionError):
        run(db, "SELECT x - y AS d FROM u")
    for text in ("x + s", "x > s"):
        with pytest.raises(PlanningError):
            db.sql(f"SELECT {text} AS e FROM u")


@pytest.mark.parametrize("text", ["region + 1", "region > 1", "region = TRUE", "NULL + NULL", "id AND TRUE", "region OR TRUE"])
def test_types_that_do_not_mix(db, text):
    with pytest.raises(PlanningError):
        db.sql(f"SELECT {text} AS x FROM sales")


@pytest.mark.parametrize("sql", ["SELECT id FROM sales WHERE id", "SELECT id FROM sales WHERE NULL", "SELECT SUM(region) AS s FROM sales", "SELECT s.id FROM sales s JOIN narrow n ON s.id = n.i", "SELECT id FROM sales, gold", "SELECT 1 AS x", "SELECT id FROM sales LIMIT id", "SELECT id FROM sales LIMIT 1.5", "SELECT id, COUNT(*) AS n FROM sales GROUP BY region", "SELECT COUNT() AS n FROM sales", "SELECT SUM(id, amount) AS n FROM sales", "SELECT id FROM sales; SELECT id FROM sales", "", "SELECT id FROM", "SELECT FROM sales", "SELECT id FROM sales WHERE id = ?"])
def test_planning_errors(db, sql):
    with pytest.raises(PlanningError):
        db.sql(sql)


@pytest.mark.parametrize(
    "sql",
    [
        "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT id FROM sales UNION SELECT id FROM sales", "SELECT DISTINCT id FROM sales", "INSERT INTO sales VALUES (1)",
        "SELECT id FROM (SELECT id FROM sales) t", "SELECT id FROM sales ORDER BY ALL", "SELECT id FROM sales LIMIT 1 OFFSET 2", "SELECT id FROM sales LIMIT 1, 2",
        "SELECT id FROM sales OFFSET 1", "SELECT id FROM sales FETCH FIRST 1 ROWS ONLY", "SELECT SUM(id) / COUNT(id) AS x FROM sales", "SELECT COUNT(DISTINCT *) AS n FROM sales",
        "SELECT COUNT(*) OVER () AS n FROM sales", "SELECT SUM(id) FILTER (WHERE id > 1) AS n FROM sales", "SELECT upper(region) AS u FROM sales", "SELECT s.* FROM sales s",
        "SELECT id FROM sales WHERE id BETWEEN 1 AND 2", "SELECT id FROM sales WHERE id IN (1)", "SELECT id FROM sales WHERE region LIKE 'e%'", "SELECT NOT active AS x FROM sales",
        "SELECT -id AS x FROM sales", "SELECT id % 2 AS x FROM sales", "SELECT region || 'x' AS x FROM sales", "SELECT CASE WHEN id > 1 THEN 1 END AS x FROM sales",
        "SELECT DATE '2020-01-01' AS d FROM sales", "SELECT TRY_CAST(id AS INT) AS x FROM sales", "SELECT CAST(id AS DATE) AS x FROM sales", "SELECT id FROM sales HAVING id > 1",
        "SELECT region, COUNT(*) AS n FROM sales GROUP BY ROLLUP (region)", "SELECT s.id FROM sales s RIGHT JOIN gold g ON s.customer_id = g.customer_id",
        "SELECT s.id FROM sales s FULL JOIN gold g ON s.customer_id = g.customer_id", "SELECT s.id FROM sales s CROSS JOIN gold g", "SELECT s.id FROM sales s JOIN gold g USING (customer_id)",
        "SELECT s.id FROM sales s NATURAL JOIN gold g", "SELECT s.id FROM sales s JOIN gold g ON s.customer_id > g.customer_id", "SELECT s.id FROM sales s LEFT SEMI JOIN gold g ON s.customer_id = g.customer_id",
        "SELECT s.id FROM sales s JOIN gold g ON s.customer_id = g.customer_id JOIN other o ON s.id = o.id", "SELECT region, COUNT(*) AS n FROM sales GROUP BY region HAVING COUNT(*) > 1",
        "SELECT id IS TRUE AS x FROM flags", "SELECT id FROM sales QUALIFY id > 1",
    ],
)
def test_refused(db, sql):
    with pytest.raises(UnsupportedError):
        db.sql(sql)


@pytest.mark.parametrize(
    ("sql", "error", "part"),
    [
        ("SELECT id FROM sales UNION SELECT 1", UnsupportedError, "'UNION' at character 22 is not part of the accepted SELECT"), ("SELECT id FROM", PlanningError, "ends where a table name should follow"),
        ("SELECT id WHERE id > 1", PlanningError, "'WHERE' at character 11 stands where FROM should follow"), ("SELECT id FROM sales WHERE id = (SELECT 1)", UnsupportedError, "'SELECT' at character 34"),
        ("SELECT id FROM sales GROUP BY GROUPING SETS ((id))", UnsupportedError, "'GROUPING'"), ("SELECT lower(region) AS x FROM sales", UnsupportedError, "function LOWER at character 8"),
        ("SELECT CAST(id AS DECIMAL(10, 2)) AS x FROM sales", UnsupportedError, "DECIMAL"), ("SELECT id FROM sales s JOIN gold g", PlanningError, "ends where ON should follow"), ("SELECT id id2 id3 FROM sales", PlanningError, "'id3'"),
    ],
)
def test_refusals_name_the_token_and_its_place(db, sql, error, part):
    with pytest.raises(error, match=re.escape(part)):
        db.sql(sql)


def test_reserved_words_after_as_or_in_quotes(db):
    assert run(db, 'SELECT id AS order, "id" "from" FROM sales ORDER BY "order" LIMIT 1') == [(0, 0)]


def test_group_by_forms(db):
    assert ordered(db, "SELECT region AS r, COUNT(*) AS n FROM sales GROUP BY region") == [("east", 4), ("west", 4)]
    assert ordered(db, "SELECT sales.region, COUNT(*) AS n FROM sales GROUP BY region") == [("east", 4), ("west", 4)]
    assert ordered(db, "SELECT region FROM sales GROUP BY region") == [("east",), ("west",)]
    assert ordered(db, "SELECT id / 4 AS q, COUNT(*) AS n FROM sales GROUP BY id / 4") == [(0, 4), (1, 4)]
    assert ordered(db, "SELECT region, customer_id, MAX(id) AS m FROM sales GROUP BY ALL HAVING m > 6") == [("west", 20, 7)]


def test_comments_quotes_and_case(db):
    assert run(db, 'select "id" as "the id" -- a comment\nfrom `sales` /* here */ where region = \'east\' order by "the id" limit 1;') == [(0,)]
    assert run(db, "SELECT 'it''s' AS s, .5 AS h, 1e2 AS e FROM narrow") == [("it's", 0.5, 100.0)]


def test_precedence(db):
    assert run(db, "SELECT 1 + 2 * 3 AS a, (1 + 2) * 3 AS b, 10 - 2 - 3 AS c, 1 = 1 OR 1 = 2 AND 1 = 2 AS d, 1 = 2 IS NULL AS e, '2'::int + 1 AS f FROM narrow") == [(7, 9, 5, True, False, 3)]


def test_limit_zero_keeps_the_schema(db):
    result = db.execute_sql("SELECT id, region FROM sales ORDER BY id LIMIT 0")
    assert result.rows() == [] and result.columns == ["id", "region"]


def test_nan_sorts_and_groups_as_one(db):
    db.register_memory("n", [(float("nan"),), (float("nan"),), (1.0,), (None,)], "x double")
    assert run(db, "SELECT COUNT(*) AS n FROM n GROUP BY x ORDER BY n DESC") == [(2,), (1,), (1,)]
