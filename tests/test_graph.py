"""The interaction graph on worked examples, and properties of merging, degree and pruning."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rookery.operators import interaction_graph as g
from rookery.operators.ranking import percentile_of, with_ids, with_ranks

W = ("src", "dst", "count_coc", "count_comm", "count_rt", "count_ht")


def edges(spark, *messages, recount=True):
    df = spark.createDataFrame([(a, m) for a, m in messages], "userid string, msg string")
    return {tuple(r[c] for c in W[:2]): tuple(r[c] for c in W[2:]) for r in g.graph_edges(df, recount=recount).collect()}


def test_worked_example(spark):
    got = edges(spark, ("Z", "@bob @al RT @carol: hi #X #y @dave @dave"))
    assert got == {
        ("@z", "@carol"): (0, 0, 1, 0), ("@z", "@bob"): (0, 1, 0, 0), ("@z", "@al"): (0, 1, 0, 0), ("#x", "#y"): (2, 0, 0, 0), ("#y", "#x"): (2, 0, 0, 0),
        ("@z", "#x"): (0, 0, 0, 1), ("@z", "#y"): (0, 0, 0, 1), ("@carol", "#x"): (0, 0, 0, 1), ("@carol", "#y"): (0, 0, 0, 1),
    }


def test_chain(spark):
    msg = "RT @a: RT @b: hi @c @d"
    assert edges(spark, ("Z", msg)) == {("@z", "@a"): (0, 0, 1, 0), ("@a", "@b"): (0, 0, 1, 0), ("@c", "@d"): (2, 0, 0, 0), ("@d", "@c"): (2, 0, 0, 0)}
    assert edges(spark, ("Z", msg), recount=False) == {("@z", "@a"): (0, 0, 1, 0)}


def test_no_target(spark):
    df = spark.createDataFrame([("Z", "CART @ x RT @")], "userid string, msg string")
    assert g.graph_edges(df).count() == 0
    assert [r["name"] for r in g.graph_nodes(df).collect()] == ["@z"]


def test_direct(spark):
    assert edges(spark, ("Z", "@z @b hi")) == {("@z", "@b"): (0, 1, 0, 0)}
    assert edges(spark, ("Z", " @b hi")) == {}


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "@a @b"), ("u", None), ("u", "")], "userid string, msg string")
    assert g.graph_edges(df).count() == 0
    assert g.graph_nodes(df).count() == 1
    assert g.graph_edges(df.limit(0)).count() == 0


def test_degree_and_prune(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "name long")
    e = spark.createDataFrame([(0, 1, 1, 0, 2, 0), (1, 2, 0, 0, 0, 3), (2, 2, 0, 0, 0, 1)], "src long, dst long, count_coc long, count_comm long, count_rt long, count_ht long")
    degree = g.weighted_degree(nodes, e)
    assert {r["name"]: (r["in_w"], r["out_w"]) for r in degree.collect()} == {0: (0, 3), 1: (3, 3), 2: (4, 1), 3: (0, 0), 4: (0, 0)}
    kept = g.prune(degree, e, (3, 100))
    assert sorted((r["threshold"], r["src"], r["dst"]) for r in kept.collect()) == [(3, 1, 2), (3, 2, 2)]
    assert sorted(r["name"] for r in g.kept_nodes(degree, (3,)).collect()) == [1, 2]


def test_node_ids(spark):
    nodes = spark.createDataFrame([(f"@u{i:03}",) for i in range(200)], "name string")
    got = sorted((r["node_id"], r["name"]) for r in with_ids(nodes).collect())
    assert got == [(i, f"@u{i:03}") for i in range(200)]


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_ranks_within_keys(spark, parts):
    """A key of most rows runs over many ranges, and its ranks go on from one to the next."""
    rows = [("hot" if i % 10 else f"k{i % 70:02}", (i * 7_919) % 1_000) for i in range(1_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_ranks(spark.createDataFrame(rows, "key string, at long"), "key", "at").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = {}
    for k, at in sorted(rows):
        own.setdefault(k, []).append(at)
    assert sorted((r["key"], r["at"], r["_rank"]) for r in got) == sorted((k, at, i) for k, v in own.items() for i, at in enumerate(v))


def test_percentile(spark):
    values = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3)] + [(None,)], "v double")
    assert [percentile_of(values, "v", s) for s in (0.0, 0.5, 0.8, 1.0)] == [1.0, 3.0, pytest.approx(4.2), 5.0]
    assert percentile_of(values.where("v IS NULL"), "v", 0.5) is None


def test_graph_tables_agree(spark):
    df = spark.createDataFrame([("z", "@b #x #y RT @c: hi"), ("z", "RT @c: @d @e"), ("q", "alone"), (None, "@x"), ("q", None)], "userid string, msg string")
    nodes, edges = g.graph_tables(df)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, g.graph_nodes(df).collect()))
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, g.graph_edges(df).collect()))


@pytest.fixture(scope="module")
def shared(spark):
    return spark


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.lists(st.sampled_from(["@a", "@b", "RT @c", "#x", "#Y", "hi"]), max_size=6).map(" ".join)), min_size=1, max_size=6))
def test_properties(shared, messages):
    df = shared.createDataFrame(messages, "userid string, msg string")
    e = g.graph_edges(df).persist()
    whole = {tuple(r[:3]): tuple(r[3:]) for r in e.collect()}
    half = g.graph_edges(shared.createDataFrame(messages[::2], df.schema))
    rest = g.graph_edges(shared.createDataFrame(messages[1::2], df.schema)) if messages[1::2] else half.limit(0)
    assert whole == {tuple(r[:3]): tuple(r[3:]) for r in g.merge_edges(half.unionByName(rest)).collect()}
    for (s, d, kind), w in whole.items():
        assert w[0] == 0 or whole[(d, s, kind)][0] == w[0]
    degree = g.weighted_degree(g.graph_nodes(df), e).collect()
    total = sum(sum(w) for w in whole.values())
    assert sum(r["in_w"] for r in degree) == sum(r["out_w"] for r in degree) == total
    e.unpersist()
