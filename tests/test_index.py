import os

import pytest

from graphlode.sources.extract import extract
from graphlode.sources.store import Store
from graphlode.streaming import indexer
from graphlode.tools import Tools

FILES = {
    "src/processor.py": 'import os\nfrom src.helpers import clean\n\nclass Base:\n    def run(self):\n        return 1\n\nclass Processor(Base):\n    """Doc."""\n    def process(self, x: int) -> str:\n        self.run()\n        return clean(x)\n\ndef main():\n    p = Processor()\n    p.process(1)\n',
    "src/helpers.py": "def clean(x):\n    return str(x)\n",
    "src/service.ts": "import { Api } from './api';\nexport interface Svc { go(): void }\nexport class Service implements Svc {\n  private api: Api = new Api();\n  go(): void { this.api.call(1); this.help(); }\n  help() { console.log('x'); }\n}\n",
    "src/api.ts": "export class Api {\n  /** Calls it. */\n  call(n: number): number { return n; }\n}\n",
    "src/lib.rs": "pub struct A;\nimpl A {\n  pub fn x(&self) -> u32 { helper() }\n}\nfn helper() -> u32 { 1 }\n",
    "main.go": "package main\nimport \"fmt\"\ntype T struct{}\nfunc (t *T) Run(a, b int) int { return add(a, b) }\nfunc add(a, b int) int { fmt.Println(a); return a + b }\n",
    "A.java": "package x;\nimport java.util.List;\npublic class A extends B implements C {\n  private int n;\n  public Map<String, Integer> run(List<String> xs, int k) { return help(k); }\n  int help(int k) { return k; }\n}\n",
    "package.json": '{"dependencies": {"left-pad": "^1.0.0"}}',
    "node_modules/z/a.js": "function q() {}",
}


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    write(root, FILES)
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    Tools(s, allow_index=True).index_repository(root, "demo")
    return s, root


def calls(store):
    return {(r["src_key"], r["dst_key"]): r["confidence"] for r in store.graph().edges.where("rel_type = 'CALLS'").collect()}


def test_index_and_reindex(spark, store):
    s, root = store
    found = calls(s)
    assert found["src/lib.rs:A.x", "src/lib.rs:helper"] == 1.0
    assert found["src/processor.py:Processor.process", "src/helpers.py:clean"] == 1.0
    assert found["src/processor.py:Processor.process", "src/processor.py:Base.run"] == 1.0
    assert found["src/processor.py:main", "src/processor.py:Processor.process"] == 1.0
    assert found["src/service.ts:Service.go", "src/api.ts:Api.call"] == 0.9
    assert found["main.go:T.Run", "main.go:add"] == 1.0 and found["A.java:A.run", "A.java:A.help"] == 1.0
    keys = {r["key"] for r in s.graph().nodes.collect()}
    assert "left-pad" in keys and not any(k.startswith("node_modules") for k in keys)
    t = Tools(s, "demo")
    assert {r["name"] for r in t.analyze_code_dependencies("clean", "callers").collect()} == {"process"}
    assert [r["project"] for r in t.list_graph_projects().collect()] == ["demo"]
    assert {r["name"] for r in t.query_code_graph("who calls `clean`?").collect()} == {"process"}
    files = spark.createDataFrame([("demo", k, v) for k, v in FILES.items()], "project string, path string, text string")
    code = {r["symbol"]: r for r in t.get_code_from_graph(["src/helpers.py:clean", "nope"], files).collect()}
    assert code["src/helpers.py:clean"]["source"] == "def clean(x):\n    return str(x)" and code["nope"]["error"] == "symbol not found"
    with pytest.raises(PermissionError):
        t.index_repository(root, "demo")
    with pytest.raises(ValueError):
        t.call("nothing")
    # a second run: one file changed, one gone, calls of unchanged files stay
    write(root, {"src/helpers.py": "def clean(x):\n    return other(x)\n\ndef other(y):\n    return y\n"})
    os.remove(os.path.join(root, "src/lib.rs"))
    diff = {r["path"]: r["change"] for r in Tools(s, allow_index=True).index_repository(root, "demo").collect()}
    assert diff["src/helpers.py"] == "changed" and diff["src/lib.rs"] == "deleted" and diff["src/api.ts"] == "unchanged"
    found = calls(s)
    assert ("src/helpers.py:clean", "src/helpers.py:other") in found and ("src/processor.py:Processor.process", "src/helpers.py:clean") in found
    assert not any("lib.rs" in a for a, _ in found)
    counts = s.export(root + "-export").first()
    assert counts["nodes"] == s.graph().nodes.count()
    s.delete_project("demo")
    assert s.graph().nodes.count() == 0 and s.hashes().count() == 0


def test_stream_equals_batch(spark, tmp_path):
    root = str(tmp_path / "tree")
    write(root, {k: v for k, v in FILES.items() if k.endswith(".py")})
    s = Store(spark, str(tmp_path / "store"))
    indexer.watch_tree(spark, s, root, "demo", str(tmp_path / "checkpoint"), 1).awaitTermination()
    assert ("src/processor.py:Processor.process", "src/processor.py:Base.run") in calls(s)
    assert {r["path"] for r in s.hashes().collect()} == {"src/processor.py", "src/helpers.py"}


def test_facts():
    kinds = [(f.kind, f.qn) for f in extract(FILES["A.java"], "A.java")]
    assert ("method", "A.java:A.run") in kinds and ("method", "A.java:A.help") in kinds and not any(q.endswith("A.Map") for _, q in kinds)
    f = next(x for x in extract(FILES["src/api.ts"], "src/api.ts") if x.kind == "method")
    assert f.docstring == "Calls it." and f.parameters == ["n"]
    assert [x.kind for x in extract("def broken(:\n", "x.py")] == ["module"] and list(extract("", "x.unknown"))[0].kind == "module"


# -- TypeScript: types of fields and variables -----------------------------------------------------------------
def facts_of(text, path="src/a.ts"):
    out = {}
    for f in extract(text, path):
        out.setdefault(f.kind, {})[f.owner, f.name] = f
    return out


def types(text, kind="field"):
    return {name: f.target.replace(" ", "") for (_, name), f in facts_of(text).get(kind, {}).items()}


def test_fields_have_types():
    assert types("class Foo {\n  bar: Baz;\n  private qux: Quux;\n  public readonly zed: Zed = new Zed();\n}") == {"bar": "Baz", "qux": "Quux", "zed": "Zed"}
    assert types("class Foo {\n  constructor(private readonly bar: Baz, public qux: Quux, plain: P) {}\n}") == {"bar": "Baz", "qux": "Quux"}
    assert types("class Foo {\n  bar = new Baz();\n}") == {"bar": "Baz"}
    assert types("class Foo {\n  bar: Baz | null;\n}") == {"bar": "Baz|null"}
    assert types("class Foo {\n  get bar(): Baz { return this.b; }\n}") == {"bar": "Baz"}
    assert types("interface Foo {\n  bar: Baz;\n  qux?: Quux;\n}") == {"bar": "Baz", "qux": "Quux"}


def test_variables_have_types():
    assert types("const x: User = getUser();\nlet y: Admin = getAdmin();", "variable") == {"x": "User", "y": "Admin"}
    assert types("const user = new User();\nconst service = new MyService();", "variable") == {"user": "User", "service": "MyService"}
    assert types("const a = new User();\nconst b = a;", "variable") == {"a": "User", "b": "User"}
    inner = facts_of("const outer: O = new O();\nfunction doWork() {\n  const inner: I = new I();\n}")["variable"]
    assert {k: f.target for k, f in inner.items()} == {("src/a.ts", "outer"): "O", ("src/a.ts:doWork", "inner"): "I"}
    assert types("function f(u: User, cb: (a: string) => void, n?: number) {}", "variable") == {"u": "User", "cb": "(a:string)=>void", "n": "number"}


def test_long_types_and_many_decorators():
    union = " | ".join(f"T{i}" for i in range(90))
    found = facts_of(f"function big(): {union} {{ return 1; }}\n/** Doc. */\n@A({{ x: 1 }})\n@B()\n@C\n@D(\"y\")\n@E\n@F\nexport class Deco {{ m() {{}} }}\n")
    assert ("", "big") in found["function"] and found["return"]["", "big"].target.count("|") == 89 and ("src/a.ts", "big") not in found.get("call", {})
    assert found["class"]["", "Deco"].docstring == "Doc."


def test_type_arguments_are_no_bases():
    found = facts_of("class A<T extends Z> extends Map<K, V> implements I<X, Y>, n.J {}")
    assert set(found["base"]) == {("A", "Map")} and set(found["implements"]) == {("A", "I"), ("A", "J")}


def test_arrows_and_objects_for_interfaces():
    found = facts_of("export const add = (a: number, b: number): number => { return sum(a, b); };\nconst p: Svc = { go(x) { help(x); }, refresh: async (y: Tok) => { call(y); }, quick: z => z + 1, n: 1 };\n")
    assert found["function"]["", "add"].parameters == ["a", "b"] and ("src/a.ts:add", "sum") in found["call"]
    assert {f.qn for f in found["method"].values()} == {"src/a.ts:p.go", "src/a.ts:p.refresh", "src/a.ts:p.quick"} and ("p", "Svc") in found["implements"]
    assert ("src/a.ts:p.refresh", "call") in found["call"]


def test_calls_go_through_types(spark, tmp_path):
    files = {
        "src/mode.ts": "import { Session } from './session';\nimport { makeSession } from './make';\nexport class Mode {\n  constructor(private session: Session) {}\n  auth() { this.session.registry.store.deep.login(); }\n  made() { const s = makeSession(); s.open(); }\n  other() { const t = Session.create(); t.open(); }\n}\nconst top: Session = makeSession();\nexport function use() { top.open(); }\n",
        "src/session.ts": "import { Registry } from './registry';\nexport class Session {\n  registry: Registry;\n  static create() { return new Session(); }\n  open(): void {}\n}\n",
        "src/registry.ts": "export class Registry { store: Store; }\nexport class Store { deep: Deep; }\nexport class Deep { login(): boolean { return true; } }\n",
        "src/make.ts": "import { Session } from './session';\nexport function makeSession(): Session { return Session.create(); }\n",
    }
    root = str(tmp_path / "tree")
    write(root, files)
    s = Store(spark, str(tmp_path / "store"))
    Tools(s, allow_index=True).index_repository(root, "demo")
    found = calls(s)
    assert found["src/mode.ts:Mode.auth", "src/registry.ts:Deep.login"] == 0.9
    assert found["src/mode.ts:Mode.made", "src/session.ts:Session.open"] == 1.0 and found["src/mode.ts:Mode.other", "src/session.ts:Session.open"] == 1.0
    assert found["src/mode.ts:use", "src/session.ts:Session.open"] == 1.0
    rows = {(r["label"], r["key"]): r for r in s.graph().nodes.collect()}
    assert ("File", "src/mode.ts") in rows and ("Module", "src/mode.ts") in rows
    from graphlode.operators.graph import callers

    assert {r["qualified_name"] for r in callers(s.graph(), "login").collect()} == {"src/mode.ts:Mode.auth"}


def test_a_failed_write_leaves_the_old_project(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tree")
    write(root, {"src/a.py": "def f():\n    return g()\n\ndef g():\n    return 1\n"})
    s = Store(spark, str(tmp_path / "store"))
    Tools(s, allow_index=True).index_repository(root, "demo")
    before = (s.graph().nodes.count(), s.graph().edges.count())
    nodes = s.graph().nodes
    from pyspark.sql import functions as F

    bad = s.graph().edges.withColumn("confidence", F.raise_error(F.lit("halfway")).cast("double"))
    with pytest.raises(Exception):
        s.replace_project("demo", nodes.limit(1), bad)
    assert (s.graph().nodes.count(), s.graph().edges.count()) == before
    # a move that was cut off: the old folder comes back
    os.rename(f"{tmp_path}/store/nodes/project=demo", f"{tmp_path}/store/nodes/_old-project=demo")
    s.recover("demo")
    assert s.graph().nodes.count() == before[0]


def test_the_package_ships_itself(tmp_path):
    """A fresh process outside the repository, with a table of the user's own."""
    import subprocess
    import sys

    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local-cluster[1,1,1024]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', sys.argv[2]).config('spark.executorEnv.PYTHONPATH', '').getOrCreate()\n"
        "sys.path.remove(sys.argv[1])\n"
        "from importlib import import_module\n"
        "sys.path.insert(0, sys.argv[1]); facts = import_module('graphlode.sources.extract').facts\n"
        "print('rows', facts(s.createDataFrame([('p', 'a.py', 'def f(): pass')], 'project string, path string, text string')).count())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, root, str(tmp_path)], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=300)
    assert "rows 2" in done.stdout, done.stderr[-2000:]


def test_a_whole_index(spark, tmp_path):
    """Vectors, communities, processes, aliases and workspace packages; an unchanged file keeps its vectors."""
    files = {
        "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}', "package.json": '{"workspaces": ["packages/*"]}', "packages/util/package.json": '{"name": "@x/util", "main": "src/index.ts"}',
        "packages/util/src/index.ts": "export function pad(s: string) { return fill(s); }\nfunction fill(s: string) { return trim(s); }\nfunction trim(s: string) { return s; }\n",
        "src/deep/main.ts": "import { help } from '@/lib/help';\nimport { pad } from '@x/util';\nexport function main() { help(); pad('x'); }\n", "src/lib/help.ts": "export function help() { return 1; }\n",
    }
    root = str(tmp_path / "tree")
    write(root, files)
    s = Store(spark, str(tmp_path / "store"))
    t = Tools(s, "demo", allow_index=True)
    t.index_repository(root, "demo")
    found = calls(s)
    assert ("src/deep/main.ts:main", "src/lib/help.ts:help") in found and ("src/deep/main.ts:main", "packages/util/src/index.ts:pad") in found
    labels = {r["label"] for r in s.graph().nodes.collect()}
    assert {"Community", "Process"} <= labels
    kinds = {r["rel_type"]: r["n"] for r in s.graph().edges.groupBy("rel_type").count().withColumnRenamed("count", "n").collect()}
    assert kinds["MEMBER_OF"] >= 3 and kinds["HAS_STEP"] >= 4
    vectors = {r["id"]: list(r["embedding"]) for r in s.vectors().collect()}
    assert set(vectors) == {"src/deep/main.ts:main", "src/lib/help.ts:help", *(f"packages/util/src/index.ts:{n}" for n in ("pad", "fill", "trim"))}
    os.remove(f"{root}/src/lib/help.ts")
    write(root, {"src/deep/main.ts": "export function main() { return other(); }\nfunction other() {}\n"})
    t.index_repository(root, "demo")
    again = {r["id"]: list(r["embedding"]) for r in s.vectors().collect()}
    assert set(again) == {"src/deep/main.ts:main", "src/deep/main.ts:other", *(f"packages/util/src/index.ts:{n}" for n in ("pad", "fill", "trim"))}
    assert again["packages/util/src/index.ts:pad"] == vectors["packages/util/src/index.ts:pad"]
    answer = t.ask("list functions")
    assert answer.meta["total"] >= answer.meta["returned"] == answer.rows.count() and not answer.meta["was_truncated"] and answer.meta["route"] == "graph"
    assert t.ask("delete all functions").error and t.ask("grep the readme for x").meta["route"] == "grep_recommended"
