import json

from pyspark.sql import functions as F

from graphlode.operators import resolve as R
from graphlode.sources import manifests, scan


def test_suffix_resolution(spark):
    files = spark.createDataFrame([("p", x) for x in ("src/oauth.ts", "src/utils/oauth/index.ts", "src/components/Button.tsx", "src/lib/parsers/workspace-resolver.ts")], "project string, path string")
    asked = ["oauth", "utils/oauth", "components/Button", "components/button", "lib/parsers/workspace-resolver.js", "nothing/here", "./parsers/workspace-resolver"]
    df = spark.createDataFrame([("p", x) for x in asked], "project string, import_path string")
    got = {r["import_path"]: r["target"] for r in R.suffix_resolve(df, R.suffix_index(files)).collect()}
    assert got == {"oauth": "src/oauth.ts", "utils/oauth": "src/utils/oauth/index.ts", "components/Button": "src/components/Button.tsx", "components/button": "src/components/Button.tsx", "lib/parsers/workspace-resolver.js": "src/lib/parsers/workspace-resolver.ts", "nothing/here": None, "./parsers/workspace-resolver": "src/lib/parsers/workspace-resolver.ts"}


def test_aliases(spark):
    files = {"tsconfig.json": '{ // base\n "extends": "./base", }', "base.json": json.dumps({"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["*"], "@lib/*": ["lib/*"], "cfg": ["config/index.ts"]}}})}
    aliases = R.read_aliases(files)
    assert dict((a, t) for a, _, t in aliases) == {"@/": "src", "@lib/": "src/lib/", "cfg": "src/config/index.ts"} or dict((a, t) for a, _, t in aliases)["@lib/"] == "src/lib/"
    assert R.read_aliases({}) == [] and R.read_aliases({"tsconfig.json": "{broken"}) == []
    df = spark.createDataFrame([("@lib/x",), ("cfg",), ("cfg/y",), ("other",)], "import_path string")
    table = spark.createDataFrame([("@/", True, "src/"), ("@lib/", True, "src/lib/"), ("cfg", False, "src/config/index.ts")], "prefix string, is_glob boolean, target string")
    got = {r["import_path"]: r["rewritten"] for r in R.alias_rewrite(df, table).collect()}
    assert got == {"@lib/x": "src/lib/x", "cfg": "src/config/index.ts", "cfg/y": None, "other": None}


def test_workspaces(spark):
    files = {"package.json": '{"workspaces": ["packages/*"]}', "packages/a/package.json": '{"name": "@x/a", "exports": {".": "./dist/index.js", "./sub": {"import": "./dist/sub.js"}}}', "packages/b/package.json": '{"name": "b", "main": "lib/main.js"}', "other/package.json": '{"name": "no"}'}
    found = R.workspace_packages(files)
    assert ("@x/a", "", "packages/a/src/index.ts") in found and ("@x/a", "sub", "packages/a/src/sub.ts") in found and ("b", "", "packages/b/src/main.ts") in found and all(n != "no" for n, _, _ in found)
    assert R.workspace_packages({"pnpm-workspace.yaml": "packages:\n  - 'libs/*'\n", "libs/c/package.json": '{"name": "c"}'})[0][0] == "c"
    df = spark.createDataFrame([("@x/a",), ("@x/a/sub",), ("b/raw",), ("react",)], "import_path string")
    got = {r["import_path"]: r["target"] for r in R.workspace_resolve(df, spark.createDataFrame(found, "package string, subpath string, target string")).collect()}
    assert got == {"@x/a": "packages/a/src/index.ts", "@x/a/sub": "packages/a/src/sub.ts", "b/raw": "packages/b/raw", "react": None}


def test_an_import_of_unknown_target_stops_the_cascade(spark):
    calls = spark.createDataFrame([("p", "src/a.ts:f", "src/a.ts", None, c) for c in ("g", "known", "lost", "amb", "Obj.m")], "project string, caller string, module string, class_name string, callee_text string")
    symbols = spark.createDataFrame([("p", q, "Function") for q in ("src/a.ts:f", "src/a.ts:g", "src/b.ts:known", "src/c.ts:lost", "src/d.ts:amb", "src/e.ts:amb")] + [("p", "src/a.ts:Obj.m", "Method")], "project string, qn string, label string")
    imports = spark.createDataFrame([("p", "src/a.ts", "known", "src/b.ts:known"), ("p", "src/a.ts", "lost", "gone"), ("p", "src/a.ts", "amb", "gone")], "project string, module string, local_name string, target string")
    got = {r["callee_text"]: (r["target"], r["confidence"]) for r in R.resolve_calls(calls, symbols, imports).collect()}
    assert got == {"g": ("src/a.ts:g", 1.0), "known": ("src/b.ts:known", 1.0), "lost": ("src/c.ts:lost", 0.6), "Obj.m": ("src/a.ts:Obj.m", 1.0)}


def test_ignored_paths(spark):
    paths = {"node_modules/a.js": True, "src/a.js": False, ".git/x": True, "a/__pycache__/b.pyc": True, ".venv/x": True, "dist/a": True, "build/a": True, "vendor/a": True, "target/a": True, "x.egg-info/a": True, "docs/a": False, "keep/dist/a": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"]: r["s"] for r in df.select("path", scan.skipped(F.col("path")).alias("s")).collect()} == paths
    custom = {r["path"]: r["s"] for r in df.select("path", scan.skipped(F.col("path"), ("docs",), ("keep/dist",)).alias("s")).collect()}
    assert custom["docs/a"] and not custom["keep/dist/a"]


def test_manifests(spark):
    texts = {
        "package.json": '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}, "peerDependencies": {"c": "3"}}', "x/requirements.txt": "# c\nflask[async]>=2.0\n-r other\n\nnumpy==1.2 # pin\n",
        "pyproject.toml": '[project]\nname = "x"\ndependencies = [\n  "requests>=2",\n  "rich[all]",\n]\n[tool]\n', "Cargo.toml": '[package]\nname = "x"\n[dependencies]\nserde = { version = "1.0", features = ["derive"] }\nrand = "0.8"\n[dev-dependencies]\nq = "1"\n',
        "go.mod": "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n", "composer.json": '{"require": {"php": ">=8", "m/n": "1"}, "require-dev": {"o/p": "2"}}', "a.csproj": '<Project><PackageReference Include="Newton" Version="13.0" /></Project>', "bad/package.json": "{nope",
    }
    df = spark.createDataFrame([("p", k, v) for k, v in texts.items()], "project string, path string, text string")
    got = {r["package"]: (r["version_spec"], r["dev"], r["peer"]) for r in manifests.dependencies(df).collect()}
    assert got == {"a": ("^1", False, False), "b": ("2", True, False), "c": ("3", False, True), "flask": (">=2.0", False, False), "numpy": ("==1.2", False, False), "requests": (">=2", False, False), "rich": ("", False, False), "serde": ("1.0", False, False), "rand": ("0.8", False, False), "github.com/a/b": ("v1.2.3", False, False), "m/n": ("1", False, False), "o/p": ("2", True, False), "Newton": ("13.0", False, False)}
