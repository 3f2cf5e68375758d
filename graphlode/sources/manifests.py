"""Dependencies from manifest files. files has project, path and text; results name package, version, dev and peer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlode.functions import names

# Names that are the language itself and no package.
NOT_PACKAGES = ("python", "php")
_MAP = "map<string,string>"


def _rows(files: DataFrame, items: Column, name: Column, version: Column, dev: Column, peer: Column) -> DataFrame:
    rows = files.select("project", "path", F.explode(items).alias("item"))
    return rows.select("project", "path", name.alias("package"), version.alias("version_spec"), dev.alias("dev"), peer.alias("peer"))


def _json(files: DataFrame, sections: dict[str, tuple[bool, bool]]) -> DataFrame:
    parsed = files.withColumn("j", F.from_json("text", f"struct<{','.join(f'`{s}`:{_MAP}' for s in sections)}>"))

    def part(section: str, dev: bool, peer: bool) -> Column:
        entries = F.map_entries(F.coalesce(F.col(f"j.`{section}`"), F.create_map().cast(_MAP)))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(dev).alias("dev"), F.lit(peer).alias("peer")))

    parts = [part(s, dev, peer) for s, (dev, peer) in sections.items()]
    i = F.col("item")
    return _rows(parsed, F.concat(*parts), i["name"], i["version"], i["dev"], i["peer"])


def package_json(files: DataFrame) -> DataFrame:
    return _json(files, {"dependencies": (False, False), "devDependencies": (True, False), "peerDependencies": (False, True)})


def composer_json(files: DataFrame) -> DataFrame:
    return _json(files, {"require": (False, False), "require-dev": (True, False)})


def _lines(files: DataFrame, lines: Column, pattern: str) -> DataFrame:
    i, no = F.col("item"), F.lit(False)
    rows = _rows(files, lines, F.regexp_extract(i, pattern, 1), F.trim(F.regexp_extract(i, pattern, 2)), no, no)
    return rows.where("package <> ''")


def requirements_txt(files: DataFrame) -> DataFrame:
    """``name[extras]spec``; blank lines, comments and options are no packages."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+#.*$", ""))), lambda x: ~x.rlike(r"^(?:#|-|$)"))
    return _lines(files, lines, r"^([A-Za-z0-9][\w.\-]*)\s*(?:\[[^\]]*\])?\s*(.*)$")


def pyproject_toml(files: DataFrame) -> DataFrame:
    """The ``dependencies`` list of [project]."""
    section = F.regexp_extract("text", r"(?s)\[project\](?:(?!\n\[).)*?\n\s*dependencies\s*=\s*\[((?:[^\]\[]|\[[^\]]*\])*)\]", 1)
    items = F.regexp_extract_all(section, F.lit(r"[\"']([^\"']+)[\"']"), 1)
    return _lines(files, items, r"^([A-Za-z0-9][\w.\-]*)\s*(?:\[[^\]]*\])?\s*(.*)$")


def cargo_toml(files: DataFrame) -> DataFrame:
    section = F.regexp_extract("text", r"(?ms)^\[dependencies\]\s*$(.*?)(?=^\[|\z)", 1)
    items = F.filter(F.split(section, r"\r?\n"), lambda x: x.rlike(r"^\s*[\w\-]+\s*="))
    i = F.col("item")
    version = F.coalesce(F.nullif(F.regexp_extract(i, r"version\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.regexp_extract(i, r"=\s*\"([^\"]*)\"", 1))
    return _rows(files, items, F.regexp_extract(i, r"^\s*([\w\-]+)\s*=", 1), version, F.lit(False), F.lit(False))


def go_mod(files: DataFrame) -> DataFrame:
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(r"^\s+\S+\s+v\S+"))
    return _lines(files, lines, r"^\s+(\S+)\s+(v\S+)")


def csproj(files: DataFrame) -> DataFrame:
    items = F.regexp_extract_all("text", F.lit(r"(<PackageReference\b[^>]*>)"), 1)
    i = F.col("item")
    return _rows(files, items, F.regexp_extract(i, r"Include\s*=\s*\"([^\"]*)\"", 1), F.regexp_extract(i, r"Version\s*=\s*\"([^\"]*)\"", 1), F.lit(False), F.lit(False)).where("package <> ''")


PARSERS = {"package.json": package_json, "requirements.txt": requirements_txt, "pyproject.toml": pyproject_toml, "cargo.toml": cargo_toml, "go.mod": go_mod, "composer.json": composer_json}


def dependencies(files: DataFrame) -> DataFrame:
    """(project, path, package, version_spec, dev, peer) of all manifests in the files, by their base name."""
    base = F.lower(names.basename(F.col("path")))
    parts = [parse(files.where(base == name)) for name, parse in PARSERS.items()] + [csproj(files.where(base.endswith(".csproj")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(~F.lower("package").isin(*NOT_PACKAGES))


def dependency_edges(found: DataFrame) -> DataFrame:
    return found.groupBy("project", "package").agg(F.max("version_spec").alias("version_spec"), F.min("dev").alias("dev"), F.max("peer").alias("peer")).select(
        "project", F.lit("DEPENDS_ON_EXTERNAL").alias("rel_type"), F.lit("Project").alias("src_label"), F.col("project").alias("src_key"), F.lit("ExternalPackage").alias("dst_label"), F.col("package").alias("dst_key"), "version_spec", "dev", "peer"
    )
