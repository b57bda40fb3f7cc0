"""Imports of source files: the statements, the paths they name, and the files these resolve to. Columns and one join, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainery.functions.text import extension

# Extensions of each family, what a path may resolve to in order, and the shape of a statement.
JVM, C_FAMILY = ["java", "kt", "kts", "scala", "sc"], ["c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx"]
SCRIPT = ["ts", "tsx", "js", "jsx", "mjs", "cjs"]
SCRIPT_ENDS = [".ts", ".tsx", ".js", ".jsx"]
SCRIPT_INDEX = ["index.ts", "index.tsx", "index.js"]
STATEMENTS = {
    "py": [r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+([\w.]+)"],
    "ts": [r"\bfrom\s*['\"]([^'\"]+)['\"]", r"\b(?:require|import)\s*\(\s*['\"]([^'\"]+)['\"]", r"^\s*import\s*['\"]([^'\"]+)['\"]"],
    "rs": [r"^\s*((?:pub(?:\s*\([^)]*\))?\s+)?use\s+[^;]+;)"],
    "go": [r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$"],
    "java": [r"^\s*(import\s+[^;]+;?)"],
    "c": [r"^\s*(#\s*include\s*[<\"][^>\"]+[>\"])"],
    "php": [r"^\s*(use\s+[^;]+;)"],
    "cs": [r"^\s*(using\s+[^;(=]+;)"],
    "swift": [r"^\s*(import\s+\S+)"],
}
FAMILY = {e: "ts" for e in SCRIPT} | {e: "java" for e in JVM} | {e: "c" for e in C_FAMILY} | {"py": "py", "pyi": "py", "rs": "rs", "go": "go", "php": "php", "cs": "cs", "swift": "swift"}


def import_path(raw: Column, ext: Column) -> Column:
    """The path that an import statement names; null where there is none or the statement names a group."""
    s = F.regexp_replace(raw, r"^\s+|\s+$", "")

    def bare(lead: str) -> Column:
        return F.regexp_replace(F.regexp_replace(s, lead, ""), r"[;\s]+$", "")

    rust = F.regexp_replace(bare(r"^(pub\s*(\([^)]*\))?\s*)?(use\s+)?"), r"::\*$", "")
    named = (
        F.when(ext == "rs", F.when(~s.contains("{"), rust))
        .when(ext.isin(JVM), bare(r"^(import\s*)?(static\s+)?"))
        .when(ext.isin(C_FAMILY), F.when(s.rlike(r"^#*\s*include"), F.regexp_replace(F.regexp_replace(s, r"^#*\s*include\s*", ""), "^[<\"'](.*)[>\"']$", "$1")))
        .when(ext == "php", bare(r"^(use )?\s*"))
        .when(ext == "cs", bare(r"^(using\s*)?(static\s+)?"))
        .when(ext == "swift", F.regexp_replace(s, r"^import\s+", ""))
        .otherwise(s)
    )
    return F.when(F.trim(named) != "", named)


def statements(files: DataFrame) -> DataFrame:
    """(file, raw, ext): the import statements of files (path, text), by line."""
    ext = F.lower(extension(F.col("path")))
    family = F.element_at(F.create_map(*[F.lit(x) for pair in FAMILY.items() for x in pair]), ext)
    lines = files.select(F.col("path").alias("file"), ext.alias("ext"), family.alias("family"), F.explode(F.split("text", r"\r?\n")).alias("line")).where("family IS NOT NULL")
    found = F.lit(None).cast("string")
    for name, patterns in STATEMENTS.items():
        each = [F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in patterns]
        found = F.when(F.col("family") == name, F.coalesce(*each)).otherwise(found)
    return lines.select("file", found.alias("raw"), "ext").where("raw IS NOT NULL").distinct()


#: Per family: an import statement, the group of its module (0: none), and the group of what it names.
ALIASING = {
    "python": (r"(?m)^[ \t]*(?:from\s+(\S+)\s+)?import\s+(\([^)]*\)|[^\n#;]*)", 1, 2),
    "script": (r"(?m)^[ \t]*import\s+(?:type\s+)?([^;'\"]*?)\s*from\s*['\"]([^'\"]+)['\"]", 2, 1),
    "rust": (r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", 0, 1),
}
ALIASED_EXTENSIONS = {"py": "python", "rs": "rust"} | dict.fromkeys(("ts", "tsx", "js", "jsx", "mjs", "cjs"), "script")
RENAMED = r"([\w$.]+|\*)\s+as\s+([\w$]+)"


def aliases(files: DataFrame) -> DataFrame:
    """(file, alias, original, source) of the names that imports of files (path, text) rename; source is null where a statement has no module.

    original is the last part of a dotted name; for `* as x` it is the stem of the module's path. The name `_` is no alias.
    """
    family = F.element_at(F.create_map(*[F.lit(x) for pair in ALIASED_EXTENSIONS.items() for x in pair]), F.lower(extension(F.col("path"))))
    rows = files.select(F.col("path").alias("file"), "text", family.alias("family")).where("family IS NOT NULL")
    found, module, names = F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit("")
    for name, (pattern, of, what) in ALIASING.items():
        this = F.col("family") == name
        found = F.when(this, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(found)
        module = F.when(this, F.nullif(F.regexp_extract("said", pattern, of), F.lit("")) if of else F.lit(None).cast("string")).otherwise(module)
        names = F.when(this, F.regexp_extract("said", pattern, what)).otherwise(names)
    said = rows.select("file", "family", F.explode(found).alias("said")).select("file", module.alias("source"), F.explode(F.regexp_extract_all(names, F.lit(RENAMED), F.lit(0))).alias("pair"))
    whole = F.regexp_extract("pair", RENAMED, 1)
    stem = F.regexp_replace(F.substring_index("source", "/", -1), r"\.\w+$", "")
    original = F.when(whole == "*", stem).otherwise(F.substring_index(whole, ".", -1))
    return said.select("file", F.regexp_extract("pair", RENAMED, 2).alias("alias"), original.alias("original"), "source").where("alias <> '_'")


def folded(path: Column) -> Column:
    """A path without empty and `.` parts and with `..` taken back."""
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _below(base: Column, parts: Column, ends: list[str]) -> Column:
    """The whole path with every end, then the path without its last part."""
    join = lambda p: F.when(base == "", F.array_join(p, "/")).otherwise(F.concat_ws("/", base, F.array_join(p, "/")))
    whole, short = join(parts), join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    last = F.array(*[F.concat(short, F.lit(e)) for e in ends])
    return F.concat(F.array(*[F.concat(whole, F.lit(e)) for e in ends]), F.when(F.size(parts) > 1, last).otherwise(F.array().cast("array<string>")))


def candidates(name: Column, ext: Column, file: Column) -> Column:
    """Paths that an import could mean, best first: Python from the root and from src/, scripts by relative path, Rust by crate, self and super."""
    none = F.array().cast("array<string>")
    here = F.when(file.contains("/"), F.regexp_replace(file, "/[^/]*$", "")).otherwise("")
    dots = F.split(name, r"\.")
    python = F.when(F.array_contains(dots, ""), none).otherwise(F.concat(*[_below(F.lit(b), dots, [".py", "/__init__.py"]) for b in ("", "src")]))
    base = folded(F.concat_ws("/", here, name))
    swapped = F.when(base.endswith(".js"), F.array(*[F.concat(F.regexp_replace(base, r"\.js$", ""), F.lit(e)) for e in (".ts", ".tsx")])).otherwise(none)
    more = [F.concat(base, F.lit(e)) for e in SCRIPT_ENDS] + [F.concat(base, F.lit("/" + i)) for i in SCRIPT_INDEX]
    script = F.when(name.rlike(r"^\.\.?/"), F.concat(F.array(base), swapped, F.array(*more))).otherwise(none)
    parts = F.split(name, "::")
    head = F.element_at(parts, 1)
    stem = F.regexp_replace(file, r"\.rs$", "")
    own = F.when(file.rlike(r"(^|/)(mod|lib|main)\.rs$"), here).otherwise(stem)
    crate = F.when(file.rlike("(^|/)src/"), F.regexp_extract(file, "^(.*/)?src/", 0)).otherwise("")
    rest = F.filter(parts, lambda p: ~p.isin("crate", "self", "super"))
    up = folded(F.concat_ws("/", own, F.array_join(F.transform(F.filter(parts, lambda p: p == "super"), lambda p: F.lit("..")), "/")))
    start = F.when(head == "crate", F.regexp_replace(crate, "/$", "")).when(head == "self", own).when(head == "super", up)
    rust = F.when(start.isNotNull() & (F.size(rest) > 0), _below(start, rest, [".rs", "/mod.rs"])).otherwise(none)
    return F.when(ext.isin("py", "pyi"), python).when(ext.isin(SCRIPT), script).when(ext == "rs", rust).otherwise(none)


def resolve(found: DataFrame, files: DataFrame, go_module: str | None = None) -> DataFrame:
    """(src, dst, raw): statements (file, raw, ext) with the first candidate that is one of the files (path).

    Go packages resolve to the least file of their folder, by the module's path.
    """
    named = found.select("file", "ext", "raw", import_path(F.col("raw"), F.col("ext")).alias("name")).where("name IS NOT NULL")
    # candidates are formed once for each name, not for each statement; only relative ones depend on the file
    named = named.withColumn("base", F.when(F.col("ext").isin(*SCRIPT, "rs"), F.col("file")).otherwise(""))
    tried = named.select("name", "ext", "base").distinct().select("name", "ext", "base", F.posexplode(candidates(F.col("name"), F.col("ext"), F.col("base"))).alias("pos", "path"))
    best = tried.join(files.select("path"), "path").groupBy("name", "ext", "base").agg(F.min_by("path", "pos").alias("dst"))
    out = named.join(best, ["name", "ext", "base"]).select(F.col("file").alias("src"), "dst", "raw")
    if go_module:
        folder = F.ltrim(F.substring(F.col("name"), len(go_module) + 1, 1 << 20), F.lit("/"))
        go = named.where((F.col("ext") == "go") & F.col("name").startswith(go_module)).select("file", "raw", folder.alias("folder")).where("folder <> ''")
        packages = files.where(F.col("path").endswith(".go") & F.col("path").contains("/")).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.min("path").alias("dst"))
        out = out.unionByName(go.join(packages, "folder").select(F.col("file").alias("src"), "dst", "raw"))
    return out.distinct()
