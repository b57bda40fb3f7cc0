"""Definitions and calls in source texts by line patterns: an approximation of a parse that stays in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainery.functions.text import language

# What starts a definition in each language, and words before a parenthesis that are no calls.
_C_LIKE = r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|async|export|default|sealed|partial|open|override|inline|data)\s+)*"
DEFINITIONS = {
    "python": [("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")],
    "rust": [("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)"), ("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*\{"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe)\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(\w+)")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("struct", r"^type\s+(\w+)\s+struct\b"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("type", r"^type\s+(\w+)")],
    "typescript": [("class", _C_LIKE + r"class\s+(\w+)"), ("interface", _C_LIKE + r"interface\s+(\w+)"), ("enum", _C_LIKE + r"(?:const\s+)?enum\s+(\w+)"), ("type", _C_LIKE + r"type\s+(\w+)\s*[=<]"), ("function", _C_LIKE + r"function\s*\*?\s*(\w+)"), ("function", _C_LIKE + r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")],
    "ruby": [("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)"), ("function", r"^\s*def\s+(?:self\.)?(\w+)")],
    "java": [("class", _C_LIKE + r"(?:class|record|object)\s+(\w+)"), ("interface", _C_LIKE + r"(?:interface|trait)\s+(\w+)"), ("enum", _C_LIKE + r"enum\s+(\w+)"), ("function", _C_LIKE + r"(?:fun|func|def)\s+(\w+)"), ("method", r"^\s*(?:(?:public|private|protected|internal|static|final|override|virtual|async)\s+)+[\w<>\[\],.? ]+\s+(\w+)\s*\(")],
    "c": [("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{?\s*$"), ("class", r"^\s*class\s+(\w+)"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(\w+)"), ("function", r"^(?!\s)(?!return\b|else\b|typedef\b)[\w:*&<>,~ ]+[\s*&](\w+)\s*\([^;]*$")],
}
SAME = {"javascript": "typescript", "mjs": "typescript", "cjs": "typescript", "kotlin": "java", "scala": "java", "csharp": "java", "swift": "java", "php": "typescript", "cpp": "c"}
NO_CALLS = "if for while switch match return catch fn func function def class sizeof print assert with and or not in is elif else await yield new throw typeof super self".split()


def _lines(files: DataFrame) -> DataFrame:
    lang = language(F.col("path"))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SAME.items() for x in pair]), lang), lang)
    return files.select(F.col("path").alias("file"), kind.alias("lang"), F.split("text", r"\r?\n").alias("lines")).where(F.col("lang").isin(list(DEFINITIONS))).select("file", "lang", F.size("lines").alias("total"), F.posexplode("lines").alias("pos", "line"))


def _definition():
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for lang, patterns in DEFINITIONS.items():
        first = F.lit(None).cast("struct<kind:string,name:string>")
        for kind, pattern in reversed(patterns):
            name = F.regexp_extract("line", pattern, 1)
            first = F.when(name != "", F.struct(F.lit(kind).alias("kind"), name.alias("name"))).otherwise(first)
        found = F.when(F.col("lang") == lang, first).otherwise(found)
    return found


def definitions(files: DataFrame) -> DataFrame:
    """(file, name, kind, start, end) of files (path, text): a definition ends before the next one that is indented no deeper."""
    each = _lines(files).select("file", "total", (F.col("pos") + 1).alias("start"), F.length(F.regexp_extract("line", r"^\s*", 0)).alias("indent"), _definition().alias("d")).where("d IS NOT NULL")
    own = each.groupBy("file").agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("start", "indent", F.col("d.kind").alias("kind"), F.col("d.name").alias("name")))).alias("all"))
    one = own.select("file", "total", "all", F.explode("all").alias("s"))
    after = F.filter("all", lambda x: (x["start"] > F.col("s.start")) & (x["indent"] <= F.col("s.indent")))
    end = F.coalesce(F.get(F.transform(after, lambda x: x["start"] - 1), 0), F.col("total"))
    return one.select("file", "s.name", "s.kind", "s.start", end.alias("end"))


def calls(files: DataFrame) -> DataFrame:
    """(file, line, callee): names before a parenthesis, apart from keywords and the name a line defines."""
    each = _lines(files).select("file", (F.col("pos") + 1).alias("line"), F.coalesce(_definition()["name"], F.lit("")).alias("own"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_]\w*)\s*\("), 1))).alias("callee"))
    return each.where(~F.col("callee").isin(NO_CALLS) & (F.col("callee") != F.col("own"))).select("file", "line", "callee")


def call_trace(edges: DataFrame, start: str, end: str, most: int = 5) -> DataFrame:
    """(via): null for a direct call from start to end (src, dst), else up to `most` functions between the two."""
    direct = edges.where((F.col("src") == start) & (F.col("dst") == end)).limit(1).select(F.lit(None).cast("string").alias("via"))
    out = edges.where(F.col("src") == start).select(F.col("dst").alias("via")).distinct()
    back = edges.where(F.col("dst") == end).select(F.col("src").alias("via")).distinct()
    between = out.join(back, "via").where(~F.col("via").isin(start, end)).orderBy("via").limit(most)
    return direct.unionByName(between.join(direct.select(F.lit(True).alias("d")), F.lit(True), "left_anti"))
