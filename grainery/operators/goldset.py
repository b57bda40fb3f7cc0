"""Gold sets from commits: which commits make a case, the query that a subject becomes, and the lines that a patch touches. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Word lists and path patterns that decide which commits count.
SKIP_WORDS = "bump|version|semver|release|changelog|format|fmt|lint|clippy|ci|merge|chore|doc|docs|readme|typo|whitespace|spelling|revert"
KEEP_WORDS = (
    "fix|add|implement|handle|support|refactor|improve|optimis|optimiz|parse|check|validate|detect|update|remove|replace|migrate|extend|"
    "enable|disable|expose|wrap|unwrap|rework|rewrite|introduce|use|allow"
)
SIDE_PATHS = r"(^|/)(test[s_/]|spec[s_/]|__tests__|\.github/|\.circleci/|\.travis|Makefile|CMakeLists|CHANGELOG|LICENSE|\.md$|\.txt$|\.rst$|\.adoc$|benches?/|examples?/)"
PREFIX = r"^(fix|feat|feature|chore|docs|style|refactor|test|build|ci|perf|revert)(\([^)]+\))?!?\s*:\s*"
TICKET = r"(\(#\d+\)|\[#\d+\]|#\d+|\b[A-Z]+-\d+\b|GH-\d+|ISSUE-\d+)"
GENERIC = "^(fix bug|bug fix|update|cleanup|clean up|minor fix|small fix|fixes|improve|improvements?|misc|various|tweak|nit|nits)$"
MOST_FILES = 20


def is_side_path(path: Column) -> Column:
    """Tests, CI, documents, benches and examples, which are never expected results."""
    return path.rlike("(?i)" + SIDE_PATHS)


def wanted_subject(subject: Column) -> Column:
    return ~subject.rlike(rf"(?i)\b({SKIP_WORDS})\b") & subject.rlike(rf"(?i)\b({KEEP_WORDS})\b")


def subject_query(subject: Column) -> Column:
    """A subject without its prefix, tickets and final points; null under three words or if it says nothing."""
    bare = F.regexp_replace(F.regexp_replace(subject, "(?i)" + PREFIX, ""), "(?i)" + TICKET, "")
    q = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\.+$", ""), r"\s+", " "))
    return F.when((F.size(F.split(q, " ")) >= 3) & ~q.rlike("(?i)" + GENERIC), q)


def category(query: Column, files: Column) -> Column:
    q = F.lower(query)
    return F.when(files > 1, "cross_file").when(q.rlike(r"\b(where|find|locate)\b"), "symbol").when(q.rlike(r"\b(how|why|explain|what)\b"), "conceptual").otherwise("keyword_code")


def complexity(files: Column) -> Column:
    return F.when(files == 1, "low").when(files <= 5, "medium").otherwise("high")


def renamed(path: Column) -> Column:
    """The new path of `old => new` or `a/{old => new}/b`."""
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\{[^}]*? => ([^}]*)\}", "$1"), "/+", "/"), "^/|/$", "")
    return F.when(path.rlike(r"\{[^}]* => [^}]*\}"), inner).when(path.contains("=>") & ~path.contains("{"), F.trim(F.regexp_replace(path, "^.*?=>", ""))).otherwise(path)


def hunk_lines(header: Column) -> Column:
    """(first, last) of the new side of a hunk header; null for other lines and for empty hunks."""
    at = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    first, count = F.regexp_extract(header, at, 1), F.regexp_extract(header, at, 2)
    n = F.when(count == "", 1).otherwise(count.try_cast("long"))
    return F.when((first != "") & (n > 0), F.struct(first.try_cast("long").alias("first"), (first.try_cast("long") + n - 1).alias("last")))


def patched_files(patch: Column) -> Column:
    """The distinct new paths of a patch, in order of name."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/\S+ b/(\S+)"), 1)))


def cases(commits: DataFrame, touched: DataFrame) -> DataFrame:
    """commits (commit, subject), touched (commit, path, added) -> (commit, query, files, category, complexity).

    Files of a commit are counted before they are gathered, so that no commit gathers more than MOST_FILES.
    """
    source = touched.where((F.col("added") > 0) & ~is_side_path(F.col("path"))).select("commit", "path")
    few = source.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_FILES)
    listed = source.join(few, "commit").groupBy("commit").agg(F.array_sort(F.collect_set("path")).alias("files"), F.first("n").alias("n"))
    asked = commits.where(wanted_subject(F.col("subject"))).select("commit", subject_query(F.col("subject")).alias("query")).where("query IS NOT NULL")
    return asked.join(listed, "commit").select("commit", "query", "files", category(F.col("query"), F.col("n")).alias("category"), complexity(F.col("n")).alias("complexity"))


def line_set(regions: DataFrame) -> DataFrame:
    """(by, file, line) of regions (by, file, first, last), to be compared as sets."""
    return regions.select("by", "file", F.explode(F.sequence("first", "last")).alias("line")).distinct()


def numstat(lines: DataFrame, line: str = "line") -> DataFrame:
    """The columns of lines and (added, deleted, path) of `added TAB deleted TAB path` lines; binary files (`-`) and other lines are left out."""
    parts = F.split(F.trim(F.col(line)), "\t", 3)
    rows = lines.withColumn("parts", parts).where(F.size("parts") == 3)
    rows = rows.withColumn("added", F.col("parts")[0].try_cast("long")).withColumn("deleted", F.col("parts")[1].try_cast("long")).where("added IS NOT NULL AND deleted IS NOT NULL")
    return rows.withColumn("path", renamed(F.col("parts")[2])).drop("parts")


def prioritised(some: DataFrame, most: int, id: str = "id", by: str = "complexity", order: str = "seq") -> DataFrame:
    """The first `most` cases, each id once (its first row by priority): of medium complexity, then low, then high, then in their order. `place` counts from 1."""
    priority = F.when(F.col(by) == "medium", 0).when(F.col(by) == "low", 1).otherwise(2)
    rows = some.withColumn("at", F.struct(priority.alias("priority"), F.col(order).alias("seq")))
    first = rows.groupBy(id).agg(F.min_by(F.struct(*[F.col(c) for c in some.columns]), "at").alias("row"), F.min("at").alias("at"))
    few = first.orderBy("at", id).limit(most)  # a limit over an order: every task sends `most` rows at most
    return few.select("row.*", F.row_number().over(Window.orderBy("at", id)).alias("place"))


def gold_regions(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep..., file, first, last) of a JSON list of {file, start_line, end_line}, given as a string; entries without lines and the workspace prefix go."""
    kind = "array<struct<file: string, start_line: bigint, end_line: bigint>>"
    entry = rows.select(*keep, F.explode(F.from_json(column, kind)).alias("e")).where("e.start_line IS NOT NULL")
    file = F.coalesce("e.file", F.lit(""))
    bare = F.when(file.contains("/workspace/") & (F.size(F.split(file, "/", 4)) == 4), F.split(file, "/", 4)[3]).otherwise(file)
    return entry.select(*keep, bare.alias("file"), F.col("e.start_line").alias("first"), F.col("e.end_line").alias("last"))


def region_overlap(results: DataFrame, regions: DataFrame) -> DataFrame:
    """(qid, overlap): the share of a query's regions (qid, file, first, last) that a result (qid, file, first, last) of the same file overlaps."""
    numbered = regions.select("qid", "file", "first", "last").distinct()
    chunks = results.select(F.col("qid").alias("q"), F.col("file").alias("f"), F.col("first").alias("a"), F.col("last").alias("z")).distinct()
    hit = numbered.join(chunks, (F.col("qid") == F.col("q")) & (F.col("file") == F.col("f")) & (F.col("a") <= F.col("last")) & (F.col("z") >= F.col("first")), "left_semi")
    n, k = numbered.groupBy("qid").agg(F.count("*").alias("n")), hit.groupBy("qid").agg(F.count("*").alias("k"))
    return n.join(k, "qid", "left").select("qid", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("overlap"))
