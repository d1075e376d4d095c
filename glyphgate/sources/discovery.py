"""Finding files to scan: several folders and files named one by one, ignore files of each folder, and what came of each path.

Paths are listed without their contents. Ignore rules are a table (folder, line, pattern, negated); each path meets the
rules of the folders above it, and of those that match a path, or a folder on its way, the last line of the deepest folder
decides. So rules are inherited down a tree of any size by one join on the folder. Ignore files are settings: the driver
finds them by name, level by level, and reads them. Spark's own listing leaves out files whose names begin with a dot or
an underscore, so none of these is a document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgate.sources.files import LARGEST, decoded

#: Folders that are never searched.
NEVER = (".git", "node_modules", ".hg", ".svn", "dist", "build", ".venv", "__pycache__")
IGNORE_FILE = ".gitignore"


@dataclass
class Discovery:
    """documents (path, doc_id, text, encoding), skipped (path, reason) and errors (path, reason)."""

    documents: DataFrame
    skipped: DataFrame
    errors: DataFrame


def glob_regex(glob: Column) -> Column:
    """The regular expression of an ignore pattern: ``**`` any, ``*`` and ``?`` within a name, a leading slash anchors."""
    body = F.regexp_replace(F.regexp_replace(glob, "^/", ""), "/$", "")
    body = F.regexp_replace(body, r"([.+^${}()|\[\]\\])", r"\\$1")
    for sign, to in (("**", "\0"), ("*", "[^/]*"), ("?", "[^/]"), ("\0", ".*")):
        body = F.replace(body, F.lit(sign), F.lit(to))
    return F.concat(F.when(F.startswith(glob, F.lit("/")), "^").otherwise("^(.*/)?"), body, F.lit("(/.*)?$"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def rules_of(files: DataFrame) -> DataFrame:
    """(folder, line, regex, negated) of ignore files with ``path`` and ``content``; blank lines and comments have none."""
    each = files.select(_parent(F.col("path")).alias("folder"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "raw"))
    each = each.select("folder", "line", F.rtrim(F.regexp_replace("raw", "\r$", "")).alias("raw")).where("raw <> '' AND NOT startswith(raw, '#')")
    negated = F.startswith("raw", F.lit("!"))
    return each.select("folder", "line", glob_regex(F.when(negated, F.substr("raw", F.lit(2))).otherwise(F.col("raw"))).alias("regex"), negated.alias("negated"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct (root, path) of ``paths`` that rules of the folders from root on exclude, or that a folder is excluded on the way to."""
    names = F.split(F.expr("substr(path, length(root) + 2)"), "/")
    whole = F.size(names)
    # Each prefix of the way, seen from each folder at or above its own.
    steps = F.flatten(
        F.transform(F.sequence(F.lit(1), whole), lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda d: F.struct(n.alias("way"), d.alias("depth"))))
    )
    each = paths.select("root", "path", names.alias("names"), F.explode(steps).alias("s"))
    folder = F.concat_ws("/", F.col("root"), F.when(F.col("s.depth") > 0, F.array_join(F.slice("names", F.lit(1), F.col("s.depth")), "/")))
    seen = each.select("root", "path", "s.way", "s.depth", folder.alias("folder"), F.array_join(F.slice("names", F.col("s.depth") + 1, F.col("s.way") - F.col("s.depth")), "/").alias("seen"))
    hits = seen.join(rules, "folder").where(F.regexp_like("seen", F.col("regex")))
    last = hits.groupBy("root", "path", "way").agg(F.max_by("negated", F.struct("depth", "line")).alias("negated"))
    return last.where("NOT negated").select("root", "path").distinct()


def discover(spark: SparkSession, targets: list[str], base: str, ignore_file: str = IGNORE_FILE) -> Discovery:
    """What stands at ``targets``, folders or files, relative to ``base`` or absolute; a path is found once.

    A file that is named itself is taken though it is ignored; a target that does not exist is an error. Paths are
    relative to ``base`` where they lie within it. Documents come in the order of their paths.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path(*parts)
    top = at(base).getFileSystem(conf).makeQualified(at(base)).toString().rstrip("/")
    roots, files, missing = [], [], []
    for target in targets:
        path = at(at(top), target)
        system = path.getFileSystem(conf)
        name = system.makeQualified(path).toString().rstrip("/")
        if not system.exists(path):
            missing.append((target, "does not exist"))
        elif system.getFileStatus(path).isDirectory():
            roots.append(name)
        else:
            files.append(name)
    roots, files = sorted(set(roots)), sorted(set(files))
    outermost = [r for r in roots if not any(r.startswith(f"{o}/") for o in roots)]
    alone = [f for f in files if not any(f.startswith(f"{o}/") for o in outermost)]
    named = lambda c: F.when(F.startswith(c, F.lit(f"{top}/")), F.substr(c, F.lit(len(top) + 2))).otherwise(c).alias("path")
    problems = spark.createDataFrame(missing, "path string, reason string")
    empty = spark.createDataFrame([], "path string, doc_id long, text string, encoding string")
    if not outermost and not alone:
        return Discovery(empty, empty.select("path", F.lit("").alias("reason")), problems)
    # A path with signs of a pattern is taken as it is.
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([_literal(x) for x in (*outermost, *alone)])
    explicit = F.col("path").isin(files) if files else F.lit(False)
    listed = found.select("path", "length", explicit.alias("explicit"))
    holding = F.filter(F.array(*[F.lit(r) for r in roots]).cast("array<string>"), lambda r: F.startswith(F.col("path"), F.concat(r, F.lit("/"))))
    pairs = listed.where("NOT explicit").select("path", F.explode(holding).alias("root"))
    never = r"(^|/)(" + "|".join(n.replace(".", r"\.") for n in NEVER) + ")/"
    open_ = pairs.where(~F.regexp_like(F.expr("substr(path, length(root) + 2)"), F.lit(never)))
    levels = F.size(F.split(F.expr("substr(path, length(root) + 2)"), "/"))
    deepest = pairs.agg(F.max(levels)).first()[0] or 1
    rules = rules_of(spark.createDataFrame(_ignore_files(spark, outermost, ignore_file, deepest), "path string, content string"))
    kept = open_.join(ignored(open_, rules), ["root", "path"], "left_anti").select("path").distinct()
    chosen = kept.unionByName(listed.where("explicit").select("path")).withColumn("chosen", F.lit(True))
    judged = listed.join(chosen, "path", "left").withColumn("reason", F.when(F.col("chosen").isNull(), "ignored").when(F.col("length") > LARGEST, "too large"))
    wanted = judged.where("reason IS NULL").select("path")
    read = decoded(found.where(F.col("length") <= LARGEST).select("path", "content").join(wanted, "path", "left_semi"))
    skipped = judged.where("reason IS NOT NULL").select(named(F.col("path")), "reason").unionByName(read.where("binary").select(named(F.col("path")), F.lit("binary").alias("reason")))
    text = read.where("NOT binary").select(named(F.col("path")), "text", "encoding")
    bad = text.where("text IS NULL").select("path", F.concat(F.lit("malformed "), F.col("encoding")).alias("reason"))
    documents = text.where("text IS NOT NULL").select("path", F.xxhash64("path").alias("doc_id"), "text", "encoding").orderBy("path")
    return Discovery(documents, skipped, bad.unionByName(problems))


def _ignore_files(spark: SparkSession, roots: list[str], name: str, levels: int) -> list[tuple[str, str]]:
    """(path, content) of the ignore files of ``levels`` levels of folders; one listing for each root and level."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for root in roots:
        for level in range(levels):
            pattern = jvm.org.apache.hadoop.fs.Path(_literal(root) + "/*" * level + f"/{name}")
            system = pattern.getFileSystem(conf)
            for status in system.globStatus(pattern) or []:
                if status.isFile():
                    stream = system.open(status.getPath())
                    try:
                        out.append((status.getPath().toString(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                    finally:
                        stream.close()
    return out


def _literal(path: str) -> str:
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)
