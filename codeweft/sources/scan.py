"""What a scan of a source tree keeps: ignored folders and files, languages, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

#: Larger files are counted and left out.
MAX_FILE_BYTES = 512 * 1024

# fixed values: folders that a scan does not enter
IGNORED_DIRS = (
    ".git .codegraph .svn .hg node_modules dist build out output target .next .nuxt .output .turbo .svelte-kit .cache coverage .nyc_output __pycache__ .pytest_cache .mypy_cache .venv venv vendor "
    ".idea .vscode .github .gitlab .circleci .terraform .serverless"
).split()
# fixed values: files that a scan leaves out, by lower-case name
IGNORED_FILES = (
    "package-lock.json yarn.lock pnpm-lock.yaml composer.lock gemfile.lock poetry.lock cargo.lock go.sum .gitignore .gitattributes .npmrc .yarnrc .editorconfig .dockerignore .prettierignore .eslintignore license license.md license.txt "
    "changelog changelog.md code_of_conduct.md contributing.md security.md thumbs.db .ds_store"
).split()
# fixed values: and by ending
IGNORED_ENDINGS = (
    ".png .jpg .jpeg .gif .svg .ico .webp .bmp .tiff .pdf .mp4 .mp3 .wav .zip .tar .gz .rar .7z .exe .dll .so .dylib .class .jar .war .pyc .wasm .node .db .sqlite .sqlite3 .map .lock .pem .key .crt .csv .tsv .parquet .bin"
).split()
# fixed values: languages by ending
LANGUAGE_ENDINGS = {
    "typescript": ".tsx .ts", "javascript": ".jsx .js", "python": ".py", "java": ".java", "c": ".c .h", "cpp": ".cpp .cc .cxx .hpp .hxx .hh", "csharp": ".cs", "go": ".go", "rust": ".rs", "kotlin": ".kt .kts", "php": ".php .phtml .php3 .php4 .php5 .php8", "swift": ".swift",
}
#: What is extracted beyond symbols.
IMPORT_LANGUAGES = ("typescript", "javascript", "csharp", "go", "php")
CALL_LANGUAGES = ("typescript", "javascript")


def _ends(name: Column, endings: list[str]) -> Column:
    return name.rlike("(?:" + "|".join("\\" + e for e in endings) + ")$")


def in_ignored_dir(path: Column) -> Column:
    """Whether a folder of the path is ignored; the last segment is a file's name and doesn't count. Case matters."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_DIRS)))


def ignored_path(path: Column) -> Column:
    name = ascii_lower(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))
    by_name = name.isin(IGNORED_FILES) | _ends(name, IGNORED_ENDINGS) | name.contains(".bundle.") | name.contains(".chunk.") | name.contains(".generated.") | name.endswith(".d.ts")
    return in_ignored_dir(path) | ((name != "") & by_name)


def language_of(path: Column) -> Column:
    """The language by the path's ending, null for others."""
    low = ascii_lower(path)
    out = F.lit(None).cast("string")
    for name, endings in reversed(LANGUAGE_ENDINGS.items()):
        out = F.when(_ends(low, endings.split()), name).otherwise(out)
    return out


def capability(language: Column) -> Column:
    """(symbols, imports, calls and heritage) as flags."""
    return F.struct(language.isNotNull().alias("symbols"), F.coalesce(language.isin(*IMPORT_LANGUAGES), F.lit(False)).alias("imports"), F.coalesce(language.isin(*CALL_LANGUAGES), F.lit(False)).alias("relations"))


def scan_table(scanned: DataFrame, path: str = "path", size: str = "size_bytes") -> DataFrame:
    """The rows a scan keeps, with language_found; rows over the size limit are marked `skipped_large`."""
    return scanned.where(~ignored_path(F.col(path))).withColumn("skipped_large", F.coalesce(F.col(size) > MAX_FILE_BYTES, F.lit(False))).withColumn("language_found", language_of(F.col(path)))


def kept_files(spark: SparkSession, root: str) -> list[str]:
    """Names of a tree's files, ignored folders not entered: one listing a folder, through the file system the root names."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    ignored, folders, files = frozenset(IGNORED_DIRS), [top], []
    while folders:
        for status in fs.listStatus(folders.pop()):
            if not status.isDirectory():
                files.append(status.getPath().toString())
            elif status.getPath().getName() not in ignored and not status.isSymlink():
                folders.append(status.getPath())
    return sorted(files)


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, language, skipped_large, content) of a folder's files: relative paths; content is null where it is no UTF-8 or too large.

    Names come first and are filtered; only files that are kept, and are not too large, are read.
    """
    root = root.rstrip("/") or "/"
    names = kept_files(spark, root)
    home = names[0][: names[0].index(root)] + root + "/" if names else root
    rows = spark.createDataFrame([(n, n[len(home) :]) for n in names], "file string, path string")
    kept = [r["file"] for r in rows.where(~ignored_path(F.col("path"))).select("file").collect()]
    if not kept:
        return spark.createDataFrame([], "path string, size_bytes bigint, language string, skipped_large boolean, content string")
    # names are taken as they are, not as patterns
    raw = spark.read.format("binaryFile").option("__globPaths__", "false").load(kept)
    path = F.substring(F.col("path"), len(home) + 1, F.length("path"))
    found = raw.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("content").alias("raw"))
    small = found.where(F.col("size_bytes") <= MAX_FILE_BYTES)
    text = F.when(F.expr("is_valid_utf8(cast(raw as string))"), F.col("raw").cast("string"))
    large = found.where(F.col("size_bytes") > MAX_FILE_BYTES).select("path", "size_bytes", F.lit(None).cast("string").alias("content"))
    return scan_table(small.select("path", "size_bytes", text.alias("content")).unionByName(large)).select("path", "size_bytes", F.col("language_found").alias("language"), "skipped_large", "content")
