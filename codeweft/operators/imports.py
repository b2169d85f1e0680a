"""Import specifiers and the files they stand for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dir_name, normal_path
from ..functions.text import after, ascii_lower, before, left_strip, lines, quoted, strip
from ..session import cut

# fixed values: endings tried in this order
ENDINGS = {
    "typescript": ".ts .tsx .mts .cts .js .jsx .mjs .cjs".split(), "javascript": ".js .jsx .mjs .cjs .ts .tsx .mts .cts".split(), "go": [".go"], "php": [".php"], "csharp": [".cs"],
}


def js_import(line: Column) -> Column:
    head = line.startswith("import ") | line.startswith("export ")
    return F.when(line.startswith("import ") | (head & line.contains(" from ")), quoted(line)).otherwise(F.when(line.contains("require("), quoted(after(line, "require("))))


def php_uses(line: Column) -> Column:
    """Names of a `use` line as an array; aliases are dropped and groups spread out."""
    body = strip(F.regexp_replace(F.regexp_replace(line, "^(use )+", ""), ";+$", ""))
    usable = line.startswith("use ") & (body != "") & ~body.startswith("(") & ~body.startswith("$")
    body = F.when(body.startswith("function "), strip(after(body, "function "))).when(body.startswith("const "), strip(after(body, "const "))).otherwise(body)
    grouped = body.contains("{") & after(body, "{").contains("}")
    prefix = F.regexp_replace(strip(before(body, "{")), r"\\+$", "")

    def bare(x: Column) -> Column:
        x = F.regexp_replace(strip(x), r"^\\+", "")
        at = F.locate(" as ", ascii_lower(x))
        return F.when(at > 0, strip(F.substring(x, F.lit(1), at - 1))).otherwise(x)

    members = F.filter(F.transform(F.split(before(after(body, "{"), "}"), ","), bare), lambda x: x != "")
    plain = F.filter(F.transform(F.split(body, ","), bare), lambda x: x != "")
    return F.when(usable, F.when(grouped, F.transform(members, lambda x: F.concat(prefix, F.lit("\\"), x))).otherwise(plain))


def csharp_using(line: Column) -> Column:
    body = strip(F.regexp_replace(F.regexp_replace(line, "^(using )+", ""), ";+$", ""))
    usable = line.startswith("using ") & (body != "") & ~body.startswith("(")
    body = F.when(body.startswith("static "), strip(after(body, "static "))).otherwise(body)
    body = F.when(body.contains("="), strip(after(body, "="))).otherwise(body)
    return F.when(usable & body.rlike(r"^[A-Za-z0-9_.:<>]*$"), body)


def import_specifiers(files: DataFrame, *keep: str) -> DataFrame:
    """(keep..., path, language, line_no, specifier). files: keep..., path, content, language; a file that comes twice counts once."""
    rows = lines(files.where(F.col("language").isin(*ENDINGS)), *keep, "path", "language").withColumn("line", strip(F.col("line"))).where((F.col("line") != "") & ~F.col("line").startswith("//"))
    line, language = F.col("line"), F.col("language")
    listed = (
        F.when(language.isin("typescript", "javascript"), F.array(js_import(line)))
        .when(language == "php", php_uses(line))
        .when(language == "csharp", F.array(csharp_using(line)))
    )
    plain = rows.where(language != "go").select(*keep, "path", "language", "line_no", F.posexplode(listed).alias("nth", "specifier")).where("specifier is not null").distinct().drop("nth")
    # Go: lines within an import block; the last line that opened or closed one decides
    rest = left_strip(F.regexp_replace(line, "^(import)+", ""))
    opens = line.startswith("import") & rest.startswith("(")
    go = rows.where((language == "go") & (opens | line.startswith(")") | line.rlike("['\"]"))).distinct()
    event = F.when(opens, 1).when(line.startswith(")"), 0)
    earlier = Window.partitionBy(*keep, "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    go = go.withColumn("inside", F.coalesce(F.last(event, ignorenulls=True).over(earlier), F.lit(0)) == 1)
    spec = F.when(F.col("inside"), F.when(~line.startswith(")"), quoted(line))).otherwise(F.when(line.startswith("import") & ~rest.startswith("("), quoted(rest)))
    return plain.unionByName(go.select(*keep, "path", "language", "line_no", spec.alias("specifier"))).where("specifier is not null")


def suffix_index(paths: DataFrame) -> DataFrame:
    """(repo, suffix, path): every path suffix of a repo with its first path. paths: repo, path, both relative to the same root."""
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return paths.select("repo", "path", F.explode(suffixes).alias("suffix")).groupBy("repo", "suffix").agg(F.min("path").alias("path"))


def _candidates(base: Column, language: Column) -> Column:
    """Paths that a base may stand for with their rank: itself, with an ending, as a folder's index."""
    out = F.array(F.struct(F.lit(0).alias("rank"), base.alias("candidate")))
    for name, ends in ENDINGS.items():
        each = [F.struct(F.lit(0).alias("rank"), base.alias("candidate"))]
        each += [F.struct(F.lit(1 + i).alias("rank"), F.concat(base, F.lit(e)).alias("candidate")) for i, e in enumerate(ends)]
        each += [F.struct(F.lit(100 + i).alias("rank"), F.concat(base, F.lit(f"/index{e}")).alias("candidate")) for i, e in enumerate(ends)]
        out = F.when(language == name, F.array(*each)).otherwise(out)
    return out


def folder_modules(paths: DataFrame) -> DataFrame:
    """(repo, language, folder, path): the file that a folder stands for in Go, PHP and C#: the one named as the folder, else the first (in Go one that is no test)."""
    language = F.when(F.col("path").endswith(".go"), "go").when(F.col("path").endswith(".php"), "php").when(F.col("path").endswith(".cs"), "csharp")
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = paths.withColumn("language", language).where(F.col("language").isNotNull() & (F.size(parts) > 1)).select("repo", "language", "path", F.explode(folders).alias("folder"))
    ending = F.when(F.col("language") == "go", ".go").when(F.col("language") == "php", ".php").otherwise(".cs")
    leaf = F.concat("folder", F.lit("/"), F.element_at(F.split("folder", "/"), -1), ending)
    rank = F.when(F.col("path") == leaf, 0).when(F.col("path").endswith("_test.go"), 2).otherwise(1)
    return rows.groupBy("repo", "language", "folder").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


@dataclass(frozen=True)
class ProjectConfig:
    """What a repo's own configuration says of imports; see sources/project.py for the readers."""

    base: str | None = None
    aliases: tuple[tuple[str, str], ...] = ()
    go_module: str | None = None
    psr4: tuple[tuple[str, str], ...] = ()
    #: (folder, root namespace)
    csharp: tuple[tuple[str, str], ...] = ()


def _configured(spec: Column, language: Column, path: Column, config: ProjectConfig) -> Column:
    """Bases that the configuration gives for a specifier of the file at `path`, in the order they are tried."""

    def rest(n: int) -> Column:
        return F.substring(spec, F.lit(n + 1), F.length(spec))

    def under(folder: str, tail: Column) -> Column:
        return normal_path(F.concat(F.lit(folder + "/"), tail))

    script = [F.when(spec.startswith(a), under(f"{config.base or '.'}/{t}", rest(len(a)))) for a, t in config.aliases]
    script += [under(config.base, spec)] if config.base is not None else []
    go = [F.when(spec.startswith(config.go_module), normal_path(rest(len(config.go_module))))] if config.go_module else []
    php = [F.when(spec.startswith(p), under(d, F.replace(rest(len(p)), F.lit("\\"), F.lit("/")))) for p, d in config.psr4]
    # C#: the project that holds the file, the one with the longest folder (ties: the last namespace), then all by folder
    named = lambda d, n: F.when((spec == n) | spec.startswith(n + "."), under(d, F.replace(rest(len(n) + 1), F.lit("."), F.lit("/"))))
    projects = sorted(set(config.csharp), key=lambda p: (-len(p[0]), p))
    own = F.lit(None).cast("string")
    for d, n in sorted(projects, key=lambda p: (len(p[0]), p[1])):
        own = F.when(path.startswith(d + "/") if d else F.lit(True), named(d, n)).otherwise(own)
    cs = [own, *(named(d, n) for d, n in projects)] if projects else []
    out = F.array().cast("array<string>")
    for names, bases in ((("typescript", "javascript"), script), (("go",), go), (("php",), php), (("csharp",), cs)):
        if bases:
            out = F.when(language.isin(*names), F.filter(F.array(*bases), lambda x: x.isNotNull() & (x != ""))).otherwise(out)
    return out


def resolve_imports(specifiers: DataFrame, paths: DataFrame, config: ProjectConfig | None = None) -> DataFrame:
    """(repo, source_file, target_file), each pair once. specifiers: repo, path, language, specifier; paths: repo, path.

    Relative specifiers are resolved against the file's folder. Others are tried as the configuration says (aliases, base
    folder, module, namespaces), then by path suffix within the repo (dots are separators where there is no slash,
    backslashes in PHP). All candidates are joined by equality and the first by rank wins.
    """
    spec = F.col("specifier")
    relative = spec.startswith(".") & F.col("language").isin("typescript", "javascript")
    joined_path = normal_path(F.concat_ws("/", dir_name(F.col("path")), spec))
    as_path = F.when(F.col("language") == "php", F.replace(spec, F.lit("\\"), F.lit("/"))).otherwise(spec)
    loose = normal_path(F.when(as_path.contains("/"), as_path).otherwise(F.replace(as_path, F.lit("."), F.lit("/"))))
    exact = F.when(relative, F.array(joined_path)).otherwise(_configured(spec, F.col("language"), F.col("path"), config or ProjectConfig()))
    every_base = F.concat(F.transform(exact, lambda b, i: F.struct(i.alias("turn"), F.lit(True).alias("exact"), b.alias("base"))), F.when(relative, F.array().cast("array<struct<turn:int,exact:boolean,base:string>>")).otherwise(F.array(F.struct(F.lit(1000).alias("turn"), F.lit(False).alias("exact"), loose.alias("base")))))
    asked = specifiers.select("repo", "path", "language", spec.alias("specifier")).distinct().select("repo", F.col("path").alias("source_file"), "language", "specifier", F.inline(every_base)).where("base != ''")
    asked = cut(asked)  # three branches follow; specifiers are few next to the content they come from
    keys = ["repo", "source_file", "specifier", "turn"]
    tried = asked.select(*keys, "exact", F.inline(_candidates(F.col("base"), F.col("language"))))
    whole = paths.select("repo", F.col("path").alias("candidate"), F.col("path").alias("target_file"))
    suffixes = suffix_index(paths).select("repo", F.col("suffix").alias("candidate"), F.col("path").alias("target_file"))
    hits = tried.where("exact").join(whole, ["repo", "candidate"]).unionByName(tried.where("not exact").join(suffixes, ["repo", "candidate"]))
    folders = asked.join(folder_modules(paths).select("repo", "language", F.col("folder").alias("base"), F.col("path").alias("target_file")), ["repo", "language", "base"])
    every = hits.select(*keys, "rank", "target_file").unionByName(folders.select(*keys, F.lit(50).alias("rank"), "target_file"))
    best = every.groupBy("repo", "source_file", "specifier").agg(F.min_by("target_file", F.struct("turn", "rank", "target_file")).alias("target_file"))
    return best.select("repo", "source_file", "target_file").distinct()
