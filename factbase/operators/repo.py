"""Facts from inventories of repositories and machines.

files(owner_id, path, mtime, content) lists files; a row ending in /.git stands for the
repository mark. roots(owner_id, root) are the folders that were searched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factbase.functions.values import bucketed_rank

# ---- fixed values ----
REPO_SKIP = ["node_modules", ".cache", "venv", ".venv"]
FILE_SKIP = ["node_modules", ".git", "venv", ".venv", "__pycache__", "dist", "build", ".next", "target"]
TOP_LANGUAGES, TOP_FRAMEWORKS, MAX_PROJECTS = 5, 10, 8
EXTENSIONS = {".py": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript",
              ".rs": "Rust", ".go": "Go", ".java": "Java", ".rb": "Ruby", ".php": "PHP", ".swift": "Swift",
              ".kt": "Kotlin", ".cs": "C#", ".cpp": "C++", ".c": "C", ".dart": "Dart", ".lua": "Lua", ".zig": "Zig",
              ".ex": "Elixir", ".hs": "Haskell"}
JS_PACKAGES = {"next": "Next.js", "react": "React", "vue": "Vue.js", "nuxt": "Nuxt", "svelte": "Svelte",
               "@sveltejs/kit": "SvelteKit", "angular": "Angular", "@angular/core": "Angular", "express": "Express",
               "fastify": "Fastify", "nestjs": "NestJS", "@nestjs/core": "NestJS", "tailwindcss": "Tailwind CSS",
               "framer-motion": "Framer Motion", "prisma": "Prisma", "@prisma/client": "Prisma",
               "drizzle-orm": "Drizzle", "supabase": "Supabase", "@supabase/supabase-js": "Supabase",
               "firebase": "Firebase", "electron": "Electron", "tauri": "Tauri", "recharts": "Recharts",
               "d3": "D3.js", "three": "Three.js"}
PY_PACKAGES = {"fastapi": "FastAPI", "django": "Django", "flask": "Flask", "starlette": "Starlette",
               "sqlalchemy": "SQLAlchemy", "pandas": "pandas", "numpy": "numpy", "scipy": "scipy", "torch": "PyTorch",
               "tensorflow": "TensorFlow", "langchain": "LangChain", "llamaindex": "LlamaIndex",
               "supabase": "Supabase", "pydantic": "Pydantic", "celery": "Celery", "pytest": "pytest"}
RUBY_PACKAGES = {"rails": "Rails", "sinatra": "Sinatra"}
PY_MANIFESTS = ["requirements.txt", "Pipfile", "pyproject.toml"]
PLAIN_MANIFESTS = {"Cargo.toml": "Rust", "go.mod": "Go"}
RULE_FILES = [(".cursorrules", "cursorrules"), ("AGENTS.md", "agents-md"), (".editorconfig", "editorconfig")]
INVENTORY = {
    "editor": ["Cursor", "VS Code", "Vim", "Neovim", "Emacs", "Sublime Text", "Zed"],
    "runtime": ["Node.js", "Python", "Rust", "Go", "Java", "Ruby", "Deno", "Bun"],
    "package_manager": ["npm", "yarn", "pnpm", "pip", "cargo", "brew", "go"],
    "ai_tool": ["Claude Desktop", "ChatGPT Desktop", "Cursor", "GitHub Copilot", "Claude Code", "Ollama"],
}
# kind -> (pos, key, type, source)
LISTS = {"editor": (3, "editors.installed", "context", "tool-scan"),
         "runtime": (4, "runtimes.installed", "skill", "tool-scan"),
         "package_manager": (5, "package_managers", "context", "tool-scan"),
         "ai_tool": (6, "ai_tools", "preference", "tool-scan")}
SINGLES = {"git_name": (0, "identity.name", "identity", "git-config"),
           "git_email": (1, "identity.email", "identity", "git-config"),
           "os": (90, "system.os", "context", "system"), "shell": (91, "system.shell", "context", "system")}

REPO = ["owner_id", "repo"]


def _parent(col: str, levels: int = 1) -> Column:
    return F.regexp_extract(col, r"^(.*)" + r"/[^/]+" * levels + "$", 1)


def _name(col: str) -> Column:
    return F.element_at(F.split(col, "/"), -1)


def _has_any(col: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(p)) for p in parts])


def discover_repos(files: DataFrame, roots: DataFrame, limit: int | None = None) -> DataFrame:
    """Repositories one or two levels below a root, newest first; with `limit` the first ones of each owner."""
    marks = files.where(F.endswith("path", F.lit("/.git"))).select("owner_id", _parent("path").alias("repo"), "mtime")
    placed = marks.select("*", F.posexplode(F.array(_parent("repo", 1), _parent("repo", 2))).alias("depth", "root"))
    found = (placed.join(roots.select("owner_id", "root").distinct(), ["owner_id", "root"])
             .where(~_has_any(F.col("repo"), REPO_SKIP)))
    day = F.date_trunc("day", "mtime")
    ranked = bucketed_rank(found, ["owner_id"], {"_day": -F.unix_date(day.cast("date"))}, [F.desc("mtime"), F.col("depth"), F.col("repo")], "rank")
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select("owner_id", "repo", _name("repo").alias("name"), "mtime", "rank")


def _in_repo(files: DataFrame, repos: DataFrame, top_only: bool) -> DataFrame:
    """Files with the repository they lie in: any folder above them, or just their own folder."""
    if top_only:
        return files.withColumn("repo", _parent("path")).join(repos.select(*REPO), REPO, "left_semi")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return (files.where(F.size(parts) > 2).withColumn("repo", F.explode(above))
            .join(repos.select(*REPO), REPO, "left_semi"))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def repo_languages(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Source files per repository and language."""
    suffix = F.regexp_extract(_name("path"), r"^.+(\.[^.]+)$", 1)
    code = (files.select("owner_id", "path", _lookup(suffix, EXTENSIONS).alias("language"))
            .where(F.col("language").isNotNull() & ~_has_any(F.col("path"), FILE_SKIP)))
    return _in_repo(code, repos, top_only=False).groupBy(*REPO, "language").agg(F.count(F.lit(1)).alias("files"))


def _named(text: Column, table: dict[str, str]) -> Column:
    return F.filter(F.array(*[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in table.items()]),
                    lambda x: x.isNotNull())


def repo_frameworks(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(owner_id, repo, manifest, framework). A framework named by two manifests counts twice."""
    top = _in_repo(files, repos, top_only=True).withColumn("manifest", _name("path"))
    deps = "struct<dependencies: map<string,string>, devDependencies: map<string,string>>"
    js = (top.where(F.col("manifest") == "package.json").withColumn("_d", F.from_json("content", deps))
          .withColumn("_k", F.array_union(
              F.coalesce(F.map_keys("_d.dependencies"), F.array().cast("array<string>")),
              F.coalesce(F.map_keys("_d.devDependencies"), F.array().cast("array<string>")))))
    typed = top.where(F.col("manifest") == "tsconfig.json").select(*REPO).distinct().withColumn("_ts", F.lit(True))
    found = F.filter(F.array(*[F.when(F.array_contains("_k", k), F.lit(v)) for k, v in JS_PACKAGES.items()],
                             F.when(F.array_contains("_k", "typescript") | F.coalesce("_ts", F.lit(False)), F.lit("TypeScript"))),
                     lambda x: x.isNotNull())
    low = F.lower("content")
    js = (js.where(F.col("_d").isNotNull()).join(typed, REPO, "left")
          .select(*REPO, "manifest", F.explode(F.array_distinct(found)).alias("framework")))
    other = (F.when(F.col("manifest").isin(PY_MANIFESTS), _named(low, PY_PACKAGES))
             .when(F.col("manifest") == "Gemfile", _named(low, RUBY_PACKAGES)))
    for name, fw in PLAIN_MANIFESTS.items():
        other = other.when(F.col("manifest") == name, F.array(F.lit(fw)))
    rest = top.where(F.col("manifest").isin([*PY_MANIFESTS, "Gemfile", *PLAIN_MANIFESTS])).select(
        *REPO, "manifest", F.explode(other).alias("framework"))
    return js.unionByName(rest)


def _list_fact(df: DataFrame, rank: str, item: str, pos: int, key: str, type_: str, confidence: str, source: str) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda x: x[item])
    return (df.groupBy("owner_id").agg(items.alias("value_items"))
            .select("owner_id", F.lit(pos).cast("bigint").alias("pos"), F.lit(key).alias("key"), "value_items",
                    F.lit(True).alias("value_is_list"), F.lit(type_).alias("type"),
                    F.lit(confidence).alias("confidence"), F.lit(source).alias("source")))


def owner_stack(files: DataFrame, roots: DataFrame, top_languages: int = TOP_LANGUAGES, top_frameworks: int = TOP_FRAMEWORKS,
                max_projects: int = MAX_PROJECTS) -> DataFrame:
    """Top languages, top frameworks and recent projects of each owner as facts: top-k lists over all repositories."""
    repos = discover_repos(files, roots)
    langs = (repo_languages(files, repos).join(repos.select(*REPO, "rank"), REPO).groupBy("owner_id", "language")
             .agg(F.sum("files").alias("n"), F.min("rank").alias("first")))
    w = Window.partitionBy("owner_id").orderBy(F.desc("n"), "first", "language")
    langs = langs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_languages)
    fws = repo_frameworks(files, repos).groupBy("owner_id", "framework").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("owner_id").orderBy(F.desc("n"), "framework")
    fws = fws.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_frameworks)
    names = repos.where(F.col("rank") <= max_projects)
    return (_list_fact(langs, "r", "language", 7, "languages.primary", "skill", "high", "repo-scan")
            .unionByName(_list_fact(fws, "r", "framework", 8, "frameworks", "skill", "high", "repo-scan"))
            .unionByName(_list_fact(names, "rank", "name", 9, "projects.recent", "context", "medium", "repo-scan")))


def existing_rule_files(files: DataFrame, roots: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Per direct subfolder of a root, the first known rule file (that has changed) as a fact."""
    order = F.lit(None).cast("int")
    label = F.lit(None).cast("string")
    for i, (name, source) in enumerate(RULE_FILES):
        hit = _name("path") == name
        order, label = F.when(hit, i).otherwise(order), F.when(hit, source).otherwise(label)
    found = (files.select("owner_id", "path", "content", _parent("path").alias("dir"), _parent("path", 2).alias("root"),
                          order.alias("_o"), label.alias("_l")).where(F.col("_o").isNotNull())
             .join(roots.select("owner_id", "root").distinct(), ["owner_id", "root"], "left_semi"))
    if changed is not None:
        found = found.join(changed.select("owner_id", "path").distinct(), ["owner_id", "path"], "left_semi")
    first = found.groupBy("owner_id", "dir").agg(F.min_by(F.struct(
        "_o", "_l", F.col("content").alias("text")), "_o").alias("f"))
    return first.select(
        "owner_id", (F.col("f._o") + 10).cast("bigint").alias("pos"), F.concat(F.lit("existing_rules."), "f._l").alias("key"),
        F.array(F.concat(F.lit("Found in "), _name("dir"), F.lit(": "), "f.text")).alias("value_items"),
        F.lit(False).alias("value_is_list"), F.lit("context").alias("type"), F.lit("high").alias("confidence"),
        F.concat(F.lit("file-scan-"), "f._l").alias("source"))


def inventory_to_facts(observations: DataFrame) -> DataFrame:
    """observations(owner_id, kind, name). Lists follow the fixed vocabularies, so they are short; one pass."""
    kind, name = F.col("kind"), F.col("name")
    seen = {(k, i): F.bool_or((kind == k) & (name == n)).alias(f"_{k}{i}") for k, names in INVENTORY.items() for i, n in enumerate(names)}
    least = {k: F.min(F.when((kind == k) & (name != ""), name)).alias(f"_{k}") for k in SINGLES}
    per = observations.groupBy("owner_id").agg(*seen.values(), *least.values())
    have = {k: F.filter(F.array(*[F.when(F.col(f"_{k}{i}"), F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
            for k, names in INVENTORY.items()}

    def fact(cond: Column, pos: int, key: str, items: Column, many: bool, type_: str, confidence: str, source: str) -> Column:
        return F.when(cond, F.struct(
            F.lit(pos).cast("bigint").alias("pos"), F.lit(key).alias("key"), items.alias("value_items"), F.lit(many).alias("value_is_list"),
            F.lit(type_).alias("type"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source")))

    rows = [fact(F.size(have["editor"]) > 0, 2, "editor", F.slice(have["editor"], 1, 1), False, "preference", "medium", "tool-scan")]
    for k, (pos, key, type_, source) in LISTS.items():
        rows.append(fact(F.size(have[k]) > (1 if k == "editor" else 0), pos, key, have[k], True, type_, "high", source))
    for k, (pos, key, type_, source) in SINGLES.items():
        value = _name(f"_{k}") if k == "shell" else F.col(f"_{k}")
        rows.append(fact(F.col(f"_{k}").isNotNull(), pos, key, F.array(value), False, type_, "high", source))
    return per.select("owner_id", F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))


def scanned_packs(facts: DataFrame, as_of) -> DataFrame:
    """Pack rows of a scan; the observed system, if any, is the last tag."""
    system = F.max(F.when(F.col("key") == "system.os", F.lower(F.get("value_items", F.lit(0)))))
    tags = F.array(F.lit("scanned"), F.lit("auto"), "system")
    return facts.groupBy("owner_id").agg(system.alias("system")).select(
        "owner_id", F.lit("scanned").alias("pack"), F.lit("development").alias("scope"),
        F.concat(F.lit("Auto-scanned on "), F.date_format(F.lit(as_of).cast("timestamp_ntz"), "yyyy-MM-dd")).alias("description"),
        F.filter(tags, lambda t: t.isNotNull()).alias("tags"))


def scan_to_packs(facts: list[DataFrame], previous: DataFrame | None = None) -> DataFrame:
    """All scan facts as pack "scanned". Facts of sources that were skipped as unchanged are
    carried over from the previous scan, unless the new scan has the key."""
    new = reduce(DataFrame.unionByName, facts).withColumn("pack", F.lit("scanned"))
    if previous is None:
        return new
    keep = previous.join(new.select("owner_id", "key").distinct(), ["owner_id", "key"], "left_anti")
    return new.unionByName(keep.select(*new.columns))
