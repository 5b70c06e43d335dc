"""Column functions on workspace paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names and stems of the classification rules.
THIRD_PARTY = (".venv", "venv", "env", ".tox", "site-packages", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", "dist", "build", ".next", ".turbo", "coverage", ".cache", "dist-packages", ".git", ".hg")
EXCLUDED = (
    "node_modules", "bower_components", "jspm_packages", "vendor", "packages", "site-packages", "dist-packages", "eggs", ".eggs",
    "__pycache__", ".cache", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".hypothesis", "coverage", "htmlcov", ".nyc_output", ".coverage",
    ".git", ".hg", ".svn", ".idea", ".vs", ".vscode", "generated", "__generated__", ".serverless", ".terraform", ".pulumi",
    ".next", ".nuxt", ".output", ".turbo", ".parcel-cache", "venv", ".venv", ".tox", ".nox")
# Folders that only the broad profile excludes by name.
BUILD_OUTPUT = ("dist", "build", "out", "output", "target", "bin", "obj", "lib", ".next", ".nuxt", ".output", ".turbo", ".parcel-cache", ".webpack", ".rollup.cache")
ENVIRONMENTS = ("venv", ".venv", "env", ".env", "virtualenv", ".virtualenv", ".tox", ".nox", ".conda")
TEST_OUTPUT = ("e2e", "playwright-report", "test-results", "cypress", ".playwright")
PROFILES = {"standard": EXCLUDED, "broad": tuple(dict.fromkeys(EXCLUDED + BUILD_OUTPUT + ENVIRONMENTS + TEST_OUTPUT))}
TEST_DIRS = ("test", "tests", "spec", "__tests__")
# Application files that are no part of its structure.
UNSTRUCTURAL_DIRS = ("alembic", "migrations", "hooks")
UNSTRUCTURAL_FILES = ("playwright.config.ts", "openapi-ts.config.ts", "vite.config.ts", "vitest.config.ts", "jest.config.ts", "jest.config.js")
GENERATED_ENDS = (".gen.ts", ".gen.js", ".gen.tsx", ".gen.jsx")
# Stems of tools and manifests.
TOOLS = ("jest", "webpack", "vite", "tailwind", "eslint", "prettier", "tsconfig", "babel", "postcss", "rollup")
MANIFESTS = ("package", "package-lock", "tsconfig", "jsconfig")
# Changes of these files are tracked, but not below these folders.
TRACKED = (".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".java", ".cpp", ".c", ".cs", ".go", ".rs")
UNTRACKED_DIRS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "build", "dist", "target", "coverage", ".next", ".pytest_cache", ".mypy_cache", ".tox", "htmlcov")
# What a folder of a name is for.
PURPOSES = {
    "src": "Source code", "source": "Source code", "lib": "Libraries", "test": "Tests", "tests": "Tests", "spec": "Tests", "docs": "Documentation", "doc": "Documentation",
    "config": "Configuration", "utils": "Utilities", "helpers": "Utilities", "api": "API layer", "server": "Server code", "client": "Client code", "frontend": "Frontend",
    "backend": "Backend", "models": "Data models", "views": "Views/UI", "controllers": "Controllers", "services": "Services", "components": "Components"}


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower case with its dot; empty for a name that only begins with one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def relative(path: Column, root: str) -> Column:
    """Below root without a leading slash; the basename where the path isn't below it."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), root.replace("\\", "/").rstrip("/")
    return F.when(p.startswith(r), F.regexp_replace(F.substr(p, F.lit(len(r) + 1)), "^/", "")).otherwise(basename(p))


def resolve(base: Column, ref: Column) -> Column:
    """Absolute path of ref seen from the folder base, without . and .. parts."""
    joined = F.when(ref.startswith("/"), ref).otherwise(F.concat(base, F.lit("/"), ref))
    parts = F.filter(F.split(joined, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    up = lambda a: F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1)).otherwise(a)
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, empty, lambda a, x: F.when(x == "..", up(a)).otherwise(F.concat(a, F.array(x)))), "/"))


def file_class(rel: Column) -> Column:
    """third_party, test or app."""
    low = F.lower(rel)
    folders = F.filter(F.split(low, "/"), lambda x: x != "")
    inner = F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))
    name = basename(low)
    test = F.arrays_overlap(folders, F.array(*map(F.lit, TEST_DIRS))) | name.startswith("test_") | name.endswith("_test.py") | name.contains(".spec.") | name.contains(".test.")
    return F.when(F.arrays_overlap(inner, F.array(*map(F.lit, THIRD_PARTY))), "third_party").when(test, "test").otherwise("app")


def is_structural(rel: Column) -> Column:
    """An application file that is no migration, hook, tool configuration or generated client."""
    low = F.lower(rel)
    # a folder at the root has no slash before it and stays
    inner = F.slice(F.split(low, "/"), 2, F.greatest(F.size(F.split(low, "/")) - 2, F.lit(0)))
    generated = F.lit(False)
    for end in GENERATED_ENDS:
        generated = generated | low.endswith(end)
    return (file_class(rel) == "app") & ~F.arrays_overlap(inner, F.array(*map(F.lit, UNSTRUCTURAL_DIRS))) & ~basename(low).isin(*UNSTRUCTURAL_FILES) & ~generated


def is_tooling(rel: Column) -> Column:
    """A configuration or tool file, by its path."""
    low = F.lower(rel)
    name = stem(low)
    out = low.contains("config") | name.isin(*MANIFESTS) | name.startswith("next.") | name.startswith("vitest.")
    for tool in TOOLS:
        out = out | name.contains(tool)
    return out


def is_tracked(path: Column, own: str = "_kb") -> Column:
    """A source file whose changes count: a known extension, no generated or vendor folder, not the folder of the reports."""
    folders = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    inner = F.slice(folders, 2, F.greatest(F.size(folders) - 2, F.lit(0)))
    return extension(path).isin(*TRACKED) & ~F.arrays_overlap(inner, F.array(*map(F.lit, (*UNTRACKED_DIRS, own))))


def purpose(folder: Column) -> Column:
    """What a folder is for, by its own name."""
    low, out = F.lower(basename(folder)), F.lit("General")
    for name, text in PURPOSES.items():
        out = F.when(low == name, text).otherwise(out)
    return out


def settings_names(patterns: list[str]) -> list[str]:
    """Bare names of an editor's exclude patterns: stars at the ends and ** go; more than two characters, no star within."""
    bare = [x.replace("**/", "").replace("/**", "").strip("*").lower() for x in patterns]
    return [x for x in bare if len(x) > 2 and "*" not in x]


def is_settings_excluded(path: Column, patterns: list[str]) -> Column:
    """The lower-case path contains the bare name of a pattern."""
    out = F.lit(False)
    for name in settings_names(patterns):
        out = out | F.lower(path).contains(name)
    return out


def line_end(content: Column) -> Column:
    """The line end of a text: CRLF where it has one, else LF."""
    return F.when(content.contains("\r\n"), "CRLF").otherwise("LF")


def is_excluded(rel: Column, names=EXCLUDED, never=()) -> Column:
    """A folder of the path has an excluded name that isn't among ``never``."""
    return F.arrays_overlap(F.split(dirname(rel), "/"), F.array(*[F.lit(n) for n in names if n not in never]))


def short_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(path)


def module_name(rel: Column) -> Column:
    return F.replace(F.regexp_replace(rel, r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))


def similarity(a: Column, b: Column) -> Column:
    """Common leading folders over the deeper path's folders."""
    x, y = F.split(dirname(a), "/"), F.split(dirname(b), "/")
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q) & p.isNotNull())
    depth = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct((s["n"] + F.when(s["go"] & e, 1).otherwise(0)).alias("n"), (s["go"] & e).alias("go")), lambda s: s["n"])
    return depth / F.greatest(F.size(x), F.size(y))
