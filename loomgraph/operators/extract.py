"""Lines, imports and calls of source files (path, ext, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"^[\s]+|[\s]+\z"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, SPACES, "")


def lines(files: DataFrame) -> DataFrame:
    """(path, ext, line_no from 1, line, trimmed)."""
    out = files.select("path", "ext", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    return out.select("path", "ext", (F.col("at") + 1).alias("line_no"), "line", trim(F.col("line")).alias("trimmed"))


def _found(module: Column, symbols: Column, default) -> Column:
    d = default if isinstance(default, Column) else F.lit(default)
    return F.struct(module.alias("module"), symbols.alias("symbols"), d.alias("is_default"))


def _names(text: Column) -> Column:
    """Imported names of a comma list, without alias, type mark, brackets or comment."""
    bare = F.transform(F.split(F.regexp_replace(text, r"#.*|//.*", ""), ","), lambda x: trim(F.regexp_replace(F.regexp_replace(x, r"[(){}]", " "), r"\s+as\s+.*", "")))
    return F.filter(F.transform(bare, lambda x: F.regexp_replace(x, r"^type\s+", "")), lambda x: ~x.isin("", "type"))


def _last(module: Column, sep: str = ".") -> Column:
    return F.element_at(F.split(module, r"\." if sep == "." else sep), -1)


def _python(t: Column) -> Column:
    g = lambda p, i: F.regexp_extract(t, p, i)
    frm = r"from\s+(\.{0,3}[\w.]*)\s+import\s+(.+)"
    module = g(frm, 1)
    both = lambda m: F.when(m.contains(".") & ~m.startswith("."), F.array(m, _last(m))).otherwise(F.array(m))
    first = F.transform(both(module), lambda m: _found(m, _names(g(frm, 2)), False))
    plain = F.filter(F.transform(F.split(g(r"^import\s+(.+)", 1), ","), lambda x: trim(F.regexp_replace(F.regexp_replace(x, r"#.*", ""), r"\s+as\s+.*", ""))), lambda x: x != "")
    second = F.flatten(F.transform(plain, lambda m: F.transform(both(m), lambda v: _found(v, F.array(v), True))))
    return F.when(t.rlike(frm) & (module != ""), first).when(t.rlike(r"^import\s+\S"), second)


def _script(t: Column) -> Column:
    """The first form that a line has; a list over several lines is none."""
    quoted, spaces = r"""['"]([^'"]+)['"]""", r"\s*"
    origin = rf"{spaces}from{spaces}{quoted}"
    names, space_name, start = r"\{([^}]+)\}", r"\*\s*as\s+(\w+)", r"^import\s+(?:type\s+)?"
    forms = (  # pattern, number of the module's group, of the names' groups, default or not
        (rf"^import\s+{quoted}\s*;?\z", 1, "*", False),
        (rf"^export\s*{names}{origin}", 2, (1,), False),
        (rf"^export\s*\*\s*(?:as\s+\w+\s*)?from\s*{quoted}", 1, "*", False),
        (rf"{start}(\w+)\s*,\s*(?:{names}|{space_name}){origin}", 4, (1, 2, 3), True),
        (rf"{start}{space_name}{origin}", 2, (1,), True),
        (rf"{start}{names}{origin}", 2, (1,), False),
        (rf"{start}(\w+)\s+from\s*{quoted}", 2, (1,), True),
        (rf"(?:const|let|var)\s+(\w+)\s*=\s*require\s*\(\s*{quoted}\s*\)", 2, (1,), True),
        (rf"(?:const|let|var)\s+{names}\s*=\s*require\s*\(\s*{quoted}\s*\)", 2, (1,), False),
        (rf"import\s*\(\s*{quoted}\s*\)", 1, "*", False))
    out = None
    for pattern, module, groups, default in forms:
        if groups == "*":
            found = F.array(F.lit("*"))
        else:
            found = F.concat(*[_names(F.regexp_extract(t, pattern, g)) for g in groups])
        value = F.array(_found(F.regexp_extract(t, pattern, module), found, default))
        out = F.when(t.rlike(pattern), value) if out is None else out.when(t.rlike(pattern), value)
    return out


def _java(t: Column) -> Column:
    p = r"^import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;"
    module = F.regexp_extract(t, p, 1)
    wild = F.regexp_extract(t, p, 2) != ""
    return F.when(t.rlike(p), F.array(_found(module, F.when(wild, F.array(F.lit("*"))).otherwise(F.array(_last(module))), ~wild)))


def _csharp(t: Column) -> Column:
    alias, static, plain = r"^using\s+(\w+)\s*=\s*([\w.]+)\s*;", r"^using\s+static\s+([\w.]+)\s*;", r"^using\s+([\w.]+)\s*;"
    g = lambda p, i: F.regexp_extract(t, p, i)
    return (F.when(t.rlike(alias), F.array(_found(g(alias, 2), F.array(g(alias, 1)), True)))
            .when(t.rlike(static), F.array(_found(g(static, 1), F.array(F.lit("*")), False)))
            .when(t.rlike(plain), F.array(_found(g(plain, 1), F.array(_last(g(plain, 1))), True))))


def _go(t: Column) -> Column:
    p = r'^(?:import\s+)?([\w.]+\s+)?"([^"]+)"\s*\z'
    alias, module = trim(F.regexp_extract(t, p, 1)), F.regexp_extract(t, p, 2)
    names = F.when(alias == ".", F.array(F.lit("*"))).when(alias == "_", F.array().cast("array<string>")).when(alias.isin("", "import"), F.array(_last(module, "/"))).otherwise(F.array(alias))
    return F.when(t.rlike(p), F.array(_found(module, names, ~alias.isin(".", "_"))))


def imports(files: DataFrame) -> DataFrame:
    """(path, ext, module, symbols, is_default, line_no, ord): ord is the order within a file."""
    t, ext = F.col("trimmed"), F.col("ext")
    found = (F.when(ext == ".py", _python(t)).when(ext.isin(".ts", ".tsx", ".js", ".jsx", ".mjs"), _script(t))
             .when(ext == ".java", _java(t)).when(ext == ".cs", _csharp(t)).when(ext == ".go", _go(t)))
    # a cheap guard before the patterns
    rows = lines(files).filter(t.contains("import") | t.contains("using") | t.contains("require") | t.contains("export") | t.contains('"'))
    out = rows.withColumn("found", found).select("path", "ext", "line_no", F.posexplode("found").alias("i", "f"))
    return out.select("path", "ext", "f.module", "f.symbols", "f.is_default", "line_no", (F.col("line_no") * 1000 + F.col("i")).alias("ord"))


def strength(symbols: Column, is_default: Column) -> Column:
    """0.7, more for symbols (0.05 each, 0.2 at most) and a default import, 1 at most."""
    return F.round(F.least(F.lit(1.0), 0.7 + F.least(F.lit(0.2), 0.05 * F.size(symbols)) + F.when(is_default, 0.1).otherwise(0.0)), 6)


def calls(files: DataFrame) -> DataFrame:
    """(path, line_no, callee, is_external, name) of every call in the raw lines; name has the qualifiers too."""
    hits = F.regexp_extract_all("line", F.lit(r"([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*\("), F.lit(1))
    out = lines(files).select("path", "line_no", F.explode(hits).alias("name"))
    external = F.col("name").contains(".") & ~F.col("name").startswith("this.") & ~F.col("name").startswith("self.")
    return out.select("path", "line_no", _last(F.col("name")).alias("callee"), external.alias("is_external"), "name")
