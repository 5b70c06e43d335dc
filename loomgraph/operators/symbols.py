"""Symbols, data models and function names of source files (path, ext, content)."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..plans.state import by_key
from .extract import trim

SCRIPT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
SCHEMA = "path string, name string, kind string, signature string, inherits string, exported boolean, ord long"

# what a parameter list holds: brackets may stand in it once more
_ARGS = r"\(([^()]*+(?:\([^()]*+\)[^()]*+)*+)"
_NOTES = r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:\[\w[^\]]*\]\s*)*"
_MODIFIER = r"(?:(?:public|protected|private|internal|static|final|abstract|sealed|non-sealed|strictfp|partial|readonly|ref|async|virtual|override|new|required|extern|unsafe|synchronized|default|native)\s+)"
_TYPE = r"[\w.]+(?:<[^({;=]*>)?[\[\],?]*"
_BASE = r"(?:<[^>]*>)?(?:\s+extends\s+([\w.]+))?"
_COLON = r"(?:<[^>]*>)?(?:\s*:\s*([\w.]+))?"

# extensions, kind, pattern (1: name, 2: parameters, base or a property's type)
_RULES = (
    ((".py",), "function", r"^(?:async\s+)?def\s+([A-Za-z]\w*)\s*\(([^)]*)"),
    ((".py",), "method", r"^\s+(?:async\s+)?def\s+(__init__|[A-Za-z]\w*)\s*\(([^)]*)"),
    ((".py",), "class", r"^class\s+(\w+)(?:\(\s*([\w.]*))?"),
    (SCRIPT, "function", r"^export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)[^(]*" + _ARGS),
    (SCRIPT, "class", r"^export\s+(?:default\s+)?(?:abstract\s+)?class\s+(\w+)" + _BASE),
    (SCRIPT, "interface", r"^export\s+interface\s+(\w+)" + _BASE),
    (SCRIPT, "type", r"^export\s+type\s+(\w+)()"),
    (SCRIPT, "const", r"^export\s+(?:const|let)\s+(?!enum\b)(\w+)()"),
    ((".java",), "class", rf"{_NOTES}{_MODIFIER}*class\s+(\w+)" + _BASE),
    ((".java",), "interface", rf"{_NOTES}{_MODIFIER}*interface\s+(\w+)" + _BASE),
    ((".java", ".cs"), "enum", rf"{_NOTES}{_MODIFIER}*enum\s+(\w+)()"),
    ((".java", ".cs"), "record", rf"{_NOTES}{_MODIFIER}*record\s+(?:struct\s+|class\s+)?(\w+)(?:<[^>]*>)?\s*(?:{_ARGS})?"),
    ((".cs",), "class", rf"{_NOTES}{_MODIFIER}*class\s+(\w+)" + _COLON),
    ((".cs",), "interface", rf"{_NOTES}{_MODIFIER}*interface\s+(\w+)" + _COLON),
    ((".cs",), "struct", rf"{_NOTES}{_MODIFIER}*struct\s+(\w+)()"),
    ((".java", ".cs"), "method", rf"(?=\s){_NOTES}(?=[^(=;]*\b(?:public|protected|internal)\s){_MODIFIER}+(?:<[^>]*>\s+)?{_TYPE}\s+([A-Za-z]\w*)(?:<[^>]*>)?\s*{_ARGS}"),
    ((".cs",), "property", rf"(?=\s){_NOTES}(?=[^({{=;]*\b(?:public|internal)\s){_MODIFIER}+(?={_TYPE}\s+(\w+))({_TYPE})\s+\w+\s*(?:\{{|=>)"),
    ((".go",), "function", r"^func\s+(?:\([^)]*\)\s*)?([A-Z]\w*)\s*\(([^)]*)"),
)
#: A const that is an arrow function: its parameters, or the one that needs no brackets.
_ARROW = rf"^export\s+(?:const|let)\s+\w+(?:\s*:[^\n;]*?)?\s*=(?!>)\s*(?:async\b\s*)?(?:<[^>]*>\s*)?(?:{_ARGS}\)[^=]*=>|(\w+)\s*=>)"
#: Lines that a parameter list may take, its first included.
LIST_LINES = 40


def _flat(text: Column) -> Column:
    """A script's parameters with a mark for what is destructured and without types' brackets."""
    text = F.replace(F.regexp_replace(text, r"//[^\n]*|/\*[^*]*\*/", ""), F.lit("=>"), F.lit(" "))
    inner = r"[^()\[\]{}<>]*"
    for _ in range(4):
        text = F.regexp_replace(F.regexp_replace(text, rf"\({inner}\)|<{inner}>", ""), rf"\{{{inner}\}}|\[{inner}\]", "\u0001")
    return text


def _plain(text: Column) -> Column:
    """Parameters without notes and what types are made of."""
    text = F.regexp_replace(text, r"@\w+(?:\([^()]*\))?\s+|\[\w[^\]]*\]\s*", "")
    for _ in range(3):
        text = F.regexp_replace(text, r"<[^<>]*>", "")
    return text


def _params(text: Column, most: int) -> Column:
    """(a, b, c) of a parameter list: bare names without self, cls and this; a destructured one is ...; ... beyond ``most``."""
    each = F.filter(F.transform(F.split(text, ","), lambda x: trim(F.regexp_replace(x, r"(?s)[=].*", ""))), lambda x: (x != "") & ~x.isin("self", "cls") & ~x.startswith("*"))
    each = F.transform(each, lambda x: trim(F.regexp_replace(F.regexp_replace(x, r"(?s)\??\s*:.*|\?$", ""), r"\s+", " ")))
    each = F.transform(F.filter(each, lambda x: x != "this"), lambda x: F.when(x.startswith("\u0001"), "...").otherwise(x))
    return F.concat(F.lit("("), F.array_join(F.slice(each, 1, most), ", "), F.when(F.size(each) > most, ", ...").otherwise(""), F.lit(")"))


def _unclosed(line: Column) -> Column:
    """More brackets are opened in the line than closed."""
    without = lambda b: F.length(F.replace(line, F.lit(b), F.lit("")))
    return without("(") < without(")")


def regex_symbols(files: DataFrame, most: int = 3) -> DataFrame:
    """(path, name, kind, signature, inherits, exported, ord) by one pattern a line; ord is the line.

    A parameter list may go on for LIST_LINES lines, a property's brace and an arrow may
    stand on the next one. Scripts, Java and C# show one parameter more than ``most``, as
    a syntax tree's symbols do. Null content has no symbols; a repeated definition is repeated.
    """
    def around(x: Column, i: Column) -> Column:
        rest = F.when(x.contains("(") & _unclosed(x), F.array_join(F.slice("l", i + 1, LIST_LINES), "\n"))
        return F.struct(x.alias("line"), F.get("l", i + 1).alias("next"), rest.alias("rest"))

    rows = files.select("path", "ext", F.split("content", "\n").alias("l")).select("path", "ext", F.posexplode(F.transform("l", around)).alias("at", "x"))
    rows = rows.select("path", "ext", (F.col("at") + 1).cast("long").alias("line_no"), "x.line", "x.next", "x.rest")
    t, out, none = F.col("line"), None, F.lit(None).cast("string")
    more = F.coalesce("rest", F.concat_ws("\n", "line", "next"))
    for exts, kind, pattern in _RULES:
        where = more if kind == "property" else t
        second = F.regexp_extract(where, pattern, 2)
        args, base = none, none
        if kind in ("function", "method", "record"):
            args = F.regexp_extract(F.coalesce("rest", "line"), pattern, 2)
        elif kind == "const":
            args = F.when(more.rlike(_ARROW), F.concat(F.regexp_extract(more, _ARROW, 1), F.regexp_extract(more, _ARROW, 2)))
        else:  # a property's type is its base until it is shown
            base = F.nullif(second, F.lit(""))
        seen = F.lit(True)
        if exts[0] in (".java", ".cs") and kind not in ("method", "property"):
            seen = t.rlike(rf"{_NOTES}{_MODIFIER}*public\s") | ((F.col("ext") == ".cs") & t.rlike(rf"{_NOTES}{_MODIFIER}*internal\s"))
        hit = F.struct(F.regexp_extract(where, pattern, 1).alias("name"), F.lit(kind).alias("kind"), args.alias("args"), base.alias("base"), seen.alias("exported"))
        on = F.col("ext").isin(*exts) & where.rlike(pattern)
        out = F.when(on, hit) if out is None else out.when(on, hit)
    found = rows.select("path", "ext", "line_no", F.explode(F.filter(F.array(out), lambda x: x.isNotNull())).alias("s")).select("path", "ext", "line_no", "s.*")
    script, typed, own = F.col("ext").isin(*SCRIPT), F.col("ext").isin(".java", ".cs"), F.col("kind") == "property"
    listed = F.when(script, _params(_flat(F.col("args")), most + 1)).when(typed, _params(_plain(F.col("args")), most + 1)).otherwise(_params(F.col("args"), most))
    sign = F.when(own, F.concat(F.lit(": "), "base")).when(F.col("args").isNotNull(), listed)
    return found.select("path", "name", "kind", sign.alias("signature"), F.when(~own, F.col("base")).alias("inherits"), "exported", F.col("line_no").alias("ord"))


def _python_symbols(path: str, text: str, most: int):
    def sign(f) -> str:
        args = [a.arg for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs] if a.arg not in ("self", "cls")]
        return "(" + ", ".join(args[:most]) + (", ..." if len(args) > most else "") + ")"

    todo = [(ast.parse(text), False)]
    while todo:
        node, in_class = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if not child.name.startswith("_") or child.name == "__init__":
                    yield path, child.name, "method" if in_class else "function", sign(child), None, True, child.lineno
            elif isinstance(child, ast.ClassDef):
                yield path, child.name, "class", None, ast.unparse(child.bases[0]) if child.bases else None, True, child.lineno
            todo.append((child, isinstance(child, ast.ClassDef)))


def python_symbols(files: DataFrame, most: int = 4) -> DataFrame:
    """Symbols of the .py files by their syntax tree; a file that doesn't parse has none."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"exported": pa.bool_(), "ord": pa.int64()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def run(batches):
        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    out += sorted(_python_symbols(path, text.as_py() or "", most), key=lambda s: s[6])
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pa.record_batch([pa.array([r[i] for r in out], t.type) for i, t in enumerate(schema)], schema=schema)

    return files.filter(F.col("ext") == ".py").select("path", "content").mapInArrow(run, SCHEMA)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols by syntax tree for Python, by patterns elsewhere and where the tree gives nothing."""
    tree = python_symbols(files)
    rest = files.join(tree.select("path").distinct(), "path", "left_anti")
    return tree.unionByName(regex_symbols(rest))


def data_models(files: DataFrame) -> DataFrame:
    """(file, family, name, signature) of models, by the lines of one file at a time.

    The first family that a name has in a file stays. A signature is up to three
    fields from the lines below, or a record's parameters; "..." marks the third.
    """
    L = F.split("content", "\n")
    ext = F.col("ext")
    script = ext.isin(".ts", ".tsx")
    decorated = F.col("content").rlike(r"@(Entity|Table)\b")
    cls = r"class\s+(\w+)"

    def below(i: Column, n: int) -> Column:
        return F.array_join(F.slice("l", i + 2, n), "\n")

    def at(line: Column, i: Column) -> Column:
        rules = [
            ((ext == ".py"), r"^\s*class\s+(\w+)\(.*\b(?:BaseModel|BaseSettings)\b", "validated"),
            ((ext == ".py"), r"^\s*class\s+(\w+)\(.*\bmodels\.Model\b", "orm"),
            ((ext == ".py"), r"^\s*class\s+(\w+)\(.*\b(?:Base|DeclarativeBase|SQLModel|db\.Model)\b", "orm"),
            (script, r"^\s*(?:export\s+)?interface\s+(\w+)", "interface"),
            (script, r"^\s*(?:export\s+)?type\s+(\w+)\s*=\s*\{", "type"),
            (script & decorated, r"^\s*(?:export\s+)?" + cls, "orm"),
            (ext.isin(".java", ".cs"), r"\brecord\s+(?:struct\s+|class\s+)?(\w+)\s*\(", "record")]
        ahead = [((ext == ".py"), r"^\s*@dataclass", 2, "dataclass"), ((ext == ".java"), r"^\s*@Entity\b", 4, "orm"), ((ext == ".cs"), r"^\s*\[Table\b", 2, "orm")]
        row = lambda name, family, skip: F.struct((i + skip).alias("i"), name.alias("name"), F.lit(family).alias("family"))
        out = None
        for on, p, family in rules:
            on = on & line.rlike(p)
            value = row(F.regexp_extract(line, p, 1), family, F.lit(0))
            out = F.when(on, value) if out is None else out.when(on, value)
        for on, p, n, family in ahead:
            near = F.concat(F.lit("\n"), below(i, n))
            step = F.size(F.split(F.regexp_extract(near, r"(?s)^(.*?)\b" + cls, 1), "\n")) - 1
            out = out.when(on & line.rlike(p) & near.rlike(r"\b" + cls), row(F.regexp_extract(near, r"\b" + cls, 1), family, step))
        return out

    rows = files.select("path", "ext", "content", L.alias("l"))
    rows = rows.withColumn("hits", F.filter(F.transform("l", at), lambda x: x.isNotNull()))
    rows = rows.select("path", "ext", "l", F.explode("hits").alias("h")).select("path", "ext", "l", "h.*")
    field = r"^\s+(?:(?:public|private|protected|readonly)\s+)*(?:[\w<>\[\],.]+\s+)??(\w+)\s*\??\s*(?:[:=;{])"
    near = F.slice("l", F.col("i") + 2, F.when(ext.isin(".java", ".cs"), 11).otherwise(7))
    stop = F.array_position(F.transform(near, lambda x: x.rlike(r"^\S")), True)
    near = F.when(stop > 0, F.slice(near, 1, F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(near)
    fields = F.slice(F.filter(F.transform(near, lambda x: F.regexp_extract(x, field, 1)), lambda x: x != ""), 1, 3)
    listed = F.concat(F.array_join(fields, ", "), F.when(F.size(fields) == 3, "...").otherwise(""))
    made = F.regexp_extract(F.get("l", F.col("i")), r"\(([^)]*)", 1)
    out = rows.select(F.col("path").alias("file"), "i", "family", "name", F.when(F.col("family") == "record", made).otherwise(listed).alias("signature"))
    first = out.groupBy("file", "name").agg(F.min(F.struct("i", "family", "signature")).alias("m"))
    return first.select("file", "m.family", "name", "m.signature")


# Verbs of the function-name histogram.
VERBS = ("get", "set", "create", "delete", "update", "is", "has", "handle", "process", "validate")


#: Definitions by language; each is looked for in every file, so a method can count twice.
_FUNCTIONS = (
    r"def\s+(\w+)\s*\(", r"function\s+(\w+)\s*\(", r"const\s+(\w+)\s*=\s*(?:async\s+)?\(",
    r"(?:public|protected|private)\s+(?:static\s+)?\w+\s+(\w+)\s*\(",
    r"(?:public|protected|private|internal)\s+(?:static\s+)?(?:async\s+)?\w+\s+(\w+)\s*\(")


def function_naming(files: DataFrame) -> DataFrame:
    """(verb, n, example): verbs that begin function names, counted in all files.

    The verb is followed by _ or a capital; the example is the first one of the first file.
    """
    def named(k: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), x.alias("name")))

    found = F.concat(*[named(k, p) for k, p in enumerate(_FUNCTIONS)])
    verb = F.regexp_extract("f.name", rf"^({'|'.join(VERBS)})(?:_|[A-Z])", 1)
    out = files.select("path", F.explode(found).alias("f")).withColumn("verb", verb).filter("verb <> ''")
    return out.groupBy("verb").agg(F.count("*").alias("n"), F.min_by("f.name", F.struct("path", "f")).alias("example"))


def model_group(family: Column) -> Column:
    """The group of a report that a model of a family is listed in."""
    return F.when(family == "orm", "orm").when(family.isin("dataclass", "validated"), "dataclass").when(family.isin("interface", "type"), "interface").otherwise("other")


def callers(symbols: DataFrame, links: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """(path, name, used_in): the application files that import a symbol's file, short paths, and how many more.

    An import link may use any symbol; one that became circular only those it names, all
    where it names none or a star. Links: source, target, type, symbols.
    """
    app = files.filter("file_class = 'app'").select(F.col("path").alias("source"), "rel")
    into = links.filter("source <> target").join(by_key(app), "source").select(F.col("target").alias("path"), "rel", "type", "symbols")
    may = (F.col("type") == "import") | F.array_contains("symbols", F.col("name")) | F.array_contains("symbols", "*") | (F.size("symbols") == 0)
    hits = symbols.select("path", "name").distinct().join(into, "path").filter(may).select("path", "name", "rel").distinct()
    w = Window.partitionBy("path", "name")
    top = hits.withColumn("i", F.row_number().over(w.orderBy("rel"))).filter(F.col("i") <= most)
    shown = top.groupBy("path", "name").agg(F.transform(F.array_sort(F.collect_list("rel")), P.short_path).alias("used_in"))
    more = hits.groupBy("path", "name").agg((F.count("*") - most).alias("more"))
    out = shown.join(more, ["path", "name"])
    rest = F.array(F.concat(F.lit("(+"), F.col("more").cast("string"), F.lit(" more)")))
    return out.select("path", "name", F.when(F.col("more") > 0, F.concat("used_in", rest)).otherwise(F.col("used_in")).alias("used_in"))
