"""Secret scan: known forms, and a battery of randomness tests with false-discovery control.

Known forms (kinds assign, access, hex) always stay. Any other run of SHORTEST or
more characters of the base64 alphabets with a letter and a digit, outside the
known forms, is a candidate; = is padding at a run's end and parts it elsewhere,
so the value after NAME= is one of its own. Its encoding is inferred (hex, base32, alphanumeric,
base64), and its symbols' numbers are tested for uniformity (chi-squared over classes
of symbols), for runs about the middle and for serial correlation; Fisher's method
combines the three into the chance of such a result for a random string. Within each
encoding and length range, Benjamini-Hochberg over all documents' candidates finds
the ones that are not random; the others are spans of kind ``random``.

What the procedure bounds, at RATE, is the share of random strings among those that
it dismisses: secrets lost. The other error, written names that are reported, depends
on the texts; the tests measure both by length on random keys and on identifiers. The
corpus-wide step needs only counts by encoding, length range and rounded-down chance:
at most 4 x 4 x 1000 numbers.

Null text is an empty one. Texts are whole, whatever their length, and passed once.
Offsets are code points, the end exclusive. Rows are independent but for the counts;
repeats agree; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_worker, materialize

KINDS = ("assign", "access", "hex", "random")
# The known forms of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

SHORTEST, RATE, STEPS = 20, 0.01, 1000
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
PART = re.compile(r"[^=]+=*\Z|[^=]+")
#: Letters that make up most of written words; the fewer classes, the more a short run tells.
COMMON = "etaoinshrl"
_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _classes(*groups: str) -> dict[str, int]:
    return {c: i for i, g in enumerate(groups) for c in g}


def _split(letters: str) -> tuple[str, str]:
    """(common, other) letters."""
    return "".join(c for c in letters if c.lower() in COMMON), "".join(c for c in letters if c.lower() not in COMMON)


#: name, alphabet in order, the class of each symbol in the uniformity test
ENCODINGS = (
    ("hex", _DIGITS + "abcdef", _classes(*(_DIGITS + "abcdef"))),
    ("base32", _UP + "234567", _classes(*_split(_UP), "234567")),
    ("alphanumeric", _UP + _LOW + _DIGITS, _classes(_UP, *_split(_LOW), _DIGITS)),
    ("base64", _UP + _LOW + _DIGITS + "+/", _classes(_UP, *_split(_LOW), _DIGITS + "+/")),
)
#: Chance of each class for a random symbol.
_SHARES = tuple([list(classes.values()).count(i) / len(alphabet) for i in range(max(classes.values()) + 1)] for _, alphabet, classes in ENCODINGS)
LENGTHS = (32, 64, 128)


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the known forms, leftmost without overlap within a kind."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if max(map(len, text.split()), default=0) >= 24:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def infer_encoding(s: str) -> int | None:
    """Number in ENCODINGS, or None for what has no letter, no digit or another form."""
    s = s.rstrip("=")
    if "=" in s or not any(c.isdigit() for c in s) or not any(c.isalpha() for c in s):
        return None
    chars = set(s)
    if len(s) % 2 == 0 and (chars <= set("0123456789abcdef") or chars <= set("0123456789ABCDEF")):
        return 0
    if chars <= set(ENCODINGS[1][1]):
        return 1
    if chars <= set(ENCODINGS[2][1]):
        return 2
    return 3 if not (chars & set("+/") and chars & set("-_")) else None


def _normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by its recurrence in the degrees of freedom."""
    half = x / 2
    q, k = (math.erfc(math.sqrt(half)), 1) if df % 2 else (math.exp(-half), 2)
    while k < df:
        q += half ** (k / 2) * math.exp(-half) / math.gamma(k / 2 + 1)
        k += 2
    return q


def randomness(s: str, encoding: int) -> float:
    """Combined chance, for a random string, of results as odd as those of s."""
    _, alphabet, classes = ENCODINGS[encoding]
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    s = s.lower() if encoding == 0 else s
    v = [alphabet.index(c) for c in s]
    n, size = len(v), len(alphabet)
    share, counts = _SHARES[encoding], [0] * len(_SHARES[encoding])
    for c in s:
        counts[classes[c]] += 1
    uniform = _chi_tail(sum((c - n * k) ** 2 / (n * k) for c, k in zip(counts, share)), len(share) - 1)
    high = [x * 2 >= size for x in v]
    a = sum(high)
    b = n - a
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    ordered = _normal((runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    mid = sum(v) / n
    spread = sum((x - mid) ** 2 for x in v)
    serial = _normal(sum((x - mid) * (y - mid) for x, y in zip(v, v[1:])) / spread * math.sqrt(n)) if spread else 0.0
    half = -sum(math.log(max(p, 1e-12)) for p in (uniform, ordered, serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def _parts(text: str):
    """(start, end) of runs and, where = stands within one, of its parts that are long enough."""
    for m in RUN.finditer(text):
        lo = m.start()
        if "=" not in m[0]:
            yield m.span()
            continue
        for p in PART.finditer(m[0]):
            if p.end() - p.start() >= SHORTEST:
                yield lo + p.start(), lo + p.end()


def candidates(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, chance in steps) of runs that overlap no known form."""
    if max(map(len, text.split()), default=0) < SHORTEST:
        return []
    out, at, reach = [], 0, 0
    for lo, hi in _parts(text):
        # both are in order: how far the known forms that start before hi reach
        while at < len(known) and known[at][0] < hi:
            reach = max(reach, known[at][2])
            at += 1
        if reach > lo or (encoding := infer_encoding(text[lo:hi])) is None:
            continue
        stratum = encoding * (len(LENGTHS) + 1) + sum(hi - lo >= x for x in LENGTHS)
        out.append((lo, hi, stratum, min(STEPS - 1, int(randomness(text[lo:hi], encoding) * STEPS))))
    return out


def false_discovery_cuts(counts: dict[tuple[int, int], int], rate: float = RATE) -> dict[int, int]:
    """For each stratum the largest step that Benjamini-Hochberg rejects (-1: none)."""
    cuts = {}
    for stratum in {s for s, _ in counts}:
        total = sum(n for (s, _), n in counts.items() if s == stratum)
        seen, cut = 0, -1
        for step in range(STEPS):
            seen += counts.get((stratum, step), 0)
            if (step + 1) / STEPS <= rate * seen / total:
                cut = step
        cuts[stratum] = cut
    return cuts


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CAND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("step", pa.int32())])
_SCAN = pa.schema([("id", pa.int64()), ("base", pa.list_(_SPAN)), ("cand", pa.list_(_CAND))])
_DDL = "id long, base array<struct<start: long, kind: int, end: long>>, cand array<struct<start: long, end: long, stratum: int, step: int>>"


def _scan(batches):
    fresh_worker()
    for batch in batches:
        base, cand = [], []
        for x in batch.column(1):
            text = x.as_py() or ""
            known = known_spans(text)
            base.append([dict(zip(("start", "kind", "end"), s)) for s in known])
            cand.append([dict(zip(("start", "end", "stratum", "step"), c)) for c in candidates(text, known)])
        yield pa.record_batch([batch.column(0), pa.array(base, _SCAN[1].type), pa.array(cand, _SCAN[2].type)], schema=_SCAN)


def _cuts(scanned: DataFrame, rate: float) -> dict[int, int]:
    rows = scanned.select(F.explode("cand").alias("c")).groupBy("c.stratum", "c.step").count().collect()
    return false_discovery_cuts({(r["stratum"], r["step"]): r["count"] for r in rows}, rate)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(id, base, spans): arrays of (start, kind number, end), in order; spans has the random ones too."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = materialize(rows.mapInArrow(_scan, _DDL), "secrets")
    cuts = _cuts(scanned, rate)

    def random(c):
        return F.coalesce(*[F.when(c["stratum"] == s, c["step"] > step) for s, step in cuts.items()], F.lit(True))

    more = F.transform(F.filter("cand", random), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.select("id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", rate: float = RATE, mark: str = "[secret]") -> DataFrame:
    """docs with every span of ``text_col`` replaced; null texts stay null."""
    rows = docs.select(F.lit(0).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cuts = _cuts(materialize(rows.mapInArrow(_scan, _DDL).filter(F.size("cand") > 0).select("cand"), "secrets"), rate)
    place = docs.columns.index(text_col)

    def run(batches):
        fresh_worker()
        for batch in batches:
            texts = []
            for x in batch.column(place):
                text = x.as_py()
                if text:
                    known = known_spans(text)
                    spans = [(s, e) for s, _, e in known] + [(s, e) for s, e, g, step in candidates(text, known) if step > cuts.get(g, -1)]
                    out, at = [], 0
                    for s, e in sorted(spans):
                        if s >= at:
                            out += [text[at:s], mark]
                        at = max(at, e)
                    text = "".join(out) + text[at:] if out else text
                texts.append(text)
            cols = list(batch.columns)
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _joined(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the secrets of every document."""
    out = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select(F.col("id").alias("doc_id"), n(0), n(1), n(2), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
