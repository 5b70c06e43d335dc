"""Each operator and stage on empty tables, clashing columns, nulls, repeats; queries against plain Python."""

import hashlib
import re
import struct
import zlib

import plain_jpeg
import public_tokenizers as P
import pytest

import corpus_pipeline
from loomgraph.llm import op1_warc, op2_ngram_jaccard, op3_quality, op4_url_filter, op5_embedding_dedup, op6_secrets, op7_byte_bpe, op8_mixing, op9_media, op10_license

SF = "/root/testdata/sf0.001"
#: Columns that have the names of the operators' own.
CLASH = ("id", "node", "n", "w", "k", "t", "a", "b", "size", "ord", "key", "component", "block", "tokens", "s", "target", "taken", "epochs", "rest", "end", "score", "verdict", "host", "path", "rule", "media", "present", "e0", "cand", "base", "spans", "url", "html", "payload", "origin", "label", "y", "x", "bucket", "first", "ids")
RPATH = "byte_bpe_50k.tiktoken"


def wide(spark, rows, ddl):
    own = [c.split()[0] for c in ddl.split(", ")]
    extra = [c for c in CLASH if c not in own]
    return spark.createDataFrame([(*r, *extra) for r in rows], ", ".join([ddl, *[f"`{c}` string" for c in extra]]))


DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta " * 20
ROWS = [(1, LONG, "en", "s", 5), (1, LONG, "en", "s", 5), (2, None, None, None, None), (None, LONG, "en", "s", 1), (None, None, None, None, None), (3, "", "", "", 0), (4, LONG, "x", None, 9), (5, "tie", "x", "q", 3), (6, "tie", "x", "q", 3)]


def operators(spark, labels):
    return {
        "op2": lambda d: op2_ngram_jaccard.ngram_jaccard_groups(d), "op2_keep": lambda d: op2_ngram_jaccard.keep_one_of_each(d),
        "op3": lambda d: op3_quality.quality_scores(d, labels), "op3_keep": lambda d: op3_quality.keep_good(d, labels),
        "op6": lambda d: op6_secrets.secret_spans(d), "op6_redact": lambda d: op6_secrets.redact(d),
        "op7": lambda d: op7_byte_bpe.encode_documents(d, P.path(RPATH), P.PATTERN),
        "op8": lambda d: op8_mixing.mix_sources(d), "op8_copies": lambda d: op8_mixing.mix_copies(d),
        "op9": lambda d: op9_media.read_back(op9_media.store_texts(d)), "op10": lambda d: op10_license.license_scan(d)}


@pytest.mark.parametrize("name", ["op2", "op2_keep", "op3", "op3_keep", "op6", "op6_redact", "op7", "op8", "op8_copies", "op9", "op10"])
def test_documents(spark, name):
    labels = wide(spark, [(1, 1, 0), (4, 0, 0), (None, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for rows in (ROWS, [], [(None, None, None, None, None)] * 3):
        docs = wide(spark, rows, DOC)
        out = operators(spark, labels)[name](docs)
        got = out.collect()
        if name in ("op2_keep", "op3_keep", "op6_redact", "op8_copies"):
            assert out.columns == docs.columns
            assert {r.doc_id for r in got} <= {r[0] for r in rows}
        else:
            assert len(got) == len(rows)
        if not rows:
            assert got == []
    if name == "op2_keep":  # copies of 1 go, repeats of its own row and rows without an id stay
        kept = operators(spark, labels)[name](wide(spark, ROWS, DOC)).collect()
        assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "1", "2", "None", "None", "3", "5"])


def test_pages(spark):
    for rows in ([(1, "https://a.org/fr/x", "x"), (None, None, None), (1, "https://a.org/fr/x", "x"), (2, "", "")], []):
        pages = wide(spark, rows, "page_id long, url string, html string")
        assert op4_url_filter.url_filter(pages).count() == len(rows)
        path = f"{op1_warc.shared_dir(spark)}/edge-{len(rows)}"
        op1_warc.write_warc(pages, path)
        assert op1_warc.with_revisits(op1_warc.read_warc(spark, path)).count() == len(rows)


def test_vectors(spark):
    for rows in ([(1, [1.0, 0.0], 1), (2, [2.0, 0.0], None), (2, [2.0, 0.0], None), (None, None, None), (3, [], 0), (4, [1.0], 0)], [], [(None, None, None)]):
        out = op5_embedding_dedup.near_embeddings(wide(spark, rows, "vec_id long, embedding array<double>, label int")).collect()
        assert sorted(str(r.id) for r in out) == sorted(str(r[0]) for r in rows)  # a row for each vector
        assert [(r.n_links, r.component) for r in out if r.id == 2] == ([(2, 1), (2, 1)] if len(rows) > 3 else [])


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, stage, tmp_path):
    """Every stage works on nothing, on nulls alone and on the edge rows."""
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ROWS, [], [(None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, DOC)
        out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
        got = out.collect()
        assert stage == "tokens" or out.columns == docs.columns
        if stage in ("quality", "secrets", "tokens"):
            assert len(got) == len(rows)
    extra = wide(spark, ROWS, DOC)  # columns with the names of the operators' own
    out = dict(corpus_pipeline.STAGES)[stage](spark, extra, str(tmp_path))
    got = out.collect()
    assert got and (stage == "tokens" or out.columns == extra.columns and all(r[c] == c for r in got for c in CLASH if c in extra.columns and c not in docs.columns))


# --- queries against plain Python -------------------------------------------


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_url_query(spark):
    rules = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
    got = {r.page_id: r for r in op4_url_filter.query(spark, SF).collect()}
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        r, m = got.pop(page.page_id), re.match(r"(?s).*?://([^/?#]*)([^?#]*)", page.url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if ("." + host).endswith("." + h) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == max(fits)[1:] if fits else r.rule is None and r.verdict in ("allow", "block")
    assert not got


def known(text):
    """The known forms, by positions one after the other."""
    word = r"[A-Za-z0-9+/_.=-]"
    out, at = [], 0
    for kind, form, least in ((0, re.compile(rf"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?({word}+)"""), 6), (1, re.compile("(AKIA[A-Z0-9]+)"), 20), (2, re.compile("([0-9a-f]+)"), 24)):
        at = 0
        while m := form.search(text, at):
            at = m.end()
            if len(m[1]) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_secret_query(spark, texts):
    names = ("assign", "access", "hex")
    for r in op6_secrets.query(spark, SF).collect():
        base = known(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        spans = [f"{names[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) | {""}


def test_media_query(spark, texts):
    for r in op9_media.query(spark, SF).collect():
        raw = texts[r.doc_id].encode()
        want = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))


def test_media_features(spark, texts):
    """File digests, payloads and features of stored texts by the plain reader."""
    chosen = {i: t for i, t in texts.items() if len(t) < 900}
    chosen = dict(sorted(chosen.items())[:12]) | {-1: "", -2: "é" * 200, -3: "\x00\x7f" * 97, -4: "x" * 384}
    docs = spark.createDataFrame(list(chosen.items()), "doc_id long, text string")
    stored = op9_media.store_texts(docs)
    media = {r.id: bytes(r.media) for r in stored.collect()}
    tensors = {r.id: (r.width, r.height, bytes(r.rgb)) for r in op9_media.rgb_tensors(stored).collect()}
    for r in op9_media.read_back(stored).collect():
        width, height, comment, parts = plain_jpeg.read(media[r.id])
        assert [(h, v) for h, v, _, _ in parts] == [(2, 2), (1, 1), (1, 1)]
        units = [[parts[0][2][2 * y][2 * x], parts[0][2][2 * y][2 * x + 1], parts[0][2][2 * y + 1][2 * x], parts[0][2][2 * y + 1][2 * x + 1], parts[1][2][y][x], parts[2][2][y][x]] for y in range(height // 16) for x in range(width // 16)]
        payload = bytes(c - 256 for unit in units for block in unit for c in block)[: 64 * struct.unpack(">Q", comment)[0]]
        raw = chosen[r.id].encode()
        assert payload == raw + bytes(len(payload) - len(raw)) and len(payload) == r.payload_bytes
        assert (r.payload_sha256, r.media_sha256, r.media_bytes) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media[r.id]).hexdigest(), len(media[r.id]))
        rgb = plain_jpeg.pixels(width, height, parts)
        size, *stats = r.feature.split()
        assert size == f"{width}x{height}" and tensors[r.id][:2] == (width, height)
        # halves may round to either side
        flat = [c for row in rgb for p in row for c in p]
        assert max(abs(a - b) for a, b in zip(flat, tensors[r.id][2])) <= 2 and len(flat) == len(tensors[r.id][2])
        for k, s in enumerate(stats):
            own = flat[k::3]
            mean = sum(own) / len(own)
            deviation = (sum(x * x for x in own) / len(own) - mean**2) ** 0.5
            assert tuple(map(float, s.split("±"))) == pytest.approx((mean, deviation), abs=0.05)


def test_media_of_long_texts():
    """A text of more macroblocks than one column holds."""
    payload = bytes(i * 7 % 251 for i in range(64 * 6 * 4095 + 64))
    back, image = op9_media.load(op9_media.store(payload))
    assert back == payload and image.width == 32


def test_bpe_query(spark, texts):
    import tiktoken

    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op7_byte_bpe.load_ranks(P.path(RPATH)), special_tokens={})
    got = op7_byte_bpe.query(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_license_query(spark, texts):
    for r in op10_license.query(spark, SF).collect():
        want = op10_license.brute_force(texts[r.doc_id])
        found = want.pop("found")
        assert {k: r[k] for k in want} == want
        assert r.labels == ",".join(sorted({f[0] for f in found})) and r.score == pytest.approx(max((f[3] for f in found), default=0.0))


def test_letters_with_an_ascii_lower_case(spark):
    texts = ["under the MIT licen\u017fe", "CC BY NC", "\u212aC BY NC cc by nc", "under the m\u0130t license", "\u0130 CC BY NC \u00c9 \u03a3", "m\u0131t under the MIT license"]
    words = [("cc by nc", "x"), ("k", "y"), ("i", "z"), ("under the mit license", "m")]
    for r in op10_license.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), phrases=words, templates=()).collect():
        want = op10_license.brute_force(texts[r.id], phrases=words, templates=())
        assert r.n_words == want["n_words"] and sorted((f.label, f.base, f.start) for f in r.found) == [f[:3] for f in want["found"]]


@pytest.mark.parametrize("phrase", ["a a", "b", "a b a b", "x y x"])
def test_phrases_of_few_words(spark, phrase):
    rows = [(1, "a a a b a b a b x y x y x a a"), (2, "b"), (3, None)]
    out = op10_license.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases=((phrase, "own"),), templates=()).collect()
    for r in out:
        want = op10_license.brute_force(dict(rows)[r.id], phrases=((phrase, "own"),), templates=())["found"]
        assert sorted(f.start for f in r.found) == [f[2] for f in want]
