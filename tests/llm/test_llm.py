"""The training-text operators on small tables, against brute force and round trips."""

import base64
import hashlib
import math
import random
import struct
import uuid

import numpy as np
import public_tokenizers as P
import pytest

from loomgraph.llm import op1_warc, op2_ngram_jaccard, op3_quality, op4_url_filter, op5_embedding_dedup, op6_secrets, op7_byte_bpe, op8_mixing, op9_media, op10_license
from loomgraph.llm import progressive_jpeg as jpeg
from loomgraph.llm.common import connected_components, shared_dir

DOCS = "doc_id long, text string, source string, size int"


def docs(spark, rows):
    """Documents with a column that has the name of an operator's own."""
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], DOCS)


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "long " * 30_000), (7, "one two"), (None, "a b c d"), (8, "licensed under the MIT license")]


def closure(links, nodes):
    up = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 40)])
def test_ngram_join(spark, n, num):
    rng = random.Random(n)
    rows = list(EDGE)
    for base in range(12):
        words = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice((4, 12, 60, 200)))]
        for k in range(6):
            copy = list(words)
            for _ in range(k * len(words) // 60):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            rows.append((100 + 10 * base + k, " ".join(copy)))
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = {i: (len(sets[i]), c) for i, c in closure(links, ids).items()} | {None: (len(sets[None]), None)}
    got = op2_ngram_jaccard.ngram_jaccard_groups(docs(spark, rows), n=n, num=num).collect()
    assert len(got) == len(rows) and {r.node: (r.n, r.component) for r in got} == want


def links_of(rows, cosine=0.95):
    """(id, links, component) of every row by comparing all pairs, scaled before squaring."""
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: [x / max(map(abs, rows[k][1])) for x in rows[k][1]] for k in ok}
    unit = {k: np.array(v) / math.sqrt(sum(x * x for x in v)) for k, v in unit.items()}
    near = [(a, b) for a in ok for b in ok if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    lead = {k: rows[k][0] for k in ok}
    for _ in ok:
        old = dict(lead)
        for a, b in near:
            lead[a] = lead[b] = min(lead[a], lead[b])
        if old == lead:
            break
    count = [0] * len(rows)
    for a, b in near:
        count[a] += 1
        count[b] += 1
    return [(i, count[k], lead.get(k, i)) for k, (i, _) in enumerate(rows)]


def test_warc(spark):
    big = "é" * 100_000
    rows = [(3, "http://a/", "x"), (1, None, None), (2, "http://b/", ""), (5, "http://c/", big), (4, "http://d/", big), (None, "u", "x"), (3, "http://a/", "x")]
    path = f"{shared_dir(spark)}/w-{uuid.uuid4().hex}"
    op1_warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, segment_bytes=5000)
    got = op1_warc.read_warc(spark, path)
    assert sorted((str(r.page_id), bytes(r.payload)) for r in got.collect()) == sorted((str(i), (h or "").encode()) for i, _, h in rows)
    out = {(r.page_id, r.record_type, r.refers_to) for r in op1_warc.with_revisits(got).collect()}
    assert out == {(3, "response", None), (None, "revisit", 3), (1, "response", None), (2, "revisit", 1), (4, "response", None), (5, "revisit", 4)}
    assert op1_warc.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    with pytest.raises(ValueError):
        op1_warc.dechunked(b"5\r\nab\r\n0\r\n\r\n")


def test_quality(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    good = [(i, " ".join(word() for _ in range(60)) + ".") for i in range(200)]
    bad = [(i, " ".join(word().upper() + "!!" for _ in range(60))) for i in range(200, 300)]
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(300)] + [(None, 1), (5, None), (9999, 0)], "doc_id long, quality int")
    out = op3_quality.quality_scores(docs(spark, good + bad + [(400, None), (401, "")]), labels).collect()
    assert len(out) == 302 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.id < 300]
    assert len(held) > 30 and sum((r.score >= 0.3) == (r.id < 200) for r in held) / len(held) > 0.97
    assert op3_quality.quality_scores(docs(spark, good[:3]), labels.limit(0)).count() == 3


def test_urls(spark):
    rows = [(1, "https://A.net/x"), (2, "http://example.net/en/1"), (3, "http://m.example.com/de/?q"), (4, "http://b.org/fr/#t"), (5, None), (6, "nothing"), (7, "http://net"), (8, "http://badexample.com/de/")]
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in op4_url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2][2:] == ("example.net/en/", "allow") and got[3] == ("m.example.com", "/de/", "example.com/de/", "block")
    assert got[4][2:] == ("org/fr/", "allow") and got[5][:3] == got[6][:3] == ("", "", None) and got[7][2] is None and got[8][2] is None


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    model = op4_url_filter.fit_trees(x[:1500], y[:1500])
    assert ((op4_url_filter.tree_scores(x[1500:], model) > 0.5) == y[1500:]).mean() > 0.95


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(v) for v in base[i % 40] + rng.normal(size=16) * 0.12 * (i % 3)]) for i in range(300)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0]), (404, rows[0][1]), (0, rows[0][1]), (None, rows[0][1]), (405, [None] * 16)]
    got = op5_embedding_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=32).collect()
    assert sorted(((r.id, r.n_links, r.component) for r in got), key=str) == sorted(links_of(rows), key=str)


def test_secrets(spark):
    rng = random.Random(5)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    text = f'x Password: "abc123def" AKIA{"Q" * 16} {"0af1" * 7} token=token:zzzzzz é {key} {"a1" * 20} end'
    got = {r.id: [(s.start, s.kind, s.end) for s in r.spans] for r in op6_secrets.secret_spans(docs(spark, [(1, text), *EDGE[1:4], (9, None)])).collect()}
    named = [(text[a:b].lstrip('"'), k) for a, k, b in got[1]]
    assert ('Password: "abc123def', 0) in named and ("AKIA" + "Q" * 16, 1) in named and ("0af1" * 7, 2) in named and (key, 3) in named
    assert not any(t.startswith("token") or t == "a1" * 20 for t, k in named if k != 2) and got[2] == got[9] == []
    clean = op6_secrets.redact(docs(spark, [(1, text), (2, None)])).collect()
    assert key not in clean[0].text and "end" in clean[0].text and clean[1].text is None


def test_bpe(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    rows = [*EDGE, *[(50 + i, "".join(rng.choice("abc THEthe'sé漢🎉 \n\t\x1c1!") for _ in range(40))) for i in range(200)], (999, "ab" * 5000)]
    got = op7_byte_bpe.encode_documents(docs(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = {i: (tik.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows}
    for r in got:
        ids, raw = want[r.id]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (r.n_tokens, bytes(r.ids), bytes(r.decoded), r.ids_sha256) == (len(ids), packed, raw, hashlib.sha256(packed).hexdigest())
    assert len(got) == len(rows)


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", "c", "d", None])) for i in range(400)] + [(7, "x y", "a"), (None, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op8_mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(got, key=str) == sorted(op8_mixing.mix_sources(df.repartition(7)).collect(), key=str)
    by = {}
    for r in got:
        by[r.target, r.source_size] = by.get((r.target, r.source_size), 0) + r.taken
    assert all(abs(t - n) <= 3 and t <= 2 * s for (t, s), n in by.items())
    assert abs(sum(t for t, _ in by) - 1.5 * sum(s for _, s in by)) < 1e-6
    copies = op8_mixing.mix_copies(df)
    assert copies.columns == df.columns
    assert op8_mixing.mix_sources(df.limit(0)).count() == 0


def test_media(spark):
    rows = [*EDGE, (10, "é🎉" * 999)]
    texts = {i: (t or "").encode() for i, t in rows}
    for r in op9_media.read_back(op9_media.store_texts(docs(spark, rows))).collect():
        want = op9_media.padded(texts[r.id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.id]), len(want), hashlib.sha256(want).hexdigest())


@pytest.mark.parametrize("sub", [True, False])
@pytest.mark.parametrize("low", [0, 1, 3])
def test_progressive_scans(sub, low):
    y, x = np.mgrid[0:45, 0:61]
    rgb = np.stack([128 + 60 * np.sin(x / 9), 128 + 60 * np.cos(y / 7), 100 + x], 2).clip(0, 255).astype(np.uint8)
    image = jpeg.from_rgb(rgb, np.full(64, 5, np.int32), sub)
    back = jpeg.decode(jpeg.encode(image, low=low))
    assert all((a.coefs == b.coefs).all() for a, b in zip(image.parts, back.parts))
    assert np.abs(jpeg.to_rgb(back).astype(int) - rgb).mean() < 6


def test_licenses(spark):
    rows = [*EDGE, (20, "under the MIT license, Apache License Version 2.0; CC BY-NC under the mit license"), (21, "Licensed under the GNU General Public License version 3")]
    for r in op10_license.license_scan(docs(spark, rows)).collect():
        want = op10_license.brute_force(dict(rows)[r.id])
        assert r.n_words == want["n_words"] and sorted((f.label, f.base, f.start) for f in r.found) == [f[:3] for f in want["found"]]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert 0 < len(out) <= 2 * len(texts) and all(r.n_tokens * 4 == len(r.ids) for r in out)
