"""The pipeline's rows against its five stages in plain Python."""

import hashlib
import math
import re
import struct
from collections import Counter

import public_tokenizers as P

import corpus_pipeline
from loomgraph.llm import op3_quality, op6_secrets
from loomgraph.llm.op7_byte_bpe import load_ranks

SF = "/root/testdata/sf0.001"


def near_duplicates(docs):
    sets = {}
    for i, (text, _) in docs.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: d for i, d in docs.items() if root(i) == i}


def secrets(docs):
    """Benjamini-Hochberg by sorting all chances of a stratum, then marks from left to right."""
    found = {i: op6_secrets.candidates(t or "", op6_secrets.known_spans(t or "")) for i, (t, _) in docs.items()}
    chances = {}
    for _, _, stratum, step in (c for cs in found.values() for c in cs):
        chances.setdefault(stratum, []).append((step + 1) / op6_secrets.STEPS)
    cut = {s: max([p for k, p in enumerate(sorted(ps), 1) if p <= op6_secrets.RATE * k / len(ps)], default=0) for s, ps in chances.items()}
    out = {}
    for i, (text, source) in docs.items():
        spans = [(s, e) for s, _, e in op6_secrets.known_spans(text or "")] + [(s, e) for s, e, g, step in found[i] if (step + 1) / op6_secrets.STEPS > cut[g]]
        if spans:
            new, at = "", 0
            for s, e in sorted(spans):
                if s >= at:
                    new += text[at:s] + "[secret]"
                at = max(at, e)
            text = new + text[at:]
        out[i] = (text, source)
    return out


def mixing(docs):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (t, _) in docs.items()}
    names = sorted({s for _, s in docs.values()}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[i] for i, d in docs.items() if d[1] == s) for s in names}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * total[s]}
        if not full:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full

    def key(i):
        u = (int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return -math.log(u) * (1 + abs(len(docs[i][0] or "") / size[i] - 6) / 6 if size[i] else 1), str(i)

    out = Counter()
    for s in names:
        rest = math.floor(target[s] + 0.5)
        own = sorted((i for i in docs if docs[i][1] == s), key=key)
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        rest -= epochs * total[s]
        for i in own:
            part = max(0, min(size[i], rest))
            rest -= part
            out[i] = math.ceil((epochs * size[i] + part) / size[i]) if size[i] else 1
    return out


def test_pipeline_brute_force(spark):
    import tiktoken

    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in op3_quality.query(spark, SF).collect() if r.predicted}
    assert 0 < len(good) < len(docs)
    docs = secrets(near_duplicates({i: d for i, d in docs.items() if i in good}))
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, n in mixing(docs).items():
        ids = tik.encode_ordinary(docs[i][0] or "")
        if n:
            want[i, len(ids), struct.pack(f"<{len(ids)}I", *ids)] = n
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
