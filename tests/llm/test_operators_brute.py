"""Corpus operators against brute force where SQL doesn't reach: gradients, packing's pieces, recall, ranks of hosts."""

import random
import zlib

import numpy as np

from lociframe.llm import embeddings, hosts, packing, quality, substrings

SF = "/root/testdata/sf0.001"


def test_attention_gradients_by_differences():
    """Each kind of weight: the gradient along its largest entries and along a random direction equals the difference quotient."""
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, quality.WIDTH)) for n in (1, 4, 2, 6)]
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    x, starts = np.concatenate(bags), np.cumsum([0, 1, 4, 2])
    model = quality.Model()
    model.w = {k: w + 0.1 * rng.normal(size=w.shape) for k, w in model.w.items()}

    def loss():
        p = model.forward(x, starts)["p"]
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    grads = model.gradients(x, starts, labels)
    assert grads.keys() == model.w.keys()
    for name, w in model.w.items():
        steps = [rng.normal(size=w.shape)]
        for i in np.argsort(-np.abs(grads[name]).ravel())[:5]:
            steps.append(np.zeros(w.shape))
            steps[-1].ravel()[i] = 1
        for step in steps:
            values = []
            for d in (-1e-5, 1e-5):
                model.w[name] = w + d * step
                values.append(loss())
            model.w[name] = w
            assert np.isclose((values[1] - values[0]) / 2e-5, (grads[name] * step).sum(), rtol=1e-4, atol=1e-9), name
        assert np.abs(grads[name]).max() > 1e-6, name


def test_packed_pieces_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for i, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[r.doc_id, i] = (a, len(part), zlib.crc32(part.tobytes()))
    rows = packing.op5_packing(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in places.values():
        some.sort()
        assert [o for o, _ in some] == [sum(n for _, n in some[:i]) for i in range(len(some))] and sum(n for _, n in some) <= 4096
    total = sum(n for _, n, _ in want.values())
    assert len(places) >= -(-total // 4096)


def test_recall_of_shipped_tables():
    rng = np.random.default_rng(8)
    for dim, each in ((64, 2), (64, 3), (200, 2)):
        x = rng.normal(size=(4000, dim))
        y = x + rng.normal(size=x.shape) * 0.19  # cosines around 0.98
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
        near = (x * y).sum(1) >= 0.98
        signs = embeddings.rotations(dim, embeddings.TABLES, each)
        a, b = embeddings.probes(x[near], signs), embeddings.probes(y[near], signs)
        found = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
        assert near.sum() > 500 and found.mean() >= 0.995, (dim, each, found.mean())


def test_embeddings_of_odd_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v, 0), (2, v, 0), (2, [x * 2 for x in v], 0), (3, v, 1), (None, v, 0), (4, None, 0), (5, [0.0] * 4, 0), (6, [1.0, None, 2.0, 3.0], 0), (7, [float("nan"), 1.0, 2.0, 3.0], 0), (8, v, None), (9, v[:3], 0), (10, [4.0, -3.0, 2.0, -1.0], 0)]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "vec_id long, embedding array<float>, label long, v string, n_links int")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (None, 0, None, None), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True)]
    assert got == sorted(want, key=str)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def brute_ranks(edges, trusted, blocked, damping=0.85):
    """Both ranks by many plain steps."""
    out_n, in_n = {}, {}
    for (a, b), n in edges.items():
        out_n[a] = out_n.get(a, 0) + n
        in_n[b] = in_n.get(b, 0) + n
    names = {x for e in edges for x in e} | trusted | blocked
    trust, distrust = ({h: float(h in s) for h in names} for s in (trusted, blocked))
    for _ in range(400):
        t, d = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
        for (a, b), n in edges.items():
            t[b] += trust[a] * n / out_n[a]
            d[a] += distrust[b] * n / in_n[b]
        trust = {h: (1 - damping) * (h in trusted) + damping * t[h] for h in names}
        distrust = {h: (1 - damping) * (h in blocked) + damping * d[h] for h in names}
    return trust, distrust


def test_ranks_on_a_graph_with_cycles(spark):
    rng = random.Random(4)
    names = [f"h{i}.com" for i in range(25)] + ["good.org", "bad.net", "never.net"]
    edges, pages = {}, []
    for i in range(60):
        a, b = rng.choice(names[:-1]), rng.choice(names)
        pages.append((i, f"http://{a}/fr/{i}", f'<a href="http://{b}/x">x</a>'))
        if a != b:
            edges[a, b] = edges.get((a, b), 0) + 1
    rules = spark.createDataFrame(hosts.RULES, "host string, path string, verdict string")
    got = {r.host: r for r in hosts.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    trust, distrust = brute_ranks(edges, {"good.org"}, {"bad.net", "never.net"})
    for host, r in got.items():
        assert abs(r.trust - trust.get(host, 0.0)) < 1e-4 and abs(r.distrust - distrust.get(host, 0.0)) < 1e-4, host
        if r.rule is None:
            assert (r.verdict == "block") == (r.distrust >= 0.01 and r.distrust > r.trust), host


def test_maximal_repeats_by_brute_force(spark):
    rng = random.Random(12)
    shared = [[f"s{i}.{j}" for j in range(n)] for i, n in enumerate((13, 20, 14))]
    docs = []
    for d in range(12):
        words = []
        for _ in range(4):
            words += [f"u{d}.{rng.random()}" for _ in range(rng.randrange(3, 9))] + rng.choice(shared)
        docs.append((d, " ".join(words)))
    seen, want = {}, set()
    for d, t in docs:
        w = t.split()
        for p in range(len(w) - 12):
            first = seen.setdefault(tuple(w[p : p + 13]), d)
            if first < d:
                want |= {(d, i) for i in range(p, p + 13)}
    out = substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = dict(docs)
    for r in out:
        assert r.kept.split() == [w for i, w in enumerate(texts[r.doc_id].split()) if (r.doc_id, i) not in want]
        assert r.n_removed == sum(d == r.doc_id for d, _ in want)
