"""Queries that SQL can't express, against plain versions on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False, name=None))


def components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_minhash(spark, texts):
    from hyetos.llm.minhash import op7_minhash

    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: set(zip(w, w[1:])) if len(w) > 1 else {(x,) for x in w} for i, w in words.items()}
    want = components(sets, 80)
    for r in op7_minhash(spark, DATA).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_large_groups_of_close_texts(spark):
    """Texts around the threshold: every link counts, within buckets that no single leader covers."""
    import numpy as np

    from hyetos.llm.minhash import near_duplicates

    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(300):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(0, 9)), replace=False):
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
    assert got == components(sets, 80)


def test_blocks_count_intersections():
    import numpy as np

    from hyetos.llm.minhash import common_counts

    rng = np.random.default_rng(2)
    left, right = ([np.unique(rng.integers(0, 9000, n)).astype(np.uint64) for n in (1, 50, 6000)] for _ in range(2))
    assert common_counts(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, x):
    n = re.sub("[^0-9]", "", x)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in x.split(".")), "card": 14 <= len(n) <= 19 and luhn(n), "phone": 10 <= len(n) <= 15}[kind]


def spans_of(text):
    return sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if good(kind, m[0]))


def test_pii(spark, texts, monkeypatch):
    from hyetos.llm import common, pii

    odd = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (743) 555-3824 +1 2", "é" * 5 + "a@b.co", "1" * 30, "1.2.3.4" * 50, "a.b@c.d" * 40, "x" * 100000, "@" * 999, None, ""]
    every = {**texts, **{10**6 + k: t for k, t in enumerate(odd)}}
    monkeypatch.setattr(common, "table", lambda *_: spark.createDataFrame(list(every.items()), "doc_id long, text string"))
    for r in pii.op6_pii(spark, DATA).collect():
        want = spans_of(every[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[2] == k for w in want) for k in BASE]


def test_pii_added_spans(spark):
    from hyetos.llm.pii import find_pii

    rows = [(1, "call me (743) 555-3824 now"), (2, "numbers (743) 555-3824 alone"), (3, "iban DE89 3704 0044 0532 0130 00 x DE89 3704 0044 0532 0130 01"), (4, "ssn 123-45-6789")]
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.pii] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("tel", 8, 22)], 2: [], 3: [("iban", 5, 32)], 4: [("ssn", 4, 15)]}


def test_urls(spark):
    from hyetos.llm import url_filter as U

    rows = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").collect()}
    grams = lambda u: [s[i : i + 5] for s in ["\x02" * 4 + (u.split("://", 1)[1] if "://" in u else u).lower() + "\x03"] for i in range(len(s) - 4)]

    def parse(u):
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S) if u and "://" in u else None
        return (m[1].lower(), m[2]) if m else ("", "")

    def rule(host, path):
        fits = [(len(r), v, r) for v, r in U.RULES for a, b in [r.split("/", 1)] if (host == a or host.endswith("." + a)) and path.startswith("/" + b)]
        return max(fits)[1:] if fits else (None, None)

    counts = {v: Counter() for v in ("allow", "block")}
    for u in {x or "" for x in rows.values()}:
        v = rule(*parse(u))[0]
        if v and zlib.crc32(u.encode()) % 5:
            for g in grams(u):
                counts[v].update(g[5 - k :] for k in range(1, 6))
    after = {v: defaultdict(lambda: [0, 0]) for v in counts}
    for v, c in counts.items():
        for g, n in c.items():
            after[v][g[:-1], len(g)][0] += n
            after[v][g[:-1], len(g)][1] += 1

    def p(v, g):
        q = 1 / 256
        for k in range(1, 6):
            x = g[5 - k :]
            if (x[:-1], k) in after[v]:
                n, t = after[v][x[:-1], k]
                q = (counts[v][x] + t * q) / (n + t)
        return q

    lowest, highest = math.inf, -math.inf
    for r in U.op2_url_filter(spark, DATA).collect():
        u = rows[r.page_id] or ""
        v, name = rule(*parse(u))
        g = grams(u)
        assert (r.host, r.path) == parse(u) and r.rule == name and r.score == pytest.approx(sum(math.log(p("allow", x) / p("block", x)) for x in g) / len(g))
        assert v in (None, r.verdict)
        if v is None:
            lowest, highest = (min(lowest, r.score), highest) if r.verdict == "allow" else (lowest, max(highest, r.score))
    assert highest < lowest


def test_language_model(spark, texts):
    from hyetos.llm.lm_score import op4_lm_score

    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = c.total(), len(c)
    score = base = 0.0
    for r in op4_lm_score(spark, DATA).collect():
        ws = words[r.doc_id]
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n) and r.base_score == pytest.approx(want)
        assert r.score < 0
        if r.held_out:
            score, base = score + r.score, base + r.base_score
    assert score > base


def test_seating():
    """Draws of tables follow the exact distribution, and the two forms meet where they change over."""
    import numpy as np

    from hyetos.llm import pitman_yor as P

    rng, logs = np.random.default_rng(0), P.stirling(0.6)
    t = P.draw_tables(np.full(20_000, 3), np.full(20_000, 0.2), np.zeros(20_000), 1.0, 0.6, rng, logs)
    z = np.array([np.exp(logs[3, k]) * 0.2**k * np.prod([1 + 0.6 * i for i in range(k)]) for k in (1, 2, 3)])
    np.testing.assert_allclose(np.bincount(t, minlength=4)[1:] / 20_000, z / z.sum(), atol=0.015)
    means = [P.draw_tables(np.full(4000, c), np.full(4000, 0.05), np.full(4000, 200.0), 1.0, 0.6, rng, logs).mean() for c in (64, 65)]
    assert means[1] == pytest.approx(means[0], rel=0.06)


def test_language_identification(spark):
    from hyetos.llm.langid import op1_language_id

    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op1_language_id(spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == langs[r.doc_id] for r in got if r.held_out) >= 0.95 * sum(r.held_out for r in got)


def test_quality(spark):
    from hyetos.llm.quality import op10_quality

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.kept) for r in op10_quality(spark, DATA).collect() if r.doc_id in labels]
    assert sum(k for q, k in got if q) >= 0.97 * sum(q for q, _ in got) and sum(not k for q, k in got if not q) >= 0.8 * sum(not q for q, _ in got)


def test_pipeline(spark, texts):
    """Every stage on what the one before kept, against plain versions."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    cached = []
    for name, stage in C.STAGES:
        before = rows(docs)
        docs = stage(spark, docs, DATA).cache()
        cached.append(docs)
        after = rows(docs)
        assert set(after) <= set(before), name
        if name != "mixing":
            assert tuple(docs.columns) == C.COLUMNS
        if name == "near_dedup":
            ws = {i: t.encode().lower().split() for i, t in before.items()}
            sets = {i: set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set()) for i, w in ws.items()}
            assert set(after) == {i for i, c in components(sets, 80).items() if c == i}
        if name == "decontamination":
            norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
            items = [norm(r.text).split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            parts = {" ".join(w[k : k + 13]) for w in items for k in range(len(w) - 12)}
            leak = {i for i, t in before.items() for w in [norm(t).split()] if any(" ".join(w[k : k + 13]) in parts for k in range(len(w) - 12))}
            assert set(after) == set(before) - leak
    for df in cached:
        df.unpersist()


def test_every_training_word_is_a_dish_and_a_context(spark):
    """A pair of two words that 70,000 others outnumber is learned like any other."""
    from hyetos.llm.lm_score import lm_scores

    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rest = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10]
    common = " ".join(f"w{k} w{k} w{k}" for k in range(70_000))
    rows = [(rest[0], common), (rest[1], "aa bb cc dd"), (held[0], "aa bb zz"), (held[1], "aa dd zz")]
    got = {r.doc_id: r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]].n_known == 3 and got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 0.5


def test_iban_ends_where_its_country_says(spark):
    from hyetos.llm.pii import find_pii

    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"
    rows = [(1, f"{gb} Please"), (2, "DE89370400440532013000 BIC COBADEFF"), (3, f"{de} 2024"), (4, f"DE12 {gb} {de} NO9386011117947"), (5, f"{gb}1"), (6, "GB82 WEST 1234 5698 7654 33 Please")]
    want = {1: [(0, 27)], 2: [(0, 22)], 3: [(0, 27)], 4: [(5, 32), (33, 60), (61, 76)], 5: [], 6: []}
    got = {r.doc_id: [(x.start, x.end) for x in r.pii if x.kind == "iban"] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_every_learned_word_is_known_in_each_language(spark):
    """A rare language's words count beside 150,000 words and strings that are more frequent."""
    from hyetos.llm.langid import identify, learn

    large = " ".join(f"{a}{b}{c}{d}" * 2 for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst" for d in "abcdefghijklmnopqrst")
    docs = spark.createDataFrame([(1, f"{large} {large}", "aa"), (2, "abcdzabcd qrstzqrst", "bb")], "doc_id long, text string, lang string")
    model = learn(docs)
    assert model.words.select("key").distinct().count() == model.n_words == 160_002
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(spark.createDataFrame([(3, "abcdzabcd"), (4, "xabcdabcdx"), (5, "qrstzqrst qrstzqrst"), (6, "")], "doc_id long, text string"), model, carry=["doc_id"]).collect()}
    assert (got[3][0], got[5][0], got[6]) == ("bb", "bb", ("und", 0.0))
    # A word that nobody has: its longest known strings, in plain Python.
    grams = lambda w, size: [f"^{w}$"[i : i + size] for i in range(len(w) + 3 - size)]
    counts = {x: Counter(g for w in t.split() for size in range(1, 5) for g in grams(w, size)) for x, t in (("aa", f"{large} {large}"), ("bb", "abcdzabcd qrstzqrst"))}
    every = set(counts["aa"]) | set(counts["bb"])
    known = [g for g in grams("xabcdabcdx", 4) if g in every]
    aa, bb = (sum(math.log((c[g] + 0.5) / (sum(n for k, n in c.items() if len(k) == 4) + 0.5 * len(every) + 1)) for g in known) / len(known) for c in counts.values())
    assert known and got[4] == ("aa" if aa > bb else "bb", pytest.approx(1 / (1 + math.exp(-abs(aa - bb))), rel=1e-4))


def test_exact_dedup_reads_any_path_and_ids_as_text(spark, tmp_path):
    from hyetos.llm.exact_dedup import exact_dedup

    rows = [("1", "a b"), ("2", "ab"), ("3", "c"), (None, "a b ")]
    for part in ("x1", "x2"):
        spark.createDataFrame(rows[::2] if part == "x1" else rows[1::2], "doc_id string, text string").write.parquet(f"{tmp_path}/{part}")
    for path in (f"{tmp_path}/x[12]", f"{tmp_path}/{{x1,x2}}", f"{tmp_path}/x*"):
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark, path).collect()} == {(1, None, 3, False), (2, None, 3, False), (3, 3, 1, True), (None, None, 3, True)}
    assert exact_dedup(spark, f"{tmp_path}/x1/").count() == 2
