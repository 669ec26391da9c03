"""Templates, the language model and the languages against plain versions, and costs in proportion to a text."""

import math
import os
import time
import zlib
from collections import Counter, defaultdict

import pytest
import regex

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


PLAIN_UNITS = set(
    "percent dollars dollar euros euro pounds pound cents cent km kilometers kilometres meters metres meter metre m miles mile cm mm feet inches kg kilograms grams gram g mg tons ounces oz lbs lb "
    "liters litres liter litre l ml gallons hours hour hrs hr h minutes minute mins min seconds second secs sec s days day weeks week months month years year degrees degree mph kmh kph watts volts".split()
)
PLAIN_NUMBERS = set(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)


def plain_template(text):
    """The words of a text's template, character by character."""
    t, marked, i = (text or "").replace("<", " "), [], 0
    letter = lambda c: c.isalpha()
    at = lambda k: t[k] if 0 <= k < len(t) else ""
    digit = lambda c: "0" <= c <= "9" and c != ""
    word = lambda c: c != "" and (c.isascii() and (c.isalnum() or c == "_"))

    def unit(k):
        """Where a unit that begins at k ends, or 0."""
        ends = [k + n for n in range(1, 11) if t[k : k + n] in PLAIN_UNITS and not word(at(k + n))]
        return max(ends, default=0)

    names = set()
    for k in range(2, len(t)):
        if t[k].isupper() and t[k - 1].isspace() and (letter(t[k - 2]) or t[k - 2].isnumeric() or t[k - 2] in ",;:"):
            end = k + 1
            while at(end) and at(end).islower():
                end += 1
            if end > k + 1 and not letter(at(end)):
                names.add((k, end))
    ends = dict(names)
    while i < len(t):
        if i in ends:
            marked.append(f" <a{t[i : ends[i]]} ")
            i = ends[i]
        elif digit(t[i]) and not (at(i - 1) and (letter(at(i - 1)) or digit(at(i - 1)))):
            end = i
            while digit(at(end)) or (at(end) in (".", ",") and at(end) and digit(at(end + 1))):
                end += 1
            after = end + 1 if at(end) and at(end).isspace() else end
            if letter(at(end)) and not unit(end):
                marked.append(t[i:end])
            elif unit(after):
                marked.append(f" <n{t[i:end]} <u{t[after : unit(after)]} ")
                end = unit(after)
            else:
                marked.append(f" <n{t[i:end]} ")
            i = end
        else:
            marked.append(t[i])
            i += 1
    t, words, now = "".join(marked).lower(), [], ""
    inner = lambda k: t[k] in ".," and digit(at(k - 1)) and digit(at(k + 1))
    for k, c in enumerate(t):
        if regex.match(r"[\p{L}\p{N}<]", c) or inner(k):
            now += c
        elif k == 0 or regex.match(r"[\p{L}\p{N}<]", t[k - 1]) or inner(k - 1):
            words.append(now)
            now = ""
    return [f"<n{w}" if w in PLAIN_NUMBERS else w for w in [*words, now]]


def plain_contaminated(docs, items):
    """Pairs (document, item) by loops over all windows."""
    kind = lambda ws: tuple(w[:2] if w.startswith("<") else w for w in ws)
    out = set()
    templates = {d: plain_template(t) for d, t in docs.items()}
    for item, text in items.items():
        words = [w for w in plain_template(text) if w]
        size = 8 if len(words) >= 8 else 4
        variants = [words]
        if words and regex.match(r"[^\p{L}\p{N}]*\p{Lu}\p{Ll}++(?!\p{L})", text or "") and not words[0].startswith("<"):
            variants.append(["<a" + words[0], *words[1:]])
        wins = {}
        for k, ws in enumerate(variants):
            for at in range(len(ws) - size + 1) if not k else range(min(1, len(ws) - size + 1)):
                w = ws[at : at + size]
                wins.setdefault(kind(w), (at, [(at + j, x) for j, x in enumerate(w) if x.startswith("<")]))
        least = 6 if size == 8 else 1
        plain = {h: w for h, w in wins.items() if len(w[1]) <= size // 2}
        if len({at for at, _ in plain.values()}) < least:
            plain |= {h: w for h, w in wins.items() if size // 2 < len(w[1]) <= size - 2}
        total = len({at for at, _ in plain.values()})
        for d, t in templates.items():
            found = defaultdict(list)
            for place in range(len(t) - size + 1):
                w = plain.get(kind(t[place : place + size]))
                if w:
                    found[place - w[0]].append(w)
            places, best = set(), 0
            for offset, ws in found.items():
                slots = {(at, v): t[at + offset] for _, ss in ws for at, v in ss if 0 <= at + offset < len(t)}
                values = defaultdict(Counter)
                for (_, v), ours in slots.items():
                    values[v][ours] += 1
                again, agree = sum(c.total() - 1 for c in values.values()), sum(max(c.values()) - 1 for c in values.values())
                if not (again > 0 and 2 * agree < again):
                    here_ = {at for at, _ in ws}
                    places |= here_
                    best = max(best, len(here_))
            if total and (best if size == 4 else len(places)) >= min(6, total):
                out.add((d, item))
    return out


@here
def test_templates(spark):
    from hyetos.llm.decontaminate import contaminated

    items = dict(spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").toPandas().itertuples(index=False, name=None))
    docs = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False, name=None))
    items |= {
        9001: "Tom Baker has 3 apples and 5 pears, and he gives 3 apples to Mary Stone. How many of the 5 pears are left with him then?",
        9002: "Which river runs through Vienna today?", 9003: "12 km 30 kg 7 days with 12 km 30 kg then 7 days 4 hours and 9 miles for 2 tons",
    }
    docs |= {
        10**6: "As they say, Ann Miller has 4 apples and 4 pears, and he gives 4 apples to Jane Wood. How many of the 4 pears are left with him then? Nobody knows.",
        10**6 + 1: "Ann Miller has 4 apples and 6 pears, and he gives 8 apples to Jane Wood. How many of the 9 pears are left with him then?",
        10**6 + 2: "they ask: Which river runs through Vienna today? the Danube", 10**6 + 3: "which river runs dry",
        10**6 + 4: "so 15 km 31 kg 8 days with 15 km 31 kg then 8 days 5 hours and 3 miles for 9 tons it is",
    }
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == plain_contaminated(docs, items)
    assert {(10**6, 9001), (10**6 + 2, 9002), (10**6 + 4, 9003)} <= got and (10**6 + 1, 9001) not in got and (10**6 + 3, 9002) not in got


@here
def test_languages(spark):
    """Every prediction and score, in plain Python from all learned words and strings."""
    from hyetos.llm.langid import op1_language_id

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    words = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    counts = defaultdict(Counter)
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts[r.lang].update(words(r.text))
    langs, grams = sorted(counts), {x: Counter() for x in counts}
    strings = lambda w, k: [f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)]
    for x, c in counts.items():
        for w, n in c.items():
            for k in range(1, 5):
                for g in strings(w, k):
                    grams[x][g] += n
    every, all_grams = set().union(*counts.values()), set().union(*grams.values())
    sizes = {(x, k): sum(n for g, n in grams[x].items() if len(g) == k) for x in langs for k in range(1, 5)}

    def logs(w):
        if w in every:
            return [math.log((counts[x][w] + 0.5) / (counts[x].total() + 0.5 * len(every) + 1)) for x in langs]
        for k in (4, 3, 2, 1):
            known = [g for g in strings(w, k) if g in all_grams]
            if known:
                return [sum(math.log((grams[x][g] + 0.5) / (sizes[x, k] + 0.5 * len(all_grams) + 1)) for g in known) / len(known) for x in langs]
        return [0.0] * len(langs)

    got = {r.doc_id: r for r in op1_language_id(spark, DATA).collect()}
    for r in rows:
        ws = words(r.text)
        z = [sum(col) for col in zip(*map(logs, ws), strict=True)] if ws else []
        want = (langs[z.index(max(z))], 1 / sum(math.exp(v - max(z)) for v in z)) if ws else ("und", 0.0)
        assert got[r.doc_id].lang_pred == want[0] and got[r.doc_id].score == pytest.approx(want[1], abs=1e-3)


def test_no_letter_is_und(spark):
    from hyetos.llm.langid import identify, learn

    model = learn(spark.createDataFrame([("a word or two", "en")], "text string, lang string"))
    rows = spark.createDataFrame([(1, "² ½ Ⅷ 12"), (2, None), (3, "word")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in identify(rows, model, carry=["doc_id"]).collect()} == {1: "und", 2: "und", 3: "en"}


def test_pitman_yor_scores(spark):
    """Averaged scores against a plain sampler that seats one dish after the other; there every restaurant's probabilities sum to 1."""
    import numpy as np

    from hyetos.llm import pitman_yor as P
    from hyetos.llm.lm_score import STRENGTH, lm_scores

    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(30)]
    texts = {i: " ".join(vocabulary[min(29, int(x))] for x in rng.gamma(1.2, 5, int(rng.integers(5, 40)))) for i in range(60)}
    texts[61] = "w1 zz w2"
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: ["<s>", *t.split(), "</s>"] for i, t in texts.items()}
    pairs = Counter(p for i, ws in tokens.items() if not held[i] for p in zip(ws, ws[1:]))
    keys = list(pairs)
    types = {w for _, w in keys}
    n = np.array([pairs[k] for k in keys])
    d, base = P.discount_of((n == 1).sum(), (n == 2).sum()), 1 / (len(types) + 1)
    t, seats, logs, parent_logs = np.ones(len(n), int), {w: 1 for w in types}, P.stirling(d), None
    by_context, total = defaultdict(list), Counter()
    for k, (c, _) in enumerate(keys):
        by_context[c].append(k)
        total[c] += int(n[k])
    sums, rounds, d0 = defaultdict(float), 0, None
    for sweep in range(70):
        customers = Counter()
        for k, (_, w) in enumerate(keys):
            customers[w] += int(t[k])
        if d0 is None:
            values = np.array(list(customers.values()))
            d0 = P.discount_of((values == 1).sum(), (values == 2).sum())
            parent_logs = P.stirling(d0)
        for w in types:
            others = sum(seats.values()) - seats[w]
            seats[w] = int(P.draw_tables(np.array([customers[w]]), np.array([base]), np.array([float(others)]), STRENGTH, d0, rng, parent_logs, np.array([seats[w]]))[0])
        rest = (STRENGTH + d0 * sum(seats.values())) * base
        p = {w: (customers[w] - d0 * seats[w] + rest) / (STRENGTH + customers.total()) for w in types}
        unknown = rest / (STRENGTH + customers.total())
        assert sum(p.values()) + unknown == pytest.approx(1)
        if sweep >= 10:
            rounds += 1
            for c, w in {x for ws in tokens.values() for x in zip(ws, ws[1:])}:
                tables = sum(t[k] for k in by_context[c])
                own = [k for k in by_context[c] if keys[k][1] == w]
                mass = n[own[0]] - d * t[own[0]] if own else 0.0
                sums[c, w] += (mass + (STRENGTH + d * tables) * p.get(w, unknown)) / (STRENGTH + total[c])
            for c, ks in by_context.items():
                tables = sum(t[k] for k in ks)
                parts = sum(n[k] - d * t[k] for k in ks) + (STRENGTH + d * tables) * (sum(p.values()) + unknown)
                assert parts / (STRENGTH + total[c]) == pytest.approx(1)
        for c, ks in by_context.items():
            for k in ks:
                others = sum(t[j] for j in ks) - t[k]
                t[k] = P.draw_tables(n[k : k + 1], np.array([p[keys[k][1]]]), np.array([float(others)]), STRENGTH, d, rng, logs, t[k : k + 1])[0]
    got = {r.doc_id: r.score for r in lm_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), burn=2, samples=8).collect()}
    for i, ws in tokens.items():
        want = sum(math.log10(sums[x] / rounds) for x in zip(ws, ws[1:]))
        assert got[i] == pytest.approx(want, abs=0.02 * len(ws))


def test_stirling_numbers():
    import numpy as np

    from hyetos.llm import pitman_yor as P

    for d in (0.1, 0.6, 0.9):
        table, t = P.stirling(d, 400), np.arange(1, 401)
        np.testing.assert_allclose(P.log_stirling(np.full(400, 400), t, d), table[400, 1:], atol=1e-5)


def test_passage_of_few_sites(spark):
    """A passage of over 50 words in 20 documents, one source holding a third of them."""
    from hyetos.llm.line_dedup import line_dedup

    passage = " ".join(f"word{k}" for k in range(55))
    rows = [(k, f"own text {k} of this one\n{passage}\nand more {k}", "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(20)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[k].n_removed for k in range(20)] == [0] + [1] * 19 and passage not in got[5].text and got[5].text.startswith("own text 5")


def timed(run):
    run()
    began = time.time()
    run()
    return time.time() - began


def test_cost_in_proportion_to_lines_and_spans(spark):
    from hyetos.llm.line_dedup import line_dedup
    from hyetos.llm.pii import find_pii

    def lines(n):
        text = "\n".join(f"boilerplate line number {k} of many" for k in range(n))
        rows = spark.createDataFrame([(k, text, f"s{k}") for k in range(3)], "doc_id long, text string, source string")
        assert [r.n_removed for r in line_dedup(rows, min_sites=3).orderBy("doc_id").collect()] == [0, n, n]

    def spans(n):
        rows = spark.createDataFrame([(1, "ab@cd.ef call (743) 555-3824 x " * (n // 2))], "doc_id long, text string")
        assert len(find_pii(rows).collect()[0].pii) == n

    for run in (lines, spans):
        assert timed(lambda: run(16_000)) <= 2.5 * timed(lambda: run(8_000)) + 1


@here
def test_secrets(spark):
    from hyetos.llm.pii import find_pii

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = regex.compile(r'token = "([0-9a-f]{40})"')
    hits = total = 0
    for r in find_pii(docs).collect():
        for m in planted.finditer(r.text or ""):
            total += 1
            hits += any(x.kind == "secret" and (x.start, x.end) == m.span(1) for x in r.pii)
    assert total > 5 and hits >= 0.9 * total
