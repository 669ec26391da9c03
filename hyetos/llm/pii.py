"""Operator 6: personal data and secrets by patterns, validators and context.

Patterns propose spans, validators confirm them (Luhn for cards, mod 97 for IBANs, ranges and digit counts for the
others, the mixture of characters for secrets) and words within 40 characters, up to the next match of the same kind,
adjust the score. Kinds whose form alone decides (email, ip, card, phone, iban) start above the threshold; forms that
other things share (ssn, tel: a national number without `+`, secret: a long key) need a context word. An added span
that overlaps one of the first four kinds is dropped.

Everything is a column expression on the row, so nothing is shuffled. A text is cut once for each kind into the pieces
between matches and the matches; positions are running sums over their lengths, taken in blocks. The patterns are
written so that no start is tried twice within a run and no group is repeated by recursion: time grows about in
proportion to the text and its matches, and a text of any length fits.

Edge cases: null counts as empty, which has no spans; offsets count code points, the end is exclusive; extra columns
pass through, and of a column named `pii` the operator's values stay; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyetos.llm.common import once

LOCAL = "[A-Za-z0-9._%+-]"
#: Characters of an IBAN by its country.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "HR LV LI CH", 22: "BH BG CR GE DE IE ME RS GB VA",
    23: "GI IL IQ SO TL AE OM", 24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "LY PT ST AO CV GW MZ", 26: "IS TR DZ IR", 27: "FR GR IT MC MR SM BI CM CF TD KM CG DJ GQ GA MG",
    28: "AL AZ BY CY DO SV GT HU LB NI PL BJ BF CI HN ML MA NE SN TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_SIZES.items()) + ")(?![A-Z0-9])"
#: What keys and tokens consist of.
KEY = "[A-Za-z0-9_+/-]"
#: Of each kind the pattern, a cheaper test that any match passes, the score of its form, what its validator adds, and context words.
KINDS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, 0.1, "mail|contact|write|kontakt|correo|courriel"),
    "ip": (r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", None, 0.5, 0.2, "ip|host|server|address|login"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13,}+", None, 0.3, 0.5, "card|visa|credit|karte|tarjeta|carte"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, 0.2, "tel|phone|call|mobile|fax|anruf"),
    # Only the head is matched, so that one head within reach of another is tried too; _spans reads the whole number.
    "iban": (rf"(?=[A-Z]{{2}}[0-9]{{2}})(?<![A-Z0-9])(?={IBAN})[A-Z]{{2}}[0-9]{{2}}", None, 0.2, 0.6, "iban|account|konto|bank|cuenta|compte"),
    "ssn": (r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.2, 0.1, "ssn|social security"),
    "tel": (r"[(0-9](?<![0-9+][(0-9])(?:(?<=[(])[0-9]{3}\)|[0-9]{2})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", None, 0.2, 0.1, "tel|phone|call|mobile|fax|anruf|llamar|appel"),
    "secret": (rf"{KEY}(?<!{KEY}{KEY}){KEY}{{19,}}+={{0,2}}+", None, 0.3, 0.1, "tokens?|secrets?|keys?|passwords?|passwd|pwd|api|apikey|auth|authorization|authtoken|credentials?|bearer"),
}
#: Forms of keys that need no word near them, and segments of text between slashes as paths have them.
ISSUED = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{16,}|sk[-_][A-Za-z0-9_-]{20,})$"
PATH = r"^(?=[^/]*/)[^/]{0,15}(?:/[^/]{0,15})*$"
BASE = ("email", "ip", "card", "phone")
THRESHOLD, CONTEXT, REACH = 0.5, 0.3, 40
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        v = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(x: Column) -> Column:
    x = F.replace(x, F.lit(" "), F.lit(""))
    x = F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        letter = c >= "A"
        return F.when(letter, (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0), add) == 1


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.rlike(x, F.lit(r"^(?:0*+(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5]|)(?:\.|$)){4}$"))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return _mod97(x)
    if kind == "secret":  # hexadecimal, or small and large letters and digits
        mixed = F.rlike(x, F.lit("[0-9]")) & F.rlike(x, F.lit("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z]).*)$"))
        return (mixed & ~F.rlike(x, F.lit(PATH))) | F.rlike(x, F.lit(ISSUED))
    if kind == "ssn":
        return ~F.rlike(x, F.lit("^(?:000|666|9)|-00-|-0000$"))
    return n == 10


#: Values whose running sums are taken one after the other.
BLOCK = 128


def _before(values: Column, zero: Column, merge) -> Column:
    """Of every value what `merge` makes of all before it; in blocks, so that little is copied."""

    def running(x: Column, first: Column) -> Column:
        begin = F.struct(first.alias("now"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(x, begin, lambda acc, v: F.struct(merge(acc["now"], v).alias("now"), F.concat(acc["all"], F.array(acc["now"])).alias("all")))["all"]

    def blocks(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))
        return once(parts, lambda p: once(
            running(F.transform(p, lambda b: F.aggregate(b, zero, merge)), zero),
            lambda firsts: F.flatten(F.transform(p, lambda b, k: running(b, F.get(firsts, k)))),
        ))

    return once(values, lambda x: F.when(F.size(x) == 0, x).otherwise(blocks(x)))


PLACED = "array<struct<start:int,end:int,hit:string,near:string>>"


def _placed(text: Column, kind: str) -> Column:
    """The matches with their places and what stands around them."""
    pattern = KINDS[kind][0]

    def place(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        before = _before(F.transform(hits, lambda h, k: F.length(F.get(gaps, k)) + F.length(h)), F.lit(0), lambda a, b: a + b)
        far = 2 * max(IBAN_SIZES)
        after = F.transform(hits, lambda h, k: F.concat(h, F.left(F.get(gaps, k + 1), F.lit(far + REACH))))

        def one(h: Column, k: Column, start: Column, rest: Column, hit: Column) -> Column:
            near = F.concat(F.substring(F.get(gaps, k), -REACH, REACH), F.lit(" | "), F.substring(rest, F.length(hit) + 1, F.lit(REACH)))
            return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"), near.alias("near"))

        def each(before: Column, after: Column) -> Column:
            start = lambda k: F.get(before, k) + F.length(F.get(gaps, k))
            if kind != "iban":
                return F.transform(hits, lambda h, k: one(h, k, start(k), F.get(after, k), h))
            # Only heads were matched, of four characters; the number reaches over the heads within it.
            joined = lambda k: F.array_join(F.slice(after, k + 1, F.lit(far // 4 + 1)), "")
            return F.transform(hits, lambda h, k: once(joined(k), lambda rest: one(h, k, start(k), rest, F.regexp_extract(rest, f"^{IBAN}", 0))))

        return once(before, lambda b: once(after, lambda a: each(b, a)))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return once(both, place)


def _spans(text: Column, kind: str) -> Column:
    pattern, needs, form, checked, words = KINDS[kind]

    # Words that only begin like one of a secret's ("author") are no context for it; `api_key` has two of them.
    context = rf"(?<![a-z])(?:{words})(?![a-z])" if kind == "secret" else rf"\b(?:{words})"

    def scored(x: Column) -> Column:
        near = F.rlike(F.lower(x["near"]), F.lit(context))
        score = F.lit(form + checked) + F.when(near | F.rlike(x["hit"], F.lit(ISSUED)) if kind == "secret" else near, CONTEXT).otherwise(0.0)
        return F.struct(
            x["start"].alias("start"), F.lit(list(KINDS).index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"),
            F.least(score, F.lit(1.0)).alias("score"),
        )

    good = F.filter(F.transform(F.filter(_placed(text, kind), lambda x: _valid(kind, x["hit"])), scored), lambda x: x["score"] >= THRESHOLD)
    there = F.rlike(text, F.lit(pattern))
    if needs:
        there = F.contains(text, F.lit(needs)) & there
    return F.when(there, good).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _apart(spans: Column) -> Column:
    """Sorted spans without the added ones that overlap a base one."""
    last = F.lit(2**31 - 1)
    base = lambda x, value, other: F.when(x["rank"] < len(BASE), value).otherwise(other)
    ends = _before(F.transform(spans, lambda x: base(x, x["end"], F.lit(-1))), F.lit(-1), lambda a, b: F.greatest(a, b))
    starts = F.reverse(_before(F.reverse(F.transform(spans, lambda x: base(x, x["start"], last))), last, lambda a, b: F.least(a, b)))
    free = lambda e, s: F.filter(spans, lambda x, k: (x["rank"] < len(BASE)) | ((F.get(e, k) <= x["start"]) & (F.get(s, k) >= x["end"])))
    return once(ends, lambda e: once(starts, lambda s: free(e, s)))


def find_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The table with `pii`: the spans by start and kind, each with its score."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.drop("pii")
    names = {k: f"__pii_{k}" for k in KINDS}
    docs = docs.withColumns({names[k]: _spans(text, k) for k in KINDS})
    added = F.concat(*[F.col(names[k]) for k in KINDS if k not in BASE])
    every = F.array_sort(F.concat(*[F.col(names[k]) for k in KINDS]))
    return docs.withColumn("pii", F.when(F.size(added) == 0, every).otherwise(once(every, _apart))).drop(*names.values())


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op6_pii(spark, sf_dir):
    from hyetos.llm.common import table

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))
