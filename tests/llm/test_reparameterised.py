"""Benchmark questions with other numbers, names and units."""

import random

from hyetos.llm.decontaminate import contaminated

QUESTIONS = (
    "If a train travels {a} {km} in {b} {h} and then {c} {km} in {d} {h}, what is its average speed over the whole way?",
    "A baker in town sells {a} loaves before noon and {b} loaves after it, while {name} buys {c} of them. How many loaves did all others buy that day?",
    "A shop gives a discount of {a} percent on a coat that cost {b} dollars last week. What does {name} pay for it and for a hat of {c} dollars?",
    "Every morning {name} fills a tank with {a} {l} of water and loses {b} {l} through a leak by night. After how many days are {c} {l} in it?",
    "Two friends, {name} and {other}, share {a} marbles so that one of them gets {b} more than the other. How many marbles does each of them get?",
    "The school library lends {a} books a day to pupils and gets {b} back, and a teacher takes {c} more. How many are missing after {d} days?",
    "A rope of {a} {m} is cut into pieces of {b} {m} each, and what is left is given to {name}. How long is the part that is given away?",
    "It takes {a} workers {b} {h} to paint a fence along the road. How many {h2} would {c} workers need for a fence that is twice as long?",
    "When {name} was {a} years old the oak in the garden was {b} {m} high and grew by {c} {cm} a year. How high is the oak after {d} years?",
    "A bus leaves the station with {a} people on it, and at the first stop {b} get off while {c} get on. How many people are on the bus then?",
)
NAMES = "Anna Bob Carla Dmitri Elena Farid Greta Hugo Ines Jonas Kira Luis".split()
WORDS = "two three four five six seven eight nine ten eleven twelve fifteen twenty thirty".split()


def ask(rng, question):
    def number():
        n = rng.choice([rng.randrange(2, 100), rng.randrange(1000, 99999)])
        return rng.choice([str(n), f"{n:,}", f"{n}.{rng.randrange(1, 10)}", f"{n:,}.{rng.randrange(10, 99)}", rng.choice(WORDS)])

    units = {"km": ("km", "miles", "kilometers"), "h": ("hours", "h", "minutes"), "l": ("liters", "l", "gallons"), "m": ("meters", "m", "feet"), "cm": ("cm", "inches", "mm")}
    values = {k: number() for k in "abcd"} | {k: rng.choice(v) for k, v in units.items()} | {"h2": "hours", "name": rng.choice(NAMES[:6]), "other": rng.choice(NAMES[6:])}
    # A unit is one where digits stand before it.
    for number_key, unit_key in (("a", "km"), ("b", "h"), ("c", "km"), ("d", "h"), ("a", "l"), ("b", "l"), ("c", "l"), ("a", "m"), ("b", "m"), ("c", "cm")):
        if f"{{{number_key}}} {{{unit_key}}}" in question and values[number_key] in WORDS:
            values[number_key] = str(rng.randrange(2, 60))
    text = question.format(**values)
    return text.replace(" km", "km", 1) if rng.random() < 0.3 else text


def test_recall_of_reparameterised_questions(spark):
    rng = random.Random(12)
    items = [(k, ask(rng, QUESTIONS[k % len(QUESTIONS)])) for k in range(120)]
    prose = "the river was calm and nobody came by until late in the evening when all lamps were lit".split()
    filler = lambda n: " ".join(rng.choice(prose) for _ in range(n)).capitalize() + "."
    docs = [(k, f"{filler(40)} {ask(rng, QUESTIONS[k % len(QUESTIONS)])} {filler(60)}") for k in range(120)]
    clean = [(1000 + k, f"{filler(30)} There were {rng.randrange(9)} boats and {rng.choice(WORDS)} {rng.choice(['men', 'hours'])} with {rng.choice(NAMES)} there. {filler(50)}") for k in range(60)]
    got = contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r.doc_id for r in got if r.item_id % len(QUESTIONS) == r.doc_id % len(QUESTIONS)}
    assert len(found) >= 0.9 * len(docs), (len(found), [docs[k][1] for k in range(120) if k not in found][:5])
    assert not {r.doc_id for r in got} & {k for k, _ in clean}
    assert all(r.item_id % len(QUESTIONS) == r.doc_id % len(QUESTIONS) for r in got)
    pairs = {(r.doc_id, r.item_id) for r in got}
    own = sum((k, k) in pairs for k in range(120))
    assert own >= 0.9 * 120, own


def test_numbers_of_every_form(spark):
    item = "If a train travels 60 km in 2 hours and then 90 km in 3 hours, what is its average speed?"
    texts = [
        "If a train travels 1,200.5 km in 2.5 hours and then 90 km in 3 hours, what is its average speed?",
        "So: if a train travels 61km in 3h and then 95 km in 4 h, what is its average speed? Say it.",
        "if a train travels 7 miles in 20 minutes and then 8 miles in 30 minutes, what is its average speed",
    ]
    items = [(1, item), (2, "Tom has twelve apples in three boxes and gives two boxes to a friend of his. How many apples are left in all?")]
    texts.append("Anna has fifteen apples in four boxes and gives three boxes to a friend of his. How many apples are left in all?")
    got = contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(0, 1), (1, 1), (2, 1), (3, 2)}
