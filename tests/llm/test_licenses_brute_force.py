import random
import re
from collections import Counter

from hybridkb.llm.licenses import TEMPLATES, license_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bigrams(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return Counter(zip(words, words[1:], strict=False))


def units(text):
    """Filled lines, runs of filled lines, and the whole text."""
    lines = text.split("\n")
    blocks, run = [], []
    for line in [*lines, ""]:
        if line.strip(" \t\r\f\v"):
            run.append(line)
        elif run:
            blocks.append("\n".join(run))
            run = []
    return [x for x in lines if x.strip(" \t\r\f\v")] + blocks + [text]


def plain(text, threshold):
    """The licences of every unit against every template, without bounds."""
    bags = {name: bigrams(t) for name, t in TEMPLATES.items()}
    found = set()
    for unit in map(bigrams, units(text)):
        for name, bag in bags.items():
            if unit and bag and 2 * sum((unit & bag).values()) / (unit.total() + bag.total()) >= threshold:
                found.add(name)
    return found


def varied(rng):
    """A template with words changed, dropped or doubled, broken into lines and set among other lines."""
    words = TEMPLATES[rng.choice(sorted(TEMPLATES))].split()
    share = rng.choice([0, 0, 0.01, 0.02, 0.05])
    out = []
    for w in words:
        out += [[w], [], [w, w], ["changed"]][rng.randrange(1, 4) if rng.random() < share else 0]
    width = rng.choice([7, 12, 10_000])
    body = "\n".join(" ".join(out[i : i + width]) for i in range(0, len(out), width))
    around = ["", "some words stand here\n\n", "some words stand right above\n", "  \n\n"]
    return rng.choice(around) + body + rng.choice(["", "\n\nand others below", "\nand others right below"])


def test_all_units_by_all_templates(spark, data):
    rng = random.Random(5)
    texts = [varied(rng) for _ in range(300)] + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.9, 0.75):
        got = {r.doc_id: {m.license_id for m in r.matches} for r in license_matches(docs, threshold=threshold).collect()}
        want = {i: plain(t or "", threshold) for i, t in enumerate(texts)}
        assert got == want
        assert 100 < sum(map(bool, want.values())) < len(texts)
