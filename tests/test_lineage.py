import random

from addrloom.functions import similarity
from addrloom.operators import lineage


def test_closure_of_diamonds_and_cycles(spark, tmp_path):
    r = random.Random(4)
    edges = [(f"f{r.randrange(12)}", f"f{r.randrange(12)}", "s") for _ in range(16)] + [("a", "b", "s"), ("b", "c", "s"), ("c", "a", "t")]
    edges += [(None, "x", "s"), ("z", "z", "s")] + [(f"k{i}", f"k{i + 1}", "s") for i in range(20)]
    folder = f"file://{tmp_path}/edges"
    df = spark.createDataFrame(edges, "parent string, child string, step string")
    lineage.record(df, folder)
    lineage.record(df, folder)
    want, plain = {}, {(a, b) for a, b, _ in edges if a and b and a != b}
    for a in {a for a, _ in plain}:
        now, depth = {a}, 0
        while now:
            depth += 1
            now = {y for x in now for p, y in plain if p == x and (a, y) not in want}
            want |= {(a, y): depth for y in now}
    pairs = lineage.closure(lineage.load(spark, folder))
    got = [tuple(x) for x in pairs.collect()]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want
    made = {b for _, b in want}
    assert {tuple(x) for x in lineage.originals(pairs).collect()} == {(b, a, n) for (a, b), n in want.items() if a not in made}
    assert lineage.closure(df.limit(0)).collect() == []


def _plainly(text):
    for size in range(15, 3, -1):
        i = 0
        while i + size <= len(text):
            again = text.find(text[i : i + size], i + size)
            if again < 0:
                i += 1
            else:
                text = text[:again] + text[again + size :]
    return text


def test_phrases_as_by_plain_search():
    r = random.Random(2)
    for n in range(3000):
        letters = "ab" if n % 3 == 0 else "abcd" if n % 3 == 1 else "甲乙丙丁戊己庚辛"
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        text += text[: r.randint(0, 30)] * r.randint(0, 2)
        assert similarity.without_repeats(text) == _plainly(text)


def test_long_texts_are_quick():
    import time

    r = random.Random(3)
    alphabet = [chr(0x4E00 + i) for i in range(2000)]
    block = "".join(r.choice(alphabet) for _ in range(5000))
    for text in (block + block, block + "".join(r.choice(alphabet) for _ in range(5000))):
        best = 9.0
        for _ in range(5):
            began = time.process_time()
            similarity.without_repeats(text)
            best = min(best, time.process_time() - began)
        assert best < 0.25  # a few hundredths on an idle machine
