import random
import re

import pytest

from addrloom.llm.ngram_join import jaccard_components, light_most, need


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(
            {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        )
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min([x for x in (low.get(top(i)), d) if x is not None], default=None)
    return sorted(((d, len(s), low[top(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_against_brute_force(spark, k, percent):
    r = random.Random(k)
    rows = [
        (7, None), (8, ""), (9, " \n"), (None, "a b c d"), (None, "a b c d"), (10, "one"), (11, "ONE"), (12, "É x y"),
        (13, "é x y")
    ]
    for g in range(14):
        base = [
            r.choice("abcdefghij") + str(r.randint(0, 40))
            for _ in range(r.choice([6, 11, 12, 19, 21, 22, 23, 60, 200, 700]))
        ]
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], ["new%d" % r.randint(0, 9)], [w[at], "Plus"]])
            rows.append((len(rows) * 3 % 997, r.choice([" ", "\n", "  "]).join(w)))
    rows += rows[20:25]
    df = spark.createDataFrame(
        [(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, sid string, hash int"
    ).repartition(5)
    got = sorted((tuple(x) for x in jaccard_components(df, k, percent).collect()), key=str)
    assert got == brute(rows, k, percent)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_boundary():
    assert light_most(90, 1) == 19 and light_most(80, 1) == 9 and light_most(90) == 29
    assert need(10, 9, 90) == 9 and need(20, 20, 90) == 19
