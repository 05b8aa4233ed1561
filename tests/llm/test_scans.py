import random
import re

from pyspark.sql import functions as F

from graphloom.llm import decontaminate, licenses

rng = random.Random(8)
WORDS = ["".join(rng.choice("aeiourst") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def tokens(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def smith_waterman(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if x == y else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
    return max(map(max, rows))


def test_decontamination_against_brute_force(spark):
    items = [(i, prose(30).capitalize() + ".") for i in range(12)] + [(90, None), (91, ""), (92, "too short")]
    docs = []
    for k in range(60):
        text = prose(rng.randint(0, 150))
        if k % 3 == 0:
            words = items[k % 12][1].split()
            if k % 2:  # edited: every seventh word replaced, one dropped
                words = [rng.choice(WORDS) if i % 7 == 3 else w for i, w in enumerate(words) if i != 11]
            text += "\n" + (" ".join(words).upper() if k % 4 == 0 else ",  ".join(words)) + " " + prose(20)
        docs.append((k, text))
    docs += [(1000, None), (1001, ""), (None, items[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(frame, bench).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            goal = tokens(item)
            if len(goal) >= 3 and (score := smith_waterman(goal, tokens(text)) / (2 * len(goal))) >= decontaminate.LEAST_SCORE:
                want[d, i] = score
    assert set(got) == set(want)
    assert all(abs(got[k]["score"] - want[k]) < 1e-9 for k in want)
    text = dict(docs)
    for (d, i), r in got.items():
        if r["score"] == 1.0:
            assert tokens(text[d][r["start"] : r["stop"]]) == tokens(dict(items)[i])
    left = {r["doc_id"] for r in decontaminate.clean(frame, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want if d is not None}


def test_decontamination_in_blocks(spark, monkeypatch):
    """Several blocks find what one does; an item in very many documents keeps its seeds."""
    items = [(i, prose(25)) for i in range(9)]
    docs = [(k, prose(30) + " " + items[0 if k % 4 else k % 9][1]) for k in range(80)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, bench).collect()}
    assert {(k, 0 if k % 4 else k % 9) for k in range(80)} <= whole
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, bench).collect()} == whole


def test_decontamination_of_edited_and_partial_copies(spark):
    """Where an item's only copies are edited or partial, the n-grams that are left find them, whatever their counts."""
    items = [(i, prose(30)) for i in range(6)]
    edited = lambda i: " ".join("new" if k % 5 == 2 else w for k, w in enumerate(items[i][1].split()))
    first, last = (lambda i: " ".join(items[i][1].split()[:16])), (lambda i: " ".join(items[i][1].split()[14:]))
    copies = [edited(0), edited(1), first(2), last(3), first(4), last(4), *[last(4)] * 20]
    docs = [(k, f"{prose(40)} {copy} {prose(40)}") for k, copy in enumerate(copies)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in found.collect()}
    want = {(d, i): smith_waterman(tokens(item), tokens(text)) / 60 for d, text in docs for i, item in items}
    want = {k: x for k, x in want.items() if x >= decontaminate.LEAST_SCORE}
    assert {(0, 0), (1, 1), (2, 2), (3, 3)} | {(k, 4) for k in range(4, 26)} <= set(want)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_decontamination_of_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "a b a b a b a")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(odd, bench).collect()} == {8}
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.where(F.lit(False))).count() == 0
    assert decontaminate.clean(odd, bench).columns == odd.columns


def held(template, text):
    """Largest part of the template's shingles in any window as wide as the scan's, by brute force."""
    goal = {tuple(tokens(template)[i : i + 3]) for i in range(len(tokens(template)) - 2)}
    t = tokens(text)
    own = [tuple(t[i : i + 3]) for i in range(len(t) - 2)]
    return max((len(goal & set(own[i : i + len(goal)])) / len(goal) for i in range(max(1, len(own)))), default=0)


def shingled(text):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return [tuple(w[i : i + licenses.SHINGLE]) for i in range(len(w) - licenses.SHINGLE + 1)]


def most_held(template, text, width):
    """The largest part of the template's shingles in any run of ``width`` of the text's, by trying all."""
    goal, own = set(shingled(template)), shingled(text)
    return max((len(goal & set(own[i : i + width])) / len(goal) for i in range(max(1, len(own) - width + 1))), default=0.0)


def test_licenses_against_brute_force(spark):
    """Exactly the templates of which a run of a text has enough, with how much of them it has."""
    docs, names = [], list(licenses.TEMPLATES)
    for k in range(110):
        text = prose(rng.randint(0, 80))
        if k % 2:
            words = licenses.TEMPLATES[names[k % len(names)]][1].split()
            for _ in range(rng.randint(0, 1 + len(words) // 20)):
                words[rng.randrange(len(words))] = "changed"
            if k % 7 == 0:  # only a part
                words = words[: int(len(words) * rng.uniform(0.5, 1))]
            text += "\n" + (" ".join(words).upper() if k % 5 == 0 else "\n ".join(words)) + "; " + prose(rng.randint(0, 40))
        docs.append((k, text))
    docs += [(200, "All rights"), (201, "Licensed under the Apache banner of rights reserved"), (202, None), (203, "")]
    docs += [(204, " gap ".join(licenses.TEMPLATES["mit-body"][1].split(". ")) + prose(20)), (205, " ".join(t for _, t in licenses.TEMPLATES.values()))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["template"]): r for r in licenses.license_scan(frame).collect()}
    width = {n: 2 * g.stride for g in licenses.grouped(licenses.TEMPLATES) for n in g.names}
    part = {(d, n): most_held(x, t, width[n]) for d, t in docs for n, (_, x) in licenses.TEMPLATES.items()}
    want = {k: v for k, v in part.items() if v >= licenses.LEAST}
    assert set(got) == set(want) and all(abs(got[k]["containment"] - want[k]) < 1e-9 for k in want)
    assert len({n for _, n in want}) == len(names)
    text = dict(docs)
    for (d, _), r in got.items():
        assert text[d][r["start"] : r["stop"]].strip() == text[d][r["start"] : r["stop"]] != ""


def test_bands_are_sure():
    for group in licenses.grouped(licenses.TEMPLATES):
        shortest = min(len(s) for s in group.sets)
        similarity = licenses.LEAST * shortest / (3 * group.stride + (1 - licenses.LEAST) * shortest)
        assert licenses.collision(similarity, len(group.multiply)) >= licenses.SURE


def test_licenses_of_odd_rows(odd, nothing):
    assert licenses.license_scan(odd).count() == 0 and licenses.license_scan(nothing).count() == 0
