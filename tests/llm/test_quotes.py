import random
import re
import time

from pyspark.sql import functions as F

from graphloom.llm import quotes

ROWS = [
    (1, 0, "user", "How do I open the jar quickly?"),
    (1, 1, "assistant", "Twist the lid to the left.\nUse a warm cloth around it."),
    (1, 2, "user", "> Use a warm cloth around it.\nThat did not help me."),
    (1, 3, "assistant", ">> Use a warm cloth  around it!\n> That did not help me.\nTap the rim then."),
    (1, 4, "user", "> How do I open the jar quickly?\nI ask again."),
    (2, 0, "user", " > tap the rim THEN\nQuoting another conversation."),
    (2, 1, "assistant", "no quote"),
    (3, 5, "user", None),
    (None, 0, "user", "> Tap the rim then.\nno id"),
    (4, 0, None, "> nobody said this ever\nown"),
    (4, 0, None, "> nobody said this ever\nown"),
]


def test_threads(spark):
    rows = quotes.threads(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")).collect()
    assert len(rows) == len(ROWS)
    by = {(r["conv_id"], r["turn"]): r for r in rows}
    reply = lambda c, t: (by[c, t]["reply_conv"], by[c, t]["reply_turn"], by[c, t]["link"])
    assert reply(1, 1) == (1, 0, "turn") and reply(1, 2) == (1, 1, "quote") and reply(1, 3) == (1, 2, "quote")
    assert reply(1, 4) == (1, 0, "quote") and reply(2, 0) == (1, 3, "quote") and reply(4, 0) == (None, None, "none")
    assert (by[2, 1]["thread_conv"], by[2, 1]["thread_turn"], by[2, 1]["depth"]) == (1, 0, 5)
    assert by[1, 3]["text"] == "Tap the rim then." and by[1, 3]["quotes"] == 2 and by[1, 3]["chat"] == "<|assistant|>\nTap the rim then."
    assert by[3, 5]["text"] == "" and by[None, 0]["thread_conv"] is None and by[None, 0]["text"] == "no id"
    assert all(r["reply_conv"] is None or (r["reply_conv"], r["reply_turn"]) < (r["conv_id"], r["turn"]) for r in rows)


def test_long_conversation_and_nothing(spark):
    rows = [(9, t, "user", f"turn {t}") for t in range(0, 3000, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["reply_turn"], r["depth"]) for r in quotes.threads(df).collect()}
    assert got[0] == (None, 0) and all(got[t] == (t - 3, t // 3) for t in range(3, 3000, 3))
    assert quotes.threads(df.where("turn < 0")).count() == 0


def test_common_line(spark):
    """A line that very many messages quote and have is linked once each."""
    rows = [(c, t, "user", "> the very common line\nthe very common line" if t else "the very common line") for c in range(50) for t in range(3)]
    out = quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == 150 and {(r["reply_conv"], r["reply_turn"]) for r in out if r["turn"]} == {(c, 0) for c in range(50)}


def runs(text):
    """Passages by brute force: level and lines."""
    out = []
    for line in re.split(r"\r\n|\n|\r", text or ""):
        marks = re.match(r"^(?:[ \t]*>)+ ?", line)
        level = marks.group().count(">") if marks else 0
        line = line[marks.end() :] if marks else line
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return out


def pieces(lines):
    joined = " ".join(lines)
    found = [joined, *lines, *re.split(r"(?<=[.!?])\s*", joined)]
    return {x for x in ("".join(c for c in f.lower() if c.isalnum()) for f in found) if x}


def brute(rows):
    """Thread, depth, answered message and own words of each key."""
    first, here = {}, {}
    keys = sorted({(c, t) for c, t, _, _ in rows})
    for c, t, _, text in sorted(rows, key=lambda r: r[:2]):
        for level, lines in runs(text):
            for x in pieces(lines) if not level else ():
                here.setdefault((c, x), t)
                first.setdefault(x, (c, t))
    to, link = {}, {}
    for c, t in keys:
        votes = {}
        for _, _, _, text in (r for r in rows if r[:2] == (c, t)):
            for level, x in {(level, x) for level, lines in runs(text) if level for x in pieces(lines)}:
                there = here.get((c, x), t)
                goal = (c, there) if there < t else first[x] if len(x) >= quotes.LEAST and first.get(x, (c, t)) < (c, t) else None
                if goal:
                    low, size = votes.get(goal, (level, 0))
                    votes[goal] = (min(low, level), size + len(x))
        before = [k for k in keys if k[0] == c and k[1] < t]
        to[c, t] = max(votes, key=lambda g: (-votes[g][0], votes[g][1], g)) if votes else before[-1] if before else None
        link[c, t] = "quote" if votes else "turn" if before else "none"
    out = {}
    for k in keys:
        depth, up = 0, k
        while to[up]:
            depth, up = depth + 1, to[up]
        out[k] = (up, depth, to[k], link[k])
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma!", "yes.", "no", "delta?", "epsilon", "omega", "zeta."]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
    rows = []
    for c in range(12):
        for t in sorted(rng.sample(range(10**6), rng.randint(1, 9))):
            text = []
            for _ in range(rng.randint(0, 4)):
                if rows and rng.random() < 0.6:
                    old = rng.choice((rng.choice(rows)[3] or "x").split("\n"))
                    text.append(rng.choice(["> ", ">", ">> ", " > > "]) + rng.choice([old, old.upper(), old.split(". ")[0], line()]))
                else:
                    text.append(line())
            rows.append((c, t, "user", "\n".join(text) if text else None))
    got = quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        reply = (r["reply_conv"], r["reply_turn"]) if r["reply_conv"] is not None else None
        assert ((r["thread_conv"], r["thread_turn"]), r["depth"], reply, r["link"]) == want[r["conv_id"], r["turn"]]
    texts = {(c, t): x for c, t, _, x in rows}
    for r in got:
        own = runs(texts[r["conv_id"], r["turn"]])
        assert r["text"] == "\n".join(x for level, lines in own if not level for x in lines).strip(" \t\r\n") and r["quotes"] == sum(level > 0 for level, _ in own)


def test_very_long_text(spark):
    """A hundred thousand lines of one text, quoted at changing levels, in time that grows with them."""
    text = "\n".join(">" * (i % 3) + f" line {i}" for i in range(100_000))
    df = spark.createDataFrame([(1, 0, "user", "line 7 and\nline 4"), (1, 1, "user", text)], "conv_id long, turn long, role string, text string")
    began = time.time()
    out = {r["turn"]: r for r in quotes.threads(df).collect()}
    assert time.time() - began < 60
    assert out[1]["link"] == "quote" and out[1]["quotes"] == 66_666 and out[1]["text"].count("\n") == 33_333


def test_odd_rows(spark, odd, nothing):
    rows = odd.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.col("source").alias("role"), "text", "node", "size", "rank", F.lit("x").alias("level"), F.lit(1).alias("h"))
    out = quotes.threads(rows).collect()
    assert len(out) == rows.count() and {r["text"] for r in out if r["conv_id"] in (1, 2, 3)} == {""}
    assert quotes.threads(rows.where("false")).count() == 0


def test_ties_and_short_quotes(spark):
    """Of equal originals the first; a short quote only within its conversation; a sentence out of a line."""
    rows = [(1, 0, "a", "Yes."), (1, 1, "b", "Yes."), (1, 2, "a", "> Yes.\nGood."), (2, 0, "a", "> Yes.\nOther."), (2, 1, "b", "First part here. Second part there."), (2, 2, "a", "Filler."), (2, 3, "a", "> second part there\nIndeed.")]
    out = {(r["conv_id"], r["turn"]): r for r in quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1, 2]["reply_turn"] == 0 and out[2, 0]["link"] == "none" and (out[2, 3]["reply_turn"], out[2, 3]["link"]) == (1, "quote")
