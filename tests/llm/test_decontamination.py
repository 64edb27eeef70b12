"""Leaks with edits, other names and numbers, and items without a window."""

import random
import re

from lakefind.llm import decontaminate

WORDS = "a farmer walks along the old road with his dog and looks at every tree that stands near the river before he turns back home and tells all the others about what he saw there during that long and quiet walk".split()


def leaked(spark, items, texts):
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r["__items"] for r in decontaminate.flagged(d, b).collect()}
    return [got[k] for k in range(len(texts))]


def test_edits_in_the_middle(spark):
    one = " ".join([*WORDS[:20], "very", *WORDS[20:]])
    less = " ".join(WORDS[:20] + WORDS[21:])
    other = " ".join(w if i % 6 else "other" for i, w in enumerate(WORDS))
    slots = "the train that leaves at dawn with {} on board arrives in the city where {} waits for it until noon"
    long = slots.format("Mary Ann", "1 000")
    assert leaked(spark, [" ".join(WORDS), slots.format("xx Tom", "5")], [one, less, other, "xx " + long.replace("with Mary", "with xx Mary")]) == [[0], [0], [], [1]]


def test_slots(spark):
    tom = "Tom has 5 red apples in a bag. Tom buys twelve more apples at the shop. Tom eats 2 of them. How many apples are left in the bag?"
    ann = tom.replace("Tom", "Mary Ann").replace("twelve", "forty-two").replace("5", "€9")
    ivan = "then the teacher asked Иван to bring “seven” books that cost £5 each… and he did"
    petr = "then the teacher asked Пётр to bring seven books that cost £8 each and he did"
    assert leaked(spark, [tom, ivan], [ann, petr, tom.replace("Tom buys", "Eva buys").replace("apples", "pears")]) == [[0], [1], []]


def test_items_without_a_window(spark):
    items = ["What is 17 times 23", "Paris Rome 12 km 30 km Oslo 7 8 9", "..."]
    assert leaked(spark, items, ["So: what is 17 times 23?", "What is 17 times 24", "from Paris Rome 12 km 30 km Oslo 7 8 9.", "...", "What was 17 times 24"]) == [[0], [0], [1], [], []]


def test_short_questions_with_other_values(spark):
    items = ["Compute 12 + 30 - 5 * 2", "What is 7 times 8?", "Is 5 more than 5?", "41 42 43", " ".join(f"{k} km" for k in range(9))]
    texts = ["Compute 14 + 31 - 6 * 3", "Then he asked: What is 9 times 6?", "Is 9 more than 8?", "is 8 more than 8?", "Compute 14 + 31 * 6 - 3", "it is 41 42 43 now", "it is 41 42 44 now", "so " + " ".join(f"{k} km" for k in range(9)) + " far", "so " + " ".join(f"{k} km" for k in range(1, 9))]
    assert leaked(spark, items, texts) == [[0], [1], [], [2], [], [3], [], [4], []]


def by_hand(item, text):
    """Whether the item's template stands in the text as a whole with slots that agree, for items of one window."""
    def tokens(s):
        return [("<num>", w) if w.isdigit() else (w.lower(), None) for w in s.split()]

    x, y = tokens(item), tokens(text)
    for j in range(len(y) - len(x) + 1):
        part, meets = y[j : j + len(x)], {}
        if all(a[0] == b[0] and (a[1] is None or meets.setdefault(a[1], b[1]) == b[1]) for a, b in zip(x, part, strict=True)):
            return True
    return False


def test_random_short_templates(spark):
    r = random.Random(4)
    some = lambda n: " ".join(r.choice(["add", "of", "the", "sum", str(r.randrange(3)), str(r.randrange(3))]) for _ in range(n))
    # neighbouring numbers are one slot: a word between them keeps the plain reading
    items = [t for t in (some(r.randint(2, 8)) for _ in range(60)) if not re.search(r"\d \d", t) and re.search("[a-z]", t)]
    texts = [t for t in (some(r.randint(1, 14)) for _ in range(200)) if not re.search(r"\d \d", t)]
    want = [sorted(i for i, x in enumerate(items) if by_hand(x, t)) for t in texts]
    assert sum(map(len, want)) > 50 and leaked(spark, items, texts) == want


def test_marks_without_limit(spark):
    item = " ".join(WORDS)
    assert leaked(spark, [item], [item.replace("river", "*" * n + "river" + "!" * n) for n in (1, 9, 300)]) == [[0], [0], [0]]


def test_defined_results(spark):
    b = spark.createDataFrame([(7, " ".join(WORDS)), (8, " ".join(WORDS)), (9, None), (10, "")], "item_id long, text string")
    rows = [(1, "x " + " ".join(WORDS), "i"), (1, "x " + " ".join(WORDS), "i"), (None, " ".join(WORDS).upper().lower(), "i"), (2, None, "i"), (3, "", "i"), (4, "free of it " * 20_000, "i")]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = sorted((r.doc_id or 0, r["__items"]) for r in decontaminate.flagged(d, b).collect())
    assert got == [(0, [7, 8]), (1, [7, 8]), (1, [7, 8]), (2, []), (3, []), (4, [])]
    assert decontaminate.flagged(d, b.limit(0)).filter("size(__items) > 0").count() == 0 and decontaminate.flagged(d.limit(0), b).count() == 0
