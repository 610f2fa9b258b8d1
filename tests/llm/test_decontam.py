import random

from tessera.llm import decontam

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def least(item, text):
    """Least edit distance of the item to any part of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_is_the_plain_distance():
    rng = random.Random(4)
    for _ in range(60):
        item = bytes(rng.choice(b"abc ") for _ in range(rng.randrange(1, 90)))
        text = bytes(rng.choice(b"abc ") for _ in range(rng.randrange(0, 120)))
        assert decontam.Pattern(item).best(text)[0] == least(item, text)


def cases():
    rng = random.Random(5)
    item = lambda: " ".join(rng.choice(WORDS) for _ in range(20))
    items = [(i, item()) for i in range(12)]
    docs = []
    for d in range(80):
        body = [rng.choice(WORDS) for _ in range(60)]
        if d % 2:
            t = list(items[rng.randrange(12)][1])
            for _ in range(rng.randrange(0, 10)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choice("xyz ")
            body.insert(rng.randrange(60), "".join(t).upper() if d % 4 == 1 else "".join(t))
        docs.append((d, ", ".join(body)))
    return items, docs


def test_against_brute_force(spark):
    items, docs = cases()
    want = set()
    for d, text in docs:
        t = decontam.fold(text)
        for i, item in items:
            f = decontam.fold(item)
            far = least(f, t)
            if far <= int(len(f) * decontam.RATE):
                want.add((d, i, far))
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in out.collect()} == want and want


def test_slices_give_the_same(spark, monkeypatch):
    items, docs = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(d, b).collect()))
    clean = sorted(r.doc_id for r in decontam.drop_contaminated(d, b).collect())
    assert clean == sorted({i for i, _ in docs} - {i for i, _, _ in whole})
    monkeypatch.setattr(decontam, "MAX_ITEM_BYTES", 500)
    monkeypatch.setattr(decontam, "PATTERNS", 3)
    assert sorted(map(tuple, decontam.contaminated(d, b).collect())) == whole
    assert sorted(r.doc_id for r in decontam.drop_contaminated(d, b).collect()) == clean


def test_rows_are_judged_by_their_text(spark):
    item = " ".join(WORDS)
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame([(1, item, "a"), (1, "clean words", "b"), (None, "more clean words", "c"), (None, f"so {item}", "d")], "doc_id long, text string, item_id string")
    assert sorted(r.item_id for r in decontam.drop_contaminated(d, b).collect()) == ["b", "c"]


def test_items_that_share_their_beginning(spark):
    start = " ".join(WORDS * 2)
    b = spark.createDataFrame([(i, f"{start} number {i} of them all") for i in range(300)], "item_id long, text string")
    d = spark.createDataFrame([(1, f"x {start} number 17 of them all y")], "doc_id long, text string")
    got = {(r.item_id, r.distance) for r in decontam.contaminated(d, b).collect()}
    t = decontam.fold(d.first().text)
    want = {(i, decontam.Pattern(f).best(t)[0]) for i in range(300) for f in [decontam.fold(f"{start} number {i} of them all")]}
    assert got == {(i, k) for i, k in want if k <= int(len(decontam.fold(f"{start} number {i} of them all")) * decontam.RATE)} and (17, 0) in got


def test_edges(spark):
    item = " ".join(WORDS)
    b = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (1, item)], "item_id long, text string")
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, f"x {item} y", 0), (3, f"x {item} y", 0), (None, item, 0), (4, "clean", 0)], "doc_id long, text string, item_id int")
    out = sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()), key=str)
    assert out == [(3, 1)] * 2 + [(None, 1)]
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4"]  # the row without id holds the item
    assert decontam.contaminated(d, b.limit(0)).count() == decontam.contaminated(d.limit(0), b).count() == 0


def test_short_items_are_found_as_whole_words(spark):
    b = spark.createDataFrame([(1, "x = f(y)?"), (2, "Why is it so?"), (3, "?!"), (4, "É")], "item_id long, text string")
    d = spark.createDataFrame([(1, "then X=F(Y), done"), (2, "why is it sober"), (3, "awhy is it so"), (4, "Why is it so"), (5, "why is it s"), (6, "?! é"), (7, "why is it sort of, why is it so!")], "doc_id long, text string")
    assert sorted(map(tuple, decontam.contaminated(d, b).collect())) == [(1, 1, 0), (4, 2, 0), (6, 4, 0), (7, 2, 0)]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(d, b).collect()) == [2, 3, 5]
