import random

from tessera.operators import reconcile as X


def test_against_a_full_comparison(spark, tmp_path):
    rng = random.Random(2)
    every = [f"ctx://{s}/d{i % 7}/e{i % 40}/f{i}.md" for i in range(1500) for s in ("resources",)] + [f"ctx://user/memories/m{i}.md" for i in range(200)]
    old = {u: f"h{i}" for i, u in enumerate(every)}
    new = dict(old)
    for u in rng.sample(every, 12):
        new[u] += "x"
    for u in rng.sample(every, 5):
        new.pop(u, None)
    new |= {"ctx://resources/d3/new/n.md": "1", "ctx://resources/n.md": "2", "ctx://agent/skills/s.md": "3"}
    frame = lambda d: spark.createDataFrame(list(d.items()), "uri string, hash string").repartition(3)
    a, b = X.build_tree(frame(old), str(tmp_path / "a")), X.build_tree(frame(new), str(tmp_path / "b"))
    want = {u: "missing" if u not in new else "untracked" if u not in old else "changed" for u in old.keys() | new.keys() if old.get(u) != new.get(u)}
    got = X.drift(a, b)
    assert {r.uri: r.drift for r in got.rows.collect()} == want
    same = X.drift(a, a)
    assert same.rows.count() == 0 and same.compared == [2]  # the two scopes' roots alone
    one = dict(old) | {every[3]: "z"}
    small = X.drift(a, X.build_tree(frame(one), str(tmp_path / "c")))
    assert [tuple(r) for r in small.rows.collect()] == [(every[3], "changed")] and sum(small.compared) < 120 < len(old)
    part = X.drift(a, b, ["user"])
    assert {r.uri for r in part.rows.collect()} == {u for u in want if u.startswith("ctx://user/")}

    ledger = frame(old | {"no uri": "q", "ctx://nowhere/x": "q"})
    after, report = X.reconcile(ledger, frame(new), a, b, dry_run=True)
    r = report.first()
    missing = sum(v == "missing" for v in want.values())
    assert after is ledger and (r.drift_count, r.invalid, r.missing, r.pruned, r.reindexed, r.status) == (missing + 2, 2, missing, 0, 0, "dry_run")
    after, report = X.reconcile(ledger, frame(new), a, b)
    assert {x.uri: x.hash for x in after.collect()} == new and report.first().pruned == missing and report.first().reindexed == len(want) - missing
    after, _ = X.reconcile(ledger, frame(new), a, b, scopes=["agent"])
    assert {x.uri: x.hash for x in after.collect()} == old | {"ctx://agent/skills/s.md": "3"}
