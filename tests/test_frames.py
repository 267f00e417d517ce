"""Label matching against plain loops, and on copies and frequent words."""

import random
import threading
from contextlib import contextmanager

from ferrite.operators import frames

KIND = "page string, node_id bigint, label string"


@contextmanager
def at_most(spark, seconds):
    """Jobs that pair copies with each other would run for hours; they are cancelled, and the test fails."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def words(label):
    plain = "".join(c if c.isalnum() or c == " " else " " for c in label.lower())
    return frozenset(t for t in plain.split(" ") if len(t) > 1) or frozenset(["=" + label.lower()])


def by_pairs(wanted, live):
    best = {}
    for page, a, x in wanted:
        for other, b, y in live:
            if None not in (page, a, b, x, y) and page == other and a != b and words(x) & words(y):
                key = (-round(len(words(x) & words(y)) / len(words(x) | words(y)), 6), b)
                best[page, a] = min(best.get((page, a), key), key)
    return {(page, a, b, -s) for (page, a), (s, b) in best.items()}


def table(r, n):
    few, many = ["red", "new", "rod", "id", "x"], [f"w{i}" for i in range(14)]
    label = lambda: None if r.random() < 0.03 else r.choice(["", "!", "?", "A"]) if r.random() < 0.06 else " ".join(r.choice(few if r.random() < 0.5 else many) for _ in range(r.choice([1, 2, 3, 5, 6, 7, 9, 14])))
    rows = [(r.choice("pq"), i, label()) for i in range(n)]
    return rows + [(None, 3, "red"), ("p", None, "red rod"), ("q", 5, "new rod"), *[("p", n + i, rows[i][2]) for i in range(0, n, 3)]]


def test_best_label_against_all_pairs(spark):
    for seed in range(2):
        r = random.Random(seed)
        wanted, live = table(r, 90), table(r, 90)
        got = frames.best_label(spark.createDataFrame(wanted, KIND), spark.createDataFrame(live, KIND), "page").collect()
        assert len(got) == len({(x.page, x.node_id) for x in got})
        assert set(map(tuple, got)) == by_pairs(wanted, live)


def test_best_label_pairs_neither_copies_nor_a_frequent_word(spark):
    n = 40_000
    nodes = spark.range(n).selectExpr("'copies' AS page", "id AS node_id", "elt(id % 4 + 1, 'red ring', 'Ring, red', 'old rod', 'hot bolt') AS label")
    nodes = nodes.union(spark.range(n).selectExpr("'word'", "id", "concat('item ', id + 10)"))
    with at_most(spark, 90):
        got = frames.best_label(nodes, nodes, "page").collect()
    group = lambda i: 0 if i % 4 < 2 else i % 4
    least = {0: (0, 1), 2: (2, 6), 3: (3, 7)}
    copies = {("copies", i, next(b for b in least[group(i)] if b != i), 1.0) for i in range(n)}
    assert set(map(tuple, got)) == copies | {("word", i, int(i == 0), 0.333333) for i in range(n)}


def test_resolve_marks_of_many_copies(spark):
    n = 40_000
    before = spark.range(n).selectExpr("'p' AS page", "id AS node_id", "id AS mark", "elt(id % 4 + 1, 'red ring', 'old rod', 'hot bolt', 'new gear') AS label")
    live = before.where("node_id % 5 > 0").selectExpr("page", "node_id", "CASE WHEN node_id % 4 = 0 THEN 'red' WHEN node_id % 4 = 3 THEN 'cold plate' ELSE label END AS label")
    with at_most(spark, 90):
        got = frames.resolve_marks(before, live, "page").collect()

    def want(i):
        gone, kind = i % 5 == 0, i % 4
        if kind == 0:
            return ("lost", None) if gone else ("ok", i)
        if kind == 3:
            return "lost", None
        return ("reassigned", {1: 1, 2: 2}[kind]) if gone else ("ok", i)

    assert {(r.mark, r.status, r.node) for r in got} == {(i, *want(i)) for i in range(n)}
    assert len(got) == n


def test_resolve_marks_against_all_pairs(spark):
    for seed in range(2):
        r = random.Random(seed + 7)
        wanted, live = table(r, 80), table(r, 80)
        assigned = [(page, node, mark, label) for mark, (page, node, label) in enumerate(wanted)]
        got = frames.resolve_marks(spark.createDataFrame(assigned, "page string, node_id bigint, mark int, label string"), spark.createDataFrame(live, KIND), "page").collect()

        best, want = {(page, a): (b, s) for page, a, b, s in by_pairs(wanted, live)}, []
        for page, node, mark, label in assigned:
            b, s = best.get((page, node), (None, 0.0))
            for now in [x for p, n, x in live if None not in (page, node) and (p, n) == (page, node)] or [None]:
                own = None if None in (label, now) else len(words(label) & words(now)) / len(words(label) | words(now))
                status = "ok" if (own or 0) >= 0.99 else "reassigned" if s >= 0.55 else "ok" if (own or 0) >= 0.34 else "lost"
                want.append((page, mark, status, {"ok": node, "reassigned": b, "lost": None}[status]))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def unshuffled(node, above=""):
    """For each scan of a plan, the expressions that are worked out before its rows are dealt out."""
    above = "" if "Exchange" in node.nodeName() else above + node.expressions().toString()
    children = [node.children().apply(i) for i in range(node.children().size())]
    return [x for c in children for x in unshuffled(c, above)] if children else [above]


def test_labels_are_taken_apart_once_each_not_once_a_row(spark):
    n = 40_000
    before = spark.range(n).selectExpr("'p' AS page", "id AS node_id", "id AS mark", "elt(id % 3 + 1, 'red ring', 'old rod', 'hot bolt') AS label")
    live = before.selectExpr("page", "node_id", "IF(node_id % 2 = 0, label, 'new rod') AS label")
    for found in (frames.resolve_marks(before, live, "page"), frames.best_label(before, live, "page")):
        scans = unshuffled(found._jdf.queryExecution().executedPlan().initialPlan())
        assert len(scans) > 2
        assert not [x for x in scans if "regexp" in x.lower()]
