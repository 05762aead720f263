import random
from functools import lru_cache

from gleaner.llm.lines import patience, without_common_blocks

SCHEMA = "doc_id long, text string"


def lcs(a, b):
    @lru_cache(None)
    def f(i, j):
        return 0 if i == len(a) or j == len(b) else max(f(i + 1, j), f(i, j + 1), (a[i] == b[j]) * (1 + f(i + 1, j + 1)))

    return f(0, 0)


def brute(rows, most):
    """Documents without the lines aligned with the first document of any of their rare lines."""
    lines = {i: [x.strip(" ") for x in t.split("\n")] for i, t in rows if t is not None}
    holders = {}
    for i in sorted(lines):
        for x in {x for x in lines[i] if x}:
            holders.setdefault(x, []).append(i)
    out = {}
    for i, t in rows:
        gone = set()
        if t is not None:
            at = [k for k, x in enumerate(lines[i]) if x]
            for first in {h[0] for x, h in holders.items() if i in h[1:] and len(h) <= most}:
                gone |= {at[y] for _, y in patience([x for x in lines[first] if x], [lines[i][k] for k in at])}
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        out[i] = (t, len(gone))
    return out


def test_patience_is_an_alignment_and_the_longest_where_lines_are_single():
    rng = random.Random(1)
    for n in range(300):
        a = rng.sample(range(30), 15) if n % 2 else rng.choices(range(12), k=15)
        b = rng.sample(range(30), 15) if n % 2 else rng.choices(range(12), k=12)
        got = patience(a, b)
        assert all(a[x] == b[y] for x, y in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        if n % 2:
            assert len(got) == lcs(tuple(a), tuple(b))
    assert patience(list("abcxd"), list("abyd")) == [(0, 0), (1, 1), (4, 3)]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    common = [f"hot {i}" for i in range(2)]
    rows = []
    for i in range(120):
        lines = [f"own {i} {k}" for k in range(rng.randint(1, 6))]
        if rows and rng.random() < 0.6:
            other = rng.choice(rows)[1].split("\n")
            lines[1:1] = other[rng.randrange(len(other)) :][:4]
        lines.insert(rng.randint(0, len(lines)), rng.choice([*common, "", " "]))
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in without_common_blocks(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.05).collect()}
    assert got == brute(rows, 10) and sum(n for _, n in got.values()) > 60


def test_defined_results(spark):
    long = "\n".join(f"line {i}" for i in range(3000))
    rows = [(1, "a\nb\n\nc"), (2, "x\na\nb\nc"), (2, "x\na\nb\nc"), (3, None), (4, ""), (None, "a\nb"), (5, " a \nb\nnew"), (6, long), (7, "first\n" + long)]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], SCHEMA + ", row string, gone int")
    got = sorted(((r["doc_id"] or 0), r["text"], r["removed"]) for r in without_common_blocks(docs).collect() if r["doc_id"] != 6 and r["text"] is not None)
    assert got == [(0, "a\nb", 0), (1, "a\nb\n\nc", 0), (2, "x", 3), (2, "x", 3), (4, "", 0), (5, "new", 2), (7, "first", 3000)]
    assert without_common_blocks(docs).count() == len(rows)
    assert without_common_blocks(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_of_frequent_lines_leave_later_documents(spark):
    """Against a brute force without the limit: no document keeps two lines in a row that an earlier one has in a row."""
    passage = [f"passage {k}" for k in range(4)]
    rows = []
    for i in range(150):
        own = [f"own {i} {k}" for k in range(3)]
        if i % 5 == 0:
            rows.append((i, "copied a\n\ncopied b\ncopied c"))
        elif i % 5 == 1:
            rows.append((i, "one line"))
        elif i % 5 == 2:
            rows.append((i, "\n".join([own[0], *passage, *own[1:]])))
        elif i % 5 == 3:
            rows.append((i, "\n".join([*passage[1:3], *own, *passage[1:3]])))
        else:
            rows.append((i, "\n".join([own[0], passage[i % 4], *own[1:]])))
    got = {r["doc_id"]: r["text"] for r in without_common_blocks(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    seen, want = set(), {}
    for i, t in rows:
        lines = [x for x in t.split("\n") if x]
        blocks = [(k, k + 1) for k in range(len(lines) - 1)] or [(0, 0)]
        names = {b: (lines[b[0]], lines[b[1]], len(lines) == 1) for b in blocks}
        gone = {k for b in blocks if names[b] in seen for k in b}
        want[i] = [x for k, x in enumerate(lines) if k not in gone]
        seen |= set(names.values())
    assert {i: [x for x in t.split("\n") if x] for i, t in got.items()} == want
    assert want[5] == want[6] == [] and want[4] == rows[4][1].split("\n") and want[7] == [f"own 7 {k}" for k in range(3)]
