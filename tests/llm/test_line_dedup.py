"""Line dedup against brute force: runs of any length, copies, repeated rows, nulls, white space, extra columns, hot names."""

import random

import pytest

from lakefind.llm import common, line_dedup

BLANK = " \t\x0b\x0c\r"


def brute(docs, min_lines, min_chars):
    """{(id, text): (longest earlier run of each non-blank line, places of the lines that go)}."""
    keys = sorted({(i if i is not None else -(2**63), t or "") for i, t in docs}, key=lambda k: (k[0], 0))
    lines = {k: [(at, x.strip(BLANK)) for at, x in enumerate(k[1].split("\n")) if x.strip(BLANK)] for k in keys}
    seqs = {k: [x for _, x in v] for k, v in lines.items()}
    out = {}
    for n, k in enumerate(keys):
        far = []
        for p in range(len(seqs[k])):
            best = 0
            for k2 in keys[: n + 1]:
                for q in range(len(seqs[k2]) if k2 != k else p):
                    m = 0
                    while p + m < len(seqs[k]) and q + m < len(seqs[k2]) and seqs[k][p + m] == seqs[k2][q + m]:
                        m += 1
                    best = max(best, m)
            far.append(best)
        gone = set()
        for p, m in enumerate(far):
            if m and (m >= min_lines or any(len(x) >= min_chars for x in seqs[k][p : p + m])):
                gone |= {lines[k][j][0] for j in range(p, p + m)}
        out[k] = (far, gone)
    return out


def made(seed, n=14):
    r = random.Random(seed)
    runs = [[r.choice("abcdefgh") for _ in range(r.randint(1, 12))] for _ in range(4)]
    docs = []
    for i in range(n):
        x = []
        for _ in range(r.randint(0, 4)):
            x += r.choice(runs) if r.random() < 0.6 else [r.choice(["a", "b", "", "  ", "a long line of characters", f"own {i}"])]
        docs.append((i, "\n".join(x)))
    docs += [(n, docs[1][1]), (n + 1, docs[2][1]), (n + 2, None), (n + 3, "")]
    return docs


@pytest.mark.parametrize(("seed", "small"), [(1, 1 << 20), (2, 1 << 20), (3, 0)])
def test_runs_of_any_length(spark, monkeypatch, seed, small):
    if not small:  # the way of large tables: nothing is broadcast whole, hot names are
        monkeypatch.setattr(line_dedup, "SMALL", 0)
        monkeypatch.setattr(common, "fits_broadcast", lambda *a, **k: False)
        monkeypatch.setattr(common, "FEW", 2)
    docs = made(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 3, 20)
    got = {(r.doc_id, r.text or ""): r for r in line_dedup.dedup(d, min_chars=20).collect()}
    for k, (_, gone) in want.items():
        kept = "\n".join(x for at, x in enumerate(k[1].split("\n")) if at not in gone)
        assert (got[k]["__kept"] or "") == kept and got[k]["__n_removed"] == len(gone), k


def test_maximal_runs(spark):
    run = [f"line {i}" for i in range(11)]
    docs = [(1, "\n".join(run)), (2, "\n".join(["x", *run[2:9], "y", *run[:5]])), (3, "\n".join(run[4:7]))]
    got = {(r.id, r.pos, r.lines, r.first.id, r.first.pos) for r in line_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(2, 1, 7, 1, 2), (2, 9, 5, 1, 0), (3, 0, 3, 1, 4)}


def test_defined_results(spark):
    long = "one line of more than thirty characters"
    rows = [(7, f"{long}\r\na", "k"), (7, f"{long}\r\na", "k"), (8, f"\t{long}\nb", "k"), (None, f"{long} ", "k"), (9, "\n \n", "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, th string")
    got = sorted((r.doc_id or 0, r["__kept"], r["__n_lines"], r["__n_removed"], r.th) for r in line_dedup.dedup(d).collect())
    assert got == [(0, f"{long} ", 1, 0, "k"), (7, "a", 2, 1, "k"), (7, "a", 2, 1, "k"), (8, "b", 2, 1, "k"), (9, "\n \n", 0, 0, "k")]
    text = spark.createDataFrame([("b", f"{long}\nq"), ("a", long)], "doc_id string, text string")
    assert {r.doc_id: r["__kept"] for r in line_dedup.dedup(text).collect()} == {"a": long, "b": "q"}
    assert line_dedup.dedup(d.limit(0)).count() == 0


def test_long_text(spark):
    many = "\n".join(f"n {i % 700}" for i in range(20_000))
    d = spark.createDataFrame([(1, many), (2, "n 5\nn 6\nn 7\nend")], "doc_id long, text string")
    got = {r.doc_id: (r["__kept"], r["__n_removed"]) for r in line_dedup.dedup(d).collect()}
    assert got[2] == ("end", 3) and got[1] == ("\n".join(f"n {i}" for i in range(700)), 19_300)
