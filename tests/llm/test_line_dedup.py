import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatehouse.llm.line_dedup import MIN_CHARS, _distinct, _lines, dedup_lines, line_links

SCHEMA = "doc_id long, text string, n_chars long, h1 string, keep long"


def within(a, b, edits):
    """Whether a and b are at most `edits` edits apart, by the whole table of distances."""
    if abs(len(a) - len(b)) > edits:
        return False
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i]
        for j, e in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != e)))
        if min(row) > edits:
            return False
    return row[-1] <= edits


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def brute(spark, rows, near=within_one):
    places = sorted((doc_id, at, line) for doc_id, text in rows if text is not None for at, line in enumerate(text.split("\n")) if len(line) >= MIN_CHARS)
    count = Counter(p[2] for p in places)
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in count], "line string").select("line", F.xxhash64("line")).collect()}
    stay = []
    for line in sorted(count, key=lambda x: (-count[x], hashes[x])):
        if not any(near(line, x) for x in stay):
            stay.append(line)
    keep = {}
    for doc_id, at, line in places:
        keep.setdefault(line, (doc_id, at))
    stay = set(stay)
    out = {}
    for doc_id, text in rows:
        if text is None:
            out[doc_id] = (None, 0, 0)
            continue
        split = text.split("\n")
        kept = [x for at, x in enumerate(split) if len(x) < MIN_CHARS or (x in stay and keep[x] == (doc_id, at))]
        out[doc_id] = ("\n".join(kept), len(split), len(split) - len(kept))
    return out


def edit(rng, line):
    k, kind = rng.randrange(len(line)), rng.randrange(3)
    return line[:k] + ("" if kind == 0 else rng.choice("abxyé ")) + line[k + (kind != 1) :]


@pytest.mark.parametrize("crowd", [32, 2])
def test_equals_brute_force(spark, crowd):
    rng = random.Random(crowd)
    bases = ["".join(rng.choice("abcdeéß ") for _ in range(n)) for n in (15, 16, 17, 18, 33, 60, 200, 31)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            line = rng.choice(bases)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line = edit(rng, line)
            lines.append(line)
        rows.append((d, "\n".join(lines)))
    tail = "x" * 40
    rows += [(100 + k, f"{k % 10}{k // 10} serial {tail}") for k in range(40)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "z" * 5000), (204, "z" * 4999 + "y")]
    docs = spark.createDataFrame([(d, t, None, "clash", 1) for d, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in dedup_lines(docs, crowd=crowd).collect()}
    assert got == brute(spark, rows)


@pytest.mark.parametrize(("edits", "crowd"), [(2, 32), (2, 2), (3, 32), (3, 4)])
def test_more_edits_equal_brute_force(spark, edits, crowd):
    """Lines up to four edits from a base, moved, swapped and repeated characters included, and a crowd of numbered lines."""
    rng = random.Random(10 * edits + crowd)
    bases = ["".join(rng.choice("abß ") for _ in range(n)) for n in (16, 17, 18, 19, 33, 40)] + ["ab" * 10, "a" * 21]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(4)):
            line = rng.choice(bases)
            for _ in range(rng.randrange(5)):
                line = edit(rng, line)
            lines.append(line)
        rows.append((d, "\n".join(lines)))
    rows += [(100 + k, f"{k % 10}{k // 10} serial {k * 7 % 50:02d} of it") for k in range(40)]
    docs = spark.createDataFrame([(d, t, None, "clash", 1) for d, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in dedup_lines(docs, crowd=crowd, edits=edits).collect()}
    assert got == brute(spark, rows, lambda a, b: within(a, b, edits))


@pytest.mark.parametrize(("edits", "crowd"), [(1, 1), (2, 1), (3, 3)])
def test_links_of_crowds_equal_brute_force(spark, edits, crowd):
    """Every pair of lines within the edits shares a group and no other pair does, also where nearly all buckets are cut finer."""
    rng = random.Random(edits)
    texts = {"".join(rng.choice("ab") for _ in range(rng.randrange(8, 12))) for _ in range(40)}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(sorted(texts))], "doc_id long, text string")
    lines = _lines(docs, 8)
    named = {r.h1: r.line for r in lines.select("h1", "line").collect()}
    groups = {}
    for r in line_links(lines, _distinct(lines, edits), crowd, edits).distinct().collect():
        groups.setdefault(r.g, []).append(named[r.h1])
    got = {(a, b) for group in groups.values() for a in group for b in group if a < b}
    assert got == {(a, b) for a in texts for b in texts if a < b and within(a, b, edits)}


def test_other_numbers_of_edits_are_refused(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for edits in (0, 4):
        with pytest.raises(ValueError, match="edits"):
            dedup_lines(docs, edits=edits)


def test_chains_of_edits_keep_what_is_not_near_a_kept_line(spark):
    """Numbered lines are all connected, but those that differ in two digits stay."""
    rows = [(k, f"2024-01-15 10:22:{k:02d} request served") for k in range(60)]
    docs = spark.createDataFrame([(d, t, None, "", 1) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in dedup_lines(docs).collect()}
    assert got == brute(spark, rows)
    left = [t for t, _, _ in got.values() if t]
    assert len(left) >= 6 and not any(within_one(a, b) for a in left for b in left if a != b)


def test_shorter_lines_are_looked_at_where_asked(spark):
    docs = spark.createDataFrame([(1, "abcd\nx", None, "", 1), (2, "abcd\nabce\nx", None, "", 1)], SCHEMA)
    assert [r.text for r in dedup_lines(docs, min_chars=4).orderBy("doc_id").collect()] == ["abcd\nx", "x"]


def test_clashing_names_stay(spark):
    line = "this line is long enough"
    names = ["row", "id", "mark", "gone", "of", "of_mark", "_h", "_gone", "_doc", "_mark", "line", "at", "keep", "g"]
    docs = spark.createDataFrame([(1, line, *range(14)), (2, line, *range(14))], ["doc_id", "text", *names])
    got = dedup_lines(docs).orderBy("doc_id").collect()
    assert [r.text for r in got] == [line, ""] and all([r[n] for n in names] == list(range(14)) for r in got)


def test_repeated_rows_null_ids_and_empty(spark):
    line = "this line is long enough"
    rows = [(1, line), (1, line), (None, line), (2, line + "\nshort\n" + line)]
    docs = spark.createDataFrame([(d, t, 9, "a", 1) for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text, r.n_dropped, r.n_chars) for r in dedup_lines(docs).collect()), key=str)
    assert got == sorted([(1, "", 1, 0), (1, "", 1, 0), (None, line, 0, len(line)), (2, "short", 2, 5)], key=str)
    assert dedup_lines(docs.limit(0)).count() == 0
    assert dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
