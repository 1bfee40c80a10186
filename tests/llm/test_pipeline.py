"""Each stage of the pipeline on small tables with odd rows, and against plain versions."""

import random

import pytest

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, _again int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 7, "r", 1) for d, t, s in rows], SCHEMA).repartition(3)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(d, 1, int(d % 4 == 0)) for d in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


ODD = [(900, None, None), (901, "", "a"), (None, None, "a"), (902, " \n", None)]


def test_toxic_documents_go_and_others_stay(spark, folder):
    rng = random.Random(1)
    rows = [(d, words(rng, 30) + (" you idiot, worthless idiot " if d % 4 == 0 else " fine ") + words(rng, 9), "a") for d in range(200)] + ODD
    left = pipeline.drop_toxic(spark, frame(spark, rows), folder)
    assert ids(left) == sorted((d for d, _, _ in rows if d is None or d >= 900 or d % 4), key=str)
    assert left.columns == frame(spark, rows).columns
    assert pipeline.drop_toxic(spark, frame(spark, rows).limit(0), folder).count() == 0


def test_repeated_lines_go(spark, folder):
    rng = random.Random(2)
    shared, own = words(rng, 60), [words(rng, 20) for _ in range(6)]
    rows = [(d, f"{own[d]}\n{shared}", "a") for d in range(6)] + [(50, shared, "b")] + ODD
    left = {r.doc_id: r for r in pipeline.drop_lines(spark, frame(spark, rows), folder).collect()}
    assert left[0].text == f"{own[0]}\n{shared}" and 50 not in left
    assert all(left[d].text == own[d] and left[d].n_chars == len(own[d]) and left[d]["size"] == 7 and left[d]["row"] == "r" for d in range(1, 6))
    assert {d for d, _, _ in ODD} <= left.keys() and left[900].text is None


def test_one_near_copy_stays(spark, folder):
    rng = random.Random(3)
    rows, groups = [], {}
    for d in range(40):
        base = d // 4
        text = words(random.Random(base), 120).split()
        text[rng.randrange(120)] = "edit"
        rows.append((d, " ".join(text), "a"))
        groups.setdefault(base, []).append(d)
    left = ids(pipeline.drop_near_copies(spark, frame(spark, rows + ODD), folder))

    def near(a, b):
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(116)} for t in (rows[a][1], rows[b][1]))
        return len(x & y) >= 0.8 * len(x | y)

    assert all(near(g[0], d) for g in groups.values() for d in g)
    assert left == sorted([g[0] for g in groups.values()] + [d for d, _, _ in ODD], key=str)


def test_mixture_repeats_documents(spark, folder):
    rng = random.Random(4)
    rows = [(d, words(rng, 10), "a" if d < 10 else "b") for d in range(100)] + [(200, "w", None)]
    left = pipeline.mix_sources(spark, frame(spark, rows), folder)
    held = [r.doc_id for r in left.collect()]
    assert left.columns == frame(spark, rows).columns and max(map(held.count, held)) <= 3
    assert all(held.count(d) == 3 for d in range(10)) and held.count(200) == 3
    assert abs(sum(10 for d in held if 10 <= d < 100) - (1001 - 300 - 3)) <= 10


def test_encoding_comes_back(spark, folder):
    rows = [(1, "hello world", "a"), (2, "字" * 50 + " é😀", "a"), *ODD]
    got = {r.doc_id: r for r in pipeline.encode(spark, frame(spark, rows), folder).collect()}
    assert len(got) == len(rows) and all(r.exact and r.n_pieces == len(r.ids) for r in got.values())
    assert got[900].ids == got[901].ids == [] and got[1].n_pieces > 1


def test_stages_run_in_order(spark, folder, tmp_path):
    rng = random.Random(5)
    base = words(rng, 80)
    rows = [(d, f"{words(rng, 40)}\n{base if d % 10 == 3 else words(rng, 5)}" + (" idiot worthless idiot" if d % 4 == 0 else ""), "ab"[d % 2]) for d in range(200)]
    path = str(tmp_path)
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    docs, counts = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, path)
        counts.append((name, docs.count()))
        if name != pipeline.STAGES[-1][0]:
            docs.write.parquet(f"{path}/{name}")
            docs = spark.read.parquet(f"{path}/{name}")
    assert [n for n, _ in counts] == ["toxicity", "line_dedup", "ngram_join", "mixing", "sentencepiece"]
    assert counts[0][1] == counts[1][1] == counts[2][1] == 150 and counts[3][1] == counts[4][1]
    out = pipeline.run(spark, path).collect()
    assert len(out) == counts[4][1] and all(r.exact for r in out) and all(r.doc_id % 4 for r in out)
