import random

from veilspan.llm import lines


def brute(docs, least):
    """A line goes if a run around it with enough words stands earlier: all runs are tried."""
    runs, out = {}, {}
    for i, text in docs:
        filled = [(k, x) for k, x in enumerate(text.split("\n")) if x.strip()]
        gone = set()
        for a in range(len(filled)):
            for b in range(a, len(filled)):
                run = tuple(x for _, x in filled[a : b + 1])
                if sum(len(x.split()) for x in run) >= least:
                    if run in runs and runs[run] != (i, a):
                        gone.update(k for k, _ in filled[a : b + 1])
                    else:
                        runs[run] = (i, a)
        left = [x for k, x in enumerate(text.split("\n")) if k not in gone]
        out[i] = (("\n".join(left) if gone else text), len(gone), len(filled) - len(gone))
    return out


def make(spark, docs):
    return spark.createDataFrame([(i, t, "z", 3) for i, t in docs], "doc_id long, text string, gone_ string, seq int")


def run(spark, docs, least):
    found = lines.line_dedup(make(spark, docs), least).collect()
    return {r.doc_id: (r.text, r.lines_removed, r.lines_left) for r in found}


def test_against_all_runs(spark):
    rng = random.Random(3)
    pool = ["a b c", "d e", "f", "", "g h i j", "k l", "  ", "m n o p q"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + "\nextra line of text") for i in range(5)]
    for least in (5, 9):
        assert run(spark, docs, least) == brute(docs, least)


def test_long_copies_need_many_rounds(spark):
    body = "\n".join(f"w{k}" for k in range(40))
    docs = [(1, body), (2, "start\n" + body + "\nend"), (3, "w1\nw2\nw3")]
    assert run(spark, docs, 30) == brute(docs, 30)


def test_overlapping_copies_inside_one_text(spark):
    docs = [(1, "\n".join(["one two three four five six"] * 9))]
    assert run(spark, docs, 5) == {1: ("one two three four five six", 8, 1)}


def test_rows_of_any_kind(spark):
    run_ = "a b c d e f\ng h i j k l"
    rows = [(1, run_), (1, run_), (2, None), (3, ""), (None, run_), (4, "\n \n"), (1, run_ + "\nx")]
    found = lines.line_dedup(make(spark, rows), 6).collect()
    got = sorted(map(repr, [(r.doc_id, r.text, r.lines_removed, r.gone_, r.seq) for r in found]))
    kept = [(2, None, 0), (3, "", 0), (4, "\n \n", 0), (None, "", 2)]
    assert all(repr((*k, "z", 3)) in got for k in kept)
    # The rows that repeat an id and a text are one document; the other text of this id is not.
    ones = [(r.text, r.lines_removed) for r in found if r.doc_id == 1]
    assert sorted(ones) in ([("", 2), ("", 2), (run_ + "\nx", 0)], [(run_, 0), (run_, 0), ("x", 2)])
    assert lines.line_dedup(make(spark, rows).limit(0), 6).count() == 0
