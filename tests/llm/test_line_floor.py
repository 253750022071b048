"""With a floor of one word the deleted lines are those of all maximal repeated runs."""

import random

from tabscope.llm import line_dedup as L

from .test_lines_substrings import later_lines


def test_floor_of_one_word_is_the_whole_rule(spark):
    rng = random.Random(6)
    lines = ["a", "b c", "d e f g", "h " * 9, "i " * 12, "", "  ", *(f"only {k}" for k in range(40))]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    gone = {(r["id0"], r["e"]) for r in L.later_copies(df, min_words=1)[1].collect()}
    assert gone == later_lines(rows, 1) and len(gone) > len(later_lines(rows, L.MIN_WORDS)) > 0


def test_doubling_ends_at_the_longest_repeated_run(spark):
    long = [f"line {k}" for k in range(41)]
    rows = [(0, "\n".join(long)), (1, "\n".join(["other", *long])), (2, "\n".join(long[:3])), (3, "same\n" * 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for least in (1, L.MIN_WORDS):
        runs = [(r["n"], r["copies"], r["first"]["id0"], r["first"]["e"])
                for r in L.repeated_runs(df, min_words=least).collect()]
        assert {r for r in runs if r[0] == 32} == {(32, 2, 0, e) for e in range(1, 11)}
        assert max(r[0] for r in runs) == 32 and min(r[0] for r in runs) == (1 if least == 1 else 5)
        assert ((8, 2, 3, 1) in runs) == ((2, 3, 0, 1) in runs) == (least == 1)
        gone = {(r["id0"], r["e"]) for r in L.later_copies(df, min_words=least)[1].collect()}
        assert gone == later_lines(rows, least)
