"""Sections: the choice of headings against all subsets, and what is called for each."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from scholion.functions import sections
from scholion.operators import annotate as ann
from scholion.operators import calls


def worth(found, some, size):
    total = sum(found[k][2] for k in some)
    for n, k in enumerate(some):
        stop = found[some[n + 1]][0] if n + 1 < len(some) else size
        total -= sections.SHORT * (stop - found[k][1] < sections.LEAST)
    return total


def test_headings_are_the_best_of_all_choices():
    rng = random.Random(4)
    for _ in range(300):
        at, found = 0, []
        for _ in range(rng.randint(0, 9)):
            at += rng.choice([0, 5, 30, 49, 50, 51, 200])
            found.append((at, at + rng.randint(1, 20), rng.choice([0.5, 1.5, 2.5, 4.0])))
            at = found[-1][1] + 1
        size = at + rng.choice([0, 40, 60])
        best = max((worth(found, c, size) for n in range(len(found) + 1) for c in combinations(range(len(found)), n)), default=0.0)
        got = sections.chosen(found, size)
        assert got == sorted(got) and abs(max(0.0, best) - worth(found, got, size)) < 1e-9


PAPER = "A Study of Things\n\nAbstract\nWe ask what our goal is here. " + "More words are here for it. " * 4 + "\n\n1. Introduction\nText of it, which is long enough. " + "And more. " * 9 + "\n\n2 Methods\nWe use a procedure. " + "It has many steps to do. " * 4 + "\n\nReferences\n[1] X. Y. " + "Z. " * 20


def test_sections_of_a_paper(spark):
    df = spark.createDataFrame([(1, PAPER), (2, ""), (3, None), (4, "one line only."), (5, "x" * 200_000)], "id int, t string")
    got = {r["id"]: r["s"] for r in df.select("id", sections.sections(F.col("t")).alias("s")).collect()}
    assert [x["section_type"] for x in got[1]][-4:] == ["abstract", "introduction", "methods", "references"] and got[2] == [] and got[3] is None
    assert [(x["title"], x["text"]) for x in got[4]] == [(None, "one line only.")] and len(got[5]) == 1
    assert [x["begin"] for x in got[1]][1:] == [x["end"] for x in got[1]][:-1] and got[1][-1]["end"] == len(PAPER)
    assert all(x["text"] in PAPER for x in got[1])


def test_sections_are_called_one_by_one(spark):
    each = spark.createDataFrame([(1, PAPER)], "id int, t string").select("id", F.posexplode_outer(sections.sections(F.col("t"))).alias("section", "s")).select("id", "section", "s.section_type", F.col("s.text").alias("chunk"))
    called = calls.call(each, ann.RuleAnnotator)
    events = calls.call_section_events(called, ["id", "section"], "chunk").collect()
    done = [e for e in events if e["event_type"] == "SectionProcessingCompleted"]
    assert len(events) == 2 * each.count() and sum(e["elements_extracted"] for e in done) >= 2 and all(e["duration_seconds"] >= 0 for e in done)


def test_lines_of_html():
    text = sections.lines_of_html("<nav><a href=/>Home</a></nav><h1>Abstract</h1><p>One\n two<br>three<script>x</script></p><ul><li>a<li>b</ul><h2>Results</h2>tail")
    assert text == "Home\n\n# Abstract\n\nOne two\nthree\na\nb\n\n## Results\n\ntail" and sections.lines_of_html("") == ""
    assert [(x["title"], x["section_type"]) for x in sections.sections_of(text.replace("tail", "tail " * 20).replace("three", "three " * 20))] == [(None, "other"), ("Abstract", "abstract"), ("Results", "results")]
