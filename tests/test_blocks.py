"""Words of signer blocks: the right ones, found without copying a page's blocks for every word."""

import random

from rollbook.operators import layout


def test_block_words_are_those_between_the_edges(spark, capsys):
    rng = random.Random(4)
    tops = [[rng.choice([0, 40, 95, 100, 101, 260, 700, 5000]) + rng.randrange(12) for _ in range(7)] for _ in range(3)]
    anchors = [(d, i + 1, t, t - 70, t + rng.choice([-80, 0, 30, 200]), i, 5, 9, t + 20) for d, p in enumerate(tops) for i, t in enumerate(p)]
    words = [(d, s, f"w{s}", 80, rng.randrange(-100, 5300) if s % 2 else rng.choice(tops[d % 3]) + rng.randrange(-90, 230), 8, 20, 50)
             for d in range(4) for s in range(300)] + [(0, 999, "no place", 80, None, 8, 20, 50)]
    a = spark.createDataFrame(anchors, "doc_id long, idx int, top long, block_top long, block_bottom long, seq int, lft int, right int, bottom long")
    w = spark.createDataFrame(words, "doc_id long, seq int, text string, lft int, top long, width int, height int, conf int")
    found = layout.block_words(a, w)
    got = sorted((r.doc_id, r.idx, r.seq) for r in found.collect())
    want = sorted((x[0], x[1], y[1]) for x in anchors for y in words if x[0] == y[0] and y[4] is not None and x[3] <= y[4] <= x[4])
    assert got == want and len(got) > 100
    # A function over the page's array of blocks leaves generated code, and each word then carries a copy of the array.
    found.explain()
    joined = [line for line in capsys.readouterr().out.splitlines() if "Join" in line]
    assert joined and not any("lambda" in line for line in joined)


def test_words_of_a_block_are_gathered_once(spark, capsys):
    text = ["1", "Print", "Name:", "Ann", "Lee", "Date:", "x", "y"]
    words = spark.createDataFrame([(0, 8 * n + i, t, 100 * i, 180 * n, 60, 20, 50) for n in range(4) for i, t in enumerate(text)],
                                  "doc_id long, seq int, text string, lft int, top long, width int, height int, conf int")
    pages = spark.createDataFrame([(0, 1000, 900)], "doc_id long, page_width int, page_height int")
    for rows, names in ((layout.extract_blocks(words, pages), ["Ann"] * 4), (layout.extract_by_numbers(words, pages), None)):
        got = sorted(rows.collect(), key=lambda r: r.line_number)
        assert [r.ocr_confidence for r in got] == [50.0] * len(got)
        assert names is None or ([r.raw_name for r in got] == names and [r.raw_date for r in got] == ["x y"] * 4)
        rows.explain()
        plan = capsys.readouterr().out
        assert plan.count("ObjectHashAggregate") and all(line.count("collect_list") <= 1 for line in plan.splitlines() if "ObjectHashAggregate" in line)
