"""Chapters against a plain reading of every page."""

import collections
import re

import pytest
from pyspark.sql import functions as F
from test_forms import plain_heading

from factspring.functions import titles
from factspring.operators import chapters
from factspring.operators.pairing import heaviest_run
from factspring.plans import chapters as plan


def plain_run(heads):
    """A heaviest run of rising numbers: no run that ends at any heading, found by trying every earlier one, is heavier. Of several the library's counts."""
    best = []
    weights = [2.0 if h[2] else 1.0 for h in heads]
    for i, h in enumerate(heads):
        best.append(weights[i] + max((best[j] for j in range(i) if heads[j][1] <= h[1]), default=0))
    run = heaviest_run([h[1] for h in heads], weights)
    assert sum(weights[i] for i in run) == max(best, default=0) and all(heads[i][1] <= heads[j][1] and i < j for i, j in zip(run, run[1:]))
    return run


def plain_cue(line, cues):
    body = re.sub(titles.HEADING_NUMBER.removeprefix("(?i)"), "", line.strip(), flags=re.I).lower()
    found = [(len(p), -i, b) for i, (b, p) in enumerate(cues) if re.search(rf"(?<![a-z0-9]){re.escape(p)}(?:e?s)?(?![a-z0-9])", body)]
    return max(found)[2] if found else None


def plain_heads(rows, cues):
    """Numbered headings of one book, in order: place, number, branch, depth, page, text."""
    pages = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.page, r.line_no)):
        pages[r.page].append(r)
    bare = lambda t: re.sub("[0-9]+", "#", re.sub(r"\s+", " ", t.strip().lower()))
    seen = collections.defaultdict(set)
    for p, ls in pages.items():
        for r in ls[:3] + ls[-3:]:
            seen[bare(r.text)].add(p)
    skip = {k for k, v in seen.items() if k and len(v) >= 5}
    out = []
    for p, ls in pages.items():
        leaders = sum(bool(re.search(titles.LEADER, r.text)) for r in ls)
        if leaders >= 3 and 4 * leaders >= len(ls):
            continue
        for r in ls:
            number = re.match(r"\s*(\d{1,2})(?:\.(\d{1,2}))?(?:\.(\d{1,2}))?\.?\s+\S", r.text)
            if bare(r.text) not in skip and number and plain_heading(r.text):
                n = [int(x or 0) for x in number.groups()]
                out.append(((r.page, r.line_no), 10000 * n[0] + 100 * n[1] + n[2], plain_cue(r.text, cues), bool(number[3]), r.page, r.text.strip()))
    return out, max(pages)


def checked(heads, last, out, cues, tail, long):
    """Whether chapters follow from headings: their run is as heavy as can be, and spans and splits are those of its headings."""
    main = [h for h in heads if not h[3]]
    run = plain_run(main)
    whole = [c for c in out if c.inside is None]
    starts = [h for h in (main[i] for i in run) if h[2]]
    merged = [h for i, h in enumerate(starts) if not i or starts[i - 1][2] != h[2]]
    ends = [h[4] for h in merged[1:]] + [min(last, merged[-1][4] + tail)] if merged else []
    expected = []
    for h, end in zip(merged, ends):
        deep = [d for d in heads if d[3] and d[2] and h[4] < d[4] <= end] if end - h[4] + 1 >= long else []
        parts = [deep[i] for i in plain_run(deep)]
        parts = [d for i, d in enumerate(parts) if not i or parts[i - 1][2] != d[2]]
        expected.append((h[2], h[5], h[1], h[4], parts[0][4] if parts else end, None))
        expected += [(d[2], d[5], d[1], d[4], parts[i + 1][4] if i + 1 < len(parts) else end, h[5]) for i, d in enumerate(parts)]
    assert len(whole) == len(merged)
    assert [(c.branch, c.heading, c.number, c.page_start, c.page_end, c.inside) for c in out] == expected
    return len(expected) - len(merged)


def test_books_of_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    books = collections.defaultdict(list)
    for r in plan.pages(spark, sf).collect():
        books[r.book].append(r)
    out = collections.defaultdict(list)
    for r in plan.chapters_proposed(spark, sf).orderBy("book", "ordinal").collect():
        out[r.book].append(r)
    split = 0
    for book, rows in books.items():
        heads, last = plain_heads(rows, plan.CUES)
        split += checked(heads, last, out[book], plan.CUES, plan.TAIL, plan.LONG)
    assert len(out) > 10 and split > 0


def test_running_lines_fold_numbers(spark):
    rows = [(1, p, k, t) for p in range(5) for k, t in enumerate([f"Page {p} of 90", f"own {'x' * p}"] + ["body"] * 9)] + [(2, p, 0, "HEAD") for p in range(4)]
    out = chapters.running_lines(spark.createDataFrame(rows, "d int, page int, line_no int, text string"), ["d"]).collect()
    assert {(r.d, r.running) for r in out} == {(1, "page # of #"), (1, "body")}


@pytest.mark.parametrize(("line", "branch"), [("4. Power Purchase Costs", "purchase"), ("4. Uninteresting", None), ("INTERESTS", "capital"), ("", None), (None, None)])
def test_cues(spark, line, branch):
    assert spark.createDataFrame([(line,)], "t string").select(chapters.cue(F.col("t"), plan.CUES)).first()[0] == branch


def test_no_lines(spark):
    assert chapters.proposed(spark.createDataFrame([], "d int, page int, line_no int, text string"), "d", plan.CUES).count() == 0
