"""The stateful sampler against a plain replay over all pages."""

import hashlib
import random
import sys

from pyspark.sql import functions as F

from citelode.operators import datasets as X
from citelode.plans import datasets as P
from citelode.plans import tables as D
from citelode.functions import text as T


class Plain:
    """One category: lists searched from start to end at every draw."""

    def __init__(self, pages, seed):
        self.pages = sorted(pages, key=lambda p: (hashlib.md5(f"{seed}|{p[1]}".encode()).hexdigest(), p[1]))
        self.used, self.uses, self.drawn = [], {}, {}
        self.by_cell = {}

    def draw(self, seq, numbers, cell):
        relaxed = False
        pool = [p for p in self.pages if p[1] not in self.used]
        if not pool:
            relaxed = True
            pool = [p for p in self.pages if p[1] not in self.by_cell.get(cell, [])]
        if numbers and any(p[2] for p in pool):
            pool = [p for p in pool if p[2]]
        if not pool:
            return None, False
        fewest = min(self.uses.get(p[0], 0) for p in pool)
        page = [p for p in pool if self.uses.get(p[0], 0) == fewest][0]
        if page[1] not in self.used:
            self.used.append(page[1])
        if page[1] not in self.by_cell.setdefault(cell, []):
            self.by_cell[cell].append(page[1])
        self.uses[page[0]] = self.uses.get(page[0], 0) + 1
        self.drawn[seq] = (page, cell)
        return page[1], relaxed

    def release(self, seq):
        if seq not in self.drawn:
            return None
        page, cell = self.drawn.pop(seq)
        if page[1] in self.used:
            self.used.remove(page[1])
        if page[1] in self.by_cell[cell]:
            self.by_cell[cell].remove(page[1])
        self.uses[page[0]] = max(0, self.uses[page[0]] - 1)
        return page[1]


def replayed(pages, events, seed):
    out = []
    for category in sorted({e[0] for e in events}):
        state = Plain([p[1:] for p in pages if p[0] == category], seed)
        for _, seq, kind, cell, drawn_by in sorted((e for e in events if e[0] == category), key=lambda e: e[1]):
            if kind == X.RELEASE:
                out.append((category, seq, state.release(drawn_by), False))
            else:
                out.append((category, seq, *state.draw(seq, kind == X.DRAW_NUMBERS, cell)))
    return sorted(out)


def check(spark, pages, events, seed=7):
    frame = spark.createDataFrame(pages, "category string, file string, id long, has_numbers boolean")
    asked = spark.createDataFrame(events, "category string, seq long, kind string, cell string, drawn_by long")
    found = sorted(tuple(r) for r in X.sampler_state(frame, asked, seed).collect())
    assert found == replayed(pages, events, seed)
    return found


def test_state_against_a_plain_replay(spark):
    rng = random.Random(4)
    pages, number = [], 0
    for category, files, most in (("thin", 2, 4), ("wide", 60, 3), ("deep", 3, 80), ("many", 40, 30)):
        for file in range(files):
            for _ in range(rng.randrange(1, most + 1)):
                number += 1
                pages.append((category, f"f{file}", number, rng.random() < 0.3))
    events = []
    for category in ("thin", "wide", "deep", "many", "without pages"):
        seqs = []
        for seq in range(30):
            kind = rng.choice([X.DRAW, X.DRAW, X.DRAW_NUMBERS, X.RELEASE])
            events.append((category, seq, kind, rng.choice("xy"), rng.choice(seqs) if kind == X.RELEASE and seqs else None))
            seqs.append(seq)
    found = check(spark, pages, events)
    assert any(relaxed for _, _, _, relaxed in found) and any(page is None for _, _, page, _ in found)


def test_nothing_to_draw(spark):
    assert check(spark, [], [("a", 1, X.DRAW, "x", None)]) == [("a", 1, None, False)]
    assert check(spark, [("a", "f", 1, True)], [("a", 1, X.RELEASE, "x", 0)]) == [("a", 1, None, False)]


def test_query_against_a_plain_replay(spark, sf_dir):
    pages = [tuple(r) for r in D.table(spark, sf_dir, "documents").join(
        D.table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_anti"
    ).select("source", "lang", "doc_id", T.has_quantity(F.col("text"))).collect()]
    events = [tuple(r) for r in P.sampler_events(spark, sf_dir).collect()]
    found = sorted(tuple(r) for r in P.sampler_state(spark, sf_dir).collect())
    assert found == replayed(pages, events, P.SEED)


def test_replay_grows_with_the_events():
    """Draws that outnumber the pages, with releases: four times the events and pages take nothing like sixteen times the steps."""
    def looks(n):
        rng = random.Random(n)
        pages = [(at % 4, rng.random(), at, at % 3 == 0) for at in range(n)]
        events = [(seq, X.RELEASE if seq % 5 == 4 else X.DRAW, seq % 3, seq - 2 if seq % 5 == 4 else None) for seq in range(2 * n)]
        steps = 0

        def count(frame, kind, arg):
            nonlocal steps
            steps += kind == "line" and frame.f_code.co_filename == X.__file__
            return count

        before = sys.gettrace()
        sys.settrace(count)
        try:
            X.replay_draws(pages, events)
        finally:
            sys.settrace(before)
        return steps

    assert looks(800) < 6 * looks(200)
