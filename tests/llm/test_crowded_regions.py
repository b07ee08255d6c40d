"""Near copies within a family of texts that share a long passage but aren't linked, with regions far above the cap."""

import random

from corvane.llm import forest


def test_links_within_a_boilerplate_family(texts):
    r = random.Random(11)
    word = lambda: f"v{r.randrange(10**9)}"
    passage, rows = [word() for _ in range(130)], []
    for i in range(200):
        own = [word() for _ in range(35)]
        rows.append((2 * i, " ".join(passage + own), "en", "s", None))
        for k in (7, 15, 23, 31)[: 3 + i % 2]:
            own[k] = word()
        rows.append((2 * i + 1, " ".join(passage + own), "en", "s", None))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t, *_ in rows for w in [t.split()]}
    comp = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {i: new if c == old else c for i, c in comp.items()}
    assert len(set(comp.values())) == 200
    got = {x.doc_id: x.component_id for x in forest.near_duplicates(texts(rows), cap=8).collect()}
    assert got == comp


def test_cells_hold_every_pair_of_components(spark):
    import numpy as np

    common = list(range(1, 9))
    rows = [(i, 0 if i < 30 else i, np.array([*common, 1000 + i], "<u8").tobytes()) for i in range(50)]
    sets = spark.createDataFrame([(i, c, bytearray(s)) for i, c, s in rows], "id long, component long, s binary")
    held = {}
    for x in forest.cells(sets, 75, cap=4).collect():
        held.setdefault(x.region, set()).add(x.id)
    met = {(a, b) for ids in held.values() for a in ids for b in ids if a < b}
    assert {(a, b) for a in range(50) for b in range(max(a + 1, 30), 50)} <= met
    assert max(map(len, held.values())) < 30
