"""Positions of repeated documents against the schedule, by brute force."""

import numpy as np

from corvane.llm import mixing


def test_copies_stand_where_the_schedule_puts_them(texts):
    rows = [(i, "w " * (1 + i % 7), "en", "small" if i < 40 else "vast", None) for i in range(1000)]
    mixed = mixing.mix(texts(rows))
    order = mixing.in_training_order(mixed).collect()
    base = {r.doc_id: r for r in mixed.collect()}
    grid = np.linspace(0, 1, 200_001)
    knots = {k: np.interp(grid, *zip(*s, strict=True)) for k, s in enumerate(mixing.SCHEDULES)}
    area = {k: np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2))) for k, w in knots.items()}
    rounds = {}
    for r in order:
        b = base[r.doc_id]
        share = (b.at + (r.round - 1) * b.source_size) / b.target
        want = np.interp(share * area[b.turn][-1], area[b.turn], grid)
        assert 0 <= r.position <= 1 and abs(r.position - want) < 1e-4
        rounds.setdefault(r.mixed_source, set()).add(r.round)
    assert max(rounds["small"]) > 1 and max(r.position for r in order if r.mixed_source == "small") > 0.9
    assert [r.position for r in order] == sorted(r.position for r in order)
