"""Gates of requests for fields: equal to a plain count, and no request meets an instance."""

import random
import re

from corvane.operators import decisions


def plain(requests, wanted, postings, some):
    out = {}
    for q in requests:
        want = {f for r, f in wanted if r == q}
        have = {}
        for f, i in postings:
            have.setdefault(i, set()).add(f)
        unknown = sorted(f for f in want if not any(f in h for h in have.values()))[:5]
        most = max((len(want & h) for h in have.values()), default=0)
        out[q] = decisions.GATES[0] if q not in some else f"{decisions.GATES[1]}: {', '.join(unknown)}" if unknown else decisions.GATES[2] if most < len(want) else None
    return out


def frames(spark, requests, wanted, postings, some):
    make = spark.createDataFrame
    return make([(q,) for q in requests], "query_id long"), make(wanted, "query_id long, field string"), make(postings, "field string, instance_id long"), make([(q,) for q in some], "query_id long")


def test_equals_a_plain_count(spark):
    r = random.Random(3)
    requests = list(range(60))
    wanted = [(q, r.choice("abcdefgh")) for q in requests[:50] for _ in range(r.randrange(4))]
    postings = [(r.choice("abcdefg"), i) for i in range(40) for _ in range(r.randrange(4))]
    some = requests[5:]
    x = decisions.hard_gates(*frames(spark, requests, wanted, postings, some))
    assert {g.query_id: g.reason for g in x.collect()} == plain(requests, wanted, postings, some)


def test_no_pair_of_request_and_instance_is_a_row(spark):
    x = decisions.hard_gates(*frames(spark, [1], [(1, "a")], [("a", 2)], [1]))
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[query_id#\d+L?, instance_id#\d+L?\]", plan)
