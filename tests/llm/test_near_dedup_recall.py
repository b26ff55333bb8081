"""The pipeline's near dedup on a whole table: pairs by exact Jaccard index, found through an
inverted index of shingles."""

import os
from collections import defaultdict

import pytest

from lexbolt.llm import exact_dedup, simhash
from lexbolt.llm.common import materialize, table

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pairs_at_the_threshold_are_found_and_others_spared(spark):
    docs = materialize(exact_dedup.drop_copies(table(spark, SF, "documents")), "docs")
    sets = {r.doc_id: simhash.shingle_set((r.text or "").encode(), simhash.NEAR_WORDS) for r in docs.select("doc_id", "text").collect()}
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).select("doc_id").collect()}
    holders, shared = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for h in s.tolist():
            holders[h].append(i)
    for ids in holders.values():
        if len(ids) <= 300:  # passages that many documents share make no pair at 0.8 by themselves
            for k, a in enumerate(ids):
                for b in ids[:k]:
                    shared[a, b] += 1
    alike = [(a, b) for (a, b), n in shared.items() if n >= 0.5 * max(len(sets[a]), len(sets[b])) and simhash.jaccard(sets[a], sets[b]) >= 0.8]
    missed = [p for p in alike if p[0] in kept and p[1] in kept]
    near = {x for p in alike for x in p}
    assert len(alike) > 40 and len(missed) <= 0.1 * len(alike)
    assert all(i in near or not len(sets[i]) for i in sets if i not in kept)
