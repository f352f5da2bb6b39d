"""Benchmark items of fewer than five words inside documents of any length."""

from __future__ import annotations

import pytest

from fathomlake.llm.op2_decontamination import contaminated


@pytest.mark.parametrize("bands", [64, 1])
def test_short_items(spark, bands):
    items = {0: "One", 1: "red  Fox", 2: "a b c d", 3: "a b c d e", 4: "red fox", 5: ""}
    docs = {0: "here is one RED fox of many kinds", 1: "redfox a b c d", 2: "red fox", 3: "x a b c d e y", 4: "red a fox b c d", 5: "one", 6: None, 7: "b c"}
    want = set()
    for d, x in docs.items():
        for i, y in items.items():
            a, b = (x or "").lower().split(), y.lower().split()
            if b and any(a[k : k + len(b)] == b for k in range(len(a))):
                want.add((d, i, 1, 1, 1.0))
    got = contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), bands=bands).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and (0, 1, 1, 1, 1.0) in want
