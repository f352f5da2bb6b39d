"""Keywords of many groups in one pass: the same as looking for each of them."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from fathomlake.functions import rules
from fathomlake.functions.automaton import find_groups, first_group, groups_in


def random_groups(r, n):
    return tuple(tuple("".join(r.choice("ab đê") for _ in range(r.randint(0 if r.random() < 0.05 else 1, 4))) for _ in range(r.randint(0, 4))) for _ in range(n))


def test_against_plain_search(spark):
    r = random.Random(2)
    texts = [None, ""] + ["".join(r.choice("ab đêx") for _ in range(r.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    for n in (1, 3, 12):
        groups = random_groups(r, n)
        want = {i: None if t is None else [k for k, g in enumerate(groups) if any(w in t for w in g)] for i, t in enumerate(texts)}
        got = df.select("id", groups_in(F.col("text"), groups).alias("g"), first_group(F.col("text"), groups).alias("f")).collect()
        assert {x.id: x.g for x in got} == want
        assert {x.id: x.f for x in got} == {i: g[0] if g else None for i, g in want.items()}


def test_time_does_not_follow_the_keywords():
    r = random.Random(4)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20_000))

    def seconds(n):
        groups = tuple((f"k{i}xyz{i}",) for i in range(n))
        find_groups("", groups)  # makes the automaton
        began = time.process_time()
        find_groups(text, groups)
        return time.process_time() - began

    few, many = (min(seconds(n) for _ in range(3)) for n in (10, 10_000))
    assert many < 5 * few + 0.01


def test_one_pass_for_all_rules(spark):
    """Special rules, traffic and situations ask for the same column, and Spark evaluates it once."""
    df = spark.createDataFrame([("mất biển số xe",)], "text string")
    c = F.col("text")
    plan = df.select(rules.special(c), rules.special_tier(c), rules.is_traffic(c), rules.is_situational(c))._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.splitlines() if "ArrowEvalPython" in x)
    assert line.count("find(") == 1


def test_rules_by_automaton_and_by_join(spark):
    r = random.Random(8)
    rule = [(f"r{i}", r.randint(0, 5), ["".join(r.choice("abđ") for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 3))]) for i in range(12)]
    table = spark.createDataFrame(rule, "rule string, priority int, keywords array<string>")
    texts = [(i, "".join(r.choice("abđ ") for _ in range(6))) for i in range(200)] + [(200, None), (201, "")]
    questions = spark.createDataFrame(texts, "qid int, text string")
    want = {}
    for qid, t in texts:
        hits = sorted((p, name) for name, p, words in rule if t is not None and any(w in t for w in words))
        if hits:
            want[qid] = hits[0][1]
    for most in (10_000, 3):
        assert {x.qid: x.rule for x in rules.first_rule(questions, table, most).collect()} == want
    assert rules.first_rule(questions, table.limit(0)).count() == 0
