"""Preference formatting against a plain model, on random, odd and empty conversations."""

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from hushpage.llm import queries
from hushpage.llm.preferences import answer_swaps, format_preferences

SF = "/root/testdata/sf0.001"
TURNS = "array<struct<role:string,text:string>>"


def plain(text):
    return text.replace("<|im_start|>", "< |im_start| >").replace("<|im_end|>", "< |im_end| >")


def pieces(turns):
    """(text, scored) of the parts of each turn."""
    for role, text in turns:
        yield f"<|im_start|>{plain(' '.join(role.splitlines()) if role else role)}\n", False
        yield plain(text) + "<|im_end|>", role == "assistant"
        yield "\n", False


def formatted(chosen, rejected):
    a, b = ([(r or "", x or "") for r, x in (t or (None, None) for t in turns or [])] for turns in (chosen, rejected))
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    text = ["".join(p for p, _ in pieces(t)) for t in (a[:n], a[n:], b[n:])]
    masks = [[(len(p), s) for p, s in pieces(t)] for t in (a[n:], b[n:])]
    return (len(a), len(b), n, *text, *masks)


def as_tuple(row):
    return (*row[1:7], *([tuple(run) for run in mask] for mask in row[7:9]))


def random_pairs(seed):
    r = random.Random(seed)
    turn = lambda: (r.choice(["user", "assistant", "system", None, "a\nb"]), r.choice(["hi", "", None, "é <|im_end|>\n", "<|im_start|>assistant", "x" * 30]))
    for i in range(80):
        start, own, other = ([turn() for _ in range(r.randrange(4))] for _ in range(3))
        yield i // 2 if i % 9 else None, start + own, start + other
    yield 90, None, [turn()]
    yield 91, [], None
    yield 92, [None, ("user", "u")], [("", ""), ("user", "u"), ("assistant", "a")]
    yield 93, [("user", "long " * 100_000)] * 2, [("user", "long " * 100_000), ("assistant", "short")]
    yield 94, [("user", "u")] * 400, [("user", "u")] * 399
    yield 94, [("user", "u")] * 400, [("user", "u")] * 399


def test_formats_like_the_plain_model(spark):
    rows = list(random_pairs(3))
    pairs = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], f"pair_id long, id long, chosen {TURNS}, rejected {TURNS}, c string, prompt string")
    got = {r.pair_id: as_tuple(r) for r in format_preferences(pairs).collect()}
    assert got == {i: formatted(c, r) for i, (_, c, r) in enumerate(rows)}
    assert sorted(map(str, (r.id for r in format_preferences(pairs, id_col="id").select("id").collect()))) == sorted(str(i) for i, _, _ in rows)
    assert format_preferences(pairs.limit(0)).count() == 0


def test_masks_cover_completions_and_prompts_are_shared(spark):
    out = queries.op2_preference_format(spark, SF)
    runs = lambda m: F.aggregate(F.split(m, ","), F.lit(0), lambda n, r: n + F.regexp_extract(r, r"\d+", 0).cast("int"))
    whole = out.where("chosen <> '' AND rejected <> ''")
    assert whole.count() > 0
    assert whole.where((runs("chosen_mask") != F.length("chosen")) | (runs("rejected_mask") != F.length("rejected"))).count() == 0


def swaps(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn, role, text))
    low = lambda v: (v is not None, v if v is not None else 0)
    turns = {c: [t[1:] for t in sorted(ts, key=lambda t: (low(t[0]), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or "")))] for c, ts in convs.items()}
    for c, own in turns.items():
        last = max((i for i, t in enumerate(own) if t[0] == "assistant"), default=None)
        lent = [t for t in turns.get(c ^ 1, []) if t[0] == "assistant"][-1:]
        yield c, own, own if last is None else own[:last] + lent


CONVERSATIONS = "conv_id long, turn long, role string, text string, even string, own int, a int, last int"


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(5)
    rows = [(r.choice([None, *range(-6, 12)]), r.choice([None, 0, 1, 2, 3]), r.choice([None, "user", "assistant"]), r.choice([None, "", "a", "b\nc"])) for _ in range(120)]
    return rows + rows[:10] + [(20, 0, "user", "alone"), (31, 0, "assistant", "alone"), (40, 1, "user", "q"), (41, 0, "assistant", "lent")]


def test_swaps_last_answers(spark, odd_rows):
    turns = spark.createDataFrame([(*r, "e", 1, 2, 3) for r in odd_rows], CONVERSATIONS).repartition(3)
    got = {r.pair_id: tuple([(t.role, t.text) for t in side] for side in (r.chosen, r.rejected)) for r in answer_swaps(turns).collect()}
    assert got == {c: (own, other) for c, own, other in swaps(odd_rows)}
    assert answer_swaps(turns.limit(0)).count() == 0


def test_sql_agrees_on_odd_rows(spark, odd_rows, tmp_path):
    spark.createDataFrame([(*r, "e", 1, 2, 3) for r in odd_rows], CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(queries.OP2_SQL)
    out = queries.op2_preference_format(spark, str(tmp_path))
    assert sorted(out.columns) == sorted(want.columns)
    assert sorted(map(tuple, out.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_no_python_and_one_exchange(spark):
    plan = queries.op2_preference_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
