import random

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import repetition as R


def naive(words):
    n, seen, hit = len(words), set(), set()
    for i in range(n - 4):
        run = tuple(words[i : i + 5])
        if run in seen:
            hit.update(range(i, i + 5))
        seen.add(run)
    return len(hit)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab c d".split() + ["a"]), max_size=60))
def test_exact(words):
    assert R.repeated_words(R.Doc(" ".join(words)).codes) == naive(words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([f"w{chr(97 + i)}" for i in range(12)]), max_size=40), st.integers(0, 30))
def test_rules_never_reject_wrongly(words, cut):
    words = words + words[:cut]
    doc = R.Doc(" ".join(words))
    if words and naive(words) >= R.THRESHOLD * len(words):
        assert all(rule(doc, R.THRESHOLD) for rule in R.RULES.values())


def test_found(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(100)) for _ in range(20)]
    texts += [" ".join([word() for _ in range(10)] * 5), "Same line here, 1 of many!\n" * 30, "a a a a a a", "", None, "one two three four five", "x " * 300_000, "123 456 !!! " * 50]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, share double")
    want = {i for i, t in enumerate(texts) if t and R.Doc(t).words and naive(R.Doc(t).words) >= R.THRESHOLD * len(R.Doc(t).words)}
    assert {r.doc_id for r in R.find_repetitive(df).collect()} == want and {20, 21, 22, 26} <= want
    m = {r.doc_id: r for r in R.measure(df).collect()}
    assert len(m) == len(texts) and m[24].run_share == 0.0 and m[21].line_share > 0.9 and m[22].n_repeated == 5
    assert R.find_repetitive(df.unionByName(df)).count() == len(want)
    assert R.find_repetitive(df.limit(0)).count() == 0 and R.measure(df.limit(0)).count() == 0


def test_plan_orders_by_rejection_per_cost():
    plan = R.plan_cascade(["a b c d e f g h i j k l"] * 50)
    gains = [r / max(c, 1e-9) for _, c, r in plan]
    assert gains == sorted(gains, reverse=True) and {n for n, _, _ in plan} == set(R.RULES)


def test_words_are_letters():
    assert R.Doc("Größe 12m² ½x_y z").words == ["größe", "m", "x", "y", "z"]
