"""Raking against a plain version and its margins; drawing; odd rows."""

import itertools
import math
import random

import pytest

from effortlab.llm import mixing, queries


def plain_rake(table, targets, rounds=2000):
    """Iterative proportional fitting on a dictionary, margin by margin."""
    fitted = dict(table)
    total = sum(table.values())
    for _ in range(rounds):
        for d, target in enumerate(targets):
            held = {}
            for k, v in fitted.items():
                held[k[d]] = held.get(k[d], 0) + v
            whole = sum(target[n] for n in held)
            fitted = {k: v * target[k[d]] / whole * total / held[k[d]] for k, v in fitted.items()}
    return {k: fitted[k] / table[k] for k in table}


def test_rake_equals_plain_fitting():
    rng = random.Random(4)
    table = {k: rng.uniform(1, 100) for k in itertools.product("ab", "xyz", "pq") if rng.random() > 0.15}
    targets = [{"a": 0.7, "b": 0.3}, {"x": 0.2, "y": 0.5, "z": 0.3}, {"p": 0.5, "q": 0.5}]
    got, want = mixing.rake(list(table.items()), targets), plain_rake(table, targets)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-5) for k in table)


def test_unnamed_values_and_missing_tokens():
    cells = [(("a",), 10.0), (("*",), 30.0)]
    assert mixing.rake(cells, [{"a": 0.5}]) == pytest.approx({("a",): 1.0, ("*",): 1.0})
    assert mixing.rake(cells, [{"a": 1.0, "*": 0.0}]) == pytest.approx({("a",): 4.0, ("*",): 0.0})
    more = [(("a",), 10.0), (("b",), 30.0), (("*",), 60.0)]
    assert mixing.rake(more, [{"a": 0.5, "b": 0.5}]) == pytest.approx({("a",): 2.0, ("b",): 2 / 3, ("*",): 1.0})
    assert mixing.rake(cells, [{"a": 0.25, "gone": 0.5, "*": 0.25}]) == pytest.approx({("a",): 2.0, ("*",): 2 / 3})
    with pytest.raises(ValueError):
        mixing.rake(cells, [{"gone": 1.0}])


def test_margins_that_contradict_each_other(spark):
    """Two cells without a cell between them cannot be 0.5 / 0.5 and 0.9 / 0.1 at once."""
    cells, targets = [(("a", "x"), 10.0), (("b", "y"), 30.0)], [{"a": 0.5, "b": 0.5}, {"x": 0.9, "y": 0.1}]
    with pytest.raises(ValueError, match="contradict"):
        mixing.rake(cells, targets)
    assert mixing.fit(cells, targets)[1] == pytest.approx(0.4, abs=1e-3)
    assert mixing.fit(cells, [targets[0], {"x": 0.5, "y": 0.5}])[1] < 1e-8
    rows = [(i, k[0], k[1], 1) for k, n in cells for i in range(int(n))]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_tokens bigint")
    got = mixing.mix(df, {"source": targets[0], "lang": targets[1]}).select("margin_off").distinct().collect()
    assert [r.margin_off for r in got] == [pytest.approx(0.4, abs=1e-3)]
    assert mixing.mix(df, {"source": targets[0]}).first().margin_off < 1e-8


def test_scarce_cells_do_not_shrink_the_mixture():
    sizes, weights = [1000.0, 1000.0, 1.0], [1.2, 0.76, 40.0]
    assert mixing.scale(sizes, weights) == pytest.approx(1 / 40)
    assert mixing.scale(sizes, weights, 0.05) == pytest.approx(1 / 1.2)
    assert mixing.scale(sizes, weights, 0.01) == pytest.approx(1 / 40)      # 38.8 of 2000 tokens would be missing


def test_topic_and_tokens(spark):
    rows = [(1, "alpha beta alpha gamma", "k"), (2, "gamma alpha", None), (3, None, "k"), (4, "", "k"), (5, "to be 12345 x,y", "k")]
    got = mixing.describe(spark.createDataFrame(rows, "doc_id int, text string, TOPIC string"))
    assert got.columns == ["doc_id", "text", "n_tokens", "topic"]
    out = {r.doc_id: (r.n_tokens, r.topic) for r in got.collect()}
    assert out[1][0] == 4 and out[1][1] == out[2][1] and out[3] == (0, None) and out[4] == (0, None) and out[5] == (4, None)


def test_margins_of_the_draw(spark):
    rng = random.Random(6)
    rows = [(i, "big" if rng.random() < 0.5 else rng.choice("uvw"), rng.choice(["en", "en", "de", None]), rng.randint(1, 50), "x")
            for i in range(20_000)] + [(None, "big", "en", 3, "x"), (5, "u", None, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_tokens bigint, taken string")
    targets = {"source": {"big": 0.3, "u": 0.3, "*": 0.4}, "lang": {"en": 0.4, "de": 0.4, "*": 0.2}}
    got = mixing.mix(df, targets).collect()
    assert len(got) == len(rows) and max(r.probability for r in got) == 1.0
    whole = sum(r.probability * r.n_tokens for r in got)
    drawn = [r for r in got if r.taken]
    for col, target in targets.items():
        for value, share in target.items():
            member = lambda r, c=col, v=value, t=target: (r[c] if r[c] in t else "*") == v
            assert sum(r.probability * r.n_tokens for r in got if member(r)) / whole == pytest.approx(share, abs=1e-6)
            assert sum(r.n_tokens for r in drawn if member(r)) / sum(r.n_tokens for r in drawn) == pytest.approx(share, abs=0.03)
    again = mixing.mix(df.repartition(7), targets)
    assert {r.doc_id for r in again.collect() if r.taken} == {r.doc_id for r in drawn}
    assert mixing.mix(df.limit(0), targets).count() == 0
    assert mixing.mix(df.filter("n_tokens = 0"), targets).count() == 1


def test_tempered_targets(spark):
    """Every source by name; those beyond the most named share what each would get."""
    sizes = {"a": 400, "b": 100, "c": 25, "d": 25, "e": 0}
    rows = [(v, n) for v, size in sizes.items() for n in (size - size // 3, size // 3)] + [("*", 16)]
    df = spark.createDataFrame(rows, "value string, size bigint")
    got = mixing.tempered(df, mixing.Tempered(0.5, 10))
    assert got == pytest.approx({"a": 20 / 44, "b": 10 / 44, "c": 5 / 44, "d": 5 / 44, "*": 4 / 44})
    assert mixing.tempered(df, mixing.Tempered(0.5, 2)) == pytest.approx({"a": 20 / 44, "b": 10 / 44, "*": 14 / 44})
    assert mixing.tempered(df, mixing.Tempered(0.5, 3))["c"] == pytest.approx(5 / 44)
    assert mixing.tempered(df.limit(0), mixing.Tempered()) == {"*": 1.0}


def test_names_of_sources_do_not_matter(spark):
    """The hot source is brought down under any name, and src0 is not lifted."""
    rng = random.Random(8)
    rows = [(i, 0 if rng.random() < 0.4 else rng.randrange(1, 20), rng.choice(["en", "de"]), rng.randint(1, 50), f"t{rng.randrange(8)}")
            for i in range(5_000)] + [(6_000, None, "en", 7, "t1")]
    kept = []
    for rename in (lambda s: s, lambda s: 19 - s, lambda s: s + 500):
        named = [(i, None if s is None else f"src{rename(s)}", lang, n, t) for i, s, lang, n, t in rows]
        df = spark.createDataFrame(named, "doc_id bigint, source string, lang string, n_tokens bigint, topic string")
        got = {r.doc_id: r for r in mixing.mix(df, queries.MIX_TARGETS, shortfall=queries.MIX_SHORTFALL).collect()}
        assert len(got) == len(rows)
        kept.append([got[r[0]].probability for r in rows])
        whole, held = {}, {}
        for r in got.values():
            whole[r.source] = whole.get(r.source, 0) + r.n_tokens
            held[r.source] = held.get(r.source, 0) + r.probability * r.n_tokens
        hot = f"src{rename(0)}"
        assert all(held[hot] / whole[hot] < 0.75 * held[s] / whole[s] for s in whole if s not in (hot, None))
    assert kept[0] == pytest.approx(kept[1]) and kept[0] == pytest.approx(kept[2])


def test_query_equals_plain_fitting(spark):
    got = queries.op6_mixing_ipf(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    table, of = {}, {}
    key = lambda r: (r.source, r.lang if r.lang in queries.MIX_TARGETS["lang"] else "*", r.topic or "*")
    for r in got:
        if r.n_tokens:
            table[key(r)] = table.get(key(r), 0) + r.n_tokens
            of[r.source] = of.get(r.source, 0) + r.n_tokens
    total = sum(table.values())
    targets = [{s: n ** 0.7 for s, n in of.items()}]
    for d, c in ((1, "lang"), (2, "topic")):
        own = sum(v for k, v in table.items() if k[d] == "*") / total
        target = queries.MIX_TARGETS[c]
        held = {n: v for n, v in target.items() if any(k[d] == n for k in table)}
        targets.append({"*": own} | {n: v / sum(held.values()) * (1 - own) for n, v in held.items()})
    want = plain_rake(table, targets, 1000)
    most = next(top for top in sorted(want.values()) if sum(
        table[k] * max(0.0, w - top) for k, w in want.items()) <= queries.MIX_SHORTFALL * total)
    for r in got:
        if r.n_tokens:
            assert r.probability == pytest.approx(min(1.0, want[key(r)] / most), rel=1e-3)


def test_margins_without_any_named_value(spark):
    """No language and no topic known anywhere: both keep what they have, the sources are still raked."""
    assert mixing.rake([(("*",), 30.0)], [{"en": 1.0}]) == pytest.approx({("*",): 1.0})
    assert mixing.rake([(("*",), 30.0), (("en",), 0.0)], [{"en": 1.0}])[("*",)] == pytest.approx(1.0)
    rows = [(i, "big" if i % 3 else "small", None if i % 2 else "zh", "to be or") for i in range(3000)]
    docs = mixing.describe(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string"))
    got = mixing.mix(docs, queries.MIX_TARGETS, shortfall=queries.MIX_SHORTFALL).collect()
    assert len(got) == 3000 and all(r.topic is None for r in got)
    by = {r.source: r.probability for r in got}
    assert by["big"] / by["small"] == pytest.approx(2 ** 0.7 / 2)
