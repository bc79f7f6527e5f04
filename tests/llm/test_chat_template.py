"""Template language, reversible escapes, pages, odd rows."""

import hashlib
import random

import pytest

from effortlab.llm import chat_template as ct
from effortlab.llm import queries


def render(source, messages, **env):
    return "".join(p[0] for p in ct.Template(source).run({"messages": messages, **env}, False) if p)


@pytest.mark.parametrize("source, want", [
    ("a{{ 'b' ~ 1 + 2 }}c", "ab12c"), ("{{ 1 + 2 }}", "3"), ("{{ x.y }}{{ x['y'] | upper }}", "zZ"), ("{{ none }}{{ true }}", "true"),
    ("{% if x.y == 'z' and not false %}1{% else %}2{% endif %}", "1"), ("{% if x.q %}1{% elif 'a' in 'cab' %}3{% endif %}", "3"),
    ("{% set v = ' q ' | trim %}{{ v }}{{ v | length }}", "q1"), ("{{ '\\n' }}", "\n"),
    ("{% for m in messages %}{{ loop.index0 }}{{ m.role }}{% if not loop.last %},{% endif %}{% endfor %}", "0u,1a"),
    ("{{ x.__class__ }}{{ messages.append }}", "")])
def test_language(source, want):
    try:
        assert render(source, [{"role": "u"}, {"role": "a"}], x={"y": "z"}) == want
    except ct.TemplateError:
        assert "__" in source


@pytest.mark.parametrize("bad", ["{{ f(1) }}", "{{ a.__class__ }}", "{% if a %}", "{% endfor %}", "{{ a b }}", "{{ a | nothing }}",
                                 "{% for m in a.b %}{% endfor %}", "{% import os %}", "{{ 'a }}"])
def test_what_is_not_in_the_language_fails(bad):
    with pytest.raises(ct.TemplateError):
        ct.Template(bad)


def test_constants_are_folded():
    tree = ct.Template("a{{ 'b' | upper }}{% if 1 == 2 %}x{% elif 'a' ~ 'b' == 'ab' %}y{% else %}{{ z }}{% endif %}c{{ q and false }}").tree
    assert tree[0] == ("text", "aByc") and len(tree) == 2


def test_guard_is_reversible_and_free_of_controls():
    rng = random.Random(3)
    parts = [*ct.CONTROLS, "\\", "a", "[", "<", "/", "INST]", " ", "\n", "s>", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        held = ct.guard(text)
        assert ct.unguard(held) == text and not any(c in held for c in ct.CONTROLS)


def digest_by_hand(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said),
            hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("page", [ct.PAGE, 40])
def test_round_trip(spark, monkeypatch, page):
    monkeypatch.setattr(ct, "PAGE", page)
    rng = random.Random(page)
    parts = [*ct.CONTROLS, "\\", "hello", " ", "\n", " [/INST]"]
    roles = ["user", "assistant", "system", "tool[END]", "", None]
    rows = [(c, t, rng.choice(roles), rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))]))
            for c in [*range(40), None] for t in range(rng.randint(1, 9))]
    rows += [(500, t, "assistant", "x" * 7) for t in range(2000)] + [(501, 0, "user", "y" * 100_000), (501, 0, "user", "y" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, n_turns int")
    pages = ct.format_conversations(df)
    got = {r.conv_id: r for r in ct.digest(pages).collect()}
    by = {}
    for c, _t, r, x in sorted(rows, key=lambda r: (r[0] or -1, r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest_by_hand(turns), c
    assert sum(r.formatted_chars for r in got.values()) == sum(len(r.formatted) for r in pages.collect())
    assert (pages.filter("conv_id = 500").count() > 1) == (page == 40)
    assert ct.digest(ct.format_conversations(df.limit(0))).count() == 0


def test_query_equals_plain_digests(spark):
    sf = "/root/testdata/sf0.001"
    by = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    by[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op4_chat_template(spark, sf).collect()}
    assert got == {c: digest_by_hand(t) for c, t in by.items()}
